"""References to records that do not exist (problem 5): orphan references, row by row and per table, field and period.

References are pre-aggregated per key and period. Keys that hold more than a fair share of the references are few by
construction (at most 1/share of them), so their presence is broadcast after a check of its size and their references
stay where they are; all other keys take a shuffled join. The two orphan sets are united.

A reference at time t is an orphan if no record with its key has loaded_at <= t and (deleted_at null or > t).

Defined results: null and blank references aren't references; a reference without a time is an orphan only if its key
never had a record; records with a null loaded_at are never present; a record deleted at or before its load is never
present; equal times count as present; repeated rows give one result; an empty records table makes every reference an
orphan, an empty references table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.session import lanes, materialize, small_enough

#: Parts that the records of one key and day are split into.
LANES = 16
_SPANS = "array<struct<a:timestamp_ntz,b:timestamp_ntz>>"


def _merged(spans: Column) -> Column:
    """Disjoint spans from sorted ones."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (s["a"] <= F.try_element_at(acc, F.lit(-1))["b"]), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPANS), step)


def presence(records: DataFrame) -> DataFrame:
    """(key, since, spans): present for ever since ``since``, and during the disjoint spans before it.

    Spans are merged first per key, day of loading and lane, then per key and day, then per key, so that a hot key's
    records are never gathered whole, nor those of one of its days: what meets in one place are the gaps between merged
    spans."""
    r = records.where("key is not null and loaded_at is not null and (deleted_at is null or deleted_at > loaded_at)")
    kept = F.when(F.col("deleted_at").isNotNull(), F.struct(F.col("loaded_at").alias("a"), F.col("deleted_at").alias("b")))
    lane = F.pmod(F.xxhash64("loaded_at", "deleted_at"), F.lit(LANES))
    first = r.groupBy("key", F.date_trunc("day", "loaded_at").alias("day"), lane.alias("lane")).agg(
        F.min(F.when(F.col("deleted_at").isNull(), F.col("loaded_at"))).alias("since"), _merged(F.array_sort(F.collect_set(kept))).alias("spans")
    )
    days = first.groupBy("key", "day").agg(F.min("since").alias("since"), _merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    whole = days.groupBy("key").agg(F.min("since").alias("since"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return whole.select("key", "since", _merged(F.filter("spans", lambda s: F.col("since").isNull() | (s["a"] < F.col("since")))).alias("spans"))


def _orphan(t: Column) -> Column:
    """Whether a reference at t, joined on the left with presence, is an orphan."""
    there = F.coalesce(F.col("__since") <= t, F.lit(False)) | F.exists("__spans", lambda s: (s["a"] <= t) & (s["b"] > t))
    return F.col("__spans").isNull() | (t.isNotNull() & ~there)


def orphan_references(references: DataFrame, records: DataFrame, share: float = 0.005, check_heavy: bool = True) -> DataFrame:
    """The rows of references(key, at, ...) that are orphans, all columns kept.

    references: column ``key`` (null or blank: not a reference) and timestamp ``at``; records: ``key``, ``loaded_at``,
    ``deleted_at``. share: a key with more than this share of all references is heavy, so at most 1/share keys are."""
    references = materialize(references.where("key is not null and trim(key) <> ''"), "references")
    there = presence(records).withColumnsRenamed({"since": "__since", "spans": "__spans"})
    counts = references.groupBy("key", F.date_trunc("month", "at").alias("period")).agg(F.count("*").alias("n"))
    per_key = counts.groupBy("key").agg(F.sum("n").alias("n"))
    heavy = [r["key"] for r in per_key.where(F.col("n") > F.lit(max(1, references.count() * share))).select("key").collect()]
    if heavy:
        is_heavy = F.col("key").isin(heavy)
        light_refs, heavy_refs, heavy_there = references.where(~is_heavy), references.where(is_heavy), materialize(there.where(is_heavy), "heavy")
        if not check_heavy or small_enough(heavy_there, 4096):
            heavy_there = F.broadcast(heavy_there)
        heavy_orphans = heavy_refs.join(heavy_there, "key", "left").where(_orphan(F.col("at"))).drop("__since", "__spans")
    else:
        light_refs = references
    light = light_refs.join(there.hint("shuffle_hash"), "key", "left").where(_orphan(F.col("at"))).drop("__since", "__spans")
    return light.unionByName(heavy_orphans) if heavy else light


def orphan_report(orphans: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """Orphan and total references per ``by`` columns and month of ``at``."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    total = references.where("key is not null and trim(key) <> ''").groupBy(*by, period).agg(F.count("*").alias("n_references"), F.countDistinct("key").alias("n_keys"))
    lost = orphans.groupBy(*by, period).agg(F.count("*").alias("n_orphans"), F.countDistinct("key").alias("n_orphan_keys"))
    return total.join(lost, [*by, "period"], "left").na.fill(0, ["n_orphans", "n_orphan_keys"])


def edge_references(edges: DataFrame, key) -> DataFrame:
    """(id, side, key, at) of both ends of every edge; key makes the key of a name column."""
    ends = edges.select("id", F.col("loaded_at").alias("at"), F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("name")) for s in ("source", "target")))).alias("end"))
    return ends.select("id", F.col("end.side").alias("side"), "at", key(F.col("end.name")).alias("key")).where("key is not null and key <> ''")
