"""Mixing sources to target weights (problem 7): pivotal dependent rounding.

Each source gets a rate, the mean number of copies of its records, so that it makes up its weight of the total size;
a rate never exceeds the source's max_repeats, and what sources that are too small or empty leave open goes to the
others in proportion to their weights. Rates are not whole numbers, so every record gets the whole part, and the
fractions are rounded by pairs: mass moves at random from one record to the other, in proportion to their sizes, until
one fraction is 0 or 1. The size of the source is kept exactly by every move and the expectation of every record's
copies is its rate. Records meet in small groups of (source, lane); the one record that each group leaves open goes
up a reduction tree of fan-in FAN until one is left per source, which is rounded alone, so a source ends within one
record of its size.

Random numbers depend on ids and the seed only: the result doesn't depend on how rows are spread, or on tasks rerun.

Defined results: records with a null source, a source without a target, or an empty or null text (no tokens) get no
copies; a source without records has a share of 0 in the report; sources repeated in the targets count once, with
their largest weight; null weights and repeats count as 0; empty tables give empty ones; records are rows with a
different id (of repeated rows one counts); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.llm.tokens import token_count
from kgweave.session import materialize

#: Records of one group, about, and groups that meet in one node of the tree.
GROUP, FAN = 20_000, 64
EPS = 1e-9


def sizes(documents: DataFrame, model: Broadcast) -> DataFrame:
    """(doc_id, source, size) of every record with a source and tokens; written once, as counting is the dear part."""
    counted = documents.where("source is not null and text <> ''").select("doc_id", "source", token_count("text", model).alias("size"))
    return materialize(counted.where("size > 0").dropDuplicates(["doc_id"]), "p7 sizes")


def rates(held: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, float]]:
    """{source: (rate, wanted share)}: shares by weight, filled up to max_repeats, the rest by weight among the others.

    total: the size of the mixture, by default the size of all records of the targets' sources."""
    have = dict(held)
    want: dict[str, tuple[float, int]] = {}
    for s, w, m in targets:
        if s is not None and (s not in want or (w or 0) > want[s][0]):
            want[s] = (w or 0.0, m or 0)
    whole = sum(w for w, _ in want.values()) or 1.0
    left = float(total if total is not None else sum(have.get(s, 0) for s in want))
    size = dict.fromkeys(want, 0.0)
    active = {s for s, (w, m) in want.items() if have.get(s) and w > 0 and m > 0}
    while active and left > EPS:
        unit = left / sum(want[s][0] for s in active)
        full = {s for s in active if want[s][0] * unit >= want[s][1] * have[s]}
        for s in full or active:
            size[s] = float(want[s][1] * have[s]) if full else want[s][0] * unit
        left -= sum(size[s] for s in full or active)
        active = active - full if full else set()
    return {s: (size[s] / have[s] if have.get(s) else 0.0, w / whole) for s, (w, _) in want.items()}


def _random(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id (splitmix64)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pivotal(ids: np.ndarray, p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """p with all but at most one entry 0 or 1, and the same sum of p * size.

    Records that are open, by size, meet in pairs, all pairs of a level at once; each leaves at most one open for the
    next level. Every move keeps the pair's size and both expectations.
    """
    p = np.round(p, 12)
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
    left, level = np.lexsort((ids, -size)), 0
    left = left[(p[left] > 0) & (p[left] < 1)]
    while len(left) > 1:
        i, j = left[:-1:2], left[1::2]
        si, sj = size[i], size[j]
        up, down = np.minimum((1 - p[i]) * si, p[j] * sj), np.minimum(p[i] * si, (1 - p[j]) * sj)
        move = np.where(_random(ids[i], seed + 1000 * level) * (up + down) < down, up, -down)
        p[i], p[j] = p[i] + move / si, p[j] - move / sj
        met = left[: 2 * len(j)]
        p[met] = np.where(p[met] < EPS, 0.0, np.where(p[met] > 1 - EPS, 1.0, p[met]))
        left, level = left[(p[left] > 0) & (p[left] < 1)], level + 1
    return p


_SCHEMA = "doc_id bigint, source string, size int, whole int, p double, lane bigint"


def _round_groups(df: DataFrame, seed: int) -> DataFrame:
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id", kind="stable")
        return g.assign(p=pivotal(g["doc_id"].to_numpy(), g["p"].to_numpy(float).copy(), g["size"].to_numpy(float), seed))

    return df.groupBy("source", "lane").applyInPandas(one, _SCHEMA)


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, copies) of every record used at least once. sized: (doc_id, source, size), written.

    The targets, and one row per source of theirs, come to the driver: the list of sources to mix is small."""
    wanted = [tuple(r) for r in targets.select("source", "weight", "max_repeats").collect()]
    held = sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    rate = rates([(r[0], r[1]) for r in held], wanted, total)
    lanes = {r[0]: max(1, -(-r[2] // GROUP)) for r in held}
    plan = sized.sparkSession.createDataFrame([(s, r, lanes[s]) for s, (r, _) in rate.items() if r > 0], "source string, rate double, lanes bigint")
    rows = sized.join(F.broadcast(plan), "source").select(
        "doc_id",
        "source",
        "size",
        F.floor(F.col("rate") + EPS).cast("int").alias("whole"),
        F.greatest(F.col("rate") - F.floor(F.col("rate") + EPS), F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("doc_id"), "lanes").alias("lane"),
    )
    rounded = materialize(_round_groups(rows, seed), "p7 rounded")
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    done, rest, width = rounded.where(~is_open), rounded.where(is_open), max(lanes.values(), default=1)
    while width > 1:
        width = -(-width // FAN)
        rest = materialize(_round_groups(rest.withColumn("lane", F.floor(F.col("lane") / FAN)), seed + width), "p7 rest")
        done, rest = done.unionByName(rest.where(~is_open)), rest.where(is_open)
    coin = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    done = done.unionByName(rest.withColumn("p", (coin < F.col("p")).cast("double")))
    return done.select("doc_id", "source", "size", (F.col("whole") + F.round("p").cast("int")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: records and tokens used, most copies, the share reached and the share wanted."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.col("size") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    want = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    return (
        want.join(got, "source", "left")
        .na.fill(0, ["n_records", "n_tokens", "most_copies"])
        .withColumn("all", F.sum("n_tokens").over(Window.partitionBy()))
        .select("source", "n_records", "n_tokens", "most_copies", F.round("weight", 6).alias("wanted_share"), F.round(F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"))
    )
