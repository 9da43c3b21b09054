"""Entity and relationship groups, name mappings, and repairs of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.session import materialize

SEP = "|"


def joined_set(items: Column) -> Column:
    """The different non-null items of a group, sorted, as one string."""
    return F.array_join(F.array_sort(F.collect_set(items)), SEP)


def _with_sets(df: DataFrame, keys: list[str], columns: dict[str, str], sums: dict[str, Column]) -> DataFrame:
    """One row per keys: sums, and of each array column the different items, sorted, as one string.

    One pass for all columns: a row becomes one row for its sums and one for each item, which are de-duplicated and added
    up on the map side before anything is gathered."""
    nothing = F.array().cast("array<struct<c:int,item:string>>")

    def numbered(k: int, column: str) -> Column:
        return F.coalesce(F.transform(column, lambda x: F.struct(F.lit(k).alias("c"), x.alias("item"))), nothing)

    items = [numbered(k, c) for k, c in enumerate(columns)]
    own = F.array(F.struct(F.lit(-1).alias("c"), F.lit(None).cast("string").alias("item")))
    spread = df.select(*keys, *[s.alias(n) for n, s in sums.items()], F.explode(F.concat(own, *items)).alias("x")).where("x.c < 0 or x.item is not null")
    once = spread.groupBy(*keys, "x").agg(*[F.sum(n).alias(n) for n in sums])
    whole = [F.sum(F.when(F.col("x.c") < 0, F.col(n))).alias(n) for n in sums]
    sets = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("x.c") == k, F.col("x.item")))), SEP).alias(alias) for k, alias in enumerate(columns.values())]
    return once.groupBy(*keys).agg(*whole, *sets)


def entity_groups(mentions: DataFrame) -> DataFrame:
    """One row per upper-cased, trimmed name: sets of types, descriptions and chunks, and the number of mentions."""
    named = mentions.withColumn("name", F.upper(F.trim("entity_name"))).where("name <> ''")
    return _with_sets(named, ["name"], {"entity_types": "types", "descriptions": "descriptions", "source_chunks": "chunks"}, {"n": F.lit(1)})


def relation_groups(edges: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per pair of names, ordered as given or not: summed weight (1 if missing), chunks; no self loops."""
    a, b = F.upper(F.trim("source")), F.upper(F.trim("target"))
    ends = edges.select(a.alias("a"), b.alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"), "source_chunks").where("a <> '' and b <> '' and a <> b")
    if not ordered:
        ends = ends.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return _with_sets(ends, ["a", "b"], {"source_chunks": "chunks"}, {"weight": F.col("w"), "n": F.lit(1)})


def mapped_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes(name, n) after mapping(name, targets): kept if absent, dropped if empty, fanned out if several."""
    out = nodes.join(mapping, "name", "left").select(F.explode(F.coalesce("targets", F.array("name"))).alias("name"), "n")
    return out.groupBy("name").agg(F.sum("n").alias("n"))


def mapped_groups(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """As mapped_nodes, with what the nodes of a name hold united: types, descriptions, chunks."""
    out = nodes.join(mapping, "name", "left").withColumn("name", F.explode(F.coalesce("targets", F.array("name"))))
    return _with_sets(out, ["name"], {"entity_types": "types", "descriptions": "descriptions", "source_chunks": "chunks"}, {"n": F.col("n")})


def mapped_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges(a, b, w) with both ends mapped on their own, unordered, self loops dropped, weights summed."""
    for end in ("a", "b"):
        m = mapping.select(F.col("name").alias(end), F.col("targets").alias("t"))
        edges = edges.join(m, end, "left").withColumn(end, F.explode(F.coalesce("t", F.array(end)))).drop("t")
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))


def endpoints(edges: DataFrame, a: str = "source", b: str = "target", *others: str) -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("name"), *others)


def healed_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes(name) and, for end points that have none, an UNKNOWN node with the chunks of the first edge that names it."""
    ends = endpoints(edges, "source", "target", "id", "source_chunks").where("name is not null")
    lost = ends.join(nodes.select("name").distinct(), "name", "left_anti")
    made = lost.groupBy("name").agg(F.min_by(F.array_join("source_chunks", SEP), "id").alias("chunks"))
    return made.select("name", F.lit("UNKNOWN").alias("type"), F.lit(1).alias("n"), F.coalesce("chunks", F.lit("")).alias("chunks"))


def anchored_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges both of whose ends are among names(name), one per ordered pair (the last by id)."""
    known = names.select("name").distinct()
    kept = edges.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    return kept.groupBy("source", "target").agg(F.max("id").alias("id"), F.max_by("weight", "id").alias("weight"))


def last_written(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in order."""
    cols = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that aren't unique."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of todo whose key isn't done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def preferred(current: DataFrame, prior: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the prior value if it is there and not marked truncated, else the current one."""
    p = prior.select(key, F.col(value).alias("__prior"), "truncated")
    merged = current.join(p, key, "left")
    keep = F.col("__prior").isNotNull() & ~F.coalesce("truncated", F.lit(False))
    return merged.select(key, F.when(keep, F.col("__prior")).otherwise(F.col(value)).alias(value), keep.alias("kept"))


def dense_ids(df: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Ids from 1 in order: range-partitioned sort, then each partition's offset; no partition holds everything."""
    placed = df.orderBy(order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    placed = materialize(placed, "dense ids")
    # One row per partition comes together: bounded by the number of partitions.
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("__first"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return placed.join(F.broadcast(starts), "__p").withColumn(name, F.col("__m") - F.col("__first") + F.col("__start") + 1).drop("__p", "__m", "__first", "__start")
