"""Streaming runs over a table's files, to completion, read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.plans.graph_build import SQL as GROUPS
from kgweave.session import new_folder, table
from kgweave.streaming import ingest as S


def _dirs(spark) -> tuple[str, str]:
    d = new_folder(spark, "stream")
    return f"{d}/out", f"{d}/checkpoint"


def stream_entity_groups(spark, sf_dir):
    """Entity groups from incremental batches of node files."""
    out, checkpoint = _dirs(spark)
    schema = table(spark, sf_dir, "nodes").schema
    S.run_groups(S.new_files(spark, f"{sf_dir}/nodes.parquet*", schema), out, checkpoint).awaitTermination()
    groups = S.merged_groups(spark.read.parquet(out))
    return groups.select("name", "n", *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("types", "descriptions", "chunks")])


def stream_append_log(spark, sf_dir):
    """One row per edge id in an append log."""
    out, checkpoint = _dirs(spark)
    S.run_append(S.new_files(spark, f"{sf_dir}/edges.parquet*", table(spark, sf_dir, "edges").schema).select("id"), "id", out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("id")


def event_windows(spark, sf_dir):
    return S.windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (stream_entity_groups, stream_append_log, event_windows)}

SQL = {
    "stream_entity_groups": GROUPS["entity_exact_groups"],
    "stream_append_log": "select distinct id from edges",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
}
