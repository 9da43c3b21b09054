"""Incremental ingestion with Structured Streaming: new files only, mergeable partial groups, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, path: str, schema, form: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that a checkpoint hasn't seen."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", per_trigger).load(path)


def partial_groups(mentions: DataFrame) -> DataFrame:
    """Partial entity groups: counts and item sets that can be merged later."""
    named = mentions.withColumn("name", F.upper(F.trim("entity_name"))).where("name <> ''")
    return named.groupBy("name").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("entity_types"))).alias("types"), F.array_distinct(F.flatten(F.collect_set("descriptions"))).alias("descriptions"), F.array_distinct(F.flatten(F.collect_set("source_chunks"))).alias("chunks"))


def merged_groups(partials: DataFrame) -> DataFrame:
    """Partial groups of any number of batches put together; each batch counts once, however often it was written."""
    p = partials.dropDuplicates(["batch", "name"])
    base = p.groupBy("name").agg(F.sum("n").alias("n"))
    for c in ("types", "descriptions", "chunks"):
        items = p.select("name", F.explode(c).alias("item")).where("item is not null").distinct().groupBy("name").agg(F.array_sort(F.collect_list("item")).alias(c))
        base = base.join(items, "name", "left")
    return base


def run_groups(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes its partials under its number; a batch that is done again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        partial_groups(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_append(stream: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """An append log with at most one row per key, in one folder per batch. Keys are looked up in the log itself, so the
    stream keeps no state that grows with them; a batch that is done again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates([key])
        if number:
            log = spark.read.schema(batch.schema.add("batch", "int")).option("basePath", out).parquet(out).where(F.col("batch") < number)
            new = new.join(log.select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and type with a watermark: an addition for event streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
