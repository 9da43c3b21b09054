"""Readers of the file shapes the pipeline takes in. Schemas are given, never inferred, where a caller has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, content string, metadata struct<source_file string, token_count int, header_context string, title string, publisher string, source_type string, published_date string, file_name string, url string, split_order int>"
NODE = "id bigint, entity_name string, entity_types array<string>, descriptions array<string>, source_chunks array<string>, occurrence_count bigint"
EDGE = "id bigint, source string, target string, descriptions array<string>, weight double, source_chunks array<string>"
REPORT = "community_id bigint, title string, summary string, rating double, rating_explanation string, findings array<struct<summary string, explanation string>>, level int, token_count int"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file, or a directory of files, that hold a JSON array or one object each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str, bad: str = "DROPMALFORMED") -> DataFrame:
    """JSON lines; blank lines don't count; bad lines are dropped, or kept in _corrupt_record (bad='PERMISSIVE')."""
    extra = ", _corrupt_record string" if bad == "PERMISSIVE" else ""
    return spark.read.schema(schema + extra).option("mode", bad).json(path)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every Markdown file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of files such as PDFs; a provider makes text of them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def csv(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """A CSV file with a header; ValueError if a required column is missing."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def excel(spark: SparkSession, path: str) -> DataFrame:
    """A small metadata sheet, read on the driver; needs an installed Excel reader of pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str))
