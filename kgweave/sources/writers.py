"""Writers: Parquet as the form between stages, JSON, CSV and GraphML for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def json_lines_to_parquet(spark: SparkSession, source: str, target: str, schema: str | None = None) -> DataFrame:
    df = (spark.read.schema(schema) if schema else spark.read).json(source)
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def json_array(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """One file that holds a JSON array of the rows; for reports. ValueError beyond most_rows: use json_lines then."""
    n = df.limit(most_rows + 1).count()
    if n > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    rows = df.coalesce(1).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"), F.monotonically_increasing_id().alias("k"))
    ends = df.sparkSession.createDataFrame([("[" if n else "[]", -1)] + ([("]", 1 << 62)] if n else []), "j string, k bigint")
    comma = F.when((F.col("k") >= 0) & (F.col("k") < n - 1), ",").otherwise("")
    ends.unionByName(rows).coalesce(1).sortWithinPartitions("k").select(F.concat("j", comma).alias("value")).write.mode("overwrite").text(path)


def excel(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """A sheet for readers, written on the driver; needs an installed Excel writer of pandas. ValueError beyond most_rows."""
    rows = flat(df).limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    rows.to_excel(path, index=False)


def csv_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header that starts with a byte order mark; for reports, which are small."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def flat(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def _escaped(c) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): GraphML elements of vertices(name, ...) and edges(a, b, ...); head and foot are parts 0 and 9."""

    def data(df: DataFrame, skip: set[str]):
        return [F.concat(F.lit(f'<data key="{c}">'), _escaped(F.col(c)), F.lit("</data>")) for c in df.columns if c not in skip]

    v, e = flat(vertices), flat(edges)
    nodes = v.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _escaped(F.col("name")), F.lit('">'), *data(v, {"name"}), F.lit("</node>")).alias("line"))
    links = e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _escaped(F.col("a")), F.lit('" target="'), _escaped(F.col("b")), F.lit('">'), *data(e, {"a", "b"}), F.lit("</edge>")).alias("line"))
    spark = vertices.sparkSession
    ends = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'), (9, "</graph></graphml>")], "part int, line string")
    return ends.unionByName(nodes).unionByName(links)


def graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    graphml_lines(vertices, edges).repartitionByRange(4, "part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)
