"""Local search: keyword and vector branches, one hop around the best, context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.operators.resolve import dot


def cosine_to(vectors: DataFrame, query: list[float], name: str = "score") -> DataFrame:
    """vectors(id, embedding) with ((1 + cosine) / 2) to the query, rounded to six places."""
    import math

    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    own = F.sqrt(dot("embedding", "embedding"))
    return vectors.withColumn(name, F.round((1 + dot("embedding", q) / (own * norm)) / 2, 6))


def vector_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    return cosine_to(vectors, query).orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def keyword_top(names: DataFrame, term: str, k: int = 3) -> DataFrame:
    """names(id, name) that contain the term whatever the case; score 1."""
    return names.where(F.lower("name").contains(term.lower())).orderBy("name", "id").limit(k).select("id", F.lit(1.0).alias("score"))


def hybrid(branches: list[DataFrame], k: int) -> DataFrame:
    """The best score per id over all branches, and the k best."""
    both = branches[0]
    for b in branches[1:]:
        both = both.unionByName(b)
    return both.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def top_per(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def one_hop(centres: DataFrame, links: DataFrame, k: int = 15) -> DataFrame:
    """(id, score, neighbours): of each centre its k strongest links(x, y, w) of either direction; centres without stay."""
    near = links.join(centres.select(F.col("id").alias("x")), "x")
    best = top_per(near, "x", [F.desc("w"), F.col("y")], k)
    lists = best.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("rank", "y", "w"))).alias("near"))
    return centres.join(lists, centres["id"] == lists["x"], "left").select("id", "score", F.coalesce("near", F.array().cast("array<struct<rank:int,y:bigint,w:bigint>>")).alias("near"))


def context_text(found: DataFrame) -> DataFrame:
    """(rank, entity, score, n_relationships, context) of found(id, score, near), best first."""
    w = Window.orderBy(F.desc("score"), "id")  # at most k rows
    ranked = found.withColumn("rank", F.row_number().over(w))
    lines = F.array_join(F.transform("near", lambda n: F.concat(F.lit("- V"), n["y"].cast("string"), F.lit(" ("), n["w"].cast("string"), F.lit(")"))), "\n")
    head = F.concat(F.lit("=== ["), F.col("rank").cast("string"), F.lit("] V"), F.col("id").cast("string"), F.lit(" ("), F.format_string("%.6f", "score"), F.lit(") ===\n"))
    body = F.when(F.size("near") == 0, "no relationships").otherwise(lines)
    return ranked.select("rank", F.concat(F.lit("V"), F.col("id").cast("string")).alias("entity"), "score", F.size("near").alias("n_relationships"), F.concat(head, body).alias("context"))
