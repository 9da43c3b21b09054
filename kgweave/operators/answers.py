"""Global questions: map over packed reports, scored points, reduce to one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.functions.text import first_object, model_text
from kgweave.operators.budget import packed, prefix
from kgweave.providers import REFUSAL, Complete, Offline, complete

POINTS = "struct<points:array<struct<description:string,score:double>>>"


def parsed_points(answer: Column) -> Column:
    """The points of a model's answer that have a description and a score above 0; empty if it can't be read."""
    read = F.from_json(first_object(model_text(answer)), POINTS)["points"]
    return F.filter(F.coalesce(read, F.array().cast("array<struct<description:string,score:double>>")), lambda p: p["description"].isNotNull() & (p["score"] > 0))


def top_score(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p["score"].cast("int")))


def report_markdown(title: Column, summary: Column, findings: Column) -> Column:
    """findings: array of struct(summary, explanation)."""
    items = F.array_join(F.transform(findings, lambda f: F.concat(F.lit("- "), f["summary"], F.lit(": "), f["explanation"])), "\n")
    return F.concat(F.lit("### "), title, F.lit("\n"), summary, F.when(F.size(findings) > 0, F.concat(F.lit("\n"), items)).otherwise(F.lit("")), F.lit("\n---\n"))


def ranked_context(points: DataFrame, limit: int = 21_000) -> DataFrame:
    """points(key, description, score) -> numbered texts, best first, up to the first that goes beyond the limit."""
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "description"))
    text = F.concat(F.lit("#"), F.col("k").cast("string"), F.lit(" ("), F.col("score").cast("int").cast("string"), F.lit(")\n"), "description", F.lit("\n\n"))
    numbered = points.withColumn("k", k).withColumn("text", text)
    return prefix(numbered.where(F.col("k") <= limit), "key", ["k"], F.length("text"), limit)


def ask_global(spark: SparkSession, reports: DataFrame, question: str, provider: Complete | None = None, limit: int = 3500) -> str:
    """The answer to one question over reports(id, text, tokens). One prefix of at most 21,000 characters comes to the driver."""
    if not question.strip():
        raise ValueError("the question is blank")
    bins = packed(reports.select("id", "tokens"), limit)
    texts = bins.join(reports.select("id", "text"), "id").groupBy("lane", "bin").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("context"))
    prompts = texts.select("bin", F.concat(F.lit(question + "\n---\n"), "context").alias("prompt"))
    found = complete(prompts, "prompt", "answer", provider or Offline()).select(F.explode(parsed_points(F.col("answer"))).alias("p")).select(F.lit(1).alias("key"), "p.description", "p.score")
    lines = [r["text"] for r in ranked_context(found).orderBy("k").collect()]
    return "".join(lines).strip() if lines else REFUSAL
