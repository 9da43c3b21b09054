"""Best representative of each duplicate group (problem 4): field-by-field survivorship in one aggregation.

Records are the same if their names read the same (kgweave.functions.names). For every attribute the aggregation takes
the maximum of a composite struct (how much it holds, trust of the source, time, value), so that a hot name is combined
on the map side and never gathered.

Defined results: a null or blank name takes part in no group; null is the worst value of anything; items that are null,
blank or placeholders, and repeats but for case and spacing, don't count; an unknown extractor has no trust; rows given
twice count once; where no record is best on all attributes the first by their order survives; records that tie on
all give the smallest id; empty tables give empty ones; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.names import name_key

# Items that say nothing.
PLACEHOLDERS = ["", "-", "--", "...", "?", "N/A", "NA", "NULL", "NONE", "UNKNOWN", "KHÔNG RÕ", "CHƯA RÕ", "CHƯA CẬP NHẬT", "KHÔNG CÓ MÔ TẢ"]


def informative(items: Column) -> Column:
    """The different items that say something, case and spacing aside; empty for null."""
    plain = F.transform(items, lambda x: F.upper(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    return F.array_distinct(F.filter(F.coalesce(plain, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.isin(PLACEHOLDERS)))


def scored(nodes: DataFrame, extractors: DataFrame) -> DataFrame:
    """One row per record with its key and what its attributes are worth. The list of extractors is fixed and small."""
    trust = extractors.groupBy("extractor").agg(F.max("trust").alias("trust"))
    rows = nodes.select("id", name_key("entity_name").alias("key"), "entity_name", "entity_types", "descriptions", "occurrence_count", "extracted_at", "extractor")
    return (
        rows.where("key is not null and key <> ''")
        .join(trust, "extractor", "left")
        .withColumn("n_descriptions", F.size(informative(F.col("descriptions"))))
        .withColumn("n_types", F.size(informative(F.col("entity_types"))))
    )


_FIVE = ["n_descriptions", "n_types", "occurrence_count", "extracted_at", "trust"]


def _top(value: str, *then: Column | str) -> Column:
    """The maximum of a field's composite struct: not null, then the value, then what decides between equal ones."""
    return F.max(F.struct(F.col(value).isNotNull().alias("there"), F.col(value).alias("value"), *then))


def best_records(nodes: DataFrame, extractors: DataFrame) -> DataFrame:
    """(key, id, dominates): of each name held by several records, the one that survives.

    For every field the aggregation takes the maximum of its composite struct, and the record that is first by all
    fields in the order of _FIVE, with the smaller id of equal ones. ``dominates`` tells whether that record holds the
    maximum of every field, that is, is at least as good as every other on all five; if any record does, it is this one."""
    s = scored(nodes, extractors)
    fields = F.struct(*_FIVE, (-F.col("id")).alias("minus_id"))
    best = s.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(fields).alias("best"), *(_top(c).alias(c) for c in _FIVE))
    on_all = reduce(lambda a, b: a & b, (F.col(f"best.{c}").eqNullSafe(F.col(f"{c}.value")) for c in _FIVE))
    return best.where("first <> last").select("key", (-F.col("best.minus_id")).alias("id"), on_all.alias("dominates"))


def built_records(nodes: DataFrame, extractors: DataFrame) -> DataFrame:
    """One record built per name: for each field the fullest, then most trusted, then latest value."""
    s = scored(nodes, extractors)

    def best(value: str, worth: Column) -> Column:
        return F.max(F.struct(worth.alias("w"), "trust", "extracted_at", F.col(value).alias("v")))["v"].alias(value)

    return s.groupBy("key").agg(
        best("entity_name", F.lit(1)),
        best("descriptions", F.col("n_descriptions")),
        best("entity_types", F.col("n_types")),
        best("occurrence_count", F.col("occurrence_count")),
        F.max("extracted_at").alias("extracted_at"),
        F.max("trust").alias("trust"),
        F.countDistinct("id").alias("n_records"),
    )
