"""Visually identical text with different characters: bring all text to one consistent form (problem 3).

Texts are cut into pieces: runs of characters that are in the consistent form already, and single letters with the
marks and invisible characters on them. Only the different pieces of the second kind, which are few, are exploded to
positioned code points, joined with the broadcast decomposition and look-alike mapping, ordered by class of mark and
recomposed; the texts are then rebuilt by position from the pieces' forms.

Defined results: a null text gives no row in ``consistent_forms`` and null in ``unify``; an empty or blank text is its
own form; case and the number of ordinary spaces stay; very long texts are treated like any other; repeated texts are
worked on once; an empty table gives an empty one; other columns are kept, whatever their names.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kgweave.functions.names import SAFE_CLASS, STROKED, STROKES, code_point_table, mark_rank
from kgweave.session import join_hot, lanes, materialize, small_enough

UNSAFE = f"[^{SAFE_CLASS}]"
#: Marks and invisible characters: they belong to the letter before them.
_ON = r"[\p{M}\p{Cf}]"
PIECE = rf"(?s)(?:[{SAFE_CLASS}](?!{_ON}))+|.{_ON}*"


def mapping(spark: SparkSession) -> DataFrame:
    """(ch, parts): the decomposed, Latin-lettered code points of every character that isn't its own, and of marks.

    About 7,000 rows, whatever the data: it is fixed by Unicode, so it may be broadcast."""
    rows = {chr(code): whole for code, whole in code_point_table()}
    for code in range(0x300, sys.maxunicode + 1):
        if unicodedata.combining(chr(code)):
            rows.setdefault(chr(code), chr(code))
    part = T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("r", T.IntegerType())]))
    schema = T.StructType([T.StructField("ch", T.StringType()), T.StructField("parts", part)])
    return spark.createDataFrame([(ch, [(c, mark_rank(c) if unicodedata.combining(c) else 0) for c in whole]) for ch, whole in rows.items()], schema)


def compositions() -> Column:
    """A constant map from letter + mark to the composed letter, by rule from Unicode's decompositions."""
    pairs = {a + b: c for a, c in STROKED.items() for b in STROKES}
    for code in range(0xC0, 0x2000):
        two = unicodedata.decomposition(chr(code))
        if two and two[0] != "<" and " " in two and unicodedata.normalize("NFC", chr(code)) == chr(code):
            pairs["".join(chr(int(x, 16)) for x in two.split())] = chr(code)
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _compose(letter: Column, marks: Column) -> Column:
    """Canonical composition of one letter with its ordered marks."""
    table = compositions()

    def add(acc, m):
        whole = table[F.concat(acc["s"], m["c"])]
        joins = whole.isNotNull() & ((acc["kept"] == "") | (F.floor(acc["r"] / 2) < F.floor(m["r"] / 2)))
        return F.when(joins, F.struct(whole.alias("s"), acc["kept"].alias("kept"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["s"].alias("s"), F.concat(acc["kept"], m["c"]).alias("kept"), m["r"].alias("r"))
        )

    start = F.struct(letter.alias("s"), F.lit("").alias("kept"), F.lit(0).alias("r"))
    return F.aggregate(marks, start, add, lambda a: F.concat(a["s"], a["kept"]))


def piece_forms(pieces: DataFrame) -> DataFrame:
    """(piece, form) of different pieces: positioned code points, mapping, order of marks, recomposition."""
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("pos", "ch"))
    mapped = points.join(F.broadcast(mapping(pieces.sparkSession)), "ch", "left").select(
        "piece", "pos", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("r"))))).alias("sub", "part")
    )
    in_order = Window.partitionBy("piece").orderBy("pos", "sub")
    lettered = mapped.withColumn("letter", F.sum((F.col("part.r") == 0).cast("int")).over(in_order))
    letters = lettered.groupBy("piece", "letter").agg(
        F.max(F.when(F.col("part.r") == 0, F.col("part.c"))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("part.r") > 0, F.struct(F.col("part.r").alias("r"), "pos", "sub", F.col("part.c").alias("c"))))).alias("marks"),
    )
    composed = letters.select("piece", "letter", _compose(F.coalesce("s", F.lit("")), F.col("marks")).alias("s"))
    return composed.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("letter", "s"))), lambda x: x["s"]), "").alias("form"))


def consistent_forms(texts: DataFrame) -> DataFrame:
    """(text, form) for every different text of the one column ``text`` that isn't in the consistent form."""
    spark = texts.sparkSession
    texts = materialize(texts.where(F.col("text").rlike(UNSAFE)).distinct(), "p3 texts")
    cut = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    pieces = texts.select(F.explode(cut).alias("piece")).where(F.col("piece").rlike(UNSAFE)).distinct()
    forms = materialize(pieces.join(piece_forms(pieces), "piece", "left").select("piece", F.coalesce("form", F.lit("")).alias("form")), "p3 pieces")
    if small_enough(forms, 64):
        forms = F.broadcast(forms)
    # The explode and the broadcast join keep the partitioning by text, so rebuilding moves nothing again.
    placed = texts.repartition(lanes(spark), "text").select("text", F.posexplode(cut).alias("pos", "piece"))
    built = placed.join(forms, "piece", "left").groupBy("text").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("form", "piece").alias("s")))), lambda x: x["s"]), "").alias("form")
    )
    return built.where(F.col("form") != F.col("text"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unify(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns in the consistent form."""
    forms = consistent_forms(_union([df.select(F.col(c).alias("text")) for c in columns]))
    for c in columns:
        f = forms.select(F.col("text").alias("__text"), F.col("form").alias("__form"))
        df = df.join(f, df[c] == f["__text"], "left").withColumn(c, F.coalesce("__form", c)).drop("__text", "__form")
    return df


def inconsistent_values(tables: dict[str, tuple[DataFrame, list[str]]], id_column: str = "id") -> DataFrame:
    """(table_name, id, field_name, value, form) of every value that isn't in the consistent form."""
    values = _union(
        [
            df.select(F.lit(name).alias("table_name"), F.col(id_column).alias("id"), F.lit(c).alias("field_name"), F.col(c).alias("text")).where(F.col(c).rlike(UNSAFE))
            for name, (df, columns) in tables.items()
            for c in columns
        ]
    )
    values = materialize(values, "p3 values")
    forms = consistent_forms(values.select("text"))
    # One text may be a large part of all values.
    return join_hot(values, forms, "text").select("table_name", "id", "field_name", F.col("text").alias("value"), "form")
