"""Documents as ordered lines and pages; order-dependent rules as windows within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.functions.text import ROMAN_LINE, corrected, heading_level, is_upper, plain_line


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of the lines that hold a visible character."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).where(F.col("line").rlike(r"[\p{L}\p{N}\p{P}\p{S}]"))


def levelled(ls: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with whether a roman-numbered heading came before them, their level and their plain text."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = plain_line(F.col("line"))
    roman = is_upper(t) & t.rlike(ROMAN_LINE)
    seen = ls.withColumn("roman_before", F.coalesce(F.max(roman).over(before), F.lit(False)))
    return seen.withColumns({"level": heading_level(F.col("line"), F.col("roman_before")), "title": t})


def with_headers(ls: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each line with its level and the headings it stands under; a new first-level heading ends the second-level one."""
    w = Window.partitionBy(key).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = levelled(ls, key)
    runs = marked.withColumns({"h1": F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(so_far), "run": F.sum((F.col("level") == 1).cast("int")).over(so_far)})
    in_run = Window.partitionBy(key, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h2 = F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(in_run)
    joined = F.concat(F.coalesce("h1", F.lit("")), F.lit(" > "), F.coalesce(h2, F.lit("")))
    return runs.select(key, "pos", "level", F.btrim(joined, F.lit(" >")).alias("context"))


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with wrong characters corrected and headings marked."""
    fixed = docs.where(F.col(text).isNotNull()).select(key, corrected(F.col(text)).alias("text"))
    ls = levelled(fixed.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")), key)
    marked = F.concat(F.repeat(F.lit("#"), "level"), F.when(F.col("level") > 0, F.lit(" ")).otherwise(""), "title")
    built = ls.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", marked.alias("s")))).alias("l"))
    return built.select(key, F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("text"))


# What the page of abbreviations holds, and what makes it a table of contents.
ABBREVIATION_PAGE = "TỪ VIẾT TẮT|DANH MỤC CÁC TỪ VIẾT TẮT|KÝ HIỆU CHỮ VIẾT TẮT|DANH MỤC TỪ VIẾT TẮT|CÁC CHỮ VIẾT TẮT|DANH MỤC KÝ HIỆU|DANH MỤC VIẾT TẮT|BẢNG CÁC CHỮ VIẾT TẮT"
CONTENTS_PAGE = "MỤC LỤC|NỘI DUNG"


def first_page_with(pages: DataFrame, want: str = ABBREVIATION_PAGE, avoid: str = CONTENTS_PAGE, among: int = 50, key: str = "doc_id") -> DataFrame:
    """Pages from the first, among the first ``among``, that matches ``want`` and not ``avoid``; all if there is none."""
    ok = F.upper("line").rlike(want) & ~F.upper("line").rlike(avoid) & (F.col("pos") < among)
    start = pages.groupBy(key).agg(F.coalesce(F.min(F.when(ok, F.col("pos"))), F.lit(0)).alias("start"))
    return pages.join(start, key).where("pos >= start").drop("start")


def until_stop(rows: DataFrame, stop, key: str, order: str = "pos") -> DataFrame:
    """Rows up to and with the first one that says stop."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__stopped", F.coalesce(F.max(stop).over(before), F.lit(False))).where(~F.col("__stopped")).drop("__stopped")


def scanned(pages: DataFrame, key: str = "doc_id", least: int = 50) -> DataFrame:
    """Whether a document is a scan: of its first, middle and last page none has more than ``least`` characters."""
    n = pages.groupBy(key).agg(F.max("pos").alias("last"))
    some = pages.join(n, key).where("pos = 0 or pos = last or pos = floor((last + 1) / 2)")
    return some.groupBy(key).agg((F.max(F.length(F.trim("line"))) <= least).alias("is_scan"))
