"""Budgeted prefixes and folds: what fits into a context, small chunks merged, reports packed, texts split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, key: str, order: list, size: Column, name: str = "total") -> DataFrame:
    """df with the running sum of size within key; sizes are positive, so that a bound on it is a prefix."""
    return df.withColumn(name, F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def prefix(df: DataFrame, key: str, order: list, size: Column, limit: Column | float, most_rows: int | None = None) -> DataFrame:
    """The rows of each key, in order, whose sizes together stay within the limit.

    most_rows: no more rows of a size of at least 1 than this can fit (the limit). They are then cut by rank first, which
    Spark does before the shuffle, so that a key with very many rows never meets in one place; rows of size 0, which use
    nothing up, are kept apart from that cut."""
    if most_rows is not None:
        sized = df.withColumn("__size", size)
        ranked = sized.where(F.col("__size") >= 1).withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        df = ranked.where(F.col("__rank") <= most_rows).drop("__rank").unionByName(sized.where("coalesce(__size, 0) < 1"))
        return running(df, key, order, F.col("__size")).where(F.col("total") <= limit).drop("__size")
    return running(df, key, order, size).where(F.col("total") <= limit)


def marked_prefix(df: DataFrame, key: str, order: list, size: Column, limit: float, text: str) -> DataFrame:
    """(key, text, omitted): the prefix joined by lines, with how many rows were left out."""
    r = running(df, key, order, size).withColumn("fits", F.col("total") <= limit)
    g = r.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("total", text)))).alias("l"), F.count_if(~F.col("fits")).alias("omitted"))
    joined = F.array_join(F.transform("l", lambda x: x[text]), "\n")
    return g.select(key, F.when(F.col("omitted") > 0, F.concat(joined, F.lit("\n...("), F.col("omitted").cast("string"), F.lit(" omitted)"))).otherwise(joined).alias("text"), "omitted")


def merged_small(chunks: DataFrame, threshold: int = 200) -> DataFrame:
    """Per file, in order: a chunk under the threshold joins what is before it, and one after a small accumulation joins
    that. chunks(file, pos, content, tokens) -> (file, pos of the first, content, tokens, n).

    Between two neighbours that both reach the threshold nothing is ever joined, so a file falls into runs that are folded
    apart, however many chunks it has. Runs are sorted within partitions and folded as they stream by: what is held is
    one batch and one open chunk."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list | None = None
        last_run = 0
        parts: list[str] = []

        def closed() -> list:
            return [last[0], last[1], "\n".join(parts), last[2], len(parts)]

        for g in batches:
            out: list[list] = []
            for f, run, pos, content, tokens in g[["file", "run", "pos", "content", "tokens"]].itertuples(index=False):
                if last and last[0] == f and run == last_run and (tokens < threshold or last[2] < threshold):
                    last[2] += tokens
                    parts.append(content)
                else:
                    if last:
                        out.append(closed())
                    last, last_run, parts = [f, pos, tokens], run, [content]
            yield pd.DataFrame(out, columns=["file", "pos", "content", "tokens", "n"])
        if last:
            yield pd.DataFrame([closed()], columns=["file", "pos", "content", "tokens", "n"])

    in_order = Window.partitionBy("file").orderBy("pos")
    parted = (F.col("tokens") >= threshold) & (F.lag("tokens").over(in_order) >= threshold)
    runs = chunks.select("file", "pos", "content", "tokens").withColumn("cut", F.coalesce(parted, F.lit(False)).cast("int"))
    runs = runs.withColumn("run", F.sum("cut").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")
    placed = runs.repartition("file", "run").sortWithinPartitions("file", "run", "pos")
    return placed.mapInPandas(fold, "file string, pos int, content string, tokens int, n int")


def packed(reports: DataFrame, limit: int = 3500, lanes: int = 1, seed: int = 42) -> DataFrame:
    """Reports(id, tokens) in a seeded order, next fit into bins of at most ``limit``; larger ones are left out.

    (id, lane, bin, tokens): bins from 1 in each lane. One lane is one global sequence; at scale, more lanes pack on
    their own, at the cost of one open bin each."""
    shuffle = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    fit = reports.where(F.col("tokens") <= limit).select("id", "tokens", shuffle.alias("h")).withColumn("lane", F.pmod(F.xxhash64("h"), F.lit(lanes)).cast("int"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "id"])
        bins, used, k = [], 0, 1
        for t in g["tokens"]:
            if used + t > limit and used:
                k, used = k + 1, 0
            used += t
            bins.append(k)
        return g.assign(bin=bins)[["id", "lane", "bin", "tokens"]]

    return fit.groupBy("lane").applyInPandas(fold, "id bigint, lane int, bin int, tokens int")


def split_text(text: str, size: Callable[[str], int], limit: int = 1500, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``limit``: split at the first separator that occurs, its parts merged up to the limit with
    about ``overlap`` repeated, and parts that are too long split by the next separator. Separators stay in the pieces."""
    if size(text) <= limit:
        return [text] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    parts = [x + sep for x in text.split(sep)[:-1]] + [text.split(sep)[-1]] if sep else list(text)
    out: list[str] = []
    kept: list[tuple[str, int]] = []
    total = 0

    def flush() -> None:
        if piece := "".join(x for x, _ in kept).strip():
            out.append(piece)

    for part in parts:
        n = size(part)
        if n > limit and rest:
            flush()
            kept, total = [], 0
            out += split_text(part, size, limit, overlap, rest)
            continue
        if kept and total + n > limit:
            flush()
            while kept and (total > overlap or total + n > limit):
                total -= kept.pop(0)[1]
        kept.append((part, n))
        total += n
    flush()
    return out


def estimated_size(text: str) -> int:
    """Words times 1.3."""
    return int(len(text.split()) * 1.3)


def split_documents(docs: DataFrame, limit: int = 1500, overlap: int = 200, size: Callable[[str], int] = estimated_size) -> DataFrame:
    """(doc_id, pos, piece) by a count of tokens: estimated, or exact by any function that is passed."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, size, limit, overlap) if t else [] for t in texts], dtype=object)

    return docs.select("doc_id", F.posexplode(pieces("text")).alias("pos", "piece"))
