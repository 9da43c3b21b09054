"""Vector index of cells, and exact search in blocks.

``build`` fits at most MAX_CELLS centres to a bounded sample of the vectors and puts every vector into the cell of its
nearest centre. ``search`` looks a query up in its nearest cells only, as many as ``calibrated`` measures to be enough; with
all cells it is exact. ``top`` and ``at_least``
compare a stated set of queries with all vectors by matrix products, a bounded block of queries at a time, and keep what
they find on the map side.

Defined results: null vectors are in no cell and found by nothing; vectors of length zero have a cosine of 0 to all;
queries don't find themselves (equal ids); ties go to the smaller id; empty tables give empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.session import BROADCAST_BYTES, materialize

#: Rows that centres are fitted to, the most centres, rounds of fitting.
SAMPLE, MAX_CELLS, ROUNDS = 20_000, 1024, 8
_FOUND = "query bigint, id bigint, score double"


def _unit(rows: list) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=float) for x in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries(query, q), a block of at most half of BROADCAST_BYTES at a time: (ids, unit vectors)."""
    first = queries.where("q is not null").select("q").first()
    if first is None:
        return
    most = max(1, BROADCAST_BYTES // 2 // (8 * max(1, len(first["q"]))))
    n = queries.count()
    parts = -(-n // most)
    for k in range(parts):
        rows = queries.where("q is not null").where(F.pmod(F.xxhash64("query"), F.lit(parts)) == k).select("query", "q").collect()
        if rows:
            yield np.array([r["query"] for r in rows]), _unit([r["q"] for r in rows])


def _compared(queries: DataFrame, vectors: DataFrame, keep) -> DataFrame:
    """What keep(ids of the block, ids, cosines) takes of every batch, all blocks united."""
    out = None
    for ids, block in _blocks(queries):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, block))

        def compare(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qids, qs = sent.value
            for g in batches:
                for i in range(0, len(g), 4096):
                    some = g.iloc[i : i + 4096]
                    own = some["id"].to_numpy()
                    scores = qs @ _unit(list(some["embedding"])).T
                    scores[qids[:, None] == own[None, :]] = -2
                    a, b = keep(scores)
                    yield pd.DataFrame({"query": qids[a], "id": own[b], "score": scores[a, b]})

        found = vectors.where("embedding is not null").select("id", "embedding").mapInPandas(compare, _FOUND)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], _FOUND) if out is None else out


def at_least(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(query, id, score) of every vector whose cosine with a query is at least ``least``."""
    return _compared(queries, vectors, lambda s: np.nonzero(s >= least))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best per query; score is ((1 + cosine) / 2), rounded to six places, then the smaller id."""
    scored = found.withColumn("score", F.round((1 + F.col("score")) / 2, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k nearest of every query(query, q), exact. A batch of vectors passes on what may be
    among its k best, ties of the rounded score included."""

    def best(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if s.shape[1] <= k:
            return np.nonzero(s > -2)
        edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        return np.nonzero((s >= edge - 4e-6) & (s > -2))

    return _ranked(_compared(queries, vectors, best), k)


def centres(vectors: DataFrame, n_cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit centres of spherical k-means over at most SAMPLE vectors, those with the smallest hash of their id."""
    n = vectors.where("embedding is not null").count()
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    m = _unit([r["embedding"] for r in rows])
    k = min(n_cells or max(1, int(math.sqrt(n))), MAX_CELLS, len(m))
    at = m[np.random.default_rng(seed).permutation(len(m))[:k]]
    for _ in range(ROUNDS):
        own = (m @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), at)
    return at


def build(vectors: DataFrame, at: np.ndarray, what: str = "index") -> DataFrame:
    """(id, embedding, cell) of every vector(id, embedding), written by cell. Broadcast are the centres, at most MAX_CELLS."""
    return materialize(_celled(vectors.where("embedding is not null").select("id", "embedding"), at, 1, "embedding").repartition("cell"), what)


def _celled(rows: DataFrame, at: np.ndarray, probes: int, column: str) -> DataFrame:
    """rows with ``cell``: one row for each of the ``probes`` nearest centres of the vector."""
    sent = rows.sparkSession.sparkContext.broadcast(at)

    @F.pandas_udf("array<int>")
    def nearest(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        s = _unit(list(x)) @ sent.value.T
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)), dtype=object)

    return rows.withColumn("cell", F.explode(nearest(column)))


def calibrated(vectors: DataFrame, index: DataFrame, at: np.ndarray, k: int, least: float = 0.95, n_queries: int = 100) -> int:
    """The fewest cells to look up for a recall of ``least``, measured against exact search with n_queries of the vectors,
    those with the smallest hash of their id. Only counts per place of a cell come to the driver."""
    if not len(at):
        return 1
    queries = vectors.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(n_queries).select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    exact = top(queries, vectors, k).select("query", "id")
    place = F.row_number().over(Window.partitionBy("query").orderBy("place"))
    cells = _celled(queries.withColumn("place", F.lit(0)), at, len(at), "q").select("query", "cell", F.monotonically_increasing_id().alias("place")).withColumn("place", place)
    counts = exact.join(index.select("id", "cell"), "id").join(cells, ["query", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    total, found = sum(r["n"] for r in counts), 0
    for r in counts:
        found += r["n"]
        if found >= least * total:
            return r["place"]
    return 1


def search(queries: DataFrame, index: DataFrame, at: np.ndarray, k: int, probes: int = 16) -> DataFrame:
    """(query, id, score, rank) of queries(query, q): the k nearest within the ``probes`` nearest cells; with probes of at
    least the number of cells, exact. Queries meet vectors by a join on the cell, which adaptive execution splits where a
    cell is large; only the k best of a task's rows go on."""
    if not len(at):
        return queries.sparkSession.createDataFrame([], _FOUND + ", rank int")
    from kgweave.operators.resolve import dot

    near = index.join(_celled(queries.where("q is not null").select("query", "q"), at, min(probes, len(at)), "q"), "cell").where("id <> query")
    norms = F.sqrt(dot("embedding", "embedding") * dot("q", "q"))
    return _ranked(near.select("query", "id", F.coalesce(F.try_divide(dot("embedding", "q"), norms), F.lit(0.0)).alias("score")), k)
