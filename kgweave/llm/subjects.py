"""Subject area of each document (problem 8): averaged word and subword embeddings with independent logistic outputs.

A document is the mean of the vectors of its words, their character 3- and 4-grams, and its pairs of words, hashed to
BUCKETS rows; each subject has its own logistic output, so a document may have several subjects or none. Training is
synchronous: in every step each partition computes the gradient of its documents of that step's batch under broadcast
parameters, the partitions' gradients are summed on the executors, block of rows by block of rows, and Adam moves the
parameters by the one sum. Of the labelled documents an eighth is held out to choose the threshold, and another, which
nothing is fitted to, to measure the result (``quality``). Parameters and gradients have a fixed size (BUCKETS x DIM
floats, 1 MB), whatever the corpus.

Training takes at most MAX_LABELLED labelled documents (of more, those with the smallest hash of their id); every
document is scored. To score, the vectors are multiplied with the outputs once, and a word's features are added up once,
so that a document is a sum of rows of its words and pairs.

Defined results: null, empty and wordless texts have no subject; without labels nothing has one; labels of documents
that don't exist, null labels and repeated labels don't count; texts are read whole, whatever their length; repeated
rows give one result; empty tables give empty ones; other columns are ignored, whatever their names. If no document is
held out, the threshold is where both outcomes are as likely.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.names import LOOK_ALIKES
from kgweave.session import materialize

BUCKETS, DIM, STEPS, BATCH, RATE, MAX_LABELLED = 1 << 14, 16, 60, 1200, 0.15, 20_000
#: Documents are scored in blocks of at most so many characters, so that a block's features fit in memory.
BLOCK_CHARS = 400_000
#: Blocks of rows by which gradients are summed.
PARTS = 4
#: Different words that a worker remembers.
REMEMBERED = 200_000

_ON = "\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff"
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_ON}])*")
_PLAIN = str.maketrans({**LOOK_ALIKES, "đ": "d", "Đ": "D", **dict.fromkeys(["\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"])})
_MARKS = dict.fromkeys(range(0x300, 0x370))


class Words:
    """Numbers the different words of texts, and holds the hash and the hashed features of each."""

    def __init__(self, n_buckets: int = BUCKETS):
        self.n_buckets = n_buckets
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []
        self.features: list[np.ndarray] = []

    def _new(self, raw: str) -> int:
        w = unicodedata.normalize("NFKD", raw).translate(_MARKS).translate(_PLAIN).lower()
        k = self.number.get(f" {w}")
        if k is None:
            k = self.number[f" {w}"] = len(self.hashes)
            s = f"<{w}>"
            self.hashes.append(zlib.crc32(w.encode()))
            self.features.append(np.array([zlib.crc32(x.encode()) % self.n_buckets for x in (w, *(s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)))]))
        self.number[raw] = k
        return k

    def of(self, text: str | None) -> list[int]:
        get, out = self.number.get, []
        for raw in _WORD.findall(text or ""):
            k = get(raw)
            out.append(self._new(raw) if k is None else k)
        return out

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """The features of neighbouring words; one less than there are words."""
        h = np.array(self.hashes, np.uint64)[words]
        mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed >> np.uint64(40)) % np.uint64(self.n_buckets)).astype(np.int64)


def features_of(words: Words, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different features of a text and their shares."""
    at = words.of(text)
    if not at:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    every = np.concatenate([*(words.features[k] for k in at), words.pairs(np.array(at))])
    ids, n = np.unique(every, return_counts=True)
    return ids.astype(np.int32), (n / len(every)).astype(np.float32)


def _means(ids: list[np.ndarray], shares: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each document; all have features."""
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    return np.add.reduceat(vectors[np.concatenate(ids)] * np.concatenate(shares)[:, None], starts, 0)


def _parameters(n: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, n)).astype(np.float32), np.full(n, -2.0, np.float32)]


def labelled_features(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, ids, shares, y, batch): features and labels of the training documents. Batch -1 is held out for the
    threshold, -2 to measure."""
    known = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    known = materialize(known.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED), "p8 labels")
    n_batches = max(1, known.count() * 6 // 8 // BATCH)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for g in batches:
            f = [features_of(words, t) for t in g["text"]]
            y = [[float(s in have) for s in subjects] for have in g["subjects"]]
            out = pd.DataFrame({"doc_id": g["doc_id"], "ids": [x[0] for x in f], "shares": [x[1] for x in f], "y": y})
            yield out[[len(x[0]) > 0 for x in f]]

    rows = texts.mapInPandas(read, "doc_id bigint, ids array<int>, shares array<float>, y array<float>")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(8 * n_batches))
    return materialize(rows.withColumn("batch", F.when(draw % 8 == 0, F.lit(-1)).when(draw % 8 == 1, F.lit(-2)).otherwise(F.floor(draw / 8)).cast("int")), "p8 features")


def _blocks(batches: Iterator[pd.DataFrame], most: int = 500) -> Iterator[pd.DataFrame]:
    for g in batches:
        for i in range(0, len(g), most):
            yield g.iloc[i : i + most]


def _summed(parts: DataFrame) -> list:
    """(part, n, values) summed over the partitions, on the executors; one row of each part comes to the driver."""

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, np.float32) for v in g["values"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"part": g["part"].iloc[:1], "n": [g["n"].sum()], "values": [total.tobytes()]})

    return parts.groupBy("part").applyInPandas(add, "part int, n bigint, values binary").collect()


def train(features: DataFrame, n_subjects: int, steps: int = STEPS, seed: int = 42) -> list[np.ndarray]:
    """Vectors, weights and biases after ``steps`` synchronised steps."""
    spark = features.sparkSession
    params = _parameters(n_subjects, seed)
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    n_batches = 1 + max(0, features.agg(F.max("batch")).first()[0] or 0)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, 16, BATCH // 400))
    # A batch is a few files of its own, so that a step reads no other.
    by_batch = [materialize(features.where(F.col("batch") == k).repartition(tasks, "doc_id"), "p8 batch") for k in range(n_batches)]
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast(params)

        def gradient(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vectors, weights, biases = shared.value
            gv, gw, gb, n = np.zeros_like(vectors), np.zeros_like(weights), np.zeros_like(biases), 0
            for g in _blocks(batches):
                ids, shares, y = list(g["ids"]), list(g["shares"]), np.stack(g["y"].to_list())
                h = _means(ids, shares, vectors)
                d = 1 / (1 + np.exp(-(h @ weights + biases))) - y
                gw, gb, n = gw + h.T @ d, gb + d.sum(0), n + len(g)
                down = np.repeat(d @ weights.T, list(map(len, ids)), 0) * np.concatenate(shares)[:, None]
                flat = np.concatenate(ids)
                for k in range(down.shape[1]):
                    gv[:, k] += np.bincount(flat, down[:, k], len(gv))
            if n:
                parts = [*np.array_split(gv, PARTS), np.concatenate([gw.ravel(), gb])]
                yield pd.DataFrame({"part": range(PARTS + 1), "n": [n] * (PARTS + 1), "values": [x.astype(np.float32).tobytes() for x in parts]})

        rows = {r["part"]: r for r in _summed(by_batch[step % n_batches].mapInPandas(gradient, "part int, n bigint, values binary"))}
        shared.destroy()
        if not rows:
            continue
        read = [np.frombuffer(rows[k]["values"], np.float32) for k in range(PARTS + 1)]
        total = [np.concatenate(read[:PARTS]).reshape(params[0].shape), read[PARTS][: params[1].size].reshape(params[1].shape), read[PARTS][params[1].size :]]
        rate = RATE * (1.05 - step / steps)
        params = [x.copy() for x in params]
        for x, g, m, v in zip(params, total, first, second):
            g = g * (n_subjects / max(rows[0]["n"], 1))
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9)
    return params


GRID, NEAR_BEST = np.arange(-2.5, 1.51, 0.125), 0.002


def counted(features: DataFrame, params: list[np.ndarray], batch: int) -> list[tuple[float, int, int, int]]:
    """(threshold, hits, found, true) for every threshold of GRID over a held-out batch; only these come to the driver."""
    shared = features.sparkSession.sparkContext.broadcast(params)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, weights, biases = shared.value
        for g in _blocks(batches):
            z = _means(list(g["ids"]), list(g["shares"]), vectors) @ weights + biases
            y = np.stack(g["y"].to_list()) > 0
            yield pd.DataFrame({"t": GRID, "hits": [((z > t) & y).sum() for t in GRID], "found": [(z > t).sum() for t in GRID], "true": y.sum()})

    per_block = features.where(F.col("batch") == batch).mapInPandas(count, "t double, hits bigint, found bigint, true bigint")
    return [tuple(r) for r in per_block.groupBy("t").agg(F.sum("hits"), F.sum("found"), F.sum("true")).orderBy("t").collect()]


def choose_threshold(features: DataFrame, params: list[np.ndarray]) -> float:
    """The highest of the thresholds whose F1 on the documents held out for it is the best, but for NEAR_BEST; 0, where
    both outcomes are as likely, if there are none. The highest, as only documents with a subject have labels: the
    others of the corpus can't add hits."""
    rows = counted(features, params, -1)
    if not rows or not rows[0][3]:
        return 0.0
    f1 = [2 * hits / max(1, found + true) for _, hits, found, true in rows]
    return max(r[0] for r, x in zip(rows, f1) if x >= max(f1) - NEAR_BEST)


def quality(features: DataFrame, params: list[np.ndarray], threshold: float) -> tuple[float, float]:
    """(precision, recall) on the documents held out from training and from the choice of the threshold."""
    for t, hits, found, true in counted(features, params, -2):
        if t == threshold:
            return hits / max(1, found), hits / max(1, true)
    return float("nan"), float("nan")


def score(documents: DataFrame, params: list[np.ndarray], subjects: list[str], threshold: float) -> DataFrame:
    """(doc_id, subject) of every document's subjects."""
    vectors, weights, biases = params
    shared = documents.sparkSession.sparkContext.broadcast((vectors @ weights, biases))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, biases = shared.value
        words, names = Words(len(rows)), np.array(subjects, dtype=object)
        # Of every word: the sum of its features' rows, and their number. They grow with the words.
        sums, sizes = np.zeros((0, rows.shape[1]), rows.dtype), np.zeros(0, np.int64)

        def block(ids: list, texts: list[list[int]]) -> pd.DataFrame:
            nonlocal sums, sizes
            if not ids:
                return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "subject": pd.Series([], dtype=object)})
            if len(words.features) > len(sizes):
                new = words.features[len(sizes) :]
                n = np.array([len(f) for f in new])
                sums = np.concatenate([sums, np.add.reduceat(rows[np.concatenate(new)], np.cumsum([0, *n[:-1]]), 0)])
                sizes = np.concatenate([sizes, n])
            lengths = np.array([len(t) for t in texts])
            flat, starts = np.concatenate(texts).astype(np.int64), np.cumsum([0, *lengths[:-1]])
            of_pairs = np.zeros((len(flat), rows.shape[1]), rows.dtype)
            of_pairs[:-1] = rows[words.pairs(flat)]
            of_pairs[np.cumsum(lengths) - 1] = 0
            total = np.add.reduceat(sums[flat] + of_pairs, starts, 0)
            z = total / (np.add.reduceat(sizes[flat], starts) + lengths - 1)[:, None] + biases
            at, which = np.nonzero(z > threshold)
            return pd.DataFrame({"doc_id": np.array(ids)[at], "subject": names[which]})

        for g in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(g["doc_id"], g["text"]):
                if at := words.of(t):
                    ids.append(i)
                    texts.append(at)
                    size += len(t)
                    if size > BLOCK_CHARS:
                        yield block(ids, texts)
                        ids, texts, size = [], [], 0
            yield block(ids, texts)
            if len(words.number) > REMEMBERED:
                words.clear()
                sums, sizes = sums[:0], sizes[:0]

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(scored, "doc_id bigint, subject string")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) of every document. The list of subjects comes to the driver: it is small."""
    names = [r[0] for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    features = labelled_features(documents, labels, names) if names else None
    if features is None or not features.limit(1).count():
        return documents.select("doc_id", F.lit("").alias("subject")).where("false")
    params = train(features, len(names))
    return score(documents, params, names, choose_threshold(features, params)).distinct()


def composition(found: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """Documents and characters per subject, and of the documents without one (subject '-')."""
    sizes = documents.select("doc_id", F.length("text").alias("n"))
    of = sizes.join(found, "doc_id", "left").withColumn("subject", F.coalesce("subject", F.lit("-")))
    counted = of.groupBy("subject").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"))
    return counted.join(F.broadcast(subjects.select("subject", "label_vi")), "subject", "left")
