"""Entity resolution: blocked edit distance under identifier signatures, clusters, canonical names, vector pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.operators.graph import components
from kgweave.session import materialize

# Words that make another thing of a name.
CRITICAL = "NÃO|NẤM|THỊ|VỊ|KHỨU|THÍNH|XÚC|TRÁI|PHẢI|TRÊN|DƯỚI|TRONG|NGOÀI|TRƯỚC|SAU|TĨNH|ĐỘNG|CẤP|MẠN|ÂM|DƯƠNG|LÀNH|ÁC|TIM|GAN|PHỔI|THẬN|MẬT|MÁU|MỦ|MẮT|MŨI|MIỆNG|TAI|CỔ|HỌNG|NGỰC|BỤNG|LƯNG|TAY|CHÂN|DA|CƠ|MỠ|XƯƠNG|KHỚP"
ROMAN = "I{1,4}|IV|V|VI{1,3}|IX|X{1,3}|IVS"


def signature(name: Column) -> Column:
    """The different identifiers of a name, sorted: numbers, single capitals, roman numerals, critical words."""
    parts = [F.regexp_extract_all(name, F.lit(p), 0) for p in (r"\d+", r"(?U)\b[A-Z]\b", rf"(?U)\b(?:{ROMAN})\b", rf"(?U)\b(?:{CRITICAL})\b")]
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), "|")


def block(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Z0-9]", ""), 1, 4)


def _cut(df: DataFrame, threshold: int) -> DataFrame:
    """Adds, for texts of length l, the number of parts, and one row per part with its start and length.

    A text of length l has at most as many edits as parts less one to any text it may be paired with, so one part of the
    shorter text of a pair occurs in the longer one unchanged."""
    df = df.withColumn("parts", (F.floor(F.floor(F.col("l") * 100 / threshold) * (100 - threshold) / 100) + 1).cast("int"))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1), "parts"))).withColumns({"base": F.floor(F.col("l") / F.col("parts")).cast("int"), "short": F.col("parts") - F.col("l") % F.col("parts")})
    return df.withColumns({"start": (F.col("i") - 1) * F.col("base") + F.greatest(F.lit(0), F.col("i") - 1 - F.col("short")) + 1, "len": F.col("base") + (F.col("i") > F.col("short")).cast("int")})


def fuzzy_pairs(names: DataFrame, threshold: int = 90) -> DataFrame:
    """(a, b, score) of names(name, text) in the same block with the same signature and similar text.

    A join on unchanged parts: the shorter text of a pair is cut into one part more than the edits allowed, and the
    longer one is looked up at the positions where a part can be. Block, signature, length, place and part make one
    hashed key, so a common block is never compared with itself row by row, and only numbers of names move; what a key of
    equal hash pairs wrongly is found by the comparison of block, signature and texts at the end."""
    rows = names.select("name", "text", block(F.col("name")).alias("k"), signature(F.col("name")).alias("s"), F.length("text").alias("n")).where("n > 0")
    rows = materialize(rows.dropDuplicates(["name"]).withColumn("nid", F.monotonically_increasing_id()).withColumn("own", F.xxhash64("k", "s")), "names")

    def key(start: str) -> Column:
        return F.xxhash64("own", "l", "i", F.expr(f"substring(text, {start}, len)")).alias("key")

    index = _cut(rows.withColumn("l", F.col("n")), threshold).select("nid", key("start"))
    probe = _cut(rows.withColumn("l", F.explode(F.sequence(F.ceil(F.col("n") * threshold / 100).cast("int"), "n"))), threshold)
    more, left = F.col("n") - F.col("l"), F.col("parts") - F.col("i")
    probe = probe.withColumns(
        {
            "low": F.greatest(F.col("start") - F.col("i") + 1, F.col("start") + more - left, F.lit(1)),
            "high": F.least(F.col("start") + F.col("i") - 1, F.col("start") + more + left, F.col("n") - F.col("len") + 1),
        }
    ).where("low <= high")
    probe = probe.withColumn("at", F.explode(F.sequence("low", "high"))).select(F.col("nid").alias("other"), key("at")).distinct()
    met = index.join(probe, "key").where("nid <> other").select(F.least("nid", "other").alias("x"), F.greatest("nid", "other").alias("y")).distinct()
    texts = [rows.select(F.col("nid").alias(e), F.col("text").alias(f"t{e}")) for e in ("x", "y")]
    both = met.join(texts[0], "x").join(texts[1], "y")
    longer = F.greatest(F.length("tx"), F.length("ty"))
    most = F.floor(longer * (100 - threshold) / 100).cast("int")
    # With a bound only the diagonals within it are filled; beyond it the distance is -1.
    scored = both.withColumn("most", most).withColumn("d", F.expr("levenshtein(tx, ty, most)")).where("d >= 0").select("x", "y", F.round(100 * (1 - F.col("d") / longer), 4).alias("score"))
    ends = [rows.select(F.col("nid").alias(e), F.struct("name", "k", "s").alias(f"_{e}")) for e in ("x", "y")]
    named = scored.join(ends[0], "x").join(ends[1], "y").where("_x.k = _y.k and _x.s = _y.s")
    return named.select(F.least("_x.name", "_y.name").alias("a"), F.greatest("_x.name", "_y.name").alias("b"), "score")


def clusters(pairs: DataFrame) -> DataFrame:
    return components(pairs.select("a", "b"))


def medoids(labels: DataFrame, text: Column) -> DataFrame:
    """(component, medoid): the member with the least summed edit distance to the others, by name on ties."""
    m = labels.withColumn("t", text)
    a, b = m.alias("a"), m.alias("b")
    sums = a.join(b, F.col("a.component") == F.col("b.component")).groupBy(F.col("a.component").alias("component"), F.col("a.v").alias("v")).agg(F.sum(F.levenshtein("a.t", "b.t")).alias("d"))
    return sums.groupBy("component").agg(F.min(F.struct("d", "v")).alias("m")).select("component", F.col("m.v").alias("medoid"), F.col("m.d").alias("distance"))


def shortest(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.min(F.struct(F.length("v").alias("n"), "v"))["v"].alias("name"))


def sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, clusters, merged names) for several thresholds, in one run: the threshold is part of the vertex."""
    at = pairs.withColumn("t", F.explode(F.array(*map(F.lit, thresholds)))).where("score >= t")
    joined = at.select(F.concat(F.col("t").cast("string"), F.lit("\t"), "a").alias("a"), F.concat(F.col("t").cast("string"), F.lit("\t"), "b").alias("b"))
    labels = components(joined).select(F.split("v", "\t")[0].cast("double").alias("threshold"), "component")
    return labels.groupBy("threshold").agg(F.countDistinct("component").alias("n_clusters"), (F.count("*") - F.countDistinct("component")).alias("n_merged"))


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn(vector, F.transform(vector, lambda x: x.cast("double") / norm))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors of one tile, about.
TILE = 4000


def vector_pairs(vectors: DataFrame, least: float, tiles: int | None = None) -> DataFrame:
    """(a, b, cosine) of vectors(id, embedding) with a cosine of at least ``least``: every pair of tiles is multiplied once.

    A tile is about 1/tiles of the rows, by default TILE of them, so that a pair of tiles fits in a task whatever the
    table. Exact and so quadratic; kgweave.operators.index finds the nearest at less."""
    import numpy as np
    import pandas as pd

    tiles = tiles or max(8, -(-vectors.count() // TILE))
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    v = vectors.select("id", "embedding", tile.alias("t"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j"))))
    spread = v.withColumn("p", pairs).select("id", "embedding", "t", "p.i", "p.j")

    def multiply(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        a, b = g[g["t"] == i], g[g["t"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "cosine": pd.Series([], dtype=float)})
        m = [np.stack(x["embedding"].to_list()).astype(float) for x in (a, b)]
        m = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in m]
        c = m[0] @ m[1].T
        x, y = np.nonzero(c >= least)
        ids, jds = a["id"].to_numpy()[x], b["id"].to_numpy()[y]
        keep = (ids < jds) if i == j else (ids != jds)
        return pd.DataFrame({"a": np.minimum(ids, jds)[keep], "b": np.maximum(ids, jds)[keep], "cosine": c[x, y][keep]})

    return spread.groupBy("i", "j").applyInPandas(multiply, "a bigint, b bigint, cosine double")


def label_pairs(labels: list[str], embed: Callable[[str], list[float]], least: float) -> list[tuple[str, str]]:
    """Pairs of a small label list whose vectors have a cosine above ``least``."""
    import numpy as np

    if not labels:
        return []
    m = np.array([embed(x) for x in labels], dtype=float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return [(labels[i], labels[j]) for i, j in zip(*np.nonzero(np.triu(m @ m.T, 1) > least))]


def stars(labels: list[str], pairs: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Greedy star groups of a label list: each label not in a group yet gathers all its neighbours; groups may overlap."""
    near: dict[str, set[str]] = {x: set() for x in labels}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), []
    for x in labels:
        if x not in seen:
            group = sorted(near[x] | {x}, key=lambda y: (len(y), y))
            seen |= set(group)
            if len(group) > 1:
                out.append((group[0], group))
    return out
