"""Graph operators over edges(a, b, w): components, degrees, contraction, neighbourhoods, communities."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.session import discard, materialize


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "w"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "w"))).alias("e")).select("e.*")


def parallel_sum(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair, weights summed, loops dropped."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex of each vertex's component, by alternating large and small stars.

    Large star: every larger neighbour of v is linked to the smallest of v and its neighbours; small star: v and its
    smaller neighbours are linked to the smallest of them. Rounds grow with the logarithm of the largest diameter."""
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct(), "links")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("v", "p")), F.sum(F.xxhash64("p", "v") % 1_000_003))
    state = None
    while True:
        around = links.unionByName(links.select(F.col("p").alias("v"), F.col("v").alias("p")))
        low = around.groupBy("v").agg(F.least(F.min("p"), F.first("v")).alias("m"))
        large = around.join(low, "v").where("p > v").select(F.col("p").alias("v"), F.col("m").alias("p")).where("v <> p").distinct()
        small_low = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(small_low, "v").select(F.explode(F.array("v", "p")).alias("v"), F.col("m").alias("p")).where("v <> p").distinct()
        after = materialize(small, "links")
        discard(links)
        links, before, state = after, state, tuple(after.agg(mark).first()[0])
        if state == before:
            break
    roots = links.select(F.col("p").alias("v"), F.col("p").alias("component"))
    return links.select("v", F.col("p").alias("component")).union(roots).distinct()


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def survey(sizes: DataFrame) -> DataFrame:
    """One row: components, vertices, the giant's size and share, components of up to 3 vertices, pairs."""
    return sizes.agg(
        F.count("*").alias("n_components"),
        F.sum("size").alias("n_vertices"),
        F.max("size").alias("giant"),
        F.round(F.max("size") / F.sum("size"), 6).alias("giant_share"),
        F.count_if(F.col("size") <= 3).alias("islands"),
        F.count_if(F.col("size") == 2).alias("pairs"),
    )


def pruned(edges: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """Edges of components with at least ``least`` vertices."""
    kept = component_sizes(labels).where(F.col("size") >= least)
    return edges.join(labels.join(kept, "component", "left_semi").select(F.col("v").alias("a")), "a", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(v, degree, strength): neighbours and summed weight."""
    return both_ways(edges).groupBy(F.col("x").alias("v")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def priorities(edges: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' strengths."""
    d = degrees(edges)
    a, b = d.select(F.col("v").alias("a"), F.col("strength").alias("sa")), d.select(F.col("v").alias("b"), F.col("strength").alias("sb"))
    return edges.join(a, "a").join(b, "b").select("a", "b", "w", (F.col("sa") + F.col("sb")).alias("priority"))


def between_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b, w): weights between different communities of member(v, c), summed."""
    a, b = member.select(F.col("v").alias("a"), F.col("c").alias("ca")), member.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    pairs = edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))


def contracted(edges: DataFrame, member: DataFrame) -> DataFrame:
    """The graph of communities; inner weight is dropped and weights are put on a log scale."""
    return between_communities(edges, member).withColumn("w", F.log10(F.col("w") + 1) + 1)


def within_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges both of whose ends are in the same community, with it."""
    a, b = member.select(F.col("v").alias("a"), F.col("c").alias("c")), member.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    return edges.join(a, "a").join(b, "b").where("c = cb").select("a", "b", "w", "c")


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges among vertices(v)."""
    v = vertices.select("v").distinct()
    return edges.join(v.withColumnRenamed("v", "a"), "a", "left_semi").join(v.withColumnRenamed("v", "b"), "b", "left_semi")


def most_connected(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "v").limit(n)


def ego(edges: DataFrame, centre: DataFrame, radius: int = 2) -> DataFrame:
    """(v, hops) within radius of centre(v), breadth first; each step joins the frontier only."""
    seen = centre.select("v", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, radius + 1):
        near = both_ways(edges).join(frontier.select(F.col("v").alias("x")), "x").select(F.col("y").alias("v")).distinct()
        frontier = near.join(seen, "v", "left_anti").select("v", F.lit(hop).alias("hops"))
        seen = seen.unionByName(frontier)
    return seen


def _move(adj: list[dict[int, float]], size: np.ndarray, gamma: float, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """Local moving for the constant Potts model: each vertex goes where the quality rises most."""
    n, rng = len(adj), np.random.default_rng(seed)
    c = np.arange(n) if start is None else start.copy()
    total = np.bincount(c, size, n).astype(float)
    free = [k for k in range(n - 1, -1, -1) if total[k] == 0]
    todo = deque(rng.permutation(n).tolist())
    waiting = set(todo)
    while todo:
        v = todo.pop()
        waiting.discard(v)
        old = c[v]
        to: dict[int, float] = {}
        for u, w in adj[v].items():
            to[c[u]] = to.get(c[u], 0.0) + w
        total[old] -= size[v]
        best, gain = old, to.get(old, 0.0) - gamma * size[v] * total[old]
        for k in sorted(to):
            g = to[k] - gamma * size[v] * total[k]
            if g > gain + 1e-12:
                best, gain = k, g
        if gain < -1e-12:
            # Alone is better; its own community is left with others, so another id is free.
            best = free.pop()
        if best != old:
            c[v] = best
            if total[old] <= 1e-9:
                total[old] = 0.0
                free.append(old)
            for u in adj[v]:
                if c[u] != best and u not in waiting:
                    todo.appendleft(u)
                    waiting.add(u)
        total[best] += size[v]
    return c


def _refined(adj: list[dict[int, float]], size: np.ndarray, gamma: float, c: np.ndarray, seed: int) -> np.ndarray:
    """Within each community: vertices that hold well to it join, one by one from being alone, the part of it where the
    quality rises most, if that part holds well to the rest. Parts are connected and numbered from 0."""
    n = len(adj)
    whole = np.bincount(c, size, n)
    sub, total, alone = np.arange(n), size.astype(float).copy(), np.ones(n, bool)
    outer = np.array([sum(w for u, w in adj[v].items() if c[u] == c[v]) for v in range(n)])
    cut = outer.copy()
    for v in np.random.default_rng(seed + 1).permutation(n).tolist():
        if not alone[v] or outer[v] < gamma * size[v] * (whole[c[v]] - size[v]) - 1e-12:
            continue
        to: dict[int, float] = {}
        for u, w in adj[v].items():
            if c[u] == c[v] and sub[u] != sub[v]:
                to[sub[u]] = to.get(sub[u], 0.0) + w
        best, gain = -1, 0.0
        for k in sorted(to):
            g = to[k] - gamma * size[v] * total[k]
            if g > gain + 1e-12 and cut[k] >= gamma * total[k] * (whole[c[v]] - total[k]) - 1e-12:
                best, gain = k, g
        if best >= 0:
            for u in adj[v]:
                if sub[u] == best:
                    alone[u] = False
            cut[best] += outer[v] - 2 * to[best]
            total[best] += size[v]
            total[sub[v]] -= size[v]
            sub[v], alone[v] = best, False
    return np.unique(sub, return_inverse=True)[1]


def _connected(adj: list[dict[int, float]], c: np.ndarray) -> np.ndarray:
    """Communities split into their connected parts."""
    out, n = np.full(len(adj), -1), 0
    for s in range(len(adj)):
        if out[s] < 0:
            out[s], stack = n, [s]
            while stack:
                v = stack.pop()
                for u in adj[v]:
                    if out[u] < 0 and c[u] == c[s]:
                        out[u] = n
                        stack.append(u)
            n += 1
    return out


def _partition(pairs: list[tuple[int, int, float]], n: int, gamma: float, seed: int) -> np.ndarray:
    """Moves, refines, and contracts the refined parts, which start in the communities they were moved to, until no two
    parts merge; communities are split into their connected parts at the end."""
    member, size, start = np.arange(n), np.ones(n), None
    of_vertices: list[dict[int, float]] | None = None
    while True:
        k = len(size)
        adj: list[dict[int, float]] = [{} for _ in range(k)]
        for a, b, w in pairs:
            if a != b:
                adj[a][b] = adj[a].get(b, 0.0) + w
                adj[b][a] = adj[b].get(a, 0.0) + w
        of_vertices = of_vertices or adj
        c = _move(adj, size, gamma, seed, start)
        part = _refined(adj, size, gamma, c, seed)
        if part.max(initial=-1) + 1 == k:
            return _connected(of_vertices, c[member])
        first = np.unique(part, return_index=True)[1]
        start = np.unique(c[first], return_inverse=True)[1]
        member, size = part[member], np.bincount(part, size)
        pairs = [(part[a], part[b], w) for a, b, w in pairs]


def communities(edges: DataFrame, labels: DataFrame, gamma: float, seed: int = 42) -> DataFrame:
    """(v, c): connected communities of high constant-Potts quality, found in each component on its own.

    The quality has no graph-wide term, so components are independent. A component is one task; c is the smallest
    vertex of the community."""
    rows = edges.join(labels.select(F.col("v").alias("a"), "component"), "a")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b"])
        names, codes = np.unique(np.concatenate([g["a"].to_numpy(), g["b"].to_numpy()]), return_inverse=True)
        k = len(g)
        c = _partition(list(zip(codes[:k].tolist(), codes[k:].tolist(), g["w"].tolist())), len(names), gamma, seed)
        first: dict[int, str] = {}
        for name, x in zip(names, c):
            first.setdefault(x, name)
        return pd.DataFrame({"v": names, "c": [first[x] for x in c]})

    return rows.groupBy("component").applyInPandas(one, "v string, c string")


def hierarchy(edges: DataFrame, levels: int = 5, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """(level, v, c, parent): level 0 finest; each level's resolution is a tenth of the last. Ends when nothing merges."""
    current, rows = materialize(parallel_sum(edges), "level"), []
    member = materialize(current.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("c")), "member")
    for level in range(levels):
        if not current.limit(1).count():
            break
        found = materialize(communities(current, components(current), gamma, seed), "communities")
        up = found.select(F.col("v").alias("c"), F.col("c").alias("up"))
        n_before, n_after = found.count(), found.select("c").distinct().count()
        if n_after == n_before and level:
            break
        rows.append(member.join(up, "c", "left").select(F.lit(level).alias("level"), "v", F.coalesce("up", "c").alias("c"), F.col("c").alias("child")))
        member = materialize(rows[-1].select("v", "c"), "member")
        current = materialize(contracted(current, found.select("v", "c")), "level")
        gamma /= 10
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def tree(levels: DataFrame) -> DataFrame:
    """(community_id, level, c, n_members, parent_id, sub_communities) of the rows of ``hierarchy``. Ids hold level and name,
    so that no two communities of any levels share one; level 0 has no sub-communities, the last no parents."""
    own = levels.groupBy("level", "c").agg(F.count("*").alias("n_members"))
    ident = lambda level, c: F.concat(F.lit("L"), level.cast("string"), F.lit(":"), c)
    up = levels.where("level > 0").select((F.col("level") - 1).alias("level"), F.col("child").alias("c"), ident(F.col("level"), F.col("c")).alias("parent_id")).distinct()
    down = up.groupBy("parent_id").agg(F.array_sort(F.collect_list(ident(F.col("level"), F.col("c")))).alias("subs"))
    named = own.join(up, ["level", "c"], "left").withColumn("community_id", ident(F.col("level"), F.col("c")))
    nothing = F.array().cast("array<string>")
    return named.join(down.withColumnRenamed("parent_id", "community_id"), "community_id", "left").select("community_id", "level", "c", "n_members", "parent_id", F.coalesce("subs", nothing).alias("sub_communities"))


def quality(edges: DataFrame, member: DataFrame, gamma: float) -> DataFrame:
    """The constant-Potts quality: inner weight less gamma times the pairs of each community."""
    inner = within_communities(edges, member).select("w")
    pairs = member.groupBy("c").agg(F.count("*").alias("n")).select((-gamma * F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    return inner.unionByName(pairs).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("quality"))
