"""Consolidating pairwise matches into groups (problem 2): deterministic Borůvka hooking.

Names get 64-bit ids in code-point order. In every round each component selects its smallest outgoing edge, by the
(smaller, larger) labels of its ends; the chosen edges form trees whose only cycles are the pairs that chose the same
edge, of which the smaller label becomes the root, and which is the smallest label of its tree. Trees collapse by
pointer doubling, edges are relabelled and deduplicated, until none remain. The number of components with edges at
least halves in each round, so there are at most log2(n) rounds, usually three or four. Joins on a label that may stand for a
large part of all names or edges (parents, roots, hubs) take such labels apart from the others (``join_hot``).

Defined results: rows with a null name link nothing, but their other name is a name; blank names are names; pairs of a
name with itself, repeated rows and pairs given both ways round change nothing; an empty table gives an empty one;
other columns are ignored, whatever their names; names are compared character for character, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.session import discard, join_hot, materialize, materialize_counted


def numbered(names: DataFrame) -> DataFrame:
    """(name, id) with ids in code-point order: a range-partitioned sort, then partition number and offset."""
    return materialize(names.orderBy("name").select("name", F.monotonically_increasing_id().alias("id")), "p2 names")


def _doubled(stars: DataFrame) -> DataFrame:
    """Every parent becomes the parent's parent; of two that are each other's parent, the smaller is the root. ``moved``
    tells whether the parent changed."""
    up = stars.select(F.col("c").alias("p"), F.col("p").alias("gp"))
    parent = F.when(F.col("gp") == F.col("c"), F.least("c", "p")).otherwise(F.col("gp"))
    # A root, or a vertex on the way to it, may be the parent of very many.
    return join_hot(stars, up, "p").select("c", parent.alias("p"), (parent != F.col("p")).alias("moved"))


def _collapsed(chosen: DataFrame) -> DataFrame:
    """(c, p) with p the root of c's tree."""
    stars = chosen
    while True:
        after, moved = materialize_counted(_doubled(stars), F.col("moved"), "p2 stars")
        discard(stars)
        stars = after.select("c", "p")
        if not moved:
            return stars


def component_labels(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges(u, v): root is the smallest vertex of its component."""
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges, left = materialize_counted(edges, F.lit(True), "p2 edges")
    rounds = []
    while left:
        ends = edges.select(F.explode(F.array("u", "v")).alias("c"), F.struct("u", "v").alias("e"))
        chosen = ends.groupBy("c").agg(F.min("e").alias("e")).select("c", F.when(F.col("c") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("p"))
        stars = _collapsed(materialize(chosen, "p2 chosen"))
        rounds.append(stars)
        half = materialize(join_hot(edges, stars.select(F.col("c").alias("u"), F.col("p").alias("pu")), "u").select("pu", "v"), "p2 half")
        relabelled = join_hot(half, stars.select(F.col("c").alias("v"), F.col("p").alias("pv")), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        relabelled = relabelled.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        done = edges
        edges, left = materialize_counted(relabelled, F.lit(True), "p2 edges")
        discard(done, half)
    if not rounds:
        return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    labels = rounds[0].select(F.col("c").alias("v"), F.col("p").alias("root"))
    for stars in rounds[1:]:
        # Written each time: a plan reads the left side of such a join more than once.
        labels = materialize(join_hot(labels, stars.select(F.col("c").alias("root"), F.col("p").alias("up")), "root", "left").select("v", F.coalesce("up", "root").alias("root")), "p2 labels")
    return labels


def match_groups(pairs: DataFrame, a: str = "entity_name", b: str = "mapped_to") -> DataFrame:
    """(group_name, entity_name) for every name of the two columns; the group is named by its smallest name."""
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    names = numbered(pairs.select(F.explode(F.array("a", "b")).alias("name")).where("name is not null").distinct())
    links = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ids = {end: names.select(F.col("name").alias(end), F.col("id").alias(to)) for end, to in (("a", "u"), ("b", "v"))}
    half = materialize(join_hot(materialize(links, "p2 links"), ids["a"], "a").select("b", "u"), "p2 half")
    edges = join_hot(half, ids["b"], "b")
    labels = component_labels(edges.select("u", "v"))
    rooted = materialize(names.join(labels, names["id"] == labels["v"], "left").select("name", F.coalesce("root", "id").alias("root")), "p2 rooted")
    heads = names.select(F.col("id").alias("root"), F.col("name").alias("group_name"))
    return join_hot(rooted, heads, "root").select("group_name", F.col("name").alias("entity_name"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """How many groups there are of each size."""
    sizes = groups.groupBy("group_name").agg(F.count("*").alias("n_names"))
    return sizes.groupBy("n_names").agg(F.count("*").alias("n_groups"))
