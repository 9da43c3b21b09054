"""Graph analytics over the relationships, and over the matched names."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.operators import graph as G
from kgweave.session import table

_E = "e as (select least(upper(trim(source)), upper(trim(target))) as a, greatest(upper(trim(source)), upper(trim(target))) as b, sum(weight) as w from edges where trim(source) <> '' and trim(target) <> '' and upper(trim(source)) <> upper(trim(target)) and weight is not null group by 1, 2)"
_BOTH = "x as (select a as x, b as y, w from e union all select b, a, w from e)"


def _edges(spark, sf_dir):
    a, b = F.upper(F.trim("source")), F.upper(F.trim("target"))
    e = table(spark, sf_dir, "edges").where("weight is not null").select(a.alias("a"), b.alias("b"), F.col("weight").alias("w")).where("a <> '' and b <> ''")
    return G.parallel_sum(e)


def _members(spark, sf_dir):
    """Communities by first word of the name: a fixed membership that SQL can express."""
    e = _edges(spark, sf_dir)
    return e.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.split("v", " ")[0].alias("c"))


_M = "m as (select distinct v, split_part(v, ' ', 1) as c from (select a as v from e union all select b from e))"


def match_components(spark, sf_dir):
    """Clusters of matched names."""
    p = table(spark, sf_dir, "fuzzy_mapping_report").select(F.col("entity_name").alias("a"), F.col("mapped_to").alias("b")).where("a is not null and b is not null")
    return G.components(p)


def component_survey(spark, sf_dir):
    return G.survey(G.component_sizes(match_components(spark, sf_dir)))


def component_histogram(spark, sf_dir):
    return G.component_sizes(match_components(spark, sf_dir)).groupBy("size").agg(F.count("*").alias("n")).orderBy("size")


def largest_components(spark, sf_dir):
    """The five largest clusters of matched names."""
    return G.component_sizes(match_components(spark, sf_dir)).orderBy(F.desc("size"), "component").limit(5)


def prune_small_components(spark, sf_dir):
    p = table(spark, sf_dir, "fuzzy_mapping_report").select(F.col("entity_name").alias("a"), F.col("mapped_to").alias("b"), "score").where("a is not null and b is not null").distinct()
    return G.pruned(p, match_components(spark, sf_dir)).select("a", "b", "score")


def weighted_degree(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


def edge_priority(spark, sf_dir):
    return G.priorities(_edges(spark, sf_dir))


def parallel_edge_sum(spark, sf_dir):
    return _edges(spark, sf_dir)


def contract_graph(spark, sf_dir):
    return G.contracted(_edges(spark, sf_dir), _members(spark, sf_dir)).withColumn("w", F.round("w", 6))


def macro_graph(spark, sf_dir):
    return G.between_communities(_edges(spark, sf_dir), _members(spark, sf_dir))


def community_edges(spark, sf_dir):
    return G.within_communities(_edges(spark, sf_dir), _members(spark, sf_dir))


def induced_subgraph(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.induced(e, G.most_connected(e, 40))


def ego_graph(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.ego(e, G.most_connected(e, 1))


def component_labels(spark, sf_dir):
    return G.components(_edges(spark, sf_dir))


def community_hierarchy(spark, sf_dir):
    return G.hierarchy(_edges(spark, sf_dir).withColumn("w", F.col("w") / 10))


def community_levels(spark, sf_dir):
    """Per level: communities, vertices, size of the largest."""
    h = community_hierarchy(spark, sf_dir)
    return h.groupBy("level", "c").agg(F.countDistinct("v").alias("n")).groupBy("level").agg(F.count("*").alias("n_communities"), F.sum("n").alias("n_vertices"), F.max("n").alias("largest"))


def community_tree(spark, sf_dir):
    """Every community of every level: its id, members, parent and sub-communities."""
    return G.tree(community_hierarchy(spark, sf_dir))


def _levels(spark, sf_dir):
    """A membership of two levels: first two words, and first word."""
    v = _members(spark, sf_dir).select("v")
    two = F.concat_ws(" ", F.slice(F.split("v", " "), 1, 2))
    return v.select(F.explode(F.array(F.struct(F.lit(0).alias("level"), two.alias("c")), F.struct(F.lit(1).alias("level"), F.split("v", " ")[0].alias("c")))).alias("m"), "v").select("m.*", "v")


_L = _E + ", " + _M + ", lv as (select 0 as level, array_to_string(list_slice(string_split(v, ' '), 1, 2), ' ') as c, v from m union all select 1, split_part(v, ' ', 1), v from m), sz as (select level, c, count(*) as n from lv group by 1, 2)"


def community_filter(spark, sf_dir):
    """Communities with at least 4 members, and of each the sub-communities that are left."""
    sizes = _levels(spark, sf_dir).groupBy("level", "c").agg(F.count("*").alias("n")).where(~(F.col("level").between(0, 4) & (F.col("n") < 4)))
    subs = sizes.where("level = 0").groupBy(F.split("c", " ")[0].alias("c")).agg(F.array_join(F.array_sort(F.collect_set("c")), "|").alias("subs")).withColumn("level", F.lit(1))
    return sizes.join(subs, ["level", "c"], "left").select("level", "c", "n", F.coalesce("subs", F.lit("")).alias("subs"))


def community_stats(spark, sf_dir):
    sizes = _levels(spark, sf_dir).groupBy("level", "c").agg(F.count("*").alias("n"))
    return sizes.groupBy("level").agg(
        F.count("*").alias("n_communities"), F.sum("n").alias("n_members"), F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sd"), F.median("n").alias("mid")
    )


QUERIES = {
    f.__name__: f
    for f in (match_components, component_survey, component_histogram, largest_components, prune_small_components, component_labels, weighted_degree, edge_priority, parallel_edge_sum, contract_graph, macro_graph, community_edges, induced_subgraph, ego_graph, community_hierarchy, community_levels, community_tree, community_filter, community_stats)
}

_PAIRS = """recursive p as (select entity_name as a, mapped_to as b from fuzzy_mapping_report where entity_name is not null and mapped_to is not null and entity_name <> mapped_to),
x as (select a, b from p union select b, a from p), r(v, c) as (select a, a from x union select r.v, x.b from r join x on r.c = x.a),
l as (select v, min(c) as component from r group by 1), z as (select component, count(*) as size from l group by 1)"""

SQL = {
    "match_components": f"with {_PAIRS} select v, component from l",
    "component_survey": f"with {_PAIRS} select count(*) as n_components, cast(sum(size) as bigint) as n_vertices, max(size) as giant, round(max(size) / sum(size), 6) as giant_share, count(*) filter (size <= 3) as islands, count(*) filter (size = 2) as pairs from z",
    "component_histogram": f"with {_PAIRS} select size, count(*) as n from z group by 1",
    "largest_components": f"with {_PAIRS} select component, size from z order by size desc, component limit 5",
    "prune_small_components": f"with {_PAIRS} select distinct entity_name as a, mapped_to as b, score from fuzzy_mapping_report where mapped_to is not null and entity_name in (select v from l join z using (component) where size >= 3)",
    "component_labels": f"with recursive {_E}, x as (select a, b from e union select b, a from e), r(v, c) as (select a, a from x union select r.v, x.b from r join x on r.c = x.a) select v, min(c) as component from r group by 1",
    "weighted_degree": f"with {_E} select v, count(*) as degree, sum(w) as strength from (select a as v, w from e union all select b, w from e) group by 1",
    "edge_priority": f"with {_E}, d as (select v, sum(w) as s from (select a as v, w from e union all select b, w from e) group by 1) select a, b, w, d1.s + d2.s as priority from e join d d1 on a = d1.v join d d2 on b = d2.v",
    "parallel_edge_sum": f"with {_E} select a, b, w from e",
    "contract_graph": f"with {_E}, {_M} select least(m1.c, m2.c) as a, greatest(m1.c, m2.c) as b, round(log10(sum(w) + 1) + 1, 6) as w from e join m m1 on a = m1.v join m m2 on b = m2.v where m1.c <> m2.c group by 1, 2",
    "macro_graph": f"with {_E}, {_M} select least(m1.c, m2.c) as a, greatest(m1.c, m2.c) as b, sum(w) as w from e join m m1 on a = m1.v join m m2 on b = m2.v where m1.c <> m2.c group by 1, 2",
    "community_edges": f"with {_E}, {_M} select a, b, w, m1.c as c from e join m m1 on a = m1.v join m m2 on b = m2.v where m1.c = m2.c",
    "induced_subgraph": f"with {_E}, t as (select v from (select a as v from e union all select b from e) group by 1 order by count(*) desc, v limit 40) select a, b, w from e where a in (select v from t) and b in (select v from t)",
    "ego_graph": f"with {_E}, {_BOTH}, c as (select x from x group by 1 order by count(*) desc, x limit 1), h as (select x as v, 0 as hops from c union all select y, 1 from x where x in (select x from c) union all select x2.y, 2 from x x1 join x x2 on x1.y = x2.x where x1.x in (select x from c)) select v, min(hops) as hops from h group by 1",
    "community_filter": f"with {_L}, k as (select * from sz where n >= 4) select level, c, n, coalesce(case when level = 1 then (select string_agg(k2.c, '|' order by k2.c) from k k2 where k2.level = 0 and split_part(k2.c, ' ', 1) = k.c) end, '') as subs from k",
    "community_stats": f"with {_L} select level, count(*) as n_communities, cast(sum(n) as bigint) as n_members, min(n) as low, max(n) as high, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as sd, median(n) as mid from sz group by 1",
}
