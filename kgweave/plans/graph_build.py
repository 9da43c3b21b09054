"""Graph construction and repair over nodes, edges and the name mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.operators import entities as E
from kgweave.session import table


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select(F.col("entity_name").alias("name"), F.coalesce("occurrence_count", F.lit(1)).alias("n")).where("name is not null")


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name -> targets: several targets fan out, a name whose only target is null is dropped."""
    pairs = table(spark, sf_dir, "fuzzy_mapping_report").where("entity_name is not null")
    return pairs.groupBy(F.col("entity_name").alias("name")).agg(F.array_sort(F.collect_set("mapped_to")).alias("targets"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges").where("source is not null and target is not null")
    return e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"))


_MAPPING = "m as (select entity_name as name, list(distinct mapped_to) filter (mapped_to is not null) as targets from fuzzy_mapping_report where entity_name is not null group by 1), mm as (select name, unnest(coalesce(targets, [])) as t from m)"


def entity_exact_groups(spark, sf_dir):
    return E.entity_groups(table(spark, sf_dir, "nodes"))


def relation_exact_groups(spark, sf_dir):
    return E.relation_groups(table(spark, sf_dir, "edges"))


def relation_unordered_groups(spark, sf_dir):
    return E.relation_groups(table(spark, sf_dir, "edges"), ordered=False)


def graph_rebuild_nodes(spark, sf_dir):
    return E.mapped_nodes(_named(spark, sf_dir), _mapping(spark, sf_dir))


def graph_rebuild_groups(spark, sf_dir):
    """The mapped nodes with what they hold: types, descriptions and chunks of all that became one."""
    n = table(spark, sf_dir, "nodes").where("entity_name is not null").select(F.col("entity_name").alias("name"), F.coalesce("occurrence_count", F.lit(1)).alias("n"), "entity_types", "descriptions", "source_chunks")
    return E.mapped_groups(n, _mapping(spark, sf_dir))


def graph_rebuild_edges(spark, sf_dir):
    return E.mapped_edges(_links(spark, sf_dir), _mapping(spark, sf_dir))


def unique_entity_names(spark, sf_dir):
    names = table(spark, sf_dir, "nodes").select(F.col("entity_name").alias("name")).union(E.endpoints(table(spark, sf_dir, "edges")))
    return names.where("trim(name) <> ''").distinct()


def self_heal_nodes(spark, sf_dir):
    return E.healed_nodes(_named(spark, sf_dir), table(spark, sf_dir, "edges"))


def dangling_edge_filter(spark, sf_dir):
    return E.anchored_edges(table(spark, sf_dir, "edges"), _named(spark, sf_dir))


def node_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nodes").select(F.col("entity_name").alias("name"), "loaded_at", "id", "occurrence_count", "extractor")
    return E.last_written(n, "name", ["loaded_at", "id"]).drop("loaded_at")


def uniqueness_violations(spark, sf_dir):
    return E.violations(table(spark, sf_dir, "nodes").distinct(), "entity_name")


def resume_pending(spark, sf_dir):
    """Chunks cited by no node yet, in chunk order."""
    done = table(spark, sf_dir, "nodes").select(F.explode("source_chunks").alias("chunk_id"))
    return E.pending(table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id").distinct(), done, "chunk_id").orderBy("chunk_id")


def resume_priority(spark, sf_dir):
    """Nodes to do again: not in the reference list by name; truncated ones (over three descriptions) first, then by id."""
    todo = table(spark, sf_dir, "nodes").select("id", "entity_name", (F.coalesce(F.size("descriptions"), F.lit(0)) > 3).alias("truncated")).distinct()
    left = E.pending(todo.where("entity_name is not null"), table(spark, sf_dir, "ref_entities").withColumnRenamed("canonical_name", "entity_name"), "entity_name")
    return left.select("id", "truncated").orderBy(F.desc("truncated"), "id")


def merge_precedence(spark, sf_dir):
    """Earlier result kept unless it was marked truncated: prior results are those with an occurrence count."""
    n = table(spark, sf_dir, "nodes").select("id", F.coalesce("extractor", F.lit("?")).alias("value"), "occurrence_count", "degree").distinct()
    one = n.groupBy("id").agg(F.min("value").alias("value"), F.max("occurrence_count").alias("c"), F.max("degree").alias("d"))
    prior = one.where("c is not null").select("id", F.concat(F.lit("done:"), F.col("c").cast("string")).alias("value"), F.expr("d is null").alias("truncated"))
    return E.preferred(one.select("id", "value"), prior, "id", "value")


def node_ids(spark, sf_dir):
    names = table(spark, sf_dir, "nodes").where("entity_name is not null").select(F.col("entity_name").alias("name")).distinct()
    return E.dense_ids(names, "name")


def extraction_totals(spark, sf_dir):
    n, e = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")
    a = n.agg(F.count("*").alias("n_nodes"), F.count("occurrence_count").alias("n_counted"), F.count_if(F.size("descriptions") > 0).alias("n_described"))
    b = e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("source") == F.col("target")).alias("n_loops"), F.count_if(F.col("source").isNull() | F.col("target").isNull()).alias("n_broken"))
    long = [a.select(F.lit(c).alias("what"), F.col(c).alias("n")) for c in a.columns] + [b.select(F.lit(c).alias("what"), F.col(c).alias("n")) for c in b.columns]
    out = long[0]
    for x in long[1:]:
        out = out.unionAll(x)
    return out


QUERIES = {f.__name__: f for f in (entity_exact_groups, relation_exact_groups, relation_unordered_groups, graph_rebuild_nodes, graph_rebuild_groups, graph_rebuild_edges, unique_entity_names, self_heal_nodes, dangling_edge_filter, node_upsert, uniqueness_violations, resume_pending, resume_priority, merge_precedence, node_ids, extraction_totals)}


def _relations(a: str, b: str) -> str:
    return f"""
with e as (select upper(trim(source)) as s, upper(trim(target)) as t, coalesce(weight, 1.0) as w, source_chunks as ch from edges),
e2 as (select {a} as a, {b} as b, w, ch from e where s <> '' and t <> '' and s <> t),
c as (select a, b, string_agg(distinct x, '|' order by x) as chunks from (select a, b, unnest(ch) as x from e2) where x is not null group by 1, 2)
select g.a, g.b, g.weight, g.n, coalesce(c.chunks, '') as chunks
from (select a, b, sum(w) as weight, count(*) as n from e2 group by 1, 2) g left join c using (a, b)"""


SQL = {
    "entity_exact_groups": """
with m as (select upper(trim(entity_name)) as name, entity_types, descriptions, source_chunks from nodes where trim(entity_name) <> ''),
t as (select name, string_agg(distinct x, '|' order by x) as types from (select name, unnest(entity_types) as x from m) where x is not null group by 1),
c as (select name, string_agg(distinct x, '|' order by x) as chunks from (select name, unnest(source_chunks) as x from m) where x is not null group by 1),
d as (select name, string_agg(distinct x, '|' order by x) as descriptions from (select name, unnest(descriptions) as x from m) where x is not null group by 1)
select g.name, g.n, coalesce(t.types, '') as types, coalesce(d.descriptions, '') as descriptions, coalesce(c.chunks, '') as chunks
from (select name, count(*) as n from m group by 1) g left join t using (name) left join d using (name) left join c using (name)""",
    "relation_exact_groups": _relations("s", "t"),
    "relation_unordered_groups": _relations("least(s, t)", "greatest(s, t)"),
    "graph_rebuild_nodes": f"""
with {_MAPPING}, n as (select entity_name as name, coalesce(occurrence_count, 1) as n from nodes where entity_name is not null)
select name, cast(sum(n) as bigint) as n from (
  select mm.t as name, n.n from n join mm on n.name = mm.name
  union all select n.name, n.n from n where n.name not in (select name from m)) group by 1""",
    "graph_rebuild_groups": f"""
with {_MAPPING}, n as (select entity_name as name, coalesce(occurrence_count, 1) as n, entity_types, descriptions, source_chunks from nodes where entity_name is not null),
o as (select mm.t as name, n.n, entity_types, descriptions, source_chunks from n join mm on n.name = mm.name
  union all select * from n where n.name not in (select name from m)),
t as (select name, string_agg(distinct x, '|' order by x) as types from (select name, unnest(entity_types) as x from o) where x is not null group by 1),
c as (select name, string_agg(distinct x, '|' order by x) as chunks from (select name, unnest(source_chunks) as x from o) where x is not null group by 1),
d as (select name, string_agg(distinct x, '|' order by x) as descriptions from (select name, unnest(descriptions) as x from o) where x is not null group by 1)
select g.name, g.n, coalesce(t.types, '') as types, coalesce(d.descriptions, '') as descriptions, coalesce(c.chunks, '') as chunks
from (select name, cast(sum(n) as bigint) as n from o group by 1) g left join t using (name) left join d using (name) left join c using (name)""",
    "graph_rebuild_edges": f"""
with {_MAPPING}, e as (select source as a, target as b, coalesce(weight, 1.0) as w from edges where source is not null and target is not null),
x as (select mm.t as a, b, w from e join mm on a = mm.name union all select a, b, w from e where a not in (select name from m)),
y as (select a, mm.t as b, w from x join mm on b = mm.name union all select a, b, w from x where b not in (select name from m))
select least(a, b) as a, greatest(a, b) as b, sum(w) as w from y where a <> b group by 1, 2""",
    "unique_entity_names": "select distinct name from (select entity_name as name from nodes union all select source from edges union all select target from edges) where trim(name) <> ''",
    "self_heal_nodes": """
with x as (select source as name, id, source_chunks as ch from edges union all select target, id, source_chunks from edges),
f as (select name, id, coalesce(array_to_string(ch, '|'), '') as chunks, row_number() over (partition by name order by id) as k from x
      where name is not null and name not in (select entity_name from nodes where entity_name is not null))
select name, 'UNKNOWN' as type, 1 as n, chunks from f where k = 1""",
    "dangling_edge_filter": """
with k as (select distinct entity_name as name from nodes where entity_name is not null)
select source, target, max(id) as id, arg_max_null(weight, id) as weight from edges
where source in (select name from k) and target in (select name from k) group by 1, 2""",
    "node_upsert": """
select entity_name as name, id, occurrence_count, extractor from (
  select distinct entity_name, id, occurrence_count, extractor, dense_rank() over (partition by entity_name order by loaded_at desc nulls last, id desc) as k
  from nodes where entity_name is not null) where k = 1""",
    "uniqueness_violations": "select entity_name, count(*) as n from (select distinct * from nodes) where entity_name is not null group by 1 having count(*) > 1",
    "resume_pending": "select distinct chunk_id from chunks where chunk_id is not null and chunk_id not in (select x from (select unnest(source_chunks) as x from nodes) where x is not null)",
    "resume_priority": """
select distinct id, truncated from (select id, entity_name, coalesce(len(descriptions), 0) > 3 as truncated from nodes
where entity_name is not null and entity_name not in (select canonical_name from ref_entities))""",
    "merge_precedence": """
with o as (select id, min(coalesce(extractor, '?')) as value, max(occurrence_count) as c, max(degree) as d from nodes group by 1)
select id, case when c is not null and d is not null then 'done:' || c::varchar else value end as value, c is not null and d is not null as kept from o""",
    "node_ids": "select name, row_number() over (order by name) as id from (select distinct entity_name as name from nodes where entity_name is not null)",
    "extraction_totals": """
with a as (select count(*) as n_nodes, count(occurrence_count) as n_counted, count(*) filter (len(descriptions) > 0) as n_described from nodes),
b as (select count(*) as n_edges, count(*) filter (source = target) as n_loops, count(*) filter (source is null or target is null) as n_broken from edges)
select 'n_nodes' as what, n_nodes as n from a union all select 'n_counted', n_counted from a union all select 'n_described', n_described from a
union all select 'n_edges', n_edges from b union all select 'n_loops', n_loops from b union all select 'n_broken', n_broken from b""",
}
