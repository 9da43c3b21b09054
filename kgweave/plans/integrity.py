"""Problem 5: edges that name entities without a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.names import name_key
from kgweave.operators import orphans
from kgweave.plans.sql import key
from kgweave.session import materialize, table


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = orphans.edge_references(table(spark, sf_dir, "edges"), name_key)
    nodes = table(spark, sf_dir, "nodes").select(name_key("entity_name").alias("key"), "loaded_at", "deleted_at")
    return edges, nodes


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.orphan_references(*_parts(spark, sf_dir))
    return found.select("id", "side", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _parts(spark, sf_dir)
    edges = materialize(edges.distinct(), "edges")
    return orphans.orphan_report(orphans.orphan_references(edges, nodes), edges, ["side"])


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_LOST = f"""n as (select {key('entity_name')} as k, loaded_at as a, deleted_at as b from nodes where entity_name is not null),
e as (select id, 'source' as side, source as name, loaded_at as t0 from edges union all select id, 'target', target, loaded_at from edges),
x as (select distinct id, side, t0 as t, {key('name')} as k from e where name is not null),
y as (select x.*, exists (select 1 from n where n.k = x.k and n.a <= x.t and (n.b is null or n.b > x.t)) as there from x where k <> '')"""

SQL = {
    "p5_found": f"with {_LOST} select distinct id, side, strftime(t, '%Y-%m') as period from y where not there",
    "p5_report": f"with {_LOST} select side, strftime(t, '%Y-%m') as period, count(*) as n_references, count(distinct k) as n_keys, count(*) filter (not there) as n_orphans, count(distinct k) filter (not there) as n_orphan_keys from y group by 1, 2",
}
