"""The queries of this package, over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm import groups, linking, mixture, subjects, survivors, tokens, unify
from kgweave.plans.sql import form, key
from kgweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.linked_records(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "ref_entities"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.unmatched(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "ref_entities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.match_groups(table(spark, sf_dir, "fuzzy_mapping_report"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_sizes(p2_found(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"nodes": ["entity_name"], "edges": ["source", "target"]}
    tables = {t: (table(spark, sf_dir, t), cols) for t, cols in fields.items()}
    return unify.inconsistent_values(tables).select("table_name", "id", "field_name").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_records(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "extractors")).where("dominates").select("id")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivor of every name held by several records, whether or not it is best on every field."""
    return survivors.best_records(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "extractors")).select("id", "dominates")


def p4_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.built_records(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "extractors"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_ids("text", tokens.broadcast_model(spark)).alias("ids"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, tokens, and documents that decode to their text."""
    model = tokens.broadcast_model(spark)
    ids = table(spark, sf_dir, "documents").select("source", "text", tokens.token_ids("text", model).alias("ids"))
    back = ids.select("source", F.size("ids").alias("n"), (tokens.decoded("ids", model) == F.coalesce("text", F.lit(""))).alias("same"))
    return back.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"), F.count_if("same").alias("n_same"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mixture.mix(mixture.sizes(table(spark, sf_dir, "documents"), tokens.broadcast_model(spark)), targets), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(*_mixed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects")))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p8_found(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"))


QUERIES = [p1_found, p1_unmatched, p2_found, p2_sizes, p3_found, p4_found, p4_survivors, p4_built, p6_ids, p6_round_trip, p7_mix, p7_shares, p8_found, p8_composition]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


_GROUPS = """recursive p as (select entity_name as a, mapped_to as b from fuzzy_mapping_report where entity_name <> mapped_to),
x as (select a, b from p union select b, a from p), r(v, c) as (select a, a from x union select r.v, x.b from r join x on r.c = x.a),
l as (select v, min(c) as g from r group by 1), n as (select entity_name as v from fuzzy_mapping_report union select mapped_to from fuzzy_mapping_report),
found as (select coalesce(g, v) as group_name, v as entity_name from n left join l using (v) where v is not null)"""

_SAYS = f"list_filter(list_transform({{0}}, lambda x: upper(trim(regexp_replace(x, '[ \\t\\n]+', ' ', 'g')))), lambda x: x is not null and x not in ({', '.join(repr(p) for p in survivors.PLACEHOLDERS)}))"
_BEST = ", ".join(f"max(coalesce({c}, {low})) over (partition by k) = coalesce({c}, {low}) as is_{c}" for c, low in (("d", -1), ("t", -1), ("occurrence_count", -1), ("extracted_at", "timestamp '0001-01-01'"), ("trust", -1)))

_SCORED = f"""s as (select id, {key('entity_name')} as k, entity_name, descriptions, entity_types, len(list_distinct({_SAYS.format('descriptions')})) as d, len(list_distinct({_SAYS.format('entity_types')})) as t, occurrence_count, extracted_at, trust
  from nodes left join extractors using (extractor) where entity_name is not null)"""
_PLACED = "{0} as (select k, {2} as v from (select *, row_number() over (partition by k order by coalesce({1}, -1) desc, trust desc nulls last, extracted_at desc nulls last, {3} desc nulls last) as place from s where k <> '') where place = 1)"
# Null items come first in the order of arrays.
_ITEMS = "list_transform({0}, lambda x: coalesce('1' || x, '0'))"

SQL = {
    "p2_found": f"with {_GROUPS} select group_name, entity_name from found",
    "p2_sizes": f"with {_GROUPS}, s as (select group_name, count(*) as n_names from found group by 1) select n_names, count(*) as n_groups from s group by 1",
    "p3_found": " union ".join(f"select '{t}' as table_name, id, '{c}' as field_name from {t} where {form(c)} <> {c}" for t, c in (("nodes", "entity_name"), ("edges", "source"), ("edges", "target"))),
    "p4_found": f"""
with {_SCORED}, b as (select id, min(id) over (partition by k) <> max(id) over (partition by k) as several, {_BEST} from s where k <> '')
select distinct id from b where several and is_d and is_t and is_occurrence_count and is_extracted_at and is_trust""",
    "p4_survivors": f"""
with {_SCORED}, b as (select k, id, min(id) over (partition by k) <> max(id) over (partition by k) as several, {_BEST},
  row_number() over (partition by k order by d desc, t desc, occurrence_count desc nulls last, extracted_at desc nulls last, trust desc nulls last, id) as place from s where k <> '')
select id, is_d and is_t and is_occurrence_count and is_extracted_at and is_trust as dominates from b where several and place = 1""",
    "p4_built": f"""
with {_SCORED}, g as (select k, count(distinct id) as n_records, max(extracted_at) as extracted_at, max(trust) as trust, max(occurrence_count) as occurrence_count from s where k <> '' group by 1),
{_PLACED.format("n", "1", "entity_name", "entity_name")}, {_PLACED.format("x", "d", "descriptions", _ITEMS.format("descriptions"))}, {_PLACED.format("y", "t", "entity_types", _ITEMS.format("entity_types"))}
select k as key, n.v as entity_name, x.v as descriptions, y.v as entity_types, occurrence_count, extracted_at, trust, n_records from g join n using (k) join x using (k) join y using (k)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
