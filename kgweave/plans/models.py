"""Model-backed steps with their offline answers, and the checks of model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.operators import model_steps as M
from kgweave.operators import records as R
from kgweave.session import table

RULES = {"guideline": "tài liệu", "paper": "paper|study", "notes": "hồ sơ|ghi"}


def domain_labelling(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.domain_label(F.col("title"), RULES).alias("domain"))


def extraction_round_trip(spark, sf_dir):
    """Offline extraction of the chunks, parsed again: entities per type and chunk."""
    c = table(spark, sf_dir, "chunks").where("content is not null and chunk_id is not null").select("chunk_id", "content").distinct()
    return R.parsed_entities(M.extracted(c).select("chunk_id", "raw")).groupBy("chunk_id", "type").agg(F.count("*").alias("n"))


def consolidated_descriptions(spark, sf_dir):
    """One description per node: the one it has, or the different ones joined."""
    n = table(spark, sf_dir, "nodes").groupBy("id").agg(F.max("descriptions").alias("items"))
    return M.consolidated(n)


def report_validity(spark, sf_dir):
    """Offline reports per entity type, read again; every third has lost its end."""
    r = table(spark, sf_dir, "ref_entities").groupBy("entity_type").agg(F.array_sort(F.collect_set("canonical_name")).alias("names"), F.min("ref_id").alias("c"))
    made = r.select("entity_type", "c", M.offline_report(F.col("c"), F.col("names"), F.transform("names", lambda x: F.concat(x, F.lit(" – x")))).alias("json"))
    cut = made.withColumn("json", F.when(F.col("c") % 3 == 0, F.left("json", F.lit(40))).otherwise(F.col("json")))
    read = M.read_report(F.col("json"))
    return cut.select("entity_type", read.isNotNull().alias("valid"), read["title"].alias("title"), F.size(read["findings"]).alias("n_findings"))


def output_flags(spark, sf_dir):
    """Flags of answers made from the documents' texts: refusal, thinking, broken off."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    reason = F.when(F.col("doc_id") % 50 == 0, "length").otherwise("stop")
    t = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Xin lỗi, tôi không thể trả lời. "), "text")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<THINK>x"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", M.is_refusal(t).alias("refusal"), M.has_thinking(t).alias("thinking"), M.is_broken_off(t, reason, F.lit(0)).alias("broken"))


def token_boost(spark, sf_dir):
    n = table(spark, sf_dir, "nodes").select("id", "occurrence_count").distinct()
    return n.select("id", M.token_limit(F.col("occurrence_count"), 4000, 1500, 12_000).alias("most"))


def synthetic_queries(spark, sf_dir):
    """Of every described node a question: its first description without its name."""
    n = table(spark, sf_dir, "nodes").select("id", F.lower(F.trim("entity_name")).alias("name"), F.lower(F.get("descriptions", F.lit(0))).alias("d")).where("name <> '' and trim(d) <> ''").distinct()
    return n.select("id", M.synthetic_query(F.col("d"), F.col("name")).alias("q"))


def audit_rates(spark, sf_dir):
    """Anomalies among the names, how many were dropped or recovered, and how many leaked (none should)."""
    a = R.audit(table(spark, sf_dir, "nodes").select(F.col("entity_name").alias("name")).where("name is not null").distinct())
    n = F.count_if(F.col("status") != "CLEAN")
    parts = [F.count_if(F.col("status") == s).alias(c) for s, c in (("SUCCESS_DROP_NOISE", "dropped"), ("SUCCESS_RECOVERY", "recovered"), ("FAILED_LEAK", "leaked"))]
    return a.agg(F.count("*").alias("n"), n.alias("anomalies"), *parts).withColumn("rate", F.round(100.0 * (F.col("dropped") + F.col("recovered")) / F.greatest("anomalies", F.lit(1)), 4))


QUERIES = {f.__name__: f for f in (domain_labelling, extraction_round_trip, consolidated_descriptions, report_validity, output_flags, token_boost, synthetic_queries, audit_rates)}

_T = "case when doc_id % 9 = 0 then 'Xin lỗi, tôi không thể trả lời. ' || text when doc_id % 7 = 0 then '<THINK>x' || text else text end"
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"

SQL = {
    "output_flags": f"""
with d as (select doc_id, {_T} as t from documents where text is not null), w as (select doc_id, t, {_STRIP.format('t')} as s from d), l as (select *, {_STRIP.format("string_split(s, chr(10))[-1]")} as line from w)
select doc_id, regexp_matches(t, '{M.REFUSALS}') as refusal, contains(lower(t), '<think>') as thinking,
  doc_id % 50 = 0 or (s <> '' and not contains('{M.SENTENCE_ENDS.replace("'", "''")}', right(s, 1)) and length(s) >= 60
    and (regexp_matches(line, '{M.BROKEN_OFF.replace("(?iU)", "(?i)")}') or length(replace(s, '(', '')) < length(replace(s, ')', '')) or length(line) > 180)) as broken from l""",
    "domain_labelling": "select doc_id, case when title is null then null when contains(lower(title), 'tài liệu') then 'guideline' when regexp_matches(lower(title), 'paper|study') then 'paper' when regexp_matches(lower(title), 'hồ sơ|ghi') then 'notes' else 'Khác' end as domain from documents",
    "consolidated_descriptions": "with n as (select id, max(descriptions) as d from nodes group by 1), c as (select id, list_filter(list_transform(d, lambda x: trim(x)), lambda x: x is not null and x <> '') as d from n) select id, case when len(list_distinct(d)) > 1 then array_to_string(list_sort(list_distinct(d)), '; ') else d[1] end as text from c",
    "report_validity": "with r as (select entity_type, list_sort(list_distinct(list(canonical_name))) as names, min(ref_id) as c from ref_entities group by 1) select entity_type, c % 3 <> 0 as valid, case when c % 3 <> 0 then array_to_string(names[1:3], ', ') end as title, case when c % 3 <> 0 then least(5, len(names))::int end as n_findings from r",
    "token_boost": "select distinct id, least(12000, 4000 + coalesce(occurrence_count, 0) * 1500) as most from nodes",
    "synthetic_queries": "with n as (select distinct id, lower(trim(entity_name)) as name, lower(descriptions[1]) as d from nodes where trim(entity_name) <> '' and trim(descriptions[1]) <> '') select id, 'query: ' || trim(left(replace(d, name, '...'), 80)) as q from n",
}
