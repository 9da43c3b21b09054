"""Profiles of chunks and reports, retrieval and answer metrics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.operators import index as I
from kgweave.operators import retrieval as R
from kgweave.plans.search import _R, _V, _reports, _vectors
from kgweave.plans.sql import as_int
from kgweave.session import table


def chunk_token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "chunks").select(F.col("metadata.token_count").alias("t")).where("t is not null")
    return t.agg(F.count("*").alias("n"), F.sum("t").alias("total"), F.min("t").alias("low"), F.max("t").alias("high"), F.round(F.avg("t"), 6).alias("mean"), F.median("t").alias("mid"), F.round(F.stddev_samp("t"), 6).alias("sd"), F.count_if(F.col("t") < 200).alias("short"), F.count_if(F.col("t") > 2000).alias("long"))


_BIN = "case when tokens <= 250 then '<=250' when tokens <= 500 then '<=500' when tokens <= 1000 then '<=1000' when tokens <= 2000 then '<=2000' else '>2000' end"


def token_bins(spark, sf_dir):
    g = _reports(spark, sf_dir).groupBy(F.expr(_BIN).alias("bin")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def level_stats(spark, sf_dir):
    """Reports and tokens per level with their share, and whether a day's quota of 500,000 tokens holds them."""
    g = _reports(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("mean"))
    return g.withColumn("percent", F.round(100.0 * F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 4)).withColumn("quota", F.when(F.col("tokens") > 500_000, "over").otherwise("within"))


def token_report(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return r.agg(F.round(F.avg("tokens"), 4).alias("mean"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.round(F.var_samp("tokens"), 2).alias("variance"), F.round(F.stddev_samp("tokens"), 4).alias("sd"), F.max(F.struct("tokens", (-F.col("id")).alias("m")))["m"].alias("minus_longest"))


def call_pacing(spark, sf_dir):
    wait = F.when(F.col("tokens") < 3000, 4).when(F.col("tokens") < 6000, 8).otherwise(15)
    return _reports(spark, sf_dir).groupBy(wait.alias("seconds")).agg(F.count("*").alias("n"))


def _golden(spark, sf_dir):
    """Ranks of each question's expected vector: questions are every hundredth vector, perturbed by its successor."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 100 = 0").select(F.col("id").alias("expected"), F.col("embedding").alias("q"))
    nxt = v.select((F.col("id") - 1).alias("expected"), F.col("embedding").alias("o"))
    queries = q.join(nxt, "expected").select(F.col("expected").alias("query"), F.zip_with("q", "o", lambda a, b: a.cast("double") * 0.6 + b.cast("double")).alias("q"), "expected")
    top = I.top(queries.select((-F.col("query") - 1).alias("query"), "q"), v, 10)
    return queries.select((-F.col("query") - 1).alias("query"), "expected").join(top.select("query", F.col("id").alias("expected"), "rank"), ["query", "expected"], "left")


def retrieval_metrics(spark, sf_dir):
    g = _golden(spark, sf_dir)
    hit = [F.round(100 * F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("int")), 4).alias(f"hr{k}") for k in (1, 3, 5, 10)]
    m = g.agg(F.count("*").alias("n"), *hit, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    return m.withColumn("verdict", F.when((F.col("hr5") >= 70) & (F.col("mrr") >= 0.6), "production").when(F.col("hr5") >= 50, "average").otherwise("poor"))


def _judged(spark, sf_dir):
    """Scores of 0 to 10 per event, not-a-number for a third of them; group B are refusals."""
    e = table(spark, sf_dir, "events")
    none = F.col("event_id") % 3 == 0
    s = [F.when(none, F.lit(float("nan"))).otherwise(F.pmod(F.col("event_id") * k, F.lit(11)).cast("double")).alias(c) for k, c in ((3, "faithfulness"), (5, "relevance"), (7, "comprehensiveness"))]
    return e.select("event_id", *s, F.when(F.col("event_type") == "click", "B").otherwise("A").alias("grp"))


_J = "j as (select event_id, (event_id * 3 % 11)::double as faithfulness, (event_id * 5 % 11)::double as relevance, (event_id * 7 % 11)::double as comprehensiveness, case when event_type = 'click' then 'B' else 'A' end as grp from events where event_id % 3 <> 0)"
_SCORES = ("faithfulness", "relevance", "comprehensiveness")


def scored(rows: DataFrame) -> DataFrame:
    """The rows that have all three scores: neither null nor not-a-number."""
    return rows.dropna(subset=list(_SCORES))



def judge_summary(spark, sf_dir):
    j = scored(_judged(spark, sf_dir))
    aggs = [f(c).alias(f"{c}_{n}") for c in _SCORES for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("sd", lambda c: F.round(F.stddev_samp(c), 6)), ("low", F.min), ("high", F.max))]
    g = j.groupBy("grp").agg(F.count("*").alias("n"), *aggs, F.round(F.avg((F.col("faithfulness") == 10).cast("int")), 6).alias("perfect"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def failed_queries(spark, sf_dir):
    return scored(_judged(spark, sf_dir)).where("faithfulness = 0 or relevance = 0 or comprehensiveness = 0").select("event_id", "grp")


def rescaled_scores(spark, sf_dir):
    """Scores of 0 to 1 put on a scale of 0 to 10; not-a-number counts as 0."""
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 100) / 100)
    return e.select("event_id", F.round(F.nanvl(raw, F.lit(0.0)) * 10, 2).alias("score"))


def stratified_sample(spark, sf_dir):
    """10 reports of level 2 and 5 of level 3 in a seeded order."""
    r = _reports(spark, sf_dir).select("id", "level")
    top = R.top_per(r.where("level in (2, 3)"), "level", [F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), F.col("id")], 10)
    return top.where((F.col("level") == 2) | (F.col("rank") <= 5)).select("level", "id", "rank")


def described_node_sample(spark, sf_dir):
    """50 described nodes in a seeded order: the golden set's items."""
    n = table(spark, sf_dir, "nodes").where("entity_name is not null").select("id", F.get("descriptions", F.lit(0)).alias("d")).where("trim(d) <> ''").distinct()
    return n.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id", "d").limit(50).select("id", "d")


def question_fanout(spark, sf_dir):
    """Of each sampled report 2 personas, of each 2 tasks, of each 2 questions."""
    s = stratified_sample(spark, sf_dir)
    for c in ("persona", "task", "question"):
        s = s.withColumn(c, F.explode(F.slice(F.array(*[F.lit(f"{c} {i}") for i in (1, 2, 3)]), 1, 2)))
    return s.select("id", "persona", "task", "question")


def points_context(spark, sf_dir):
    """Points of answers flattened to one text per user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("types"), F.count("*").alias("n"))


def node_sizes(spark, sf_dir):
    """Sizes of drawn nodes: clamped to 10 to 50."""
    return table(spark, sf_dir, "nodes").where("degree is not null").select("id", F.greatest(F.lit(10.0), F.least(F.lit(50.0), F.col("degree") / 2)).alias("size")).distinct()


QUERIES = {
    f.__name__: f
    for f in (chunk_token_stats, token_bins, level_stats, token_report, call_pacing, retrieval_metrics, judge_summary, failed_queries, rescaled_scores, stratified_sample, described_node_sample, question_fanout, points_context, node_sizes)
}

_SAMPLE = f"{_R}, k as (select level, id, row_number() over (partition by level order by md5(id::varchar || ':42'), id) as rank from rep where level in (2, 3)), s as (select * from k where (level = 2 and rank <= 10) or (level = 3 and rank <= 5))"
_HITS = ", ".join(f"round(100 * avg((coalesce(rank, 99) <= {k})::int), 4) as hr{k}" for k in (1, 3, 5, 10))
_AGGS = ", ".join(f"round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_sd, min({c}) as {c}_low, max({c}) as {c}_high" for c in _SCORES)

SQL = {
    "chunk_token_stats": "with t as (select metadata.token_count as t from chunks where metadata.token_count is not null) select count(*) as n, sum(t)::bigint as total, min(t) as low, max(t) as high, round(avg(t), 6) as mean, median(t) as mid, round(stddev_samp(t), 6) as sd, count(*) filter (t < 200) as short, count(*) filter (t > 2000) as long from t",
    "token_bins": f"with {_R}, g as (select {_BIN} as bin, count(*) as n, sum(tokens)::bigint as tokens from rep group by 1) select *, round(100.0::double * n / sum(n) over (), 4) as percent from g",
    "level_stats": f"with {_R}, g as (select level, count(*) as n, sum(tokens)::bigint as tokens, round(avg(tokens), 4) as mean from rep group by 1) select *, round(100.0::double * tokens / sum(tokens) over (), 4) as percent, case when tokens > 500000 then 'over' else 'within' end as quota from g",
    "token_report": f"with {_R} select round(avg(tokens), 4) as mean, min(tokens) as low, max(tokens) as high, round(var_samp(tokens), 2) as variance, round(stddev_samp(tokens), 4) as sd, (select -id from rep order by tokens desc, id limit 1) as minus_longest from rep",
    "call_pacing": f"with {_R} select case when tokens < 3000 then 4 when tokens < 6000 then 8 else 15 end as seconds, count(*) as n from rep group by 1",
    "retrieval_metrics": f"""
with {_V}, q as (select a.id as expected, list_transform(list_zip(a.e, b.e), lambda z: z[1] * 0.6 + z[2]) as e from v a join v b on b.id = a.id + 1 where a.id % 100 = 0),
s as (select expected, u.id, round((1 + list_dot_product(q.e, u.e) / (sqrt(list_dot_product(q.e, q.e)) * u.n)) / 2, 6) as score from q, u),
r as (select *, row_number() over (partition by expected order by score desc, id) as rank from s), g as (select q.expected, r.rank from q left join r on r.expected = q.expected and r.id = q.expected and r.rank <= 10),
m as (select count(*) as n, {_HITS}, round(avg(coalesce(1 / rank, 0)), 6) as mrr from g)
select *, case when hr5 >= 70 and mrr >= 0.6 then 'production' when hr5 >= 50 then 'average' else 'poor' end as verdict from m""",
    "judge_summary": f"with {_J}, g as (select grp, count(*) as n, {_AGGS}, round(avg((faithfulness = 10)::int), 6) as perfect from j group by 1) select *, round(n / sum(n) over (), 6) as share from g",
    "failed_queries": f"with {_J} select event_id, grp from j where faithfulness = 0 or relevance = 0 or comprehensiveness = 0",
    "rescaled_scores": "select event_id, case when event_id % 5 = 0 then 0.0::double else round((event_id % 100)::double / 100 * 10, 2) end as score from events",
    "stratified_sample": f"with {_SAMPLE} select level, id, rank from s",
    "described_node_sample": "with n as (select distinct id, descriptions[1] as d from nodes where entity_name is not null and trim(descriptions[1]) <> '') select id, d from n order by md5(id::varchar || ':42'), id, d limit 50",
    "question_fanout": f"with {_SAMPLE}, p as (select unnest(['1', '2']) as i) select id, 'persona ' || a.i as persona, 'task ' || b.i as task, 'question ' || c.i as question from s, p a, p b, p c",
    "points_context": "select user_id, '[' || string_agg(distinct '\"' || event_type || '\"', ',' order by '\"' || event_type || '\"') || ']' as types, count(*) as n from events group by 1",
    "node_sizes": "select distinct id, greatest(10.0, least(50.0, degree / 2)) as size from nodes where degree is not null",
}

_INT = {
    "stratified_sample": ["rank"],
}
SQL |= {name: as_int(SQL[name], *columns) for name, columns in _INT.items()}
