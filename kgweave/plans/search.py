"""Contexts under a budget, chunk folds, local and global search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.functions.text import estimated_tokens, first_object, model_text, truncated
from kgweave.operators import answers as A
from kgweave.operators import budget as B
from kgweave.operators import index as I
from kgweave.operators import retrieval as R
from kgweave.providers import Offline, complete
from kgweave.plans.sql import as_int
from kgweave.session import table

_TOK = "cast(floor(len(list_filter(string_split_regex({0}, '[ \\t\\n\\r]+'), lambda w: w <> '')) * 13 // 10) as int)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _links(vectors: DataFrame, centres: DataFrame, least: float = 0.3) -> DataFrame:
    """(x, y, w): links of the centres only, weight = cosine in thousandths."""
    own = vectors.join(centres.select("id"), "id").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    return I.at_least(own, vectors, least).select(F.col("query").alias("x"), F.col("id").alias("y"), F.round(F.col("score") * 1000).cast("bigint").alias("w"))


def local_context(vectors: DataFrame, names: DataFrame, query: list[float], term: str, k: int = 5) -> DataFrame:
    """The flagship: keyword and vector branches, best k, their strongest links, context text; one plan."""
    centres = R.hybrid([R.keyword_top(names, term), R.vector_top(vectors, query, k)], k)
    return R.context_text(R.one_hop(centres, _links(vectors, centres)))


def hybrid_local_context(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    query = v.orderBy("id").first()["embedding"]  # one row: the vector of the question
    return local_context(v, v.select("id", F.concat(F.lit("V"), F.col("id").cast("string")).alias("name")), list(query), "V1")


def vector_topk_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    return I.top(queries, v, 10).select("query", "id", "score", "rank")


def vector_index_exact(spark, sf_dir):
    """The same by the index of cells, with every cell looked up."""
    v = _vectors(spark, sf_dir)
    at = I.centres(v)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    return I.search(queries, I.build(v, at), at, 10, probes=len(at)).select("query", "id", "score", "rank")


def vector_index_recall(spark, sf_dir):
    """How many of the exact 10 nearest the index finds in as many cells as it measured to be enough."""
    v = _vectors(spark, sf_dir)
    at = I.centres(v)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    index = I.build(v, at)
    found = I.search(queries, index, at, 10, probes=I.calibrated(v, index, at, 10)).select("query", "id", F.lit(1).alias("hit"))
    both = I.top(queries, v, 10).select("query", "id").join(found, ["query", "id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def keyword_contains(spark, sf_dir):
    n = table(spark, sf_dir, "ref_entities").select(F.col("ref_id").alias("id"), F.col("canonical_name").alias("name"))
    return R.keyword_top(n, "zoran").join(n, "id").select("id", "name", "score")


def node_top_neighbours(spark, sf_dir):
    """Of each node its 5 strongest neighbours, as one text."""
    e = table(spark, sf_dir, "edges").where("source is not null and target is not null and source <> target")
    both = e.select(F.explode(F.array(F.struct(F.col("source").alias("x"), F.col("target").alias("y")), F.struct(F.col("target").alias("x"), F.col("source").alias("y")))).alias("p"), F.coalesce("weight", F.lit(0.0)).alias("w"))
    summed = both.groupBy("p.x", "p.y").agg(F.max("w").alias("w"))
    best = R.top_per(summed, "x", [F.desc("w"), F.col("y")], 5)
    return best.groupBy("x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "y"))), lambda n: n["y"]), "|").alias("near"), F.count("*").alias("n"))


def enriched_text(spark, sf_dir):
    """What a node's vector is made of."""
    n = table(spark, sf_dir, "nodes").where("entity_name is not null")
    first = F.coalesce(F.get(F.filter("descriptions", lambda d: d.isNotNull()), F.lit(0)), F.lit("-"))
    return n.select("id", F.concat(F.lit("passage: "), "entity_name", F.lit(". "), truncated(first)).alias("text")).distinct()


def embedding_coverage(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.groupBy("label").agg(F.count("*").alias("n"), F.count("embedding").alias("n_there"), F.count_if(F.col("embedding").isNull()).alias("n_missing"), F.max(F.size("embedding")).alias("dims"))


def embedding_writeback(spark, sf_dir):
    """Nodes with the vector of their id where there is one: its length and first value."""
    n = table(spark, sf_dir, "nodes").select("id").distinct()
    v = _vectors(spark, sf_dir)
    return n.join(v, "id", "left").select("id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"))


def _reports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).cast("int").alias("level"), "title", "text", estimated_tokens(F.col("text")).alias("tokens"))


def report_levels(spark, sf_dir):
    """Reports with the level of their community, -1 where that is missing."""
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    levels = table(spark, sf_dir, "doc_labels").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").cast("int").alias("level"))
    return r.join(levels, "id", "left").select("id", F.coalesce("level", F.lit(-1)).alias("level"))


def entity_budget_prefix(spark, sf_dir):
    """Per source chunk, nodes by occurrence until 60 of 100 tokens are used."""
    n = table(spark, sf_dir, "nodes").where("entity_name is not null").select("id", "entity_name", F.coalesce("occurrence_count", F.lit(0)).alias("o"), F.explode("source_chunks").alias("chunk")).where("chunk is not null").distinct()
    return B.prefix(n.withColumn("t", estimated_tokens(F.col("entity_name"))), "chunk", [F.desc("o"), "id", "entity_name"], F.col("t"), 60, most_rows=60).select("chunk", "id", "entity_name", "total")


def edge_budget_prefix(spark, sf_dir):
    """Per source name, edges by priority within what its name leaves of 200 tokens."""
    e = table(spark, sf_dir, "edges").where("source is not null and target is not null").select("id", "source", "target", F.coalesce("priority_score", F.lit(-1.0)).alias("p")).distinct()
    sized = e.withColumn("t", estimated_tokens(F.concat_ws(" ", "source", "target"))).withColumn("budget", 200 - estimated_tokens(F.col("source")))
    return B.prefix(sized, "source", [F.desc("p"), "id", "target"], F.col("t"), F.col("budget"), most_rows=200).select("source", "id", "total")


def reduce_context_prefix(spark, sf_dir):
    """Points per level by score, numbered, until 21,000 characters. The points are the lines of the reports, whole."""
    lines = _reports(spark, sf_dir).select("id", F.col("level").alias("key"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    p = lines.withColumn("score", estimated_tokens(F.col("line")).cast("double")).where("score > 0")
    return A.ranked_context(p.withColumn("description", F.concat(F.col("id").cast("string"), F.lit(" "), "line"))).select("key", "k", "score", "total")


def description_budget(spark, sf_dir):
    """Descriptions per name within 300 characters, with how many were left out."""
    d = table(spark, sf_dir, "nodes").where("entity_name is not null").select(F.col("entity_name").alias("name"), F.explode("descriptions").alias("d")).where("trim(d) <> ''").distinct()
    return B.marked_prefix(d, "name", ["d"], F.length("d"), 300, "d")


def description_collapse(spark, sf_dir):
    """Whether a node's descriptions need a model: more than one different; else the first."""
    clean = F.array_distinct(F.filter(F.transform("descriptions", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    n = table(spark, sf_dir, "nodes").select("id", clean.alias("d")).distinct()
    return n.select("id", F.coalesce(F.size("d") > 1, F.lit(False)).alias("needs_model"), F.get("d", F.lit(0)).alias("first"))


def community_text(spark, sf_dir):
    """Rows of a context: id, name and description cut at 300 characters."""
    n = table(spark, sf_dir, "nodes").where("entity_name is not null")
    d = F.array_join(F.coalesce("descriptions", F.array().cast("array<string>")), " ")
    return n.select(F.concat(F.col("id").cast("string"), F.lit(","), "entity_name", F.lit(","), F.when(d == "", "-").otherwise(truncated(d))).alias("row")).distinct()


def merge_small_chunks(spark, sf_dir):
    m = F.col("metadata")
    c = table(spark, sf_dir, "chunks").where("metadata.source_file is not null and chunk_id is not null").select("chunk_id", m["source_file"].alias("file"), F.coalesce(m["split_order"], F.lit(0)).alias("o"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce(m["token_count"], F.lit(0)).alias("tokens")).distinct()
    placed = c.select("file", F.row_number().over(Window.partitionBy("file").orderBy("o", "chunk_id", "tokens", "content")).alias("pos"), "content", "tokens")
    return B.merged_small(placed).select("file", "pos", "tokens", "n", F.length("content").alias("n_chars"))


def pack_chunks(spark, sf_dir):
    """Reports of level 2 packed in a seeded order into contexts of at most 3,500 tokens."""
    packed = B.packed(_reports(spark, sf_dir).where("level = 2").select("id", "tokens"))
    return packed.groupBy("bin").agg(F.sum("tokens").cast("int").alias("tokens"), F.count("*").alias("n"), F.min("id").alias("first"))


def split_documents(spark, sf_dir):
    return B.split_documents(table(spark, sf_dir, "documents"), 150, 20)


def score_filter_points(spark, sf_dir):
    """Points of JSON answers with a score above 0, and the best per answer; unreadable answers have none."""
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('```json\n{"points": [{"description": "'), "event_type", F.lit('", "score": '), F.round("value", 2).cast("string"), F.lit('}, {"description": "zero", "score": 0}, {"score": 5}]'), F.when(F.col("event_id") % 7 == 0, "").otherwise("}"), F.lit("\n```"))
    p = e.select("event_id", A.parsed_points(raw).alias("points")).where(F.size("points") > 0)
    return p.select("event_id", F.size("points").alias("n"), A.top_score(F.col("points")).alias("best"))


def answer_cleaning(spark, sf_dir):
    """Model output cleaned of thinking, fences and preambles; its first object."""
    d = table(spark, sf_dir, "ref_entities").select("ref_id", F.concat(F.lit("<think>a {b} c</think>\nHere is the answer:\n```json\n"), F.lit('{"t": "'), "canonical_name", F.lit('"}\n```')).alias("raw"))
    return d.select("ref_id", model_text(F.col("raw")).alias("clean"), F.get_json_object(first_object(model_text(F.col("raw"))), "$.t").alias("t"))


def global_map_points(spark, sf_dir):
    """The map step over packed reports with the offline provider: scored points, best first."""
    r = _reports(spark, sf_dir).where("level = 2")
    bins = B.packed(r.select("id", "tokens"))
    texts = bins.join(r, "id").groupBy("bin").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("context"))
    prompts = texts.select("bin", F.concat(F.lit("đau thắt ngực và rối loạn nhịp\n---\n"), "context").alias("prompt"))
    return complete(prompts, "prompt", "answer", Offline()).select("bin", F.explode(A.parsed_points(F.col("answer"))).alias("p")).select("bin", "p.description", "p.score")


def report_markdown(spark, sf_dir):
    r = table(spark, sf_dir, "ref_entities")
    findings = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("summary"), F.lit("alias").alias("explanation")))
    return r.select("ref_id", A.report_markdown(F.col("canonical_name"), F.col("entity_type"), findings).alias("md"))


QUERIES = {
    f.__name__: f
    for f in (hybrid_local_context, vector_topk_batch, vector_index_exact, vector_index_recall, keyword_contains, node_top_neighbours, enriched_text, embedding_coverage, embedding_writeback, report_levels, entity_budget_prefix, edge_budget_prefix, reduce_context_prefix, description_budget, description_collapse, community_text, merge_small_chunks, pack_chunks, split_documents, score_filter_points, answer_cleaning, global_map_points, report_markdown)
}

_V = "v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select id, e, sqrt(list_dot_product(e, e)) as n from v)"
_R = f"rep as (select doc_id as id, cast(doc_id % 5 as int) as level, text, {_TOK.format('text')} as tokens from documents where text is not null)"

SQL = {
    "hybrid_local_context": f"""
with {_V}, q as (select e, n from u order by id limit 1),
kw as (select id, 1.0::double as score from u where contains(lower('V' || id), 'v1') order by 'V' || id, id limit 3),
vs as (select u.id, round((1 + list_dot_product(u.e, q.e) / (u.n * q.n)) / 2, 6) as score from u, q order by 2 desc, 1 limit 5),
c as (select id, max(score) as score from (select * from kw union all select * from vs) group by 1 order by 2 desc, 1 limit 5),
l as (select c.id as x, b.id as y, list_dot_product(a.e, b.e) / (a.n * b.n) as cos from c join u a on a.id = c.id join u b on b.id <> a.id),
w as (select x, y, cast(round(cos * 1000) as bigint) as w from l where cos >= 0.3),
t as (select *, row_number() over (partition by x order by w desc, y) as k from w),
s as (select x, count(*) as n, string_agg('- V' || y || ' (' || w || ')', chr(10) order by k) as txt from t where k <= 15 group by 1),
r as (select c.*, row_number() over (order by score desc, id) as rank from c)
select rank, 'V' || id as entity, score, coalesce(n, 0)::int as n_relationships, '=== [' || rank || '] V' || id || ' (' || printf('%.6f', score) || ') ===' || chr(10) || coalesce(txt, 'no relationships') as context from r left join s on r.id = s.x""",
    "vector_topk_batch": f"with {_V}, p as (select a.id as query, b.id as id, round((1 + list_dot_product(a.e, b.e) / (a.n * b.n)) / 2, 6) as score from u a join u b on a.id <> b.id where a.id % 100 = 0), r as (select *, row_number() over (partition by query order by score desc, id) as rank from p) select query, id, score, rank from r where rank <= 10",
    "keyword_contains": "select ref_id as id, canonical_name as name, 1.0::double as score from ref_entities where contains(lower(canonical_name), 'zoran') order by canonical_name, ref_id limit 3",
    "node_top_neighbours": "with b as (select source as x, target as y, coalesce(weight, 0.0) as w from edges where source is not null and target is not null and source <> target union all select target, source, coalesce(weight, 0.0) from edges where source is not null and target is not null and source <> target), g as (select x, y, max(w) as w from b group by 1, 2), r as (select *, row_number() over (partition by x order by w desc, y) as k from g) select x, string_agg(y, '|' order by k) as near, count(*) as n from r where k <= 5 group by 1",
    "enriched_text": "select distinct id, 'passage: ' || entity_name || '. ' || case when length(f) > 300 then left(f, 300) || '...' else f end as text from (select id, entity_name, coalesce(list_filter(descriptions, lambda d: d is not null)[1], '-') as f from nodes where entity_name is not null)",
    "embedding_coverage": "select label, count(*) as n, count(embedding) as n_there, count(*) filter (embedding is null) as n_missing, max(len(embedding)) as dims from embeddings group by 1",
    "embedding_writeback": "select n.id, coalesce(len(embedding), -1) as dims from (select distinct id from nodes) n left join embeddings on vec_id = n.id",
    "report_levels": "select doc_id as id, coalesce(l.level, -1) as level from documents left join (select doc_id, count(*)::int as level from doc_labels group by 1) l using (doc_id)",
    "entity_budget_prefix": f"with n as (select distinct id, entity_name, coalesce(occurrence_count, 0) as o, unnest(source_chunks) as chunk from nodes where entity_name is not null), r as (select chunk, id, entity_name, sum({_TOK.format('entity_name')}) over (partition by chunk order by o desc, id, entity_name rows unbounded preceding) as total from n where chunk is not null) select chunk, id, entity_name, total::bigint as total from r where total <= 60",
    "edge_budget_prefix": f"with e as (select distinct id, source, target, coalesce(priority_score, -1.0) as p from edges where source is not null and target is not null), r as (select source, id, 200 - {_TOK.format('source')} as budget, sum({_TOK.format("source || ' ' || target")}) over (partition by source order by p desc, id, target rows unbounded preceding) as total from e) select source, id, total::bigint as total from r where total <= budget",
    "reduce_context_prefix": f"with {_R}, l as (select id, level as key, unnest(string_split_regex(text, '\\r?\\n')) as line from rep), p as (select key, id || ' ' || line as d, {_TOK.format('line')}::double as score from l), k as (select *, row_number() over (partition by key order by score desc, d) as k from p where score > 0), t as (select key, k, score, sum(length('#' || k || ' (' || score::int || ')' || chr(10) || d || chr(10) || chr(10))) over (partition by key order by k rows unbounded preceding) as total from k) select key, k, score, total::bigint as total from t where total <= 21000",
    "description_budget": "with d as (select distinct entity_name as name, unnest(descriptions) as d from nodes where entity_name is not null), r as (select *, sum(length(d)) over (partition by name order by d rows unbounded preceding) as total from d where trim(d) <> ''), g as (select name, coalesce(string_agg(d, chr(10) order by total) filter (total <= 300), '') as t, count(*) filter (total > 300) as omitted from r group by 1) select name, case when omitted > 0 then t || chr(10) || '...(' || omitted || ' omitted)' else t end as text, omitted from g",
    "description_collapse": "with n as (select distinct id, list_filter(list_transform(descriptions, lambda x: trim(x)), lambda x: x is not null and x <> '') as d from nodes) select distinct id, coalesce(len(list_distinct(d)) > 1, false) as needs_model, d[1] as first from n",
    "community_text": "select distinct id || ',' || entity_name || ',' || case when d = '' then '-' when length(d) > 300 then left(d, 300) || '...' else d end as row from (select id, entity_name, coalesce(array_to_string(descriptions, ' '), '') as d from nodes where entity_name is not null)",
    "merge_small_chunks": """
with recursive c as (select distinct chunk_id, metadata.source_file as file, coalesce(metadata.split_order, 0) as o, coalesce(content, '') as content, coalesce(metadata.token_count, 0) as tokens from chunks where metadata.source_file is not null and chunk_id is not null),
p as (select file, row_number() over (partition by file order by o, chunk_id, tokens, content) as pos, length(content) as l, tokens from c),
r(file, pos, head, tokens, n, l) as (select file, pos, pos, tokens::bigint, 1::bigint, l from p where pos = 1
  union all select p.file, p.pos, case when m then r.head else p.pos end, case when m then r.tokens + p.tokens else p.tokens end, case when m then r.n + 1 else 1 end, case when m then r.l + 1 + p.l else p.l end
  from (select r.*, p2.tokens < 200 or r.tokens < 200 as m from r join p p2 on p2.file = r.file and p2.pos = r.pos + 1) r join p on p.file = r.file and p.pos = r.pos + 1)
select file, head::int as pos, max(tokens)::int as tokens, max(n)::int as n, max(l)::int as n_chars from r group by 1, 2""",
    "pack_chunks": f"""
with recursive {_R}, s as (select id, tokens, row_number() over (order by md5(id::varchar || ':42'), id) as k from rep where level = 2 and tokens <= 3500),
r(k, id, tokens, bin, used) as (select k, id, tokens, 1, tokens from s where k = 1
  union all select s.k, s.id, s.tokens, case when r.used + s.tokens > 3500 and r.used > 0 then r.bin + 1 else r.bin end, case when r.used + s.tokens > 3500 and r.used > 0 then s.tokens else r.used + s.tokens end from r join s on s.k = r.k + 1)
select bin, sum(tokens)::int as tokens, count(*) as n, min(id) as first from r group by 1""",
    "score_filter_points": "select event_id, 1 as n, cast(trunc(round(value, 2)) as int) as best from events where event_id % 7 <> 0 and round(value, 2) > 0",
    "answer_cleaning": "select ref_id, '{\"t\": \"' || canonical_name || '\"}' as clean, canonical_name as t from ref_entities",
    "report_markdown": "select ref_id, '### ' || canonical_name || chr(10) || entity_type || case when len(aliases) > 0 then chr(10) || array_to_string(list_transform(aliases, lambda a: '- ' || a || ': alias'), chr(10)) else '' end || chr(10) || '---' || chr(10) as md from ref_entities",
}

_INT = {
    "hybrid_local_context": ["rank"],
    "vector_topk_batch": ["rank"],
    "embedding_coverage": ["dims"],
    "embedding_writeback": ["dims"],
    "reduce_context_prefix": ["k"],
}
SQL["vector_index_exact"] = SQL["vector_topk_batch"]
_INT["vector_index_exact"] = ["rank"]
SQL |= {name: as_int(SQL[name], *columns) for name, columns in _INT.items()}
