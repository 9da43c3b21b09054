"""Record parsing, name rules and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.functions.names import composed
from kgweave.operators import records as R
from kgweave.operators import resolve as V
from kgweave.providers import hashed_vector
from kgweave.session import materialize, table


def _raw(spark, sf_dir):
    """Extraction output per edge, built from the edges: entity and relationship records, some with brackets inside."""
    e = table(spark, sf_dir, "edges").where("source is not null and target is not null").select("id", "source", "target", F.coalesce(F.get("descriptions", F.lit(0)), F.lit("n/a (none) x")).alias("d"), "weight").distinct()
    w = F.coalesce(F.format_string("%.1f", "weight"), F.lit("strong"))
    raw = F.concat(F.lit('("entity"<|>'), "source", F.lit(" <|>BENH_LY<|> "), "d", F.lit(')####("relationship"<|>'), "source", F.lit("<|> "), "target", F.lit("<|>"), "d", F.lit("<|>"), w, F.lit(')####("entity"<|>'), "target", F.lit(")"))
    return e.select("id", raw.alias("raw"))


_RAW = """e as (select distinct id, source, target, coalesce(descriptions[1], 'n/a (none) x') as d, weight from edges where source is not null and target is not null),
t as (select id, '("entity"<|>' || source || ' <|>BENH_LY<|> ' || d || ')####("relationship"<|>' || source || '<|> ' || target || '<|>' || d || '<|>' || coalesce(printf('%.1f', weight), 'strong') || ')####("entity"<|>' || target || ')' as raw from e)"""


def _flat(kind: str) -> str:
    return f"f as (select id, list_transform(string_split(trim(r), '<|>'), lambda x: trim(x)) as f from (select id, unnest(regexp_extract_all(raw, '(?is)\\(\"{kind}\"\\s*<\\|>(.*?)\\)', 1)) as r from t) where len(string_split(r, '<|>')) >= 3)"


_N = "upper(trim(regexp_replace(replace({0}, '_', ' '), '[ \\t\\n]+', ' ', 'g')))"


def record_entities(spark, sf_dir):
    return R.parsed_entities(_raw(spark, sf_dir))


def record_relationships(spark, sf_dir):
    return R.parsed_relationships(_raw(spark, sf_dir))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "nodes").select(F.col("entity_name").alias("name")).where("name is not null").distinct()


def name_targets(spark, sf_dir):
    return _names(spark, sf_dir).select("name", F.array_join(R.targets(F.col("name")), "|").alias("targets"))


def structural_clean(spark, sf_dir):
    return _names(spark, sf_dir).select("name", R.cleaned(F.col("name")).alias("clean"))


def structural_audit(spark, sf_dir):
    return R.audit(_names(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def noise_rules(spark, sf_dir):
    """Names by rule: the share of letters, marked ones too, that the engine's rules take, and whether too short or long."""
    return _names(spark, sf_dir).select("name", F.round(R.letter_ratio(F.upper("name")), 6).alias("letters"), ((F.length("name") < 3) | (F.length("name") > 60)).alias("outlier"))


ABBREVIATIONS = [("TP", "thành phố"), ("BN", "bệnh nhân"), ("XN", "xét nghiệm"), ("HC", "hội chứng"), ("HCC", "ung thư gan"), ("THK", "thoái hóa khớp")]


def abbreviation_expansion(spark, sf_dir):
    return _names(spark, sf_dir).select("name", R.expanded(F.col("name"), ABBREVIATIONS).alias("expanded"))


def abbreviation_map(spark, sf_dir):
    """The last alias given for each entry wins; aliases are united per entry."""
    a = table(spark, sf_dir, "ref_entities").select("ref_id", "canonical_name", F.explode("aliases").alias("alias")).where("alias is not null")
    return a.groupBy("alias").agg(F.max_by("canonical_name", "ref_id").alias("long"), F.count("*").alias("n"))


def _letters(name):
    """Letters and digits of a name in capitals, marks kept."""
    return F.regexp_replace(name, "[^A-Z0-9À-Ỹ]", "")


def _fuzzy_names(spark, sf_dir):
    """The different names in composed capitals with their marks, single spaces."""
    name = F.trim(F.regexp_replace(F.upper(composed("entity_name")), r"(?U)\s+", " "))
    n = table(spark, sf_dir, "nodes").select("entity_name").where("entity_name is not null").distinct().select(name.alias("name")).where("name <> ''").distinct()
    return n.select("name", _letters(F.col("name")).alias("text"))


def fuzzy_pairs(spark, sf_dir):
    return V.fuzzy_pairs(_fuzzy_names(spark, sf_dir))


def _clusters(spark, sf_dir):
    return materialize(V.clusters(fuzzy_pairs(spark, sf_dir)), "clusters")


def fuzzy_components(spark, sf_dir):
    return V.clusters(fuzzy_pairs(spark, sf_dir))


def medoid_names(spark, sf_dir):
    return V.medoids(_clusters(spark, sf_dir), _letters(F.col("v")))


def shortest_names(spark, sf_dir):
    return V.shortest(_clusters(spark, sf_dir))


def threshold_sweep(spark, sf_dir):
    p = table(spark, sf_dir, "fuzzy_mapping_report").where("entity_name is not null and mapped_to is not null and entity_name <> mapped_to and score is not null")
    return V.sweep(p.select(F.col("entity_name").alias("a"), F.col("mapped_to").alias("b"), "score"), [80.0, 83.0, 85.0, 88.0, 90.0, 92.0, 94.0])


def mapping_validation(spark, sf_dir):
    """Share of mappings whose identifiers (numbers, letters, numerals, critical words) agree; those where either side has
    none aren't judged as violations."""
    p = table(spark, sf_dir, "fuzzy_mapping_report").where("entity_name is not null and mapped_to is not null").select("entity_name", "mapped_to").distinct()
    own = [V.signature(F.upper(c)) for c in ("entity_name", "mapped_to")]
    bad = (own[0] != "") & (own[1] != "") & (own[0] != own[1])
    return p.agg(F.count("*").alias("n"), F.count_if(bad).alias("violations"), F.round(100 - 100.0 * F.count_if(bad) / F.count("*"), 6).alias("precision"))


def cosine_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return V.vector_pairs(v, 0.4).withColumn("cosine", F.round("cosine", 5))


def semantic_clusters(spark, sf_dir):
    return V.clusters(cosine_pairs(spark, sf_dir))


def label_stars(spark, sf_dir, least: float = 0.8, embed=hashed_vector):
    """Greedy stars of subject labels with a cosine above ``least``: the label list is small and comes to the driver in order."""
    labels = [r[0] for r in table(spark, sf_dir, "subjects").where("label_vi is not null").orderBy("subject").select("label_vi").collect()]
    return spark.createDataFrame([(h, ", ".join(g)) for h, g in V.stars(labels, V.label_pairs(labels, embed, least))], "head string, members string")


# The distances of names with marks have no SQL: DuckDB's count bytes. tests/test_whole.py holds them against brute force.
def _identifiers(name: str) -> str:
    words = f"regexp_extract_all({name}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
    return f"array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all({name}, '[0-9]+'), list_filter({words}, lambda x: regexp_matches(x, '^([A-Z]|{V.ROMAN}|{V.CRITICAL})$'))))), '|')"


QUERIES = {
    f.__name__: f
    for f in (record_entities, record_relationships, name_targets, structural_clean, structural_audit, noise_rules, abbreviation_expansion, abbreviation_map, fuzzy_pairs, fuzzy_components, medoid_names, shortest_names, threshold_sweep, mapping_validation, cosine_pairs, semantic_clusters, label_stars)
}

# Characters of words.
_W = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}"

SQL = {
    "record_entities": f"with {_RAW}, {_flat('entity')} select id, {_N.format('f[1]')} as name, {_N.format('f[2]')} as type, f[3] as description from f",
    "record_relationships": f"with {_RAW}, {_flat('relationship')} select id, {_N.format('f[1]')} as source, {_N.format('f[2]')} as target, f[3] as description, coalesce(try_cast(nullif(regexp_replace(coalesce(f[4], ''), '[^0-9]', '', 'g'), '') as int), 1) as weight from f",
    "structural_clean": "with n as (select distinct entity_name as name from nodes where entity_name is not null) select name, trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(upper(trim(name)), '[#*{}\\[\\]_><]+', ' ', 'g'), '$', ''), '([A-Z])[ \\t\\n\\r\\f\\v]+([0-9])', '\\1\\2', 'g'), '^-', '-'), '[ \\t\\n\\r\\f\\v]{2,}', ' ', 'g')) as clean from n",
    "noise_rules": "with n as (select distinct entity_name as name from nodes where entity_name is not null) select name, round(length(regexp_replace(upper(name), '[^A-ZÀ-Ỹ]', '', 'g')) / greatest(length(upper(name)), 1), 6) as letters, length(name) < 3 or length(name) > 60 as outlier from n",
    "abbreviation_expansion": f"with n as (select distinct entity_name as name from nodes where entity_name is not null), w as (select name, regexp_extract_all(name, '[{_W}]+|[^{_W}]+') as w from n) select name, array_to_string(list_transform(w, lambda x: case x {' '.join(f"when '{a}' then '{b}'" for a, b in ABBREVIATIONS)} else x end), '') as expanded from w",
    "abbreviation_map": "with a as (select ref_id, canonical_name, unnest(aliases) as alias from ref_entities) select alias, arg_max(canonical_name, ref_id) as long, count(*) as n from a where alias is not null group by 1",
    "threshold_sweep": "with recursive th(t) as (select unnest([80.0, 83.0, 85.0, 88.0, 90.0, 92.0, 94.0])), p as (select t, entity_name as a, mapped_to as b from fuzzy_mapping_report, th where entity_name <> mapped_to and score >= t), x as (select t, a, b from p union select t, b, a from p), r(t, v, c) as (select t, a, a from x union select r.t, r.v, x.b from r join x on r.c = x.a and r.t = x.t), l as (select t, v, min(c) as component from r group by 1, 2) select t::double as threshold, count(distinct component) as n_clusters, count(*) - count(distinct component) as n_merged from l group by 1",
    "mapping_validation": f"with p as (select distinct entity_name, mapped_to from fuzzy_mapping_report where entity_name is not null and mapped_to is not null), d as (select {_identifiers('upper(entity_name)')} as x, {_identifiers('upper(mapped_to)')} as y from p) select count(*) as n, count(*) filter (x <> '' and y <> '' and x <> y) as violations, round(100 - 100.0 * count(*) filter (x <> '' and y <> '' and x <> y) / count(*), 6) as precision from d",
    "cosine_pairs": "with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select id, e, sqrt(list_dot_product(e, e)) as n from v) select a.id as a, b.id as b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 5) as cosine from n a join n b on a.id < b.id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.4",
    "semantic_clusters": "with recursive v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select id, e, sqrt(list_dot_product(e, e)) as n from v), p as (select a.id as a, b.id as b from n a join n b on a.id < b.id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.4), x as (select a, b from p union select b, a from p), r(v, c) as (select a, a from x union select r.v, x.b from r join x on r.c = x.a) select v, min(c) as component from r group by 1",
}
