"""Pages, headings, links, dates, files and profiles of the documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.functions import text as X
from kgweave.operators import lines as L
from kgweave.operators.entities import dense_ids
from kgweave.plans.sql import as_int
from kgweave.session import table

BASE = "https://example.invalid"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pages_html(spark, sf_dir):
    """Listing pages built from the documents: an anchor per document, relative on odd ids, with a date block."""
    d = _docs(spark, sf_dir).where("title is not null and url is not null")
    href = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("url", "^https?://[^/]+", "")).otherwise(F.col("url"))
    html = F.concat(F.lit('<li><a href="'), href, F.lit('">'), "title", F.lit('</a><span class="date">'), F.coalesce("published_date", F.lit("Error")), F.lit("</span></li>"))
    return d.select(F.floor(F.col("doc_id") / 20).alias("page_id"), "doc_id", html.alias("html"))


_HTML = "h as (select doc_id // 20 as page_id, doc_id, '<li><a href=\"' || case when doc_id % 2 = 1 then regexp_replace(url, '^https?://[^/]+', '') else url end || '\">' || title || '</a><span class=\"date\">' || coalesce(published_date, 'Error') || '</span></li>' as html from documents where title is not null and url is not null), a as (select page_id, doc_id, regexp_extract(html, 'href=\"([^\"]*)\"', 1) as href, regexp_extract(html, '>([^<]*)</a>', 1) as title, regexp_extract(html, 'class=\"date\">([^<]*)<', 1) as d from h)"


def _anchors(spark, sf_dir):
    p = _pages_html(spark, sf_dir)
    return p.select("page_id", "doc_id", F.regexp_extract("html", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("html", ">([^<]*)</a>", 1).alias("title"), F.regexp_extract("html", 'class="date">([^<]*)<', 1).alias("d"))


def page_links(spark, sf_dir):
    a = _anchors(spark, sf_dir).where(F.col("href").contains("/phac_do/") & (F.trim("title") != ""))
    return a.select("page_id", "title", X.absolute_url(F.col("href"), BASE).alias("url"))


def page_link_first_wins(spark, sf_dir):
    a = _anchors(spark, sf_dir).select("doc_id", "title", X.absolute_url(F.col("href"), BASE).alias("url"))
    return a.groupBy("url").agg(F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title"))


def page_dates(spark, sf_dir):
    """Published dates with what became of them; documents to fetch again are those without one."""
    a = _anchors(spark, sf_dir)
    found = X.day(F.col("d"))
    status = F.when(F.col("d").isin("Error", "Unknown", "N/A", ""), "missing").when(found.isNull(), "unreadable").otherwise("ok")
    return a.select("doc_id", F.date_format(found, "yyyy-MM-dd").alias("published"), F.left("d", F.lit(4)).alias("year"), status.alias("status"))


def title_repair(spark, sf_dir):
    """A chunk's title replaced by that of the document of its file, where there is one."""
    c = table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id", F.col("metadata.title").alias("old"), F.col("metadata.file_name").alias("file_name")).distinct()
    d = _docs(spark, sf_dir).where("title is not null and title <> 'N/A'").groupBy("file_name").agg(F.min("title").alias("new"))
    return c.join(d, "file_name", "left").select("chunk_id", F.coalesce("new", "old").alias("title"))


def doc_metadata_lookup(spark, sf_dir):
    """Chunks with their document's metadata; N/A where it is missing."""
    c = table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id", F.col("metadata.file_name").alias("file_name")).distinct()
    d = _docs(spark, sf_dir).groupBy("file_name").agg(F.min("publisher").alias("publisher"), F.min("source").alias("source"), F.min("published_date").alias("published_date"))
    j = c.join(d, "file_name", "left")
    return j.select("chunk_id", *[F.coalesce(x, F.lit("N/A")).alias(x) for x in ("publisher", "source", "published_date")])


def file_doc_id_match(spark, sf_dir):
    """Chunk files matched with documents by the last part of the document's URL."""
    d = _docs(spark, sf_dir).where("url is not null").select("doc_id", X.url_file(F.col("url")).alias("tail"))
    c = table(spark, sf_dir, "chunks").select(F.ltrim(F.regexp_extract("metadata.source_file", r"(\d+)\.md$", 1), F.lit("0")).alias("tail")).where("tail <> ''").distinct()
    return d.join(c, "tail", "left").groupBy((F.length("tail") > 6).alias("long_tail")).agg(F.count("*").alias("n"), F.countDistinct("tail").alias("n_tails"), F.min("doc_id").alias("first"))


def unmatched_files(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").select(F.col("metadata.file_name").alias("file_name")).where("file_name is not null").distinct()
    return c.join(_docs(spark, sf_dir).select("file_name"), "file_name", "left_anti")


def download_paths(spark, sf_dir):
    d = _docs(spark, sf_dir)
    name = F.concat_ws("_", F.format_string("DOC_%03d", "doc_id"), F.left(F.regexp_replace("file_name", r"\.pdf$", ""), F.lit(50)))
    return d.select("doc_id", F.concat(F.concat_ws("/", F.coalesce("source", F.lit("khac")), F.coalesce("lang", F.lit("xx")), name), F.lit(".pdf")).alias("path"))


def header_carry_forward(spark, sf_dir):
    return L.with_headers(L.lines(_docs(spark, sf_dir)))


_LINES = r"li as (select doc_id, pos - 1 as pos, line from (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as pos from documents) where regexp_matches(line, '[\p{L}\p{N}\p{P}\p{S}]'))"
_PLAIN = "m0 as (select doc_id, pos, trim(regexp_replace(line, '[#*]', '', 'g')) as t from li), m1 as (select *, coalesce(max((t = upper(t) and t <> lower(t) and regexp_matches(t, '^[IVXLCDM]+\\.'))::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) = 1 as rb from m0), m as (select doc_id, pos, t as title, rb, case when t = upper(t) and t <> lower(t) and (regexp_matches(t, '^[IVXLCDM]+\\.') or (regexp_matches(t, '^[0-9]+\\.') and not rb)) then 2 when t = upper(t) and t <> lower(t) and length(t) > 3 then 1 else 0 end as level from m1)"


def header_counts(spark, sf_dir):
    h = L.with_headers(L.lines(_docs(spark, sf_dir)))
    return h.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("n1"), F.count_if(F.col("level") == 2).alias("n2"), F.count("*").alias("n_lines"))


def arabic_after_roman(spark, sf_dir):
    r = L.levelled(L.lines(_docs(spark, sf_dir)))
    return r.groupBy("doc_id").agg(F.count_if(F.col("roman_before")).alias("n_after"), F.count("*").alias("n_lines"))


def markdown_normalised(spark, sf_dir):
    return L.normalised(_docs(spark, sf_dir))


def page_number_lines(spark, sf_dir):
    """Texts without the lines that only hold a page number."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\s*(Trang|Page)?\s*\d+\s*$"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(kept, "\n").alias("text"))


def scanned_documents(spark, sf_dir):
    return L.scanned(L.lines(_docs(spark, sf_dir)).select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("pos"), "line"))


def true_start_page(spark, sf_dir):
    pages = L.lines(_docs(spark, sf_dir))
    return L.first_page_with(pages, "BÀN LUẬN|FINDINGS", "DANH BẠ|APPENDIX").groupBy("doc_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


def stop_signal_prefix(spark, sf_dir):
    pages = L.lines(_docs(spark, sf_dir)).where("pos < 15")
    return L.until_stop(pages, F.col("line").rlike(r"^## "), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def complex_pages(spark, sf_dir):
    pages = L.lines(_docs(spark, sf_dir))
    return pages.select("doc_id", "pos", (F.col("line").contains("![") | (F.regexp_count("line", F.lit(r"\|")) > 2)).alias("is_complex"))


def markdown_quality(spark, sf_dir):
    q = _docs(spark, sf_dir).where("text is not null").select("doc_id", X.markdown_quality(F.col("text")).alias("score"), F.col("text").contains("|---").alias("has_table"))
    return q.withColumn("status", F.when(F.col("score") >= 80, "PASSED").otherwise("FAILED"))


def table_loss(spark, sf_dir):
    """Rows that look like table rows against table rules: what a conversion lost."""
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.regexp_count("text", F.lit(r"\|")).alias("n_bars"), F.regexp_count("text", F.lit(r"\|---")).alias("n_rules"))
    return d.withColumn("lost", F.when((F.col("n_bars") > 0) & (F.col("n_rules") == 0), 1).otherwise(0))


def special_char_freq(spark, sf_dir):
    n = table(spark, sf_dir, "ref_entities").select(F.explode(F.split("canonical_name", "")).alias("ch"))
    return n.where(F.col("ch").rlike("[^A-Z0-9 ]")).groupBy("ch").agg(F.count("*").alias("n"))


def boundary_tokens(spark, sf_dir):
    n = table(spark, sf_dir, "ref_entities").select(F.split("canonical_name", " ").alias("w"))
    ends = n.select(F.explode(F.array(F.struct(F.lit("first").alias("place"), F.element_at("w", 1).alias("t")), F.struct(F.lit("last").alias("place"), F.element_at("w", -1).alias("t")))).alias("x")).select("x.*")
    ranked = ends.groupBy("place", "t").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "t")))
    return ranked.where("k <= 100")


def length_profile(spark, sf_dir):
    n = table(spark, sf_dir, "nodes").where("entity_name is not null").select(F.length("entity_name").alias("l"))
    return n.agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.stddev_samp("l"), 6).alias("sd"), F.min("l").alias("low"), F.percentile("l", 0.25).alias("q1"), F.percentile("l", 0.5).alias("q2"), F.percentile("l", 0.75).alias("q3"), F.max("l").alias("high"))


def length_outliers(spark, sf_dir):
    return table(spark, sf_dir, "nodes").where((F.length("entity_name") < 3) | (F.length("entity_name") > 60)).select("id", "entity_name").distinct()


def metadata_append(spark, sf_dir):
    """The first 66 reference rows kept, documents of one source appended with ids that go on."""
    old = table(spark, sf_dir, "ref_entities").where("ref_id <= 66").select(F.format_string("DOC_%03d", "ref_id").alias("doc"), F.col("canonical_name").alias("title"))
    new = dense_ids(_docs(spark, sf_dir).where("source = 'ban_tin'").select("doc_id", "title"), "doc_id", "k")
    return old.unionByName(new.select(F.format_string("DOC_%03d", F.col("k") + 66).alias("doc"), "title"))


def domain_labels(spark, sf_dir):
    return _docs(spark, sf_dir).where(~F.col("source").isin("Error", "N/A")).select("source").distinct()


def refetch(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("published_date").isNull() | F.col("published_date").isin("Unknown", "Error", "N/A")).select("doc_id")


def chunk_ids(spark, sf_dir):
    """Chunks renumbered within their file by split order, and named after it."""
    c = table(spark, sf_dir, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("metadata.source_file").alias("f"), F.min("metadata.split_order").alias("o")).where("f is not null")
    k = F.row_number().over(Window.partitionBy("f").orderBy("o", "chunk_id")) - 1
    return c.select("chunk_id", k.alias("split_order"), F.format_string("%s_chunk_%04d", F.regexp_replace("f", r"\.md$", ""), k).alias("new_id"))


QUERIES = {
    f.__name__: f
    for f in (page_links, page_link_first_wins, page_dates, title_repair, doc_metadata_lookup, file_doc_id_match, unmatched_files, download_paths, header_carry_forward, header_counts, arabic_after_roman, markdown_normalised, page_number_lines, scanned_documents, true_start_page, stop_signal_prefix, complex_pages, markdown_quality, table_loss, special_char_freq, boundary_tokens, length_profile, length_outliers, metadata_append, domain_labels, refetch, chunk_ids)
}

SQL = {
    "page_links": f"with {_HTML} select page_id, title, case when starts_with(href, 'http') then href else '{BASE}' || href end as url from a where contains(href, '/phac_do/') and trim(title) <> ''",
    "page_link_first_wins": f"with {_HTML}, u as (select doc_id, title, case when starts_with(href, 'http') then href else '{BASE}' || href end as url from a) select url, min(doc_id) as doc_id, arg_min(title, doc_id) as title from u group by 1",
    "page_dates": f"with {_HTML}, p as (select doc_id, d, coalesce(try_strptime(nullif(regexp_extract(d, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1), ''), '%d/%m/%Y'), try_strptime(nullif(regexp_extract(d, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), ''), '%Y-%m-%d')) as f from a) select doc_id, strftime(f, '%Y-%m-%d') as published, left(d, 4) as year, case when d in ('Error', 'Unknown', 'N/A', '') then 'missing' when f is null then 'unreadable' else 'ok' end as status from p",
    "title_repair": "with c as (select distinct chunk_id, metadata.title as old, metadata.file_name as file_name from chunks where chunk_id is not null), d as (select file_name, min(title) as new from documents where title is not null and title <> 'N/A' group by 1) select chunk_id, coalesce(new, old) as title from c left join d using (file_name)",
    "doc_metadata_lookup": "with c as (select distinct chunk_id, metadata.file_name as file_name from chunks where chunk_id is not null), d as (select file_name, min(publisher) as publisher, min(source) as source, min(published_date) as published_date from documents group by 1) select chunk_id, coalesce(publisher, 'N/A') as publisher, coalesce(source, 'N/A') as source, coalesce(published_date, 'N/A') as published_date from c left join d using (file_name)",
    "file_doc_id_match": "with d as (select doc_id, regexp_replace(list_extract(string_split(url, '/'), -1), '\\.pdf$', '') as tail from documents where url is not null) select length(tail) > 6 as long_tail, count(*) as n, count(distinct tail) as n_tails, min(doc_id) as first from d group by 1",
    "unmatched_files": "select distinct metadata.file_name as file_name from chunks where metadata.file_name is not null and metadata.file_name not in (select file_name from documents where file_name is not null)",
    "download_paths": "select doc_id, coalesce(source, 'khac') || '/' || coalesce(lang, 'xx') || '/' || concat_ws('_', 'DOC_' || lpad(doc_id::varchar, greatest(3, length(doc_id::varchar))::int, '0'), left(regexp_replace(file_name, '\\.pdf$', ''), 50)) || '.pdf' as path from documents",
    "header_carry_forward": f"with {_LINES}, {_PLAIN}, r as (select *, last_value(case when level = 1 then title end ignore nulls) over w as h1, sum((level = 1)::int) over w as run from m window w as (partition by doc_id order by pos rows unbounded preceding)), s as (select *, last_value(case when level = 2 then title end ignore nulls) over (partition by doc_id, run order by pos rows unbounded preceding) as h2 from r) select doc_id, pos, level, trim(coalesce(h1, '') || ' > ' || coalesce(h2, ''), ' >') as context from s",
    "header_counts": f"with {_LINES}, {_PLAIN} select doc_id, count(*) filter (level = 1) as n1, count(*) filter (level = 2) as n2, count(*) as n_lines from m group by 1",
    "arabic_after_roman": f"with {_LINES}, {_PLAIN} select doc_id, count(*) filter (rb) as n_after, count(*) as n_lines from m group by 1",
    "page_number_lines": "select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^[ \\t\\n\\v\\f\\r]*(Trang|Page)?[ \\t\\n\\v\\f\\r]*[0-9]+[ \\t\\n\\v\\f\\r]*$')), chr(10)) as text from documents",
    "scanned_documents": f"with {_LINES}, k as (select doc_id, line, row_number() over (partition by doc_id order by pos) - 1 as pos, count(*) over (partition by doc_id) - 1 as last from li) select doc_id, max(length(trim(line))) <= 50 as is_scan from k where pos = 0 or pos = last or pos = (last + 1) // 2 group by 1",
    "true_start_page": f"with {_LINES}, s as (select doc_id, coalesce(min(pos) filter (regexp_matches(upper(line), 'BÀN LUẬN|FINDINGS') and not regexp_matches(upper(line), 'DANH BẠ|APPENDIX') and pos < 50), 0) as start from li group by 1) select doc_id, min(pos) as first, count(*) as n from li join s using (doc_id) where pos >= start group by 1",
    "stop_signal_prefix": f"with {_LINES}, m as (select doc_id, pos, max(starts_with(line, '## ')::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as b from li where pos < 15) select doc_id, count(*) as n, max(pos) as last from m where coalesce(b, 0) = 0 group by 1",
    "complex_pages": f"with {_LINES} select doc_id, pos, contains(line, '![') or length(line) - length(replace(line, '|', '')) > 2 as is_complex from li",
    "markdown_quality": "with q as (select doc_id, text, regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b]', '', 'g') as d from documents where text is not null), s as (select doc_id, text, case when length(d) = 0 then 0.0::double else round(100.0::double * length(regexp_replace(d, '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}.,!?;:()\\-#|*]', '', 'g')) / length(d), 4) end as score from q) select doc_id, score, contains(text, '|---') as has_table, case when score >= 80 then 'PASSED' else 'FAILED' end as status from s",
    "table_loss": "with d as (select doc_id, length(text) - length(replace(text, '|', '')) as n_bars, (length(text) - length(replace(text, '|---', ''))) // 4 as n_rules from documents where text is not null) select *, case when n_bars > 0 and n_rules = 0 then 1 else 0 end as lost from d",
    "special_char_freq": "select ch, count(*) as n from (select unnest(string_split(canonical_name, '')) as ch from ref_entities) where regexp_matches(ch, '[^A-Z0-9 ]') group by 1",
    "boundary_tokens": "with w as (select string_split(canonical_name, ' ') as w from ref_entities), e as (select 'first' as place, w[1] as t from w union all select 'last', w[-1] from w), c as (select place, t, count(*) as n from e group by 1, 2), r as (select *, row_number() over (partition by place order by n desc, t) as k from c) select * from r where k <= 100",
    "length_profile": "select count(*) as n, round(avg(l), 6) as mean, round(stddev_samp(l), 6) as sd, min(l) as low, quantile_cont(l, 0.25) as q1, quantile_cont(l, 0.5) as q2, quantile_cont(l, 0.75) as q3, max(l) as high from (select length(entity_name) as l from nodes where entity_name is not null)",
    "length_outliers": "select distinct id, entity_name from nodes where length(entity_name) < 3 or length(entity_name) > 60",
    "metadata_append": "select 'DOC_' || lpad(ref_id::varchar, greatest(3, length(ref_id::varchar))::int, '0') as doc, canonical_name as title from ref_entities where ref_id <= 66 union all select 'DOC_' || lpad(k::varchar, greatest(3, length(k::varchar))::int, '0'), title from (select row_number() over (order by doc_id) + 66 as k, title from documents where source = 'ban_tin')",
    "domain_labels": "select distinct source from documents where source not in ('Error', 'N/A')",
    "refetch": "select doc_id from documents where published_date is null or published_date in ('Unknown', 'Error', 'N/A')",
    "chunk_ids": "with c as (select chunk_id, min(metadata.source_file) as f, min(metadata.split_order) as o from chunks where chunk_id is not null group by 1), k as (select *, row_number() over (partition by f order by o nulls first, chunk_id) - 1 as k from c where f is not null) select chunk_id, k as split_order, regexp_replace(f, '\\.md$', '') || '_chunk_' || lpad(k::varchar, greatest(4, length(k::varchar))::int, '0') as new_id from k",
}

_INT = {
    "header_carry_forward": ["pos"],
    "true_start_page": ["first"],
    "stop_signal_prefix": ["last"],
    "complex_pages": ["pos"],
    "table_loss": ["n_bars", "n_rules"],
    "boundary_tokens": ["k"],
    "length_profile": ["low", "high"],
    "chunk_ids": ["split_order"],
}
SQL |= {name: as_int(SQL[name], *columns) for name, columns in _INT.items()}
