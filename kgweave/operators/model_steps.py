"""Model-backed steps with deterministic offline answers, and the checks of what models return."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.text import first_object, model_text, strip
from kgweave.operators import retrieval as R
from kgweave.providers import Complete, Offline, complete, hashed_vector, joined_descriptions

# Delimiters of the extraction format, and the types of entities.
FIELD, RECORD, DONE = "<|>", "####", "[DONE]"
TYPES = ["BỆNH_LÝ", "TRIỆU_CHỨNG", "HOẠT_CHẤT_THUỐC", "XÉT_NGHIỆM", "THỦ_THUẬT", "GIẢI_PHẪU", "TÁC_NHÂN_GÂY_BỆNH"]
# Phrases of a refusal, and of a text that broke off.
REFUSALS = r"(?is)xin lỗi.*không thể|không thể.*xin lỗi|as an ai|i cannot fulfill|tôi không thể.*y tế|y tế.*tôi không thể"
SENTENCE_ENDS = ".!?…)\"»'"
BROKEN_OFF = r"(?iU)(?:[-*•]\s+\S+|:|\(|,\s*|\b(?:và|hoặc|như|ví dụ|bao gồm)\s*)$"


def is_refusal(c: Column) -> Column:
    return F.coalesce(c.rlike(REFUSALS), F.lit(False))


def has_thinking(c: Column) -> Column:
    return F.coalesce(F.lower(c).contains("<think>"), F.lit(False))


#: An answer is near its limit from this share of it, and from so many tokens; only an answer of some length is judged by
#: how it ends, and a last line beyond the longest is no sentence that was finished.
NEAR_LIMIT, LEAST_TOKENS, LEAST_CHARS, LONGEST_LINE = 0.92, 64, 60, 180


def is_broken_off(text: Column, reason: Column, tokens: Column, most: int = 1024) -> Column:
    """Whether an answer was cut: the model said so, or it ends without the end of a sentence, near its limit or in a way
    that tells: on a bare list item, an opened bracket, a comma or a joining word, or in a very long line."""
    told = F.coalesce(reason.isin("length", "max_tokens", "MAX_TOKENS"), F.lit(False))
    whole = strip(F.coalesce(text, F.lit("")))
    unfinished = (whole != "") & ~F.right(whole, F.lit(1)).isin(list(SENTENCE_ENDS))
    at_limit = F.coalesce(tokens, F.lit(0)) >= max(LEAST_TOKENS, int(most * NEAR_LIMIT))
    line = strip(F.substring_index(whole, "\n", -1))
    open_brackets = F.regexp_count(whole, F.lit(r"\(")) - F.regexp_count(whole, F.lit(r"\)"))
    tells = line.rlike(BROKEN_OFF) | (open_brackets > 0) | (F.length(line) > LONGEST_LINE)
    return told | (unfinished & (at_limit | (tells & (F.length(whole) >= LEAST_CHARS))))


def token_limit(boost: Column, base: int, step: int, cap: int) -> Column:
    """The limit for an answer that was cut ``boost`` times."""
    return F.least(F.lit(cap), F.lit(base) + F.coalesce(boost, F.lit(0)) * step)


def read_report(c: Column) -> Column:
    """A report's title and findings, or null if the JSON has no title or findings."""
    r = F.from_json(first_object(model_text(c)), "title string, summary string, rating double, findings array<struct<summary:string,explanation:string>>")
    return F.when(r["title"].isNotNull() & r["findings"].isNotNull(), r)


def domain_label(title: Column, rules: dict[str, str], other: str = "Khác") -> Column:
    """The first domain whose pattern the title matches: the offline answer to classification by title."""
    out = F.lit(other)
    for domain, pattern in reversed(rules.items()):
        out = F.when(F.lower(title).rlike(pattern), domain).otherwise(out)
    return F.when(title.isNotNull(), out)


def offline_extraction(text: str) -> str:
    """Entities: the phrases before 'và', ',' or '.' of each sentence with 'nhóm ghi nhận' or 'liên quan đến'; a
    relationship between the two of a sentence, weight by their length. The format is the model's."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        m = re.search(r"(?:trường hợp|khảo sát) ([^.,;]{3,60}?) (?:liên quan đến|và) ([^.,;]{3,60}?)[.,;]", s)
        if m:
            a, b = (x.strip().upper() for x in m.groups())
            d = s.strip().replace(")", "").replace("(", "")
            out += [f'("entity"{FIELD}{a}{FIELD}{TYPES[0]}{FIELD}{d})', f'("entity"{FIELD}{b}{FIELD}{TYPES[1]}{FIELD}{d})', f'("relationship"{FIELD}{a}{FIELD}{b}{FIELD}{d}{FIELD}{1 + len(a) % 10})']
    return f"\n{RECORD}\n".join([*out, DONE])


def extracted(chunks: DataFrame, provider: Complete | None = None, check: Complete | None = None, more: Complete | None = None) -> DataFrame:
    """chunks(chunk_id, content) with ``raw``: one answer, and where ``check`` says YES a second one joined to it."""
    first = complete(chunks, "content", "raw", provider or Offline(offline_extraction))
    if not (check and more):
        return first
    asked = complete(first, "raw", "__more", check)
    gleaned = complete(asked, "content", "__again", more)
    both = F.concat("raw", F.lit(f"\n{RECORD}\n"), "__again")
    return gleaned.withColumn("raw", F.when(F.upper("__more").contains("YES") & F.col("__again").isNotNull(), both).otherwise(F.col("raw"))).drop("__more", "__again")


def consolidated(descriptions: DataFrame, provider: Complete | None = None) -> DataFrame:
    """(id, text) of descriptions(id, items): the one there is, or the provider's answer where there are several."""
    clean = F.array_distinct(F.filter(F.transform("items", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    d = descriptions.select("id", clean.alias("items"))
    few = d.where(F.coalesce(F.size("items"), F.lit(0)) <= 1).select("id", F.get("items", F.lit(0)).alias("text"))
    many = d.where(F.size("items") > 1).select("id", F.array_join("items", "\n").alias("prompt"))
    return few.unionByName(complete(many, "prompt", "text", provider or Offline(joined_descriptions)).select("id", "text"))


def offline_report(community: Column, names: Column, edges: Column) -> Column:
    """A templated report as JSON: names and edges are arrays of text, most important first."""
    findings = F.transform(F.slice(edges, 1, 5), lambda e: F.struct(e.alias("summary"), F.concat(F.lit("Quan hệ: "), e).alias("explanation")))
    title = F.concat_ws(", ", F.slice(names, 1, 3))
    return F.to_json(F.struct(community.alias("community_id"), title.alias("title"), F.concat(F.size(names).cast("string"), F.lit(" thực thể")).alias("summary"), F.least(F.size(edges).cast("double"), F.lit(10.0)).alias("rating"), findings.alias("findings")))


def synthetic_query(description: Column, name: Column) -> Column:
    """The beginning of a description without the entity's name: an offline question whose answer is the entity."""
    return F.concat(F.lit("query: "), strip(F.left(F.regexp_replace(description, F.concat(F.lit(r"(?iU)\Q"), name, F.lit(r"\E")), "..."), F.lit(80))))


def ask_local(spark: SparkSession, vectors: DataFrame, names: DataFrame, links: Callable[[DataFrame], DataFrame], question: str, k: int = 5, embed: Callable[[str, int], list[float]] = hashed_vector, answer: Complete | None = None) -> str:
    """The answer to one question from the k best nodes and their strongest links; the context itself by default.

    links makes (x, y, w) of the centres it is given. k rows come to the driver."""
    if not question.strip():
        raise ValueError("the question is blank")
    first = vectors.select("embedding").first()
    if first is None:
        return "Không tìm thấy ngữ cảnh phù hợp."
    centres = R.hybrid([R.keyword_top(names, question), R.vector_top(vectors, embed(question, len(first["embedding"])), k)], k)
    context = "\n\n".join(r["context"] for r in R.context_text(R.one_hop(centres, links(centres))).orderBy("rank").collect())
    return answer([f"{question}\n---\n{context}"])[0] if answer else context
