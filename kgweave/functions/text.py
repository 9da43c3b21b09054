"""Column functions on text: cleaning, headings, dates, files, tokens. All are built-in expressions, null in, null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented capitals and their plain letters, for keys that must be ASCII.
ACCENTED = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐĨŨƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ"
PLAIN = "AAAAEEEIIOOOOUUYADIUOUAAAAAAAAAAAAEEEEEEEEIIOOOOOOOOOOOOUUUUUUUYYYY"


def plain_upper(c: Column) -> Column:
    """Upper case without Vietnamese marks; only characters of the table change."""
    return F.translate(F.upper(c), ACCENTED, PLAIN)


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def estimated_tokens(c: Column) -> Column:
    """Words times 1.3, cut to a whole number; 0 for blank."""
    words = F.size(F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != ""))
    return F.floor(words * 13 / 10).cast("int")


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def parent_url(url: Column) -> Column:
    return F.regexp_replace(url, "/[^/]*$", "")


def url_file(url: Column) -> Column:
    """Last segment, without .pdf, percent-decoded; a plus stays a plus."""
    tail = F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.pdf$", "")
    return F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))


def slug(c: Column, most: int = 50) -> Column:
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(F.trim(kept), r"(?U)[\s-]+", "_"), 1, most)


def day(c: Column) -> Column:
    """A date written d/m/y or y-m-d somewhere in the text; null if there is none."""
    dmy = F.try_to_date(F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy")
    return F.coalesce(dmy, F.try_to_date(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))


def chained(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


# Numbered lines in capitals are second-level headings; wrong characters that stand for others.
ROMAN_LINE, ARABIC_LINE = r"^[IVXLCDM]+\.", r"^\d+\."
CORRECTIONS = {"Ƣ": "Ư", "ƣ": "ư", "–": "-", "—": "-", "\uf0b7": "*", "\uf0b4": "x"}


def corrected(c: Column) -> Column:
    return F.translate(c, "".join(CORRECTIONS), "".join(CORRECTIONS.values()))


def plain_line(line: Column) -> Column:
    """Without heading and emphasis marks."""
    return F.trim(F.regexp_replace(line, "[#*]", ""))


def heading_level(line: Column, roman_before: Column) -> Column:
    """2 for roman-numbered lines in capitals, and arabic-numbered ones where no roman one came before; 1 for other lines
    of more than 3 characters in capitals; else 0."""
    t = plain_line(line)
    return F.when(is_upper(t) & (t.rlike(ROMAN_LINE) | (t.rlike(ARABIC_LINE) & ~roman_before)), 2).when(is_upper(t) & (F.length(t) > 3), 1).otherwise(0)


def truncated(c: Column, most: int = 300) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


# The marks that count as text beside letters and digits.
TEXT_MARKS = r".,!?;:()\-#|*"


def markdown_quality(c: Column) -> Column:
    """100 times the share of non-space characters that are letters, digits or marks of text; 0 for an empty text."""
    dense = F.regexp_replace(c, r"(?U)\s", "")
    kept = F.regexp_replace(dense, rf"(?U)[^\w{TEXT_MARKS}]", "")
    return F.when(F.length(dense) == 0, 0.0).otherwise(F.round(100.0 * F.length(kept) / F.length(dense), 4))


def without_thinking(c: Column) -> Column:
    """Closed and unclosed think blocks removed."""
    return strip(chained(c, [(r"(?is)<think>.*?</think>", ""), (r"(?is)<think>.*$", "")]))


def model_text(c: Column) -> Column:
    """Model output without think blocks, code fences, and a preamble line that ends in a colon."""
    return strip(chained(without_thinking(c), [(r"(?m)^```\w*\s*$", ""), (r"(?i)^\s*(here is|sure|below is|dưới đây là|đây là|sau đây là|tất nhiên)[^\n]*:\s*\n", "")]))


def first_object(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def unwrapped(c: Column) -> Column:
    """The value of an object with one key, as models wrap a plain answer; any other text as it is."""
    read = F.from_json(c, "map<string,string>")
    return F.when(c.rlike(r"(?s)^\s*\{.*\}\s*$") & (F.size(read) == 1), F.get(F.map_values(read), F.lit(0))).otherwise(c)
