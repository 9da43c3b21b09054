"""Records in extraction output, and the rules that clean entity names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.text import chained, squeeze

_RECORD = r'(?is)\("%s"\s*<\|>(.*?)\)'


def fields(c: Column, kind: str) -> Column:
    """The field lists of every record of a kind: up to the first closing bracket, at least three fields."""
    found = F.regexp_extract_all(c, F.lit(_RECORD % kind), 1)
    return F.filter(F.transform(found, lambda r: F.split(F.trim(r), r"\s*<\|>\s*")), lambda f: F.size(f) >= 3)


def _name(c: Column) -> Column:
    return F.upper(squeeze(F.translate(c, "_", " ")))


def parsed_entities(df: DataFrame, text: str = "raw") -> DataFrame:
    """The columns of df but text, with (name, type, description) per entity record."""
    rest = [c for c in df.columns if c != text]
    f = F.col("f")
    return df.select(*rest, F.explode(fields(F.col(text), "entity")).alias("f")).select(*rest, _name(f[0]).alias("name"), _name(f[1]).alias("type"), F.trim(f[2]).alias("description"))


def parsed_relationships(df: DataFrame, text: str = "raw", strict_weight: bool = False) -> DataFrame:
    """(source, target, description, weight) per relationship record. The weight keeps digits only (8.5 becomes 85), 1 if
    there are none; strict_weight limits it to 1 to 10."""
    rest = [c for c in df.columns if c != text]
    f = F.col("f")
    digits = F.nullif(F.regexp_replace(F.coalesce(F.get(f, F.lit(3)), F.lit("")), r"\D", ""), F.lit(""))
    weight = F.coalesce(digits.try_cast("int"), F.lit(1))
    weight = F.least(F.greatest(weight, F.lit(1)), F.lit(10)) if strict_weight else weight
    rows = df.select(*rest, F.explode(fields(F.col(text), "relationship")).alias("f"))
    return rows.select(*rest, _name(f[0]).alias("source"), _name(f[1]).alias("target"), F.trim(f[2]).alias("description"), weight.alias("weight"))


# Marks of parser noise, signs that no clean name holds, words of clinical action, short names to keep.
NOISE = r"ENTITY|#### \("
SUSPICIOUS = r"(?U)[^\w\s\-,().°+/'%µ]|(?i:ENTITY|KEYWORD|VALUE|####)"
ACTIONS = "XỊT|UỐNG|TIÊM|NGƯNG|TĂNG|LIỀU|NGƯỜI LỚN|TRẺ EM|TRUYỀN TĨNH MẠCH"
SHORT_NAMES = ["D", "E", "S", "CK", "EF", "LH", "HB", "XQ"]

# Ordered rules that bring typographic variants of a name together.
SPELLING = [
    ("₁", "1"),
    ("₂", "2"),
    ("₃", "3"),
    ("₄", "4"),
    ("⁺", "+"),
    ("⁻", "-"),
    ("º", "°"),
    ("[’'“”\"]", ""),
    ("[‑–—_]", "-"),
    (r"\s*\(\s*", "("),
    (r"\s*\)\s*", ")"),
    (r"(?<=\d)\s*,\s*(?=\d)", ","),
    (r"(?<=\d)\s+(MG|ML|G|IU|UI|MCG)\b", "$1"),
    (r"INJ\.", "INJ"),
    (r"\s{2,}", " "),
    (r"^\s+|\s+$", ""),
]
# Ordered rules for markup, temperatures and repeated phrases.
_MARKUP = [(r"[#*{}\[\]_><]+", " "), (r"\$", ""), (r"(?<=[A-Z])\s+(?=\d)", ""), (r"\^-", "-"), (r"\s{2,}", " ")]
_HEAT = [("</\\|>", " "), (r"\[\s*O\s*\]\s*C", "°C"), (r"ĐỘ\s+C\b", "°C")]
_LAST = [("DIHYDROXY VITAMIN", "DIHYDROXYVITAMIN"), (r"\b(.+?)(?:\s+\1)+\b", "$1"), (r"\s{2,}", " ")]


def _unicode(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [("(?U)" + p, r) for p, r in rules]


def rules_from(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered rules of a JSON file, [[pattern, replacement], ...] or {pattern: replacement, ...}: a configuration."""
    read = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return [(str(p), str(r)) for p, r in (read.items() if isinstance(read, dict) else read)]


def cleaned(name: Column) -> Column:
    """Upper case without markup; letters and a number after them joined."""
    return F.trim(chained(F.trim(F.upper(name)), _MARKUP))


def spelled(name: Column) -> Column:
    """One spelling of signs, brackets, units and temperatures; repeated phrases once."""
    return F.trim(chained(F.trim(F.upper(name)), _unicode(_HEAT + SPELLING + _LAST)))


def letter_ratio(name: Column) -> Column:
    return F.length(F.regexp_replace(name, "[^A-ZÀ-Ỹ]", "")) / F.greatest(F.length(name), F.lit(1))


def targets(name: Column) -> Column:
    """What a name becomes: nothing (an empty list), itself cleaned, or the parts of a very long list of names."""
    upper = F.trim(F.upper(name))
    clean = spelled(cleaned(name))
    n = F.length(clean)
    noise = upper.rlike(NOISE) | ((F.length(upper) > 4) & (letter_ratio(upper) < 0.25)) | (n == 0)
    too_short = (n <= 2) & (clean.rlike(r"^\d+$") | ((n == 1) & ~clean.isin(SHORT_NAMES)))
    is_list = (n > 150) & clean.contains(",")
    parts = F.filter(F.transform(F.split(clean, ","), lambda p: spelled(p)), lambda p: F.length(p) > 2)
    nothing = F.array().cast("array<string>")
    return F.when(noise | too_short, nothing).when(is_list, parts).when((n > 60) & clean.rlike(ACTIONS), nothing).otherwise(F.array(clean))


def audit(names: DataFrame) -> DataFrame:
    """(name, targets) with what became of anomalies: dropped, recovered, or leaked."""
    t = names.withColumn("targets", targets(F.col("name"))).withColumn("anomaly", F.col("name").rlike(SUSPICIOUS))
    status = (
        F.when(~F.col("anomaly"), "CLEAN")
        .when(F.size("targets") == 0, "SUCCESS_DROP_NOISE")
        .when(F.exists("targets", lambda x: x.rlike(SUSPICIOUS)), "FAILED_LEAK")
        .otherwise("SUCCESS_RECOVERY")
    )
    return t.withColumn("status", status)


def expanded(text: Column, abbreviations: list[tuple[str, str]], whole: bool = False) -> Column:
    """Abbreviations written out, the longest first, each seeing what the ones before it wrote; whole: only whole names.

    The dictionary becomes expressions: it is a configuration, not data."""
    out = text
    for short, long in sorted(abbreviations, key=lambda a: (-len(a[0]), a[0])):
        out = F.when(F.upper(text) == short.upper(), long).otherwise(out) if whole else F.regexp_replace(out, rf"(?U)(?<!\w)\Q{short}\E(?!\w)", long)
    return out
