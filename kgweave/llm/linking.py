"""Mapping free-entered values to a canonical list (problem 1).

Values are deduplicated and normalised to plain words (consistent characters, upper case, no marks, keystrokes of the
telex input method undone), and values of the same words are one. Candidates come from an inverted index of the
character trigrams of the entries' names and aliases, weighed by their cubed inverse document frequency in the list; an
entry isn't posted under its commonest trigrams, which together hold less than CUT of its norm. Entries whose trigram
cosine reaches RETRIEVED are candidates.

A candidate's score is a weighted cosine of words. A word of an entry weighs its letters times its squared inverse
document frequency in the list; a word of a value that the entry doesn't have weighs its letters times its inverse
document frequency among the values, so a word that is common beside many names costs little, and a long rare one, or
one that is the rarest of another entry, costs much. Words are alike by their typing slips (at least ALIKE, else not at all), also where
they were split or run together; an alias found as typed stands for the entry. The score must reach THRESHOLD, and beat
that of every other entry by MARGIN unless it alone is 1. An exact check goes with it: distinguishing words must agree.
Those are numbers, numerals, single letters and letters with numbers by their shape (a number with its unit is a
quantity and distinguishes nothing), words of SIDES, and the words that specify in the list itself: those that stand
only behind the rarest word of several entries. THRESHOLD lies between the scores of names two slips away from a word of
seven letters (0.71) and those of names that share only what many entries have (below 0.6).

Defined results: null and blank values, and those without a letter or digit, are unmatched and give no row in ``link``;
several records of one value get the same entry; entries of the same words are one, with the smallest id and the aliases
of all; an alias of two entries leaves a value unmatched; repeated rows give one result; null or repeated aliases don't
count; an empty list leaves every value unmatched; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgweave.functions.names import key_of
from kgweave.session import lanes, materialize, small_enough

RETRIEVED, CUT, ALIKE, THRESHOLD, MARGIN = 0.22, 0.25, 0.6, 0.6, 0.05
#: Words count as frequent (among the values, or as specifying in the list) from one in so many; fewer are all alike.
#: There are at most FREQUENT times the mean number of different words of them, so they may be sent to the workers.
FREQUENT = 10_000
# Words of place, by which one thing is told from another.
SIDES = ["TRÁI", "PHẢI", "TRÊN", "DƯỚI", "TRƯỚC", "SAU", "TRONG", "NGOÀI"]

_NUMERAL = re.compile(r"(?=[IVX])X{0,3}(?:IX|IV|V?I{0,3})")
_LETTERS_NUMBER = re.compile(r"[A-Z]+\d+")
_QUANTITY = re.compile(r"\d+[A-Z]+")
# A syllable as typed by telex: first consonants, vowels, last consonants, keystroke of the tone.
_SYLLABLE = re.compile(r"((?:NGH|NH|NG|CH|TH|TR|PH|KH|GH|GI|QU|DD|[BCDGHKLMNPRSTVX])?)([AEIOUYW]+)((?:NG|NH|CH|[CMNPT])?)([SFRXJ]?)")


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("Đ", "D")


_SIDES = frozenset(map(fold, SIDES))


@lru_cache(1 << 17)
def plain(word: str) -> str:
    """An upper-case word without marks; a syllable typed by telex without the keystrokes of its marks."""
    word = fold(word)
    m = None if len(word) < 3 or _NUMERAL.fullmatch(word) else _SYLLABLE.fullmatch(word)
    if not m:
        return word
    first, vowels, last, tone = m.groups()
    bare = vowels.replace("AA", "A").replace("EE", "E").replace("OO", "O").replace("W", "")
    return first.replace("DD", "D") + bare + last if bare and (tone or bare != vowels or first == "DD") else word


def words_of(name: str) -> list[str]:
    return [plain(w) for w in re.findall(r"[^\W_]+", key_of(name))]


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most and (not before or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(1 << 17)
def told_apart(word: str) -> bool:
    """Whether a word distinguishes things by its shape, or is one of SIDES."""
    return len(word) == 1 or word.isdigit() or word in _SIDES or bool(_NUMERAL.fullmatch(word) or _LETTERS_NUMBER.fullmatch(word))


@lru_cache(1 << 18)
def alike(a: str, b: str) -> float:
    """1 less slips by length; 0 below ALIKE, and for different words of under three letters."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    most = int(n * (1 - ALIKE) + 1e-9)
    if n < 3 or abs(len(a) - len(b)) > most:
        return 0.0
    # A slip takes at most one letter away and brings one.
    left = list(b)
    for c in a:
        if c in left:
            left.remove(c)
    if len(left) > most or len(a) - len(b) + len(left) > most:
        return 0.0
    d = slips(a, b, most)
    return 1 - d / n if d <= most else 0.0


def _run_on(word: str, ending: str) -> bool:
    """Whether ending was written on to the word before it: it isn't the end of a longer number or numeral."""
    before = word[-len(ending) - 1 : -len(ending)]
    if len(word) < len(ending) + 4 or not word.endswith(ending):
        return False
    return not (ending.isdigit() and before.isdigit()) and not (set(ending) <= set("IVX") and before in "IV")


class Score:
    """Weighted cosines of a value's words with entries. common: {word: values that hold it} of the frequent words."""

    def __init__(self, common: dict[str, int], n_values: int, specifying: set[str]):
        self.common, self.n, self.specifying = common, max(n_values, 1), specifying
        self.whole = math.log(1 + min(self.n, FREQUENT))

    def weight(self, word: str) -> float:
        return len(word) * min(1.0, math.log(1 + self.n / self.common.get(word, 1)) / self.whole)

    def _quantities(self, words: list[str], used: list[bool]) -> set[int]:
        """Positions of numbers with a unit and of their units, and of syllables that only look like numerals."""
        out = set()
        for i, w in enumerate(words):
            after = words[i + 1] if i + 1 < len(words) and not used[i + 1] else ""
            if used[i]:
                continue
            if _QUANTITY.fullmatch(w):
                out.add(i)
            elif w.isdigit() and after.isalpha() and len(after) <= 4 and after not in _SIDES and not (_NUMERAL.fullmatch(after)):
                out |= {i, i + 1}
            elif w in ("VI", "XI") and after.isalpha() and len(after) > 1:
                out.add(i)
        return out

    def of(self, words: list[str], entry: list[str], weights: list[float], specifies: list[bool], codes: list[str], heads: list[str] = ()) -> float:
        """0 where a distinguishing word differs. heads: the words of the value that are the rarest of some entry."""
        used, code = [False] * len(words), 0
        for c in codes:
            for i in range(len(words)):
                for k in (1, 2, 3):
                    if i + k <= len(words) and not any(used[i : i + k]) and "".join(words[i : i + k]) == c:
                        used[i : i + k], code = [True] * k, max(code, len(c))
        core = [j for j, w in enumerate(entry) if not told_apart(w)] or list(range(len(entry)))
        missing = [w for j, w in enumerate(entry) if j not in core]
        got = [0.0] * len(entry)
        for j in core:
            for i, w in enumerate(words):
                if w == entry[j] and not used[i]:
                    used[i], got[j] = True, 1.0
                    break
        for q in list(missing):
            for i, w in enumerate(words):
                if w == q and not used[i]:
                    used[i] = True
                    missing.remove(q)
                    break
        if len(missing) == 1:
            for i, w in enumerate(words):
                if not used[i] and _run_on(w, missing[0]):
                    s, j = max((alike(entry[j], w[: -len(missing[0])]), j) for j in core)
                    if s > got[j]:
                        used[i], got[j], missing = True, s, []
                        break
        top = max(core, key=lambda j: weights[j])
        if not got[top] and not code and weights[top] ** 2 > (1 - THRESHOLD**2) * sum(weights[j] ** 2 for j in core):
            # Without its weightiest word the entry can't reach the threshold.
            if not self._options(words, used, entry, [j for j in core if abs(j - top) < 2], got, top):
                return 0.0
        for _, s, j, m, i, k in sorted(self._options(words, used, entry, core, got), reverse=True):
            if not any(got[j : j + m]) and not any(used[i : i + k]):
                got[j : j + m], used[i : i + k] = [s] * m, [True] * k
        if len(missing) == 1 and len(missing[0]) > 2 and missing[0].isalpha():
            for i, w in enumerate(words):
                if not used[i] and not told_apart(w) and slips(w, missing[0], 1) <= 1:
                    used[i], missing = True, []
                    break
        quantities, cost = self._quantities(words, used), 0.0
        for i, w in enumerate(words):
            if not used[i]:
                if i not in quantities and (told_apart(w) or w in self.specifying):
                    return 0.0
                if not (i in quantities and (w.isdigit() or _QUANTITY.fullmatch(w))):
                    cost += (len(w) if w in heads else self.weight(w)) ** 2
        cosine = 0.0
        if not missing and all(got[j] for j in core if specifies[j]):
            all_of = sum(weights[j] ** 2 for j in core)
            met = sum(weights[j] ** 2 for j in core if got[j])
            if met:
                cosine = sum(weights[j] ** 2 * got[j] for j in core) / math.sqrt(all_of * (met + cost))
        return max(cosine, code / math.sqrt(code**2 + cost)) if code else cosine

    @staticmethod
    def _options(words: list[str], used: list[bool], entry: list[str], core: list[int], got: list[float], only: int | None = None) -> list[tuple]:
        """How what is left of the words may be paired, with likeness: one with one, one with two run together. only: of
        the entry's words, the one that must take part."""
        out = []
        for at, j in enumerate(core):
            if got[j]:
                continue
            after = core[at + 1] if at + 1 < len(core) else -1
            run = entry[j] + entry[after] if after == j + 1 and not got[after] and only in (None, j, after) else ""
            alone = only is None or only == j
            for i, w in enumerate(words):
                if used[i]:
                    continue
                if alone and not told_apart(w) and (s := alike(entry[j], w)):
                    out.append((s * len(entry[j]), s, j, 1, i, 1))
                if run and (s := alike(run, w)):
                    out.append((s * len(run), s, j, 2, i, 1))
                if alone and i + 1 < len(words) and not used[i + 1]:
                    if s := alike(entry[j], w + words[i + 1]):
                        out.append((s * len(entry[j]), s, j, 1, i, 2))
                    if i + 2 < len(words) and not used[i + 2] and w + words[i + 1] + words[i + 2] == entry[j]:
                        out.append((len(entry[j]), 1.0, j, 1, i, 3))
        return out


def _words(col: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def read(names: pd.Series) -> pd.Series:
        return pd.Series([words_of(n) if n else [] for n in names], dtype=object)

    return read(col)


def entries(canonical: DataFrame) -> DataFrame:
    """(form_id, ref_id, words, weights, specifies, codes, head): each name of an entry in words: its own and its aliases of
    letters alone; codes are the aliases with digits, which are found as they are or not at all; head is the rarest word."""
    rows = canonical.where("canonical_name is not null").dropDuplicates(["ref_id"])
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull())
    own = rows.select("ref_id", _words("canonical_name").alias("words"), F.posexplode(F.concat(F.array("canonical_name"), aliases)).alias("at", "other"))
    read = own.select("ref_id", "words", "at", _words("other").alias("other"), F.array_join(_words("other"), "").alias("code"))
    is_code = (F.col("at") > 0) & F.col("code").rlike("[0-9]")
    one = read.groupBy("words").agg(
        F.min("ref_id").alias("ref_id"), F.collect_set(F.when(is_code & (F.col("code") != ""), F.col("code"))).alias("codes"), F.collect_set(F.when(~is_code & (F.size("other") > 0), F.col("other"))).alias("names")
    )
    one = one.where(F.size("words") > 0).select("ref_id", "codes", F.explode("names").alias("words"))
    forms = materialize(one.withColumn("form_id", F.xxhash64("ref_id", "words")), "p1 forms")
    n = max(forms.count(), 1)
    parts = forms.select("form_id", F.posexplode("words").alias("pos", "word"))
    idf = F.log(F.lit(2.0 * n) / F.col("df")) / math.log(2.0 * n)
    df = parts.groupBy("word").agg(F.count_distinct("form_id").alias("df"))
    weighed = parts.join(df, "word").withColumn("weight", F.length("word") * idf * idf)
    rarest = weighed.groupBy("form_id").agg(F.max(F.struct("weight", "pos")).alias("top")).select("form_id", F.col("top.pos").alias("rarest"))
    weighed = materialize(weighed.join(rarest, "form_id"), "p1 weighed")
    behind = weighed.groupBy("word").agg((F.min((F.col("pos") > F.col("rarest")).cast("int")) == 1).alias("behind"))
    placed = weighed.join(behind, "word").select("form_id", F.struct("pos", "word", "weight", (F.col("behind") & (F.col("df") > 1)).alias("specifies")).alias("w"))
    ordered = placed.groupBy("form_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    parallel = [F.col(f"w.{c}").alias(a) for c, a in (("word", "words"), ("weight", "weights"), ("specifies", "specifies"))]
    ordered = ordered.join(forms.select("form_id", "ref_id", "codes"), "form_id").select("form_id", "ref_id", *parallel, "codes")
    return materialize(ordered.withColumn("head", F.get("words", F.array_position("weights", F.array_max("weights")).cast("int") - 1)), "p1 entries")


def _grams(letters: Column) -> Column:
    """The different trigrams of a word between its bounds, as 64-bit hashes, by which joins are quicker."""
    padded = F.concat(F.lit("^"), letters, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.xxhash64(F.substring(padded, i, 3))))


def retrieved(values: DataFrame, entry: DataFrame) -> DataFrame:
    """(vid, form_id) of the entries whose trigram cosine with a value reaches RETRIEVED. values: (vid, words)."""
    named = entry.select("form_id", F.explode(F.array_distinct(F.concat(F.array(F.array_join("words", "")), "codes"))).alias("letters"))
    posted = named.select("form_id", F.xxhash64("form_id", "letters").alias("vector"), F.explode(_grams(F.col("letters"))).alias("gram"))
    n = max(named.count(), 1)
    weights = materialize(posted.groupBy("gram").agg(F.pow(F.log(F.lit(2.0 * n) / F.count("*")), 6).alias("w2")), "p1 weights")
    per = Window.partitionBy("vector")
    below = F.sum("w2").over(per.orderBy("w2", "gram").rowsBetween(Window.unboundedPreceding, 0))
    index = posted.join(weights, "gram").withColumn("below", below).withColumn("r2", F.sum("w2").over(per)).where(F.col("below") >= CUT**2 * F.col("r2"))
    # By unit vectors of the entries, so that one number is summed for each pair.
    index = materialize(index.select("gram", "form_id", "vector", (F.col("w2") / F.sqrt("r2")).cast("float").alias("w")), "p1 index")
    near = F.broadcast if small_enough(index, 128) else (lambda d: d)
    # Spread by value first, so that neither sum moves the exploded trigrams.
    spread = values.repartition(lanes(values.sparkSession), "vid").select("vid", F.explode(_grams(F.array_join("words", ""))).alias("gram"))
    norms = spread.join(near(weights), "gram").groupBy("vid").agg(F.sum("w2").alias("q2"))
    part = spread.join(near(index.drop("form_id")), "gram").groupBy("vid", "vector").agg(F.sum("w").alias("part"))
    met = part.join(norms, "vid").where(F.col("part") >= RETRIEVED * F.sqrt("q2")).select("vid", "vector")
    return met.join(near(index.select("vector", "form_id").distinct()), "vector").select("vid", "form_id").distinct()


def frequent_words(values: DataFrame, n: int) -> dict[str, int]:
    """{word: values that hold it}, of the words that one in FREQUENT values or more holds; bounded, as FREQUENT says."""
    counts = values.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r[0]: r[1] for r in counts.where(F.col("n") > max(1.0, n / FREQUENT)).collect()}


def specifying_words(entry: DataFrame) -> set[str]:
    """The words that specify in several entries, at least one in FREQUENT of them; bounded, as FREQUENT says."""
    n = entry.count()
    counts = entry.select(F.explode(F.arrays_zip("words", "specifies")).alias("w")).where("w.specifies").groupBy(F.col("w.words").alias("word")).agg(F.count("*").alias("n"))
    return {r[0] for r in counts.where(F.col("n") >= n / FREQUENT).collect()}


def distinct_values(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, vid) of the different names with words, and (vid, words) of the different lists of words, both written."""
    read = names.where("trim(name) <> ''").distinct().repartition(lanes(names.sparkSession), "name").select("name", _words("name").alias("words"))
    read = materialize(read.where(F.size("words") > 0).select("name", "words", F.xxhash64("words").alias("h")), "p1 names")
    values = materialize(read.select("h", "words").distinct().withColumn("vid", F.monotonically_increasing_id()), "p1 values")
    return read.join(values, ["h", "words"]).select("name", "vid"), values.select("vid", "words")


def scored(values: DataFrame, entry: DataFrame) -> DataFrame:
    """(vid, ref_id, score) of every candidate that reaches THRESHOLD. values: (vid, words)."""
    n = values.count()
    common, specifying = frequent_words(values, n), specifying_words(entry)
    sent = values.sparkSession.sparkContext.broadcast((common, n, specifying))
    near = F.broadcast if small_enough(entry, 2048) else (lambda d: d)

    @F.pandas_udf("double")
    def score(words: pd.Series, own: pd.Series, weights: pd.Series, specifies: pd.Series, codes: pd.Series, heads: pd.Series) -> pd.Series:
        s = Score(*sent.value)
        return pd.Series([s.of(*map(list, x)) for x in zip(words, own, weights, specifies, codes, heads)], dtype="float64")

    pairs = materialize(retrieved(values, entry).join(values, "vid"), "p1 pairs")
    heads = entry.select(F.col("head").alias("word")).distinct()
    held = pairs.select("vid", F.explode("words").alias("word")).distinct().join(F.broadcast(heads) if small_enough(heads, 128) else heads, "word")
    pairs = pairs.join(held.groupBy("vid").agg(F.collect_set("word").alias("heads")), "vid", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))
    # "words" is a column of both sides; the entry's is renamed.
    rows = pairs.repartition(lanes(values.sparkSession)).join(near(entry.drop("head").withColumnRenamed("words", "own")), "form_id")
    met = rows.select("vid", "ref_id", score("words", "own", "weights", "specifies", "codes", "heads").alias("score")).where(F.col("score") >= THRESHOLD)
    return met.groupBy("vid", "ref_id").agg(F.max("score").alias("score"))


def link(values: DataFrame, canonical: DataFrame) -> DataFrame:
    """(name, ref_id, score): the entry of every value of the column ``name`` that has one."""
    names, distinct = distinct_values(values.select("name"))
    entry = entries(canonical)
    order = Window.partitionBy("vid").orderBy(F.desc("score"), "ref_id")
    best = scored(distinct, entry).withColumn("k", F.row_number().over(order)).where("k <= 2")
    two = best.groupBy("vid").agg(F.max(F.when(F.col("k") == 1, F.struct("ref_id", "score"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("next"))
    whole = (F.col("best.score") > 1 - 1e-9) & (F.col("next") <= 1 - 1e-9)
    clear = two.where(F.col("next").isNull() | whole | (F.col("best.score") - F.col("next") >= MARGIN))
    return names.join(clear, "vid").select("name", F.col("best.ref_id").alias("ref_id"), F.col("best.score").alias("score"))


def linked_records(records: DataFrame, canonical: DataFrame, name: str = "entity_name", id_column: str = "id") -> DataFrame:
    """(id, ref_id) of every record whose name has an entry."""
    rows = records.select(F.col(id_column).alias("id"), F.col(name).alias("name"))
    links = materialize(link(rows, canonical).select("name", "ref_id"), "p1 links")
    if small_enough(links, 256):
        links = F.broadcast(links)
    return rows.join(links, "name").select("id", "ref_id").distinct()


def unmatched(records: DataFrame, canonical: DataFrame, name: str = "entity_name") -> DataFrame:
    """(name, n_records) of the values without an entry, blank and null ones included."""
    rows = records.select(F.col(name).alias("name"))
    counted = rows.groupBy("name").agg(F.count("*").alias("n_records"))
    return counted.join(link(counted, canonical).select("name"), "name", "left_anti")
