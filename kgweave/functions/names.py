"""One consistent form of text, and the key under which names that read the same compare equal.

Consistent form: compatibility characters (full-width forms, ligatures, numeral signs) are spelled out, except
superscripts and subscripts; letters of other scripts that look like Latin ones become Latin, and digits of every
script plain digits; invisible characters go;
all white space is U+0020 and all hyphens U+002D; marks are composed. Null stays null, the empty string stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look like a Latin letter, and that letter.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈԚԜҮҺаеорсухѕіјԛԝһԁ", "ABEKMHOPCTYXSIJQWYhaeopcyxsijqwhd"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj"))
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j"}
OLD_CYRILLIC = dict(zip("ӀӏѴѵԌ", "IlVvG"))
ARMENIAN = dict(zip("ՍՏՕհոսօցզ", "USOhnuogq"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎶᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
COPTIC = dict(zip("ⲂⲤⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬⲌⲥⲟⲣ", "BCHIKMNOPTYXZcop"))
# By rule: small capitals are the capitals they are named after.
SMALL_CAPITALS = {c: n[-1] for c in map(chr, range(0x250, 0x1D23)) if (n := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(n.split()) == 5 and len(n.split()[-1]) == 1}
LOOK_ALIKES = CYRILLIC | GREEK | LATIN | OLD_CYRILLIC | ARMENIAN | CHEROKEE | LISU | COPTIC | SMALL_CAPITALS
# Hyphen-like signs. Soft hyphens are invisible and go.
HYPHENS = "‐‑‒–−﹣－"
# The marks that make another Vietnamese letter; they come before the marks of tone.
QUALITY_MARKS = "̛̂̆"
# A mark used for the bar of Đ.
STROKES = "̵̶"
STROKED = {"D": "Đ", "d": "đ"}


def is_invisible(ch: str) -> bool:
    """Format characters, the grapheme joiner, variation selectors, fillers, and controls that aren't white space."""
    kind = unicodedata.category(ch)
    return kind == "Cf" or ch == "͏" or "︀" <= ch <= "️" or ch in "ᅟᅠㅤﾠ" or (kind == "Cc" and not ch.isspace())


def spelled_out(ch: str) -> str | None:
    """The decomposed code points that stand for ch, in no other order than decomposition gives; None: ch itself."""
    if is_invisible(ch):
        return ""
    if ch.isspace():
        return None if ch == " " else " "
    if ch in HYPHENS:
        return "-"
    digit = unicodedata.decimal(ch, None)
    if digit is not None:
        return None if ch == str(digit) else str(digit)
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<super>", "<sub>")):
        return None
    whole = unicodedata.normalize("NFKD" if tag.startswith("<") else "NFD", LOOK_ALIKES.get(ch, ch))
    whole = "".join(LOOK_ALIKES.get(x, x) for x in whole)
    return None if whole == ch else whole


class _Spelling(dict):
    """A str.translate table that is filled as characters appear."""

    def __missing__(self, code: int):
        out = spelled_out(chr(code))
        self[code] = code if out is None else out
        return self[code]


def code_point_table() -> list[tuple[int, str]]:
    """(code point, what stands for it) for every character that isn't its own spelling; Hangul is left alone."""
    out = []
    for code in range(128, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0xE0100 <= code <= 0xE01EF:
            continue
        ch = chr(code)
        if unicodedata.category(ch) in ("Cn", "Co"):
            continue
        whole = spelled_out(ch)
        if whole is not None:
            out.append((code, whole))
    for code in (*range(9, 14), *range(28, 32)):
        out.append((code, " "))
    out += [(c, "") for c in range(32) if c not in (*range(9, 14), *range(28, 32))] + [(127, "")]
    return out


def mark_rank(ch: str) -> int:
    """Order of a mark within its letter: combining class, Vietnamese letter marks before marks of tone."""
    return unicodedata.combining(ch) * 2 + (ch not in QUALITY_MARKS)


#: Text of only these characters is in the consistent form already (the quick check).
SAFE_CLASS = " -~²³¹°ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯưẠ-ỹβγδμ⁰⁴-⁹₀-₉"
_SAFE = re.compile(f"[{SAFE_CLASS}]*")
_MARKS = re.compile(r"[̀-ͯ]{2,}")
_STROKE = re.compile(f"([Dd])((?:[̀-ͯ])*?)[{STROKES}]")


def canonical_text(s: str, table=_Spelling()) -> str:
    if _SAFE.fullmatch(s):
        return s
    s = unicodedata.normalize("NFD", s.translate(table))
    s = _STROKE.sub(lambda m: STROKED[m[1]] + m[2], s)
    s = _MARKS.sub(lambda m: "".join(sorted(m[0], key=mark_rank)), s)
    return unicodedata.normalize("NFC", s)


def key_of(s: str) -> str:
    """What names that read the same have in common: consistent form, upper case, single spaces."""
    return " ".join(canonical_text(s).split()).upper()


def canonical_column(col: Column | str) -> Column:
    @F.pandas_udf("string")
    def consistent(x: pd.Series) -> pd.Series:
        return x.map(canonical_text, na_action="ignore")

    return consistent(col)


def composed(col: Column | str) -> Column:
    """Marks composed with their letters (NFC) and nothing else changed; null for null."""

    @F.pandas_udf("string")
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    return nfc(col)


def name_key(col: Column | str) -> Column:
    """The key of a name; null for null. Python works on Arrow batches; the quick check keeps it cheap."""

    @F.pandas_udf("string")
    def keyed(x: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def one(s):
            if s is None or s != s:
                return None
            k = seen.get(s)
            if k is None:
                k = seen[s] = key_of(s)
            return k

        return pd.Series([one(s) for s in x], dtype=object)

    return keyed(col)
