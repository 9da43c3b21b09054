"""SQL for DuckDB that brings names to one form, written on its own from the same rules as kgweave.functions.names."""

from __future__ import annotations

from kgweave.functions.names import HYPHENS, LOOK_ALIKES

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
_SPACES = "              　"
_DIGITS = [chr(c) for c in range(0x80, 0x20000) if chr(c).isdecimal() and chr(c) not in _WIDE[0]]
_FROM = "".join(LOOK_ALIKES) + _WIDE[0] + _SPACES + HYPHENS.replace("－", "") + "Ⅰ" + "".join(_DIGITS)
_TO = "".join(LOOK_ALIKES.values()) + _WIDE[1] + " " * len(_SPACES) + "-" * (len(HYPHENS) - 1) + "I" + "".join(str(int(c)) for c in _DIGITS)
_GONE = "[\\x{AD}\\x{34F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]"


def form(column: str) -> str:
    out = f"translate(regexp_replace({column}, '{_GONE}', '', 'g'), '{_FROM.replace(chr(39), chr(39) * 2)}', '{_TO.replace(chr(39), chr(39) * 2)}')"
    for numeral, letters in (("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV")):
        out = f"replace({out}, '{numeral}', '{letters}')"
    return f"nfc_normalize({out})"


def key(column: str) -> str:
    return f"upper(trim(regexp_replace({form(column)}, ' +', ' ', 'g')))"


def as_int(sql: str, *columns: str) -> str:
    """The query with these columns as 32-bit integers."""
    return f"select * replace ({', '.join(f'{c}::int as {c}' for c in columns)}) from ({sql})"
