import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kgweave.functions.names import canonical_text, key_of, name_key


@pytest.mark.parametrize(
    "typed, form",
    [
        ("ＶＩÊＭ　Ｇａｎ", "VIÊM Gan"),
        ("VIÊM", "VIÊM"),
        ("ệ", "ệ"),
        ("é̂", "ế"),
        ("а​В", "aB"),
        ("A B C", "A B C"),
        ("A‑B‐C", "A-B-C"),
        ("ÐƉ", "ĐĐ"),
        ("Ⅳ", "IV"),
        ("CO₂ m² 37°C β", "CO₂ m² 37°C β"),
        ("D̵", "Đ"),
        ("a͏́", "á"),
        ("", ""),
        ("  two  spaces ", "  two  spaces "),
    ],
)
def test_form(typed, form):
    assert canonical_text(typed) == form


@given(st.text(alphabet="aAeEoOuUdDđĐ̛̣̀́̂̆ ​АОβ１", max_size=12))
def test_form_is_settled(s):
    once = canonical_text(s)
    assert canonical_text(once) == once
    assert canonical_text(unicodedata.normalize("NFD", once)) == once


def test_key():
    assert key_of("  viêm   GAN​ ") == key_of("VIÊM gan") == "VIÊM GAN"
    assert key_of("viem gan") != key_of("viêm gan")


def test_key_column(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("đ",)], "s string").repartition(1)
    assert {r[0] for r in df.select(name_key("s")).collect()} == {None, "", "Đ"}


def test_look_alikes_of_other_scripts_and_digits():
    pairs = {"Ӏѵ": "Iv", "օ": "o", "Ꭺ": "A", "ꓮ": "A", "ⲟ": "o", "ı": "i", "ʙ": "B", "٣٤": "34", "१२": "12", "𝟗": "9", "Ⅳ": "IV", "²": "²", "₂": "₂", "β": "β", "ệ": "ệ"}
    assert {k: canonical_text(k) for k in pairs} == pairs
