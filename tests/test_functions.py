"""Normalisation, encoders and measures on the pinned fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions import measures as M
from kinloom.functions.encoders import ENCODERS, _metaphone
from kinloom.functions.text import normalise


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


def test_normalise(spark):
    assert one(spark, "This is a  TEST of the", normalise("v")) == "this is test"
    assert one(spark, None, normalise("v")) == ""
    assert one(spark, " \tAnother\n test to ", normalise("v")) == "another test"


@pytest.mark.parametrize(
    ("name", "value", "keys"),
    [
        ("term_id", "a b", ["a b"]),
        ("tokens", " a b a", ["a", "b"]),
        ("bigrams", "abab", ["ab", "ba"]),
        ("bigrams", "a", []),
        ("trigrams", "abcd", ["abc", "bcd"]),
        ("prefixes", "abc", ["ab", "abc"]),
        ("suffixes", "abcde", ["de", "cde", "bcde"]),
        ("first3", " abcd", ["abc"]),
        ("first1", "abc", ["a"]),
        ("soundex", "robert", ["R163"]),
    ],
)
def test_encoders(spark, name, value, keys):
    assert one(spark, value, ENCODERS[name](F.col("v"))) == keys


def test_metaphone():
    assert _metaphone("smith") == _metaphone("smyth")
    assert _metaphone("knight") == _metaphone("night")
    known = {
        "metaphone": "MTFN", "school": "SKL", "science": "SNS", "watch": "WX", "sign": "SN", "signal": "SKNL", "judge": "JJ", "bridge": "BRJ", "wright": "RT",
        "thumb": "0M", "physics": "FSKS", "queen": "KN", "xylophone": "SLFN", "which": "WX", "action": "AKXN", "nation": "NXN", "vision": "FXN", "check": "XK",
        "phone": "FN", "aggressive": "AKRSF", "ghost": "KST", "": "",
    }
    assert {w: _metaphone(w) for w in known} == known


def test_pinned_ratios():
    got = [round(M.py_ratio(a, b), 1) for a, b in (("tony", "tonya"), ("tony", "tonia"), ("tonya", "tonia"), ("cathrine", "catrine"))]
    assert got == [0.9, 0.7, 0.8, 0.9]


def test_jaro_and_damerau():
    assert round(M.py_jaro("martha", "marhta"), 4) == 0.9444
    assert round(M.py_jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert M.damerau_distance("ca", "abc") == 2
    assert M.damerau_distance("ab", "ba", transpose=0.5) == 0.5


def test_properties(spark):
    r = random.Random(1)
    words = ["", "a", *("".join(r.choices("abcd", k=r.randint(1, 8))) for _ in range(12))]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for name in [*M.NATIVE, *M.PYTHON]:
        rows = pairs.select("a", "b", M.measure(name)(F.col("a"), F.col("b")).alias("s")).collect()
        got = {(x.a, x.b): x.s for x in rows}
        assert all(0 <= s <= 1 for s in got.values()), name
        assert all(got[w, w] == 1 for w in words), name
        if name != "ratio":
            assert all(abs(got[a, b] - got[b, a]) < 1e-9 for a, b in got), name
