"""Blocking-key encoders: each makes an array of distinct keys of a value. Users may register more."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import tokens

Encoder = Callable[[Column], Column]


def _grams(n: int) -> Encoder:
    def encode(c: Column) -> Column:
        places = F.sequence(F.lit(1), F.char_length(c) - (n - 1))
        grams = F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(n))))
        return F.when(F.char_length(c) >= n, grams).otherwise(F.array().cast("array<string>"))

    return encode


def _metaphone(word: str) -> str:
    """The English metaphone: consonant classes, silent letters dropped, vowels kept at the start only."""
    s = "".join(c for c in word.upper() if "A" <= c <= "Z")
    for a, b in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if s.startswith(a):
            s = b + s[len(a) :]
            break
    out: list[str] = []
    i = 0
    while i < len(s):
        c, after, last = s[i], s[i + 1 : i + 2], s[i - 1] if i else ""
        soft = after != "" and after in "EIY"
        code, step = c, 1
        if c == last and c != "C":
            code = ""
        elif c in "AEIOU":
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == len(s) - 1 and last == "M" else "B"
        elif c == "C":
            if after == "H":
                code, step = "K" if last == "S" else "X", 2
            elif s[i : i + 3] == "CIA":
                code = "X"
            else:
                code = ("" if last == "S" else "S") if soft else "K"
        elif c == "D":
            code, step = ("J", 2) if after == "G" and s[i + 2 : i + 3] in tuple("EIY") else ("T", 1)
        elif c == "G":
            silent = after == "H" and s[i + 2 : i + 3] not in tuple("AEIOU") or s[i:] in ("GN", "GNED", "GNS")
            code = "" if silent else "J" if soft else "K"
        elif c == "H":
            code = "H" if (after != "" and after in "AEIOU") and (last == "" or last not in "CSPTG") else ""
        elif c == "K":
            code = "" if last == "C" else "K"
        elif c == "P":
            code, step = ("F", 2) if after == "H" else ("P", 1)
        elif c == "Q":
            code = "K"
        elif c == "S":
            sh = after == "H" or s[i : i + 3] in ("SIO", "SIA")
            code, step = ("X", 2 if after == "H" else 1) if sh else ("S", 1)
        elif c == "T":
            if s[i + 1 : i + 3] == "CH":
                code = ""
            else:
                code = "X" if s[i : i + 3] in ("TIA", "TIO") else "0" if after == "H" else "T"
            step = 2 if after == "H" else 1
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if after != "" and after in "AEIOU" else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        out.append(code)
        i += step
    return "".join(out)


def _metaphones(c: Column) -> Column:
    @F.pandas_udf("array<string>")
    def over(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [_metaphone(v or "")])

    return over(c)


ENCODERS: dict[str, Encoder] = {
    "term_id": lambda c: F.array(c),
    "tokens": lambda c: F.array_distinct(tokens(c)),
    "bigrams": _grams(2),
    "trigrams": _grams(3),
    "prefixes": lambda c: F.array_distinct(F.array(*[F.substring(c, 1, n) for n in (2, 3, 4)])),
    "suffixes": lambda c: F.array_distinct(F.array(*[F.right(c, F.lit(n)) for n in (2, 3, 4)])),
    "soundex": lambda c: F.array(F.soundex(c)),
    "metaphone": _metaphones,
    "first3": lambda c: F.array(F.substring(F.trim(c), 1, 3)),
    "first1": lambda c: F.array(F.substring(c, 1, 1)),
}


def register_encoder(name: str, encode: Encoder) -> None:
    ENCODERS[name] = encode
