"""Normalisation of attribute values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that normalisation removes.
STOP_WORDS = ("for", "a", "of", "the", "and", "to", "in")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(as_column(c), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Whitespace-separated tokens, with repetitions."""
    return F.filter(F.split(clean(c), r"\s+"), lambda x: x != "")


def normalise(c: Column | str) -> Column:
    """Lower case, without stop words, single blanks."""
    return F.array_join(F.filter(tokens(F.lower(clean(c))), lambda x: ~x.isin(*STOP_WORDS)), " ")
