"""Key tables, inverted lists, block sizes and bans.

Everything starts from one table, ``keys(rec_id, seq, term, field, bkv, value)``: a row for each key of each term
and each non-empty field that the term covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Scheme, Term
from kinloom.functions.encoders import ENCODERS


def term_keys(term: Term) -> Column:
    """Keys of a record for a conjunction: empty attributes are skipped, the others' keys concatenated in order."""
    none = F.lit(None).cast("array<string>")
    got = none
    for k in term.keys:
        value = F.col(f"a_{k.field}")
        own = ENCODERS[k.encoder](value)
        both = F.flatten(F.transform(got, _joined(own)))
        got = F.when(value == "", got).when(got.isNull(), own).otherwise(both)
    keys = F.array_distinct(F.coalesce(got, F.array().cast("array<string>")))
    return F.array_except(keys, F.array(*[F.lit(b) for b in sorted(term.banned)])) if term.banned else keys


def _joined(own: Column):
    return lambda x: F.transform(own, lambda y: F.concat(x, y))


def term_table(records: DataFrame, scheme: Scheme) -> DataFrame:
    """``rec_id, seq, term, bkv, fields``: fields holds (field, value) of what the term covers and is not empty."""
    each = []
    for i, t in enumerate(scheme.terms):
        covered = [
            F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("value")) for f in sorted({k.field for k in t.keys})
        ]
        fields = F.filter(F.array(*covered), lambda x: x.value != "")
        each.append(F.struct(F.lit(i).alias("term"), term_keys(t).alias("bkvs"), fields.alias("fields")))
    named = records.select("rec_id", "seq", F.explode(F.array(*each)).alias("t"))
    return named.select("rec_id", "seq", "t.term", F.explode("t.bkvs").alias("bkv"), "t.fields")


def key_table(records: DataFrame, scheme: Scheme) -> DataFrame:
    own = term_table(records, scheme)
    return own.select("rec_id", "seq", "term", "bkv", F.inline("fields")).select("rec_id", "seq", "term", "field", "bkv", "value")


def record_index(long: DataFrame) -> DataFrame:
    """``field, value, ids``: sorted records of each value."""
    return long.groupBy("field", "value").agg(F.sort_array(F.collect_set("rec_id")).alias("ids"))


def block_index(keys: DataFrame) -> DataFrame:
    """``term, field, bkv, vals``: sorted values of each block."""
    return keys.groupBy("term", "field", "bkv").agg(F.sort_array(F.collect_set("value")).alias("vals"))


def block_sizes(keys: DataFrame, by: tuple[str, ...] = ("term", "field", "bkv")) -> DataFrame:
    """Records of each block; keys hold a record once per block."""
    return keys.groupBy(*by).agg(F.count("*").alias("n"))


def size_histogram(sizes: DataFrame, by: tuple[str, ...] = ("term",)) -> DataFrame:
    """How many blocks have each size."""
    return sizes.groupBy(*by, "n").agg(F.count("*").alias("blocks"))


def small_blocks(keys: DataFrame, less_than: int = 100, by: tuple[str, ...] = ("field", "bkv")) -> DataFrame:
    ok = block_sizes(keys, by).where(F.col("n") < less_than).select(*by)
    return keys.join(ok, list(by), "left_semi")


def oversized(sizes: DataFrame, most: int = 100) -> DataFrame:
    """Keys to ban: ``term, bkv`` of blocks of more than ``most`` records."""
    return sizes.where(F.col("n") > most).select("term", "bkv").distinct()


def without(keys: DataFrame, banned: DataFrame) -> DataFrame:
    return keys.join(banned, ["term", "bkv"], "left_anti")


def good_ratio(sizes: DataFrame, most: int = 100, least: float = 0.9) -> DataFrame:
    """``term, good, bad, passes``: records in blocks of 2 to ``most``, in larger ones, and whether the gate opens."""
    n = F.col("n")
    got = sizes.groupBy("term").agg(
        F.sum(F.when((n > 1) & (n <= most), n).otherwise(0)).alias("good"), F.sum(F.when(n > most, n).otherwise(0)).alias("bad")
    )
    ratio = F.col("good") / (F.col("good") + F.col("bad"))
    return got.withColumn("passes", F.when(F.col("good") == 0, False).otherwise(ratio >= least))


def has_common_block(pairs: DataFrame, records: DataFrame, scheme: Scheme, left: str = "t1", right: str = "t2") -> DataFrame:
    """``pairs`` with a column ``shared``: whether any term gives both records a common key."""
    bkvs = [term_keys(t).alias(f"k{i}") for i, t in enumerate(scheme.terms)]
    own = records.select("rec_id", *bkvs)
    names = [f"k{i}" for i in range(len(scheme.terms))]
    x = own.select(F.col("rec_id").alias(left), *[F.col(c).alias(f"{c}_l") for c in names])
    y = own.select(F.col("rec_id").alias(right), *[F.col(c).alias(f"{c}_r") for c in names])
    any_ = F.lit(False)
    for c in names:
        any_ = any_ | F.arrays_overlap(f"{c}_l", f"{c}_r")
    got = pairs.join(x, left).join(y, right)
    return got.withColumn("shared", F.coalesce(any_, F.lit(False))).drop(*[f"{c}_{s}" for c in names for s in "lr"])
