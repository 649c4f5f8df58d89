"""Choice of a similarity measure for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.measures import POOL, measure
from kinloom.operators.evaluate import average_precision
from kinloom.sources.readers import attributes


def pair_values(labels: DataFrame, records: DataFrame) -> DataFrame:
    """``t1, t2, label, field, a, b``: the attributes of labelled pairs, place by place."""
    own = F.array(*attributes(records))
    x = records.select(F.col("rec_id").alias("t1"), own.alias("x"))
    y = records.select(F.col("rec_id").alias("t2"), own.alias("y"))
    both = labels.select("t1", "t2", "label").join(x, "t1").join(y, "t2")
    each = both.select("t1", "t2", "label", F.posexplode(F.arrays_zip("x", "y")).alias("field", "v"))
    return each.select("t1", "t2", "label", "field", F.col("v.x").alias("a"), F.col("v.y").alias("b"))


def measured(values: DataFrame, pool: tuple[str, ...] = POOL) -> DataFrame:
    """``field, measure, truth, score`` of every pair and measure; pairs with an empty value score 0."""
    distinct = values.select("a", "b").distinct()
    made = distinct.select("a", "b", *[measure(m)(F.col("a"), F.col("b")).alias(m) for m in pool])
    own = values.join(made, ["a", "b"])
    empty = (F.col("a") == "") | (F.col("b") == "")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("measure"), F.when(empty, 0.0).otherwise(F.col(m)).alias("score")) for i, m in enumerate(pool)]))
    return own.select("field", F.col("label").alias("truth"), each.alias("m")).select("field", "m.place", "m.measure", "truth", "m.score")


def by_average_precision(measured_: DataFrame) -> DataFrame:
    """``field, measure, average_precision`` of the best measure; ties go to the pool's order."""
    ap = average_precision(measured_, ("field", "place", "measure"))
    best = F.max_by(F.struct("measure", "average_precision"), F.struct(F.round("average_precision", 9), -F.col("place")))
    return ap.groupBy("field").agg(best.alias("b")).select("field", "b.*")


def min_max(measured_: DataFrame) -> DataFrame:
    """``field, measure, loss``: the measure with the smallest 1 - mean(positive) + mean(negative), to 5 digits."""
    mean = lambda v: F.coalesce(F.avg(F.when(F.col("truth") == v, F.col("score"))), F.lit(0.0))
    loss = measured_.groupBy("field", "place", "measure").agg(F.round(1 - mean(1) + mean(0), 5).alias("loss"))
    best = F.min_by(F.struct("measure", "loss"), F.struct("loss", "place"))
    return loss.groupBy("field").agg(best.alias("b")).select("field", "b.*")


def in_shared_blocks(values: DataFrame, keys: DataFrame) -> DataFrame:
    """``values`` (of ``pair_values``) with ``shared``: whether the two records have a common key that covers the field."""
    own = keys.select("rec_id", "term", "field", "bkv")
    x = values.select("t1", "t2", "field").join(own.withColumnRenamed("rec_id", "t1"), ["t1", "field"])
    met = x.join(own.withColumnRenamed("rec_id", "t2"), ["t2", "term", "field", "bkv"]).select("t1", "t2", "field").distinct()
    got = values.join(met.withColumn("shared", F.lit(True)), ["t1", "t2", "field"], "left")
    return got.withColumn("shared", F.coalesce("shared", F.lit(False)))


def choose(
    labels: DataFrame, records: DataFrame, by_ap: bool = True, pool: tuple[str, ...] = POOL,
    mode: str = "full", keys: DataFrame | None = None, covered: set[int] | None = None,
) -> list[str]:
    """The best measure of each field. In the vector mode ``block`` a similarity counts only where ``keys`` bring the two
    together (elsewhere 0); in ``parfull`` that holds for fields which the scheme does not cover; ``full`` counts all."""
    values = pair_values(labels, records)
    if mode != "full":
        values = in_shared_blocks(values, keys)
        counts = F.col("shared") | (F.col("field").isin(sorted(covered or ())) if mode == "parfull" else F.lit(False))
        # a value that does not count is empty, and pairs with an empty value score 0
        values = values.withColumn("a", F.when(counts, F.col("a")).otherwise(""))
    got = measured(values, pool)
    best = by_average_precision(got) if by_ap else min_max(got)
    found = {r.field: r.measure for r in best.collect()}
    return [found.get(i, pool[0]) for i in range(len(attributes(records)))]
