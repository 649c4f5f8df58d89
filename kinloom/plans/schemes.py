"""Learning of a blocking scheme in disjunctive normal form."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.config import Key, Scheme, Term
from kinloom.operators.blocking import block_sizes, good_ratio, key_table, oversized
from kinloom.operators.evaluate import counted
from kinloom.sources.readers import attributes

MOST_FEATURES = 1000


def candidate_terms(fields: int, encoders: tuple[str, ...], most: int) -> list[Term]:
    """All conjunctions of 1 to ``most`` keys."""
    keys = [Key(f, e) for f in range(fields) for e in encoders]
    return [Term(c) for k in range(1, most + 1) for c in combinations(keys, k)]


def _inside(keys: DataFrame, most_block: int) -> DataFrame:
    sizes = block_sizes(keys)
    ok = sizes.where((F.col("n") > 1) & (F.col("n") <= most_block)).select("term", "field", "bkv")
    return keys.join(ok, ["term", "field", "bkv"], "left_semi").select("term", "field", "bkv", "rec_id")


def block_pairs(keys: DataFrame, most_block: int = 100) -> DataFrame:
    """``term, field, bkv, t1, t2``: pairs (t1 < t2) inside blocks of bounded size, once for each block."""
    own = _inside(keys, most_block)
    x, y = own.withColumnRenamed("rec_id", "t1"), own.withColumnRenamed("rec_id", "t2")
    return x.join(y, ["term", "field", "bkv"]).where(F.col("t1") < F.col("t2"))


def feature_scores(keys: DataFrame, pos: DataFrame, most_block: int = 100, min_good: float = 0.9) -> DataFrame:
    """``term, good, bad, tp, fp, fn, fsc`` of every term of the key table, in one job.

    Pairs count once for each block. False negatives are the records of a block's false pairs that occur in any positive pair.
    Terms that the gate stops aren't expanded and score 0.
    """
    gate = good_ratio(block_sizes(keys), most_block, min_good)
    open_ = keys.join(gate.where("passes").select("term"), "term", "left_semi")
    truth = pos.select(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2")).distinct()
    pairs = block_pairs(open_, most_block).join(truth.withColumn("is_match", F.lit(1)), ["t1", "t2"], "left")
    counts = pairs.groupBy("term").agg(F.count("is_match").alias("tp"), F.count_if(F.col("is_match").isNull()).alias("fp"))
    known = truth.select(F.explode(F.array("t1", "t2")).alias("rec_id")).distinct()
    false_ = pairs.where(F.col("is_match").isNull()).select("term", "field", "bkv", F.explode(F.array("t1", "t2")).alias("rec_id")).distinct()
    missed = false_.join(known, "rec_id", "left_semi").groupBy("term").agg(F.count("*").alias("fn"))
    got = gate.join(counts, "term", "left").join(missed, "term", "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    fsc = F.when(F.col("passes") & (tp > 0), 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return got.select("term", "good", "bad", "tp", "fp", "fn", fsc.alias("fsc"))


def coverage(keys: DataFrame, labels: DataFrame, most_block: int = 100) -> DataFrame:
    """``term, t1, t2, label``: labelled pairs that a term brings together in a block of bounded size."""
    own = _inside(keys, most_block)
    named = labels.select(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"), "label")
    x = named.join(own.withColumnRenamed("rec_id", "t1"), "t1")
    return x.join(own.withColumnRenamed("rec_id", "t2"), ["term", "field", "bkv", "t2"]).select("term", "t1", "t2", "label").distinct()


def patterns(covers: DataFrame) -> DataFrame:
    """``terms, label, n``: how many labelled pairs exactly these terms bring together."""
    each = covers.groupBy("t1", "t2", "label").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return each.groupBy("terms", "label").agg(F.count("*").alias("n"))


def best_scheme(scores: list[tuple[int, float]], counted: list[tuple[list[int], int, int]], positives: int, most: int) -> list[int]:
    """Terms of the disjunction with the best F1: by size, then rank; the first strict maximum stays.

    ``counted``: the rows of ``patterns``.
    """
    ranked = top_terms(scores)
    hit = np.zeros((len(ranked), len(counted)), bool)
    place = {t: i for i, t in enumerate(ranked)}
    for j, (terms, _, _) in enumerate(counted):
        hit[[place[t] for t in terms if t in place], j] = True
    weight = np.array([[n if label else 0, 0 if label else n] for _, label, n in counted], "f8").reshape(-1, 2)
    best, found = 0.0, []
    for size in range(1, most + 1):
        for some in combinations(range(len(ranked)), size - 1):
            first = some[-1] + 1 if some else 0
            any_ = hit[first:] | hit[list(some)].any(axis=0)
            tp, fp = (any_ @ weight).T
            f1 = np.where(tp > 0, 2 * tp / np.maximum(tp + fp + positives, 1), 0.0)
            if len(f1) and f1.max() > best:
                best, found = float(f1.max()), [ranked[i] for i in (*some, first + int(f1.argmax()))]
    return found


def top_terms(scores: list[tuple[int, float]]) -> list[int]:
    return [t for t, s in sorted(scores, key=lambda x: (-x[1], x[0])) if s > 0][:MOST_FEATURES]


def classed(records: DataFrame) -> DataFrame:
    """``rec_id, cls``: the class of each record, the smallest id of those with equal attributes."""
    names = attributes(records)
    return records.join(counted(records).select(*names, F.col("rec_id").alias("cls")), names).select("rec_id", "cls")


def with_classes(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``t1, t2, c1, c2``: distinct pairs (t1 < t2) of records and their classes."""
    named = pairs.select(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2")).where(F.col("t1") < F.col("t2")).distinct()
    of = lambda t, c: classed(records).toDF(t, c)
    return named.join(of("t1", "c1"), "t1").join(of("t2", "c2"), "t2").select("t1", "t2", "c1", "c2")


def partners(pairs: DataFrame) -> DataFrame:
    """``rec_id, cls, other, n``: how many partners of class ``other`` a record has. ``pairs``: as of ``with_classes``."""
    side = lambda t, c, o: pairs.groupBy(F.col(t).alias("rec_id"), F.col(c).alias("cls"), F.col(o).alias("other")).agg(F.count("*").alias("n"))
    return side("t1", "c1", "c2").union(side("t2", "c2", "c1")).groupBy("rec_id", "cls", "other").agg(F.sum("n").alias("n"))


_BLOCK = ["term", "field", "bkv"]


def class_keys(own: DataFrame, scheme: Scheme) -> DataFrame:
    """``term, field, bkv, cls, n``: keys of classes (``evaluate.counted``) with their numbers of records."""
    keys = key_table(own.select("rec_id", F.col("n").alias("seq"), *attributes(own)), scheme)
    return keys.select(*_BLOCK, F.col("rec_id").alias("cls"), F.col("seq").alias("n"))


def class_blocks(keys: DataFrame, most_block: int = 100, min_good: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The gate of every term, and the keys (``class_keys``) of blocks of bounded size of the terms that it lets through, with the
    blocks' numbers of records and classes."""
    sizes = keys.groupBy(*_BLOCK).agg(F.sum("n").alias("n"), F.count("*").alias("classes"))
    gate = good_ratio(sizes, most_block, min_good)
    held = sizes.where((F.col("n") > 1) & (F.col("n") <= most_block)).join(gate.where("passes").select("term"), "term", "left_semi")
    return gate, keys.drop("n").join(held.withColumnRenamed("n", "size"), _BLOCK)


def shared_terms(inside: DataFrame, counts: DataFrame) -> DataFrame:
    """``a, b, label, n, term, blocks``: in how many blocks a term brings two classes with ``n`` labelled pairs together."""
    x, y = inside.select(*_BLOCK, F.col("cls").alias("a")), inside.select(*_BLOCK, F.col("cls").alias("b"))
    spread = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism, "a")  # a pair of classes meets in many blocks
    return spread.join(x, "a").join(y, [*_BLOCK, "b"]).groupBy("a", "b", "label", "n", "term").agg(F.count("*").alias("blocks"))


def class_scores(gate: DataFrame, inside: DataFrame, shared: DataFrame, known: DataFrame, own: DataFrame) -> DataFrame:
    """As ``feature_scores``, from counts of classes; no pair of records is made. ``known``: ``partners`` of the positive pairs.

    A record is in no false pair of a block if its partners are all others of every class of the block.
    """
    sums = lambda df, x, name: df.groupBy("term").agg(F.sum(x).alias(name))
    blocks = inside.select(*_BLOCK, "size").distinct()
    pairs = sums(blocks, F.expr("size * (size - 1) div 2"), "pairs")
    tp = sums(shared.where("label = 1"), F.col("n") * F.col("blocks"), "tp")
    seen = known.select("rec_id", "cls").distinct()
    there = sums(inside.join(seen.groupBy("cls").agg(F.count("*").alias("k")), "cls"), "k", "there")
    weight = own.select(F.col("rec_id").alias("other"), F.col("n").alias("w"))
    whole = known.join(weight, "other").where(F.col("n") == F.col("w") - (F.col("other") == F.col("cls")).cast("long"))
    alone = seen.join(weight.where("w = 1").select(F.col("other").alias("cls")), "cls").select("rec_id", "cls", F.col("cls").alias("other"))
    sets = whole.select("rec_id", "cls", "other").union(alone).groupBy("rec_id", "cls").agg(F.sort_array(F.collect_set("other")).alias("others"))
    sets = sets.where(F.array_contains("others", F.col("cls"))).groupBy("cls", "others").agg(F.min("rec_id").alias("which"), F.count("*").alias("m"))
    met = sets.select("which", "m", F.col("cls").alias("mine"), F.explode("others").alias("cls")).join(inside, "cls")
    met = met.groupBy("which", "m", "classes", *_BLOCK).agg(F.count("*").alias("c"), F.max(F.col("cls") == F.col("mine")).alias("has"))
    true_ = sums(met.where((F.col("c") == F.col("classes")) & F.col("has")), "m", "only")
    got = gate
    for more in (pairs, tp, there, true_):
        got = got.join(more, "term", "left")
    got = got.na.fill(0, ["pairs", "tp", "there", "only"])
    got = got.withColumns({"fp": F.col("pairs") - F.col("tp"), "fn": F.col("there") - F.col("only")})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    fsc = F.when(F.col("passes") & (tp > 0), 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return got.select("term", "good", "bad", "tp", "fp", "fn", fsc.alias("fsc"))


def class_patterns(shared: DataFrame) -> DataFrame:
    """As ``patterns``, from pairs of classes."""
    each = shared.groupBy("a", "b", "label", "n").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return each.groupBy("terms", "label").agg(F.sum("n").alias("n"))


def learn_scheme(records: DataFrame, pos: DataFrame, neg: DataFrame, fields: int, encoders=("term_id", "tokens"), conjunction=2, disjunction=2, most_block=100, min_good=0.9) -> Scheme | None:
    """The scheme, with its terms' scores; None if no term scores. ``bans`` makes the keys that it bans.

    Keys hang on attributes only, so all is counted by classes of equal records; an id occurs once. Positive pairs (t1, t2) that have
    their classes c1, c2 already are taken to be distinct, with t1 < t2; of others each pair counts once, and none of a record with itself.
    To the driver come one score per term, and counts of labelled pairs by the set of terms that bring them together.
    """
    terms = candidate_terms(fields, tuple(encoders), conjunction)
    own = counted(records).repartition(records.sparkSession.sparkContext.defaultParallelism, "rec_id").persist()  # a few rows have many keys
    known = partners(pos if "c1" in pos.columns else with_classes(pos, records)).persist()
    a, b = F.col("cls"), F.col("other")
    good = known.where(a <= b).groupBy(a.alias("a"), b.alias("b")).agg(F.sum("n").alias("n"))
    good = good.select("a", "b", F.lit(1).alias("label"), F.when(F.col("a") == F.col("b"), F.expr("n div 2")).otherwise(F.col("n")).alias("n"))
    bad = with_classes(neg, records).groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))
    bad = bad.agg(F.count("*").alias("n")).select("a", "b", F.lit(0).alias("label"), "n")
    keys = class_keys(own, Scheme(tuple(terms))).persist()
    gate, inside = class_blocks(keys, most_block, min_good)
    gate, inside = gate.persist(), inside.persist()
    shared = shared_terms(inside, good.union(bad)).persist()
    scores = [(r.term, r.fsc) for r in class_scores(gate, inside, shared, known, own).select("term", "fsc").collect()]
    best = top_terms(scores)
    counted_ = class_patterns(shared.where(F.col("term").isin(best))).collect() if best else []
    positives = known.agg(F.sum("n")).first()[0] or 0
    chosen = best_scheme(scores, [(r.terms, r.label, r.n) for r in counted_], positives // 2, disjunction)
    for df in (shared, inside, gate, keys, known, own):
        df.unpersist()
    score = dict(scores)
    return Scheme(tuple(Term(terms[t].keys, score[t]) for t in chosen)) if chosen else None


def bans(records: DataFrame, scheme: Scheme, most_block: int = 100) -> DataFrame:
    """``term, bkv``: keys of oversized blocks, a table for ``blocking.without``."""
    return oversized(block_sizes(key_table(records, scheme)), most_block)


def scheme_f1(covers: DataFrame, positives: int, terms: list[int]) -> DataFrame:
    """tp, fp and F1 of a disjunction of terms."""
    any_ = covers.where(F.col("term").isin(terms)).select("t1", "t2", "label").distinct()
    c = any_.agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    tp = F.col("tp")
    return c.withColumn("f1", F.when(tp == 0, 0.0).otherwise(2 * tp / (tp + F.col("fp") + F.lit(positives))))


def fisher(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fisher score of ``x`` by ``label``: squared difference of means over the sum of squared population variances.

    0 where the positives' mean is 0; a sum of 0 counts as 0.01. With it the difference of means.
    """
    when = lambda v: F.when(F.col("label") == v, F.col("x"))
    s = values.groupBy(*by).agg(
        F.avg(when(1)).alias("m1"), F.avg(when(0)).alias("m0"), F.var_pop(when(1)).alias("v1"), F.var_pop(when(0)).alias("v0")
    )
    spread = F.col("v1") * F.col("v1") + F.col("v0") * F.col("v0")
    top = F.pow(F.col("m1") - F.col("m0"), F.lit(2.0))
    score = F.when(F.col("m1") == 0, 0.0).otherwise(top / F.when((F.col("v1") == 0) & (F.col("v0") == 0), 0.01).otherwise(spread))
    return s.select(*by, score.alias("fisher"), (F.col("m1") - F.col("m0")).alias("mean_diff"))


def ranked(scores: DataFrame, most: int = MOST_FEATURES) -> DataFrame:
    """The ``most`` best terms with a score, ties by number, with their ``rank``; what is not among them is not sorted."""
    order = Window.orderBy(F.col("fsc").desc(), "term")
    best = scores.where(F.col("fsc") > 0).orderBy(F.col("fsc").desc(), "term").limit(most)
    return best.withColumn("rank", F.row_number().over(order))
