"""Queries against the index, replaying pinned states."""

import pytest
from pyspark.sql import functions as F

from kinloom.config import Scheme
from kinloom.operators import blocking, evaluate, lsh, match
from kinloom.plans import labels, schemes
from kinloom.shipping import ship

RESTAURANTS = [
    ("0", "mario's pizza", "italian"), ("1", "marios pizza", "italian"), ("2", "fringal", "french bistro"), ("3", "fringale", "french bistro"),
    ("4", "yujean kang's gourmet cuisine", "asian"), ("5", "yujean kang's best cuisine", "asian"), ("6", "big belly burger", "american"),
    ("7", "big belly burger", "german"), ("8", "sally's cafè and internet", "tex-mex cafe"), ("9", "cafè sunflower and more", "health food"),
    ("10", "roosevelt tamale parlor", "mexican"), ("11", "wa-ha-ka oaxaca moaxo", "mexican"), ("12", "thailand restaurant", "thai"),
    ("13", "andre's petit restaurant", "spanish"), ("14", "zubu", "japanese"), ("15", "nobu", "japanese"),
]
DNF = Scheme.of([(0, "tokens"), (1, "tokens")], [(0, "tokens")], [(1, "tokens")])


def rel(spark, rows):
    ship(spark)
    n = len(rows[0]) - 2
    return spark.createDataFrame(rows, "rec_id string, seq long, " + ", ".join(f"a_{i} string" for i in range(n)))


def restaurants(spark):
    return rel(spark, [(i, 0, a, b) for i, a, b in RESTAURANTS])


def scores(spark, rows, scheme, **options):
    n = len(rows[0]) - 2
    got = match.scored(match.candidates(blocking.key_table(rel(spark, rows), scheme)), ["ratio"] * n, digits=1)
    out: dict = {}
    for r in match.totals(got, n, **options).collect():
        out.setdefault(r.q_id, {})[r.c_id] = round(r.score, 6)
    return out


def test_later_queries_see_earlier_ones(spark):
    index = [("r1", 0, "tony"), ("r2", 0, "cathrine"), ("r4", 0, "catrine"), ("r5", 0, "tonya"), ("r8", 0, "tonia")]
    asked = [("r10", 1, "tony"), ("r11", 2, "catrine"), ("r12", 3, "catrina"), ("r13", 4, "catrine")]
    got = scores(spark, index + asked, Scheme.of([(0, "first1")]))
    assert got["r10"] == {"r1": 1.0, "r5": 0.9, "r8": 0.7}
    assert got["r11"] == {"r2": 0.9, "r4": 1.0}
    assert got["r12"] == {"r2": 0.8, "r4": 0.9, "r11": 0.9}
    assert got["r13"] == {"r2": 0.9, "r4": 1.0, "r11": 1.0, "r12": 0.9}


def test_sums_thresholds_and_top(spark):
    rows = [("r1", 0, "tony", "23465"), ("r2", 0, "tonya", "23465"), ("r3", 0, "tonia", "23578"), ("r4", 1, "tony", "23578")]
    scheme = Scheme.of([(0, "first1")], [(1, "first1")])
    assert scores(spark, rows, scheme)["r4"] == {"r1": 1.6, "r2": 1.5, "r3": 1.7}
    assert set(scores(spark, rows, scheme, threshold=1.55)["r4"]) == {"r1", "r3"}
    assert scores(spark, rows, scheme, normalise=True)["r4"] == {"r1": 0.8, "r2": 0.75, "r3": 0.85}
    assert set(scores(spark, rows, scheme, threshold=0.79, normalise=True)["r4"]) == {"r1", "r3"}
    got = match.totals(match.scored(match.candidates(blocking.key_table(rel(spark, rows), scheme)), ["ratio"] * 2, 1), 2)
    assert [r.c_id for r in match.top(got, 2).orderBy("rank").collect()] == ["r3", "r1"]


def test_dnf_vector(spark):
    r = rel(spark, [("0", 0, *RESTAURANTS[0][1:]), ("1", 1, *RESTAURANTS[1][1:])])
    keys = blocking.key_table(r, DNF)
    assert {x.bkv for x in keys.where("term = 0").collect()} == {"mario'sitalian", "mariositalian", "pizzaitalian"}
    row = match.vectors(match.scored(match.candidates(keys), ["ratio"] * 2), 2).first()
    assert [round(x, 2) for x in row.simvec] == [0.96, 1.0]


def test_empty_attribute_degrades_a_conjunction(spark):
    r = rel(spark, [("0", 0, "a", ""), ("1", 0, "", "")])
    keys = blocking.key_table(r, Scheme.of([(0, "tokens"), (1, "term_id")]))
    assert [(k.rec_id, k.field, k.bkv) for k in keys.collect()] == [("0", 0, "a")]


def test_vector_modes(spark):
    r = rel(spark, [("0", 0, "x", "y", "z"), ("1", 1, "x", "yy", "zz")])
    scheme = Scheme.of([(0, "term_id")], [(1, "term_id")])
    got = match.vectors(match.scored(match.candidates(blocking.key_table(r, scheme)), ["levenshtein"] * 3), 3)
    modes = {m: match.completed(got, r, ["levenshtein"] * 3, m, scheme.fields()).first().simvec for m in match.MODES}
    assert modes == {"block": [1, 0, 0], "parfull": [1, 0.5, 0], "full": [1, 0.5, 0.5]}


def test_tfidf(spark):
    r = restaurants(spark)
    pairs = spark.createDataFrame([(str(i), str(i + 1)) for i in (0, 2, 4, 6)], "t1 string, t2 string")
    got = labels.cosine(pairs, labels.token_weights(r)).orderBy("t1").collect()
    assert [round(x.sim, 2) for x in got] == [0.57, 0.57, 0.72, 0.66]


def test_gold_labels(spark):
    gold = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (6, 7)], "id_1 int, id_2 int")
    pos, neg = labels.gold_labels(restaurants(spark), gold, 5, 4)
    assert {(p.t1, p.t2) for p in pos.collect()} == {("0", "1"), ("2", "3"), ("4", "5"), ("6", "7")}
    assert neg.count() <= 4


def test_feature_scores_against_plain_loops(spark):
    r = restaurants(spark)
    terms = schemes.candidate_terms(2, ("term_id", "tokens"), 2)
    gold = {("0", "1"), ("2", "3"), ("4", "5"), ("6", "7")}
    pos = spark.createDataFrame(sorted(gold), "t1 string, t2 string")
    keys = blocking.key_table(r, Scheme(tuple(terms)))
    got = {x.term: x for x in schemes.feature_scores(keys, pos, 3, 0.5).collect()}
    blocks: dict = {}
    for k in keys.collect():
        blocks.setdefault((k.term, k.field, k.bkv), set()).add(k.rec_id)
    known = {i for p in gold for i in p}
    for t in {b[0] for b in blocks}:
        own = [v for b, v in blocks.items() if b[0] == t]
        good, bad = sum(len(v) for v in own if 1 < len(v) <= 3), sum(len(v) for v in own if len(v) > 3)
        tp = fp = fn = 0
        if good and good / (good + bad) >= 0.5:
            for v in (v for v in own if len(v) <= 3):
                pairs = {(a, b) for a in v for b in v if a < b}
                tp, fp = tp + len(pairs & gold), fp + len(pairs - gold)
                fn += len({i for p in pairs - gold for i in p} & known)
        assert (got[t].good, got[t].bad, got[t].tp, got[t].fp, got[t].fn) == (good, bad, tp, fp, fn)


def test_learned_scheme_covers_gold(spark):
    r = restaurants(spark)
    pos = spark.createDataFrame([("0", "1"), ("2", "3"), ("4", "5"), ("6", "7")], "t1 string, t2 string")
    neg = spark.createDataFrame([("10", "11"), ("14", "15")], "t1 string, t2 string")
    scheme = schemes.learn_scheme(r, pos, neg, 2, min_good=0.5)
    assert scheme is not None and Scheme.from_json(scheme.to_json()) == scheme
    shared = blocking.has_common_block(pos, r, scheme).where("shared").count()
    assert shared >= 3


def test_fisher_order(spark):
    rows = [(k, 1, x) for k, v in enumerate(([1, 0, 1, 1], [1, 1, 1, 0], [1, 0, 1, 0])) for x in map(float, v)]
    rows += [(k, 0, x) for k, v in enumerate(([1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 0, 0])) for x in map(float, v)]
    got = {r.k: r for r in schemes.fisher(spark.createDataFrame(rows, "k int, label int, x double"), ("k",)).collect()}
    assert got[0].fisher == pytest.approx(got[1].fisher) and got[1].fisher < got[2].fisher
    assert got[0].mean_diff == got[1].mean_diff < got[2].mean_diff


def test_banding():
    assert lsh.banding(0.3, 2) == (2, 1)
    assert lsh.banding(0.3, 60) == (15, 2)
    assert lsh.banding(0.4, 128) == (32, 4)


def test_clusters_and_bands(spark):
    r = restaurants(spark)
    placed = lsh.clusters(lsh.fit_clusters(r, 3), r)
    assert placed.count() == 16 and placed.where("dist < 0").count() == 0
    q = r.withColumn("seq", F.when(F.col("rec_id") == "1", 1).otherwise(0).cast("long"))
    met = lsh.meeting(lsh.bands(q, 0.3, 60), ["band", "sig"]).collect()
    assert {(m.q_id, m.c_id) for m in met} <= {("1", r[0]) for r in RESTAURANTS}


def test_average_precision_with_ties(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)]
    df = spark.createDataFrame(rows, "truth int, score double")
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_outcomes_count_missing_partners(spark):
    res = spark.createDataFrame([("q", "a", 0.9), ("q", "x", 0.2), ("z", "a", 0.5)], "q_id string, c_id string, score double")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "q_id string, c_id string")
    m = evaluate.micro_metrics(evaluate.outcomes(res, gold)).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (1, 1, 1, 0.5, 0.5)


def test_vectors_in_one_step_equal_the_parts(spark):
    rows = [(i, int(i), a, b) for i, a, b in RESTAURANTS] + [("90", 17, "", "thai"), ("91", 18, "thai", ""), ("92", 19, "", "")]
    r = rel(spark, rows)
    scheme = Scheme.of([(0, "tokens"), (1, "term_id")], [(0, "first3")], [(1, "tokens")])
    banned = spark.createDataFrame([(2, "american")], "term int, bkv string")
    for measures in (["levenshtein", "jaccard"], ["ratio", "levenshtein"], ["jaro", "damerau"]):
        for mode in match.MODES:
            keys = blocking.without(blocking.key_table(r, scheme), banned)
            want = match.completed(match.vectors(match.scored(match.candidates(keys), measures), 2), r, measures, mode, scheme.fields())
            got = match.dnf_vectors(r, scheme, measures, mode, banned)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert match.dnf_vectors(r.limit(0), scheme, ["levenshtein"] * 2).count() == 0
