"""Pairs by classes of equal records against pairs of records, and tables of many copies."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.config import Scheme
from kinloom.operators import blocking, evaluate, lsh, match
from kinloom.plans import labels, schemes
from kinloom.queries import QUERIES

SCHEME = Scheme.of([(0, "tokens")], [(1, "term_id"), (0, "first1")])


def made(spark, n=400):
    r = random.Random(5)
    rows = [(i, max(0, i - 20), *(r.choice(("", "a", "a b", "b c", "d")) for _ in range(2))) for i in range(n)]
    return spark.createDataFrame(rows, "rec_id long, seq long, a_0 string, a_1 string").repartition(3)


def test_pairs_of_classes_are_pairs_of_records(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 7)
    r = made(spark)
    want = match.vectors(match.scored(match.candidates(blocking.key_table(r, SCHEME)), ["levenshtein"] * 2), 2)
    rows = lambda df: sorted((x.q_id, x.c_id, *x.simvec) for x in df.collect())
    assert rows(match.dnf_vectors(r, SCHEME, ["levenshtein"] * 2)) == rows(want)
    reps, members = match.classes(r)
    got = match.expanded(lsh.together(lsh.bands(reps, 0.5, 20), ["band", "sig"]), members)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lsh.meeting(lsh.bands(r, 0.5, 20), ["band", "sig"]).collect()))


@pytest.mark.parametrize("same", [["a_0"], ["a_1", "a_0"], ["a_1"]])
def test_recall_among_equals_recall_of(spark, same):
    r = made(spark)
    x = r.select(F.col("rec_id").alias("id_1"), *same)
    gold = x.join(r.select(F.col("rec_id").alias("id_2"), *same), same).where("id_1 < id_2").select("id_1", "id_2")
    for place, on in ((lambda t: blocking.key_table(t, SCHEME), ["term", "field", "bkv"]), (lambda t: lsh.bands(t, 0.5, 20), ["band", "sig"])):
        assert evaluate.recall_among(evaluate.counted(r), same, place, on).collect() == evaluate.recall_of(place(r), gold, on).collect()
    empty = evaluate.recall_among(evaluate.counted(r.limit(0)), same, place, on).first()
    assert (empty.hit, empty.pairs, empty.recall) == (0, 0, None)


def parts(spark, folder, n, names):
    t = spark.range(n).select(F.col("id").alias("p_partkey"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("p_name"))
    t.withColumns({"p_brand": F.lit("Brand#1"), "p_type": F.lit("SMALL")}).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["band_recall", "blocking_recall", "lsh_sweep"])
def test_recall_of_many_copies(spark, tmp_path, name):
    n = 200_000  # five billion pairs a name
    got = QUERIES[name](spark, parts(spark, tmp_path, n, ("hot bolt", "old ring"))).collect()
    assert all(x.recall == 1 for x in got)
    if name != "lsh_sweep":
        assert got[0].hit == got[0].pairs == 2 * (n // 2) * (n // 2 - 1) // 2


@pytest.mark.parametrize("name", ["query_dnf_vector", "query_full", "query_parfull", "lsh_candidates", "lsh_scores", "lsh_vectors"])
def test_pairs_of_many_copies(spark, tmp_path, name):
    n = 20_000
    assert QUERIES[name](spark, parts(spark, tmp_path, n, ("hot bolt",))).count() == n * (n - 1) // 2


def test_labels_of_large_blocks(spark):
    """Every block has 100 records or more, and no pair is equal."""
    rows = [(i, 0, f"n{i % 2} m{i % 3}", f"t{i % 2}") for i in range(300)]
    r = spark.createDataFrame(rows, "rec_id long, seq long, a_0 string, a_1 string")
    assert labels.neighbours(r).isEmpty() and not labels.neighbours(r, less_than=None).isEmpty()
    for lower, upper in ((0.45, 0.9), (0.0, 1.1)):
        pos, neg = labels.training_labels(r, lower, upper)
        assert not pos.isEmpty() and not neg.isEmpty()
        assert pos.join(neg, ["t1", "t2"]).isEmpty()


def test_cluster_distances_are_those_of_whole_vectors(spark):
    r = made(spark)
    model = lsh.fit_clusters(r, 3, hashing=True)
    centres = model.stages[-1].clusterCenters()
    want = {x.rec_id: float(((x.features.toArray() - centres[x.cluster]) ** 2).sum() ** 0.5) for x in model.transform(lsh._texts(r)).collect()}
    got = lsh.clusters(model, r)
    assert {x.rec_id: round(x.dist, 6) for x in got.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert "vector_to_array" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [3, 60, 500])
def test_scheme_counts_by_classes_are_those_of_pairs(spark, most):
    r = made(spark, 200)
    r = r.union(spark.createDataFrame([(900 + i, 0, f"u{i // 2}", "") for i in range(6)], r.schema)).persist()
    own, scheme = evaluate.counted(r).persist(), Scheme(tuple(schemes.candidate_terms(2, ("term_id", "tokens"), 2)))
    x = r.select("rec_id", "a_0")
    pos = x.toDF("t1", "a_0").where("t1 % 3 <> 1 or t1 > 150").join(x.toDF("t2", "a_0"), "a_0").where("t1 < t2").select("t1", "t2")
    pos = pos.union(spark.createDataFrame([(1, 2), (7, 5)], pos.schema)).distinct().persist()
    neg = spark.createDataFrame([(i, i + 1) for i in range(3, 40)], pos.schema).join(pos, ["t1", "t2"], "left_anti")
    keys = blocking.key_table(r, scheme)
    known = schemes.partners(schemes.with_classes(pos, r))
    gate, inside = schemes.class_blocks(schemes.class_keys(own, scheme), most, 0.1)
    counts = lambda pairs, label: schemes.with_classes(pairs, r).groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(
        F.lit(label).alias("label"), F.count("*").alias("n")
    )
    shared = schemes.shared_terms(inside, counts(pos, 1).union(counts(neg, 0)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(schemes.class_scores(gate, inside, shared, known, own))
    assert got == rows(schemes.feature_scores(keys, pos, most, 0.1)) and (most == 3 or any(x[3] for x in got))
    both = pos.withColumn("label", F.lit(1)).union(neg.withColumn("label", F.lit(0)))
    passing = [x.term for x in gate.where("passes").collect()]
    covered = schemes.coverage(keys.where(F.col("term").isin(passing)), both, most)
    assert rows(schemes.class_patterns(shared)) == rows(schemes.patterns(covered))


@pytest.mark.parametrize("n", [12_000, 14_000])
def test_scheme_of_many_copies(spark, tmp_path, n):
    """Every block has 1,000 records, or more than the query's limit: then no term scores."""
    names = [f"{a} {b}" for a in ("hot", "old", "red") for b in ("bolt", "ring", "nut", "gear")]
    folder = parts(spark, tmp_path, n, names)
    assert (QUERIES["learned_scheme"](spark, folder).count() > 0) == (n == 12_000)
    assert QUERIES["gold_negatives"](spark, folder).count() == 300


def test_parfull_fills_slots_of_pairs_of_the_first_term(spark, tmp_path):
    rows = [(0, "hot bolt", "Brand#1", "SMALL"), (1, "hot ring", "Brand#1", "SMALLER"), (2, "old nut", "Brand#2", "SMALL")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {name: [(x.q_id, x.c_id, x.s1, x.s2) for x in QUERIES[name](spark, str(tmp_path)).collect()] for name in ("query_parfull", "query_dnf_vector")}
    assert got == {"query_parfull": [(1, 0, 1.0, 0.714286)], "query_dnf_vector": [(1, 0, 1.0, 0.0)]}


@pytest.mark.parametrize("less_than", [30, None])
def test_cosines_of_classes_are_those_of_records(spark, less_than):
    r = made(spark, 200)
    want = labels.cosine(labels.neighbours(r, 3, less_than), labels.token_weights(r))
    rows = lambda df: sorted((x.t1, x.t2, round(x.sim, 9)) for x in df.collect())
    got = rows(labels.near(r, 3, less_than))
    assert got == rows(want) and (len(got) > 0) == (less_than is None)


def test_training_takes_few_tasks(spark):
    """Steps of an optimiser are jobs with a task a partition."""
    from kinloom.plans import fusion

    train = spark.range(60).select(F.array(F.rand(1), (F.col("id") % 3 == 0).cast("double")).alias("simvec"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    seen, plain = [], fusion.cross_validated
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fusion, "cross_validated", lambda models, *a: seen.extend(df.rdd.getNumPartitions() for _, df in models) or plain(models, *a))
        name, model = fusion.best_model(train.repartition(50), 2, ("tree", "linear"), costs=(1.0, 10.0))
    assert name == "tree" and set(seen) == {1} and len(seen) == 5
    assert fusion.classify(model, train).where("match <> label").isEmpty()


def test_undistributed_joins_broadcast_nothing(spark):
    from kinloom.shipping import undistributed

    x = spark.range(50)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    with undistributed(spark):
        got = x.join(x.withColumn("y", F.lit(1)), "id")
        assert got.count() == 50 and "BroadcastHashJoin" not in got._jdf.queryExecution().toString()
    assert [spark.conf.get(n, None) for n in names] == before
