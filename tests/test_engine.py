"""The engine end to end, reload, stream and files."""

import json

import pytest
from pyspark.sql import functions as F

from kinloom import runner
from kinloom.config import Scheme, Settings
from kinloom.operators import blocking, evaluate, lsh, match
from kinloom.plans import choice
from kinloom.plans.engine import LinkageEngine
from kinloom.sources.readers import arrival, first_of_each, gold, import_csv, peak_memory, read_csv, records, reports, scan, with_fit
from kinloom.sources.store import write_csv, write_metrics
from kinloom.streaming.live import latencies, meetings, settle
from tests.test_match import DNF, RESTAURANTS, rel


def test_fit_build_query_and_reload(spark, tmp_path):
    r = rel(spark, [(i, 0, a, b) for i, a, b in RESTAURANTS])
    pairs = spark.createDataFrame([("0", "1"), ("2", "3"), ("4", "5"), ("6", "7")], "id_1 string, id_2 string")
    settings = Settings(min_good=0.5, window=5, families=("linear", "tree"), grid=(1.0,))
    engine = LinkageEngine(spark, f"file://{tmp_path}", settings).fit(r, pairs)
    engine.build(r.where("rec_id % 2 = 0"))
    asked = r.where("rec_id % 2 = 1").withColumn("seq", F.col("rec_id").cast("long"))
    first = engine.evaluate(asked, pairs)
    assert first["pairs_completeness"] >= 0.75 and 0 <= first["reduction_ratio"] <= 1
    again = LinkageEngine(spark, f"file://{tmp_path}", settings).fit(r, pairs)
    assert again.scheme == engine.scheme and again.measures == engine.measures
    told = again.evaluate(asked, pairs)
    assert {k: v for k, v in told.items() if "second" not in k} == {k: v for k, v in first.items() if "second" not in k}


def parts(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    return records(p, "p_partkey", ["p_name", "p_brand", "p_type"])


def same(r, *names):
    x = r.selectExpr("rec_id id_1", *names)
    return x.join(r.selectExpr("rec_id id_2", *names), list(names)).where("id_1 < id_2").select("id_1", "id_2")


def test_engine_without_gold(spark, tmp_path):
    r = parts(spark)
    settings = Settings(families=("tree",), min_good=0.1, upper=0.5, max_conjunction=1)
    engine = LinkageEngine(spark, f"file://{tmp_path}", settings).fit(r)
    assert engine.scheme.terms and len(engine.measures) == 3 and engine.model and engine.seconds["fit"] > 0
    engine.build(r.where("rec_id % 2 = 0"))
    asked = r.where("rec_id % 2 = 1").withColumn("seq", F.col("rec_id").cast("long"))
    got = engine.query(asked)
    assert got.where("match <> 1 or probability < 0.5").count() == 0


@pytest.mark.parametrize("indexer", ["dnf", "lsh", "kmeans"])
def test_engine_inserts_and_indexers(spark, tmp_path, indexer):
    r = parts(spark)
    settings = Settings(use_classifier=False, indexer=indexer, clusters=6, lsh_threshold=0.5, lsh_permutations=24)
    engine = LinkageEngine(spark, f"file://{tmp_path}", settings)
    engine.set_baseline([(0, 0, "tokens"), (0, 1, "term_id"), (1, 2, "term_id")])
    for name, rows in (("labels", "t1 long, t2 long, sim double, label int"), ("pairs", "t1 long, t2 long, sim double, label int")):
        engine.store.put(name, spark.createDataFrame([], rows))
    engine.store.put_json("measures", ["levenshtein"] * 3)
    engine.fit(r)
    engine.build(r.where("rec_id % 4 < 2"))
    before = engine.store.get("index").count()
    added = engine.insert(r.where("rec_id % 4 < 3"))  # most of them are there
    assert added == r.where("rec_id % 4 = 2").count() and engine.store.get("index").count() == before + added
    assert engine.insert(r.where("rec_id % 4 = 2")) == 0
    asked = r.where("rec_id % 4 = 3").withColumn("seq", F.col("rec_id").cast("long"))
    pairs = {(p.q_id, p.c_id) for p in engine.candidates(asked).collect()}
    seen = r.where("rec_id % 4 < 3").unionByName(asked)
    if indexer == "dnf":  # records that were inserted later are found like the others
        want = match.candidates(blocking.key_table(seen, engine.scheme))
    elif indexer == "lsh":
        want = lsh.meeting(lsh.bands(seen, 0.5, 24), ["band", "sig"])
    else:
        want = lsh.cluster_candidates(lsh.clusters(engine.clusters, seen))
    assert pairs == {(p.q_id, p.c_id) for p in want.select("q_id", "c_id").collect()} and pairs
    got = engine.query(asked).collect()
    assert {(x.q_id, x.c_id) for x in got} <= pairs and all(any(x.simvec) for x in got)
    if indexer == "lsh":
        told = engine.evaluate(asked, same(r, "a_0", "a_1", "a_2"))
        assert 0 <= told["reduction_ratio"] <= 1 and told["queries_a_second"] > 0 and told["inserts_a_second"] > 0


def test_runner(spark, tmp_path, capsys):
    rows = ["id,name,kind", *(f"{i},{a},{b}" for i, a, b in RESTAURANTS)]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "g.csv").write_text("id_1,id_2\n0,1\n2,3\n4,5\n6,7\n")
    common = ["--folder", f"file://{tmp_path}/f", "--csv", str(tmp_path / "t.csv"), "--id", "id", "--attributes", "name", "kind"]
    options = ["--no-classifier", "--baseline", json.dumps([(0, 0, "tokens"), (1, 1, "term_id")])]
    gold_file = ["--gold", str(tmp_path / "g.csv")]
    for verb in ("fit", "build", "insert", "evaluate"):
        runner.main([verb, *common, *options, *(gold_file if verb in ("fit", "evaluate") else [])])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[0]["scheme"] and said[1]["keys"] > 0 and said[2]["inserted"] == 0 and "reduction_ratio" in said[3]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [(i, int(i) + 1, a, b) for i, a, b in RESTAURANTS]
    schema = rel(spark, rows).schema
    for k in range(2):
        rel(spark, rows[8 * k : 8 * k + 8]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = meetings(source, DNF).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        assert latencies(q)
        q.stop()
    got = settle(spark.read.parquet(str(tmp_path / "out")), ["levenshtein"] * 2).collect()
    batch = match.vectors(match.scored(match.candidates(blocking.key_table(rel(spark, rows), DNF)), ["levenshtein"] * 2), 2).collect()
    assert {(x.q_id, x.c_id) for x in got} == {(x.q_id, x.c_id) for x in batch}


def test_measures_in_block_mode(spark):
    r = rel(spark, [(i, 0, a, b) for i, a, b in RESTAURANTS])
    both = spark.createDataFrame([("0", "1", 1), ("2", "3", 1), ("8", "9", 0), ("10", "12", 0)], "t1 string, t2 string, label int")
    keys = blocking.key_table(r, DNF)
    values = choice.in_shared_blocks(choice.pair_values(both, r), keys)
    met = {(x.t1, x.t2, x.field) for x in values.where("shared").collect()}
    own = {(x.rec_id, x.term, x.field, x.bkv) for x in keys.collect()}
    want = {(a, b, f) for a, b, _ in both.collect() for i, t, f, k in own if i == a and (b, t, f, k) in own}
    assert met == want
    for mode in ("full", "parfull", "block"):
        assert len(choice.choose(both, r, mode=mode, keys=keys, covered={0})) == 2


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,a,b\n2,The Cat,x\n1,Dog,\n")
    stored = import_csv(spark, str(tmp_path / "t.csv"), "id", ["a", "b"], f"{tmp_path}/store")
    assert [tuple(x) for x in scan(spark, f"{tmp_path}/store", "a_0 = 'cat'", ["rec_id", "a_1"]).collect()] == [("2", "x")] and stored.count() == 2
    assert import_csv(spark, "no such file", "id", ["a", "b"], f"{tmp_path}/store").count() == 2  # it is there already
    write_csv(stored, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    write_metrics(spark.createDataFrame([(0.5,)], "recall double"), f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").first().recall == 0.5
    (tmp_path / "p.mem").write_text("CMD x\nMEM 10.0 1\nMEM 30.5 2\nMEM 20.0 3\n")
    got = peak_memory(spark, str(tmp_path / "p.mem")).first()
    assert (got.peak_mb, got.used_mb) == (30.5, 20.5)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "run1_dnf_part.json").write_text('{"recall": 0.5}')
    (tmp_path / "r" / "fit_dnf_part.json").write_text('{"fit_time": 3}')
    found = reports(spark, str(tmp_path / "r"))
    both = with_fit(found.where("run = 'run1'").drop("fit_time"), found.where("run = 'fit'").drop("recall")).first()
    assert (both.recall, both.fit_fit_time, both.indexer, both.dataset) == (0.5, 3, "dnf", "part")


def test_arrival(spark):
    rows = [(i, None if i == 3 else 1000 + i // 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s long").selectExpr("id", "timestamp_seconds(s) ts").repartition(7)
    for cell in (1, 13, 10_000):
        got = [r.id for r in arrival(df, "ts", "id", rows=cell).orderBy("seq").collect()]
        assert got == [3, *(i for i in range(200) if i != 3)]
        assert sorted(r.seq for r in arrival(df, "ts", "id", rows=cell).collect()) == list(range(1, 201))
    same_time = spark.createDataFrame([(1999,), (2000,)], "id long").selectExpr("id", "timestamp_seconds(1) ts")
    assert [r.id for r in arrival(same_time, "ts", "id").orderBy("seq").collect()] == [1999, 2000]


def test_running_sums_in_cells(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, float(i % 37)) for i in range(300)], "truth int, score double")
    records_ = spark.range(1, 201).selectExpr("id rec_id", "id * 3 seq")
    results = spark.range(1, 150).selectExpr("id q_id", "id % 7 c_id")
    gold_ = spark.range(1, 200, 3).selectExpr("id q_id", "id % 7 c_id")
    whole = [evaluate.curve(df).orderBy("score").collect(), evaluate.average_precision(df).first(), evaluate.complexity(records_, results, gold_).orderBy("seq").collect()]
    monkeypatch.setattr(evaluate, "CELL", 4)
    cells = [evaluate.curve(df).orderBy("score").collect(), evaluate.average_precision(df).first(), evaluate.complexity(records_, results, gold_).orderBy("seq").collect()]
    assert whole[0] == cells[0] and abs(whole[1][0] - cells[1][0]) < 1e-12 and whole[2] == cells[2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, int(i), a, b) for i, a, b in RESTAURANTS]
    rows = [(i, s + 1, a, b) for i, s, a, b in rows]
    for k in range(2):
        rel(spark, rows[8 * k : 8 * k + 8]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rel(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = meetings(source, DNF).writeStream.format("memory").queryName("met").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    live = {(x.q_id, x.c_id): x.simvec for x in settle(spark.table("met"), ["levenshtein"] * 2).collect()}
    keys = blocking.key_table(rel(spark, rows), DNF)
    batch = match.vectors(match.scored(match.candidates(keys), ["levenshtein"] * 2), 2).collect()
    assert live == {(x.q_id, x.c_id): x.simvec for x in batch} and live


def test_csv_and_gold(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id, attr1, attr2\n1, This is a Test, Another TEST of\n2, , x\n")
    raw = read_csv(spark, str(tmp_path / "t.csv"))
    got = records(raw, "id", ["attr2", "attr1"]).orderBy("rec_id").collect()
    assert [(r.rec_id, r.a_0, r.a_1) for r in got] == [("1", "another test", "this is test"), ("2", "x", "")]
    g = gold(spark.createDataFrame([("2", "1"), ("1", "2")], "l string, r string"), "l", "r", "int")
    assert [(x.id_1, x.id_2) for x in g.collect()] == [(1, 2)]
    twice = rel(spark, [("1", 1, "old"), ("1", 2, "new")])
    assert [x.a_0 for x in first_of_each(twice).collect()] == ["old"]


def test_scheme_rows():
    s = Scheme.from_rows([(0, 0, "tokens"), (0, 1, "term_id"), (1, 2, "term_id")])
    assert s == Scheme.of([(0, "tokens"), (1, "term_id")], [(2, "term_id")])
    assert [r[:3] for r in s.rows()] == [(0, 0, "tokens"), (0, 1, "term_id"), (1, 2, "term_id")]
