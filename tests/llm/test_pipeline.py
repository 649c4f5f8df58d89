"""The pipeline, stage by stage, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.test_free import brute_groups
from tests.llm.test_native import plain_counts

import corpus_pipeline
from kinloom.llm import crf_langid

WORDS = {"xx": ["kalo", "mira", "tevo", "runa", "sela"], "yy": ["strob", "blick", "grund", "tramp", "knast"]}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows():
    r = random.Random(12)
    out = []
    for i in range(150):
        lang = "xx" if i % 2 else "yy"
        text = " ".join(f"{r.choice(WORDS[lang])}{r.choice(('', '', r.choice(WORDS[lang])))}" for _ in range(r.randint(15, 90)))
        out.append((i, text, lang, "abcd"[i % 4] if i % 9 else None, len(text)))
    for i in range(20):  # near and exact copies
        w = out[3 * i + 1][1].split()
        w[-1] = "tail" if i % 2 else w[-1]
        out.append((200 + i, " ".join(w), out[3 * i + 1][2], "b", 1))
    out += [(300, None, "xx", "a", None), (301, "", None, None, 0), (302, "12 34 !", "yy", "a", 7), (303, "kalo mira " * 60, "xx", "a", 1)]
    out += [(304, "strob blick grund tramp " * 9, "xx", "a", 1), (305, " ".join(f"{w}{k}" for k in range(4000) for w in ("tevo",)), "xx", "c", 1), out[0]]
    return out


def plain_mix(docs):
    size = {i: len((t or "").split()) for i, t, *_ in docs}
    by = defaultdict(list)
    for i, _, _, s, _ in docs:
        by[("1",) if s is None else ("0", s)].append(i)
    order = sorted(by)
    total = {s: sum(size[i] for i in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if s in full else level * weight[s]
        open_ -= full or open_
    line = []
    for rank, s in enumerate(order):
        run = 0
        for h, i in sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i in by[s]):
            run += size[i]
            if size[i] and target[s]:
                line += [((run + k * total[s]) / target[s], rank, h, i, run) for k in range(2)]
    taken, left = Counter(), math.floor(1.5 * sum(total.values()))
    for _, _, _, i, _ in sorted(line):
        if size[i] > left:
            break
        left -= size[i]
        taken[i] += 1
    return taken


def test_every_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    given = rows()
    named = table(spark, given).withColumns({c: F.lit(1) for c in ("m", "_id", "_pass", "passes", "size", "component")})
    named.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def after(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == columns
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        return out, sorted((tuple(r)[:5] for r in out.collect()), key=repr)

    model = crf_langid.fit(docs)
    said = {r.doc_id: r for r in crf_langid.predict(docs, model).collect()}
    want = [r for r in given if said[r[0]].lang_pred != "und" and not (r[2] in model.langs and said[r[0]].lang_pred != r[2] and said[r[0]].score >= 0.9)]
    docs, got = after("language ID", docs)
    assert got == sorted(want, key=repr) and {r[0] for r in given} - {r[0] for r in got} >= {300, 301, 302, 304}

    want = [r for r in got if not ((n := plain_counts(r[1]))[0] < 20 or 100 * n[4] > 30 * n[0])]
    docs, now = after("quality rules", docs)
    assert now == want and 303 not in {r[0] for r in now} and len(want) < len(got)

    group = brute_groups([(i, t, s) for i, t, _, s, _ in now])
    want = {r[0]: r for r in now if group[r[0]][1] == r[0]}
    docs, got = after("n-gram Jaccard join", docs)
    assert got == sorted(want.values(), key=repr) and len(got) < len(now) - 10

    want = plain_mix(got)
    docs, now = after("mixing sources to target weights", docs)
    assert Counter(r[0] for r in now) == want and set(now) <= set(got)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["best-fit packing"](spark, docs, str(tmp_path)).collect()
    ids = {r[0]: np.array([*tok.encode(r[1], add_special_tokens=False).ids, 2], "<u4") for r in now}
    want = Counter()
    for i, n in Counter(r[0] for r in now).items():
        first = len(ids[i]) % 1024 or 1024
        for k, s in enumerate((0, *range(first, len(ids[i]), 1024))):
            e = first if not k else s + 1024
            want[i, k, s, e - s, zlib.crc32(ids[i][s:e].tobytes())] += n
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    for spans in (sorted((p.offset, p.length) for p in pieces if p.sequence_id == q) for q in {p.sequence_id for p in pieces}):
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 1024
    least = -(-sum(p.length for p in pieces) // 1024)
    assert len({p.sequence_id for p in pieces}) <= least + 1

    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(
        (p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces
    )


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
