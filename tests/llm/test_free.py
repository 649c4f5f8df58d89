"""Archives, join, packing, scoring, language ID and token counts against plain versions."""

import base64
import hashlib
import inspect
import io
import random
import re
import zlib
from collections import Counter
from itertools import pairwise, product

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.test_native import docs

from kinloom.llm import crf_langid, packing, parity_join, pseudo_likelihood, unigram_count, warc
from kinloom.llm.common import cut, new_path
from kinloom.llm.hashing import word_hashes


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "same" * 50), (0, "u", "same" * 50), (2, None, None), (3, "u", ""), (4, "u", "é🙂" * 3000), (4, "u", "é🙂" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "size", "first", "key", "often")})
    folder = new_path(spark, "warc")
    written = cut(warc.write(pages, folder), "archives")
    warc.write(pages, folder).count()  # as if tasks had run twice
    assert warc.drop_orphans(written, folder) >= 1 and warc.drop_orphans(written, folder) == 0
    got = sorted(warc.read(written, 2).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == [0, 1, 2, 3, 4, 4]
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    assert [(r.record_type, r.refers_to) for r in got[:4]] == [("response", None), ("revisit", 0), ("response", None), ("revisit", 2)]
    assert warc.read(cut(warc.write(pages.limit(0), new_path(spark, "warc"))), 2).count() == 0


def test_warc_file_layout():
    raw = [warc.record(i, "http://h/", (f"<p>page {i}</p>" * 40).encode(), None) for i in range(40)]
    out = io.BytesIO()
    w = warc.Writer(out, warc.build_dictionary(raw))
    for r in raw:
        w.add(r)
    data = out.getvalue()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and len(data) == w.bytes
    assert list(warc.read_records(io.BytesIO(data))) == raw


def brute_groups(rows, num=75, den=100):
    sets = {}
    for i, t, _ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_parity_join(spark):
    r = random.Random(3)
    rows, common = [], [f"c{j}" for j in range(60)]
    for g in range(14):
        base = [f"{r.choice('abcdefg')}{r.randint(0, 400)}" for _ in range(r.choice((3, 8, 30, 70, 90, 300)))]
        base = base + common if g % 3 == 0 else base
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "a"))
    rows += [(950, "long words come back " * 60_000, "a"), (951, " ".join(f"n{j}" for j in range(40_000)), "a"), (952, " ".join(f"n{j}" for j in range(39_000)), "a")]
    rows += [(900, None, None), (901, "", "a"), (902, " \n", "a"), (903, "One two", "a"), (904, "oNE\ttwo", "a"), (905, "One two three", "a")]
    rows.append(rows[0])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity_join.groups(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)
    named = docs(spark, [*rows, (903, "another text of that id", "a"), (None, "no id", "a")]).withColumns({c: F.lit(1) for c in ("_id", "_chosen", "_rank", "component", "n", "sig")})
    kept = parity_join.one_of_each(named)
    assert kept.columns == named.columns
    kept = [(x.doc_id, x.text) for x in kept.collect()]
    assert sorted((i for i, _ in kept), key=lambda i: (i is None, i)) == [*sorted({c for _, c in got.values()}), None]
    assert (903, "One two") in kept  # of several rows of one id the first by text
    assert parity_join.groups(docs(spark, rows).limit(0)).count() == 0


def test_parity_join_of_large_groups(spark):
    """5,000 near copies, a passage that many share, and a group of borderline copies: what each step returns stays near its rows."""
    r = random.Random(11)
    base = [f"b{j}" for j in range(120)]
    passage = [f"p{j}" for j in range(60)]
    rows = []
    for i in range(5000):
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w), "a"))
    for i in range(400):
        rows.append((6000 + i, " ".join([*passage, *(f"u{i}v{j}" for j in range(12))]), "a"))
    plain = brute_groups(rows[:60] + rows[5000:5060])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity_join.groups(docs(spark, rows).repartition(8)).collect()}
    assert all(got[i] == (plain[i][0], 0) for i in range(60)) and {got[i][1] for i in range(5000)} == {0}
    assert all((got[i][1] == got[6000][1]) == (plain[i][1] == plain[6000][1]) for i in range(6000, 6060))


def test_blocks_return_rows_not_pairs():
    rng = np.random.default_rng(2)
    n = 900  # all near each other, each a component of its own
    core = np.unique(rng.integers(0, 2**63, 400).astype("u8"))
    sets = [np.unique(np.r_[core, rng.integers(0, 2**63, 3).astype("u8")]) for _ in range(n)]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    bits = np.empty(n, object)
    bits[:] = [parity_join.sketch(sets[k]) for k in order]
    block = parity_join.Block(np.zeros((n, 3), "int64"), order, order.copy(), sizes[order], np.full(n, -1), bits, 75, 100)
    assert len(block.near()[0]) == n * (n - 1) // 2
    out = block.forest()
    assert len(out["a"]) <= 2 * n and (out["a"] == out["b"]).sum() <= n
    texts = [" ".join(map(str, range(k, k + 300))) for k in range(n)]  # neighbours are alike
    block.id = np.arange(n)
    links = block.links(lambda row: texts[row])
    assert len(links["a"]) < n


def test_signatures_end_in_zero_bytes():
    """Shuffles needn't carry the low bits; the flag of frequent shingles stays, and equal texts have equal signatures."""
    texts = [" ".join(f"w{j}" for j in range(n)) for n in (40, 300)] * 2
    hot = type("Hot", (), {"value": np.sort(parity_join.shingles(texts[1]))})
    given = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(parity_join._joined_on(hot, 75, 100)([given])).to_pandas()
    assert len(got) and not (got.sig & (parity_join.LATE - 1)).any()
    assert ((got.sig & parity_join.LATE) != 0).any()
    own = got.groupby("id").sig.apply(sorted)
    assert own[0] == own[2] and own[1] == own[3] and (own[0] != own[1])


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (5, 70, 300):
        a = np.unique(rng.integers(0, 2**63, n).astype("u8"))
        b = np.unique(np.r_[a[: n * 4 // 5], rng.integers(0, 2**63, n // 5).astype("u8")])
        x, y = parity_join.sketch(a), parity_join.sketch(b)
        w = min(len(x), len(y))
        apart = int(np.bitwise_count(parity_join.fold(x, w) ^ parity_join.fold(y, w)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_packing_solver_is_optimal_on_small_cases():
    def least(items, cap):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    r = random.Random(5)
    for _ in range(25):
        items = sorted((r.randint(3, 20) for _ in range(9)), reverse=True)
        counts = {s: items.count(s) for s in items}
        got = packing.solve(counts, 20)
        assert {s: sum(n * dict(f).get(s, 0) for n, f in got) for s in counts} == counts
        assert all(sum(s * c for s, c in f) <= 20 for _, f in got)
        assert sum(n for n, _ in got) == least(items, 20)


def test_packing_search_leaves_nothing_out():
    cases = [({24: 1, 27: 4, 20: 3, 13: 5, 9: 4}, 50, 6), ({14: 5, 6: 4, 18: 2, 16: 1, 11: 3, 13: 4}, 30, 8), ({13: 6, 18: 4, 16: 3, 22: 6, 25: 2}, 50, 8)]
    for counts, cap, bound in cases:
        for more in ({}, {cap: 2}):  # full pieces leave no room
            got = packing.solve(counts | more, cap)
            assert sum(n for n, _ in got) == packing.lower_bound(counts | more, cap) == bound + sum(more.values())
            assert {s: sum(n * dict(f).get(s, 0) for n, f in got) for s in counts | more} == counts | more


def test_packing_beats_best_fit():
    for seed in (2, 14, 15, 27):
        r, counts = random.Random(seed), Counter()
        for _ in range(120):
            counts[r.randint(20, 600)] += 1
        got = packing.solve(dict(counts), 1024)
        assert {s: sum(n * dict(f).get(s, 0) for n, f in got) for s in counts} == counts
        assert sum(n for n, _ in got) == packing.lower_bound(counts, 1024) < sum(n for n, _ in packing.best_fit(dict(counts), 1024))


def test_longest_filling_is_undominated():
    r = random.Random(8)
    for _ in range(60):
        left = Counter(r.randint(2, 30) for _ in range(14))
        room, tolerance = r.randint(5, 60), r.randint(0, 6)
        sizes = sorted(left, reverse=True)
        waste, items = packing.longest_filling(sizes, left, room, tolerance)
        every = [(w, x) for w, x in packing.fillings(sizes, left, room, room) if x is not None]
        least = min(w for w, _ in every)
        assert waste == room - sum(s * c for s, c in items) and (waste, items) in every
        assert items == max(x for w, x in every if w <= max(tolerance, least))


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a" * 5000, "Hello world " * 300, "<|endoftext|> x", "日本 🙂\n\n  y", *(f"word{i} " * i for i in range(40))]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    copies = packing.pack(cut(packing.pieces(docs(spark, rows[:9] * 3), 64, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)), 64, rows=8).collect()
    assert len({(p.sequence_id, p.offset) for p in copies}) == len(copies) and Counter(p.doc_id for p in copies if not p.piece) == {i: 3 for i in range(9)}
    ready = packing.pieces(docs(spark, rows), 64, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = packing.pack(cut(ready), 64, rows=8).collect()
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((p for p in got if p.doc_id == i), key=lambda p: p.piece)
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist() and sum(p.length for p in mine) == len(ids)
        assert all(p.length == 64 for p in mine[1:])
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
    by = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 64
    assert packing.pack(cut(ready.limit(0)), 64).count() == 0


def plain_model(params, shape):
    tables, bias, out, e, deep, f = (x.astype("f8") for x in pseudo_likelihood.views(params, shape))

    def distributions(near):
        h = np.tanh(sum(tables[k * shape.vocabulary + w] for k, w in enumerate(near)) + bias)
        soft = lambda z: np.exp(z) / np.exp(z).sum()
        return h, soft(h @ out + e), lambda c: soft(h @ deep[c] + f[c])

    return distributions


def neighbours(ids, t):
    return [int(ids[t + o]) if 0 <= t + o < len(ids) else 0 for o in (-2, -1, 1, 2)]


def test_pseudo_likelihood(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(("sun rises", "Sun rises", "tide falls", f"rare{r.randint(0, 90)}")) for _ in range(30)), "a") for i in range(60)]
    rows += [(100, None, None), (101, "", "a"), (102, " É ", "a"), rows[0]]
    shape = pseudo_likelihood.Shape(side=4, hidden=6)
    given = docs(spark, rows).repartition(3)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    count = Counter(w for _, t, _ in rows for w in low(t))
    counts = cut(pseudo_likelihood.word_counts(given))
    hashes = {w: int(hash_of(w)) for w in count}
    assert {x.h: x.n for x in counts.collect()} == {np.array([hashes[w]], "u8").view("i8")[0]: n for w, n in count.items()}
    frequent = sorted(count, key=lambda w: (-count[w], np.array([hashes[w]], "u8").view("i8")[0]))[: shape.words]
    member = {w: frequent.index(w) + 1 if w in frequent else shape.words + 1 + hashes[w] % shape.side for w in count}
    of_class = Counter()
    for w in count:
        if w not in frequent:
            of_class[member[w]] += count[w]
    assert frequent[:1] == ["rises"] and len(of_class) > 1
    scores = []
    for near in (0, 20, 1000):  # rare words by the join, some, all by the workers' table
        voc, rest = pseudo_likelihood.vocabulary(counts, shape, near)
        stored = cut(pseudo_likelihood.encoded(given, spark.sparkContext.broadcast(voc)))
        params = pseudo_likelihood.fit(stored, shape, rounds=4)
        got = pseudo_likelihood.apply(stored, params, shape, rest).collect()
        scores.append(sorted((x.doc_id, round(x.score, 6)) for x in got))
        model = plain_model(params, shape)
        text = {i: t for i, t, _ in rows}
        for x in got:
            ids = [member[w] for w in low(text[x.doc_id])]
            want = 0.0
            for t, w in enumerate(low(text[x.doc_id])):
                _, p, q = model(neighbours(ids, t))
                c, m = divmod(ids[t] - 1, shape.side)
                want += np.log(p[c]) + np.log(q(c)[m]) + (0 if w in frequent else np.log(count[w] / of_class[ids[t]]))
            assert x.n_words == len(ids) and abs(want - x.score) < 1e-2 and (x.mean_score is None) == (not ids)
    assert scores[0] == scores[1] == scores[2]
    twice = [x.score for x in got if x.doc_id == rows[0][0]]
    assert len(twice) == 2 and twice[0] == twice[1]
    first = pseudo_likelihood.apply(stored, pseudo_likelihood.initial(shape), shape, rest).collect()
    assert sum(x.score for x in got) > 0.8 * sum(x.score for x in first)  # it learned something
    assert pseudo_likelihood.score(given.limit(0)).count() == 0


def hash_of(word):
    data = np.frombuffer(word.encode(), "u1")
    return word_hashes(data, np.array([0, len(data)]))[0][0]


def test_pseudo_likelihood_training_equals_a_plain_version():
    shape, rng = pseudo_likelihood.Shape(side=3, hidden=4), np.random.default_rng(1)
    ids = [rng.integers(1, shape.vocabulary, 50), rng.integers(1, shape.vocabulary, 40)]
    start = pseudo_likelihood.initial(shape)
    rows, words = pseudo_likelihood.windows(ids, shape)
    got, state = start.copy(), np.zeros_like(start)
    pseudo_likelihood.train(got, rows, words, shape, state, rate=0.1, step=32)
    params, state, at = start.astype("f8"), np.zeros(len(start)), [(x, t) for x in ids for t in range(len(x))]
    for i in range(0, len(at), 32):
        now = at[i : i + 32]

        def loss(p):
            model = plain_model(p, shape)
            total = 0.0
            for x, t in now:
                _, a, b = model(neighbours(x, t))
                c, m = divmod(int(x[t]) - 1, shape.side)
                total -= np.log(a[c]) + np.log(b(c)[m])
            return total / len(now)

        grad = np.empty(len(params))
        for k in range(len(params)):
            up, down = params.copy(), params.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            grad[k] = (loss(up) - loss(down)) / 2e-5
        grad[np.abs(grad) < 1e-9] = 0
        state += grad * grad
        params -= 0.1 * grad / np.sqrt(state + 1e-8)
    assert np.abs(got - params).max() < 2e-2


def test_pseudo_likelihood_learns_from_logits_far_apart():
    """A row whose logits all lie far below another row's has its own softmax, not equal shares."""
    shape, rng = pseudo_likelihood.Shape(side=3, hidden=4), np.random.default_rng(4)
    rows, words = pseudo_likelihood.windows([rng.integers(1, shape.vocabulary, 60)], shape)
    got = pseudo_likelihood.initial(shape)
    tables, _, out, *_ = pseudo_likelihood.views(got, shape)
    tables[:, 0] = rng.choice([-2, 2], len(tables))
    out[0], out[1:] = 100, rng.normal(0, 20, out[1:].shape)
    tables, bias, out, e, *_ = (x.astype("f8") for x in pseudo_likelihood.views(got, shape))
    pseudo_likelihood.train(got, rows, words, shape, np.ones_like(got), step=len(words))
    h = np.tanh(tables[rows].sum(1) + bias)
    z = h @ out + e
    assert np.ptp(z.max(1)) > 160
    p = np.exp(z - z.max(1, keepdims=True))
    p = p / p.sum(1, keepdims=True) - np.eye(3)[(words - 1) // shape.side]
    for now, was, grad in zip(pseudo_likelihood.views(got, shape)[2:4], (out, e), (h.T @ p / len(words), p.mean(0)), strict=True):
        assert np.abs(now - (was - 0.1 * grad / np.sqrt(1 + grad * grad))).max() < 1e-4


def test_pseudo_likelihood_of_unshifted_exponentials(monkeypatch):
    shape, rng = pseudo_likelihood.Shape(side=8), np.random.default_rng(3)
    rows, words = pseudo_likelihood.windows([rng.integers(1, shape.vocabulary, 9000)], shape)
    got = []
    for most in (pseudo_likelihood.TAME, -1):
        monkeypatch.setattr(pseudo_likelihood, "TAME", most)
        params = pseudo_likelihood.initial(shape)
        pseudo_likelihood.train(params, rows, words, shape, np.zeros_like(params))
        got.append((params, pseudo_likelihood.log_probabilities(params, rows, words, shape)))
    assert np.allclose(got[0][0], got[1][0], atol=1e-3) and np.allclose(got[0][1], got[1][1], atol=1e-3)


def test_pseudo_likelihood_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD", 3000)
    r = random.Random(6)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(40)), "a") for i in range(400)]
    given = docs(spark, rows)
    got = [sorted((x.doc_id, x.n_words, round(x.score, 3)) for x in pseudo_likelihood.score(given.repartition(n)).collect()) for n in (1, 4, 60)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 400


def test_pseudo_likelihood_predicts_every_document():
    shape = pseudo_likelihood.Shape(side=3, hidden=2)
    shard, seen = pseudo_likelihood.Shard(pseudo_likelihood.initial(shape), shape, 0), []
    plain, pseudo_likelihood.train = pseudo_likelihood.train, lambda p, rows, words, *rest: seen.append(len(words))
    try:
        for i in range(7):
            shard.add(np.full(i, 1, "u2"))
        shard.total()
    finally:
        pseudo_likelihood.train = plain
    assert sum(seen) == sum(-(-i // pseudo_likelihood.MASKS) for i in range(7)) and pseudo_likelihood.side_for(10**9) > pseudo_likelihood.side_for(10**6) > 8


def test_pseudo_likelihood_predicts_every_word_once(monkeypatch):
    """The rounds that a run has by default and others: together they predict each word once."""
    default = inspect.signature(pseudo_likelihood.score).parameters["rounds"].default
    shape, seen = pseudo_likelihood.Shape(side=8, hidden=2), []
    monkeypatch.setattr(pseudo_likelihood, "train", lambda p, rows, words, *rest: seen.extend(words.tolist()))
    for rounds in (1, default, 3):
        seen.clear()
        for turn in range(rounds):
            shard = pseudo_likelihood.Shard.of_round(pseudo_likelihood.initial(shape), shape, turn, rounds)
            shard.add(np.arange(1, 12, dtype="u2"))
            shard.add(np.array([20], "u2"))
            shard.total()
        assert sorted(seen) == [*range(1, 12), 20]


def test_language(spark):
    r = random.Random(4)
    lex = {"xx": ["kalo", "mira", "tevo", "runa"], "yy": ["strob", "blick", "grund", "tramp"]}
    rows = [(i, " ".join(r.choices(lex[g], k=25)), g) for i in range(160) for g in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame([(i, t, g) for i, t, g in rows] + [(500, None, "xx"), (501, "12 !!", None), (502, "mira", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in crf_langid.identify(df).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert all(x.held_out == (crf_langid.crc_mod(i) == 2) and 0 <= x.score <= 1 for i, x in got.items())
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "xx"
    assert crf_langid.keep_identified(df).count() == len(rows) + 1
    assert {x.lang_pred for x in crf_langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}
    model = crf_langid.fit(df)
    words = crf_langid.words_of("kalo strob " * 50)
    exact, _, _ = crf_langid.marginals(model.emissions(words).astype("f8")[None], np.ones((1, len(words)), bool), model.step, model.first)
    sums, n = crf_langid.Tagger(model).sums(["kalo strob " * 50, None])
    assert n.tolist() == [100, 0] and np.allclose(exact[0].sum(0), sums[0], atol=0.1)


def test_marginals_equal_an_enumeration_of_all_labellings():
    rng = np.random.default_rng(3)
    emit, step, first = rng.normal(0, 1, (2, 5, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    mask = np.array([[True] * 5, [True] * 3 + [False] * 2])
    got, pairs, log_z = crf_langid.marginals(emit, mask, step, first)
    want_pairs, want_z = np.zeros((3, 3)), 0.0
    for s in range(2):
        n, total, own, both = int(mask[s].sum()), 0.0, np.zeros((5, 3)), np.zeros((3, 3))
        for labels in product(range(3), repeat=n):
            w = np.exp(first[labels[0]] + sum(emit[s, i, x] for i, x in enumerate(labels)) + sum(step[a, b] for a, b in pairwise(labels)))
            total += w
            for i, x in enumerate(labels):
                own[i, x] += w
            for a, b in pairwise(labels):
                both[a, b] += w
        assert np.allclose(got[s], own / total)
        want_pairs, want_z = want_pairs + both / total, want_z + np.log(total)
    assert np.allclose(pairs, want_pairs) and abs(log_z - want_z) < 1e-9


def test_language_edges(spark):
    r = random.Random(4)
    lex = {f"l{k:02}": [f"{a}{b}{k}".translate(str.maketrans("0123456789", "qwxzkjvypb")) for a in "bdg" for b in ("ar", "ol")] for k in range(70)}
    rows = [(70 * i + k, " ".join(r.choices(lex[g], k=30)), g) for k, g in enumerate(lex) for i in range(6)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string, lang string")
    named = df.withColumns({c: F.lit(1) for c in ("score", "lang_pred", "held_out", "h", "r", "spans")})
    got = crf_langid.identify(named).collect()
    held = [x for x in got if x.held_out]
    truth = {i: g for i, _, g in rows}
    assert len(got) == len(rows) + 2 and len(held) > 50 and sum(x.lang_pred == truth[x.doc_id] for x in held) > 0.9 * len(held)  # all 70 languages
    kept = crf_langid.keep_identified(named)
    assert kept.columns == named.columns and kept.count() > 0.9 * len(rows)
    assert crf_langid.identify(df.limit(0)).count() == 0 and crf_langid.keep_identified(df.limit(0)).count() == 0
    long = spark.createDataFrame([*rows, (9999, " ".join(lex["l03"] * 40_000), None)], "doc_id long, text string, lang string")
    assert [x.lang_pred for x in crf_langid.identify(long).where("doc_id = 9999").collect()] == ["l03"]


def test_language_that_was_not_learned_is_kept(spark):
    r = random.Random(4)
    lex = {"xx": ["kalo", "mira", "tevo", "runa"], "yy": ["strob", "blick", "grund", "tramp"]}
    rows = [(i, " ".join(r.choices(lex[g], k=25)), g) for i in range(160) for g in [("xx", "yy")[i % 2]]]
    rows += [(500, "kalo mira tevo runa " * 6, "zz"), (501, "kalo mira tevo runa " * 6, "yy")]  # 501: a label that is wrong
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in crf_langid.keep_identified(df, most_langs=2).collect()}
    assert kept == {i for i, _, _ in rows} - {501}


def test_unigram_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    v = unigram_count.vocabulary(path)
    texts = ["Hello  world", " lead", "x\n\ny", "日本語 🙂🙂 z", "▁a b▁", "<s> <0x0A>", "\n", None, "", "tokenization of uncommonword " * 50]
    got = {x.doc_id: x.n_tokens for x in unigram_count.count(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), path).collect()}
    tok = Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    assert got == {i: len(tok.encode(t or "").ids) for i, t in enumerate(texts)}
    small = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    tok = Tokenizer(models.Unigram(small, unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    c = unigram_count.Counter(small)
    for t in ("ab", "abab b", "zz a", "azzb", "z"):
        assert c.of_text(t)[0] == len(tok.encode(t).ids), t


def test_scores_do_not_hang_on_the_batch(monkeypatch):
    shape = pseudo_likelihood.Shape(8)
    ids = [np.random.default_rng(7).integers(1, shape.vocabulary, 3000)]
    params, (rows, words) = pseudo_likelihood.initial(shape), pseudo_likelihood.windows(ids, shape)
    whole = pseudo_likelihood.log_probabilities(params, rows, words, shape)
    monkeypatch.setattr(pseudo_likelihood, "SCORED", 257)
    assert np.allclose(whole, pseudo_likelihood.log_probabilities(params, rows, words, shape), atol=1e-4)
