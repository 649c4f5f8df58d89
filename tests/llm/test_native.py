"""Rotation, fingerprints, quality rules and mixing against plain Python."""

import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from kinloom.llm import fair_mix, multiset_hash, risk_rules, rotation
from kinloom.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


def docs(spark, rows):
    """Rows (doc_id, text, source); the column key clashes with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, None, "x") for i, t, s in rows], DOCS)


def test_rotation(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 2, "ann", None), (1, 1, "bob", "Hi"), (1, 1, "bob", "Hi"),
        (2, 0, "system", "alone"), (None, 0, None, "lost"), (3, 0, "ann", "long " * 40_000), (3, 1, "bob", "short"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {(r.conv_id, r.participant): r for r in rotation.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "ann"), (3, "bob"), (None, "unknown")}
    lost = spark.createDataFrame([(None, i % 2, "ann", "lost") for i in range(9)], "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in rotation.rotate(lost).collect()] == [1] * 9  # without an id each row stands alone
    bob = got[1, "bob"]
    assert bob.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n" + 2 * "<|im_start|>assistant\nHi<|im_end|>\n" + "<|im_start|>user name=ann\n<|im_end|>\n"
    )
    for r in got.values():
        at, said = 0, []
        for n, on in zip(r.mask_len, r.mask_on, strict=True):
            if on:
                said.append(r.text[at : at + n])
            at += n
        assert at == len(r.text) and sum(map(len, said)) == r.trained_chars
        if r.conv_id == 1 and r.participant == "bob":
            assert said == ["Hi<|im_end|>\n"] * 2
    assert rotation.rotate(df.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [(9, "One. Two.\nThree.", "a"), (7, "Three.\nTwo. One.", "a"), (7, "é" * 10, "a"), (5, None, "a"), (3, "", None), (1, "Other. Words here.", "a")]
    got = multiset_hash.compare_edited(docs(spark, rows), rows=2).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = []
    for i, t in enumerate(texts):
        k = len(t) // 3
        edited = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        want.append((order[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[9][0].fingerprint in {r.fingerprint for r in by[7]}  # order of paragraphs does not count
    assert by[5][0].fingerprint == by[3][0].fingerprint and by[5][0].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert multiset_hash.compare_edited(docs(spark, rows).limit(0)).count() == 0


def plain_vector(text):
    """Sums over paragraphs: 8 words modulo 2^32 and 128 lanes modulo 2^16 of SHA-256, by hand."""
    paragraphs = [p for p in re.split(r"\s*\n\s*|(?<=[.!?])\s+", text) if p.strip(" ")]
    words, lanes = [0] * 8, [0] * 128
    for p in paragraphs:
        h = hashlib.sha256(p.encode()).digest()
        for i in range(8):
            words[i] = (words[i] + int.from_bytes(h[4 * i : 4 * i + 4], "big")) % 2**32
        for half in range(2):
            x = int.from_bytes(h[8 * half : 8 * half + 8], "big")
            for k in range(32):  # a number holds two lanes
                lanes[32 * half + k] = (lanes[32 * half + k] + (x >> k + 32 & 1)) % 2**16
                lanes[64 + 32 * half + k] = (lanes[64 + 32 * half + k] + (x >> k & 1)) % 2**16
    return len(paragraphs), words, lanes


def plain_likeness(a, b):
    if not a[0] + b[0]:
        return 1.0
    off = a[0] - b[0]
    gap = sum((2 * ((x - y + 2**15) % 2**16 - 2**15) - off) ** 2 for x, y in zip(a[2], b[2], strict=True))
    return max(0.0, min(1.0, 1 - gap / 128 / (a[0] + b[0])))


def test_fingerprints_equal_a_plain_version(spark):
    many = "\n".join(f"Line {i} of a long text." for i in range(3000))
    texts = ["One. Two.\nThree.", "Three. Four!  Five?\n\n six", None, "", "x" * 50_000, many, many.replace("7", "8"), "é. 🙂 ü.\nOne."]
    rows = [(3 * i, t, None) for i, t in enumerate(texts)] + [(6, "again", None), (None, "no id", None)]
    named = docs(spark, rows).withColumns({c: F.lit(1) for c in ("cell", "guard", "v", "ev", "next_v", "edited", "to", "top")})
    for size in (1, 3, 512):
        got = multiset_hash.compare_edited(named, rows=size).collect()
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        assert len(got) == len(rows)
        want = {}
        for i, (d, t, _) in enumerate(order):
            t, after = t or "", order[(i + 1) % len(order)][1] or ""
            k = len(t) // 3
            v, e, x = plain_vector(t), plain_vector(t[: len(t) - k] + after[:k]), plain_vector(after)
            hexed = lambda y: "%08x" % y[0] + "".join("%08x" % w for w in y[1]) + "".join("%04x" % s for s in y[2])
            want[d, len(t)] = hexed(v), hexed(e), round(plain_likeness(v, e), 9), round(plain_likeness(v, x), 9)
        assert {(r.doc_id, r.n_chars): (r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want


def test_ranges_are_found_by_bisection(spark):
    bounds = [-5, 0, 7, 7 + 2**40]
    xs = [-9, -5, -4, 0, 1, 7, 8, 2**41]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", multiset_hash._place(F.col("x"), bounds).alias("i")).collect()
    assert all(r.i == sum(b < r.x for b in bounds) for r in got)


def test_fingerprint_insertion_and_deletion(spark):
    df = spark.createDataFrame([("A one. B two.", "C three.", "A one. B two. C three.")], "a string, b string, ab string")
    a, b, ab = (multiset_hash.vector(F.col(c)) for c in ("a", "b", "ab"))
    text = multiset_hash.text_of
    r = df.select(text(multiset_hash.combine(a, b)).alias("x"), text(ab).alias("y"), text(multiset_hash.combine(ab, b, -1)).alias("z"), text(a).alias("w")).first()
    assert r.x == r.y and r.z == r.w and r.x != r.w


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_guarantee(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "a") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"w{j}#$" for j in range(30)), "a") for i in range(40)]
    odd = [(9000, None, None), (9001, "", "a"), (9002, "a b " * 40, "a"), (9003, "x y\nx y\n \n" * 30, "a"), (9004, "é ü " * 9, "a"), (9000, None, None)]
    rows = good + bad + odd
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = risk_rules.judge(docs(spark, rows), labels).collect()
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert plain_counts(text[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.doc_id < 3000)
    no_labels = risk_rules.judge(docs(spark, rows), labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in no_labels)
    assert risk_rules.judge(docs(spark, rows).limit(0), labels).count() == 0


def test_quality_cutoffs_equal_a_plain_version(spark):
    # 70 strata; in every third one some good texts fail rungs, in the last all do
    def rung(i, stratum):
        if stratum == 69:
            return 0
        return (5 if i % 97 == 0 else 13 if i % 11 == 0 else len(risk_rules.RUNGS)) if stratum % 3 == 0 else len(risk_rules.RUNGS)

    rows = [(i * 70 + s, f"l{s}" if s else None, rung(i, s)) for s in range(70) for i in range(300 + 20 * s)]
    m = spark.createDataFrame(rows, "doc_id long, lang string, rung int")
    labels = m.selectExpr("doc_id", "if(doc_id % 1000 = 7, 0, 1) quality").union(m.limit(5).selectExpr("doc_id", "cast(null as int)"))
    risk = risk_rules.Risk(alpha=0.05, delta=0.1)
    want = {}
    for s in range(70):
        mine = [r for i, x, r in rows if i % 70 == s and i % 1000 != 7]
        n, best = len(mine), None
        for j in range(len(risk_rules.RUNGS)):
            k = sum(r <= j for r in mine)
            if 700 * sum(math.comb(n, x) * 5**x * 95 ** (n - x) for x in range(k + 1)) > 100**n:  # exactly
                break
            best = (n, k, j + 1)
        if best:
            want["null" if not s else f"lang=l{s}"] = best
    got = {r.stratum: (r.n, r.k, r.rungs) for r in risk_rules.cutoffs(m, labels, risk).collect()}
    assert got == want and len({x[2] for x in want.values()}) > 1 and "lang=l69" not in want
    assert risk_rules.cutoffs(m.limit(0), labels, risk).count() == 0


def test_quality_rungs(spark):
    texts = ["one two three " * 10, "a! b! c d e f g h i j", "x# y# z", "p q\n" * 9 + "r", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("text", risk_rules.measures().alias("m")).collect()
    for r in got:
        n = max(1, r.m.n_words)
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        share = {"symbols": r.m.n_symbols / n, "shouts": (r.text or "").count("!") / n, "repeats": r.m.n_repeat_words / n}
        share["same_lines"] = r.m.n_dup_lines / max(1, len(lines))
        fails = [i for i, (rule, c) in enumerate(risk_rules.RUNGS) if share[rule] > c]
        assert r.m.rung == (fails[0] if fails else len(risk_rules.RUNGS))


def test_quality_stage_keeps_columns_that_clash(spark):
    rows = [(i, "word%d " % i * 3 + "and so on it goes for a while until there are enough words here for the base rule of twenty", "a") for i in range(5)]
    df = docs(spark, [*rows, (9, "short", "a")]).withColumns({c: F.lit(1) for c in ("m", "_measures", "_kept", "stratum", "_stratum", "rungs", "_RUNGS")})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = risk_rules.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_binomial_tail(spark):
    for k, n, p in ((0, 300, 0.02), (3, 500, 0.02), (40, 3000, 0.02), (15, 25, 0.9)):
        want = math.log(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))
        got = spark.range(1).select(risk_rules.ln_lower_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(got - want) < 1e-6


def test_fair_mix(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(400)] + [(1000, None, "a"), (1001, "z z", None), (1001, "z z", None)]
    got = fair_mix.mix_counts(docs(spark, rows), cut, rows=16).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    taken, target, longest = defaultdict(int), {}, 7
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.target <= 2 * r.source_size
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, fair_mix.mix_counts(docs(spark, rows).repartition(3), cut, rows=16).collect()))
    named = docs(spark, rows[:-2]).withColumns({c: F.lit(1) for c in ("_id", "passes", "_passes", "_pass", "_turn", "size", "rank")})
    mixed = fair_mix.mix(named, cut, rows=16)
    assert mixed.columns == named.columns
    times = {r.doc_id: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert times == {r.doc_id: r.taken // r.size for r in fair_mix.mix_counts(named, cut, rows=16).collect() if r.taken}
    assert fair_mix.mix_counts(docs(spark, rows).limit(0), cut).count() == 0
