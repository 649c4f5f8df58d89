"""Quality rules whose cutoffs come from labelled holdouts with a guarantee.

Each rule measures a text and rejects it above a cutoff. The rules' cutoffs make one ladder: each rung tightens one rule by one
step of its grid, rule after rule, so a text that fails a rung fails all above it. For each stratum (language) the highest
rung is taken whose false rejection of good texts, by all rules together, is certified: among n good holdout texts, of
which k fail the rung, the exact binomial tail P(Bin(n, alpha) <= k) must be at most delta divided by the number of strata
(Bonferroni). A stratum's rungs are tested from lenient to strict up to the first failure, a fixed sequence, which needs no
division by its length; as k only grows on the way, that is the highest rung to pass. With probability 1 - delta at least, no
stratum then loses more than alpha of its good texts. A stratum in which no rung can be certified has no cutoffs: with
delta = 0.05, four strata and alpha = 0.02 that takes 217 good labels, were none of them to fail.

Only DataFrame functions run over the texts. Every stratum has its own rung, in a table that is joined; only strata with a
certified rung are in it, which have hundreds of good labels each.

Edge cases: a null or empty text has no words, so it fails the base rule; a null language is a stratum of its own;
a document without label takes no part in the choice of cutoffs; of repeated labels of one document each counts,
null labels don't; repeated rows have equal results; very long texts are measured whole; without labels only the base rule
rejects; an empty table gives an empty result; further columns, whatever their names, are ignored or (``keep_good``) kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import cut, fresh, let, words_of

#: Grids, lenient to strict. Share of: symbols per word, exclamation marks per word, words in repeated windows, repeated lines.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.0, 0.5, 0.25, 0.1, 0.05),
    "shouts": (1.5, 1.0, 0.5, 0.25, 0.15, 0.1),
    "repeats": (0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "same_lines": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
}
#: The ladder: (rule, cutoff) of each rung.
RUNGS = [(r, GRIDS[r][i]) for i in range(6) for r in GRIDS]
WINDOW = 8


@dataclass(frozen=True)
class Risk:
    alpha: float = 0.02  # most good texts of a stratum that its cutoffs reject
    delta: float = 0.05  # chance that the guarantee fails anywhere


def repeated_words(words: Column) -> Column:
    """Words covered by windows of 8 words that the text has twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def by_place(s: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                before, after = F.get(s, j - 1), F.get(s, j + 1)
                return F.coalesce(before.h == x.h, F.lit(False)) | F.coalesce(after.h == x.h, F.lit(False))

            def width(at: Column) -> Column:
                return F.aggregate(
                    F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                )

            return let(F.array_sort(F.transform(F.filter(s, same), lambda x: x.i)), width)

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(pairs), by_place)
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(
            F.transform(
                F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
            ),
            covered,
        )
    )


def measures() -> Column:
    """Of a row with ``text``: a struct of the base counts, the rules' shares and ``rung``, the first rung that the text fails."""
    text = F.coalesce("text", F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    got = F.struct(
        let(words_of(F.col("text")), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
    )

    def shares(x: Column) -> Column:
        n = F.greatest(x.w.n_words, F.lit(1)).cast("double")
        return F.struct(
            x.w.n_words.alias("n_words"),
            x.w.word_chars.alias("word_chars"),
            x.n_symbols.alias("n_symbols"),
            x.l.n_dup_lines.alias("n_dup_lines"),
            x.w.n_repeat_words.alias("n_repeat_words"),
            ((x.w.n_words < 20) | (100 * x.w.n_repeat_words > 30 * x.w.n_words)).alias("base_failed"),
            (x.n_symbols / n).alias("symbols"),
            (x.n_shouts / n).alias("shouts"),
            (x.w.n_repeat_words / n).alias("repeats"),
            (x.l.n_dup_lines / F.greatest(x.l.n_lines, F.lit(1)).cast("double")).alias("same_lines"),
        )

    def graded(x: Column) -> Column:
        fails = [F.when(x[r] > c, i) for i, (r, c) in enumerate(RUNGS)]
        return F.struct(*[x[c].alias(c) for c in (*COUNTS, "base_failed", *GRIDS)], F.coalesce(*fails, F.lit(len(RUNGS))).alias("rung"))

    return let(let(got, shares), graded)


def _ln_factorial(x: Column) -> Column:
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def ln_lower_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for k < n p: terms from k downwards until they no longer count."""
    import math

    at_k = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, (12 * F.sqrt(n * (p * (1 - p))) + 50).cast("long"))
    odds = (1 - p) / p
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: let(
            a.t * (k - i + 1) / (n - k + i) * odds, lambda t: F.struct(t.alias("t"), (a.s + t).alias("s"))
        ),
        lambda a: a.s,
    )
    return at_k + F.log(total)


def _stratum(lang: Column) -> Column:
    return F.when(lang.isNull(), "null").otherwise(F.concat(F.lit("lang="), lang))


def cutoffs(graded: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``stratum, n, k, rungs`` of strata with a certified rung: good labels, how many of them fail, and the number of rungs.

    ``graded``: doc_id, lang, rung. Counts go up to the strata's table, one row each.
    """
    good = labels.where(F.col("quality") == 1).select("doc_id")
    held = graded.select("doc_id", _stratum(F.col("lang")).alias("stratum"), "rung").join(good, "doc_id")
    failed = [F.count_if(F.col("rung") <= i).alias(f"k{i}") for i in range(len(RUNGS))]
    counts = cut(held.groupBy("stratum").agg(F.count("*").alias("n"), *failed), "strata")
    tests = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rungs"), F.col(f"k{i}").alias("k")) for i in range(len(RUNGS))]))
    each = counts.select("stratum", "n", tests.alias("t")).select("stratum", "n", "t.*")
    level = risk.delta / max(1, counts.count())
    few = F.col("k") < F.col("n") * risk.alpha
    tail = F.when(few, ln_lower_tail(F.col("k"), F.col("n"), risk.alpha))
    return each.where(few & (tail <= F.log(F.lit(level)))).groupBy("stratum", "n").agg(F.max("k").alias("k"), F.max("rungs").alias("rungs"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(rows: DataFrame, cuts: DataFrame, m: str, kept: str) -> DataFrame:
    """``rows`` (with lang and the struct ``m``) with ``kept``: no base failure, no rung failed that its stratum certifies."""
    stratum, rungs = fresh(rows, "stratum"), fresh(rows, "rungs")
    mine = cuts.select(F.col("stratum").alias(stratum), F.col("rungs").alias(rungs))
    got = rows.withColumn(stratum, _stratum(F.col("lang"))).join(F.broadcast(mine), stratum, "left")
    return got.withColumn(kept, ~F.col(m)["base_failed"] & (F.col(m)["rung"] >= F.coalesce(F.col(rungs), F.lit(0))))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), hold=cut) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept``. ``hold`` stores the measures between both passes."""
    rows = hold(docs.select("doc_id", "lang", measures().alias("m")))
    cuts = cutoffs(rows.select("doc_id", "lang", "m.rung"), labels, risk)
    got = _judged(rows, cuts, "m", "kept")
    return got.select("doc_id", *[F.col("m")[c].alias(c) for c in (*COUNTS, "base_failed")], "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), hold=cut) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Texts are measured once: ``hold`` stores the rows with their measures."""
    m, kept = fresh(docs, "measures"), fresh(docs, "kept")
    rows = hold(docs.withColumn(m, measures()))
    cuts = cutoffs(rows.select("doc_id", "lang", F.col(m)["rung"].alias("rung")), labels, risk)
    return _judged(rows, cuts, m, kept).where(F.col(kept)).select(*docs.columns)
