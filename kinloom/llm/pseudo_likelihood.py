"""LM scoring by masked pseudo-likelihood.

A small network, trained in numpy, predicts every word from a window on both sides of it: the neighbours' embeddings (one
table for each place in the window) are summed, pass a tanh layer and give the word's probability in two steps, P(cluster) and
P(member | cluster). A document's score is the sum of the words' conditional log-probabilities. The vocabulary is every word
of the documents (64-bit hashes, A-Z as a-z): the most frequent are members of their own, clustered by frequency; all others
fall into hash classes, the members of the last cluster, and a word's probability is its class's times P(word | class), its share of the class's
occurrences in all documents. A text's ends are marked.

What is gathered grows with the corpus: every word is counted, and the network has clusters and members in proportion to
the fourth root of the number of distinct words, so outputs and embeddings in proportion to its square root (``side_for``).

Training reads all documents in each of ``rounds`` rounds and predicts, in each round, another part of every document's
words (of two rounds, every other word), so that after the last round every word was predicted once. Documents are dealt to shards by a hash
of their words, about ``SHARD`` words each, in an order that only their words decide. Each shard trains from the round's start, and parameters
are averaged over shards by numbers of words, as sums of whole numbers. So the model doesn't depend on partitions, tasks or
retries, and one model's size is all that reaches the driver.

Edge cases: null texts and texts without words have no words and score 0 (mean null); equal texts have equal scores; without any
word the network stays as it began; an empty table gives an empty result; a very long text is
scored whole, in one task; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import cut, parts
from kinloom.llm.hashing import batch, mix64, numbers, runs, word_hashes
from kinloom.shipping import ship

EDGE = 0  # the mark before and after a text
SHARD = 1 << 20  # words
CHUNK = 2 << 20  # bytes of texts handled at once
AT_ONCE = 1 << 16  # words whose windows are held at once
SCORED = 1 << 13  # words that are scored at once: their arrays stay in the processor's cache
COUNTED = 1 << 20  # distinct words that a task holds before it passes counts on
TAME = 40  # logits up to which exponentials and their products are far from a float's ends
MASKS = 4  # parts of a text's words, of which a shard predicts one, if it isn't told
SCALE = 1 << 24  # parameters are added up in these units
PIECE = 1 << 12  # parameters in a row on their way to the driver


@dataclass(frozen=True)
class Shape:
    side: int  # clusters, and members of each
    window: int = 2
    hidden: int = 16

    @property
    def words(self) -> int:
        """Members that are words of their own."""
        return self.side * (self.side - 1)

    @property
    def vocabulary(self) -> int:
        return 1 + self.side * self.side


def side_for(distinct: int) -> int:
    """Clusters and members for a number of distinct words: twice its fourth root, in steps of 8."""
    return max(8, 8 * round(distinct**0.25 / 4))


@dataclass
class Vocabulary:
    """Member numbers of word hashes. ``words``: hashes by member number less 1; ``known``: hashes (sorted) of rare words with
    their ln P(word | class) in ``share``; other rare words are joined with theirs."""

    shape: Shape
    words: np.ndarray
    known: np.ndarray
    share: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.ordered = self.words[self.order]

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(h), "int64"), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return at, table[at] == h

    def members(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Member numbers, and whether each is a word of its own."""
        at, own = self._find(self.ordered, h)
        out = class_of(h, self.shape)
        out[own] = self.order[at[own]] + 1
        return out, own


def class_of(h: np.ndarray, shape: Shape) -> np.ndarray:
    """Member numbers of the hash classes."""
    return (h % np.uint64(shape.side)).astype("int64") + shape.words + 1


def sizes(shape: Shape) -> list[tuple[int, ...]]:
    v, d, k, s = shape.vocabulary, shape.hidden, 2 * shape.window, shape.side
    return [(k * v, d), (d,), (d + 1, s), (s, d + 1, s)]


def layers(params: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Window tables, hidden bias, and the matrices of clusters and of members, the last row of each being its bias."""
    ends = np.cumsum([int(np.prod(x)) for x in sizes(shape)])
    return [p.reshape(x) for p, x in zip(np.split(params, ends[:-1]), sizes(shape), strict=True)]


def views(params: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Window tables, hidden bias, cluster matrix and bias, member matrices and biases."""
    tables, bias, top, deep = layers(params, shape)
    return [tables, bias, top[:-1], top[-1], deep[:, :-1], deep[:, -1]]


def initial(shape: Shape, seed: int = 5) -> np.ndarray:
    """All parameters in one vector."""
    rng = np.random.default_rng(seed)
    params = np.zeros(sum(int(np.prod(x)) for x in sizes(shape)), "f4")
    for i in (0, 2, 4):
        weights = views(params, shape)[i]
        weights[...] = rng.normal(0, 0.1, weights.shape)
    return params


def windows(ids: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the window tables for each word of the texts (one after the other), and the words."""
    w, v = shape.window, shape.vocabulary
    pad = np.full(w, EDGE)
    flat = np.concatenate([pad, *(x for t in ids for x in (t, pad))]).astype("int64")
    at = np.flatnonzero(flat != EDGE)
    sides = [o for o in range(-w, w + 1) if o]
    kind = "u2" if 2 * w * v <= 1 << 16 else "u4"
    return np.stack([(flat[at + o] + i * v).astype(kind) for i, o in enumerate(sides)], 1), flat[at]


def _hidden(tables: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The hidden layer, and a column of ones for the biases."""
    h = tables.take(rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        h += tables.take(rows[:, j], axis=0)
    h += bias
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    np.tanh(h, out=out[:, :-1])
    return out


def _by_cluster(words: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of words by cluster; their clusters and members in this order; and (cluster, first, end) of its runs."""
    c, m = np.divmod(words - 1, shape.side)
    order = np.argsort(c.astype("u2"), kind="stable")
    c, m = c[order], m[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    return order, c, m, list(zip(c[first].tolist(), first.tolist(), np.r_[first[1:], len(c)].tolist(), strict=True))


def _tame(weights: np.ndarray) -> bool:
    """Whether the hidden layer, within -1 and 1, can't give logits beyond ``TAME``: their exponentials need no shift."""
    return bool(np.abs(weights).sum(-2).max() <= TAME)


def _exp(z: np.ndarray, tame: bool) -> np.ndarray | float:
    """Takes exponentials in place; returns by how much each row was lowered for that."""
    top = 0.0
    if not tame:
        top = z.max(1)
        z -= top[:, None]
        np.maximum(z, -80, out=z)
    np.exp(z, out=z)
    return top


def log_probabilities(params: np.ndarray, rows: np.ndarray, words: np.ndarray, shape: Shape) -> np.ndarray:
    tables, bias, first, deep = layers(params, shape)
    tame, tame_deep = _tame(first), _tame(deep)
    got, ones = np.empty(len(words)), np.ones(shape.side, params.dtype)
    for i in range(0, len(words), SCORED):
        r, w = rows[i : i + SCORED], words[i : i + SCORED]
        order, c, m, spans = _by_cluster(w, shape)
        h, at = _hidden(tables, bias, r[order]), np.arange(len(w))
        z = h @ first
        own = z[at, c].astype("f8")
        top = _exp(z, tame)
        own -= np.log(z @ ones) + top
        for k, x, y in spans:
            z = h[x:y] @ deep[k]
            mine = z[at[: y - x], m[x:y]].astype("f8")
            top = _exp(z, tame_deep)
            own[x:y] += mine - (np.log(z @ ones) + top)
        got[i + order] = own
    return got


def _adagrad(x: np.ndarray, state: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Uses up ``grad``."""
    square = grad * grad
    state += square
    np.add(state, 1e-8, out=square)
    np.sqrt(square, out=square)
    grad *= rate
    grad /= square
    x -= grad


def _errors(h: np.ndarray, weights: np.ndarray, own: np.ndarray, at: np.ndarray, ones: np.ndarray, tame: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What a softmax layer returns to the hidden layer, and the gradient of its weights. Rows are weighted on the narrow side."""
    z = h @ weights
    _exp(z, tame)
    total = z @ ones
    z[at, own] -= total
    total *= n
    back = z @ weights[:-1].T
    back /= total[:, None]
    return back, (h / total[:, None]).T @ z


def train(params: np.ndarray, rows: np.ndarray, words: np.ndarray, shape: Shape, state: np.ndarray, rate: float = 0.1, step: int = 4096) -> None:
    """One pass of Adagrad over the words; changes ``params`` and ``state``."""
    tables, bias, first, deep = layers(params, shape)
    s_tables, s_bias, s_first, s_deep = layers(state, shape)
    sides, ones, grads = rows.shape[1], np.ones(shape.side, params.dtype), np.empty_like(deep)
    for i in range(0, len(words), step):
        w = words[i : i + step]
        n = len(w)
        order, c, m, spans = _by_cluster(w, shape)
        r, at = rows[i : i + step][order], np.arange(n)
        h = _hidden(tables, bias, r)
        g_h, g = _errors(h, first, c, at, ones, _tame(first), n)
        _adagrad(first, s_first, g, rate)
        tame = _tame(deep)
        grads[...] = 0
        for k, x, y in spans:
            back, grads[k] = _errors(h[x:y], deep[k], m[x:y], at[: y - x], ones, tame, n)
            g_h[x:y] += back
        _adagrad(deep, s_deep, grads, rate)
        h = h[:, :-1]
        g_h *= 1 - h * h
        _adagrad(bias, s_bias, g_h.sum(0), rate)
        flat = r.ravel()
        place = np.argsort(flat, kind="stable")
        flat = flat[place]
        new = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        g, used = np.add.reduceat(g_h.take(place // sides, axis=0), new, axis=0), flat[new].astype("int64")
        s = s_tables.take(used, axis=0) + g * g
        s_tables[used] = s
        tables[used] -= rate * g / np.sqrt(s + 1e-8)


class Shard:
    """A model in training on one shard; what it has seen decides when it steps, not how the data came."""

    def __init__(self, start: np.ndarray, shape: Shape, turn: int, masks: int = MASKS):
        self.params, self.state, self.shape, self.turn, self.masks = start.copy(), np.zeros_like(start), shape, turn, masks
        self.held: list[np.ndarray] = []
        self.size = self.words = 0

    @classmethod
    def of_round(cls, start: np.ndarray, shape: Shape, turn: int, rounds: int) -> Shard:
        """As many parts as rounds, so that together they predict every word once."""
        return cls(start, shape, turn, rounds)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if self.size:
            rows, words = windows(self.held, self.shape)
            at = np.concatenate([np.arange(len(x)) for x in self.held])
            mine = at % self.masks == self.turn % self.masks
            train(self.params, rows[mine], words[mine], self.shape, self.state)
            self.words += self.size
        self.held, self.size = [], 0

    def total(self) -> tuple[int, np.ndarray]:
        """The shard's weight and its parameters times that, in whole units."""
        self.flush()
        weight = max(1, self.words >> 10)
        return weight, np.rint(self.params.astype("f8") * SCALE).astype("int64") * weight


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, n``: every word's hash and how often it occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([n for _, n in held])).astype("int64")

        for b in batches:
            for *_, data, at in runs(b.column(0), CHUNK):
                held.append(np.unique(word_hashes(data, at)[0], return_counts=True))
                size += len(held[-1][0])
            if size >= COUNTED and held:
                h, n = summed()
                if len(h) >= COUNTED // 2:
                    yield batch(h=h.view("i8"), n=n)
                    held, size = [], 0
                else:
                    held, size = [(h, n)], len(h)
        if held:
            h, n = summed()
            yield batch(h=h.view("i8"), n=n)

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, shape: Shape, near: int = 400_000) -> tuple[Vocabulary, DataFrame]:
    """The words of ``counts`` (stored) by rank, ties by hash, and ``h, x`` with x = ln P(word | class) of the rare words
    that the vocabulary leaves out: it holds the commonest of them, at most ``near`` (16 bytes each)."""
    ranked = counts.orderBy(F.col("n").desc(), "h").limit(shape.words).toPandas()
    words = ranked.h.to_numpy("int64").view("u8")
    if len(ranked) < shape.words:
        return Vocabulary(shape, words, np.empty(0, "u8"), np.empty(0)), counts.select("h", F.lit(0.0).alias("x")).limit(0)
    last = ranked.iloc[-1]
    rare = counts.where((F.col("n") < int(last.n)) | ((F.col("n") == int(last.n)) & (F.col("h") > int(last.h))))
    # unsigned remainder of a signed 64-bit number
    side = F.lit(shape.side).cast("long")
    cls = F.pmod(F.pmod(F.shiftrightunsigned("h", 1), side) * 2 + F.col("h").bitwiseAND(F.lit(1).cast("long")), side)
    rare = rare.withColumn("c", cls).withColumn("step", F.floor(8 * F.log2("n")).cast("int"))
    cells = rare.groupBy("c", "step").agg(F.count("*").alias("words"), F.sum("n").alias("n")).toPandas()
    if not len(cells):
        return Vocabulary(shape, words, np.empty(0, "u8"), np.empty(0)), rare.select("h", F.lit(0.0).alias("x"))
    total = cells.groupby("c").n.sum()
    held = cells.groupby("step").words.sum().sort_index(ascending=False).cumsum()
    held = held[held <= near]
    least = int(held.index.min()) if len(held) else int(cells.step.max()) + 1
    known = rare.where(F.col("step") >= least).select("h", "c", "n").toPandas()
    x = np.log(known.n.to_numpy("f8")) - np.log(total.reindex(known.c).to_numpy("f8"))
    h = known.h.to_numpy("int64").view("u8")
    order = np.argsort(h)
    totals = counts.sparkSession.createDataFrame([(int(c), float(n)) for c, n in total.items()], "c long, total double")
    rest = rare.where(F.col("step") < least).join(F.broadcast(totals), "c")  # a row for each class
    return Vocabulary(shape, words, h[order], x[order]), rest.select("h", (F.log("n") - F.log("total")).alias("x"))


ENCODED = "doc_id long, n_words long, key long, ids binary, inner double, rest array<long>"


def encoded(docs: DataFrame, voc) -> DataFrame:
    """For each document its member numbers (16 or 32 bits each), a hash of its words, the sum of ln P(word | class) of its
    rare words in the broadcast vocabulary and the hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voc.value
        kind = "u2" if v.shape.vocabulary <= 1 << 16 else "u4"
        for b in batches:
            for i, j, data, at in runs(b.column(1), CHUNK):
                h, n = word_hashes(data, at)
                ids, own = v.members(h)
                ids = ids.astype(kind)
                end = np.cumsum(n)
                begin = end - n
                rare = np.flatnonzero(~own)
                place, known = v._find(v.known, h[rare])
                inner = np.zeros(len(h) + 1)
                inner[rare[known] + 1] = v.share[place[known]]
                left = rare[~known]
                # each text's own sum, so that equal texts have equal ones
                inner = [float(inner[x + 1 : y + 1].sum()) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                key = np.zeros(len(n), "u8")
                if len(h):
                    at_word = np.arange(len(h)) - np.repeat(begin, n)
                    key[n > 0] = np.add.reduceat(mix64(h + mix64(at_word.astype("u8") + np.uint64(1))), begin[n > 0])
                rest = pa.ListArray.from_arrays(np.searchsorted(left, np.r_[begin, len(h)]).astype("i4"), pa.array(h[left].view("i8")))
                raw = [ids[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                yield batch(doc_id=b.column(0).slice(i, j - i), n_words=n, key=key.view("i8"), ids=pa.array(raw, pa.binary()), inner=np.array(inner), rest=rest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def _ids(column: pa.Array, shape: Shape) -> Iterator[np.ndarray]:
    kind = "u2" if shape.vocabulary <= 1 << 16 else "u4"
    return (np.frombuffer(x.as_buffer(), kind) for x in column)


def fit(docs: DataFrame, shape: Shape, rounds: int = 2) -> np.ndarray:
    """Parameters after ``rounds`` rounds over all documents (``encoded``, stored); each word is predicted in one of them."""
    spark = docs.sparkSession
    params = initial(shape)
    words = docs.agg(F.sum("n_words")).first()[0] or 0
    if not words:
        return params
    shards = max(1, round(words / SHARD))
    rows = docs.where(F.col("n_words") > 0).select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "ids")
    tasks = min(shards, parts(spark))
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(params)

        def step(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            weight, total, now, model = 0, 0, None, None
            for b in batches:
                for shard, ids in zip(b.column(0).to_pylist(), _ids(b.column(2), shape), strict=True):
                    if shard != now:
                        if model:
                            w, x = model.total()
                            weight, total = weight + w, total + x
                        now, model = shard, Shard.of_round(start.value, shape, turn, rounds)
                    model.add(ids)
            if model:
                w, x = model.total()
                weight, total = weight + w, total + x
                pieces = [total[i : i + PIECE].tobytes() for i in range(0, len(total), PIECE)]
                yield batch(piece=np.arange(len(pieces)), weight=np.full(len(pieces), weight), total=pa.array(pieces, pa.binary()))

        def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, "int64") for x in group.total)
            mean = (total / float(group.weight.sum()) / SCALE).astype("f4")
            return pd.DataFrame({"piece": [key[0]], "mean": [mean.tobytes()]})

        sorted_ = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "key", "ids")
        sums = sorted_.mapInArrow(step, "piece long, weight long, total binary").groupBy("piece").applyInPandas(added, "piece long, mean binary")
        got = sums.toPandas().sort_values("piece")
        params = np.frombuffer(b"".join(got["mean"]), "f4").copy()
    return params


def apply(docs: DataFrame, params: np.ndarray, shape: Shape, rest: DataFrame) -> DataFrame:
    """``doc_id, n_words, score, mean_score`` for every document (``encoded``, stored)."""
    model = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = list(_ids(b.column("ids"), shape)), numbers(b.column("n_words"))
            score, i = numbers(b.column("inner")).copy(), 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and (j == i or size + len(ids[j]) <= AT_ONCE):
                    size += len(ids[j])
                    j += 1
                if size:
                    lp = np.r_[log_probabilities(model.value, *windows(ids[i:j], shape), shape), 0.0]
                    ends = np.cumsum(n[i:j])
                    score[i:j] += [float(lp[e - k : e].sum()) if k else 0.0 for e, k in zip(ends.tolist(), n[i:j].tolist(), strict=True)]
                i = j
            yield batch(doc_id=b.column("doc_id"), n_words=n, key=b.column("key"), score=score, rest=b.column("rest"))

    held = docs.select("doc_id", "n_words", "key", "ids", "inner", "rest")
    scored = held.mapInArrow(run, "doc_id long, n_words long, key long, score double, rest array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    # a word's place in a batch may change a sum's last digits: equal texts take the least of their sums
    least = scored.groupBy("key", "n_words").agg(F.min("score").alias("least"), F.count("*").alias("c")).where(F.col("c") > 1)
    scored = scored.join(least.drop("c"), ["key", "n_words"], "left").withColumn("score", F.coalesce("least", "score"))
    # sums of whole numbers don't depend on their order
    words = scored.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    each = words.join(rest, "h").select("row", (F.col("n") * F.round(F.col("x") * 2**32).cast("long")).alias("x"))
    got = scored.drop("rest").join(each.groupBy("row").agg(F.sum("x").alias("x")), "row", "left")
    score = F.col("score") + F.coalesce(F.col("x"), F.lit(0)) / 2**32
    return got.select("doc_id", "n_words", score.alias("score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_score"))


def score(docs: DataFrame, shape: Shape | None = None, rounds: int = 2, near: int = 400_000) -> DataFrame:
    """``doc_id, n_words, score, mean_score`` for every document."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs), "words")
    shape = shape or Shape(side_for(counts.count()))
    voc, rest = vocabulary(counts, shape, near)
    stored = cut(encoded(docs, spark.sparkContext.broadcast(voc)), "encoded")
    return apply(stored, fit(stored, shape, rounds), shape, rest)
