"""Language ID by a linear-chain conditional random field over words.

Words (runs of letters, lower case) get a language each: features are the word itself, affixes, character n-grams and
membership in lexicons of words that the training texts use in one language; transitions between the languages of neighbouring
words are learned with them, on passages of labelled documents and on passages spliced from two languages. Prediction
runs forward-backward over a whole text, and sums the words' marginals: the language with the largest sum is predicted, its
share of the words is the score.

Training takes at most ``per_lang`` documents of each language, by hash of the id, and ``passages`` passages of ``span``
characters of each, spread evenly over its text. That sample grows with the number of languages only and fits the driver, where
memory goes with that number and time with its square (``most_langs`` bounds it, if set); prediction covers every
word of every text. Sequences are cut in blocks whose transfer matrices are multiplied, so that numpy handles all texts
of a batch at once, with exact results.

Edge cases: null texts and texts without letters are ``und`` with score 0; without any labelled document everything else is
``und``, too; ties go to the first language by name; equal texts have equal results, and repeated rows are trained on as often as
they come; a very long text is handled whole, in one task; an empty table gives an empty result; further columns, whatever
their names, are ignored or (``keep_identified``) kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.shipping import lean, ship

UND = "und"
_letters = re.compile(r"[^\W\d_]+")
BLOCK, SPAN = 32, 400
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def words_of(text: str) -> list[str]:
    return _letters.findall(text.lower())


def features(word: str, lexicon: dict[str, str]) -> list[str]:
    w = f"^{word}$"
    out = ["=" + word]
    if (of := lexicon.get(word)) is not None:
        out.append("@" + of)
    out += [w[:k] for k in (2, 3, 4) if k < len(w)]
    out += [w[-k:] for k in (2, 3, 4) if k < len(w)]
    out += [w[i : i + 2] for i in range(1, len(w) - 2)]
    out += [w[i : i + 3] for i in range(1, len(w) - 3)]
    return out


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int] = field(default_factory=dict)
    lexicon: dict[str, str] = field(default_factory=dict)
    weights: np.ndarray | None = None  # features by languages; the last row, of unknown words, is zero
    step: np.ndarray | None = None  # log transition weights
    first: np.ndarray | None = None

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words' features, one after the other, and where each word's begin."""
        get, none = self.index.get, len(self.index)
        flat, begin = [], []
        for w in words:
            begin.append(len(flat))
            flat += [i for f in features(w, self.lexicon) if (i := get(f)) is not None] or [none]
        return np.array(flat, "int32"), np.array(begin, "int64")

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty((0, len(self.langs)), "f4")
        flat, begin = self.rows(words)
        return np.add.reduceat(self.weights[flat], begin, axis=0)


def marginals(emit: np.ndarray, mask: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of padded sequences (n, t, langs): word marginals, summed transition marginals and the log partition sum."""
    n, t, k = emit.shape
    psi = np.exp(emit - emit.max(2, keepdims=True))
    top = emit.max(2)
    move = np.exp(step)
    alpha, scale = np.zeros((n, t, k)), np.ones((n, t))
    a = np.exp(first) * psi[:, 0]
    for i in range(t):
        if i:
            a = np.where(mask[:, i, None], (alpha[:, i - 1] @ move) * psi[:, i], alpha[:, i - 1])
        scale[:, i] = a.sum(1)
        alpha[:, i] = a / scale[:, i, None]
    log_z = float((np.log(scale) * mask).sum() + (top * mask).sum())
    beta, pairs = np.ones((n, k)), np.zeros((k, k))
    out = np.zeros((n, t, k))
    for i in range(t - 1, -1, -1):
        p = alpha[:, i] * beta
        out[:, i] = p / p.sum(1, keepdims=True) * mask[:, i, None]
        if i:
            nb = psi[:, i] * beta
            here = alpha[:, i - 1] * mask[:, i, None]
            norm = ((here @ move) * nb).sum(1, keepdims=True)
            pairs += move * ((here / np.where(norm > 0, norm, 1)).T @ nb)
            nb = nb @ move.T
            beta = np.where(mask[:, i, None], nb / nb.sum(1, keepdims=True), beta)
    return out, pairs, log_z


def train(passages: list[tuple[str, list[str]]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4, least: int = 2) -> Model:
    """Fit by full-batch Adagrad on passages (language, words)."""
    langs = sorted({x for x, _ in passages})
    model = Model(langs)
    by: dict[str, Counter] = {}
    for x, words in passages:
        for w in words:
            by.setdefault(w, Counter())[x] += 1
    for w, c in by.items():
        (x, n), total = c.most_common(1)[0], sum(c.values())
        if n >= 3 and n >= 0.8 * total:
            model.lexicon[w] = x
    seen: Counter = Counter()
    for w in by:
        seen.update(set(features(w, model.lexicon)))
    for f, c in seen.items():
        if c >= least or f[0] == "@" or f[0] == "=" and sum(by[f[1:]].values()) >= least:
            model.index[f] = len(model.index)
    k, m = len(langs), len(model.index)
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(7)
    labelled = [([number[x]] * len(w), w) for x, w in passages]
    for _ in range(len(labelled) // 3):  # spliced passages: code-switching
        (la, wa), (lb, wb) = (labelled[i] for i in rng.integers(0, len(passages), 2))
        i, j = rng.integers(0, len(wa) + 1), rng.integers(0, len(wb) + 1)
        if wa[:i] + wb[j:]:
            labelled.append((la[:i] + lb[j:], wa[:i] + wb[j:]))
    names = sorted({w for _, ws in labelled for w in ws})
    place = {w: i for i, w in enumerate(names)}
    t = max(len(w) for _, w in labelled)
    word, truth = np.zeros((len(labelled), t), "int64"), np.full((len(labelled), t), -1)
    for r, (ls, ws) in enumerate(labelled):
        word[r, : len(ws)] = [place[w] for w in ws]
        truth[r, : len(ls)] = ls
    mask = truth >= 0
    gold = np.eye(k)[np.maximum(truth, 0)] * mask[:, :, None]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (truth[:, :-1][mask[:, 1:]], truth[:, 1:][mask[:, 1:]]), 1)
    model.weights, model.step, model.first = np.zeros((m + 1, k)), np.zeros((k, k)), np.zeros(k)
    flat, begin = model.rows(names)
    spans = np.diff(np.r_[begin, len(flat)])
    sums = [np.full((m + 1, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)]
    n = mask.sum()
    for _ in range(rounds):
        emit = np.add.reduceat(model.weights[flat], begin, axis=0)[word]
        p, pairs, _ = marginals(emit, mask, model.step, model.first)
        off = (gold - p).reshape(-1, k)
        per_word = np.stack([np.bincount(word.ravel(), off[:, c], len(names)) for c in range(k)], 1)
        spread = np.repeat(per_word, spans, axis=0)
        slopes = [
            np.stack([np.bincount(flat, spread[:, c], m + 1) for c in range(k)], 1) / n - decay * model.weights,
            (gold_pairs - pairs) / n - decay * model.step,
            (gold[:, 0] - p[:, 0]).sum(0) / n - decay * model.first,
        ]
        slopes[0][m] = 0
        for x, g, s in zip((model.weights, model.step, model.first), slopes, sums, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    model.weights = model.weights.astype("f4")
    return model


def sample(docs: DataFrame, per_lang: int = 150, most_langs: int | None = None, passages: int = 4, span: int = SPAN) -> list[tuple[str, list[str]]]:
    """``passages`` passages of ``span`` characters of labelled documents that are not held out: at most ``per_lang`` documents
    of each language, or of the ``most_langs`` most frequent ones."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.select("doc_id", "lang", "text")
    if most_langs is not None:
        counts = own.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_langs).select("lang")
        own = own.join(F.broadcast(counts), "lang", "left_semi")
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = own.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h"))
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).select("doc_id", "lang")
    ids = F.broadcast(ids.distinct())  # at most per_lang ids of a language
    length = F.char_length("text")
    spans = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(passages - 1)),
            lambda i: F.substring(F.col("text"), (F.greatest(length - span, F.lit(0)) * i / max(1, passages - 1)).cast("int") + 1, F.lit(span)),
        )
    )
    # of rows with one id, each is taken; the hash keeps the order of the sample the same in every run
    got = own.join(ids, ["doc_id", "lang"]).select("lang", "doc_id", spans.alias("spans"))
    out = []
    for r in sorted(got.collect(), key=lambda r: (r.lang, r.doc_id, r.spans)):
        for s in r.spans:
            words = words_of(s)
            words = words[1:-1] if len(words) > 4 else words  # cut words at both ends
            for i in range(0, len(words), BLOCK):
                if words[i : i + BLOCK]:
                    out.append((r.lang, words[i : i + BLOCK]))
    return out


class Tagger:
    """Applies a model to batches of texts; emissions of words seen lately are kept."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep = model, keep
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(model.langs)), "f4")

    def _numbers(self, words: list[str]) -> list[int]:
        place = self.place
        try:
            return [place[w] for w in words]
        except KeyError:
            for w in words:
                if w not in place:
                    place[w] = len(place)
            return [place[w] for w in words]

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed marginals of the words of each text, and numbers of words."""
        k = len(self.model.langs)
        if len(self.place) > self.keep:
            self.place, self.table = {}, self.table[:0]
        numbers = [self._numbers(words_of(x)) if x else [] for x in texts]
        lengths = np.array([len(x) for x in numbers], "int64")
        total = np.zeros((len(texts), k))
        if not lengths.sum():
            return total, lengths
        if len(self.table) < len(self.place):
            new = list(self.place)[len(self.table) :]
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        blocks = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        at = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # number of a block in its text
        flat = np.full((len(text), BLOCK), -1, "int64")
        base = np.cumsum(blocks) - blocks
        put = np.repeat(base * BLOCK, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat.ravel()[put] = np.concatenate([np.array(x, "int64") for x in numbers if x])
        mask = flat >= 0
        emit = self.table[flat]
        psi = np.exp(emit - emit.max(2, keepdims=True)).astype("f4")
        move, start = np.exp(self.model.step).astype("f4"), np.exp(self.model.first).astype("f4")
        # transfer matrix of each block; a text's first word has no transition
        whole = np.broadcast_to(np.eye(k, dtype="f4"), (len(text), k, k)).copy()
        for i in range(BLOCK):
            rows = np.flatnonzero(mask[:, i])
            m = whole[rows]
            if i == 0:
                m = np.where((at[rows] > 0)[:, None, None], m @ move, m)
            else:
                m = m @ move
            m = m * psi[rows, i][:, None, :]
            whole[rows] = m / m.sum((1, 2), keepdims=True)
        front, back = np.empty((len(text), k), "f4"), np.ones((len(text), k), "f4")
        deep = int(blocks.max())
        front[base[blocks > 0]] = start
        live = np.flatnonzero(blocks > 1)
        for j in range(1, deep):
            live = live[blocks[live] > j]
            prev = base[live] + j - 1
            v = np.einsum("nk,nkl->nl", front[prev], whole[prev])
            front[prev + 1] = v / v.sum(1, keepdims=True)
        for j in range(deep - 1, 0, -1):
            live = np.flatnonzero(blocks > j)
            here = base[live] + j
            v = np.einsum("nkl,nl->nk", whole[here], back[here])
            back[here - 1] = v / v.sum(1, keepdims=True)
        alpha = np.empty((len(text), BLOCK, k), "f4")
        a = front
        for i in range(BLOCK):
            moved = np.where((at > 0)[:, None], a @ move, a) if i == 0 else a @ move
            new = moved * psi[:, i]
            a = np.where(mask[:, i, None], new / new.sum(1, keepdims=True), a)
            alpha[:, i] = a
        summed = np.zeros((len(text), k))
        b = back
        for i in range(BLOCK - 1, -1, -1):
            p = alpha[:, i] * b
            summed += np.where(mask[:, i, None], p / p.sum(1, keepdims=True), 0)
            nb = (psi[:, i] * b) @ move.T
            b = np.where(mask[:, i, None], nb / nb.sum(1, keepdims=True), b)
        np.add.at(total, text, summed)
        return total, lengths


def _tag(model, most: int = 1 << 19):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        tagger = Tagger(m) if m.langs else None
        for b in batches:
            texts = list(b.text)
            out_lang, out_score = [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= most):
                    size += len(texts[j] or "")
                    j += 1
                if tagger is None:
                    out_lang += [UND] * (j - i)
                    out_score += [0.0] * (j - i)
                else:
                    total, n = tagger.sums(texts[i:j])
                    share = total / np.maximum(n, 1)[:, None]
                    best = np.argmax(np.round(share, 9), axis=1)
                    out_lang += [m.langs[x] if c else UND for x, c in zip(best, n, strict=True)]
                    out_score += np.clip(np.where(n > 0, share[np.arange(len(best)), best], 0.0), 0.0, 1.0).tolist()
                i = j
            yield b.drop(columns="text").assign(lang_pred=out_lang, score=out_score)

    return run


def fit(docs: DataFrame, **options) -> Model:
    passages = sample(docs, **options)
    return train(passages) if passages else Model([])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    run = _tag(spark.sparkContext.broadcast(model))

    def typed(batches):
        for b in run(batches):
            yield b.astype({"doc_id": "Int64"})

    return given.mapInPandas(lean(typed), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, fit(docs, **options))


def keep_identified(docs: DataFrame, sure: float = 0.9, **options) -> DataFrame:
    """The rows of ``docs`` with a language: some letters, and no label that a prediction of score ``sure`` contradicts.

    A language that the model has not learned can't be predicted, so its label is never contradicted.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, **options))
    run = _tag(model)
    columns = docs.columns

    def keep(batches):
        for b in batches:
            got = next(run(iter([b[["text"]]])))
            wrong = b.lang.isin(model.value.langs).to_numpy() & (got.lang_pred.to_numpy() != b.lang.to_numpy()) & (got.score.to_numpy() >= sure)
            yield b[(got.lang_pred.to_numpy() != UND) & ~wrong]

    from pyspark.sql import types as T

    whole = T.StructType([f for f in docs.schema.fields])
    numbers = {f.name: "Int64" for f in whole.fields if f.dataType.typeName() in ("long", "integer", "short")}

    def typed(batches):
        for b in keep(b.astype(numbers) for b in batches):
            yield b[columns]

    return docs.mapInPandas(lean(typed), whole)


def crc_mod(doc_id: int) -> int:
    """The held-out rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
