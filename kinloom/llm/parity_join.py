"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles (64-bit hashes). Each shingle flips one bit of a sketch, so the Hamming
distance of two sketches is at most the size of the sets' symmetric difference; for a Jaccard similarity of t
or more that is at most d = (1-t)/(1+t) * (|A|+|B|).

Pigeonhole per size band: within a band (an octave of set sizes, and the sizes above that can still reach it) the shingles'
hashes are dealt to m parts of a very wide sketch, a part being kept as the XOR of its shingles' hashes (equal parts have equal
XOR). A difference spoils one part at most, so of a document's occupied parts all but d are found in its partner. It
therefore suffices to join on any d+1 of them, if all documents choose by one order: parts that hold a
rarer shingle come first, parts of very frequent shingles last, then by hash. (Sets under 64 shingles have a part for each
hash.) A document with too few occupied parts for that is compared with all of its size band and the next ones.

The join never lists all pairs of a bucket. First each member meets the smallest id of its bucket; buckets of frequent
shingles are salted for that, and their salts' smallest ids meet in turn. Pairs are filtered by size and by the sketch's Hamming
distance, then verified on the whole sets; components follow. Then buckets whose members are still in several components
are compared by sketch, in blocks of bounded size and across components only: each component is verified against its
nearest neighbour, and what else is near is compared once more, in its block and on the whole sets, which returns the links
that join components there. So what a step returns grows with the rows it reads, not with the pairs it compares, and no linked pair
of different texts is lost. Documents of equal sets are one class from the start.

Edge cases: a null text or one without words has an empty set and is linked with nothing; fewer than five words are one
shingle; very long texts are sets like others (hashed in windows of 64 KB; a task holds one batch of texts); equal rows, and rows
of one doc_id, count as linked; a row without doc_id has no component; an empty table gives an empty result; other
columns, whatever their names, are ignored. Similarities under one half are refused: sizes may then differ by more than an octave.

Constants that change speed only, never results: ``HOT_IN_BATCH``, ``HOT_LEAST`` and ``HOT_MOST`` say which shingles
count as frequent (joined on last, salted), ``SALTS`` how far their buckets are split, ``CHUNK`` and ``BLOCK`` how much a
worker handles at once, ``WIDEST`` the largest sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import cut, drop_cut, fresh, parts
from kinloom.llm.components import components
from kinloom.llm.hashing import FACTORS, batch, mix64, numbers, runs, word_hashes
from kinloom.shipping import lean, ship

WIDTH = 5
SMALL = 64
HOT_IN_BATCH, HOT_LEAST, HOT_MOST = 4, 32, 1 << 16
HOT_HELD = 1_500_000  # shingles that are counted together
SALTS = 64
CHUNK = 2 << 20  # bytes of texts whose sets are held at once
BLOCK = 1024
WIDEST = 1 << 17  # bits

def sets_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, one after the other, each sorted, and where they begin."""
    with np.errstate(over="ignore"):
        h, n = word_hashes(data, at)
        start = np.cumsum(n) - n
        s, valid = np.zeros(len(h), "u8"), np.ones(len(h), bool)
        if len(h) >= WIDTH:
            own = s[: len(h) - WIDTH + 1]
            for i in range(WIDTH):
                own += h[i : len(h) - WIDTH + 1 + i] * FACTORS[i]
            own += np.uint64(WIDTH)
        for k in range(1, WIDTH):  # a text's last words begin no shingle, unless it has no other
            valid[(start + n - k)[n >= k]] = False
            short = start[n == k]
            s[short] = sum((h[short + i] * FACTORS[i] for i in range(k)), np.uint64(k))
        valid[start[(n > 0) & (n < WIDTH)]] = True
        s = mix64(s[valid])
    size = np.where(n >= WIDTH, n - WIDTH + 1, n > 0)
    ends = np.cumsum(size)
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[(ends - size)[size > 0]] = True
    return s[new], np.r_[0, np.cumsum(new)][np.r_[0, ends]]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles, or of its whole sequence of fewer words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")
    return sets_of(data, np.array([0, len(data)]))[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, sets, begin) of runs of texts of at most ``CHUNK`` bytes, or of one text."""
    for i, j, data, at in runs(texts, CHUNK):
        yield i, j, *sets_of(data, at)


def sketch_bits(n: int) -> int:
    """Width of the sketch: four times the octave of the set's size, so that few differences fall on one bit."""
    return min(max(1024, 4 << (max(n, 1).bit_length() - 1)), WIDEST)


def sketch(s: np.ndarray) -> bytes:
    w = sketch_bits(len(s))
    at = ((s >> np.uint64(17)) & np.uint64(w - 1)).view("int64")
    return np.packbits(np.bincount(at, minlength=w).astype("u1") & 1).tobytes()


def fold(b: bytes, size: int) -> np.ndarray:
    """The sketch of the same set at a smaller width (bytes): bits are addressed by low bits of the hash, so halves are XORed."""
    x = np.frombuffer(b, "u1")
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_apart(n: int, m: int, num: int, den: int) -> int:
    """Largest symmetric difference of sets of n and m with a Jaccard similarity of num/den or more."""
    return (n + m) * (den - num) // (den + num)


def bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """The bands of a set size as (band, most differences from a partner in it). Band 0 holds sets under SMALL."""
    own = n.bit_length() - 1 if n >= SMALL else 0
    out = [(own, most_apart(n, n * den // num, num, den))]
    floor = 1 << own if own else 0
    if own and n * num < floor * den:  # a partner may be an octave lower
        low = own - 1 if floor > SMALL else 0
        out.append((low, most_apart(n, floor - 1, num, den)))
    return out


def frequent(s: np.ndarray, hot: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether each hash is in the sorted array ``hot``; ``cells`` marks the 20-bit prefixes of its hashes."""
    out = cells[(s >> np.uint64(44)).view("int64")]
    maybe = np.flatnonzero(out)
    if len(maybe):
        x = s[maybe]
        out[maybe] = hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x
    return out


def signatures(s: np.ndarray, begin: np.ndarray, hot: np.ndarray, cells: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, int, bool]]:
    """What each set is joined on, as (its number, signatures in order, how many of them - the last - are of frequent shingles only,
    whether all are too few). A set has one such list for each of its bands."""
    often, mixed = frequent(s, hot, cells), mix64(s)
    by: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(np.diff(begin).tolist()):
        for band, d in bands(n, num, den) if n else ():
            by.setdefault(band, []).append((i, d))
    for band, sets in by.items():
        lengths = np.array([begin[i + 1] - begin[i] for i, _ in sets])
        ends = np.cumsum(lengths)
        rows = np.repeat(np.array([begin[i] for i, _ in sets]) - (ends - lengths), lengths) + np.arange(ends[-1])
        if band:
            part = s[rows] >> np.uint64(63 - band)  # 2 << band parts; the sorted hashes of a part are neighbours
            new = np.ones(len(rows), bool)
            new[1:] = part[1:] != part[:-1]
            new[(ends - lengths)] = True
            first = np.flatnonzero(new)
            sig = np.bitwise_xor.reduceat(mixed[rows], first) ^ part[first]
            late = np.logical_and.reduceat(often[rows], first)
            at = np.searchsorted(first, np.r_[ends - lengths, ends[-1]])
        else:
            sig, late, at = s[rows], often[rows], np.r_[0, ends]
        sig = mix64(sig + np.uint64(band * int(FACTORS[1]) & (1 << 64) - 1))
        any_late = np.logical_or.reduceat(late, at[:-1])
        for (i, d), a, b, some in zip(sets, at[:-1].tolist(), at[1:].tolist(), any_late.tolist(), strict=True):
            x, k = sig[a:b], d + 1
            if not some:
                yield i, np.sort(np.partition(x, k - 1)[:k] if b - a > k else x), 0, b - a < k
                continue
            soon, rest = x[~late[a:b]], x[late[a:b]]
            if len(soon) >= k:
                yield i, np.sort(np.partition(soon, k - 1)[:k]), 0, False
            else:
                rest = np.partition(rest, k - len(soon) - 1)[: k - len(soon)] if b - a > k else rest
                yield i, np.concatenate([np.sort(soon), np.sort(rest)]), len(rest), b - a < k


PROFILE = "id long, n long, h1 long, h2 long, bits binary, few_bits binary"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its size, two hashes of its set and its sketch; and shingles that several texts held at once have."""
    held, size = [], 0

    def repeated() -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        cell = (x >> np.uint64(43)).view("int64")
        h, c = np.unique(x[np.bincount(cell, minlength=1 << 21)[cell] >= HOT_IN_BATCH], return_counts=True)
        h, c = h[c >= HOT_IN_BATCH], c[c >= HOT_IN_BATCH]
        if len(h):
            none = pa.nulls(len(h), pa.binary())
            yield batch(id=pa.nulls(len(h), pa.int64()), n=-c, h1=h.view("i8"), h2=np.zeros(len(h), "i8"), bits=none, few_bits=none)

    for b in batches:
        for i, j, s, begin in chunks(b.column(1)):
            n, a = np.diff(begin), begin[:-1]
            h1, h2, full = np.zeros(len(n), "u8"), np.zeros(len(n), "u8"), n > 0
            if len(s):
                h1[full], h2[full] = np.add.reduceat(s, a[full]), np.add.reduceat(mix64(s ^ FACTORS[2]), a[full])
            bits = [sketch(s[x:y]) if y > x else b"" for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            few = pa.array([fold(x, len(x) // 2).tobytes() for x in bits], pa.binary())
            yield batch(id=b.column(0).slice(i, j - i), n=n, h1=h1.view("i8"), h2=h2.view("i8"), bits=pa.array(bits, pa.binary()), few_bits=few)
            _, own = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True)  # equal sets count once
            own = own[n[own] > 0]
            held.append(s if len(own) == len(n) else np.concatenate([np.empty(0, "u8"), *(s[begin[x] : begin[x + 1]] for x in own.tolist())]))
            size += len(held[-1])
            if size >= HOT_HELD:
                yield from repeated()
                held, size = [], 0
    if size:
        yield from repeated()


JOINED = "sig long, id long"
LATE = 1 << 24


def _joined_on(hot, num: int, den: int):
    """(sig, id) rows; sig 0: to be compared with the whole band. Bit ``LATE`` tells a signature of frequent shingles, the bits
    below are 0: bytes that shuffles needn't carry. Signatures that are equal in the other 39 bits by chance only make more pairs to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value
        cells = np.zeros(1 << 20, bool)
        cells[(often >> np.uint64(44)).view("int64")] = True
        for b in batches:
            ids = numbers(b.column(0)).astype("int64")
            for i, _, s, begin in chunks(b.column(1)):
                sigs, row, size = [np.empty(0, "u8")], [], []
                for k, x, late, few in signatures(s, begin, often, cells, num, den):
                    x &= ~np.uint64(2 * LATE - 1)
                    x[len(x) - late :] |= np.uint64(LATE)
                    sigs.append(np.r_[np.uint64(0), x] if few else x)
                    row.append(i + k)
                    size.append(len(sigs[-1]))
                yield batch(sig=np.concatenate(sigs).view("i8"), id=ids[np.repeat(np.array(row, "int64"), size)])

    return run


def _salt(sig, id_):
    """0, or 1 to ``SALTS`` for signatures of frequent shingles."""
    return F.when(sig.bitwiseAND(F.lit(LATE).cast("long")) != 0, F.pmod(F.xxhash64(id_), F.lit(SALTS)) + 1).otherwise(0).cast("int")


MEMBERS = "sig long, salt int, hub long, id long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, salt, id), each id once, with the first id of their bucket as ``hub``.

    Buckets of one id are left out, unless they are salted or of sig 0.
    """
    last, hub, id_, told = None, 0, None, False  # of the row before: its bucket, hub, id, and whether the hub's own row was returned
    for b in batches:
        if not b.num_rows:
            continue
        sig, salt, ids = (numbers(b.column(c)) for c in ("sig", "salt", "id"))
        goes_on = last == (sig[0], salt[0])
        new, same = np.ones(len(sig), bool), np.zeros(len(sig), bool)
        new[0], same[0] = not goes_on, goes_on and ids[0] == id_
        new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        same[1:] = ~new[1:] & (ids[1:] == ids[:-1])
        group = np.cumsum(new) - new[0]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        hubs = ids[first]
        if goes_on:
            hubs[0] = hub
        other = ~same & (hubs[group] != ids)
        alone = (salt[first] > 0) | (sig[first] == 0)
        tell = alone | np.logical_or.reduceat(other, first)
        if goes_on and (alone[0] or told):
            tell[0] = False
        keep = other | (new & tell[group])
        late = np.flatnonzero(tell[:1] & goes_on)  # the hub came in an earlier batch
        rows = np.r_[late, np.flatnonzero(keep)]
        if len(rows):
            yield batch(sig=sig[rows], salt=salt[rows], hub=hubs[group[rows]], id=np.r_[hubs[late], ids[keep]])
        told = bool(tell[-1]) or (goes_on and group[-1] == 0 and (told or bool(alone[0])))
        last, hub, id_ = (sig[-1], salt[-1]), hubs[-1], ids[-1]


def _near_pairs(num: int, den: int):
    """Of pairs with sizes and sketches those whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, m = (numbers(b.column(x)) for x in ("a", "b", "n_a", "n_b"))
            bits = np.empty(2 * len(a), object)
            bits[:] = b.column("bits_a").to_pylist() + b.column("bits_b").to_pylist()
            rows = np.arange(len(a))
            keep = _far(bits, rows, rows + len(a)) <= (n + m) * (den - num) // (den + num) if len(a) else rows
            yield batch(a=a[keep], b=c[keep])

    return run


def _linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return den * both >= num * (len(s) + len(t) - both)


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([s[v:w] for *_, s, at in chunks(b.column(c)) for v, w in zip(at[:-1], at[1:], strict=True)] for c in ("text_a", "text_b"))
            keep = [_linked(s, t, num, den) for s, t in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _far(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the sketches of rows a and b, each pair at the smaller width of the two."""
    width = np.array([len(x) for x in bits])
    at, out = np.minimum(width[a], width[b]), np.empty(len(a), "int64")
    for w in np.unique(at):
        mine = np.flatnonzero(at == w)
        rows, place = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        table = np.stack([fold(x, w) for x in bits[rows]]).view("u8")  # widths are multiples of 16 bytes
        x, y = np.split(place, 2)
        step = max(1, (8 << 20) // int(w))
        for i in range(0, len(mine), step):
            out[mine[i : i + step]] = np.bitwise_count(table[x[i : i + step]] ^ table[y[i : i + step]]).sum(axis=1)
    return out


FEW = 32  # groups up to this size are compared many at once
NONE = np.empty(0, "int64")


class Block:
    """Rows of whole groups, a group being a pair of blocks (sig, i, j) of a bucket; sorted by group and size."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, side: np.ndarray, bits: np.ndarray, num: int, den: int):
        # side: of a group of two different blocks 0 or 1, else -1
        self.key, self.id, self.component, self.n, self.side, self.bits = key, ids, component, n, side, bits
        self.num, self.den = num, den
        self.first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else NONE
        self.size = np.diff(np.r_[self.first, len(key)])

    def _wanted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, c, s = self.n, self.component, self.side
        return (c[a] != c[b]) & (self.den * n[a] >= self.num * n[b]) & ((s[a] < 0) | (s[a] != s[b]))

    def _most(self, a, b):
        return (self.n[a] + self.n[b]) * (self.den - self.num) // (self.den + self.num)

    def _small(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Near pairs of the small groups."""
        rows = np.flatnonzero(np.repeat(self.size <= FEW, self.size))
        end = np.repeat(self.first + self.size, self.size)
        a, b = [], []
        for k in range(1, FEW):
            rows = rows[rows + k < end[rows]]
            if not len(rows):
                break
            ok = self._wanted(rows, rows + k)
            a.append(rows[ok])
            b.append(rows[ok] + k)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                far = _far(self.bits, a, b)
                near = far <= self._most(a, b)
                yield a[near], b[near], far[near]

    def _large(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Near pairs of one group, row by row: sizes rise, so partners of a width are neighbours."""
        n, width = self.n[lo:hi], np.array([len(x) for x in self.bits[lo:hi]])
        reach = np.searchsorted(n, n * self.den // self.num, "right")
        for w in np.unique(width).tolist():
            x, y = np.searchsorted(width, w), np.searchsorted(width, w, "right")
            top = min(int(reach[y - 1]), int(np.searchsorted(width, 2 * w, "right")))
            table = np.stack([fold(v, w) for v in self.bits[lo + x : lo + top]])
            least = min(w, 64)
            small = np.bitwise_xor.reduce(table.reshape(top - x, w // least, least), axis=1).view("u8")
            table = table.view("u8")
            for r in range(x, y):
                to = min(int(reach[r]), top)
                b = np.arange(lo + r + 1, lo + to)
                if not len(b):
                    continue
                b = b[self._wanted(np.full(len(b), lo + r), b)]
                for step in (small, table):
                    if len(b):
                        far = np.bitwise_count(step[b - lo - x] ^ step[r - x]).sum(axis=1)
                        near = far <= self._most(np.full(len(b), lo + r), b)
                        b, far = b[near], far[near]
                if len(b):
                    yield np.full(len(b), lo + r), b, far

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows of a group, across components, whose sizes and sketches are near enough, and how far they are."""
        found = list(self._small())
        for lo, m in zip(self.first.tolist(), self.size.tolist(), strict=True):
            if m > FEW:
                found += self._large(lo, lo + m)
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (NONE, NONE, NONE)

    def flagged(self, rows: np.ndarray) -> dict:
        rows = np.unique(rows)
        return {**{c: self.key[rows, k] for k, c in enumerate(("sig", "i", "j"))}, "side": self.side[rows], "a": self.id[rows], "b": self.id[rows]}

    def forest(self) -> dict:
        """As (sig, i, j, side, a, b): the nearest near pair of each component of a group, and (a = b) rows with other near pairs."""
        a, b, far = self.near()
        if not len(a):
            return self.flagged(NONE)
        lo, hi = np.minimum(self.id[a], self.id[b]), np.maximum(self.id[a], self.id[b])
        rank = np.empty(len(a), "int64")
        rank[np.lexsort((hi, lo, far / (self.n[a] + self.n[b])))] = np.arange(len(a))
        both, place = np.concatenate([self.component[a], self.component[b]]), np.concatenate([rank, rank])
        order = np.lexsort((place, both))
        keep = np.isin(rank, place[order][np.r_[True, both[order][1:] != both[order][:-1]]])
        # a pair that is chosen is verified wherever else it meets
        pair = np.stack([lo, hi], 1)
        _, number = np.unique(pair, axis=0, return_inverse=True)
        keep = np.isin(number, number[keep])
        more = self.flagged(np.concatenate([a[~keep], b[~keep]]))
        once = np.flatnonzero(keep)[np.unique(number[keep], return_index=True)[1]]
        here = {**{c: self.key[a[once], k] for k, c in enumerate(("sig", "i", "j"))}, "side": self.side[a[once]], "a": lo[once], "b": hi[once]}
        return {c: np.concatenate([here[c], more[c]]) for c in here}

    def links(self, text) -> dict:
        """As (a, b): verified links that join the components of each group. ``text(row)``: a row's text."""
        a, b, far = self.near()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        held: dict[int, np.ndarray] = {}

        def own(row: int) -> np.ndarray:
            if (i := int(self.id[row])) not in held:
                if len(held) >= 2 * BLOCK:
                    held.pop(next(iter(held)))
                held[i] = shingles(text(row))
            return held[i]

        out, failed = [], set()
        for k in np.lexsort((far / (self.n[a] + self.n[b]), self.key[a, 0])).tolist() if len(a) else ():
            r, s = int(a[k]), int(b[k])
            x, y = find(int(self.component[r])), find(int(self.component[s]))
            pair = tuple(sorted((int(self.id[r]), int(self.id[s]))))
            if x == y or pair in failed:
                continue
            if _linked(own(r), own(s), self.num, self.den):
                root[max(x, y)] = min(x, y)
                out.append(pair)
            elif len(failed) < 1 << 18:
                failed.add(pair)
        pairs = np.array(out, "int64").reshape(-1, 2)
        return {"a": pairs[:, 0], "b": pairs[:, 1]}


ACROSS = "sig long, i int, j int, side int, a long, b long"


def _across(step: str, num: int, den: int):
    """Applies a step of ``Block`` (forest, links) to whole groups of rows sorted by (sig, i, j, n, id)."""
    exact = step == "links"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def columns(b: pa.RecordBatch) -> tuple:
            key = np.stack([numbers(b.column(c)).astype("int64") for c in ("sig", "i", "j")], 1)
            bits = np.empty(b.num_rows, object)
            bits[:] = b.column("bits").to_pylist()
            text = np.empty(b.num_rows, object)
            if exact:
                text[:] = b.column("text").to_pylist()
            return key, *(numbers(b.column(c)) for c in ("id", "component", "n", "side")), bits, text

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            *x, text = (np.concatenate(c) for c in zip(*rows, strict=True))
            block = Block(*x, num, den)
            out = block.links(text.__getitem__) if exact else getattr(block, step)()
            if len(out["a"]):
                kinds = {"i": "i4", "j": "i4", "side": "i4"}
                yield batch(**{c: v.astype(kinds.get(c, "i8")) for c, v in out.items()})

        for b in batches:
            if not b.num_rows:
                continue
            now = columns(b)
            key = now[0]
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held and (held[-1][0][-1] != key[0]).any():
                change = np.r_[0, change]
            if len(change):  # the last group may go on; those before it are whole
                at = int(change[-1]) if size else int(change[-1])
                if held or at:
                    yield from done([*held, tuple(c[:at] for c in now)])
                held, size = [tuple(c[at:] for c in now)], len(key) - at
            else:
                held.append(now)
                size += len(key)
        if held:
            yield from done(held)

    return run


MOST_BROADCAST = 1_000_000


def _ids(df: DataFrame, name: str) -> DataFrame:
    """Distinct ids of ``df`` as column ``name``, marked for broadcast if they are at most a million (8 MB)."""
    ids = cut(df.toDF(name).distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def _check(pairs: DataFrame, profile: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of distinct pairs (a < b)."""

    def nearer(pairs: DataFrame, sketch: str) -> DataFrame:
        side = lambda c: profile.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col(sketch).alias(f"bits_{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        sized = sized.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        return cut(sized.mapInArrow(lean(_near_pairs(num, den)), "a long, b long"), "near")

    nearly = nearer(pairs, "few_bits")  # most pairs go by half of the sketch
    near = nearer(nearly, "bits")
    drop_cut(nearly)
    used = _ids(near.select("a").union(near.select("b")), "doc_id")
    some = texts.join(used, "doc_id", "left_semi")
    text = lambda c: some.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    full = near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    links = cut(full.mapInArrow(lean(_verified(num, den)), "a long, b long").distinct(), "links")
    drop_cut(near)
    return links


def _named(members: DataFrame, known: DataFrame) -> DataFrame:
    """``members`` with the component of each id."""
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    return members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open_blocks(members: DataFrame) -> DataFrame:
    """``sig, i, j, side, id, component`` of buckets with several components, each row once for every pair of blocks of its bucket.

    A bucket of two ids is done with, as they have met.
    """
    buckets = members.groupBy("sig").agg(
        F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("salt").alias("salted")
    )
    buckets = buckets.where((F.col("c") > 2) & (F.col("lo") != F.col("hi")))
    salts = F.when(F.col("salted") > 0, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    buckets = buckets.select("sig", F.explode(salts).alias("salt"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rest = members.join(buckets, ["sig", "salt"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spots = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    rest = rest.select("sig", "id", "component", "block", F.inline(spots))
    side = F.when(F.col("i") == F.col("j"), -1).when(F.col("block") == F.col("i"), 0).otherwise(1)
    return rest.select("sig", "i", "j", side.cast("int").alias("side"), "id", "component")


def link(docs: DataFrame, num: int = 75, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (id, n, rep) of all documents, links (a, b) between representatives that connect what is similar, and
    the representatives' components (id, component) by these links.

    Two sets are linked when ``den * intersection >= num * union``. Not every link within a component is listed, but
    each linked pair is connected.
    """
    if 2 * num < den:
        raise ValueError("similarities under one half are not supported")
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(given.mapInArrow(lean(_profiles), PROFILE), "profiles")
    hot = found.where(F.col("n") < 0).groupBy("h1").agg((-F.sum("n")).alias("c")).where(F.col("c") >= HOT_LEAST)
    hot = np.sort(np.array([r.h1 for r in hot.orderBy(F.col("c").desc(), "h1").limit(HOT_MOST).collect()], "i8").view("u8"))
    hot = spark.sparkContext.broadcast(hot)
    full = found.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = cut(full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    chosen = classes.select(F.col("rep").alias("id")).distinct()
    one = cut(full.join(chosen, "id", "left_semi").select("id", "n", "bits", "few_bits").dropDuplicates(["id"]), "reps")
    profile = cut(found.where(F.col("n") >= 0).drop("bits", "few_bits"), "sizes")
    drop_cut(found)
    others = _ids(profile.where(F.col("id").isNotNull()).select("id").distinct().join(one, "id", "left_anti").select("id"), "doc_id")
    texts = given.where(F.col("doc_id").isNotNull())
    rows = texts.join(others, "doc_id", "left_anti").mapInArrow(lean(_joined_on(hot, num, den)), JOINED)
    salt = _salt(F.col("sig"), F.col("id"))
    rows = rows.repartition(parts(spark), "sig", salt).sortWithinPartitions("sig", salt, "id").withColumn("salt", salt)
    stars = cut(rows.mapInArrow(lean(_stars), MEMBERS), "stars")
    members = stars.where(F.col("sig") != 0).select("sig", "salt", "id")
    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = pair(stars.where((F.col("sig") != 0) & (F.col("hub") != F.col("id"))), "hub", "id")
    hubs = stars.where((F.col("salt") > 0) & (F.col("hub") == F.col("id"))).select("sig", "hub")  # at most SALTS of a bucket
    tops = hubs.groupBy("sig").agg(F.min("hub").alias("top"))
    pairs = pairs.union(pair(hubs.join(tops, "sig").where(F.col("hub") != F.col("top")), "top", "hub"))
    loose = cut(stars.where(F.col("sig") == 0).select("id").distinct(), "loose")
    if not loose.isEmpty():
        octave = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
        wide = one.join(loose, "id").select(F.col("id").alias("x"), F.explode(F.array(octave - 1, octave, octave + 1)).alias("o"))
        wide = wide.join(one.select(F.col("id").alias("y"), octave.alias("o")), "o").where(F.col("x") != F.col("y"))
        pairs = pairs.union(pair(wide, "x", "y"))
    links = _check(pairs.distinct(), one, texts, num, den)
    known = components(links)

    def compared(step: str, rows: DataFrame, profile: DataFrame) -> DataFrame:
        rows = rows.join(profile, "id").repartition(parts(spark), "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "id")
        return cut(rows.mapInArrow(lean(_across(step, num, den)), "a long, b long" if step == "links" else ACROSS), step)

    whole = one.select("id", "n", "bits")
    found = compared("forest", _open_blocks(_named(members, known)), whole)
    near = found.where(F.col("a") == F.col("b")).select("sig", "i", "j", "side", F.col("a").alias("id"))
    more = _check(found.where(F.col("a") != F.col("b")).select("a", "b").distinct(), one, texts, num, den)
    if not more.isEmpty():
        links = links.union(more)
        known = components(links)
    if not near.isEmpty():
        rest = _named(near, known)
        blocks = rest.groupBy("sig", "i", "j").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        rest = cut(rest.join(blocks.where(F.col("lo") != F.col("hi")).drop("lo", "hi"), ["sig", "i", "j"]), "rest")
        used = _ids(rest.select("id"), "doc_id")
        some = texts.join(used, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text"))
        more = compared("links", rest, whole.join(some, "id"))
        if not more.isEmpty():
            links = links.union(more.distinct())
            known = components(links)
    return profile.join(classes, ["n", "h1", "h2"], "left").select("id", "n", "rep"), links, known


def groups(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    profile, _, known = link(docs, num, den)
    whole = profile.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return whole.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, and all rows without id.

    Of several rows of one id the first by text (null first) stays, ties by a hash of the columns; only such rows are shuffled.
    """
    mine, rank = fresh(docs, "chosen"), fresh(docs, "rank")
    chosen = groups(docs.select("doc_id", "text"), num, den).where(F.col("doc_id") == F.col("component_id"))
    chosen = chosen.groupBy(F.col("doc_id").alias(mine)).agg(F.count("*").alias(rank))
    chosen = cut(chosen, "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen
    kept = docs.join(chosen, F.col("doc_id").cast("long") == F.col(mine))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*plain))
    single = kept.where(F.col(rank) == 1).select(*docs.columns)
    several = kept.where(F.col(rank) > 1).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
    return single.unionByName(several).unionByName(docs.where(F.col("doc_id").isNull()))
