"""Best-fit packing of documents into training sequences by bin completion.

Documents become token ids (byte-level BPE) and an end id; longer ones than a sequence are cut into full pieces, with the
remainder as the first piece. Pieces of one length are interchangeable, so the packing is solved on the histogram of lengths: at
most ``capacity`` numbers reach the driver, whatever the input's size. Best-fit decreasing gives the incumbent; if it
needs more sequences than the lower bound, a branch-and-bound completes bins around the largest length left with undominated
fillings (no item can be added, none replaced by a longer one), repeats a filling as often as counts allow, and prunes by the
waste that a better solution may still have. It begins with descents: each takes, bin after bin, the filling of longest items
among those whose waste is at most a tolerance (0, 1, 2, 4 ... of ``TOLERANCES``), which keeps short items for the end.
If none meets the bound, all undominated fillings are enumerated, least waste first, with all repetitions, most first, until ``node_limit`` nodes are seen; the
best solution so far stays. Each filling and its repetitions become places, and the
k-th piece of a length takes the k-th place of that length; places are dealt out by a distributed rank.

Edge cases: a null or empty text is one piece, the end id alone; ids are those of each row, so repeated rows are packed each; an
empty table gives an empty result. Ties between pieces of one length go by doc_id, piece and checksum.
"""

from __future__ import annotations

import base64
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import Shared
from kinloom.shipping import lean, ship

END_ID = 2
_encoders: dict = {}


def encoder(vocabulary: Shared):
    """The byte-level BPE of a broadcast (ranks file, pattern, special tokens), once per process."""
    if vocabulary.id not in _encoders:
        import tiktoken

        lines, pattern, specials = vocabulary.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _encoders.clear()
        _encoders[vocabulary.id] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
    return _encoders[vocabulary.id]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, ranks_path: str, pattern: str, specials=(("<|endoftext|>", 50256),)) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    ship(docs.sparkSession)
    vocabulary = Shared(docs.sparkSession, (Path(ranks_path).read_bytes(), pattern, tuple(specials)))  # the file need not be where workers run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            rows = []
            for d, t in zip(b.doc_id, b.text, strict=True):
                ids = np.array([*enc.encode(t or "", allowed_special="all"), END_ID], "<u4")
                for i, (s, n) in enumerate(cut_points(len(ids), capacity)):
                    rows.append((d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


#: A filling: how many sequences have it, and its (length, count) pairs, longest first.
Filling = tuple[int, tuple[tuple[int, int], ...]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by sum, and by long items that can't share (Martello and Toth's L2)."""
    best = math.ceil(sum(s * c for s, c in counts.items()) / capacity)
    for k in sorted({s for s in counts if s <= capacity // 2} | {0}):
        n1 = sum(c for s, c in counts.items() if s > capacity - k)
        mid = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        n2 = sum(c for _, c in mid)
        small = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2)
        room = n2 * capacity - sum(s * c for s, c in mid)
        best = max(best, n1 + n2 + max(0, math.ceil((small - room) / capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on a histogram; sequences of equal content are kept as one class."""
    classes: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, n: int) -> None:
        if room not in classes:
            classes[room] = {}
            insort(rooms, room)
        classes[room][items] = classes[room].get(items, 0) + n

    def more(items: tuple, s: int, c: int) -> tuple:
        return (*items[:-1], (s, items[-1][1] + c)) if items and items[-1][0] == s else (*items, (s, c))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left and (at := bisect_left(rooms, s)) < len(rooms):
            room = rooms[at]
            items, n = next(iter(classes[room].items()))
            each = min(room // s, left)
            n = min(n, left // each)
            classes[room][items] -= n
            if not classes[room][items]:
                del classes[room][items]
                if not classes[room]:
                    del classes[room]
                    rooms.pop(at)
            put(room - each * s, more(items, s, each), n)
            left -= n * each
        each = capacity // s
        if left >= each:
            put(capacity - each * s, ((s, each),), left // each)
            left %= each
        if left:
            put(capacity - left * s, ((s, left),), 1)
    return [(n, items) for by in classes.values() for items, n in by.items()]


def fillings(sizes: list[int], counts: dict[int, int], room: int, most_waste: int, after: tuple[int, tuple | None] = (0, None)) -> Iterator[tuple[int, tuple | None]]:
    """All undominated fillings of ``room`` as (waste, items), one by one, least waste first, then longest items first.

    Only those that come later than ``after`` in this order; None stands for a dominated one.
    """
    usable = [s for s in sizes if s <= room and counts[s]]
    have = [counts[s] for s in usable]
    # bit x of reach[i]: some of usable[i:] add up to x, so that no branch below ends without a filling
    reach, whole = [1] * (len(usable) + 1), (1 << room + 1) - 1
    for i in range(len(usable) - 1, -1, -1):
        got, left, step = reach[i + 1], min(have[i], room // usable[i]), 1
        while left:
            n = min(step, left)
            got |= got << n * usable[i] & whole
            left, step = left - n, 2 * step
        reach[i] = got

    def undominated(items: tuple, waste: int) -> bool:
        """No item can be added, none replaced by a longer one."""
        used = dict(items)
        free = [s for s, n in zip(usable, have, strict=True) if n > used.get(s, 0)]
        return not waste or not any(t <= waste for t in free[-1:]) and not any(s < t <= s + waste for s in used for t in free)

    def go(i: int, left: int, items: tuple, last: tuple | None) -> Iterator[tuple]:
        if not left:
            if items != last:
                yield items
            return
        while i < len(usable) and reach[i] >> left & 1:
            s = usable[i]
            i += 1
            for c in range(min(have[i - 1], left // s), 0, -1):
                more = (*items, (s, c))
                if reach[i] >> left - c * s & 1 and (last is None or more <= last[: len(more)]):
                    yield from go(i, left - c * s, more, last)

    for waste in range(after[0], min(room, most_waste) + 1):
        if reach[0] >> room - waste & 1:
            for items in go(0, room - waste, (), after[1] if waste == after[0] else None):
                yield waste, items if undominated(items, waste) else None


#: Waste that a descent accepts for longer items.
TOLERANCES = (0, 1, 2, 4, 6, 8, 12, 16, 24, 32, 64)


def longest_filling(sizes: list[int], left: dict[int, int], room: int, tolerance: int) -> tuple[int, tuple]:
    """Waste and items of the filling of ``room`` that has the longest items, among those that waste ``tolerance`` or less,
    or least if there is none. It is undominated: more or longer items would come first."""
    usable = [s for s in sizes if s <= room and left[s]]
    reach, whole = [1] * (len(usable) + 1), (1 << room + 1) - 1
    for i in range(len(usable) - 1, -1, -1):
        got, more, step = reach[i + 1], min(left[usable[i]], room // usable[i]), 1
        while more:
            n = min(step, more)
            got |= got << n * usable[i] & whole
            more, step = more - n, 2 * step
        reach[i] = got
    best: tuple[int, tuple] | None = None
    for waste in range(room + 1):
        if best and waste > tolerance:
            break
        if not reach[0] >> room - waste & 1:
            continue
        items, rest = [], room - waste
        for i, s in enumerate(usable):
            if not rest:
                break
            c = min(left[s], rest // s)
            while not reach[i + 1] >> rest - c * s & 1:
                c -= 1
            if c:
                items.append((s, c))
                rest -= c * s
        if best is None or tuple(items) > best[1]:
            best = waste, tuple(items)
    return best


def descend(counts: dict[int, int], capacity: int, tolerance: int, spare: int) -> list[Filling] | None:
    """A solution that wastes at most ``spare`` in all, or None: the waste bound prunes the descent."""
    left, sizes, out = dict(counts), sorted(counts, reverse=True), []
    while sizes := [s for s in sizes if left[s]]:
        big = sizes[0]
        left[big] -= 1
        waste, items = longest_filling(sizes, left, capacity - big, tolerance)
        left[big] += 1
        merged: dict[int, int] = {big: 1}
        for s, c in items:
            merged[s] = merged.get(s, 0) + c
        n = min(left[s] // c for s, c in merged.items())
        if waste * n > spare:
            n = spare // waste  # the rest of them must do with other fillings
            if not n:
                return None
        spare -= waste * n
        for s, c in merged.items():
            left[s] -= n * c
        out.append((n, tuple(merged.items())))
    return out


def complete_bins(counts: dict[int, int], capacity: int, incumbent: list[Filling], bound: int, node_limit: int) -> list[Filling]:
    """Bin completion: a solution of fewer sequences than ``incumbent``, or ``incumbent``."""
    best, total = incumbent, sum(s * c for s, c in counts.items())
    used = sum(n for n, _ in best)
    for tolerance in TOLERANCES:
        if used > bound and (got := descend(counts, capacity, tolerance, (used - 1) * capacity - total)):
            best, used = got, sum(n for n, _ in got)
    left = dict(counts)
    nodes = 0
    stack: list[tuple[Filling, Iterator]] = []
    bins, waste = 0, 0

    def options() -> Iterator:
        # when this goes on after a yield, ``left`` is as it was before; sequences of one longest item come in the order of
        # fillings, as any other order was seen or will be
        sizes = [s for s in sorted(left, reverse=True) if left[s]]
        big = sizes[0]
        spare = (used - 1) * capacity - total - waste
        after = (0, None)
        if stack and stack[-1][1][0][0] == big:
            _, last, w = stack[-1]
            after = (w, tuple((s, c - (s == big)) for s, c in last if s != big or c > 1))
        for w, items in fillings(sizes, left | {big: left[big] - 1}, capacity - big, spare, after):
            if items is None:
                yield 0, (), 0
                continue
            merged: dict[int, int] = {big: 1}
            for s, c in items:
                merged[s] = merged.get(s, 0) + c
            n = min(left[s] // c for s, c in merged.items())
            if w:
                n = min(n, spare // w)
            for k in range(n, 0, -1):
                yield k, tuple(merged.items()), w

    if not any(left.values()):
        return []
    frames = [options()]
    while frames and nodes < node_limit and used > bound:
        nodes += 1
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            if stack:
                n, items, w = stack.pop()
                for s, c in items:
                    left[s] += n * c
                bins, waste = bins - n, waste - n * w
            continue
        n, items, w = step
        if not n or waste + n * w > (used - 1) * capacity - total:
            continue
        for s, c in items:
            left[s] -= n * c
        bins, waste = bins + n, waste + n * w
        stack.append(step)
        if not any(left.values()):
            if bins < used:
                used, best = bins, [(k, x) for k, x, _ in stack]
            frames.append(iter(()))
        else:
            frames.append(options())
    return best


def solve(counts: dict[int, int], capacity: int, node_limit: int = 20_000) -> list[Filling]:
    """Fillings that place every piece once."""
    counts = {s: c for s, c in counts.items() if c}
    if not counts:
        return []
    first = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    return first if sum(n for n, _ in first) <= bound else complete_bins(counts, capacity, first, bound, node_limit)


def places(solution: list[Filling]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: ranks at which segments of places begin, their first sequence, places in a sequence, first offset."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for n, items in solution:
        offset = 0
        for s, c in items:
            out.setdefault(s, []).append((taken.get(s, 0), sequence, c, offset))
            taken[s] = taken.get(s, 0) + n * c
            offset += s * c
        sequence += n
    return {s: tuple(np.array(x, "int64") for x in zip(*rows, strict=True)) for s, rows in out.items()}


def pack(cut_docs: DataFrame, capacity: int, node_limit: int = 20_000, rows: int = 2048) -> DataFrame:
    """``cut_docs`` (stored pieces, read three times) with ``sequence_id`` and ``offset``."""
    counts = {r.length: r.n for r in cut_docs.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = cut_docs.sparkSession.sparkContext.broadcast(places(solve(counts, capacity, node_limit)))
    slots = max(1, sum(counts.values()) // rows)
    p = cut_docs.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy("length", "slot").agg(F.count("*").alias("n"))
    starts = starts.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    own = Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = p.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "slot"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("skip")).alias("rank"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = where.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(b), "int64"), np.zeros(len(b), "int64")
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                first, base, each, begin = table[int(s)]
                k = np.searchsorted(first, rank[at], "right") - 1
                n, i = np.divmod(rank[at] - first[k], each[k])
                sequence[at] = base[k] + n
                offset[at] = begin[k] + i * s
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return ranked.mapInPandas(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
