"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order (MD5 of seed and doc_id), passed through twice. A document's virtual
finish time is the tokens of its source up to and with it, divided by the source's target. All queues are merged by finish
time, ties by source and shuffled order, and the merged order is truncated at the total budget: the mix takes the longest run
of it whose tokens fit. Tokens are words.

Targets: ``share`` of all tokens is dealt out by weight; a source's target stops at twice its tokens, and what is
left over is dealt out again among the others until none is above (water filling).

The running sums never gather a source in one task: a queue is cut into cells by leading digits of the hash, cells are
summed first, and a document adds its own cell's sum so far to those of the cells before. The truncation works likewise on cells of
finish time, summed in two levels; only the documents of the cell in which the budget ends are ordered, and only those.

Edge cases: null texts have no tokens and are never taken; a null source is a source, ordered last; null ids share a place in
the shuffle; repeated rows follow each other; without any tokens all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import fresh, word_count

PASSES = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """``key, rank, source_size, target`` by source. ``sizes``: key, null_source, size."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", weight.cast("double"))
    per = per.withColumn("cap", (PASSES * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    open_ = F.col("cap") / F.col("w") > F.col("level")
    final = F.min(F.when(open_, F.struct("cap_rank", "level"))).over(every)["level"]
    per = per.withColumn("cap_rank", F.row_number().over(order)).withColumn("final", final)
    return per.select(
        "key", "rank", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target")
    )


def source_key(source: Column) -> Column:
    """Orders sources by code point, null last, and joins null with null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def _cells(n: int, rows: int) -> int:
    """Hexadecimal digits for cells of about ``rows`` rows."""
    return max(0, min(7, math.ceil(math.log(max(n / rows, 1), 16))))


def queue(docs: DataFrame, hold, seed: str = "mix", rows: int = 2000, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """``doc_id, size, source_size, target, passes`` for every document; passes: how often the mix takes it (0 to 2).

    ``hold`` stores a frame (without texts) between passes.
    """
    sizes = hold(
        docs.select(
            "doc_id",
            source_key(F.col("source")).alias("key"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
        )
    )
    n = sizes.count()
    digits = _cells(n, rows)
    goal = targets(sizes.select("key", "size"), weights, share)
    cell = F.substring("h", 1, digits) if digits else F.lit("")
    sizes = sizes.withColumn("cell", cell)
    so_far = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("key", "cell").agg(F.sum("size").alias("s"))
    starts = starts.select("key", "cell", F.coalesce(F.sum("s").over(so_far), F.lit(0)).alias("start"))
    starts = starts.join(goal, "key")
    inside = Window.partitionBy("key", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = hold(
        sizes.withColumn("run", F.sum("size").over(inside))
        .join(starts, ["key", "cell"])
        .select("doc_id", "size", "source_size", "target", "rank", "h", (F.col("start") + F.col("run")).alias("run"))
    )
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    limit = math.floor(share * total)
    finish = lambda k: (F.col("run") + k * F.col("source_size")) / F.col("target")
    both = F.explode(F.array(*[F.struct(finish(k).alias("f"), F.lit(k).alias("k")) for k in range(PASSES)]))
    waiting = queued.where((F.col("target") > 0) & (F.col("size") > 0)).select("doc_id", "size", "rank", "h", "run", both.alias("p"))
    waiting = waiting.select("doc_id", "size", "rank", "h", "run", "p.f", "p.k")
    fine = 1 << max(0, min(30, math.ceil(math.log2(max(PASSES * n / rows, 1)))))
    slot = F.floor(F.col("f") * fine).cast("long")
    sums = hold(waiting.groupBy(slot.alias("slot")).agg(F.sum("size").alias("s")))

    def crossing(sums: DataFrame, before: int):
        """The first slot whose running sum exceeds the limit, and the sum before it."""
        upto = sums.select("slot", (F.lit(before) + F.sum("s").over(Window.orderBy("slot"))).alias("upto"), "s")
        return upto.where(F.col("upto") > limit).agg(F.min("slot").alias("slot"), F.min(F.col("upto") - F.col("s")).alias("before")).first()

    # runs of slots first, then the slots of one run: no window sees more than the square root of the slots
    run = 1 << (fine.bit_length() - 1) // 2
    runs = sums.groupBy(F.floor(F.col("slot") / run).cast("long").alias("slot")).agg(F.sum("s").alias("s"))
    last = crossing(runs, 0)
    if last.slot is not None:
        last = crossing(sums.where((F.col("slot") >= last.slot * run) & (F.col("slot") < (last.slot + 1) * run)), last.before)
    if last.slot is None:  # everything fits
        return queued.select("doc_id", "size", "source_size", "target", F.when((F.col("target") > 0) & (F.col("size") > 0), PASSES).otherwise(0).alias("passes"))
    order = Window.orderBy("f", "rank", "h", "doc_id", "run").rowsBetween(Window.unboundedPreceding, 0)
    edge = waiting.where(slot == last.slot).withColumn("upto", last.before + F.sum("size").over(order))
    cut = edge.where(F.col("upto") > limit).orderBy("upto", "f", "rank", "h", "doc_id", "run").select("f", "rank", "h", "doc_id", "run").first()
    no_id = -(1 << 63)

    def place(f: Column, rank: Column, h: Column, doc_id: Column, run: Column) -> Column:
        return F.struct(f, rank.cast("int"), h, F.coalesce(doc_id.cast("long"), F.lit(no_id).cast("long")), run.cast("long"))

    here = [F.col(c) for c in ("rank", "h", "doc_id", "run")]
    end = place(*[F.lit(cut[c]) for c in ("f", "rank", "h", "doc_id", "run")])
    taken = sum((F.when((F.col("target") > 0) & (F.col("size") > 0) & (place(finish(k), *here) < end), 1).otherwise(0) for k in range(PASSES)), F.lit(0))
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("passes"))


def mix_counts(docs: DataFrame, hold, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    q = queue(docs, hold, **options)
    return q.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, hold, **options) -> DataFrame:
    """The mixed rows of ``docs``: a document that is taken twice comes twice.

    Rows are joined with their counts by ``doc_id``; of rows with one id each comes as often as the first of them.
    """
    mine, passes, turn = (fresh(docs, c) for c in ("id", "passes", "turn"))
    q = queue(docs.select("doc_id", "source", "text"), hold, **options)
    per = q.groupBy("doc_id").agg(F.max("passes").alias("passes")).where(F.col("passes") > 0)
    per = per.select(F.col("doc_id").alias(mine), F.col("passes").alias(passes))
    got = docs.join(per, F.col("doc_id").eqNullSafe(F.col(mine)))
    return got.select(*docs.columns, F.explode(F.sequence(F.lit(1), passes)).alias(turn)).drop(turn)
