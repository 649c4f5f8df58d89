"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered once more, with that participant as the assistant
and all others as named users. Only what the assistant says is trained on: the loss mask comes as runs of
characters, ``mask_len`` and ``mask_on``, whose lengths add up to the length of ``text``.

Edge cases: a null text is an empty turn; a null role is the speaker ``unknown``; a null turn number comes last; equal turn
numbers are ordered by role and text, and repeated rows stay repeated; a row with a null ``conv_id`` is a dialogue of its own;
a dialogue without participants (system turns only) gives no row; an empty table gives an empty result; further
columns of the input are ignored. A dialogue's output is one row per participant, so a dialogue has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _head(role: Column, participant: Column, system: list[str]) -> Column:
    who = (
        F.when(role.isin(system), role)
        .when(role == participant, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate(conversations: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per dialogue and participant: ``conv_id, participant, n_turns, text, mask_len, mask_on, trained_chars``."""
    system = list(system_roles)
    said = conversations.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            F.col("turn").isNull().alias("late"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = said.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = F.array_sort(
        F.array_distinct(F.transform(F.filter("turns", lambda t: ~t.role.isin(system)), lambda t: t.role))
    )
    each = whole.select("conv_id", "turns", F.explode(speakers).alias("participant"))
    p = F.col("participant")

    def runs(t: Column) -> Column:
        """A turn as two runs: what is read and what is learned (empty for all but the assistant)."""
        head, own = _head(t.role, p, system), t.role == p
        tail = F.concat(t.text, F.lit(END))
        return F.array(
            F.struct(F.when(own, head).otherwise(F.concat(head, tail)).alias("s"), F.lit(False).alias("on")),
            F.struct(F.when(own, tail).otherwise(F.lit("")).alias("s"), F.lit(True).alias("on")),
        )

    cut = each.select(
        "conv_id",
        "participant",
        F.size("turns").cast("long").alias("n_turns"),
        F.filter(F.flatten(F.transform("turns", runs)), lambda r: r.s != "").alias("runs"),
    )
    return cut.select(
        "conv_id",
        "participant",
        "n_turns",
        F.array_join(F.transform("runs", lambda r: r.s), "").alias("text"),
        F.transform("runs", lambda r: F.char_length(r.s).cast("long")).alias("mask_len"),
        F.transform("runs", lambda r: r.on).alias("mask_on"),
        F.aggregate(
            "runs", F.lit(0).cast("long"), lambda a, r: a + F.when(r.on, F.char_length(r.s)).otherwise(0).cast("long")
        ).alias("trained_chars"),
    )
