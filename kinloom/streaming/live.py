"""Insert-then-query over a stream: every record is matched with all earlier ones, then kept.

The stream's keys are the state's keys: a block's earlier values are kept with the block, in order. One pair can meet in several
blocks, so results hold a row per block; ``settle`` makes them the batch result. Within a micro-batch records are taken
in order of ``seq``.

A block's state lives in one task and grows with the block, and every record of a block meets all earlier ones: choose a scheme
whose blocks stay small (the bans of oversized blocks apply here, too). State is restored from the stream's checkpoint; ``settle`` of
what was written so far is a snapshot that needs no stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinloom.config import Scheme
from kinloom.operators.blocking import key_table
from kinloom.operators.match import scored, totals, vectors
from kinloom.shipping import ship

OUT = "q_id string, c_id string, term int, field int, qv string, cv string, q_seq long"
COLUMNS = ["q_id", "c_id", "term", "field", "qv", "cv", "q_seq"]
STATE = "ids array<string>, vals array<string>, seqs array<bigint>"


def _meet(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    term, field, _ = key
    ids, vals, seqs = map(list, state.get) if state.exists else ([], [], [])
    new = pd.concat(list(batches)).drop_duplicates(["rec_id", "seq", "value"]).sort_values(["seq", "rec_id"])
    seen = set(zip(ids, vals, strict=True))
    fresh = [(r, v, int(s)) for r, v, s in zip(new.rec_id, new.value, new.seq, strict=True) if (r, v) not in seen and not seen.add((r, v))]
    ids, vals, seqs = (old + [x[k] for x in fresh] for k, old in enumerate((ids, vals, seqs)))
    known, order = pd.DataFrame({"c_id": ids, "cv": vals}), np.array(seqs, "int64")
    for r, s, v in zip(new.rec_id, new.seq, new.value, strict=True):
        if s > 0:
            met = known[(order < s) & (known.c_id != r)]
            if len(met):
                yield met.assign(q_id=r, term=term, field=field, qv=v, q_seq=s)[COLUMNS]
    state.update((ids, vals, seqs))


def meetings(stream: DataFrame, scheme: Scheme) -> DataFrame:
    """Streaming ``candidates`` of records (rec_id, seq, a_0 ...): ``OUT`` rows, appended as records arrive."""
    ship(stream.sparkSession)
    keys = key_table(stream, scheme)
    keys = keys.withColumn("rec_id", keys.rec_id.cast("string"))
    return keys.groupBy("term", "field", "bkv").applyInPandasWithState(_meet, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def settle(met: DataFrame, measures: list[str]) -> DataFrame:
    """``q_id, c_id, simvec`` of collected meetings."""
    return vectors(scored(met.select("q_id", "c_id", "field", "qv", "cv").distinct(), measures), len(measures))


def settle_scores(met: DataFrame, measures: list[str], **options) -> DataFrame:
    return totals(scored(met.select("q_id", "c_id", "field", "qv", "cv").distinct(), measures), len(measures), **options)


def latencies(query) -> list[dict]:
    """Of the query's recent micro-batches: number, rows, seconds, rows a second."""
    out = []
    for p in query.recentProgress:
        seconds = p["durationMs"].get("triggerExecution", 0) / 1000
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "seconds": seconds, "rate": p["numInputRows"] / seconds if seconds else None})
    return out
