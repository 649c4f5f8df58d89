"""What batches and Python workers hold."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.shipping import lean, ship


def test_batches_fit_pooled_buffers(spark):
    ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]})

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))  # 15 MB
    got = texts.mapInArrow(sizes, "n long, rows long").agg(F.max("n").alias("n"), F.sum("rows").alias("rows")).first()
    assert got.n <= 4 << 20 and got.rows == 3000


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="no /proc")
def test_a_worker_returns_what_it_no_longer_holds():
    last = []

    def run(batches):
        for b in batches:
            held = [b"x" * 60_000 for _ in range(4000)]
            last.append(b"x" * 60_000)  # the heap can't shrink from its end
            yield b + len(held)

    before = resident()
    assert list(lean(run)(iter([1, 2]))) == [4001, 4002]
    assert resident() - before < 120_000_000
