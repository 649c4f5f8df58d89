"""Makes this package importable in Python workers, and keeps what they and their batches hold small."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch for Python workers, which hold a batch several times over; a row count alone doesn't bound long texts.
#: Buffers grow to the next power of two: up to 4 MB the executor's allocator pools them, larger ones leave gaps in its heap.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors of this application, once, and bound the batches of Python workers.

    Functions that run in Python workers are pickled by reference, so workers must be able to import them wherever
    the driver found the package.
    """
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        tree = Path(tmp, "tree")
        shutil.copytree(here, tree / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        target = Path(tempfile.mkdtemp(prefix="kinloom-src-"))
        sc.addPyFile(shutil.make_archive(str(target / "kinloom_src"), "zip", tree))


@contextmanager
def undistributed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within it broadcast no table that isn't marked for it: tables are chosen by the size of compressed files and caches,
    and their rows can fill the driver, which builds them."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def release() -> None:
    """Give memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; the worker, which later tasks and operators use again, then keeps no free memory."""

    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return released
