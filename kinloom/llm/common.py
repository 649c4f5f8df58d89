"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII blanks (Python and Java regex syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a folder of this process stands in for it, but only on a local master: on a cluster
    other machines would not see it, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        atexit.register(shutil.rmtree, _own.removeprefix("file://"), ignore_errors=True)
    return _own


_own: str | None = None


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/kinloom-{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there.

    Any executor can read the files, so a lost executor costs no recomputation. The shuffle files of the work go when
    it is done, as nothing else reads them; the table goes when the driver ends, or by ``drop_cut`` or ``tidy``.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.select("*").write.parquet(path)  # a frame takes the setting when it is made
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with ``key`` set to ``value``, as it was afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(spark: SparkSession, *needed: DataFrame) -> None:
    """Remove all tables that ``cut`` has left, but for those which ``needed`` reads: for between two steps, when what the
    step before returned has been stored."""
    read = {f.rsplit("/", 1)[0] for df in needed for f in df.inputFiles()}
    names = {p.rsplit("/", 1)[1] for p in read}
    for other, path in list(_made):
        if other is spark and path.rsplit("/", 1)[1] not in names:
            drop_path(spark, path)
            _made.remove((other, path))


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a frame that ``cut`` made and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/kinloom-" in path:
            drop_path(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            return


class Shared:
    """A broadcast value with an id of its own, for what workers build from it once per process."""

    def __init__(self, spark: SparkSession, value):
        self.id, self._held = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._held.value


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where lambdas in ``body`` use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
