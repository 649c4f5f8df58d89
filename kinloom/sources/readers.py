"""Relations of records: CSV and Parquet scans, normalisation, gold pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.text import clean, normalise


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as text, blanks after delimiters skipped, malformed lines dropped, nulls empty."""
    df = spark.read.csv(
        path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, mode="DROPMALFORMED", encoding=encoding
    )
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in columns or df.columns])


def records(df: DataFrame, rec_id: str, attributes: list[str], seq: str | None = None, normalised: bool = True) -> DataFrame:
    """``rec_id, seq, a_0 ... a_n`` in the order of ``attributes``. Without ``seq`` the records are an index (0)."""
    make = normalise if normalised else clean
    own = [make(F.col(c).cast("string")).alias(f"a_{i}") for i, c in enumerate(attributes)]
    place = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    return df.select(F.col(rec_id).alias("rec_id"), place.alias("seq"), *own)


def attributes(records_: DataFrame) -> list[str]:
    return sorted((c for c in records_.columns if c.startswith("a_")), key=lambda c: int(c[2:]))


def long_form(records_: DataFrame) -> DataFrame:
    """``rec_id, seq, field, value`` of non-empty values."""
    own = F.posexplode(F.array(*attributes(records_))).alias("field", "value")
    return records_.select("rec_id", "seq", own).where(F.col("value") != "")


def grouped(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """``df`` with ``part``: the number of the group of ``n`` that a row belongs to, in the order of ``seq`` (1, 2, ...)."""
    return df.withColumn("part", F.floor((F.col(seq) - 1) / n).cast("long"))


def import_csv(spark: SparkSession, path: str, rec_id: str, names: list[str], store: str) -> DataFrame:
    """Normalise a UTF-8 CSV file into a Parquet relation sorted by id within files, unless it is there already; the relation."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{store}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        made = records(read_csv(spark, path, [rec_id, *names], "UTF-8"), rec_id, names)
        made.sortWithinPartitions("rec_id").write.mode("overwrite").parquet(store)
    return spark.read.parquet(store)


def scan(spark: SparkSession, store: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A stored relation; predicate and columns reach the Parquet scan."""
    df = spark.read.parquet(store)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def by_ids(records_: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose ids are in ``ids.rec_id``."""
    return records_.join(ids.select("rec_id").distinct(), "rec_id", "left_semi")


def first_of_each(records_: DataFrame) -> DataFrame:
    """One record for each id: the first by ``seq`` (ties by value); an id that is there already is not inserted again."""
    names = attributes(records_)
    best = records_.groupBy("rec_id").agg(F.min_by(F.struct("seq", *names), F.struct("seq", *names)).alias("r"))
    return best.select("rec_id", "r.*")


def arrival(df: DataFrame, at: str, tie: str, rows: int = 50_000) -> DataFrame:
    """``df`` with ``seq``: 1, 2, ... in the order of the timestamp ``at``, then of ``tie`` (nulls first).

    The span of time is cut into cells of equal length, about ``rows`` rows each; rows are numbered within their cell, after
    the cells before it. One row per cell goes through a single window.
    """
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62)))
    span = df.agg(F.min(F.unix_micros(F.col(at).cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("hi"), F.count("*").alias("n")).first()
    lo, hi = span.lo or 0, span.hi or 0
    width = max(1, (hi - lo) // max(1, span.n // rows) + 1)
    timed = df.withColumn("_at", micros).withColumn("_cell", F.greatest(F.floor((F.col("_at") - lo) / width), F.lit(-1)).cast("long"))
    sizes = timed.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_cell").orderBy("_at", tie)
    got = timed.withColumn("_rank", F.row_number().over(own)).join(sizes, "_cell")
    return got.withColumn("seq", F.col("_before") + F.col("_rank")).drop("_at", "_cell", "_before", "_rank")


def gold(pairs: DataFrame, left: str, right: str, id_type: str) -> DataFrame:
    """Distinct unordered pairs ``id_1 < id_2`` of the records' id type; ids that don't fit the type are an error."""
    x, y = F.col(left).cast(id_type), F.col(right).cast(id_type)
    return pairs.select(F.least(x, y).alias("id_1"), F.greatest(x, y).alias("id_2")).distinct()


def both_ways(gold_: DataFrame) -> DataFrame:
    """Gold pairs as adjacency ``q_id, c_id``."""
    return gold_.select(F.col("id_1").alias("q_id"), F.col("id_2").alias("c_id")).union(gold_.select("id_2", "id_1")).distinct()


def peak_memory(spark: SparkSession, path: str) -> DataFrame:
    """Peak of the samples (lines ``MEM mb time``) of each memory profile, and less its first sample."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    got = lines.where(F.col("value").startswith("MEM ")).withColumn("mb", F.split("value", " ")[1].cast("double"))
    per = got.groupBy("file").agg(F.max("mb").alias("peak_mb"), F.min_by("mb", "at").alias("start_mb"))
    return per.withColumn("used_mb", F.col("peak_mb") - F.col("start_mb"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """JSON reports named run_indexer_dataset, with those parts of their names."""
    df = spark.read.option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    return df.withColumns({k: F.split(name, "_")[i] for i, k in enumerate(("run", "indexer", "dataset"))})


def with_fit(measurements: DataFrame, fits: DataFrame) -> DataFrame:
    """Reports of runs next to the fit report of the same indexer and data set, whose columns get the prefix ``fit_``."""
    on = ["indexer", "dataset"]
    named = fits.select(*on, *[F.col(c).alias(f"fit_{c}") for c in fits.columns if c not in (*on, "run", "file")])
    return measurements.join(named, on, "left")
