"""MinHash banding over whole attribute values, and nearest-cluster candidates."""

from __future__ import annotations

import time
from functools import cache

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, Normalizer, StopWordsRemover, Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.evaluate import counted, recall_among, recall_of
from kinloom.sources.readers import attributes


@cache
def banding(threshold: float, permutations: int, false_positive: float = 0.4, false_negative: float = 0.6) -> tuple[int, int]:
    """Bands and rows that minimise the weighted areas of false positives and negatives under 1 - (1 - s^r)^b."""
    steps = 400

    def area(low: float, high: float, f) -> float:
        width = (high - low) / steps
        return sum(f(low + (i + 0.5) * width) for i in range(steps)) * width

    best = None
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            hit = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            cost = false_positive * area(0, threshold, hit) + false_negative * area(threshold, 1, lambda s, hit=hit: 1 - hit(s))
            if best is None or cost < best[0]:
                best = cost, b, r
    return best[1], best[2]


#: Hashes are numbers modulo this prime; 2^31 - 1, so that products fit 64 bits in any engine.
PRIME = 2147483647


def multipliers(permutations: int) -> list[tuple[int, int]]:
    """The (a, b) of x -> a x + b modulo ``PRIME`` for each permutation."""
    return [((i + 1) * 2654435761 % PRIME, (i + 1) * 40503 * 65537 % PRIME) for i in range(permutations)]


def minhash(values: Column, permutations: int) -> Column:
    """Smallest hash of the values for each permutation. A value is hashed once (digits of MD5, which any engine can make)."""
    hashed = F.transform(values, lambda v: F.conv(F.substring(F.md5(v), 1, 15), 16, 10).cast("long") % PRIME)
    turns = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in multipliers(permutations)])
    least = lambda hs: F.transform(turns, lambda t: F.array_min(F.transform(hs, lambda h: (t.a * h + t.b) % PRIME)))
    return F.get(F.transform(F.array(hashed), least), F.lit(0))  # hashed before the turns are taken


def bands(records: DataFrame, threshold: float = 0.3, permutations: int = 60) -> DataFrame:
    """``rec_id, seq, band, sig`` of each record's set of attribute values."""
    b, r = banding(threshold, permutations)
    own = F.array_distinct(F.array(*attributes(records)))
    h = minhash(own, b * r)
    sigs = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: F.array_join(F.slice("h", j * r + 1, F.lit(r)), "."))
    return records.select("rec_id", "seq", h.alias("h")).select("rec_id", "seq", F.posexplode(sigs).alias("band", "sig"))


def meeting(places: DataFrame, on: list[str]) -> DataFrame:
    """``q_id, c_id``: distinct earlier records that share a place (a band's signature or a cluster)."""
    q = places.where(F.col("seq") > 0).select(*on, F.col("rec_id").alias("q_id"), F.col("seq").alias("q_seq"))
    c = places.select(*on, F.col("rec_id").alias("c_id"), F.col("seq").alias("c_seq"))
    met = q.join(c, on).where((F.col("c_seq") < F.col("q_seq")) & (F.col("q_id") != F.col("c_id")))
    return met.select("q_id", "c_id").distinct()


def together(places: DataFrame, on: list[str]) -> DataFrame:
    """``q_id, c_id``: distinct representatives (``match.classes``) that share a place, in both orders and each with itself."""
    q = places.select(*on, F.col("rec_id").alias("q_id"))
    return q.join(places.select(*on, F.col("rec_id").alias("c_id")), on).select("q_id", "c_id").distinct()


def vectorizer(hashing: bool = False, idf: bool = True, features: int = 10_000) -> Pipeline:
    """Joined attribute text to unit vectors."""
    stages = [Tokenizer(inputCol="text", outputCol="all"), StopWordsRemover(inputCol="all", outputCol="words")]
    if hashing:
        stages.append(HashingTF(inputCol="words", outputCol="tf", numFeatures=features))
    else:
        stages.append(CountVectorizer(inputCol="words", outputCol="tf", vocabSize=features))
    if idf or not hashing:
        stages.append(IDF(inputCol="tf", outputCol="weights"))
    return Pipeline(stages=[*stages, Normalizer(inputCol=stages[-1].getOutputCol(), outputCol="features")])


def _texts(records: DataFrame) -> DataFrame:
    return records.withColumn("text", F.array_join(F.array(*attributes(records)), " "))


MOST_CLUSTERS = 10_000
CENTRES_BYTES = 64 << 20  # centres that are broadcast


def fit_clusters(records: DataFrame, k: int = -1, seed: int = 1, **options) -> PipelineModel:
    """Vectors and k-means in one model; -1 clusters means 0.35 of the records.

    Centres are driver-side and every record meets every centre, so that default is refused beyond ``MOST_CLUSTERS``: name k.
    """
    if k == -1:
        k = max(2, int(0.35 * records.count()))
        if k > MOST_CLUSTERS:
            raise ValueError(f"0.35 of the records are {k} clusters; name a number of clusters")
    texts = _texts(records)
    vectors = vectorizer(**options).fit(texts)
    # equal texts are one point with their number as weight: the same sums, over fewer rows
    points = vectors.transform(texts.groupBy("text").agg(F.count("*").cast("double").alias("weight")))
    means = KMeans(k=k, maxIter=100, seed=seed, predictionCol="cluster", weightCol="weight").fit(points)
    return PipelineModel(stages=[*vectors.stages, means])


def nearest(points: DataFrame, centres: list[list[float]], vector: str = "x") -> DataFrame:
    """``points`` with ``cluster`` and ``dist``: the nearest of the given centres, ties to the first."""
    known = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, v: s + v)
    best = F.array_min(F.transform(known, lambda c, i: F.struct(square(c).alias("d"), i.alias("cluster"))))
    return points.withColumn("_best", best).select(*points.columns, F.col("_best.cluster").alias("cluster"), F.sqrt("_best.d").alias("dist"))


def clusters(model: PipelineModel, records: DataFrame) -> DataFrame:
    """``rec_id, seq, cluster, dist``: the nearest cluster and the distance to its centre."""
    centres = records.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())], "cluster int, centre array<double>"
    )
    # a vector stays as its entries: at its full width it is tens of kilobytes
    got = model.transform(_texts(records)).select("rec_id", "seq", "cluster", F.unwrap_udt("features").alias("x"))
    centres = centres.withColumn("norm", F.aggregate("centre", F.lit(0.0), lambda s, v: s + v * v))
    small = 8 * sum(len(c) for c in model.stages[-1].clusterCenters()) <= CENTRES_BYTES
    both = got.join(F.broadcast(centres), "cluster") if small else got.hint("merge").join(centres, "cluster")
    at = F.coalesce("x.indices", F.transform("x.values", lambda v, i: i))
    own = F.zip_with(at, "x.values", lambda i, v: (v - F.get("centre", i)) * (v - F.get("centre", i)) - F.get("centre", i) * F.get("centre", i))
    square = F.aggregate(own, F.col("norm"), lambda s, v: s + v)
    return both.select("rec_id", "seq", "cluster", F.sqrt(F.greatest(square, F.lit(0.0))).alias("dist"))


def cluster_candidates(placed: DataFrame) -> DataFrame:
    """Indexed records in the query's cluster; a query joins no cluster itself."""
    q = placed.where(F.col("seq") > 0).select("cluster", F.col("rec_id").alias("q_id"))
    c = placed.where(F.col("seq") == 0).select("cluster", F.col("rec_id").alias("c_id"))
    return q.join(c, "cluster").where(F.col("q_id") != F.col("c_id")).select("q_id", "c_id")


def sweep(records: DataFrame, ks: list[int], gold: DataFrame | list[str] | None = None, seed: int = 1) -> DataFrame:
    """``k, fit_s, silhouette, recall``: fit time, silhouette and, with gold pairs (or the attributes in which a gold pair is
    equal), recall of pairs in one cluster."""
    out = []
    known = counted(records) if isinstance(gold, list) else None
    for k in ks:
        began = time.perf_counter()
        model = fit_clusters(records, k, seed)
        took = time.perf_counter() - began
        place = lambda r, model=model: model.transform(_texts(r))
        silhouette = ClusteringEvaluator(metricName="silhouette", predictionCol="cluster").evaluate(place(records))
        recall = None
        if gold is not None:
            got = recall_among(known, gold, place, ["cluster"]) if known else recall_of(place(records), gold, ["cluster"])
            recall = got.first().recall
        out.append((k, took, silhouette, recall))
    return records.sparkSession.createDataFrame(out, "k int, fit_s double, silhouette double, recall double")


def band_sweep(records: DataFrame, gold: DataFrame | list[str], settings: list[tuple[float, int]]) -> DataFrame:
    """``threshold, permutations, bands, rows, recall``: recall of gold pairs (or of pairs equal in the attributes
    ``gold``) for each setting of the banding."""
    out = []
    known = counted(records) if isinstance(gold, list) else None
    for threshold, permutations in settings:
        b, r = banding(threshold, permutations)
        place = lambda x, t=threshold, n=permutations: bands(x, t, n)
        got = recall_among(known, gold, place, ["band", "sig"]) if known else recall_of(place(records), gold, ["band", "sig"])
        out.append((float(threshold), permutations, b, r, got.first().recall))
    return records.sparkSession.createDataFrame(out, "threshold double, permutations int, bands int, rows int, recall double")
