"""The self-configuring linkage engine: fit, build, insert, query, evaluate.

Every learned artefact is stored; a second ``fit`` on the same folder loads what is there. Candidates come from one of
``INDEXERS``: shared keys of the blocking scheme (dnf), MinHash bands (lsh) or clusters (kmeans). The latter two are
scored by the scheme's blocks, too: a pair that shares no block is no answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.config import Scheme, Settings
from kinloom.operators import lsh
from kinloom.operators.blocking import key_table, without
from kinloom.operators.evaluate import complexity, complexity_metrics, micro_metrics, outcomes
from kinloom.operators.match import block_vectors, candidates, completed, rescored, scored, vectors
from kinloom.plans import choice, fusion, labels, schemes
from kinloom.shipping import ship
from kinloom.sources.readers import attributes, both_ways, first_of_each, import_csv
from kinloom.sources.store import Store


def _by_bands(engine: LinkageEngine, index: DataFrame, queries: DataFrame) -> DataFrame:
    s = engine.settings
    asked = lsh.bands(queries, s.lsh_threshold, s.lsh_permutations)
    return lsh.meeting(engine.store.get("bands").unionByName(asked), ["band", "sig"])


def _by_clusters(engine: LinkageEngine, index: DataFrame, queries: DataFrame) -> DataFrame:
    return lsh.cluster_candidates(engine.store.get("clusters").unionByName(lsh.clusters(engine.clusters, queries)))


#: Name of an indexer: (index, queries) to pairs ``q_id, c_id``. None: shared keys. Users may add their own.
INDEXERS: dict[str, Callable[[LinkageEngine, DataFrame, DataFrame], DataFrame] | None] = {"dnf": None, "lsh": _by_bands, "kmeans": _by_clusters}


class LinkageEngine:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        if settings.indexer not in INDEXERS:
            raise ValueError(f"indexer is one of {sorted(INDEXERS)}")
        ship(spark)
        self.spark, self.store, self.settings = spark, Store(spark, folder), settings
        self.scheme: Scheme | None = None
        self.bans: DataFrame | None = None
        self.measures: list[str] | None = None
        self.model: PipelineModel | None = None
        self.clusters: PipelineModel | None = None
        self.seconds: dict[str, float] = {}

    @contextmanager
    def timed(self, what: str):
        """Adds the block's seconds to ``seconds[what]``."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[what] = self.seconds.get(what, 0.0) + time.perf_counter() - began

    def set_baseline(self, rows: list[tuple[int, int, str]]) -> None:
        """Use a given scheme instead of a learned one."""
        self.store.put_json("scheme", Scheme.from_rows(rows).to_json())

    def keys(self, records: DataFrame) -> DataFrame:
        """The key table of records, without banned keys."""
        return without(key_table(records, self.scheme), self.bans)

    def fit_csv(self, path: str, rec_id: str, names: list[str], gold: DataFrame | None = None) -> LinkageEngine:
        return self.fit(import_csv(self.spark, path, rec_id, names, f"{self.store.folder}/train"), gold)

    def fit(self, records: DataFrame, gold: DataFrame | None = None) -> LinkageEngine:
        with self.timed("fit"):
            return self._fit(records, gold)

    def _labels(self, records: DataFrame, gold: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        s = self.settings
        if self.store.has("labels/_SUCCESS"):
            marked = self.store.get("labels")
        else:
            n = records.count()
            most_pos = s.max_positive if s.max_positive is not None else int(n * s.positive_part)
            most_neg = s.max_negative if s.max_negative is not None else int(n * s.negative_part)
            if gold is not None:
                pos, neg = labels.gold_labels(records, gold, s.window, s.max_negative, s.seed)
            else:
                pos, neg = labels.weak_labels(records, s.lower, s.upper, s.window, most_pos, most_neg)
            marked = self.store.put("labels", pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))))
            # what the labels were made of and under: their similarities by bin, and the budgets
            self.store.put("label_bins", labels.histogram(marked.where("label = 0")))
            self.store.put_json("label_budget", {"max_positive": most_pos, "max_negative": most_neg, "gold": gold is not None})
        return marked.where("label = 1").drop("label"), marked.where("label = 0").drop("label")

    def _fit(self, records: DataFrame, gold: DataFrame | None) -> LinkageEngine:
        s, fields = self.settings, len(attributes(records))
        pos, neg = self._labels(records, gold)

        def scheme() -> str:
            found = schemes.learn_scheme(records, pos, neg, fields, s.encoders, s.max_conjunction, s.max_disjunction, s.max_block, s.min_good)
            if found is None:
                raise ValueError("no blocking scheme scores above 0 on the labels")
            return found.to_json()

        given = self.store.has("scheme.json") and not self.store.has("bans/_SUCCESS")  # a baseline bans nothing
        self.scheme = Scheme.from_json(self.store.json("scheme", scheme))
        found = schemes.bans(records, self.scheme, s.max_block)
        self.bans = self.store.table("bans", lambda: found.limit(0) if given else found)
        if not self.store.has("pairs/_SUCCESS"):
            pool = labels.cosine(labels.neighbours(records, s.window), labels.token_weights(records)).where(F.col("sim") < s.lower)
            all_pos, all_neg = pos, neg
            pos, neg = labels.in_blocks(pos, neg, pool, records, self.scheme, neg.count())
            # where the scheme separates a class completely, its unfiltered pairs (zero vectors) stand for it
            pos, neg = (all_pos if pos.isEmpty() else pos), (all_neg if neg.isEmpty() else neg)
            if neg.isEmpty():  # no pair is as dissimilar as ``lower`` asks: the least similar neighbours that aren't positive
                near = labels.cosine(labels.neighbours(records, s.window), labels.token_weights(records)).where(F.col("sim") < s.upper)
                near = near.join(all_pos.select("t1", "t2"), ["t1", "t2"], "left_anti")
                neg = near.orderBy("sim", "t1", "t2").limit(max(1, int(records.count() * s.negative_part)))
        pairs = self.store.table("pairs", lambda: pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))))
        with self.timed("measures"):
            self.measures = self.store.json("measures", lambda: choice.choose(
                pairs, records, s.by_average_precision, mode=s.vector, keys=self.keys(records), covered=self.scheme.fields()
            ))
        if s.indexer == "kmeans":
            if not self.store.has("cluster_model"):
                lsh.fit_clusters(records, s.clusters, s.seed).write().overwrite().save(f"{self.store.folder}/cluster_model")
            self.clusters = PipelineModel.load(f"{self.store.folder}/cluster_model")
        if s.use_classifier:
            if not self.store.has("model"):
                split = lambda v: pairs.where(F.col("label") == v).drop("label")
                some = labels.sample(split(1), split(0), s.train_positive, s.train_negative, s.seed)
                with self.timed("classifier"):
                    _, model = fusion.best_model(self._labelled_vectors(some, records), fields, s.families, s.scoring, seed=s.seed, costs=s.grid)
                model.write().overwrite().save(f"{self.store.folder}/model")
            self.model = PipelineModel.load(f"{self.store.folder}/model")
        return self

    def _labelled_vectors(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        """Vectors of labelled pairs; in block mode only slots whose key the scheme shares count."""
        ids = pairs.select(F.col("t1").alias("q_id"), F.col("t2").alias("c_id"), "label")
        if self.settings.vector == "full":
            got = vectors(rescored(ids, records, self.measures), len(self.measures))
        else:
            got = block_vectors(ids, self.keys(records), self.measures)
            got = completed(got, records, self.measures, self.settings.vector, self.scheme.fields())
        zero = F.array(*[F.lit(0.0)] * len(self.measures))
        return ids.join(got, ["q_id", "c_id"], "left").select(F.coalesce("simvec", zero).alias("simvec"), "label")

    def build(self, records: DataFrame) -> DataFrame:
        """Store the index, unless it is there: its records (of an id the first) and what candidates are found by; its key table."""
        with self.timed("build"):
            if not self.store.has("index/_SUCCESS"):
                self._add(first_of_each(records), "overwrite")
        return self.store.get("keys")

    def insert(self, records: DataFrame) -> int:
        """Add records to the index, without a rebuild; those whose id is there already are ignored. How many were added."""
        with self.timed("insert"):
            new = first_of_each(records).join(self.store.get("index").select("rec_id"), "rec_id", "left_anti").select(*records.columns)
            held = self.store.put("arriving", new)
            self._add(held, "append")
            return held.count()

    def _add(self, records: DataFrame, mode: str) -> None:
        s = self.settings
        if s.indexer == "lsh":
            self.store.put("bands", lsh.bands(records, s.lsh_threshold, s.lsh_permutations), mode)
        if s.indexer == "kmeans":
            self.store.put("clusters", lsh.clusters(self.clusters, records), mode)
        self.store.put("keys", self.keys(records), mode)
        self.store.put("index", records, mode)  # last: a record counts as there when all of it is

    def candidates(self, queries: DataFrame) -> DataFrame:
        """``q_id, c_id`` that the indexer finds."""
        index, find = self.store.get("index"), INDEXERS[self.settings.indexer]
        if find is not None:
            return find(self, index, queries).select("q_id", "c_id")
        return candidates(self.store.get("keys").unionByName(self.keys(queries))).select("q_id", "c_id").distinct()

    def query(self, queries: DataFrame) -> DataFrame:
        """``q_id, c_id, simvec, score`` and, with a classifier, ``match`` and ``probability`` of what it accepts.

        Queries (seq >= 1) see the index and each other in order of ``seq``; clusters hold the index only.
        """
        index = self.store.get("index")
        keys = self.store.get("keys").unionByName(self.keys(queries))
        if INDEXERS[self.settings.indexer] is None:
            got = vectors(scored(candidates(keys), self.measures), len(self.measures))
        else:
            got = block_vectors(self.candidates(queries), keys, self.measures)
        got = completed(got, index.unionByName(queries), self.measures, self.settings.vector, self.scheme.fields())
        got = got.withColumn("score", F.aggregate("simvec", F.lit(0.0), lambda a, x: a + x))
        return fusion.classify(self.model, got).where(F.col("match") == 1) if self.model else got

    def evaluate(self, queries: DataFrame, gold: DataFrame) -> dict:
        """Completeness, quality and reduction of the candidates; precision, recall and F1 of the answers; seconds and rates."""
        two = both_ways(gold)
        records = self.store.get("index").select("rec_id", "seq").union(queries.select("rec_id", "seq"))
        cost = complexity_metrics(complexity(records, self.candidates(queries), two)).first()
        with self.timed("query"):
            answers = self.store.put("answers", self.query(queries))
        score = answers.withColumn("score", F.col("probability")) if self.model else answers
        per = lambda n, what: n / self.seconds[what] if self.seconds.get(what) else None
        return {
            **cost.asDict(),
            **micro_metrics(outcomes(score, two)).first().asDict(),
            "seconds": dict(self.seconds),
            "inserts_a_second": per(self.store.get("index").count(), "build"),
            "queries_a_second": per(queries.count(), "query"),
        }
