"""Command line: ``python -m kinloom.runner fit|build|insert|evaluate`` over CSV files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinloom.config import Settings
from kinloom.plans.engine import INDEXERS, LinkageEngine
from kinloom.sources.readers import gold, read_csv, records


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("verb", choices=("fit", "build", "insert", "evaluate"))
    p.add_argument("--folder", required=True, help="artefacts")
    p.add_argument("--csv", required=True)
    p.add_argument("--id", required=True)
    p.add_argument("--attributes", required=True, nargs="+")
    p.add_argument("--gold")
    p.add_argument("--gold-columns", nargs=2, default=("id_1", "id_2"))
    p.add_argument("--vector", choices=("block", "parfull", "full"), default="block")
    p.add_argument("--no-classifier", action="store_true")
    p.add_argument("--indexer", choices=sorted(INDEXERS), default="dnf")
    p.add_argument("--clusters", type=int, default=-1, help="of the indexer kmeans; -1: 0.35 of the records")
    p.add_argument("--lsh-threshold", type=float, default=0.3)
    p.add_argument("--lsh-permutations", type=int, default=60)
    p.add_argument("--thresholds", nargs=2, type=float, default=(0.1, 0.6), metavar=("LOWER", "UPPER"), help="of weak labels")
    p.add_argument("--window", type=int, default=2)
    p.add_argument("--max-pairs", nargs=2, type=int, metavar=("POSITIVE", "NEGATIVE"), help="label budgets")
    p.add_argument("--depth", nargs=2, type=int, default=(2, 2), metavar=("CONJUNCTION", "DISJUNCTION"))
    p.add_argument("--block-size", type=int, default=100)
    p.add_argument("--good-ratio", type=float, default=0.9)
    p.add_argument("--encoders", nargs="+", default=("term_id", "tokens"))
    p.add_argument("--min-max", action="store_true", help="choose measures by mean similarities instead of average precision")
    p.add_argument("--scoring", default="f1", choices=("f1", "precision", "recall", "accuracy"))
    p.add_argument("--families", nargs="+", default=("linear", "rbf", "tree"), choices=("linear", "rbf", "tree"))
    p.add_argument("--baseline", help="JSON rows (term, field, encoder)")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    budget = a.max_pairs or (None, None)
    settings = Settings(
        lower=a.thresholds[0], upper=a.thresholds[1], window=a.window, max_positive=budget[0], max_negative=budget[1],
        max_conjunction=a.depth[0], max_disjunction=a.depth[1], max_block=a.block_size, min_good=a.good_ratio,
        encoders=tuple(a.encoders), by_average_precision=not a.min_max, vector=a.vector, indexer=a.indexer,
        lsh_threshold=a.lsh_threshold, lsh_permutations=a.lsh_permutations, clusters=a.clusters,
        use_classifier=not a.no_classifier, families=tuple(a.families), scoring=a.scoring,
    )
    engine = LinkageEngine(spark, a.folder, settings)
    if a.baseline:
        engine.set_baseline([tuple(r) for r in json.loads(a.baseline)])
    raw = read_csv(spark, a.csv, [a.id, *a.attributes], "UTF-8")
    pairs = gold(read_csv(spark, a.gold), *a.gold_columns, "string") if a.gold else None
    if a.verb == "fit":
        engine.fit(records(raw, a.id, a.attributes), pairs)
        print(json.dumps({"scheme": engine.scheme.rows(), "measures": engine.measures, "seconds": engine.seconds}))
        return
    engine.fit(engine.store.get("index") if engine.store.has("index") else records(raw, a.id, a.attributes))
    if a.verb == "build":
        print(json.dumps({"keys": engine.build(records(raw, a.id, a.attributes)).count()}))
    elif a.verb == "insert":
        print(json.dumps({"inserted": engine.insert(records(raw, a.id, a.attributes))}))
    else:
        numbered = raw.withColumn("_seq", F.monotonically_increasing_id() + 1)
        print(json.dumps(engine.evaluate(records(numbered, a.id, a.attributes, "_seq"), pairs)))


if __name__ == "__main__":
    main()
