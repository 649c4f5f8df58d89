"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (a, b): the smallest id that links reach.

    Labels start as the smallest neighbour. A round takes the smallest label among a node, its neighbours and the nodes that
    point to it, then follows labels of labels, so that long chains shrink geometrically. Minima are combined before
    shuffles; each round's labels are written to the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("a"), "label"), "a").select(F.col("b").alias("id"), "label")
        got = near.union(labels.select("id", "label")).groupBy("id").agg(F.min("label").alias("got"))
        step = labels.select("id", F.col("label").alias("old")).join(got, "id")
        up = step.select(F.col("old").alias("id"), "got").union(step.select("id", "got")).groupBy("id").agg(F.min("got").alias("got"))
        far = up.select(F.col("id").alias("got"), F.col("got").alias("far"))
        new = up.join(far, "got", "left").select("id", F.least("got", F.coalesce("far", "got")).alias("label"))
        new = cut(new.join(labels.select("id", F.col("label").alias("old")), "id"), "labels")
        done = new.where(F.col("old") != F.col("label")).isEmpty()
        drop_cut(labels)
        labels = new
        if done:
            drop_cut(both)
            return labels.select("id", F.col("label").alias("component"))
