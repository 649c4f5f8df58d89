"""Record linkage on Spark: blocking, similarity vectors, learned schemes, evaluation and streams."""
