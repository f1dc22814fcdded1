"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.runtime import drop_materialized, materialize


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its connected component, of links ``a``, ``b``, by alternating large-star
    and small-star steps; each round is a table in the shared folder, nothing is collected. A node without a link to
    another one has no row."""
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    seen = None
    while True:
        # large star: a node's larger neighbours go to its least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        old, e = e, materialize(small, "edges")
        sums = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop_materialized(old)
        if seen == (sums.n, sums.s):
            break
        seen = (sums.n, sums.s)
    return e.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
