"""Distributed prefix sums: running totals within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Aimed-at rows in one bin of a group's key range.
BIN_ROWS = 20_000


def with_prefix_sums(rows: DataFrame, group: str, weight: str, key: str, tie: str, largest: int, out: str = "__before") -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same ``group`` that come before in the order of ``key``
    (a random 64-bit hash), then ``tie``.

    ``largest`` is the number of rows of the largest group. Each group's key range is cut into bins; bin totals are
    summed first (partial aggregation, a table of groups times bins), then rows only within their bin.
    """
    bits = min(20, max(4, (largest // BIN_ROWS).bit_length()))
    binned = rows.withColumn("__bin", F.shiftright(key, 64 - bits))  # bins are ranges of the key: bin order is key order
    totals = binned.groupBy(group, "__bin").agg(F.sum(weight).alias("__t"))
    earlier = Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(group).alias("__of"), F.col("__bin").alias("__b"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__base"))
    joined = binned.join(before, (F.col(group).eqNullSafe(F.col("__of"))) & (F.col("__bin") == F.col("__b")))
    within = Window.partitionBy(group, "__bin").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(weight).over(within), F.lit(0))).drop("__of", "__b", "__base", "__bin")
