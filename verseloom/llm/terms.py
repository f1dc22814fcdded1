"""Term statistics of a whole collection: how often each term occurs, and how distinctive it is of a record."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm._text import terms
from verseloom.runtime import map_batches, materialize


def record_terms(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """One row for each record and distinct term: id, ``term``, ``tf``, and ``n_terms``, the tokens of the record.

    Counted within the record before anything is shuffled. Null texts count as empty; a record without terms has no row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(ids: pa.Array, *texts: pa.Array):
        out: dict[str, list] = {"id": [], "term": [], "tf": [], "n_terms": []}
        for i, *parts in zip(ids.to_pylist(), *(t.to_pylist() for t in texts)):
            count: Counter = Counter()
            for part in parts:
                count.update(terms(part))
            out["id"] += [i] * len(count)
            out["term"] += count.keys()
            out["tf"] += count.values()
            out["n_terms"] += [sum(count.values())] * len(count)
        yield out

    picked = df.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`").cast("string").alias(f"__{k}") for k, c in enumerate(text_cols)])
    return map_batches(picked, run, f"id {kind}, term string, tf bigint, n_terms bigint")


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """G² of a two-by-two table of counts, 0 at least: twice the sum of observed times ln(observed / expected)."""
    xlogx = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))
    cells = sum((xlogx(k.cast("double")) for k in (k11, k12, k21, k22)), F.lit(0.0))
    margins = sum((xlogx(k.cast("double")) for k in (k11 + k12, k21 + k22, k11 + k21, k12 + k22)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 2 * (cells + xlogx((k11 + k12 + k21 + k22).cast("double")) - margins))


def distinctive_terms(df: DataFrame, id_col: str, text_col: str, min_tf: int = 1, min_records: int = 1, max_records: int | None = None) -> DataFrame:
    """Score every term of every record by the log-likelihood ratio of its count in the record against its count in the
    rest of the collection: id, ``term``, ``tf``, ``records`` (how many hold it), ``total`` (its occurrences), ``llr`` and
    ``over`` (whether it is more frequent here than elsewhere).

    The statistics are of all records; ``min_tf``, ``min_records`` and ``max_records`` choose which scores are given.
    ``id_col`` must be unique (see ``one_per_key``). Null and empty texts have no terms; ties get equal scores; an empty
    table gives none; other columns are ignored. Counts are made per record before the first shuffle, and joined on the
    term, where the statistics side has one row per term, so that a very common term can be split by AQE.
    """
    counted = materialize(record_terms(df, id_col, [text_col]), "record-terms")  # read twice below: tokenized once
    stats = materialize(counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("records")), "term-statistics")
    size = stats.agg(F.sum("total").alias("n")).first().n or 0
    kept = stats.where(F.col("records") >= min_records)
    if max_records is not None:
        kept = kept.where(F.col("records") <= max_records)
    joined = counted.where(F.col("tf") >= min_tf).join(kept, "term")
    k11, total, here, n = F.col("tf"), F.col("total"), F.col("n_terms"), F.lit(size)
    score = log_likelihood(k11, total - k11, here - k11, n - here - (total - k11))
    return joined.select(
        F.col("id").alias(id_col), "term", "tf", "records", "total", score.alias("llr"), (k11.cast("double") * (n - here) > (total - k11).cast("double") * here).alias("over")
    )


def term_frequencies(df: DataFrame, id_col: str, text_cols: list[str], rare_records: int = 2, common_share: float = 0.5, n_records: int | None = None) -> DataFrame:
    """Count every distinct term over the whole collection: ``term``, ``occurrences``, ``records``, and ``mark`` —
    ``rare`` (in ``rare_records`` records at most), ``common`` (in more, and in more than ``common_share`` of all) or null.

    An external sort: pairs of term and record are partitioned by ranges of (term, record), so that a very common term
    spreads over many partitions, sorted within each (spilling to disk), and scanned once for run lengths. Runs that
    cross a partition's edge are put together in a last small aggregation. ``id_col`` must be unique; ``n_records`` is
    the number of records, else counted. Null and empty texts have no terms; an empty table gives no rows.
    """
    n = df.select(id_col).count() if n_records is None else n_records
    # written once: the sort samples it for its ranges, then reads it again
    pairs = materialize(record_terms(df, id_col, text_cols).select("term", "id", "tf"), "record-terms")
    ordered = pairs.repartitionByRange("term", "id").sortWithinPartitions("term", "id")

    def run(batches):
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            term, tf = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            new = np.ones(size, bool)
            if size > 1:
                new[1:] = pc.not_equal(term.slice(1), term.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [term.take(pa.array(starts)).cast(pa.string()), pa.array(np.add.reduceat(tf, starts), pa.int64()), pa.array(np.diff(np.append(starts, size)), pa.int64())],
                names=["term", "occurrences", "records"],
            )

    runs = ordered.mapInArrow(run, "term string, occurrences bigint, records bigint")
    counts = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * n, "common")
    return counts.withColumn("mark", mark)
