"""Joins of keyed data sets, and restriction of one to the keys of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.operators.keyed import POSITION, KeyError_, Keyed, assert_unique
from verseloom.runtime import pretty_size

#: A right side under this many bytes, by Catalyst's estimate, is broadcast.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its size is small enough."""
    return F.broadcast(df) if pretty_size(df) <= BROADCAST_BYTES else df


def join(basis: Keyed, *others: Keyed) -> Keyed:
    """Left equi-join of any number of data sets with the same key. The basis gives rows and order; keys that only a later
    one has are left out; what is missing is null. The result owns keys only."""
    seen = set(basis.all_columns()) - set(basis.pk)
    for o in others:
        if o.pk != basis.pk:
            raise ValueError(f"keys differ: {basis.pk} and {o.pk}")
        own = set(o.all_columns()) - set(o.pk)
        if seen & own:
            raise ValueError(f"columns of the same name: {sorted(seen & own)}")
        seen |= own
    return basis.derive(basis.keys(), "joined_key", bases=[basis, *others])


def attach(left: DataFrame, left_pk: Sequence[str], right: Keyed, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Left join of a coarser table: its key must be part of the left key. A name that is taken gets the table's prefix."""
    if not set(right.pk) <= set(left_pk):
        raise ValueError(f"{right.pk} is not part of {list(left_pk)}")
    taken = set(left.columns)
    view = right.view(columns).select(*right.pk, *[F.col(c).alias(f"{prefix or right.name or 'with'}.{c}" if c in taken else c) for c in columns])
    return left.join(sized(view), right.pk, "left")


def attach_cells(left: DataFrame, cells: DataFrame, pk: Sequence[str], features: dict[int, str]) -> DataFrame:
    """Late join of matrix features: a matched row's missing cell is 0, an unmatched row's is null."""
    wide = cells.where(F.col("feature_id").isin(list(features)) | F.col("feature_id").isNull()).groupBy(*pk).agg(*[F.sum(F.when(F.col("feature_id") == i, F.col("value"))).alias(n) for i, n in features.items()])
    present = cells.select(*pk).distinct().withColumn("__in", F.lit(True))
    out = left.join(present, list(pk), "left").join(wide, list(pk), "left")
    for n in features.values():
        out = out.withColumn(n, F.when(F.col("__in"), F.coalesce(n, F.lit(0.0))))
    return out.drop("__in")


def restrict(source: Keyed, to: Keyed) -> Keyed:
    """Rows of the source whose key prefix is in ``to``; grain and order of the source stay."""
    if source.pk[: len(to.pk)] != to.pk:
        raise ValueError(f"{to.pk} is not a prefix of {source.pk}")
    kept = source.keys().join(to.df.select(*to.pk), to.pk, "left_semi")
    return source.derive(kept, "preserved_key")


def select_keys(source: Keyed, keys: Sequence) -> Keyed:
    """Rows of the keys given, in source order. Repeated or unknown keys are errors."""
    rows = [tuple(k) if isinstance(k, (tuple, list)) else (k,) for k in keys]
    if len(set(rows)) < len(rows):
        raise KeyError_("a key is asked for twice")
    asked = source.df.sparkSession.createDataFrame(rows, ", ".join(f"{k} bigint" for k in source.pk))
    unknown = asked.join(source.df.select(*source.pk), source.pk, "left_anti").limit(3).collect()
    if unknown:
        raise KeyError_(f"unknown keys: {[tuple(r) for r in unknown]}")
    return source.derive(source.keys().join(F.broadcast(asked), source.pk, "left_semi"), "preserved_key")  # rows of the call


def from_keyed_frame(source: Keyed, frame: DataFrame, columns: Sequence[str], require_complete: bool = False, as_metadata: bool = False) -> Keyed:
    """New columns for the keys of a source: unique keys, none unknown; with ``require_complete`` none missing."""
    assert_unique(frame, source.pk)
    if frame.join(source.df.select(*source.pk), source.pk, "left_anti").limit(1).count():
        raise KeyError_("the frame has keys that the source hasn't")
    joined = source.keys().join(frame.select(*source.pk, *columns), source.pk, "inner")
    if require_complete and source.df.join(frame.select(*source.pk), source.pk, "left_anti").limit(1).count():
        raise KeyError_("the frame lacks keys of the source")
    return source.derive(joined, "preserved_key", data=[] if as_metadata else columns, metadata=columns if as_metadata else [])


def attach_metadata(source: Keyed, frame: DataFrame, metadata_fields: Sequence[str], require_complete: bool = True) -> Keyed:
    """Metadata columns for the keys of a source. Every row stays; keys of the frame must be unique and known and, unless
    ``require_complete`` is off, all there; what is missing is null."""
    assert_unique(frame, source.pk)
    if frame.join(source.df.select(*source.pk), source.pk, "left_anti").limit(1).count():
        raise KeyError_("the frame has keys that the source hasn't")
    if require_complete and source.df.join(frame.select(*source.pk), source.pk, "left_anti").limit(1).count():
        raise KeyError_("the frame lacks keys of the source")
    if taken := set(metadata_fields) & set(source.all_columns()):
        raise ValueError(f"columns of the same name: {sorted(taken)}")
    return source.derive(source.keys().join(frame.select(*source.pk, *metadata_fields), source.pk, "left"), "preserved_key", metadata=metadata_fields)


def span_members(spans: DataFrame, rows: DataFrame, parent: Sequence[str], leaf: str) -> DataFrame:
    """Rows of each span: equal parents and the leaf between start and end, both included. Spans may overlap."""
    start, end = f"{leaf}_start", f"{leaf}_end"
    if parent:
        return spans.join(rows, list(parent)).where(F.col(leaf).between(F.col(start), F.col(end)))
    width = 1024  # without a parent, blocks of the leaf give an equi-join
    cut = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return cut.join(rows.withColumn("__b", F.floor(F.col(leaf) / width)), "__b").where(F.col(leaf).between(F.col(start), F.col(end))).drop("__b")


def one_to_one(left: DataFrame, right: DataFrame, pk: Sequence[str], what: str) -> DataFrame:
    """Inner join that raises unless the right side has exactly one row for every left key."""
    assert_unique(left, pk, what)
    assert_unique(right, pk, what)
    if left.join(right, list(pk), "left_anti").limit(1).count():
        raise KeyError_(f"missing {what}")
    return left.join(right, list(pk), "inner")


def position_map(left: Keyed, right: Keyed) -> DataFrame:
    """Positions of left rows and of the right rows that share their key prefix."""
    on = [k for k in left.pk if k in right.pk]
    r = right.positions().select(*on, F.col(POSITION).alias("right_position"))
    return left.positions().select(*on, F.col(POSITION).alias("left_position")).join(r, on, "left").select("left_position", "right_position")
