"""Aggregation to key prefixes, and runs of equal rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseloom.operators.joins import span_members
from verseloom.operators.keyed import POSITION, Keyed

#: Rows that one task numbers runs in, where no parent key parts them.
RUN_BLOCK = 65_536
REDUCERS = (
    "first last first_non_null last_non_null min max mean median sum count nunique any all all_equal mode concat unique "
    "concat_unique list unique_list"
).split()


@dataclass(frozen=True)
class Agg:
    """One output: a source column and a reducer. ``literal`` gives a constant instead."""

    source: str = ""
    reducer: str = ""
    separator: str = " "
    literal: object = None


def _ordered(c: Column, order: Column) -> Column:
    """Non-null values in row order, as an array."""
    pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def reduce_column(name: str, how: str, order: Column, separator: str = " ") -> Column:
    """The aggregate expression of a reducer; ``order`` is what first, last, concat and the like go by."""
    c = F.col(f"`{name}`")
    number = c.try_cast("double")
    truth = c.try_cast("boolean")
    if how == "first":
        return F.min_by(c, order)
    if how == "last":
        return F.max_by(c, order)
    if how == "first_non_null":
        return F.min_by(c, F.when(c.isNotNull(), order))
    if how == "last_non_null":
        return F.max_by(c, F.when(c.isNotNull(), order))
    if how in ("concat", "concat_unique"):
        text = _ordered(c.cast("string"), order)
        return F.array_join(F.array_distinct(text) if how == "concat_unique" else text, separator)
    simple = {
        "min": F.min(c), "max": F.max(c), "mean": F.avg(number), "median": F.median(number), "sum": F.coalesce(F.sum(number), F.lit(0.0)),
        "count": F.count(c), "nunique": F.count_distinct(c), "any": F.coalesce(F.bool_or(truth), F.lit(False)), "all": F.coalesce(F.bool_and(truth), F.lit(False)),
        "all_equal": F.count_distinct(c) <= 1,
    }
    if how in simple:
        return simple[how]
    if how in ("unique", "unique_list"):
        return F.array_distinct(_ordered(c, order))
    if how == "list":
        return _ordered(c, order)
    raise ValueError(f"no reducer {how!r}; there are {REDUCERS}")


def normalize_rules(rules: dict) -> dict[str, Agg]:
    """Also the short forms ``{column: reducer}``, ``{column: [reducers]}`` and ``{column: {output: reducer}}``."""
    out: dict[str, Agg] = {}
    for name, rule in rules.items():
        if callable(rule):
            raise ValueError("functions can't be reducers")
        if isinstance(rule, Agg):
            new = {name: rule}
        elif isinstance(rule, str):
            new = {name: Agg(name, rule)}
        elif isinstance(rule, dict):
            new = {o: Agg(name, r) for o, r in rule.items()}
        else:
            new = {f"{name}_{r}": Agg(name, r) for r in rule}
        if set(new) & set(out):
            raise ValueError(f"output twice: {sorted(set(new) & set(out))}")
        out |= new
    return out


def grouped(df: DataFrame, keys: Sequence[str], rules: dict[str, Agg], order: Column) -> DataFrame:
    """One groupBy for all rules; ``mode`` (ties: the value that comes first) is counted per value first, before the shuffle."""
    plain = {o: r for o, r in rules.items() if r.reducer != "mode"}
    aggs = [F.lit(r.literal).alias(o) if r.reducer == "" else reduce_column(r.source, r.reducer, order, r.separator).alias(o) for o, r in plain.items()]
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *aggs)
    for o, r in rules.items():
        if r.reducer == "mode":
            per = df.where(F.col(f"`{r.source}`").isNotNull()).groupBy(*keys, F.col(f"`{r.source}`").alias("__v")).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
            # most frequent, then earliest
            best = per.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), F.col("__first"))).alias(o))
            out = out.join(best, list(keys), "left") if keys else out.crossJoin(F.broadcast(best))  # one row each
    return out.select(*keys, "n_rows", *rules)


def aggregate(source: Keyed, to_key: Sequence[str], data: dict | None = None, metadata: dict | None = None) -> Keyed:
    """Reduce to a proper prefix of the key. ``n_rows`` is always among the metadata; values are ordered by key; the
    result is ordered by the group's first position."""
    to_key = list(to_key)
    if not to_key or source.pk[: len(to_key)] != to_key or len(to_key) >= len(source.pk):
        raise ValueError(f"{to_key} is not a proper prefix of {source.pk}")
    data, metadata = normalize_rules(data or {}), normalize_rules(metadata or {})
    if "n_rows" in data or "n_rows" in metadata or set(data) & set(metadata):
        raise ValueError("n_rows is reserved, and an output can't be in both groups")
    rules = data | metadata
    cols = [c for c in dict.fromkeys(r.source for r in rules.values() if r.reducer) if c not in source.pk]
    source.require(cols)
    view = source.view(cols)
    if POSITION in source.df.columns:  # else the key's order is that of the groups, too
        rules = rules | {POSITION: Agg(POSITION, "min")}
    out = grouped(view, to_key, rules, F.struct(*source.pk))
    return source.derive(out, "reduced_key", pk=to_key, data=list(data), metadata=["n_rows", *metadata])


def aggregate_cells(cells: DataFrame, rows: DataFrame, to_key: Sequence[str], how: str) -> DataFrame:
    """Pool a sparse matrix to a key prefix: sums, or means over all rows of the group, zeros too."""
    if how not in ("sum", "mean"):
        raise ValueError("a matrix is pooled by sum or mean")
    total = cells.groupBy(*to_key, "feature_id").agg(F.sum("value").alias("value"))
    if how == "sum":
        return total
    sizes = rows.groupBy(*to_key).agg(F.count("*").alias("__n"))
    return total.join(sizes, list(to_key)).select(*to_key, "feature_id", (F.col("value") / F.col("__n")).alias("value"))


def collapse_runs(source: Keyed, by: Sequence[str], data: dict | None = None, metadata: dict | None = None) -> Keyed:
    """Runs of consecutive rows (by position, within the parent key) with equal values of ``by``, nulls equal: key
    ``leaf_start, leaf_end`` are the least and greatest leaf, reducers go over all rows of that span, by position."""
    data, metadata = normalize_rules(data or {}), normalize_rules(metadata or {})
    *parent, leaf = source.pk
    rules = data | metadata
    cols = [c for c in dict.fromkeys([*by, *(r.source for r in rules.values() if r.reducer)]) if c not in source.pk]
    view = source.view(cols).withColumn("__at", source.order_value())
    runs = run_ids(view, parent, "__at", by) if parent else run_ids_by_range(source.positioned(cols).withColumn("__at", F.col(POSITION)), by)
    start, end = f"{leaf}_start", f"{leaf}_end"
    spans = runs.groupBy(*parent, "__run").agg(F.min(leaf).alias(start), F.max(leaf).alias(end), F.min("__at").alias("__first"), *[F.min_by(b, "__at").alias(f"__by_{b}") for b in by])
    members = span_members(spans, view.select(*source.pk, "__at", *[c for c in cols if c not in source.pk]), parent, leaf)
    keys = [*parent, start, end, "__first", *[f"__by_{b}" for b in by]]
    out = grouped(members, keys, rules, F.col("__at"))
    for b in by:
        out = out.withColumnRenamed(f"__by_{b}", b)
    if POSITION in source.df.columns:  # else the order is that of the spans' keys
        first = F.col("__first") if isinstance(source.df.schema[POSITION].dataType, T.ArrayType) else F.array(F.col("__first").cast("bigint"))
        out = out.withColumn(POSITION, F.concat(F.array(*[F.col(k).cast("bigint") for k in parent]), first) if parent else first)
    return source.derive(out.drop("__first"), "span_key", pk=[*parent, start, end], data=list(data), metadata=["n_rows", *by, *[m for m in metadata if m not in by]])


def run_ids(df: DataFrame, parent: Sequence[str], order: str, by: Sequence[str]) -> DataFrame:
    """Number the runs of equal ``by`` values within each parent (gaps and islands), as ``__run``."""
    w = Window.partitionBy(*parent).orderBy(order)
    changed = F.lit(False)
    for b in by:
        changed = changed | ~F.col(f"`{b}`").eqNullSafe(F.lag(f"`{b}`").over(w))
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("__new", F.when(first | changed, 1).otherwise(0))
    return flagged.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def run_ids_by_range(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same without a parent, for a table with dense ``_position``: blocks of positions are numbered each on its own,
    and put together by the last row and the number of runs of each block (one row per block)."""
    blocked = df.withColumn("__block", F.floor(F.col(POSITION) / RUN_BLOCK))
    values = F.struct(*[F.col(f"`{b}`") for b in by])
    lasts = blocked.groupBy("__block").agg(F.max_by(values, POSITION).alias("__last")).withColumn("__block", F.col("__block") + 1)
    w = Window.partitionBy("__block").orderBy(POSITION)
    joined = blocked.join(F.broadcast(lasts), "__block", "left")
    before = F.when(F.row_number().over(w) == 1, F.col("__last")).otherwise(F.lag(values).over(w))
    flagged = joined.withColumn("__before", before).withColumn("__new", F.when(F.col("__before").isNull() | ~values.eqNullSafe(F.col("__before")), 1).otherwise(0))
    per = flagged.groupBy("__block").agg(F.sum("__new").alias("__n"))
    bases = per.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    numbered = flagged.join(F.broadcast(bases), "__block").withColumn("__run", F.col("__base") + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.drop("__block", "__last", "__before", "__new", "__base")


def crosstab(df: DataFrame, rows: str, columns: str, margins: bool = False, dropna: bool = True, where: Column | str | None = None) -> DataFrame:
    """Counts of value pairs, of the rows for which ``where`` holds, in long form: row, column, ``n``. With ``dropna=False`` a null is ``<NA>``; with margins the
    totals are under ``All``."""
    df = df if where is None else df.where(where)
    r, c = F.col(f"`{rows}`").cast("string"), F.col(f"`{columns}`").cast("string")
    base = df.select(F.coalesce(r, F.lit("<NA>")).alias(rows), F.coalesce(c, F.lit("<NA>")).alias(columns)) if not dropna else df.select(r.alias(rows), c.alias(columns)).where(f"`{rows}` IS NOT NULL AND `{columns}` IS NOT NULL")
    if not margins:
        return base.groupBy(rows, columns).agg(F.count("*").alias("n"))
    cube = base.cube(rows, columns).agg(F.count("*").alias("n"), F.grouping(rows).alias("gr"), F.grouping(columns).alias("gc"))
    return cube.select(F.when(F.col("gr") == 1, "All").otherwise(F.col(rows)).alias(rows), F.when(F.col("gc") == 1, "All").otherwise(F.col(columns)).alias(columns), "n")


def histogram(df: DataFrame, field: str, edges: Sequence[float] | int, low: float | None = None, high: float | None = None, by: str | None = None, dropna: bool = True, where: Column | str | None = None) -> DataFrame:
    """Counts in right-open bins, the last one closed: ``bin``, ``lower``, ``upper``, ``n``; under- and overflow and nulls
    have bins -1, n and -2. ``by``: one histogram for each value of a column, with the same edges; its nulls are left out
    or, with ``dropna=False``, are the group ``<NA>``."""
    df = df if where is None else df.where(where)
    if by:
        group = F.col(f"`{by}`").cast("string")
        df = df.where(group.isNotNull()) if dropna else df
        df = df.select(F.col(f"`{field}`"), F.coalesce(group, F.lit("<NA>")).alias("__by"))
    c = F.col(f"`{field}`").try_cast("double")
    if isinstance(edges, int):
        if low is None or high is None:
            span = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
            low, high = (0.0, 1.0) if span.a is None else (span.a, span.b)
        if low == high:
            low, high = low - 0.5, high + 0.5
        edges = [low + (high - low) * i / edges for i in range(edges + 1)]
    edges, k = [float(e) for e in edges], len(edges) - 1
    if k < 1 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must rise")
    which = F.when(c.isNull() | F.isnan(c), -2).when(c < edges[0], -1).when(c > edges[-1], k)
    for i in range(k):
        which = which.when(c < edges[i + 1], i)
    keys = ["__by"] if by else []
    counts = df.groupBy(*keys, which.otherwise(k - 1).alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(k)] + [(-2, None, None), (-1, None, edges[0]), (k, edges[-1], None)], "bin int, lower double, upper double")
    if not by:
        return bins.join(F.broadcast(counts), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))  # one row per bin
    groups = counts.select("__by").distinct().withColumn("bin", F.explode(F.array(*[F.lit(i) for i in (-2, *range(-1, k + 1))])))
    full = groups.join(counts, ["__by", "bin"], "left").join(F.broadcast(bins), "bin")
    return full.select(F.col("__by").alias(by), "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def text_diagnostics(df: DataFrame, field: str, strip: bool = True) -> DataFrame:
    """One row: ``rows``, ``missing``, ``empty``, ``nonempty``, ``unique``, and duplicate groups, rows and excess among nonempty texts."""
    c = F.col(f"`{field}`")
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "") if strip else c
    per = df.select(text.alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    full = (F.col("t").isNotNull()) & (F.col("t") != "")
    twice = full & (F.col("n") > 1)
    s = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("bigint")
    return per.agg(
        s(F.lit(True), F.col("n")).alias("rows"), s(F.col("t").isNull(), F.col("n")).alias("missing"), s(F.col("t") == "", F.col("n")).alias("empty"), s(full, F.col("n")).alias("nonempty"),
        s(full, F.lit(1)).alias("unique"), s(twice, F.lit(1)).alias("duplicate_groups"), s(twice, F.col("n")).alias("duplicate_rows"), s(twice, F.col("n") - 1).alias("duplicate_excess"),
    )


def compare_keys(left: DataFrame, right: DataFrame, pk: Sequence[str]) -> dict[str, int]:
    """How many keys only one side has."""
    return {"only_left": left.join(right, list(pk), "left_anti").count(), "only_right": right.join(left, list(pk), "left_anti").count()}
