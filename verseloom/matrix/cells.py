"""Sparse and dense matrices as cell tables.

A sparse matrix is a table of ``pk..., feature_id, value`` without zeros, next to a table of its rows and one of its
features (``feature_id``, ``feature``). A dense one is ``pk..., features array<double>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.text import char_ngrams, ngrams, stemmed, tokens
from verseloom.operators.joins import sized
from verseloom.operators.keyed import Keyed, with_position
from verseloom.runtime import materialize


@dataclass(frozen=True)
class Cells:
    """A sparse matrix: all row keys, the nonzero cells and the features."""

    rows: DataFrame
    cells: DataFrame
    features: DataFrame
    pk: tuple[str, ...]

    @property
    def key(self) -> list[str]:
        return list(self.pk)

    def with_cells(self, cells: DataFrame) -> "Cells":
        return replace(self, cells=cells.where("value <> 0").select(*self.pk, "feature_id", "value"))

    def wide(self, feature_ids: Sequence[int] | None = None) -> DataFrame:
        """Dense rows of the chosen features, or of all in the order of their ids: implicit zeros filled in. A row is an
        array as wide as its features; for wide matrices use the cells."""
        some, wanted = self.cells, self.features.select("feature_id")
        if feature_ids is not None:
            wanted = self.rows.sparkSession.createDataFrame([(int(i), n) for n, i in enumerate(feature_ids)], "feature_id bigint, place int")
            some = some.join(F.broadcast(wanted), "feature_id")  # features of the call
            n = F.lit(len(feature_ids))
        else:
            span = self.features.agg(F.min("feature_id").alias("a"), F.max("feature_id").alias("b"), F.count("*").alias("n")).first()
            n = F.lit(span.n)
            if span.n and (span.a, span.b) != (0, span.n - 1):
                some = some.join(sized(with_position(wanted, ["feature_id"], "place")), "feature_id")
            else:
                some = some.withColumn("place", F.col("feature_id"))
        maps = some.groupBy(*self.pk).agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("bigint"), "value"))).alias("m"))
        out = self.rows.select(*self.pk).join(maps, self.key, "left")
        value = lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0))
        return out.select(*self.pk, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), value)).otherwise(F.array().cast("array<double>")).alias("features"))


def from_dense(df: DataFrame, pk: Sequence[str], array: str = "features") -> Cells:
    long = df.select(*pk, F.posexplode(array).alias("feature_id", "value")).select(*pk, F.col("feature_id").cast("bigint"), F.col("value").cast("double"))
    width = df.select(F.size(array).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    features = df.sparkSession.range(width).select(F.col("id").alias("feature_id"), F.col("id").cast("string").alias("feature"))
    return Cells(df.select(*pk), long.where("value <> 0"), features, tuple(pk))


def _bound(x: int | float, n: int, up: bool) -> float:
    """A whole number counts rows, a float is their share."""
    import math

    return x if isinstance(x, int) else (math.ceil(x * n - 1e-9) if up else math.floor(x * n + 1e-9))


def _vocabulary(counts: DataFrame, n: int, min_df: int | float, max_df: int | float, max_features: int | None, label: str) -> DataFrame:
    low, high = _bound(min_df, n, True), _bound(max_df, n, False)
    if high < low:
        raise ValueError("max_df is below min_df")
    kept = counts.where(F.col("df").between(low, high))
    if max_features:
        kept = kept.orderBy(F.desc("tf"), label).limit(max_features)
    return with_position(kept, [label], "feature_id").select("feature_id", F.col(label).alias("feature"))


def count_vectorize(
    df: DataFrame, pk: Sequence[str], field: str, lowercase: bool = True, stop_words: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 1), analyzer: str = "word",
    min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None, binary: bool = False, stem: bool = False, separator: str = " ",
) -> Cells:
    """Bag of words: words of two characters or more, stop words out, stemmed if asked, then n-grams; ids in alphabetical
    order; the top ``max_features`` by frequency, ties by term."""
    c = F.coalesce(F.col(f"`{field}`"), F.lit(""))
    if analyzer == "word":
        ws = tokens(c, lowercase)
        if stop_words:
            ws = F.filter(ws, lambda w: ~w.isin(list(stop_words)))
        if stem:
            ws = stemmed(ws)
        grams = ws if ngram_range == (1, 1) else ngrams(ws, *ngram_range, separator)
    else:
        grams = char_ngrams(F.lower(c) if lowercase else c, *ngram_range, within_words=analyzer == "char_wb")
    # the texts are shuffled by their key, not their words: the counts of a row are made where it lands
    placed = df.select(*pk, F.col(f"`{field}`")).repartition(*pk)
    long = placed.select(*pk, F.explode(grams).alias("term")).groupBy(*pk, "term").agg(F.count("*").cast("double").alias("value"))
    if binary:
        long = long.withColumn("value", F.lit(1.0))
    long = materialize(long, "counts")  # the matrix itself: read for the vocabulary and for the cells, tokenized once
    counts = long.groupBy("term").agg(F.count("*").alias("df"), F.sum("value").alias("tf"))
    vocabulary = _vocabulary(counts, df.count(), min_df, max_df, max_features, "term")
    cells = long.join(sized(vocabulary.withColumnRenamed("feature", "term")), "term").select(*pk, "feature_id", "value")
    return Cells(df.select(*pk), cells, vocabulary, tuple(pk))


def transform_counts(fitted: Cells, df: DataFrame, pk: Sequence[str], field: str, lowercase: bool = True) -> Cells:
    """Counts of a fitted vocabulary's single words in other texts."""
    long = df.select(*pk, F.explode(tokens(F.coalesce(F.col(f"`{field}`"), F.lit("")), lowercase)).alias("feature"))
    cells = long.join(sized(fitted.features), "feature").groupBy(*pk, "feature_id").agg(F.count("*").cast("double").alias("value"))
    return Cells(df.select(*pk), cells, fitted.features, tuple(pk))


def count_items(
    df: DataFrame, field: str, group_by: Sequence[str], sequence_by: Sequence[str] = (), order_by: Sequence[str] = (), where: Column | str | None = None,
    ngram_range: tuple[int, int] = (1, 1), min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None, separator: str = " ",
) -> Cells:
    """Counts of a column's values (tokens made elsewhere) by group; n-grams never cross a sequence; groups of which
    everything is filtered out stay as rows of zeros."""
    kept = df.where(where) if where is not None else df
    kept = kept.where(F.col(field).isNotNull())
    low, high = ngram_range
    w = Window.partitionBy(*dict.fromkeys([*group_by, *sequence_by])).orderBy(*(order_by or [F.lit(0)]))
    made = None
    for n in range(low, high + 1):
        parts = [F.lead(F.col(field).cast("string"), k).over(w) if k else F.col(field).cast("string") for k in range(n)]
        one = kept.select(*group_by, F.when(parts[-1].isNotNull(), F.concat_ws(separator, *parts)).alias("term")).where("term IS NOT NULL")
        made = one if made is None else made.unionByName(one)
    long = materialize(made.groupBy(*group_by, "term").agg(F.count("*").cast("double").alias("value")), "counts")
    rows = df.select(*group_by).distinct()
    counts = long.groupBy("term").agg(F.count("*").alias("df"), F.sum("value").alias("tf"))
    vocabulary = _vocabulary(counts, rows.count(), min_df, max_df, max_features, "term")
    cells = long.join(sized(vocabulary.withColumnRenamed("feature", "term")), "term").select(*group_by, "feature_id", "value")
    return Cells(rows, cells, vocabulary, tuple(group_by))


def tfidf(m: Cells, norm: str | None = None, use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False) -> Cells:
    """tf·(ln((1+n)/(1+df))+1), unsmoothed ln(n/df)+1; sublinear tf is 1+ln tf."""
    cells = m.cells
    tf = F.when(F.col("value") > 0, 1 + F.ln("value")).otherwise(0.0) if sublinear_tf else F.col("value")
    if use_idf:
        n = m.rows.count()
        freq = cells.groupBy("feature_id").agg(F.count("*").alias("df"))
        idf = F.ln((F.lit(1.0) + n) / (1 + F.col("df"))) + 1 if smooth_idf else F.ln(F.lit(float(n)) / F.col("df")) + 1
        cells = cells.join(sized(freq), "feature_id").withColumn("value", tf * idf)
    else:
        cells = cells.withColumn("value", tf)
    out = m.with_cells(cells)
    return normalize(out, norm) if norm else out


def normalize(m: Cells, norm: str = "l2", axis: str = "rows") -> Cells:
    """l1, l2 or max norm of rows or columns; a zero vector stays zero."""
    by = m.key if axis == "rows" else ["feature_id"]
    size = {"l1": F.sum(F.abs("value")), "l2": F.sqrt(F.sum(F.col("value") * F.col("value"))), "max": F.max(F.abs("value"))}[norm]
    sizes = m.cells.groupBy(*by).agg(size.alias("__n"))
    return m.with_cells(m.cells.join(sizes, by).withColumn("value", F.when(F.col("__n") > 0, F.col("value") / F.col("__n")).otherwise(F.col("value"))))


def _renumber(m: Cells, kept: DataFrame) -> Cells:
    """Keep some features (``feature_id``) and number them anew in their order."""
    numbered = with_position(m.features.join(kept.select("feature_id"), "feature_id", "left_semi"), ["feature_id"], "__new")
    cells = m.cells.join(sized(numbered.select("feature_id", "__new")), "feature_id").select(*m.pk, F.col("__new").alias("feature_id"), "value")
    extra = [c for c in m.features.columns if c != "feature_id"]
    return Cells(m.rows, cells, numbered.select(F.col("__new").alias("feature_id"), *extra), m.pk)


def trim_features(m: Cells, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None) -> Cells:
    """Features by the number of rows that hold them, then the top ones by sum (ties by id), in their old order."""
    n = m.rows.count()
    low, high = _bound(min_df, n, True), _bound(max_df, n, False)
    if high < low:
        raise ValueError("max_df is below min_df")
    counts = m.features.select("feature_id").join(m.cells.groupBy("feature_id").agg(F.count("*").alias("df"), F.sum("value").alias("s")), "feature_id", "left").na.fill(0)
    kept = counts.where(F.col("df").between(low, high))
    if max_features:
        kept = kept.orderBy(F.desc("s"), "feature_id").limit(max_features)
    return _renumber(m, kept)


def feature_subset(m: Cells, predicate: Column | str | Callable) -> Cells:
    """Features for which a predicate over the feature table holds."""
    if callable(predicate) and not isinstance(predicate, Column):
        kept = m.features.mapInPandas(lambda fs: (f.loc[list(map(bool, predicate(f))), ["feature_id"]] for f in fs), "feature_id bigint")
    else:
        kept = m.features.where(predicate)
    return _renumber(m, kept)


def transpose(m: Cells, row_name: str | None = None) -> Cells:
    """Features become rows of key ``column_id``; rows become features in key order, named by ``row_name`` or their rank."""
    ranked = with_position(m.rows, m.key, "__r")
    cells = m.cells.join(ranked.select(*m.pk, "__r"), m.key).select("feature_id", F.col("__r").alias("__f"), "value")
    features = ranked.select(F.col("__r").alias("feature_id"), (F.col(row_name) if row_name else F.col("__r")).cast("string").alias("feature"))
    rows = m.features.select(F.col("feature_id").alias("column_id"), "feature")
    return Cells(rows, cells.select(F.col("feature_id").alias("column_id"), F.col("__f").alias("feature_id"), "value"), features, ("column_id",))


def arg_max(m: Cells) -> DataFrame:
    """``max_feature`` and ``max_value`` of each row; implicit zeros compete; ties go to the least name; a row of zeros has
    null and 0."""
    n = m.features.count()
    ranked = with_position(m.features, ["feature", "feature_id"], "__name")
    named = m.cells.join(sized(ranked.select("feature_id", "feature", "__name")), "feature_id")
    best = named.groupBy(*m.pk).agg(F.max("value").alias("__v"), F.min_by("feature", F.struct(-F.col("value"), F.col("feature"))).alias("__f"), F.count("*").alias("__k"), F.collect_set("__name").alias("__held"))
    out = m.rows.select(*m.pk).join(best, m.key, "left")
    # where every stored value is negative, the first name that the row doesn't hold wins with 0
    zero = (F.col("__v") < 0) & (F.col("__k") < n)
    free = F.filter(F.sequence(F.lit(0), F.size("__held")), lambda r: ~F.array_contains("__held", r.cast("bigint")))
    out = out.withColumn("__name", F.when(zero, F.element_at(free, 1).cast("bigint"))).join(sized(ranked.select("__name", F.col("feature").alias("__zf"))), "__name", "left")
    return out.select(*m.pk, F.when(zero, F.col("__zf")).otherwise(F.col("__f")).alias("max_feature"), F.when(F.col("__v").isNull() | zero, 0.0).otherwise(F.col("__v")).alias("max_value"))


def _stats(n: Column, cells: str = "__k") -> list[Column]:
    k = F.coalesce(F.col(cells), F.lit(0))
    zeros = k < n
    low, high = F.coalesce("__min", F.lit(0.0)), F.coalesce("__max", F.lit(0.0))
    nothing = n == 0
    return [
        k.alias("nonzero"), F.when(~nothing, k / n).alias("nonzero_fraction"), F.coalesce("__sum", F.lit(0.0)).alias("sum"), F.when(~nothing, F.coalesce("__sum", F.lit(0.0)) / n).alias("mean"),
        F.when(~nothing, F.when(zeros, F.least(low, F.lit(0.0))).otherwise(low)).alias("min"), F.when(~nothing, F.when(zeros, F.greatest(high, F.lit(0.0))).otherwise(high)).alias("max"),
        F.coalesce("__l1", F.lit(0.0)).alias("l1"), F.coalesce(F.sqrt("__l2"), F.lit(0.0)).alias("l2"),
    ]


def _sums(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    v = F.col("value")
    return cells.groupBy(*by).agg(F.count("*").alias("__k"), F.sum(v).alias("__sum"), F.min(v).alias("__min"), F.max(v).alias("__max"), F.sum(F.abs(v)).alias("__l1"), F.sum(v * v).alias("__l2"))


def row_summary(m: Cells) -> DataFrame:
    """Per row: nonzero count and share, sum, mean over all features, min and max with implicit zeros, l1 and l2."""
    n = F.lit(m.features.count())
    return m.rows.select(*m.pk).join(_sums(m.cells, m.pk), m.key, "left").select(*m.pk, *_stats(n))


def feature_summary(m: Cells) -> DataFrame:
    n = F.lit(m.rows.count())
    return m.features.join(_sums(m.cells, ["feature_id"]), "feature_id", "left").select("feature_id", "feature", *_stats(n))


def matrix_summary(m: Cells) -> DataFrame:
    """One row: shape, nonzero cells, density, zero rows and features, sum, mean, min, max, l1 and Frobenius norm."""
    rows, features = m.rows.count(), m.features.count()
    total = F.lit(rows * features)
    one = _sums(m.cells, []).crossJoin(m.cells.agg(F.count_distinct(*m.pk).alias("__r"), F.count_distinct("feature_id").alias("__f")))  # two single rows
    return one.select(F.lit(rows).alias("rows"), F.lit(features).alias("features"), *_stats(total), (F.lit(rows) - F.col("__r")).alias("zero_rows"), (F.lit(features) - F.col("__f")).alias("zero_features")).withColumnsRenamed({"nonzero_fraction": "density", "l2": "frobenius"})


def pool_rows(m: Cells, group_by: Sequence[str], pooling: str = "mean") -> Cells:
    """Sum or mean of rows by other columns of the row table (zeros count for the mean)."""
    from verseloom.operators.aggregate import aggregate_cells

    labelled = m.cells.join(m.rows, m.key)
    return Cells(m.rows.groupBy(*group_by).agg(F.count("*").alias("n_rows")), aggregate_cells(labelled, m.rows, group_by, pooling), m.features, tuple(group_by))


def scale_features(m: Cells, gamma: float = 1.0, norm: str = "rms") -> Cells:
    """x / scale^gamma by column; the scale is its RMS or l2 norm, one near zero counts as 1."""
    n = m.rows.count()
    total = F.sum(F.col("value") * F.col("value"))
    scale = m.cells.groupBy("feature_id").agg(F.sqrt(total / n if norm == "rms" else total).alias("__s"))
    return m.with_cells(m.cells.join(sized(scale), "feature_id").withColumn("value", F.col("value") / F.pow(F.when(F.col("__s") <= 1e-12, 1.0).otherwise(F.col("__s")), F.lit(gamma))))


METRICS = ("cosine", "euclidean", "sqeuclidean", "manhattan", "cityblock", "chebyshev", "minkowski", "canberra", "braycurtis", "correlation", "hamming", "jaccard", "dice")


def pair_distance(x: Column, y: Column, metric: str = "cosine", p: float = 3.0) -> Column:
    """Distance of two arrays of numbers by one of ``METRICS``: 1 - cosine and 1 - correlation are 1 with a zero (or
    constant) vector; ``p`` is Minkowski's; jaccard and dice go by which values aren't zero; hamming is the share of
    unequal values."""
    x, y = (F.transform(c, lambda v: v.cast("double")) for c in (x, y))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    each = lambda f: F.zip_with(x, y, f)
    d = lambda f: total(each(f))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    over = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            centred = lambda c: F.transform(c, lambda v: v - total(c) / F.size(c))
            a, b = centred(x), centred(y)
        else:
            a, b = x, y
        size = F.sqrt(total(F.transform(a, lambda v: v * v))) * F.sqrt(total(F.transform(b, lambda v: v * v)))
        return F.when(size > 0, 1 - total(F.zip_with(a, b, lambda v, w: v * w)) / size).otherwise(1.0)
    if metric in ("jaccard", "dice"):
        both, unequal = d(lambda a, b: one((a != 0) & (b != 0))), d(lambda a, b: one((a != 0) != (b != 0)))
        return over(unequal, both + unequal if metric == "jaccard" else 2 * both + unequal, 0.0)
    found = {
        "euclidean": lambda: F.sqrt(d(lambda a, b: (a - b) * (a - b))), "sqeuclidean": lambda: d(lambda a, b: (a - b) * (a - b)),
        "manhattan": lambda: d(lambda a, b: F.abs(a - b)), "cityblock": lambda: d(lambda a, b: F.abs(a - b)),
        "chebyshev": lambda: F.coalesce(F.array_max(each(lambda a, b: F.abs(a - b))), F.lit(0.0)), "minkowski": lambda: F.pow(d(lambda a, b: F.pow(F.abs(a - b), F.lit(p))), F.lit(1 / p)),
        "canberra": lambda: d(lambda a, b: over(F.abs(a - b), F.abs(a) + F.abs(b), 0.0)), "braycurtis": lambda: over(d(lambda a, b: F.abs(a - b)), d(lambda a, b: F.abs(a + b)), 0.0),
        "hamming": lambda: d(lambda a, b: one(a != b)) / F.size(x),
    }.get(metric)
    if found is None:
        raise ValueError(f"no metric {metric!r}; there are {METRICS}")
    return found()


def nearest_neighbors(df: DataFrame, pk: Sequence[str], focus: dict, k: int = 10, metric: str = "cosine", include_self: bool = False, array: str = "features", context: Keyed | None = None, context_columns: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows nearest to one row, by an exact scan; ties by key. The focus row is a literal of the plan.
    ``context``: a table of the same or a coarser key that the named columns are taken from."""
    cond = F.lit(True)
    for name, v in focus.items():
        cond = cond & (F.col(name) == v)
    row = df.where(cond).select(array).first()
    if row is None:
        raise ValueError(f"no row {focus}")
    target = F.array(*[F.lit(float(v)) for v in row[0]])
    rest = df if include_self else df.where(~cond)
    found = rest.select(*pk, pair_distance(F.col(array), target, metric).alias("distance")).orderBy("distance", *pk).limit(k)
    if context is None:
        return found
    if clash := {"distance", *pk} & set(context_columns):
        raise ValueError(f"context columns of the names of results: {sorted(clash)}")
    # k rows against the table: the few are broadcast, the table isn't moved
    few = found.select(*context.pk).distinct()
    held = context.view(context_columns).join(F.broadcast(few), context.pk, "left_semi").select(*context.pk, *context_columns)
    return found.join(held, context.pk, "left").orderBy("distance", *pk).select(*pk, "distance", *context_columns)


def row_names(m: Cells, name: str) -> DataFrame:
    """The key and the name of every row, from a column of the row table; a name that is null or given twice is an error."""
    named = m.rows.select(*m.pk, F.col(f"`{name}`").cast("string").alias("row_name"))
    if named.groupBy("row_name").count().where("row_name IS NULL OR count > 1").limit(1).count():
        raise ValueError("a row name that is null or isn't unique")
    return named


def rows_by_name(m: Cells, name: str, wanted: Sequence[str]) -> DataFrame:
    """``request`` (the place in ``wanted``), ``row_name`` and the key of the rows asked for; an unknown name is an error."""
    asked = m.rows.sparkSession.createDataFrame([(i, str(w)) for i, w in enumerate(wanted)], "request int, row_name string")
    found = asked.join(row_names(m, name).join(F.broadcast(asked.select("row_name").distinct()), "row_name", "left_semi"), "row_name", "left")  # names of the call
    if unknown := [r.row_name for r in found.where(F.col(m.pk[0]).isNull()).limit(5).collect()]:
        raise ValueError(f"unknown row names: {unknown}")
    return found.select("request", "row_name", *m.pk).orderBy("request")


def cells_by_row_name(m: Cells, name: str, wanted: Sequence[str]) -> DataFrame:
    """The cells of the named rows, with ``request`` and ``row_name``; a row of zeros has none."""
    return rows_by_name(m, name, wanted).join(m.cells, m.key).select("request", "row_name", *m.pk, "feature_id", "value").orderBy("request", "feature_id")


def top_features(m: Cells, n: int = 10, method: str = "value", reference: Cells | None = None, frex_weight: float = 0.7) -> DataFrame:
    """The ``n`` best features of each row: ``rank``, ``feature``, ``score``; ties by feature id."""
    cells, by_row = m.cells, Window.partitionBy(*m.pk)
    ref = (reference or m).cells
    if method in ("probability", "lift", "frex"):
        bad = cells.where((F.col("value") < 0) | F.isnan("value")).limit(1).count()
        if bad:
            raise ValueError(f"{method} needs values that aren't negative")
    p = F.col("value") / F.sum("value").over(by_row)
    if method == "value":
        scored = cells.withColumn("score", F.col("value"))
    elif method == "absolute":
        scored = cells.withColumn("score", F.abs("value"))
    elif method == "probability":
        scored = cells.withColumn("score", p)
    elif method in ("term_frequency", "document_frequency"):
        agg = F.sum("value") if method == "term_frequency" else F.count("*").cast("double")
        scored = cells.join(ref.groupBy("feature_id").agg(agg.alias("score")), "feature_id")
    elif method == "lift":
        if reference is None:
            raise ValueError("lift needs a reference")
        total = ref.agg(F.sum("value").alias("t")).first().t
        back = ref.groupBy("feature_id").agg((F.sum("value") / F.lit(total)).alias("__b"))
        scored = cells.withColumn("__p", p).join(back, "feature_id", "left")
        scored = scored.withColumn("score", F.when(F.col("__b") > 0, F.col("__p") / F.col("__b")).when(F.col("__p") > 0, F.raise_error(F.lit("a feature isn't in the reference")).cast("double")).otherwise(0.0))
    elif method == "frex":
        shares = cells.withColumn("__p", p)
        e = shares.withColumn("__e", F.col("__p") / F.sum("__p").over(Window.partitionBy("feature_id")))
        width = m.features.count()
        # the empirical distribution is over all features, implicit zeros below every stored value
        held = F.count("*").over(by_row)
        ecdf = lambda c: (F.cume_dist().over(by_row.orderBy(c)) * held + (F.lit(width) - held)) / F.lit(width)
        both = e.withColumn("__fe", ecdf("__e")).withColumn("__fp", ecdf("__p"))
        scored = both.withColumn("score", 1 / (F.lit(frex_weight) / F.col("__fe") + F.lit(1 - frex_weight) / F.col("__fp")))
    else:
        raise ValueError(f"no method {method!r}")
    ranked = scored.withColumn("rank", F.row_number().over(by_row.orderBy(F.desc("score"), "feature_id"))).where(F.col("rank") <= n)
    return ranked.join(sized(m.features), "feature_id").select(*m.pk, "rank", "feature_id", "feature", "score")


def embedding_lookup(df: DataFrame, pk: Sequence[str], field: str, table: DataFrame, name: str = "feature", array: str = "features", oov: str = "zero") -> DataFrame:
    """The vector of each row's string; unknown, null and empty ones are zeros or an error."""
    width = table.select(F.size(array).alias("n")).limit(1).collect()[0].n
    out = df.select(*pk, F.col(field).alias("__f")).join(sized(table.select(F.col(name).alias("__f"), array)), "__f", "left")
    none = F.raise_error(F.concat(F.lit("no vector for "), F.coalesce("__f", F.lit("null")))).cast("array<double>") if oov == "error" else F.array_repeat(F.lit(0.0), width)
    return out.select(*pk, F.coalesce(F.col(array).cast("array<double>"), none).alias(array))


#: Categories of a column that may become one feature each.
MOST_CATEGORIES = 50_000


def feature_matrix(df: DataFrame, pk: Sequence[str], recipe: dict[str, dict]) -> tuple[DataFrame, list[str]]:
    """Encode columns into one array: ``{column: {"encoding": raw | zscore | minmax | onehot | mapping | bins, ...}}``. Fit
    statistics are one aggregation; missing values are zeros but for raw and mapping, where they are NaN. A binned value
    outside finite edges is all zeros."""
    aggs, fitted = [], {}
    for c, r in recipe.items():
        x = F.col(f"`{c}`").try_cast("double")
        kind = r.get("encoding", "raw")
        if kind == "zscore":
            aggs += [F.avg(x).alias(f"{c}.a"), F.stddev_pop(x).alias(f"{c}.b")]
        elif kind == "minmax" or (kind == "bins" and r.get("method") in ("fixed_width", "equal_width")):
            aggs += [F.min(x).alias(f"{c}.a"), F.max(x).alias(f"{c}.b")]
        elif kind == "onehot":
            found = df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(MOST_CATEGORIES + 1).collect()
            if len(found) > MOST_CATEGORIES:
                raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories")
            fitted[f"{c}.a"] = sorted(r.v for r in found)
        elif kind == "bins" and r.get("method") == "quantile":
            k = r["n"]
            aggs.append(F.percentile_approx(x, [i / k for i in range(1, k)], 10_000).alias(f"{c}.a"))
    fit = fitted | (df.agg(*aggs).first().asDict() if aggs else {})
    parts: list[Column] = []
    names: list[str] = []
    for c, r in recipe.items():
        x, kind = F.col(f"`{c}`").try_cast("double"), r.get("encoding", "raw")
        if kind == "raw":
            parts.append(F.coalesce(x, F.lit(float("nan"))))
            names.append(c)
        elif kind == "zscore":
            sd = fit[f"{c}.b"] or 0.0
            parts.append(F.coalesce((x - fit[f"{c}.a"]) / sd, F.lit(0.0)) if sd else F.lit(0.0))
            names.append(c)
        elif kind == "minmax":
            lo, hi = fit[f"{c}.a"], fit[f"{c}.b"]
            parts.append(F.coalesce((x - lo) / (hi - lo), F.lit(0.0)) if lo is not None and hi > lo else F.lit(0.0))
            names.append(c)
        elif kind == "mapping":
            value = F.lit(float("nan"))
            for k, v in r["values"].items():
                value = F.when(F.col(f"`{c}`").cast("string") == str(k), float(v)).otherwise(value)
            parts.append(value)
            names.append(c)
        elif kind == "onehot":
            for v in fit[f"{c}.a"]:
                parts.append(F.when(F.col(f"`{c}`").cast("string") == v, 1.0).otherwise(0.0))
                names.append(f"{c}_{v}")
        elif kind == "bins":
            how, inf = r.get("method", "boundaries"), float("inf")
            if how == "boundaries":
                edges = [float(e) for e in r["edges"]]
            elif how == "quantile":
                edges = [-inf, *dict.fromkeys(fit[f"{c}.a"]), inf]
            else:
                lo, hi = fit[f"{c}.a"], fit[f"{c}.b"]
                step = r["width"] if how == "fixed_width" else (hi - lo) / r["n"]
                inner = [lo + step * i for i in range(int((hi - lo) // step) + 2)] if how == "fixed_width" else [-inf, *[lo + step * i for i in range(1, r["n"])], inf]
                edges = inner
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                parts.append(F.when((x >= a) & (x < b), 1.0).otherwise(0.0))
                names.append(f"{c}_bin_{i}")
        else:
            raise ValueError(f"no encoding {kind!r}")
    return df.select(*pk, F.array(*parts).alias("features")), names
