"""Union, subsets, samples, splits and new keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.operators.keyed import POSITION, Keyed, assert_unique, hash_sample, with_position
from verseloom.operators.prefix import with_prefix_sums


def merge(sources: Sequence[Keyed]) -> Keyed:
    """Disjoint union: source order, then row order. Same key and same columns; a key in two sources is an error."""
    if len(sources) < 2:
        raise ValueError("a merge needs two sources")
    flat = [b for s in sources for b in (s.bases if s.mode == "merged_key" else [s])]
    shape = lambda s: {c: g for c, g in s.all_columns().items()}
    if any(s.pk != flat[0].pk or shape(s) != shape(flat[0]) for s in flat):
        raise ValueError("sources differ in key or columns")
    parts = [s.keys().select(*s.pk, F.concat(F.array(F.lit(i).cast("bigint")), s.order_array()).alias(POSITION)) for i, s in enumerate(flat)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    assert_unique(union, flat[0].pk)
    return flat[0].derive(union, "merged_key", bases=flat)


def subset(source: Keyed, predicate: Column | str | Callable, columns: Sequence[str] | None = None) -> Keyed:
    """Rows for which the predicate holds: a column expression, SQL, or a function of a pandas batch that gives one
    boolean per row (null and other lengths are errors)."""
    cols = list(columns or [c for c, g in source.all_columns().items() if g != "key"])
    view = source.view(cols)
    if callable(predicate) and not isinstance(predicate, Column):
        keys = source.key_columns

        source_pk = list(source.pk)

        def run(frames):
            for f in frames:
                mask = predicate(f[[*source_pk, *cols]])
                if not hasattr(mask, "__len__") or len(mask) != len(f):
                    raise ValueError("the predicate must give one boolean per row")
                mask = pd.Series(list(mask), index=f.index)
                if mask.isna().any() or not mask.map(lambda v: isinstance(v, bool) or type(v).__name__ == "bool").all():
                    raise ValueError("the predicate must give booleans without nulls")
                yield f.loc[mask.astype(bool), keys]

        list(run([view.limit(2).toPandas()]))  # a function of the wrong shape shows at once
        kept = view.mapInPandas(run, view.select(*keys).schema)
    else:
        kept = view.where(predicate).select(*source.key_columns)
    return source.derive(kept, "preserved_key")


def sample(source: Keyed, n: int, seed: int = 0) -> Keyed:
    """``n`` rows without replacement, in source order."""
    if not 0 < n <= source.df.count():
        raise ValueError("n must be between 1 and the number of rows")
    return source.derive(hash_sample(source.keys(), n, None, seed, source.pk), "preserved_key")


def largest_remainder(shares: Sequence[float], n: int) -> list[int]:
    """Whole numbers that sum to ``n``: floors, then one more for the largest fractions, earlier ones first."""
    exact = [s * n for s in shares]
    out = [math.floor(x + 1e-9) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (-(exact[i] - out[i]), i))[: n - sum(out)]:
        out[i] += 1
    return out


def _ranked(units: DataFrame, strata: Sequence[str], unit: Sequence[str], seed: int) -> tuple[DataFrame, dict]:
    """Random rank of each unit in its stratum, and the strata's sizes (as many as there are strata, at the driver)."""
    keyed = units.withColumn("__s", F.concat_ws("\u001f", *[F.coalesce(F.col(s).cast("string"), F.lit("\u0000")) for s in strata]) if strata else F.lit(""))
    keyed = keyed.withColumn("__k", F.xxhash64(F.lit(seed), *unit)).withColumn("__one", F.lit(1).cast("bigint")).withColumn("__tie", F.concat_ws("\u001f", *[F.col(u).cast("string") for u in unit]))
    sizes = {r["__s"]: r["count"] for r in keyed.groupBy("__s").count().limit(100_001).collect()}
    if len(sizes) > 100_000:
        raise ValueError("more than 100,000 strata")
    return with_prefix_sums(keyed, "__s", "__one", "__k", "__tie", max(sizes.values(), default=0), "__rank").drop("__k", "__one", "__tie"), sizes


def split(source: Keyed, labels: Sequence[str], proportions: Sequence[float], seed: int = 0, by: Sequence[str] = (), stratify: Sequence[str] = ()) -> dict[str, Keyed]:
    """Random parts by proportions, per stratum by largest remainder. ``by`` keeps units whole: the proportions are then
    over units, and a unit in two strata is an error."""
    if abs(sum(proportions) - 1) > 1e-9 or len(labels) != len(proportions):
        raise ValueError("proportions must be as many as labels and sum to 1")
    unit = list(by or source.pk)
    units = source.view([c for c in (*by, *stratify) if c not in source.pk]).select(*dict.fromkeys([*unit, *stratify])).distinct()
    if by and stratify:
        assert_unique(units, unit, "unit across strata")
    ranked, sizes = _ranked(units, list(stratify), unit, seed)
    cuts = [(s, i, sum(c[:i]), sum(c[: i + 1])) for s, n in sizes.items() for c in [largest_remainder(proportions, n)] for i in range(len(c))]
    table = source.df.sparkSession.createDataFrame(cuts, "__s string, __part int, __lo bigint, __hi bigint")
    placed = ranked.join(F.broadcast(table), "__s").where("__rank >= __lo AND __rank < __hi").select(*unit, "__part")  # strata times labels
    keys = source.view([c for c in by if c not in source.pk]).join(placed, unit).select(*source.key_columns, "__part")
    return {label: source.derive(keys.where(F.col("__part") == i).select(*source.key_columns), "preserved_key") for i, label in enumerate(labels)}


def probability_sample(source: Keyed, n: int | None = None, fraction: float | None = None, probability: float | None = None, strata: Sequence[str] = (), n_by_stratum: dict | None = None, seed: int = 0) -> tuple[Keyed, Keyed, Keyed]:
    """``(sample, remainder, pi)``: simple random, stratified or Bernoulli. ``pi`` owns the inclusion probability."""
    if sum(x is not None for x in (n, fraction, probability, n_by_stratum)) != 1:
        raise ValueError("give one of n, fraction, probability and n_by_stratum")
    total = source.df.count()
    if probability is not None:
        if not 0 < probability < 1:
            raise ValueError("a probability is between 0 and 1")
        u = (F.pmod(F.xxhash64(F.lit(seed), *source.pk), F.lit(1 << 53)) / F.lit(float(1 << 53))) < probability
        drawn = source.keys().withColumn("pi", F.lit(float(probability))).withColumn("__in", u)
    else:
        if fraction is not None:
            n = math.floor(fraction * total + 0.5)
        ranked, sizes = _ranked(source.view([s for s in strata if s not in source.pk]), list(strata), source.pk, seed)
        if n_by_stratum is not None:
            quota = {s: n_by_stratum.get(s, 0) for s in sizes}
        else:
            if not 0 < n < total:
                raise ValueError("the sample must be smaller than the source and not empty")
            names = sorted(sizes)
            quota = dict(zip(names, largest_remainder([sizes[s] / total for s in names], n)))
        if any(not 0 < q <= sizes[s] for s, q in quota.items()):
            raise ValueError(f"no sample of these sizes: {quota} of {sizes}")
        table = source.df.sparkSession.createDataFrame([(s, q, q / sizes[s]) for s, q in quota.items()], "__s string, __q bigint, pi double")
        drawn = ranked.join(F.broadcast(table), "__s").withColumn("__in", F.col("__rank") < F.col("__q"))  # one row per stratum
    part = lambda cond: source.derive(drawn.where(cond).select(*source.key_columns), "preserved_key")
    pi = source.derive(drawn.where("__in").select(*source.key_columns, "pi"), "preserved_key", data=["pi"])
    return part("__in"), part("NOT __in"), pi


def probability_split(source: Keyed, n: int, strata: Sequence[str] = (), allocation: str | dict = "proportional", seed: int = 0) -> dict[str, Keyed]:
    """``sample``, ``remainder`` and ``pi`` of a simple random sample of ``n`` rows or a stratified one: ``proportional``
    (largest remainder), ``equal`` (ties to the first strata by name) or given numbers that sum to ``n``. A stratum without
    a row in the sample, or with more than it has, is an error."""
    if not strata or allocation == "proportional":
        parts = probability_sample(source, n=n, strata=strata, seed=seed)
    else:
        view = source.view([s for s in strata if s not in source.pk])
        name = F.concat_ws("\u001f", *[F.coalesce(F.col(s).cast("string"), F.lit("\u0000")) for s in strata])
        names = sorted(r.s for r in view.select(name.alias("s")).distinct().limit(100_001).collect())  # one row per stratum
        if allocation == "equal":
            given = {s: n // len(names) + (i < n % len(names)) for i, s in enumerate(names)}
        elif isinstance(allocation, dict):
            given = {"\u001f".join(map(str, k if isinstance(k, tuple) else (k,))): v for k, v in allocation.items()}
            if sum(given.values()) != n or set(given) != set(names):
                raise ValueError("the numbers must be for all strata and sum to n")
        else:
            raise ValueError(f"no allocation {allocation!r}")
        parts = probability_sample(source, strata=strata, n_by_stratum=given, seed=seed)
    return dict(zip(("sample", "remainder", "pi"), parts))


def set_primary_keys(source: Keyed, levels: dict[str, str], leaf: str) -> Keyed:
    """New keys from columns: each level is the dense rank of its column's values within the levels before, the leaf the
    rank by position within all of them. Ranks are made over distinct values, so no task sees a whole level."""
    cols = list(levels.values())
    if {*levels, leaf} & {*source.pk, *cols}:
        raise ValueError("new key names must differ from the old keys and the level columns")
    view = source.positioned([c for c in cols if c not in source.pk])
    bad = view.where(" OR ".join(f"`{c}` IS NULL" for c in cols)).limit(1).count()
    if bad:
        raise ValueError("a level is null")
    out = view
    for i, (name, col) in enumerate(levels.items()):
        above = cols[:i]
        values = view.select(*above, col).distinct()
        if above:
            ranked = values.withColumn(name, (F.row_number().over(Window.partitionBy(*above).orderBy(col)) - 1).cast("bigint"))
        else:
            ranked = with_position(values, [col], name)
        out = out.join(ranked, [*above, col])
    per = out.groupBy(*levels).count().agg(F.max("count").alias("n")).first().n or 0
    grouped = out.withColumn("__g", F.concat_ws(",", *levels)).withColumn("__one", F.lit(1).cast("bigint"))
    total = source.positions().agg(F.max(POSITION).alias("n")).first().n or 0
    scaled = grouped.withColumn("__k", ((F.col(POSITION) / F.lit(max(1, total + 1)) - 0.5) * F.lit(float(1 << 63))).cast("bigint"))
    leafed = with_prefix_sums(scaled, "__g", "__one", "__k", POSITION, per, leaf)
    pk = [*levels, leaf]
    keyed = leafed.select(*pk, POSITION, *[F.col(k).alias(f"__old_{k}") for k in source.pk])
    bridge = keyed.select(*pk, *[F.col(f"__old_{k}").alias(k) for k in source.pk])
    return source.derive(keyed.select(*pk, POSITION), "rekeyed_key", pk=pk, bridge=bridge)
