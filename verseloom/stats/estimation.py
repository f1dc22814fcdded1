"""Design-based estimation from probability samples, audits of predictions, and classification metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseloom.operators.joins import one_to_one
from verseloom.runtime import drop_materialized, materialize


#: Distinct values that one ordered window may hold.
MOST_ORDERED = 100_000


def _check_pi(df: DataFrame, pi: str = "pi") -> None:
    if df.where(F.col(pi).isNull() | (F.col(pi) <= 0) | (F.col(pi) > 1)).limit(1).count():
        raise ValueError("an inclusion probability outside (0, 1]")


def _check_finite(df: DataFrame, *columns: str) -> None:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    if df.where(bad).limit(1).count():
        raise ValueError(f"a null or infinite value in {columns}")


def census(df: DataFrame, value: str) -> DataFrame:
    """Mean and total of a complete population."""
    return df.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col(value).cast("double")).alias("total"))


def horvitz_thompson(sample: DataFrame, value: str, pi: str, population: int, known_total: float = 0.0) -> DataFrame:
    """``total`` = sum of y/pi plus known outcomes, and ``mean`` = total / N."""
    _check_pi(sample, pi)
    _check_finite(sample, value)
    total = F.coalesce(F.sum(F.col(value) / F.col(pi)), F.lit(0.0)) + known_total
    return sample.agg(total.alias("total"), F.count("*").alias("n")).withColumn("mean", F.col("total") / population).select("n", "total", "mean")


def left_weighted_quantile(df: DataFrame, value: str, p: float, weight: str | None = None) -> float | None:
    """The least y of which the weights up to it are a share ``p`` of all, or more. Values are summed first; of them, the
    few around the cut are what the window orders."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    per = df.groupBy(F.col(value).alias("y")).agg(F.sum(w).alias("w"))
    total = per.agg(F.sum("w").alias("w")).first().w
    if total is None:
        return None
    # halve the range of values, a few quantiles at a time, until the ordered rest is short at any size
    need, below, part = p * total - 1e-12 * total, 0.0, per
    while part.count() > MOST_ORDERED:
        edges = sorted(set(part.approxQuantile("y", [i / 16 for i in range(1, 17)], 0.01)))
        sums = part.agg(*[F.coalesce(F.sum(F.when(F.col("y") <= e, F.col("w"))), F.lit(0.0)).alias(f"e{i}") for i, e in enumerate(edges)]).first()
        at = next((i for i, e in enumerate(edges) if below + sums[i] >= need), len(edges))
        if at < len(edges):
            part = part.where(F.col("y") <= edges[at])
        if at:
            part, below = part.where(F.col("y") > edges[at - 1]), below + sums[at - 1]
    run = part.withColumn("c", F.lit(below) + F.sum("w").over(Window.orderBy("y")))
    return run.where(F.col("c") >= need).agg(F.min("y").alias("y")).first().y


def hypergeometric_tail(k: int, population: int, marked: int, n: int) -> float:
    """Probability of ``k`` marked units or fewer among ``n`` drawn without replacement."""
    low, high = max(0, n - (population - marked)), min(n, marked)
    if k < low:
        return 0.0
    if k >= high:
        return 1.0
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    log_p = lambda i: ln(marked, i) + ln(population - marked, n - i) - ln(population, n)
    mode = (n + 1) * (marked + 1) // (population + 2)
    upper = k >= mode  # the shorter side is summed, from its largest term outward, by the ratio of neighbours
    i, part, total = (k + 1, math.exp(log_p(k + 1)), 0.0) if upper else (k, math.exp(log_p(k)), 0.0)
    while low <= i <= high and part > total * 1e-17:
        total += part
        if upper:
            part *= (marked - i) * (n - i) / ((i + 1) * (population - marked - n + i + 1)) if i < high else 0.0
            i += 1
        else:
            part *= i * (population - marked - n + i) / ((marked - i + 1) * (n - i + 1)) if i > low else 0.0
            i -= 1
    return min(1.0, 1 - total if upper else total)


def quantile_ranks(population: int, n: int, p: float, confidence: float = 0.95) -> tuple[int | None, int | None]:
    """Ranks in a simple random sample of the ends of an interval that covers the population quantile, by hypergeometric
    tails; an end that no rank supports is None, and the other one stays. Both tails fall as the rank moves out, so each
    rank is found by bisection."""
    if not 1 <= n <= population or not 0 < p < 1 or not 0 < confidence < 1:
        raise ValueError("n must be between 1 and the population, p and confidence between 0 and 1")
    rank = max(1, math.ceil(p * population - 1e-12))
    if n == population:
        return rank, rank
    alpha = (1 - confidence) / 2

    def first(good) -> int | None:
        """The least rank from which on ``good`` holds."""
        a, b = 1, n + 1
        while a < b:
            middle = (a + b) // 2
            a, b = (a, middle) if good(middle) else (middle + 1, b)
        return a if a <= n else None

    too_high = first(lambda r: hypergeometric_tail(r - 1, population, rank, n) > alpha)
    low = n if too_high is None else too_high - 1
    high = first(lambda r: 1 - hypergeometric_tail(r - 1, population, rank - 1, n) <= alpha)
    return low or None, high


def quantile_rank_interval(population: int, n: int, p: float, confidence: float = 0.95) -> tuple[int, int] | None:
    """Both of :func:`quantile_ranks`; None where one is missing."""
    low, high = quantile_ranks(population, n, p, confidence)
    return None if low is None or high is None or low > high else (low, high)


def quantile_interval(sample: DataFrame, value: str, population: int, p: float, confidence: float = 0.95) -> tuple[float, float]:
    """The interval itself: an end without a rank is infinite. The two order statistics are found by counts of distinct
    values, see :func:`left_weighted_quantile`."""
    _check_finite(sample, value)
    n = sample.count()
    low, high = quantile_ranks(population, n, p, confidence)
    at = lambda r: left_weighted_quantile(sample, value, (r - 0.5) / n)
    return (-math.inf if low is None else float(at(low)), math.inf if high is None else float(at(high)))


def srs_variance(population: int, n: int, s2: float | None) -> float | None:
    """N²(1-n/N)s²/n; 0 for a census, None for one unit."""
    if n == population:
        return 0.0
    return None if n < 2 or s2 is None else population**2 * (1 - n / population) * s2 / n


def design_variance(audit: DataFrame, residual: str, design: str, population: int | dict, stratum: str | None = None, pi: str = "pi") -> float | None:
    """Variance of the estimated total: ``srs``, ``stratified`` or ``bernoulli``."""
    if design == "srs":
        r = audit.agg(F.count("*").alias("n"), F.var_samp(residual).alias("s2"), F.max(F.abs(F.col(pi) - F.lit(1.0) * F.lit(audit.count()) / population)).alias("off")).first()
        if r.n == 0:
            raise ValueError("an empty audit")
        if r.off > 1e-8:
            raise ValueError("pi isn't n/N")
        return srs_variance(population, r.n, r.s2)
    if design == "stratified":
        rows = {x[stratum]: x for x in audit.groupBy(stratum).agg(F.count("*").alias("n"), F.var_samp(residual).alias("s2")).collect()}  # one row per stratum
        if missing := [s for s in population if s not in rows]:
            raise ValueError(f"strata without an audit: {missing}")
        parts = [srs_variance(big, rows[s].n, rows[s].s2) for s, big in population.items()]
        return None if any(v is None for v in parts) else sum(parts)
    if design == "bernoulli":
        return audit.agg(F.sum((1 - F.col(pi)) * F.pow(F.col(residual) / F.col(pi), 2)).alias("v")).first().v or 0.0
    raise ValueError(f"no design {design!r}")


def superpopulation_variance(audit: DataFrame, value: str, design: str, population: int, pi: str = "pi") -> float:
    """What the population's own sampling adds: s²/N for simple random, its weighted form for Bernoulli samples."""
    if design == "srs":
        return (audit.agg(F.var_samp(value).alias("v")).first().v or 0.0) / population
    w = 1 / F.col(pi)
    one = audit.agg(F.sum(w).alias("w"), F.sum(w * F.col(value)).alias("wy"), F.sum(w * F.col(value) * F.col(value)).alias("wyy")).first()
    spread = one.wyy - one.wy**2 / one.w
    return one.w * spread / (population**2 * (population - 1))


def generalized_difference(surrogate: DataFrame, gold: DataFrame, pk: Sequence[str], q: str = "q", y: str = "y", pi: str = "pi", known: DataFrame | None = None) -> DataFrame:
    """Sum of predictions, plus the audited differences over pi, plus known outcomes: one row with ``population``,
    ``audit``, ``surrogate_total``, ``correction``, ``known_total``, ``total`` and ``mean``."""
    _check_pi(gold, pi)
    _check_finite(gold, y)
    frame = surrogate
    if known is not None:
        frame = surrogate.join(known.select(*pk), list(pk), "left_anti")
    _check_finite(frame, q)
    both = one_to_one(gold.select(*pk, y, pi), frame.select(*pk, q).join(gold.select(*pk), list(pk), "left_semi"), pk, "audited prediction")
    if not both.limit(1).count():
        raise ValueError("an empty audit")
    c = both.agg(F.sum((F.col(y) - F.col(q)) / F.col(pi)).alias("correction"), F.count("*").alias("audit"))
    s = frame.agg(F.sum(F.col(q).cast("double")).alias("surrogate_total"), F.count("*").alias("unknown"))
    k = (known if known is not None else surrogate.limit(0).withColumn(y, F.lit(0.0))).agg(F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("known_total"), F.count("*").alias("known"))
    one = s.crossJoin(c).crossJoin(k)  # three single rows
    total = F.col("surrogate_total") + F.col("correction") + F.col("known_total")
    return one.select((F.col("unknown") + F.col("known")).alias("population"), "audit", "surrogate_total", "correction", "known_total", total.alias("total"), (total / (F.col("unknown") + F.col("known"))).alias("mean"))


def generalized_difference_by(surrogate: DataFrame, gold: DataFrame, pk: Sequence[str], group: str, q: str = "q", y: str = "y", pi: str = "pi") -> DataFrame:
    """Per group: ``n``, ``audit``, ``total`` and ``mean``; a group without audits has no correction."""
    _check_pi(gold, pi)
    both = surrogate.select(*pk, group, q).join(gold.select(*pk, y, pi), list(pk), "left")
    part = F.coalesce(F.sum((F.col(y) - F.col(q)) / F.col(pi)), F.lit(0.0))
    out = both.groupBy(group).agg(F.count("*").alias("n"), F.count(y).alias("audit"), (F.sum(F.col(q).cast("double")) + part).alias("total"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def contrast(by_group: DataFrame, group: str, a, b) -> float:
    rows = {r[group]: r["mean"] for r in by_group.where(F.col(group).isin([a, b])).collect()}
    return rows[a] - rows[b]


def isotonic(values: Sequence[float], weights: Sequence[float] | None = None) -> list[float]:
    """Nearest non-decreasing sequence: pooled adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights or [1.0] * len(values)):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [b[0] for b in blocks for _ in range(b[2])]


def gd_quantile(surrogate: DataFrame, gold: DataFrame, pk: Sequence[str], p: float, q: str = "q", y: str = "y", pi: str = "pi") -> float:
    """Quantile of the corrected distribution function: counts of predictions up to each knot, corrected by the audit, made
    monotone (see :func:`isotonic`), ended at 1 and inverted. Knots are the distinct values, any number of them.

    The least non-decreasing fit reaches ``p`` right after the knot at which the running sum of F - p is least, so that
    the knots are only sorted by ranges and summed; the driver sees three numbers for each range."""
    _check_pi(gold, pi)
    n = surrogate.count()
    audit = gold.select(*pk, y, pi).join(surrogate.select(*pk, q), list(pk))
    steps = surrogate.select(F.col(q).cast("double").alias("t"), F.lit(1.0).alias("d")).unionByName(audit.select(F.col(y).cast("double").alias("t"), (1 / F.col(pi)).alias("d"))).unionByName(audit.select(F.col(q).cast("double").alias("t"), (-1 / F.col(pi)).alias("d")))
    knots = materialize(steps.groupBy("t").agg(F.sum("d").alias("d")), "knots")
    ranged = materialize(knots.repartitionByRange("t").withColumn("part", F.spark_partition_id()), "knot-ranges")

    def scan(start: dict):
        """Per range: its knots, the sum of its steps and of their running sums, and where the sum of F - p is least."""

        def run(key, f):
            import pandas as pd

            f = f.sort_values("t")
            s0, c0 = start.get(int(key[0]), (0.0, 0.0))
            running = s0 + f["d"].cumsum().to_numpy()
            sums = c0 + np.cumsum(running / n - (p - 1e-12))
            at = int(sums.argmin())
            follows = f["t"].iloc[at + 1] if at + 1 < len(f) else None
            return pd.DataFrame({"part": [int(key[0])], "d": [float(f["d"].sum())], "least": [float(sums[at])], "total": [float(sums[-1])], "first": [float(f["t"].iloc[0])], "follows": [follows], "last": [float(f["t"].iloc[-1])]})

        rows = ranged.groupBy("part").applyInPandas(run, "part int, d double, least double, total double, first double, follows double, last double").collect()
        return sorted(rows, key=lambda r: r.part), {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}

    plain, sizes = scan({})
    start, s, c = {}, 0.0, 0.0
    for r in plain:
        start[r.part] = (s, c)
        c += r.total + sizes[r.part] * s / n
        s += r.d
    best, answer, found = 0.0, plain[0].first, scan(start)[0]  # before the first knot the sum is 0
    for i, r in enumerate(found):
        if r.least < best:
            best = r.least
            answer = r.follows if r.follows is not None and not math.isnan(r.follows) else found[i + 1].first if i + 1 < len(found) else r.last
    drop_materialized(knots)
    drop_materialized(ranged)
    return answer


def classification(gold: DataFrame, prediction: DataFrame, pk: Sequence[str], y: str = "y", q: str = "q", pi: str | None = None) -> DataFrame:
    """Raw and 1/pi weighted two-by-two counts and metrics; 0/0 is 0. Values other than 0 and 1 and missing predictions
    are errors; predictions for other keys are ignored."""
    both = one_to_one(gold, prediction.join(gold.select(*pk), list(pk), "left_semi"), pk, "prediction")
    if both.where(~F.col(y).isin(0, 1) | ~F.col(q).isin(0, 1) | F.col(y).isNull() | F.col(q).isNull()).limit(1).count():
        raise ValueError("labels must be 0 or 1")
    if pi:
        _check_pi(gold, pi)
    made = None
    for name, w in [("raw", F.lit(1.0))] + ([("weighted", 1 / F.col(pi))] if pi else []):
        cell = lambda a, b, w=w: F.coalesce(F.sum(F.when((F.col(y) == a) & (F.col(q) == b), w)), F.lit(0.0))
        one = both.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
        over = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
        tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
        n = tp + fp + fn + tn
        one = one.select(
            F.lit(name).alias("weights"), "tp", "fp", "fn", "tn", over(tp + tn, n).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"),
            over(tn, tn + fp).alias("specificity"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp + fn, n).alias("prevalence"),
        )
        made = one if made is None else made.unionByName(one)
    return made


def estimate(sample: DataFrame, value: str, statistic: str = "mean", population: int | None = None, pi: str | None = None, p: float = 0.5) -> float | None:
    """One number: ``mean``, ``total`` or ``quantile`` of a complete population, or of a sample with inclusion
    probabilities ``pi`` (Horvitz-Thompson; quantiles by weights 1/pi)."""
    if statistic == "quantile":
        return left_weighted_quantile(sample if pi is None else sample.withColumn("__w", 1 / F.col(pi)), value, p, None if pi is None else "__w")
    if statistic not in ("mean", "total"):
        raise ValueError(f"no statistic {statistic!r}")
    if pi is None:
        return census(sample, value).first()[statistic]
    if population is None and statistic == "mean":
        raise ValueError("the mean of a sample needs the size of the population")
    return horvitz_thompson(sample, value, pi, population or 1).first()[statistic]
