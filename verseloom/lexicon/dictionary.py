"""Dictionaries: matching entries to features, category counts, polarity and valence."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.matrix.cells import Cells
from verseloom.operators.joins import sized
from verseloom.runtime import map_batches

#: Patterns in one dictionary.
MOST_PATTERNS = 100_000


def entry_pattern(entry: str, valuetype: str) -> str:
    """The regular expression of an entry: ``fixed``, ``glob`` (``*`` and ``?``), ``non_whitespace_glob`` or ``regex``.
    All but ``regex`` match the whole feature."""
    if valuetype == "regex":
        return entry
    if valuetype == "fixed":
        return "^" + re.escape(entry) + "$"
    any_ = {"glob": ".", "non_whitespace_glob": r"\S"}[valuetype]
    return "^" + "".join(f"{any_}*" if c == "*" else any_ if c == "?" else re.escape(c) for c in entry) + "$"


@dataclass(frozen=True)
class Dictionary:
    """Categories of entries. ``frame`` is one row for each ``entry`` and ``category``; ``provenance`` is free text fields
    such as resource, citation and licence."""

    categories: dict[str, tuple[str, ...]]
    valuetype: str = "glob"
    case_sensitive: bool = False
    name: str = ""
    provenance: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.valuetype not in ("fixed", "glob", "non_whitespace_glob", "regex"):
            raise ValueError(f"no value type {self.valuetype!r}")
        if not self.categories or any(not c or isinstance(es, str) or not es or not all(isinstance(e, str) and e for e in es) for c, es in self.categories.items()):
            raise ValueError("every category needs a name and entries that aren't empty")

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(e, c) for c, es in self.categories.items() for e in dict.fromkeys(es)], "entry string, category string")

    @classmethod
    def from_frame(cls, df: DataFrame, **options) -> "Dictionary":
        rows = df.select("entry", "category").limit(MOST_PATTERNS + 1).collect()
        if len(rows) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} entries")
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r.category, []).append(r.entry)
        return cls({c: tuple(sorted(es)) for c, es in sorted(out.items())}, **options)

    def match(self, features: DataFrame) -> DataFrame:
        """Members of every category among the features of a matrix."""
        return match_features(features, self.frame(features.sparkSession), self.valuetype, self.case_sensitive)


@dataclass(frozen=True)
class PolarityDictionary:
    """A dictionary of which categories are positive, negative and, if there is one, neutral. ``match`` adds ``pole``."""

    base: Dictionary
    positive: str = "positive"
    negative: str = "negative"
    neutral: str | None = None

    def __post_init__(self) -> None:
        named = [c for c in (self.positive, self.negative, self.neutral) if c is not None]
        if len(set(named)) < len(named) or not set(named) <= set(self.base.categories):
            raise ValueError(f"poles must be different categories of {sorted(self.base.categories)}")

    def match(self, features: DataFrame) -> DataFrame:
        c = F.col("category")
        pole = F.when(c == self.positive, "positive").when(c == self.negative, "negative").when(c == F.lit(self.neutral), "neutral")
        return self.base.match(features).withColumn("pole", pole).where("pole IS NOT NULL")


@dataclass(frozen=True)
class ValenceDictionary:
    """A finite score for each entry. ``match`` adds ``score``."""

    scores: dict[str, float]
    valuetype: str = "fixed"
    case_sensitive: bool = False
    name: str = ""
    provenance: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.scores or any(not e or not math.isfinite(float(v)) for e, v in self.scores.items()):
            raise ValueError("every entry needs a finite score")

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(e, float(v)) for e, v in self.scores.items()], "entry string, score double")

    def match(self, features: DataFrame) -> DataFrame:
        return match_features(features, self.frame(features.sparkSession), self.valuetype, self.case_sensitive)


def match_features(features: DataFrame, entries: DataFrame, valuetype: str = "glob", case_sensitive: bool = False) -> DataFrame:
    """``feature_id`` with every column of the entries (``entry`` and more) that match it. Fixed entries are an equi-join;
    patterns are tried on the vocabulary only, a block of entries against all features, never on the texts."""
    fold = (lambda c: c) if case_sensitive else F.lower
    rest = [c for c in entries.columns if c != "entry"]
    if valuetype == "fixed":
        e = entries.withColumn("__k", fold(F.col("entry")))
        return features.withColumn("__k", fold(F.col("feature"))).join(sized(e), "__k").select("feature_id", "feature", "entry", *rest).distinct()
    # patterns are a setting of at most 100,000; each batch of the vocabulary tries those whose literal beginning it has
    rows = entries.select("entry").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    flags = regex.V0 | (0 if case_sensitive else regex.IGNORECASE)
    starts: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        literal = "" if valuetype == "regex" else re.match(r"[^*?]*", r.entry).group()
        literal = literal if case_sensitive else literal.lower()
        starts.setdefault(literal[:3] if len(literal) >= 3 else "", []).append((r.entry, entry_pattern(r.entry, valuetype)))

    def run(ids: pa.Array, names: pa.Array, compiled={}):  # noqa: B006 - compiled once in a task
        out: dict[str, list] = {"feature_id": [], "feature": [], "entry": []}
        for i, name in zip(ids.to_pylist(), names.to_pylist()):
            if name is None:
                continue
            key = (name if case_sensitive else name.lower())[:3]
            for entry, pattern in (*starts.get("", ()), *(starts.get(key, ()) if key else ())):
                test = compiled.get(pattern)
                if test is None:
                    test = compiled[pattern] = regex.compile(pattern, flags)
                if test.search(name):
                    for c, v in zip(out, (i, name, entry)):
                        out[c].append(v)
        yield out

    hits = map_batches(features.select("feature_id", "feature"), run, "feature_id bigint, feature string, entry string")
    return hits.join(F.broadcast(entries.distinct()), "entry").select("feature_id", "feature", "entry", *rest).distinct()


def dictionary_counts(m: Cells, members: DataFrame) -> DataFrame:
    """Per row and ``category`` the counts of its features (a feature may be in several), all rows and categories."""
    per = m.cells.join(sized(members.select("feature_id", "category").distinct()), "feature_id").groupBy(*m.pk, "category").agg(F.sum("value").alias("n"))
    return per


def dictionary_totals(m: Cells, members: DataFrame) -> DataFrame:
    """Per row ``matched``, ``unmatched`` and ``total``; a feature counts once however many categories it is in."""
    known = members.select("feature_id").distinct().withColumn("__in", F.lit(1))
    per = m.cells.join(sized(known), "feature_id", "left").groupBy(*m.pk).agg(F.sum(F.when(F.col("__in") == 1, F.col("value")).otherwise(0.0)).alias("matched"), F.sum("value").alias("total"))
    z = F.lit(0.0)
    return m.rows.select(*m.pk).join(per, m.key, "left").select(*m.pk, F.coalesce("matched", z).alias("matched"), (F.coalesce("total", z) - F.coalesce("matched", z)).alias("unmatched"), F.coalesce("total", z).alias("total"))


def dictionary_matches(m: Cells, members: DataFrame) -> DataFrame:
    """The cells of matched features with their categories."""
    return m.cells.join(sized(members), "feature_id").orderBy(*m.pk, "feature_id")


def polarity(m: Cells, members: DataFrame, formula: str = "difference", smoothing: float = 0.5, zero_division: float = 0.0, custom: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Scores from ``pole`` (positive, negative, neutral) of features; one feature in two poles is an error."""
    if members.groupBy("feature_id").agg(F.count_distinct("pole").alias("k")).where("k > 1").limit(1).count():
        raise ValueError("a feature is in two poles")
    poles = members.select("feature_id", "pole").distinct()
    pick = lambda p: F.coalesce(F.sum(F.when(F.col("pole") == p, F.col("value"))), F.lit(0.0))
    per = m.cells.join(sized(poles), "feature_id", "left").groupBy(*m.pk).agg(pick("positive").alias("positive"), pick("negative").alias("negative"), pick("neutral").alias("neutral"), F.sum("value").alias("total"))
    out = m.rows.select(*m.pk).join(per, m.key, "left").na.fill(0.0, ["positive", "negative", "neutral", "total"])
    p, n, matched, total = F.col("positive"), F.col("negative"), F.col("positive") + F.col("negative") + F.col("neutral"), F.col("total")
    over = lambda d: F.when(d != 0, (p - n) / d).otherwise(F.lit(zero_division))
    formulas = {"difference": p - n, "log_ratio": F.ln((p + smoothing) / (n + smoothing)), "proportional": over(p + n), "matched": over(matched), "total": over(total)}
    score = custom(p, n, total) if custom else formulas[formula]
    return out.withColumn("score", score)


def valence(m: Cells, scores: DataFrame) -> DataFrame:
    """From one ``score`` per feature: weighted sum, means over matched and all, population deviation, extremes, and linear
    quartiles of the hits, each counted as often as it occurs."""
    if scores.groupBy("feature_id").agg(F.count_distinct("score").alias("k")).where("k > 1").limit(1).count():
        raise ValueError("a feature has two scores")
    hit = m.cells.join(sized(scores.select("feature_id", "score").distinct()), "feature_id")
    per = hit.groupBy(*m.pk, "score").agg(F.sum("value").alias("__c"))
    w = Window.partitionBy(*m.pk).orderBy("score")
    cum = per.withColumn("__hi", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*m.pk)))

    def quantile(q: float) -> Column:
        h = (F.col("__n") - 1) * q
        at = lambda k: F.min(F.when(F.col("__hi") > k, F.col("score")))
        a, b = at(F.floor(h)), at(F.least(F.floor(h) + 1, F.col("__n") - 1))
        return a + (b - a) * F.max(h - F.floor(h))

    s, c = F.col("score"), F.col("__c")
    mean = F.sum(s * c) / F.sum(c)
    out = cum.groupBy(*m.pk).agg(
        F.sum(s * c).alias("weighted_sum"), F.sum(c).alias("matched"), mean.alias("mean_matched"), F.sqrt(F.greatest(F.sum(s * s * c) / F.sum(c) - mean * mean, F.lit(0.0))).alias("std"),
        F.min(s).alias("min"), F.max(s).alias("max"), quantile(0.25).alias("q25"), quantile(0.5).alias("median"), quantile(0.75).alias("q75"),
    )
    total = m.cells.groupBy(*m.pk).agg(F.sum("value").alias("total"))
    joined = m.rows.select(*m.pk).join(out, m.key, "left").join(total, m.key, "left")
    return joined.withColumn("mean_all", F.when(F.col("total") > 0, F.coalesce("weighted_sum", F.lit(0.0)) / F.col("total"))).na.fill(0.0, ["weighted_sum", "matched", "total"])


def load_entries(spark, path: str, entry: str = "entry", columns: Sequence[str] = ()) -> DataFrame:
    """Dictionary entries from a CSV or Parquet file of the user's own."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return df.select(F.col(entry).alias("entry"), *columns)


def _fields(spark, path: str, least: int) -> DataFrame:
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return lines.where((F.size("f") >= least) & ~F.col("f")[0].startswith("#"))


def load_afinn(spark, path: str) -> DataFrame:
    """``entry`` and ``score`` of a file of AFINN's format: term, tab, whole number."""
    return _fields(spark, path, 2).select(F.col("f")[0].alias("entry"), F.col("f")[1].cast("double").alias("score"))


def load_vader(spark, path: str) -> DataFrame:
    """``entry`` and ``score`` (the mean rating) of a file of VADER's format: term, mean, deviation and ratings by tabs.
    The ratings of words only, without the rules for negation and emphasis."""
    return _fields(spark, path, 2).select(F.col("f")[0].alias("entry"), F.col("f")[1].cast("double").alias("score"))


def load_opinion_words(spark, positive: str, negative: str) -> DataFrame:
    """``entry`` and ``pole`` of two word lists, a word a line, with comment lines that begin with a semicolon."""
    part = lambda path, pole: spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\u0001", schema="entry string").select(F.trim("entry").alias("entry"), F.lit(pole).alias("pole")).where("entry <> '' AND NOT startswith(entry, ';')")
    return part(positive, "positive").unionByName(part(negative, "negative"))


def load_sense_scores(spark, path: str) -> DataFrame:
    """Scores of word senses in SentiWordNet's format (part of speech, number, positive, negative, terms with sense
    numbers, gloss, by tabs): ``entry`` is the sense's name such as ``happy.a.01``, with ``positive``, ``negative`` and
    ``objective``."""
    f = F.col("f")
    first = F.split(F.split(f[4], " ")[0], "#")
    rows = _fields(spark, path, 5).select(F.concat_ws(".", F.lower(first[0]), f[0], F.lpad(first[1], 2, "0")).alias("entry"), f[2].cast("double").alias("positive"), f[3].cast("double").alias("negative"))
    return rows.where("positive IS NOT NULL AND negative IS NOT NULL").withColumn("objective", 1 - F.col("positive") - F.col("negative"))
