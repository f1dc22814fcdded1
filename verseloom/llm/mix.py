"""Mixing sources to target shares of a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.operators.prefix import with_prefix_sums
from verseloom.runtime import materialize

#: Most sources in a table of targets; it is a setting, broadcast.
MOST_SOURCES = 10_000


def source_key(name: Column) -> Column:
    """Sources are one if they differ only in letter case or in leading, trailing or repeated white space."""
    return F.lower(F.trim(F.regexp_replace(F.translate(name, "\u200b\u00ad", ""), r"(?U)[\s\u00a0]+", " ")))


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level tokenizer without merges: the UTF-8 bytes. Null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _sized(docs: DataFrame, id_col: str, source_col: str, tokens: Column, seed: int) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("__id"), source_key(F.col(f"`{source_col}`")).alias("__source"), tokens.alias("__tokens"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("__key"))


def _targets(targets: DataFrame) -> DataFrame:
    bad = targets.where("source IS NULL OR target_permille IS NULL OR max_repeats IS NULL OR budget_permille IS NULL OR target_permille < 0 OR max_repeats < 0 OR budget_permille < 0")
    if bad.limit(1).count():
        raise ValueError("a target with a null or negative value")
    if targets.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if targets.select(source_key(F.col("source"))).distinct().count() < targets.count():
        raise ValueError("a source with two targets")
    return targets.select("source", source_key(F.col("source")).alias("__source"), "target_permille", "max_repeats", "budget_permille")


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, tokens: Column, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draw a mix in which each source of ``targets`` has its share of the token budget.

    Gives ``(mix, report)``. mix: id, ``source`` (as spelled in targets), ``tokens`` and ``copies``, how many times over the
    record is in the mix. report: a row per target with ``available``, ``wanted`` (its target times the budget), ``reached``
    tokens, ``copies_most``, ``share`` (of the tokens of the mix) and ``short`` (the mix ends under what is wanted, as
    ``max_repeats`` times over isn't enough).

    Records get hash-random keys and are sorted by key within their source; distributed prefix sums of tokens — over bins
    of the key range first, then within a bin — cut each source at its exact budget, so that only one bin of ordered rows
    is ever in one task, whatever share one source has. Whole epochs come before the cut one. The last record taken is the
    one at which the budget is reached. Sources without a target are left out; records with a null source too; empty and
    null texts have no tokens and are taken when the cut passes them; ids that repeat are records of their own; equal keys
    are ordered by id.
    """
    goals = _targets(targets)
    sized = _sized(docs, id_col, source_col, tokens, seed)
    summed = materialize(sized.groupBy("__source").agg(F.sum("__tokens").alias("t"), F.count("*").alias("n")), "mix-sources")
    total, most = (summed.agg(F.sum("t").alias("t"), F.max("n").alias("n")).first() or (0, 0))
    total, most = total or 0, most or 0
    per = goals.join(summed, "__source", "left").select("__source", "source", "target_permille", "max_repeats", F.coalesce("t", F.lit(0)).alias("available"), F.floor(F.col("budget_permille") * F.lit(total) / 1000).cast("bigint").alias("budget"))
    # exact in whole numbers: everything is held in thousandths of a token
    goal = F.col("target_permille") * F.col("budget")
    per = per.withColumn("goal_milli", F.least(goal, F.col("max_repeats") * F.col("available") * 1000))
    per = per.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("goal_milli") / (F.col("available") * 1000))).otherwise(0).cast("bigint"))
    per = per.withColumn("rest_milli", F.col("goal_milli") - F.col("epochs") * F.col("available") * 1000)
    rules = F.broadcast(per)  # one row per target, at most MOST_SOURCES

    rows = with_prefix_sums(sized.join(rules, "__source"), "__source", "__tokens", "__key", "__id", most).withColumnRenamed("__before", "__start")
    copies = F.col("epochs") + F.when(F.col("__start") * 1000 < F.col("rest_milli"), 1).otherwise(0)
    mix = rows.withColumn("copies", copies).where("copies > 0").select(F.col("__id").alias(id_col), "source", F.col("__tokens").alias("tokens"), "copies")
    mix = materialize(mix, "mix")
    reached = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("copies_most"))
    whole = mix.agg(F.sum(F.col("tokens") * F.col("copies")).alias("x")).first().x or 0
    report = per.join(reached, "source", "left").select(
        "source", "available", (goal / 1000).alias("wanted"), F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("copies_most", F.lit(0)).alias("copies_most"),
        (F.coalesce("reached", F.lit(0)) / F.lit(float(whole or 1))).alias("share"), "target_permille", (F.coalesce("reached", F.lit(0)) * 1000 < goal).alias("short"),
    )
    return mix, report
