"""Queries of the corpus operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseloom.llm.abuse import fit_abuse_model, labelled_sample, score_abuse
from verseloom.llm.leaks import find_leaks, find_passages
from verseloom.llm.mix import byte_tokens, mix_sources, source_key
from verseloom.llm.neardup import NearDuplicates
from verseloom.llm.proportions import proportional_samples
from verseloom.llm.sentences import sentences
from verseloom.llm.split import oversize_report, split_oversized
from verseloom.llm.terms import distinctive_terms, term_frequencies
from verseloom.runtime import count_keys, one_per_key, tune

FIELDS = ["topic_group", "region_group"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Every article once, as last delivered."""
    return one_per_key(_table(spark, sf_dir, "articles"), ["article_id"], list(columns), "ingested_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _table(spark, sf_dir, "split_limits")
    return oversize_report(split_oversized(_articles(spark, sf_dir, "text"), "article_id", "text", limits, with_text=False), "article_id", limits)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_articles(spark, sf_dir, "text"), "article_id", "text", _table(spark, sf_dir, "split_limits"))


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every split text: whether its pieces are within the limit, overlap as asked, and end where the text ends."""
    limits = _table(spark, sf_dir, "split_limits")
    texts = _articles(spark, sf_dir, "text")
    pieces = split_oversized(texts, "article_id", "text", limits, with_text=False).join(F.broadcast(limits), "limit_id")  # a setting of three rows
    after = F.lag("end_char").over(Window.partitionBy("article_id", "limit_id").orderBy("piece_no"))
    marked = pieces.withColumn("gap", after - F.col("start_char")).withColumn("fits", F.col("end_char") - F.col("start_char") <= F.col("max_chars"))
    linked = F.when(F.col("piece_no") == 0, F.col("start_char") == 0).otherwise(F.col("gap") == F.col("overlap_chars"))
    return marked.groupBy("article_id", "limit_id").agg(F.bool_and("fits").alias("fits"), F.bool_and(linked).alias("linked"), F.max("end_char").alias("chars"))


def p2_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood ratio of every term of every article; the rule of ``p2_found`` needs none."""
    scored = distinctive_terms(_articles(spark, sf_dir, "text"), "article_id", "text")
    return scored.select("article_id", "term", "tf", "records", "total", "llr", "over")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(_articles(spark, sf_dir, "text"), "article_id", "text", min_tf=3, min_records=2, max_records=6).select("article_id", "term")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(_articles(spark, sf_dir, "text"), "article_id", "text")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`p2_method` with ratios rounded, as two engines' logarithms differ in the last digits."""
    return p2_method(spark, sf_dir).withColumn("llr", F.round("llr", 2))


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return proportional_samples(_articles(spark, sf_dir, *FIELDS), "article_id", FIELDS, _table(spark, sf_dir, "sample_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)[1].where("lacking > 0").select("field", "category")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)[0]


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different articles drawn for each category."""
    return p3_sample(spark, sf_dir).groupBy("field", "category").agg(F.count_distinct("article_id").alias("drawn"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)[1]


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = count_keys(_table(spark, sf_dir, "articles"), ["article_id"])
    return term_frequencies(_articles(spark, sf_dir, "title", "text"), "article_id", ["title", "text"], n_records=n)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(_articles(spark, sf_dir, "text"), "article_id", "text", with_text=False).select("article_id", "end_char")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(_articles(spark, sf_dir, "text"), "article_id", "text")


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(_articles(spark, sf_dir, "title", "text"), "article_id", ["title", "text"], threshold=0.6)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs().select(F.col("id_a").alias("article_id_a"), F.col("id_b").alias("article_id_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).classes()


def p8_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a document holds but for a few word edits: pieces found, then verified by Myers' distance."""
    return find_passages(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an item's runs a document holds."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id", "shared", "runs", "item_words")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), "doc_id", "source", byte_tokens(F.col("text")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source: what it has and what is wanted, and whether the mix reaches that, or all that its repeats allow,
    without going further than by one document."""
    mix, report = _mixed(spark, sf_dir)
    longest = mix.groupBy("source").agg(F.max("tokens").alias("longest"))
    rules = _table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    joined = report.join(F.broadcast(rules), "source").join(longest, "source", "left")  # rules: a setting
    most = F.least(F.col("wanted"), (F.col("max_repeats") * F.col("available")).cast("double"))
    return joined.select("source", "available", F.round("wanted", 3).alias("wanted"), "short", (F.col("reached") >= most).alias("enough"), (F.col("reached") < most + F.coalesce("longest", F.lit(0)) + 1).alias("not_more"), (F.col("copies_most") <= F.col("max_repeats")).alias("repeats_kept"))


def _scored(spark: SparkSession, sf_dir: str, docs: DataFrame, *keep: str) -> DataFrame:
    model = fit_abuse_model(labelled_sample(docs, "doc_id", "text", _table(spark, sf_dir, "labels"), "toxic"))
    return score_abuse(docs, "doc_id", "text", model, keep=keep)


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and their rate for every source; a null source is one of them."""
    docs = _table(spark, sf_dir, "documents")
    scored = _scored(spark, sf_dir, docs.withColumn("source", source_key(F.col("source"))), "source")
    per = scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("int")).alias("flagged"))
    return per.withColumn("rate", F.col("flagged") / F.col("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_bounds, p2_method, p2_found, p2_terms, p2_scores, p3_found, p3_sample, p3_counts, p3_report, p4_found, p4_terms, p5_found, p5_sentences, p6_found, p6_classes, p8_method, p8_found, p8_leaks, p8_shares, p9_found, p9_mix, p9_report, p9_bounds, p10_found, p10_scores, p10_rates)
}

_CLEAN = "lower(nfc_normalize(replace(replace({}, chr(173), ''), chr(8203), '')))"
_TERMS = "regexp_extract_all(" + _CLEAN + r", '[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}\x{400}-\x{4FF}]+')"
_WORDS = "regexp_extract_all(" + _CLEAN + r", '[\p{{L}}\p{{N}}]+')"
_CATEGORY = r"regexp_replace(trim(regexp_replace(lower({}), '[\s\x{{A0}}_\-]+', ' ', 'g')), ' ?/ ?', '/', 'g')"
_SOURCE = r"trim(regexp_replace(lower({}), '[\s\x{{A0}}]+', ' ', 'g'))"
_TERM_COUNTS = f"""a AS (SELECT article_id, coalesce(any_value(title), '') || ' ' || coalesce(any_value(text), '') t FROM articles GROUP BY 1),
w AS (SELECT article_id, unnest({_TERMS.replace("{}", "t", 1)}) term FROM a),
c AS (SELECT term, count(*) occurrences, count(DISTINCT article_id) records FROM w GROUP BY 1),
m AS (SELECT c.*, CASE WHEN records <= 2 THEN 'rare' WHEN records > (SELECT count(*) FROM a) / 2.0 THEN 'common' END mark FROM c)"""

_KEYS = f"""a AS (SELECT article_id, regexp_replace({_CLEAN.format("coalesce(any_value(title), '') || ' ' || coalesce(any_value(text), '')")}, '[^\\p{{L}}\\p{{N}}]', '', 'g') s FROM articles GROUP BY 1)"""
_NEAR = """g AS (SELECT DISTINCT {id}, substr(s, i, 9) g FROM (SELECT {id}, s, unnest(range(1, length(s) - 7)) i FROM {of})),
n AS (SELECT {id}, count(*) n FROM g GROUP BY 1),
c AS (SELECT x.{id} p, y.{id} q, count(*) k FROM g x JOIN g y ON x.g = y.g AND x.{id} < y.{id} GROUP BY 1, 2),
near AS (SELECT p, q FROM c JOIN n a ON a.{id} = p JOIN n b ON b.{id} = q WHERE k >= 0.6 * (a.n + b.n - k))"""

SQL: dict[str, str] = {
    "p1_found": r"""WITH a AS (SELECT article_id, any_value(text) t FROM articles GROUP BY 1)
SELECT article_id, limit_id, 'over' AS kind FROM a, split_limits WHERE length(t) > max_chars
UNION ALL SELECT article_id, limit_id, 'unbroken' FROM a, split_limits
WHERE list_max(list_transform(regexp_split_to_array(t, '[ \t\n\r\x{A0}\x{3000}.!?。！？।؟]'), lambda x: length(x))) > max_chars""",
    "p1_bounds": "WITH a AS (SELECT article_id, any_value(text) t FROM articles GROUP BY 1) SELECT article_id, limit_id, true AS fits, true AS linked, length(t) AS chars FROM a, split_limits WHERE length(t) > max_chars",
    "p2_found": f"""WITH a AS (SELECT article_id, any_value(text) t FROM articles GROUP BY 1),
w AS (SELECT article_id, unnest({_TERMS.replace("{}", "t", 1)}) term FROM a), c AS (SELECT article_id, term, count(*) tf FROM w GROUP BY 1, 2),
d AS (SELECT term FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6) SELECT article_id, term FROM c JOIN d USING (term) WHERE tf >= 3""",
    "p2_scores": f"""WITH a AS (SELECT article_id, any_value(text) t FROM articles GROUP BY 1), w AS (SELECT article_id, unnest({_TERMS.replace("{}", "t", 1)}) term FROM a),
c AS (SELECT article_id, term, count(*) tf FROM w GROUP BY 1, 2), s AS (SELECT term, sum(tf)::BIGINT total, count(*) records FROM c GROUP BY 1), h AS (SELECT article_id, sum(tf)::BIGINT here FROM c GROUP BY 1), z AS (SELECT sum(tf)::BIGINT n FROM c),
k AS (SELECT c.article_id, c.term, c.tf, s.records, s.total, here, n, c.tf k11, total - c.tf k12, here - c.tf k21, n - here - total + c.tf k22 FROM c JOIN s USING (term) JOIN h USING (article_id), z)
SELECT article_id, term, tf, records, total, round(greatest(0, 2 * ({" + ".join(f"CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END" for x in ("k11", "k12", "k21", "k22"))} + n * ln(n) - {" - ".join(f"CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END" for x in ("total", "(n - total)", "here", "(n - here)"))})), 2) AS llr, k11 * (n - here) > k12 * here AS over FROM k""",
    "p3_found": f"""WITH a AS (SELECT article_id, any_value(topic_group) t, any_value(region_group) r FROM articles GROUP BY 1),
l AS (SELECT 'topic_group' field, t c FROM a UNION ALL SELECT 'region_group', r FROM a),
n AS (SELECT field, {_CATEGORY.format("c")} c, count(*) n FROM l GROUP BY 1, 2),
s AS (SELECT *, {_CATEGORY.format("category")} c, (sample_permille * (SELECT count(*) FROM a)) // 1000 size FROM sample_targets)
SELECT s.field, category FROM s LEFT JOIN n ON n.field = s.field AND n.c = s.c
WHERE coalesce(n.n, 0) < greatest(min_count, (target_permille * size + 999) // 1000)""",
    "p3_report": f"""WITH a AS (SELECT article_id, any_value(topic_group) t, any_value(region_group) r FROM articles GROUP BY 1),
l AS (SELECT 'topic_group' field, t c FROM a UNION ALL SELECT 'region_group', r FROM a),
n AS (SELECT field, {_CATEGORY.format("c")} c, count(*) n FROM l GROUP BY 1, 2),
s AS (SELECT *, {_CATEGORY.format("category")} c, (sample_permille * (SELECT count(*) FROM a)) // 1000 size FROM sample_targets),
k AS (SELECT s.field, category, coalesce(n.n, 0) AS available, greatest(min_count, (target_permille * size + 999) // 1000)::BIGINT AS needed FROM s LEFT JOIN n ON n.field = s.field AND n.c = s.c)
SELECT field, category, available, needed, least(available, needed) AS drawn, greatest(0, needed - available) AS lacking FROM k""",
    "p3_counts": f"""WITH a AS (SELECT article_id, any_value(topic_group) t, any_value(region_group) r FROM articles GROUP BY 1),
l AS (SELECT 'topic_group' field, t c FROM a UNION ALL SELECT 'region_group', r FROM a), n AS (SELECT field, {_CATEGORY.format("c")} c, count(*) n FROM l GROUP BY 1, 2),
s AS (SELECT *, {_CATEGORY.format("category")} c, (sample_permille * (SELECT count(*) FROM a)) // 1000 size FROM sample_targets)
SELECT s.field, category, least(n.n, greatest(min_count, (target_permille * size + 999) // 1000))::BIGINT AS drawn FROM s JOIN n ON n.field = s.field AND n.c = s.c WHERE greatest(min_count, (target_permille * size + 999) // 1000) > 0""",
    "p4_found": f"WITH {_TERM_COUNTS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": f"WITH {_TERM_COUNTS} SELECT term, occurrences, records, mark FROM m",
    "p6_found": f"""WITH {_KEYS}, {_NEAR.format(id="article_id", of="a")} SELECT p article_id_a, q article_id_b FROM near""",
    "p6_classes": f"""WITH RECURSIVE {_KEYS}, r AS (SELECT s, min(article_id) rep, count(*) copies FROM a WHERE length(s) >= 9 GROUP BY 1), {_NEAR.format(id="rep", of="r")},
b AS (SELECT p, q FROM near UNION ALL SELECT q, p FROM near), w AS (SELECT rep p, rep q FROM r UNION SELECT w.p, b.q FROM w JOIN b ON b.p = w.q),
l AS (SELECT p rep, min(q) class_id FROM w GROUP BY 1), k AS (SELECT p rep, count(*) n FROM b GROUP BY 1)
SELECT article_id, class_id, copies, coalesce(k.n, 0) AS links FROM a JOIN r USING (s) JOIN l USING (rep) LEFT JOIN k USING (rep)""",
    "p8_found": f"""WITH w AS (SELECT item_id, {_WORDS.format("text")} w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format("text")} w FROM documents),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) i FROM w)),
h AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d)),
n AS (SELECT item_id, count(*) n FROM g GROUP BY 1), c AS (SELECT doc_id, item_id, count(*) k FROM g JOIN h USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id FROM c JOIN n USING (item_id) WHERE 2 * k >= n""",
    "p8_shares": f"""WITH w AS (SELECT item_id, {_WORDS.format("text")} w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format("text")} w FROM documents),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) i FROM w)),
h AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d)),
n AS (SELECT item_id, count(*) n FROM g GROUP BY 1), c AS (SELECT doc_id, item_id, count(*) k FROM g JOIN h USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, k::INTEGER AS shared, n::INTEGER AS runs, len(w)::INTEGER AS item_words FROM c JOIN n USING (item_id) JOIN w USING (item_id) WHERE 2 * k >= n""",
    "p9_bounds": f"""WITH k AS (SELECT {_SOURCE.format("source")} s, octet_length(encode(coalesce(text, ''))) t FROM documents), z AS (SELECT sum(t) t FROM k), a AS (SELECT s, sum(t)::BIGINT t FROM k GROUP BY 1)
SELECT source, coalesce(a.t, 0) AS available, round(target_permille * ((budget_permille * z.t) // 1000) / 1000, 3)::DOUBLE AS wanted, max_repeats * coalesce(a.t, 0) * 1000 < target_permille * ((budget_permille * z.t) // 1000) AS short, true AS enough, true AS not_more, true AS repeats_kept
FROM mix_targets m LEFT JOIN a ON a.s = {_SOURCE.format("source")}, z""",
    "p9_found": f"""WITH k AS (SELECT {_SOURCE.format("source")} s, octet_length(encode(coalesce(text, ''))) t FROM documents),
z AS (SELECT sum(t) t FROM k), a AS (SELECT s, sum(t) t FROM k GROUP BY 1)
SELECT source FROM mix_targets m LEFT JOIN a ON a.s = {_SOURCE.format("source")}, z
WHERE max_repeats * coalesce(a.t, 0) * 1000 < target_permille * ((budget_permille * z.t) // 1000)""",
}
