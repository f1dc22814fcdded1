"""Queries of the library's own operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseloom.functions import text as X
from verseloom.lexicon import dictionary as L
from verseloom.matrix import cells as M
from verseloom.ml import models as ML
from verseloom.operators import aggregate as A
from verseloom.operators import joins as J
from verseloom.operators import setops as S
from verseloom.operators.hierarchy import Hierarchy, first_parents
from verseloom.operators.keyed import POSITION, Keyed, map_rows, sql_over
from verseloom.operators.scope import Scope, scatter_rows
from verseloom.plans.workspace import Workspace
from verseloom.runtime import application_dir, tune
from verseloom.sources import readers as R
from verseloom.stats import estimation as E
from verseloom.streaming.incremental import follow, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 4):
    return F.round(c, digits)


#: White space as the JVM's Unicode class has it, for patterns of the SQL side.
_W = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


_LINES = f"""p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i FROM documents),
s AS (SELECT doc_id, i, {_strip("l")} t FROM p), lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 line_id, t FROM s WHERE t <> '')"""
_WORDS = f"len(list_filter(regexp_split_to_array(t, '{_W}+'), lambda x: x <> ''))"


def _documents(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("text", "lang", "source", "n_chars", "record_type")) -> Keyed:
    return Keyed.of(_table(spark, sf_dir, "documents"), ["doc_id"], [c for c in columns if c == "text"], [c for c in columns if c != "text"], name="documents")


def _lines(spark: SparkSession, sf_dir: str) -> Keyed:
    return X.decompose(_documents(spark, sf_dir), "text", "\n", "line_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under a real key: ``l_orderkey`` and a rank over all columns."""
    li = _table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*[c for c in li.columns if c != "l_orderkey"])
    return li.withColumn("item", (F.row_number().over(w) - 1).cast("bigint"))


_ITEMS = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 item FROM lineitem)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"), "label")


_CELLS = "c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) - 1 f FROM embeddings)"
_BOW = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_\p{Pc}\x{200C}\x{200D}]+')) term FROM documents),
tf AS (SELECT doc_id, term, count(*)::DOUBLE value FROM w WHERE length(term) >= 2 GROUP BY 1, 2),
voc AS (SELECT term FROM tf GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT tf.* FROM tf JOIN voc USING (term))"""


def _bag(spark: SparkSession, sf_dir: str, **options) -> M.Cells:
    return M.count_vectorize(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", min_df=5, **options)


def _named(m: M.Cells) -> DataFrame:
    return m.cells.join(J.sized(m.features), "feature_id")


# -- flagship ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_LINES}, g AS (SELECT doc_id, count(*) n_rows, sum(length(t))::DOUBLE chars_sum, max({_WORDS})::BIGINT words_max, arg_min(t, line_id) first_line, count(DISTINCT t) distinct_lines FROM lines GROUP BY 1)
SELECT g.*, l.quality, l.toxic FROM g LEFT JOIN labels l USING (doc_id)"""
)
def line_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into lines, measured, rolled up to the document and joined with its labels."""
    lines = _lines(spark, sf_dir)
    measured = lines.derive(lines.df.withColumns({"chars": X.text_length(F.col("text")), "words": X.text_length(F.col("text"), "words")}), "preserved_key", data=["text", "chars", "words"])
    rolled = A.aggregate(measured, ["doc_id"], data={"chars_sum": A.Agg("chars", "sum"), "words_max": A.Agg("words", "max"), "first_line": A.Agg("text", "first"), "distinct_lines": A.Agg("text", "nunique")})
    labels = Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"], name="labels")
    return rolled.query(["n_rows", "chars_sum", "words_max", "first_line", "distinct_lines", "quality", "toxic"], with_tables=[(labels, ["quality", "toxic"])], ordered=False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rollup(spark, sf_dir)


# -- reading ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents WHERE record_type = 'post' AND n_chars > 500")
def filter_project(spark, sf_dir):
    """A filter on a column that isn't projected."""
    return _documents(spark, sf_dir).query(["lang", "n_chars"], where="record_type = 'post' AND n_chars > 500", ordered=False)


@query("SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25")
def sort_top_k(spark, sf_dir):
    return _documents(spark, sf_dir).query(["n_chars", "lang"], order_by=["n_chars desc", "doc_id"], limit=25)


@query("WITH p AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 n FROM documents) SELECT doc_id, source FROM p WHERE n IN (7, 3, 90) UNION ALL SELECT doc_id, source FROM p WHERE n = 3")
def read_positions(spark, sf_dir):
    return _documents(spark, sf_dir).query(["source"], positions=[7, 3, 90, 3])


@query("WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 n FROM documents), m AS (SELECT n FROM p ORDER BY n LIMIT 1 OFFSET 40) SELECT doc_id, lang FROM p, m WHERE p.n BETWEEN m.n - 3 AND m.n + 2")
def read_context(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    key = docs.at(40).select("doc_id").first().doc_id
    return docs.context({"doc_id": key}, before=3, after=2, columns=["lang"])


@query("WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 n FROM documents) SELECT doc_id, lang FROM p WHERE n >= 10 AND n < 20")
def read_slice(spark, sf_dir):
    return _documents(spark, sf_dir).at(slice(10, 20), ["lang"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels)")
def point_lookup(spark, sf_dir):
    t = Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"])
    return t.get(t.df.agg(F.min("doc_id")).first()[0], ["quality"])


@query("SELECT CAST(floor(count(*) * 0.25 + 0.5) AS BIGINT) n_rows, CAST(floor(count(*) * 0.25 + 0.5) AS BIGINT) n_keys, 0 AS n_short FROM documents WHERE n_chars > 200")
def sampled_rows(spark, sf_dir):
    """A seeded quarter of what is filtered: its size, its different keys, and rows that the filter should have left out."""
    got = _documents(spark, sf_dir).query(["n_chars"], where="n_chars > 200", sample_frac=0.25, seed=5)
    return got.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"), F.count_if(F.col("n_chars") <= 200).cast("int").alias("n_short"))


@query("SELECT l.quality, d.record_type, count(*) n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def project_sql(spark, sf_dir):
    tables = {"documents_": _documents(spark, sf_dir), "labels_": Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"])}
    return sql_over(spark, tables, "SELECT l.quality, d.record_type, count(*) n FROM documents_ d JOIN labels_ l USING (doc_id) GROUP BY ALL")


# -- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(spark, sf_dir):
    joined = J.join(_documents(spark, sf_dir), Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"]))
    return joined.query(["lang", "quality", "toxic"], ordered=False)


@query("SELECT l_orderkey, count(*) n, max(o_orderpriority) priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def attach_coarser(spark, sf_dir):
    items = Keyed.of(_items(spark, sf_dir), ["l_orderkey", "item"], ["l_quantity"])
    orders = Keyed.of(_table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"], name="orders")
    out = J.attach(items.df, items.pk, orders, ["o_orderpriority"])
    return out.where("o_orderpriority IS NOT NULL").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("priority"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def attach_chain(spark, sf_dir):
    """Coarser tables attached one after the other: nations to customers, regions to both."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    customers = Keyed.of(c.withColumnRenamed("c_nationkey", "n_nationkey"), ["n_nationkey", "c_custkey"], [])
    nations, regions = Keyed.of(n, ["n_nationkey"], name="nation"), Keyed.of(r.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], name="region")
    placed = J.attach(customers.df, customers.pk, nations, ["n_name", "n_regionkey"])
    return J.attach(placed, ["n_regionkey", *customers.pk], regions, ["r_name"]).select("c_custkey", "n_name", "r_name")


@query(f"WITH {_LINES} SELECT doc_id, line_id FROM lines WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def restrict_rows(spark, sf_dir):
    domain = S.subset(Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"]), "toxic = 1")
    return J.restrict(_lines(spark, sf_dir), domain).df.select("doc_id", "line_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)")
def select_by_keys(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    keys = [r.doc_id for r in docs.query([], limit=5).collect()]
    return J.select_keys(docs, keys[::-1]).query(["source"])


@query("SELECT doc_id, quality FROM labels WHERE quality >= 4")
def keyed_frame(spark, sf_dir):
    frame = _table(spark, sf_dir, "labels").where("quality >= 4")
    return J.from_keyed_frame(_documents(spark, sf_dir), frame, ["quality"]).query(["quality"], ordered=False)


# -- set operations, samples, keys -----------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars IS NULL OR n_chars < 700, doc_id) - 1 AS position, lang FROM documents")
def merge_disjoint(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    merged = S.merge([S.subset(docs, "n_chars >= 700"), S.subset(docs, "n_chars IS NULL OR n_chars < 700")])
    return merged.positioned(["lang"]).select("doc_id", F.col(POSITION).alias("position"), "lang")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars % 2 = 0")
def subset_function(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return S.subset(docs, lambda f: (f["n_chars"] % 2 == 0).fillna(False).astype(bool), ["n_chars"]).query(["n_chars"], ordered=False)


@query(
    """WITH s AS (SELECT record_type, count(*) n FROM documents GROUP BY 1), c AS (SELECT *, (8 * n) // 10 a, (2 * n) // 10 b, n - (8 * n) // 10 - (2 * n) // 10 rest, (8 * n) % 10 >= (2 * n) % 10 first FROM s)
SELECT record_type, 'train' AS part, a + CASE WHEN first THEN rest ELSE 0 END AS n FROM c UNION ALL SELECT record_type, 'test', b + CASE WHEN first THEN 0 ELSE rest END FROM c"""
)
def split_counts(spark, sf_dir):
    """Sizes of the parts of a stratified split, by largest remainder in every stratum."""
    docs = _documents(spark, sf_dir)
    parts = S.split(docs, ["train", "test"], [0.8, 0.2], seed=3, stratify=["record_type"])
    sized = [p.view(["record_type"]).groupBy("record_type").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, p in parts.items()]
    return sized[0].unionByName(sized[1]).where("n > 0").select("record_type", "part", "n")


@query("SELECT CAST(floor(count(*) * 0.1 + 0.5) AS BIGINT) n, round(floor(count(*) * 0.1 + 0.5) / count(*), 6) pi FROM documents")
def probability_design(spark, sf_dir):
    _, _, pi = S.probability_sample(_documents(spark, sf_dir), fraction=0.1, seed=2)
    return pi.df.groupBy(_r("pi", 6).alias("pi")).agg(F.count("*").alias("n")).select("n", "pi")


@query(
    """WITH d AS (SELECT doc_id, coalesce(record_type, '-') t, coalesce(lang, '-') g FROM documents), a AS (SELECT *, dense_rank() OVER (ORDER BY t) - 1 type_id FROM d),
b AS (SELECT *, dense_rank() OVER (PARTITION BY t ORDER BY g) - 1 lang_id FROM a) SELECT type_id, lang_id, row_number() OVER (PARTITION BY t, g ORDER BY doc_id) - 1 AS leaf_id, doc_id FROM b"""
)
def rekey(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("record_type", F.lit("-")).alias("t"), F.coalesce("lang", F.lit("-")).alias("g"))
    keyed = S.set_primary_keys(Keyed.of(docs, ["doc_id"]), {"type_id": "t", "lang_id": "g"}, "leaf_id")
    return keyed.bridge.select("type_id", "lang_id", "leaf_id", "doc_id")


@query("SELECT doc_id, text IS NOT NULL AS has_text, lang FROM documents")
def rekey_inherits(spark, sf_dir):
    """Columns cross a change of keys."""
    docs = Keyed.of(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce("record_type", F.lit("-")).alias("t"), F.col("doc_id").alias("old")), ["doc_id"])
    keyed = S.set_primary_keys(docs, {"type_id": "t"}, "leaf_id")
    return keyed.view(["old", "text", "lang"]).select(F.col("old").alias("doc_id"), F.col("text").isNotNull().alias("has_text"), "lang")


# -- aggregation -----------------------------------------------------------------------------------------------------

_PRE = f"WITH {_ITEMS}"


@query(
    f"""{_PRE} SELECT l_orderkey, count(*) n_rows, arg_min(l_returnflag, item) flag_first, arg_max(l_returnflag, item) flag_last, min(l_shipdate) ship_min, max(l_shipdate) ship_max,
round(avg(l_quantity), 4) qty_mean, round(median(l_quantity), 4) qty_median, round(sum(l_quantity), 4) qty_sum, count(l_tax) tax_count, count(DISTINCT l_partkey) part_nunique, count(DISTINCT l_linestatus) <= 1 status_equal FROM li GROUP BY 1"""
)
def reducers_basic(spark, sf_dir):
    items = Keyed.of(_items(spark, sf_dir), ["l_orderkey", "item"])
    rules = {"flag_first": ("l_returnflag", "first"), "flag_last": ("l_returnflag", "last"), "ship_min": ("l_shipdate", "min"), "ship_max": ("l_shipdate", "max"), "qty_mean": ("l_quantity", "mean"), "qty_median": ("l_quantity", "median"), "qty_sum": ("l_quantity", "sum"), "tax_count": ("l_tax", "count"), "part_nunique": ("l_partkey", "nunique"), "status_equal": ("l_linestatus", "all_equal")}
    out = A.grouped(items.df, ["l_orderkey"], {o: A.Agg(*r) for o, r in rules.items()}, F.col("item"))
    return out.withColumns({c: _r(c) for c in ("qty_mean", "qty_median", "qty_sum")})


@query(
    f"""{_PRE}, k AS (SELECT l_orderkey, l_returnflag v, count(*) n, min(item) f FROM li GROUP BY 1, 2), m AS (SELECT l_orderkey, arg_min(v, (-n, f)) flag_mode FROM k GROUP BY 1),
u AS (SELECT l_orderkey, string_agg(v, '|' ORDER BY f) flag_unique FROM k GROUP BY 1)
SELECT li.l_orderkey, count(*) n_rows, string_agg(l_returnflag, '|' ORDER BY item) flag_concat, any_value(flag_mode) flag_mode, any_value(flag_unique) flag_unique, bool_or(l_quantity > 49) big_any, bool_and(l_quantity > 5) big_all FROM li JOIN m USING (l_orderkey) JOIN u USING (l_orderkey) GROUP BY 1"""
)
def reducers_ordered(spark, sf_dir):
    df = _items(spark, sf_dir).withColumns({"b1": F.col("l_quantity") > 49, "b2": F.col("l_quantity") > 5})
    rules = {"flag_concat": A.Agg("l_returnflag", "concat", "|"), "flag_mode": A.Agg("l_returnflag", "mode"), "flag_unique": A.Agg("l_returnflag", "unique"), "big_any": A.Agg("b1", "any"), "big_all": A.Agg("b2", "all")}
    return A.grouped(df, ["l_orderkey"], rules, F.col("item")).withColumn("flag_unique", F.array_join("flag_unique", "|"))


@query(
    """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 seq FROM events),
n AS (SELECT *, CASE WHEN seq = 0 OR event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) THEN 1 ELSE 0 END x FROM e),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY seq) run FROM n)
SELECT user_id, min(seq) seq_start, max(seq) seq_end, any_value(event_type) event_type, count(*) n_rows, round(sum(value), 4) value_sum FROM r GROUP BY user_id, run"""
)
def collapse_event_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events").withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).select("user_id", "seq", "event_type", "value")
    runs = A.collapse_runs(Keyed.of(e, ["user_id", "seq"]), ["event_type"], data={"value_sum": A.Agg("value", "sum")})
    return runs.df.select("user_id", "seq_start", "seq_end", "event_type", "n_rows", _r("value_sum").alias("value_sum"))


@query("SELECT coalesce(lang, '<NA>') lang, record_type, count(*) n FROM documents GROUP BY 1, 2 UNION ALL SELECT 'All', record_type, count(*) FROM documents GROUP BY 2 UNION ALL SELECT coalesce(lang, '<NA>'), 'All', count(*) FROM documents GROUP BY 1 UNION ALL SELECT 'All', 'All', count(*) FROM documents")
def crosstab(spark, sf_dir):
    return A.crosstab(_table(spark, sf_dir, "documents"), "lang", "record_type", margins=True, dropna=False)


@query("SELECT CASE WHEN n_chars IS NULL THEN -2 WHEN n_chars < 0 THEN -1 WHEN n_chars > 4000 THEN 8 ELSE least(7, n_chars // 500) END::INTEGER AS bin, count(*) n FROM documents GROUP BY 1")
def histogram(spark, sf_dir):
    return A.histogram(_table(spark, sf_dir, "documents"), "n_chars", [500 * i for i in range(9)]).where("n > 0").select("bin", "n")


@query(
    f"""WITH g AS (SELECT {_strip("text")} t, count(*) n FROM documents GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS "rows", coalesce(sum(n) FILTER (t IS NULL), 0)::BIGINT missing, coalesce(sum(n) FILTER (t = ''), 0)::BIGINT "empty",
coalesce(sum(n) FILTER (t <> ''), 0)::BIGINT nonempty, count(*) FILTER (t <> '') "unique", count(*) FILTER (t <> '' AND n > 1) duplicate_groups, coalesce(sum(n) FILTER (t <> '' AND n > 1), 0)::BIGINT duplicate_rows, coalesce(sum(n - 1) FILTER (t <> '' AND n > 1), 0)::BIGINT duplicate_excess FROM g"""
)
def text_diagnostics(spark, sf_dir):
    return A.text_diagnostics(_table(spark, sf_dir, "documents"), "text")


# -- text ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '(?i)subject: ([^\n\r]*)', 'S=\1', 'g') AS clean FROM documents""")
def regex_clean(spark, sf_dir):
    rules = [X.Rule(r"[0-9]+", "#"), X.Rule(r"subject: ([^\n\r]*)", r"S=\1", flags="I")]
    return _table(spark, sf_dir, "documents").select("doc_id", X.regex_clean(F.col("text"), rules, strip_result=False).alias("clean"))


@query(r"""SELECT doc_id, CASE WHEN regexp_full_match(source, '[A-Z][a-z]+ [A-Z][a-z]+') THEN regexp_extract(source, '^([A-Z][a-z]+)', 1) ELSE '?' END AS house, CASE WHEN regexp_full_match(source, '[A-Z][a-z]+ [A-Z][a-z]+') THEN regexp_extract(source, '([A-Z][a-z]+)$', 1) ELSE '?' END AS section FROM documents""")
def extract_pattern(spark, sf_dir):
    return X.extract_pattern(_table(spark, sf_dir, "documents"), "source", r"(?P<data_house>[A-Z][a-z]+) (?P<metadata_section>[A-Z][a-z]+)", fill_value="?").select("doc_id", "house", "section")


@query(f"WITH {_LINES} SELECT doc_id, line_id, t AS text FROM lines")
def decompose_lines(spark, sf_dir):
    return _lines(spark, sf_dir).df.select("doc_id", "line_id", "text")


@query(f"SELECT doc_id, length(t)::BIGINT n_characters, {_WORDS}::BIGINT n_words, round(ln(1 + {_WORDS}), 6) log_words FROM (SELECT doc_id, coalesce(text, '') t FROM documents)")
def text_lengths(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", X.text_length(t).alias("n_characters"), X.text_length(t, "words").alias("n_words"), _r(X.text_length(t, "log_words"), 6).alias("log_words"))


@query(r"""SELECT doc_id, count(*) hits FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}_]+', '  ', 'g') , '(?:^| )(?i:council)(?: |$)')) FROM documents) GROUP BY 1""")
def kwic_counts(spark, sf_dir):
    return X.kwic(_table(spark, sf_dir, "documents"), ["doc_id"], "text", "council").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query()
def kwic_contexts(spark, sf_dir):
    return X.kwic(_table(spark, sf_dir, "documents"), ["doc_id"], "text", "counc*", window=4, valuetype="glob")


@query()
def rule_tokens(spark, sf_dir):
    return X.linguistic_tokens(_table(spark, sf_dir, "documents"), ["doc_id"], "text")


# -- bags of words and matrices ----------------------------------------------------------------------------------------


@query(f"WITH {_BOW} SELECT doc_id, term AS feature, value::BIGINT n FROM c")
def count_vectors(spark, sf_dir):
    return _named(_bag(spark, sf_dir)).select("doc_id", "feature", F.col("value").cast("bigint").alias("n"))


@query(f"WITH {_BOW} SELECT row_number() OVER (ORDER BY term) - 1 AS feature_id, term AS feature FROM voc")
def vocabulary(spark, sf_dir):
    return _bag(spark, sf_dir).features


@query(f"WITH {_BOW}, n AS (SELECT count(*) n FROM documents), d AS (SELECT term, count(*) df FROM c GROUP BY 1) SELECT doc_id, term AS feature, round(value * (ln((1.0 + n.n) / (1 + df)) + 1), 4) score FROM c JOIN d USING (term), n")
def tfidf(spark, sf_dir):
    return _named(M.tfidf(_bag(spark, sf_dir))).select("doc_id", "feature", _r("value").alias("score"))


@query(f"WITH {_BOW}, s AS (SELECT doc_id, sqrt(sum(value * value)) s FROM c GROUP BY 1) SELECT doc_id, term AS feature, round(value / s, 4) score FROM c JOIN s USING (doc_id)")
def normalize_rows(spark, sf_dir):
    return _named(M.normalize(_bag(spark, sf_dir))).select("doc_id", "feature", _r("value").alias("score"))


@query(f"WITH {_BOW}, k AS (SELECT term FROM c GROUP BY 1 ORDER BY sum(value) DESC, term LIMIT 50) SELECT doc_id, term AS feature, value::BIGINT n FROM c JOIN k USING (term)")
def trim_features(spark, sf_dir):
    return _named(M.trim_features(_bag(spark, sf_dir), max_features=50)).select("doc_id", "feature", F.col("value").cast("bigint").alias("n"))


@query(f"WITH {_BOW} SELECT doc_id, term AS feature, value::BIGINT n FROM c WHERE term LIKE 're%'")
def feature_subset(spark, sf_dir):
    return _named(M.feature_subset(_bag(spark, sf_dir), "feature LIKE 're%'")).select("doc_id", "feature", F.col("value").cast("bigint").alias("n"))


@query(f"WITH {_BOW} SELECT doc_id, arg_min(term, (-value, term)) max_feature, max(value) max_value FROM c GROUP BY 1 UNION ALL SELECT doc_id, NULL, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def arg_max(spark, sf_dir):
    return M.arg_max(_bag(spark, sf_dir))


@query(f"WITH {_BOW}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, term) k FROM c) SELECT doc_id, k::INTEGER AS rank, term AS feature, value AS score FROM t WHERE k <= 5")
def top_features(spark, sf_dir):
    return M.top_features(_bag(spark, sf_dir), 5).select("doc_id", "rank", "feature", "score")


@query(f"WITH {_BOW}, n AS (SELECT count(*) n FROM voc) SELECT d.doc_id, count(term) nonzero, round(coalesce(sum(value), 0), 4) total, round(coalesce(sum(value), 0) / any_value(n.n), 6) mean, round(coalesce(sqrt(sum(value * value)), 0), 4) l2 FROM documents d LEFT JOIN c USING (doc_id), n GROUP BY 1")
def row_summary(spark, sf_dir):
    return M.row_summary(_bag(spark, sf_dir)).select("doc_id", "nonzero", _r("sum").alias("total"), _r("mean", 6).alias("mean"), _r("l2").alias("l2"))


@query(f"WITH {_CELLS} SELECT f AS feature_id, round(sum(v), 3) total, round(min(v), 4) least, round(max(v), 4) most FROM c GROUP BY 1")
def feature_summary(spark, sf_dir):
    m = M.from_dense(_vectors(spark, sf_dir), ["vec_id"])
    return M.feature_summary(m).select("feature_id", _r("sum", 3).alias("total"), _r("min").alias("least"), _r("max").alias("most"))


@query(f"WITH {_BOW}, v AS (SELECT count(*) n FROM voc), d AS (SELECT count(*) n FROM documents) SELECT d.n AS \"rows\", v.n AS features, (SELECT count(*) FROM c) nonzero, d.n - (SELECT count(DISTINCT doc_id) FROM c) zero_rows, round((SELECT sqrt(sum(value * value)) FROM c), 3) frobenius FROM v, d")
def matrix_summary(spark, sf_dir):
    return M.matrix_summary(_bag(spark, sf_dir)).select("rows", "features", "nonzero", "zero_rows", _r("frobenius", 3).alias("frobenius"))


@query(f"WITH {_CELLS} SELECT label, f AS feature_id, round(avg(v), 4) value FROM c GROUP BY 1, 2")
def pool_by_label(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    m = M.from_dense(v, ["vec_id"])
    pooled = M.pool_rows(M.Cells(v.select("vec_id", "label"), m.cells, m.features, m.pk), ["label"], "mean")
    return pooled.cells.select("label", "feature_id", _r("value").alias("value"))


@query(f"WITH {_CELLS}, r AS (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 k FROM c) SELECT f AS column_id, k AS feature_id, round(v, 5) value FROM r WHERE v <> 0")
def transpose(spark, sf_dir):
    return M.transpose(M.from_dense(_vectors(spark, sf_dir), ["vec_id"])).cells.select("column_id", "feature_id", _r("value", 5).alias("value"))


@query(f"WITH {_CELLS}, s AS (SELECT f, sqrt(sum(v * v) / count(DISTINCT vec_id)) s FROM c GROUP BY 1) SELECT vec_id, c.f AS feature_id, round(v / sqrt(s), 4) value FROM c JOIN s USING (f) WHERE v <> 0")
def scale_features(spark, sf_dir):
    return M.scale_features(M.from_dense(_vectors(spark, sf_dir), ["vec_id"]), gamma=0.5).cells.select("vec_id", "feature_id", _r("value").alias("value"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = (SELECT min(vec_id) FROM e))
SELECT e.vec_id, round(1 - list_cosine_similarity(e.v, q.v), 5) AS distance FROM e, q WHERE e.vec_id <> (SELECT min(vec_id) FROM e) ORDER BY 1 - list_cosine_similarity(e.v, q.v), vec_id LIMIT 10"""
)
def nearest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    first = v.agg(F.min("vec_id")).first()[0]
    return M.nearest_neighbors(v, ["vec_id"], {"vec_id": first}, 10).select("vec_id", _r("distance", 5).alias("distance"))


@query("""WITH s AS (SELECT avg(p_size) m, stddev_pop(p_size) d, min(p_retailprice) a, max(p_retailprice) b FROM part)
SELECT p_partkey, round((p_size - m) / d, 4) size_z, round((p_retailprice - a) / (b - a), 4) price_01, (p_size >= 10 AND p_size < 20)::INTEGER mid FROM part, s""")
def feature_matrix(spark, sf_dir):
    m, _ = M.feature_matrix(_table(spark, sf_dir, "part"), ["p_partkey"], {"p_size": {"encoding": "zscore"}, "p_retailprice": {"encoding": "minmax"}})
    bins, _ = M.feature_matrix(_table(spark, sf_dir, "part"), ["p_partkey"], {"p_size": {"encoding": "bins", "edges": [0, 10, 20, 100]}})
    f = F.col("features")
    return m.select("p_partkey", _r(f[0]).alias("size_z"), _r(f[1]).alias("price_01")).join(bins.select("p_partkey", f[1].cast("int").alias("mid")), "p_partkey")


@query("""WITH k AS (SELECT DISTINCT c_mktsegment s, dense_rank() OVER (ORDER BY c_mktsegment) - 1 i FROM customer WHERE c_mktsegment IS NOT NULL), m AS (SELECT min(c_acctbal) a, (max(c_acctbal) - min(c_acctbal)) / 4 w FROM customer)
SELECT c_custkey, c_acctbal AS balance, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 2.5 ELSE -1.0 END::DOUBLE AS mapped, i::INTEGER AS segment, CASE WHEN c_acctbal < a + w THEN 0 WHEN c_acctbal < a + 2 * w THEN 1 WHEN c_acctbal < a + 3 * w THEN 2 ELSE 3 END::INTEGER AS quarter FROM customer LEFT JOIN k ON s = c_mktsegment, m""")
def feature_encodings(spark, sf_dir):
    """Raw, mapped, one-hot and equal-width columns; the last two by which of their features is 1."""
    c = _table(spark, sf_dir, "customer")
    one = M.feature_matrix(c, ["c_custkey"], {"c_acctbal": {"encoding": "raw"}, "c_mktsegment": {"encoding": "mapping", "values": {"BUILDING": 1.0, "MACHINERY": 2.5}}})[0]
    two, names = M.feature_matrix(c, ["c_custkey"], {"c_mktsegment": {"encoding": "onehot"}, "c_acctbal": {"encoding": "bins", "method": "equal_width", "n": 4}})
    n = len(names) - 4
    f, mapped = F.col("features"), F.col("features")[1]
    place = lambda part: F.when(F.array_contains(part, 1.0), F.array_position(part, 1.0).cast("int") - 1)
    left = one.select("c_custkey", f[0].alias("balance"), F.when(F.isnan(mapped), -1.0).otherwise(mapped).alias("mapped"))
    return left.join(two.select("c_custkey", place(F.slice(f, 1, n)).alias("segment"), place(F.slice(f, n + 1, 4)).alias("quarter")), "c_custkey")


@query(f"""WITH {_BOW}, v AS (SELECT term, row_number() OVER (ORDER BY term) i FROM voc), s AS (SELECT *, value / sum(value) OVER (PARTITION BY doc_id) p, sum(value) OVER (PARTITION BY term) tf, count(*) OVER (PARTITION BY term) df FROM c JOIN v USING (term)),
x AS (SELECT doc_id, i, 'absolute' m, value score FROM s UNION ALL SELECT doc_id, i, 'probability', p FROM s UNION ALL SELECT doc_id, i, 'term_frequency', tf FROM s UNION ALL SELECT doc_id, i, 'document_frequency', df FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY m, doc_id ORDER BY score DESC, i) k FROM x) SELECT doc_id, m AS method, k::INTEGER AS rank, (i - 1)::BIGINT AS feature_id, round(score, 5) AS score FROM t WHERE k <= 2""")
def top_by_methods(spark, sf_dir):
    m = _bag(spark, sf_dir)
    parts = [M.top_features(m, 2, how).select("doc_id", F.lit(how).alias("method"), "rank", "feature_id", _r("score", 5).alias("score")) for how in ("absolute", "probability", "term_frequency", "document_frequency")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT doc_id, coalesce(m.target_permille, 0.0)::DOUBLE AS v0, coalesce(m.max_repeats, 0.0)::DOUBLE AS v1 FROM documents d LEFT JOIN mix_targets m ON m.source = d.source")
def embedding_lookup(spark, sf_dir):
    """The vector of each document's source; sources of another spelling, and null ones, have zeros."""
    table = _table(spark, sf_dir, "mix_targets").select(F.col("source").alias("feature"), F.array(F.col("target_permille").cast("double"), F.col("max_repeats").cast("double")).alias("features"))
    return M.embedding_lookup(_table(spark, sf_dir, "documents"), ["doc_id"], "source", table).select("doc_id", F.col("features")[0].alias("v0"), F.col("features")[1].alias("v1"))


# -- dictionaries ------------------------------------------------------------------------------------------------------

_ENTRIES = [("council*", "rule", "positive", 1.0), ("court*", "rule", "negative", -1.0), ("harbor", "place", "positive", 2.0), ("m?yor", "rule", "neutral", 0.0), ("storm", "event", "negative", -2.0)]
_MEMBERS = r"""mem AS (SELECT term, 'rule' category, 'positive' pole, 1.0::DOUBLE score FROM voc WHERE term LIKE 'council%' UNION ALL SELECT term, 'rule', 'negative', -1.0 FROM voc WHERE term LIKE 'court%'
UNION ALL SELECT term, 'place', 'positive', 2.0 FROM voc WHERE term = 'harbor' UNION ALL SELECT term, 'rule', 'neutral', 0.0 FROM voc WHERE term LIKE 'm_yor' UNION ALL SELECT term, 'event', 'negative', -2.0 FROM voc WHERE term = 'storm')"""


def _members(spark, m: M.Cells) -> DataFrame:
    return L.match_features(m.features, spark.createDataFrame(_ENTRIES, "entry string, category string, pole string, score double"))


@query(f"WITH {_BOW}, {_MEMBERS} SELECT doc_id, category, sum(value) n FROM c JOIN (SELECT DISTINCT term, category FROM mem) USING (term) GROUP BY 1, 2")
def dictionary_counts(spark, sf_dir):
    m = _bag(spark, sf_dir)
    return L.dictionary_counts(m, _members(spark, m))


@query(f"WITH {_BOW}, {_MEMBERS} SELECT d.doc_id, coalesce(sum(value) FILTER (term IN (SELECT term FROM mem)), 0.0) matched, coalesce(sum(value), 0.0) total FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1")
def dictionary_totals(spark, sf_dir):
    m = _bag(spark, sf_dir)
    return L.dictionary_totals(m, _members(spark, m)).select("doc_id", "matched", "total")


@query(f"""WITH {_BOW}, {_MEMBERS}, p AS (SELECT d.doc_id, coalesce(sum(value) FILTER (pole = 'positive'), 0.0) positive, coalesce(sum(value) FILTER (pole = 'negative'), 0.0) negative FROM documents d LEFT JOIN (SELECT c.*, pole FROM c JOIN (SELECT DISTINCT term, pole FROM mem) USING (term)) x USING (doc_id) GROUP BY 1)
SELECT doc_id, positive, negative, round(ln((positive + 0.5) / (negative + 0.5)), 5) score FROM p""")
def polarity(spark, sf_dir):
    m = _bag(spark, sf_dir)
    return L.polarity(m, _members(spark, m), "log_ratio").select("doc_id", "positive", "negative", _r("score", 5).alias("score"))


@query(f"""WITH {_BOW}, {_MEMBERS}, p AS (SELECT d.doc_id, coalesce(sum(value) FILTER (pole = 'positive'), 0.0) p, coalesce(sum(value) FILTER (pole = 'negative'), 0.0) n, coalesce(sum(value) FILTER (pole = 'neutral'), 0.0) z, coalesce(sum(value), 0.0) t FROM documents d LEFT JOIN (SELECT c.*, pole FROM c LEFT JOIN (SELECT DISTINCT term, pole FROM mem) USING (term)) x USING (doc_id) GROUP BY 1)
SELECT doc_id, 'difference' AS formula, (p - n)::DOUBLE AS score FROM p UNION ALL SELECT doc_id, 'proportional', round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END, 5) FROM p UNION ALL SELECT doc_id, 'matched', round(CASE WHEN p + n + z > 0 THEN (p - n) / (p + n + z) ELSE 0 END, 5) FROM p UNION ALL SELECT doc_id, 'total', round(CASE WHEN t > 0 THEN (p - n) / t ELSE 0 END, 5) FROM p""")
def polarity_formulas(spark, sf_dir):
    m = _bag(spark, sf_dir)
    members = _members(spark, m)
    parts = [L.polarity(m, members, f).select("doc_id", F.lit(f).alias("formula"), _r("score", 5).alias("score")) for f in ("difference", "proportional", "matched", "total")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {_BOW}, {_MEMBERS}, x AS (SELECT doc_id, score, value, unnest(range(value::BIGINT)) FROM c JOIN (SELECT DISTINCT term, score FROM mem) USING (term))
SELECT doc_id, sum(score) weighted_sum, round(avg(score), 5) mean_matched, round(stddev_pop(score), 5) std, round(quantile_cont(score, 0.25), 5) q25, round(quantile_cont(score, 0.5), 5) median FROM x GROUP BY 1""")
def valence(spark, sf_dir):
    m = _bag(spark, sf_dir)
    out = L.valence(m, _members(spark, m)).where("matched > 0")
    return out.select("doc_id", "weighted_sum", _r("mean_matched", 5).alias("mean_matched"), _r("std", 5).alias("std"), _r("q25", 5).alias("q25"), _r("median", 5).alias("median"))


@query(f"WITH {_BOW}, {_MEMBERS} SELECT doc_id, term AS feature, category, pole, value::BIGINT n FROM c JOIN mem USING (term)")
def dictionary_matches(spark, sf_dir):
    m = _bag(spark, sf_dir)
    return L.dictionary_matches(m, _members(spark, m)).select("doc_id", "feature", "category", "pole", F.col("value").cast("bigint").alias("n"))


@query(
    """WITH e AS (SELECT user_id, event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events),
g AS (SELECT user_id, a || '>' || b AS feature FROM e WHERE b IS NOT NULL) SELECT user_id, feature, count(*) n FROM g GROUP BY 1, 2"""
)
def item_ngrams(spark, sf_dir):
    """Pairs of consecutive events of a user, counted as features."""
    m = M.count_items(_table(spark, sf_dir, "events"), "event_type", ["user_id"], order_by=["ts", "event_id"], ngram_range=(2, 2), separator=">")
    return _named(m).select("user_id", "feature", F.col("value").cast("bigint").alias("n"))


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def keys_without_partner(spark, sf_dir):
    """Set difference by keys, through SQL over keyed data sets."""
    tables = {"a_": _documents(spark, sf_dir, ("lang",)), "b_": Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"])}
    return sql_over(spark, tables, "SELECT doc_id FROM a_ LEFT ANTI JOIN b_ USING (doc_id)")


@query()
def gaussian_mixture_clusters(spark, sf_dir):
    """Cluster and probabilities of every whole vector."""
    return ML.gaussian_mixture(_vectors(spark, sf_dir), ["vec_id"], 3)[0]


@query("SELECT vec_id, 1.0::DOUBLE AS total, true AS likeliest FROM embeddings")
def gaussian_mixture(spark, sf_dir):
    """Every row's probabilities sum to 1, and its cluster has the greatest."""
    p = F.col("features")
    return gaussian_mixture_clusters(spark, sf_dir).select("vec_id", _r(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), 6).alias("total"), (F.get(p, F.col("cluster")) == F.array_max(p)).alias("likeliest"))


def _all_words(spark: SparkSession, sf_dir: str) -> M.Cells:
    """Counts of every word, those of a single document too."""
    return M.count_vectorize(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query()
def lda_topics(spark, sf_dir):
    """Topic shares of every document; documents without a counted word too."""
    return ML.lda(_all_words(spark, sf_dir), 4)[0]


@query()
def lda_terms(spark, sf_dir):
    """Weight of every term in every topic."""
    return ML.lda(_all_words(spark, sf_dir), 4)[1]


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_\p{Pc}\x{200C}\x{200D}]+')) term FROM documents), v AS (SELECT count(DISTINCT term) n FROM w WHERE length(term) >= 2)
SELECT t::INTEGER AS topic, v.n AS n_features, 1.0::DOUBLE AS total, (SELECT count(*) FROM documents) AS n_rows FROM range(4) r(t), v"""
)
def lda(spark, sf_dir):
    """Every topic weighs every word of the vocabulary, with weights that sum to 1; and so do the shares of every row."""
    shares, terms = ML.lda(_all_words(spark, sf_dir), 4)
    whole = shares.where(F.abs(F.aggregate("features", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6).count()
    return terms.groupBy("topic").agg(F.count_distinct("feature").alias("n_features"), _r(F.sum("weight"), 6).alias("total"), F.lit(whole).cast("bigint").alias("n_rows"))


@query()
def dbscan_clusters(spark, sf_dir):
    """Cluster of every whole vector."""
    return ML.dbscan(_vectors(spark, sf_dir), ["vec_id"], 0.05)


@query(
    """WITH RECURSIVE d AS (SELECT a.vec_id x, b.vec_id y FROM embeddings a, embeddings b WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.15),
core AS (SELECT x FROM d GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT x, y FROM d WHERE x IN (FROM core) AND y IN (FROM core)),
w AS (SELECT x, x y FROM core UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y), g AS (SELECT x, min(y) g FROM w GROUP BY 1)
SELECT vec_id, vec_id NOT IN (SELECT y FROM d WHERE x IN (FROM core)) AS noise, (SELECT count(DISTINCT g) FROM g) AS n_clusters FROM embeddings"""
)
def dbscan(spark, sf_dir):
    """Which whole vectors are noise at a radius at which there are clusters, and how many of these there are."""
    out = ML.dbscan(_vectors(spark, sf_dir), ["vec_id"], 1.15, min_samples=3)
    n = out.where("cluster >= 0").agg(F.count_distinct("cluster").alias("n_clusters"))
    return out.select("vec_id", (F.col("cluster") < 0).alias("noise")).join(F.broadcast(n))  # one row


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_\p{Pc}\x{200C}\x{200D}]+')) feature FROM documents)
SELECT feature, count(*) AS count, 16 AS width FROM w WHERE length(feature) >= 2 GROUP BY 1 HAVING count(*) >= 20"""
)
def word2vec(spark, sf_dir):
    """The words that get a vector, how often they occur, and the width of their vectors."""
    words = _table(spark, sf_dir, "documents").select(X.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return ML.word2vec(words, "words", size=16, min_count=20).select("feature", "count", F.size("features").alias("width"))


# -- estimation --------------------------------------------------------------------------------------------------------

_AUDIT = "g AS (SELECT doc_id, (quality >= 4)::INTEGER y, CASE WHEN doc_id % 2 = 0 THEN 0.25 ELSE 0.5 END pi FROM labels WHERE quality IS NOT NULL), s AS (SELECT doc_id, record_type, (coalesce(n_chars, 0) > 800)::INTEGER q FROM documents)"


def _audit(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    gold = _table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", (F.col("quality") >= 4).cast("int").alias("y"), F.when(F.col("doc_id") % 2 == 0, 0.25).otherwise(0.5).alias("pi"))
    frame = _table(spark, sf_dir, "documents").select("doc_id", "record_type", (F.coalesce("n_chars", F.lit(0)) > 800).cast("int").alias("q"))
    return gold, frame


@query(f"WITH {_AUDIT} SELECT count(*) n, round(sum(y / pi), 4) total FROM g")
def horvitz_thompson(spark, sf_dir):
    gold, _ = _audit(spark, sf_dir)
    return E.horvitz_thompson(gold, "y", "pi", 1000).select("n", _r("total").alias("total"))


@query(f"WITH {_AUDIT}, c AS (SELECT sum((y - q) / pi) c, count(*) n FROM g JOIN s USING (doc_id)) SELECT (SELECT count(*) FROM s) population, c.n AS audit, round((SELECT sum(q) FROM s) + c.c, 4) total FROM c")
def generalized_difference(spark, sf_dir):
    gold, frame = _audit(spark, sf_dir)
    return E.generalized_difference(frame, gold, ["doc_id"]).select("population", "audit", _r("total").alias("total"))


@query(f"WITH {_AUDIT} SELECT record_type, count(*) n, count(y) audit, round(sum(q) + coalesce(sum((y - q) / pi), 0), 4) total FROM s LEFT JOIN g USING (doc_id) GROUP BY 1")
def generalized_difference_by(spark, sf_dir):
    gold, frame = _audit(spark, sf_dir)
    return E.generalized_difference_by(frame, gold, ["doc_id"], "record_type").select("record_type", "n", "audit", _r("total").alias("total"))


@query(f"""WITH {_AUDIT}, b AS (SELECT y, q, pi FROM g JOIN s USING (doc_id)), x AS (SELECT 'raw' weights, y, q, 1.0 w FROM b UNION ALL SELECT 'weighted', y, q, 1 / pi FROM b),
k AS (SELECT weights, coalesce(sum(w) FILTER (y = 1 AND q = 1), 0.0) tp, coalesce(sum(w) FILTER (y = 0 AND q = 1), 0.0) fp, coalesce(sum(w) FILTER (y = 1 AND q = 0), 0.0) fn, coalesce(sum(w) FILTER (y = 0 AND q = 0), 0.0) tn FROM x GROUP BY 1)
SELECT weights, tp::DOUBLE tp, fp::DOUBLE fp, fn::DOUBLE fn, tn::DOUBLE tn, round((tp + tn) / (tp + fp + fn + tn), 5)::DOUBLE accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 5)::DOUBLE f1 FROM k""")
def classification(spark, sf_dir):
    gold, frame = _audit(spark, sf_dir)
    return E.classification(gold, frame, ["doc_id"], pi="pi").select("weights", "tp", "fp", "fn", "tn", _r("accuracy", 5).alias("accuracy"), _r("f1", 5).alias("f1"))


@query("SELECT quantile_disc(o_totalprice, 0.9) q90 FROM orders")
def left_quantile(spark, sf_dir):
    return spark.createDataFrame([(E.left_weighted_quantile(_table(spark, sf_dir, "orders"), "o_totalprice", 0.9),)], "q90 double")


@query(f"WITH {_AUDIT}, b AS (SELECT (y - q)::DOUBLE d FROM g JOIN s USING (doc_id)), n AS (SELECT count(*) n, var_samp(d) s2, (SELECT count(*) FROM s) big FROM b), p AS (SELECT sum((1 - pi) * ((y - q) / pi) ** 2) v FROM g JOIN s USING (doc_id)) SELECT round(big * big * (1 - n::DOUBLE / big) * s2 / n, 2) AS srs, round(p.v, 2) AS bernoulli, round(s2 / big, 8) AS superpopulation FROM n, p")
def design_variances(spark, sf_dir):
    """Variances of the estimated total of an audit: simple random, Bernoulli, and what the population's own sampling adds."""
    gold, frame = _audit(spark, sf_dir)
    audit = gold.join(frame, "doc_id").withColumn("d", (F.col("y") - F.col("q")).cast("double"))
    n, big = audit.count(), frame.count()
    srs = E.design_variance(audit.withColumn("pi", F.lit(n / big)), "d", "srs", big)
    rows = [(round(srs, 2), round(E.design_variance(audit, "d", "bernoulli", big), 2), round(E.superpopulation_variance(audit, "d", "srs", big), 8))]
    return spark.createDataFrame(rows, "srs double, bernoulli double, superpopulation double")


@query(
    """WITH g AS (SELECT doc_id, quality::DOUBLE y, 0.25 pi FROM labels WHERE quality IS NOT NULL), s AS (SELECT doc_id, (coalesce(n_chars, 0) // 400)::DOUBLE q FROM documents), n AS (SELECT count(*) n FROM s),
k AS (SELECT q t, 1.0 d FROM s UNION ALL SELECT y, 1 / pi FROM g JOIN s USING (doc_id) UNION ALL SELECT q, -1 / pi FROM g JOIN s USING (doc_id)), j AS (SELECT t, sum(d) d FROM k GROUP BY 1),
f AS (SELECT t, sum(d) OVER (ORDER BY t) / n f FROM j, n), c AS (SELECT t, sum(f - 0.5) OVER (ORDER BY t) c FROM f), b AS (SELECT least(0, min(c)) c FROM c), l AS (SELECT min(c.t) t FROM c, b WHERE c.c <= b.c AND b.c < 0)
SELECT coalesce((SELECT min(f.t) FROM f, l WHERE f.t > coalesce(l.t, -1e300)), (SELECT max(t) FROM f)) AS q50"""
)
def corrected_median(spark, sf_dir):
    """The median of predictions, corrected by an audit."""
    gold = _table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"), F.lit(0.25).alias("pi"))
    frame = _table(spark, sf_dir, "documents").select("doc_id", F.floor(F.coalesce("n_chars", F.lit(0)) / 400).cast("double").alias("q"))
    return spark.createDataFrame([(E.gd_quantile(frame, gold, ["doc_id"], 0.5),)], "q50 double")


# -- models ------------------------------------------------------------------------------------------------------------


def _centres(spark: SparkSession, sf_dir: str):
    """Means of the vectors of each label, by label."""
    v = _vectors(spark, sf_dir)
    pooled = M.pool_rows(M.Cells(v.select("vec_id", "label"), M.from_dense(v, ["vec_id"]).cells, M.from_dense(v, ["vec_id"]).features, ("vec_id",)), ["label"], "mean")
    rows = sorted(pooled.cells.collect(), key=lambda r: (r.label, r.feature_id))  # labels times 64
    labels = sorted({r.label for r in rows})
    out = np.zeros((len(labels), 64))
    for r in rows:
        out[labels.index(r.label), r.feature_id] = r.value
    return out


_LLOYD = """c AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) / {size} u, generate_subscripts(v, 1) f FROM c),
l0 AS (SELECT dense_rank() OVER (ORDER BY label) - 1 k, f, m FROM (SELECT label, f, avg(u0) m FROM (SELECT label, unnest(v) u0, generate_subscripts(v, 1) f FROM c) GROUP BY 1, 2)),
{rounds} SELECT vec_id, k::INTEGER AS cluster FROM a{last}"""
_ROUND = """n{i} AS (SELECT k, f, m / {norm} m FROM l{i}), a{i} AS (SELECT vec_id, arg_min(k, (d, k)) k FROM (SELECT vec_id, k, sum({by}) d FROM x JOIN n{i} USING (f) GROUP BY 1, 2) GROUP BY 1),
l{j} AS (SELECT k, f, avg(u) m FROM x JOIN a{i} USING (vec_id) GROUP BY 1, 2)"""


def _lloyd(spherical: bool, rounds: int) -> str:
    norm, by = ("sqrt(sum(m * m) OVER (PARTITION BY k))", "-u * m") if spherical else ("1.0", "(u - m) * (u - m)")
    size = "sqrt(list_sum(list_transform(v, lambda y: y * y)))" if spherical else "1.0"
    return "WITH " + _LLOYD.format(size=size, rounds=", ".join(_ROUND.format(i=i, j=i + 1, norm=norm, by=by) for i in range(rounds + 1)), last=rounds)


@query(_lloyd(False, 2))
def kmeans(spark, sf_dir):
    """Two rounds of k-means from the means of the labels: the cluster of every row."""
    return ML.kmeans_from(_vectors(spark, sf_dir), ["vec_id"], _centres(spark, sf_dir), 2)[0]


@query(_lloyd(True, 2))
def spherical_kmeans(spark, sf_dir):
    return ML.kmeans_from(_vectors(spark, sf_dir), ["vec_id"], _centres(spark, sf_dir), 2, spherical=True)[0]


@query("SELECT vec_id, true AS nearest FROM embeddings")
def kmeans_fitted(spark, sf_dir):
    """k-means|| centres: no other centre is nearer to a row than its own."""
    v = _vectors(spark, sf_dir)
    out, model = ML.kmeans(v, ["vec_id"], 8)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    far = F.transform(centres, lambda c: M.pair_distance(F.col("v"), c, "sqeuclidean"))
    return out.select("vec_id", "cluster").join(v.select("vec_id", F.col("features").alias("v")), "vec_id").withColumn("far", far).select("vec_id", (F.get("far", F.col("cluster")) <= F.array_min("far") * (1 + 1e-9)).alias("nearest"))


@query(f"WITH {_CELLS}, g AS (SELECT x.f i, y.f j, sum(x.v * y.v) g FROM c x JOIN c y USING (vec_id) GROUP BY 1, 2) SELECT 64 AS components, round((SELECT sum(v * v) FROM c), 3) AS energy, round((SELECT sum(g * g) FROM g) / 1000, 3) AS fourth, round(1.0, 6)::DOUBLE AS share")
def svd_spectrum(spark, sf_dir):
    """All singular values: their squares sum to the squares of the cells, their fourth powers to those of the Gram matrix."""
    sq = F.col("sigma") * F.col("sigma")
    return ML.svd_spectrum(_vectors(spark, sf_dir), 64).agg(F.count("*").cast("int").alias("components"), _r(F.sum(sq), 3).alias("energy"), _r(F.sum(sq * sq) / 1000, 3).alias("fourth"), _r(F.sum("energy"), 6).alias("share"))


@query(f"WITH {_CELLS} SELECT vec_id, round(sum(v * v), 4) AS length FROM c GROUP BY 1")
def svd_rows(spark, sf_dir):
    """With all components, U·S is a rotation: every row keeps its length."""
    return ML.truncated_svd(_vectors(spark, sf_dir), ["vec_id"], 64)[0].select("vec_id", _r(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


# -- more reducers, rankings, distances and estimates -------------------------------------------------------------------


@query(
    f"""{_PRE}, n AS (SELECT *, nullif(l_returnflag, 'N') v FROM li), u AS (SELECT l_orderkey, v, min(item) f FROM n WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT n.l_orderkey, count(*) n_rows, arg_min(v, item) FILTER (v IS NOT NULL) v_first, arg_max(v, item) FILTER (v IS NOT NULL) v_last, coalesce(string_agg(v, ',' ORDER BY item), '') v_list, coalesce(any_value(s), '') v_unique, min(l_quantity) l_quantity_min, max(l_quantity) l_quantity_max, round(sum(l_tax), 4) tax
FROM n LEFT JOIN (SELECT l_orderkey, string_agg(v, ',' ORDER BY f) s FROM u GROUP BY 1) USING (l_orderkey) GROUP BY 1"""
)
def reducers_sparse(spark, sf_dir):
    """Reducers that skip nulls, the metadata reducers, and the short forms of rules."""
    df = _items(spark, sf_dir).withColumn("v", F.expr("nullif(l_returnflag, 'N')"))
    short = A.normalize_rules({"l_quantity": ["min", "max"], "l_tax": {"tax": "sum"}})
    rules = {"v_first": A.Agg("v", "first_non_null"), "v_last": A.Agg("v", "last_non_null"), "v_list": A.Agg("v", "list"), "v_unique": A.Agg("v", "unique_list"), **short}
    out = A.grouped(df, ["l_orderkey"], rules, F.col("item"))
    return out.withColumns({"v_list": F.array_join("v_list", ","), "v_unique": F.array_join("v_unique", ","), "tax": _r("tax")})


@query(
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 seq FROM events), n AS (SELECT *, CASE WHEN seq > 0 AND (event_type = 'purchase') = (lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) = 'purchase') THEN 0 ELSE 1 END x FROM e),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY seq) run FROM n), u AS (SELECT user_id, run, event_type, min(seq) f FROM r GROUP BY 1, 2, 3)
SELECT user_id, min(seq) seq_start, max(seq) seq_end, any_value(kinds) kinds FROM r JOIN (SELECT user_id, run, string_agg(event_type, '' ORDER BY f) kinds FROM u GROUP BY 1, 2) USING (user_id, run) GROUP BY user_id, run"""
)
def span_metadata(spark, sf_dir):
    """Metadata reduced by spans of consecutive rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "event_type", (F.col("event_type") == "purchase").alias("buys"))
    runs = A.collapse_runs(Keyed.of(e, ["user_id", "seq"]), ["buys"], metadata={"kinds": A.Agg("event_type", "concat_unique", "")})
    return runs.df.select("user_id", "seq_start", "seq_end", "kinds")


@query(f"WITH {_BOW}, r AS (SELECT term, sum(value) / (SELECT sum(value) FROM c) b FROM c GROUP BY 1), s AS (SELECT doc_id, term, value / sum(value) OVER (PARTITION BY doc_id) / b score FROM c JOIN r USING (term)), v AS (SELECT term, row_number() OVER (ORDER BY term) i FROM voc), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) k FROM s JOIN v USING (term)) SELECT doc_id, k::INTEGER AS rank, round(score, 4) AS score FROM t WHERE k <= 3")
def top_by_lift(spark, sf_dir):
    m = _bag(spark, sf_dir)
    return M.top_features(m, 3, "lift", reference=m).select("doc_id", "rank", _r("score").alias("score"))


@query(f"""WITH {_BOW}, wide AS (SELECT count(*) w FROM voc), p AS (SELECT doc_id, term, value / sum(value) OVER (PARTITION BY doc_id) p, count(*) OVER (PARTITION BY doc_id) h FROM c), e AS (SELECT *, p / sum(p) OVER (PARTITION BY term) e FROM p),
q AS (SELECT doc_id, term, (count(*) OVER (PARTITION BY doc_id ORDER BY round(e, 12)) + w - h) / w fe, (count(*) OVER (PARTITION BY doc_id ORDER BY round(p, 12)) + w - h) / w fp FROM e, wide), s AS (SELECT doc_id, 1 / (0.7 / fe + 0.3 / fp) score FROM q)
SELECT doc_id, round(max(score), 6) AS score FROM s GROUP BY 1""")
def top_by_frex(spark, sf_dir):
    """The best score of each row by frequency and exclusivity."""
    return M.top_features(_bag(spark, sf_dir), 1, "frex").select("doc_id", _r("score", 6).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] q FROM embeddings ORDER BY vec_id LIMIT 1), e AS (SELECT vec_id, embedding::DOUBLE[] v, q FROM embeddings, q)
SELECT vec_id, round(list_distance(v, q), 5) AS euclidean, round(list_cosine_distance(v, q), 5) AS cosine, round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 5) AS manhattan, round(list_max(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 5) AS chebyshev,
round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))) / list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] + z[2]))), 5) AS braycurtis FROM e""")
def distance_metrics(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    first = F.array(*[F.lit(float(x)) for x in v.orderBy("vec_id").first().features])
    return v.select("vec_id", *[_r(M.pair_distance(F.col("features"), first, m), 5).alias(m) for m in ("euclidean", "cosine", "manhattan", "chebyshev", "braycurtis")])


@query("WITH e AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) d FROM embeddings) SELECT vec_id, label FROM e WHERE vec_id > (SELECT min(vec_id) FROM e) ORDER BY d, vec_id LIMIT 5")
def nearest_with_context(spark, sf_dir):
    """Neighbours with columns of another table of their key."""
    v = _vectors(spark, sf_dir)
    context = Keyed.of(_table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"])
    return M.nearest_neighbors(v, ["vec_id"], {"vec_id": v.agg(F.min("vec_id")).first()[0]}, 5, "euclidean", context=context, context_columns=["label"]).select("vec_id", "label")


@query("SELECT record_type, CASE WHEN n_chars IS NULL THEN -2 WHEN n_chars < 0 THEN -1 WHEN n_chars > 4000 THEN 4 ELSE least(3, n_chars // 1000) END::INTEGER AS bin, count(*) n FROM documents WHERE record_type IS NOT NULL GROUP BY 1, 2")
def histogram_by(spark, sf_dir):
    return A.histogram(_table(spark, sf_dir, "documents"), "n_chars", [1000 * i for i in range(5)], by="record_type").where("n > 0").select("record_type", "bin", "n")


@query("SELECT lang, record_type, count(*) n FROM documents WHERE n_chars > 500 AND lang IS NOT NULL AND record_type IS NOT NULL GROUP BY 1, 2")
def crosstab_where(spark, sf_dir):
    return A.crosstab(_table(spark, sf_dir, "documents"), "lang", "record_type", where="n_chars > 500")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def scope_query(spark, sf_dir):
    """A scope: one set of names over a table and what is attached to it."""
    scope = Scope(_documents(spark, sf_dir), ((Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"], name="labels"), ["quality", "toxic"]),))
    return scope.query([scope.resolve("source"), scope.resolve("quality", "attached")], where="toxic = 1", ordered=False)


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS x, round(embedding[2]::DOUBLE, 5) AS y, coalesce(label::VARCHAR, 'Other') AS label FROM embeddings WHERE label <> 3")
def scatter_points(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    points = Keyed.of(e.select("vec_id", F.slice("embedding", 1, 2).alias("xy")), ["vec_id"])
    got = scatter_rows(Keyed.of(e.select("vec_id", "label"), ["vec_id"]), points, color="label", color_na_label="Other", where="label <> 3", ordered=False)
    return got.select("vec_id", _r(F.col("x").cast("double"), 5).alias("x"), _r(F.col("y").cast("double"), 5).alias("y"), "label")


@query(r"""SELECT doc_id, i - 1 AS match_no, k[i] AS keyword FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1))::INTEGER i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])(counc[\p{L}\p{N}_]*)', 1) k FROM documents))""")
def kwic_keywords(spark, sf_dir):
    return kwic_contexts(spark, sf_dir).select("doc_id", "match_no", "keyword")


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT n FROM documents")
def mapped_rows(spark, sf_dir):
    """A function over batches of rows that keeps the key."""
    return map_rows(_documents(spark, sf_dir), lambda f: f[["text"]].fillna("").assign(n=lambda g: g["text"].map(len))[["n"]], "n bigint", ["text"]).df.select("doc_id", "n")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 p FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 p FROM labels) SELECT a.p left_position, b.p right_position FROM a LEFT JOIN b USING (doc_id)")
def position_pairs(spark, sf_dir):
    return J.position_map(_documents(spark, sf_dir), Keyed.of(_table(spark, sf_dir, "labels"), ["doc_id"]))


@query("SELECT record_type, CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) n, round(greatest(1, floor(count(*) * 0.1)) / count(*), 6) pi FROM documents GROUP BY 1")
def stratified_design(spark, sf_dir):
    """Sizes and inclusion probabilities of a stratified sample with given numbers in each stratum."""
    docs = _documents(spark, sf_dir)
    sizes = {r.record_type: max(1, r["count"] // 10) for r in docs.view(["record_type"]).groupBy("record_type").count().collect()}  # one row per stratum
    _, _, pi = S.probability_sample(docs, strata=["record_type"], n_by_stratum={k: v for k, v in sizes.items()}, seed=9)
    return pi.view(["pi", "record_type"]).groupBy("record_type", _r("pi", 6).alias("pi")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 p FROM documents) SELECT doc_id, CASE WHEN p < 40 THEN 'before' ELSE 'after' END AS side FROM d WHERE p BETWEEN 37 AND 42 AND p <> 40")
def read_neighbours(spark, sf_dir):
    """The rows before and after one row."""
    docs = _documents(spark, sf_dir)
    key = {"doc_id": docs.at(40, []).first().doc_id}
    return docs.previous(key, 3, []).withColumn("side", F.lit("before")).unionByName(docs.next(key, 2, []).withColumn("side", F.lit("after")))


@query("SELECT 'documents' AS name, 'doc_id' AS primary_key, 'doc_id,text,lang,source,n_chars,record_type' AS columns, count(*) AS rows FROM documents")
def data_set_summary(spark, sf_dir):
    return _documents(spark, sf_dir).summary().select("name", "primary_key", "columns", "rows")


@query(f"WITH {_LINES} SELECT doc_id, line_id, source, record_type FROM lines JOIN documents USING (doc_id) WHERE lang = 'de'")
def lineage_metadata(spark, sf_dir):
    """Metadata of documents, asked for and filtered by at their lines."""
    return _lines(spark, sf_dir).query(["source", "record_type"], where="lang = 'de'", ordered=False)


@query(f"WITH {_BOW} SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM c) THEN coalesce(max(value) FILTER (term = 'the'), 0.0) END AS n_the, CASE WHEN d.doc_id IN (SELECT doc_id FROM c) THEN coalesce(max(value) FILTER (term = 'and'), 0.0) END AS n_and FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1")
def attached_features(spark, sf_dir):
    """Features of a matrix attached to a table: zero where a row hasn't one, null where it has no cells at all."""
    m = _bag(spark, sf_dir)
    ids = {r.feature_id: f"n_{r.feature}" for r in m.features.where("feature IN ('the', 'and')").collect()}
    return J.attach_cells(_table(spark, sf_dir, "documents").select("doc_id"), m.cells, ["doc_id"], ids).select("doc_id", "n_the", "n_and")


@query(f"WITH {_BOW} SELECT d.doc_id, coalesce(max(value) FILTER (term = 'the'), 0.0) AS f0, coalesce(max(value) FILTER (term = 'and'), 0.0) AS f1 FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1")
def dense_rows(spark, sf_dir):
    m = _bag(spark, sf_dir)
    ids = {r.feature: r.feature_id for r in m.features.where("feature IN ('the', 'and')").collect()}
    return m.wide([ids["the"], ids["and"]]).select("doc_id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


#: Examples of the published algorithm.
_STEMS = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam hopefulness:hope formaliti:formal triplicate:triplic electrical:electr goodness:good revival:reviv allowance:allow adjustable:adjust replacement:replac adoption:adopt activate:activ effective:effect probate:probat rate:rate controll:control"


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(*x.split(":")) for x in _STEMS.split()) + ") t(word, stem)")
def porter_stems(spark, sf_dir):
    words = spark.createDataFrame([(x.split(":")[0],) for x in _STEMS.split()], "word string")
    return words.select("word", X.stemmed(F.array("word"))[0].alias("stem"))


@query(
    f"""WITH {_ITEMS}, k AS (SELECT l_orderkey, item, l_linenumber AS rank, l_returnflag AS sense, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE 'y' END lemma FROM li), c AS (SELECT * FROM k WHERE sense <> 'A' AND (lemma <> 'x' OR sense = 'N')),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, sense, item) n FROM c) SELECT l_orderkey, rank, sense AS sense_id FROM r WHERE n = 1"""
)
def chosen_senses(spark, sf_dir):
    """One candidate for each token: of those that are neither excluded nor beside a forced one, the first by rank."""
    items = _items(spark, sf_dir).select("l_orderkey", F.col("item").alias("candidate_id"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("sense_id"), F.when(F.col("l_linestatus") == "O", "x").otherwise("y").alias("lemma"))
    return X.select_senses(items, ["l_orderkey"], force={"x": "N"}, exclude=["A"]).select("l_orderkey", "rank", "sense_id")


@query(f"WITH {_LINES} SELECT doc_id, line_id, length(t)::BIGINT AS n, source FROM lines JOIN documents USING (doc_id)")
def workspace_reload(spark, sf_dir):
    """Data sets stored in a workspace, one of them in parts, and read by another session of it with what they inherit."""
    at = _folder(spark, "workspace")
    work = Workspace(spark, at)
    base = work.save(_documents(spark, sf_dir), "documents")
    lines = work.save(X.decompose(base, "text", "\n", "line_id"), "lines")
    work.save_parts("sizes", lines, lambda part: part.derive(part.view(["text"]).select(*part.key_columns, F.char_length("text").cast("bigint").alias("n")), "preserved_key", data=["n"]), parts=2, operation="sizes")
    return Workspace(spark, at).load("sizes").query(["n", "source"], ordered=False)


@query("SELECT 50 AS n_rows, 50 AS n_known, 50 AS n_keys")
def sampled_subset(spark, sf_dir):
    """A sample of fifty rows: as many different keys, all of the source."""
    docs = _documents(spark, sf_dir)
    got = S.sample(docs, 50, seed=8).df.select("doc_id")
    known = got.join(docs.df.select("doc_id"), "doc_id", "left_semi").count()
    return got.agg(F.count("*").cast("int").alias("n_rows"), F.lit(known).alias("n_known"), F.count_distinct("doc_id").cast("int").alias("n_keys"))


# -- sources -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents")
def parquet_rows(spark, sf_dir):
    return R.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"], ["source"], order_by=["doc_id"]).df.select("doc_id", "lang", "source")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL AND text <> ''")
def csv_rows(spark, sf_dir):
    """Texts with line breaks, quotes and commas, written as CSV files and read back with one key over all files."""
    at = _folder(spark, "csv")
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("coded"), "source", F.lit('a "quoted", one\nof two lines').alias("note"))
    docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(at)
    read = R.read_csv_folder(spark, at.removeprefix("file://"), text_fields=["coded", "note"], metadata_fields=["doc_id", "source"], schema="doc_id bigint, coded string, source string, note string")
    return read.df.where(F.col("note") == 'a "quoted", one\nof two lines').select("doc_id", F.decode(F.unbase64("coded"), "UTF-8").alias("text"), "source")


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_rows(spark, sf_dir):
    at = _folder(spark, "jsonl")
    _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(at)
    return R.read_jsonl(spark, at, ["text"], ["doc_id", "lang"], schema="doc_id bigint, text string, lang string").df.select("doc_id", "text", "lang")


@query("SELECT item_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, 'ok' AS status FROM benchmark WHERE text <> ''")
def text_files(spark, sf_dir):
    """A file for each item, listed and read back."""
    at = _folder(spark, "texts")
    items = _table(spark, sf_dir, "benchmark").where("text <> ''").select(F.col("item_id").cast("string").alias("item"), "text")
    items.repartition("item").write.partitionBy("item").option("lineSep", "\n").text(at)
    files = R.folder_inventory(spark, at, ["*.txt"])
    read = R.extract_text_files(files)
    out = read.view(["text", "status", "relative_path"])
    return out.select(F.regexp_extract("relative_path", "item=([^/]*)/", 1).cast("bigint").alias("item_id"), F.regexp_replace("text", "\n$", "").alias("text"), "status")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    """Hourly counts of a stream of event files, until it has read all that is there."""
    events = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    at = _folder(spark, "stream")
    events.write.parquet(at)
    counted = windowed_counts(follow(spark, at, events.schema), "ts", "1 hour", ["event_type"], late="3650 days")
    name = f"windows_{uuid.uuid4().hex}"
    run = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _folder(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# -- hierarchies -------------------------------------------------------------------------------------------------------


def _forest(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return Hierarchy(first_parents(_table(spark, sf_dir, "artifact_basis"), "artifact_id", "basis_artifact_id", "ordinal"))


@query(
    """WITH RECURSIVE b AS (SELECT lower(trim(artifact_id)) a, lower(trim(basis_artifact_id)) p, ordinal o FROM artifact_basis WHERE basis_artifact_id IS NOT NULL),
e AS (SELECT a, arg_min(p, (o, p)) p FROM b GROUP BY 1),
w AS (SELECT a, p x, [a, p] path, 1 d, (a = p) cyc FROM e
UNION ALL SELECT w.a, e.p, list_append(w.path, e.p), d + 1, list_contains(w.path, e.p) FROM w JOIN e ON e.a = w.x WHERE NOT w.cyc),
t AS (SELECT a, x, path, d, cyc FROM w ANTI JOIN e ON e.a = w.x AND NOT w.cyc)
SELECT a AS artifact_id, CASE WHEN cyc THEN list_min(path[list_position(path, x):len(path) - 1]) ELSE x END AS root_artifact_id, CAST(CASE WHEN cyc THEN -1 ELSE d END AS BIGINT) AS depth FROM t"""
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_parent = _forest(spark, sf_dir).nodes.where("parent IS NOT NULL")
    return with_parent.select(F.col("id").alias("artifact_id"), F.col("root").alias("root_artifact_id"), "depth")


_CHAINS = """b AS (SELECT lower(trim(artifact_id)) a, lower(trim(basis_artifact_id)) p, ordinal o FROM artifact_basis WHERE basis_artifact_id IS NOT NULL),
e AS (SELECT a, arg_min(p, (o, p)) p FROM b GROUP BY 1), w AS (SELECT a, p x, [a, p] path, 1 d, (a = p) bad FROM e
UNION ALL SELECT w.a, e.p, list_append(w.path, e.p), d + 1, list_contains(w.path, e.p) FROM w JOIN e ON e.a = w.x WHERE NOT w.bad)"""


@query(
    f"""WITH RECURSIVE {_CHAINS}, t AS (SELECT a, x, path, d, bad FROM w ANTI JOIN e ON e.a = w.x AND NOT w.bad),
n AS (SELECT x, count(*) + 1 size FROM w WHERE a NOT IN (SELECT a FROM t WHERE bad) GROUP BY 1), heads AS (SELECT DISTINCT x FROM t WHERE NOT bad)
SELECT t.a AS id, CASE WHEN bad THEN list_min(path[list_position(path, t.x):len(path) - 1]) ELSE t.x END AS root, CAST(CASE WHEN bad THEN -1 ELSE d END AS BIGINT) AS depth,
CASE WHEN NOT bad THEN coalesce(size, 1) ELSE 0 END AS size, CASE WHEN NOT bad THEN array_to_string(list_reverse(path), '/') END AS path, bad AND t.a = t.x AS in_cycle, NOT bad AS ranged FROM t LEFT JOIN n ON n.x = t.a
UNION ALL SELECT heads.x, heads.x, 0, size, heads.x, false, true FROM heads JOIN n USING (x)"""
)
def p7_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact's root, depth, subtree size and path; cycles are marked. ``ranged``: its preorder range is as wide as its subtree."""
    nodes = p7_nodes(spark, sf_dir)
    ranged = F.coalesce(F.col("last") - F.col("pre") + 1 == F.col("size"), F.lit(False))
    return nodes.select("id", "root", "depth", F.coalesce("size", F.lit(0)).alias("size"), "path", "in_cycle", ranged.alias("ranged"))


@query()
def p7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact's path, depth, root, subtree size and preorder range; cycles are marked."""
    forest = _forest(spark, sf_dir)
    return forest.nodes.join(forest.paths(), "id", "left")


@query(
    """WITH RECURSIVE b AS (SELECT lower(trim(artifact_id)) a, lower(trim(basis_artifact_id)) p, ordinal o FROM artifact_basis WHERE basis_artifact_id IS NOT NULL),
e AS (SELECT a, arg_min(p, (o, p)) p FROM b GROUP BY 1), w AS (SELECT a, p x, 1 d, [a, p] path, a = p bad FROM e UNION ALL SELECT w.a, e.p, d + 1, list_append(path, e.p), list_contains(path, e.p) FROM w JOIN e ON e.a = w.x WHERE NOT bad),
lost AS (SELECT DISTINCT a FROM w WHERE bad) SELECT x AS ancestor, a AS id, d::BIGINT AS distance FROM w WHERE a NOT IN (SELECT a FROM lost)"""
)
def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).descendants()
