import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verseloom.functions import text as X
from verseloom.lexicon import dictionary as L
from verseloom.matrix import cells as M


@pytest.fixture(scope="module")
def bag(spark):
    df = spark.createDataFrame([(0, "red red blue"), (1, "blue green"), (2, None)], "k long, t string")
    return M.count_vectorize(df, ["k"], "t")


def named(m):
    return sorted(rows(m.cells.join(m.features, "feature_id").select(*m.pk, "feature", "value")))


def test_cleaning_and_extraction(spark):
    df = spark.createDataFrame([("  a1b22  ",), (None,)], "t string")
    jvm = X.regex_clean(F.col("t"), [X.Rule(r"\d+", "#"), X.Rule("A", "z", flags="I")])
    py = X.regex_clean(F.col("t"), [X.Rule(r"\d+", "#", count=1)])
    assert rows(df.select(jvm, py)) == [("z#b#", "a#b22"), (None, None)]
    e = X.extract_pattern(spark.createDataFrame([("p-7",), ("q",)], "t string"), "t", r"(?P<data_name>\w)-(?P<metadata_no>\d)")
    assert rows(e.select("name", "no")) == [("p", "7"), (None, None)]
    with pytest.raises(ValueError):
        X.extract_pattern(e, "t", r"(?P<data_name>\w)-(?P<metadata_no>\d)", on_unmatched="fail")


def test_lengths(spark):
    df = spark.createDataFrame([("one two",), (None,), ("日本 x",)], "t string")
    assert rows(df.select(X.text_length(F.col("t")), X.text_length(F.col("t"), "words"))) == [(7, 2), (0, 0), (4, 2)]


def test_kwic(spark):
    df = spark.createDataFrame([(1, "The old cat sat; the Cat's hat. concat")], "k long, t string")
    got = rows(X.kwic(df, ["k"], "t", "cat", window=2), "match_no")
    assert [(g[2], g[4], g[5], g[6]) for g in got] == [(8, "The old", "cat", "sat;"), (21, "; the", "Cat", "'s hat")]
    assert X.kwic(df, ["k"], "t", "c*", valuetype="glob").count() == 3


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("filing", "file"), ("generalizations", "gener")])
def test_porter(word, stem):
    assert X.porter_stem(word) == stem


def test_tokens_backend_and_heads(spark):
    df = spark.createDataFrame([(1, "One. Two words!")], "k long, t string")
    assert [(r.sentence_id, r.text) for r in X.linguistic_tokens(df, ["k"], "t").collect()] == [(0, "One"), (0, "."), (1, "Two"), (1, "words"), (1, "!")]
    with pytest.raises(RuntimeError):
        X.with_backend(df, ["k"], ["t"], None, "x int", "a model")
    ok = X.with_backend(df, ["k"], ["t"], lambda r: [{"x": len(r["t"])}], "x int", "a model")
    assert rows(ok) == [(1, 0, 15, None)]
    assert rows(X.with_backend(df, ["k"], ["t"], lambda r: 1 / 0, "x int", "a model"))[0][3].startswith("ZeroDivisionError")
    toks = [{"token_id": i, "head": h} for i, h in enumerate([1, 4, 1, 2])]
    assert X.head_of_span(toks, 0, 2) == 1


def test_sense_selection(spark):
    c = spark.createDataFrame([(1, 0, "s1", 1, "run"), (1, 1, "s2", 0, "run"), (2, 0, "s3", 0, "go")], "tok long, candidate_id long, sense_id string, rank int, lemma string")
    assert rows(X.select_senses(c, ["tok"]).select("tok", "sense_id"), "tok") == [(1, "s2"), (2, "s3")]
    assert rows(X.select_senses(c, ["tok"], force={"run": "s1"}, exclude=["s3"]).select("tok", "sense_id")) == [(1, "s1")]


def test_counts_and_tfidf(bag):
    assert named(bag) == [(0, "blue", 1.0), (0, "red", 2.0), (1, "blue", 1.0), (1, "green", 1.0)]
    t = {(k, f): v for k, f, v in named(M.tfidf(bag))}
    assert t[0, "red"] == pytest.approx(2 * (math.log(4 / 2) + 1)) and t[0, "blue"] == pytest.approx(math.log(4 / 3) + 1)
    n = {(k, f): v for k, f, v in named(M.normalize(bag))}
    assert n[0, "red"] == pytest.approx(2 / 5**0.5)
    assert [f for _, f, _ in named(M.trim_features(bag, min_df=2))] == ["blue", "blue"]
    assert rows(M.feature_subset(bag, "feature > 'c'").features, "feature_id") == [(0, "green"), (1, "red")]


def test_items_keep_empty_groups(spark):
    df = spark.createDataFrame([(0, 0, 0, "alpha", True, False), (0, 0, 1, "the", True, True), (0, 1, 0, "beta", True, False), (0, 1, 1, "gamma", True, False), (0, 2, 0, "the", True, True)], "d long, s long, t long, lemma string, is_alpha boolean, is_stop boolean")
    m = M.count_items(df, "lemma", ["d", "s"], where="is_alpha AND NOT is_stop", order_by=["t"])
    assert [r.features for r in m.wide().orderBy("d", "s").collect()] == [[1, 0, 0], [0, 1, 1], [0, 0, 0]]
    two = M.count_items(df, "lemma", ["d"], ["s"], ["t"], ngram_range=(2, 2))
    assert [r[1] for r in rows(two.features, "feature_id")] == ["alpha the", "beta gamma"]


def test_summaries_and_argmax(spark):
    m = M.from_dense(spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [-1.0, -2.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, -2.0, -3.0])], "k long, features array<double>"), ["k"])
    r = {x.k: x for x in M.row_summary(m).collect()}
    assert (r[0]["sum"], r[0]["min"], r[0]["max"], r[1]["max"], r[2]["nonzero"], r[3]["max"]) == (3.0, 0.0, 2.0, 0.0, 0, -1.0)
    assert rows(M.arg_max(m), "k") == [(0, "2", 2.0), (1, "2", 0.0), (2, None, 0.0), (3, "0", -1.0)]
    s = M.matrix_summary(m).first()
    assert (s["rows"], s.features, s.nonzero, s.zero_rows, s["sum"]) == (4, 3, 7, 1, -6.0)
    assert rows(M.transpose(m).cells, "column_id", "feature_id")[0] == (0, 0, 1.0)
    p = M.top_features(M.from_dense(spark.createDataFrame([(0, [1.0, 3.0])], "k long, features array<double>"), ["k"]), 2, "frex")
    assert [x.feature for x in p.orderBy("rank").collect()] == ["1", "0"]


def test_neighbors_tie_by_key(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.1])], "k long, features array<double>")
    assert [r.k for r in M.nearest_neighbors(v, ["k"], {"k": 0}, 3).collect()] == [3, 1, 2]
    with pytest.raises(ValueError):
        M.nearest_neighbors(v, ["k"], {"k": 9})


def test_feature_recipes(spark):
    df = spark.createDataFrame([(0, 1.0, "x"), (1, 3.0, None), (2, None, "y")], "k long, a double, c string")
    m, names = M.feature_matrix(df, ["k"], {"a": {"encoding": "zscore"}, "c": {"encoding": "onehot"}})
    assert names == ["a", "c_x", "c_y"] and [r.features for r in m.orderBy("k").collect()] == [[-1, 1, 0], [1, 0, 0], [0, 0, 1]]
    b, _ = M.feature_matrix(df, ["k"], {"a": {"encoding": "bins", "edges": [0, 1, 3]}})
    assert [r.features for r in b.orderBy("k").collect()] == [[0, 1], [0, 0], [0, 0]]


def test_dictionaries(spark, bag):
    e = spark.createDataFrame([("re*", "warm", "positive", 2.0), ("blue", "cool", "negative", -1.0)], "entry string, category string, pole string, score double")
    mem = L.match_features(bag.features, e)
    assert set(rows(L.dictionary_counts(bag, mem))) == {(0, "warm", 2.0), (0, "cool", 1.0), (1, "cool", 1.0)}
    assert rows(L.dictionary_totals(bag, mem), "k") == [(0, 3.0, 0.0, 3.0), (1, 1.0, 1.0, 2.0), (2, 0.0, 0.0, 0.0)]
    assert [r.score for r in L.polarity(bag, mem, "proportional").orderBy("k").collect()] == [pytest.approx(1 / 3), -1.0, 0.0]
    v = L.valence(bag, mem).orderBy("k").collect()
    assert (v[0].weighted_sum, v[0].median, v[0].q25) == (3.0, 2.0, 0.5)
    assert L.entry_pattern("a.b", "fixed") == r"^a\.b$"
    with pytest.raises(ValueError):
        L.polarity(bag, mem.unionByName(mem.withColumn("pole", F.lit("neutral"))))


def test_heads_of_spans_as_a_table(spark):
    import random

    rng = random.Random(2)
    tokens, spans, want = [], [], set()
    for s in range(12):
        n = rng.randrange(1, 9)
        own = [{"token_id": i, "head": rng.randrange(n), "is_punct": rng.random() < 0.3} for i in range(n)]
        tokens += [(s, t["token_id"], t["head"], t["is_punct"]) for t in own]
        for role in ("a", None):
            a = rng.randrange(n)
            b = rng.randrange(a, n)
            spans.append((s, a, b, role))
            want.add((s, a, b, role, X.head_of_span(own, a, b)))
    t, sp = spark.createDataFrame(tokens, "sid long, token_id long, head long, is_punct boolean"), spark.createDataFrame([*spans, spans[0], (99, 4, 5, "x")], "sid long, start long, end long, role string")
    assert set(rows(X.span_heads(t, sp, ["sid"]))) == want | {(99, 4, 5, "x", 4)} and X.span_heads(t, sp, ["sid"]).count() == len(want) + 1


def test_backend_columns_of_tokens(spark):
    def parse(text):
        return [[{"text": w, "lemma": w, "is_alpha": True, "is_punct": False, "start": 0, "pos": "X", "head": i} for i, w in enumerate(text.split())]]

    got = X.linguistic_tokens(spark.createDataFrame([(1, "a b")], "k long, t string"), ["k"], "t", parse, "pos string, head bigint, dep string")
    assert rows(got.select("text", "pos", "head", "dep"), "head") == [("a", "X", 0, None), ("b", "X", 1, None)]
