import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verseloom.functions import text as X
from verseloom.operators import aggregate as A
from verseloom.operators import joins as J
from verseloom.operators import setops as S
from verseloom.operators.keyed import POSITION, KeyError_, Keyed, check_mode, map_rows, sql_over


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(0, "alpha|beta", "A"), (1, "gamma", "B"), (2, "delta|epsilon", "A")], "row_id long, text string, grp string")
    return Keyed.of(df, ["row_id"], ["text"], ["grp"], name="docs")


@pytest.fixture(scope="module")
def runs(spark):
    data = [(0, 1, "a", 1, "child", "n1"), (0, 3, "b", 2, "child", "n2"), (0, 7, "c", 3, "interlocutor", "n3"), (0, 8, "d", 4, "interlocutor", "n4"), (0, 12, "e", 5, "child", "n5")]
    return Keyed.of(spark.createDataFrame(data, "child_id long, turn_id long, text string, score int, role string, note string"), ["child_id", "turn_id"])


def test_decompose_and_restrict(docs):
    s = X.decompose(docs, "text", "|", "sentence_id")
    assert s.df.count() == 5
    some = J.select_keys(docs, [2, 0])
    assert rows(some.query(["grp"])) == [(0, "A"), (2, "A")]
    assert rows(J.restrict(s, some).view(["text", "grp"]).select("row_id", "sentence_id", "text", "grp"), "row_id", "sentence_id") == [(0, 0, "alpha", "A"), (0, 1, "beta", "A"), (2, 0, "delta", "A"), (2, 1, "epsilon", "A")]


def test_attach_is_n_to_one_and_filterable(spark):
    left = Keyed.of(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "doc_id long, sentence_id long, text string"), ["doc_id", "sentence_id"])
    right = Keyed.of(spark.createDataFrame([(2, 9), (1, 5), (4, 0)], "doc_id long, topic int"), ["doc_id"], name="t")
    assert rows(left.query(["topic"], with_tables=[(right, ["topic"])])) == [(1, 0, 5), (1, 1, 5), (2, 0, 9), (3, 0, None)]
    assert rows(left.query(["text"], where="topic = 5", with_tables=[(right, ["topic"])]).select("text")) == [("a",), ("b",)]


def test_attached_cells_tell_zero_from_missing(spark):
    left = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    cells = spark.createDataFrame([(1, None, None), (1, 1, 9.0), (2, 0, 2.0), (2, 1, 8.0), (3, 1, 7.0)], "doc_id long, feature_id long, value double")
    assert rows(J.attach_cells(left, cells, ["doc_id"], {0: "score"}), "doc_id") == [(1, 0.0), (2, 2.0), (3, 0.0), (4, None)]


def test_merge_orders_and_rejects_overlap(docs):
    a, b = S.subset(docs, "grp = 'A'"), S.subset(docs, "grp = 'B'")
    m = S.merge([b, a])
    assert rows(m.view(["text"]).orderBy(POSITION).select("row_id", "text")) == [(1, "gamma"), (0, "alpha|beta"), (2, "delta|epsilon")]
    with pytest.raises(KeyError_):
        S.merge([a, docs.derive(docs.keys(), "preserved_key")])


def test_runs_of_equal_rows(runs):
    got = A.collapse_runs(runs, ["role"], data={"text": A.Agg("text", "concat"), "s": A.Agg("score", "sum"), "notes": A.Agg("note", "concat", "|")})
    assert rows(got.df.select("turn_id_start", "turn_id_end", "text", "s", "notes", "n_rows"), "turn_id_start") == [(1, 3, "a b", 3.0, "n1|n2", 2), (7, 8, "c d", 7.0, "n3|n4", 2), (12, 12, "e", 5.0, "n5", 1)]


def test_runs_with_overlapping_spans(spark):
    df = spark.createDataFrame([(0, 0, "a", "A", 0), (0, 2, "b", "A", 1), (0, 1, "c", "B", 2), (0, 3, "d", "B", 3)], f"child long, turn long, text string, who string, {POSITION} long")
    got = A.collapse_runs(Keyed.of(df, ["child", "turn"]), ["who"], data={"text": A.Agg("text", "concat")})
    assert rows(got.df.select("turn_start", "turn_end", "text", "n_rows"), "turn_start") == [(0, 2, "a b c", 3), (1, 3, "b c d", 3)]


def test_rekey_nested_ranks(spark):
    data = list(zip(range(6), "BAAABB", "ZYXXAZ"))
    t = Keyed.of(spark.createDataFrame(data, "row_id long, child string, book string"), ["row_id"])
    k = S.set_primary_keys(t, {"child_id": "child", "book_id": "book"}, "leaf")
    got = rows(k.bridge.select("row_id", "child_id", "book_id", "leaf"), "row_id")
    assert [g[1] for g in got] == [1, 0, 0, 0, 1, 1] and [g[2] for g in got] == [1, 1, 0, 0, 0, 1] and [g[3] for g in got] == [0, 0, 0, 1, 0, 1]
    assert rows(k.view(["book"]).select("book"), "book") == [("A",), ("X",), ("X",), ("Y",), ("Z",), ("Z",)]


def test_reducers(spark):
    df = spark.createDataFrame([(0, i, v, n) for i, (v, n) in enumerate(zip("baab", [None, 2, None, 4]))], "g long, i long, v string, n int")
    t = Keyed.of(df, ["g", "i"])
    rules = {h: A.Agg("v", h) for h in ("first", "last", "mode", "unique", "count", "nunique")} | {"cat": A.Agg("v", "concat", "|"), "fn": A.Agg("n", "first_non_null"), "f": A.Agg("n", "first"), "su": A.Agg("n", "sum"), "any_": A.Agg("n", "any"), "c": A.Agg(literal=7)}
    r = A.aggregate(t, ["g"], data=rules).df.first()
    assert (r["first"], r["last"], r["mode"], r["unique"], r["cat"], r["fn"], r["f"], r["su"], r["c"], r["n_rows"]) == ("b", "b", "b", ["b", "a"], "b|a|a|b", 2, None, 6.0, 7, 4)
    assert A.normalize_rules({"v": ["min", "max"]}).keys() == {"v_min", "v_max"}
    with pytest.raises(ValueError):
        A.aggregate(t, ["g", "i"])
    with pytest.raises(ValueError):
        A.normalize_rules({"v": len})


def test_keys_are_checked(spark):
    with pytest.raises(KeyError_):
        Keyed.of(spark.createDataFrame([(1,), (1,)], "k long"), ["k"], check=True)
    for bad in ([(1.5,)], [(None,)]):
        with pytest.raises(Exception, match="integer key"):
            Keyed.of(spark.createDataFrame(bad, "k double"), ["k"]).df.collect()
    with pytest.raises(KeyError_):
        Keyed.of(spark.createDataFrame([(1,)], "_k long"), ["_k"])
    for mode, pk, bases in (("extended_key", ["a"], [["a"]]), ("reduced_key", ["b"], [["a", "b"]]), ("merged_key", ["a"], [["a"]]), ("span_key", ["a"], [["a"]]), ("odd", ["a"], [])):
        with pytest.raises(ValueError):
            check_mode(mode, pk, bases)


def test_reading(docs):
    assert rows(docs.query(["grp"], positions=[2, 0, 2])) == [(2, "A"), (0, "A"), (2, "A")]
    assert rows(docs.query(["text"], order_by=["grp desc", "row_id"], limit=2)) == [(1, "gamma"), (0, "alpha|beta")]
    assert rows(docs.context({"row_id": 1}, before=1, columns=[])) == [(0,), (1,)]
    assert rows(docs.previous({"row_id": 2}, columns=[])) == [(1,)] and rows(docs.next({"row_id": 2}, columns=[])) == []
    assert docs.query(sample_n=2, seed=1).count() == 2
    assert rows(docs.get((1,), ["grp"])) == [(1, "B")]
    with pytest.raises(ValueError):
        docs.query(["grp"], metadata_mode="none")
    with pytest.raises(ValueError):
        docs.query(["nope"]).collect()
    with pytest.raises(KeyError_):
        J.select_keys(docs, [0, 0])
    with pytest.raises(KeyError_):
        J.select_keys(docs, [99])


def test_join_frame_map_and_sql(spark, docs):
    extra = Keyed.of(spark.createDataFrame([(0, 10), (7, 70)], "row_id long, v int"), ["row_id"])
    assert rows(J.join(docs, extra).query(["text", "v"])) == [(0, "alpha|beta", 10), (1, "gamma", None), (2, "delta|epsilon", None)]
    with pytest.raises(ValueError):
        J.join(docs, docs)
    frame = spark.createDataFrame([(1, "z")], "row_id long, code string")
    assert rows(J.from_keyed_frame(docs, frame, ["code"]).query(["code", "grp"])) == [(1, "z", "B")]
    with pytest.raises(KeyError_):
        J.from_keyed_frame(docs, frame, ["code"], require_complete=True)
    up = map_rows(docs, lambda f: f.assign(u=f["text"].str.upper())[["u"]], "u string", ["text"])
    assert rows(up.query(["u", "grp"]))[1] == (1, "GAMMA", "B")
    assert rows(sql_over(spark, {"d": docs}, "SELECT grp, count(*) FROM d GROUP BY grp"), "grp") == [("A", 2), ("B", 1)]


def test_split_and_samples(spark):
    t = Keyed.of(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"), (F.col("id") / 4).cast("int").alias("u")), ["k"])
    parts = S.split(t, ["a", "b", "c"], [0.5, 0.3, 0.2], seed=1, stratify=["s"])
    assert sum(p.df.count() for p in parts.values()) == 100
    whole = S.split(t, ["a", "b"], [0.6, 0.4], by=["u"])
    assert whole["a"].view(["u"]).join(whole["b"].view(["u"]).select("u"), "u").count() == 0 and whole["a"].df.count() == 60
    s, rest, pi = S.probability_sample(t, n=20, strata=["s"], seed=4)
    assert s.df.count() == 20 and rest.df.count() == 80 and pi.df.where("pi <= 0 OR pi > 1").count() == 0
    b, r, _ = S.probability_sample(t, probability=0.5, seed=1)
    assert b.df.count() + r.df.count() == 100
    assert S.largest_remainder([0.5, 0.3, 0.2], 33) == [16, 10, 7]
    for bad in (dict(n=100), dict(n=0), dict(n=1, fraction=0.1), dict(probability=1.0)):
        with pytest.raises(ValueError):
            S.probability_sample(t, **bad)


def test_subset_functions_are_checked(docs):
    assert rows(S.subset(docs, lambda f: f["grp"] == "A", ["grp"]).query([])) == [(0,), (2,)]
    for bad in (lambda f: True, lambda f: [None] * len(f), lambda f: [True]):
        with pytest.raises(Exception):
            S.subset(docs, bad, ["grp"]).df.collect()
    assert S.subset(docs, "grp = 'nothing'").df.count() == 0


def test_diagnostics_crosstab_histogram(spark):
    df = spark.createDataFrame([("alpha",), (" alpha ",), ("",), ("   ",), (None,), ("beta",)], "t string")
    r = A.text_diagnostics(df, "t").first()
    assert (r.missing, r.empty, r.nonempty, r.unique, r.duplicate_groups, r.duplicate_rows, r.duplicate_excess) == (1, 2, 3, 2, 1, 2, 1)
    h = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.0, 2.0, 3.0, None, 9.0)], "x double")
    assert rows(A.histogram(h, "x", [0, 1, 3]).select("bin", "n"), "bin") == [(-2, 1), (-1, 0), (0, 1), (1, 4), (2, 1)]
    c = A.crosstab(spark.createDataFrame([("a", "x"), ("a", None)], "r string, c string"), "r", "c", margins=True, dropna=False)
    assert set(rows(c)) == {("a", "x", 1), ("a", "<NA>", 1), ("All", "x", 1), ("All", "<NA>", 1), ("a", "All", 2), ("All", "All", 2)}
