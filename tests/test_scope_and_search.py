import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verseloom.functions import text as X
from verseloom.lexicon import dictionary as L
from verseloom.matrix import cells as M
from verseloom.ml import models as ML
from verseloom.operators import aggregate as A
from verseloom.operators import setops as S
from verseloom.operators.keyed import POSITION, Keyed, attributes, hash_sample
from verseloom.operators.scope import Scope, scatter_rows
from verseloom.plans.workspace import BinaryCoding, Workspace, translate_values
from verseloom.stats import estimation as E


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, f"text {i}", "AB"[i % 2], float(i)) for i in range(6)], "row_id long, text string, grp string, score double")
    return Keyed.of(df, ["row_id"], ["text", "score"], ["grp"], name="docs")


def test_scope_names_and_refuses_overrides(spark, docs):
    extra = Keyed.of(spark.createDataFrame([(0, 9.0, "z")], "row_id long, score double, tag string"), ["row_id"], name="extra")
    scope = Scope(docs, ((extra, ["score", "tag"]),))
    assert {(c["output"], c["group"]) for c in scope.columns()} == {("row_id", "key"), ("text", "data"), ("score", "data"), ("grp", "metadata"), ("extra.score", "attached"), ("tag", "attached")}
    assert scope.resolve("score") == "score" and scope.resolve("score", "attached") == "extra.score" and scope.resolve("tag") == "tag"
    with pytest.raises(ValueError):
        scope.resolve("nope")
    with pytest.raises(TypeError):
        scope.query(["text"], metadata_mode="none")
    assert rows(scope.query(["text", "tag"], where="score < 2")) == [(0, "text 0", "z"), (1, "text 1", None)]
    assert [c["output"] for c in Scope(docs, metadata_mode="none", include_data=False).columns()] == ["row_id"]


def test_scatter_joins_coordinates(spark, docs):
    xy = Keyed.of(spark.createDataFrame([(i, [i / 2, 1.0]) for i in range(5)], "row_id long, features array<double>"), ["row_id"])
    got = scatter_rows(docs, xy, ["text"], color="grp", longest=3, where="score > 2")
    assert rows(got, "row_id") == [(3, 1.5, 1.0, "tex…", "B"), (4, 2.0, 1.0, "tex…", "A")]


def test_columns_of_a_filter_are_parsed(spark, docs):
    assert attributes(spark, "text LIKE 'score%' AND upper(grp) = 'A'") == {"text", "grp"}
    assert rows(docs.query([], where="grp = 'A'", ordered=False).select("row_id"), "row_id") == [(0,), (2,), (4,)]
    plan = docs.query(["text"], where="grp = 'A'", ordered=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" not in plan and "score" not in plan.split("\n")[0]


def test_positions_are_ranks_of_the_data_set(docs):
    odd = S.subset(docs, "grp = 'B'")
    assert rows(odd.query(["text"], positions=[2, 0])) == [(5, "text 5"), (1, "text 1")]
    assert rows(odd.at(slice(1, 3), [])) == [(3,), (5,)] and rows(odd.query([], where=f"{POSITION} = 1")) == [(3,)]
    merged = S.merge([odd, S.subset(docs, "grp = 'A'")])
    assert [r[0] for r in rows(merged.query([]))] == [1, 3, 5, 0, 2, 4] and rows(merged.query([], positions=[3])) == [(0,)]


def test_sample_sizes_are_exact_and_spread(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    for n in (0, 1, 777, 4999, 5000, 9000):
        got = [r.k for r in hash_sample(df, n, None, 3, ["k"]).collect()]
        assert len(got) == len(set(got)) == min(n, 5000)
    a, b = ({r.k for r in hash_sample(df, None, 0.2, s, ["k"]).collect()} for s in (1, 2))
    assert len(a) == len(b) == 1000 and 120 < len(a & b) < 290 and 350 < sum(k < 2000 for k in a) < 450
    assert a == {r.k for r in hash_sample(df.repartition(7), None, 0.2, 1, ["k"]).collect()}


def test_runs_without_a_parent_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "RUN_BLOCK", 4)
    rng = random.Random(1)
    values = [rng.choice(["a", "a", "b", None]) for _ in range(60)]
    t = Keyed.of(spark.createDataFrame(list(enumerate(values)), "k long, v string"), ["k"])
    want, at = [], 0
    for i in range(1, 61):
        if i == 60 or values[i] != values[at]:
            want.append((at, i - 1, values[at], i - at))
            at = i
    assert rows(A.collapse_runs(t, ["v"]).df.select("k_start", "k_end", "v", "n_rows"), "k_start") == want


def test_histogram_by_and_crosstab_where(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0), (None, 0.5), ("b", None), ("b", 9.0)], "g string, x double")
    got = {(r.g, r.bin): r.n for r in A.histogram(df, "x", [0, 1, 2], by="g", dropna=False).collect()}
    assert {k: n for k, n in got.items() if n} == {("a", 0): 1, ("a", 1): 1, ("b", 1): 1, ("b", -2): 1, ("b", 2): 1, ("<NA>", 0): 1} and len(got) == 15
    assert set(r.g for r in A.histogram(df, "x", 3, by="g").collect()) == {"a", "b"}
    assert rows(A.crosstab(df.withColumn("h", F.lit("y")), "g", "h", where="x < 2")) == [("a", "y", 2)]
    with pytest.raises(ValueError):
        A.histogram(df, "x", [1, 1])


def test_metrics_match_their_formulas(spark):
    x, y = [1.0, 0.0, 2.0, -3.0], [2.0, 0.0, 0.0, 5.0]
    a, b = np.array(x), np.array(y)
    want = {
        "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), "euclidean": np.linalg.norm(a - b), "sqeuclidean": ((a - b) ** 2).sum(), "manhattan": np.abs(a - b).sum(), "cityblock": np.abs(a - b).sum(),
        "chebyshev": np.abs(a - b).max(), "minkowski": (np.abs(a - b) ** 3).sum() ** (1 / 3), "canberra": 1 / 3 + 1 + 8 / 8, "braycurtis": np.abs(a - b).sum() / np.abs(a + b).sum(),
        "correlation": 1 - np.corrcoef(a, b)[0, 1], "hamming": 3 / 4, "jaccard": 1 / 3, "dice": 1 / 5,
    }
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    got = df.select(*[M.pair_distance(F.col("x"), F.col("y"), m).alias(m) for m in M.METRICS]).first()
    assert set(want) == set(M.METRICS) and all(got[m] == pytest.approx(v) for m, v in want.items())
    with pytest.raises(ValueError):
        M.pair_distance(F.col("x"), F.col("y"), "odd")


def test_neighbours_with_context(spark, docs):
    v = spark.createDataFrame([(i, s, [float(i), float(s)]) for i in range(4) for s in range(2)], "row_id long, part long, features array<double>")
    got = M.nearest_neighbors(v, ["row_id", "part"], {"row_id": 0, "part": 0}, 3, "euclidean", context=docs, context_columns=["text", "grp"])
    assert rows(got) == [(0, 1, 1.0, "text 0", "A"), (1, 0, 1.0, "text 1", "B"), (1, 1, math.sqrt(2), "text 1", "B")]
    with pytest.raises(ValueError):
        M.nearest_neighbors(v, ["row_id", "part"], {"row_id": 0, "part": 0}, context=docs, context_columns=["distance"])


def test_rows_by_name(spark):
    m = M.from_dense(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "k long, features array<double>"), ["k"])
    named = M.Cells(spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "k long, name string"), m.cells, m.features, m.pk)
    assert rows(M.rows_by_name(named, "name", ["two", "zero", "two"])) == [(0, "two", 2), (1, "zero", 0), (2, "two", 2)]
    assert rows(M.cells_by_row_name(named, "name", ["one", "two"]).select("row_name", "feature_id", "value")) == [("one", 1, 2.0)]
    with pytest.raises(ValueError, match="unknown"):
        M.rows_by_name(named, "name", ["none"])
    with pytest.raises(ValueError, match="unique"):
        M.row_names(M.Cells(named.rows.unionByName(named.rows), m.cells, m.features, m.pk), "name")
    with pytest.raises(TypeError):
        X.kwic(named, ["k"], "name", "one")


def test_kwic_lines(spark):
    hits = X.kwic(spark.createDataFrame([(1, "the cat sat"), (2, "a cat\n and a cat")], "k long, t string"), ["k"], "t", "cat", 2)
    lines = X.kwic_lines(hits, ["k"], width=8, rows=2)
    assert lines[0] == "3 matches, 2 shown" and lines[1] == "1       the [cat] sat" and lines[2].startswith("2         a [cat] and a")
    assert len(X.kwic_lines(hits, ["k"], rows=None)) == 4 and len(X.kwic_lines(hits, ["k"], rows=1, sample_seed=3)) == 2


def test_patterns_over_the_vocabulary(spark):
    names = ["council", "councils", "a council", "Court", "x", "mayor", "mawyor", "co", None]
    features = spark.createDataFrame(list(enumerate(names)), "feature_id long, feature string")
    entries = spark.createDataFrame([("council*", "a"), ("COURT", "b"), ("ma?or", "c"), ("*", "d"), ("co*", "e")], "entry string, category string")
    got = {(r.feature, r.category) for r in L.match_features(features, entries).where("category <> 'd'").collect()}
    assert got == {("council", "a"), ("councils", "a"), ("Court", "b"), ("mayor", "c"), ("council", "e"), ("councils", "e"), ("Court", "e"), ("co", "e")}
    assert L.match_features(features, entries).where("category = 'd'").count() == 8
    assert {r.feature for r in L.match_features(features, spark.createDataFrame([("ou.",)], "entry string"), "regex").collect()} == {"council", "councils", "a council", "Court"}
    assert L.match_features(features, entries, case_sensitive=True).where("category = 'b'").count() == 0


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "afinn.txt").write_text("good\t3\ncan't stand\t-3\n")
    (tmp_path / "vader.txt").write_text(":)\t2.0\t1.1\t[2, 1]\nawful\t-2.0\t0.4\t[-2]\n")
    (tmp_path / "pos.txt").write_text("; a list\n\nfine\nna\xefve\n", encoding="latin-1")
    (tmp_path / "neg.txt").write_text(";\nbad\n", encoding="latin-1")
    (tmp_path / "senses.txt").write_text("# POS\tID\ta\tb\tterms\tgloss\na\t00001740\t0.125\t0.25\tAble#1 capable#3\tgloss\n")
    assert rows(L.load_afinn(spark, f"{tmp_path}/afinn.txt"), "entry") == [("can't stand", -3.0), ("good", 3.0)]
    assert rows(L.load_vader(spark, f"{tmp_path}/vader.txt"), "entry") == [(":)", 2.0), ("awful", -2.0)]
    assert rows(L.load_opinion_words(spark, f"{tmp_path}/pos.txt", f"{tmp_path}/neg.txt"), "entry") == [("bad", "negative"), ("fine", "positive"), ("naïve", "positive")]
    assert rows(L.load_sense_scores(spark, f"{tmp_path}/senses.txt")) == [("able.a.01", 0.125, 0.25, 0.625)]


def test_quantile_ranks_by_exact_sums(spark):
    rng = random.Random(5)

    def brute(big, n, p, alpha=0.025):
        rank = max(1, math.ceil(p * big - 1e-12))
        at_most = lambda k, m: 0.0 if k < 0 else sum(math.comb(m, i) * math.comb(big - m, n - i) for i in range(min(k, n, m) + 1)) / math.comb(big, n)
        low = max((r for r in range(1, n + 1) if at_most(r - 1, rank) <= alpha), default=None)
        return low, min((r for r in range(1, n + 1) if 1 - at_most(r - 1, rank - 1) <= alpha), default=None)

    for _ in range(200):
        big = rng.randrange(2, 60)
        n, p = rng.randrange(1, big), rng.random()
        assert E.quantile_ranks(big, n, p) == brute(big, n, p)
    assert E.quantile_ranks(10**9, 10**6, 0.5) == (499_021, 500_980)
    sample = spark.createDataFrame([(float(v),) for v in range(1, 21)], "y double")
    assert E.quantile_interval(sample, "y", 1000, 0.02)[0] == -math.inf and E.quantile_interval(sample, "y", 1000, 0.5)[1] < math.inf
    assert E.quantile_interval(sample, "y", 20, 0.5) == (10.0, 10.0)


def test_gd_quantile_equals_the_pooled_fit(spark):
    rng = random.Random(8)
    for seed in range(4):
        n = 60
        q = [float(rng.randrange(12)) for _ in range(n)]
        gold = [(i, float(rng.randrange(14)), 0.2) for i in rng.sample(range(n), 12)]
        knots = {}
        for v in q:
            knots[v] = knots.get(v, 0.0) + 1
        for i, y, pi in gold:
            knots[y] = knots.get(y, 0.0) + 1 / pi
            knots[q[i]] = knots.get(q[i], 0.0) - 1 / pi
        ts = sorted(knots)
        cdf = E.isotonic(list(np.cumsum([knots[t] for t in ts]) / n))
        cdf[-1] = 1.0
        s, g = spark.createDataFrame(list(enumerate(q)), "k long, q double"), spark.createDataFrame(gold, "k long, y double, pi double")
        for p in (0.1, 0.5, 0.9):
            assert E.gd_quantile(s, g, ["k"], p) == next(t for t, f in zip(ts, cdf) if f >= p - 1e-12), (seed, p)
    assert E.estimate(s.withColumnRenamed("q", "v"), "v", "total") == sum(q) and E.estimate(g, "y", "total", pi="pi") == pytest.approx(sum(y / p for _, y, p in gold))


def test_sparse_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 30)) * (rng.random((40, 30)) < 0.5) + 0.01 * rng.normal(size=(40, 30))
    m = M.from_dense(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "k long, features array<double>"), ["k"])
    got, sigma, comps = ML.cells_svd(m, 3, oversample=12, iterations=6)
    u, want, vt = np.linalg.svd(a)
    assert np.allclose(sigma, want[:3], rtol=1e-4)
    x = np.array([r.features for r in got.orderBy("k").collect()])
    v = np.array([r.features for r in comps.orderBy("feature_id").collect()])
    assert np.allclose(x @ v.T, (u[:, :3] * want[:3]) @ vt[:3], atol=0.05) and (v[np.abs(v).argmax(0), range(3)] > 0).all()


def test_umap_keeps_groups_apart(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 5)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, features array<double>")
    out = np.array([r.features for r in ML.umap(df, ["k"], neighbors=8, epochs=120).orderBy("k").collect()])
    d = ML.distances(out)
    near = np.argsort(d + np.eye(60) * 1e9, axis=1)[:, :5]
    assert out.shape == (60, 2) and (near // 20 == np.arange(60)[:, None] // 20).mean() > 0.95
    assert ML.umap(df.limit(2), ["k"]).count() == 2 and ML.umap(df.limit(0), ["k"]).count() == 0


def test_grid_halving_and_stack(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, (rng.normal(size=3) + 2 * (i % 2)).tolist(), i % 2) for i in range(120)], "k long, features array<double>, y int")
    grid = ML.ClassifierSearch.grid("lr", LogisticRegression(), {"regParam": [0.01, 0.1, 10.0], "elasticNetParam": [0.0, 1.0]})
    assert len(grid) == 6
    s = ML.ClassifierSearch(3, seed=2)
    assert len(s.random("lr", LogisticRegression(), {"regParam": [0.1, 0.2, 0.3]}, 2)) == 2
    s.halve({"raw": d}, "y", grid, factor=3, least=0.3)
    assert 1 <= len(s.found) <= 2
    name = s.found[0][1]
    oof = s.out_of_fold("raw", name, ["k"])
    assert oof.count() == 120
    stack = ML.Stack.fit([oof, oof], d, ["k"], "y")
    assert stack.transform([oof, oof], ["k"]).join(d, "k").where("prediction = y").count() > 105


def test_parts_resume_where_they_ended(spark, tmp_path, docs):
    w = Workspace(spark, f"file://{tmp_path}/w")
    base = w.save(docs, "docs")
    calls = []

    def compute(part, fail_at=None):
        calls.append(1)
        if len(calls) == fail_at:
            raise RuntimeError("stopped")
        return part.derive(part.view(["text"]).withColumn("n", F.char_length("text")).select(*part.key_columns, "n"), "preserved_key", data=["n"])

    with pytest.raises(RuntimeError):
        w.save_parts("sizes", base, lambda p: compute(p, 3), parts=4)
    out = w.save_parts("sizes", base, compute, parts=4)
    assert rows(out.query(["n", "grp"])) == [(i, 6, "AB"[i % 2]) for i in range(6)] and w.save_parts("sizes", base, compute, parts=4).df.count() == 6


def test_coding_by_hand_goes_on(spark, tmp_path, docs):
    w = Workspace(spark, f"file://{tmp_path}/w")
    coding = BinaryCoding(w, "abuse", docs, "text", "1 if it insults")
    first = coding.pending(2, before=1, after=1)
    assert [p["key"]["row_id"] for p in first] == [0, 1] and first[1]["context"] == ["text 0", "text 1", "text 2"]
    for i in range(5):
        coding.code({"row_id": i}, i % 2)
    again = BinaryCoding(w, "abuse", docs, "text", "1 if it insults")
    assert [p["key"]["row_id"] for p in again.pending(9)] == [5]
    with pytest.raises(ValueError):
        again.finish()
    again.code({"row_id": 5}, 1)
    assert [r.code for r in again.finish().query(["code"]).collect()] == [0, 1, 0, 1, 0, 1]


def test_values_in_memory(spark):
    got = translate_values(spark, ["a|b", "", None, "c"], lambda t: X.decompose(t, "text", "|", "part"))
    assert got == [{"row_id": 0, "part": 0, "text": "a"}, {"row_id": 0, "part": 1, "text": "b"}, {"row_id": 3, "part": 0, "text": "c"}]
    assert translate_values(spark, [], lambda t: t) == []
