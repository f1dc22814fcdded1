import numpy as np
import pytest

from tests.conftest import rows
from verseloom.ml import models as ML
from verseloom.stats import estimation as E


def test_generalized_difference(spark):
    frame = spark.createDataFrame([(3, 1), (0, 0), (2, 1), (1, 0)], "k long, q int")
    gold = spark.createDataFrame([(2, 1, 0.5), (0, 1, 0.5)], "k long, y int, pi double")
    r = E.generalized_difference(frame, gold, ["k"]).first()
    assert (r.population, r.audit, r.surrogate_total, r.total) == (4, 2, 2.0, 4.0)
    by = E.generalized_difference_by(frame.selectExpr("k", "q", "k % 2 AS g"), gold, ["k"], "g")
    assert rows(by.select("g", "n", "audit", "total"), "g") == [(0, 2, 2, 3.0), (1, 2, 0, 1.0)]
    assert E.contrast(by, "g", 0, 1) == 1.0
    for bad in (spark.createDataFrame([(2, 1, 1.5)], "k long, y int, pi double"), spark.createDataFrame([(9, 1, 0.5)], "k long, y int, pi double")):
        with pytest.raises(ValueError):
            E.generalized_difference(frame, bad, ["k"]).collect()


def test_known_outcomes(spark):
    frame = spark.createDataFrame([(0, 9), (1, 1), (2, 1), (3, 1), (4, 1)], "k long, q int")
    gold = spark.createDataFrame([(3, 4, 0.5), (1, 2, 0.5)], "k long, y int, pi double")
    known = spark.createDataFrame([(0, 5)], "k long, y int")
    r = E.generalized_difference(frame, gold, ["k"], known=known).first()
    assert r.total == 17 and r.mean == pytest.approx(17 / 5)


def test_variances():
    assert E.srs_variance(10, 10, 4.0) == 0.0 and E.srs_variance(10, 1, None) is None
    assert E.srs_variance(10, 5, 4.0) == pytest.approx(100 * 0.5 * 4 / 5)


def test_quantiles(spark, monkeypatch):
    df = spark.range(1, 2001).selectExpr("id AS y", "id % 3 + 1 AS w")
    import itertools

    w = [(i, i % 3 + 1) for i in range(1, 2001)]
    total = sum(x for _, x in w)
    want = next(y for (y, _), c in zip(w, itertools.accumulate(x for _, x in w)) if c >= 0.7 * total)
    assert E.left_weighted_quantile(df, "y", 0.7, "w") == want
    monkeypatch.setattr(E, "MOST_ORDERED", 50)
    assert E.left_weighted_quantile(df, "y", 0.7, "w") == want and E.left_weighted_quantile(df, "y", 0.0) == 1 and E.left_weighted_quantile(df, "y", 1.0) == 2000
    assert E.isotonic([1, 3, 2, 4]) == [1, 2.5, 2.5, 4]
    low, high = E.quantile_rank_interval(100, 30, 0.5)
    assert 1 <= low < 15 < high <= 30


def test_classification(spark):
    gold = spark.createDataFrame([(0, 1, 0.5), (1, 0, 1.0), (2, 1, 0.5)], "k long, y int, pi double")
    pred = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (9, 1)], "k long, q int")
    r = {x.weights: x for x in E.classification(gold, pred, ["k"], pi="pi").collect()}
    assert (r["raw"].tp, r["raw"].fp, r["raw"].fn, r["raw"].accuracy) == (1, 1, 1, pytest.approx(1 / 3))
    assert (r["weighted"].tp, r["weighted"].precision) == (2.0, pytest.approx(2 / 3))
    with pytest.raises(ValueError):
        E.classification(gold, pred.where("k = 0"), ["k"]).collect()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "k long, features array<double>")


@pytest.mark.parametrize("fit", [lambda d: ML.kmeans(d, ["k"], 3)[0], lambda d: ML.kmedoids(d, ["k"], 3), lambda d: ML.agglomerative(d, ["k"], 3), lambda d: ML.agglomerative(d, ["k"], 3, "ward"), lambda d: ML.spectral(d, ["k"], 3), lambda d: ML.dbscan(d, ["k"], 0.6), lambda d: ML.optics(d, ["k"], 0.6), lambda d: ML.hdbscan(d, ["k"], 5)])
def test_clusterings_find_the_blobs(blobs, fit):
    got = {r.k: r.cluster for r in fit(blobs).collect()}
    parts = [{got[i] for i in range(a, a + 20)} - {-1} for a in (0, 20, 40)]
    assert len(got) == 60 and all(len(p) == 1 for p in parts) and len(set().union(*parts)) == 3


def test_svd_matches_numpy(blobs):
    x = np.array([r.features for r in blobs.orderBy("k").collect()])
    out, sigma, _ = ML.truncated_svd(blobs, ["k"], 2)
    assert np.allclose(sigma, np.linalg.svd(x, compute_uv=False))
    got = np.array([r.features for r in out.orderBy("k").collect()])
    assert np.allclose(got @ got.T, x @ x.T)


def test_search_and_committee(spark, blobs):
    from pyspark.ml.classification import LogisticRegression

    d = blobs.selectExpr("k", "features", "IF(k < 20, 1, 0) AS y")
    s = ML.ClassifierSearch(2).fit({"raw": d}, "y", {"lr": LogisticRegression(), "ridge": LogisticRegression(regParam=0.001)})
    assert s.results(spark).count() == 2
    _, best = s.finalize()
    p = best.transform(d, ["k"])
    assert p.join(d, "k").where("prediction = y").count() == 60
    assert ML.committee([p, p], ["k"]).count() == 60
