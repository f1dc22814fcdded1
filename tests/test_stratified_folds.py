"""Every fold of the classifier search holds its part of a rare class."""

from pyspark.ml.classification import LogisticRegression

from verseloom.ml import models as ML


def _folds(search, *columns):
    return [tuple(r) for r in search.data["raw"].select(*columns, "__fold").collect()]


def test_rare_class_in_every_fold(spark):
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], int(i in (3, 4, 5))) for i in range(90)], "k long, features array<double>, y int")
    for seed in range(5):
        s = ML.ClassifierSearch(3, seed=seed).fit({"raw": d}, "y", {"lr": LogisticRegression(maxIter=2)})
        got = _folds(s, "k", "y")
        assert sorted(k for k, _, _ in got) == list(range(90)) and sorted(f for _, y, f in got if y) == [0, 1, 2]
        assert {f: sum(g == f for _, _, g in got) for f in range(3)} == {0: 30, 1: 30, 2: 30}


def test_groups_stay_whole_and_are_stratified(spark):
    d = spark.createDataFrame([(i, None if i // 5 == 17 else i // 5, [float(i % 7)], int(i in (10, 31, 62))) for i in range(90)], "k long, g long, features array<double>, y int")
    for seed in range(3):
        s = ML.ClassifierSearch(3, seed=seed, group="g").fit({"raw": d}, "y", {"lr": LogisticRegression(maxIter=2)})
        got = _folds(s, "g", "y")
        assert len(got) == 90 and len({(g, f) for g, _, f in got}) == 18 and sorted(f for _, y, f in got if y) == [0, 1, 2]
