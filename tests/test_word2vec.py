"""Word vectors: every counted word gets one, large tables train in several tasks at once, and the words are made once."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from verseloom.ml import models as ML


def _texts(n: int = 600) -> list[list[str]]:
    """Of two topics in turn, with 30 words each; a word of its own in every tenth text."""
    rng = np.random.default_rng(3)
    return [[f"{'ab'[d % 2]}{i:02d}" for i in rng.integers(0, 30, 100)] + [f"{'ab'[d % 2]}x{d // 100}"] * (d % 10 < 2) for d in range(n)]


def _training_tasks(spark, group: str) -> int:
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s and s.name.startswith("mapPartitions at Word2Vec"))


def test_large_tables_train_in_several_tasks(spark, monkeypatch):
    texts = _texts()
    want = {w: n for w, n in Counter(w for t in texts for w in t).items() if n >= 5}
    df = spark.createDataFrame([(t,) for t in [*texts, ["once"], []]], "words array<string>").coalesce(1)
    for least, tasks in ((15_000, spark.sparkContext.defaultParallelism), (25_000, 2), (1_000_000, 1)):
        monkeypatch.setattr(ML, "WORDS_A_TASK", least, raising=False)
        spark.sparkContext.setJobGroup(f"word2vec-{tasks}", "word2vec")
        found = ML.word2vec(df, "words", size=16, min_count=5).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert _training_tasks(spark, f"word2vec-{tasks}") == tasks
        assert {r.feature: r["count"] for r in found} == want and len(found) == len(want) == 72
        x = np.array([r.features for r in found])
        assert x.shape == (72, 16) and np.isfinite(x).all()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        same = np.equal.outer(*[np.array([r.feature[0] for r in found])] * 2)
        assert (x @ x.T)[same].mean() - (x @ x.T)[~same].mean() > 0.8  # the rare words' too


def test_words_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def words(t):
        made.add(1)
        return t.split()

    df = spark.createDataFrame([(" ".join(t),) for t in _texts(50)], "t string").select(F.udf(words, "array<string>")("t").alias("words"))
    assert ML.word2vec(df, "words", size=4).count() == 62
    assert made.value == 50
