"""Topics are fitted to every word of every document, and every word has its weight in every topic."""

import numpy as np
import pytest

from tests.conftest import rows
from verseloom.matrix import cells as M
from verseloom.ml import models as ML
from verseloom.queries import QUERIES


def _save(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_topics_see_all_words(spark, tmp_path):
    common = [f"c{i:03d}" for i in range(100)]  # the most frequent words are in all documents alike
    texts = [" ".join(common + [f"{'ab'[d % 2]}{(d // 2 + i) % 30:03d}" for i in range(25)] * 2) for d in range(40)] + ["a001 a002 a003 once", "", None]
    at = _save(spark, tmp_path, texts)
    shares = {r.doc_id: np.array(r.features) for r in QUERIES["lda_topics"](spark, at).collect()}
    assert set(shares) == set(range(43)) and all(s.sum() == pytest.approx(1) and (s >= 0).all() for s in shares.values())
    assert shares[41].tolist() == shares[42].tolist() == [0.25] * 4 and shares[40].max() > 0.5
    weights = rows(QUERIES["lda_terms"](spark, at).select("topic", "feature", "weight"))
    vocabulary = {w for t in texts if t for w in t.split()}
    assert len(vocabulary) == 161 and {(t, f) for t, f, _ in weights} == {(t, f) for t in range(4) for f in vocabulary} and len(weights) == 4 * 161
    for t in range(4):
        assert sum(w for x, _, w in weights if x == t) == pytest.approx(1)


def test_lda_refuses_what_is_no_count(spark):
    m = M.count_vectorize(spark.createDataFrame([(1, "aa bb"), (2, "bb")], "k long, t string"), ["k"], "t")
    with pytest.raises(ValueError):
        ML.lda(m.with_cells(m.cells.selectExpr("k", "feature_id", "value / 2 AS value")), 2)
    with pytest.raises(ValueError):
        ML.lda(M.count_vectorize(spark.createDataFrame([(1, "")], "k long, t string"), ["k"], "t"), 2)
