"""Clusterings of the embeddings use every coordinate and give each vector's cluster."""

import numpy as np

from verseloom.ml import models as ML
from verseloom.queries import QUERIES


def _save(spark, folder, x):
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def _parts(labels):
    return {frozenset(i for i, c in labels.items() if c == k) for k in set(labels.values()) - {-1}}


def _brute_dbscan(x, eps, least=5):
    near = [set(np.flatnonzero(np.sqrt(((x - v) ** 2).sum(1)) <= eps).tolist()) for v in x]
    core = {i for i, n in enumerate(near) if len(n) >= least}
    parts, left = [], set(core)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in part:
                part.add(i)
                todo += near[i] & core
        parts.append(part)
        left -= part
    return {frozenset(p | {i for c in p for i in near[c]}) for p in parts}


def test_dbscan_is_of_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.zeros((34, 64))  # the first two coordinates are the same for all
    x[:15, 40], x[15:30, 63], x[30:, 2] = 0.4, 0.7, np.arange(1, 5)
    x[:30, 2:] += rng.normal(0, 0.002, (30, 62))
    x[14, 41] += 0.035  # at the edge of the first cluster
    x = x.astype(np.float32).astype(float)
    got = {r.vec_id: r.cluster for r in QUERIES["dbscan_clusters"](spark, _save(spark, tmp_path, x)).collect()}
    want = _brute_dbscan(x, 0.05)
    assert len(got) == 34 and _parts(got) == want and {len(p) for p in want} == {15} and {i for i, c in got.items() if c == -1} == {30, 31, 32, 33}


def _em_step(x, p):
    """Probabilities after one step of expectation maximization from the probabilities ``p``."""
    log = []
    for w in p.T:
        mean = w @ x / w.sum()
        cov = (x - mean).T @ (w[:, None] * (x - mean)) / w.sum()
        log.append(np.log(w.sum() / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
    log = np.array(log).T
    e = np.exp(log - log.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_gaussian_mixture_is_of_whole_vectors(spark, tmp_path):
    """The result is what a step of the method over all 64 coordinates leaves as it is."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.12, (900, 64))
    for b in range(3):  # what tells them apart comes after the fourth coordinate
        x[b * 300 : b * 300 + 300, 10 + 15 * b : 14 + 15 * b] += 0.3
    x = x.astype(np.float32).astype(float)
    found = sorted(QUERIES["gaussian_mixture_clusters"](spark, _save(spark, tmp_path, x)).collect())
    p = np.array([r.features for r in found])
    assert [r.vec_id for r in found] == list(range(900)) and [r.cluster for r in found] == p.argmax(1).tolist()
    assert p.sum(0).min() > 0.5 and len({r.cluster for r in found}) > 1
    assert np.allclose(p.sum(1), 1) and np.abs(_em_step(x, p) - p).mean() < 0.001


def test_dbscan_equals_plain_rules_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ML, "NEAR_BLOCK", 7)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.6, (30, 5)) for c in (0, 2.5, 9)] + [rng.uniform(-5, 12, (15, 5)), np.zeros((4, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, features array<double>")
    for eps, least in ((0.9, 4), (1.5, 3), (0.5, 2)):
        near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
        core = near.sum(1) >= least
        label = np.where(core, np.arange(len(x)), -1)
        for _ in range(len(x)):
            for i in np.flatnonzero(core):
                label[i] = label[near[i] & core].min()
        got = {r.k: r.cluster for r in ML.dbscan(df, ["k"], eps, least).collect()}
        assert len(got) == len(x)
        groups = {}
        for i in np.flatnonzero(core):
            groups.setdefault(got[i], set()).add(label[i])
        assert -1 not in groups and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label[core]))
        for i in np.flatnonzero(~core):
            assert (got[i] == -1) == (not (near[i] & core).any()) and (got[i] == -1 or got[i] in {got[j] for j in np.flatnonzero(near[i] & core)})
