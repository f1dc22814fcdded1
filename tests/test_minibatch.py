"""Mini-batch k-means passes over all rows."""

import numpy as np

from verseloom.ml import models as ML


def test_small_clusters_get_a_centre(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (500, 2)), [[50, 50], [50.1, 50]], [[-60, 40]]])  # two rows, and one
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "k long, features array<double>")
    for seed in range(4):
        out, centres = ML.minibatch_kmeans(df, ["k"], 3, seed=seed)
        got = {r.k: r.cluster for r in out.collect()}
        assert len(got) == 503 and [len({got[i] for i in part}) for part in (range(500), (500, 501), (502,))] == [1, 1, 1] and len(set(got.values())) == 3
        for part in (range(500), (500, 501), (502,)):  # the centres are the means of all rows, not of a sample
            assert np.allclose(centres[got[part[0]]], x[list(part)].mean(0), atol=1e-6)
