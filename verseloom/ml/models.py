"""Decompositions, clusterings and predictors over dense rows (``pk..., features array<double>``).

What ``pyspark.ml`` has runs there. The methods that need all distances (k-medoids, agglomerative, spectral, OPTICS,
HDBSCAN) are NumPy kernels for at most ``MOST_ROWS`` rows, as their memory is the square of the rows; more is an error.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.matrix.cells import Cells
from verseloom.operators.graph import connected
from verseloom.runtime import Scratch, materialize

#: Rows of a cell that meet as many visitors at a time in DBSCAN.
NEAR_BLOCK = 2000
#: Rows of a method that holds all distances: 800 MB of them on the driver.
MOST_ROWS = 10_000
#: Counted words that a task of word2vec trains on at least, if there are several: with few, the mean over tasks leaves rare words near their start.
WORDS_A_TASK = 10_000_000


def _vectors(df: DataFrame, array: str = "features") -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(array).cast("array<double>")))


def _spread(array: str, name: str, k: int):
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.col(name) == i, 1.0).otherwise(0.0))


def kmeans(df: DataFrame, pk: Sequence[str], k: int, seed: int = 0, spherical: bool = False, max_iter: int = 30) -> tuple[DataFrame, object]:
    """``cluster`` and one-hot ``features``; spherical: by cosine, zero rows are -1."""
    from pyspark.ml.clustering import KMeans

    v = _vectors(df)
    zero = F.forall("features", lambda x: x == 0)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="cluster", distanceMeasure="cosine" if spherical else "euclidean").fit(v.where(~zero) if spherical else v)
    out = model.transform(v.where(~zero) if spherical else v).select(*pk, "cluster")
    if spherical:
        out = out.unionByName(df.where(zero).select(*pk, F.lit(-1).alias("cluster")))
    return out.withColumn("features", _spread("features", "cluster", k)), model


def kmeans_from(df: DataFrame, pk: Sequence[str], centres: np.ndarray, iterations: int = 10, spherical: bool = False) -> tuple[DataFrame, np.ndarray]:
    """``cluster`` of every row by k-means from given centres: so many rounds of moving each centre to the mean of its rows
    (spherical: rows and centres of length 1, zero rows are -1 and move nothing); ties go to the first centre, a centre
    without rows stays. A round is one pass that sums per partition; the driver sees the sums only."""
    centres = np.array(centres, float)

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not spherical:
            return ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        return np.where(np.abs(x).sum(1) > 0, (x @ c.T).argmax(1), -1)

    def rows_of(f) -> np.ndarray:
        x = np.array(f["features"].tolist(), float).reshape(len(f), -1)
        return unit(x) if spherical else x

    centres = unit(centres) if spherical else centres
    v = df.select(*pk, F.col("features").cast("array<double>").alias("features"))
    for _ in range(iterations):

        def sums(frames, centres=centres):
            import pandas as pd

            n, total = np.zeros(len(centres)), np.zeros_like(centres)
            for f in frames:
                x = rows_of(f)
                c = near(x, centres)
                np.add.at(n, c[c >= 0], 1)
                np.add.at(total, c[c >= 0], x[c >= 0])
            yield pd.DataFrame({"c": np.flatnonzero(n), "n": n[n > 0], "total": list(total[n > 0])})

        n, total = np.zeros(len(centres)), np.zeros_like(centres)
        for r in v.select("features").mapInPandas(sums, "c int, n double, total array<double>").collect():
            n[r.c] += r.n
            total[r.c] += r.total
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        centres = unit(new) if spherical else new

    def label(frames):
        for f in frames:
            yield f.drop(columns="features").assign(cluster=near(rows_of(f), centres).astype("int32"))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in pk)
    return v.mapInPandas(label, f"{kinds}, cluster int"), centres


def minibatch_kmeans(df: DataFrame, pk: Sequence[str], k: int, fraction: float = 0.2, seed: int = 0, passes: int = 3) -> tuple[DataFrame, np.ndarray]:
    """``cluster`` of every row, and the centres. The rows are split by key hash into batches of about ``fraction`` of
    the table; each batch in turn moves the centres towards the means of its rows, with a weight that falls as a centre's
    rows grow, and every pass goes over all batches, so over all rows. The first centres are those of k-means|| over all
    rows, which reaches far small clusters too."""
    from pyspark.ml.clustering import KMeans

    if not 0 < fraction <= 1 or passes < 1:
        raise ValueError("fraction must be above 0 and at most 1, passes 1 at least")
    batches = max(1, round(1 / fraction))
    v = materialize(_vectors(df).withColumn("__batch", F.pmod(F.xxhash64(F.lit(seed), *pk), F.lit(batches))), "minibatch")
    first = KMeans(k=k, seed=seed, maxIter=1, featuresCol="__v", predictionCol="cluster").fit(v)
    centres = np.array(first.clusterCenters())
    seen = np.zeros(len(centres))

    def assign(frames, centres):
        import pandas as pd

        for f in frames:
            x = np.array(f["features"].tolist(), float).reshape(len(f), -1)
            near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1) if len(f) else np.zeros(0, int)
            yield f, x, near, pd

    for _ in range(passes):
        for b in range(batches):

            def sums(frames, centres=centres):
                n, total = np.zeros(len(centres)), np.zeros_like(centres)
                for _, x, near, pd in assign(frames, centres):
                    np.add.at(n, near, 1)
                    np.add.at(total, near, x)
                if n.any():
                    yield pd.DataFrame({"c": np.flatnonzero(n), "n": n[n > 0], "total": list(total[n > 0])})

            parts = v.where(F.col("__batch") == b).select(F.col("features").cast("array<double>").alias("features")).mapInPandas(sums, "c int, n double, total array<double>").collect()
            centres = centres.copy()
            n, total = np.zeros(len(centres)), np.zeros_like(centres)
            for r in parts:
                n[r.c] += r.n
                total[r.c] += r.total
            seen += n
            on = n > 0
            centres[on] += (total[on] - n[on, None] * centres[on]) / seen[on, None]

    def label(frames):
        for f, _, near, _ in assign(frames, centres):
            yield f.drop(columns="features").assign(cluster=near)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in pk)
    return v.select(*pk, F.col("features").cast("array<double>").alias("features")).mapInPandas(label, f"{kinds}, cluster int"), centres


def gaussian_mixture(df: DataFrame, pk: Sequence[str], k: int, seed: int = 0) -> tuple[DataFrame, object]:
    from pyspark.ml.clustering import GaussianMixture

    v = _vectors(df)
    model = GaussianMixture(k=k, seed=seed, featuresCol="__v", probabilityCol="__p", predictionCol="cluster").fit(v)
    return model.transform(v).select(*pk, "cluster", vector_to_array("__p").alias("features")), model


def truncated_svd(df: DataFrame, pk: Sequence[str], k: int, array: str = "features") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Uncentered: ``features`` = U·S of each row, the singular values and the components. The Gram matrix (features
    squared, at most 4,096 wide) is summed over the rows by Spark; the rows never leave it."""
    width = df.select(F.size(array).alias("n")).agg(F.max("n").alias("n")).first().n
    if width > 4096:
        raise ValueError("more than 4,096 features: trim them first")

    def gram(frames):
        total = np.zeros((width, width))
        for f in frames:
            x = np.array(f[array].tolist(), float)
            total += x.T @ x
        import pandas as pd

        yield pd.DataFrame({"i": np.arange(width), "r": list(total)})

    parts = df.select(array).mapInPandas(gram, "i int, r array<double>")
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("r")[j]) for j in range(width)]).alias("r")).orderBy("i").collect()
    values, vectors = np.linalg.eigh(np.array([r.r for r in rows]))
    order = np.argsort(values)[::-1][:k]
    sigma, comps = np.sqrt(np.maximum(values[order], 0)), vectors[:, order].T
    comps *= np.where(comps[np.arange(len(comps)), np.abs(comps).argmax(1)] < 0, -1, 1)[:, None]
    out = [F.aggregate(F.zip_with(F.col(array), F.array(*[F.lit(float(c)) for c in comp]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for comp in comps]
    return df.select(*pk, F.array(*out).alias("features")), sigma, comps


def svd_spectrum(df: DataFrame, k: int, array: str = "features") -> DataFrame:
    """``component``, ``sigma`` and ``energy``, its share of the squared Frobenius norm."""
    _, sigma, _ = truncated_svd(df, [], k, array)
    total = df.select(F.sum(F.aggregate(array, F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("t")).first().t
    return df.sparkSession.createDataFrame([(i, float(s), float(min(1.0, s * s / total)) if total else 0.0) for i, s in enumerate(sigma)], "component int, sigma double, energy double")


def cells_svd(m: Cells, k: int, oversample: int = 8, iterations: int = 3, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Uncentered SVD of a sparse matrix of any width: ``(rows, sigma, components)``; rows are ``pk..., features`` = U·S,
    components ``feature_id, features``, a value for each of the ``k``.

    Randomized subspace iteration: the matrix is multiplied by ``k + oversample`` random columns, then ``iterations`` times
    by its transpose and itself, with the columns made orthonormal in between by their Gram matrix, the only thing the
    driver sees (as wide as the columns). A product is a join on the row or feature and a sum by the other."""
    width = k + oversample
    key = list(m.pk)
    sums = lambda c: F.array(*[F.sum(F.col("value") * F.col(c)[j]) for j in range(width)]).alias("b")
    gauss = lambda j: F.sqrt(-2 * F.ln(unit(2 * j))) * F.cos(2 * math.pi * unit(2 * j + 1))
    unit = lambda j: (F.pmod(F.xxhash64(F.lit(seed * 1000 + j), "feature_id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    scratch = Scratch()
    cells = m.cells

    def gram(rows: DataFrame) -> np.ndarray:
        def run(frames):
            import pandas as pd

            total = np.zeros((width, width))
            for f in frames:
                x = np.array(f["b"].tolist(), float).reshape(len(f), width)
                total += x.T @ x
            yield pd.DataFrame({"g": [total.ravel()]})

        return sum((np.array(r.g).reshape(width, width) for r in rows.select("b").mapInPandas(run, "g array<double>").collect()), np.zeros((width, width)))

    def times(rows: DataFrame, by: list[str], matrix: np.ndarray) -> DataFrame:
        out = matrix.shape[1]
        cols = [sum((F.col("b")[i] * float(matrix[i, j]) for i in range(width)), F.lit(0.0)) for j in range(out)]
        return rows.select(*by, F.array(*cols).alias("b"))

    def whiten(g: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(g)
        good = values > values.max(initial=0) * 1e-13
        return vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)

    omega = m.features.select("feature_id", F.array(*[gauss(j) for j in range(width)]).alias("b"))
    y = scratch(cells.join(omega, "feature_id").groupBy(*key).agg(sums("b")), "svd-rows")
    for _ in range(iterations):
        q = times(y, key, whiten(gram(y)))
        z = scratch(cells.join(q, key).groupBy("feature_id").agg(sums("b")), "svd-features")
        w = times(z, ["feature_id"], whiten(gram(z)))
        y = scratch(cells.join(w, "feature_id").groupBy(*key).agg(sums("b")), "svd-rows")
    q = times(y, key, whiten(gram(y)))
    z = scratch(cells.join(q, key).groupBy("feature_id").agg(sums("b")), "svd-features")  # transposed: the matrix's projection
    values, vectors = np.linalg.eigh(gram(z))
    order = np.argsort(values)[::-1][:k]
    sigma = np.sqrt(np.maximum(values[order], 0))
    turn = vectors[:, order]
    comps = materialize(times(z, ["feature_id"], turn / np.where(sigma > 0, sigma, 1.0)).withColumnRenamed("b", "features"), "svd-components")
    widest = comps.agg(*[F.max_by(F.col("features")[j], F.abs(F.col("features")[j])).alias(f"s{j}") for j in range(len(order))]).first()
    sign = np.array([-1.0 if (widest[j] or 0) < 0 else 1.0 for j in range(len(order))])  # the largest part of each is positive
    flip = lambda c: F.array(*[F.col(c)[j] * float(sign[j]) for j in range(len(order))])
    rows = materialize(times(q, key, turn * sigma * sign).withColumnRenamed("b", "features"), "svd-result")
    scratch.release()
    full = m.rows.select(*key).join(rows, key, "left").select(*key, F.coalesce("features", F.array_repeat(F.lit(0.0), len(order))).alias("features"))
    return full, sigma, comps.select("feature_id", flip("features").alias("features"))


def lda(m: Cells, k: int, seed: int = 0, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """Topic shares of every row of a matrix of whole counts, and ``topic``, ``feature_id``, ``feature``, ``weight`` for
    every feature of every topic, a topic's weights summing to 1. Rows are sparse vectors over the whole vocabulary, and
    each of the ``max_iter`` updates sees all of them; a row without a counted feature has equal shares."""
    from pyspark.ml.clustering import LDA

    if m.cells.where((F.col("value") < 0) | (F.col("value") != F.floor("value"))).limit(1).count():
        raise ValueError("LDA needs whole counts")
    ids = m.features.agg(F.min("feature_id").alias("a"), F.max("feature_id").alias("b"), F.count("*").alias("n")).first()
    if not ids.n or (ids.a, ids.b) != (0, ids.n - 1):
        raise ValueError("LDA needs features numbered from 0 without gaps")
    width = ids.n
    packed = m.cells.groupBy(*m.pk).agg(F.array_sort(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("i"), F.col("value").cast("double").alias("x")))).alias("c"))
    sparse = F.udf(lambda c: Vectors.sparse(width, [e.i for e in c or ()], [e.x for e in c or ()]), VectorUDT())
    v = materialize(m.rows.select(*m.pk).join(packed, m.key, "left").select(*m.pk, sparse("c").alias("__v")), "lda")
    model = LDA(k=k, seed=seed, maxIter=max_iter, subsamplingRate=1.0, featuresCol="__v", topicDistributionCol="__t").fit(v)
    shares = F.when(F.col("total") > 0, F.transform("t", lambda x: x / F.col("total"))).otherwise(F.array_repeat(F.lit(1.0 / k), k))
    given = model.transform(v).select(*m.pk, vector_to_array("__t").alias("t")).withColumn("total", F.aggregate("t", F.lit(0.0), lambda a, x: a + x))
    weights = model.topicsMatrix().toArray()
    weights = weights / weights.sum(axis=0)
    spark = m.rows.sparkSession
    import pandas as pd

    long = spark.createDataFrame(pd.DataFrame({"topic": np.tile(np.arange(k), width), "feature_id": np.repeat(np.arange(width), k), "weight": weights.ravel()}), "topic int, feature_id bigint, weight double")
    return given.select(*m.pk, shares.alias("features")), long.join(m.features, "feature_id").select("topic", "feature_id", "feature", "weight")


def word2vec(df: DataFrame, words: str, size: int = 50, min_count: int = 5, seed: int = 0) -> DataFrame:
    """``feature``, its vector and its ``count``. The words are made once and kept as a table. Every word that occurs
    ``min_count`` times is trained on at every place: up to twice ``WORDS_A_TASK`` of them by one task, more by up to as
    many tasks as the cluster has cores, each over its own rows; a word's vector is the mean of those that the tasks gave it."""
    from pyspark.ml.feature import Word2Vec

    scratch = Scratch()
    texts = scratch(df.select(words), "words")
    counts = materialize(texts.select(F.explode(words).alias("feature")).groupBy("feature").count().where(F.col("count") >= min_count), "word-counts")
    places = counts.agg(F.sum("count").alias("n")).first().n or 0
    tasks = max(1, min(places // WORDS_A_TASK, df.sparkSession.sparkContext.defaultParallelism))
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, numPartitions=tasks, inputCol=words, outputCol="__o").fit(texts)
    scratch.release()
    return model.getVectors().select(F.col("word").alias("feature"), vector_to_array("vector").alias("features")).join(counts, "feature")


def random_projection(df: DataFrame, pk: Sequence[str], dims: int = 2, seed: int = 0, array: str = "features") -> DataFrame:
    """A seeded Gaussian projection."""
    width = df.select(F.size(array).alias("n")).limit(1).collect()[0].n
    p = np.random.default_rng(seed).normal(size=(dims, width)) / np.sqrt(dims)
    out = [F.aggregate(F.zip_with(F.col(array), F.array(*[F.lit(float(c)) for c in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in p]
    return df.select(*pk, F.array(*out).alias("features"))


def encode_texts(df: DataFrame, pk: Sequence[str], field: str, encoder: Callable | None) -> DataFrame:
    """Vectors that an injected model gives: ``encoder(list of texts) -> array of rows``, a batch at a time."""
    if encoder is None:
        raise RuntimeError("pass encoder=, a function of a list of texts")
    from verseloom.runtime import map_batches

    def run(*columns):
        texts = [t or "" for t in columns[-1].to_pylist()]
        yield {**dict(zip(pk, columns)), "features": [list(map(float, v)) for v in encoder(texts)]}

    return map_batches(df.select(*pk, field), run, ", ".join(f"{k} bigint" for k in pk) + ", features array<double>")


# -- kernels over bounded rows ---------------------------------------------------------------------------------------


def _local(df: DataFrame, pk: Sequence[str], what: str, array: str = "features") -> tuple[list[tuple], np.ndarray]:
    rows = df.select(*pk, array).orderBy(*pk).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{what} holds all distances: {MOST_ROWS} rows at most")
    return [tuple(r)[:-1] for r in rows], np.array([r[-1] for r in rows], float).reshape(len(rows), -1 if rows else 0)


def _labels(df: DataFrame, pk: Sequence[str], keys: list[tuple], labels: Sequence[int]) -> DataFrame:
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in pk) + ", cluster int"
    return df.sparkSession.createDataFrame([(*k, int(c)) for k, c in zip(keys, labels)], schema)


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))


def kmedoids(df: DataFrame, pk: Sequence[str], k: int, seed: int = 0, max_iter: int = 100) -> DataFrame:
    """Partition around medoids: swaps that lower the total distance most, until none does."""
    keys, x = _local(df, pk, "k-medoids")
    d = distances(x)
    n = len(x)
    if not 0 < k <= n:
        raise ValueError("k must be between 1 and the number of rows")
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:  # the row that lowers the cost most comes next
        near = d[:, medoids].min(1)
        gain = np.maximum(near[None, :] - d, 0).sum(1)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    for _ in range(max_iter):
        part = np.sort(d[:, medoids], axis=1)
        owner = d[:, medoids].argmin(1)
        first, second = part[:, 0], part[:, 1] if k > 1 else np.full(n, np.inf)
        best = (-1e-9, None, None)
        for m in range(k):
            own = owner == m
            base = np.where(own, second, first)
            change = np.minimum(base[None, :], d).sum(1) - first.sum()
            change[medoids] = 0
            c = int(change.argmin())
            if change[c] < best[0]:
                best = (change[c], m, c)
        if best[1] is None:
            break
        medoids[best[1]] = best[2]
    return _labels(df, pk, keys, d[:, medoids].argmin(1))


def umap(df: DataFrame, pk: Sequence[str], dims: int = 2, neighbors: int = 15, min_dist: float = 0.1, epochs: int = 300, seed: int = 0) -> DataFrame:
    """``features``: uniform manifold approximation. Exact nearest neighbours, memberships that sum to log2(neighbors) for
    each row, their fuzzy union, and a layout by attraction along its edges and repulsion from random rows, all seeded."""
    keys, x = _local(df, pk, "UMAP")
    n = len(x)
    rng = np.random.default_rng(seed)
    k = min(neighbors, n - 1)
    if k < 2:
        points = np.zeros((n, dims))
    else:
        d = distances(x)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :k]
        dist = np.take_along_axis(d, near, axis=1)
        del d
        rho = dist[:, :1]
        low, high = np.zeros((n, 1)), np.full((n, 1), np.inf)
        scale = np.maximum(dist.mean(1, keepdims=True), 1e-12)
        for _ in range(64):
            total = np.exp(-np.maximum(dist - rho, 0) / scale).sum(1, keepdims=True)
            over = total > np.log2(k)
            high, low = np.where(over, scale, high), np.where(over, low, scale)
            scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
        one = dict(zip(zip(np.repeat(np.arange(n), k).tolist(), near.ravel().tolist()), np.exp(-np.maximum(dist - rho, 0) / scale).ravel().tolist()))
        edges = {(min(i, j), max(i, j)) for i, j in one}
        tail, head = np.array(sorted(edges)).T
        weight = np.array([(a := one.get((i, j), 0.0)) + (b := one.get((j, i), 0.0)) - a * b for i, j in zip(tail.tolist(), head.tolist())])
        # the curve 1 / (1 + a d^2b) nearest to 1 up to min_dist and an exponential fall beyond
        grid = np.linspace(0, 3, 300)[1:]
        want = np.where(grid <= min_dist, 1.0, np.exp(-(grid - min_dist)))
        a, b = min(((a, b) for a in np.linspace(0.2, 3, 57) for b in np.linspace(0.5, 1.5, 41)), key=lambda ab: ((1 / (1 + ab[0] * grid ** (2 * ab[1])) - want) ** 2).sum())
        centred = x - x.mean(0)
        _, _, axes = np.linalg.svd(centred if n <= 2000 else centred[rng.choice(n, 2000, replace=False)], full_matrices=False)
        points = centred @ axes[:dims].T
        points = np.pad(points, ((0, 0), (0, dims - points.shape[1])))
        points = 10 * points / max(np.abs(points).max(), 1e-12) + rng.normal(scale=1e-4, size=points.shape)
        for epoch in range(epochs):
            rate = 1 - epoch / epochs
            on = rng.random(len(weight)) < weight / weight.max()
            i, j = tail[on], head[on]
            gap = points[i] - points[j]
            sq = (gap * gap).sum(1, keepdims=True)
            pull = np.clip(-2 * a * b * np.maximum(sq, 1e-12) ** (b - 1) / (1 + a * sq**b) * gap, -4, 4) * rate
            move = np.zeros_like(points)
            np.add.at(move, i, pull)
            np.add.at(move, j, -pull)
            for _ in range(5):
                other = rng.integers(0, n, len(i))
                gap = points[i] - points[other]
                sq = (gap * gap).sum(1, keepdims=True)
                np.add.at(move, i, np.where(other[:, None] == i[:, None], 0.0, np.clip(2 * b / ((0.001 + sq) * (1 + a * sq**b)) * gap, -4, 4) * rate))
            degree = np.maximum(np.bincount(i, minlength=n) + np.bincount(j, minlength=n), 1)[:, None]
            points = points + move / np.sqrt(degree)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in pk) + ", features array<double>"
    return df.sparkSession.createDataFrame([(*key, p) for key, p in zip(keys, points.tolist())], schema)


def agglomerative(df: DataFrame, pk: Sequence[str], k: int, linkage: str = "average") -> DataFrame:
    """Merge the two nearest clusters until ``k`` are left (single, complete, average or ward distances)."""
    keys, x = _local(df, pk, "agglomerative clustering")
    n = len(x)
    d = distances(x) ** (2 if linkage == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - k):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        a, b = size[i], size[j]
        if linkage == "single":
            new = np.minimum(d[i], d[j])
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        elif linkage == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        new[[i, j]] = np.inf
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j], size[i] = False, a + b
        label[label == j] = i
    return _labels(df, pk, keys, np.unique(label, return_inverse=True)[1])


def spectral(df: DataFrame, pk: Sequence[str], k: int, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Normalized cuts: leading eigenvectors of the normalized affinity, then k-means on their rows."""
    keys, x = _local(df, pk, "spectral clustering")
    w = np.exp(-gamma * distances(x) ** 2)
    s = 1 / np.sqrt(w.sum(1))
    _, vec = np.linalg.eigh(w * s[:, None] * s[None, :])
    u = vec[:, -k:]
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    rng, best = np.random.default_rng(seed), None
    for _ in range(10):
        c = u[rng.choice(len(u), k, replace=False)]
        for _ in range(50):
            lab = ((u[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([u[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
        cost = ((u - c[lab]) ** 2).sum()
        if best is None or cost < best[0]:
            best = (cost, lab)
    return _labels(df, pk, keys, best[1])


def optics_order(d: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """OPTICS: the order of the rows and their reachability."""
    n = len(d)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        i = int(np.where(done, np.inf, np.where(np.isinf(reach), 1e300, reach)).argmin())
        done[i] = True
        order.append(i)
        reach = np.where(done, reach, np.minimum(reach, np.maximum(core[i], d[i])))
    return np.array(order), reach


def optics(df: DataFrame, pk: Sequence[str], eps: float, min_samples: int = 5) -> DataFrame:
    """Clusters of the OPTICS order at a reachability of ``eps``; noise is -1."""
    keys, x = _local(df, pk, "OPTICS")
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x)) - 1]
    order, reach = optics_order(d, min_samples)
    label, c = np.full(len(x), -1), -1
    for i in order:
        if reach[i] > eps:
            if core[i] <= eps:
                c += 1
                label[i] = c
        else:
            label[i] = c
    return _labels(df, pk, keys, label)


def hdbscan(df: DataFrame, pk: Sequence[str], min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """Density hierarchy: minimum spanning tree of mutual reachability, condensed by cluster size, clusters by excess of
    mass; noise is -1."""
    keys, x = _local(df, pk, "HDBSCAN")
    n, least = len(x), min_cluster_size
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(min_samples or least, n) - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, best, via, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    cur = 0
    for _ in range(n - 1):
        inside[cur] = True
        better = ~inside & (m[cur] < best)
        best[better], via[better] = m[cur][better], cur
        nxt = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[nxt], via[nxt], nxt))
        cur = nxt
    edges.sort()
    root, children, weight, size = list(range(n)), {}, {}, dict.fromkeys(range(n), 1)
    find = lambda a: a if root[a] == a else find(root.__getitem__(a))
    top = n
    for w, a, b in edges:
        a, b = find(a), find(b)
        root.append(top)
        root[a] = root[b] = top
        children[top], weight[top], size[top] = (a, b), w, size[a] + size[b]
        top += 1
    members = lambda c: [c] if c < n else [y for z in children[c] for y in members(z)]

    def walk(c: int, born: float) -> tuple[float, list[int]]:
        """Stability of the best choice of clusters under ``c``, and these clusters."""
        stability, node = 0.0, c
        while node >= n:
            lam = 1 / max(weight[node], 1e-12)
            a, b = children[node]
            big = [z for z in (a, b) if size[z] >= least]
            if len(big) == 2:
                stability += size[node] * (lam - born)
                parts = [walk(z, lam) for z in big]
                below = sum(s for s, _ in parts)
                return (stability, [c]) if stability >= below and c != top - 1 else (below, [x for _, cs in parts for x in cs])
            stability += (size[node] - (size[big[0]] if big else 0)) * (lam - born)
            if not big:
                break
            node = big[0]
        return stability, [c]

    label = np.full(n, -1)
    if n >= least:
        import sys

        sys.setrecursionlimit(max(10_000, 3 * n))
        for i, c in enumerate(walk(top - 1, 0.0)[1]):
            label[members(c)] = i
    return _labels(df, pk, keys, label)


def _axes(df: DataFrame, array: str, width: int, most: int = 2) -> np.ndarray:
    """Orthonormal directions in which the rows spread most: of their covariance, summed by Spark."""
    if width > 4096:
        return np.linalg.qr(np.random.default_rng(0).normal(size=(width, most)))[0].T

    def run(frames):
        import pandas as pd

        total, n, squares = np.zeros(width), 0, np.zeros((width, width))
        for f in frames:
            x = np.array(f[array].tolist(), float).reshape(len(f), width)
            total, n, squares = total + x.sum(0), n + len(f), squares + x.T @ x
        yield pd.DataFrame({"n": [n], "total": [total], "squares": [squares.ravel()]})

    n, total, squares = 0, np.zeros(width), np.zeros(width * width)
    for r in df.select(array).mapInPandas(run, "n bigint, total array<double>, squares array<double>").toLocalIterator():
        n, total, squares = n + r.n, total + np.array(r.total), squares + np.array(r.squares)
    mean = total / max(n, 1)
    return np.linalg.eigh(squares.reshape(width, width) / max(n, 1) - np.outer(mean, mean))[1][:, ::-1][:, :most].T


def dbscan(df: DataFrame, pk: Sequence[str], eps: float, min_samples: int = 5, array: str = "features") -> DataFrame:
    """DBSCAN by grid cells of width ``eps`` over the two directions in which the rows spread most (a projection makes no
    distance longer, so no neighbour is missed). Border rows go to the least of their clusters; noise is -1.

    A row visits its own cell and the eight around it; hosts and visitors of a cell are cut into blocks of ``NEAR_BLOCK``
    rows, and every pair of blocks is a group of its own. Groups first give the number of neighbours of each visitor, then,
    of core rows, links to the first of each component within the group: as many as it has rows, not as it has pairs."""
    width = df.select(F.size(array).alias("n")).limit(1).collect()
    if not width:
        return df.select(*pk, F.lit(-1).alias("cluster"))
    scratch = Scratch()
    axes = _axes(df, array, width[0].n)
    cell = lambda i: F.floor(F.aggregate(F.zip_with(F.col(array), F.array(*[F.lit(float(c)) for c in axes[i]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / (eps * (1 + 1e-9)))
    base = scratch(df.select(F.xxhash64(*pk).alias("id"), *pk, F.col(array).cast("array<double>").alias("v"), cell(0).alias("cx"), (cell(1) if len(axes) > 1 else F.lit(0).cast("bigint")).alias("cy")), "dbscan-cells")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / NEAR_BLOCK)).cast("int")
    hosts = base.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    spread = hosts.select(F.explode(around).alias("o"), "cx", "cy", "n").select((F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), "n")
    sizes = scratch(hosts.select("cx", "cy", blocks(F.col("n")).alias("hb")).join(spread.groupBy("cx", "cy").agg(blocks(F.sum("n")).alias("vb")), ["cx", "cy"]), "dbscan-blocks")

    def grouped(rows: DataFrame) -> DataFrame:
        host = rows.join(sizes, ["cx", "cy"]).withColumn("h", F.pmod(F.xxhash64("id"), F.col("hb")).cast("int")).withColumn("w", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).withColumn("role", F.lit(True))
        moved = rows.withColumn("o", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b")}).drop("o")
        visitor = moved.join(sizes, ["cx", "cy"]).withColumn("w", F.pmod(F.xxhash64("id"), F.col("vb")).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("hb") - 1))).withColumn("role", F.lit(False))
        return host.unionByName(visitor, allowMissingColumns=True).groupBy("cx", "cy", "h", "w")

    def near(f) -> tuple:
        x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
        host = f["role"].to_numpy()
        a, b = x[~host], x[host]
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        close = sq <= eps * eps
        # the expansion is only good to some digits: pairs at the edge are measured again
        i, j = np.nonzero(np.abs(sq - eps * eps) <= 1e-9 * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] + eps * eps))
        close[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(1)) <= eps
        return close, f["id"].to_numpy()[~host], f["id"].to_numpy()[host], host

    def count(f):
        import pandas as pd

        close, ids, _, _ = near(f)
        return pd.DataFrame({"id": ids, "n": close.sum(1)})

    counts = grouped(base.select("id", "v", "cx", "cy")).applyInPandas(count, "id bigint, n bigint")
    core = scratch(counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id"), "dbscan-core")

    def link(f):
        """Links of core rows, and of other rows to core rows: each to the least host of a component of the group."""
        import pandas as pd

        close, ids, host_ids, host = near(f)
        is_core = f["core"].to_numpy()
        mine, theirs = is_core[~host], is_core[host]
        close = close[:, theirs]
        host_ids = host_ids[theirs]
        label = np.arange(close.shape[1])
        inner = close[mine]
        while True:  # least label among the hosts that share a visitor
            at = np.where(inner, label[None, :], close.shape[1]).min(1, initial=close.shape[1])
            new = np.minimum(label, np.where(inner, at[:, None], close.shape[1]).min(0, initial=close.shape[1]))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        rep = host_ids[label] if len(host_ids) else host_ids
        parts = [pd.DataFrame({"a": host_ids, "b": rep, "core": True})]
        if len(host_ids) and len(ids):
            hit = close.any(1)
            first = close[hit].argmax(1)
            joined = pd.DataFrame({"a": ids[hit], "b": rep[first], "core": mine[hit]})
            # a row that isn't core may touch several components of the group
            i, j = np.nonzero(close & ~mine[:, None])
            parts += [joined[joined["core"]], pd.DataFrame({"a": ids[i], "b": rep[j], "core": False}).drop_duplicates()]
        return pd.concat(parts).astype({"a": "int64", "b": "int64", "core": "bool"})

    marked = base.select("id", "v", "cx", "cy").join(core.withColumn("core", F.lit(True)), "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    links = scratch(grouped(marked).applyInPandas(link, "a bigint, b bigint, core boolean"), "dbscan-links")
    linked = connected(links.where("core AND a <> b").select("a", "b"))
    label = scratch(core.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label")), "dbscan-label")
    border = links.where("NOT core").join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
    every = base.join(label.unionByName(border), "id", "left")
    from verseloom.operators.keyed import with_position

    numbered = with_position(label.select("label").distinct(), ["label"], "cluster")
    out = materialize(every.join(numbered, "label", "left").select(*pk, F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster")), "dbscan-result")
    scratch.release()
    return out


# -- predictors ------------------------------------------------------------------------------------------------------


class FittedPredictor:
    """A frozen model's ``prediction`` and ``probability``: of two classes that of class 1, of more one for each class."""

    def __init__(self, model, threshold: float = 0.5):
        self.model, self.threshold = model, threshold

    def transform(self, df: DataFrame, pk: Sequence[str]) -> DataFrame:
        out = self.model.transform(_vectors(df))
        if getattr(self.model, "numClasses", 2) > 2:
            return out.select(*pk, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))
        p = vector_to_array("probability")[1]
        return out.select(*pk, F.when(p >= self.threshold, 1).otherwise(0).alias("prediction"), p.alias("probability"))

    def save(self, path: str) -> None:
        """A portable folder: the model in pyspark.ml's format, and the threshold."""
        from pyspark.sql import SparkSession

        self.model.write().overwrite().save(f"{path}/model")
        kind = type(self.model)
        SparkSession.active().createDataFrame([(kind.__module__, kind.__name__, self.threshold)], "module string, name string, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/predictor")

    @classmethod
    def load(cls, spark, path: str) -> "FittedPredictor":
        import importlib

        r = spark.read.json(f"{path}/predictor").first()
        if not r.module.startswith("pyspark.ml."):
            raise ValueError(f"not a model of pyspark.ml: {r.module}")
        return cls(getattr(importlib.import_module(r.module), r.name).load(f"{path}/model"), r.threshold)


class Stack:
    """A logistic model over the probabilities of other models. ``fit`` takes each member's probabilities for rows that it
    was not fitted to (see :meth:`ClassifierSearch.out_of_fold`)."""

    def __init__(self, model, threshold: float = 0.5):
        self.model, self.threshold = model, threshold

    @staticmethod
    def _joined(members: Sequence[DataFrame], pk: Sequence[str]) -> DataFrame:
        out = members[0].select(*pk, F.col("probability").alias("p0"))
        for i, m in enumerate(members[1:], 1):
            out = out.join(m.select(*pk, F.col("probability").alias(f"p{i}")), list(pk))
        return out.select(*pk, F.array(*[f"p{i}" for i in range(len(members))]).alias("features"))

    @classmethod
    def fit(cls, members: Sequence[DataFrame], labels: DataFrame, pk: Sequence[str], label: str, regularization: float = 1e-4, threshold: float = 0.5) -> "Stack":
        from pyspark.ml.classification import LogisticRegression

        rows = _vectors(cls._joined(members, pk).join(labels.select(*pk, label), list(pk)))
        return cls(LogisticRegression(featuresCol="__v", labelCol=label, regParam=regularization).fit(rows), threshold)

    def transform(self, members: Sequence[DataFrame], pk: Sequence[str]) -> DataFrame:
        return FittedPredictor(self.model, self.threshold).transform(self._joined(members, pk), pk)


def committee(members: Sequence[DataFrame], pk: Sequence[str], weights: Sequence[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Weighted mean of member probabilities, joined by key; 1 from the threshold on."""
    weights = list(weights or [1.0] * len(members))
    out = members[0].select(*pk, F.col("probability").alias("p0"))
    for i, m in enumerate(members[1:], 1):
        out = out.join(m.select(*pk, F.col("probability").alias(f"p{i}")), list(pk))
    p = sum((F.col(f"p{i}") * w for i, w in enumerate(weights)), F.lit(0.0)) / sum(weights)
    return out.select(*pk, F.when(p >= threshold, 1).otherwise(0).alias("prediction"), p.alias("probability"))


class ClassifierSearch:
    """Search over representations and models with the same folds for all: a list of candidates, a grid or random draws of
    its settings, or successive halving. Folds are stratified by the label; groups stay in one fold, stratified by their
    greatest label."""

    def __init__(self, folds: int = 3, seed: int = 0, group: str | None = None):
        self.folds, self.seed, self.group, self.found, self.data = folds, seed, group, [], {}

    @staticmethod
    def grid(name: str, estimator, settings: dict[str, Sequence]) -> dict[str, object]:
        """Every combination of settings of an estimator, by name."""
        keys = sorted(settings)
        return {f"{name}({', '.join(f'{k}={v}' for k, v in zip(keys, vs))})": estimator.copy({estimator.getParam(k): v for k, v in zip(keys, vs)}) for vs in itertools.product(*(settings[k] for k in keys))}

    def random(self, name: str, estimator, settings: dict[str, Sequence], n: int) -> dict[str, object]:
        """``n`` different combinations, drawn by the seed."""
        every = self.grid(name, estimator, settings)
        picked = np.random.default_rng(self.seed).permutation(len(every))[:n]
        return {k: every[k] for i, k in enumerate(every) if i in set(picked.tolist())}

    def _folded(self, r: str, df: DataFrame, label: str) -> DataFrame:
        if r not in self.data:
            from verseloom.operators.keyed import with_position

            keys = [self.group] if self.group else [c for c in df.columns if c not in ("features", label)]
            units = df.groupBy(*keys).agg(F.max(label).alias("__label")).withColumn("__draw", F.xxhash64(F.lit(self.seed), *keys))
            dealt = with_position(units, ["__label", "__draw", *keys], "__place")  # dealt to the folds in turn, label by label
            fold = dealt.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.pmod("__place", F.lit(self.folds)).cast("int").alias("__fold"), "__draw")
            same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
            self.data[r] = materialize(df.join(fold, same).drop(*[f"__k{i}" for i in range(len(keys))]), "folds")
        return self.data[r]

    def _scores(self, r: str, est, label: str, share: float = 1.0) -> list[float]:
        from pyspark.ml.evaluation import BinaryClassificationEvaluator

        score = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
        v = self.data[r]
        # a share of the units, by their draw; the same for every candidate
        some = v if share >= 1 else v.where(F.pmod(F.xxhash64("__draw"), F.lit(1 << 20)) < int(share * (1 << 20)))
        return [score.evaluate(est.fit(_vectors(some.where(F.col("__fold") != k))).transform(_vectors(v.where(F.col("__fold") == k)))) for k in range(self.folds)]

    def fit(self, representations: dict[str, DataFrame], label: str, candidates: dict[str, object]) -> "ClassifierSearch":
        """``candidates``: unfitted ``pyspark.ml`` classifiers by name; may be called again with more."""
        for r, df in representations.items():
            self._folded(r, df, label)
            for name, est in candidates.items():
                est = est.copy({est.featuresCol: "__v", est.labelCol: label})
                parts = self._scores(r, est, label)
                self.found.append((r, name, est, float(np.mean(parts)), float(np.std(parts))))
        return self

    def halve(self, representations: dict[str, DataFrame], label: str, candidates: dict[str, object], factor: int = 3, least: float = 0.1) -> "ClassifierSearch":
        """Successive halving: all candidates are fitted to a small share of the training rows, the best 1 / ``factor`` of
        them to ``factor`` times as much, until those left see all rows. Only these last are among the results."""
        left = []
        for r, df in representations.items():
            self._folded(r, df, label)
            left += [(r, name, est.copy({est.featuresCol: "__v", est.labelCol: label})) for name, est in candidates.items()]
        share = max(least, 1 / factor ** max(0, math.ceil(math.log(max(len(left), 1), factor))))
        while share < 1 and len(left) > 1:
            scored = sorted(((float(np.mean(self._scores(r, est, label, share))), i) for i, (r, _, est) in enumerate(left)), reverse=True)
            left = [left[i] for _, i in sorted(scored[: max(1, math.ceil(len(left) / factor))], key=lambda x: x[1])]
            share *= factor
        for r, name, est in left:
            parts = self._scores(r, est, label)
            self.found.append((r, name, est, float(np.mean(parts)), float(np.std(parts))))
        return self

    def out_of_fold(self, r: str, name: str, pk: Sequence[str]) -> DataFrame:
        """A candidate's ``probability`` for every row, each from the model fitted to the other folds."""
        est = next(e for a, b, e, _, _ in self.found if (a, b) == (r, name))
        out = None
        for k in range(self.folds):
            part = FittedPredictor(est.fit(_vectors(self.data[r].where(F.col("__fold") != k)))).transform(self.data[r].where(F.col("__fold") == k), pk)
            out = part if out is None else out.unionByName(part)
        return out

    fit_more = fit

    def results(self, spark) -> DataFrame:
        rows = [(r, n, m, s) for r, n, _, m, s in sorted(self.found, key=lambda x: -x[3])]
        return spark.createDataFrame(rows, "representation string, model string, mean_auc double, sd_auc double")

    def finalize(self) -> tuple[str, FittedPredictor]:
        """The best candidate, fitted to all rows of its representation."""
        r, _, est, _, _ = max(self.found, key=lambda x: x[3])
        return r, FittedPredictor(est.fit(_vectors(self.data[r])))
