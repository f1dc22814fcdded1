"""Session helpers shared by all operators: shared storage, lineage cuts, Arrow batch maps, key handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per Arrow batch. Texts may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Set session options that the operators rely on; an option the user already set stays as it is."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        if spark.conf.get(key, None) in (None, "10000"):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a folder of our own is made, and deleted when Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("verseloom.scratch.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="verseloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = f"file://{own}"
            spark.conf.set("verseloom.scratch.dir", found)
    return found.rstrip("/")


#: Folders of this process's applications that are deleted when Python ends.
_FOLDERS: set[str] = set()


def application_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when Python ends, or by :func:`clear_materialized`."""
    folder = f"{shared_dir(spark)}/verseloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def _delete(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone when Python ends
        pass


def clear_materialized(spark: SparkSession) -> None:
    """Delete every table that this application has materialized; results that still read them can't be used after it."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), application_dir(spark))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives a lost executor,
    and gives later plans true sizes."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` once no later plan reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        if "/verseloom-" in folder:
            _delete(spark._jvm, spark._jsc.hadoopConfiguration(), folder)


class Scratch:
    """Materializes the steps of one operator and deletes them together once its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str = "step") -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def release(self) -> None:
        for t in self.tables:
            drop_materialized(t)
        self.tables = []


def map_batches(df: DataFrame, fn: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(*columns)`` over the batch's columns as Arrow arrays; ``fn`` gives dicts of lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(*batch.columns):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def pretty_size(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``; scans of written tables give true sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def one_per_key(df: DataFrame, keys: Sequence[str], columns: Sequence[str], latest: str | None = None) -> DataFrame:
    """One row for each key: the row with the greatest ``latest`` (ties by content hash). Rows with a null key are left out.

    Aggregates before the shuffle, so that a key that is repeated very often costs one row per task."""
    present = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    picked = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    order: list[Column] = [F.col(f"`{latest}`")] if latest else []
    order.append(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns]))
    out = present.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(picked, F.struct(*order)).alias("__row"))
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"__row.`{c}`").alias(c) for c in columns])


def count_keys(df: DataFrame, keys: Sequence[str]) -> int:
    """Number of distinct non-null keys."""
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys).distinct().count()


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def builder(app: str = "verseloom", cores: int | None = None):
    """A session builder for local use; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores or os.cpu_count()}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores or 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
