"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; a cluster's own settings win.

    AQE sizes the shuffle reads, splits skewed join partitions and broadcasts a join side only
    once its size has been measured, so no operator carries a broadcast hint of its own.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8" if master else "2000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    Only when none is configured (tests, a laptop) is a temporary one created.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or context.getConf().get(_CHECKPOINT_KEY)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table below the shared folder; ``drop_scratch`` deletes it."""
    _scratch.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; results that read from them must be saved before."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    done = 0
    while _scratch:
        path = paths(_scratch.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here delete their shuffle files when they end; otherwise these stay until the driver collects its garbage.

    A table that is read again later has to be made outside.
    """
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)


def stored(df: DataFrame, label: str, *parts: str) -> DataFrame:
    """Write a table to the shared folder and read it back, as often as it is joined with itself; survives the loss of executors.

    Its files lie by the columns ``parts``, which have few values and no null, so that a filter on them opens no other file. Of what it
    was made from nothing stays on disk.
    """
    path = scratch_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    folders = {file.rsplit("/", 2)[1] for file in df.inputFiles()}
    for path in [p for p in _scratch if p.rsplit("/", 1)[1] in folders]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scratch.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage and drop the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)
