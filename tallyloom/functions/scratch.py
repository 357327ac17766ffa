"""Tables in between, in the shared folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a Python worker. Spark's 10,000 rows of text are tens of MB, which executor and worker hold several times and keep.
BATCH_BYTES = 1 << 21
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: list[str] = []


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. A local session without that setting, as in tests, gets a temporary folder; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    _made.append(f"{root}/tallyloom/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, what runs sends Arrow batches of some BATCH_BYTES, unless the session says how large they are; a batch has a row at least."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, in small batches, into a table of the shared folder and read from there: it survives lost executors and ends the lineage."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders in the file system that they are in."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every folder that this process has had from scratch; call it once no result that stands on them is needed."""
    removed(spark, *_made)
    _made.clear()
