"""Orders published once: a batch's tables are written first, below folders of their own, and count from one commit file on."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scratch import removed

_COMMIT = "version long, batch string, folder string, last_no long"


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file; False, and nothing done, if there is one. Of two writers at once one gets True, on a local disk and on every store whose create without overwriting is atomic, as HDFS's is."""
    system, where = _hadoop(spark, path)
    system.mkdirs(where.getParent())
    if system.getUri().getScheme() == "file":
        try:
            with os.fdopen(os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as file:
                file.write(text)
            return True
        except FileExistsError:
            return False
    try:
        out = system.create(where, False)
    except Exception:
        if system.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    """version, batch, folder, last_no of every batch published. The file of a writer that was lost before it had written its line has no row."""
    system, where = _hadoop(spark, f"{path}/commits")
    if not system.exists(where):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/commits").where("folder is not null")


def publish(spark: SparkSession, path: str, batch: str, make: Callable[[int], dict[str, DataFrame]], attempts: int = 10) -> bool:
    """The tables that make gives for a batch, all of them or none, once; False if the batch is published already.

    make gets the last order number given so far; its table master has order_no. The commit of a version can be put once: a writer that finds
    another one's there drops its tables and makes them anew on top of that one's numbers. Tables of a batch that failed are
    never read; the batch is made anew when it comes again.
    """
    for _ in range(attempts):
        known = commits(spark, path).agg(F.max("version"), F.max("last_no"), F.count_if(F.col("batch") == batch)).first()
        if known[2]:
            return False
        last, folder = known[1] or 0, f"b-{uuid.uuid4().hex}"
        names = []
        for name, table in make(last).items():
            names.append(name)
            table.write.parquet(f"{path}/{name}/folder={folder}")
        highest = spark.read.parquet(f"{path}/master/folder={folder}").agg(F.max("order_no")).first()[0]
        # a version whose file exists without a line is passed over
        version = (known[0] or 0) + 1
        while True:
            line = {"version": version, "batch": batch, "folder": folder, "last_no": max(last, highest or 0)}
            if put_if_absent(spark, f"{path}/commits/{version:020d}.json", json.dumps(line)):
                return True
            if not commits(spark, path).where(F.col("version") >= version).isEmpty():
                break
            version += 1
        removed(spark, *(f"{path}/{name}/folder={folder}" for name in names))
    raise RuntimeError(f"other writers came first {attempts} times")


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the batches that are published, with batch. Folders of batches that failed are not opened, neither for rows nor for column types. Commits are few beside rows; whether they are broadcast goes by their size."""
    known = commits(spark, path).select("folder", "batch")
    published = {f"folder={r['folder']}" for r in known.collect()}
    system, where = _hadoop(spark, f"{path}/{table}")
    own = sorted(published & {s.getPath().getName() for s in system.listStatus(where)})
    if not own:
        return spark.read.parquet(f"{path}/{table}").join(known, "folder").drop("folder")
    return spark.read.option("basePath", f"{path}/{table}").parquet(*(f"{path}/{table}/{name}" for name in own)).join(known, "folder").drop("folder")
