"""Submissions as a stream: each taken once, and published as orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.orders import orders_of
from tallyloom.sources.order_store import commits, publish, read_published


def once_per_session(submissions: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of the submissions (session_id, submitted_at) of a session; one that comes again within `late` goes. State is dropped after that."""
    return submissions.withWatermark("submitted_at", late).dropDuplicatesWithinWatermark(["session_id"])


def publish_submissions(submissions: DataFrame, groups: DataFrame, path: str, batch: str) -> bool:
    """Orders of a batch of submissions (as orders_of takes them) into the store at path, numbered after those there: tables master, details and rejected. False if the batch is there already.

    A session is an order once: those that the store has are passed over, whichever batch they came with.
    """
    spark = submissions.sparkSession

    def make(last: int) -> dict[str, DataFrame]:
        done = spark.createDataFrame([], "session_id string") if commits(spark, path).isEmpty() else read_published(spark, path, "master")
        return orders_of(submissions, groups, done, last, F.current_date())

    return publish(spark, path, batch, make)


def stream_orders(submissions: DataFrame, groups: DataFrame, path: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The stream of submissions into the store at path. A batch goes by `name` and its number, so one that is replayed after a failure is published once. trigger: as DataStreamWriter.trigger takes it."""
    return submissions.writeStream.foreachBatch(lambda batch, n: publish_submissions(batch, groups, path, f"{name}-{n}") and None).option("checkpointLocation", checkpoint).queryName(name).trigger(**trigger).start()
