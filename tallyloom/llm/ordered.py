"""Running sums along an order that no task holds whole: ranges are summed on their own, then moved by what came before them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyloom.llm._shared import written


def running_sums(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with each of the long columns `values` replaced by its sum over the rows of the same key up to and with this one, in the order of the columns `order`.

    key: a long, never null. order: nulls first; rows equal in all of it may come in any order. rows should be a written table, as
    finding the ranges reads it once more. Rows are ranged over key and order, so one key's rows lie in as many ranges as
    they fill. Each range sends one row, its first and last key and its last sums, through the driver. Returns a written table.
    """
    schema = StructType([*rows.schema.fields, StructField("range", IntegerType()), StructField("seq", LongType())])
    names = rows.columns

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seq, last, carried = TaskContext.get().partitionId(), 0, None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key)).to_numpy()
            new = np.append(keys[0] != last, np.diff(keys) != 0)
            starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            columns, ends = list(batch.columns), carried.copy()
            for i, name in enumerate(values):
                own = batch.column(names.index(name)).to_numpy()
                upto = np.cumsum(own)
                sums = np.where(starts < 0, upto + carried[i], upto - (upto - own)[np.maximum(starts, 0)])
                columns[names.index(name)], ends[i] = pa.array(sums), sums[-1]
            carried, last = ends, keys[-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(keys), here, np.int32)), pa.array(np.arange(seq, seq + len(keys)))], [*names, "range", "seq"])
            seq += len(keys)

    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = written(ranged.mapInArrow(summed, schema), "ranges")
    ends = local.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.array(*values), "seq").alias("sums"))
    moved, before = [], {}
    for r in sorted(ends.collect()):
        if r["first"] in before:
            moved.append((r["range"], r["first"], before[r["first"]]))
        own = before.get(r["last"], [0] * len(values)) if r["first"] == r["last"] else [0] * len(values)
        before = {r["last"]: [a + b for a, b in zip(own, r["sums"])]}
    if not moved:
        return local.drop("range", "seq")
    offsets = rows.sparkSession.createDataFrame(moved, "range int, moved_key long, by array<long>")
    joined = local.join(F.broadcast(offsets), "range", "left")
    own = (F.col(key) == F.col("moved_key")) & F.col("by").isNotNull()
    return joined.withColumns({v: F.when(own, F.col(v) + F.col("by")[i]).otherwise(F.col(v)) for i, v in enumerate(values)}).select(*names)
