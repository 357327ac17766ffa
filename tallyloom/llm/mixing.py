"""Mixing sources to target weights, by Efraimidis-Spirakis sampling in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import WORD, fresh, written


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def quality_weight(size: Column, chars: Column) -> Column:
    """The default weight of a document: 1 for texts of 20 words or more with a usual mean word length, else 0.25."""
    return F.when((size >= 20) & (chars >= 3 * size) & (chars <= 13 * size), 1.0).otherwise(0.25)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number above 0 and below 1 from the document's id; the same in every run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in code-point order, null last.

    Sources share `share` times all sizes by weight; a target stops at most_epochs times its source's size and
    the excess is shared anew. That is min(cap, level * weight); the level is found from running sums over the
    sources by cap / weight, so no loop is needed. Works on one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    listed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1)))
    listed = listed.withColumn("cap", most_epochs * F.col("source_size"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy(F.lit(1))
    listed = (
        listed.withColumn("capped", F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.col("capped")) / F.col("open_weight"))
        .withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    )
    return listed.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0, seed: int = 7, quality: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, epochs.

    taken is size times the epochs a document is taken. Complete epochs take every document of a source. The
    rest of the target goes to documents in the order of their exponential keys -ln(u) / quality, as long as
    the running sum of sizes comes nearer the rest, so a source ends within half a document of its target.
    Null text has size 0 and is never taken; a null source is a source; a null doc_id sorts as any id. Repeated
    rows are documents of their own, with one key; ties fall to the smaller doc_id. quality: a column of docs
    above 0, by default quality_weight.

    Texts are read once: sizes and keys are written, and the rest works on these. No window holds a source: rows are
    ranged over (source, key), each range sums what it has, and the ranges' sums, a row for each source and range,
    give the offsets.
    """
    return _mixed_rows(docs, weights, share, most_epochs, seed, quality).drop("sha")


def _mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0, seed: int = 7, quality: Column | None = None) -> DataFrame:
    """mix's rows, with sha, a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.length(text).alias("chars"), F.xxhash64(text).alias("sha"), (quality if quality is not None else F.lit(None)).cast("double").alias("given"))
    small = small.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce("given", quality_weight(F.col("size"), F.col("chars")))).drop("chars", "given")
    small = written(small, "sizes")
    ranged = written(small.repartitionByRange("source", "key", "doc_id").withColumn("range", F.spark_partition_id()), "mix")
    targets = source_targets(ranged, weights, share, most_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size")).withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    offsets = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("o_source"), F.col("range").alias("o_range"), "before", "source_size", "target", "whole", "rest")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "sha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("upto", F.sum("size").over(within))
    joined = summed.join(offsets, summed["source"].eqNullSafe(offsets["o_source"]) & (summed["range"] == offsets["o_range"]))
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    epochs = F.when(F.col("size") > 0, F.col("whole") + F.when(middle < F.col("rest"), 1).otherwise(0)).otherwise(0).cast("long")
    return joined.withColumn("epochs", epochs).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "epochs", "sha")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as mix takes it, its columns unchanged. Rows that mix never takes go.

    Rows of one doc_id and text are taken as often as mix takes all of them together: each the same number of times, and one of
    them the times that remain.
    """
    own_id, own_sha, t_id, t_sha, each, more, copy = fresh(docs, "own_id", "own_sha", "t_id", "t_sha", "each", "more", "copy")
    rows = _mixed_rows(docs, **options).groupBy(F.col("doc_id").alias(t_id), F.col("sha").alias(t_sha)).agg(F.sum("epochs").alias("e"), F.count("*").alias("n")).where("e > 0")
    taken = rows.select(t_id, t_sha, F.expr("e div n").cast("int").alias(each), F.expr("e % n").cast("int").alias(more))
    sized = docs.withColumns({own_id: docs["doc_id"].cast("long"), own_sha: F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
    joined = sized.join(taken, F.col(own_id).eqNullSafe(F.col(t_id)) & (F.col(own_sha) == F.col(t_sha)))
    whole = joined.where(F.col(each) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).select(docs.columns)
    rest = joined.where(F.col(more) > 0).dropDuplicates([own_id, own_sha]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(more)))).select(docs.columns)
    return whole.unionByName(rest)
