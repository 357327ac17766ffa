"""Totals and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_totals(cells: DataFrame) -> DataFrame:
    """Rows, filled cells, pieces and unbound rows with pieces (bsid null) of each page, of each session (page null), and of all (both null). One row for each row first, so no distinct count is needed."""
    rows = cells.groupBy("session_id", "page", "row_idx").agg(F.sum((F.col("qty") > 0).cast("long")).alias("n"), F.sum("qty").alias("q"), F.count("bsid").alias("b"))
    unbound = ((F.col("q") > 0) & (F.col("b") == 0)).cast("long")
    return rows.rollup("session_id", "page").agg(F.count("*").alias("rows"), F.sum("n").alias("filled"), F.sum("q").alias("pieces"), F.coalesce(F.sum(unbound), F.lit(0)).alias("unbound"))


def size_column_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("session_id", "page", "size").agg(F.sum("qty").alias("pieces"))


def order_totals(cells: DataFrame) -> DataFrame:
    """page_totals and size_column_totals in one pass: (level, session_id, page, size, rows, filled, pieces, unbound) for each size of a page, each page, each session and all.

    level says which: size, page, session or all. A size has no rows and unbound rows of its own: these are null. A row's cells meet first, so that it counts once.
    """
    row = cells.groupBy("session_id", "page", "row_idx").agg(F.collect_list(F.struct("size", "qty")).alias("cells"), ((F.coalesce(F.sum("qty"), F.lit(0)) > 0) & (F.count("bsid") == 0)).alias("unbound"))
    listed = row.select("session_id", "page", "unbound", F.posexplode("cells").alias("pos", "c")).select("session_id", "page", "c.size", "c.qty", (F.col("pos") == 0).alias("first"), "unbound")
    sets = [["session_id", "page", "size"], ["session_id", "page"], ["session_id"], []]
    whole = F.grouping_id() > 0
    return listed.groupingSets([[F.col(c) for c in s] for s in sets], "session_id", "page", "size").agg(
        F.element_at(F.create_map(*(F.lit(x) for kv in ((0, "size"), (1, "page"), (3, "session"), (7, "all")) for x in kv)), F.grouping_id().cast("int")).alias("level"),
        F.when(whole, F.count_if("first")).alias("rows"), F.count_if(F.col("qty") > 0).alias("filled"), F.sum("qty").alias("pieces"), F.when(whole, F.count_if(F.col("first") & F.col("unbound"))).alias("unbound"),
    ).select("level", "session_id", "page", "size", "rows", "filled", "pieces", "unbound")


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost in dollars; null for a model without a price. Reads from the cache cost a tenth, writes a quarter more, batches half."""
    joined = calls.join(F.broadcast(prices), "model", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = (n("input_tokens") * F.col("p_in") + n("cache_read_tokens") * F.col("p_in") * 0.1 + n("cache_write_tokens") * F.col("p_in") * 1.25 + n("output_tokens") * F.col("p_out")) / 1e6
    return joined.withColumn("cost", cost * F.when(F.col("mode") == "batch", 0.5).otherwise(1.0)).drop("p_in", "p_out")


def usage_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model", "mode").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.count("error").alias("errors"))


def usage_by_image(calls: DataFrame) -> DataFrame:
    """Per image, model and mode: calls, tokens, cost (null where no price is known), errors, seconds of all calls together and from the first call's start to the last one's end."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    wall = F.max(start + F.coalesce(F.col("duration_seconds") * 1e6, F.lit(0.0))) - F.min(start)
    return calls.groupBy("image", "model", "mode").agg(F.count("*").alias("calls"), n("input_tokens"), n("output_tokens"), F.sum("cost").alias("cost"), F.count("error").alias("errors"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("seconds"), (wall / 1e6).alias("wall_seconds"))
