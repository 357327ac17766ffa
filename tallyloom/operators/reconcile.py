"""Two readings of the same cells, and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import sort_sizes

#: How severe a flag's status is.
SEVERITY = {"no_recount": 0, "ok": 0, "unverified": 1, "resolved": 2, "auto_corrected": 2, "template_corrected": 2, "unresolved": 3}


def reconcile_readings(first: DataFrame, second: DataFrame, totals: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Per row (form_id, row_idx): chosen reading and status, from two readings (form_id, row_idx, size, qty), printed totals and printed headers (form_id, size).

    An empty side, a size of the first that is no printed header, or equal sides: first, no flag. Other sizes: first, unverified.
    Same sizes, other values: the only side whose sum is the printed total, resolved; else first, unresolved.

    Readings and totals are one table, dealt by form once; sizes, rows and the form's headers, an array, then meet where they are.
    """
    key = ["form_id", "row_idx"]
    none, q = F.lit(None).cast("long"), F.col("qty").cast("long")
    part = lambda rows, size, a, b, total: rows.select(*key, size.alias("size"), a.alias("a"), b.alias("b"), total.alias("total"), F.lit(size is none).alias("printed"))
    size = F.col("size")
    parts = part(first, size, q, none, none).unionByName(part(second, size, none, q, none)).unionByName(part(totals, none, none, none, F.col("total").cast("long")).withColumn("size", F.lit(None).cast("string")))
    cells = parts.repartition("form_id").groupBy(*key, "size", "printed").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("total").alias("total"))
    foreign = F.lit(False)
    if headers is not None:
        cells = cells.join(headers.groupBy("form_id").agg(F.collect_set("size").alias("known")), "form_id", "left")
        foreign = F.col("a").isNotNull() & ~F.coalesce(F.array_contains("known", F.col("size")), F.lit(False))
    joined = cells.groupBy(*key).agg(
        F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.max("total").alias("total"), F.max(~F.col("printed") & (F.col("a").isNull() | F.col("b").isNull())).alias("other_sizes"), F.max(F.col("a") != F.col("b")).alias("other_values"), F.max(foreign).alias("foreign"), F.min("printed").alias("alone")
    ).where(~F.col("alone"))
    on_a, on_b = F.coalesce(F.col("sum_a") == F.col("total"), F.lit(False)), F.coalesce(F.col("sum_b") == F.col("total"), F.lit(False))
    kept = F.col("sum_a").isNull() | F.col("sum_b").isNull() | F.col("foreign")
    differ = F.coalesce("other_values", F.lit(False))
    status = F.when(kept, "ok").when(F.col("other_sizes"), "unverified").when(~differ, "ok").when(on_a != on_b, "resolved").otherwise("unresolved")
    chosen = F.when(~kept & ~F.col("other_sizes") & differ & on_b & ~on_a, "second").otherwise("first")
    return joined.select(*key, "sum_a", "sum_b", "total", status.alias("status"), chosen.alias("chosen"))


def flag_total_mismatch(rows: DataFrame) -> DataFrame:
    """Rows (form_id, row_idx, sum, total) whose sum is not the printed total: off by 1 or 2 unverified, by more unresolved."""
    off = F.abs(F.col("sum") - F.col("total"))
    return rows.where((F.col("total") > 0) & (F.col("sum") > 0) & (off > 0)).select("form_id", "row_idx", F.when(off > 2, "unresolved").otherwise("unverified").alias("status"))


def coverage_guard(marks: DataFrame, cells: DataFrame, least: float = 0.6) -> DataFrame:
    """Per form with cells: marks found, cells filled, and whether the marks are enough to be used."""
    found, filled = marks.groupBy("form_id").agg(F.count("*").alias("marks")), cells.where("qty > 0").groupBy("form_id").agg(F.count("*").alias("cells"))
    return filled.join(found, "form_id", "left").select("form_id", F.coalesce("marks", F.lit(0)).alias("marks"), "cells", (F.coalesce("marks", F.lit(0)) >= least * F.col("cells")).alias("used"))


def coverage_flags(marks: DataFrame, cells: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows with a quantity on forms whose marks are too few to be used: unverified, on no size."""
    down = coverage_guard(marks, cells, least).where(~F.col("used")).select("form_id")
    rows = cells.where("qty > 0").select("form_id", "row_idx").distinct().join(down, "form_id", "left_semi")
    return rows.select("form_id", "row_idx", F.lit("unverified").alias("status"), F.array().cast("array<string>").alias("sizes"))


def merge_flags(flags: DataFrame) -> DataFrame:
    """One flag for each row: the most severe status, the first of equals; all sizes sorted; notes in order of arrival joined by ' | '."""
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("status"))
    return flags.groupBy("form_id", "row_idx").agg(
        F.min_by("status", F.struct(-severity, F.col("seq"))).alias("status"),
        F.array_join(sort_sizes(F.array_distinct(F.flatten(F.collect_list("sizes")))), ",").alias("sizes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("note", F.lit("")) != "", F.struct("seq", "note")))), lambda x: x["note"]), " | ").alias("note"),
    )


def compare_readings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per form: rows, and rows whose cells are the same in both readings."""
    joined = first.select("form_id", "row_idx", "size", F.col("qty").alias("a")).join(second.select("form_id", "row_idx", "size", F.col("qty").alias("b")), ["form_id", "row_idx", "size"], "full")
    rows = joined.groupBy("form_id", "row_idx").agg(F.min(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    return rows.groupBy("form_id").agg(F.count("*").alias("rows"), F.count_if("same").alias("agree"))


def override_flags(hybrid: DataFrame, recount: DataFrame) -> DataFrame:
    """One status for each row (form_id, row_idx, status): the recount's, unless it has none, or says no more than ok or no_recount."""
    key = ["form_id", "row_idx"]
    joined = hybrid.select(*key, "status").join(recount.select(*key, F.col("status").alias("_r")), key, "full")
    return joined.select(*key, F.when(F.coalesce("_r", F.lit("ok")).isin("ok", "no_recount"), F.coalesce("status", "_r")).otherwise(F.col("_r")).alias("status"))


def catalog_flags(rows: DataFrame) -> DataFrame:
    """Rows (form_id, row_idx, offset, sizes, outside) whose column seems shifted: resolved, on their sizes; else those with sizes that the catalog lacks: unverified, on these."""
    shifted = F.col("offset").isNotNull()
    flagged = rows.where(shifted | (F.size("outside") > 0))
    return flagged.select("form_id", "row_idx", F.when(shifted, "resolved").otherwise("unverified").alias("status"), F.when(shifted, F.col("sizes")).otherwise(F.col("outside")).alias("sizes"))


def flag_failed_rows(errors: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (form_id, row_idx, error) that could not be read a second time: unverified, on the sizes of the first reading."""
    failed = errors.where("error is not null").select("form_id", "row_idx").distinct()
    sizes = cells.join(failed, ["form_id", "row_idx"], "left_semi").groupBy("form_id", "row_idx").agg(sort_sizes(F.collect_set("size")).alias("sizes"))
    return failed.join(sizes, ["form_id", "row_idx"], "left").select("form_id", "row_idx", F.lit("unverified").alias("status"), F.coalesce("sizes", F.array().cast("array<string>")).alias("sizes"))


def display_flags(flags: DataFrame) -> DataFrame:
    return flags.where(~F.coalesce("status", F.lit("ok")).isin("ok", "no_recount"))


def struck_out_conflict(rows: DataFrame) -> DataFrame:
    """Struck rows (form_id, row_idx, struck_out, marks): those with marks are unresolved, the marks kept."""
    return rows.where(F.col("struck_out") & (F.col("marks") > 0)).select("form_id", "row_idx", F.lit("unresolved").alias("status"))


def drift_trend(anchors: DataFrame) -> DataFrame:
    """Per form the line of catalog-confirmed offsets by place on the page (form_id, y, offset); null under three anchors or a spread below 0.08."""
    fit = anchors.groupBy("form_id").agg(F.count("*").alias("anchors"), (F.max("y") - F.min("y")).alias("_spread"), F.regr_slope("offset", "y").alias("_a"), F.regr_intercept("offset", "y").alias("_b"))
    enough = (F.col("anchors") >= 3) & (F.col("_spread") >= 0.08)
    return fit.select("form_id", "anchors", F.when(enough, F.col("_a")).alias("slope"), F.when(enough, F.col("_b")).alias("intercept"))


def drift_hints(rows: DataFrame, trend: DataFrame) -> DataFrame:
    """Unresolved rows (form_id, row_idx, y, status, matched) without a catalog match, with the offset that their form's trend predicts, rounded half to even; those of offset 0 go."""
    joined = rows.where("status = 'unresolved' and not matched").join(trend.where("slope is not null"), "form_id")
    return joined.select("form_id", "row_idx", F.bround(F.col("slope") * F.col("y") + F.col("intercept")).cast("int").alias("offset")).where("offset <> 0")


def row_centres_valid(rows: DataFrame) -> DataFrame:
    """Per form (form_id, row_idx, top, bottom), the loose check: whether the centres of rows of some height go down the page, within 0.005. Rows without height are passed over."""
    order = Window.partitionBy("form_id").orderBy("row_idx")
    centres = rows.where("bottom > top").withColumn("_c", (F.col("top") + F.col("bottom")) / 2)
    placed = centres.withColumn("_above", F.lag("_c").over(order))
    found = placed.groupBy("form_id").agg(F.bool_and(F.col("_above").isNull() | (F.col("_c") >= F.col("_above") - 0.005)).alias("valid"))
    return rows.select("form_id").distinct().join(found, "form_id", "left").select("form_id", F.coalesce("valid", F.lit(False)).alias("valid"))


def row_fracs_valid(rows: DataFrame) -> DataFrame:
    """Per form (form_id, row_idx, top, bottom, table_bottom): whether its rows are at least 0.008 high, on the page, in order and within the table."""
    order = Window.partitionBy("form_id").orderBy("row_idx")
    placed = rows.withColumn("_above", F.lag("bottom").over(order)).withColumn("_last", F.lead("row_idx").over(order).isNull())
    good = (F.col("top") >= 0) & (F.col("top") < F.col("bottom")) & (F.col("bottom") <= 1) & (F.col("bottom") - F.col("top") >= 0.008)
    good &= F.col("_above").isNull() | (F.col("top") >= F.col("_above") - 0.01)
    good &= ~F.col("_last") | (F.col("bottom") <= F.col("table_bottom") + 0.02)
    return placed.groupBy("form_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("valid"))
