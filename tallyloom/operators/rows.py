"""Cleaning of form rows that needs their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_fill_items(rows: DataFrame) -> DataFrame:
    """A blank item takes the last one above it on its form; leading blanks stay."""
    above = Window.partitionBy("form_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(F.when(F.trim("item") != "", F.col("item")), ignorenulls=True).over(above)
    return rows.withColumn("item", F.coalesce(filled, "item"))


def expand_ditto(rows: DataFrame) -> DataFrame:
    """An item that begins with two ditto marks or more: alone, the name above; with a rest, the name above with the rest for its last word.

    Each name above is itself expanded, so a form's rows are folded in order, in an array: a form is a page.
    """
    place = lambda r: F.struct(r["row_idx"], r["item"])
    before = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    step = lambda done, row: F.concat(done, F.array(_expanded(F.when(F.size(done) > 0, F.element_at(done, -1)), row["item"])))
    page = rows.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), before).alias("_r"))
    folded = page.withColumn("_items", F.aggregate("_r", F.array().cast("array<string>"), step))
    each = folded.select(F.explode(F.arrays_zip(F.col("_r").alias("r"), F.col("_items").alias("item"))).alias("e"))
    rest = [c for c in rows.columns if c not in ("form_id", "row_idx", "item")]
    return each.select("e.r.form_id", "e.r.row_idx", *(F.col("e.r")[c].alias(c) for c in rest), "e.item")


def _expanded(above, item):
    rest = F.trim(F.regexp_replace(item, r"^[\s\-—–\"'`]{2,}", ""))
    stem = F.when(F.contains(above, F.lit(" ")), F.regexp_replace(above, " [^ ]*$", "")).otherwise(above)  # a name of one word stays whole
    ditto = F.trim(item).rlike(r"^[\s\-—–\"'`]{2,}") & (F.coalesce(above, F.lit("")) != "")
    return F.when(ditto & (rest == ""), above).when(ditto, F.concat_ws(" ", stem, rest)).otherwise(item)


def gate_presence(rows: DataFrame) -> DataFrame:
    """A struck row has no quantity and no printed total."""
    return rows.withColumn("qty", F.when(~F.col("struck_out"), F.col("qty"))).withColumn("row_total", F.when(F.col("struck_out"), "").otherwise(F.col("row_total")))


def gate_date(forms: DataFrame) -> DataFrame:
    """A form without a date has no order_date."""
    return forms.withColumn("order_date", F.when(F.coalesce("date_present", F.lit(True)), F.col("order_date")).otherwise(""))


def shift_rows_vertically(cells: DataFrame, first: DataFrame, down: bool = True) -> DataFrame:
    """cells (form_id, row_idx, size, qty) with the quantities of each row from first (form_id, from_row) on moved to the next row, or the one above.

    Rows are numbered without gaps. Going down, what leaves the form is gone, so rows (form_id, rows) bounds it; going up, the row above from_row takes what moves there.
    """
    moved = F.col("row_idx") >= F.col("from_row")
    placed = cells.join(first, "form_id", "left").withColumn("_to", F.when(moved, F.col("row_idx") + (1 if down else -1)).otherwise(F.col("row_idx")))
    inside = placed.where((F.col("_to") >= 1) & (F.col("rows").isNull() | (F.col("_to") <= F.col("rows"))))
    if not down:  # what stood in the row above is replaced
        inside = inside.where(~F.coalesce((F.col("row_idx") == F.col("from_row") - 1), F.lit(False)))
    return inside.select("form_id", F.col("_to").alias("row_idx"), "size", "qty")
