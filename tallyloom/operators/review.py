"""Forms, pages and orders as a reviewer sees them, and how what is submitted differs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.functions.scratch import fresh
from tallyloom.functions.text import normalize_name
from tallyloom.operators.orders import numbered


def flatten_review(forms: DataFrame) -> DataFrame:
    """forms (form_id, notes, items: (item, kind, quantities: (size, qty))) as a row for each size; a form without items and an item without quantities are one row, null where there is nothing."""
    items = forms.select("form_id", F.array_join("notes", "; ").alias("notes"), F.explode_outer("items").alias("i"))
    cells = items.select("form_id", "notes", F.col("i.item").alias("item"), F.col("i.kind").alias("kind"), F.explode_outer("i.quantities").alias("q"))
    return cells.select("form_id", "notes", "item", "kind", F.col("q.size").alias("size"), F.col("q.qty").alias("qty"))


def order_header_from_pages(pages: DataFrame) -> DataFrame:
    """Per session the first order_no, order_date and party_name in page order that are not blank, and whether its pages name several buyers."""
    first = lambda c: F.min_by(F.col(c), F.when(F.trim(c) != "", F.col("page"))).alias(c)
    name = F.nullif(normalize_name(F.col("party_name")), F.lit(""))
    return pages.groupBy("session_id").agg(first("order_no"), first("order_date"), first("party_name"), (F.min(name) < F.max(name)).alias("several")).withColumn("several", F.coalesce("several", F.lit(False)))


def session_status(pages: DataFrame) -> DataFrame:
    """Per session: processing while a page is queued or running, error if all failed, else ready."""
    status = F.when(F.bool_or(F.col("status").isin("queued", "running")), "processing").when(F.bool_and(F.col("status") == "error"), "error").otherwise("ready")
    return pages.groupBy("session_id").agg(status.alias("status"))


def lookup_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): how many rows each table has."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def page_notes(notes: DataFrame, flags: DataFrame) -> DataFrame:
    """Notes (form_id, note) that are not the note of a flag of a row of the form."""
    return notes.join(flags.select("form_id", "note"), ["form_id", "note"], "left_anti")


def total_vs_printed(cells: DataFrame, printed: DataFrame) -> DataFrame:
    """Rows with their sum, the printed total and whether they differ; without a printed total they do not."""
    key = ["form_id", "row_idx"]
    sums = cells.groupBy(*key).agg(F.sum("qty").alias("sum")).join(printed.select(*key, "total"), key, "left")
    return sums.withColumn("differs", F.coalesce(F.col("sum") != F.col("total"), F.lit(False)))


def drop_summary_rows(rows: DataFrame) -> DataFrame:
    """rows (label, cells: array) without those that have no cell and are blank or a total by their label."""
    label = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    return rows.where(~((F.size("cells") == 0) & label.isin("", "TOTAL", "TOTALS", "GRAND TOTAL")))


def zero_value_forms(cells: DataFrame) -> DataFrame:
    """Forms with cells that sum to 0, to be read again."""
    return cells.groupBy("form_id").agg(F.sum("qty").alias("_q"), F.count("*").alias("cells")).where("_q = 0").drop("_q")


def prune_empty_sizes(cells: DataFrame) -> DataFrame:
    """Cells of the sizes that have a quantity above 0 somewhere on their form."""
    return cells.join(cells.where("qty > 0").select("form_id", "size").distinct(), ["form_id", "size"], "left_semi")


def add_product_sizes(headers: DataFrame, products: DataFrame) -> DataFrame:
    """The size columns of a form (form_id, size) with those of the products on it (form_id, size)."""
    return headers.select("form_id", "size").unionByName(products.select("form_id", F.col("size").cast("string").alias("size"))).where("size <> ''").distinct()


def add_size(headers: DataFrame, sizes: DataFrame) -> DataFrame:
    """The size columns of a form (form_id, size) with new ones, trimmed, in capitals; blank ones go."""
    return add_product_sizes(headers, sizes.select("form_id", F.upper(F.trim("size")).alias("size")))


def pivot_grid(cells: DataFrame, sizes: list[str]) -> DataFrame:
    """Rows of a form with a column for each of the sizes, null where there is no quantity."""
    return cells.groupBy("form_id", "row_idx").pivot("size", sizes).agg(F.sum("qty"))


def correction_diff(shown: DataFrame, submitted: DataFrame) -> DataFrame:
    """Cells (form_id, row_idx, size, qty) that were added, removed or changed."""
    key = ["form_id", "row_idx", "size"]
    joined = shown.select(*key, F.col("qty").alias("before")).join(submitted.select(*key, F.col("qty").alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return joined.withColumn("change", change).where("change is not null")


def cluster_rows(marks: DataFrame, gap: float | Column) -> DataFrame:
    """marks (form_id, token_id, y) with cluster, from 0 down the page: a new one after each gap above `gap`, a number or a column of marks (see geometry.cluster_gap)."""
    order = Window.partitionBy("form_id").orderBy("y", "token_id")
    apart = marks.withColumn("_new", F.coalesce(F.col("y") - F.lag("y").over(order) > gap, F.lit(False)).cast("int"))
    return apart.withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def header_geometry(headers: DataFrame) -> DataFrame:
    """Per form with two headers (form_id, x) or more: their spacing, and the ends of the columns 0.6 of it beyond them."""
    ends = headers.groupBy("form_id").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).where("n > 1").withColumn("spacing", (F.col("b") - F.col("a")) / (F.col("n") - 1))
    return ends.select("form_id", "spacing", (F.col("a") - 0.6 * F.col("spacing")).alias("floor"), (F.col("b") + 0.6 * F.col("spacing")).alias("ceiling"))


def _edits(a: Sequence[str], b: Sequence[str]) -> int:
    """The least number of insertions, deletions and replacements that turn a into b. A column of the table of distances is two numbers of len(a) bits: where it goes up and where down."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    all_, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = all_, 0
    for y in b:
        same = places.get(y, 0)
        level = (((same & up) + up) ^ up) | same
        right_up, right_down = down | ~(level | up) & all_, up & level
        found += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = right_up << 1 & all_ | 1, right_down << 1 & all_
        up, down = right_down | ~(same | down | right_up) & all_, right_up & (same | down)
    return found


def _text_edits(truth: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    pairs = [(0, 0) if a == b else (_edits(a, b), _edits(a.split(), b.split())) for a, b in zip(truth, prediction)]
    return pd.DataFrame(pairs, columns=["c", "w"], dtype="int64")


def text_error_rates(pairs: DataFrame, *by: str) -> DataFrame:
    """Error rates in per cent of characters and of words over all pairs (truth, prediction), trimmed, null as empty, and how many are the same. Equal pairs are counted before they are compared."""
    t, p = (F.trim(F.coalesce(c, F.lit(""))) for c in ("truth", "prediction"))
    rows = pairs.select(*by, t.alias("t"), p.alias("p")).groupBy(*by, "t", "p").agg(F.count("*").alias("k")).withColumns({"e": pandas_udf(_text_edits, "c long, w long")("t", "p"), "n": F.length("t"), "m": F.size(F.filter(F.split("t", r"\s+"), lambda x: x != ""))})
    return rows.groupBy(*by).agg((F.sum(F.expr("e.c * k")) * 100.0 / F.sum(F.expr("n * k"))).alias("cer"), (F.sum(F.expr("e.w * k")) * 100.0 / F.sum(F.expr("m * k"))).alias("wer"), F.sum(F.when(F.col("t") == F.col("p"), F.col("k")).otherwise(0)).alias("perfect"))


def split_dataset(rows: DataFrame, *order: str) -> DataFrame:
    """rows with part: train for the first 85 % in an order, validation for the next 10 %, test for the rest."""
    place, total = fresh(rows, "place", "total")
    placed = numbered(rows, *order, n=place)
    counted = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias(total))))  # one row
    n, below = F.col(total), F.col(place) - 1
    part = F.when(below < F.floor(n * 85 / 100), "train").when(below < F.floor(n * 95 / 100), "validation").otherwise("test")
    return counted.withColumn("part", part).drop(place, total)
