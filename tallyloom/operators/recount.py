"""A second, independent reading of whole rows merged with the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import likeness_form, plain_total, sort_sizes
from tallyloom.operators.fuzzy import weighted_ratio
from tallyloom.operators.matching import shift_offsets

#: Names of two readings of one row are at least this much alike; the beginning of notes, which flag_message shows as they are.
ALIGNED, NOTE = 55, "Row-crop recount"


def _offset(rows: DataFrame, cells: str, name: str) -> DataFrame:
    """rows with name: the only offset that moves the numeric sizes of cells onto the catalog's; null for rows without a trusted match, too."""
    sizes = F.transform(cells, lambda c: c["size"].try_cast("int"))
    placed = shift_offsets(rows.withColumns({"sizes": F.when(F.forall(sizes, lambda s: s.isNotNull()), sizes), "headers": F.transform("size_headers", lambda h: h.try_cast("int"))}))
    return placed.withColumn(name, F.when(F.col("catalog_sizes").isNotNull(), F.col("offset"))).drop("sizes", "headers", "offset")


def _moved(cells: Column, offset: Column) -> Column:
    """cells at the headers that are `offset` further on; those off the edge go, sizes that are no header stay."""
    at = lambda c: F.array_position("size_headers", c["size"]).cast("int")
    there = lambda c: F.when(at(c) + offset > 0, F.try_element_at(F.col("size_headers"), F.greatest(at(c) + offset, F.lit(1))))
    placed = F.transform(cells, lambda c: F.struct(F.when(at(c) == 0, c["size"]).otherwise(there(c)).alias("size"), c["qty"].alias("qty")))
    return F.filter(placed, lambda c: c["size"].isNotNull())


def merge_recount(rows: DataFrame) -> DataFrame:
    """One row for each of rows: form_id, row_idx, status, cells (size, qty), chosen, sizes (those that the flag is on), offset and note, what a reviewer is told.

    rows: form_id, row_idx, item, main (array of (size, qty)), row_total, size_headers, catalog_sizes (array of int; null without a trusted match),
    and of the second reading item_seen, recount and total_dozen; recount null: there is none. In this order:
    names that are not alike, nothing in the second reading but in the first, or digits among its sizes that are no header: unverified, first.
    Equal: moved by the catalog's only offset, if that is not 0, auto_corrected; else unverified if the printed total is another, else ok.
    Not equal: the only side that the printed total fits, or else the only side that fits the catalog as it is, resolved; else first, unresolved.
    The printed total is the second reading's, where null or 0 the first's.
    """
    name, seen = likeness_form(F.col("item")), likeness_form(F.col("item_seen"))
    aligned = (name == "") | (seen == "") | (weighted_ratio(name, seen) >= ALIGNED)
    told = rows.withColumn("_aligned", aligned)
    told = _offset(_offset(told, "main", "_a"), "recount", "_b")
    total = lambda c: F.nullif(plain_total(F.col(c)), F.lit(0))
    sums = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["qty"])
    told = told.withColumns({"_total": F.coalesce(total("total_dozen"), plain_total(F.col("row_total"))), "_sum_a": sums("main"), "_sum_b": sums("recount")})
    foreign = (F.size("size_headers") > 0) & F.exists("recount", lambda c: c["size"].rlike("^[0-9]+$") & ~F.array_contains("size_headers", c["size"]))
    unusable = ~F.col("_aligned") | ((F.size("recount") == 0) & (F.size("main") > 0)) | foreign
    equal = F.array_sort("main") == F.array_sort("recount")
    shifted = equal & F.coalesce(F.col("_a") != 0, F.lit(False))
    total_differs = F.coalesce(F.col("_total") != F.col("_sum_a"), F.lit(False))
    fits = lambda c: F.coalesce(F.col("_total") == F.col(c), F.lit(False))
    by_total = F.when(fits("_sum_b") & ~fits("_sum_a"), "recount").when(fits("_sum_a") & ~fits("_sum_b"), "main")
    zero = lambda c: F.coalesce(F.col(c) == 0, F.lit(False))
    by_catalog = F.when(F.col("catalog_sizes").isNotNull(), F.when(zero("_a") & ~zero("_b"), "main").when(zero("_b") & ~zero("_a"), "recount"))
    decided = F.coalesce(by_total, by_catalog)
    status = (
        F.when(F.col("recount").isNull(), "no_recount").when(unusable, "unverified").when(shifted, "auto_corrected")
        .when(equal, F.when(total_differs, "unverified").otherwise("ok")).when(decided.isNotNull(), "resolved").otherwise("unresolved")
    )
    chosen = F.when(F.col("recount").isNull() | unusable, "main").when(shifted, "shifted").when(equal, "main").otherwise(F.coalesce(decided, F.lit("main")))
    told = told.withColumns({"status": status, "chosen": chosen})
    cells = F.when(F.col("chosen") == "recount", F.col("recount")).when(F.col("chosen") == "shifted", _moved(F.col("main"), F.col("_a"))).otherwise(F.col("main"))
    names = lambda c: F.transform(c, lambda x: x["size"])
    differ = F.array_distinct(names(F.concat(F.array_except("main", "recount"), F.array_except("recount", "main"))))
    told = told.withColumn("cells", cells)
    sizes = F.when(F.col("status").isin("ok", "no_recount"), F.array().cast("array<string>")).when(F.col("status").isin("resolved", "unresolved"), differ).when(F.col("status") == "auto_corrected", names("cells")).otherwise(names("main"))
    say = lambda *parts: F.concat(F.lit(NOTE), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    others = F.filter(names("recount"), lambda s: s.rlike("^[0-9]+$") & ~F.array_contains("size_headers", s))
    note = (
        F.when(F.col("recount").isNull(), "").when(~F.col("_aligned"), say(" read another item here: ", F.col("item_seen"), ".")).when((F.size("recount") == 0) & (F.size("main") > 0), say(" found no quantities."))
        .when(foreign, say(" found sizes that are no header: ", F.array_join(sort_sizes(others), ", "), ".")).when(shifted, say(" agrees, moved by ", F.col("_a"), " to the sizes of the catalog."))
        .when(equal & total_differs, say(" agrees, but the printed total is ", F.col("_total"), ", the sum ", F.col("_sum_a"), ".")).when(equal, "")
        .when(by_total.isNotNull(), say(" differs, the ", by_total, " fits the printed total.")).when(by_catalog.isNotNull(), say(" differs, the ", by_catalog, " fits the sizes of the catalog."))
        .otherwise(say(" differs, and nothing says which is right."))
    )
    return told.select("form_id", "row_idx", "status", "chosen", "cells", sort_sizes(sizes).alias("sizes"), F.col("_a").alias("offset"), note.alias("note"))
