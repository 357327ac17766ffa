"""Item names against the catalog, and shifts of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scratch import fresh
from tallyloom.functions.text import product_codes, sort_sizes

#: What a letter size is as a number, for adults and for children.
ADULT_SIZES = {"XS": 75, "S": 80, "M": 85, "L": 90, "XL": 95, "XXL": 100, "2XL": 100, "3XL": 105, "4XL": 110}
CHILD_SIZES = {"0": 25, "XS": 30, "S": 35, "M": 40, "L": 45, "XL": 50, "XXL": 55, "2XL": 55}

#: The least score to trust a match that a code narrows to one name, to at most NARROW names, and any other; the least to show one.
UNIQUE_CODE, NARROWED, UNNARROWED, NARROW, SHOWN = 35, 70, 95, 2, 70


def resolve_letter_size(letter: F.Column, sizes: F.Column) -> F.Column:
    """The number of a letter size that a product's sizes (array of int) have; null without one, or with one of each table."""
    def hit(table: dict[str, int]) -> F.Column:
        number = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.upper(F.trim(letter)))
        return F.when(F.array_contains(sizes, number), number)

    adult, child = hit(ADULT_SIZES), hit(CHILD_SIZES)
    return F.when(adult.isNull() | child.isNull() | (adult == child), F.coalesce(adult, child))


def binding_result(rows: DataFrame) -> DataFrame:
    """rows (sizes, product_sizes: arrays of string) with size_mismatch, the ordered sizes that the product lacks, and auto_bound, whether there is none."""
    return rows.withColumn("size_mismatch", sort_sizes(F.array_except("sizes", "product_sizes"))).withColumn("auto_bound", F.size("size_mismatch") == 0)


def fill_or_check_style(rows: DataFrame) -> DataFrame:
    """rows (kind, styles, trusted): on trusted rows a blank kind becomes the only style; style_mismatch has the styles, trusted or not, where the kind is none of them. styles is empty for a match that is not shown."""
    blank = F.trim(F.coalesce("kind", F.lit(""))) == ""
    only = F.col("trusted") & blank & (F.size("styles") == 1)
    other = ~blank & (F.size("styles") > 0) & ~F.array_contains("styles", F.col("kind"))
    return rows.withColumns({"style_mismatch": F.when(other, F.col("styles")), "kind": F.when(only, F.get("styles", 0)).otherwise(F.col("kind"))})


def vocabulary(catalog: DataFrame) -> DataFrame:
    """(kind, value): the distinct styles and sizes of a catalog that are not blank."""
    pairs = catalog.select(F.explode(F.array(F.struct(F.lit("style").alias("kind"), F.trim("bstyle").alias("value")), F.struct(F.lit("size").alias("kind"), F.col("bsize").cast("string").alias("value")))).alias("p"))
    return pairs.select("p.kind", "p.value").where("value <> ''").distinct()


def products_named(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each item with the products of that name, whatever its case."""
    a, b = items.alias("a"), catalog.alias("b")
    return a.join(b, F.lower(F.trim("a.item")) == F.lower(F.trim("b.bname")))


def sizes_outside_catalog(sizes: F.Column, catalog_sizes: F.Column) -> F.Column:
    """The numeric sizes that a product with sizes does not have."""
    return F.when(F.size(catalog_sizes) > 0, sort_sizes(F.array_except(F.filter(sizes, lambda s: s.rlike("^[0-9]+$")), catalog_sizes)))


def code_candidates(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(item, bname): catalog names that hold any code of an item as a part of one of their runs of digits.

    Each name is listed under every part of three digits or more of its runs, so containment is an equal join.
    """
    runs = catalog.select("bname").distinct().select("bname", F.explode(product_codes(F.col("bname"))).alias("run"))
    starts = runs.select("bname", "run", F.explode(F.sequence(F.lit(1), F.length("run") - 2)).alias("at"))
    parts = starts.select("bname", F.explode(F.transform(F.sequence(F.lit(3), F.length("run") - F.col("at") + 1), lambda n: F.substr(F.col("run"), F.col("at"), n))).alias("code")).distinct()
    codes = items.select("item").distinct().select("item", F.explode(F.array_distinct(product_codes(F.col("item")))).alias("code"))
    return codes.join(parts, "code").select("item", "bname").distinct()


def code_narrowing(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per item, whether a name has its code or not: item, codes, code_narrowed, pool and unmatched_code.

    The pool is what code_candidates finds, counted; without any it is all names of the catalog, and unmatched_code
    the first code, empty where the item has none. Items are not crossed with the catalog.
    """
    found = code_candidates(items, catalog).groupBy("item").agg(F.count("*").alias("found"))
    whole = catalog.agg(F.countDistinct("bname").alias("whole"))
    rows = items.select("item").distinct().join(found, "item", "left").crossJoin(F.broadcast(whole)).withColumn("codes", product_codes(F.col("item")))
    narrowed = F.col("found").isNotNull()
    missing = F.when(~narrowed & (F.size("codes") > 0), F.element_at("codes", 1)).otherwise("")
    return rows.select("item", "codes", narrowed.alias("code_narrowed"), F.coalesce("found", "whole").alias("pool"), missing.alias("unmatched_code"))


def match_trust(matches: DataFrame) -> DataFrame:
    """matches (score, code_narrowed, pool) with trusted, by how far the code narrows the pool, and shown."""
    only = F.col("code_narrowed") & (F.col("pool") == 1)
    floor = F.when(only, UNIQUE_CODE).when(F.col("code_narrowed") & (F.col("pool") <= NARROW), NARROWED).otherwise(UNNARROWED)
    return matches.withColumn("trusted", F.col("score") >= floor).withColumn("shown", (F.col("score") >= SHOWN) | only)


def _fits(offset: F.Column) -> F.Column:
    """Whether every size is a header that the offset moves to one the catalog has."""
    places = F.transform("sizes", lambda s: F.array_position("headers", s).cast("int"))
    there = lambda p: F.try_element_at(F.col("headers"), F.when(p + offset > 0, p + offset).otherwise(F.size("headers") + 1))
    return F.coalesce(F.forall(places, lambda p: (p > 0) & F.coalesce(F.array_contains("catalog_sizes", there(p)), F.lit(False))), F.lit(False))


def detect_column_shift(rows: DataFrame) -> DataFrame:
    """rows as in shift_offsets with offset: the first of 1, -1, 2, -2 that moves every size to a header the catalog has; null where the sizes are the catalog's already."""
    valid = F.size(F.array_except("sizes", "catalog_sizes")) == 0
    found = F.coalesce(*(F.when(_fits(F.lit(o)), o) for o in (1, -1, 2, -2)))
    return rows.withColumn("offset", F.when((F.size("sizes") > 0) & ~valid, found))


def shift_offsets(rows: DataFrame, offsets: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> DataFrame:
    """rows (form_id, row_idx, sizes, headers, catalog_sizes: arrays of int) with offset: the only one that moves every size to a header the catalog has; else null."""
    good = F.filter(F.array(*map(F.lit, offsets)), _fits)
    only = fresh(rows, "good")[0]
    return rows.withColumn(only, F.when(F.size("sizes") > 0, good)).withColumn("offset", F.when(F.size(only) == 1, F.col(only)[0])).drop(only)


def apply_offset(cells: DataFrame, headers: DataFrame, numbers: bool = False) -> DataFrame:
    """cells (form_id, row_idx, size, qty, offset) with sizes moved by the header positions (form_id, pos, size); off the edge they go, sizes that are no header stay. numbers: only headers that are numbers count, in their order."""
    if numbers:
        order = Window.partitionBy("form_id").orderBy("pos")
        headers = headers.where(F.col("size").rlike("^[0-9]+$")).withColumn("pos", F.row_number().over(order))
    here = headers.select("form_id", F.col("pos").alias("_from"), "size")
    there = headers.select("form_id", F.col("pos").alias("_to"), F.col("size").alias("_moved"))
    placed = cells.join(here, ["form_id", "size"], "left").withColumn("_to", F.col("_from") + F.col("offset"))
    moved = placed.join(there, ["form_id", "_to"], "left").where("_from is null or _moved is not null")
    return moved.select("form_id", "row_idx", F.when(F.col("_from").isNull(), F.col("size")).otherwise(F.col("_moved")).alias("size"), "qty")
