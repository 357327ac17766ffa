"""Reviewed rows to SKU lines to orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scratch import fresh, written
from tallyloom.functions.text import sort_sizes

#: The most that a cell's quantity can be stored as.
MOST = 32767


def catalog_by_name(catalog: DataFrame) -> DataFrame:
    """The distinct styles and sizes of each name."""
    return catalog.groupBy("bname").agg(F.sort_array(F.collect_set(F.when(F.trim("bstyle") != "", F.col("bstyle")))).alias("styles"), F.sort_array(F.collect_set("bsize")).alias("sizes"))


def product_groups(catalog: DataFrame) -> DataFrame:
    """(bsid, size, detid): the SKU of each size of a product; the largest detid where one repeats, as rows of a table have no order. A blank bsid is bid and style put together. Blank names go."""
    keyed = catalog.where(F.trim("bname") != "").withColumn("bsid", F.coalesce(F.nullif("bsid", F.lit("")), F.concat(F.col("bid").cast("string"), F.coalesce("bstyle", F.lit("")))))
    return keyed.groupBy("bsid", F.col("bsize").cast("string").alias("size")).agg(F.max("detid").alias("detid"))


def resolve_lines(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """cells (session_id, rsno, bsid, size, qty) with detid and problem: null for a good line.

    Zero and blank cells are passed over. A product is one row with its sizes as a map, so cells meet it in one join; one that very many cells name is left to the skew join.
    """
    cells = cells.where(F.coalesce("qty", F.lit(0)) != 0)
    sized = F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "detid")))
    products = groups.groupBy("bsid").agg(F.map_from_entries(sized).alias("known"))
    joined = cells.join(products, "bsid", "left").withColumn("detid", F.try_element_at("known", "size"))
    problem = (
        F.when(F.col("bsid").isNull(), "unbound")
        .when(F.col("known").isNull(), "unknown_product")
        .when(F.col("qty") < 0, "negative_qty")
        .when(F.col("qty") > MOST, "qty_too_large")
        .when(F.col("detid").isNull(), "size_not_in_product")
    )
    return joined.select("session_id", "rsno", "bsid", "size", "qty", "detid", problem.alias("problem"))


def row_problems(lines: DataFrame) -> DataFrame:
    """(session_id, rsno, kind, sizes) of resolve_lines' problems: one for a row without a known product, one for each cell out of range, and one for all sizes of a row that its product lacks, in order."""
    by_cell = F.when(F.col("problem").isin("negative_qty", "qty_too_large"), F.col("size"))
    bound = ~F.col("problem").isin("unbound", "unknown_product")
    found = lines.where("problem is not null").groupBy("session_id", "rsno", F.col("problem").alias("kind"), by_cell.alias("cell")).agg(F.collect_set(F.when(bound, F.col("size"))).alias("sizes"))
    return found.select("session_id", "rsno", "kind", sort_sizes("sizes").alias("sizes"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """Good lines with each SKU of an order once: quantities summed into the first line, whose rsno and size stay; sno numbers them."""
    good = lines.where("problem is null")
    first = good.groupBy("session_id", "detid").agg(F.min(F.struct("rsno", "size")).alias("first"), F.sum("qty").alias("qty"), F.count("*").alias("merged"))
    order = Window.partitionBy("session_id").orderBy("first.rsno", "first.size", "detid")
    return first.select("session_id", "detid", F.col("first.rsno").alias("rsno"), F.col("first.size").alias("size"), "qty", "merged", F.row_number().over(order).alias("sno"))


def validate(lines: DataFrame) -> DataFrame:
    """Per submission: problems, lines, total, and ok: no problem and a line at least."""
    out = lines.groupBy("session_id").agg(F.count("problem").alias("problems"), F.sum(F.col("problem").isNull().cast("long")).alias("lines"), F.coalesce(F.sum(F.when(F.col("problem").isNull(), F.col("qty"))), F.lit(0)).alias("total"))
    return out.withColumn("ok", (F.col("problems") == 0) & (F.col("lines") > 0))


def skip_submitted(headers: DataFrame, submitted: DataFrame) -> DataFrame:
    return headers.join(submitted.select("session_id").distinct(), "session_id", "left_anti")


def numbered(rows: DataFrame, *order: str, n: str = "n") -> DataFrame:
    """rows with n, their place from 1 on in an order.

    Rows are ranged by that order and numbered within their range; the ranges' counts, a row each, give the offsets.
    The ranged rows are written first: ranges drawn anew for the counts could be others. n replaces a column of that name.
    """
    part, count, before, place = fresh(rows.withColumn(n, F.lit(0)), "part", "count", "before", "place")
    ranged = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    placed = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    counts = placed.groupBy(part).agg(F.count("*").alias(count))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(part, (F.sum(count).over(upto) - F.col(count)).alias(before))
    return placed.join(offsets, part).withColumn(n, F.col(before) + F.col(place)).drop(part, before, place)


def allocate_order_no(headers: DataFrame, last: int = 0) -> DataFrame:
    """order_no: consecutive from last + 1 on, by (submitted_at, session_id)."""
    return numbered(headers, "submitted_at", "session_id", n="order_no").withColumn("order_no", F.lit(last) + F.col("order_no"))


def build_submission(cells: DataFrame) -> DataFrame:
    """Cells above 0 (session_id, page, row_idx, size, qty) with pos, the place of their row in the order, by page and row; rows without any go."""
    order = Window.partitionBy("session_id").orderBy("page", "row_idx")
    return cells.where("qty > 0").withColumn("pos", F.dense_rank().over(order))


def header_problems(headers: DataFrame) -> DataFrame:
    """headers (session_id, head_id, user_id, pieces) with problems, an array of what is missing."""
    missing = F.array(F.when(F.col("head_id").isNull(), "buyer"), F.when(F.col("user_id").isNull(), "operator"), F.when(F.coalesce("pieces", F.lit(0)) <= 0, "quantities"))
    return headers.withColumn("problems", F.array_compact(missing))


def header_defaults(headers: DataFrame, today: F.Column) -> DataFrame:
    """Headers as they are stored: reference cut at 20 characters, dates, company, user and source with their defaults."""
    order_dt = F.coalesce("order_dt", today)
    return headers.withColumns({
        "ref_no": F.substring(F.trim(F.coalesce("ref_no", F.lit(""))), 1, 20), "ref_dt": F.coalesce(F.col("ref_dt"), order_dt), "order_dt": order_dt,
        "company_id": F.coalesce("company_id", F.lit(1)), "user_id": F.coalesce("user_id", F.lit(0)), "order_source": F.substring(F.coalesce(F.nullif(F.trim("order_source"), F.lit("")), F.lit("Local")), 1, 50),
    })


def order_summary(master: DataFrame, details: DataFrame, buyers: DataFrame) -> DataFrame:
    """Per order: buyer, date as DD/MM/YYYY, number of lines and sum; 0 without lines. Details are summed before the join."""
    sums = details.groupBy("session_id").agg(F.count("*").alias("lines"), F.sum("qty").alias("total"))
    joined = master.join(buyers, "head_id", "left").join(sums, "session_id", "left")
    return joined.select("session_id", "buyer", F.date_format("order_dt", "dd/MM/yyyy").alias("order_dt"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("total", F.lit(0)).alias("total"))


def orders_of(submissions: DataFrame, groups: DataFrame, done: DataFrame, last: int, today: F.Column) -> dict[str, DataFrame]:
    """What a batch of submissions comes to: master and details of those without a problem, numbered from last + 1 on, and rejected (session_id, submitted_at, problems).

    submissions: session_id, submitted_at, head_id, user_id, ref_no, order_dt, ref_dt, company_id, order_source and rows, an array of (bsid, item, quantities: a map of sizes). Of
    a session the first counts, by submitted_at, then reference and buyer; sessions in done (session_id) are passed over. groups: as product_groups gives them.
    """
    columns = ["session_id", "submitted_at", "head_id", "user_id", "ref_no", "order_dt", "ref_dt", "company_id", "order_source", "rows"]
    first = submissions.select(columns).where("session_id is not null").groupBy("session_id").agg(F.min_by(F.struct(*columns[1:]), F.struct("submitted_at", "ref_no", "head_id")).alias("s")).select("session_id", "s.*")
    new = written(first.join(done.select("session_id").distinct(), "session_id", "left_anti"), "submissions")
    placed = new.select("session_id", F.posexplode("rows").alias("rsno", "r")).select("session_id", (F.col("rsno") + 1).alias("rsno"), F.nullif(F.trim("r.bsid"), F.lit("")).alias("bsid"), F.explode("r.quantities").alias("size", "qty"))
    lines = written(resolve_lines(placed, groups), "lines")
    wrong = row_problems(lines).groupBy("session_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.concat(F.lit("row "), F.col("rsno").cast("string")), "kind", F.nullif(F.array_join("sizes", ","), F.lit(""))))).alias("wrong"))
    pieces = lines.where("qty > 0").groupBy("session_id").agg(F.sum("qty").alias("pieces"))
    told = header_problems(new.drop("rows").join(pieces, "session_id", "left")).join(wrong, "session_id", "left")
    told = written(told.withColumn("problems", F.concat("problems", F.coalesce("wrong", F.array().cast("array<string>")))).drop("wrong", "pieces"), "headers")
    good = told.where(F.size("problems") == 0).drop("problems")
    master = written(allocate_order_no(header_defaults(good, today), last), "master")
    details = merge_lines(lines.join(good.select("session_id"), "session_id", "left_semi")).join(master.select("session_id", "order_no"), "session_id")
    return {"master": master, "details": details.select("order_no", F.col("detid").alias("det_id"), "qty", "rsno", "sno"), "rejected": told.where(F.size("problems") > 0).select("session_id", "submitted_at", "problems")}
