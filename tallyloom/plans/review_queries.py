"""Queries of review, matching by names, evidence and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import matching, orders, reconcile, review, templates
from tallyloom.plans.registry import query
from tallyloom.plans.views import SECOND, second_reading, view, with_views


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cells").select("form_id", "row_idx", "size", "qty")


def _k() -> Column:
    return F.col("p_partkey")


def _joined(cells: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(cells), lambda c: F.concat(c["size"], F.lit(":"), c["qty"].cast("string"))), ",")


# texts

@query("SELECT p_partkey, p_name AS item_seen, CAST(p_size AS VARCHAR) AS first_size, CAST(p_size + 5 AS VARCHAR) AS last_size, p_size || ':' || p_size % 7 || ',' || (p_size + 5) || ':20' AS quantities, CAST(p_size + 3 AS VARCHAR) AS total FROM part")
def parse_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda n: (F.col("p_size") + n).cast("string")
    line = F.concat(F.lit("Item seen: "), "p_name", F.lit("\nquantities: "), size(0), F.lit(":"), (F.col("p_size") % 7).cast("string"), F.lit(", "), size(5), F.lit(" : 20\nTOTAL: "), size(3))
    r = F.col("r")
    joined = F.array_join(F.transform(r["quantities"], lambda c: F.concat(c["size"], F.lit(":"), c["qty"].cast("string"))), ",")
    return _part(spark, sf_dir).select(_k(), text.parse_row_text(line).alias("r")).select(_k(), r["item_seen"].alias("item_seen"), r["first_size"].alias("first_size"), r["last_size"].alias("last_size"), joined.alias("quantities"), r["total"].alias("total"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '45:' || p_size WHEN 1 THEN '45:3,55:' || p_size ELSE '' END AS cells FROM part")
def parse_pairs_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    line = F.when(_k() % 3 == 0, F.concat(F.lit("45: 10, 50:x, 55:0, 45 :"), size)).when(_k() % 3 == 1, F.concat(F.lit("3,,"), size)).otherwise("3 4")
    return _part(spark, sf_dir).select(_k(), _joined(text.parse_pairs_line(line, F.array(*map(F.lit, ("45", "50", "55"))))).alias("cells"))


@query("SELECT page_id, CASE WHEN regexp_matches(t, '^\\[.*\\]$') THEN '' ELSE t END AS text FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br[ \\t\\r\\n]*/?>', ' ', 'gi'), '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '45:' || p_size WHEN 1 THEN '110:' || p_size END AS cell FROM part")
def parse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    cell = text.parse_cell(F.lit("45"), F.when(_k() % 3 == 0, F.concat(F.lit(" "), size)).when(_k() % 3 == 1, F.concat(F.lit("110 "), size)).otherwise("x"))
    return _part(spark, sf_dir).select(_k(), F.concat(cell["size"], F.lit(":"), cell["qty"].cast("string")).alias("cell"))


@query(with_views("form_rows", "cells", more="u AS (SELECT DISTINCT form_id, CASE WHEN row_idx % 3 = 0 THEN 'XL' ELSE size END AS size, CASE WHEN form_id % 2 = 0 THEN ['50', '45', 'XL'] ELSE ['100', '5'] END AS p FROM cells)") + "SELECT form_id, array_to_string(list_concat(p, coalesce(list(size ORDER BY try_cast(size AS INT) NULLS LAST, size) FILTER (WHERE NOT list_contains(p, size)), [])), ',') AS headers FROM u GROUP BY form_id, p")
def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _cells(spark, sf_dir).groupBy("form_id").agg(F.collect_set(F.when(F.col("row_idx") % 3 == 0, "XL").otherwise(F.col("size"))).alias("used"))
    printed = F.when(F.col("form_id") % 2 == 0, F.array(*map(F.lit, ("50", "45", "XL")))).otherwise(F.array(F.lit("100"), F.lit("5")))
    return used.select("form_id", F.array_join(text.page_headers(printed, F.col("used")), ",").alias("headers"))


# review

@query(with_views("form_rows", "cells", "forms") + "SELECT f.form_id, o_orderpriority || '; ' || o_orderstatus AS notes, p_name AS item, p_type AS kind, CASE WHEN qty % 4 <> 0 THEN size END AS size, CASE WHEN qty % 4 <> 0 THEN qty END AS qty FROM forms f LEFT JOIN cells c ON f.form_id = c.form_id")
def flatten_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells")
    quantities = F.filter(F.array(F.struct("size", "qty")), lambda c: c["qty"] % 4 != 0)
    items = cells.groupBy("form_id").agg(F.collect_list(F.struct(F.col("p_name").alias("item"), F.col("p_type").alias("kind"), quantities.alias("quantities"))).alias("items"))
    forms = view(spark, sf_dir, "forms").select("form_id", F.array("o_orderpriority", "o_orderstatus").alias("notes"))
    return review.flatten_review(forms.join(items, "form_id", "left"))


_PAGES = "g AS (SELECT session_id, form_id AS page, CASE WHEN form_id % 3 = 0 THEN '' ELSE CAST(form_id AS VARCHAR) END AS order_no, CASE WHEN form_id % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS order_date, CASE WHEN form_id % 2 = 0 THEN party_name ELSE upper(party_name) || CASE WHEN form_id % 5 = 0 THEN ' B' ELSE ' .' END END AS party_name FROM forms)"


@query(with_views("forms", more=_PAGES) + "SELECT session_id, arg_min(order_no, page) FILTER (WHERE order_no <> '') AS order_no, arg_min(order_date, page) FILTER (WHERE order_date <> '') AS order_date, arg_min(party_name, page) AS party_name, count(DISTINCT trim(regexp_replace(lower(party_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))) > 1 AS several FROM g GROUP BY session_id")
def order_header_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("form_id"), F.col("party_name")
    pages = view(spark, sf_dir, "forms").select("session_id", k.alias("page"), F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("order_no"), F.when(k % 4 == 0, "").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("order_date"), F.when(k % 2 == 0, name).otherwise(F.concat(F.upper(name), F.when(k % 5 == 0, " B").otherwise(" ."))).alias("party_name"))
    return review.order_header_from_pages(pages)


@query("SELECT o_custkey AS session_id, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0) > 0 THEN 'processing' WHEN count(*) = count(*) FILTER (WHERE o_orderstatus = 'O' AND NOT (o_orderstatus = 'P' AND o_orderkey % 5 = 0)) THEN 'error' ELSE 'ready' END AS status FROM orders GROUP BY 1")
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0), "running").when(F.col("o_orderstatus") == "O", "error").otherwise("done")
    return review.session_status(_orders(spark, sf_dir).select(F.col("o_custkey").alias("session_id"), status.alias("status")))


@query(with_views("form_rows", "cells") + "SELECT form_id, count(*) AS cells FROM cells GROUP BY form_id HAVING max(qty) <= 10")
def zero_value_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.zero_value_forms(_cells(spark, sf_dir).withColumn("qty", F.greatest(F.col("qty") - 10, F.lit(0))))


@query(with_views("form_rows", "cells", more="z AS (SELECT form_id, row_idx, size, CASE WHEN qty % 3 = 0 THEN 0 ELSE qty END AS qty FROM cells)") + "SELECT * FROM z a WHERE EXISTS (SELECT 1 FROM z b WHERE a.form_id = b.form_id AND a.size = b.size AND b.qty > 0)")
def prune_empty_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.prune_empty_sizes(_cells(spark, sf_dir).withColumn("qty", F.when(F.col("qty") % 3 == 0, 0).otherwise(F.col("qty")))).select("form_id", "row_idx", "size", "qty")


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx % 3 AS row_idx, CAST(sum(qty) FILTER (WHERE size = '50') AS BIGINT) AS \"50\", CAST(sum(qty) FILTER (WHERE size = '100') AS BIGINT) AS \"100\" FROM cells GROUP BY 1, 2")
def pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pivot_grid(_cells(spark, sf_dir).withColumn("row_idx", F.col("row_idx") % 3), ["50", "100"])


@query(with_views("form_rows", "cells", more=f"b AS ({SECOND})") + "SELECT * FROM (SELECT form_id, row_idx, size, a.qty AS before, b.qty AS after, CASE WHEN a.qty IS NULL THEN 'added' WHEN b.qty IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT form_id, row_idx, size, qty FROM cells) a FULL JOIN b USING (form_id, row_idx, size)) WHERE before IS DISTINCT FROM after")
def correction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return review.correction_diff(cells, second_reading(cells))


@query(with_views("form_rows", more="m AS (SELECT form_id, row_idx AS token_id, price % 1000 AS y FROM form_rows), d AS (SELECT *, y - lag(y) OVER (PARTITION BY form_id ORDER BY y, token_id) AS step FROM m)") + "SELECT form_id, token_id, y, CAST(count(*) FILTER (WHERE step > 120) OVER (PARTITION BY form_id ORDER BY y, token_id) AS BIGINT) AS cluster FROM d")
def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cluster_rows(view(spark, sf_dir, "form_rows").select("form_id", F.col("row_idx").alias("token_id"), (F.col("price") % 1000).alias("y")), 120)


@query(with_views("form_rows", "cells", more="h AS (SELECT DISTINCT form_id, CAST(size AS INT) * 3 AS x FROM cells), g AS (SELECT form_id, min(x) AS a, max(x) AS b, (max(x) - min(x)) / (count(*) - 1) AS s FROM h GROUP BY form_id HAVING count(*) > 1)") + "SELECT form_id, round(s, 4) AS spacing, round(a - 0.6 * s, 4) AS floor, round(b + 0.6 * s, 4) AS ceiling FROM g")
def header_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.header_geometry(_cells(spark, sf_dir).select("form_id", (F.col("size").cast("int") * 3).alias("x")).distinct())
    return out.select("form_id", *(F.round(c, 4).alias(c) for c in ("spacing", "floor", "ceiling")))


_PAIRS = "e AS (SELECT c_mktsegment AS g, c_name || ' of ' || c_mktsegment AS t, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' or ' ELSE ' of ' END || c_mktsegment AS p FROM customer)"


@query("WITH " + _PAIRS + " SELECT g AS segment, round(sum(levenshtein(t, p)) * 100.0 / sum(length(t)), 6) AS cer, round(count(*) FILTER (WHERE t <> p) * 100.0 / sum(len(string_split(t, ' '))), 6) AS wer, count(*) FILTER (WHERE t = p) AS perfect FROM e GROUP BY g")
def text_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pairs = c.select(F.col("c_mktsegment").alias("segment"), F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("truth"), F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " or ").otherwise(" of "), "c_mktsegment").alias("prediction"))
    return review.text_error_rates(pairs, "segment").withColumns({"cer": F.round("cer", 6), "wer": F.round("wer", 6)})


@query("SELECT o_orderkey, CASE WHEN n <= a * 85 // 100 THEN 'train' WHEN n <= a * 95 // 100 THEN 'validation' ELSE 'test' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER () AS a FROM orders)")
def split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.split_dataset(_orders(spark, sf_dir).select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "part")


# orders

@query(with_views("form_rows", "cells", "forms", more="p AS (SELECT session_id, page, form_id * 100 + row_idx AS row_idx, size, qty - 10 AS qty FROM cells JOIN forms USING (form_id))") + "SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY page, row_idx) AS pos FROM p WHERE qty > 0")
def build_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").join(view(spark, sf_dir, "forms").select("form_id", "session_id", "page"), "form_id")
    return orders.build_submission(cells.select("session_id", "page", (F.col("form_id") * 100 + F.col("row_idx")).alias("row_idx"), "size", (F.col("qty") - 10).alias("qty")))


@query("SELECT o_orderkey, array_to_string([p FOR p IN [CASE WHEN o_custkey % 4 = 0 THEN 'buyer' END, CASE WHEN o_custkey % 3 = 0 THEN 'operator' END, CASE WHEN o_orderkey % 5 = 0 THEN 'quantities' END] IF p IS NOT NULL], ',') AS problems FROM orders")
def header_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    headers = _orders(spark, sf_dir).select("o_orderkey", F.when(c % 4 != 0, c).alias("head_id"), F.when(c % 3 != 0, c).alias("user_id"), (F.col("o_orderkey") % 5).alias("pieces"))
    return orders.header_problems(headers).select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query("SELECT o_orderkey, 'reference no 1234567' AS ref_no, CASE WHEN o_custkey % 2 = 0 THEN 5 ELSE 1 END AS company_id, CASE WHEN o_custkey % 3 = 0 THEN 9 ELSE 0 END AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Local' ELSE o_orderpriority END AS order_source, CAST(CASE WHEN o_orderkey % 3 = 0 THEN DATE '2026-01-01' ELSE o_orderdate END AS DATE) AS order_dt, CAST(CASE WHEN o_orderkey % 3 = 0 THEN DATE '2026-01-01' ELSE o_orderdate END AS DATE) AS ref_dt FROM orders")
def header_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    headers = _orders(spark, sf_dir).select(k, F.lit(" reference no 123456789").alias("ref_no"), F.when(c % 2 == 0, 5).alias("company_id"), F.when(c % 3 == 0, 9).alias("user_id"), F.when(k % 2 == 0, " ").otherwise(F.col("o_orderpriority")).alias("order_source"), F.when(k % 3 != 0, F.to_date("o_orderdate")).alias("order_dt"), F.lit(None).cast("date").alias("ref_dt"))
    return orders.header_defaults(headers, F.lit("2026-01-01").cast("date"))


# matching

_LETTERS = "l AS (SELECT p_partkey, p_size * 5 AS s, ['XS', 'm', ' L', 'XXL', 'Q'][p_partkey % 5 + 1] AS letter FROM part), v AS (SELECT unnest(['XS', 'XS', 'M', 'M', 'L', 'L', 'XXL', 'XXL']) AS letter, unnest([75, 30, 85, 40, 90, 45, 100, 55]) AS n)"


@query("WITH " + _LETTERS + " SELECT p_partkey, n AS size FROM l LEFT JOIN v ON upper(trim(l.letter)) = v.letter AND n = s")
def resolve_letter_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.get(F.array(*map(F.lit, ("XS", "m", " L", "XXL", "Q"))), (_k() % 5).cast("int"))
    return _part(spark, sf_dir).select(_k(), matching.resolve_letter_size(letter, F.array((F.col("p_size") * 5).cast("int"))).alias("size"))


_NAMES = "n AS (SELECT bname, list(DISTINCT bsize) AS sizes, list(DISTINCT bstyle) AS styles FROM catalog GROUP BY bname)"


def _with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = view(spark, sf_dir, "catalog")
    return catalog.select("detid", "bname", "bsize", "bstyle").join(orders.catalog_by_name(catalog), "bname")


@query(with_views("catalog", more=_NAMES + ", o AS (SELECT detid, bname, unnest([bsize, bsize + 5]) AS s FROM catalog), x AS (SELECT detid, s FROM o JOIN n USING (bname) WHERE NOT list_contains(sizes, s))") + "SELECT c.detid, coalesce(array_to_string(list(s ORDER BY s) FILTER (WHERE s IS NOT NULL), ','), '') AS size_mismatch, count(s) = 0 AS auto_bound FROM catalog c LEFT JOIN x USING (detid) GROUP BY c.detid")
def binding_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_names(spark, sf_dir).select("detid", F.array("bsize", F.col("bsize") + 5).cast("array<string>").alias("sizes"), F.col("sizes").cast("array<string>").alias("product_sizes"))
    return matching.binding_result(rows).select("detid", F.array_join("size_mismatch", ",").alias("size_mismatch"), "auto_bound")


@query(with_views("catalog", more=_NAMES) + "SELECT detid, CASE WHEN detid % 3 = 0 THEN CASE WHEN detid % 5 <> 0 AND len(styles) = 1 THEN styles[1] ELSE '' END WHEN detid % 3 = 1 THEN bstyle ELSE 'none' END AS kind, CASE WHEN detid % 3 = 2 THEN array_to_string(list_sort(styles), ',') END AS style_mismatch FROM catalog JOIN n USING (bname)")
def fill_or_check_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("detid")
    rows = _with_names(spark, sf_dir).select(k, F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("bstyle")).otherwise("none").alias("kind"), "styles", (k % 5 != 0).alias("trusted"))
    return matching.fill_or_check_style(rows).select("detid", "kind", F.array_join("style_mismatch", ",").alias("style_mismatch"))


@query("WITH x AS (SELECT p_partkey, p_partkey % 12 + 1 AS a, p_partkey % 3 AS n, p_partkey % 7 + 3 AS lo, p_partkey % 7 + 3 + p_partkey % 5 AS hi FROM part) SELECT p_partkey, CASE WHEN a >= lo AND a + n <= hi THEN NULL WHEN a + 1 >= lo AND a + 1 + n <= least(15, hi) THEN 1 WHEN a - 1 >= greatest(1, lo) AND a - 1 + n <= hi THEN -1 WHEN a + 2 >= lo AND a + 2 + n <= least(15, hi) THEN 2 WHEN a - 2 >= greatest(1, lo) AND a - 2 + n <= hi THEN -2 END AS \"offset\" FROM x")
def detect_column_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k().cast("int")
    span = lambda a, b: F.transform(F.sequence(a, b), lambda i: i * 5 + 35)
    rows = _part(spark, sf_dir).select(_k(), span(k % 12 + 1, k % 12 + 1 + k % 3).alias("sizes"), span(F.lit(1), F.lit(15)).alias("headers"), span(k % 7 + 3, k % 7 + 3 + k % 5).alias("catalog_sizes"))
    return matching.detect_column_shift(rows).select(_k(), "offset")


# flags

_TWO = "h AS (SELECT form_id, row_idx, CASE qty % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'unverified' ELSE 'resolved' END AS a FROM form_rows WHERE qty % 5 > 0), r AS (SELECT form_id, row_idx, CASE price % 3 WHEN 0 THEN 'no_recount' WHEN 1 THEN 'ok' ELSE 'unresolved' END AS b FROM form_rows WHERE price % 7 > 0)"


@query(with_views("form_rows", more=_TWO) + "SELECT * FROM (SELECT form_id, row_idx, CASE WHEN b = 'unresolved' THEN b ELSE coalesce(a, b) END AS status FROM h FULL JOIN r USING (form_id, row_idx)) WHERE status NOT IN ('ok', 'no_recount')")
def override_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("qty"), F.col("price")
    rows = view(spark, sf_dir, "form_rows")
    hybrid = rows.where(q % 5 > 0).withColumn("status", F.when(q % 4 == 0, "ok").when(q % 4 == 1, "unverified").otherwise("resolved"))
    recount = rows.where(p % 7 > 0).withColumn("status", F.when(p % 3 == 0, "no_recount").when(p % 3 == 1, "ok").otherwise("unresolved"))
    return reconcile.display_flags(reconcile.override_flags(hybrid, recount))


@query(with_views("form_rows", "cells", more="a AS (SELECT form_id, row_idx AS y, qty % 3 - 1 AS o FROM cells WHERE qty % 2 = 0)") + "SELECT form_id, count(*) AS anchors, CASE WHEN count(*) >= 3 THEN round(regr_slope(o, y), 6) + 0.0 END AS slope, CASE WHEN count(*) >= 3 THEN round(regr_intercept(o, y), 6) + 0.0 END AS intercept FROM a GROUP BY form_id")
def drift_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconcile.drift_trend(_cells(spark, sf_dir).where("qty % 2 = 0").select("form_id", F.col("row_idx").cast("double").alias("y"), (F.col("qty") % 3 - 1).alias("offset")))
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("slope", "intercept")})


@query(with_views("form_rows", more="b AS (SELECT form_id, row_idx, row_idx / 8.0::DOUBLE AS t, (row_idx + qty % 32 / 30.0::DOUBLE) / 8.0::DOUBLE AS e FROM form_rows), c AS (SELECT *, lag(e) OVER w AS above, lead(e) OVER w IS NULL AS final FROM b WINDOW w AS (PARTITION BY form_id ORDER BY row_idx))") + "SELECT form_id, bool_and(t < e AND e <= 1 AND e - t >= 0.008 AND (above IS NULL OR t >= above - 0.01) AND (NOT final OR e <= 0.92)) AS valid FROM c GROUP BY form_id")
def row_fracs_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("row_idx")
    rows = view(spark, sf_dir, "form_rows").select("form_id", at, (at / F.lit(8.0)).alias("top"), ((at + F.col("qty") % 32 / F.lit(30.0)) / F.lit(8.0)).alias("bottom"), F.lit(0.9).alias("table_bottom"))
    return reconcile.row_fracs_valid(rows)


# templates

@query("SELECT p_partkey, CASE WHEN abs(p_partkey % 9 - 4) BETWEEN 1 AND 3 THEN CAST(p_partkey % 9 - 4 AS INT) END AS \"offset\" FROM part")
def detect_shift_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = (6 + _k() % 5).cast("int"), (_k() % 9 - 4).cast("int")
    cells = lambda at: F.array(*(F.struct((at + i).cast("string").alias("size"), (F.col("p_size") + i).cast("int").alias("qty")) for i in (0, 1)))
    rows = _part(spark, sf_dir).select(_k(), cells(a).alias("raw"), cells(a + d).alias("submitted"), F.sequence(F.lit(1), F.lit(20)).cast("array<string>").alias("headers"))
    return templates.detect_shift_offset(rows).select(_k(), "offset")


@query("SELECT o_custkey AS signature, o_orderstatus AS backend, count(*) AS uses, round(avg((o_orderkey % 3) / 4.0::DOUBLE), 6) AS rate FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY ALL")
def correction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = _orders(spark, sf_dir).select(F.col("o_custkey").alias("signature"), F.col("o_orderstatus").alias("backend"), (k % 3).alias("corrected"), F.when(k % 6 == 0, 0).otherwise(4).alias("rows"))
    return templates.correction_rate(pages).withColumn("rate", F.round("rate", 6))


@query(with_views("form_rows", "cells") + "SELECT form_id % 50 AS signature, 'name' AS kind, p_name AS trigger, count(DISTINCT form_id) AS times_applied FROM cells GROUP BY ALL")
def count_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.count_applied(view(spark, sf_dir, "cells").select((F.col("form_id") % 50).alias("signature"), F.lit("name").alias("kind"), F.col("p_name").alias("trigger"), "form_id"))


@query(with_views("form_rows", "cells", more="r AS (SELECT DISTINCT p_partkey % 50 AS signature, p_name AS t FROM part WHERE p_partkey % 3 = 0)") + """
SELECT c.form_id, c.row_idx, c.form_id % 50 AS signature, CASE WHEN o.t IS NOT NULL THEN upper(o.t) WHEN c.row_idx % 2 = 0 OR r.t IS NOT NULL THEN upper(p_name) ELSE p_name || 's' END AS item,
       CASE WHEN c.row_idx % 2 = 1 THEN upper(r.t) ELSE upper(o.t) END AS fired,
       CASE WHEN c.row_idx % 2 = 1 AND r.t IS NOT NULL THEN 'Template memory: read as ' || p_name || 's, confirmed before as ' || upper(r.t)
            WHEN o.t IS NOT NULL THEN 'Template memory: read as ' || upper(p_name) || ', confirmed before as ' || upper(o.t) END AS note
FROM cells c LEFT JOIN r ON r.signature = c.form_id % 50 AND r.t = c.p_name
     -- old and cold are as near as a rule takes
     LEFT JOIN r o ON c.row_idx % 2 = 0 AND r.t IS NULL AND o.signature = c.form_id % 50 AND (o.t = 'c' || c.p_name AND c.p_name LIKE 'old %' OR 'c' || o.t = c.p_name AND o.t LIKE 'old %')
""")
def apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every second row with one letter misread, of the others as a rule has them already, against rules of their template for a third of the names, whose triggers are written otherwise."""
    item = F.when(F.col("row_idx") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("s")))
    cells = view(spark, sf_dir, "cells").select("form_id", "row_idx", (F.col("form_id") % 50).alias("signature"), item.alias("item"))
    rules = _part(spark, sf_dir).where("p_partkey % 3 = 0").select((_k() % 50).alias("signature"), F.upper("p_name").alias("trigger"), F.upper("p_name").alias("corrected")).distinct()
    return templates.apply_rules(cells, rules)


# further checks

@query(with_views("catalog", "buyers") + "SELECT 'products' AS name, count(*) AS n FROM (SELECT DISTINCT bsid, bsize FROM catalog) UNION ALL SELECT 'buyers', count(*) FROM buyers WHERE is_active = 0")
def lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.lookup_counts(products=orders.product_groups(view(spark, sf_dir, "catalog")), buyers=view(spark, sf_dir, "buyers").where("is_active = 0"))


@query(with_views("form_rows", "cells", more="n AS (SELECT DISTINCT form_id, 'note ' || qty % 10 AS note FROM cells), f AS (SELECT form_id, 'note ' || qty % 10 AS note FROM cells WHERE row_idx % 2 = 0)") + "SELECT form_id, note FROM n WHERE (form_id, note) NOT IN (SELECT (form_id, note) FROM f)")
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _cells(spark, sf_dir).select("form_id", "row_idx", F.concat(F.lit("note "), (F.col("qty") % 10).cast("string")).alias("note"))
    return review.page_notes(notes.select("form_id", "note").distinct(), notes.where("row_idx % 2 = 0"))


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CAST(qty AS BIGINT) AS sum, CASE WHEN row_idx % 4 > 0 THEN qty + CASE WHEN row_idx % 3 = 0 THEN 1 ELSE 0 END END AS total, row_idx % 4 > 0 AND row_idx % 3 = 0 AS differs FROM cells")
def total_vs_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    printed = cells.where("row_idx % 4 > 0").select("form_id", "row_idx", (F.col("qty") + F.when(F.col("row_idx") % 3 == 0, 1).otherwise(0)).alias("total"))
    return review.total_vs_printed(cells, printed)


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CASE WHEN row_idx % 3 = 0 THEN ' Grand total' ELSE p_name END AS label FROM cells WHERE NOT (qty % 2 = 0 AND row_idx % 3 = 0)")
def drop_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("row_idx") % 3 == 0, " Grand total").otherwise(F.col("p_name"))
    rows = view(spark, sf_dir, "cells").select("form_id", "row_idx", label.alias("label"), F.filter(F.array("qty"), lambda q: q % 2 != 0).alias("cells"))
    return review.drop_summary_rows(rows).select("form_id", "row_idx", "label")


@query(with_views("catalog") + "SELECT DISTINCT 'style' AS kind, bstyle AS value FROM catalog UNION ALL SELECT DISTINCT 'size', CAST(bsize AS VARCHAR) FROM catalog")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.vocabulary(view(spark, sf_dir, "catalog"))


@query(with_views("catalog") + "SELECT a.detid AS item_id, b.detid FROM catalog a JOIN catalog b ON a.bname = b.bname WHERE a.detid % 2 = 0")
def products_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = view(spark, sf_dir, "catalog")
    items = catalog.where("detid % 2 = 0").select(F.col("detid").alias("item_id"), F.concat(F.lit(" "), F.lower("bname")).alias("item"))
    return matching.products_named(items, catalog.select("bname", "detid")).select("item_id", "detid")


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CASE WHEN qty % 3 = 0 THEN 'resolved' ELSE 'unverified' END AS status, CASE WHEN qty % 3 = 0 THEN size ELSE size || '0' END AS sizes FROM cells WHERE qty % 3 = 0 OR qty % 2 = 0")
def catalog_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qty")
    rows = _cells(spark, sf_dir).select("form_id", "row_idx", F.when(q % 3 == 0, 1).alias("offset"), F.array("size").alias("sizes"), F.filter(F.array(F.when(q % 2 == 0, F.concat("size", F.lit("0")))), lambda s: s.isNotNull()).alias("outside"))
    return reconcile.catalog_flags(rows).withColumn("sizes", F.array_join("sizes", ","))


@query(with_views("form_rows", "cells") + "SELECT r.form_id, r.row_idx, 'unverified' AS status, CASE WHEN c.qty % 2 = 0 THEN size ELSE '' END AS sizes FROM form_rows r LEFT JOIN cells c ON r.form_id = c.form_id AND r.row_idx = c.row_idx WHERE r.price % 5 = 0")
def flag_failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = view(spark, sf_dir, "form_rows").select("form_id", "row_idx", F.when(F.col("price") % 5 == 0, "timeout").alias("error"))
    return reconcile.flag_failed_rows(errors, _cells(spark, sf_dir).where("qty % 2 = 0")).withColumn("sizes", F.array_join("sizes", ","))


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CASE WHEN row_idx % 5 > 2 THEN 'unresolved' ELSE 'unverified' END AS status FROM cells WHERE row_idx % 5 > 0 AND qty > 0")
def flag_total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.flag_total_mismatch(_cells(spark, sf_dir).select("form_id", "row_idx", F.col("qty").alias("sum"), (F.col("qty") + F.col("row_idx") % 5).alias("total")))
