"""Queries of catalog and buyer matching, recounts, template events and single fields, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import catalog_match, matching, reconcile, recount, review, rows, templates
from tallyloom.plans.registry import query
from tallyloom.plans.views import selected, view, with_views
from tallyloom.sources.tables import live_buyers
from tallyloom.streaming.usage import usage_sessions


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _k() -> Column:
    return F.col("p_partkey")


def _joined(cells: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(cells), lambda c: F.concat(c["size"], F.lit(":"), c["qty"].cast("string"))), ",")


# single fields

@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS kind FROM part")
def clear_numeric_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(_k() % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    return _part(spark, sf_dir).select(_k(), text.clear_numeric_type(kind).alias("kind"))


@query("SELECT p_partkey, p_size || ',xl' AS headers FROM part")
def filter_size_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array(F.col("p_size").cast("string"), F.lit("Total"), F.lit("xl"), F.lit("1000"), F.lit(""))
    return _part(spark, sf_dir).select(_k(), F.array_join(text.filter_size_headers(headers, letters=True), ",").alias("headers"))


@query("SELECT p_partkey, p_size || ',x/2' AS headers FROM part")
def repair_fused_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array(F.concat(F.col("p_size").cast("string"), F.lit("/18")), F.lit("x/2"))
    return _part(spark, sf_dir).select(_k(), F.array_join(text.repair_fused_headers(headers), ",").alias("headers"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 10 + 2 WHEN 1 THEN p_size END AS shown, CASE WHEN p_partkey % 3 = 1 THEN p_size END AS reckoned FROM part")
def parse_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    written = F.when(_k() % 3 == 0, F.concat(size, F.lit(" 2"))).when(_k() % 3 == 1, size).otherwise(F.concat(size, F.lit(" pcs")))
    return _part(spark, sf_dir).select(_k(), text.parse_total(written).alias("shown"), text.plain_total(written).alias("reckoned"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 105 WHEN 1 THEN 11 WHEN 2 THEN CASE WHEN p_size < 1000 THEN p_size END END AS qty FROM part")
def correct_lookalike_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(_k() % 4 == 0, "lOS").when(_k() % 4 == 1, "I1").when(_k() % 4 == 2, F.col("p_size").cast("string")).otherwise("o0")
    return _part(spark, sf_dir).select(_k(), text.correct_lookalike_digits(written).alias("qty"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 9 + 1 WHEN 1 THEN p_size END AS qty FROM part")
def plain_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    circled = F.get(F.split(F.lit("①,②,③,④,⑤,⑥,⑦,⑧,⑨"), ","), (_k() % 9).cast("int"))
    return _part(spark, sf_dir).select(_k(), text.plain_int(F.when(_k() % 3 == 0, circled).when(_k() % 3 == 1, F.col("p_size").cast("string")).otherwise("x")).cast("long").alias("qty"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/20%y') AS day FROM orders")
def normalize_dmy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.normalize_dmy(F.date_format("o_orderdate", "d/M/yy")).alias("day"))


@query("""
SELECT p_partkey, p_name AS seller, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS party, p_partkey % 4 = 0 AS dated, CAST(p_size AS VARCHAR) AS headers,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Vest/' || p_size || ':' || p_size % 9 || ',L:0' END AS items
FROM part
""")
def repair_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a fence, with missing and null fields, numbers as text, unknown keys and entries of the wrong kind."""
    size, part = F.col("p_size").cast("string"), lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    party = F.when(_k() % 2 == 0, part('"party_name": "', F.col("p_type"), '", "extra": 1, ')).otherwise('"party_name": null, ')
    items = F.when(_k() % 3 == 0, '"none"').otherwise(part('[7, "x", {"item": "Vest", "row_total": null, "quantities": [{"size": "', size, '", "quantity": "', (F.col("p_size") % 9).cast("string"), '"}, {"size": "L", "quantity": "few"}]}]'))
    raw = part("```json\n", '{"seller_name": "', F.col("p_name"), '", ', party, '"date_present": ', (_k() % 4 == 0).cast("string"), ', "size_headers": ["', size, '", null], "items": ', items, "}\n```")
    r = F.col("r")
    told = F.array_join(F.transform(r["items"], lambda i: F.concat(i["item"], F.lit("/"), F.array_join(F.transform(i["quantities"], lambda q: F.concat(q["size"], F.lit(":"), q["qty"].cast("string"))), ","))), ";")
    return _part(spark, sf_dir).select(_k(), text.repair_record(raw).alias("r")).select(_k(), r["seller_name"].alias("seller"), r["party_name"].alias("party"), r["date_present"].alias("dated"), F.array_join(r["size_headers"], ",").alias("headers"), told.alias("items"))


@query(with_views("form_rows", "grid") + "SELECT form_id, row_idx, coalesce(string_agg(size || ':' || qty, ',' ORDER BY size) FILTER (WHERE qty > 0), '') AS cells FROM grid GROUP BY ALL")
def keep_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "grid").groupBy("form_id", "row_idx").agg(F.collect_list(F.struct("size", "qty")).alias("cells"))
    return cells.select("form_id", "row_idx", _joined(text.keep_positive(F.col("cells"))).alias("cells"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'NEEDS REVIEW (' || p_size || ')' WHEN p_partkey % 3 = 0 THEN 'Two readings differ: check this row against the photo.'
                       WHEN p_partkey % 3 = 1 THEN 'This row could not be checked.' END AS message
FROM part
""")
def flag_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(_k() % 3 == 0, "unresolved").when(_k() % 3 == 1, "unverified").otherwise("ok")
    note = F.when(_k() % 2 == 0, F.concat(F.lit("NEEDS REVIEW ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise("something else")
    return _part(spark, sf_dir).select(_k(), text.flag_message(status, note).alias("message"))


@query("""
WITH h AS (SELECT CAST(unnest(range(45, 115, 5)) AS VARCHAR) AS h),
     p AS (SELECT p_partkey, CAST(45 + 5 * (p_partkey % 14) AS VARCHAR) || CAST(45 + 5 * (p_size % 14) AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '5' WHEN p_partkey % 3 = 1 THEN '50' ELSE '' END AS t FROM part),
     w AS (SELECT p_partkey, a.h || ',' || b.h AS way FROM p, h a, h b WHERE t = a.h || b.h
           UNION ALL SELECT p_partkey, a.h || ',' || b.h || ',' || c.h FROM p, h a, h b, h c WHERE t = a.h || b.h || c.h
           UNION ALL SELECT p_partkey, a.h || ',' || b.h || ',' || c.h || ',' || d.h FROM p, h a, h b, h c, h d WHERE t = a.h || b.h || c.h || d.h)
SELECT p_partkey, CASE WHEN count(way) = 1 THEN min(way) END AS headers FROM p LEFT JOIN w USING (p_partkey) GROUP BY p_partkey
""")
def split_merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: (45 + 5 * (c % 14)).cast("string")
    fused = F.concat(size(_k()), size(F.col("p_size")), F.when(_k() % 3 == 0, "5").when(_k() % 3 == 1, "50").otherwise(""))
    headers = F.transform(F.sequence(F.lit(45), F.lit(110), F.lit(5)), lambda s: s.cast("string"))
    return _part(spark, sf_dir).select(_k(), fused.alias("t"), headers.alias("h")).select(_k(), F.array_join(text.split_merged_headers(F.col("t"), F.col("h")), ",").alias("headers"))


# rows

@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CASE WHEN l_returnflag <> 'R' THEN qty END AS qty, CASE WHEN l_returnflag = 'R' THEN '' ELSE '9' END AS row_total FROM cells")
def gate_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.gate_presence(view(spark, sf_dir, "cells").select("form_id", "row_idx", "qty", F.lit("9").alias("row_total"), (F.col("l_returnflag") == "R").alias("struck_out"))).drop("struck_out")


@query("SELECT o_orderkey AS form_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '1/2/26' END AS order_date FROM orders")
def gate_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("form_id"), F.lit("1/2/26").alias("order_date"), (F.col("o_orderkey") % 3 != 0).alias("date_present"))
    return rows.gate_date(forms).select("form_id", "order_date")


@query(with_views("form_rows", "grid", more="n AS (SELECT form_id, max(row_idx) AS rows FROM form_rows GROUP BY form_id)") + """
SELECT form_id, CASE WHEN row_idx >= 2 THEN row_idx + 1 ELSE row_idx END AS row_idx, size, qty FROM grid JOIN n USING (form_id) WHERE row_idx < 2 OR row_idx + 1 <= rows
""")
def shift_rows_vertically(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = view(spark, sf_dir, "form_rows").groupBy("form_id").agg(F.max("row_idx").alias("rows")).withColumn("from_row", F.lit(2))
    return rows.shift_rows_vertically(view(spark, sf_dir, "grid").select("form_id", "row_idx", "size", "qty"), first)


@query(with_views("form_rows", "grid", "cells") + "SELECT DISTINCT form_id, size FROM grid UNION SELECT DISTINCT form_id, size FROM cells UNION SELECT DISTINCT form_id, 'XL' FROM cells")
def add_product_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells")
    return review.add_size(review.add_product_sizes(view(spark, sf_dir, "grid"), cells), cells.select("form_id", F.lit(" xl ").alias("size")).distinct())


# readings and flags

@query(with_views("form_rows", "grid", more="f AS (SELECT form_id, count(*) FILTER (WHERE qty > 0) AS cells, count(*) FILTER (WHERE qty > 10) AS marks FROM grid GROUP BY form_id)") + """
SELECT DISTINCT form_id, row_idx, 'unverified' AS status, '' AS sizes FROM grid JOIN f USING (form_id) WHERE qty > 0 AND marks < 0.6 * cells
""")
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = view(spark, sf_dir, "grid")
    return reconcile.coverage_flags(grid.where("qty > 10"), grid).withColumn("sizes", F.array_join("sizes", ","))


@query(with_views("form_rows", more="a AS (SELECT form_id, row_idx / 8.0::DOUBLE AS y, CAST(qty % 5 - 2 AS DOUBLE) AS o, qty FROM form_rows), t AS (SELECT form_id, regr_slope(o, y) AS s, regr_intercept(o, y) AS i FROM a WHERE qty % 2 = 0 GROUP BY form_id HAVING count(*) >= 3 AND max(y) - min(y) >= 0.08)") + """
SELECT form_id, row_idx, CAST(round_even(round(s, 6) * (row_idx / 8.0::DOUBLE) + round(i, 6), 0) AS INT) AS "offset"
FROM form_rows JOIN t USING (form_id) WHERE qty % 2 = 1 AND round_even(round(s, 6) * (row_idx / 8.0::DOUBLE) + round(i, 6), 0) <> 0
""")
def drift_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "form_rows").select("form_id", "row_idx", (F.col("row_idx") / F.lit(8.0)).alias("y"), "qty")
    # lines are rounded on both sides, so that a half is a half in either engine
    trend = reconcile.drift_trend(r.where("qty % 2 = 0").select("form_id", "y", (F.col("qty") % 5 - 2).cast("double").alias("offset"))).withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 6)})
    open_ = r.select("form_id", "row_idx", "y", F.when(F.col("qty") % 2 == 1, "unresolved").otherwise("ok").alias("status"), F.lit(False).alias("matched"))
    return reconcile.drift_hints(open_, trend)


@query(with_views("form_rows", more="b AS (SELECT form_id, row_idx, (2 * row_idx + qty % 7) / 20.0::DOUBLE AS c, qty % 7 > 0 AS high FROM form_rows), l AS (SELECT *, lag(c) OVER (PARTITION BY form_id ORDER BY row_idx) AS above FROM b WHERE high)") + """
SELECT form_id, coalesce(valid, false) AS valid
FROM (SELECT DISTINCT form_id FROM form_rows) LEFT JOIN (SELECT form_id, bool_and(above IS NULL OR c >= above - 0.005) AS valid FROM l GROUP BY form_id) USING (form_id)
""")
def row_centres_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, q = F.col("row_idx"), F.col("qty") % 7
    return reconcile.row_centres_valid(view(spark, sf_dir, "form_rows").select("form_id", at, (at / F.lit(10.0)).alias("top"), ((at + q) / F.lit(10.0)).alias("bottom")))


#: Rows with two readings: moved ones, ones with a higher value, foreign sizes, other names, printed totals of either, and catalog sizes for two rows of three.
_RECOUNT = """
    k AS (SELECT form_id, row_idx, size, qty, CAST(size AS INT) AS s, form_id * 5 + row_idx AS k, (l_partkey % 16) * 5 + 40 AS low, 3 + l_partkey % 4 AS n FROM grid WHERE (l_partkey % 16) + 5 < 16),
    c AS (SELECT form_id, row_idx, k, low, n, s, qty,
                 CASE WHEN k % 7 = 0 THEN s + 5 WHEN k % 13 = 0 AND s = low THEN 999 ELSE s END AS s2,
                 CASE WHEN k % 7 <> 0 AND k % 5 = 0 AND s = low THEN qty + 2 ELSE qty END AS qty2
          FROM k)"""


#: What merge_recount decides of each, as st.
_DECIDED = """,
    r AS (SELECT form_id, row_idx, k, low, n, list(s || ':' || qty ORDER BY s) AS main, list(s2 || ':' || qty2 ORDER BY s2) AS other, sum(qty) AS sa, sum(qty2) AS sb,
                 list(s ORDER BY s) AS ka, list(s2 ORDER BY s2) AS kb FROM c GROUP BY ALL),
    o AS (SELECT *, CASE WHEN k % 4 = 0 THEN sa WHEN k % 4 = 1 THEN sb END AS total, CASE WHEN k % 3 = 0 THEN [low + 5 * i FOR i IN range(0, n)] WHEN k % 3 = 1 THEN [low + 5 * i FOR i IN range(1, n + 1)] END AS cat FROM r),
    f AS (SELECT *, [d FOR d IN [-2, -1, 0, 1, 2] IF list_bool_and([x + 5 * d BETWEEN 40 AND 115 AND x BETWEEN 40 AND 115 AND list_contains(cat, x + 5 * d) FOR x IN ka])] AS fa,
                 [d FOR d IN [-2, -1, 0, 1, 2] IF list_bool_and([x + 5 * d BETWEEN 40 AND 115 AND x BETWEEN 40 AND 115 AND list_contains(cat, x + 5 * d) FOR x IN kb])] AS fb FROM o),
    g AS (SELECT *, CASE WHEN len(fa) = 1 THEN fa[1] END AS a, CASE WHEN len(fb) = 1 THEN fb[1] END AS b FROM f),
    h AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'unverified'
                         WHEN list_contains(kb, 999) OR kb[-1] > 115 THEN 'unverified'
                         WHEN main = other AND a <> 0 THEN 'auto_corrected'
                         WHEN main = other THEN CASE WHEN total > 0 AND total <> sa THEN 'unverified' ELSE 'ok' END
                         WHEN total > 0 AND sb = total AND sa <> total THEN 'recount' WHEN total > 0 AND sa = total AND sb <> total THEN 'main'
                         WHEN cat IS NOT NULL AND a = 0 AND b IS DISTINCT FROM 0 THEN 'main' WHEN cat IS NOT NULL AND b = 0 AND a IS DISTINCT FROM 0 THEN 'recount' ELSE 'unresolved' END AS st FROM g)"""


@query(with_views("form_rows", "grid", more=_RECOUNT) + _DECIDED + """
SELECT form_id, row_idx, CASE WHEN st IN ('main', 'recount') THEN 'resolved' ELSE st END AS status,
       CASE st WHEN 'recount' THEN 'recount' WHEN 'auto_corrected' THEN 'shifted' ELSE 'main' END AS chosen,
       array_to_string(list_sort(CASE st WHEN 'recount' THEN other WHEN 'auto_corrected' THEN [CAST(x + 5 * a AS VARCHAR) || ':' || string_split(m, ':')[2] FOR m IN main FOR x IN [CAST(string_split(m, ':')[1] AS INT)]] ELSE main END), ',') AS cells
FROM h
""".replace("[CAST(x + 5 * a AS VARCHAR) || ':' || string_split(m, ':')[2] FOR m IN main FOR x IN [CAST(string_split(m, ':')[1] AS INT)]]", "[CAST(CAST(string_split(m, ':')[1] AS INT) + 5 * a AS VARCHAR) || ':' || string_split(m, ':')[2] FOR m IN main]"))
def merge_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recount.merge_recount(two_readings(spark, sf_dir))
    return out.select("form_id", "row_idx", "status", "chosen", F.array_join(F.array_sort(F.transform("cells", lambda x: F.concat(x["size"], F.lit(":"), x["qty"].cast("string")))), ",").alias("cells"))


def two_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as merge_recount takes them."""
    c = selected(spark, sf_dir, "SELECT * FROM c", "grid", more=_RECOUNT)
    k, cell = F.col("k"), lambda s, q: F.collect_list(F.struct(F.col(s).cast("string").alias("size"), F.col(q).alias("qty")))
    r = c.groupBy("form_id", "row_idx", "k", "low", "n").agg(cell("s", "qty").alias("main"), cell("s2", "qty2").alias("recount"), F.sum("qty").alias("sa"), F.sum("qty2").alias("sb"))
    span = lambda first: F.transform(F.sequence(F.lit(first), F.col("n").cast("int") - 1 + first), lambda i: (F.col("low") + 5 * i).cast("int"))
    return r.select(
        "form_id", "row_idx", "main", "recount", F.lit("Vest Plain").alias("item"), F.when(k % 11 == 0, "zzz qqq").otherwise("VEST  plain").alias("item_seen"),
        F.when(k % 4 == 0, F.col("sa").cast("string")).otherwise("").alias("row_total"), F.when(k % 4 == 1, F.col("sb").cast("string")).otherwise("0").alias("total_dozen"),
        F.when(k % 3 == 0, span(0)).when(k % 3 == 1, span(1)).alias("catalog_sizes"), F.transform(F.sequence(F.lit(40), F.lit(115), F.lit(5)), lambda s: s.cast("string")).alias("size_headers"))


# matching

@query(with_views("catalog", more="n AS (SELECT DISTINCT bname FROM catalog)") + """
SELECT replace(lower(a.bname), ' ', '-') AS item, a.bname, 100.0::DOUBLE AS score, true AS code_narrowed, count(*) AS pool, '' AS unmatched_code
FROM n a JOIN n b ON contains(b.bname, a.bname[-3:])
GROUP BY a.bname
UNION ALL
SELECT 'x' || lower(bname[:-4]) || '1o' || bname[-2:], bname, round(200 * length(bname) / CAST(2 * length(bname) + 2 AS DOUBLE), 6), false, (SELECT count(*) FROM n), '' FROM n
""")
def best_catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of the catalog finds itself, written otherwise, and misread: with a letter before it and one between the digits, so that no code narrows."""
    catalog = view(spark, sf_dir, "catalog")
    low = F.lower("bname")
    misread = F.concat(F.lit("x"), F.substr(low, F.lit(1), F.length(low) - 3), F.lit("1o"), F.right(low, F.lit(2)))
    items = catalog.select(F.explode(F.array(F.replace(low, F.lit(" "), F.lit("-")), misread)).alias("item"))
    return catalog_match.best_catalog_match(items, catalog).withColumn("score", F.round("score", 6))


#: Names on forms: the own letterhead, buyers' names, and others. Customers whose key is a multiple of 7 are not live.
_PARTIES = """p AS (
    SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'LOOMHOUSE Garments' WHEN 1 THEN 'customer#' || lpad(CAST(s_suppkey AS VARCHAR(9)), 9, '0') ELSE s_name END AS seller_name,
           CASE s_suppkey % 3 WHEN 0 THEN 'Customer ' || lpad(CAST(s_suppkey AS VARCHAR(9)), 9, '0') WHEN 1 THEN 'Customer#' || lpad(CAST(s_suppkey + 1 AS VARCHAR(9)), 9, '0') ELSE 'Nobody at all' END AS party_name
    FROM supplier)"""


@query("""
WITH p AS (SELECT s_suppkey AS k FROM supplier),
     h AS (SELECT k, k % 4 = 1 AND k % 7 <> 0 AS s, CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN k WHEN k % 3 = 1 AND (k + 1) % 7 <> 0 THEN k + 1 END AS p FROM p),
     o AS (SELECT *, CASE WHEN k % 4 = 0 OR (p IS NOT NULL AND NOT s) OR (s AND p = k) THEN NULL WHEN s AND p IS NOT NULL THEN 'ambiguous' WHEN s THEN 'suggest' ELSE 'unmatched' END AS outcome FROM h)
SELECT k AS form_id, outcome, CASE WHEN outcome = 'suggest' THEN c_name END AS suggested_party_name, false AS closed_hint FROM o LEFT JOIN customer ON c_custkey = k
""")
def resolve_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = selected(spark, sf_dir, "SELECT k AS form_id, seller_name, party_name FROM p", "supplier", more=_PARTIES)
    return catalog_match.resolve_party(forms, live_buyers(view(spark, sf_dir, "buyers")), "loomhouse")


@query("SELECT s_suppkey AS form_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 THEN s_suppkey WHEN s_suppkey % 3 = 1 AND (s_suppkey + 1) % 7 <> 0 THEN s_suppkey + 1 END AS head_id FROM supplier")
def suggest_buyer(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = selected(spark, sf_dir, "SELECT k AS form_id, party_name, '' AS suggested_party_name FROM p", "supplier", more=_PARTIES)
    return catalog_match.suggest_buyer(forms, live_buyers(view(spark, sf_dir, "buyers")))


@query()
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best names for each product name with a code behind it. Tested against brute force."""
    catalog = view(spark, sf_dir, "catalog")
    names = catalog_match.ordered_keys(catalog.select("bname").distinct(), "bname").select("ord", F.col("bname").alias("key"))
    texts = _part(spark, sf_dir).select(F.concat(F.lower("p_name"), F.lit(" "), (100 + F.col("p_size") % 5).cast("string")).alias("text"))
    return catalog_match.ranked_search(texts, names, 10)


def _products(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("bsid", "bname", "bstyle").agg(F.sort_array(F.collect_set(F.col("bsize").cast("string"))).alias("sizes"))


@query()
def bind_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item of each name of the catalog, with the style and sizes of one of its products, bound by way of its match. Tested on small cases."""
    catalog = view(spark, sf_dir, "catalog")
    products = _products(catalog)
    items = products.groupBy("bname").agg(F.min(F.struct("bstyle", "sizes")).alias("p")).select(F.col("bname").alias("row_id"), F.lower("bname").alias("item"), F.col("p.bstyle").alias("style"), F.col("p.sizes").alias("sizes"))
    matches = matching.match_trust(catalog_match.best_catalog_match(items.select("item"), catalog))
    out = catalog_match.bind_products(items, matches, products)
    return out.select("row_id", "bsid", "auto_bound", F.array_join("size_mismatch", ",").alias("size_mismatch"), F.array_join("candidates", ";").alias("candidates"))


@query()
def annotate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several cells matched, trusted, and checked for styles, letter sizes and shifts, one step after the other. Tested on small cases."""
    grid = view(spark, sf_dir, "grid").groupBy("form_id", "row_idx", "l_partkey").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("size") == "45", "L").otherwise(F.col("size")).alias("size"), "qty"))).alias("cells"))
    names = view(spark, sf_dir, "catalog").select(F.col("detid").alias("l_partkey"), F.lower("bname").alias("item"), F.when(F.col("detid") % 2 == 0, F.col("bstyle")).otherwise("").alias("kind"))
    r = grid.join(names, "l_partkey").select("form_id", "row_idx", "item", "kind", F.sequence(F.lit(40), F.lit(115), F.lit(5)).alias("headers"), "cells")
    out = catalog_match.annotate_rows(r, view(spark, sf_dir, "catalog"))
    flat = {c: F.array_join(c, ",") for c in ("style_mismatch", "unresolved", "conflicts", "outside")}
    return out.withColumns(flat).withColumn("cells", _joined(F.col("cells")))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS q FROM part),
     r AS (SELECT k, q, k % 4 < 3 AS trusted, k % 2 = 0 AS has45, k % 3 <> 0 AS kids FROM p)
SELECT k AS p_partkey,
       CASE WHEN NOT trusted OR NOT kids THEN 'L:2,' WHEN has45 THEN 'L:2,' ELSE '45:2,' END || CASE WHEN trusted AND kids THEN '50:3' ELSE 'XL:3' END || CASE WHEN has45 THEN ',45:' || q ELSE '' END AS cells,
       CASE WHEN trusted AND kids AND has45 THEN 'L' ELSE '' END AS conflicts
FROM r
""")
def apply_letter_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda s, q: F.struct(F.lit(s).alias("size"), q.cast("int").alias("qty"))
    cells = F.concat(F.array(cell("L", F.lit(2)), cell("XL", F.lit(3))), F.when(_k() % 2 == 0, F.array(cell("45", F.col("p_size")))).otherwise(F.array().cast("array<struct<size:string,qty:int>>")))
    sizes = F.when(_k() % 3 != 0, F.array(F.lit(45), F.lit(50))).otherwise(F.array(F.lit(60)))
    out = catalog_match.apply_letter_sizes(_part(spark, sf_dir).select(_k(), cells.alias("cells"), sizes.alias("catalog_sizes"), (_k() % 4 < 3).alias("trusted")))
    told = F.array_join(F.transform("cells", lambda c: F.concat(c["size"], F.lit(":"), c["qty"].cast("string"))), ",")
    return out.select(_k(), told.alias("cells"), F.array_join("conflicts", ",").alias("conflicts"))


# templates and usage

def shown_and_submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some were renamed, some kept a rule's name or shift, some were moved by a column, and some were added or dropped. Some names differ in case alone."""
    c, pair = _k() % 5, lambda *s: F.array(*(F.struct(F.lit(x).alias("size"), F.col("p_size").cast("int").alias("qty")) for x in s))
    renamed = F.when(_k() % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("-"))).otherwise(" Vest ")
    return _part(spark, sf_dir).select(
        F.concat(F.lit("s"), (_k() % 9).cast("string")).alias("signature"), F.when(_k() % 12 == 0, "1#new").when(_k() % 6 == 0, "").otherwise(_k().cast("string")).alias("uid"), _k().alias("at"),
        F.col("p_name").alias("item"), pair("45", "50").alias("cells"), F.when(c == 0, renamed).otherwise(F.col("p_name")).alias("submitted_item"), F.when(c == 2, pair("50", "55")).otherwise(pair("45", "50")).alias("submitted_cells"),
        F.array(F.lit("45"), F.lit("50"), F.lit("55"), F.lit("60")).alias("headers"), F.when(c == 1, "item_substitution").when(c == 3, "column_shift").alias("fired_kind"), F.lit("Read, as").alias("rule_raw"), F.lit("Moved!").alias("rule_trigger"), pair("50", "55").alias("raw_cells"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS name, p_partkey % 5 AS c FROM part WHERE p_partkey % 6 <> 0)
SELECT 's' || k % 9 AS signature, 'item_substitution' AS kind, name AS trigger, k AS at, CASE WHEN k % 2 = 0 THEN upper(name) || '-' ELSE 'Vest' END AS value FROM p WHERE c = 0
UNION ALL SELECT 's' || k % 9, 'item_substitution', 'Read, as', k, NULL FROM p WHERE c = 1
UNION ALL SELECT 's' || k % 9, 'column_shift', lower(name), k, '1' FROM p WHERE c = 2
UNION ALL SELECT 's' || k % 9, 'column_shift', 'moved', k, NULL FROM p WHERE c = 3
""")
def correction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.correction_events(shown_and_submitted(spark, sf_dir)).drop("uid")


@query("""
WITH e AS (SELECT user_id AS image, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first, CAST(floor(value) AS BIGINT) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT *, sum(first) OVER (PARTITION BY image ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT image, min(ts) AS start, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY image, n
""")
def usage_sessions_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("image"), "ts", F.floor("value").alias("input_tokens"))
    return usage_sessions(events, "6 hours")
