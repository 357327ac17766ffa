"""Queries of whole workloads, of template statistics and of rules that stand alone, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.scratch import written
from tallyloom.operators import geometry, matching, orders, reconcile, recount, review, templates, totals
from tallyloom.plans.geometry_queries import _BANDS, _HEADERS, _headers, _tokens
from tallyloom.plans.match_queries import _DECIDED, _RECOUNT, shown_and_submitted, two_readings
from tallyloom.plans.registry import query
from tallyloom.plans.views import selected, view, with_views

# submissions to orders

#: A submission for each order, with every kind of problem among its cells, and some without a buyer.
_SUBMITTED = """
s AS (
    SELECT CAST(form_id AS STRING) AS session_id, row_idx AS rsno,
           CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'none' ELSE upper(p_name) || '/' || CAST(100 + p_partkey % 40 AS STRING) || '/' || p_type END AS bsid,
           CASE WHEN p_partkey % 37 = 0 THEN '7' ELSE size END AS size,
           CASE WHEN p_partkey % 41 = 0 THEN -qty WHEN p_partkey % 43 = 0 THEN qty + 40000 WHEN p_partkey % 5 = 0 THEN 0 ELSE qty END AS qty
    FROM cells)"""
_TAKEN = with_views("form_rows", "cells", "catalog", more=_SUBMITTED.replace("STRING", "VARCHAR") + """,
g AS (SELECT bsid, CAST(bsize AS VARCHAR) AS size, max(detid) AS detid FROM catalog GROUP BY ALL),
known AS (SELECT DISTINCT bsid FROM g),
r AS (
    SELECT s.*, detid,
           CASE WHEN s.bsid IS NULL THEN 'unbound' WHEN known.bsid IS NULL THEN 'unknown_product' WHEN qty < 0 THEN 'negative_qty' WHEN qty > 32767 THEN 'qty_too_large' WHEN detid IS NULL THEN 'size_not_in_product' END AS problem
    FROM s LEFT JOIN known ON s.bsid = known.bsid LEFT JOIN g ON s.bsid = g.bsid AND s.size = g.size WHERE qty <> 0),
h AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderdate AS day, o_orderkey % 50 <> 0 AS buyer FROM orders),
p AS (
    SELECT session_id, coalesce(list(CASE WHEN problem IN ('unbound', 'unknown_product') THEN 'row ' || rsno || ' ' || problem ELSE 'row ' || rsno || ' ' || problem || ' ' || size END) FILTER (problem IS NOT NULL), []) AS problems, bool_or(qty > 0) AS pieces
    FROM r GROUP BY session_id),
told AS (
    SELECT session_id, day, list_concat(CASE WHEN buyer THEN [] ELSE ['buyer'] END, CASE WHEN coalesce(pieces, false) THEN [] ELSE ['quantities'] END, list_sort(coalesce(problems, []))) AS problems
    FROM h LEFT JOIN p USING (session_id)),
m AS (SELECT session_id, row_number() OVER (ORDER BY day, session_id) + 500 AS order_no FROM told WHERE len(problems) = 0)""")


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selected(spark, sf_dir, "SELECT * FROM s", "cells", more=_SUBMITTED).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rsno", "bsid", F.lit("").alias("item"), F.array(F.struct("size", "qty")).alias("q")))).alias("rows"))
    rows = rows.select("session_id", F.transform("rows", lambda r: F.struct(r["bsid"].alias("bsid"), r["item"].alias("item"), F.map_from_entries(r["q"]).alias("quantities"))).alias("rows"))
    key = F.col("o_orderkey")
    heads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.cast("string").alias("session_id"), F.col("o_orderdate").alias("submitted_at"), F.when(key % 50 != 0, F.col("o_custkey")).cast("int").alias("head_id"), F.lit(7).alias("user_id"), F.lit("").alias("ref_no"), F.to_date("o_orderdate").alias("order_dt"), F.lit(None).cast("date").alias("ref_dt"), F.lit(None).cast("int").alias("company_id"), F.lit("").alias("order_source"))
    return heads.join(rows, "session_id", "left")


def _orders(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    none = spark.createDataFrame([], "session_id string")
    return orders.orders_of(_submissions(spark, sf_dir), orders.product_groups(view(spark, sf_dir, "catalog")), none, 500, F.current_date())


@query(_TAKEN + """
SELECT order_no, session_id, detid AS det_id, qty, rsno, row_number() OVER (PARTITION BY session_id ORDER BY rsno, size, detid) AS sno
FROM (SELECT session_id, detid, min(rsno) AS rsno, arg_min(size, (rsno, size)) AS size, CAST(sum(qty) AS BIGINT) AS qty FROM r JOIN m USING (session_id) GROUP BY ALL) JOIN m USING (session_id)
""")
def submissions_to_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions resolved, checked, numbered and merged to details, as a batch of stream_orders."""
    out = _orders(spark, sf_dir)
    return out["details"].join(out["master"].select("order_no", "session_id"), "order_no").select("order_no", "session_id", "det_id", "qty", "rsno", "sno")


@query(_TAKEN + "SELECT session_id, array_to_string(problems, ';') AS problems FROM told WHERE len(problems) > 0")
def rejected_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)["rejected"].select("session_id", F.array_join("problems", ";").alias("problems"))


@query(_TAKEN + "SELECT session_id, rsno, problem AS kind, CASE WHEN problem IN ('unbound', 'unknown_product') THEN '' ELSE size END AS sizes FROM r WHERE problem IS NOT NULL")
def row_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = selected(spark, sf_dir, "SELECT * FROM s", "cells", more=_SUBMITTED)
    return orders.row_problems(orders.resolve_lines(cells, orders.product_groups(view(spark, sf_dir, "catalog")))).withColumn("sizes", F.array_join("sizes", ","))


# readings to flags

@query(with_views("form_rows", "grid", more=_RECOUNT) + _DECIDED + """,
    n AS (
        SELECT *, CASE st WHEN 'main' THEN 2 WHEN 'recount' THEN 2 WHEN 'auto_corrected' THEN 2 WHEN 'unverified' THEN 1 WHEN 'unresolved' THEN 3 ELSE 0 END AS sev, CASE WHEN st IN ('main', 'recount') THEN 'resolved' ELSE st END AS status,
               CASE WHEN total > 0 AND (CASE WHEN st = 'recount' THEN sb ELSE sa END) > 0 THEN abs((CASE WHEN st = 'recount' THEN sb ELSE sa END) - total) ELSE 0 END AS off,
               'Row-crop recount' || CASE
                   WHEN k % 11 = 0 THEN ' read another item here: zzz qqq.' WHEN list_contains(kb, 999) THEN ' found sizes that are no header: 999.' WHEN kb[-1] > 115 THEN ' found sizes that are no header: 120.'
                   WHEN main = other AND a <> 0 THEN ' agrees, moved by ' || a || ' to the sizes of the catalog.' WHEN main = other THEN ' agrees, but the printed total is ' || total || ', the sum ' || sa || '.'
                   WHEN st = 'unresolved' THEN ' differs, and nothing says which is right.' WHEN total > 0 AND (sb = total) <> (sa = total) THEN ' differs, the ' || st || ' fits the printed total.'
                   ELSE ' differs, the ' || st || ' fits the sizes of the catalog.' END AS note
        FROM h),
    m AS (SELECT *, CASE WHEN off > 2 THEN 3 WHEN off > 0 THEN 1 ELSE 0 END AS sev2 FROM n)
SELECT form_id, row_idx, CASE WHEN sev2 > sev THEN CASE sev2 WHEN 3 THEN 'unresolved' ELSE 'unverified' END ELSE status END AS status,
       CASE WHEN sev > 0 THEN note WHEN sev2 = 3 THEN 'Two readings differ: check this row against the photo.' ELSE 'This row could not be checked.' END AS message
FROM m WHERE greatest(sev, sev2) > 0
""")
def readings_to_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each row merged, the outcome held against the printed total, and the flags of both merged into what a reviewer is shown."""
    readings = written(two_readings(spark, sf_dir), "readings")
    merged = written(recount.merge_recount(readings), "recounts")  # two branches read it
    read = readings.select("form_id", "row_idx", F.coalesce(F.nullif(F.col("total_dozen").try_cast("long"), F.lit(0)), F.col("row_total").try_cast("long")).alias("total"))
    flags = merged.where("status not in ('ok', 'no_recount')").select("form_id", "row_idx", F.lit(1).alias("seq"), "status", "sizes", "note")
    sums = merged.select("form_id", "row_idx", F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + c["qty"]).alias("sum")).join(read, ["form_id", "row_idx"])
    off = reconcile.flag_total_mismatch(sums).select("form_id", "row_idx", F.lit(2).alias("seq"), "status", F.array().cast("array<string>").alias("sizes"), F.lit("").alias("note"))
    shown = reconcile.merge_flags(flags.unionByName(off))
    return shown.select("form_id", "row_idx", "status", text.flag_message(F.col("status"), F.col("note")).alias("message"))


# templates

@query("""
WITH k AS (SELECT p_partkey % 9 AS t, 'b' || p_partkey % 3 AS backend, 'm' || p_partkey % 2 AS model, p_partkey % 5 IN (0, 2) AS corrected FROM part WHERE p_partkey % 6 <> 0),
     p AS (SELECT 's' || t AS signature, backend, model, count(*) FILTER (corrected) / CAST(count(*) AS DOUBLE) AS r FROM k GROUP BY ALL)
SELECT signature, 'backend' AS stat, backend AS name, count(*) AS uses, round(avg(r), 6) AS rate FROM p GROUP BY ALL
UNION ALL SELECT signature, 'model', model, count(*), round(avg(r), 6) FROM p GROUP BY ALL
""")
def correction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From rows as shown and as submitted to pages' corrections to the rates of backends and models."""
    k = F.col("at")
    rows = shown_and_submitted(spark, sf_dir).withColumns({"backend": F.concat(F.lit("b"), (k % 3).cast("string")), "model": F.concat(F.lit("m"), (k % 2).cast("string"))})
    return templates.correction_rates(templates.page_corrections(rows, "backend", "model")).withColumn("rate", F.round("rate", 6))


# tokens

#: Headers 100 and 105 of every third form as one token; of every sixth it stands far below the header row.
_FUSED = """
pair AS (SELECT form_id FROM h WHERE size IN ('100', '105') AND form_id % 3 = 0 GROUP BY form_id HAVING count(*) = 2),
fused AS (SELECT t.* FROM tokens t WHERE NOT (token_id IN (100, 105) AND form_id IN (SELECT form_id FROM pair))
          UNION ALL SELECT form_id, 100, '100105', 790.0::DOUBLE, CASE WHEN form_id % 6 = 0 THEN 990.0 ELSE 90.0 END::DOUBLE, 850.0::DOUBLE, CASE WHEN form_id % 6 = 0 THEN 1010.0 ELSE 110.0 END::DOUBLE, 0.9::DOUBLE FROM pair),
f AS (SELECT form_id, size, arg_min((x0 + x1) / 2, token_id) AS x FROM h JOIN fused USING (form_id) WHERE text = size AND score >= 0.5 GROUP BY form_id, size),
two AS (SELECT form_id, size, CASE size WHEN '100' THEN 805.0 ELSE 835.0 END::DOUBLE AS x FROM h JOIN pair USING (form_id) WHERE size IN ('100', '105') AND form_id % 6 <> 0 AND form_id IN (SELECT form_id FROM f)),
every AS (SELECT form_id, size, coalesce(f.x, two.x) AS x FROM h LEFT JOIN f USING (form_id, size) LEFT JOIN two USING (form_id, size))"""


@query(with_views("form_rows", "grid", "tokens", more=_HEADERS + "," + _FUSED) + "SELECT form_id, size, x FROM every WHERE x IS NOT NULL AND form_id IN (SELECT form_id FROM every GROUP BY form_id HAVING count(x) >= 0.6 * count(*))")
def locate_fused_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, tokens, own = _headers(spark, sf_dir), _tokens(spark, sf_dir), F.col("token_id").isin(100, 105)
    both = headers.where("size in ('100', '105') and form_id % 3 = 0").groupBy("form_id").agg(F.size(F.collect_set("size")).alias("n")).where("n = 2").select("form_id")
    down = F.when(F.col("form_id") % 6 == 0, 900.0).otherwise(0.0)
    one = both.select("form_id", F.lit(100).alias("token_id"), F.lit("100105").alias("text"), F.lit(790.0).alias("x0"), (down + 90).alias("y0"), F.lit(850.0).alias("x1"), (down + 110).alias("y1"), F.lit(0.9).alias("score"))
    fused = tokens.where(~own).unionByName(tokens.where(own).join(both, "form_id", "left_anti")).unionByName(one)
    return geometry.locate_headers(fused, headers).select("form_id", "size", "x")


@query(with_views("form_rows", "grid", "tokens", more=_BANDS.replace("WHERE text", "WHERE token_id < 1000 AND text")) + "SELECT form_id, CASE WHEN form_id % 2 = 0 THEN 128.0 ELSE bottom END::DOUBLE AS bottom FROM bands")
def skip_decoy_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second form has a further line of labels below its headers."""
    tokens = _tokens(spark, sf_dir)
    printed = tokens.where("token_id < 1000")
    bands = geometry.header_bands(geometry.locate_headers(printed, _headers(spark, sf_dir)))
    line = printed.where("form_id % 2 = 0").withColumns({"token_id": F.col("token_id") + 500, "text": F.lit("d"), "y0": F.lit(112.0), "y1": F.lit(128.0), "score": F.lit(0.9)})
    return geometry.skip_decoy_bands(tokens.unionByName(line), bands).select("form_id", "bottom")


@query(with_views("form_rows", more="y AS (SELECT form_id, CAST(price % 1000 AS DOUBLE) / (1 + form_id % 40) AS y, form_id % 40 AS k FROM form_rows), g AS (SELECT form_id, CASE WHEN count(*) > 1 THEN greatest(least((max(y) - min(y)) / (count(*) - 1) * 0.6::DOUBLE, 20.0::DOUBLE), 8.0::DOUBLE) ELSE 20.0::DOUBLE END AS gap FROM y GROUP BY form_id)") + "SELECT form_id, round(gap, 6) AS gap FROM g")
def cluster_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "form_rows").select("form_id", ((F.col("price") % 1000).cast("double") / (1 + F.col("form_id") % 40)).alias("y"))
    return geometry.cluster_gap(items).withColumn("gap", F.round("gap", 6))


@query(with_views("form_rows", more="m AS (SELECT form_id, row_idx AS token_id, price % 97 AS y, 8 + form_id % 13 AS gap FROM form_rows), d AS (SELECT *, y - lag(y) OVER (PARTITION BY form_id ORDER BY y, token_id) AS step FROM m)") + "SELECT form_id, token_id, CAST(count(*) FILTER (WHERE step > gap) OVER (PARTITION BY form_id ORDER BY y, token_id) AS BIGINT) AS cluster FROM d")
def cluster_rows_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = view(spark, sf_dir, "form_rows").select("form_id", F.col("row_idx").alias("token_id"), (F.col("price") % 97).alias("y"), (8 + F.col("form_id") % 13).alias("gap"))
    return review.cluster_rows(marks, F.col("gap")).select("form_id", "token_id", "cluster")


# totals

@query(with_views("form_rows", "cells", "forms", more="""
c AS (SELECT session_id, page, form_id * 100 + row_idx AS row_idx, size, qty, p_partkey % 7 > 0 AS bound FROM cells JOIN forms USING (form_id)),
r AS (SELECT session_id, page, row_idx, sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) AS n, sum(qty) AS q, NOT bool_or(bound) AND sum(qty) > 0 AS unbound FROM c GROUP BY ALL)""") + """
SELECT 'size' AS level, session_id, page, size, CAST(NULL AS BIGINT) AS rows, count(*) FILTER (qty > 0) AS filled, CAST(sum(qty) AS BIGINT) AS pieces, CAST(NULL AS BIGINT) AS unbound FROM c GROUP BY session_id, page, size
UNION ALL SELECT 'page', session_id, page, NULL, count(*), CAST(sum(n) AS BIGINT), CAST(sum(q) AS BIGINT), count_if(unbound) FROM r GROUP BY session_id, page
UNION ALL SELECT 'session', session_id, NULL, NULL, count(*), CAST(sum(n) AS BIGINT), CAST(sum(q) AS BIGINT), count_if(unbound) FROM r GROUP BY session_id
UNION ALL SELECT 'all', NULL, NULL, NULL, count(*), CAST(sum(n) AS BIGINT), CAST(sum(q) AS BIGINT), count_if(unbound) FROM r
""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").join(view(spark, sf_dir, "forms"), "form_id").withColumn("row_idx", F.col("form_id") * 100 + F.col("row_idx"))
    return totals.order_totals(cells.withColumn("bsid", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type"))))


# rules that stand alone

@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN array_to_string(list_sort([s FOR s IN [p_size, p_size + 5, 200] IF s <> p_size % 4 + p_size - 1 AND s <> 200 OR s = 200]), ',') END AS outside FROM part")
def sizes_outside_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a row beside a letter; the product has the first of them, another, or no size at all."""
    size = F.col("p_size").cast("int")
    sizes = F.transform(F.array(F.lit(200), size + 5, size), lambda s: s.cast("string"))
    has = F.when(size % 4 > 0, F.array((size % 4 + size - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.array_join(matching.sizes_outside_catalog(F.concat(sizes, F.array(F.lit("XL"))), has), ",").alias("outside"))


@query(with_views("form_rows") + "SELECT form_id, row_idx, 'unresolved' AS status FROM form_rows WHERE l_returnflag = 'R' AND qty % 3 > 0")
def struck_out_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "form_rows").select("form_id", "row_idx", (F.col("l_returnflag") == "R").alias("struck_out"), (F.col("qty") % 3).alias("marks"))
    return reconcile.struck_out_conflict(rows)


@query(with_views("form_rows", "cells") + """
SELECT form_id, row_idx, CASE WHEN CAST(size AS INT) % 10 = 5 THEN size ELSE CAST(CAST(size AS INT) + 10 * (form_id % 3 - 1) AS VARCHAR) END AS size, qty FROM cells
WHERE CAST(size AS INT) % 10 = 5 OR CAST(size AS INT) + 10 * (form_id % 3 - 1) BETWEEN 10 AND 250
""")
def apply_offset_to_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers have a letter between each two numbers, which the offset does not count."""
    cells = view(spark, sf_dir, "cells").select("form_id", "row_idx", "size", "qty", (F.col("form_id") % 3 - 1).cast("int").alias("offset"))
    printed = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.when(i % 2 == 1, ((i + 1) * 5).cast("string")).otherwise(F.concat(F.lit("L"), i.cast("string"))))
    headers = cells.select("form_id").distinct().select("form_id", F.posexplode(printed).alias("pos", "size"))
    return matching.apply_offset(cells, headers, numbers=True)
