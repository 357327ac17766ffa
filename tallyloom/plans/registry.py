"""Registered queries, each a use of operators on the stand-in tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.scratch import written
from tallyloom.operators import matching, orders, reconcile, rows, templates, totals
from tallyloom.plans.views import SECOND, second_reading, selected, view, with_views
from tallyloom.sources import tables
from tallyloom.streaming.usage import usage_windows

FLAGSHIP = "order_summary"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# sources

@query(with_views("catalog") + "SELECT bid, bname, bsize, detid FROM catalog WHERE isprimary = 1 AND isunused = 0 AND bsize IS NOT NULL")
def read_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.catalog_for_picking(view(spark, sf_dir, "catalog")).select("bid", "bname", "bsize", "detid")


@query(with_views("buyers") + "SELECT head_id, trim(name) AS name, trim(city) AS city FROM buyers WHERE is_active = 0 AND trim(name) <> ''")
def read_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.live_buyers(view(spark, sf_dir, "buyers")).select("head_id", "name", "city")


# aggregates

@query(with_views("catalog") + "SELECT bname, array_to_string(list_sort(list(DISTINCT bstyle)), ',') AS styles, array_to_string(list_sort(list(DISTINCT bsize)), ',') AS sizes FROM catalog GROUP BY bname")
def catalog_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orders.catalog_by_name(view(spark, sf_dir, "catalog"))
    return out.select("bname", F.array_join("styles", ",").alias("styles"), F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


@query(with_views("catalog") + """
SELECT CASE WHEN detid % 7 = 0 OR detid % 11 = 0 THEN bid || bstyle ELSE bsid END AS bsid, CAST(bsize AS VARCHAR) AS size, max(detid) AS detid
FROM catalog
GROUP BY 1, 2
""")
def product_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("detid")
    return orders.product_groups(view(spark, sf_dir, "catalog").withColumn("bsid", F.when(k % 7 == 0, "").when(k % 11 != 0, F.col("bsid"))))


@query(with_views("form_rows", "cells", "forms", more="r AS (SELECT session_id, page, form_id * 100 + row_idx AS row_idx, sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) AS n, sum(qty) AS q, bool_and(p_partkey % 7 = 0) AS none FROM cells JOIN forms USING (form_id) GROUP BY session_id, page, form_id, row_idx)") + "SELECT session_id, page, count(*) AS rows, CAST(sum(n) AS BIGINT) AS filled, CAST(sum(q) AS BIGINT) AS pieces, count_if(none AND q > 0) AS unbound FROM r GROUP BY ROLLUP (session_id, page)")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").join(view(spark, sf_dir, "forms"), "form_id").withColumn("row_idx", F.col("form_id") * 100 + F.col("row_idx"))
    return totals.page_totals(cells.withColumn("bsid", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type"))))


@query(with_views("form_rows", "cells", "forms") + "SELECT session_id, page, size, CAST(sum(qty) AS BIGINT) AS pieces FROM cells JOIN forms USING (form_id) GROUP BY ALL")
def size_column_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.size_column_totals(view(spark, sf_dir, "cells").join(view(spark, sf_dir, "forms"), "form_id"))


_CALLS = "c AS (SELECT ts, event_type AS model, CASE WHEN user_id % 3 = 0 THEN 'batch' ELSE 'live' END AS mode, CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, CASE WHEN event_id % 17 = 0 THEN 'timeout' END AS error FROM events)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("ts", F.col("event_type").alias("model"), F.when(F.col("user_id") % 3 == 0, "batch").otherwise("live").alias("mode"), F.floor(F.col("value") * 10).alias("input_tokens"), F.floor("value").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), F.when(F.col("event_id") % 17 == 0, "timeout").alias("error"))


@query("WITH " + _CALLS + ", p AS (SELECT 'click' AS model, 3.0::DOUBLE AS p_in, 15.0::DOUBLE AS p_out UNION ALL SELECT 'view', 1.0, 5.0) SELECT model, mode, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum((input_tokens * p_in + output_tokens * p_out) / 1e6 * CASE WHEN mode = 'batch' THEN 0.5 ELSE 1.0 END), 6) AS cost, count(error) AS errors FROM c LEFT JOIN p USING (model) GROUP BY model, mode")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 1.0, 5.0)], "model string, p_in double, p_out double")
    return totals.usage_summary(totals.usage_cost(_calls(spark, sf_dir), prices)).withColumn("cost", F.round("cost", 6))


@query("WITH " + _CALLS + " SELECT date_trunc('day', ts) AS start, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(error) AS errors FROM c GROUP BY ALL")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_windows(_calls(spark, sf_dir))


@query("SELECT user_id AS image, event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'batch' ELSE 'live' END AS mode, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens, count(CASE WHEN event_id % 17 = 0 THEN 1 END) AS errors, CAST(sum(event_id % 7) AS DOUBLE) AS seconds, round(max(epoch_us(ts) / 1e6 + event_id % 7) - min(epoch_us(ts) / 1e6), 2) AS wall_seconds FROM events GROUP BY ALL")
def usage_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("user_id").alias("image"), F.col("event_type").alias("model"), F.when(k % 2 == 0, "batch").otherwise("live").alias("mode"), (k % 100).alias("input_tokens"), (k % 10).alias("output_tokens"), F.lit(0.0).alias("cost"), F.when(k % 17 == 0, "x").alias("error"), (k % 7).cast("double").alias("duration_seconds"))
    return totals.usage_by_image(calls).drop("cost").withColumn("wall_seconds", F.round("wall_seconds", 2))


@query("SELECT s_suppkey AS id, trim(s_name) AS name FROM supplier ORDER BY name, id")
def read_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_lookup(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", "s_name", by_name=True)


# orders

#: Cells of a submission, with every kind of problem among them.
_SUBMITTED = "s AS (SELECT o_custkey AS session_id, form_id * 100 + row_idx AS rsno, CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'none' ELSE upper(p_name) || '/' || CAST(100 + p_partkey % 40 AS VARCHAR(9)) || '/' || p_type END AS bsid, CASE WHEN p_partkey % 37 = 0 THEN '7' ELSE size END AS size, CASE WHEN p_partkey % 41 = 0 THEN -qty WHEN p_partkey % 43 = 0 THEN qty + 40000 WHEN p_partkey % 5 = 0 THEN 0 ELSE qty END AS qty FROM cells JOIN orders ON form_id = o_orderkey)"
_RESOLVED = "g AS (SELECT bsid, CAST(bsize AS VARCHAR(9)) AS size, max(detid) AS detid FROM catalog GROUP BY ALL), k AS (SELECT DISTINCT bsid AS known FROM g), r AS (SELECT session_id, rsno, s.bsid, s.size, qty, detid, CASE WHEN s.bsid IS NULL THEN 'unbound' WHEN known IS NULL THEN 'unknown_product' WHEN qty < 0 THEN 'negative_qty' WHEN qty > 32767 THEN 'qty_too_large' WHEN detid IS NULL THEN 'size_not_in_product' END AS problem FROM s LEFT JOIN k ON s.bsid = known LEFT JOIN g ON s.bsid = g.bsid AND s.size = g.size WHERE qty <> 0)"
_MERGED = "m AS (SELECT session_id, detid, min(rsno) AS rsno, arg_min(size, (rsno, size)) AS size, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS merged FROM r WHERE problem IS NULL GROUP BY ALL)"
_ORDERS = with_views("form_rows", "cells", "catalog", more=", ".join((_SUBMITTED, _RESOLVED, _MERGED)))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted = selected(spark, sf_dir, "SELECT * FROM s", "cells", "orders", more=_SUBMITTED)
    return orders.resolve_lines(submitted, orders.product_groups(view(spark, sf_dir, "catalog")))


@query(_ORDERS + "SELECT * FROM r")
def resolve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(_ORDERS + "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rsno, size, detid) AS sno FROM m")
def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.merge_lines(_resolved(spark, sf_dir))


@query(_ORDERS + "SELECT session_id, count(problem) AS problems, count(*) - count(problem) AS lines, CAST(coalesce(sum(CASE WHEN problem IS NULL THEN qty END), 0) AS BIGINT) AS total, count(problem) = 0 AND count(*) > count(problem) AS ok FROM r GROUP BY session_id")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.validate(_resolved(spark, sf_dir))


@query("SELECT o_orderkey AS session_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS order_no FROM orders WHERE o_orderkey % 9 <> 0")
def allocate_order_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("submitted_at"))
    return orders.allocate_order_no(orders.skip_submitted(headers, headers.where("session_id % 9 = 0")), 1000).select("session_id", "order_no")


@query(_ORDERS + "SELECT o_custkey AS session_id, c_name AS buyer, strftime(o, '%d/%m/%Y') AS order_dt, coalesce(lines, 0) AS lines, coalesce(total, 0) AS total FROM (SELECT o_custkey, min(o_orderdate) AS o FROM orders GROUP BY ALL) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT session_id, count(*) AS lines, CAST(sum(qty) AS BIGINT) AS total FROM m GROUP BY ALL) t ON o_custkey = session_id")
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = orders.merge_lines(_resolved(spark, sf_dir))
    master = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("session_id")).agg(F.min("o_orderdate").alias("order_dt")).withColumn("head_id", F.col("session_id"))
    buyers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("head_id"), F.col("c_name").alias("buyer"))
    return orders.order_summary(master, details, buyers)


# cleaning

@query("WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' IE' WHEN 1 THEN ' FCD' WHEN 2 THEN ' ' || 'RNS' ELSE '' END AS item, CASE WHEN p_partkey % 3 = 0 THEN 'RNS' ELSE '' END AS kind FROM part), x AS (SELECT *, regexp_extract(item, '^(.+?)\\s+([A-Z]{2,4})$', 1) AS n, regexp_extract(item, '^(.+?)\\s+([A-Z]{2,4})$', 2) AS c FROM p), y AS (SELECT *, c <> '' AND ((kind = '' AND c IN ('IE', 'OE', 'RN', 'RNS')) OR (kind <> '' AND c = kind)) AS b FROM x) SELECT p_partkey, CASE WHEN b THEN n ELSE item END AS item, CASE WHEN b THEN c ELSE kind END AS kind FROM y")
def split_style_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k, F.concat("p_name", F.when(k % 4 == 0, " IE").when(k % 4 == 1, " FCD").when(k % 4 == 2, " RNS").otherwise("")).alias("item"), F.when(k % 3 == 0, "RNS").otherwise("").alias("kind"))
    item, kind = text.split_style_code(F.col("item"), F.col("kind"))
    return part.select(k, item.alias("item"), kind.alias("kind"))


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, coalesce(last_value(CASE WHEN row_idx % 3 <> 2 THEN p_name END IGNORE NULLS) OVER (PARTITION BY form_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS item FROM cells")
def forward_fill_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").select("form_id", "row_idx", F.when(F.col("row_idx") % 3 != 2, F.col("p_name")).otherwise("").alias("item"))
    return rows.forward_fill_items(cells)


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CASE WHEN row_idx % 4 = 2 AND row_idx > 1 THEN lag(p_name) OVER w WHEN row_idx % 4 = 3 THEN regexp_replace(lag(p_name, 2) OVER w, '\\s*\\S+\\s*$', '') || ' plain' ELSE p_name END AS item FROM cells WINDOW w AS (PARTITION BY form_id ORDER BY row_idx)")
def expand_ditto(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row_idx")
    return rows.expand_ditto(view(spark, sf_dir, "cells").select("form_id", i, F.when(i % 4 == 2, "—\"").when(i % 4 == 3, "— \" plain").otherwise(F.col("p_name")).alias("item")))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'dated ' || strftime(o_orderdate, '%d/%m/%y') || ' (seen)' ELSE 'none' END AS t FROM orders"


@query(f"WITH d AS ({_DATES}), c AS (SELECT o_orderkey, CASE WHEN regexp_extract(t, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}') <> '' THEN regexp_extract(t, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}') ELSE t END AS cleaned FROM d) SELECT o_orderkey, cleaned, CAST(CASE WHEN regexp_matches(cleaned, '^\\d+/\\d+/\\d{{4}}$') THEN try_strptime(cleaned, '%d/%m/%Y') WHEN regexp_matches(cleaned, '^\\d+/\\d+/\\d{{2}}$') THEN try_strptime(cleaned[:6] || '20' || cleaned[7:], '%d/%m/%Y') ELSE try_strptime(cleaned, '%Y-%m-%d') END AS DATE) AS day FROM c")
def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(k % 4 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 2, F.concat(F.lit("dated "), F.date_format(d, "dd/MM/yy"), F.lit(" (seen)"))).otherwise("none")
    cleaned = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, text.clean_order_date(written).alias("cleaned"))
    return cleaned.withColumn("day", text.parse_date(F.col("cleaned")))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' & ' || c_mktsegment || ' (Co.)'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name FROM customer")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select("c_custkey", text.normalize_name(F.concat("c_name", F.lit(" & "), "c_mktsegment", F.lit(" (Co.)"))).alias("name"))


@query("WITH d AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS t FROM orders), w AS (SELECT o_orderkey, t, [CAST(t[:i] AS INT) || ',' || CAST(t[i + 1:] AS INT) FOR i IN range(1, len(t)) IF NOT starts_with(t, '0') AND t[i + 1] <> '0' AND CAST(t[:i] AS BIGINT) BETWEEN 1 AND 500 AND CAST(t[i + 1:] AS BIGINT) BETWEEN 1 AND 500] AS ways FROM d) SELECT o_orderkey, CASE WHEN len(ways) = 1 THEN ways[1] END AS split FROM w")
def split_merged_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.floor("o_totalprice").cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.array_join(text.split_merged_qty(digits).cast("array<string>"), ",").alias("split"))


# matching

@query(with_views("catalog", more="i AS (SELECT DISTINCT 'order ' || CAST(100 + c_custkey % 60 AS VARCHAR) || ' of 5' AS item FROM customer)") + "SELECT DISTINCT item, bname FROM i JOIN (SELECT DISTINCT bname FROM catalog) c ON contains(bname, item[7:9])")
def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("order "), (100 + F.col("c_custkey") % 60).cast("string"), F.lit(" of 5")).alias("item"))
    return matching.code_candidates(items, view(spark, sf_dir, "catalog"))


@query("WITH m AS (SELECT p_partkey, round(p_retailprice % 100, 1) AS score, p_partkey % 2 = 0 AS code_narrowed, p_partkey % 4 + 1 AS pool FROM part) SELECT *, score >= CASE WHEN code_narrowed AND pool = 1 THEN 35 WHEN code_narrowed AND pool <= 2 THEN 70 ELSE 95 END AS trusted, score >= 70 OR (code_narrowed AND pool = 1) AS shown FROM m")
def match_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return matching.match_trust(spark.read.parquet(f"{sf_dir}/part.parquet").select(k, F.round(F.col("p_retailprice") % 100, 1).alias("score"), (k % 2 == 0).alias("code_narrowed"), (k % 4 + 1).alias("pool")))


_SHIFT = "x AS (SELECT p_partkey, p_partkey % 12 + 1 AS a, p_partkey % 3 AS n, p_partkey % 7 + 3 AS lo, p_partkey % 7 + 3 + p_partkey % 5 AS hi FROM part)"


@query("WITH " + _SHIFT + ", o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o), f AS (SELECT p_partkey, count(*) AS n, min(o) AS o FROM x, o WHERE a + o >= greatest(1, lo) AND a + x.n + o <= least(15, hi) GROUP BY p_partkey) SELECT x.p_partkey, CASE WHEN f.n = 1 THEN CAST(f.o AS INT) END AS \"offset\" FROM x LEFT JOIN f USING (p_partkey)")
def shift_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    span = lambda a, b: F.transform(F.sequence(a, b), lambda i: i * 5 + 35)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", span(k % 12 + 1, k % 12 + 1 + k % 3).alias("sizes"), span(F.lit(1), F.lit(15)).alias("headers"), span(k % 7 + 3, k % 7 + 3 + k % 5).alias("catalog_sizes"))
    return matching.shift_offsets(part).select("p_partkey", "offset")


@query(with_views("form_rows", "cells") + "SELECT form_id, row_idx, CAST(CASE WHEN CAST(size AS INT) % 10 = 5 THEN CAST(size AS INT) ELSE CAST(size AS INT) + 10 * (form_id % 3 - 1) END AS VARCHAR) AS size, qty FROM cells WHERE CAST(size AS INT) % 10 = 5 OR CAST(size AS INT) + 10 * (form_id % 3 - 1) BETWEEN 10 AND 250")
def apply_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").select("form_id", "row_idx", "size", "qty", (F.col("form_id") % 3 - 1).cast("int").alias("offset"))
    headers = cells.select("form_id").distinct().select("form_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: (i * 10).cast("string"))).alias("pos", "size"))
    return matching.apply_offset(cells, headers)


# readings and flags

_READ = with_views("form_rows", "cells", more=f"b AS ({SECOND})")

#: Two readings of rows of several cells: of some rows one has no cell, of others one cell more; some values are one higher.
_TWO = """
    k AS (SELECT form_id, row_idx, size, qty, form_id * 7 + row_idx AS k, CAST(size AS INT) AS s FROM grid),
    one AS (SELECT form_id, row_idx, size, qty, k FROM k WHERE k % 19 <> 0),
    two AS (SELECT form_id, row_idx, size, CASE WHEN k % 5 < 2 AND s % 10 = 0 THEN qty + 1 ELSE qty END AS qty, k FROM k WHERE k % 17 <> 0 AND NOT (k % 7 = 0 AND s % 10 = 5)),
    total AS (
        SELECT form_id, row_idx, CASE WHEN k % 3 = 0 THEN sum(qty) WHEN k % 3 = 1 THEN sum(CASE WHEN k % 5 < 2 AND s % 10 = 0 THEN qty + 1 ELSE qty END) END AS total
        FROM k GROUP BY form_id, row_idx, k)"""


@query(with_views("form_rows", "grid", more=_TWO) + """,
    a AS (SELECT form_id, row_idx, sum(qty) AS sum_a, list(size ORDER BY size) AS keys, list(size || ':' || qty ORDER BY size) AS cells, max(CAST(size AS INT)) > 110 AS foreign_key FROM one GROUP BY ALL),
    b AS (SELECT form_id, row_idx, sum(qty) AS sum_b, list(size ORDER BY size) AS keys, list(size || ':' || qty ORDER BY size) AS cells FROM two GROUP BY ALL),
    j AS (
        SELECT form_id, row_idx, sum_a, sum_b, total, foreign_key,
               CASE WHEN sum_a IS NULL OR sum_b IS NULL OR foreign_key OR a.cells = b.cells THEN 'same' WHEN a.keys <> b.keys THEN 'sizes'
                    WHEN sum_a = total AND sum_b <> total THEN 'a' WHEN sum_b = total AND sum_a <> total THEN 'b' ELSE 'open' END AS kind
        FROM a FULL JOIN b USING (form_id, row_idx) LEFT JOIN total USING (form_id, row_idx))
SELECT form_id, row_idx, CAST(sum_a AS BIGINT) AS sum_a, CAST(sum_b AS BIGINT) AS sum_b, CAST(total AS BIGINT) AS total,
       CASE kind WHEN 'same' THEN 'ok' WHEN 'sizes' THEN 'unverified' WHEN 'open' THEN 'unresolved' ELSE 'resolved' END AS status,
       CASE WHEN kind = 'b' THEN 'second' ELSE 'first' END AS chosen
FROM j
""")
def reconcile_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cells that both readings and the totals stand on are made once
    grid = written(view(spark, sf_dir, "grid"), "grid")
    read = lambda name: spark.sql("WITH " + _TWO.replace("FROM grid", "FROM {grid}") + f" SELECT * FROM {name}", grid=grid)
    first = read("one")
    headers = first.select("form_id").distinct().select("form_id", F.explode(F.transform(F.sequence(F.lit(40), F.lit(110), F.lit(5)), lambda s: s.cast("string"))).alias("size"))
    return reconcile.reconcile_readings(first, read("two"), read("total"), headers)


@query(_READ + "SELECT form_id, count(*) AS rows, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM (SELECT coalesce(a.form_id, b.form_id) AS form_id, coalesce(a.row_idx, b.row_idx) AS row_idx, bool_and(a.qty IS NOT DISTINCT FROM b.qty) AS same FROM cells a FULL JOIN b ON a.form_id = b.form_id AND a.row_idx = b.row_idx AND a.size = b.size GROUP BY ALL) GROUP BY form_id")
def compare_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").select("form_id", "row_idx", "size", "qty")
    return reconcile.compare_readings(cells, second_reading(cells))


@query(_READ + "SELECT c.form_id, count(DISTINCT b.row_idx) AS marks, count(*) AS cells, count(DISTINCT b.row_idx) >= 0.6 * count(*) AS used FROM cells c LEFT JOIN b ON c.form_id = b.form_id AND c.row_idx = b.row_idx AND b.size NOT LIKE '%00' GROUP BY c.form_id")
def coverage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells").select("form_id", "row_idx", "size", "qty")
    return reconcile.coverage_guard(second_reading(cells).where("size not like '%00'"), cells)


@query(with_views("form_rows", more="f AS (SELECT form_id, row_idx % 2 AS row_idx, row_idx AS seq, CASE qty % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'unverified' WHEN 2 THEN 'resolved' ELSE 'unresolved' END AS status, CASE qty % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS sev, (qty % 5) * 45 AS size, CASE WHEN qty % 3 > 0 THEN 'note ' || qty % 3 END AS note FROM form_rows)") + "SELECT form_id, CAST(row_idx AS INT) AS row_idx, arg_min(status, (-sev, seq)) AS status, array_to_string(list_sort(list(DISTINCT size)), ',') AS sizes, coalesce(string_agg(note, ' | ' ORDER BY seq), '') AS note FROM f GROUP BY ALL")
def merge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qty")
    flags = view(spark, sf_dir, "form_rows").select("form_id", (F.col("row_idx") % 2).alias("row_idx"), F.col("row_idx").alias("seq"), F.when(q % 4 == 0, "ok").when(q % 4 == 1, "unverified").when(q % 4 == 2, "resolved").otherwise("unresolved").alias("status"), F.array((q % 5 * 45).cast("string")).alias("sizes"), F.when(q % 3 > 0, F.concat(F.lit("note "), (q % 3).cast("string"))).alias("note"))
    return reconcile.merge_flags(flags)


# templates

@query("SELECT o_orderkey, substr(sha256(trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) || '||' || '45|50|' || o_orderpriority), 1, 16) AS signature FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10 + 1")
def template_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey") == F.col("o_orderkey") % 10 + 1)
    return forms.select("o_orderkey", text.template_signature(F.col("s_name"), F.array(F.lit("45"), F.lit("50"), F.col("o_orderpriority"))).alias("signature"))


@query("SELECT o_orderpriority AS signature, count(*) AS occurrences, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1")
def template_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.template_seen(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("signature"), F.col("o_orderdate").alias("seen_at")))


@query("""
WITH e AS (SELECT user_id % 50 AS signature, event_type AS kind, 'x' AS trigger, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS value FROM events),
v AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY signature, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
c AS (SELECT *, sum(CASE WHEN value <> before THEN 1 ELSE 0 END) OVER (PARTITION BY signature, kind ORDER BY seq) AS epoch, CASE WHEN value IS NULL THEN before IS NOT NULL ELSE value IS DISTINCT FROM before END AS counts FROM v),
g AS (
    SELECT signature, kind, trigger, epoch, arg_max(value, seq) FILTER (value IS NOT NULL) AS value, sum(CASE WHEN value IS NULL AND before IS NOT NULL THEN 1 ELSE 0 END) AS confirmed,
           min(seq) FILTER (value IS NOT NULL) AS first, max(seq) FILTER (counts) AS last
    FROM c GROUP BY ALL)
SELECT signature, kind, trigger, arg_max(value, epoch) AS value, CAST(max(epoch) AS BIGINT) AS contradicted, CAST(arg_max(confirmed, epoch) AS BIGINT) AS confirmed, 'active' AS status, min(first) AS first_seen, max(last) AS last_confirmed
FROM g GROUP BY ALL HAVING arg_max(value, epoch) IS NOT NULL
""")
def fold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("signature"), F.col("event_type").alias("kind"), F.lit("x").alias("trigger"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 > 0, (F.floor("value") % 3).cast("string")).alias("value"))
    return templates.fold_rules(events)


@query("WITH r AS (SELECT o_custkey AS signature, o_orderstatus AS backend, count(*) AS uses, avg(o_totalprice) AS rate FROM orders GROUP BY ALL), n AS (SELECT *, row_number() OVER w AS n, lead(rate) OVER w AS nx FROM r WINDOW w AS (PARTITION BY signature ORDER BY rate, backend)) SELECT signature, backend, round(rate, 4) AS rate FROM n WHERE n = 1 AND nx > rate")
def preferred_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("signature"), F.col("o_orderstatus").alias("backend")).agg(F.count("*").alias("uses"), F.avg("o_totalprice").alias("rate"))
    return templates.preferred_backend(rates).withColumn("rate", F.round("rate", 4))


# the rest registers itself
from tallyloom.plans import column_queries, geometry_queries, markup_queries, match_queries, review_queries, workload_queries  # noqa: E402, F401
