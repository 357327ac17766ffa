"""Stand-ins for a shop's tables over the synthetic star schema, as Spark views and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Both engines run these texts.
SQL = {
    "catalog": "SELECT p_partkey % 997 AS bid, upper(p_name) || ' ' || CAST(100 + p_partkey % 40 AS VARCHAR(9)) AS bname, p_type AS bstyle, p_size * 5 AS bsize, p_partkey AS detid, upper(p_name) || '/' || CAST(100 + p_partkey % 40 AS VARCHAR(9)) || '/' || p_type AS bsid, CASE WHEN p_partkey % 10 <> 0 THEN 1 ELSE 0 END AS isprimary, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS isunused FROM part",
    "buyers": "SELECT c_custkey AS head_id, c_name AS name, n_name AS city, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS is_active FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "form_rows": "SELECT l_orderkey AS form_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS row_idx, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS qty, l_returnflag, l_linestatus, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem",
    "cells": "SELECT form_id, row_idx, CAST(p_size * 5 AS VARCHAR(9)) AS size, qty, p_partkey, p_name, p_type, l_returnflag, l_linestatus FROM form_rows JOIN part ON l_partkey = p_partkey",
    "grid": "SELECT form_id, row_idx, CAST(40 + 5 * ((l_partkey + n) % 16) AS VARCHAR(9)) AS size, CAST((qty + n * 7) % 30 AS INT) AS qty, l_partkey FROM form_rows, (VALUES (0), (1), (2), (3), (4), (5)) AS t(n) WHERE n < 3 + l_partkey % 4",
    "tokens": """SELECT DISTINCT form_id, CAST(size AS INT) AS token_id, size AS text, CAST(8 * CAST(size AS INT) - 10 AS DOUBLE) AS x0, 90e0 AS y0, CAST(8 * CAST(size AS INT) + 10 AS DOUBLE) AS x1, 110e0 AS y1, CASE WHEN (form_id + CAST(size AS INT)) % 4 = 0 THEN 0.4e0 ELSE 0.9e0 END AS score FROM grid
UNION ALL SELECT form_id, row_idx * 1000 + CAST(size AS INT), CASE WHEN (l_partkey + qty) % 9 = 0 THEN '-' WHEN (l_partkey + qty) % 23 = 0 THEN size ELSE CAST(qty AS VARCHAR(9)) END, CAST(8 * CAST(size AS INT) - 10 + (form_id + row_idx) % 7 - 3 AS DOUBLE), CAST(120 + 30 * row_idx AS DOUBLE), CAST(8 * CAST(size AS INT) + 10 + (form_id + row_idx) % 7 - 3 AS DOUBLE), CAST(140 + 30 * row_idx + l_partkey % 5 AS DOUBLE), CASE (l_partkey + qty) % 7 WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.4e0 ELSE 0.9e0 END FROM grid
UNION ALL SELECT form_id, row_idx * 1000 + 999, 'b-' || CAST(1000 + l_partkey % 5 AS VARCHAR(9)), 10e0, CAST(120 + 30 * row_idx AS DOUBLE), 90e0, CAST(140 + 30 * row_idx AS DOUBLE), 0.9e0 FROM form_rows""",
    "forms": "SELECT o_orderkey AS form_id, o_custkey AS session_id, c_name AS party_name, o_orderdate, o_orderstatus, o_orderpriority, CAST(o_orderkey % 5 AS INT) AS page FROM orders JOIN customer ON o_custkey = c_custkey",
}


#: What each stands on.
NEEDS = {"catalog": ("part",), "buyers": ("customer", "nation"), "form_rows": ("lineitem",), "cells": ("form_rows", "part"), "grid": ("form_rows",), "tokens": ("grid", "form_rows"), "forms": ("orders", "customer")}


def selected(spark: SparkSession, sf_dir: str, text: str, *names: str, more: str = "") -> DataFrame:
    """A query over stand-ins and tables by name. They are named within the query alone: no view of the session is made or replaced."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        parts.setdefault(name, SQL.get(name) or f"SELECT * FROM parquet.`{sf_dir}/{name}.parquet`")

    for name in names:
        add(name)
    return spark.sql("WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + (", " + more if more else "") + " " + text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return selected(spark, sf_dir, f"SELECT * FROM {name}", name)


def second_reading(cells: DataFrame) -> DataFrame:
    """A second reading of cells: every seventh row read one higher, every eleventh with another size, every thirteenth not at all."""
    k = F.col("form_id") * 7 + F.col("row_idx")
    return cells.where(k % 13 != 0).withColumn("qty", F.when(k % 7 == 0, F.col("qty") + 1).otherwise(F.col("qty"))).withColumn("size", F.when(k % 11 == 0, F.concat("size", F.lit("0"))).otherwise(F.col("size")))


SECOND = "SELECT form_id, row_idx, CASE WHEN (form_id * 7 + row_idx) % 11 = 0 THEN size || '0' ELSE size END AS size, CASE WHEN (form_id * 7 + row_idx) % 7 = 0 THEN qty + 1 ELSE qty END AS qty FROM cells WHERE (form_id * 7 + row_idx) % 13 <> 0"


def with_views(*names: str, more: str = "") -> str:
    """The head of a DuckDB query over stand-ins."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " + more if more else "") + "\n"
