"""Queries of rows and columns found on a page, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import geometry
from tallyloom.plans.registry import query
from tallyloom.plans.views import selected, view, with_views

_BOX = "CAST({x} - 10 AS DOUBLE) AS x0, CAST({y} - 10 AS DOUBLE) AS y0, CAST({x} + 10 AS DOUBLE) AS x1, CAST({y} + 10 AS DOUBLE) AS y1, 0.9e0 AS score"


def _token(token: str, text: str, x: str, y: str) -> str:
    return f"SELECT form_id, row_idx, CAST({token} AS INT) AS token_id, CAST({text} AS VARCHAR(9)) AS text, " + _BOX.format(x=x, y=y)


#: Two headers, a label behind them in the first row, its quantity below, and numbers in its column in every third row further down.
_BEHIND = " UNION ALL ".join((
    _token("0", "'45'", "100", "100") + " FROM form_rows WHERE row_idx = 1", _token("1", "'50'", "140", "100") + " FROM form_rows WHERE row_idx = 1",
    _token("2", "CASE WHEN l_partkey % 2 = 0 THEN '110' ELSE '111' END", "180", "300") + " FROM form_rows WHERE row_idx = 1", _token("3", "qty", "181", "320") + " FROM form_rows WHERE row_idx = 1",
    _token("100 + row_idx", "qty", "183", "200 + 100 * row_idx") + " FROM form_rows WHERE row_idx > 1 AND l_partkey % 3 = 0",
))


@query(with_views("form_rows", more="n AS (SELECT form_id, 1 + count_if(row_idx > 1 AND l_partkey % 3 = 0) AS near, count(*) AS n, max(CASE WHEN row_idx = 1 THEN l_partkey END) AS label FROM form_rows GROUP BY form_id)") + """
SELECT form_id, CASE WHEN row_idx = 1 THEN 3 ELSE 100 + row_idx END AS token_id, qty, '110' AS size FROM form_rows JOIN n USING (form_id)
WHERE label % 2 = 0 AND near * 2 <= n AND (row_idx = 1 OR l_partkey % 3 = 0)
""")
def overflow_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "form_rows")
    tokens = selected(spark, sf_dir, _BEHIND, "form_rows")
    headers = rows.select("form_id", F.explode(F.array(F.lit("45"), F.lit("50"))).alias("size")).distinct()
    located = geometry.locate_headers(tokens, headers)
    centres = rows.select("form_id", "row_idx", (F.lit(200.0) + F.col("row_idx") * 100).alias("y"))
    bands = geometry.header_bands(located)
    catalog = view(spark, sf_dir, "catalog").select(F.col("bsize").alias("size"))
    new, added = geometry.overflow_columns(tokens, bands, located, catalog, centres, geometry.candidate_marks(tokens, bands))
    return added.join(new.select("form_id", "size"), "form_id").select("form_id", "token_id", "qty", "size")


_CENTRES = "SELECT form_id, row_idx, CASE WHEN l_partkey % 3 = 0 THEN 0.9e0 ELSE row_idx / 20e0 END AS center, (4 + l_partkey % 4) / 200e0 AS half, CASE WHEN l_partkey % 11 = 0 THEN row_idx / 10e0 END AS name_y FROM form_rows"


@query(with_views("form_rows", more=f"""c AS ({_CENTRES}),
t AS (SELECT *, coalesce(lag(center) OVER w = center, false) OR coalesce(lead(center) OVER w = center, false) AS tied FROM c WINDOW w AS (PARTITION BY form_id ORDER BY row_idx)),
m AS (SELECT form_id, list_sort(list(half) FILTER (WHERE NOT tied)) AS hs FROM t GROUP BY form_id),
w AS (SELECT *, CASE WHEN tied THEN hs[len(hs) // 2 + 1] ELSE half END AS w FROM t JOIN m USING (form_id)),
s AS (SELECT *, 0.1 + 0.8 * (sum(w) OVER (PARTITION BY form_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY form_id) AS share FROM w)""")
    + "SELECT form_id, row_idx, round(CASE WHEN name_y IS NOT NULL THEN name_y WHEN tied AND len(hs) >= 3 THEN share ELSE center END, 6) AS center FROM s")
def recover_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selected(spark, sf_dir, _CENTRES, "form_rows").withColumns({"top": F.lit(0.0), "bottom": F.col("half") * 2})
    tables = rows.select("form_id", F.lit(0.1).alias("top_frac"), F.lit(0.9).alias("bottom_frac")).distinct()
    return geometry.recover_centres(rows, tables).select("form_id", "row_idx", F.round("center", 6).alias("center"))


@query(with_views("form_rows") + "SELECT form_id, row_idx, CASE WHEN row_idx % 5 <> 4 THEN row_idx END AS cluster FROM form_rows")
def assign_clusters_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row has neither a total nor marks; all others have their total."""
    at, rows = F.col("row_idx"), view(spark, sf_dir, "form_rows")
    clusters = rows.where(at % 5 != 4).select("form_id", at.alias("cluster"), at.cast("double").alias("y"), "qty")
    given, empty = geometry.assign_clusters_to_rows(clusters, rows.select("form_id", "row_idx", (at + 0.4).alias("y"), F.when(at % 5 != 4, F.col("qty")).alias("total")))
    return given.select("form_id", "row_idx", "cluster").unionByName(empty, allowMissingColumns=True)


def _drifting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks that drift to the right by up to 12 pixels."""
    grid, size = view(spark, sf_dir, "grid"), F.col("size").cast("int")
    marks = grid.select("form_id", "row_idx", (size * 8 + F.col("form_id") % 3 * (F.col("row_idx") - 1)).cast("double").alias("x"), "qty")
    located = grid.select("form_id", "size", (size * 8).cast("double").alias("x")).distinct()
    return marks, located, grid.select("form_id", "row_idx", ((F.col("row_idx") - 1) / 10).alias("y")).distinct()


@query(with_views("form_rows") + "SELECT form_id, CAST(form_id % 3 * 10 AS DOUBLE) AS a FROM form_rows GROUP BY form_id HAVING count(*) >= 3")
def calibrate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    drift = geometry.calibrate_drift(*_drifting(spark, sf_dir))
    return drift.select("form_id", (F.round("a", 4) + 0.0).alias("a"))


@query(with_views("form_rows", "grid") + "SELECT form_id, row_idx, size, qty FROM grid")
def assign_with_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.assign_with_drift(*_drifting(spark, sf_dir)).select("form_id", "row_idx", "size", "qty")


#: In each row a letter above a quantity; in the first one a number behind the columns, with or without a quantity; in others such a quantity alone.
_STACKED = " UNION ALL ".join((
    _token("0", "'xl'", "100", "20") + " FROM form_rows", _token("1", "qty", "104", "40") + " FROM form_rows",
    _token("2", "'110'", "170", "20") + " FROM form_rows WHERE row_idx = 1", _token("3", "qty + 1", "165", "40") + " FROM form_rows WHERE l_partkey % 2 = 0",
))


@query(with_views("form_rows") + """
SELECT form_id, row_idx, 'XL' AS size, qty FROM form_rows UNION ALL
SELECT form_id, row_idx, '110', qty + 1 FROM form_rows WHERE l_partkey % 2 = 0 AND form_id IN (SELECT form_id FROM form_rows WHERE row_idx = 1 AND l_partkey % 2 = 0)
""")
def stacked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = selected(spark, sf_dir, _STACKED, "form_rows")
    bounds = view(spark, sf_dir, "form_rows").select("form_id", F.lit(0.0).alias("floor"), F.lit(140.0).alias("cutoff"), F.lit(40.0).alias("spacing")).distinct()
    return geometry.stacked_labels(tokens, bounds)


@query(with_views("form_rows", "grid", more="""
a AS (SELECT form_id, size FROM grid WHERE row_idx = 2),
b AS (SELECT g.form_id, min(CASE WHEN a.size IS NULL THEN row_idx END) AS bad, max(row_idx) + 1 AS beyond FROM grid g LEFT JOIN a ON a.form_id = g.form_id AND a.size = g.size WHERE row_idx >= 2 GROUP BY g.form_id)""")
    + "SELECT form_id, row_idx, 'L' || size AS size, qty FROM grid JOIN b USING (form_id) WHERE row_idx >= 2 AND row_idx < coalesce(bad, beyond) AND coalesce(bad, beyond) >= 4")
def share_letter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, x = view(spark, sf_dir, "grid"), (F.col("size").cast("int") * 8).cast("double")
    letters = grid.where("row_idx = 2").select("form_id", F.col("row_idx").alias("anchor_row"), F.concat(F.lit("L"), "size").alias("letter"), x.alias("x"))
    return geometry.share_letter_columns(grid.select("form_id", "row_idx", (x + 3).alias("x"), "qty"), letters, 16.0)


@query(with_views("form_rows", "grid") + "SELECT DISTINCT form_id, size, CAST(8 * CAST(size AS INT) AS DOUBLE) AS x FROM grid WHERE form_id % 3 <> 1")
def recover_headers_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No header is read right; every third form has a second line below the first, and every third lacks a number."""
    size = F.col("size").cast("int")
    headers = view(spark, sf_dir, "grid").select("form_id", size.alias("pos"), "size").distinct()
    line = lambda y: headers.select("form_id", (size + y).cast("int").alias("token_id"), F.lit("1").alias("text"), (size * 8 - 10.0).alias("x0"), F.lit(y + 0.0).alias("y0"), (size * 8 + 10.0).alias("x1"), F.lit(y + 20.0).alias("y1"), F.lit(0.9).alias("score"))
    first = line(100).join(headers.groupBy("form_id").agg(F.min("pos").alias("_least")), "form_id").where("form_id % 3 <> 1 or token_id - 100 <> _least").drop("_least")
    bottoms = headers.select("form_id", F.lit(200.0).alias("bottom")).distinct()
    return geometry.recover_headers_by_order(first.unionByName(line(130).where("form_id % 3 = 0")), headers, bottoms)
