import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import matching, orders, reconcile, rows

SF = "/root/testdata/sf0.001"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize("value, expected", [("3030", [30, 30]), ("530", [5, 30]), ("1010", [10, 10]), ("255", None), ("7", None)])
def test_split_merged_qty(spark, value, expected):
    assert one(spark, text.split_merged_qty(F.lit(value))) == expected


def test_split_style_code(spark):
    df = spark.createDataFrame([("Trend Trunk IE", ""), ("Image FCD", ""), ("RNS", None), ("Vest RN", "RN"), (None, None)], "i string, k string")
    item, kind = text.split_style_code(F.col("i"), F.col("k"))
    assert [tuple(r) for r in df.select(item, kind).collect()] == [("Trend Trunk", "IE"), ("Image FCD", ""), ("", "RNS"), ("Vest", "RN"), ("", "")]


def test_dates_names_numbers(spark):
    assert one(spark, text.clean_order_date(F.lit("30/13/26 (normalize: 30/01/2026)"))) == "30/13/26"
    assert one(spark, text.parse_date(F.lit("30/13/26"))) is None
    assert one(spark, text.parse_date(F.lit("5/3/26"))) == datetime.date(2026, 3, 5)
    assert one(spark, text.normalize_dmy(F.lit("5/3/26"))) == "05/03/2026"
    assert one(spark, text.normalize_name(F.lit("M. K. Enterprises"))) == one(spark, text.normalize_name(F.lit("M K ENTERPRISES")))
    assert one(spark, text.correct_lookalike_digits(F.lit("lO"))) == 10
    assert one(spark, text.plain_int(F.lit("③"))) == 3
    assert one(spark, text.repair_fused_headers(F.array(F.lit("45/18"), F.lit("x/2")))) == ["45", "x/2"]
    assert one(spark, text.template_signature(F.lit(" "), F.array(F.lit("45")))) is None


def test_ditto_and_fill(spark):
    df = spark.createDataFrame([(1, 1, "Fairlane Print"), (1, 2, "— \" — Plain"), (1, 3, "\" \""), (2, 1, ""), (2, 2, "A")], "form_id int, row_idx int, item string")
    got = {(r.form_id, r.row_idx): r.item for r in rows.expand_ditto(df).collect()}
    assert got == {(1, 1): "Fairlane Print", (1, 2): "Fairlane Plain", (1, 3): "Fairlane Plain", (2, 1): "", (2, 2): "A"}
    assert {(r.form_id, r.row_idx): r.item for r in rows.forward_fill_items(df).collect()}[(2, 1)] == ""


def test_shift(spark):
    df = spark.createDataFrame([(1, 1, list(range(50, 90, 5)), list(range(45, 100, 5)), list(range(55, 95, 5))), (1, 2, [], [1], [1])], "form_id int, row_idx int, sizes array<int>, headers array<int>, catalog_sizes array<int>")
    assert [r.offset for r in matching.shift_offsets(df).orderBy("row_idx").collect()] == [1, None]


def test_flags(spark):
    flags = spark.createDataFrame([(1, 1, 1, "unverified", ["50"], "a"), (1, 1, 2, "resolved", ["45"], ""), (1, 1, 3, "auto_corrected", ["50"], "b")], "form_id int, row_idx int, seq int, status string, sizes array<string>, note string")
    assert tuple(reconcile.merge_flags(flags).first()) == (1, 1, "resolved", "45,50", "a | b")


def test_lines(spark):
    groups = spark.createDataFrame([("p", "45", 7), ("p", "50", 7)], "bsid string, size string, detid int")
    cells = spark.createDataFrame([(1, 1, "p", "45", 3), (1, 2, "p", "50", 4), (1, 3, None, "45", 1), (1, 4, "q", "45", 1), (1, 5, "p", "60", 1), (1, 6, "p", "45", -1), (1, 7, "p", "45", 40000), (1, 8, "p", "45", 0)], "session_id int, rsno int, bsid string, size string, qty int")
    lines = orders.resolve_lines(cells, groups)
    assert {r.rsno: r.problem for r in lines.collect()} == {1: None, 2: None, 3: "unbound", 4: "unknown_product", 5: "size_not_in_product", 6: "negative_qty", 7: "qty_too_large"}
    merged = orders.merge_lines(lines).collect()
    assert [(r.detid, r.rsno, r["size"], r.qty, r.merged, r.sno) for r in merged] == [(7, 1, "45", 7, 2, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_query_matches_its_sql(spark):
    import duckdb

    from tallyloom.plans import registry

    c = duckdb.connect()
    for t in ("part", "customer", "nation", "supplier", "lineitem", "orders", "events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names), name
        expected = sorted(tuple(show(r[names.index(k)]) for k in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(show(r[k]) for k in sorted(names)) for r in df.collect()) == expected, name


def test_numbered_wide_rows(spark):
    """Numbers have no gap and no repeat where rows have further columns and lie in several ranges."""
    from pyspark.sql import functions as F

    from tallyloom.operators import orders

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60000).select(F.xxhash64("id").alias("submitted_at"), F.col("id").alias("session_id"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("more"))
        got = orders.allocate_order_no(rows, 5).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert [r.order_no for r in sorted(got, key=lambda r: (r.submitted_at, r.session_id))] == list(range(6, 60006))


def test_code_narrowing_keeps_unmatched_items(spark):
    from tallyloom.operators import matching

    items = spark.createDataFrame([("shirt 123",), ("shirt 999 888",), ("shirt",), ("coat 45612",)], "item string")
    catalog = spark.createDataFrame([("A 1234",), ("B 91239",), ("C 45612",), ("C 45612",)], "bname string")
    got = {r["item"]: (r.code_narrowed, r.pool, r.unmatched_code) for r in matching.code_narrowing(items, catalog).collect()}
    assert got == {"shirt 123": (True, 2, ""), "shirt 999 888": (False, 3, "999"), "shirt": (False, 3, ""), "coat 45612": (True, 1, "")}
    trusted = matching.match_trust(matching.code_narrowing(items, catalog).selectExpr("item", "40 score", "code_narrowed", "pool"))
    assert [r["item"] for r in trusted.where("trusted").collect()] == ["coat 45612"]
