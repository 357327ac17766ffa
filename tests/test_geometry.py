import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import geometry
from tallyloom.plans import registry, views

TOKENS = "form_id int, token_id int, text string, x0 double, y0 double, x1 double, y1 double, score double"


def box(form, token, text, x, y, score=0.9, w=20, h=20):
    return (form, token, text, x - w / 2, y - h / 2, x + w / 2, y + h / 2, score)


def test_headers_and_decoys(spark):
    sizes = ["45", "50", "55", "60"]
    rows = [box(1, i, s, 100 + 40 * i, 100) for i, s in enumerate(sizes)] + [box(1, 9, "45", 100, 300)]
    rows += [box(1, 10 + i, str(14 + i), 100 + 40 * i, 120) for i in range(4)]  # a line of labels
    rows += [box(1, 20, "7", 101, 150), box(1, 21, "3030", 160, 150), box(1, 22, "O8", 220, 150), box(1, 23, "5", 185, 150, 0.3), box(1, 24, "6", 141, 155, 0.4), box(1, 25, "9", 400, 150), box(1, 26, "60", 221, 180)]
    rows += [box(2, 1, "45", 100, 100), box(2, 2, "50", 140, 100, 0.2)]  # half of its headers
    tokens = spark.createDataFrame(rows, TOKENS)
    headers = spark.createDataFrame([(f, s) for f in (1, 2) for s in sizes], "form_id int, size string")
    located = geometry.locate_headers(tokens, headers)
    assert sorted(map(tuple, located.collect())) == [(1, s, 100.0 + 40 * i, 90.0, 110.0) for i, s in enumerate(sizes)]
    bands = geometry.skip_decoy_bands(tokens, geometry.header_bands(located))
    b = bands.first()
    assert (b.spacing, b.floor, b.ceiling, b.bottom) == (40.0, 76.0, 244.0, 130.0)
    marks = geometry.candidate_marks(tokens, bands)
    got = sorted((m.token_id, m.part, m.qty, m.x) for m in marks.collect())
    assert got == [(9, 0, 45, 100.0), (20, 0, 7, 101.0), (21, 0, 30, 155.0), (21, 1, 30, 165.0), (22, 0, 8, 220.0), (26, 0, 60, 221.0)]
    assert sorted({m.token_id for m in geometry.drop_label_duplicates(marks, located).collect()}) == [20, 21, 22]
    # 24 lies 14 pixels from the left part of 21, 23 lies 20 from its right part
    assert [r.token_id for r in geometry.low_confidence_worklist(tokens, bands, marks).collect()] == [23]
    dash = tokens.unionByName(spark.createDataFrame([box(1, 30, "-", 187, 200, 0.4)], TOKENS))
    assert geometry.low_confidence_worklist(dash, bands, marks).count() == 0


def test_marks_in_order_at_least_cost(spark):
    r = random.Random(4)
    heads = sorted(r.sample(range(0, 400, 10), 6))
    marks, want = [], {}
    for row in range(60):
        xs = sorted(r.sample(range(-20, 420), r.randint(1, 7)))
        marks += [(1, row, float(x), i) for i, x in enumerate(xs)]
        ways = [(sum(abs(x - heads[j]) for x, j in zip(xs, c)), c) for c in itertools.combinations(range(6), len(xs))]
        spacing = (heads[-1] - heads[0]) / 5
        if ways and min(ways)[0] / len(xs) <= 0.6 * spacing:
            want[row] = min(ways)[0]
    located = spark.createDataFrame([(1, str(h), float(h)) for h in heads], "form_id int, size string, x double")
    got = {}
    for m in geometry.assign_marks_to_headers(spark.createDataFrame(marks, "form_id int, row_idx int, x double, qty int"), located).orderBy("row_idx", "x").collect():
        got.setdefault(m.row_idx, []).append((m.x, int(m["size"])))
    assert got.keys() == want.keys()
    for row, cells in got.items():
        sizes = [s for _, s in cells]
        assert sizes == sorted(set(sizes)) and abs(sum(abs(x - s) for x, s in cells) - want[row]) < 1e-9


def test_names_letters_and_tables(spark):
    df = spark.range(1).select(*(geometry.name_matches(F.lit(a), F.lit(b)).alias(str(i)) for i, (a, b) in enumerate([("", "LOOPER"), ("MM K4532", "Looper zb"), ("the looper", "Looper zb"), ("x", "F.G-3005")])))
    assert tuple(df.first()) == (True, False, True, True)
    columns = spark.createDataFrame([(1, 1, float(x)) for x in range(0, 200, 40)] + [(2, 1, 0.0), (3, 1, 0.0)], "form_id int, group_id int, x double")
    anchors = spark.createDataFrame([(1, 1, "XL", 121.0), (2, 1, "S", 90.0), (3, 1, "Q", 0.0)], "form_id int, group_id int, letter string, x double")
    got = geometry.infer_letter_columns(columns, anchors, 15.0).orderBy("x").collect()
    assert [(g.form_id, g.letter) for g in got] == [(1, "S"), (1, "M"), (1, "L"), (1, "XL"), (1, "XXL")]
    two = anchors.unionByName(spark.createDataFrame([(1, 1, "XXL", 80.0)], anchors.schema))
    assert geometry.infer_letter_columns(columns, two, 15.0).count() == 0
    rows = spark.createDataFrame([("PANT", "pant", '12. CREED B4756'), (" ", None, "x"), ("Creed", "Pant", "3. y"), (None, "", " ")], "item string, kind string, label string")
    assert [r["item"] for r in geometry.fill_collapsed_names(rows).collect()] == ["CREED B4756", "x", "Creed", None]
    cells = spark.createDataFrame([(1, 0, "Party"), (1, 1, "45 cm"), (1, 1, "50"), (1, 2, "45"), (1, 2, "50"), (2, 0, None)], "form_id int, table_idx int, cell string")
    headers = spark.createDataFrame([(1, "45"), (1, "50")], "form_id int, size string")
    assert sorted(map(tuple, geometry.pick_item_table(cells, headers).collect())) == [(1, 1, 2), (2, 0, 0)]


def test_least_sums_in_order_of_many_tables():
    r = np.random.default_rng(4)
    for rows, columns in ((1, 1), (1, 4), (3, 3), (3, 6), (4, 7)):
        first, second = r.integers(0, 3, (40, rows, columns)), r.integers(0, 4, (40, rows, columns)).astype(float)
        at, sums = geometry.least_in_order(first, second)
        for k in range(40):
            wanted = min((sum(first[k, i, j] for i, j in enumerate(c)), sum(second[k, i, j] for i, j in enumerate(c)), c) for c in itertools.combinations(range(columns), rows))
            assert (sums[0][k], sums[1][k]) == wanted[:2]
            assert sum(first[k, i, j] for i, j in enumerate(at[k])) == wanted[0] and sum(second[k, i, j] for i, j in enumerate(at[k])) == wanted[1] and (np.diff(at[k]) > 0).all()


def test_fused_headers_are_taken_apart(spark):
    """Only in the header row, only where one cut is possible, and beside what was found by itself."""
    sizes = ["95", "100", "105", "110", "115"]
    token = lambda f, i, t, x0, y0, x1: (f, i, t, float(x0), float(y0), float(x1), float(y0 + 20), 0.9)
    rows = [token(1, 1, "95", 0, 90, 20), token(1, 2, "100105", 30, 92, 90), token(1, 3, "110115", 100, 300, 160), token(1, 4, "110", 100, 90, 120)]
    rows += [token(2, 1, "12", 0, 0, 10), token(2, 2, "1212121212121212", 20, 0, 180), token(2, 3, "121", 200, 0, 230)]
    tokens = spark.createDataFrame(rows, "form_id int, token_id int, text string, x0 double, y0 double, x1 double, y1 double, score double")
    headers = spark.createDataFrame([(1, s) for s in sizes] + [(2, "12"), (2, "14")], "form_id int, size string")
    got = {(r.form_id, r["size"]): r.x for r in geometry.locate_headers(tokens, headers, 0.4).collect()}
    assert got == {(1, "95"): 10.0, (1, "100"): 45.0, (1, "105"): 75.0, (1, "110"): 110.0, (2, "12"): 5.0}


def test_merged_headers_of_any_length(spark):
    cut = lambda t, *h: spark.range(1).select(text.split_merged_headers(F.lit(t), F.array(*map(F.lit, h))).alias("x")).first().x
    assert cut("1212121212121212", "12", "14") == ["12"] * 8
    assert cut("1234567", *"1234567") == list("1234567")
    assert cut("1234567", *"1234567", "12") is None and cut("123", "12", "12", "3") == ["12", "3"] and cut("124", "12", "") is None
    assert cut("x12", "x", "12") is None and cut("45", "45", "4", "5") is None


def test_tokens_are_those_of_the_stand_in(spark):
    from tallyloom.plans import geometry_queries

    made, view = geometry_queries._tokens(spark, "/root/testdata/sf0.001"), views.view(spark, "/root/testdata/sf0.001", "tokens")
    view = view.select(*made.columns)
    assert made.exceptAll(view).count() == 0 and view.exceptAll(made).count() == 0


@pytest.mark.parametrize("name", ["locate_headers", "candidate_marks", "locate_fused_headers", "assign_marks_to_headers", "low_confidence_worklist", "drop_label_duplicates", "item_name_y", "skip_decoy_bands"])
def test_forms_are_dealt_by_form_alone(spark, name):
    """What stands on the tokens of forms is dealt by form, not once more by form and size or row."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.fullmatch(r"(form_id|l_orderkey)#\d+L?, \d+", d) for d in dealt)
