import itertools
import random

import pytest

from tallyloom.operators import geometry

TOKENS = "form_id int, token_id int, text string, x0 double, y0 double, x1 double, y1 double, score double"


def box(form, token, text, x, y, score=0.9, w=20, h=20):
    return (form, token, text, x - w / 2, y - h / 2, x + w / 2, y + h / 2, score)


def test_overflow_columns(spark):
    rows = [box(1, 1, "45", 100, 100), box(1, 2, "50", 140, 100)]
    rows += [box(1, 10, "110", 180, 150), box(1, 11, "7", 182, 170), box(1, 12, "4", 181, 230), box(1, 13, "O9", 178, 290), box(1, 14, "8", 184, 293), box(1, 15, "600", 180, 330), box(1, 16, "5", 181, 350, 0.4)]
    rows += [box(2, 1, "45", 100, 100), box(2, 2, "50", 140, 100)] + [box(2, 10 + i, "110", 180, 150 + 20 * i) for i in range(4)]  # a column that all rows have
    rows += [box(3, 1, "45", 100, 100), box(3, 2, "50", 140, 100), box(3, 3, "111", 180, 150), box(3, 4, "7", 180, 170)]  # no size of the catalog
    tokens = spark.createDataFrame(rows, TOKENS)
    headers = spark.createDataFrame([(f, s) for f in (1, 2, 3) for s in ("45", "50")], "form_id int, size string")
    located = geometry.locate_headers(tokens, headers)
    bands = geometry.header_bands(located)
    centres = spark.createDataFrame([(f, r, 160.0 + 60 * r) for f in (1, 2, 3) for r in range(12)], "form_id int, row_idx int, y double")
    dense = centres.where("form_id <> 2").unionByName(spark.createDataFrame([(2, r, 150.0 + 20 * r) for r in range(4)], centres.schema))
    marks = spark.createDataFrame([(1, 99, 100.0, 230.0)], "form_id int, token_id int, x double, y double")
    sizes = spark.createDataFrame([(110,), (110,), (45,)], "size int")
    new, added = geometry.overflow_columns(tokens, bands, located, sizes, dense, marks)
    assert [tuple(r) for r in new.collect()] == [(1, "110", 180.0, 160.0)]
    # 14 lies beside 13, 15 is too many
    assert sorted((r.token_id, r.qty) for r in added.collect()) == [(11, 7), (12, 4), (13, 9)]


def test_centres(spark):
    rows = [(1, i, 0.1 + 0.1 * i, 0.05 + 0.1 * i, 0.15 + 0.1 * i, None) for i in range(4)] + [(1, i, 0.98, 0.97, 0.99, 0.77 if i == 5 else None) for i in (4, 5, 6)]
    rows += [(2, i, 0.5, 0.4, 0.6, None) for i in range(3)]  # none can be trusted
    tables = spark.createDataFrame([(1, 0.05, 0.75), (2, 0.0, 1.0)], "form_id int, top_frac double, bottom_frac double")
    got = geometry.recover_centres(spark.createDataFrame(rows, "form_id int, row_idx int, center double, top double, bottom double, name_y double"), tables)
    want = [0.1, 0.2, 0.3, 0.4, 0.5, 0.77, 0.7, 0.5, 0.5, 0.5]
    assert [r.center for r in got.orderBy("form_id", "row_idx").collect()] == pytest.approx(want)


def test_clusters_of_marks_go_to_rows(spark):
    r = random.Random(7)
    clusters, rows, want = [], [], {}
    for form in range(40):
        items = [(form, i, i + r.random() / 2, r.choice([None, 1, 2, 3, 4])) for i in range(6)]
        marks = [(form, i, y, r.randint(1, 4)) for i, y in enumerate(sorted(r.uniform(0, 6) for _ in range(r.randint(1, 5))))]
        blank = sum(i[3] is None for i in items)
        void = {i[1] for i in items if i[3] is None and blank < 3}
        cost = lambda m, i: (-int(i[3] == m[3]), int(i[1] in void), abs(m[2] - i[2]))  # noqa: B023, E731
        ways = [tuple(map(sum, zip(*(cost(m, items[j]) for m, j in zip(marks, c))))) for c in itertools.combinations(range(6), len(marks))]
        want[form] = (min(ways), items, marks, void)
        clusters += marks
        rows += items
    clusters.append((99, 0, 1.0, 1))
    given, empty = geometry.assign_clusters_to_rows(spark.createDataFrame(clusters, "form_id int, cluster int, y double, qty int"), spark.createDataFrame(rows, "form_id int, row_idx int, y double, total int"))
    got = {f: {} for f in want}
    for g in given.collect():
        got[g.form_id][g.cluster] = g.row_idx
    none = {f: set() for f in want}
    for e in empty.collect():
        none[e.form_id].add(e.row_idx)
    for form, (best, items, marks, void) in want.items():
        at = [got[form][m[1]] for m in marks]
        assert at == sorted(set(at)) and none[form] == void - set(at)
        costs = [(-int(items[j][3] == m[3]), int(j in void), abs(m[2] - items[j][2])) for m, j in zip(marks, at)]
        assert tuple(map(sum, zip(*costs))) == pytest.approx(best)


def test_drift(spark):
    located = spark.createDataFrame([(f, str(s), 40.0 * i) for f in (1, 2) for i, s in enumerate((45, 50, 55, 60))], "form_id int, size string, x double")
    # marks drift by 40 pixels over the height: the lowest rows lie nearer to the next header
    marks = [(1, r, 40.0 * i + 4 * r, 10 * r + i) for r in range(8) for i in (0, 2)] + [(2, 0, 1.0, 5)]
    rows = spark.createDataFrame([(1, r, r / 10) for r in range(8)] + [(2, 0, 0.5)], "form_id int, row_idx int, y double")
    df = spark.createDataFrame(marks, "form_id int, row_idx int, x double, qty int")
    drift = geometry.calibrate_drift(df, located, rows).collect()
    assert len(drift) == 1 and drift[0].form_id == 1 and drift[0].a == pytest.approx(40) and drift[0].b == pytest.approx(0)
    got = {(g.form_id, g.row_idx, g.x): (g["size"], g.qty) for g in geometry.assign_with_drift(df, located, rows).collect()}
    assert got == {(f, r, x): ("45" if q % 10 == 0 or f == 2 else "55", q) for f, r, x, q in marks}


def test_stacked_labels(spark):
    # columns end at 140, a spacing is 40
    rows = [(1, 0, i, *t) for i, t in enumerate([("110", 170, 10), ("7", 171, 30), ("XL", 100, 10), ("5", 102, 30), ("4", 101, 50), ("9", 60, 30), ("S", 20, 10)])]
    rows += [(1, 1, i, *t) for i, t in enumerate([("6", 168, 110), ("3", 100, 110)])] + [(1, 2, i, *t) for i, t in enumerate([("2", 150, 210), ("901", 170, 210)])] + [(1, 3, 0, "8", 170, 310)]
    df = spark.createDataFrame([(f, r, t, text, float(x - 10), float(y), float(x + 10), float(y + 15), 0.9) for f, r, t, text, x, y in rows] + [(1, 3, 1, "1", 165.0, 330.0, 175.0, 340.0, 0.2)], "form_id int, row_idx int, token_id int, text string, x0 double, y0 double, x1 double, y1 double, score double")
    bounds = spark.createDataFrame([(1, 0.0, 140.0, 40.0), (2, 0.0, 1.0, 1.0)], "form_id int, floor double, cutoff double, spacing double")
    assert sorted(tuple(r)[1:] for r in geometry.stacked_labels(df, bounds).collect()) == [(0, "110", 7), (0, "XL", 5), (1, "110", 6), (3, "110", 8)]


def test_letter_columns_are_shared(spark):
    letters = [(1, 2, "S", 100.0), (1, 2, "M", 140.0), (2, 1, "S", 100.0), (1, 5, "L", 140.0)]
    marks = [(1, 1, 100.0, 9), (1, 2, 101.0, 1), (1, 2, 141.0, 2), (1, 3, 99.0, 3), (1, 3, 103.0, 4), (1, 4, 100.0, 5), (1, 4, 180.0, 6), (1, 5, 140.0, 7), (1, 6, 140.0, 8), (1, 8, 140.0, 9), (2, 1, 100.0, 1), (2, 3, 100.0, 1)]
    got = geometry.share_letter_columns(spark.createDataFrame(marks, "form_id int, row_idx int, x double, qty int"), spark.createDataFrame(letters, "form_id int, anchor_row int, letter string, x double"), 10.0)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "M", 2), (1, 2, "S", 1), (1, 3, "S", 4), (1, 5, "L", 7), (1, 6, "L", 8)]


def test_headers_by_order(spark):
    rows = [box(1, i, t, 100 + 40 * i, 100 + i) for i, t in enumerate(["45", "80", "80"])] + [box(1, 9 + i, t, 100 + 40 * i, 130) for i, t in enumerate(["7", "8", "9"])]
    rows += [box(2, i, t, 200 - 40 * i, 100) for i, t in enumerate(["1", "2", "3"])] + [box(2, 7, "4567", 10, 100), box(2, 8, "5", 10, 190)] + [box(3, 0, "1", 10, 100)]
    headers = spark.createDataFrame([(f, p, s) for f in (1, 2, 3) for p, s in enumerate(["45", "50", "55"])], "form_id int, pos int, size string")
    bottoms = spark.createDataFrame([(f, 145.0) for f in (1, 2, 3)], "form_id int, bottom double")
    got = geometry.recover_headers_by_order(spark.createDataFrame(rows, TOKENS), headers, bottoms)
    assert sorted(map(tuple, got.collect())) == [(1, "45", 100.0), (1, "50", 140.0), (1, "55", 180.0), (2, "45", 120.0), (2, "50", 160.0), (2, "55", 200.0)]


def _long_page(spark):
    """Marks of 22 rows that drift by 2 pixels a row, so that the lowest lie within 12 pixels of the next header; of a second form, two rows are unsure between others."""
    located = spark.createDataFrame([(f, str(45 + 5 * i), 40.0 * i) for f in (1, 2) for i in range(7)], "form_id int, size string, x double")
    marks = [(1, r, 40.0 * i + 2 * r, 10 * r + i) for r in range(22) for i in (r % 3, r % 3 + 2)] + [(2, r, 80.0 + r + (17 if r in (3, 4) else 0), 10 * r + 2) for r in range(8)]
    rows = [(f, r, r / 10) for f, n in ((1, 22), (2, 8)) for r in range(n)]
    return spark.createDataFrame(marks, "form_id int, row_idx int, x double, qty int"), located, spark.createDataFrame(rows, "form_id int, row_idx int, y double")


def test_drift_past_the_next_header(spark):
    drift = {d.form_id: (d.a, d.b) for d in geometry.calibrate_drift(*_long_page(spark)).collect()}
    assert drift == {1: pytest.approx((20, 0)), 2: pytest.approx((10, 0))}


def test_marks_that_drift_past_the_next_header(spark):
    marks, located, rows = _long_page(spark)
    got = {(g.form_id, g.row_idx, g.qty): g["size"] for g in geometry.assign_with_drift(marks, located, rows).collect()}
    assert got == {(m.form_id, m.row_idx, m.qty): str(45 + 5 * (m.qty % 10)) for m in marks.collect()}
