import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import files
from tallyloom.streaming.forms import checked_rows, stream_form_files, stream_forms


def test_images_and_markup(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.JPG", "x.png", "p#1.jpeg", "notes.txt", "a+b.bmp"):
        (tmp_path / name).write_bytes(b"12")
    assert sorted((r.name, r.length) for r in files.list_images(spark, str(tmp_path)).collect()) == [("a_b", 2), ("p_1", 2), ("x", 2), ("x (2)", 2)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/page 1.html").write_text("<p>a\nb</p>")
    assert [tuple(r) for r in files.read_page_markup(spark, str(tmp_path / "m")).collect()] == [("page 1", "<p>a\nb</p>")]


def test_forms_and_what_stands_beside_them(spark, tmp_path):
    items = [{"item": "A", "type": "", "quantities": {"45": 3}}, {"item": "B", "type": "x", "quantities": {}}]
    (tmp_path / "f.1.json").write_text(json.dumps({"party_name": "P", "items": items}))
    (tmp_path / "f.1.raw.json").write_text(json.dumps({"items": [{"row_total": "1 2", "struck_out": True}]}))
    (tmp_path / "f.1.recount_flags.json").write_text(json.dumps([None, {"status": "unresolved", "note": "n"}]))
    (tmp_path / "f.1.brandlist.json").write_text("{broken")
    (tmp_path / "g.json").write_text("{}")
    (tmp_path / "alone.raw.json").write_text("{}")
    forms = files.read_form_json(spark, str(tmp_path))
    assert sorted((r.form_id, r.brandlist, r.party_check) for r in forms.collect()) == [("f.1", None, None), ("g", None, None)]
    rows = [tuple(r) for r in files.form_rows(forms).orderBy("row_idx").drop("quantities").collect()]
    assert rows == [("f.1", 0, "A", "", None, None, None, None, 12, True), ("f.1", 1, "B", "x", "unresolved", "n", None, None, None, False)]


def test_orders_are_published_whole(spark, tmp_path):
    path = str(tmp_path)
    master, details = spark.createDataFrame([(1, "a")], "order_no int, party string"), spark.createDataFrame([(1, 7, 2)], "order_no int, det_id int, qty int")
    with pytest.raises(ValueError):
        files.write_orders(master, details.union(details), path, "x")
    assert files.published(spark, path).isEmpty()
    assert files.write_orders(master, details, path, "x") and not files.write_orders(master, details, path, "x")
    master.withColumn("order_no", F.lit(9)).write.parquet(f"{path}/master/folder=b-y")  # a writer that was lost before it had published
    assert [r.order_no for r in files.read_orders(spark, path, "master").collect()] == [1] and files.read_orders(spark, path, "details").count() == 1
    assert files.write_orders(master, details, path, "007") and sorted(r.batch for r in files.read_orders(spark, path, "master").collect()) == ["007", "x"]


def test_usage_and_audit(spark, tmp_path):
    at = datetime.datetime(2026, 1, 2, 3)
    calls = spark.createDataFrame([(at, "i", "m", "live", 1, None, None, 2, None, 0.5, "late")], files._USAGE + ", duration_seconds double, error string")
    for _ in range(2):
        files.append_usage(calls, str(tmp_path / "u"))
    assert [(r.image, r.cache_read_tokens, r.error) for r in files.read_usage_log(spark, None, str(tmp_path / "u")).collect()] == [("i", None, "late")] * 2
    files.write_audit(spark.createDataFrame([(5, "s", at, {"a": 1}, {"a": 2}, 1)], "order_no int, session string, submitted_at timestamp, extracted map<string,int>, submitted map<string,int>, detail_rows int"), str(tmp_path / "audit"))
    got = spark.read.json(str(tmp_path / "audit")).first()
    assert (got.order_no, got.extracted.a, got.submitted.a, str(got.day)) == (5, 1, 2, "2026-01-02")


def test_forms_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    form = {"form_id": "f", "order_date": "1/2/2026", "items": [{"item": "fainlady  PLAIN", "type": "", "quantities": {"45": 3, "50": 0}}, {"item": "Q", "quantities": {"45": 1}}]}
    (tmp_path / "in/1.json").write_text(json.dumps(form) + "\n{broken\n")
    catalog = spark.createDataFrame([("Fainlady Plain",), ("Fainlady Plain",)], "bname string")

    def run():
        cells = stream_forms(spark, str(tmp_path / "in"), catalog)
        cells.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)
        return sorted((r.form_id, r.row_idx, r["size"], r.qty, r.in_catalog) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want = [("f", 0, "45", 3, True), ("f", 1, "45", 1, False)]
    assert run() == want
    (tmp_path / "in/2.json").write_text(json.dumps({**form, "form_id": "g"}))
    assert run() == want + [("g", *w[1:]) for w in want]


def test_forms_whose_files_come_apart(spark, tmp_path):
    """Late, missing and corrupt files of a form: the row waits for the first, and the others say nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, began = tmp_path / "in", 1_750_000_000
    folder.mkdir()
    catalog = spark.createDataFrame([("Vest Plain",)], "bname string")

    def put(name, value, minute):
        (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
        os.utime(folder / name, (began + 60 * minute, began + 60 * minute))

    def run():
        rows = checked_rows(stream_form_files(spark, str(folder)), catalog)
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(200)
        return sorted(((r.form_id, r.row_idx, r.item, [tuple(q) for q in r.quantities or []], r.total, r.in_catalog, r.status, r.note) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)

    item = lambda name, **q: {"item": name, "quantities": [{"size": s[1:], "quantity": n} for s, n in q.items()]}
    put("a.1.json", {"items": [item("VEST-plain", _45=3, _50=0), item("Odd", _45=2)]}, 0)
    put("a.1.raw.json", {"items": [{"row_total": "4", "struck_out": False}, {"row_total": "", "struck_out": True}]}, 1)
    put("b.json", {"items": [item("vest plain", _45=1)]}, 0)
    put("b.brandlist.json", "{broken", 1)
    put("c.json", "no json", 0)
    put("alone.raw.json", {"items": []}, 0)
    run()  # nothing may be missing yet
    put("a.1.recount_flags.json", [None, {"status": "unresolved", "note": "n"}], 5)
    run()
    put("z.json", {"items": []}, 60)
    run()
    put("zz.json", {"items": []}, 120)
    put("b.raw.json", {"items": [{"row_total": "9"}]}, 8)  # an hour after its form
    got = [r for r in run() if r[0] < "z"]
    assert got == [
        ("a.1", 0, "VEST-plain", [("45", 3)], 4, True, "unverified", None), ("a.1", 1, "Odd", [], None, False, "unresolved", "n"),
        ("b", 0, "vest plain", [("45", 1)], None, True, "ok", None), ("c", None, None, [], None, False, "no_items", None),
    ]


def test_review_and_order_files(spark, tmp_path):
    rows = [("f", "P", None, "1/2/2026", "B", "x", "100", 3, "n", 1, 0), ("f", "P", None, "1/2/2026", "B", "x", "95", 2, "n", 1, 1), ("f", "P", None, "1/2/2026", "A", "", None, None, "n", 2, 0)]
    df = spark.createDataFrame(rows, "source_file string, party_name string, order_no string, order_date string, item string, type string, size string, quantity int, notes string, row_idx int, pos int")
    files.write_review(df.orderBy(F.desc("pos")), str(tmp_path / "r"))
    lines = [line for f in sorted((tmp_path / "r").glob("*.csv")) for line in f.read_text().splitlines()]
    assert lines == ["source_file,party_name,order_no,order_date,item,type,size,quantity,notes", "f,P,,1/2/2026,B,x,100,3,n", "f,P,,1/2/2026,B,x,95,2,n", "f,P,,1/2/2026,A,,,,n"]
    cells = spark.createDataFrame([("f", 2, "A", "IE", "45", 1, 0), ("f", 1, "B", None, "50", 7, 0), ("f", 1, "B", None, "50", 5, 1)], "form_id string, row_idx int, item string, kind string, size string, qty int, pos int")
    heads = spark.createDataFrame([("f", "P", "", "30/03/2026"), ("g", None, "7", None)], "form_id string, party_name string, order_no string, order_date string")
    files.write_order_forms(cells, str(tmp_path / "o"), heads)
    got = sorted((json.loads(line) for f in (tmp_path / "o").glob("*.json") for line in f.read_text().splitlines()), key=lambda d: d["form_id"])
    assert got == [
        {"form_id": "f", "party_name": "P", "order_no": "", "order_date": "30/03/2026", "items": [{"item": "B", "type": "", "quantities": {"50": 5}}, {"item": "A", "type": "IE", "quantities": {"45": 1}}]},
        {"form_id": "g", "party_name": "", "order_no": "7", "order_date": "", "items": []},
    ]
