import datetime
import json
import random
import time

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import fuzzy, matching, reconcile, review, templates
from tallyloom.plans import registry
from tallyloom.sources import files
from tallyloom.streaming.submissions import once_per_session


def common(a, b):
    """Longest common subsequence by the plain table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def plain_ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def test_scores(spark):
    r = random.Random(3)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randint(0, 12))), "".join(r.choice("abc ") for _ in range(r.randint(0, 12)))) for _ in range(200)] + [(None, "a"), ("fainlady plain", "fainladi plain")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", fuzzy.ratio("a", "b").alias("r"), fuzzy.partial_ratio("a", "b").alias("p")).collect():
        if x.a is None:
            assert x.r is None
            continue
        assert abs(x.r - plain_ratio(x.a, x.b)) < 1e-9
        short, long = sorted((x.a, x.b), key=len)
        windows = [w for i in range(len(long)) for w in (long[i : i + len(short)], long[: i + 1][-len(short) or None :] if short else "")]
        best = max((plain_ratio(short, w) for w in windows), default=100.0 if not long else 0.0) if short else (0.0 if long else 100.0)
        assert abs(x.p - best) < 1e-9
    one = spark.createDataFrame([("b 4749 full pant", "b 4749 full pant set")], "a string, b string").select(fuzzy.weighted_ratio("a", "b").alias("w"), fuzzy.token_set_ratio("a", "b").alias("t")).first()
    assert (one.w, one.t) == (95.0, 100.0)


def test_rules(spark):
    rows = spark.createDataFrame([(1, 1, "t", "Fainladi Plain"), (1, 2, "t", "Other"), (1, 3, "u", "Fainladi Plain"), (1, 4, None, None)], "form_id int, row_idx int, signature string, item string")
    rules = spark.createDataFrame([("t", "Fainlady Plain", "Fairlady Plain"), ("t", "Zainlady Plain", "Other one")], "signature string, trigger string, corrected string")
    got = {r.row_idx: (r["item"], r.fired) for r in templates.apply_rules(rows, rules).collect()}
    assert got == {1: ("Fairlady Plain", "Fainlady Plain"), 2: ("Other", None), 3: ("Fainladi Plain", None), 4: (None, None)}


def test_catalog_checks(spark):
    sizes = F.array(*map(F.lit, range(35, 60, 5)))
    df = spark.range(1).select(*(matching.resolve_letter_size(F.lit(x), sizes).alias(x) for x in ("S", "m", "L", "XL", "XXL", "Q")))
    assert tuple(df.first()) == (35, 40, 45, 50, 55, None)
    df = spark.range(1).select(matching.sizes_outside_catalog(F.array(F.lit("100"), F.lit("95"), F.lit("XL")), F.array(F.lit("45"))).alias("x"))
    assert df.first().x == ["95", "100"]
    df = spark.createDataFrame([(list(range(50, 90, 5)), list(range(50, 100, 5)), list(range(55, 95, 5)))], "sizes array<int>, headers array<int>, catalog_sizes array<int>")
    assert matching.detect_column_shift(df).first().offset == 1


def test_texts(spark):
    cell = spark.range(1).select(text.parse_cell(F.lit("100"), F.lit("105 10")).alias("a"), text.parse_cell(F.lit("100"), F.lit("-")).alias("b"), text.strip_markup(F.lit("<td>[Signature]</td>")).alias("c"), text.strip_markup(F.lit("a<br/>b &amp;  c")).alias("d")).first()
    assert (tuple(cell.a), cell.b, cell.c, cell.d) == (("105", 10), None, "", "a b & c")


def test_struck_and_clusters(spark):
    rows = spark.createDataFrame([(1, 1, True, 2), (1, 2, True, 0), (1, 3, False, 2)], "form_id int, row_idx int, struck_out boolean, marks int")
    assert [tuple(r) for r in reconcile.struck_out_conflict(rows).collect()] == [(1, 1, "unresolved")]
    marks = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.11), (1, 3, 0.3), (2, 1, 0.5)], "form_id int, token_id int, y double")
    assert sorted((r.form_id, r.token_id, r.cluster) for r in review.cluster_rows(marks, 0.05).collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0)]


def test_files(spark, tmp_path):
    (tmp_path / "old.csv").write_text("timestamp_utc,image,model,mode,input_tokens,cache_read_tokens,cache_write_tokens,output_tokens,estimated_cost_usd\n2026-01-01T00:00:00Z,a,m,live,5,,,7,0.5\n")
    (tmp_path / "new.csv").write_text("timestamp_utc,image,model,mode,input_tokens,cache_read_tokens,cache_write_tokens,output_tokens,estimated_cost_usd,duration_seconds,error\n2026-01-02T00:00:00Z,b,m,live,5,1,1,7,,2.5,late\n")
    got = files.read_usage_log(spark, str(tmp_path / "old.csv"), str(tmp_path / "new.csv")).orderBy("image").collect()
    assert [(r.image, r.input_tokens, r.cache_read_tokens, r.duration_seconds, r.error) for r in got] == [("a", 5, None, None, None), ("b", 5, 1, 2.5, "late")]
    cells = spark.createDataFrame([(1, 2, "B", "50", 4), (1, 1, "A", "45", 3), (1, 1, "A", "50", 2)], "form_id int, row_idx int, item string, size string, qty int")
    files.write_order_forms(cells, str(tmp_path / "forms"))
    item = lambda name, **q: {"item": name, "type": "", "quantities": {k[1:]: v for k, v in q.items()}}
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "forms")).collect()] == [{"form_id": 1, "party_name": "", "order_no": "", "order_date": "", "items": [item("A", _45=3, _50=2), item("B", _50=4)]}]


def test_submissions_once(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], "session_id string, submitted_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, submitted_at timestamp").parquet(str(tmp_path / "in"))
    q = once_per_session(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(60)
    assert sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_edits_against_the_table_of_distances():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert review._edits(a, b) == table(a, b)
    words = [r.choice("abcdefgh") for _ in range(100_000)]
    other = words[:500] + words[501:70_000] + ["x"] + words[70_000:]
    began = time.time()
    assert review._edits(words, other) == 2 and time.time() - began < 60


def test_two_readings_are_merged_once(spark):
    """Flags and sums stand on the same merged rows: what is merged is not worked out for either."""
    plan = registry.queries()["readings_to_flags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan
