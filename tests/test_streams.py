import datetime
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.templates import correction_rate, fold_rules
from tallyloom.sources.order_store import publish, read_published
from tallyloom.sources.tables import read_lookup
from tallyloom.streaming.memory import MEMORY, memory_events, stream_template_memory
from tallyloom.streaming.submissions import once_per_session, publish_submissions, stream_orders
from tallyloom.streaming.usage import usage_sessions, usage_windows

DAY = datetime.datetime(2026, 1, 1)


def fed(spark, tmp_path, schema, batches, job, mode):
    """What a job makes of batches of rows, each a file of a stream."""
    folder, name = tmp_path / "in", f"out{random.randrange(10 ** 9)}"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r, default=str) for r in rows))
        os.utime(folder / f"{i}.json", (1_750_000_000 + i, 1_750_000_000 + i))  # files come in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    sink = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    sink.awaitTermination(120)
    rows = [tuple(r) for r in spark.table(name).collect()]
    spark.catalog.dropTempView(name)
    return rows


EVENTS = "signature string, kind string, trigger string, at timestamp, value string"


@pytest.mark.parametrize("ordered", [True, False])
def test_memory_as_a_stream(spark, tmp_path, ordered):
    """Rules, rates and occurrences as the batch folds them, over a restart after each two batches, begun from what was known before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(3)
    event = lambda i: {"signature": f"s{r.randrange(2)}", "kind": "k", "trigger": f"t{r.randrange(3)}", "at": DAY + datetime.timedelta(minutes=i // 2), "value": r.choice([None, None, "a", "b"])}
    page = lambda i: {"signature": f"s{r.randrange(2)}", "kind": r.choice(["backend", "model"]), "trigger": r.choice("pq"), "at": DAY + datetime.timedelta(minutes=i // 2), "value": str(r.randrange(5) / 4)}
    events = [r.choice([event, event, page])(i) for i in range(200)] + [{"signature": "s0", "kind": "k", "trigger": "only confirmed", "at": DAY, "value": None}]
    before, rest = events[:60], events[60:]
    last = {"signature": "end", "kind": "k", "trigger": "", "at": DAY + datetime.timedelta(days=2), "value": "x"}
    batches = [rest[:60], rest[60:100], rest[100:], [last], [{**last, "at": DAY + datetime.timedelta(days=4)}]]
    if not ordered:
        r.shuffle(rest)  # within the hour that the watermark allows, an event may come in any batch
        batches[:3] = [rest[:50], rest[50:70], rest[70:]]

    def folded(rows):
        df = spark.createDataFrame(rows, EVENTS)
        rules = {(x.signature, x.kind, x.trigger): (x.value, x.contradicted, x.confirmed, x.first_seen, x.last_confirmed) for x in fold_rules(df.where("kind = 'k'")).collect()}
        rates = {(x.signature, x.kind, x.trigger): (x.uses, round(x.rate, 6)) for x in df.where("kind <> 'k'").groupBy("signature", "kind", "trigger").agg(F.count("*").alias("uses"), F.avg(F.col("value").cast("double")).alias("rate")).collect()}
        return rules, rates

    rules, rates = folded(before)
    at = {(e["signature"], e["kind"], e["trigger"]): e["at"] for e in before}
    known = [(*k, *v, 0, None) for k, v in rules.items()] + [(*k, None, 0, 0, at[k], at[k], *v) for k, v in rates.items()]
    known = spark.createDataFrame(known, MEMORY)
    (tmp_path / "in").mkdir()
    got = {}
    for n, rows in enumerate(batches):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(e, default=str) for e in rows))
        os.utime(tmp_path / f"in/{n}.json", (1_750_000_000 + n, 1_750_000_000 + n))
        if n % 2 or n == len(batches) - 1:
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

            def take(batch, _):
                for x in batch.collect():
                    got[x.signature, x.kind, x.trigger] = x

            stream_template_memory(stream, known, "3 hours").writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    rules, rates = folded(events)
    untouched = {(x.signature, x.kind, x.trigger): x for x in known.collect()}
    got = {**untouched, **got}
    assert {k: tuple(x)[3:8] for k, x in got.items() if k[1] == "k" and k[0] != "end"} == rules
    assert {k: (x.uses, round(x.rate, 6)) for k, x in got.items() if k[1] != "k"} == rates


def test_events_of_pages(spark):
    pages = spark.createDataFrame([("s", DAY, "p", None, 1, 4), ("s", DAY, "p", "m", 0, 0), (None, DAY, "p", "m", 1, 1)], "signature string, at timestamp, backend string, model string, corrected int, rows int")
    got = sorted((r.kind, r.trigger, r.value) for r in memory_events(spark.createDataFrame([], EVENTS), pages).collect())
    assert got == [("backend", "p", "0.25"), ("page", "", None), ("page", "", None)]


def test_orders_as_a_stream(spark, tmp_path):
    """Sessions are published once, numbered without gaps, whatever batch they come with, over a batch that fails between its tables, one that is replayed and a second writer."""
    groups = spark.createDataFrame([("b1", "45", 7), ("b1", "50", 8), ("b2", "45", 9)], "bsid string, size string, detid int")
    schema = "session_id string, submitted_at timestamp, head_id int, user_id int, ref_no string, order_dt date, ref_dt date, company_id int, order_source string, rows array<struct<bsid:string,item:string,quantities:map<string,int>>>"
    row = lambda bsid, **q: {"bsid": bsid, "item": "i", "quantities": {k[1:]: v for k, v in q.items()}}
    order = lambda s, h, *rows, **more: {"session_id": s, "submitted_at": DAY + datetime.timedelta(hours=h), "head_id": 5, "user_id": 6, "ref_no": " 007 ", "order_dt": "2026-01-03", "rows": list(rows), **more}
    path, store = tmp_path / "in", str(tmp_path / "store")
    path.mkdir()

    def put(n, *orders):
        (path / f"{n}.json").write_text("\n".join(json.dumps(o, default=str) for o in orders))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
        stream_orders(stream, groups, store, "007", str(tmp_path / "c"), availableNow=True).awaitTermination(300)

    put(0, order("x", 2, row("b1", _45=1, _50=2), row("b1", _45=3), row(None)), order("y", 1, row("b2", _45=4)), order("y", 3, row("b2", _45=40)), order("bad", 1, row("b2", _45=1, _95=1, _100=2), row("zz", _45=1)), order("none", 1, row("b1", _45=0), head_id=None))
    run()
    master = lambda: sorted((r.order_no, r.session_id, r.ref_no, str(r.order_dt), r.batch) for r in read_published(spark, store, "master").collect())
    assert master() == [(1, "y", "007", "2026-01-03", "007-0"), (2, "x", "007", "2026-01-03", "007-0")]
    assert sorted(tuple(r) for r in read_published(spark, store, "details").select("order_no", "det_id", "qty", "rsno", "sno").collect()) == [(1, 9, 4, 1, 1), (2, 7, 4, 1, 1), (2, 8, 2, 1, 2)]
    assert {r.session_id: r.problems for r in read_published(spark, store, "rejected").collect()} == {"bad": ["row 1 size_not_in_product 95,100", "row 2 unknown_product"], "none": ["buyer", "quantities"]}
    assert publish_submissions(spark.read.schema(schema).json(str(path)), groups, store, "007-0") is False  # the batch again
    put(1, order("x", 9, row("b1", _45=9)), order("z", 9, row("b2", _45=1)))
    run()
    assert [m[:2] for m in master()] == [(1, "y"), (2, "x"), (3, "z")]

    def broken(last):
        return {"master": spark.createDataFrame([(last + 1, "w")], "order_no int, session_id string"), "details": spark.range(1).select(F.raise_error(F.lit("lost")).alias("order_no"))}

    with pytest.raises(Exception, match="lost"):
        publish(spark, store, "b", broken)
    assert len(master()) == 3
    new = lambda s: spark.createDataFrame([], schema).unionByName(spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(order(s, 20, row("b2", _45=2)), default=str)])))
    with ThreadPoolExecutor(2) as pool:
        assert [*pool.map(lambda s: publish_submissions(new(s), groups, store, f"of {s}"), ("v", "w"))] == [True, True]
    assert [m[0] for m in master()] == [1, 2, 3, 4, 5] and {m[1] for m in master()[3:]} == {"v", "w"}


def test_failed_batches_are_not_opened(spark, tmp_path):
    """What a batch that failed has left, of other types or broken, is in no one's way; a table that a batch has not is empty there."""
    store = str(tmp_path / "store")
    table = lambda n: spark.createDataFrame([(n, f"s{n}")], "order_no long, session_id string")
    for name in ("b-0", "b-z"):
        spark.createDataFrame([(7, 7)], "order_no int, session_id int").write.parquet(f"{store}/master/folder={name}")
    (tmp_path / "store/master/folder=b-00").mkdir()
    (tmp_path / "store/master/folder=b-00/part.parquet").write_text("cut short")
    assert publish(spark, store, "x", lambda last: {"master": table(last + 1), "rejected": table(0)})
    assert publish(spark, store, "y", lambda last: {"master": table(last + 1)})
    assert sorted(tuple(r) for r in read_published(spark, store, "master").collect()) == [(1, "s1", "x"), (2, "s2", "y")]
    assert [tuple(r) for r in read_published(spark, store, "rejected").collect()] == [(0, "s0", "x")]


def test_usage_as_a_stream(spark, tmp_path):
    at = lambda h: (DAY + datetime.timedelta(hours=h)).isoformat()
    call = lambda h, e=None: {"ts": at(h), "model": "m", "image": "i", "input_tokens": 2, "error": e}
    schema = "ts timestamp, model string, image string, input_tokens long, error string"
    # the call at 3 comes after its day has ended: rows are late by the watermark that the batch before began with
    batches = [[call(1), call(2, "late")], [call(30)], [call(31)], [call(3)], [call(80)], [call(81)]]
    (tmp_path / "a").mkdir()
    got = fed(spark, tmp_path / "a", schema, batches, usage_windows, "append")
    assert got == [(DAY, "m", 2, 4, 1), (DAY + datetime.timedelta(days=1), "m", 2, 4, 0)]
    (tmp_path / "b").mkdir()
    got = fed(spark, tmp_path / "b", schema, batches[:3] + batches[4:], lambda s: usage_sessions(s, "2 hours"), "append")
    assert sorted(got) == [("i", DAY + datetime.timedelta(hours=1), 2, 4), ("i", DAY + datetime.timedelta(hours=30), 2, 4)]


def test_sessions_once_and_rates(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    row = lambda s, h, n: {"session_id": s, "submitted_at": (DAY + datetime.timedelta(hours=h)).isoformat(), "n": n}
    got = fed(spark, tmp_path / "a", "session_id string, submitted_at timestamp, n int", [[row("x", 1, 1), row("y", 1, 2)], [row("x", 2, 3), row("z", 2, 4)]], once_per_session, "append")
    assert sorted((g[0], g[2]) for g in got) == [("x", 1), ("y", 2), ("z", 4)]
    page = lambda b, c, n: {"signature": "s", "backend": b, "corrected": c, "rows": n}
    got = fed(spark, tmp_path / "b", "signature string, backend string, corrected int, rows int", [[page("p", 1, 2), page("q", 0, 0)], [page("p", 4, 4), page("q", 1, 4)]], correction_rate, "complete")
    assert sorted(got) == [("s", "p", 2, 0.75), ("s", "q", 1, 0.25)]


def test_lookup(spark):
    df = spark.createDataFrame([(2, " b "), (1, None), (3, "a"), (4, "")], "id int, name string")
    assert [tuple(r) for r in read_lookup(df, "id", "name", by_name=True).collect()] == [(1, ""), (4, ""), (3, "a"), (2, "b")]
    assert [r.id for r in read_lookup(df, "id", "name").collect()] == [1, 2, 3, 4]
    assert read_lookup(df.where(F.lit(False)), "id", "name").count() == 0
