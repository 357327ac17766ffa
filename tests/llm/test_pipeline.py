"""The pipeline's stages against plain versions of what each should have done with its input."""

import hashlib
import os
import re

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    import corpus_pipeline
    from tallyloom.llm import mixing, toxicity
    from tallyloom.llm._shared import written

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {"": docs}, docs.columns
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last = kept[name] = written(stage(spark, last, SF), "test")
        assert last.columns == columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = {k: df.collect() for k, df in kept.items()}
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in rows["toxicity"]} == {i for i, p in predicted.items() if not p}
    first = {}
    for r in sorted(rows["toxicity"]):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in rows["exact dedup"]} == {*first.values()}
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").lower().split())
    sets = {r.doc_id: shingles(r.text) for r in rows["exact dedup"]}
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    stay = {r.doc_id for r in rows["simhash near-dedup"]}
    for i in sets.keys() - stay:
        assert any(near(i, j) > 0.55 for j in sets if j != i)
    assert not [(i, j) for i in stay for j in stay if i < j and len(sets[i]) > 20 and near(i, j) >= 0.9]
    epochs = {r.doc_id: r.epochs for r in mixing.mix(kept["simhash near-dedup"]).collect()}
    assert sorted(r.doc_id for r in rows["mixing"]) == sorted(i for i, n in epochs.items() for _ in range(n))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in rows["mixing"]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(rows["mixing"])
    assert all((r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_near_stage_keeps_one_of_each_group(spark):
    """Groups of the shingle sets with a similarity of 0.8 or more, by brute force: of each the smallest doc_id stays, and all else goes."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null")
    docs = dict(corpus_pipeline.STAGES)["exact dedup"](spark, docs, SF)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {r.doc_id: shingles((r.text or "").lower().split()) for r in docs.collect()}
    holds, root = {}, {i: i for i in sets}
    for i in sorted(sets):
        for s in sets[i]:
            holds.setdefault(s, []).append(i)
    for i, j in {(i, j) for ids in holds.values() for i in ids for j in ids if i < j}:
        if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = {k: a if x == b else x for k, x in root.items()}
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, SF).collect()) == sorted({*root.values()})


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, own_id string, fp string, node string"


def test_stages_take_nulls_clashing_columns_and_no_rows(spark, tmp_path):
    """The whole pipeline over documents with null ids, texts and sources, repeated rows and further columns, and over none."""
    import corpus_pipeline

    words = "it rained all day in the valley and the river rose over its banks before the night was out".split()
    text = " ".join(words * 3)
    rows = [(i, t, "en", s, 1, "a", "b", "c") for i, (t, s) in enumerate([(text, "x"), (text + " again", "x"), (text.replace(" ", "\n"), None), (None, "x"), ("", None), (" ".join(reversed(words * 3)), "y")])]
    rows += [rows[0], (None, "no id " + text[:60], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    for name, data in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (5, None, 1), (None, 0, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        last = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            last = stage(spark, last, folder)
            assert last.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        out = corpus_pipeline.run(spark, folder).collect()
        assert len(out) == last.count() and (out or name == "none")
        # one of the equal and nearly equal texts stays: that of the smallest id
        assert {r.doc_id for r in out} & {0, 1, 2} in ({0}, set()) if data else not out


def test_one_rule_for_small_and_large_components(spark):
    """Groups are the same whether sets meet within their component or under their least hashes."""
    import random

    from tallyloom.llm import simhash

    r = random.Random(9)
    base = [[f"w{r.randrange(4000)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for words in base:
        for _ in range(12):
            own = words.copy()
            for _ in range(r.randrange(7)):
                own[r.randrange(60)] = f"v{r.randrange(9)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    groups = lambda keys, tile: sorted((x.doc_id, x.group) for x in simhash.near_groups(docs, 5, 80, 4, 0.8, keys, 0.8, sets_tile=tile).collect())
    for keys in (12, 1):
        assert groups(keys, simhash.SETS_TILE) == groups(keys, 2)


def test_workers_get_texts_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tallyloom.functions.scratch import BATCH_BYTES
    from tallyloom.llm._shared import written

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("some words "), 200).alias("text")).mapInArrow(run, "n long, size long")
    got = written(rows, "test").collect()
    assert sum(r.n for r in got) == 6000 and max(r.size for r in got) < 2 * BATCH_BYTES
    assert spark.conf.get(conf, None) is None
    try:
        spark.conf.set(conf, "512k")
        got = written(rows, "test").collect()
        assert sum(r.n for r in got) == 6000 and max(r.size for r in got) < 1 << 20 and spark.conf.get(conf) == "512k"
    finally:
        spark.conf.unset(conf)


def test_buckets_that_go_over_batches_lose_no_link(spark):
    from tallyloom.llm.simhash import near_links

    # buckets of 1, 2, .. 12 rows, in which each row is one bit from the next
    rows = [(100 * b + k, ((1 << k) - 1).to_bytes(8, "little"), 1, bytes([b])) for b in range(12) for k in range(b + 1)]
    prints = spark.createDataFrame(rows, "id long, fp binary, size long, bucket binary")
    wanted = {(100 * b + k, 100 * b + k + 1) for b in range(12) for k in range(b)}
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(conf)
    try:
        for n in (1, 2, 5, 1000):
            spark.conf.set(conf, n)
            assert {tuple(sorted(r)) for r in near_links(prints, 1).collect()} == wanted
    finally:
        spark.conf.set(conf, own)
