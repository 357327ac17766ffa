"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows, no rows, and further columns of clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tallyloom.llm import additive_quantizer, bpe, exact_dedup, mixing, quality, simhash, token_counts, token_files, toxicity, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, norm string, node string, key string"


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(60)]
    out += [out[0], out[0].replace(" ", "\n\t"), out[0].upper(), out[3] + " more", "", " ", None, None, "x" * 9000, "a b " * 20000, "<|endoftext|> a\0b  c", "漢字 😀\x1c  z"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], 0, "x", "y", "z", "k") for i, t in enumerate(texts())]
    rows += [rows[0], (None, "null id", "en", "s1", 0, "x", "y", "z", "k"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_exact_dedup(docs, none):
    groups = collections.defaultdict(list)
    for i, t in plain(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    expected = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    for shards in (None, 1):
        got = exact_dedup.exact_duplicates(docs, shards).collect()
        assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, expected))
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.without_exact_duplicates(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_quotient_filters_merge_without_loss():
    r = np.random.default_rng(0)
    parts = [r.integers(0, 2**64, 500, dtype=np.uint64) // np.uint64(2**50) * np.uint64(2**49) for _ in range(4)]
    filters = [exact_dedup.CountingQuotientFilter.of(*np.unique(p, return_counts=True), 6) for p in parts]
    values, counts = exact_dedup.CountingQuotientFilter.merged(filters).items()
    expected = np.unique(np.concatenate(parts), return_counts=True)
    assert (values == expected[0]).all() and (counts == expected[1]).all()


def test_simhash(docs, none):
    rows = plain(docs)

    def brute(t):
        w = "".join(c.lower() if c.isascii() else c for c in t)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    known = {t: brute(t) for _, t in rows}
    prints = [known[t] for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    expected = sorted(map(str, [(rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))]))
    for tile in (simhash.TILE, 2):
        assert sorted(map(str, map(tuple, simhash.near_duplicates(docs, tile=tile).collect()))) == expected
        assert sorted(map(str, map(tuple, simhash.near_duplicates(docs, tile=tile, keys=64).collect()))) == sorted(map(str, map(tuple, simhash.near_duplicates(docs, radius=2, keys=0).collect())))
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(none, keys=4).count() == 0
    assert simhash.without_near_duplicates(docs).columns == docs.columns


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for target in {(r.source_size, r.target) for r in rows}:
        assert abs(sum(r.taken for r in rows if (r.source_size, r.target) == target) - target[1]) <= largest
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_token_counts(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = sorted(str((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096)) for i, t in plain(docs))
    for size, overlap in ((32768, 256), (64, 4)):
        assert sorted(str(tuple(r)) for r in token_counts.token_counts(docs, path, chunk=size, overlap=overlap).collect()) == expected
    assert token_counts.token_counts(none, path).count() == 0


def test_bpe_and_token_files(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in plain(docs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = sorted(str((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False)))) for i, x in ids)
    assert sorted(str(tuple(r)) for r in bpe.round_trip(docs, path).collect()) == expected
    assert bpe.decoded(bpe.encoded(docs, path), path).where("doc_id = 3").first().text == docs.where("doc_id = 3").first().text
    got = token_files.token_files(docs, path, 2).orderBy("start").collect()
    crc = lambda x: zlib.crc32(np.array([*x, 2], "<u4").tobytes())
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((i, len(x) + 1, crc(x))) for i, x in ids)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert bpe.round_trip(none, path).count() == token_files.token_files(none, path, 2).count() == 0
    own = bpe.Codec(path)
    assert own.merge_words(["a", "hello", "x" * 63]) == [own.merge_word(w) for w in ["a", "hello", "x" * 63]]


def test_library_encodes_a_word_once(monkeypatch):
    """A word goes through the library once, whatever punctuation is around it; ids are the library's over odd ends of letters, white space, zeros and special tokens."""
    import pyarrow as pa

    encoder, asked = token_files.LibraryEncoder(P.path("byte_bpe_50k.json")), []
    inner = encoder.library
    monkeypatch.setattr(encoder, "library", lambda parts: asked.extend(parts) or inner(parts))
    r = random.Random(7)
    words, marks = ["".join(r.choice("abcdeföщ汉") for _ in range(6)) for _ in range(50)], ["", ",", ".", "###", "?!", ")", ";", "$$$", "'s", "_1"]
    found = encoder.encode(pa.array([" ".join(w + m for w in words) for m in marks]))
    assert len(asked) == len({*asked}) <= 2 * len(words) + 2 * len(marks)
    odd = ["".join(r.choice(["a", "Bc", "ö", "щ", "汉", "½", "²", "e\u0301", "'", "'s", "'ll", "7", "_", ",", "#!", "-", "\t", "\n", "\r\n", " ", " ", "  ", "\u00a0", "\u2003 ", "\x1c", "\0", "<|endoftext|>", "<|endof", "\u0120", "😀"]) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    odd += ["", " ", "\n", " \nabc", "abc\n", "abc ", "x" * 70 + "." * 70 + " y"]
    for texts, ids in (([" ".join(w + m for w in words) for m in marks], found), (odd, encoder.encode(pa.array(odd))), (odd[:5], encoder.encode(pa.array(odd[:9]).slice(0, 5))), ([], encoder.encode(pa.array([], pa.string())))):
        assert [x.tolist() for x in ids] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts(tmp_path):
    """One that puts a space first, and one whose added token takes the space before it: their words do not end where parts do."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        data = json.load(f)
    texts = ["a b, c <|endoftext|> d", "Hello, world", "", "x \0 y"]
    led = {**data, "pre_tokenizer": {**data["pre_tokenizer"], "add_prefix_space": True}}
    stripped = {**data, "added_tokens": [{**t, "lstrip": True} for t in data["added_tokens"]]}
    for k, changed in enumerate((led, stripped)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(changed))
        expected = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in token_files.LibraryEncoder(str(path)).encode(pa.array(texts))] == expected


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 50257, 4096), np.full(4096, 7), r.integers(0, 9, 4096), np.where(r.random(4096) < 0.01, 2**32 - 1, 3)]).astype(np.uint32)
    assert (token_files.decode_blocks([memoryview(b) for b in token_files.encode_blocks(ids)]).reshape(-1) == ids).all()


def test_warc(spark, tmp_path):
    long = "<p>é" + "x" * 200
    rows = [(1, "http://a/ b\r\n", long, 1), (2, None, long, 2), (3, "u", "short", 3), (4, "u", "short", 4), (5, "u", None, 5), (None, "u", long, 6), (2, "u", long, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    got = warc.archived(pages, f"file://{tmp_path}/w").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(p, len((h or "").encode()), digest(h or ""), *(("revisit", 1) if h == long and p != 1 else ("response", None))) for p, _, h, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    back = spark.read.format("warc").load(f"file://{tmp_path}/w").where("page_id = 1").first()
    assert (back.url, bytes(back.payload).decode()) == ("http://a/ b\r\n", long)
    assert warc.archived(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_search(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 8))
    x[300:] = x[7]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (50, [float(v) for v in x[50]], 0)]
    got = additive_quantizer.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    x = x.astype(np.float32).astype(float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = total = 0
    for q in range(0, 400, 50):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        best = np.lexsort((np.arange(400), -s))[:5]
        found = [g.vec_id for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q]
        hits, total = hits + len({*found} & {*best.tolist()}), total + 5
    assert hits / total >= 0.9 and len(got) == total
    assert additive_quantizer.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_classifiers(spark, docs, none):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(40)]
        toxic, good = i % 5 == 0, i % 4 > 0
        if toxic:
            t[3:6] = ["idiot", "zorkly" + r.choice("abc"), "scum"]
        rows.append((i, " ".join(t) if good else "!! ".join(t).upper()))
        labels.append((i, int(good), int(toxic)))
    made, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f, at in ((quality.quality, 1), (toxicity.toxicity, 2)):
        got = [g for g in f(made, marks).collect() if g.held_out]
        assert len(got) > 80 and np.mean([g.predicted == labels[g.doc_id][at] for g in got]) > 0.9
        assert f(docs, marks.limit(0)).count() == docs.count()
        assert f(none, marks).count() == 0
    kept = {x.doc_id for x in toxicity.without_toxic(made, marks).collect()}
    assert sum(i not in kept for i, _, t in labels if t) > 100 and sum(i in kept for i, _, t in labels if not t) > 460


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_have_similar_sets(spark):
    """Pairs just above and just below a similarity of 0.8, small sets, and a repeated passage: groups are those of the sets, both ways."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for _ in range(60):
        for n in (104, 8):
            words = [word() for _ in range(n)]
            rows.append(" ".join(words))
            for least, most in ((0.8, 0.83), (0.7, 0.79)):
                cut = next((c for c in range(n) if least <= likeness(shingles_of(" ".join(words)), shingles_of(" ".join(words[: n - c]))) <= most), None)
                changed = [*words[: n - 10], *(word() for _ in range(10))]
                rows += [" ".join(words[: n - cut])] if cut else []
                rows += [" ".join(changed)] if n > 10 and least <= likeness(shingles_of(" ".join(words)), shingles_of(" ".join(changed))) <= most else []
    words = [word() for _ in range(160)]
    rows += [" ".join(words), " ".join(words + words[:120])]  # one set but for four shingles, sizes 156 and 276 with repeats
    sets = [shingles_of(t) for t in rows]
    assert likeness(*sets[-2:]) >= 0.8
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and likeness(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    made = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in simhash.without_near_duplicates(made).collect()) == sorted({*root})


def test_every_candidate_is_compared(spark):
    """Each link of similar sets is found, also where a bucket is cut into tiles."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(100)]
    rows = [" ".join(words[:k] + [f"new{k}"] * 6 + words[k + 6 :]) for k in range(8, 88, 2)]  # each far from most others
    sets = [shingles_of(t) for t in rows]
    links = {(i, j) for i in range(len(rows)) for j in range(i) if likeness(sets[i], sets[j]) >= 0.8}
    made = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    groups = [simhash.near_groups(made, 5, 80, 4, 0.8, 12, 0.8, tile, tile).collect() for tile in (1 << 15, 8)]
    of = [{x.doc_id: x.group for x in found} for found in groups]
    assert of[0] == of[1]
    assert all(of[0][i] == of[0][j] for i, j in links)


def test_stages_tell_rows_of_one_id_apart(spark, monkeypatch):
    """Null and repeated ids: only the near copy and the toxic row of an id go, and of each group one row stays."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (None, d), (None, d + " more"), (None, a + " less"), (5, ""), (5, "")]
    near = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text[:1]) for r in near) == {(1, "a"): 1, (2, "b"): 1, (3, "c"): 1, (None, "d"): 1, (5, ""): 2}
    monkeypatch.setattr(toxicity.Linear, "fitted", classmethod(lambda cls, sample: cls({"idiot": 5.0}, -3.0)))
    rows = [(1, "a fine day"), (2, "you idiot"), (3, "one idiot"), (3, "one friend"), (None, "an idiot again"), (None, "a friend again"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stays = toxicity.without_toxic(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")).collect()
    assert sorted(map(str, map(tuple, stays))) == sorted(str(r) for r in rows if "idiot" not in (r[1] or ""))


def test_bound_of_features_reaches_the_classifier(spark, monkeypatch):
    """One that stands in for it need take a sample alone, as long as the bound is the usual one."""
    seen = []
    docs, labels = spark.createDataFrame([(1, "a fine day"), (2, "you idiot")], "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity.Linear, "fitted", classmethod(lambda cls, sample, **bound: seen.append(bound) or cls({}, -3.0)))
    for bound in ({}, {"features": 5}):
        assert toxicity.toxicity(docs, labels, **bound).count() == 2
    assert seen == [{}, {"features": 5}]


def test_neighbours_of_tiny_and_huge_vectors(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(200)]
    rows += [(1000, [1e-200 * v for v in rows[3][1]]), (1050, [1e200 * v for v in rows[4][1]]), (1001, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    got = {}
    for x in additive_quantizer.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    assert got.keys() == {0, 50, 100, 150, 1000, 1050} and {len(v) for v in got.values()} == {5}
    assert got[1000][1][0] == 3 and got[1050][1][0] == 4 and abs(got[1000][1][1] - 1) < 1e-12


def test_neighbours_over_several_shards_and_blocks(spark):
    """Real dimensions, a short list far below the table, shards and blocks of few rows: the same rows as by one shard and block, and near all of the true ones."""
    r = np.random.default_rng(3)
    x = (r.normal(size=(40, 64))[r.integers(0, 40, 1500)] + 0.4 * r.normal(size=(1500, 64))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    run = lambda **k: {(g.query_id, g["rank"]): (g.vec_id, round(g.score, 12)) for g in additive_quantizer.search(df, shortlist=60, **k).collect()}
    got = run(shard_rows=400, block=8)
    assert len(got) == 30 * 5 and got == run()
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len({*np.lexsort((np.arange(1500), -s))[:5].tolist()} & {got[q, k][0] for k in range(1, 6)})
    assert hits / len(got) >= 0.9


def test_warc_passes_over_what_filters_name(spark, tmp_path):
    """Filters on header columns are taken by the reader, which then parses no payload of the records that they pass over; others are left to Spark."""
    from pyspark.sql.datasource import EqualTo, In, StringContains

    pages = spark.createDataFrame([(i, "u", "x" * (50 + 60 * (i % 3))) for i in range(12)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    kinds = [r.record_type for r in warc.archived(pages, path).collect()]
    back = spark.read.format("warc").load(path)
    for pushed, kept in (([EqualTo(("record_type",), "revisit")], kinds.count("revisit")), ([In(("payload_bytes",), (110, 170))], 8)):
        reader = warc.WarcReader({"path": path}, back.schema)
        assert [*reader.pushFilters([*pushed, StringContains(("payload",), "x")])] == [StringContains(("payload",), "x")]
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        assert rows == kept and reader.passed_over > 0
    assert back.where("record_type = 'revisit'").count() == kinds.count("revisit") and back.where("payload_bytes > 100").count() == 8
