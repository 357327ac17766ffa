"""URL filter, whitening and prefix trie against brute force, with nulls, empty and long texts, ties, repeated rows, no rows, and further columns of clashing names."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import prefix_trie, url_filter, whitening
from tallyloom.llm._shared import written
from tallyloom.llm.ordered import running_sums
from tallyloom.llm.tree_contraction import subtree_totals


def test_url_rules(spark):
    urls = [
        "https://a.example.net/de/1", "http://EXAMPLE.net/en/x?y", "http://myexample.net/en/", "http://example.net", "http://example.net?/en/", "http://b.org/fr/a#b", "http://org/fr", "x://Éa.Org/fr/",
        "http://www.example.com/de/", "http://example.com/DE/", "example.com/de/", "", None, "a://b://c/d", "http://example.com/en/1\n/de/", "http://" + "a" * 200_000 + ".net/" + "é" * 1000, "http:///net/", "http://net/", "http://net./x",
    ]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[0], "x", 1), (None, urls[1], "x", 1)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, host string, score int").repartition(3)).collect()

    def plain(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    wanted = [(i, *plain(u)) for i, u, _, _ in rows]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted((w[:4] for w in wanted), key=str)
    assert all(r.verdict == (plain(urls[1 if r.page_id is None else r.page_id])[3] or ("block" if r.score >= 0.5 else "allow")) for r in got)
    assert {r.verdict for r in got if r.host == r.path == ""} == {"allow"}
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    rules = url_filter.Rules([("block", "a.b/"), ("allow", "b/xy"), ("block", "b/xyz/")])
    assert rules.of("a.b", "/xy") == ("a.b/", "block") and rules.of("a.b", "/xyz/1") == ("b/xyz/", "block") and rules.of("c", "/") == (None, None)


def test_url_grams_are_those_of_the_texts():
    texts = ["abc", "", "ünï", "😀x", "abc", "a" * 50]

    def plain(t):
        t = f"\x02{t}\x03" if t else ""
        return [t[i : i + n] for n in url_filter.GRAMS for i in range(len(t) - n + 1)]

    rows, slots = url_filter.hashed_grams(pa.array(texts), 1)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(plain(t)) for t in texts]
    by_text = collections.defaultdict(collections.Counter)
    for r, s in zip(rows, slots):
        by_text[r][s] += 1
    assert by_text[0] == by_text[4] and sorted(by_text[5].values()) == sorted(collections.Counter(plain(texts[5])).values())
    assert set(url_filter.hashed_grams(pa.array(["abc"]), 2)[1]) != set(by_text[0])


def test_url_model_tells_hosts_it_has_not_seen(spark):
    model = url_filter.trained(url_filter.labelled_urls(spark))
    score = lambda *hosts: model.score(pa.array(hosts), pa.array(["/en/1"] * len(hosts)))
    assert (score("casino-lucky.example.org", "pills-cheap.example.com", "adult-tube.example.com", "bets-online.example.org") >= 0.5).all()
    assert (score("gardens.example.org", "blog.mathematics.example.com", "cathedral.example.com", "m.railway-museum.example.org") < 0.5).all()
    empty = url_filter.trained(spark.createDataFrame([("http://a/", None), (None, 2)], "url string, blocked int"))
    assert empty.score(pa.array(["a"]), pa.array([""]))[0] < 0.5
    first = url_filter.trained(url_filter.labelled_urls(spark).repartition(5))
    assert (first.weights == model.weights).all()


def whitened_plainly(rows, most=4):
    x = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    fit = list({tuple(v) for _, v in x})
    n, size = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(size)]
    d = [[n * v[k] - sums[k] for k in range(size)] for v in fit]
    v = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(size)] for i in range(size)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes.T[::-1]
    out = []
    for i, own in x:
        centred = [Fraction(n * a - b, n) for a, b in zip(own, sums)]
        deviation = sum((n * a - b) ** 2 for a, b in zip(own, sums))
        for c in range(min(most, size)):
            out.append((i, c + 1, n, deviation, abs(float(sum(a * Fraction(float(u)) for a, u in zip(centred, axes[c])))) / e[c] ** 0.5, e[c] / np.trace(v)))
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e15])
def test_whitening(spark, scale):
    r = np.random.default_rng(0)
    rows = [(i, [float(a) for a in r.normal(size=6) * scale]) for i in range(120)]
    rows += [rows[0], (None, rows[1][1]), (1000, rows[1][1]), (1001, [-0.0] * 6)]
    odd = [(2000, None), (2001, [float("nan")] * 6), (2002, [None] * 6), (2003, [float("inf")] * 6), (2004, [1.0]), (2005, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"x": F.lit("q"), "n": F.lit(1)}).repartition(5)
    got, wanted = whitening.whitened(df).collect(), whitened_plainly(rows)
    key = lambda t: (str(t[0]), t[1], str(t[3]))
    got = sorted([(g.vec_id, g.component, g.n, g.deviation, abs(g.whitened), g.explained) for g in got], key=key)
    wanted = sorted([(*w[:3], w[3] if w[3] < 2**63 else None, *w[4:]) for w in wanted], key=key)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    near = lambda rows: sorted((str(t[0]), t[1], round(t[4], 6)) for t in rows)
    assert near(got) == near(wanted) and np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-9)
    assert all(0 <= g.identity_error < 1e-9 for g in whitening.whitened(df).limit(3).collect())


def test_whitening_of_little(spark):
    of = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert of([]) == [] and of([(1, None)]) == []
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])] == [(1, 0, None, None, None), (2, 0, None, None, None)] * 2
    line = of([(1, [1.0, 2.0]), (2, [2.0, 4.0])])
    assert sorted((r.component, r.whitened is None) for r in line) == [(1, False), (1, False), (2, True), (2, True)] and line[0].identity_error < 1e-12


def test_squares_are_exact():
    r = np.random.default_rng(3)
    for most in (10, 2**30, 2**55):
        d = r.integers(-most, most, (5000, 5))
        own = whitening.Squares(5)
        own.add(d)
        own.add(d[:7].astype(object) * 2**40)
        got = collections.Counter()
        for batch in own.rows():
            for row in batch.to_pylist():
                got[row["pair"]] += ((row["high"] << 31) + row["low"]) << whitening.LIMB * row["level"]
        plain = [[int(v) for v in row] for row in d] + [[int(v) * 2**40 for v in row] for row in d[:7]]
        pairs = [(i, j) for i in range(5) for j in range(i, 5)]
        assert [got[k] for k in range(len(pairs))] == [sum((v[i] + v[j] if i != j else v[i]) ** 2 for v in plain) for i, j in pairs]


def trie_plainly(rows):
    conv, rebuilt, members = collections.defaultdict(list), {}, collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    for c, own in conv.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(conv.get(base, [])[:h] + own[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k)))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    r = random.Random(1)
    rows = [(c, r.choice([t, t, None, 3]), r.choice(["u", "a", None]), r.choice(["x", "é", "z" * 60, "z" * 60 + "k", None, ""])) for c in range(-8, 30) for t in range(r.choice([0, 1, 2, 9, 12, 3]))]
    rows += [(c, t, "u", f"w{t % 3}") for c, n in ((1003, 60), (1004, 55)) for t in range(n)]
    return rows + [(c, 0, "u", "same") for c in range(2000, 2200)] + [rows[0], rows[0], (None, 1, "u", "q"), (7777, 1, None, None), (7001, 5, "u", "x" * 100_000)]


@pytest.mark.parametrize("partitions,piece", [(4, prefix_trie.PIECE), (13, 50)])
def test_prefix_trie(spark, turns, monkeypatch, partitions, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", piece == prefix_trie.PIECE and partitions == 4)
    try:
        df = spark.createDataFrame(turns, CONVERSATIONS).withColumns({"node": F.lit(1), "parent": F.lit("p"), "n": F.lit(2)}).repartition(7)
        assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str) == trie_plainly(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_of_little(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    rows = [(3, None, None, None)]
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()] == trie_plainly(rows)


def test_subtree_totals_of_a_long_chain_and_a_wide_node(spark):
    parent = {i: i - 1 if 0 < i < 300 else None if i == 0 else 299 if i < 420 else 7 for i in range(430)}
    tree = written(spark.createDataFrame([(f"n{i}", None if p is None else f"n{p}", i, 1) for i, p in parent.items()], "node string, parent string, a long, b long"), "tree")
    sums = {i: [i, 1] for i in parent}
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            sums[parent[i]] = [x + y for x, y in zip(sums[parent[i]], sums[i])]
    assert {r.node: [r.a, r.b] for r in subtree_totals(tree, ["a", "b"]).collect()} == {f"n{i}": s for i, s in sums.items()}


def test_running_sums_over_ranges(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 5, -3]), i, r.randint(0, 9)) for i in range(900)]
    sums, wanted = collections.Counter(), {}
    for k, i, v in rows:
        sums[k] += v
        wanted[k, i] = sums[k]
    df = written(spark.createDataFrame(rows, "k long, i long, v long").repartition(5), "rows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {(x.k, x.i): x.v for x in running_sums(df, "k", ["i"], ["v"]).collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
