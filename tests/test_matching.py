import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import catalog_match, fuzzy, matching, reconcile, recount, review, rows, templates
from tallyloom.operators.name_index import NameIndex, against_names

CATALOG = "bid int, bsid string, bname string, bstyle string, bsize int, detid int"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.fixture(scope="module")
def catalog(spark):
    products = [("B 4749 FULL PANT SET", "RNS", range(55, 95, 5)), ("MM K 4532 B FULL PANT SET (RNS)", "RNS", range(35, 60, 5)), ("BLOOMER KIDS PLAIN", "IE", range(40, 80, 5)), ("BLOOMER LADIES PLAIN", "IE", range(80, 115, 5)), ("B 4756 SHORTS", "OE", (45, 50)), ("VEST 321", "", (75,))]
    return spark.createDataFrame([(i, f"s{i}", name, style, size, 100 * i + size) for i, (name, style, sizes) in enumerate(products) for size in sizes], CATALOG)


def test_scores():
    assert fuzzy.weighted(fuzzy.cleaned("B-4749 full Pant"), fuzzy.cleaned("B 4749 FULL PANT SET")) == 95.0
    assert fuzzy.token_set("a b", "c d") >= 0 and fuzzy.token_set("same", "same") == 100


def test_fields(spark):
    headers = F.array(*(F.lit(str(s)) for s in range(45, 115, 5)))
    assert one(spark, text.split_merged_headers(F.lit("100105"), headers)) == ["100", "105"]
    assert one(spark, text.split_merged_headers(F.lit("100"), headers)) is None
    assert one(spark, text.split_merged_headers(F.lit("12"), headers)) is None
    three = F.array(*map(F.lit, ("45", "50", "55")))
    assert [tuple(c) for c in one(spark, text.parse_pairs_line(F.lit("3,,5"), three))] == [("45", 3), ("55", 5)]
    assert one(spark, text.parse_pairs_line(F.lit("3 4"), three)) == []
    assert one(spark, text.repair_record(F.lit("no json"))).items == []


def test_ditto_keeps_a_name_of_one_word(spark):
    df = spark.createDataFrame([(1, 1, "MYNA"), (1, 2, "-- Plain"), (1, 3, "— \" —")], "form_id int, row_idx int, item string")
    assert [r.item for r in rows.expand_ditto(df).orderBy("row_idx").collect()] == ["MYNA", "MYNA Plain", "MYNA Plain"]


def test_flags_sort_sizes_as_numbers(spark):
    flags = spark.createDataFrame([(1, 1, 1, "unverified", ["100", "45"], "")], "form_id int, row_idx int, seq int, status string, sizes array<string>, note string")
    assert reconcile.merge_flags(flags).first().sizes == "45,100"


def test_error_rates_take_null(spark):
    pairs = spark.createDataFrame([("ab cd", None), ("ab cd", "ab cd"), (None, None)], "truth string, prediction string")
    got = review.text_error_rates(pairs).first()
    assert (got.cer, got.wer, got.perfect) == (50.0, 50.0, 2)


def test_empty_first_reading_stays(spark):
    cells = "form_id int, row_idx int, size string, qty int"
    first, second = spark.createDataFrame([(1, 2, "45", 1), (1, 3, "X", 9)], cells), spark.createDataFrame([(1, 1, "45", 3), (1, 2, "45", 2), (1, 3, "45", 9)], cells)
    totals, headers = spark.createDataFrame([(1, 2, 2)], "form_id int, row_idx int, total int"), spark.createDataFrame([(1, "45")], "form_id int, size string")
    got = {r.row_idx: (r.status, r.chosen) for r in reconcile.reconcile_readings(first, second, totals, headers).collect()}
    assert got == {1: ("ok", "first"), 2: ("resolved", "second"), 3: ("ok", "first")}


def test_best_catalog_match(spark, catalog):
    items = spark.createDataFrame([("MM K4532",), ("B-4749 full Pant",), ("bloomer kid plain",), ("X 999 SHORTS",), (" ",), (None,)], "item string")
    got = {r.item: r for r in catalog_match.best_catalog_match(items, catalog).collect()}
    assert set(got) == {"MM K4532", "B-4749 full Pant", "bloomer kid plain", "X 999 SHORTS"}
    assert got["B-4749 full Pant"][1:5] == ("B 4749 FULL PANT SET", 95.0, True, 1)
    assert got["bloomer kid plain"].bname == "BLOOMER KIDS PLAIN" and not got["bloomer kid plain"].code_narrowed
    assert got["X 999 SHORTS"].unmatched_code == "999" and got["X 999 SHORTS"].pool == 6


def misread(r, text):
    chars = list(text)
    for _ in range(r.randint(0, 3)):
        at = r.randrange(len(chars))
        chars[at : at + 1] = r.choice([[], [r.choice("ABEILNO018 ")], [chars[at], chars[at]]])
    return "".join(chars)


def test_bounds_are_never_below_scores():
    r = random.Random(4)
    words = ["FULL", "PANT", "SET", "B", "MM", "K", "KIDS", "PLAIN", "LADIES", "TRUNK", "VEST", "PRINT", "ÉTÉ", "aaa"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(0, 6))) + r.choice(["", " ", "-"]) + str(r.randint(1, 99999)) for _ in range(90)] + ["", "-", "  ", "a" * 300, "B  B b"]
    texts = [misread(r, n + " x") for n in names[:60]] + ["".join(r.choice("abcdeé 12-. ") for _ in range(r.randint(0, 30))) for _ in range(60)]
    index = NameIndex(np.arange(len(names))[::-1].copy(), names)
    for text in texts:
        form, at = fuzzy.cleaned(text), index._shared(fuzzy.cleaned(text))
        for kind, bounds, score in (("weighted", index._weighted_bound, fuzzy.weighted), ("set", index._set_bound, fuzzy.token_set)):
            exact = [score(form, f) for f in index.forms]
            assert (bounds(form, *at) + 1e-7 >= exact).all()
            for k, least, coded in ((1, 0.0, False), (5, 40.0, False), (5, 40.0, True)):
                wanted = sorted((-s, i) for i, s in enumerate(exact) if s >= least and (not coded or any(c in index.names[i] for c in fuzzy.codes(text))))[:k]
                assert index.best(text, k, kind, least, coded) == [(-s, i) for s, i in wanted]


def test_few_pairs_are_scored():
    r = random.Random(1)
    names = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) + f" {r.choice(('full', 'half'))} pant {r.randint(10, 9999)}" for _ in range(5000)})
    index = NameIndex(np.arange(len(names)), names)
    for text in (asked := [misread(r, r.choice(names)) for _ in range(100)]):
        index.best(text, 1)
    assert index.scored < 0.05 * len(asked) * len(names)


def test_few_pairs_of_like_numbers_are_scored():
    """The same digits in another order are in common as characters, not as a sequence."""
    r = random.Random(3)
    names = [f"Customer#{i:09d} " + r.choice(("NATION_7", "NATION_12", "PERU", "NORTH AND SOUTH")) for i in r.sample(range(60_000), 4000)]
    index = NameIndex(np.arange(len(names)), names)
    asked = [n[:18].replace("#", " ") for n in names[:20]] + ["Supplier#000000012", "Customer 000000000"]
    for kind, score, k, least in (("weighted", fuzzy.weighted, 1, 88), ("set", fuzzy.token_set, 60, 40)):
        index.scored = 0
        for text in asked:
            exact = [score(fuzzy.cleaned(text), f) for f in index.forms]
            assert index.best(text, k, kind, least) == [(-s, i) for s, i in sorted((-s, i) for i, s in enumerate(exact) if s >= least)[:k]]
        assert index.scored < 10 * k * len(asked)


def test_each_pair_of_block_and_shard_is_work_of_its_own(spark):
    texts, keys = spark.range(400).selectExpr("'t' || id AS text"), spark.range(40).selectExpr("id AS ord", "'k' || id AS key")
    found = against_names(texts, keys, lambda index, text: [(1.0, 0)], "score double, ord long", 10, 100)
    assert found.where("score > 0").rdd.getNumPartitions() == 64  # of 4 shards and 4 blocks; few bytes are not put together


def test_shards_and_blocks_give_the_same_best(spark):
    r = random.Random(2)
    names = [f"{a} {b}" for a in ("RED", "BLUE", "OLD", "NEW") for b in ("VEST", "TRUNK", "BRIEF", "SLIP", "GOWN")]
    keys = spark.createDataFrame([*enumerate(names)], "ord long, key string")
    asked = sorted({misread(r, n) for n in names} | {"trunk old"})
    texts = spark.createDataFrame([(t,) for t in [*asked, None, asked[0]]], "text string")
    wanted = {t: max((fuzzy.weighted(fuzzy.cleaned(t), fuzzy.cleaned(k)), -i) for i, k in enumerate(names)) for t in asked}

    def take(index, text):
        return [(s, int(index.ords[i])) for s, i in index.best(text, 1)]

    for shard, block in ((100, 1000), (3, 4)):
        rows = against_names(texts, keys, take, "score double, ord long", shard, block).collect()
        best = {}
        for x in rows:
            best[x.text] = max(best.get(x.text, (-1, 0)), (x.score, -x.ord))
        assert best == wanted
    assert against_names(texts, keys.limit(0), take, "score double, ord long").count() == 0 and against_names(texts.limit(0), keys, take, "score double, ord long").count() == 0


def test_ranked_search(spark, catalog):
    names = [r.bname for r in catalog.select("bname").distinct().orderBy("bname").collect()]
    keys = spark.createDataFrame([*enumerate(names)], "ord long, key string")
    asked = ["MM K4532", "full pant set", "bloomer", "shorts 4756", ""]
    got = {}
    for r in catalog_match.ranked_search(spark.createDataFrame([(t,) for t in asked], "text string"), keys, 3).collect():
        got.setdefault(r.text, {})[r["rank"]] = names[r.ord]
    assert got["MM K4532"][1].startswith("MM K 4532")

    def brute(query, limit):
        if not query:
            return names[:limit]
        out = []
        for pool in ([k for k in names if any(c in k for c in fuzzy.codes(query))], names):
            scored = sorted(((fuzzy.token_set(fuzzy.cleaned(query), fuzzy.cleaned(k)), k) for k in pool), key=lambda x: (-x[0], names.index(x[1])))
            best = [x for x in scored if x[0] >= 40][:60]
            best.sort(key=lambda x: (x[1].casefold().startswith(query.casefold()), query.casefold() in x[1].casefold(), x[0]), reverse=True)
            out += [k for _, k in best if k not in out]
        return out[:limit]

    assert {t: [v for _, v in sorted(r.items())] for t, r in got.items()} == {t: brute(t, 3) for t in asked}


def test_binding(spark, catalog):
    products = catalog.groupBy("bsid", "bname", "bstyle").agg(F.sort_array(F.collect_set(F.col("bsize").cast("string"))).alias("sizes"))
    items = spark.createDataFrame([(1, "Bloomer Plain", "IE", ["80", "85"]), (2, "Bloomer Plain", "IE", ["40", "45"]), (3, "Bloomer Plain", "IE", ["45"]), (4, "B 4749", "RNS", ["55", "95"]), (5, "nothing like it", "", [])], "row_id int, item string, style string, sizes array<string>")
    matches = matching.match_trust(catalog_match.best_catalog_match(items.select("item"), catalog))
    assert matches.where("item = 'Bloomer Plain'").first().trusted
    assert catalog_match.bind_products(items, matches, products).where("row_id = 1").first().bsid == "s2"  # route 1 goes by the name alone
    matches = matches.withColumn("trusted", F.col("trusted") & (F.col("item") != "Bloomer Plain"))
    got = {r.row_id: r for r in catalog_match.bind_products(items, matches, products).collect()}
    assert (got[1].bsid, got[2].bsid, got[3].bsid, got[4].bsid, got[5].bsid) == ("s3", "s2", None, "s0", None)
    assert got[4].size_mismatch == ["95"] and not got[4].auto_bound and got[1].auto_bound and "s0" in got[4].candidates


def test_parties(spark):
    buyers = spark.createDataFrame([(1, "SHARDA SALES (Z CLOSE)", "SOLAPUR"), (2, "M K ENTERPRISES", "PUNE"), (3, "M.M ENTERPRISES", "PUNE"), (4, "ALPHA HOSIERY", None), (5, "ALPHA HOSIERY", "AGRA")], "head_id int, name string, city string")
    forms = spark.createDataFrame([(1, "Sharda Sales (Z Close)", "Ramu"), (2, "LOOMHOUSE", "Alpha Hosiery"), (3, "Alpha Hosiery", "M K Enterprises Pune"), (4, "Alpha Hosiery", "alpha-hosiery"), (5, "Ramu", "Shamu"), (6, "", "M. K. Enterprises"), (7, " ", "Shamu"), (8, "Alpha Hosiery", "Alpha Hosiery Agra")], "form_id int, seller_name string, party_name string")
    got = {r.form_id: r[1:] for r in catalog_match.resolve_party(forms, buyers, "loomhouse").collect()}
    assert got == {1: ("suggest", "SHARDA SALES (Z CLOSE)", True), 2: (None, None, False), 3: ("ambiguous", None, False), 4: (None, None, False), 5: ("unmatched", None, False), 6: (None, None, False), 7: ("unmatched", None, False), 8: (None, None, False)}
    picked = {r.form_id: r.head_id for r in catalog_match.suggest_buyer(forms.withColumn("suggested_party_name", F.lit("")), buyers).collect()}
    assert picked[6] == 2 and picked[2] is None and picked[5] is None  # two buyers of one name: none is selected


def test_annotation(spark, catalog):
    cells = "form_id int, row_idx int, item string, kind string, headers array<int>, cells array<struct<size:string,qty:int>>"
    letters = [(s, 6) for s in ("S", "M", "L", "XL", "XXL")]
    df = spark.createDataFrame([(1, 1, "MM K 4532 B full pant set (RNS)", "", [*range(35, 100, 5)], letters), (1, 2, "MM K 4532 B full pant set (RNS)", "OE", [*range(35, 100, 5)], [("45", 1), ("L", 2)]), (1, 3, "B-4749 full Pant", "RNS", [*range(45, 100, 5)], [(str(s), 1) for s in range(50, 90, 5)]), (1, 4, "", "", [45], [])], cells)
    got = {r.row_idx: r for r in catalog_match.annotate_rows(df, catalog).collect()}
    assert [tuple(c) for c in got[1].cells] == [(str(s), 6) for s in range(35, 60, 5)] and got[1].kind == "RNS"
    assert got[2].conflicts == ["L"] and [tuple(c) for c in got[2].cells] == [("45", 1), ("L", 2)] and got[2].style_mismatch == ["RNS"]
    assert got[3].offset == 1 and got[3].outside == ["50"] and got[3].suggestion == "B 4749 FULL PANT SET"
    assert got[4].trusted is False and got[4].suggestion is None
    weak = catalog_match.annotate_rows(spark.createDataFrame([(1, 5, "qqq zzz", "OE", [45], [("L", 1)])], cells), catalog).first()
    assert (weak.suggestion, weak.style_mismatch, weak.unresolved, weak.conflicts) == (None, None, None, None)


def test_trust_goes_by_the_score_as_it_is(spark):
    df = spark.createDataFrame([(94.96, False, 9), (95.0, False, 9), (69.96, True, 2), (34.96, True, 1)], "score double, code_narrowed boolean, pool int")
    assert [(r.trusted, r.shown) for r in matching.match_trust(df).collect()] == [(False, True), (True, True), (False, False), (False, True)]


def test_style_mismatch_without_trust(spark):
    df = spark.createDataFrame([("RN", ["IE"], False), ("", ["IE"], False), ("", ["IE"], True), ("RN", [], True)], "kind string, styles array<string>, trusted boolean")
    assert [(r.kind, r.style_mismatch) for r in matching.fill_or_check_style(df).collect()] == [("RN", ["IE"]), ("", None), ("IE", None), ("RN", None)]


def test_recount_without_second_reading(spark):
    cells = "array<struct<size:string,qty:int>>"
    df = spark.createDataFrame([(1, 1, "A", [("45", 1)], "", ["45"], None, "", None, ""), (1, 2, "A", [("45", 1)], "", ["45"], None, "", [], ""), (1, 3, "", [("45", 1)], "9", ["45"], None, "zzz", [("45", 1)], "0")], f"form_id int, row_idx int, item string, main {cells}, row_total string, size_headers array<string>, catalog_sizes array<int>, item_seen string, recount {cells}, total_dozen string")
    assert [r.status for r in recount.merge_recount(df).orderBy("row_idx").collect()] == ["no_recount", "unverified", "unverified"]


def test_rules(spark):
    rules = spark.createDataFrame([("s", "Fainlady Plain", "FAIRLADY PLAIN")], "signature string, trigger string, corrected string")
    shown = spark.createDataFrame([("s", 1, 1, "Fainladi Plain"), ("s", 1, 2, "FAINLADY  PLAIN"), ("t", 1, 3, "Fainlady Plain")], "signature string, form_id int, row_idx int, item string")
    assert [r.item for r in templates.apply_rules(shown, rules).orderBy("row_idx").collect()] == ["FAIRLADY PLAIN", "FAIRLADY PLAIN", "Fainlady Plain"]
    shifts = spark.createDataFrame([("s", "fainlady plain", 1)], "signature string, trigger string, offset int")
    cells = spark.createDataFrame([(1, 1, s, q) for s, q in (("45", 5), ("50", 30), ("55", 30), ("60", 4))] + [(1, 3, "45", 1)], "form_id int, row_idx int, size string, qty int")
    headers = spark.createDataFrame([(1, i, str(45 + 5 * i)) for i in range(5)], "form_id int, pos int, size string")
    moved = {(r.row_idx, r.size): r.qty for r in templates.apply_shift_rules(shown, cells, headers, shifts).collect()}
    assert moved == {(1, "50"): 5, (1, "55"): 30, (1, "60"): 30, (1, "65"): 4, (3, "45"): 1}


def test_rows_move_up(spark):
    cells = spark.createDataFrame([(1, 1, "45", 1), (1, 2, "45", 2), (1, 3, "45", 3)], "form_id int, row_idx int, size string, qty int")
    first = spark.createDataFrame([(1, 2, 3)], "form_id int, from_row int, rows int")
    assert {(r.row_idx, r.qty) for r in rows.shift_rows_vertically(cells, first, down=False).collect()} == {(1, 2), (2, 3)}
    assert {(r.row_idx, r.qty) for r in rows.shift_rows_vertically(cells, first).collect()} == {(1, 1), (3, 2)}
