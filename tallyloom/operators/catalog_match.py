"""Names of items and buyers against catalog and buyer master: best match, search, binding to a product, and the annotation of rows.

Texts are made distinct first. A text that nothing narrows is held against all keys of a table by way of name_index: exactly, but scored with few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scratch import written
from tallyloom.functions.text import likeness_form, normalize_name, product_codes, sort_sizes
from tallyloom.operators import fuzzy
from tallyloom.operators.name_index import NameIndex, against_names
from tallyloom.operators.orders import numbered
from tallyloom.operators.matching import code_candidates, code_narrowing, detect_column_shift, fill_or_check_style, match_trust, resolve_letter_size, sizes_outside_catalog

#: The least score of a search hit, of a buyer hit, of a suggested name, of a selected buyer and its lead, and how far from the best name a product may be.
SEARCHED, BUYER_HIT, SUGGESTED, SELECTED, LEAD, BAND = 40, 88, 70, 90, 8, 8


def _best(scored: DataFrame, *by: str) -> DataFrame:
    """The row of the highest score of each key, ties to the smallest ord."""
    return scored.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("s"), "ord")).alias("b")).select(*by, (-F.col("b.s")).alias("score"), F.col("b.ord").alias("ord"))


def best_of_all(texts: DataFrame, keys: DataFrame, least: float = 0.0) -> DataFrame:
    """(text, score, ord): the key with the highest weighted ratio, of `least` or more, the first by ord of equals. Texts that are blank once cleaned have none."""

    def take(index: NameIndex, text: str) -> list[tuple]:
        return [(score, int(index.ords[i])) for score, i in index.best(text, 1, least=least)] if fuzzy.cleaned(text) else []

    return _best(against_names(texts, keys, take, "score double, ord long"), "text")


def ordered_keys(keys: DataFrame, *order: str) -> DataFrame:
    """keys with ord, their place in an order. Ranges of the order are numbered apart."""
    return numbered(keys, *order, n="ord").withColumn("ord", F.col("ord").cast("long"))


def best_catalog_match(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each distinct item that is not blank: bname, score, code_narrowed, pool, unmatched_code.

    Items are scored against the names that hold one of their codes; those without such a name, against all. Names are in order of text.
    """
    names = written(ordered_keys(catalog.select(F.col("bname")).where(F.trim("bname") != "").distinct(), "bname"), "names")
    items = written(items.select("item").where(likeness_form(F.col("item")) != "").distinct(), "items")
    narrowing = written(code_narrowing(items, catalog), "narrowing")
    coded = code_candidates(items, catalog).join(names, "bname").withColumn("score", fuzzy.weighted_ratio(likeness_form(F.col("item")), likeness_form(F.col("bname"))))
    free = best_of_all(narrowing.where("not code_narrowed").select(F.col("item").alias("text")), names.select("ord", F.col("bname").alias("key"))).withColumnRenamed("text", "item")
    best = _best(coded.select("item", "score", "ord"), "item").unionByName(free)
    return narrowing.join(best, "item").join(names, "ord").select("item", "bname", "score", "code_narrowed", "pool", "unmatched_code")


def best_buyer_match(texts: DataFrame, buyers: DataFrame, least: float = 0.0) -> DataFrame:
    """(text, head_id, name, city, score) of each distinct text: the live buyer (head_id, name, city) whose name and city are most like it, ties by name, then id. Texts whose best score is below `least` have none."""
    listed = written(ordered_keys(buyers.select("head_id", "name", F.coalesce("city", F.lit("")).alias("city")), "name", "head_id"), "buyers")
    best = best_of_all(texts, listed.select("ord", F.trim(F.concat_ws(" ", "name", "city")).alias("key")), least)
    return best.join(listed, "ord").select("text", "head_id", "name", "city", "score")


def resolve_party(forms: DataFrame, buyers: DataFrame, own: str) -> DataFrame:
    """Per form (form_id, seller_name, party_name): outcome, suggested_party_name and closed_hint; null outcome where nothing is to be said.

    Forms whose seller's name holds `own`, the own letterhead, are passed over. A hit is a score of 88 or more. Buyers of different names: ambiguous. Only the seller:
    its buyer is suggested, with a hint where its name says that it is closed. Neither, a blank one too: unmatched. Only the party, or the same name twice: nothing.
    """
    skipped = F.contains(F.lower(F.coalesce("seller_name", F.lit(""))), F.lit(own.lower()))
    texts = forms.where(~skipped).select(F.explode(F.array("seller_name", "party_name")).alias("text")).where("trim(text) <> ''")
    found = written(best_buyer_match(texts, buyers, BUYER_HIT).select("text", "name"), "parties")
    seller, party = (found.select(F.col("text").alias(f"{c}_name"), F.col("name").alias(f"{c}_buyer")) for c in ("seller", "party"))
    joined = forms.select("form_id", "seller_name", "party_name").join(seller, "seller_name", "left").join(party, "party_name", "left")
    s, p = F.col("seller_buyer").isNotNull(), F.col("party_buyer").isNotNull()
    outcome = F.when(skipped | (p & ~s) | (s & p & (F.col("seller_buyer") == F.col("party_buyer"))), None).when(s & p, "ambiguous").when(s, "suggest").otherwise("unmatched")
    suggested = F.when(outcome == "suggest", F.col("seller_buyer"))
    return joined.select("form_id", outcome.alias("outcome"), suggested.alias("suggested_party_name"), F.coalesce(F.contains(F.lower(suggested), F.lit("close")), F.lit(False)).alias("closed_hint"))


def ranked_search(texts: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """(text, rank, ord, score): the best `limit` of keys (ord long, key) for each distinct text, as a picker shows them.

    First keys that hold a code of the text, then all. Of either, those with a token-set ratio of 40 or more, the best max(4 * limit, 60) of them, in the
    order of beginning with the text, holding it, and score; equals by ord. A blank text has the first `limit` keys, with a null score.
    """
    most = max(4 * limit, 60)

    def take(index: NameIndex, text: str) -> list[tuple]:
        if not text.strip():
            return [(int(ord_), None, False, False, False) for ord_ in index.ords[:limit]]
        low, codes = text.casefold(), set(fuzzy.codes(text))
        # each shard sends on no more than its own best of either kind
        best = {*index.best(text, most, "set", SEARCHED), *index.best(text, most, "set", SEARCHED, coded=True)}
        keys = {i: index.names[i] for _, i in best}
        return [(int(index.ords[i]), score, any(c in keys[i] for c in codes), keys[i].casefold().startswith(low), low in keys[i].casefold()) for score, i in best]

    found = written(against_names(texts, keys, take, "ord long, score double, coded boolean, begins boolean, holds boolean"), "hits")
    by_score = Window.partitionBy("text").orderBy(F.desc_nulls_last("score"), "ord")
    shown = Window.partitionBy("text").orderBy(F.desc("begins"), F.desc("holds"), F.desc_nulls_last("score"), "ord")

    def one_pass(rows: DataFrame, first: int) -> DataFrame:
        short = rows.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= most)
        return short.withColumn("_at", F.row_number().over(shown)).select("text", "ord", "score", F.lit(first).alias("_pass"), "_at")

    both = one_pass(found.where("coded"), 1).unionByName(one_pass(found, 2))
    once = both.groupBy("text", "ord").agg(F.min(F.struct("_pass", "_at")).alias("_p"), F.first("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy("_p", "ord"))).where(F.col("rank") <= limit)
    return ranked.select("text", "rank", "ord", "score")


def suggest_buyer(forms: DataFrame, buyers: DataFrame) -> DataFrame:
    """Per form (form_id, party_name, suggested_party_name): head_id of the only buyer that the name can mean, else null.

    The suggested name goes before the one read. Among the eight best of a search, exactly one with the same name but for case and signs is selected; else the
    first, if its weighted ratio is 90 or more and 8 more than that of any other.
    """
    name = F.trim(F.coalesce(F.nullif("suggested_party_name", F.lit("")), "party_name"))
    asked = forms.select("form_id", name.alias("text")).where("text <> ''")
    listed = written(ordered_keys(buyers.select("head_id", "name", F.coalesce("city", F.lit("")).alias("city")), "name", "head_id"), "buyers")
    hits = ranked_search(asked, listed.select("ord", F.trim(F.concat_ws(" ", "name", "city")).alias("key")), 8).join(listed, "ord")
    same = normalize_name(F.col("text")) == normalize_name(F.col("name"))
    scored = hits.withColumn("w", fuzzy.weighted_ratio(likeness_form(F.col("text")), likeness_form(F.col("name")))).withColumn("same", same)
    told = scored.groupBy("text").agg(F.count_if("same").alias("equal"), F.max(F.when(F.col("same"), F.col("head_id"))).alias("equal_id"), F.min_by("head_id", "rank").alias("first_id"), F.min_by("w", "rank").alias("first"), F.coalesce(F.max(F.when(F.col("rank") > 1, F.col("w"))), F.lit(0.0)).alias("next"))
    chosen = F.when(F.col("equal") == 1, F.col("equal_id")).when((F.col("first") >= SELECTED) & (F.col("first") - F.col("next") >= LEAD), F.col("first_id"))
    return forms.select("form_id").join(asked.join(told.select("text", chosen.alias("head_id")), "text").select("form_id", "head_id"), "form_id", "left")


def apply_letter_sizes(rows: DataFrame) -> DataFrame:
    """rows (cells: array of (size, qty) in the row's order, catalog_sizes: array of int, trusted) with letter sizes resolved: cells, resolved, unresolved and conflicts (letter sizes).

    A letter goes to a number only on trusted rows. Where that number is a size of the row already, or an earlier letter of the row has taken it, the letter stays and is a conflict.
    """
    numbers = F.transform(F.filter("cells", lambda c: c["size"].rlike("^[0-9]+$")), lambda c: c["size"])
    number = lambda c: F.when(F.col("trusted") & ~c["size"].rlike("^[0-9]+$"), resolve_letter_size(c["size"], F.col("catalog_sizes")).cast("string"))
    told = rows.withColumn("_t", F.transform("cells", lambda c: F.struct(c["size"].alias("size"), c["qty"].alias("qty"), number(c).alias("to")))).withColumn("_numbers", numbers)
    taken = lambda c, i: F.array_contains("_numbers", c["to"]) | F.exists(F.slice("_t", 1, i), lambda e: e["to"] == c["to"])
    told = told.withColumn("_t", F.transform("_t", lambda c, i: F.struct(c["size"].alias("size"), c["qty"].alias("qty"), c["to"].alias("to"), F.coalesce(taken(c, i), F.lit(False)).alias("taken"))))
    good = lambda c: c["to"].isNotNull() & ~c["taken"]
    sizes = lambda keep: F.transform(F.filter("_t", keep), lambda c: c["size"])
    return told.withColumns({
        "resolved": F.transform(F.filter("_t", good), lambda c: c["to"]), "unresolved": sizes(lambda c: ~c["size"].rlike("^[0-9]+$") & ~good(c)), "conflicts": sizes(lambda c: c["taken"]),
        "cells": F.transform("_t", lambda c: F.struct(F.when(good(c), c["to"]).otherwise(c["size"]).alias("size"), c["qty"].alias("qty"))),
    }).drop("_t", "_numbers")


def annotate_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (form_id, row_idx, item, kind, headers: array of int, cells) with what the catalog says of each: match and trust, style, letter sizes, shift, sizes that the product lacks. The item is never changed.

    Scores are held against their bounds as they are and rounded to one digit for the result. A match too weak to show says nothing of styles and sizes.
    """
    by_name = catalog.groupBy("bname").agg(F.sort_array(F.collect_set(F.when(F.trim("bstyle") != "", F.col("bstyle")))).alias("styles"), F.sort_array(F.collect_set(F.col("bsize").cast("int"))).alias("catalog_sizes"))
    matches = match_trust(best_catalog_match(rows.select("item"), catalog)).join(by_name, "bname")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    joined = rows.join(matches, "item", "left").withColumns({"shown": F.coalesce("shown", F.lit(False)), "trusted": F.coalesce("trusted", F.lit(False)), "catalog_sizes": none("catalog_sizes", "int")})
    joined = joined.withColumns({"trusted": F.col("trusted") & F.col("shown"), "styles": F.when(F.col("shown"), none("styles", "string")).otherwise(F.array().cast("array<string>"))})
    told = apply_letter_sizes(fill_or_check_style(joined))
    numbers = F.transform(F.filter("cells", lambda c: c["size"].rlike("^[0-9]+$")), lambda c: c["size"].cast("int"))
    told = detect_column_shift(told.withColumn("sizes", numbers)).withColumn("offset", F.when(F.col("trusted"), F.col("offset")))
    outside = F.when(F.col("trusted"), sizes_outside_catalog(F.transform("cells", lambda c: c["size"]), F.col("catalog_sizes").cast("array<string>")))
    seen = lambda c: F.when(F.col("shown"), F.col(c)).alias(c)
    return told.select("form_id", "row_idx", "item", "kind", F.when(F.col("shown"), F.col("bname")).alias("suggestion"), F.round("score", 1).alias("score"), "code_narrowed", "pool", "unmatched_code", "trusted", "style_mismatch", "cells", seen("unresolved"), seen("conflicts"), "offset", outside.alias("outside"))


def bind_products(rows: DataFrame, matches: DataFrame, products: DataFrame) -> DataFrame:
    """rows (row_id, item, style, sizes: array of string) with bsid, auto_bound, size_mismatch and candidates (at most 8 bsid).

    matches: as best_catalog_match with match_trust. products: (bsid, bname, bstyle, sizes: array of string), one row each.
    Candidates are the products of the matched name, of the row's style if any has it, then the 40 best of a search for name and style. The first twelve, by style miss, size
    miss and place, are shown. Route 1 binds a trusted match's only product, or its only one of the style. Route 2 binds the only one of the candidates that has the
    style and all of two ordered sizes or more, and whose name scores 70 or more and within 8 of the best.
    """
    listed = written(ordered_keys(products, "bname", "bsid"), "products")
    style = F.lower(F.trim(F.coalesce("style", F.lit(""))))
    rows = written(rows.select("row_id", "item", style.alias("_style"), "sizes"), "rows")
    own = listed.select("ord", "bsid", F.lower("bname").alias("_name"), F.col("bname"), F.lower(F.coalesce("bstyle", F.lit(""))).alias("_bstyle"), F.col("sizes").alias("has"))
    named = rows.join(matches.select("item", F.lower("bname").alias("_name"), "trusted"), "item").join(own, "_name").withColumn("styled", (F.col("_style") != "") & (F.col("_style") == F.col("_bstyle")))
    any_styled = F.max("styled").over(Window.partitionBy("row_id"))
    named = named.withColumn("_any", any_styled).where("styled or not _any").select("row_id", "ord", F.lit(0).alias("source"), F.col("ord").alias("place"), "trusted")
    texts = rows.withColumn("text", F.trim(F.concat_ws(" ", "item", "_style")))
    hits = ranked_search(texts, listed.select("ord", F.trim(F.concat_ws(" ", "bname", "bstyle")).alias("key")), 40)
    searched = texts.where("text <> ''").join(hits, "text").select("row_id", "ord", F.lit(1).alias("source"), F.col("rank").cast("long").alias("place"), F.lit(False).alias("trusted"))
    pool = named.unionByName(searched).groupBy("row_id", "ord").agg(F.min(F.struct("source", "place")).alias("at"), F.max("trusted").alias("trusted"))
    pool = pool.join(own, "ord").join(rows, "row_id").withColumn("styled", (F.col("_style") != "") & (F.col("_style") == F.col("_bstyle"))).withColumn("covers", F.size(F.array_except("sizes", "has")) == 0)
    pool = pool.withColumn("pos", F.row_number().over(Window.partitionBy("row_id").orderBy("at")))
    pool = written(pool.withColumn("name", fuzzy.token_set_ratio(likeness_form(F.col("item")), likeness_form(F.col("bname")))), "pool")
    first = pool.where("at.source = 0 and trusted")
    one = first.groupBy("row_id").agg(F.when(F.count("*") == 1, F.max("bsid")).when(F.count_if("styled") == 1, F.max(F.when(F.col("styled"), F.col("bsid")))).alias("route1"))
    best = F.max("name").over(Window.partitionBy("row_id"))
    fit = pool.withColumn("best", best).where((F.col("best") >= SUGGESTED) & (F.col("name") >= F.col("best") - BAND) & F.col("styled") & F.col("covers") & (F.size("sizes") >= 2))
    two = fit.groupBy("row_id").agg(F.when(F.count("*") == 1, F.max("bsid")).alias("route2"))
    miss = F.struct(((F.col("_style") != "") & ~F.col("styled")).alias("s"), (~F.col("covers")).alias("c"), "pos", "bsid")
    short = pool.where("pos <= 12").groupBy("row_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(miss)), lambda x: x["bsid"]), 1, 8).alias("candidates"))
    out = rows.join(one, "row_id", "left").join(two, "row_id", "left").join(short, "row_id", "left").withColumn("bsid", F.coalesce("route1", "route2"))
    out = out.join(listed.select("bsid", F.col("sizes").alias("has")), "bsid", "left")
    mismatch = F.when(F.col("bsid").isNotNull(), sort_sizes(F.array_except("sizes", "has")))
    shown = F.coalesce("candidates", F.array().cast("array<string>"))
    forced = F.when(F.col("bsid").isNull() | F.array_contains(shown, F.col("bsid")), shown).otherwise(F.slice(F.concat(F.array("bsid"), shown), 1, 8))
    return out.select("row_id", "bsid", (F.size(mismatch) == 0).alias("auto_bound"), mismatch.alias("size_mismatch"), forced.alias("candidates"))
