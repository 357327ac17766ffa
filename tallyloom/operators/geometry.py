"""OCR tokens of forms to the marks of their rows and columns.

tokens: (form_id, token_id, text, x0, y0, x1, y1, score), boxes in pixels. A form is a page, so what is gathered by form
is bounded by what a page holds; joins are by form_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.functions.text import correct_lookalike_digits, merged_header_centres, split_merged_headers, split_merged_qty

#: Letter sizes in their order, and texts of a dash.
LETTERS = ("XS", "S", "M", "L", "XL", "XXL", "3XL", "4XL")
LABELS = (*LETTERS, "2XL")
DASHES = ("一", "-")
#: Least score, pixels within which marks are the same, least height of a header band, most of a quantity.
SURE, SAME, BAND, MOST = 0.5, 15.0, 15.0, 500


def _x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def _y() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def locate_headers(tokens: DataFrame, headers: DataFrame, share: float = 0.6) -> DataFrame:
    """The first sure token of each printed size header (form_id, size): form_id, size, x, y0, y1. Forms with less than `share` of theirs found go.

    Headers that were read as one token are taken apart where only one cut into headers of the form is possible and the token's middle lies no further than half the height
    of the headers found (15 pixels at least) above or below them; those that were found by themselves stay where they are.
    """
    wanted = headers.groupBy("form_id").agg(F.collect_set("size").alias("_w"))
    read = F.struct("token_id", "text", "x0", "x1", "y0", "y1")
    page = tokens.where((F.col("score") >= SURE) & F.col("text").isNotNull()).groupBy("form_id").agg(F.array_sort(F.collect_list(read)).alias("_t")).join(wanted, "form_id")
    page = page.withColumn("_f", F.transform("_w", lambda w: F.struct(w.alias("size"), F.get(F.filter("_t", lambda t: t["text"] == w), 0).alias("t"))))
    top, bottom = F.array_min(F.transform("_f", lambda f: f["t"]["y0"])), F.array_max(F.transform("_f", lambda f: f["t"]["y1"]))
    page = page.withColumns({"_top": top, "_bottom": bottom})
    margin = F.greatest(F.col("_bottom") - F.col("_top"), F.lit(BAND)) * 0.5
    level = lambda t: ((t["y0"] + t["y1"]) / 2).between(F.col("_top") - margin, F.col("_bottom") + margin)
    fused = F.filter("_t", lambda t: t["text"].rlike("^[0-9]{2,}$") & ~F.array_contains("_w", t["text"]) & level(t))
    each = page.select("form_id", "_w", "_f", F.posexplode_outer(fused).alias("_k", "t"))
    parts = merged_header_centres(split_merged_headers(F.col("t.text"), F.col("_w")), F.col("t.x0"), F.col("t.x1"))
    parts = F.transform(parts, lambda p: F.struct(p["size"].alias("size"), F.struct(p["x"].alias("x"), F.col("t.y0").alias("y0"), F.col("t.y1").alias("y1")).alias("box")))
    forms = each.withColumn("_p", parts).groupBy("form_id").agg(F.first("_f").alias("_f"), F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_k", "_p")))).alias("_p"))
    forms = forms.withColumn("_p", F.flatten(F.transform("_p", lambda p: p["_p"])))
    own = lambda t: F.when(t.isNotNull(), F.struct(((t["x0"] + t["x1"]) / 2).alias("x"), t["y0"].alias("y0"), t["y1"].alias("y1")))
    box = lambda f: F.coalesce(own(f["t"]), F.get(F.filter("_p", lambda p: p["size"] == f["size"]), 0)["box"])
    forms = forms.select("form_id", F.transform("_f", lambda f: F.struct(f["size"].alias("size"), box(f).alias("box"))).alias("_f")).withColumn("_all", F.size("_f"))
    forms = forms.withColumn("_f", F.filter("_f", lambda f: f["box"].isNotNull())).where(F.size("_f") >= share * F.col("_all"))
    return forms.select("form_id", F.explode("_f").alias("f")).select("form_id", "f.size", "f.box.x", "f.box.y0", "f.box.y1")


def cluster_gap(items: DataFrame) -> DataFrame:
    """(form_id, gap) of the gap, in pixels, that parts rows of marks: 0.6 of the mean distance of the items' middles (form_id, y), but 8 at least and 20 at most; 20 for one item."""
    mean = (F.max("y") - F.min("y")) / (F.count("y") - 1)
    return items.groupBy("form_id").agg(F.when(F.count("y") >= 2, F.greatest(F.least(mean * 0.6, F.lit(20.0)), F.lit(8.0))).otherwise(20.0).alias("gap"))


def header_bands(located: DataFrame) -> DataFrame:
    """Per form: its header places in order (xs), their spacing, floor and ceiling of x, the bottom of the header row and its height (band). One header has spacing 0."""
    ends = located.groupBy("form_id").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.max("y1").alias("bottom"), F.greatest(F.max("y1") - F.min("y0"), F.lit(BAND)).alias("band"))
    first, last = F.element_at("xs", 1), F.element_at("xs", -1)
    spaced = ends.withColumn("spacing", (last - first) / F.greatest(F.size("xs") - 1, F.lit(1)))
    return spaced.withColumns({"floor": first - 0.6 * F.col("spacing"), "ceiling": last + 0.6 * F.col("spacing")})


def _placed(tokens: DataFrame, bands: DataFrame, more: Column) -> DataFrame:
    """Tokens with their form's band, whose middle lies below the header row and between the ends of the columns."""
    return tokens.join(bands, "form_id").where((_y() > F.col("bottom")) & _x().between(F.col("floor"), F.col("ceiling")) & more)


def skip_decoy_bands(tokens: DataFrame, bands: DataFrame, most: int = 3) -> DataFrame:
    """bands with the bottom moved past up to `most` further lines of labels: bands of 1.3 times the header's height with a sure token within 0.4 spacings of 85 % of the headers."""
    placed = _placed(tokens, bands, F.col("score") >= SURE).select("form_id", F.struct(_x().alias("x"), _y().alias("y"), "y1").alias("t"))
    bands = bands.join(placed.groupBy("form_id").agg(F.collect_list("t").alias("_t")), "form_id", "left")
    for _ in range(most):  # where a band is no line of labels, the next pass finds the same
        bands = bands.withColumn("_in", F.filter("_t", lambda t: (t["y"] > F.col("bottom")) & (t["y"] <= F.col("bottom") + 1.3 * F.col("band"))))
        near = F.filter("xs", lambda h: F.exists("_in", lambda t: F.abs(h - t["x"]) <= 0.4 * F.col("spacing")))
        labels = F.size(near) >= 0.85 * F.size("xs")
        bands = bands.withColumn("bottom", F.when(labels, F.array_max(F.transform("_in", lambda t: t["y1"]))).otherwise(F.col("bottom")))
    return bands.drop("_t", "_in")


def candidate_marks(tokens: DataFrame, bands: DataFrame) -> DataFrame:
    """Sure quantities in the data area: form_id, token_id, part, qty, x, y. A number above 500 is two that were read as one, at a quarter and three quarters by their digits, or goes."""
    placed = _placed(tokens, bands, F.col("score") >= SURE)
    digits = F.col("text").rlike("^[0-9]+$")
    qty = F.when(digits, F.coalesce(F.col("text").try_cast("long"), F.lit(MOST + 1))).otherwise(correct_lookalike_digits(F.col("text")).cast("long"))
    two, width = split_merged_qty(F.col("text"), MOST), F.col("x1") - F.col("x0")
    left = F.length(two[0].cast("string")) / F.length("text")
    pair = F.array(F.struct(two[0].alias("qty"), (F.col("x0") + width * left / 2).alias("x")), F.struct(two[1].alias("qty"), (F.col("x0") + width * (1 + left) / 2).alias("x")))
    one = F.array(F.struct(F.col("_q").cast("int").alias("qty"), _x().alias("x")))
    marks = F.when(F.col("_q").between(1, MOST), one).when((F.col("_q") > MOST) & two.isNotNull(), pair)
    return placed.withColumn("_q", qty).select("form_id", "token_id", _y().alias("y"), F.posexplode(marks).alias("part", "m")).select("form_id", "token_id", "part", "m.qty", "m.x", "y")


def drop_label_duplicates(marks: DataFrame, located: DataFrame) -> DataFrame:
    """Marks without those that are a header's own text within 15 pixels of it."""
    labels = located.groupBy("form_id").agg(F.collect_list(F.struct("size", "x")).alias("_l"))
    same = F.exists("_l", lambda h: (F.col("qty").cast("string") == h["size"]) & (F.abs(F.col("x") - h["x"]) <= SAME))
    return marks.join(labels, "form_id", "left").where(~F.coalesce(same, F.lit(False))).select(*marks.columns)


def low_confidence_worklist(tokens: DataFrame, bands: DataFrame, marks: DataFrame) -> DataFrame:
    """Unsure tokens of the data area to be read again (form_id, token_id, text, x, y): no dashes, none in a column with a dash, none where a mark is known."""
    text = F.coalesce("text", F.lit(""))
    unsure = _placed(tokens, bands, (F.col("score") < SURE) & ~text.isin("", *DASHES)).select("form_id", "token_id", "text", _x().alias("x"), _y().alias("y"), "spacing")
    dashes = tokens.where((F.col("score") >= 0.3) & F.col("text").isin(*DASHES)).join(bands.select("form_id", "bottom"), "form_id").where("y0 > bottom").select("form_id", _x().alias("_dx")).distinct()
    known = marks.select("form_id", F.col("x").alias("_mx"), F.col("y").alias("_my"))
    open_columns = unsure.join(dashes, (unsure["form_id"] == dashes["form_id"]) & (F.abs(unsure["x"] - dashes["_dx"]) <= 0.4 * unsure["spacing"]), "left_anti")
    new = (open_columns["form_id"] == known["form_id"]) & (F.abs(open_columns["x"] - known["_mx"]) <= SAME) & (F.abs(open_columns["y"] - known["_my"]) <= SAME)
    return open_columns.join(known, new, "left_anti").drop("spacing")


def telling_words(name: Column) -> Column:
    """Words of three Latin letters or more, in capitals, and codes of three digits or more."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(name, F.lit(""))), F.lit("([A-Z]{3,}|[0-9]{3,})"), 1))


def item_name_y(rows: DataFrame, tokens: DataFrame, bands: DataFrame, most: float = 60.0) -> DataFrame:
    """rows (form_id, row_idx, item) with name_y: the mean height of the sure tokens left of the columns that hold a telling word of the item; null without, or if they spread over more than `most` pixels."""
    left = tokens.where(F.col("score") >= SURE).join(bands.select("form_id", "floor", "bottom"), "form_id").where((_x() < F.col("floor")) & (F.col("y0") > F.col("bottom")))
    names = left.groupBy("form_id").agg(F.collect_list(F.struct(F.upper("text").alias("text"), _y().alias("y"))).alias("_names"))
    named = rows.join(names, "form_id", "left").withColumn("_words", telling_words(F.col("item")))
    heights = F.transform(F.filter("_names", lambda n: F.exists("_words", lambda w: F.contains(n["text"], w))), lambda n: n["y"])
    named = named.withColumn("_ys", heights)
    mean = F.aggregate("_ys", F.lit(0.0), lambda total, y: total + y) / F.size("_ys")
    return named.withColumn("name_y", F.when((F.size("_ys") > 0) & (F.array_max("_ys") - F.array_min("_ys") <= most), mean)).select(*rows.columns, "name_y")


def name_matches(seen: Column, expected: Column) -> Column:
    """Whether what was read may be the expected name: nothing was read, there is no word of three letters to look for, or one is in it."""
    words = F.regexp_extract_all(F.upper(F.coalesce(expected, F.lit(""))), F.lit("([A-Z]{3,})"), 1)
    return (F.coalesce(seen, F.lit("")) == "") | (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.upper(seen), w))


def least_in_order(*costs: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of many tables (k, rows, columns) at once, the column of each row, in order and one each, with the least sum of costs, and that sum. There are as many columns as rows or more.

    Several costs are compared one after the other. Of equal sums the one with the earlier columns counts.
    """
    k, rows, columns = costs[0].shape
    zero = tuple(np.zeros(k, c.dtype) for c in costs)
    # least[j]: the least sums of the rows so far on the first j columns, or none yet where they do not fit
    least: list[tuple[np.ndarray, ...] | None] = [zero] * (columns + 1)
    last = np.zeros((rows, k, columns + 1), np.int64)  # the last column at or before j that is taken
    for i in range(rows):
        now: list[tuple[np.ndarray, ...] | None] = [None]
        for j in range(1, columns + 1):
            left, before = now[-1], least[j - 1]
            on = None if before is None else tuple(b + c[:, i, j - 1] for b, c in zip(before, costs))
            if on is None or left is None:
                better = np.full(k, on is not None)
                now.append(on if left is None else left)
            else:
                better, same = np.zeros(k, bool), np.ones(k, bool)
                for x, y in zip(on, left):
                    better |= same & (x < y)
                    same &= x == y
                now.append(tuple(np.where(better, x, y) for x, y in zip(on, left)))
            last[i, :, j] = np.where(better, j, last[i, :, j - 1])
        least = now
    at, j = np.zeros((k, rows), np.int64), np.full(k, columns)
    for i in range(rows - 1, -1, -1):
        j = last[i, np.arange(k), j] - 1
        at[:, i] = j
    return at, least[-1]


def _by_shape(left: pd.Series, right: pd.Series) -> Iterator[tuple[list[int], int]]:
    """Places of the rows whose arrays have the same two lengths, none of the left being empty or longer than the right, with the left length."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(left, right)):
        if 0 < len(a) <= len(b):
            groups.setdefault((len(a), len(b)), []).append(i)
    for (m, _), places in groups.items():
        yield places, m


def _nearest_in_order(marks: pd.Series, headers: pd.Series) -> pd.DataFrame:
    """For each row its marks' headers, in order and one each, with the least sum of distances, and the mean distance; rows of the same numbers of both are solved at once."""
    out = [(None, None)] * len(marks)
    for places, m in _by_shape(marks, headers):
        x, h = (np.array([s.iloc[i] for i in places], np.float64) for s in (marks, headers))
        at, (cost,) = least_in_order(np.abs(x[:, :, None] - h[:, None, :]))
        for i, a, c in zip(places, at.tolist(), (cost / m).tolist()):
            out[i] = a, c
    return pd.DataFrame(out, columns=["at", "cost"])


def assign_marks_to_headers(marks: DataFrame, located: DataFrame, most: float = 0.6) -> DataFrame:
    """marks (form_id, row_idx, x, qty) with the size of their header and the row's mean distance (cost).

    In a row marks keep their order and no two share a header; the sum of distances is the least. A row with more marks than headers, or with
    a mean distance above `most` spacings, goes. Rows meet their form's headers as arrays of what a page holds.
    """
    columns = located.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("x", "size"))).alias("_h"))
    lines = marks.groupBy("form_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("x", "qty"))).alias("_m")).join(columns, "form_id")
    spacing = (F.element_at("_h", -1)["x"] - F.element_at("_h", 1)["x"]) / F.greatest(F.size("_h") - 1, F.lit(1))
    solved = lines.withColumn("_a", pandas_udf(_nearest_in_order, "at array<int>, cost double")(F.col("_m.x"), F.col("_h.x"))).where(F.col("_a.at").isNotNull() & (F.col("_a.cost") <= most * spacing))
    cells = solved.select("form_id", "row_idx", F.col("_a.cost").alias("cost"), "_h", F.explode(F.arrays_zip(F.col("_m").alias("m"), F.col("_a.at").alias("at"))).alias("c"))
    return cells.select("form_id", "row_idx", F.get("_h", F.col("c.at"))["size"].alias("size"), F.col("c.m.qty").alias("qty"), F.col("c.m.x").alias("x"), "cost")


def infer_letter_columns(columns: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """Letters of a group's columns (form_id, group_id, x), from XS on, by those that were read (form_id, group_id, letter, x) within `tolerance` of a column.

    A group without an anchor, whose anchors disagree, or that runs off the list has no rows.
    """
    group = ["form_id", "group_id"]
    placed = columns.select(*group, "x").withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy("x")) - 1)
    order = F.array_position(F.array(*map(F.lit, LETTERS)), F.col("letter")).cast("int") - 1
    read = anchors.where(F.col("letter").isin(*LETTERS)).select(*group, "letter", F.col("x").alias("_ax"))
    nearest = read.join(placed, group).groupBy(*group, "letter", "_ax").agg(F.min(F.struct(F.abs(F.col("x") - F.col("_ax")).alias("d"), "pos")).alias("n")).where(F.col("n.d") <= tolerance)
    offsets = nearest.groupBy(*group).agg(F.min(order - F.col("n.pos")).alias("_a"), F.max(order - F.col("n.pos")).alias("_b")).where("_a = _b and _a >= 0")
    sized = offsets.join(placed.groupBy(*group).agg(F.count("*").alias("_n")), group).where(F.col("_a") + F.col("_n") <= len(LETTERS))
    return placed.join(sized.select(*group, "_a"), group).select(*group, "x", F.get(F.array(*map(F.lit, LETTERS)), F.col("pos") + F.col("_a")).alias("letter"))


def score_grid_candidates(candidates: DataFrame) -> DataFrame:
    """Of a form's candidates (form_id, candidate, headers, found, rows, aligned) with 70 % of the headers and half of the rows, that with most aligned rows, the first of equals."""
    good = candidates.where((F.col("found") >= 0.7 * F.col("headers")) & (F.col("aligned") >= 0.5 * F.col("rows")))
    best = good.withColumn("_n", F.row_number().over(Window.partitionBy("form_id").orderBy(F.desc("aligned"), "candidate")))
    return best.where("_n = 1").drop("_n")


def interpolate_row_fracs(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows (form_id, row_idx from 0) with top and bottom: an even share of their table (form_id, top_frac, bottom_frac, header_rows, body_rows) below its header rows."""
    unit = (F.col("bottom_frac") - F.col("top_frac")) / (F.greatest("header_rows", F.lit(0)) + F.greatest("body_rows", F.lit(1)))
    edge = lambda n: F.col("top_frac") + unit * (F.col("header_rows") + F.col("row_idx") + n)
    return rows.join(tables, "form_id").withColumns({"top": edge(0), "bottom": edge(1)}).drop("top_frac", "bottom_frac", "header_rows", "body_rows")


def pick_item_table(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Of a form's tables, by their header cells (form_id, table_idx, cell), that with most of the printed sizes (form_id, size) as a cell or its first word; the first of equals."""
    word = F.split(F.trim("cell"), r"\s+")
    texts = cells.select("form_id", "table_idx", F.explode(F.array_distinct(F.array(F.trim("cell"), word[0]))).alias("size"))
    hits = texts.join(headers.select("form_id", "size", F.lit(1).alias("_hit")).distinct(), ["form_id", "size"], "left")
    counts = hits.groupBy("form_id", "table_idx").agg(F.count_distinct(F.when(F.col("_hit") == 1, F.col("size"))).alias("found"))
    return counts.groupBy("form_id").agg(F.max_by(F.struct("table_idx", "found"), F.struct("found", -F.col("table_idx"))).alias("b")).select("form_id", "b.table_idx", "b.found")


def fill_collapsed_names(rows: DataFrame) -> DataFrame:
    """rows (item, kind, label): an item that is blank or the same as its kind takes the label without a leading number, unless that is blank too."""
    item, label = F.trim(F.coalesce("item", F.lit(""))), F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"^\d+\.\s*", ""))
    collapsed = (item == "") | (F.lower(item) == F.lower(F.trim(F.coalesce("kind", F.lit("")))))
    return rows.withColumn("item", F.when(collapsed & (label != ""), label).otherwise(F.col("item")))


def overflow_columns(tokens: DataFrame, bands: DataFrame, located: DataFrame, sizes: DataFrame, centres: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns written behind the last printed one: their headers (form_id, size, x, bottom) and their marks (form_id, token_id, part, qty, x, y).

    A label is a sure number of the catalog's sizes (size), no header, up to 1.2 spacings right of the columns, with a quantity below it (0.3 spacings in x, 1.5
    bands in y; the first by token_id). Where over half the form's rows (centres: form_id, row_idx, y) have a number within a spacing, it is no label. Its quantity, and
    what stands below the label in its column, are marks, in their order; those within 15 pixels of a known one, or of one before, go. A form's tokens meet as an array.
    """
    digits = F.col("text").rlike("^[0-9]+$")
    number = F.when(digits, F.col("text").try_cast("long"))
    read = F.struct("token_id", "text", _x().alias("x"), _y().alias("y"), "y0", "y1", number.alias("n"), F.when(digits, number).otherwise(correct_lookalike_digits(F.col("text")).cast("long")).alias("qty"))
    listed = lambda df, name, item: df.groupBy("form_id").agg(F.collect_list(item).alias(name))
    page = tokens.where(F.col("score") >= SURE).groupBy("form_id").agg(F.array_sort(F.collect_list(read)).alias("_t"))
    page = page.join(bands.select("form_id", "bottom", "band", "spacing", "ceiling"), "form_id").join(listed(located, "_h", F.col("size")), "form_id")
    right = F.filter("_t", lambda t: t["n"].isNotNull() & (t["y0"] > F.col("bottom")) & (t["x"] > F.col("ceiling")) & (t["x"] <= F.col("ceiling") + 1.2 * F.col("spacing")) & ~F.array_contains("_h", t["text"]))
    known = sizes.select(F.col("size").cast("string").alias("_size")).distinct()
    labels = page.withColumn("l", F.explode(right)).withColumn("_size", F.col("l.text")).join(known, "_size", "left_semi")
    labels = labels.join(listed(centres, "_c", F.col("y")), "form_id", "left").join(listed(marks, "_m", F.struct("x", "y")), "form_id", "left")

    label = F.col("l")
    below = F.filter("_t", lambda t: t["n"].isNotNull() & (F.abs(t["x"] - label["x"]) <= 0.3 * F.col("spacing")) & (t["y"] > label["y"]) & (t["y"] - label["y"] <= 1.5 * F.col("band")))
    filled = F.filter("_c", lambda c: F.exists("_t", lambda t: t["n"].isNotNull() & (F.abs(t["y"] - c) <= F.col("band")) & (F.abs(t["x"] - label["x"]) <= F.col("spacing"))))
    rows = F.coalesce(F.size("_c"), F.lit(0))
    good = labels.withColumn("_q", F.get(below, 0)).where(F.col("_q.n").between(1, MOST) & ((rows <= 0) | (F.size(filled) <= 0.5 * rows)))
    first = good.groupBy("form_id", "_size").agg(F.min_by(F.struct("l", "_q", "spacing", "_t", "_m"), "l.token_id").alias("g")).select("form_id", "_size", "g.*")

    form = first.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct(F.col("l.token_id").alias("at"), "l", "_q"))).alias("_f"), *(F.first(c).alias(c) for c in ("spacing", "_t", "_m")))
    mark = lambda t: F.struct(t["token_id"].alias("token_id"), t["qty"].cast("int").alias("qty"), t["x"].alias("x"), t["y"].alias("y"))
    inside = lambda f: F.transform(F.filter("_t", lambda t: (t["y0"] > f["l"]["y1"]) & (F.abs(t["x"] - f["l"]["x"]) <= 0.3 * F.col("spacing")) & t["qty"].between(1, MOST)), mark)
    near = lambda t: lambda m: (F.abs(m["x"] - t["x"]) <= SAME) & (F.abs(m["y"] - t["y"]) <= SAME)
    held = F.transform("_f", lambda f: mark(f["_q"]))
    new = lambda t: ~F.coalesce(F.exists("_m", near(t)), F.lit(False))
    added = F.aggregate(F.filter(F.flatten(F.transform("_f", inside)), new), held, lambda done, t: F.when(F.exists(done, near(t)), done).otherwise(F.concat(done, F.array(t))))
    found = form.select("form_id", F.explode(added).alias("m")).select("form_id", "m.token_id", F.lit(0).alias("part"), "m.qty", "m.x", "m.y")
    return first.select("form_id", F.col("_size").alias("size"), "l.x", F.col("l.y1").alias("bottom")), found


def recover_centres(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows (form_id, row_idx, center, top, bottom, name_y; shares of the page's height) with center mended.

    The height of its name counts where that is known. Else a center that a neighbour has too is no measurement: rows then share the height of the table
    (form_id, top_frac, bottom_frac) by their own heights, the middle one of the trusted heights for those without, if three can be trusted.
    """
    page, line = Window.partitionBy("form_id"), Window.partitionBy("form_id").orderBy("row_idx")
    same = lambda other: F.coalesce(F.abs(other - F.col("center")) < 1e-6, F.lit(False))
    placed = rows.join(tables.select("form_id", "top_frac", "bottom_frac"), "form_id", "left").withColumn("_tied", same(F.lag("center").over(line)) | same(F.lead("center").over(line)))
    height = F.col("bottom") - F.col("top")
    placed = placed.withColumn("_h", F.when(~F.col("_tied") & (height > 0), height))
    placed = placed.withColumn("_all", F.sort_array(F.collect_list("_h").over(page)))
    typical = F.get("_all", F.floor(F.size("_all") / 2).cast("int"))
    placed = placed.withColumn("_w", F.coalesce("_h", typical))
    upto = F.sum("_w").over(line.rowsBetween(Window.unboundedPreceding, 0))
    share = F.col("top_frac") + (upto - F.col("_w") / 2) * (F.col("bottom_frac") - F.col("top_frac")) / F.sum("_w").over(page)
    may = (F.size("_all") >= 3) & (F.col("top_frac") >= 0) & (F.col("top_frac") < F.col("bottom_frac")) & (F.col("bottom_frac") <= 1)
    return placed.withColumn("center", F.when(F.col("name_y").isNotNull(), F.col("name_y")).when(F.col("_tied") & may, share).otherwise(F.col("center"))).drop("_tied", "_h", "_all", "_w", "top_frac", "bottom_frac")


def _clusters_in_order(clusters: pd.Series, rows: pd.Series) -> pd.Series:
    """For each form the place of each cluster's row; forms of the same numbers of both are solved at once."""
    out: list[list[int] | None] = [[] if not len(c) else None for c in clusters]
    for places, _ in _by_shape(clusters, rows):
        taken = lambda s, f: np.array([[f(e) for e in s.iloc[i]] for i in places])  # noqa: B023, E731
        y, qty = taken(clusters, lambda c: c["y"]), taken(clusters, lambda c: c["qty"])
        at_y, total, blank = taken(rows, lambda r: r["y"]), taken(rows, lambda r: r["total"] or 0), taken(rows, lambda r: r["total"] is None)
        void = blank & (2 * blank.sum(1, keepdims=True) < blank.shape[1])
        fits = (qty[:, :, None] == total[:, None, :]) & ~blank[:, None, :]
        shape = fits.shape
        at, _ = least_in_order(-fits.astype(np.int64), np.broadcast_to(void[:, None, :], shape).astype(np.int64), np.abs(y[:, :, None] - at_y[:, None, :]).astype(np.float64))
        for i, a in zip(places, at.tolist()):
            out[i] = a
    return pd.Series(out, dtype=object)


def assign_clusters_to_rows(clusters: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of marks (form_id, cluster, y, qty: their sum) with row_idx, and the rows (form_id, row_idx) that are taken for empty.

    rows: form_id, row_idx, y, total (null: none is printed). In order, one cluster a row: as many sums as can be that are the row's total, then as few rows that may be void, then
    the least distance. Rows without a total may be void where under half of the form's rows lack one; those that get no cluster are empty. A form with more clusters than rows goes.
    """
    page = rows.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "y", F.col("total").cast("long").alias("total")))).alias("_r"))
    found = clusters.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("y", "cluster", F.col("qty").cast("long").alias("qty")))).alias("_c")).join(page, "form_id")
    solved = found.withColumn("_a", pandas_udf(_clusters_in_order, "array<int>")("_c", "_r")).where("_a is not null")
    each = solved.select("form_id", "_r", F.explode(F.arrays_zip(F.col("_c").alias("c"), F.col("_a").alias("at"))).alias("e"))
    given = each.select("form_id", F.col("e.c.cluster").alias("cluster"), F.col("e.c.y").alias("y"), F.col("e.c.qty").alias("qty"), F.get("_r", F.col("e.at"))["row_idx"].alias("row_idx"))
    blank = F.filter("_r", lambda r: r["total"].isNull())
    rest = F.filter(F.transform("_r", lambda r, i: F.struct(r["row_idx"].alias("row_idx"), (r["total"].isNull() & ~F.array_contains("_a", i)).alias("void"))), lambda r: r["void"])
    empty = solved.where(F.size(blank) < 0.5 * F.size("_r")).select("form_id", F.explode(rest).alias("r")).select("form_id", "r.row_idx")
    return given, empty


def calibrate_drift(marks: DataFrame, located: DataFrame, rows: DataFrame, sure: float = 12.0) -> DataFrame:
    """(form_id, a, b): how far marks (form_id, row_idx, x, qty) lie right of their headers, a * y + b, at a row's height y (rows: form_id, row_idx, y; a share of the page's).

    Fitted to the rows whose marks lie within `sure` pixels of their headers in the mean; forms with fewer than three, or with these within 0.08 of the height, go. Drift
    that grows down the page brings marks near the next headers in the end: where rows that are not sure are followed by a sure one whose distance differs
    by more than `sure` from that of the last sure row above, that row and those below it do not count.
    """
    first = assign_marks_to_headers(marks, located, float("inf")).join(located.select("form_id", "size", F.col("x").alias("_hx")), ["form_id", "size"])
    offsets = first.groupBy("form_id", "row_idx").agg(F.avg(F.col("x") - F.col("_hx")).alias("_off"), (F.max("cost") < sure).alias("_sure")).join(rows.select("form_id", "row_idx", "y"), ["form_id", "row_idx"])
    page = Window.partitionBy("form_id").orderBy("y", "row_idx")
    before = F.last(F.when(F.col("_sure"), F.col("_off")), ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    turned = F.col("_sure") & ~F.lag("_sure").over(page) & (F.abs(F.col("_off") - before) > sure)
    points = offsets.withColumn("_turned", F.coalesce(turned, F.lit(False)))
    points = points.withColumn("_turned", F.max("_turned").over(page.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sure") & ~F.col("_turned"))
    fitted = points.groupBy("form_id").agg(F.count("*").alias("_n"), (F.max("y") - F.min("y")).alias("_spread"), F.regr_slope("_off", "y").alias("a"), F.regr_intercept("_off", "y").alias("b"))
    return fitted.where("_n >= 3 and _spread >= 0.08").select("form_id", "a", "b")


def assign_with_drift(marks: DataFrame, located: DataFrame, rows: DataFrame) -> DataFrame:
    """assign_marks_to_headers once more, after marks have moved back by their form's drift; x stays as it was."""
    drift = calibrate_drift(marks, located, rows)
    shift = F.coalesce(F.col("a") * F.col("y") + F.col("b"), F.lit(0.0))
    moved = marks.join(rows.select("form_id", "row_idx", "y"), ["form_id", "row_idx"], "left").join(drift, "form_id", "left").select("form_id", "row_idx", (F.col("x") - shift).alias("x"), "qty")
    shifts = rows.join(drift, "form_id").select("form_id", "row_idx", shift.alias("_shift"))
    placed = assign_marks_to_headers(moved, located, float("inf")).join(shifts, ["form_id", "row_idx"], "left")
    return placed.withColumn("x", F.col("x") + F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def _labelled(pages: pd.Series, bounds: pd.DataFrame) -> pd.Series:
    """For each form (row_idx, label, qty) of labels above their quantities, and of quantities below an earlier row's label."""

    def one(rows: list, floor: float, cutoff: float, spacing: float) -> list[dict]:
        out, known = [], {}
        for row in rows:
            tokens = [(t["text"], (t["x0"] + t["x1"]) / 2, t["y0"]) for t in row["tokens"]]
            beyond = lambda x: cutoff < x <= cutoff + spacing
            quantity = {i: int(t) for i, (t, _, _) in enumerate(tokens) if t.isdecimal() and 1 <= int(t) <= MOST}
            used, mine = set(), {}
            for i, (text, x, y) in enumerate(tokens):
                number = text.isdecimal() and len(text) <= 3 and beyond(x)
                letter = text.upper() in LABELS and floor <= x <= cutoff + spacing
                under = [(tokens[j][2], j) for j in quantity if j != i and j not in used and abs(tokens[j][1] - x) <= 0.25 * spacing and tokens[j][2] > y]
                if (number or letter) and under:
                    j = min(under)[1]
                    used |= {i, j}
                    label = text if number else text.upper()
                    mine[label] = quantity[j]
                    if label.isdecimal():
                        known.setdefault(label, x)
            free = {j: tokens[j][1] for j in quantity if j not in used and beyond(tokens[j][1])}
            for label, x in known.items():
                near = [(abs(at - x), j) for j, at in free.items() if abs(at - x) <= SAME]
                if label not in mine and near:
                    j = min(near)[1]
                    mine[label] = quantity[j]
                    del free[j]
            out += [{"row_idx": row["row_idx"], "size": label, "qty": qty} for label, qty in mine.items()]
        return out

    return pd.Series([one(p, f, c, s) for p, f, c, s in zip(pages, bounds["floor"], bounds["cutoff"], bounds["spacing"])])


def stacked_labels(tokens: DataFrame, bounds: DataFrame) -> DataFrame:
    """(form_id, row_idx, size, qty) of sizes that stand above their quantity in a row: numbers up to a spacing right of the columns, and letters anywhere.

    tokens: those of rows' bands below the header (form_id, row_idx, token_id, text, x0, y0, x1, y1, score); bounds: form_id, floor, cutoff, spacing. The quantity (1 to 500) is the
    nearest below within a quarter of a spacing, each used once. A number left over right of the columns takes the label that an earlier row has within 15 pixels. A form's rows go in order, as one array.
    """
    sure = tokens.where((F.col("score") >= SURE) & F.col("text").isNotNull())
    rows = sure.groupBy("form_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("token_id", "text", "x0", "x1", "y0"))).alias("tokens"))
    pages = rows.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "tokens"))).alias("_p")).join(bounds, "form_id")
    cells = pandas_udf(_labelled, "array<struct<row_idx:int,size:string,qty:int>>")("_p", F.struct("floor", "cutoff", "spacing"))
    return pages.select("form_id", F.explode(cells).alias("c")).select("form_id", "c.row_idx", "c.size", "c.qty")


def share_letter_columns(marks: DataFrame, letters: DataFrame, tolerance: float) -> DataFrame:
    """(form_id, row_idx, size, qty) of the rows from an anchor row down whose marks (form_id, row_idx, x, qty) all lie in its columns of letters (form_id, anchor_row, letter, x), if there are two or more.

    The first row without marks, or with one beyond `tolerance` of all columns, ends the group. Where groups meet, the lower anchor counts. Of marks of one letter the right one stays.
    """
    columns = letters.groupBy("form_id", "anchor_row").agg(F.collect_list(F.struct("x", "letter")).alias("_l"))
    met = marks.join(columns, "form_id").where("row_idx >= anchor_row")
    near = F.array_min(F.transform("_l", lambda c: F.struct(F.abs(c["x"] - F.col("x")).alias("d"), c["x"].alias("x"), c["letter"].alias("letter"))))
    met = met.withColumn("_n", near).select("form_id", "anchor_row", "row_idx", "x", "qty", F.col("_n.letter").alias("size"), (F.col("_n.d") <= tolerance).alias("_in"))
    group = Window.partitionBy("form_id", "anchor_row")
    rows = met.groupBy("form_id", "anchor_row", "row_idx").agg(F.bool_and("_in").alias("_in"))
    line = group.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(F.col("_in")).withColumn("_k", F.count("*").over(line)).where(F.col("row_idx") - F.col("anchor_row") + 1 == F.col("_k"))
    rows = rows.withColumn("_size", F.count("*").over(group)).where("_size >= 2")
    last = rows.groupBy("form_id", "row_idx").agg(F.max("anchor_row").alias("anchor_row"))
    return met.join(last, ["form_id", "row_idx", "anchor_row"]).groupBy("form_id", "row_idx", "size").agg(F.max_by("qty", "x").alias("qty"))


def recover_headers_by_order(tokens: DataFrame, headers: DataFrame, bottoms: DataFrame) -> DataFrame:
    """(form_id, size, x): places of headers (form_id, pos, size) by order alone, for forms of which not all are found by text.

    Numbers of three digits at most that end above the bottom of the header row (form_id, bottom) are taken from left to right if there are as many as headers; of
    more, those above their largest gap in height. Else the form goes.
    """
    line = Window.partitionBy("form_id").orderBy("y0", "token_id")
    wanted = headers.groupBy("form_id").agg(F.count("*").alias("_all"))
    numbers = tokens.where(F.col("text").rlike("^[0-9]{1,3}$")).join(bottoms.select("form_id", "bottom"), "form_id").where("y1 <= bottom").join(wanted, "form_id").withColumn("x", _x())
    page = Window.partitionBy("form_id")
    ranked = numbers.withColumns({"_k": F.row_number().over(line), "_gap": F.lead("y0").over(line) - F.col("y0"), "_found": F.count("*").over(page)})
    cut = F.max_by("_k", F.when(F.col("_gap").isNotNull(), F.struct("_gap", -F.col("_k")))).over(page)
    top = ranked.withColumn("_cut", F.when(F.col("_found") == F.col("_all"), F.col("_found")).when(F.col("_found") > F.col("_all"), cut)).where("_k <= _cut and _cut = _all")
    places = top.withColumn("_pos", F.row_number().over(page.orderBy("x", "token_id"))).select("form_id", "_pos", "x")
    order = headers.withColumn("_pos", F.row_number().over(page.orderBy("pos")))
    return order.join(places, ["form_id", "_pos"]).select("form_id", "size", "x")
