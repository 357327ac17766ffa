"""Column expressions over the texts of a reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The style codes that may stand behind an item's name.
STYLE_CODES = ("IE", "OE", "RN", "RNS")
#: How a name with a style code behind it looks, and a date.
_NAMED = r"^(.+?)\s+([A-Z]{2,4})$"
_DATE = r"\d{1,2}/\d{1,2}/\d{2,4}"


def split_style_code(item: Column, kind: Column) -> tuple[Column, Column]:
    """Item and type, after a known style code that stands for the item, or behind it, has moved to the type."""
    item, kind = F.trim(F.coalesce(item, F.lit(""))), F.trim(F.coalesce(kind, F.lit("")))
    name, code = F.regexp_extract(item, _NAMED, 1), F.regexp_extract(item, _NAMED, 2)
    alone = (kind == "") & item.isin(*STYLE_CODES)
    behind = (code != "") & (((kind == "") & code.isin(*STYLE_CODES)) | ((kind != "") & (code == kind)))
    return F.when(alone, "").when(behind, name).otherwise(item), F.when(alone, item).when(behind, code).otherwise(kind)


def clear_numeric_type(kind: Column) -> Column:
    return F.when(kind.rlike("^[0-9]+$"), "").otherwise(kind)


def clean_order_date(text: Column) -> Column:
    """The first d/m/y in a text; without one the text itself."""
    found = F.regexp_extract(text, _DATE, 0)
    return F.when(found != "", found).otherwise(text)


def normalize_dmy(text: Column) -> Column:
    """d/m/y with two-digit day and month and a four-digit year."""
    part = F.split(text, "/")
    year = F.element_at(part, 3)
    return F.concat_ws("/", F.lpad(F.element_at(part, 1), 2, "0"), F.lpad(F.element_at(part, 2), 2, "0"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))


def parse_date(text: Column) -> Column:
    """A date in one of the five written forms; null for any other text and for days that do not exist."""
    text = F.trim(text)
    forms = (("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d", text), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy", text), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "d/M/yyyy", F.regexp_replace(text, "/([0-9]{2})$", "/20$1")), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy", text), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d", text))
    return F.coalesce(*(F.when(text.rlike(form), F.to_date(F.try_to_timestamp(value, F.lit(pattern)))) for form, pattern, value in forms))


def filter_size_headers(headers: Column, letters: bool = False) -> Column:
    """Headers of one to three digits; with letters, XS to 4XL too."""
    shape = "^[0-9]{1,3}$" + ("|^(?i:xs|s|m|l|xl|xxl|2xl|3xl|xxxl|4xl)$" if letters else "")
    return F.filter(headers, lambda h: h.rlike(shape))


def repair_fused_headers(headers: Column) -> Column:
    """What is before a slash, where that is digits."""
    return F.transform(headers, lambda h: F.when(h.rlike("^[0-9]+/"), F.regexp_extract(h, "^([0-9]+)/", 1)).otherwise(h))


def normalize_name(text: Column) -> Column:
    """Lower case, with every run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def parse_total(text: Column) -> Column:
    """The number of a total that is digits and spaces only, else null."""
    return F.when(text.rlike("^[0-9 ]*[0-9][0-9 ]*$"), F.replace(text, F.lit(" "), F.lit("")).try_cast("int"))


def correct_lookalike_digits(text: Column) -> Column:
    """A quantity of up to three characters, with letters that look like digits read as such; null unless above 0."""
    fixed = F.translate(text, "OoSslI", "005511")
    number = F.when((F.length(text) <= 3) & fixed.rlike("^[0-9]{1,3}$"), fixed.cast("int"))
    return F.when(number > 0, number)


def split_merged_qty(text: Column, most: int = 500) -> Column:
    """[left, right] of the one way to cut a run of digits into two quantities of 1 to `most` without leading zeros; null without, or with several."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda at: F.struct(F.substr(text, F.lit(1), at).alias("a"), F.substr(text, at + 1).alias("b")))
    fits = lambda s: ~s.startswith("0") & F.coalesce(s.try_cast("int"), F.lit(0)).between(1, most)
    ways = F.filter(cuts, lambda c: fits(c["a"]) & fits(c["b"]))
    return F.when(text.rlike("^[0-9]{2,}$") & (F.size(ways) == 1), F.array(ways[0]["a"].cast("int"), ways[0]["b"].cast("int")))


def plain_int(text: Column) -> Column:
    """Digits, or one circled digit, as a number."""
    flat = F.translate(F.trim(text), "①②③④⑤⑥⑦⑧⑨", "123456789")
    return F.when(flat.rlike("^[0-9]+$"), flat.try_cast("int"))


def product_codes(text: Column) -> Column:
    """All runs of three digits or more, in order."""
    return F.regexp_extract_all(text, F.lit("([0-9]{3,})"), 1)


def template_signature(seller: Column, headers: Column) -> Column:
    """The key of a form's template; null without a seller or without headers."""
    name = normalize_name(seller)
    return F.when((name != "") & (F.size(headers) > 0), F.substring(F.sha2(F.concat(name, F.lit("||"), F.array_join(headers, "|")), 256), 1, 16))


def sort_sizes(sizes: Column) -> Column:
    """Numbers in ascending order, then other sizes by text."""
    keyed = F.transform(sizes, lambda s: F.struct((~s.rlike("^[0-9]+$")).alias("text"), s.try_cast("long").alias("n"), s.alias("size")))
    return F.transform(F.array_sort(keyed), lambda k: k["size"])


def page_headers(printed: Column, used: Column) -> Column:
    """The printed headers in their order, then sizes used but not printed, sorted."""
    return F.concat(printed, sort_sizes(F.array_except(used, printed)))


def _pairs(text: Column, value: str) -> Column:
    found = lambda n: F.regexp_extract_all(text, F.lit(r"([0-9]+)\s*:\s*(" + value + ")"), n)
    return F.zip_with(found(1), found(2), lambda s, q: F.struct(s.alias("size"), q.try_cast("int").alias("qty")))


def parse_row_text(text: Column) -> Column:
    """item_seen, first_size, last_size, quantities (size, qty) and total of a reading with lines 'Item seen:', 'Quantities:' and 'Total:'; blank where a line lacks."""
    line = lambda head: F.trim(F.regexp_extract(text, r"(?im)^\s*" + head + r":[ \t]*(.*)$", 1))
    pairs = _pairs(line("quantities"), "[0-9]+")
    end = lambda at: F.coalesce(F.try_element_at(pairs, F.lit(at))["size"], F.lit(""))
    return F.struct(line("item seen").alias("item_seen"), end(1).alias("first_size"), end(-1).alias("last_size"), pairs.alias("quantities"), line("total").alias("total"))


def parse_pairs_line(text: Column, headers: Column) -> Column:
    """(size, qty) of a line of size:quantity pairs, or, without any, of as many places between commas as headers, by position; places may be blank. Other than whole numbers above 0 go; of a repeated size the last stays."""
    pairs = _pairs(text, r"[A-Za-z0-9\-]+")
    words = F.transform(F.split(text, ","), lambda w: F.trim(w))
    placed = F.zip_with(headers, words, lambda s, q: F.struct(s.alias("size"), q.try_cast("int").alias("qty")))
    all_ = F.when(F.size(pairs) > 0, pairs).when(F.size(words) == F.size(headers), placed).otherwise(F.slice(placed, 1, 0))
    good = F.filter(all_, lambda p: p["qty"] > 0)
    return F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["size"] == p["size"]))


def plain_markup(text: Column) -> Column:
    """A piece of markup as text: breaks are spaces, tags go, four entities are read, spaces are run together."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?i)<br[ \t\r\n]*/?>", " "), "<[^>]*>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        flat = F.replace(flat, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(flat, r"[ \t\r\n]+", " "))


def strip_markup(text: Column) -> Column:
    """As plain_markup; a placeholder in brackets is nothing."""
    flat = plain_markup(text)
    return F.when(flat.rlike(r"^\[.*\]$"), "").otherwise(flat)


def parse_cell(header: Column, text: Column) -> Column:
    """(size, qty) of a cell: one number under its header, or two, of which the first names the size; null for anything else."""
    two = text.rlike(r"^\s*[0-9]+\s+[0-9]+\s*$")
    size, qty = F.when(two, F.regexp_extract(text, "([0-9]+)", 1)).otherwise(header), F.regexp_extract(text, r"([0-9]+)\s*$", 1)
    return F.when(two | text.rlike(r"^\s*[0-9]+\s*$"), F.struct(size.alias("size"), qty.try_cast("int").alias("qty")))


#: Letters that may name a cell's size.
CELL_LABELS = ("XS", "S", "M", "L", "XL", "XXL", "2XL", "3XL", "4XL")


def labelled_cell(text: Column) -> Column:
    """(label, qty) of a cell: one number, whose label is null, or a size (a number or letters, these in capitals) and a number; null for anything else. Numbers may be a circled digit, sizes not."""
    words = F.split(F.trim(text), r"\s+")
    label = F.upper(F.get(words, 0))
    named = (F.size(words) == 2) & (label.rlike("^[0-9]+$") | label.isin(*CELL_LABELS))
    qty = F.when(F.size(words) == 1, plain_int(F.get(words, 0))).when(named, plain_int(F.get(words, 1)))
    return F.when(qty.isNotNull(), F.struct(F.when(named, label).alias("label"), qty.alias("qty")))


def likeness_form(text: Column) -> Column:
    """A text as likeness scores take it: lower case, each character but letters, digits and the underscore a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]", " "))


def plain_total(text: Column) -> Column:
    """A total for arithmetic: a whole number with an optional sign, else null."""
    return F.trim(text).try_cast("int")


def keep_positive(cells: Column) -> Column:
    """Those of an array of (size, qty) with a quantity above 0."""
    return F.filter(cells, lambda c: c["qty"] > 0)


#: What a flag's status says to a reviewer, and the beginnings of notes that are shown as they are.
MESSAGES = {"unresolved": "Two readings differ: check this row against the photo.", "resolved": "Two readings differed and one was chosen: check it.", "unverified": "This row could not be checked.", "auto_corrected": "Moved by the catalog's sizes: check it.", "template_corrected": "Changed as reviewers changed this form before: check it."}
SHOWN_NOTES = ("NEEDS REVIEW", "Row-crop recount", "Hybrid OCR+VLM")


def flag_message(status: Column, note: Column) -> Column:
    """The text shown for a flag: its note where that begins in a known way, else one for its status."""
    known = F.lit(False)
    for head in SHOWN_NOTES:
        known = known | F.startswith(F.coalesce(note, F.lit("")), F.lit(head))
    return F.when(known, note).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), status))


#: The record of a form as models return it.
RECORD = "seller_name string, party_name string, order_no string, order_date string, date_present string, size_headers array<string>, items array<string>, notes array<string>"
_ITEM = "item string, type string, struck_out string, row_total string, quantities array<string>"


def repair_record(raw: Column) -> Column:
    """A form's record from a model's answer, whatever is wrong with it: fences go, unknown keys go, missing and null values are blank, 0 or false, entries of the wrong kind are passed over."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    blank = lambda c: F.coalesce(c, F.lit(""))
    texts = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    true = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))

    def item(text: Column) -> Column:
        i = F.from_json(text, _ITEM)
        pairs = F.transform(texts(i["quantities"]), lambda q: F.from_json(q, "size string, quantity string"))
        pairs = F.transform(F.filter(pairs, lambda q: q["size"].isNotNull() | q["quantity"].isNotNull()), lambda q: F.struct(blank(q["size"]).alias("size"), F.coalesce(q["quantity"].try_cast("double").cast("int"), F.lit(0)).alias("qty")))
        return F.struct(blank(i["item"]).alias("item"), blank(i["type"]).alias("type"), true(i["struck_out"]).alias("struck_out"), blank(i["row_total"]).alias("row_total"), pairs.alias("quantities"))

    r = F.from_json(bare, RECORD)
    entries = F.filter(texts(r["items"]), lambda x: F.startswith(F.ltrim(x), F.lit("{")))
    return F.struct(*(blank(r[c]).alias(c) for c in ("seller_name", "party_name", "order_no", "order_date")), true(r["date_present"]).alias("date_present"), texts(r["size_headers"]).alias("size_headers"), F.transform(entries, item).alias("items"), texts(r["notes"]).alias("notes"))


def split_merged_headers(text: Column, headers: Column) -> Column:
    """The one way to cut a run of digits, itself no header, into known headers; null without, or with several.

    For each place of the text the number of ways to reach it, two standing for more, and the parts of one of them: as long as the text, whatever that is.
    """
    known = F.filter(F.array_distinct(headers), lambda h: F.length(h) > 0)
    none = F.array().cast("array<string>")
    reached = lambda ways, parts: F.struct(ways.cast("int").alias("ways"), parts.alias("parts"))

    def step(so_far: Column, i: Column) -> Column:
        ends = F.filter(known, lambda h: (F.length(h) <= i) & (F.substr(text, i - F.length(h) + 1, F.length(h)) == h))
        from_ = F.filter(F.transform(ends, lambda h: F.struct(h.alias("h"), F.get(so_far, i - F.length(h)).alias("w"))), lambda e: e["w"]["ways"] > 0)
        ways = F.least(F.lit(2), F.aggregate(from_, F.lit(0), lambda n, e: n + e["w"]["ways"]))
        parts = F.when(ways == 1, F.concat(F.get(from_, 0)["w"]["parts"], F.array(F.get(from_, 0)["h"]))).otherwise(none)
        return F.concat(so_far, F.array(reached(ways, parts)))

    last = F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(text)), F.array(reached(F.lit(1), none)), step), -1)
    # looked at only where it can be: the rest of the texts of a page are no such runs
    return F.when(text.rlike("^[0-9]{2,}$") & ~F.array_contains(headers, text), F.when(last["ways"] == 1, last["parts"]))


def merged_header_centres(parts: Column, x0: Column, x1: Column) -> Column:
    """(size, x) of the headers that one box holds, each with the middle of its share of the box, by characters."""
    long = lambda p: F.aggregate(p, F.lit(0), lambda n, h: n + F.length(h))
    return F.transform(parts, lambda h, i: F.struct(h.alias("size"), (x0 + (x1 - x0) * (long(F.slice(parts, 1, i)) + F.length(h) / 2) / long(parts)).alias("x")))
