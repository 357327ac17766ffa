"""What reviewers' corrections teach about a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scratch import fresh, written
from tallyloom.functions.text import likeness_form, normalize_name
from tallyloom.operators.fuzzy import ratio
from tallyloom.operators.matching import apply_offset


def template_seen(forms: DataFrame) -> DataFrame:
    return forms.where("signature is not null").groupBy("signature").agg(F.count("*").alias("occurrences"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


_RULE = ["signature", "kind", "trigger"]


def _stretches(events: DataFrame) -> DataFrame:
    """What each range of the order of (rule, at) holds of a rule, as (rule, range, stretch).

    A stretch has the confirmations before its first value (pre, the last at pre_at), its first value and when, its last one, the changes from one value to another,
    the confirmations since the last of these (since), and when its last event after the first value was that counts (after_at).
    """
    ranged = written(events.repartitionByRange(*_RULE, "at", "value").withColumn("range", F.spark_partition_id()), "events")
    here = Window.partitionBy("range", *_RULE)
    order = here.orderBy("at", "value")
    upto, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    given = F.col("value").isNotNull()
    marked = ranged.withColumns({"n": F.row_number().over(order), "before": F.last("value", ignorenulls=True).over(above)})
    marked = marked.withColumn("change", F.coalesce(given & (F.col("value") != F.col("before")), F.lit(False)))
    marked = marked.withColumn("epoch", F.sum(F.col("change").cast("long")).over(upto))
    marked = marked.withColumn("latest", F.max("epoch").over(here))
    known, first = F.col("before").isNotNull(), given & F.col("before").isNull()
    return marked.groupBy(*_RULE, "range").agg(F.struct(
        F.count_if(~given & ~known).alias("pre"), F.max(F.when(~given & ~known, F.col("at"))).alias("pre_at"), F.max(F.when(first, F.col("value"))).alias("first"), F.max(F.when(first, F.col("at"))).alias("first_at"),
        F.max_by("value", F.when(given, F.col("n"))).alias("last"), F.max("epoch").alias("changes"), F.count_if(~given & known & (F.col("epoch") == F.col("latest"))).alias("since"),
        F.max(F.when((~given & known) | F.col("change"), F.col("at"))).alias("after_at"),
    ).alias("stretch"))


def _joined(a: Column, b: Column) -> Column:
    """Two stretches, one after the other, as one. Associative: what b's first confirmations and first value mean is told by whether a has a value, and which."""
    has_a, has_b = a["first"].isNotNull(), b["first"].isNotNull()
    turn = F.coalesce(a["last"] != b["first"], F.lit(False))
    since = F.when(~has_b, a["since"] + F.when(has_a, b["pre"]).otherwise(0)).when(~has_a | (b["changes"] > 0) | turn, b["since"]).otherwise(a["since"] + b["pre"] + b["since"])
    return F.struct(
        F.when(has_a, a["pre"]).otherwise(a["pre"] + b["pre"]).alias("pre"), F.when(has_a, a["pre_at"]).otherwise(F.greatest(a["pre_at"], b["pre_at"])).alias("pre_at"),
        F.coalesce(a["first"], b["first"]).alias("first"), F.when(has_a, a["first_at"]).otherwise(b["first_at"]).alias("first_at"), F.coalesce(b["last"], a["last"]).alias("last"),
        (a["changes"] + b["changes"] + turn.cast("long")).alias("changes"), since.alias("since"),
        F.when(has_a, F.greatest(a["after_at"], b["pre_at"], F.when(turn, b["first_at"]), b["after_at"])).otherwise(b["after_at"]).alias("after_at"),
    )


def fold_rules(events: DataFrame) -> DataFrame:
    """Rules from events (signature, kind, trigger, at, value; value null: a confirmation): value, contradicted, confirmed, status, first_seen, last_confirmed.

    A rule's value is its last one; a change counts as a contradiction, confirmations count since the last change, and one that comes before any value does not. The same value
    again says nothing. last_confirmed is when the rule was made, changed or confirmed last. Events of one time: confirmations first, then by value.

    Events are ranged over rule and time, so a rule's events lie in as many tasks as they fill; each range's stretch of a rule is one row, and these are joined in order.
    """
    rows = events.select(*_RULE, "at", "value")
    folded = _stretches(rows).groupBy(*_RULE).agg(F.array_sort(F.collect_list(F.struct("range", "stretch"))).alias("s"))
    whole = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", 0)["stretch"], lambda a, b: _joined(a, b["stretch"]))
    told = folded.select(*_RULE, whole.alias("w")).where("w.last is not null")
    return told.select(*_RULE, F.col("w.last").alias("value"), F.col("w.changes").alias("contradicted"), F.col("w.since").alias("confirmed"), F.lit("active").alias("status"), F.col("w.first_at").alias("first_seen"), F.greatest("w.first_at", "w.after_at").alias("last_confirmed"))


def preferred_backend(rates: DataFrame) -> DataFrame:
    """(signature, backend): of two backends or more with uses, the one with strictly the lowest mean rate."""
    used = rates.where("uses >= 1")
    order = Window.partitionBy("signature").orderBy("rate", "backend")
    ranked = used.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("rate").over(order))
    return ranked.where("_n = 1 and _next > rate").select("signature", "backend", "rate")


def detect_shift_offset(rows: DataFrame) -> DataFrame:
    """rows (raw, submitted: arrays of (size, qty), headers) with offset: the only one of -3 to 3 but 0 that turns raw into submitted; else null. Off the edge cells go, sizes that are no header stay."""
    def moved(offset: F.Column) -> F.Column:
        def cell(c: F.Column) -> F.Column:
            at = F.array_position("headers", c["size"]).cast("int")
            there = F.when(at + offset > 0, F.try_element_at(F.col("headers"), F.greatest(at + offset, F.lit(1))))
            return F.struct(F.when(at == 0, c["size"]).otherwise(there).alias("size"), c["qty"].alias("qty"))

        return F.array_sort(F.filter(F.transform("raw", cell), lambda c: c["size"].isNotNull()))

    good = F.filter(F.array(*map(F.lit, (-3, -2, -1, 1, 2, 3))), lambda o: moved(o) == F.array_sort("submitted"))
    only = fresh(rows, "good")[0]
    return rows.withColumn(only, good).withColumn("offset", F.when(F.size(only) == 1, F.get(only, 0))).drop(only)


def correction_rate(pages: DataFrame) -> DataFrame:
    """Per signature and backend: pages used, and the mean share of their rows with something in them (rows) that were corrected."""
    return pages.where("rows > 0").groupBy("signature", "backend").agg(F.count("*").alias("uses"), F.avg(F.col("corrected") / F.col("rows")).alias("rate"))


def count_applied(fired: DataFrame) -> DataFrame:
    """How many forms each rule fired on, however many rows of them. Forms are made distinct first, so a hot rule is many keys."""
    return fired.select("signature", "kind", "trigger", "form_id").distinct().groupBy("signature", "kind", "trigger").agg(F.count("*").alias("times_applied"))


def fired_rules(rows: DataFrame, rules: DataFrame, least: float = 92.0) -> DataFrame:
    """(signature, item, fired, value) of each distinct name of a template that a rule (signature, trigger, value) fires on: the nearest trigger from a ratio of `least` on, ties to the first by text.

    Names and triggers are compared without case and signs, each distinct pair of a template once.
    """
    names = rows.select("signature", "item").distinct()
    scored = names.join(rules.select("signature", "trigger", "value"), "signature").withColumn("score", ratio(likeness_form(F.col("item")), likeness_form(F.col("trigger")))).where(F.col("score") >= least)
    best = scored.groupBy("signature", "item").agg(F.min(F.struct(-F.col("score"), "trigger", "value")).alias("b"))
    return best.select("signature", "item", F.col("b.trigger").alias("fired"), F.col("b.value").alias("value"))


def apply_rules(rows: DataFrame, rules: DataFrame, least: float = 92.0) -> DataFrame:
    """rows (.., signature, item) with item replaced by what the rule (signature, trigger, corrected) that fires on it says, fired: its trigger, and note for the reviewer. A rule does not fire on a name that is what it says already."""
    said = fresh(rows, "said")[0]
    best = fired_rules(rows, rules.withColumnRenamed("corrected", "value"), least).where(F.col("value") != F.col("item")).withColumnRenamed("value", said)
    note = F.when(F.col("fired").isNotNull(), F.concat(F.lit("Template memory: read as "), F.col("item"), F.lit(", confirmed before as "), F.col(said)))
    return rows.join(best, ["signature", "item"], "left").withColumn("note", note).withColumn("item", F.coalesce(said, "item")).drop(said)


def apply_shift_rules(rows: DataFrame, cells: DataFrame, headers: DataFrame, rules: DataFrame, least: float = 92.0) -> DataFrame:
    """cells (form_id, row_idx, size, qty) moved by the offset of the shift rule (signature, trigger, offset) that fires on their row's name, as it is after apply_rules; others stay as they are."""
    best = fired_rules(rows, rules.withColumnRenamed("offset", "value"), least)
    offsets = rows.join(best, ["signature", "item"]).select("form_id", "row_idx", F.col("value").alias("offset"))
    placed = cells.join(offsets, ["form_id", "row_idx"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    return apply_offset(placed, headers)


def _corrected(rows: DataFrame) -> DataFrame:
    """Rows of known templates that were read and submitted, with name, shown and read names, and whether name and cells were changed, the latter by one offset."""
    name = F.trim(F.coalesce("submitted_item", F.lit("")))
    sub, shift = F.coalesce(F.col("fired_kind") == "item_substitution", F.lit(False)), F.coalesce(F.col("fired_kind") == "column_shift", F.lit(False))
    known = rows.where("signature is not null and coalesce(uid, '') <> '' and not contains(uid, '#new') and submitted_item is not null").withColumn("raw", F.when(shift, F.col("raw_cells")).otherwise(F.col("cells")))
    known = detect_shift_offset(known.withColumn("submitted", F.col("submitted_cells")))
    item = F.coalesce("item", F.lit(""))
    same = F.array_sort("submitted_cells") == F.array_sort("cells")
    return known.withColumns({
        "name": name, "sub_fired": sub, "shift_fired": shift, "renamed": (name != "") & (name != item), "same_cells": same, "moved": ~same & F.col("offset").isNotNull(),
        "read": F.when(sub, F.col("rule_raw")).otherwise(item), "shown_as": F.when(shift, F.col("rule_trigger")).when(name != "", name).otherwise(item),
    })


def correction_events(rows: DataFrame) -> DataFrame:
    """Events (signature, kind, trigger, at, value; value null: a confirmation) of rows as shown and as submitted.

    rows: signature, uid, at, item and cells as shown, submitted_item (null: not submitted) and submitted_cells, headers, and of the last correction that
    fired fired_kind, rule_raw, rule_trigger and raw_cells, else null; cells are arrays of (size, qty). Rows without uid, new ones and those that were not submitted
    teach nothing. A changed name is a substitution for what was read, letter by letter; the name of a fired substitution that stays is confirmed. Changed
    quantities are a shift, by the name without case and signs, if one offset alone makes them from what was read; those of a fired shift that stay are confirmed.
    """
    event = lambda when, kind, trigger, value: F.when(when, F.struct(F.lit(kind).alias("kind"), trigger.alias("trigger"), value.cast("string").alias("value")))
    nothing, name, read, shown = F.lit(None).cast("string"), F.col("name"), F.col("read"), F.col("shown_as")
    events = F.array_compact(F.array(
        event(F.col("renamed") & (read != "") & (read != name), "item_substitution", read, name), event(~F.col("renamed") & (name != "") & F.col("sub_fired"), "item_substitution", read, nothing),
        event(F.col("moved") & (shown != ""), "column_shift", normalize_name(shown), F.col("offset")), event(F.col("same_cells") & F.col("shift_fired"), "column_shift", normalize_name(shown), nothing),
    ))
    return _corrected(rows).select("signature", "uid", "at", F.explode(events).alias("e")).select("signature", "e.kind", "e.trigger", "at", "uid", "e.value")


def page_corrections(rows: DataFrame, *page: str) -> DataFrame:
    """Per page (signature and the columns page) of correction_events' rows: rows that were read with quantities, and corrected: changed names and shifts, a row with both counts twice."""
    changes = F.col("renamed").cast("long") + F.col("moved").cast("long")
    return _corrected(rows).groupBy("signature", *page).agg(F.sum(F.coalesce(changes, F.lit(0))).alias("corrected"), F.count_if(F.size("cells") > 0).alias("rows"))


def correction_rates(pages: DataFrame) -> DataFrame:
    """(signature, stat, name, uses, rate) of pages (signature, backend, model, corrected, rows): for each backend and each model its pages with rows, and the mean of corrected over rows."""
    stats = F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).alias("name")) for c in ("backend", "model")))
    listed = pages.where("rows > 0").select("signature", F.explode(stats).alias("s"), (F.col("corrected") / F.col("rows")).alias("r")).where("s.name <> ''")
    return listed.groupBy("signature", "s.stat", "s.name").agg(F.count("*").alias("uses"), F.avg("r").alias("rate"))
