"""New forms as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import clean_order_date, normalize_name, parse_total, repair_record
from tallyloom.sources.files import artefact_name

FORM = "form_id string, order_date string, items array<struct<item:string,type:string,quantities:map<string,int>>>"
#: A form's files beside its own that its rows are checked with, and their shapes.
BESIDE = {"raw": "items array<struct<row_total:string,struck_out:boolean>>", "recount_flags": "array<struct<status:string,note:string>>", "brandlist": "array<struct<matched:string,score:double>>"}


def _known(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """items with in_catalog: whether a name of the catalog (bname) is the item's, but for case and signs."""
    names = catalog.select(normalize_name(F.col("bname")).alias("_name")).distinct().withColumn("_known", F.lit(True))
    return items.withColumn("_name", normalize_name(F.col("item"))).join(names, "_name", "left").withColumn("in_catalog", F.coalesce("_known", F.lit(False))).drop("_name", "_known")


def stream_forms(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """Cells of the form files (FORM, a JSON document a line) that come to a folder: form_id, order_date, row_idx, item, size, qty, in_catalog.

    Stateless: dates are cleaned, quantities of 0 or less go, and items are held against the catalog's names (bname), which is read
    anew for each batch. A form that is no JSON is a row of nulls in permissive mode and goes.
    """
    forms = spark.readStream.schema(FORM).json(path).where("form_id is not null")
    items = forms.select("form_id", clean_order_date(F.col("order_date")).alias("order_date"), F.posexplode("items").alias("row_idx", "i"))
    return _known(items.select("form_id", "order_date", "row_idx", F.col("i.item").alias("item"), F.explode("i.quantities").alias("size", "qty")).where("qty > 0"), catalog)


def stream_form_files(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """form_id, form, raw, recount_flags, brandlist: the texts of a form's files below a folder, X.json and X.raw.json and so on, which may come at different times.

    Each kind of file is a stream; they are joined by form, as far as their times of change lie within `late` of the form's own. A row goes out with all three others at once, or,
    once the watermark says that no more can come, with null for those that are missing. State is dropped then. A file that comes later than that, and files without their X.json, have no row.
    """
    name, kind, form_id = artefact_name(F.col("_metadata.file_path"), [*BESIDE])
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    files = files.select(form_id.alias("form_id"), kind.alias("kind"), "value", F.col("_metadata.file_modification_time").alias("at")).withWatermark("at", late)
    rows = files.where("kind = 'form'").select("form_id", F.col("value").alias("form"), "at")
    for k in BESIDE:
        side = files.where(F.col("kind") == k).select(F.col("form_id").alias("beside_id"), F.col("value").alias(k), F.col("at").alias("beside_at"))
        near = F.expr(f"form_id = beside_id AND beside_at BETWEEN at - INTERVAL {late} AND at + INTERVAL {late}")
        rows = rows.join(side, near, "leftOuter").drop("beside_id", "beside_at")
    return rows.drop("at")


def _parsed(text: Column, shape: str) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, shape))


def checked_rows(forms: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of stream_form_files' forms, repaired, held against the catalog's names and flagged: form_id, row_idx, item, kind, quantities, total, in_catalog, status, note.

    A form that is no JSON, or has no items, is one row with row_idx null and status no_items. A struck row keeps no quantities. status is the recount's; else unverified where the
    printed total differs from the sum or the item is neither a catalog name nor matched in brandlist, else ok. A missing file, or one that is no JSON, says nothing.
    """
    read = forms.select("form_id", repair_record(F.col("form")).alias("r"), *(_parsed(F.col(k), shape).alias(k) for k, shape in BESIDE.items()))
    items = read.select("form_id", "raw", "recount_flags", "brandlist", F.posexplode_outer("r.items").alias("row_idx", "i"))
    raw, flag, match = F.get(F.col("raw.items"), F.col("row_idx")), F.get("recount_flags", "row_idx"), F.get("brandlist", "row_idx")
    struck = F.coalesce(raw["struck_out"], F.col("i.struck_out"), F.lit(False))
    kept = F.filter("i.quantities", lambda c: (c["qty"] > 0) & ~struck)
    rows = items.select(
        "form_id", "row_idx", F.col("i.item").alias("item"), F.col("i.type").alias("kind"), kept.alias("quantities"), parse_total(F.coalesce(raw["row_total"], F.col("i.row_total"))).alias("total"),
        struck.alias("struck"), flag["status"].alias("said"), flag["note"].alias("note"), match["matched"].isNotNull().alias("matched"))
    rows = _known(rows, catalog)
    summed = F.aggregate("quantities", F.lit(0), lambda n, c: n + c["qty"])
    differs = F.coalesce((F.col("total") > 0) & (F.col("total") != summed), F.lit(False)) & ~F.col("struck")
    status = F.when(F.col("row_idx").isNull(), "no_items").when(F.col("said").isNotNull(), F.col("said")).when(differs | ~(F.col("in_catalog") | F.coalesce("matched", F.lit(False))), "unverified").otherwise("ok")
    return rows.select("form_id", "row_idx", "item", "kind", "quantities", "total", "in_catalog", status.alias("status"), "note")
