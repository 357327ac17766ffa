"""Usage logs, forms, images and markup in; reviews, order forms, orders, usage and audit records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import parse_total
from tallyloom.sources.order_store import commits, publish, read_published

_USAGE = "timestamp_utc timestamp, image string, model string, mode string, input_tokens long, cache_read_tokens long, cache_write_tokens long, output_tokens long, estimated_cost_usd double"


def read_usage_log(spark: SparkSession, old: str | None, new: str | None) -> DataFrame:
    """Calls from CSV files with a header: old ones of nine columns, and new ones that have duration_seconds and error too. Blank numbers are null."""
    parts = [spark.read.csv(path, header=True, schema=schema) for path, schema in ((old, _USAGE), (new, _USAGE + ", duration_seconds double, error string")) if path]
    return parts[0] if len(parts) == 1 else parts[1].unionByName(parts[0], allowMissingColumns=True)


#: The columns of a review file, in their order.
REVIEW = ("source_file", "party_name", "order_no", "order_date", "item", "type", "size", "quantity", "notes")


def write_review(rows: DataFrame, path: str) -> None:
    """REVIEW's columns of flattened rows as CSV with a header, null as blank, each form's rows together in the order of row_idx and pos, the place of a size in its row."""
    ordered = rows.repartition("source_file").sortWithinPartitions("source_file", "row_idx", "pos")
    ordered.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REVIEW)).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_order_forms(cells: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    """A JSON document for each form: party_name, order_no and order_date of headers (form_id, ..), blank where there is none, and its items (item, type, quantities) in row order.

    cells: form_id, row_idx, item, size, qty, and kind and pos where there are such columns. Of a size that a row repeats the last quantity by pos counts; without pos, the largest. A form of headers without cells has no items.
    """
    last = F.max_by("qty", "pos") if "pos" in cells.columns else F.max("qty")
    kind = F.coalesce(F.col("kind"), F.lit("")) if "kind" in cells.columns else F.lit("")
    once = cells.withColumn("type", kind).groupBy("form_id", "row_idx", "item", "type", "size").agg(last.alias("qty"))
    rows = once.groupBy("form_id", "row_idx", "item", "type").agg(F.array_sort(F.collect_list(F.struct("size", "qty"))).alias("q"))
    forms = rows.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "item", "type", "q"))).alias("r"))
    names = ["party_name", "order_no", "order_date"]
    told = forms if headers is None else headers.select("form_id", *names).join(forms, "form_id", "full")
    blank = [F.lit("").alias(n) if headers is None else F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]
    items = F.transform(F.coalesce("r", F.array().cast(forms.schema["r"].dataType)), lambda i: F.struct(i["item"].alias("item"), i["type"].alias("type"), F.map_from_entries(i["q"]).alias("quantities")))
    told.select("form_id", *blank, items.alias("items")).write.mode("overwrite").json(path)


#: Extensions of images, and of a form's artefacts before .json with their shapes.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
_ITEM = "struct<item:string,type:string,quantities:map<string,int>>"
_ARTEFACTS = {
    "form": f"seller_name string, party_name string, order_no string, order_date string, items array<{_ITEM}>",
    "stageA": "size_headers array<string>",
    "raw": "items array<struct<row_total:string,struck_out:boolean>>",
    "recount_flags": "array<struct<status:string,note:string>>",
    "brandlist": "array<struct<matched:string,score:double>>",
    "party_check": "status string, note string",
    "template_learning": "matched boolean, occurrences int",
}


def _file(path: Column) -> Column:
    """The last part of a path, decoded."""
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def artefact_name(path: Column, kinds: list[str]) -> tuple[Column, Column, Column]:
    """Of the path of a JSON file its name without .json, its kind, one of kinds or form, and the form that it belongs to: X.raw.json is the raw of X, X.json the form itself."""
    name = F.regexp_replace(_file(path), r"\.json$", "")
    ending = F.regexp_extract(name, r"\.(" + "|".join(kinds) + ")$", 1)
    return name, F.when(ending == "", "form").otherwise(ending), F.when(ending == "", name).otherwise(F.substr(name, F.lit(1), F.length(name) - F.length(ending) - 1))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below a folder in order of their paths: path, length, name. The name is the file's stem with other than letters, digits, space, - and _ as _, page where blank; of equal names the second is `name (2)`.

    Contents are not read. Equal names are numbered by name, so a folder of many names is many groups.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    stem = F.trim(F.regexp_replace(F.regexp_replace(_file(F.col("path")), r"\.[^.]*$", ""), r"[^\p{L}\p{N} _-]", "_"))
    named = files.withColumn("name", F.when(stem == "", "page").otherwise(stem))
    n = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    return named.withColumn("_n", n).withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("name"))).drop("_n")


def read_page_markup(spark: SparkSession, path: str) -> DataFrame:
    """form_id, raw_text: the whole text of each file below a folder, by its name without the extension."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.regexp_replace(_file(F.input_file_name()), r"\.[^.]*$", "").alias("form_id"), F.col("value").alias("raw_text"))


def read_form_json(spark: SparkSession, path: str) -> DataFrame:
    """A row for each form of a folder with what stands beside it: form_id, form, stageA, raw, recount_flags, brandlist, party_check, template_learning.

    Form X is X.json, its artefacts X.raw.json and so on. A missing file, or one that is no JSON, is null. A form without X.json has no row.
    """
    name, kind, form_id = artefact_name(F.input_file_name(), [k for k in _ARTEFACTS if k != "form"])
    own = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(form_id.alias("form_id"), kind.alias("kind"), "value")
    wide = own.groupBy("form_id").pivot("kind", list(_ARTEFACTS)).agg(F.first("value")).where("form is not null")
    parsed = [F.when(F.try_parse_json(F.col(k)).isNotNull(), F.from_json(k, shape)).alias(k) for k, shape in _ARTEFACTS.items()]
    return wide.select("form_id", *parsed)


def form_rows(forms: DataFrame) -> DataFrame:
    """The items of read_form_json's forms as rows, each with what has its index in the other artefacts: form_id, row_idx (from 0), item, kind, quantities, status, note, matched, score, printed_total, struck_out."""
    items = forms.select("form_id", "raw", "recount_flags", "brandlist", F.posexplode("form.items").alias("row_idx", "i"))
    flag, match, raw = F.get("recount_flags", "row_idx"), F.get("brandlist", "row_idx"), F.get(F.col("raw.items"), F.col("row_idx"))
    return items.select("form_id", "row_idx", F.col("i.item").alias("item"), F.col("i.type").alias("kind"), F.col("i.quantities").alias("quantities"), flag["status"].alias("status"), flag["note"].alias("note"), match["matched"].alias("matched"), match["score"].alias("score"), parse_total(raw["row_total"]).alias("printed_total"), F.coalesce(raw["struck_out"], F.lit(False)).alias("struck_out"))


def write_orders(master: DataFrame, details: DataFrame, path: str, batch: str) -> bool:
    """Both tables of a batch, or neither (see order_store.publish). False if the batch is published already; one that failed before is written anew.

    A detail (order_no, det_id) that comes twice is an error.
    """
    twice = details.groupBy("order_no", "det_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"order {twice[0]['order_no']} has detail {twice[0]['det_id']} twice")
    return publish(master.sparkSession, path, batch, lambda last: {"master": master, "details": details})


def published(spark: SparkSession, path: str) -> DataFrame:
    """batch of each one that write_orders has finished."""
    return commits(spark, path).select("batch")


def read_orders(spark: SparkSession, path: str, table: str) -> DataFrame:
    """master or details of the batches that are published, with batch, a text whatever it looks like."""
    return read_published(spark, path, table)


def append_usage(calls: DataFrame, path: str) -> None:
    """Calls, failed ones too, after those of a log folder, in the columns that read_usage_log reads as new."""
    names = [c.split()[0] for c in (_USAGE + ", duration_seconds double, error string").split(", ")]
    calls.select(*names).write.mode("append").csv(path, header=True)


def write_audit(orders: DataFrame, path: str) -> None:
    """A JSON record for each order (order_no, session, submitted_at, extracted, submitted, detail_rows: any types), in a folder for each day."""
    orders.withColumn("day", F.to_date("submitted_at")).repartition("day", F.pmod(F.xxhash64("order_no"), F.lit(16))).write.mode("append").partitionBy("day").json(path)
