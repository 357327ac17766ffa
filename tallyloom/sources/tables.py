"""Reading of the catalog and the buyer master, from tables or by JDBC. Filters stand on the scan, so the source applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_for_matching(catalog: DataFrame) -> DataFrame:
    return catalog.where("isprimary = 1")


def catalog_for_picking(catalog: DataFrame) -> DataFrame:
    return catalog.where("isprimary = 1 and isunused = 0 and bsize is not null")


def live_buyers(buyers: DataFrame) -> DataFrame:
    """is_active = 0 means live. Names and cities are trimmed; blank names go."""
    return buyers.where("is_active = 0").withColumns({"name": F.trim("name"), "city": F.trim("city")}).where("name <> ''")


def read_lookup(table: DataFrame, key: str, name: str, by_name: bool = False) -> DataFrame:
    """A small table of users or companies: key and trimmed name (blank for null), ordered by the key, or by name and key."""
    rows = table.select(F.col(key).alias("id"), F.trim(F.coalesce(name, F.lit(""))).alias("name"))
    return rows.orderBy("name", "id") if by_name else rows.orderBy("id")


def read_table(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database by JDBC, read in `parts` ranges of its number column key; nulls of key are in the first. Filters and columns that follow reach the database.

    One row, the ends of key, is asked before. options: as the jdbc source takes them, user and driver among them. Names come in lower case.
    """
    source = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    ends = source().option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}").load().first()
    if ends[0] is None:
        rows = source().option("dbtable", table).load()
    else:
        rows = source().option("dbtable", table).options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(int(ends[1]) + 1), numPartitions=str(parts)).load()
    return rows.select(*(F.col(c).alias(c.lower()) for c in rows.columns))
