"""Scratch tables, input shapes, joins that bear hot keys, and file access that the operators here share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scratch import removed, scratch, written  # noqa: F401

#: The runs of white space that the contracts name, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with at least this share of all rows, and this many, is joined by broadcast: there are fewer of them than the inverse.
HOT_SHARE, HOT_ROWS = 1 / 1000, 1000
#: Bits for each member of a set that rows are held against before a shuffle, and at most for all of them: 64 MB.
BITS_EACH, BITS_MOST = 16, 1 << 29
_BITMAP = 1 << 15  # bits of a row of bitmap_construct_agg


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text, null as empty, with the columns named in more; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Short pieces of Arrow batches, of some 4 MB of text at most unless one text is longer, so that few texts are Python strings at once."""
    for batch in batches:
        length = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                length += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(length), 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = min(max(fit, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()  # what a worker keeps of past batches counts against its executor
    trimmed()


def trimmed() -> None:
    """Gives back what the C library keeps of freed memory, where it can: a worker outlives its tasks."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def left_by_key(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows LEFT JOIN groups on keys that are never null, where groups, a written table, has each key once and in the column n how many rows have it.

    Keys of at least HOT_SHARE of the rows, bounded in number by that share, are broadcast; the others meet by shuffle, so no task
    gets more of one key than that. rows is read twice where there are hot keys: it should be a written table, too.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = groups.where(F.col(n) >= least)
    if hot.isEmpty():
        return rows.join(groups, keys, "left")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(n) < least), keys, "left")
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def split_by_members(rows: DataFrame, key: Column, members: DataFrame, most: int = BITS_MOST) -> tuple[DataFrame, DataFrame]:
    """rows that are surely not among members, and those that may be: all that are, and some more. The second need no further look if there is no member.

    key, a long, is looked up in a bitmap of the values of members' only column. The bitmap is broadcast; it has 16 bits
    for each member and at most `most`, beyond which more rows than that pass for members, but none is lost.
    """
    n = members.count()
    bits = min(most, max(_BITMAP, 1 << (BITS_EACH * n - 1).bit_length() if n else _BITMAP))
    slot, bucket, bitmap = fresh(rows, "slot", "bucket", "bitmap")
    place = lambda c: F.pmod(c, F.lit(bits)) + 1  # noqa: E731 (bitmap places begin at 1)
    maps = members.select(place(F.col(members.columns[0])).alias(slot)).groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bitmap))
    looked = rows.withColumn(slot, place(key)).withColumn(bucket, F.bitmap_bucket_number(F.col(slot))).join(F.broadcast(maps), bucket, "left")
    at = F.bitmap_bit_position(F.col(slot))
    byte = F.conv(F.hex(F.substr(F.col(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return looked.where(~found).select(rows.columns), looked.where(found).select(rows.columns)


def row_key(doc_id: Column, sha: Column) -> Column:
    """A long that stands for a row's id, null or not, and its text's hash."""
    return F.xxhash64(doc_id, sha)


def decided(docs: DataFrame, decisions: DataFrame, sha: Column) -> DataFrame:
    """docs without the rows that decisions names, all columns unchanged.

    decisions, a written table: (id long, sha, first boolean), each id, null or not, with a hash once. Of the rows of docs with that id and hash
    one stays where first is true, none where it is false; rows that are not named stay. sha: that hash, from docs' columns.

    Only rows that may be named, by a bitmap of bounded size, are shuffled.
    """
    own_id, own_sha, d_id, d_sha, first = fresh(docs, "own_id", "own_sha", "d_id", "d_sha", "first")
    named = decisions.select(F.col("id").alias(d_id), F.col("sha").alias(d_sha), F.col("first").alias(first))
    tagged = docs.withColumns({own_id: docs["doc_id"].cast("long"), own_sha: sha})
    stay, maybe = split_by_members(tagged, row_key(F.col(own_id), F.col(own_sha)), decisions.select(row_key(F.col("id"), F.col("sha")).alias("k")))
    looked = maybe.join(named, F.col(own_id).eqNullSafe(F.col(d_id)) & (F.col(own_sha) == F.col(d_sha)), "left")
    kept = looked.where(F.col(first)).dropDuplicates([own_id, own_sha])
    return stay.select(docs.columns).unionByName(looked.where(F.col(first).isNull()).select(docs.columns)).unionByName(kept.select(docs.columns))


def held_in_fold(doc_id: Column, folds: int, out: int) -> Column:
    """True where crc32(doc_id as text) mod folds is the fold held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == out


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local path, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def output_file(folder: str, name: str) -> tuple[pa.NativeFile, str]:
    """A new file to write below a folder, which is made where missing, and its URI."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"
