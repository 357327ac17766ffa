"""Exact duplicates by counting quotient filters.

Each input partition builds counting quotient filters of its 64-bit fingerprints, one for each shard of
the fingerprint space. A shard's filters merge by their sorted remainders, without loss, and only
fingerprints with a count above one go on: their texts are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import SPACE, decided, documents, left_by_key, split_by_members, written

#: Fingerprints of a shard that its merging task holds, at the most expected.
SHARD_ROWS = 2_000_000
#: Fingerprints after which a task closes its filters and begins new ones.
FLUSH_ROWS = 4_000_000
#: Rows that one array makes of a count.
REPEATS = 65536


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of unsigned 64-bit values, one after the other, as bytes."""
    out = []
    for at in range(0, len(values), 1 << 15):  # a multiple of 8 values ends at a byte
        block = values[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(block, axis=1)[:, 64 - width :]))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def unpacked(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """The n values that packed has packed."""
    out = np.empty(n, np.uint64)
    for at in range(0, n, 1 << 15):
        count = min(1 << 15, n - at)
        bits = np.zeros((count, 64), np.uint8)
        begin = at // 8 * width
        bits[:, 64 - width :] = np.unpackbits(data[begin : begin + -(-count * width // 8)], count=count * width).reshape(count, width)
        out[at : at + count] = np.packbits(bits, axis=1).view(">u8")[:, 0]
    return out


class CountingQuotientFilter:
    """A multiset of fingerprints of `bits` bits: the top q name a run, the rest are its sorted remainders.

    occupied has a bit for each quotient that has a run, run_end a bit for each slot that ends one, and remainders
    the slots, packed at bits - q bits; counts above one are kept beside the slots that have them.
    """

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, run_end: np.ndarray, slots: int, remainders: np.ndarray, more_at: np.ndarray, more: np.ndarray):
        self.bits, self.quotient_bits, self.occupied, self.run_end, self.slots, self.remainders, self.more_at, self.more = bits, quotient_bits, occupied, run_end, slots, remainders, more_at, more

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int, bits: int = 64) -> CountingQuotientFilter:
        """From distinct sorted unsigned fingerprints below 2 ** bits."""
        low = np.uint64(bits - quotient_bits)
        quotients = (fingerprints >> low).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        run_end = np.append(quotients[1:] != quotients[:-1], True)[: len(quotients)]
        more_at = np.flatnonzero(counts > 1)
        return cls(bits, quotient_bits, np.packbits(occupied), np.packbits(run_end), len(quotients), packed(fingerprints, bits - quotient_bits), more_at.astype(np.uint32), counts[more_at].astype(np.uint64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in ascending order, and their counts."""
        n, width = self.slots, self.bits - self.quotient_bits
        ends = np.unpackbits(self.run_end, count=n)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.quotient_bits)).astype(np.uint64)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        counts = np.ones(n, np.int64)
        counts[self.more_at] = self.more
        return (quotients[run] << np.uint64(width)) | unpacked(self.remainders, width, n), counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sums the counts of equal remainders of a run. Runs are sorted, and so are quotients: two filters at a time are merged in their order."""
        parts = [f.items() for f in filters]
        while len(parts) > 1:
            parts = [_merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        values, counts = parts[0]
        return cls.of(values, counts, max(f.quotient_bits for f in filters), filters[0].bits)

    def to_row(self) -> dict:
        return {"bits": self.bits, "quotient_bits": self.quotient_bits, "slots": self.slots} | {k: getattr(self, k).tobytes() for k in ("occupied", "run_end", "remainders", "more_at", "more")}

    @classmethod
    def from_row(cls, row: dict) -> CountingQuotientFilter:
        data = {k: np.frombuffer(row[k], t) for k, t in (("occupied", np.uint8), ("run_end", np.uint8), ("remainders", np.uint8), ("more_at", np.uint32), ("more", np.uint64))}
        return cls(bits=row["bits"], quotient_bits=row["quotient_bits"], slots=row["slots"], **data)


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct values with counts as one."""
    at = np.searchsorted(a[0], b[0])
    same = np.zeros(len(b[0]), bool)
    inside = at < len(a[0])
    same[inside] = a[0][at[inside]] == b[0][inside]
    counts = a[1].copy()
    counts[at[same]] += b[1][same]
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(counts, at[~same], b[1][~same])


FILTER_SCHEMA = "shard int, bits int, quotient_bits int, slots long, occupied binary, run_end binary, remainders binary, more_at binary, more binary"


def repeated_fingerprints(fingerprints: DataFrame, shards: int | None = None) -> DataFrame:
    """(fp long, n long) for each value of the long column fp that occurs more than once, by merged filters.

    shards defaults to the rows over SHARD_ROWS; a task of the merge holds one shard's distinct values.
    """
    wanted = shards or max(32, -(-fingerprints.count() // SHARD_ROWS))
    bits = max(0, (wanted - 1).bit_length())
    low = np.uint64((1 << (64 - bits)) - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(values: np.ndarray) -> pa.RecordBatch:
            values, counts = np.unique(values, return_counts=True)
            shard = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
            rows = []
            for s in np.unique(shard):
                own = shard == s
                n = int(own.sum())
                # the shard is left out: its bits are the same for the whole filter
                f = CountingQuotientFilter.of(values[own] & low, counts[own], max(3, n.bit_length()), 64 - bits)
                rows.append({"shard": int(s)} | f.to_row())
            return pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("bits", pa.int32()), ("quotient_bits", pa.int32()), ("slots", pa.int64()), *((k, pa.binary()) for k in ("occupied", "run_end", "remainders", "more_at", "more"))]))

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield filters(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield filters(np.concatenate(held))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values, counts = CountingQuotientFilter.merged([CountingQuotientFilter.from_row(r) for r in rows]).items()
        values, counts = values[counts > 1], counts[counts > 1]
        whole = values | (np.uint64(rows[0]["shard"]) << np.uint64(64 - bits)) if bits else values
        return pa.table({"fp": whole.view(np.int64), "n": counts})

    return fingerprints.select("fp").mapInArrow(build, FILTER_SCHEMA).groupBy("shard").applyInArrow(merge, "fp long, n long")


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def exact_duplicates(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is empty; empty texts equal each other. Texts equal when the same after each run of
    white space becomes one space. Of a group the smallest doc_id is kept, and null only if all are null;
    of rows that repeat that doc_id with that text, one is kept. Other columns are not read.

    Texts are read twice and shuffled only where their fingerprint may be a repeated one. There they are grouped by all
    their bytes, copies in one partition as one; a row for each group, not the texts, goes back to the rows.
    """
    return _decided_rows(docs, shards).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _decided_rows(docs: DataFrame, shards: int | None = None) -> DataFrame:
    texts = documents(docs).select("doc_id", _normal(F.col("text")).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    hashed = written(texts.select("doc_id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")), "fingerprints")
    repeated = written(repeated_fingerprints(hashed, shards).select("fp"), "repeated")
    _, candidates = split_by_members(texts, F.col("fp"), repeated)
    # the text is part of the key: rows of one group are equal byte for byte
    groups = candidates.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    joined = written(left_by_key(hashed, groups, ["fp", "sha"], "group_size").drop("fp"), "joined")
    alone = joined.where("group_size is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    grouped, smallest = joined.where("group_size is not null"), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    others = grouped.where(~smallest).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "sha")
    # rows that repeat the kept row's id and text, counted, then one of them kept
    first = grouped.where(smallest).groupBy("doc_id", "keep_id", "group_size", "sha").agg(F.count("*").alias("n"))
    again = first.where("n > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / REPEATS))))
    again = again.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("n") - 1 - F.col("block") * REPEATS))))
    columns = ["doc_id", "keep_id", "group_size", "kept", "sha"]
    return alone.unionByName(others).unionByName(first.withColumn("kept", F.lit(True)).select(columns)).unionByName(again.withColumn("kept", F.lit(False)).select(columns))


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, all their columns."""
    found = _decided_rows(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "sha", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("first"))
    return decided(docs, written(found.distinct(), "dropped"), F.unhex(F.sha2(_normal(F.coalesce(docs["text"].cast("string"), F.lit(""))), 256)))
