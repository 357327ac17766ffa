"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each codebook, found by beam search over
residuals. A query scores a code by looking up its products with all codewords, and the code's stored norm;
the best codes are scored again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import opened, scratch, written

#: Bounded sample that the codebooks are fitted on.
SAMPLE = 8192
BOOKS, WORDS, BEAM = 32, 256, 4
#: Codes of a shard, queries of a block, and codes that each query takes from a shard to exact scoring.
SHARD_ROWS, QUERY_BLOCK, SHORTLIST = 131072, 256, 128


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dimension)

    @classmethod
    def fitted(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 1) -> Codebooks:
        """k-means of what earlier codebooks leave; then, with the codes of a beam search held, sweeps of least squares over one codebook at a time."""
        rng, rest, out = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        words = max(1, min(words, len(x)))
        for _ in range(books):
            centres = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(rounds):
                _means(rest, (rest @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1), centres)
            rest -= centres[(rest @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)]
            out.append(centres)
        own = cls(np.stack(out))
        codes, _ = own.encode(x)
        rest = x.astype(np.float32) - sum(book[c] for book, c in zip(own.words, codes.T))
        for _ in range(3):
            for book, c in zip(own.words, codes.T):
                rest += book[c]
                _means(rest, c, book)
                rest -= book[c]
        return own

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) and squared norms of the sums that they stand for."""
        codes, norms = np.empty((len(x), len(self.words)), np.int64), np.empty(len(x), np.float32)
        half = 0.5 * (self.words**2).sum(2)
        for at in range(0, len(x), 512):
            part = x[at : at + 512].astype(np.float32)
            n, rows = len(part), np.arange(len(part))[:, None]
            rest, error, chosen = part[:, None, :], (part**2).sum(1)[:, None], np.zeros((n, 1, 0), np.int64)
            for book, offset in zip(self.words, half):
                flat = np.ascontiguousarray(rest).reshape(-1, part.shape[1]) @ (-2 * book.T)
                flat += 2 * offset
                flat += error.reshape(-1, 1)
                flat = flat.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
                parent, word = best // len(book), best % len(book)
                error = flat[rows, best]
                rest = rest[rows, parent] - book[word]
                chosen = np.concatenate([chosen[rows, parent], word[:, :, None]], axis=2)
            final = error.argmin(1)
            codes[at : at + n] = chosen[rows[:, 0], final]
            norms[at : at + n] = ((part - rest[rows[:, 0], final]) ** 2).sum(1)
        return codes, norms


def _means(x: np.ndarray, group: np.ndarray, out: np.ndarray) -> None:
    """Sets the rows of out whose group has members to their mean."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    out[group[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]


def levelled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one, so that no square is lost to the range of doubles. Exact, but for components lost beside that one."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = levelled(x)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, embedding array<double>) of the rows that take part: an id, and a vector of the usual length without nulls and non-finite components, that is not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(finite)
    usual = rows.groupBy(F.size("embedding").alias("usual")).count().orderBy(F.desc("count"), "usual").limit(1).select("usual")
    return rows.join(F.broadcast(usual), F.size("embedding") == F.col("usual"), "left_semi")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _folder(path: str, part: str, columns: list[str]) -> pa.Table | None:
    """The rows of one partition folder of a Parquet table; None where there is none."""
    system, at = opened(f"{path}/{part}")
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    files = [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read(columns) for f in sorted(files)])


def _shortlists(part: pa.Table, products: np.ndarray, asked: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], shortlist: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each query has found, ids and scores, with the codes of one more shard: the best `shortlist`, ties to the smaller id. products: of codebooks, queries and words."""
    ids = part.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, norm = ids[order], part.column("norm").to_numpy()[order]
    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T.astype(np.intp)
    keep, out = min(shortlist + 1, len(ids)), []
    for i, (before, scores) in enumerate(found):
        score = -0.5 * norm
        for table, own in zip(products[:, i], code):
            score += table[own]
        # every row better than the last one kept, then its equals by vec_id
        bound = np.partition(score, len(ids) - keep)[len(ids) - keep]
        above, equal = np.flatnonzero(score > bound), np.flatnonzero(score == bound)
        new = np.concatenate([above, equal[: keep - len(above)]])
        new = new[ids[new] != asked[i]]
        both, near = np.concatenate([before, ids[new]]), np.concatenate([scores, score[new]])
        best = np.lexsort((both, -near))[:shortlist]
        out.append((both[best], near[best]))
    return out


def search(vectors: DataFrame, every: int = 50, k: int = 5, shortlist: int = SHORTLIST, shard_rows: int = SHARD_ROWS, block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k found nearest of all others by cosine.

    Nearest first, ties to the smaller vec_id. A row with a null id, and one whose vector is null, zero, of
    another length than most, or holds null or non-finite components, takes no part. Rows that repeat a vec_id
    are candidates once, by their smallest vector. A query without candidates has no row, one with fewer than k has all.

    Of equal vectors only the k + 1 rows of smallest vec_id are coded: no other one can be among any query's k.
    Codes are stored by shard and queries by block; a task reads its block, and shard after shard, from there, so neither is
    shuffled or held more than once. The codebooks, of bounded size, are fitted on `sample` rows and broadcast.
    """
    rows = written(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not len(fit):
        return empty
    books = Codebooks.fitted(unit(_matrix(fit.column("embedding"))))
    words = rows.sparkSession.sparkContext.broadcast(books.words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(words.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes, norms = own.encode(unit(_matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norms, pa.float32())], ["vec_id", "code", "norm"])

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).select("vec_id", "embedding")
    index = written(distinct.mapInArrow(encode, "vec_id long, code binary, norm float"), "codes")
    queries = rows.where(F.col("vec_id") % every == 0)
    spark = rows.sparkSession
    shards, blocks = -(-index.count() // shard_rows), -(-queries.count() // block)
    if not blocks:
        return empty
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    codes_at, asked_at = scratch(spark, "shards"), scratch(spark, "asked")
    index.withColumn("shard", deal(shards)).repartition("shard").write.partitionBy("shard").parquet(codes_at)
    queries.withColumn("block", deal(blocks)).repartition("block").write.partitionBy("block").parquet(asked_at)
    # a task takes a block of queries through a span of shards; with blocks enough for all cores, through all of them
    spans = min(shards, -(-2 * spark.sparkContext.defaultParallelism // blocks))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                own = _folder(asked_at, f"block={task // spans}", ["vec_id", "embedding"])
                if own is None:
                    continue
                asked, q = own.column("vec_id").to_numpy(), unit(_matrix(own.column("embedding"))).astype(np.float32)
                products = np.einsum("qd,bwd->bqw", q, words.value, optimize=True)
                found = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(asked)
                for shard in range(task % spans, shards, spans):
                    part = _folder(codes_at, f"shard={shard}", ["vec_id", "code", "norm"])
                    if part is not None:
                        found = _shortlists(part, products, asked, found, shortlist)
                sizes = [len(ids) for ids, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.float64))], ["query_id", "vec_id", "near"])

    near = spark.range(blocks * spans, numPartitions=blocks * spans).mapInArrow(best, "query_id long, vec_id long, near double")
    listed = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    short = near.withColumn("_n", F.row_number().over(listed)).where(F.col("_n") <= shortlist).select("query_id", "vec_id")
    pairs = short.join(rows, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = levelled(_matrix(batch.column(2))), levelled(_matrix(batch.column(3)))
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "embedding", "query").mapInArrow(cosine, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
