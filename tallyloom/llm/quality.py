"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import documents, held_in_fold, slices
from tallyloom.llm.labelled import labelled_sample

#: Hashed terms: words, word shapes, and one each for words that repeat the last one and for empty texts.
WORD_TERMS, SHAPE_TERMS = 1536, 510
TERMS = WORD_TERMS + SHAPE_TERMS + 2
#: Length of a vector; labelled documents broadcast, at most; neighbours that vote.
DIMENSIONS, LABELLED, NEIGHBOURS = 64, 6000, 15
#: Shapes of words whose terms a worker remembers.
MEMORY = 200_000
_RUN = re.compile(r"(.)\1+")


class _Kinds(dict):
    """Letters as A, a or 9 by kind, other characters as they are, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


class Terms:
    def __init__(self) -> None:
        self.shapes: dict[str, int] = {}

    def _shape(self, kinds: str) -> int:
        """The term of a word's kinds of letters, with runs as one."""
        found = self.shapes.get(kinds)
        if found is None:
            if len(self.shapes) >= MEMORY:
                self.shapes.clear()
            found = WORD_TERMS + zlib.crc32(_RUN.sub(r"\1", kinds).encode()) % SHAPE_TERMS
            if len(kinds) <= 64:  # a bound of memory, not of the shape
                self.shapes[kinds] = found
        return found

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word term and the shape term of each word. Words hold no line break, so all are lowered and turned to kinds at once."""
        joined = "\n".join(words)
        lowered, kinds = joined.lower().encode().split(b"\n"), joined.translate(_KINDS).split("\n")
        return np.fromiter(map(zlib.crc32, lowered), np.int64) % WORD_TERMS, np.fromiter(map(self._shape, kinds), np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """A row of term counts for each text. The words of all texts are split by Arrow, and each distinct one is looked up once."""
        rows, lists = len(texts), pc.utf8_split_whitespace(texts)
        words = lists.flatten()
        whole = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # space at an end leaves an empty word
        row = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))[whole]
        coded = words.filter(pa.array(whole)).dictionary_encode()
        word, shape = self.of(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy(zero_copy_only=False)
        at = row * TERMS
        out = np.bincount(np.concatenate([at + word[code], at + shape[code]]), minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32)
        same = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        out[:, -2] = np.bincount(row[1:][same], minlength=rows)
        out[:, -1] = np.bincount(row, minlength=rows) == 0
        return out


_terms = Terms()


@dataclass
class LatentSpace:
    idf: np.ndarray
    projection: np.ndarray

    @classmethod
    def fitted(cls, counts: np.ndarray, frequencies: np.ndarray, documents: int, dimensions: int = DIMENSIONS) -> LatentSpace:
        """The leading right singular vectors of the weighted term counts of a sample. frequencies: of how many of all documents has each term."""
        idf = (np.log((1 + documents) / (1 + frequencies)) + 0.2).astype(np.float32)
        weighted = cls(idf, np.eye(1, dtype=np.float32)).weighted(counts)
        values, vectors = np.linalg.eigh(weighted.T @ weighted)
        return cls(idf, np.ascontiguousarray(vectors[:, ::-1][:, :dimensions], np.float32))

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        out = np.log1p(counts) * self.idf
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = self.weighted(counts) @ self.projection
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Labels of the nearest known vectors, weighted by a power of their cosines, which are computed exactly in blocks."""
    out = np.empty(len(vectors))
    keep = min(neighbours, len(known))
    for at in range(0, len(vectors), 256):
        cosine = vectors[at : at + 256] @ known.T
        near = np.argpartition(-cosine, keep - 1, axis=1)[:, :keep]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 1e-3, 1).astype(np.float64) ** 4
        out[at : at + 256] = (weight * labels[near]).sum(1) / weight.sum(1)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches):
            seen += (_terms.counts(batch.column(0)) > 0).sum(0)
            n += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["term", "n"])

    sums = documents(docs).select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS, np.int64)
    for row in sums:
        if row["term"] >= 0:
            out[row["term"]] = row["n"]
    return out, sum(row["n"] for row in sums if row["term"] < 0)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, threshold: float = 0.7, labelled: int = LABELLED, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1, higher: good quality likelier), predicted (score >= threshold).

    labels (doc_id, quality) teach only outside the fold held out; lang, source, labels and doc_id are inputs of no
    score. Null text counts as empty; an empty text has a term of its own. Null and repeated ids pass through.
    Without labels every score is 0.5. Other columns are not read.

    The space and the labelled vectors come from at most `labelled` documents, so what is broadcast is bounded. Terms
    are weighted by their frequencies over all documents, which tasks count and Spark sums: there are 2,048 terms.
    """
    rows = labelled_sample(docs, labels, "quality", folds, out, labelled, False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sparse = [(at := np.flatnonzero(c).astype(np.int32), c[at]) for c in _terms.counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([s[0] for s in sparse], pa.list_(pa.int32())), pa.array([s[1] for s in sparse], pa.list_(pa.float32()))], ["label", "terms", "counts"])

    table = rows.mapInArrow(count, "label int, terms array<int>, counts array<float>").toArrow()
    if table.num_rows:
        dense = np.zeros((table.num_rows, TERMS), np.float32)
        for i, (at, n) in enumerate(zip(table.column("terms").to_pylist(), table.column("counts").to_pylist())):
            dense[i, at] = n
        frequencies, n = document_frequencies(docs)
        space = LatentSpace.fitted(dense, frequencies, n)
        known, marks = space.vectors(dense), table.column("label").to_numpy().astype(np.float64)
        del dense
        model = docs.sparkSession.sparkContext.broadcast((space, known, marks))
    else:
        model = None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                space, known, marks = model.value
                scores = vote(space.vectors(_terms.counts(batch.column(1))), known, marks, neighbours)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_in_fold(F.col("doc_id"), folds, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
