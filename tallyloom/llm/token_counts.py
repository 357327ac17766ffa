"""Exact token counts of texts of any length, by overlap resynchronisation.

A text beyond a chunk is encoded in chunks that overlap. Two neighbouring chunks are spliced at a place inside
the overlap where both have a token boundary, and that is proven stable: no piece of the vocabulary holds the
two characters beside it next to each other, so no merge of either chunk, or of the whole text, can span it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import documents, slices

#: Characters of a chunk, and by which chunks overlap at first.
CHUNK, OVERLAP = 32768, 256
#: Characters on either side of a place that are normalized to see whether the normalizer works across it.
NEAR = 16


class SpanCounter:
    """Counts the pieces of texts for one sentencepiece model."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=model_file), chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.adjacent = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.encoded = 0  # chunks so far, for tests

    def boundaries(self, text: str) -> list[int]:
        """Offsets at which the pieces of a text begin; those of one character's bytes share theirs."""
        self.encoded += 1
        return [begin for begin, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]]

    def normal(self, text: str) -> str:
        """What the model's normalizer makes of a text inside another one."""
        return self.model.normalize(f"a{text}a").lstrip("\u2581")[1:-1]

    def stable(self, text: str, at: int) -> bool:
        """True if the normalizer treats the two sides of a place apart, and no piece holds the normalized characters beside it next to each other."""
        left, right = self.normal(text[max(0, at - NEAR) : at]), self.normal(text[at : at + NEAR])
        if not left or not right or left + right != self.normal(text[max(0, at - NEAR) : at + NEAR]):
            return False
        return left[-1] + right[0] not in self.adjacent

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text, num_threads=1))
        total, at, counted, size = 0, 0, 0, self.chunk
        begins = self.boundaries(text[:size])
        while at + size < len(text):
            end, overlap = at + size, self.overlap
            while True:
                start = max(counted, end - overlap)
                if start <= counted:  # nothing in the whole chunk: a longer chunk takes its place
                    size *= 2
                    begins = self.boundaries(text[at : at + size])
                    break
                following = self.boundaries(text[start : start + size])
                common = {b + at for b in begins} & {b + start for b in following}
                splice = next((p for p in sorted(common, reverse=True) if start < p < end and self.stable(text, p)), 0)
                if splice:
                    total += sum(counted <= b + at < splice for b in begins)
                    at, counted, begins, size = start, splice, following, self.chunk
                    break
                overlap *= 2
        return total + sum(b + at >= counted for b in begins)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above limit).

    Null text counts as empty: 0 bytes, 0 tokens. doc_id passes through, null or repeated. Other columns are not
    read. Rows are independent; a task holds a few texts and one chunk's pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SpanCounter(model_file, chunk, overlap)
        for batch in slices(batches):
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
