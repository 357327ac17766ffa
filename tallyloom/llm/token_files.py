"""Token ids in binary files of patched frame-of-reference blocks, and their reading.

A file holds the ids of documents in order, one after the other, cut into blocks of BLOCK ids. A block
subtracts its minimum and packs what is left at a width that a share of its values fits; the values that do
not fit stand in an exception list. A footer has the start of every block and the documents' ids and lengths.

    magic, then for each block: minimum u32, exceptions u16, width u8, 0 u8, packed words u32...,
    exception places u16..., exception values u32...
    footer: block starts u64..., doc_id i64..., doc_id is set u8..., lengths u64...
    tail: blocks u64, documents u64, ids u64, footer start u64, magic
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import documents, opened, output_file, scratch, slices, written
from tallyloom.llm.bpe import Recent, byte_level, parts_of

MAGIC = b"TLPFOR1\n"
#: Ids of a block; a multiple of 32.
BLOCK = 4096
#: Blocks coded at once.
GROUP = 64
#: Parts of texts that a worker remembers in either of two generations: some 150 MB at most.
PARTS = 400_000
#: Arrow's expression for texts that parts_of cuts with more care: Python's white space before a space, or zero, in them.
AWKWARD = r"\x00|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
#: A letter (of Latin, Cyrillic or Chinese) before an ASCII character that is neither one nor a space.
LETTER_ENDS = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{4E00}-\x{9FA5}])([\x00-\x1F!-@\[-`{-\x7F])"
#: Share of a block's values that its width must fit.
SHARE = 0.95


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (n, BLOCK) of values below 2**width as words (n, width, lanes): 32 values below each other in a lane share `width` words."""
    lanes = values.shape[1] // 32
    columns = np.ascontiguousarray(values.reshape(len(values), 32, lanes).transpose(1, 0, 2), np.uint32)
    words = np.zeros((width, len(values), lanes), np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        words[word] |= columns[i] << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= columns[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(words.transpose(1, 0, 2))


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack."""
    n, _, lanes = words.shape
    rows = np.ascontiguousarray(words.transpose(1, 0, 2))
    out = np.empty((32, n, lanes), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        part = rows[word] >> np.uint32(shift)
        if shift + width > 32:
            part = part | rows[word + 1] << np.uint32(32 - shift)
        out[i] = part & mask
    return out.transpose(1, 0, 2).reshape(n, 32 * lanes)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Coded blocks of ids, whose number is a multiple of BLOCK."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint32)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    fit = np.partition(rest, int(BLOCK * SHARE) - 1, axis=1)[:, int(BLOCK * SHARE) - 1]
    widths = np.array([int(x).bit_length() for x in fit])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        width = int(width)
        own = np.flatnonzero(widths == width)
        part = rest[own]
        beyond = part >= np.uint64(1 << width)
        words = pack(part & np.uint32((1 << width) - 1), width).astype("<u4", copy=False)
        for k, at in enumerate(own):
            places = np.flatnonzero(beyond[k])
            out[at] = struct.pack("<IHBB", int(low[at]), len(places), width, 0) + words[k].tobytes() + places.astype("<u2").tobytes() + part[k][places].astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """The ids of coded blocks, one row for each; those of one width are unpacked together."""
    heads = [struct.unpack_from("<IHBB", b) for b in blocks]
    out = np.empty((len(blocks), BLOCK), np.uint32)
    widths = np.array([h[2] for h in heads])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = BLOCK // 32 * width
        out[own] = unpack(np.stack([np.frombuffer(blocks[k], "<u4", size, 8) for k in own]).reshape(len(own), width, BLOCK // 32), width) if width else 0
    for k, (low, n, width, _) in enumerate(heads):
        if n:
            end = 8 + BLOCK // 32 * width * 4
            out[k][np.frombuffer(blocks[k], "<u2", n, end)] = np.frombuffer(blocks[k], "<u4", n, end + 2 * n)
        out[k] += np.uint32(low)
    return out


class TokenFileWriter:
    """Writes documents' ids in the order given, holding no more than a group of blocks."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.held, self.n_held, self.at, self.starts, self.doc_ids, self.lengths = stream, [], 0, len(MAGIC), [], [], []
        stream.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids):
            self.starts.append(self.at)
            self.stream.write(block)
            self.at += len(block)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= GROUP * BLOCK:
            whole = np.concatenate(self.held)
            full = len(whole) // BLOCK * BLOCK
            self._blocks(whole[:full])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def close(self) -> int:
        """The number of ids."""
        total = sum(self.lengths)
        if self.n_held:
            rest = np.concatenate(self.held)
            self._blocks(np.concatenate([rest, np.full(-len(rest) % BLOCK, rest[-1], rest.dtype)]))
        known = np.array([x is not None for x in self.doc_ids], bool)
        self.stream.write(np.array(self.starts, "<u8").tobytes() + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + known.astype("u1").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.stream.write(struct.pack("<QQQQ", len(self.starts), len(self.doc_ids), total, self.at) + MAGIC)
        self.stream.close()
        return total


class TokenFile:
    """Reads a file of TokenFileWriter; any span of ids is read by way of the block starts."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        tail = len(MAGIC) + 32
        size = self.file.size()
        data = self.file.read_at(tail, size - tail)
        if data[32:] != MAGIC:
            raise ValueError(f"{uri} is no token file or is cut short")
        blocks, documents_, self.n_ids, self.end = struct.unpack_from("<QQQQ", data)
        footer = self.file.read_at(size - tail - self.end, self.end)
        self.starts = np.append(np.frombuffer(footer, "<u8", blocks), np.uint64(self.end)).astype(np.int64)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(footer, "<i8", documents_, at)
        self.known = np.frombuffer(footer, "u1", documents_, at + 8 * documents_).astype(bool)
        self.lengths = np.frombuffer(footer, "<u8", documents_, at + 9 * documents_).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file on."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        data = memoryview(self.file.read_at(int(self.starts[last + 1] - self.starts[first]), int(self.starts[first])))
        base = self.starts[first]
        values = decode_blocks([data[self.starts[b] - base : self.starts[b + 1] - base] for b in range(first, last + 1)]).reshape(-1)
        return values[start - first * BLOCK : start - first * BLOCK + n]

    def documents(self, span: int = GROUP * BLOCK) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, number of ids and their pieces, of each document in order. A piece must be read before the next document is."""
        at, held_at, held = 0, 0, np.zeros(0, np.uint32)

        def pieces(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal held_at, held
            while n:
                if not held_at <= start < held_at + len(held):
                    held_at = start // BLOCK * BLOCK
                    held = self.ids(held_at, min(span, self.n_ids - held_at))
                piece = held[start - held_at : start - held_at + n]
                yield piece
                start, n = start + len(piece), n - len(piece)

        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist()):
            yield doc_id if known else None, n, pieces(at, n)
            at += n


class LibraryEncoder:
    """Ids of texts as the tokenizers library gives them; it encodes each part once and remembers it.

    Parts end where no word of a byte-level BPE can span: before a space that follows no white space, and between a
    letter and an ASCII character that is none. Texts with an added token in them, and all texts with a tokenizer of
    another kind, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # "\u0120" stands for a space in the vocabulary
        self.begins_space = np.array([(self.tokenizer.id_to_token(i) or "")[:1] in ("\u0120", " ") for i in range(self.tokenizer.get_vocab_size())], bool)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.cuts = byte_level(json.load(f))
        self.part = Recent(PARTS)

    def library(self, parts: list[str]) -> list[bytes]:
        """Ids of parts. Those that follow a space go through the library as one text, which is cut before each token that begins with a space: a part has no other."""
        ids = lambda e: np.array(e.ids, "<u4")
        if len(parts) > 2048:
            return [x for at in range(0, len(parts), 2048) for x in self.library(parts[at : at + 2048])]
        led, out = [k for k, p in enumerate(parts) if p[:1] != "\0"], [b""] * len(parts)
        if led:
            found = ids(self.tokenizer.encode_batch_fast(["".join(" " + parts[k] for k in led)], add_special_tokens=False)[0])
            starts = np.flatnonzero(self.begins_space[found])
            if len(starts) == len(led):
                data, ends = found.tobytes(), (4 * np.append(starts[1:], len(found))).tolist()
                for k, a, b in zip(led, (4 * starts).tolist(), ends):
                    out[k] = data[a:b]
            else:
                for k, e in zip(led, self.tokenizer.encode_batch_fast([" " + parts[k] for k in led], add_special_tokens=False)):
                    out[k] = ids(e).tobytes()
        bare = [k for k, p in enumerate(parts) if p[:1] == "\0"]
        for k, e in zip(bare, self.tokenizer.encode_batch_fast([parts[k][1:] for k in bare], add_special_tokens=False)):
            out[k] = ids(e).tobytes()
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow cuts those without white space before a space, numbers their parts and leaves one of each to look up."""
        whole = np.full(len(texts), not self.cuts)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        awkward = pc.match_substring_regex(texts, AWKWARD).to_numpy(zero_copy_only=False) & ~whole
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        own = np.flatnonzero(whole)
        for k, e in zip(own.tolist(), self.tokenizer.encode_batch_fast(texts.take(pa.array(own)).to_pylist(), add_special_tokens=False)):
            out[k] = np.array(e.ids, np.uint32)
        own = np.flatnonzero(awkward)
        for k, values in zip(own.tolist(), self.part.filled([*map(parts_of, texts.take(pa.array(own)).to_pylist())], self.library)):
            out[k] = np.frombuffer(b"".join(values), "<u4")
        own = np.flatnonzero(~whole & ~awkward)
        if not len(own):
            return out
        # a part that no space begins stands after a zero, as parts_of has it
        marked = pc.binary_join_element_wise(pa.scalar("\0"), texts.take(pa.array(own)), "")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, LETTER_ENDS, "\\1 \0\\2"), " ")
        ends = np.cumsum(lists.value_lengths().to_numpy())
        coded = lists.flatten().dictionary_encode()
        values = self.part.filled([coded.dictionary.to_numpy(zero_copy_only=False).tolist()], self.library)[0]  # faster than to_pylist
        at = coded.indices.to_numpy()
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts, n = np.cumsum(lengths) - lengths, lengths[at]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(values), "<u4")[np.repeat(starts[at] - (upto - n), n) + np.arange(upto[-1])]
        last = upto[ends - 1].tolist()
        for k, a, b in zip(own.tolist(), [0, *last], last):
            out[k] = ids[a:b]
        return out


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One for each worker process and file, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Encodes every text, appends end_id and writes files in ascending doc_id order, null first; a row for each file: part, uri, documents, ids.

    Rows are ranged by doc_id, so that a task writes one file of neighbouring documents. A task that is run again
    writes under a new name; only the files that the returned rows name count. Those rows are a table by now.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        writer = None
        for batch in slices(batches, 4096):
            if writer is None:
                stream, uri = output_file(folder, f"{uuid.uuid4().hex}.tokens")
                writer = TokenFileWriter(stream)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            total = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "uri": [uri], "documents": [len(writer.lengths)], "ids": [total]})

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(write, "part int, uri string, documents long, ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files, read block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, n, pieces in TokenFile(uri).documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.astype("<u4", copy=False).tobytes(), crc)
                    rows.append((doc_id, before, n, crc))
                    before += n
                    if len(rows) == 65536:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows)] or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each file: their running sum is over files, not documents
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    # ranged by part, in as many partitions as files: a task reads one
    placed = files.select("uri", before.alias("before"), "part").repartitionByRange(max(1, files.count()), "part").drop("part")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what read_token_files finds in them.

    Null text counts as empty: end_id alone. Null doc_ids come first; repeated ids and rows are documents of their
    own, in any order among themselves. Other columns are not read. folder defaults to one in spark.checkpoint.dir.
    """
    return read_token_files(write_token_files(docs, path, folder or scratch(docs.sparkSession, "tokens"), end_id))
