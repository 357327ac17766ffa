"""Byte-level BPE with a segment tree over adjacent pair ranks.

The tree's leaves hold the ranks of a word's adjacent pairs, so that its root gives the leftmost merge of the
lowest rank. A merge changes three leaves; the loop ends when no pair has a rank. A word of n bytes takes
O(n log n), whatever it holds.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyloom.llm._shared import documents, slices

#: How a text is cut into words before merging: a fixed value of this kind of tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts and words of texts that a worker remembers, in either of two generations, and the longest of them: some 80 MB at most.
PARTS, WORDS_KEPT, MEMORY_CHARS = 160_000, 60_000, 64
#: White space before a space: where it occurs, a text is cut with more care.
_AWKWARD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
NONE = 1 << 62


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, as character to byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Recent(dict):
    """Remembers values of recent keys: two generations of about `most` keys each. Long keys are left out."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def filled(self, lists: list[list[str]], make: Callable[[list[str]], list]) -> list[list]:
        """The values of lists of keys; make gives those of keys that are not known."""
        found = [[*map(self.get, keys)] for keys in lists]
        gaps = [(values, keys, [i for i, v in enumerate(values) if v is None]) for values, keys in zip(found, lists) if None in values]
        fresh, new = {}, []
        for key in {keys[i] for _, keys, at in gaps for i in at}:
            value = self.older.get(key)
            if value is None:
                new.append(key)
            else:
                fresh[key] = value
        fresh.update(zip(new, make(new)))
        for values, keys, at in gaps:
            for i in at:
                values[i] = fresh[keys[i]]
        if len(self) + len(fresh) > self.most:
            self.older = dict(self)
            self.clear()
            fresh = dict(itertools.islice(fresh.items(), self.most))
        self.update((k, v) for k, v in fresh.items() if len(k) <= MEMORY_CHARS)
        return found


def parts_of(text: str) -> list[str]:
    """A text cut where no word of this kind of tokenizer can span: between a character and a space after it, unless that is white space too.

    A part that a single space begins stands as what follows the space, any other as itself after a zero.
    """
    if "\0" in text or _AWKWARD.search(text):
        return ["\0" + p for p in _CUT.split(text)]
    parts = text.split(" ")
    parts[0] = "\0" + parts[0]
    return parts


def byte_level(data: dict) -> bool:
    """Whether a tokenizer file is a plain byte-level BPE: words as in WORDS, each merged on its own, nothing normalized."""
    parts = [data.get("pre_tokenizer") or {}]
    parts = parts[0].get("pretokenizers", parts)
    plain = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex", True) for p in parts) and len(parts) == 1
    flags = any(t.get(k) for t in data["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    return plain and not (data.get("normalizer") or flags or data["model"].get("dropout") or data["model"].get("ignore_merges"))


def _check(data: dict) -> None:
    """Raises on a tokenizer file with a part that Codec does not follow."""
    if not byte_level(data):
        raise ValueError("only byte-level BPE without normalizer, prefix space and stripping added tokens is supported")


class Codec:
    """Encodes and decodes as the tokenizer file's byte-level BPE does, without its special-token templates."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        _check(data)
        vocab, chars = data["model"]["vocab"], byte_characters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.split_special = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.words = regex.compile(WORDS)
        self.word, self.part = Recent(WORDS_KEPT), Recent(PARTS)
        keys = np.array([*self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.rank.values()], np.int64)[order]
        self.merged_ids, self.byte_ids = np.array(self.merged, np.int64), np.array(self.byte_id, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE without."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """merge_word of each: words of up to 64 bytes in one matrix of trees for each width, in step."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths, out = np.array([*map(len, data)]), [b""] * len(words)
        for k in np.flatnonzero(lengths > 64):
            out[k] = self.merge_word(words[k])
        for width in (2, 4, 8, 16, 32, 64):
            own = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            for at in range(0, len(own), 4096):
                block = own[at : at + 4096]
                ids, counts = self._trees([data[k] for k in block], lengths[block], width)
                ends = (4 * np.cumsum(counts)).tolist()
                for k, a, b in zip(block.tolist(), [0, *ends], ends):
                    out[k] = ids[a:b]
        return out

    def _trees(self, data: list[bytes], lengths: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
        n, places = len(data), np.arange(width)
        inside = places < lengths[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = np.where(inside[:, 1:], self.ranks(ids[:, :-1], ids[:, 1:]), NONE)
        tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + places[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        following = np.tile(places + 1, (n, 1))
        previous = np.tile(places - 1, (n, 1))

        def put(rows: np.ndarray, place: np.ndarray, value: np.ndarray | int) -> None:
            at = place + width
            tree[rows, at] = value
            for _ in range(width.bit_length() - 1):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def leaf(rows: np.ndarray, place: np.ndarray, after: np.ndarray) -> np.ndarray:
            rank = self.ranks(ids[rows, place], ids[rows, after])
            return np.where(rank < NONE, rank * width + place, NONE)

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                return ids[ids >= 0].astype("<u4").tobytes(), (ids >= 0).sum(1)
            rank, at = root // width, root % width
            gone = following[rows, at]
            after = following[rows, gone]
            ids[rows, at], ids[rows, gone], following[rows, at] = self.merged_ids[rank], -1, after
            put(rows, gone, NONE)
            has = after < lengths[rows]
            put(rows[~has], at[~has], NONE)
            previous[rows[has], after[has]] = at[has]
            put(rows[has], at[has], leaf(rows[has], at[has], after[has]))
            before = previous[rows, at]
            has = before >= 0
            put(rows[has], before[has], leaf(rows[has], before[has], at[has]))

    def merge_word(self, word: str) -> bytes:
        """The ids of one word, by the segment tree, as little-endian 32-bit numbers."""
        ids = [self.byte_id[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return np.array(ids, "<u4").tobytes()
        rank, width = self.rank, 1 << (n - 1).bit_length()
        # a leaf is rank * n + place, so that the least one is the leftmost of the lowest rank
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[width + i] = r * n + i
        for at in range(width - 1, 0, -1):
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left < right else right
        following, previous = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, value: int) -> None:
            at = width + i
            if tree[at] == value:
                return
            tree[at] = value
            at >>= 1
            while at:
                left, right = tree[2 * at], tree[2 * at + 1]
                least = left if left < right else right
                if tree[at] == least:
                    return
                tree[at] = least
                at >>= 1

        while (root := tree[1]) != NONE:
            r, i = divmod(root, n)
            gone = following[i]
            after = following[gone]
            ids[i], ids[gone], following[i] = self.merged[r], -1, after
            put(gone, NONE)
            if after < n:
                previous[after] = i
                r = rank.get(ids[i] << 32 | ids[after])
                put(i, NONE if r is None else r * n + i)
            else:
                put(i, NONE)
            before = previous[i]
            if before >= 0:
                r = rank.get(ids[before] << 32 | ids[i])
                put(before, NONE if r is None else r * n + before)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Texts are cut into parts, parts into words; each is encoded once and remembered."""
        return [*map(b"".join, self.part.filled([*map(parts_of, texts)], self.encode_parts))]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_bytes(texts)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        pieces = [self.pieces(p[1:] if p[:1] == "\0" else " " + p) for p in parts]
        if not any(map(self.special.__contains__, itertools.chain.from_iterable(pieces))):
            return [x[0] if len(x) == 1 else b"".join(x) for x in self.word.filled(pieces, self.merge_words)]
        known = self.word.filled([[w for w in p if w not in self.special] for p in pieces], self.merge_words)
        special = {w: np.array([i], "<u4").tobytes() for w, i in self.special.items()}
        return [b"".join(special[w] if w in special else next(values) for w in own) for own, values in zip(pieces, map(iter, known))]

    def pieces(self, part: str) -> list[str]:
        """The words of a part, and the special tokens in it."""
        if self.split_special is None or not self.split_special.search(part):
            return self.words.findall(part)
        return [x for p in self.split_special.split(part) for x in ([p] if p in self.special else self.words.findall(p))]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and file, so that tasks share what it remembers, which is bounded."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256.

    Each text is encoded and its ids decoded again. Null text counts as empty: no ids. doc_id passes through, null
    or repeated; other columns are not read. Rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            counts, digests, decoded = [], [], []
            for ids in own.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id long, ids array<int>) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode_batch(batch.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id long, text string) of each row of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
