"""The most like names of many, exactly, without scoring all pairs.

Names are dealt into shards of bounded size, texts into blocks. Where a block meets a shard, an index of the shard's characters, words and
runs of digits gives for a text an upper bound of its score with every name. Those with the highest bounds get a closer one, by the longest common
subsequence of many names at once; names are scored in falling order of it until what is found beats the next bound. No bound is below its
score, so the rows are those of scoring everything.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import fuzzy

#: Names of a shard and texts of a block, at most but for the unevenness of a hash.
SHARD_NAMES, BLOCK_TEXTS = 100_000, 4_000
#: Bounds may be above the score by a rounding, never below.
SLACK = 1e-7
#: A character in more than this share of names has a count for every name, others a list of the names that hold it.
COMMON = 1 / 16
#: Names that get a closer bound at first, and at once at most; texts of more characters have none.
CLOSER, AT_ONCE, BITS = 1024, 8192, 64


class Letters:
    """Texts as one array of the numbers of their characters, for common subsequences of one text with many."""

    def __init__(self, texts: list[str]):
        whole = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.known, flat = np.unique(whole, return_inverse=True)
        self.flat = np.append(flat + 1, 0).astype(np.min_scalar_type(len(self.known) + 1))  # 0 is no character
        self.length = np.array([*map(len, texts)], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def common(self, text: str, at: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of text, of 64 characters at most, and each of the texts at these places; a row of the table is the bits of one number."""
        masks = np.zeros(len(self.known) + 1, np.uint64)
        for i, c in enumerate(text):
            k = int(np.searchsorted(self.known, ord(c)))
            if k < len(self.known) and self.known[k] == ord(c):
                masks[k + 1] |= np.uint64(1 << i)
        full, out = np.uint64((1 << len(text)) - 1), np.zeros(len(at), np.int64)
        for a in range(0, len(at), AT_ONCE):
            part = at[a : a + AT_ONCE]
            start, length = self.start[part], self.length[part]
            row = np.full(len(part), full)
            for p in range(int(length.max(initial=0))):
                hit = row & masks[self.flat[np.where(p < length, start + p, -1)]]
                row = (row + hit) | (row - hit)
            out[a : a + AT_ONCE] = len(text) - np.bitwise_count(row & full).astype(np.int64)
        return out


class NameIndex:
    """An index of names (ord, text), for the best of them by either score. scored: how many pairs were scored so far."""

    def __init__(self, ords: np.ndarray, names: list[str]):
        order = np.argsort(ords, kind="stable")
        self.ords, self.names, self.scored = ords[order], [names[i] for i in order], 0
        self._asked: tuple = (None, (), None)
        self.forms = [fuzzy.cleaned(n) for n in self.names]
        words = [f.split() for f in self.forms]
        distinct = [set(w) for w in words]
        count = lambda of: np.array([*of], np.int64)
        self.length, self.spaces = count(map(len, self.forms)), count(f.count(" ") for f in self.forms)
        self.sorted_length, self.n_words = count(len(" ".join(w)) for w in words), count(map(len, words))
        self.set_length, self.n_distinct = count(len(" ".join(w)) for w in distinct), count(map(len, distinct))
        self.in_order, self.in_set = Letters(self.forms), Letters([" ".join(sorted(w)) for w in distinct])
        self.holds = _lists((w, i) for i, own in enumerate(distinct) for w in own)
        self.codes = _lists((c, i) for i, n in enumerate(self.names) for c in {r[a:b] for r in fuzzy.codes(n) for a in range(len(r) - 2) for b in range(a + 3, len(r) + 1)})
        self.counts: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]] = {}
        chars: dict[str, dict[int, int]] = {}
        for i, f in enumerate(self.forms):
            for c in f:
                own = chars.setdefault(c, {})
                own[i] = own.get(i, 0) + 1
        chars.pop(" ", None)
        for c, own in chars.items():
            at, n = count(own), count(own.values())
            if len(at) > COMMON * len(names):
                dense = np.zeros(len(names), np.min_scalar_type(int(n.max())))
                dense[at] = n
                self.counts[c] = dense
            else:
                self.counts[c] = at, n

    def _shared(self, form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each name: characters but spaces that both have, words that both have, and the length of these joined."""
        common = np.zeros(len(self.names), np.int32)
        for c in set(form) - {" "}:
            own, n = self.counts.get(c), form.count(c)
            if isinstance(own, tuple):
                common[own[0]] += np.minimum(own[1], n).astype(np.int32)
            elif own is not None:
                common += np.minimum(own, min(n, np.iinfo(own.dtype).max))
        n_both, length = np.zeros(len(self.names), np.int32), np.zeros(len(self.names), np.int32)
        for w in set(form.split()):
            at = self.holds.get(w)
            if at is not None:
                n_both[at] += 1
                length[at] += len(w)
        return common, n_both, length + np.maximum(n_both - 1, 0)

    def _set_bound(self, form: str, common: np.ndarray, n_both: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Upper bounds of the token-set ratio."""
        words = set(form.split())
        length = len(" ".join(words))
        bound = 200.0 * (common + np.minimum(self.n_distinct, len(words)) - 1) / np.maximum(self.set_length + length, 1)
        at = np.flatnonzero(n_both)
        part = np.maximum(bound[at], 200.0 * both[at] / (both[at] + np.minimum(self.set_length[at], length)))
        bound[at] = np.where((n_both[at] == len(words)) | (n_both[at] == self.n_distinct[at]), 100.0, part)
        return np.clip(bound, 0.0, 100.0)

    def _weighted_bound(self, form: str, common: np.ndarray, n_both: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Upper bounds of the weighted ratio."""
        n, words = len(form), form.split()
        shorter = np.maximum(np.minimum(self.length, n), 1)
        plain = 200.0 * (common + np.minimum(self.spaces, form.count(" "))) / np.maximum(self.length + n, 1)
        in_order = 200.0 * (common + np.minimum(self.n_words, len(words)) - 1) / np.maximum(self.sorted_length + len(" ".join(words)), 1)
        alike = np.maximum(plain, 0.95 * np.maximum(in_order, self._set_bound(form, common, n_both, both)))
        # a stretch of the longer text that has all that is common and nothing else
        most = common + np.maximum(self.spaces, form.count(" "))
        stretch = np.minimum(200.0 * most / (np.maximum(np.minimum(self.set_length, len(" ".join(set(words)))), 1) + most), 100.0)
        scale = np.where(np.maximum(self.length, n) / shorter <= 8, 0.9, 0.6)
        unlike = np.maximum(plain, np.where(n_both > 0, np.maximum(scale * stretch, 0.95 * scale * 100.0), scale * stretch))
        bound = np.where(np.maximum(self.length, n) / shorter < 1.5, alike, unlike)
        return np.where(self.length > 0, np.minimum(bound, 100.0), 0.0)

    def _closer_set(self, form: str, at: np.ndarray, common: np.ndarray, n_both: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Closer upper bounds of the token-set ratio at these places: behind the words that both have, what is left of the text and the name's words in order."""
        words = sorted(set(form.split()))
        length = len(" ".join(words))
        has = np.zeros(len(self.names), np.uint64)
        for j, w in enumerate(words):
            has[self.holds.get(w, [])] |= np.uint64(1 << j)
        has, bound = has[at], np.full(len(at), 100.0)
        for kind in np.unique(has).tolist():
            mine = np.flatnonzero(has == kind)
            rest, place = " ".join(w for j, w in enumerate(words) if not kind >> j & 1), at[mine]
            ahead = both[place] + (n_both[place] > 0)
            alike = 200.0 * (ahead + self.in_set.common(rest, place)) / np.maximum(self.set_length[place] + length, 1)
            part = 200.0 * both[place] / np.maximum(both[place] + np.minimum(self.set_length[place], length), 1)
            covered = (n_both[place] > 0) & ((n_both[place] == len(words)) | (n_both[place] == self.n_distinct[place]))
            bound[mine] = np.where(covered, 100.0, np.maximum(alike, part))
        return bound

    def _closer_weighted(self, form: str, at: np.ndarray, common: np.ndarray, n_both: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Closer upper bounds of the weighted ratio at these places: the ratio as it is, and no stretch has more in common than the whole text."""
        n, words, length = len(form), form.split(), self.length[at]
        same, most = self.in_order.common(form, at), common[at] + np.maximum(self.spaces[at], form.count(" "))
        plain = 200.0 * same / np.maximum(length + n, 1)
        in_order = 200.0 * (common[at] + np.minimum(self.n_words[at], len(words)) - 1) / np.maximum(self.sorted_length[at] + len(" ".join(words)), 1)
        alike = np.maximum(plain, 0.95 * np.maximum(in_order, self._closer_set(form, at, common, n_both, both)))
        shorter = np.maximum(np.minimum(length, n), 1)
        stretch = 200.0 * same / (shorter + same)
        apart = np.minimum(200.0 * most / (np.maximum(np.minimum(self.set_length[at], len(" ".join(set(words)))), 1) + most), 100.0)
        scale = np.where(np.maximum(length, n) / shorter <= 8, 0.9, 0.6)
        unlike = np.maximum(np.maximum(plain, scale * stretch), 0.95 * scale * np.where(n_both[at] > 0, 100.0, apart))
        return np.where(np.maximum(length, n) / shorter < 1.5, alike, unlike)

    def best(self, text: str, k: int, score: str = "weighted", least: float = 0.0, coded: bool = False) -> list[tuple[float, int]]:
        """(score, place) of the k names with the highest score of at least `least`, equals by ord. coded: only of those that hold a code of the text."""
        form = fuzzy.cleaned(text)
        exact, bounds, closer = (fuzzy.weighted, self._weighted_bound, self._closer_weighted) if score == "weighted" else (fuzzy.token_set, self._set_bound, self._closer_set)
        if self._asked[0] != (form, score):  # a text is often asked for with codes and without
            shared = self._shared(form)
            self._asked = (form, score), shared, bounds(form, *shared) + SLACK
        _, shared, bound = self._asked
        if coded:
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.codes.get(c, np.zeros(0, np.int64)) for c in set(fuzzy.codes(text)))]))
        else:
            at = np.flatnonzero(bound >= least)
        found: list[tuple[float, int]] = []
        step = max(CLOSER, 2 * k)
        while len(at):
            # the next names by bound; the rest waits, unsorted
            if len(at) > step:
                cut = np.partition(bound[at], len(at) - step)[len(at) - step]
                now, at = at[bound[at] >= cut], at[bound[at] < cut]
            else:
                now, at = at, at[:0]
            near = np.minimum(bound[now], closer(form, now, *shared) + SLACK) if len(form) <= BITS else bound[now]
            worst = -found[-1][0] if len(found) >= k else least
            now, near = now[near >= worst], near[near >= worst]
            for n in np.lexsort((now, -near)).tolist():
                if len(found) >= k and near[n] < -found[-1][0]:
                    break
                self.scored += 1
                value = exact(form, self.forms[now[n]])
                if value >= least:
                    insort(found, (-value, int(now[n])))
                    del found[k:]
            if len(found) >= k:
                at = at[bound[at] >= -found[-1][0]]
            step *= 4
        return [(-value, i) for value, i in found]


def _lists(pairs) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for key, i in pairs:
        out.setdefault(key, []).append(i)
    return {k: np.array(v) for k, v in out.items()}


def against_names(texts: DataFrame, keys: DataFrame, take: Callable[[NameIndex, str], list[tuple]], columns: str, shard_names: int = SHARD_NAMES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(text, columns..): what take makes of each distinct text that is not null and the index of each shard of keys (ord long, key string).

    Both go to the pairs of a block and a shard by shuffle: nothing is broadcast, nothing comes to the driver but two counts.
    """
    spark = texts.sparkSession
    texts = texts.select("text").where("text is not null").distinct()
    shards = max(1, -(-keys.count() // shard_names))
    n, cores = texts.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_texts), min(-(-n // 16), -(-cores // shards)))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    asked = texts.select("text", deal("text", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    named = keys.select("ord", "key", deal("ord", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    names = ["text", *(c.split()[0] for c in columns.split(", "))]
    # a number of its own, as each pair is work for a task however few its bytes are; more than there are pairs, so that few share one
    dealt = lambda df: df.repartition(min(4 * blocks * shards, max(2_000, blocks * shards)), "block", "shard").groupBy("block", "shard")

    def meet(asked: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or named.empty:
            return pd.DataFrame([], columns=names)
        index = NameIndex(named["ord"].to_numpy(), named["key"].tolist())
        return pd.DataFrame([(text, *found) for text in asked["text"] for found in take(index, text)], columns=names)

    return dealt(asked).cogroup(dealt(named)).applyInPandas(meet, f"text string, {columns}")
