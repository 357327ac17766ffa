"""Near-duplicates by SimHash: tiled exact comparison of fingerprints with numpy exclusive-or and bit counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import decided, documents, left_by_key, slices, split_by_members, trimmed, written
from tallyloom.llm.components import connected_components

#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Fingerprints of a tile.
TILE = 32768
#: Fixed odd numbers that derive further 64-bit words of a fingerprint from one hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Least hashes of a text under which it meets others: texts with shingle similarity s share none with probability (1 - s) ** KEYS.
KEYS = 12
#: Prints of a tile where they come with their sets.
SETS_TILE = 2048


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle, in order; a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """`words` 64-bit words whose bits are 1 if set in over half of the hashes; zero without hashes.

    The first word is of the hashes themselves, each further one of their products with a fixed odd number, mixed.
    """
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        for w in range(words):
            if w:
                block = hashes[at : at + BLOCK] * np.uint64(MIX[w - 1])
                block ^= block >> np.uint64(31)
                block *= np.uint64(MIX[-w])
                block ^= block >> np.uint64(29)
            counts[64 * w : 64 * w + 64] += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64) if len(hashes) else np.zeros(words, np.uint64)


def least_hashes(hashes: np.ndarray, keys: int) -> np.ndarray:
    """The least of the hashes in each of `keys` orders; zeros without hashes."""
    odd = np.array([xxhash.xxh64_intdigest(bytes([k]), 42) | 1 for k in range(keys)], np.uint64)
    least = np.full(keys, np.iinfo(np.uint64).max) if len(hashes) else np.zeros(keys, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK] ^ (hashes[at : at + BLOCK] >> np.uint64(32))
        for k in range(keys):
            least[k] = min(least[k], (block * odd[k]).min())
    return least


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, keys: int = 0) -> DataFrame:
    """(doc_id long, fp binary, shingles long, keys array of binary) of each row: fp has 8 * words bytes, little-endian words, keys the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, sizes, least = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                prints.append(fingerprint(hashes, words).tobytes())
                sizes.append(len(hashes))
                least.append([k.tobytes() for k in least_hashes(hashes, keys)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.binary()))], ["doc_id", "fp", "shingles", "keys"])

    return documents(docs).mapInArrow(run, "doc_id long, fp binary, shingles long, keys array<binary>")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Where each row of a (n, words) is within the radius of each row of b."""
    distance = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    if a.shape[1] > 1:
        distance = distance.astype(np.uint16)
        for w in range(1, a.shape[1]):
            distance += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return distance <= radius


def forest(prints: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray | None, radius: int, ratio: float, sets: list[bytes] | None = None, similarity: float = 0.0, least: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the links between rows `first` and `second`, or among `first`; at most an edge for each row.

    Both are ordered by size; a block of rows meets only those whose sizes are within the ratio. With the rows' sets
    (64-bit words, sorted) a link counts only if they share `similarity` of their union, and with least hashes (64-bit words in
    one order) only if one of these is the same; what links joined already needs no such check.
    """
    root = np.arange(len(prints))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if sets is not None:
        lengths = np.array([len(x) // 8 for x in sets])
        ends = np.cumsum(lengths)
        members = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
        own = [members[e - n : e] for e, n in zip(ends, lengths)]
        mark = np.zeros(len(members) + 1, np.int64)
        keys = np.frombuffer(b"".join(least), np.uint64).reshape(len(sets), -1) if least and least[0] else None

    def verified(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        for i in np.unique(x).tolist():
            others = np.array([j for j in y[x == i].tolist() if find(i) != find(j)], np.int64)
            if keys is not None:
                others = others[(keys[others] == keys[i]).any(1)]
            if not len(others):
                continue
            mark[own[i]] = 1
            shared = np.add.reduceat(mark[np.concatenate([own[j] for j in others])], np.append(0, np.cumsum(lengths[others])[:-1]))
            mark[own[i]] = 0
            yield from ((i, j) for j in others[shared >= similarity * (lengths[i] + lengths[others] - shared) - 1e-9].tolist())

    left, right = [], []
    other = first if second is None else second
    first, other = first[np.argsort(sizes[first], kind="stable")], other[np.argsort(sizes[other], kind="stable")]
    others = sizes[other]
    for at in range(0, len(first), 128):
        block = first[at : at + 128]
        low, high = (np.searchsorted(others, sizes[block[0]] * ratio - 1e-9), np.searchsorted(others, sizes[block[-1]] / ratio + 1e-9, "right")) if ratio else (0, len(other))
        for begin in range(low, high, 1024):
            part = other[begin : min(high, begin + 1024)]
            x, y = np.nonzero(_near(prints[block], prints[part], radius))
            if not len(x):
                continue
            x, y = block[x], part[y]
            while (root != (flat := root[root])).any():
                root[:] = flat
            new = x < y if second is None else x != y
            if ratio:
                new &= np.minimum(sizes[x], sizes[y]) >= ratio * np.maximum(sizes[x], sizes[y]) - 1e-9
            new &= root[x] != root[y]  # what is joined already needs no edge
            for i, j in zip(x[new].tolist(), y[new].tolist()) if sets is None else verified(x[new], y[new]):
                if (a := find(i)) != (b := find(j)):
                    root[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def near_links(prints: DataFrame, radius: int, words: int = 1, ratio: float = 0.0, tile: int = TILE, similarity: float = 0.0) -> DataFrame:
    """(a long, b long): edges between ids of prints that span the components of all links.

    prints: (id long, fp binary of 8 * words bytes, size long), each fp once, or (.., bucket binary), each fp once in a bucket. Two link if `radius` or fewer bits differ, and
    where ratio is above 0 if the smaller size is at least that share of the larger. With columns set and least (binary), two link only
    if besides their sets have that similarity and one of their least hashes is the same, as forest says.

    Rows meet in buckets, the given ones where there is such a column. Else, with a radius below 4 and 64 bits, of any two linked prints 4 - radius of the four
    16-bit bands are equal, so a bucket is a choice of bands and their values: each link falls in one at least.
    Otherwise there is one bucket of all rows. A bucket of over `tile` rows is cut into tiles by class of bit
    count, radius + 1 wide, and a salt; a pair of tiles is compared, in a task of its own, only if the classes
    are the same or neighbours, as else the bit counts differ beyond the radius. So no task holds more than two
    tiles however many rows share a bucket.
    """
    ones = F.lit(0)
    for at in range(1, 8 * words, 4):
        ones = ones + F.bit_count(F.conv(F.hex(F.substring("fp", at, 4)), 16, 10).cast("long"))
    given = ["bucket"] if "bucket" in prints.columns else []
    known = ["set", "least"] if "set" in prints.columns else []
    rows = prints.select("id", "fp", "size", *known, *given, F.floor(ones / (radius + 1)).cast("int").alias("ones"))
    if given:
        pass
    elif words == 1 and radius < 4:
        choices = list(itertools.combinations(range(4), 4 - radius))
        keys = [F.concat(F.lit(bytes([k])), *(F.substring("fp", 2 * band + 1, 2) for band in choice)) for k, choice in enumerate(choices)]
        rows = rows.withColumn("bucket", F.explode(F.array(*keys)))
    else:
        rows = rows.withColumn("bucket", F.lit(b"\0"))
    # what a bucket has of each bit count, so that large ones can be cut
    counts = rows.groupBy("bucket", "ones").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("salts")))).alias("tiles")).where("all > 1")
    small, large = buckets.where(F.col("all") <= tile).select("bucket"), buckets.where(F.col("all") > tile)
    alone = rows.join(small, "bucket", "left_semi").select("bucket", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "id", "fp", "size", *known)
    cut = rows.join(large, "bucket").withColumn("salts", F.element_at(F.filter("tiles", lambda t: t["ones"] == F.col("ones")), 1)["salts"])
    cut = cut.withColumn("own", F.col("ones") * 65536 + F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    partners = F.flatten(F.transform(F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= 1), lambda t: F.transform(F.sequence(F.lit(0), t["salts"] - 1), lambda s: t["ones"] * 65536 + s)))
    cut = cut.select("bucket", "id", "fp", "size", *known, "own", F.explode(partners).alias("other"))
    cut = cut.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "fp", "size", *known)

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(len(ids), -1)
        size, side = table.column("size").to_numpy(), table.column("side").to_numpy()
        pair = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        sets, least = (table.column(c).to_pylist() for c in known) if known else (None, None)
        left, right = forest(fp, size, np.flatnonzero(side == 0), np.flatnonzero(side == 1) if pair else None, radius, ratio, sets, similarity, least)
        return pa.table({"a": ids[left], "b": ids[right]})

    def compare_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small buckets, each whole within the partition and in order."""
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table) -> pa.RecordBatch:
            keys = np.array(table.column("bucket").to_pylist(), object)
            ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
            fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(len(ids), -1)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            out = [np.zeros((2, 0), np.int64)]
            for a, b in zip(starts, np.append(starts[1:], len(keys))):
                sets, least = (table.column(c).slice(a, b - a).to_pylist() for c in known) if known else (None, None)
                left, right = forest(fp[a:b], size[a:b], np.arange(b - a), None, radius, ratio, sets, similarity, least)
                out.append(np.stack([ids[a:b][left], ids[a:b][right]]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("bucket").to_pylist()
            end = next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), -1) + 1
            if held and (end or keys[0] != last):  # what is held is one bucket, which goes on in this batch or is whole
                yield edges(pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks())
                held = []
            elif end:
                yield edges(pa.Table.from_batches([batch.slice(0, end)]))
            held.append(batch.slice(end))
            last = keys[-1]
        if held:
            yield edges(pa.Table.from_batches(held).combine_chunks())
        trimmed()

    one = alone.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare_many, "a long, b long")
    many = cut.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")
    return one.unionByName(many)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, words: int = 1, ratio: float = 0.0, tile: int = TILE, keys: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (hex of the fingerprint's words), component_id.

    Texts are lower-cased A-Z and cut at ASCII white space; a null or blank text has fingerprint zero and links
    like any other. Rows link if their fingerprints differ in `radius` or fewer bits, and by `ratio` as near_links
    says. component_id is the smallest doc_id that links reach, the row's own included; null ids do not count
    unless all are null. Repeated rows and ids are rows like others. Other columns are not read.

    With keys above 0 only texts that share one of as many least hashes are compared, so the work grows with the
    documents, not with their square; with 0 all that can link are. Equal fingerprints are one node of the graph,
    so copies add no links.
    """
    prints = written(fingerprints(docs, shingle, words, keys), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("shingles").alias("size"), F.count("*").alias("n")).withColumn("id", F.xxhash64("fp"))
    nodes = written(nodes, "nodes")
    met = nodes.select("id", "fp", "size")
    if keys:
        met = written(prints.select("fp", "shingles", F.explode("keys").alias("bucket")).groupBy("fp", "bucket").agg(F.max("shingles").alias("size")).withColumn("id", F.xxhash64("fp")), "met")
    roots = connected_components(near_links(met, radius, words, ratio, tile))
    linked = nodes.join(roots, nodes["id"] == roots["node"]).select("fp", "least", "root")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id")
    component = nodes.select("fp", "least", "n").join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return left_by_key(prints.select("doc_id", "fp"), written(component, "component"), ["fp"]).select("doc_id", _shown(words).alias("fingerprint"), "component_id")


def _shown(words: int) -> F.Column:
    """Each little-endian word as 16 hex digits, most significant first."""
    byte = lambda at: F.substring("fp", at, 1)
    return F.lower(F.concat(*(F.hex(byte(8 * w + 8 - k)) for w in range(words) for k in range(8))))


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and sha, which tells texts of one doc_id apart."""
    return documents(docs).withColumn("sha", F.sha2("text", 256))


def shingle_sets(docs: DataFrame, shingle: int, words: int, keys: int) -> DataFrame:
    """(doc_id long, sha, id long, fp binary, size long, keys array of binary) of each row: all of its distinct shingles, of which id is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, prints, sizes, least = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                ids.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42) - (1 << 63))
                prints.append(fingerprint(hashes, words).tobytes())
                sizes.append(len(hashes))
                least.append([k.tobytes() for k in least_hashes(hashes, keys)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.binary()))], ["doc_id", "sha", "id", "fp", "size", "keys"])

    return _hashed(docs).select("doc_id", "sha", "text").mapInArrow(run, "doc_id long, sha string, id long, fp binary, size long, keys array<binary>")


def near_groups(docs: DataFrame, shingle: int, radius: int, words: int, ratio: float, keys: int, similarity: float, tile: int = TILE, sets_tile: int = SETS_TILE) -> DataFrame:
    """(doc_id, sha, group long) of each row of docs with words: groups are the components of the links between shingle sets of at least the similarity.

    Two sets link if they have that similarity, share a least hash, their sizes are within the ratio and their fingerprints within the radius. What
    may link by the last three has its set fetched, once, if it is in a component of such candidates, which hold every link. Sets meet where they are
    copied less, which changes no link: within their component, or, as one of more than keys * sets_tile sets would be cut into more tiles than there are
    least hashes, under each of these. They link in the task that compares them: pairs are never rows, however large a group is.
    """
    prints = written(shingle_sets(docs, shingle, words, keys).where("size > 0"), "prints")
    nodes = written(prints.groupBy("id").agg(F.min("sha").alias("sha"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.count("*").alias("n")), "nodes")
    met = nodes.select("id", "fp", "size")
    if keys:
        met = written(nodes.select("id", "fp", "size", F.explode(F.array_distinct("keys")).alias("bucket")), "met")
    candidates = connected_components(near_links(met, radius, words, ratio, tile)).withColumnRenamed("node", "id")
    sizes = candidates.groupBy("root").agg(F.count("*").alias("n"))
    candidates = written(left_by_key(candidates, written(sizes, "sizes"), ["root"]), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, least = [], []
            for text in batch.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                sets.append(hashes.tobytes())
                least.append(least_hashes(hashes, keys).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(least, pa.binary())], ["id", "set", "least"])

    wanted = written(nodes.join(candidates, "id").select("id", "sha"), "wanted")
    _, maybe = split_by_members(_hashed(docs).select("text", "sha"), F.xxhash64("sha"), wanted.select(F.xxhash64("sha").alias("k")))
    texts = maybe.join(wanted, "sha").dropDuplicates(["id"]).select("id", "text")
    sets = written(texts.mapInArrow(run, "id long, set binary, least binary"), "sets")
    few = F.col("n") <= max(1, keys) * sets_tile
    meet = nodes.select("id", "fp", "size").join(candidates.where(few), "id").select("id", "fp", "size", F.encode(F.concat(F.lit("component "), F.col("root").cast("string")), "utf-8").alias("bucket"))
    if keys:
        meet = meet.unionByName(met.join(candidates.where(~few).select("id"), "id", "left_semi").select("id", "fp", "size", "bucket"))
    links = near_links(meet.join(sets, "id"), radius, words, ratio, sets_tile, similarity)
    roots = nodes.select("id", "n").join(connected_components(links).select(F.col("node").alias("id"), "root"), "id")
    return left_by_key(prints.select("doc_id", "sha", "id"), written(roots, "roots"), ["id"]).select("doc_id", "sha", F.coalesce("root", "id").alias("group"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 80, words: int = 4, ratio: float = 0.8, keys: int = KEYS, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group, all columns: that with the smallest doc_id, null last; of texts with this id that of the smallest hash.

    Texts link if their sets of five-word shingles have a similarity of 0.8 or more, and groups are what links
    reach. Fingerprints and least hashes only choose what is compared: at a similarity of 0.8 the 256-bit
    fingerprints of two sets differ in 39 +- 6 bits, in 48 +- 6 for the smallest sets (4 of 5 shingles), so 80 is 5
    deviations off; that none of the 12 least hashes is shared happens to 4 in a billion pairs. Rows without words
    stay: there is nothing in them to compare.
    """
    found = written(near_groups(docs, shingle, radius, words, ratio, keys, similarity), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "sha")
    kept = written(found.groupBy("group").agg(F.min(row).alias("kept"), F.count("*").alias("n")).where("n > 1"), "kept")
    grouped = left_by_key(found, kept, ["group"]).where("kept is not null")
    decisions = grouped.select(F.col("doc_id").alias("id"), "sha", (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("sha") == F.col("kept.sha"))).alias("first"))
    return decided(docs, written(decisions.distinct(), "near"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
