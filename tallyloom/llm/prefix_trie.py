"""The trie of all conversations' beginnings, with its subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import left_by_key, written
from tallyloom.llm.ordered import running_sums
from tallyloom.llm.tree_contraction import subtree_totals

#: Conversations that share a base, and one more than the turns at most that are taken from it.
FAMILY, HEADS = 5, 9
#: Characters of role and text that order equal turns, before a hash does.
TIE_CHARS = 64
#: Parts of 32 bits of a turn's hash, summed along a conversation.
PARTS = ["h0", "h1", "h2", "h3"]
#: Bytes of joined ids in a row.
PIECE = 1 << 14
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def heads_taken(conv_id: Column) -> Column:
    """How many turns at most a conversation takes from its base: crc32 of the decimal id, modulo HEADS."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, sha, bytes), a written table: turns in the order of turn, nulls first; sha stands for role and text, null as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.left(role, F.lit(TIE_CHARS)).alias("role"), F.left(text, F.lit(TIE_CHARS)).alias("head"),
        sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("pos"), F.rand(3).alias("salt"))
    return running_sums(written(narrow, "turns"), "conv_id", ["turn", "role", "head", "sha", "salt"], ["pos"]).select("conv_id", "pos", "sha", "bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every conversation: (conv_id, n, h, base, taken, length), and its rebuilt turns (conv_id, depth, sha, bytes, length). Both are written tables.

    The first h turns of the base, the conversation whose id is conv_id - conv_id % 5 (with SQL's sign), then its own after its
    first h. A base has at most HEADS - 1 turns to give to at most 9 conversations, so their join stays small.
    """
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.withColumns({"h": heads_taken(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0)))).drop("base_n")
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = left_by_key(placed, convs, ["conv_id"]).where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "sha", "bytes", "length")
    first = placed.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "sha", "bytes")
    heads = convs.join(first, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "sha", "bytes", "length")
    turns = own.unionByName(heads)
    digest = F.sha2(F.concat_ws(":", F.col("depth"), F.col("sha")).cast("binary"), 256)
    parts = {p: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i, p in enumerate(PARTS)}
    return convs, written(turns.withColumn("digest", digest).withColumns(parts).drop("digest"), "rebuilt")


def node_key(depth: Column, *sums: Column) -> Column:
    return F.md5(F.concat_ws(",", depth, *sums).cast("binary"))


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, sha, bytes, ends): for each rebuilt turn the node of the sequence up to it, and that sequence's own beginning.

    A sequence is named by its length and the sums, along the conversation, of four 32-bit parts of each turn's hash with its place.
    """
    summed = running_sums(turns.withColumns({f"own_{p}": F.col(p) for p in PARTS}), "conv_id", ["depth"], PARTS)
    node = node_key(F.col("depth"), *(F.col(p) for p in PARTS))
    parent = node_key(F.col("depth") - 1, *(F.col(p) - F.col(f"own_{p}") for p in PARTS))
    return summed.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "sha", "bytes", (F.col("depth") == F.col("length")).alias("ends"))


def joined_ids(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal conv_ids of each node, ascending, joined by commas. ends: (node, conv_id), each pair once.

    Rows are ranged over node and id. A task hashes the nodes that it holds whole; of those at its borders, and of long ones, it passes on
    joined ids in pieces of PIECE bytes. A hash is one chain, so a node's pieces, some 10 bytes a member, go through one
    task, one after the other, none of them held.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, texts, size, start, whole = None, [], 0, None, False

        def passed() -> None:
            if texts:
                out.append((node, None, start, ",".join(texts)))

        for batch in batches:
            if not batch.num_rows:
                continue
            runs, ids = pc.run_end_encode(batch.column(0)), batch.column(1)
            at = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                for lo in range(at, end, 1024):
                    part = ids.slice(lo, min(end, lo + 1024) - lo)
                    if name != node:
                        if whole:
                            out.append((node, hashlib.sha256(",".join(texts).encode()).hexdigest(), None, None))
                        else:
                            passed()
                        # the first node of a task may have begun in another one
                        whole, node, texts, size, start = node is not None, name, [], 0, part[0].as_py()
                    new = pc.cast(part, pa.string()).to_pylist()
                    if not texts:
                        start = part[0].as_py()
                    texts += new
                    size += sum(map(len, new)) + len(new)
                    if size >= PIECE:
                        passed()
                        whole, texts, size = False, [], 0
                at = end
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "sha", "start", "piece"), r)) for r in out], schema)
            out = []
        passed()  # the last node may go on in the next task
        yield pa.RecordBatch.from_pylist([dict(zip(("node", "sha", "start", "piece"), r)) for r in out], schema)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == node:
                    state.update(b"," + piece.encode())
                else:
                    if node is not None:
                        done.append({"node": node, "sha": state.hexdigest()})
                    node, state = name, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_pylist(done, pa.schema([("node", pa.string()), ("sha", pa.string())]))
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "sha": [state.hexdigest()]})

    schema = pa.schema([("node", pa.string()), ("sha", pa.string()), ("start", pa.int64()), ("piece", pa.string())])
    found = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(hashed, "node string, sha string, start long, piece string")
    found = written(found, "ends")
    pieces = found.where("sha is null").select("node", "start", "piece").repartition("node").sortWithinPartitions("node", "start").select("node", "piece")
    rest = pieces.mapInArrow(chained, "node string, sha string")
    return found.where("sha is not null").select("node", "sha").unionByName(rest).withColumnRenamed("sha", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct beginning of a rebuilt conversation, the empty one included.

    Rows with a null conv_id are of no conversation and take no part. Turns stand in the order of turn, null first, equal ones in that
    of role and text (beyond 64 characters of these, of their hash); repeated rows are turns of their own. Null role and text are
    empty. Other columns are not read. An empty table has no rows.

    Texts are read once and go on as a hash and a length. Positions, and the names of beginnings, are running sums over ranges, so one
    conversation may hold any share of the turns; a node's members are counted before they are shuffled. Rows of a node whose
    last turn or parent differ, two sequences of one name, raise an error: names are exact as far as SHA-256 of a turn is.
    """
    placed = placed_turns(conversations)
    convs, turns = rebuilt(placed)
    rows = written(beginnings(turns), "beginnings")
    root = node_key(F.lit(0).cast("long"), *[F.lit(0).cast("long")] * len(PARTS))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two sequences of turns have one name")))
    nodes = rows.groupBy("node").agg(one("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), one("sha").alias("sha"), F.min("bytes").alias("bytes")).drop("sha")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = written(nodes.unionByName(top), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    tree = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    ends = rows.where("ends").select("node", "conv_id").unionByName(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    parents = written(nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    named = left_by_key(nodes.withColumn("parent", F.coalesce("parent", F.lit(""))), parents, ["parent"])
    full = named.join(totals, "node").join(joined_ids(ends), "node", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
