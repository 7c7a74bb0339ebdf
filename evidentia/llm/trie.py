"""The trie of all conversations' prefixes, built family by family.

Conversations of one base id are a family: each begins with some turns of the base. A family's conversations meet as one sorted stream, are
rebuilt and laid into a small trie of their own; only its nodes, each once however many conversations pass it, are shuffled to be merged.

What a node sums over its subtree follows from its members, so no walk from level to level is needed. Each node is *owned* by its smallest
member. A conversation owns a stretch from some depth to its end, so the distinct texts below a node are what its members own, but for the
node's owner, of which everything from the node on counts; and a childless node is the end of exactly one owner.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.shared import materialize, with_least

FAMILY = 100
SHARED_TURNS = 6
ROOT = bytes(16)
#: Nodes that a task holds before it hands on what it has of a family.
HELD = 100_000
_NODE = "node binary, parent binary, depth long, size long, before long, members array<long>, ends array<long>"


def base_turns(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % SHARED_TURNS


def _family_nodes(held: int):
    """Nodes of each family from rows (base, conv_id, mark, size), sorted by family, the base first, and each conversation's turns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("size", pa.int64()), ("before", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        trie: dict[bytes, list] = {}
        base = conv = None
        shared: list[tuple[bytes, int]] = []  # the first turns of the base
        at: tuple = ()  # the node that the conversation being laid has reached, with its parent, depth, size and length before

        def visit(node: bytes, *about) -> None:
            nonlocal at
            trie.setdefault(node, [*about, [], []])[4].append(conv)
            at = (node, *about)

        def turn(mark: bytes, size: int) -> None:
            node, _, depth, last, before = at
            visit(hashlib.md5(node + mark).digest(), node, depth + 1, size, before + last)

        def end() -> None:
            if conv is not None:
                trie.setdefault(at[0], [*at[1:], [], []])[5].append(conv)

        def handed_on() -> pa.RecordBatch:
            rows = []
            for node, (*about, members, ends) in trie.items():
                if base < 0 and base in ends:  # the base comes first in the stream, but is the largest id of a family below 0
                    ends.remove(base)
                    rows.append((node, *about, [], [base]))
                rows.append((node, *about, members, ends))
            trie.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for family, c, mark, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (family, c) != (base, conv):
                    end()
                    if trie and family != base:
                        yield handed_on()
                    if family != base:
                        shared = []
                    base, conv, own = family, c, 0
                    visit(ROOT, None, 0, 0, 0)
                    first = base_turns(c)
                    if c != family:
                        for x in shared[:first]:
                            turn(*x)
                if len(trie) >= held:
                    yield handed_on()
                if c == family and len(shared) < SHARED_TURNS - 1:
                    shared.append((mark, size))
                if own >= first or c == family:
                    turn(mark, size)
                own += 1
        end()
        if trie:
            yield handed_on()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest per node of its lists of ids, which come one after the other in ascending order."""
    node, digest = None, None
    for batch in batches:
        found = []
        for n, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if n == node:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    found.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(ids.encode())
        yield _digested(found)
    yield _digested([(node, digest.hexdigest())] if digest else [])


def _digested(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])


def _mark(role: Column, text: Column) -> Column:
    """What tells turns apart; the length keeps role and text from running into each other."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the trie of rebuilt conversations.

    Turns go by ``turn``, null first; turns of one number go by a digest of role and text, and repeated rows are turns of their own. A null role
    or text is empty. Rows without a conv_id belong to no conversation and are left out, as are further columns, whatever their names. No
    conversations give no rows, not even a root. Texts of any length travel as digest and length; a conversation of any number of turns
    is streamed.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), F.col("turn").alias("turn"), _mark(role, text).alias("mark"), F.length(text).cast("long").alias("size"))
    sorted_turns = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "mark")
    family = materialize(sorted_turns.select("base", "conv_id", "mark", "size").mapInArrow(_family_nodes(HELD), _NODE), "trie-families")

    same = ["node", "parent", "depth", "size", "before"]
    merged = family.groupBy(*same).agg(F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id"))
    nodes = materialize(merged, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))

    # the parent's smallest member is the least of its own and its children's, found in cells of its children
    own = nodes.select("node", F.col("node").alias("key"), "conv_id", F.lit(True).alias("self"))
    kin = own.unionAll(nodes.where("parent is not null").select("node", F.col("parent").alias("key"), "conv_id", F.lit(False)))
    parents = with_least(kin, "key", "conv_id", "parent_conv_id").where("not self").select("node", "parent_conv_id")

    counted = materialize(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "trie-counted")
    owned = counted.groupBy("conv_id").agg(F.sum("size").alias("own"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    ends = family.where(F.size("ends") > 0)
    totals = ends.select(F.explode("ends").alias("conv_id"), (F.col("before") + F.col("size")).alias("total"))
    weights = totals.join(owned, "conv_id", "left").fillna(0, ["own", "leaf"]).select(F.col("conv_id").alias("member"), "total", "own", "leaf")

    # a node of one member has one leaf and saves nothing; only shared nodes need sums over their members
    shared = counted.where("n_convs > 1").select("node")
    members = family.join(shared, "node", "left_semi").select("node", F.explode("members").alias("member"))
    sums = members.join(weights, "member").groupBy("node").agg(*[F.sum(x).alias(f"all_{x}") for x in ("total", "own", "leaf")])
    owner = weights.select(F.col("member").alias("conv_id"), F.col("total").alias("owner_total"), F.col("own").alias("owner_own"))
    summed = sums.join(counted.where("n_convs > 1").select("node", "conv_id", "before", "n_convs"), "node").join(owner, "conv_id")
    every = F.col("all_total") - F.col("n_convs") * F.col("before")
    distinct = F.col("all_own") - F.col("owner_own") + F.col("owner_total") - F.col("before")
    below = summed.select("node", (every - distinct).alias("saved_tokens"), F.col("all_leaf").alias("n_leaves"))

    lists = ends.select("node", F.element_at("ends", 1).alias("first"), F.array_join(F.transform("ends", lambda x: x.cast("string")), ",").alias("ids"))
    digests = lists.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")

    found = counted.join(parents, "node", "left").join(below, "node", "left").join(digests, "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
