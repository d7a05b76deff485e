"""Merkle manifest of a dataset: one 16-ary hash tree per group, and one over the groups' roots.

Nodes are cut into aligned blocks of ``HEIGHT`` levels (16^3 nodes at the bottom). A block is stored as one byte string
in van Emde Boas order: a tree of some levels is its upper half, followed by its lower subtrees from left to right, each
laid out by the same rule, so a subtree of any size is one stretch of bytes. ``address`` gives the place of a node from
the levels, its depth and its number alone; the construction writes parents and the proofs read siblings through it.
The roots of the blocks are the leaves of the next tier of blocks, until one block holds the rest of the tree.

Distribution: leaves get their positions from one range shuffle on (group, order), so a group that holds a third of all
rows spreads over all tasks; the offsets of a group are sums over at most (partitions + groups) rows. Blocks are built
and read in streamed maps over rows partitioned by (tree, block), so no task holds more than a block at once. The top of
each tree goes down to the leaves as one path per block, joined on (tree, block). Nothing but one row (the root of an
empty or full manifest, when asked for) comes to the driver. All intermediate tables are checkpoints.

Nulls: a null field has its own form in the leaf; a null group is a group and stands before all others; a null order key
stands before all others. Ties of the order key are put in order of their leaves, so repeated rows (equal leaves) give
the same manifest in any partitioning. An empty table has no groups and no rows. Extra columns of the input are ignored
unless kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import BROADCAST_BYTES, stage
from carepath.operators.ordering import sorted_partitions

# Children of a node, and bytes of a digest.
ARITY = 16
DIGEST = 32

HEIGHT = 3  # levels of edges in a block
BLOCK = ARITY**HEIGHT

STEP = "struct<place:int,others:binary>"  # own place in a run of siblings, and the others' digests
_STEP = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))


def field(value: Column) -> Column:
    """A value as it enters a leaf: UTF-8 byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Digest of the row with these fields."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def tree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0 is the root) in the layout of a full tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    lower = levels - upper
    if depth < upper:
        return address(upper, depth, index)
    tree, inside = np.divmod(index, ARITY ** (depth - upper))
    return tree_size(upper) + tree * tree_size(lower) + address(lower, depth - upper, inside)


def levels_of(total: int, height: int = HEIGHT) -> int:
    """Levels of the blocks of a tier with ``total`` nodes: up to a single node, at most ``height`` reductions."""
    levels = 1
    while total > 1 and levels <= height:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def parent(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Block:
    """One aligned subtree: the digests of its nodes in van Emde Boas order, cut behind the last node in use."""

    def __init__(self, levels: int, count: int, nodes: np.ndarray):
        self.levels, self.nodes = levels, nodes
        self.counts = [-(-count // ARITY ** (levels - 1 - depth)) for depth in range(levels)]

    @classmethod
    def build(cls, levels: int, leaves: Sequence[bytes]) -> Block:
        block = cls(levels, len(leaves), np.zeros((0, DIGEST), np.uint8))
        last = max(int(address(levels, d, np.array([n - 1]))[0]) for d, n in enumerate(block.counts))
        block.nodes = np.zeros((last + 1, DIGEST), np.uint8)
        places = address(levels, levels - 1, np.arange(len(leaves)))
        block.nodes[places] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
        for depth in range(levels - 2, -1, -1):
            below = block.level(depth + 1)
            made = [bytes.fromhex(parent(below[i : i + ARITY])) for i in range(0, len(below), ARITY)]
            places = address(levels, depth, np.arange(len(made)))
            block.nodes[places] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, DIGEST)
        return block

    @classmethod
    def load(cls, levels: int, count: int, stored: bytes) -> Block:
        return cls(levels, count, np.frombuffer(stored, np.uint8).reshape(-1, DIGEST))

    def level(self, depth: int) -> list[str]:
        """Digests of a depth as hex text, left to right."""
        text = self.nodes[address(self.levels, depth, np.arange(self.counts[depth]))].tobytes().hex()
        return [text[i : i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)]

    def siblings(self) -> list[list[str]]:
        """For each depth but the root's, from the leaves up, the runs of siblings, each as one hex text."""
        out = []
        for depth in range(self.levels - 1, 0, -1):
            row = self.level(depth)
            out.append(["".join(row[i : i + ARITY]) for i in range(0, len(row), ARITY)])
        return out


def others(run: str, place: int) -> str:
    """A run of siblings without the one at ``place``."""
    return run[: 2 * DIGEST * place] + run[2 * DIGEST * (place + 1) :]


def fold(digest: str, path: Iterable[tuple[int, str]]) -> str:
    """The root that a digest and the (place, others) of each level lead to."""
    for place, rest in path:
        cut = 2 * DIGEST * place
        digest = sha256((rest[:cut] + digest + rest[cut:]).encode()).hexdigest()
    return digest


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """(tree, block, rows) of rows that arrive sorted by both, one block at a time."""
    key, parts = None, []
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        start = 0
        while start < len(keys):
            stop = start + 1
            while stop < len(keys) and keys[stop] == keys[start]:
                stop += 1
            if keys[start] != key:
                if parts:
                    yield *key, pa.Table.from_batches(parts)
                key, parts = keys[start], []
            parts.append(batch.slice(start, stop - start))
            start = stop
    if parts:
        yield *key, pa.Table.from_batches(parts)


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(BLOCK)).cast("long"))


def _tier(nodes: DataFrame) -> DataFrame:
    """Blocks (tree, block, total, count, root, nodes) over nodes (tree, pos, total, digest)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, number, rows in _streamed(batches):
            total = rows.column("total")[0].as_py()
            leaves = rows.column("digest").to_pylist()
            made = Block.build(levels_of(total), leaves)
            stored = made.nodes.tobytes()
            values = [[tree], [number], [total], [len(leaves)], [stored[:DIGEST]], [stored]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["tree", "block", "total", "count", "root", "nodes"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    rows = _by_block(_with_block(nodes).select("tree", "block", "pos", "total", "digest"), "pos")
    return rows.mapInArrow(build, "tree string, block bigint, total bigint, count bigint, root binary, nodes binary")


def forest(nodes: DataFrame) -> list[DataFrame]:
    """Tiers of blocks over nodes (tree, pos, total, digest); every tree ends in the first tier where one block holds it."""
    tiers = []
    while True:
        tier = stage(_tier(nodes))
        tiers.append(tier)
        nodes = tier.where(F.col("total") > BLOCK).select(
            "tree",
            F.col("block").alias("pos"),
            F.ceil(F.col("total") / F.lit(BLOCK)).cast("long").alias("total"),
            F.col("root").alias("digest"),
        )
        if not nodes.take(1):
            return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    out = None
    for tier in tiers:
        ended = tier.where(F.col("total") <= BLOCK).select("tree", "root")
        out = ended if out is None else out.unionByName(ended)
    return out


def _positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with pos (0-based, within their tree, in the given order) and total (rows of the tree)."""
    staged = sorted_partitions(rows, ["tree", *order])
    parts = staged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        parts.select(
            "tree",
            "_part",
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("total"),
        )
    )
    if offsets.count() * 64 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    out = staged.join(offsets, ["tree", "_part"])
    pos = F.col("_before") + F.col("_mid") - F.col("_first")
    return out.withColumn("pos", pos).drop("_part", "_mid", "_first", "_before")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: keep (a struct), tree, pos, total, digest, claimed; ``tiers``: blocks of the groups' trees; ``groups``:
    tree, group's value, root digest, pos, total; ``top``: blocks of the tree over the groups' roots."""

    leaves: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]

    def root(self) -> str | None:
        """The root of the dataset as hex text; None for an empty one."""
        row = roots(self.top).select(F.lower(F.hex("root"))).first()
        return row[0] if row else None


def build(
    rows: DataFrame,
    leaf: Column,
    group: str | Column,
    order: str | Column,
    keep: Sequence[str | Column] = (),
    claimed: Column | None = None,
) -> Manifest:
    """The manifest of ``rows``. ``leaf`` is each row's digest, ``group`` its tree, ``order`` its place in it. ``keep``
    names columns that proofs return; ``claimed`` is a digest to be held against the root in place of ``leaf``."""
    group = F.col(group) if isinstance(group, str) else group
    order = F.col(order) if isinstance(order, str) else order
    leaves = stage(
        rows.select(
            (F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("_none"))).alias("keep"),
            F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("tree"),
            order.alias("_order"),
            leaf.alias("digest"),
            (leaf if claimed is None else F.coalesce(claimed, leaf)).alias("claimed"),
        )
    )
    leaves = stage(_positions(leaves, ["_order", "digest"]).drop("_order"))
    tiers = forest(leaves)
    subroots = roots(tiers).select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("root").alias("digest"))
    groups = stage(_positions(subroots, ["member"]))
    return Manifest(leaves, tiers, groups, forest(groups))


def _expand(blocks: DataFrame) -> DataFrame:
    """(tree, block, path): for each leaf of the blocks (with ``path`` above them) the path from it up; ``block`` is the
    number of the leaf in its tier, which is the number of its block in the tier below."""

    def children(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.load(levels_of(row["total"]), row["count"], row["nodes"])
                runs, first = block.siblings(), row["block"] * BLOCK
                paths = []
                for i in range(row["count"]):
                    path = [
                        {"place": i // ARITY**k % ARITY, "others": bytes.fromhex(others(run[i // ARITY ** (k + 1)], i // ARITY**k % ARITY))}
                        for k, run in enumerate(runs)
                    ]
                    paths.append(path + row["path"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(paths), pa.string()),
                        pa.array(np.arange(first, first + len(paths))),
                        pa.array(paths, _STEP),
                    ],
                    ["tree", "block", "path"],
                )

    return blocks.mapInArrow(children, f"tree string, block bigint, path array<{STEP}>")


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's blocks, each with the path from its root upward; ``above`` has each tree's own (tree, path)."""
    placed = None
    for tier in reversed(tiers):
        now = tier.where(F.col("total") <= BLOCK).join(above, "tree")
        if placed is not None:
            inner = tier.where(F.col("total") > BLOCK).join(stage(_expand(placed)), ["tree", "block"])
            now = now.unionByName(inner)
        placed = now
    return placed


def _placed(manifest: Manifest) -> DataFrame:
    """Blocks of leaves with the path above each up to the root, and both roots."""
    empty = F.array().cast(f"array<{STEP}>")
    whole = roots(manifest.top).select("tree", F.col("root").alias("top"))
    tops = _expand(_descend(manifest.top, whole.select("tree", empty.alias("path"))))
    members = manifest.groups.select("tree", F.col("pos").alias("block"), "member", "digest").join(tops, ["tree", "block"])
    members = members.join(whole, "tree")
    above = stage(members.select(F.col("member").alias("tree"), "path", F.col("digest").alias("subroot"), "top"))
    blocks = _descend(manifest.tiers, above.select("tree", "path"))
    return blocks.join(above.select("tree", "subroot", "top"), "tree")


def _with_blocks(manifest: Manifest) -> DataFrame:
    """Leaves and their blocks in one stream, the block before its leaves."""
    leaves = _with_block(manifest.leaves).drop("total").withColumn("is_leaf", F.lit(True))
    blocks = _placed(manifest).drop("root").withColumn("is_leaf", F.lit(False))
    return _by_block(leaves.unionByName(blocks, allowMissingColumns=True), "is_leaf", "pos")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Block, dict]]:
    """The leaves of each block, the block, and its row without the nodes."""
    for _, _, rows in _streamed(batches):
        head = rows.slice(0, 1).to_pylist()[0]
        yield rows.slice(1), Block.load(levels_of(head["total"]), head["count"], head["nodes"]), head


def _inner(block: Block, offset: int, runs: list[list[str]]) -> list[tuple[int, str]]:
    """(place, others) of a leaf at each level inside its block."""
    out = []
    for run in runs:
        above, place = divmod(offset, ARITY)
        out.append((place, others(run[above], place)))
        offset = above
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """The kept columns plus leaf, subroot, root (hex text) and path: for each level from the leaf to the root the own
    place among the siblings and the others' digests, one after another."""
    return _answer(manifest, f"path array<{STEP}>", [_STEP], lambda path, claimed, top: [
        [{"place": p, "others": bytes.fromhex(o)} for p, o in path]
    ])


def verify(manifest: Manifest) -> DataFrame:
    """The kept columns plus leaf, subroot, root, proof_sha256 (digest of all siblings' hex text, level by level),
    folded_root (what the claimed digest leads to) and verified (whether that is the root). Hex text throughout."""

    def verdict(path: list[tuple[int, str]], claimed: str, top: str) -> list:
        found = fold(claimed, path)
        return [sha256("".join(o for _, o in path).encode()).hexdigest(), found, found == top]

    kinds = [pa.string(), pa.string(), pa.bool_()]
    return _answer(manifest, "proof_sha256 string, folded_root string, verified boolean", kinds, verdict)


def _answer(manifest: Manifest, schema: str, kinds: list[pa.DataType], answer) -> DataFrame:
    keep = manifest.leaves.schema["keep"].dataType
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block, head in _rows(batches):
            runs = block.siblings()
            above = [(step["place"], step["others"].hex()) for step in head["path"]]
            subroot, top, first = head["subroot"].hex(), head["top"].hex(), head["block"] * BLOCK
            leaves = [d.hex() for d in rows.column("digest").to_pylist()]
            claimed = rows.column("claimed").to_pylist()
            made = [
                answer(_inner(block, pos - first, runs) + above, c.hex(), top)
                for pos, c in zip(rows.column("pos").to_pylist(), claimed)
            ]
            columns = [rows.column("keep").combine_chunks(), pa.array(leaves, pa.string())]
            columns += [pa.array([subroot] * len(leaves), pa.string()), pa.array([top] * len(leaves), pa.string())]
            columns += [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["keep", "leaf", "subroot", "root", *names])

    out = _with_blocks(manifest).mapInArrow(run, f"keep {keep.simpleString()}, leaf string, subroot string, root string, {schema}")
    kept = [F.col("keep").getField(f.name).alias(f.name) for f in keep.fields if f.name != "_none"]
    return out.select(*kept, "leaf", "subroot", "root", *names)
