"""The Merkle manifest against a plain construction of the same trees."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.llm import merkle
from carepath.llm.queries import op11_merkle_manifest
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, with_extra

FIELDS = ("doc_id", "source", "lang", "n_chars")


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, proof of each leaf as (place, others) pairs)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, proof in enumerate(proofs):
            run, place = divmod(at[i], 16)
            members = level[16 * run : 16 * run + 16]
            proof.append((place, "".join(members[:place] + members[place + 1 :])))
            at[i] = run
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], proofs


def plain_rows(rows, tamper):
    """Verdict rows of documents (doc_id, source, lang, n_chars, text), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, plain_leaf(*r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        trees.append(plain_tree([leaf for _, leaf in groups[s]]))
    root, tops = plain_tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (subroot, proofs), top in zip(order, trees, tops):
        for (r, leaf), proof in zip(groups[s], proofs):
            path = proof + top
            digest = leaf
            if tamper(r[0]):
                digest = plain_leaf(*r[:4], None if r[4] is None else "".join(c.lower() if c.isascii() else c for c in r[4]))
            for place, rest in path:
                digest = h(rest[: 64 * place] + digest + rest[64 * place :])
            out.append((r[0], leaf, subroot, root, h("".join(o for _, o in path)), digest, digest == root))
    return sorted(out, key=repr)


def by_id(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("levels", range(1, 6))
def test_addresses_number_every_node_once_and_keep_subtrees_together(levels):
    places = [merkle.address(levels, d, np.arange(16**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
    upper = levels // 2
    if upper:
        assert max(p.max() for p in places[:upper]) == merkle.tree_size(upper) - 1
        lower, size = places[upper:], merkle.tree_size(levels - upper)
        for t in range(min(16**upper, 300)):
            inside = np.concatenate([p.reshape(16**upper, -1)[t] for p in lower])
            assert sorted(inside.tolist()) == list(range(merkle.tree_size(upper) + t * size, merkle.tree_size(upper) + (t + 1) * size))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096])
def test_blocks_equal_plain_trees(n):
    leaves = [h(str(i)) for i in range(n)]
    root, proofs = plain_tree(leaves)
    made = merkle.Block.build(merkle.levels_of(n), [bytes.fromhex(x) for x in leaves])
    block = merkle.Block.load(merkle.levels_of(n), n, made.nodes.tobytes())
    assert block.level(0) == [root] and block.nodes[0].tobytes().hex() == root
    runs = block.siblings()
    for i in range(0, n, max(1, n // 50)):
        assert merkle._inner(block, i, runs) == proofs[i]
        assert merkle.fold(leaves[i], proofs[i]) == root


@pytest.mark.parametrize("height", [1, 2, 3])
def test_verdicts_of_awkward_rows(spark, monkeypatch, height):
    """Ties, repeated rows, nulls in any column, one group with most rows; several tiers of blocks."""
    monkeypatch.setattr(merkle, "BLOCK", 16**height)
    monkeypatch.setattr(merkle, "levels_of", lambda total, f=merkle.levels_of: f(total, height))
    docs = documents(spark, 90)
    more = spark.range(2000, 2600).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text ÄB "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"),
        F.lit(None).cast("long").alias("n_chars"),
    )
    many = spark.range(3000, 3040).select(
        F.col("id").alias("doc_id"), F.lit("A").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("ü"), "id").alias("source"),
        F.lit(1).cast("long").alias("n_chars"),
    )
    docs = docs.unionByName(more).unionByName(many)
    leaf = lambda text: merkle.leaf_hash(*[F.col(c) for c in FIELDS], text)
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tamper = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    manifest = merkle.build(with_extra(docs), leaf(F.col("text")), "source", "doc_id", ("doc_id",), F.when(tamper, leaf(changed)))
    got = merkle.verify(manifest)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in docs.select(*FIELDS, "text").collect()]
    want = plain_rows(rows, by_id)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert manifest.root() == want[0][3]
    if height == 2:
        paths = merkle.proofs(manifest).collect()
        assert len(paths) == len(want)
        for r in paths:
            assert merkle.fold(r.leaf, [(s.place, s.others.hex()) for s in r.path]) == r.root == want[0][3]


def test_empty_and_single(spark):
    docs = documents(spark, 10)
    leaf = merkle.leaf_hash(F.col("doc_id"))
    empty = merkle.build(docs.limit(0), leaf, "source", "doc_id", ("doc_id",))
    assert merkle.verify(empty).collect() == [] and empty.root() is None
    one = merkle.build(docs.where("doc_id = 1"), leaf, "source", "doc_id")
    row = merkle.verify(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == plain_leaf(1) and row.verified
    assert row.proof_sha256 == h("")


def test_query_equals_plain_trees(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*FIELDS, "text").collect()
    got = sorted(map(tuple, op11_merkle_manifest(spark, SF_SMALL).collect()), key=repr)
    assert got == plain_rows([tuple(r) for r in docs], by_id)
    assert {r[6] for r in got} == {True, False}
