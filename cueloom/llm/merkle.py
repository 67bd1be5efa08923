"""Merkle manifest of a table: a tree for each source, and one over the sources' roots.

A block is an aligned run of BLOCK = FAN ** DEPTH nodes of one tree. A task goes through a block
by postorder recursion: each visit returns its subtree's digest and, while it unwinds, appends the siblings
of each child to the proofs of all leaves below that child. The blocks' roots are the leaves of the
next traversal, which Spark distributes in the same way, until a tree has one node left. The proofs of
blocks are found first, from the top; each leaf's own part goes in front of its block's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, settled

FAN, DEPTH = 16, 3
BLOCK = FAN**DEPTH
#: Of each level from a leaf up: the digests of its siblings to the left and to the right, as hex text one after another.
PROOF = "array<struct<left: string, right: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """Digest of each field's UTF-8 byte count, a colon and its value, or of "-" for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


def levels(n: int) -> int:
    """How often FAN nodes become one until one of n is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def visit(leaves: list[str], at: int, level: int, proofs: list[list] | None) -> str:
    """The digest of the subtree of `level` levels over leaves[at:]; its leaves' proofs take on their siblings, from the lowest level up."""
    if not level:
        return leaves[at]
    span = FAN ** (level - 1)
    starts = range(at, min(at + FAN * span, len(leaves)), span)
    children = [visit(leaves, s, level - 1, proofs) for s in starts]
    if proofs is not None:
        for i, s in enumerate(starts):
            siblings = "".join(children[:i]), "".join(children[i + 1 :])
            for proof in proofs[s : s + span]:
                proof.append(siblings)
    return _digest(children)


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """tree, block, n (of the whole tree), nodes: the block's nodes in order, each with its digest and what it carries; written. nodes: tree, pos, n, digest."""
    node = F.struct("pos", "digest", *carried)
    return settled(nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("nodes")))


def _roots(blocks: DataFrame) -> DataFrame:
    """tree, pos (the block's place), n (the tree's blocks), digest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [visit(leaves, 0, min(DEPTH, levels(n)), None) for n, leaves in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-(-n // BLOCK) for n in b.column(2).to_pylist()], pa.int64()), pa.array(tops, pa.string())], names=["tree", "pos", "n", "digest"])

    kind = blocks.schema["tree"].dataType.simpleString()
    return settled(blocks.select("tree", "block", "n", F.col("nodes.digest").alias("digests")).mapInArrow(run, f"tree {kind}, pos long, n long, digest string"))


def _proved(blocks: DataFrame, carried: list[str], top: DataFrame) -> DataFrame:
    """tree, pos, digest, carried and proof of every node; top (tree, block, above): what goes behind the proofs within a block."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["nodes"].dataType.elementType.fields}
    few = top.select(F.col("tree").alias("__tree"), F.col("block").alias("__block"), "above")
    both = blocks.join(few, blocks["tree"].eqNullSafe(few["__tree"]) & (blocks["block"] == few["__block"]), "left").select("tree", "n", "nodes", "above")
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                nodes = b.column(2)[i].values
                above = [(x["left"], x["right"]) for x in b.column(3)[i].as_py() or []]
                proofs: list[list] = [[] for _ in range(len(nodes))]
                visit(nodes.field("digest").to_pylist(), 0, min(DEPTH, levels(b.column(1)[i].as_py())), proofs)
                for at in range(0, len(nodes), 1024):
                    some = [p + above for p in proofs[at : at + 1024]]
                    ends = [0]
                    for p in some:
                        ends.append(ends[-1] + len(p))
                    left, right = (pa.array([x[j] for p in some for x in p], pa.string()) for j in (0, 1))
                    proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([left, right], ["left", "right"]))
                    part = nodes.slice(at, 1024)
                    tree = pa.array([b.column(0)[i].as_py()] * len(part), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([tree, *(part.field(c) for c in names), proof], names=["tree", *names, "proof"])

    kind = blocks.schema["tree"].dataType.simpleString()
    return both.mapInArrow(run, f"tree {kind}, {', '.join(f'`{c}` {k}' for c, k in kinds.items())}, proof {PROOF}")


def tree_proofs(nodes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of trees of nodes (tree, pos from 0, n, digest, carried columns): blocks of nodes, what goes behind the proofs of each block (tree, block, above), and root of each tree (tree, digest)."""
    blocks = _blocks(nodes, carried)
    tops = _roots(blocks)
    done = tops.where("n = 1").select("tree", "digest")
    open_ = tops.where("n > 1")
    if open_.isEmpty():
        return blocks, tops.select("tree", F.col("pos").alias("block"), F.array().cast(PROOF).alias("above")), done
    upper, above, roots = tree_proofs(open_, [])
    proved = settled(_proved(upper, [], above).select("tree", F.col("pos").alias("block"), F.col("proof").alias("above")))
    return blocks, proved.unionByName(done.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(PROOF).alias("above"))), roots.unionByName(done)


def manifest(leaves: DataFrame, group: str, order: str, carried: list[str] | None = None) -> DataFrame:
    """Every row of leaves (group, order, digest, carried columns) with subroot, root and proof (see PROOF).

    A group's leaves ascend by `order`, nulls first, then by digest; groups ascend by name, null first.
    While several nodes are left, each FAN consecutive ones become their digest; a lone leaf is its
    tree's root. Rows that are equal are leaves of their own, at neighbouring places. A leaf's proof ends
    with the levels over the groups. No leaves give no rows.
    """
    carried = [order, *(carried or [])]
    placed = ranked(settled(leaves.select(group, "digest", *carried)), [group], [order, "digest"])
    blocks, above, subroots = tree_proofs(placed.withColumnRenamed(group, "tree"), carried)
    named = settled(subroots.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "digest"))
    upper, over, roots = tree_proofs(ranked(named, ["all"], ["name"]).select(F.col("all").alias("tree"), "pos", "n", "digest", "name"), ["name"])
    groups = _proved(upper, ["name"], over).crossJoin(F.broadcast(roots.select(F.col("digest").alias("root"))))  # one root
    groups = settled(groups.select("name", F.col("digest").alias("subroot"), F.col("proof").alias("over"), "root"))
    tops = above.join(groups, above["tree"].eqNullSafe(groups["name"])).select("tree", "block", F.concat("above", "over").alias("above"))
    proved = _proved(blocks, carried, settled(tops))
    few = groups.select("name", "subroot", "root")
    return proved.join(few, proved["tree"].eqNullSafe(few["name"])).select(F.col("tree").alias(group), *carried, "digest", "subroot", "root", "proof")


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf with this digest has by this proof."""
    return F.aggregate(proof, digest, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]).cast("binary"), 256))


def document_manifest(docs: DataFrame, received: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof of each document, and received: the leaf of the row whose columns `received` names are replaced.

    A leaf is the digest of doc_id, source, lang, n_chars and text; other columns are ignored. Nulls are
    told apart from empty texts. Documents without a doc_id come first in their source.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = [(received or {}).get(c, F.col(c)) for c in FIELDS]
    leaves = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*fields).alias("digest"), leaf_digest(*changed).alias("received"))
    return manifest(leaves, "source", "doc_id", ["received"]).select("doc_id", "source", F.col("digest").alias("leaf"), "received", "subroot", "root", "proof")
