"""Merkle manifest of a table: a persistent tree over aligned blocks, and proofs that survive tampering checks.

Every row is a leaf: the sha256 of its id, source, language, length and text, each as byte count, colon and value
(a null as a dash). The leaves of a source, in order of id, are the base of a tree of fan-out 3; the roots of the
sources, in order of name, are the base of another, whose root names the whole table.

Blocks. A block is 3^HEIGHT consecutive nodes of one group. It is built in one task, its root is a node of the next
round, and rounds go on until every group has a single node: no task ever sees more than a block, however
large a source is. On the way back every block hands its path to the root down to its nodes.

Versions. The tree is persistent: changing a leaf copies the leaf and its ancestors inside the block and shares every
other node with the version before (`Block.changed` returns the copies only). The new block root then goes on along
the path of its block, so the version reaches its own root without rebuilding anything. A leaf is verified when its version's
root is the table's.

Rows with one id go by their leaf digest; repeated rows are leaves of their own. A null id comes first, and
counts as the empty text where its checksum decides about tampering. A null source is a group of its own, before all others. Texts are hashed whole, by Spark's own functions,
and do not leave the scan. An empty table has no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievewright.llm.common import in_batches, numbered, row_groups
from sievewright.session import settled

FAN, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class Block:
    """A tree over the digests of one block: `levels[0]` are the nodes given, each further level the runs of three."""

    def __init__(self, digests: list[str], height: int):
        self.levels = [digests]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([H(*below[i:i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of a node's ancestors in their runs, bottom-up."""
        found = []
        for level in self.levels[:-1]:
            run = at - at % FAN
            found.append(("".join(level[run:at]), "".join(level[at + 1:run + FAN])))
            at //= FAN
        return found

    def changed(self, at: int, digest: str) -> list[str]:
        """The version in which one node differs: its copied nodes from leaf to block root; all others are shared."""
        copies = [digest]
        for level in self.levels[:-1]:
            run = at - at % FAN
            copies.append(H(*level[run:at], copies[-1], *level[at + 1:run + FAN]))
            at //= FAN
        return copies


def follow(digest: str, path) -> str:
    """The root that a node reaches along a path."""
    for left, right in path:
        digest = H(left, digest, right)
    return digest


def height_of(size: int, most: int = HEIGHT) -> int:
    """Levels that a block of a group of `size` nodes has: all, or as many as the group needs to become one node."""
    levels = 0
    while levels < most and FAN ** levels < size:
        levels += 1
    return levels


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN ** height))


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Nodes (grp, pos, size, digest) of the next round: one a block."""
    def run(batches):
        def rows():
            for (grp, block), members in row_groups(batches, 2):
                members = list(members)
                size = members[0][3]
                root = Block([m[4] for m in members], height_of(size, height)).root
                yield grp, block, -(-size // FAN ** height), root
        yield from in_batches(rows(), ["grp", "pos", "size", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])
    dealt = _blocks(nodes, height).select("grp", "block", "pos", "size", "digest")
    return dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(
        run, "grp string, pos long, size long, digest string")


def climb(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The node tables of all rounds; the last has one node a group. One number a round reaches the driver."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        rounds.append(settled(block_roots(rounds[-1], height), "merkle-round"))
    return rounds


def _with_parents(nodes: DataFrame, parents: DataFrame, carried: list[str], height: int) -> DataFrame:
    """Nodes by block, each block led by the row of its parent node with the path upwards. Sorted within partitions."""
    extra = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried]
    heads = parents.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"),
                           F.lit(None).cast("string").alias("digest"), "path", "subroot", "root", *extra)
    empty = [F.lit(None).cast(parents.schema[c].dataType).alias(c) for c in ("path", "subroot", "root")]
    below = _blocks(nodes, height).select("grp", "block", "pos", "size", "digest", *empty, *carried)
    return heads.unionByName(below).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def descend(rounds: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Hand paths down from the last round: (grp, pos, path, subroot, root) for the nodes of the first."""
    def run(batches):
        def rows():
            for (grp, _), members in row_groups(batches, 2):
                (_, _, _, _, _, path, subroot, root), *members = members
                block = Block([m[4] for m in members], height_of(members[0][3], height))
                for at, member in enumerate(members):
                    own = [{"left": a, "right": b} for a, b in block.path(at)]
                    yield grp, member[2], own + path, subroot, root
        yield from in_batches(rows(), ["grp", "pos", "path", "subroot", "root"],
                              [pa.string(), pa.int64(), STEP, pa.string(), pa.string()])
    for nodes in reversed(rounds[:-1]):
        top = _with_parents(nodes, top, [], height).mapInArrow(
            run, "grp string, pos long, path array<struct<left: string, right: string>>, subroot string, root string")
    return top


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values, each a dash if null, else its bytes' count, a colon and the value."""
    parts = []
    for value in values:
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def without_newlines(docs: DataFrame) -> Column:
    """The text as tampering leaves it: without line feeds where the checksum of the id is even, else null."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    return F.when(even, F.translate("text", "\n", ""))


def proofs(docs: DataFrame, tampered=without_newlines, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied), one row a document.

    `tampered(docs)` is the changed text of a row, null where it is untouched. `copied` counts the nodes
    that the row's version has of its own, 0 where nothing changed.
    """
    text = tampered(docs)
    columns = [F.col(c) for c in FIELDS]
    changed = F.when(text.isNotNull() & (text != F.col("text")), leaf_digest([*columns[:-1], text]))
    leaves = settled(docs.select("doc_id", F.col("source").cast("string").alias("grp"), leaf_digest(columns).alias("digest"),
                                 changed.alias("changed")), "leaves")
    placed = settled(numbered(leaves, ["grp"], [F.col("doc_id"), F.col("digest")], name="leaves-in-order"), "numbered-leaves")
    rounds = climb(placed.select("grp", "pos", "size", "digest"), height)
    sources = settled(numbered(rounds[-1].select(F.col("grp").alias("source"), "digest"), [], [F.col("source")], name="sources"), "numbered-sources")
    upper = climb(sources.select(F.lit("").alias("grp"), "pos", "size", "digest"), height)
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    top = upper[-1].select("grp", "pos", nothing.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    by_source = descend(upper, top, height).select(F.col("pos").alias("at"), "path", "root").join(
        sources.select(F.col("pos").alias("at"), "source", F.col("digest").alias("subroot")), "at")
    tops = by_source.select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    parents = tops
    if len(rounds) > 1:
        parents = descend(rounds[1:], tops, height)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        def rows():
            for _, members in row_groups(batches, 2):
                (_, _, _, _, _, path, subroot, root, _, _), *members = members
                block = Block([m[4] for m in members], height_of(members[0][3], height))
                above = [(step["left"], step["right"]) for step in path]
                upper_levels = "".join(a + b for a, b in above)
                for at, (_, _, _, _, leaf, _, _, _, number, new) in enumerate(members):
                    copies = block.changed(at, new or leaf)
                    folded = follow(copies[-1], above)
                    siblings = "".join(a + b for a, b in block.path(at)) + upper_levels
                    yield (number, leaf, subroot, root, H(siblings), folded, folded == root,
                           len(copies) + len(above) if new else 0)
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied"]
        types = [arrow, pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield from in_batches(rows(), names, types)

    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(kind)
    joined = _with_parents(placed, parents, ["doc_id", "changed"], height)
    return joined.mapInArrow(run, f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
                             "folded_root string, verified boolean, copied long")
