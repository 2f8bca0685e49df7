"""Merkle manifest of a table: a tree over each group's rows, a tree over the groups' subroots, and for
every row the siblings that prove it against the root.

A leaf is H (sha256 as lowercase hex) of a row's fields, each ``-`` if null and else its UTF-8 byte count,
``:`` and the value.  A group's leaves ascend by id.  While several nodes remain, every two consecutive ones
become H of both as hex text, a last one alone H of itself.  Subroots, ordered by group, give the root alike.

Leaves are hashed where rows lie; from there on only digests move.  They are numbered by ranges of
(group, id, leaf), so a group of any size is spread.  A superblock is ``1 << bits`` aligned neighbours of
a level.  Upwards each superblock reduces to one node, and its nodes form the next level's superblocks.
Downwards nodes and the outer siblings of their superblock are cogrouped by superblock: one function
finishes the local reduction, joins the proof and, at the leaves, folds the candidate to a root.  A task
holds one superblock, whatever the size of a group; all steps are written tables or shuffles of them.

Defined results: rows with equal ids are ordered by their leaf (equal rows are interchangeable); null ids
come first, null groups are a group of their own that comes first; an empty table has no rows and no root;
a group of one row has its leaf as subroot.  Columns that are not named are left out of the leaf.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from .common import Scratch

#: Levels of the tree in one superblock.
BITS = 11


def field(c: Column) -> Column:
    """A field of a leaf: ``-`` or byte count, colon and value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def H(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def heights(size: int, bits: int) -> int:
    """Levels to climb in a superblock of a level with ``size`` nodes."""
    return min(bits, (size - 1).bit_length())


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from the given ones to the one that remains."""
    out = [nodes]
    for _ in range(levels):
        nodes = [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def fold(node: str, pos: int, size: int, proof: list[str], at: int = 0) -> tuple[str, int]:
    """The subroot from a node, its place among ``size`` and its siblings from ``proof[at]`` on, and the
    place behind the siblings used."""
    while size > 1:
        other = pos ^ 1
        if other < size:
            node = H(proof[at], node) if pos & 1 else H(node, proof[at])
            at += 1
        else:
            node = H(node)
        pos, size = pos >> 1, (size + 1) >> 1
    return node, at


def _reduce(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        size = int(pdf["size"].iloc[0])
        node = climb(pdf["node"].tolist(), heights(size, bits))[-1][0]
        return pd.DataFrame({"grp": [int(pdf["grp"].iloc[0])], "pos": [int(pdf["pos"].iloc[0]) >> bits],
                             "size": [-(-size >> bits)], "node": [node]})
    return run


def _paths(nodes: list[str], levels: int) -> list[list[str]]:
    """For every node of a superblock its siblings inside it, bottom up."""
    rows = climb(nodes, levels)
    out = []
    for i in range(len(nodes)):
        path = []
        for level in rows[:-1]:
            if i ^ 1 < len(level):
                path.append(level[i ^ 1])
            i >>= 1
        out.append(path)
    return out


def _extend(bits: int):
    """Nodes of a superblock and the row of its outer siblings -> the siblings of every node."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        above = list(outer["proof"].iloc[0])
        local = _paths(nodes["node"].tolist(), heights(int(nodes["size"].iloc[0]), bits))
        return pd.DataFrame({"grp": nodes["grp"], "pos": nodes["pos"], "node": nodes["node"], "proof": [p + above for p in local],
                             **{c: [outer[c].iloc[0]] * len(nodes) for c in ("top", "subroot", "root")}})
    return run


def _prove(bits: int):
    """The same for leaves, whose candidate is folded to a root."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        size, group = int(nodes["size"].iloc[0]), int(nodes["grp"].iloc[0])
        above, root, top = list(outer["proof"].iloc[0]), outer["root"].iloc[0], int(outer["top"].iloc[0])
        proofs = [p + above for p in _paths(nodes["node"].tolist(), heights(size, bits))]
        folded = []
        for pos, node, proof in zip(nodes["pos"].tolist(), nodes["candidate"].tolist(), proofs, strict=True):
            node, at = fold(node, pos, size, proof)
            folded.append(fold(node, group, top, proof, at)[0])
        return pd.DataFrame({"id": nodes["id"], "leaf": nodes["node"], "subroot": outer["subroot"].iloc[0], "root": root,
                             "proof": proofs, "folded_root": folded, "verified": [x == root for x in folded]})
    return run


@dataclass
class Manifest:
    """``subroots``: group, subroot (one row a group); ``root``: null for an empty table; ``proofs``: one row a
    row of the table: id, leaf, subroot, root, proof (siblings from the leaf up), folded_root, verified."""

    subroots: DataFrame
    root: str | None
    proofs: DataFrame


_NODE = "grp long, pos long, size long, node string"
_OUTER = "grp long, pos long, node string, proof array<string>, top long, subroot string, root string"


def _levels(scratch: Scratch, nodes: DataFrame, size: int, bits: int) -> list[DataFrame]:
    """The given nodes and those that stand at the tops of superblocks, up to one node a group."""
    out = [nodes]
    while size > 1:
        block = F.shiftright("pos", bits).alias("block")
        up = out[-1].select("grp", "pos", "size", "node").groupBy("grp", block).applyInPandas(_reduce(bits), _NODE)
        out.append(scratch.table(up))
        size = -(-size >> bits)
    return out


def _descend(levels: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """The siblings of every node of ``levels[1]``, from those of the one node of each group."""
    for nodes in reversed(levels[1:-1]):
        outer = _cogrouped(nodes, outer, bits).applyInPandas(_extend(bits), _OUTER)
    return outer


def _cogrouped(nodes: DataFrame, outer: DataFrame, bits: int):
    return nodes.groupBy("grp", F.shiftright("pos", bits).alias("block")).cogroup(outer.groupBy("grp", F.col("pos").alias("block")))


def _numbered(scratch: Scratch, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their group's number and size and their place in it, and one row a group.

    The table holds ranges of the order; a small table of each group's rows in each range carries places on."""
    spark = scratch.spark
    leaves = scratch.table(leaves.withColumn("tie", F.monotonically_increasing_id()))  # equal rows spread, too
    order = ["name", "id", "node", "tie"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = scratch.table(ranged.select("name", "id", "node", "candidate", F.spark_partition_id().alias("part"),
                                         F.monotonically_increasing_id().alias("row")))
    parts = ranged.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    group = Window.partitionBy("name")  # one row a range that the group reaches into
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.table(parts.select("name", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size")))
    names = parts.groupBy("name").agg(F.first("size").alias("size"))
    groups, n = number_rows(names, ["name"], "grp", int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = scratch.table(groups.select("name", "size", (F.col("grp") - 1).alias("grp"), F.lit(n).cast("long").alias("top")))
    shifts = parts.select(F.col("name").alias("of"), "part", "shift", "size")
    numbers = groups.select(F.col("name").alias("its"), "grp")
    shifts = shifts.join(numbers, F.col("of").eqNullSafe(F.col("its"))).select("of", F.col("part").alias("in"), "shift", "size", "grp")
    placed = ranged.join(shifts, (F.col("part") == F.col("in")) & F.col("name").eqNullSafe(F.col("of")))
    return placed.select("grp", (F.col("row") + F.col("shift")).alias("pos"), "size", "node", "id", "candidate"), groups


def build(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang",
          candidate: Column | None = None, bits: int = BITS) -> Manifest:
    """The manifest of ``docs`` over the fields ``columns``.  ``candidate`` is the leaf to be verified in each
    row's place (null or none: the row's own)."""
    own = leaf([F.col(f"`{c}`") for c in columns])
    rows = docs.select(F.col(f"`{group_col}`").cast("string").alias("name"), F.col(f"`{id_col}`").alias("id"), own.alias("node"),
                       *([candidate.alias("given")] if candidate is not None else []))
    given = F.coalesce("given", "node") if candidate is not None else F.col("node")
    scratch = Scratch(docs.sparkSession)
    leaves, groups = _numbered(scratch, rows.select("name", "id", "node", given.alias("candidate")))
    most = groups.agg(F.max("size"), F.max("top")).first()
    ups = _levels(scratch, leaves, most[0] or 0, bits)
    subroots = ups[-1].select("grp", F.col("node").alias("subroot"))
    whole = subroots.join(groups, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.col("top").alias("size"),
                                                F.col("subroot").alias("node"))
    tops = _levels(scratch, scratch.table(whole), most[1] or 0, bits)
    found = tops[-1].first() if most[1] else None
    root = found["node"] if found else None
    # from the root down: the siblings of each subroot, then of each superblock, then the leaves'
    none = F.lit(None).cast("string").alias("subroot")
    outer = tops[-1].select("grp", "pos", "node", F.expr("cast(array() as array<string>)").alias("proof"),
                            F.col("size").alias("top"), none, F.lit(root).cast("string").alias("root"))
    if len(tops) > 1:
        outer = _cogrouped(tops[0], _descend(tops, outer, bits), bits).applyInPandas(_extend(bits), _OUTER)
    top = F.lit(most[1] or 0).cast("long").alias("top")
    outer = outer.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "node", "proof", top,
                         F.col("node").alias("subroot"), "root")
    kind = leaves.schema["id"].dataType.simpleString()
    result = f"id {kind}, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    proofs = _cogrouped(leaves, _descend(ups, outer, bits), bits).applyInPandas(_prove(bits), result)
    named = groups.select("grp", F.col("name").alias("group")).join(subroots, "grp").select("group", "subroot")
    return Manifest(named, root, proofs)
