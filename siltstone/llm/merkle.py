"""Merkle manifest of a dataset: leaf digests, a subtree for each group, a root over the groups, and a proof for each row.

Rows of a group stand in the order of their id; while several nodes remain, every `arity` consecutive ones become the
digest of their concatenated hex digests.  Nodes are cut into aligned blocks of arity ** HEIGHT.  Each block is one call
of a recursive postorder traversal, which returns the digest of its subtree and, while unwinding, appends the siblings
of each child to the leaves below it.  The blocks' roots are the nodes of the next traversal, until a group is one
block; the groups' roots, in order, are the nodes of one more tree.  A block never depends on the size of its group, so
a group of any size is spread over as many tasks as it has blocks.

Proofs travel downwards through the blocks' table, a row for each block; leaves meet it by (group, block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import durable, numbered, pick, same

#: Levels of the tree within a block: 243 leaves at arity 3.
HEIGHT = 5
#: One level of a proof: the digests left and right of the path's node, concatenated in binary.
STEP = "struct<before: binary, after: binary>"
_STEP = pa.struct([("before", pa.binary()), ("after", pa.binary())])


def field(value: Column | str) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value; so no two rows share an encoding."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column | str) -> Column:
    """The digest (lowercase hex SHA-256) of a row's encoded values."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def traverse(digests: list[bytes], height: int, arity: int) -> tuple[bytes, list[list[tuple[bytes, bytes]]]]:
    """The digest of the subtree of that height over the leaves, and each leaf's siblings from below.

    Postorder: a node's children come first; then their siblings are appended to all leaves that each child contains.
    A height above what the leaves need ends in nodes of one child each.
    """
    paths: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]

    def visit(first: int, last: int, height: int) -> bytes:
        if height == 0:
            return digests[first]
        step = arity ** (height - 1)
        cuts = range(first, last, step)
        below = [visit(at, min(at + step, last), height - 1) for at in cuts]
        for k, at in enumerate(cuts):
            siblings = (b"".join(below[:k]), b"".join(below[k + 1 :]))
            for leaf in range(at, min(at + step, last)):
                paths[leaf].append(siblings)
        return parent(below)

    return visit(0, len(digests), height), paths


def _steps(paths: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    flat = [s for p in paths for s in p]
    steps = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.binary()) for k in (0, 1)], fields=list(_STEP))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), steps)


def _blocks(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The nodes (grp, pos, size, digest and others) with proof, the siblings within their block, and top, its root."""

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("pos")
        size, levels = rows.column("size")[0].as_py(), 0
        while levels < height and arity**levels < size:
            levels += 1
        top, paths = traverse(rows.column("digest").to_pylist(), levels, arity)
        return rows.append_column("proof", _steps(paths)).append_column("top", pa.array([top] * len(rows), pa.binary()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    keyed = nodes.groupBy("grp", F.floor(F.col("pos") / arity**height).alias("_block"))
    return durable(keyed.applyInArrow(block, f"{kinds}, proof array<{STEP}>, top binary"))


def _tops(blocks: DataFrame, span: int) -> DataFrame:
    """The blocks' roots as nodes of the next traversal."""
    return blocks.filter(F.col("pos") % span == 0).select("grp", F.expr(f"pos div {span}").alias("pos"), F.expr(f"(size + {span} - 1) div {span}").alias("size"), F.col("top").alias("digest"))


def _under(nodes: DataFrame, above: DataFrame, span: int) -> DataFrame:
    """The nodes with the proofs and other columns of their blocks in above: grp, pos, proof, ..."""
    above = above.withColumnsRenamed({"pos": "_block", "proof": "_above"})
    met = same(nodes.withColumn("_block", F.expr(f"pos div {span}")), above, ["grp", "_block"])
    return met.withColumn("proof", F.concat("proof", "_above")).drop("_block", "_above", "top")


def climb(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The nodes (grp, pos, size, digest) as grp, pos, proof, root: all siblings up to their group's root."""
    span, blocks = arity**height, _blocks(nodes, arity, height)
    if blocks.filter(F.col("size") > span).isEmpty():
        return blocks.select("grp", "pos", "proof", F.col("top").alias("root"))
    return durable(_under(blocks.select("grp", "pos", "proof"), climb(_tops(blocks, span), arity, height), span))


def manifest(
    docs: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    arity: int = 3,
    height: int = HEIGHT,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per row: id_col, group_col, leaf, subroot, root (lowercase hex) and proof, an array of STEP from leaf to root.

    fields: the columns in a leaf, in order; a missing one reads as null.  carry: further columns by name, each over
    the fields' names.  Groups stand in the order of their UTF-8 bytes, rows in that of their ids, null first; rows of
    equal ids in the order of their leaves, so equal rows take places of their own and any of them may be the first.
    A table of one row has its leaf as root and an empty proof; an empty table gives no rows.
    """
    named = {f"f{i}": c for i, c in enumerate(fields)} | {"_id": id_col, "_grp": group_col}
    rows = pick(docs, **named)
    carried = {f"carried{i}": c for i, c in enumerate((carry or {}).values())}
    plain = rows.select(*[F.col(f"f{i}").alias(c) for i, c in enumerate(fields)], "_id", "_grp")
    leaves = plain.select(
        F.col("_id").cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col("_grp").cast("string")), F.lit("")).alias("grp"),
        F.unhex(leaf_digest(*fields)).alias("digest"),
        *[c.alias(n) for n, c in carried.items()],
    )
    span = arity**height
    leaves = _blocks(numbered(durable(leaves), ["grp"], ["id", "digest"]), arity, height)
    above = climb(_tops(leaves, span), arity, height)
    groups = above.filter("pos = 0").select(F.lit(0).alias("all"), F.col("grp").alias("name"), F.col("root").alias("digest"))
    groups = numbered(groups, ["all"], ["name"]).withColumnRenamed("all", "grp")
    whole = same(groups.select("grp", "pos", "name", F.col("digest").alias("subroot")), climb(groups.select("grp", "pos", "size", "digest"), arity, height), ["grp", "pos"])
    whole = whole.select(F.col("name").alias("grp"), "subroot", F.col("root").alias("whole"), F.col("proof").alias("_outer"))
    above = same(above.drop("root"), durable(whole), ["grp"]).withColumn("proof", F.concat("proof", "_outer")).drop("_outer")
    out = _under(leaves, durable(above), span)
    text = {"leaf": "digest", "subroot": "subroot", "root": "whole"}
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).alias(group_col),
        *[F.lower(F.hex(c)).alias(n) for n, c in text.items()],
        "proof",
        *[F.col(f"carried{i}").alias(n) for i, n in enumerate(carry or {})],
    )


def proof_digest(proof: Column | str) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s["before"], s["after"])))), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column | str) -> Column:
    """The root that a leaf (hex) and a proof give."""
    proof = F.col(proof) if isinstance(proof, str) else proof
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(F.lower(F.hex(s["before"])), at, F.lower(F.hex(s["after"]))).cast("binary"), 256))
