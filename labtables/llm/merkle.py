"""Merkle manifest of a table: a hash per row, one tree per group, one root, a proof for each row.

H is the lowercase hex SHA-256 of its inputs written one after the other, digests as hex text.
A row's leaf is H of its fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its
text.  The leaves of a group stand in ascending order; every ``fanout`` consecutive nodes become
their H (the last run may be shorter, even one node) until one node, the subroot, remains.  The
subroots, in the order of their groups (null first, then by bytes), likewise give the root.

Leaves are numbered by ranges and cut into aligned blocks of a power of the fanout, each of
which is hashed up to its own root in one task.  Blocks then exchange roots like a butterfly: in
each round the ``fanout`` blocks that differ in one digit of their number (in base fanout) swap the
roots of the subtrees they are in, and each hashes the common ancestor by itself.  So every block
comes to hold all siblings on its way to the subroot, and the subroot, without a pass back down.
Where the last subtree of a round has fewer blocks than the others, its blocks also send to those
that have no partner in it.  A round shuffles a row per block (leaves / 4096), not leaves; a
group with most of the rows is many blocks.  The subroots go through the same steps as one tree.

A proof is the siblings' digests, level by level from the leaf through the subroot to the root,
left to right; which side each is on follows from the leaf's and the group's numbers.

Defined cases: null fields and groups as above; repeated keys and rows are leaves of their own,
ordered by their hash, null keys first; texts of any length are hashed whole where they are read
and never shuffled; an empty table gives no rows; other columns are ignored, unless named in
``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labtables.llm._common import parts_for
from labtables.session import scratch_dir

FANOUT = 2
#: Leaves of a block at most, and rounds of the exchange after which its rows are written.
BLOCK_LEAVES, ROUNDS_WRITTEN = 4096, 8
_DIGEST = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: str | Column) -> Column:
    """The hash of a row's fields."""
    parts = []
    for field in fields:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def _h(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _block_leaves(fanout: int) -> int:
    """The largest power of the fanout within BLOCK_LEAVES."""
    size = fanout
    while size * fanout <= BLOCK_LEAVES:
        size *= fanout
    return size


def _levels(leaves: list[str], n: int, block: int, fanout: int) -> list[list[str]]:
    """A block's levels up to its root: as many for each block of a tree of ``n`` leaves."""
    width = min(n, block)
    levels = [leaves]
    while width > 1:
        below = levels[-1]
        levels.append([_h(below[k : k + fanout]) for k in range(0, len(below), fanout)])
        width = -(-width // fanout)
    return levels


def _numbered(leaves: DataFrame, order: list[str], block: int) -> DataFrame:
    """``leaves`` (tree, leaf and others) with pos, n (of the tree) and block, from a written table.

    Ranges of the whole order are numbered inside, and shifted by the sizes of those before.
    """
    spark = leaves.sparkSession
    folder = scratch_dir(spark, "leaves")
    (
        leaves.repartitionByRange(parts_for(spark), "tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .write.parquet(folder)
    )
    written = spark.read.parquet(folder)
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        written.groupBy("tree", "part")
        .agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
        .select(
            "tree",
            "part",
            (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("here").over(Window.partitionBy("tree")).alias("n"),
        )
    )
    placed = written.join(shifts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return placed.drop("part", "at", "shift").withColumn("block", F.expr(f"pos div {block}"))


def _block_roots(numbered: DataFrame, block: int, fanout: int) -> DataFrame:
    """tree, block, n_blocks and the block's own root."""

    def roots(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        n = part["n"][0].as_py()
        top = _levels(part["leaf"].to_pylist(), n, block, fanout)[-1][0]
        return pa.table(
            {
                "tree": part["tree"][:1].combine_chunks(),
                "block": part["block"][:1].combine_chunks(),
                "n_blocks": pa.array([-(-n // block)], pa.int64()),
                "root": pa.array([top]),
            }
        )

    return (
        numbered.select("tree", "block", "pos", "n", "leaf")
        .groupBy("tree", "block")
        .applyInArrow(roots, "tree string, block long, n_blocks long, root string")
    )


def _exchange(blocks: DataFrame, fanout: int) -> DataFrame:
    """Each block with its tree's root and the siblings on the way there (``path``)."""
    spark = blocks.sparkSession
    folder = scratch_dir(spark, "blocks")
    blocks.withColumn("path", F.lit("")).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    most = blocks.agg(F.max("n_blocks")).first()[0] or 0
    span, done = 1, 0
    while span < most:
        blocks = _round(blocks, fanout, span)
        span, done = span * fanout, done + 1
        if done % ROUNDS_WRITTEN == 0 and span < most:
            folder = scratch_dir(spark, "blocks")
            blocks.write.parquet(folder)
            blocks = spark.read.parquet(folder)
    return blocks


def _round(blocks: DataFrame, fanout: int, span: int) -> DataFrame:
    """One round: subtrees of ``span`` blocks become subtrees of ``span`` x ``fanout``."""
    widest = span * fanout
    own = F.expr(f"block div {span}")  # the subtree
    low = F.col("block") % span
    has_partners = F.col("n_blocks") > F.greatest(F.expr(f"block div {widest}") * widest + span, F.lit(span))
    held = F.least(F.lit(span), F.col("n_blocks") - own * span)  # blocks in the subtree
    sent = (
        blocks.withColumn("group", F.expr(f"block div {widest}"))
        .withColumn("digit", (own % fanout).cast("int"))
        .withColumn("low", low)
        .withColumn("to", F.explode(F.when(has_partners, F.sequence(low, F.lit(span - 1), held)).otherwise(F.array(low))))
    )
    swapped = F.array_sort(
        F.collect_list(F.struct("digit", "root")).over(Window.partitionBy("tree", "group", "to"))
    )
    met = sent.withColumn("met", swapped).where(F.col("to") == F.col("low"))
    others = F.filter("met", lambda x: x["digit"] != F.col("digit"))

    def text(nodes: Column) -> Column:
        return F.array_join(F.transform(nodes, lambda x: x["root"]), "")

    going_on = F.col("n_blocks") > span
    return met.select(
        "tree",
        "block",
        "n_blocks",
        F.when(going_on, digest(text(F.col("met")))).otherwise(F.col("root")).alias("root"),
        F.when(going_on, F.concat("path", text(others))).otherwise(F.col("path")).alias("path"),
    )


def _paths(numbered: DataFrame, blocks: DataFrame, block: int, fanout: int) -> DataFrame:
    """``numbered`` rows with the columns of their block and the whole ``proof``."""
    more = [f for f in blocks.schema if f.name not in ("tree", "block", "n_blocks", "path")]
    schema = T.StructType([*numbered.schema, *more, T.StructField("proof", T.StringType())])

    def join(part: pa.Table, own: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        if not len(part):
            return schema_arrow.empty_table()
        levels = _levels(part["leaf"].to_pylist(), part["n"][0].as_py(), block, fanout)
        paths = [own["path"][0].as_py()]
        for nodes in levels[-2::-1]:
            paths = [
                "".join(nodes[k - k % fanout : k]) + "".join(nodes[k + 1 : k - k % fanout + fanout]) + paths[k // fanout]
                for k in range(len(nodes))
            ]
        columns = [part[f.name] for f in numbered_schema]
        columns += [pa.array([own[name][0].as_py()] * len(part), kind) for name, kind in more_kinds]
        return pa.Table.from_arrays([*columns, pa.array(paths, pa.string())], schema=schema_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    schema_arrow = to_arrow_schema(schema)
    numbered_schema = list(numbered.schema)
    more_kinds = [(f.name, to_arrow_type(f.dataType)) for f in more]
    return (
        numbered.groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInArrow(join, schema)
    )


def manifest(
    rows: DataFrame,
    fields: Sequence[str],
    tree: str,
    key: str,
    keep: Sequence[str] = (),
    fanout: int = FANOUT,
) -> DataFrame:
    """key, ``keep``, leaf, subroot, root, proof, leaf_index, n_leaves, tree_index, n_trees.

    One tree for each value of ``tree``, leaves in ascending order of ``key``.  ``leaf_index`` of
    ``n_leaves`` in the tree and ``tree_index`` of ``n_trees`` say how to fold the proof.
    """
    block = _block_leaves(fanout)
    named = F.col(tree).cast("string")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("1"), named), F.lit("0")).alias("tree"),  # null first, then by bytes
        F.struct(F.col(key).alias("key"), *[F.col(name).alias(f"keep{k}") for k, name in enumerate(keep)]).alias("row"),
        leaf(*fields).alias("leaf"),
    )
    numbered = _numbered(leaves, ["row.key", "leaf"], block)
    blocks = _exchange(_block_roots(numbered, block, fanout), fanout)
    tops = blocks.where("block = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("leaf")
    )
    upper = _numbered(tops, ["own"], block)
    upper_blocks = _exchange(_block_roots(upper, block, fanout), fanout)
    above = _paths(upper, upper_blocks, block, fanout).select(
        F.col("own").alias("tree"),
        F.col("pos").alias("tree_index"),
        F.col("n").alias("n_trees"),
        F.col("leaf").alias("subroot"),
        F.col("root").alias("top"),
        F.col("proof").alias("rest"),
    )
    whole = blocks.join(above, "tree").select(
        "tree",
        "block",
        F.concat("path", "rest").alias("path"),
        "subroot",
        "top",
        "tree_index",
        "n_trees",
    )
    return _paths(numbered, whole, block, fanout).select(
        F.col("row.key").alias(key),
        *[F.col(f"row.keep{k}").alias(name) for k, name in enumerate(keep)],
        "leaf",
        "subroot",
        F.col("top").alias("root"),
        "proof",
        F.col("pos").alias("leaf_index"),
        F.col("n").alias("n_leaves"),
        "tree_index",
        "n_trees",
    )


def fold(node: str, proof: str, places: Sequence[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a leaf and its proof give; ``places``: (index, number) in the tree, then above."""
    at = 0
    for index, n in places:
        while n > 1:
            own = index % fanout
            others = min(fanout, n - (index - own)) - 1
            siblings = proof[at : at + _DIGEST * others]
            at += _DIGEST * others
            node = _h((siblings[: _DIGEST * own], node, siblings[_DIGEST * own :]))
            index, n = index // fanout, -(-n // fanout)
    return node


def folded(claim: str, fanout: int = FANOUT) -> Column:
    """The root that a manifest row's proof gives for the leaf in column ``claim``."""

    @F.pandas_udf("string")
    def roots(
        leaves: pd.Series, proof: pd.Series, i: pd.Series, n: pd.Series, j: pd.Series, m: pd.Series
    ) -> pd.Series:
        found = zip(leaves, proof, i, n, j, m, strict=True)
        return pd.Series([fold(x, p, ((a, b), (c, d)), fanout) for x, p, a, b, c, d in found], dtype=object)

    return roots(claim, "proof", "leaf_index", "n_leaves", "tree_index", "n_trees")
