"""A Merkle manifest of a table: one digest per row, trees over them, and proofs of rows.

Rows are leaves of the tree of their group, in an order of their own; every two consecutive
nodes have one parent, the last one may be alone. The roots of the groups, in order, are the
leaves of a tree of their own, whose root stands for the table.

Only every ``stride``-th level is stored, as one row per aligned subtree with the digests of
its lowest level. Whoever needs the levels between makes them anew from that row and gives them
up again: the next stored level needs the subtree's top, a proof needs the siblings on the way
from a node to that top. A proof goes from the stored level at the top down to the leaves, each
level joined to the one above by the number of its subtree, so a task holds ``2 ** stride``
digests at a time and a group may have any share of the rows.

Leaves are numbered by one shuffle by ranges of group and order: a row's place is its place in
its range after the rows of its group in the ranges before.

Defined results: null is a value of its own in every column, and a group; it comes first in any
order. Rows that agree in group and order are ordered by their digest; equal rows are
separate leaves. A group of one row has its leaf as root, and a table of one group its root. An
empty table has no root and no proofs. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aliasmith.session import scratch_folder, stored

STRIDE = 5
_STEP = "struct<before:string,after:string>"
# monotonically_increasing_id has the number of the partition above these bits.
_ROW_BITS = 33


def joined_digest(parts: Column) -> Column:
    """SHA-256 in hex of an array of strings, one after the other; null parts are left out."""
    return F.sha2(F.concat_ws("", parts), 256)


def row_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and itself, null as a dash."""
    texts = [c.cast("string") for c in columns]
    return joined_digest(
        F.array(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    )


@dataclass(frozen=True)
class Forest:
    """``levels[k]``: the stored level ``k * stride`` as ``(tree, block, n, members)``.

    ``n`` is how many nodes the tree has on that level, ``members`` are the nodes of one
    aligned subtree in order, as ``(pos, digest, kept)``.
    """

    levels: list[DataFrame]
    stride: int


@dataclass(frozen=True)
class Manifest:
    """``groups``: the trees of the groups; ``top``: the tree of their roots."""

    groups: Forest
    top: Forest
    address: str


def _numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves (tree, digest, ...)`` with ``pos``, the place in the tree, and ``n``, the tree's leaves."""
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    runs = placed.groupBy(F.col("tree").alias("_tree"), part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("_tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n"))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftright("_at", _ROW_BITS) == F.col("_part"))
    pos = (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos")
    return placed.join(runs, same).select("tree", pos, "n", "digest", "kept")


def _halved(nodes: Column) -> Column:
    parent = lambda i: joined_digest(F.array(F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), parent)


def _rebuilt(stride: int) -> Column:
    """All levels of a stored subtree, from its members up to its top."""
    # A tree with n nodes has as many levels above them as n - 1 has binary digits.
    height = F.when(F.col("n") > 1, F.least(F.length(F.bin(F.col("n") - 1)), F.lit(stride))).otherwise(0)
    lowest = F.transform("members", lambda m: m.digest)
    steps = F.slice(F.sequence(F.lit(1), F.lit(stride)), F.lit(1), height)
    return F.aggregate(steps, F.array(lowest), lambda levels, _: F.concat(levels, F.array(_halved(F.element_at(levels, -1)))))


def _top(levels: Column) -> Column:
    return F.element_at(F.element_at(levels, -1), 1)


def _write_forest(nodes: DataFrame, stride: int, folder: str) -> Forest:
    levels: list[DataFrame] = []
    while True:
        member = F.struct("pos", "digest", "kept").alias("member")
        blocks = nodes.select("tree", F.shiftright("pos", stride).alias("block"), "n", member).groupBy("tree", "block").agg(
            F.first("n").alias("n"), F.array_sort(F.collect_list("member")).alias("members")
        )
        address = f"{folder}-{len(levels)}"
        blocks.write.parquet(address)
        levels.append(nodes.sparkSession.read.schema(blocks.schema).parquet(address))
        taller = levels[-1].where(F.col("n") > 1 << stride)
        if taller.isEmpty():
            return Forest(levels, stride)
        nodes = taller.select(
            "tree",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / (1 << stride)).alias("n"),
            _top(_rebuilt(stride)).alias("digest"),
            F.lit(None).cast("struct<none:int>").alias("kept"),
        )


def tree_roots(forest: Forest) -> DataFrame:
    """``(tree, root)`` of every tree."""
    tops = [level.where(F.col("n") <= 1 << forest.stride) for level in forest.levels]
    found = [t.select("tree", _top(_rebuilt(forest.stride)).alias("root")) for t in tops]
    total = found[0]
    for more in found[1:]:
        total = total.union(more)
    return total


def write_manifest(
    rows: DataFrame,
    digest: Column,
    *,
    group: Column,
    order: Sequence[Column],
    keep: Mapping[str, Column],
    stride: int = STRIDE,
    address: str | None = None,
) -> Manifest:
    """Writes the manifest of ``rows`` to a folder, by default below the shared one.

    ``digest``, ``group`` and ``order`` are columns of ``rows``; what ``keep`` names is stored
    with a leaf and returned with its proof.
    """
    if stride < 1:
        raise ValueError("a subtree has one level at least")
    address = address or scratch_folder(rows.sparkSession, "manifest")
    keys = {f"_order{i}": c for i, c in enumerate(order)}
    kept = F.struct(*[c.alias(name) for name, c in keep.items()]) if keep else F.lit(None).cast("struct<none:int>")
    leaves = rows.select(
        group.alias("tree"), *[c.alias(name) for name, c in keys.items()], digest.alias("digest"), kept.alias("kept")
    )
    # The range partitioner looks at its input twice, the rows are hashed once.
    numbered = _numbered(stored(leaves, "digests"), [*keys, "digest"])
    groups = _write_forest(numbered, stride, f"{address}/groups")
    roots = tree_roots(groups).select(
        F.lit(0).alias("tree"), F.col("tree").alias("_order0"), F.col("root").alias("digest"), F.struct(F.col("tree").alias("group")).alias("kept")
    )
    top = _write_forest(_numbered(stored(roots, "group-roots"), ["_order0"]), stride, f"{address}/top")
    counts = rows.sparkSession.createDataFrame(
        [(stride, len(groups.levels), len(top.levels))], "stride int, groups int, top int"
    )
    counts.coalesce(1).write.parquet(f"{address}/levels")
    return Manifest(groups, top, address)


def read_manifest(spark: SparkSession, address: str) -> Manifest:
    """The manifest that a folder holds."""
    row = spark.read.parquet(f"{address}/levels").first()

    def forest(name: str, count: int) -> Forest:
        return Forest([spark.read.parquet(f"{address}/{name}-{k}") for k in range(count)], row.stride)

    return Manifest(forest("groups", row.groups), forest("top", row.top), address)


def _siblings(levels: Column, place: Column) -> Column:
    """The steps from a member of a subtree to its top: the siblings before and after, if any."""

    def step(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(2), level)).cast("int")
        other = F.get(nodes, F.when(at % 2 == 1, at - 1).otherwise(at + 1))
        return F.struct(F.when(at % 2 == 1, other).alias("before"), F.when(at % 2 == 0, other).alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _proofs(forest: Forest, above: DataFrame | None) -> DataFrame:
    """``(tree, pos, digest, kept, path, subroot, root)`` of every leaf.

    ``above (tree, path, root)`` goes on from the roots of the trees; without it they are the end.
    """
    stride, found = forest.stride, None
    for level in reversed(forest.levels):
        made = level.withColumn("_levels", _rebuilt(stride))
        tops = made.where(F.col("n") <= 1 << stride).withColumn("subroot", _top(F.col("_levels")))
        if above is None:
            blocks = tops.select("*", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("subroot").alias("root"))
        else:
            ends = above.select(F.col("tree").alias("_tree"), "path", "root")
            blocks = tops.join(ends, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if found is not None:
            upper = found.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "subroot", "path", "root")
            same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_pos"))
            lower = made.where(F.col("n") > 1 << stride).join(upper, same).drop("_tree", "_pos")
            blocks = blocks.unionByName(lower)
        place = lambda m: (m.pos % (1 << stride)).cast("int")
        member = F.explode(
            F.transform(
                "members",
                lambda m: F.struct(m.alias("node"), F.concat(_siblings(F.col("_levels"), place(m)), F.col("path")).alias("path")),
            )
        )
        found = blocks.select("tree", "subroot", "root", member.alias("m")).select(
            "tree", "m.node.pos", "m.node.digest", "m.node.kept", "m.path", "subroot", "root"
        )
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """``(tree, pos, digest, kept, path, subroot, root)`` of every row of the table.

    ``path`` has one step per level from the leaf by its group's root to the root, with the
    sibling before and the sibling after the node, of which one is null, or both if it is alone.
    """
    top = _proofs(manifest.top, None).select(F.col("kept.group").alias("tree"), "path", "root")
    return _proofs(manifest.groups, stored(top, "group-proofs"))


def siblings(path: Column) -> Column:
    """The siblings of a proof, level by level."""
    return F.flatten(F.transform(path, lambda s: F.array_compact(F.array(s.before, s.after))))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, digest, lambda node, s: joined_digest(F.array(s.before, node, s.after)))
