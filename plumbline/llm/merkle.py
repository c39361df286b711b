"""Merkle manifest of a table: a digest for each row, a tree for each group, one root, and a proof for every row.

Leaves are numbered within their group without a window over it: rows are sorted by range, and only a
count per range and group meets anywhere. Then blocks of 512 consecutive nodes become arrays, and SQL's higher-order
functions collapse three levels of each block (``sequence``, ``transform``, ``slice`` inside an
``aggregate`` over levels); the blocks' roots are the nodes of the next round. The groups' roots are the
leaves of one more tree of the same kind. Siblings come back the other way: a block gets the path above
it once, and its own levels add the rest, so no proof is shuffled row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import computed, materialise, small

#: Nodes that become one, and levels that a block holds.
FAN, LEVELS = 8, 3
WIDTH = FAN**LEVELS

#: Most bytes of a path in estimates: a dozen levels of seven hex digests.
PATH_BYTES = 12 * 7 * 64

#: All levels of a block from its digests; a level is built where its tree has several nodes below it.
_COLLAPSE = f"""aggregate(sequence(0, {LEVELS - 1}), array(digests), (done, k) -> concat(done, array(
  CASE WHEN n > power({FAN}, k) THEN transform(sequence(0, cast((size(element_at(done, -1)) - 1) div {FAN} AS INT)),
    i -> sha2(array_join(slice(element_at(done, -1), {FAN} * i + 1, {FAN}), ''), 256)) ELSE element_at(done, -1) END)))"""

#: Siblings of element ``i`` on the levels of its block, lowest first: texts left and right of the node.
_PATH = f"""transform(filter(sequence(0, {LEVELS - 1}), k -> n > power({FAN}, k)), k -> transform(array(cast(i div cast(power({FAN}, k) AS INT) AS INT)),
  q -> struct(array_join(slice(levels[k], {FAN} * cast(q div {FAN} AS INT) + 1, q % {FAN}), '') AS left, array_join(slice(levels[k], q + 2, {FAN - 1} - q % {FAN}), '') AS right))[0])"""


def row_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns: ``-`` for null, else length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column ``tree``) and pos, their place from 0 within the tree, and n, the tree's size.

    ``order`` has to be total but for rows that are alike. Sorted ranges are written, so that places
    never depend on a second evaluation; a tree of any size is spread over all ranges.
    """
    keys = ["tree", *order]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranges = materialise(ranges, "merkle-ranges").withColumn("part", F.shiftright("at", 33))
    counts = ranges.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")), "merkle-starts")
    return ranges.join(small(starts, 100), ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Written blocks (tree, block, n, items, top) of nodes (tree, pos, n, digest and more); items are in order of pos."""
    carried = [c for c in nodes.columns if c not in ("tree", "pos", "n", "digest")]
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("items")
    blocks = nodes.groupBy("tree", F.expr(f"pos div {WIDTH}").alias("block")).agg(F.first("n").alias("n"), items)
    return materialise(_with_levels(blocks).withColumn("top", F.element_at("levels", -1)[0]).drop("levels"), "merkle-blocks")


def _with_levels(blocks: DataFrame) -> DataFrame:
    return computed(blocks.withColumn("digests", F.expr("transform(items, x -> x.digest)")), "levels", F.expr(_COLLAPSE)).drop("digests")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks from the leaves up, and (tree, top)."""
    rounds = []
    while True:
        rounds.append(blocks := _blocks(nodes))
        nodes = blocks.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), F.col("top").alias("digest"))
        if not nodes.where("n > 1").limit(1).count():
            return rounds, blocks.select("tree", "top")


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest round: their items' fields, the other columns of ``above`` and path.

    ``above``: (tree, block, path and more), what stands over each block of the highest round.
    """
    for k, blocks in reversed(list(enumerate(rounds))):
        more = [c for c in above.columns if c not in ("tree", "block", "path")]
        own = F.expr(f"transform(sequence(0, size(items) - 1), i -> struct(items[i] AS item, concat({_PATH}, path) AS path))")
        rows = _with_levels(blocks.join(small(above, PATH_BYTES), ["tree", "block"])).select("tree", *more, F.inline(own))
        if k:
            above = materialise(rows.select("tree", *more, F.col("item.pos").alias("block"), "path"), "merkle-paths")
    return rows.select("tree", *more, "item.*", "path")


def proofs(leaves: DataFrame, *order: str) -> DataFrame:
    """The rows of ``leaves`` (tree, digest, and the columns of ``order`` and more) with subroot, root and path.

    ``tree`` is a text that is never null; trees are ordered by its UTF-8 bytes, leaves by ``order``, then
    by digest, nulls first. ``path`` has the siblings of a row from the lowest level to the root, as texts
    (left, right) of hex digests. Rows that are alike in all of it are told apart by a number that is written with them, so a
    hot group of copies is spread too.
    """
    rows = materialise(leaves.withColumn("copy", F.monotonically_increasing_id()), "merkle-leaves")
    rounds, subroots = _climb(numbered(rows, *order, "digest", "copy"))
    subroots = materialise(subroots, "merkle-subroots")
    tops, root = _climb(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")), "name"))
    start = root.select("tree", F.lit(0).cast("long").alias("block"), F.col("top").alias("root"), F.expr("cast(array() AS array<struct<left:string,right:string>>)").alias("path"))
    over = _descend(tops, materialise(start, "merkle-paths")).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", "path")
    return _descend(rounds, materialise(over, "merkle-paths")).drop("pos", "copy")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``.

    Leaves cover doc_id, source, lang, n_chars and text; trees go by lang. The fold starts from the row
    as it would be if someone had lower-cased its letters A to Z, where 3 divides the CRC-32 of its id.

    Nulls count as values of their own in any column: a null lang is a tree of its own and the first, null ids come
    first and are never tampered with. Repeated rows are leaves of their own; alike in every field, they
    stand side by side. An empty table gives no rows. Other columns are not read.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        row_digest(*fields, F.col("text")).alias("digest"), F.when(hit, row_digest(*fields, low)).alias("changed"),
    )
    rows = proofs(leaves, "doc_id")
    siblings = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings.alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
