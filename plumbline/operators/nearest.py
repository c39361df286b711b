"""Boxes near others in the same image, by grid cells instead of all pairs of an image, and all pairs by blocks.

Boxes are (image, idx, x0, y0, x1, y1) in whole numbers. Equal boxes are one class, so copies are never compared. A
class is dealt to the cells that it covers, an anchor to those that it covers when widened by the reach; both meet where
they share a cell. Where every pair is asked for, an image falls into pieces, and each two pieces meet in a block.
Tasks grow in number with classes, anchors and pairs, never in size: few bytes may have many neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written

CELL = 64
#: The first reach of a nearest search; anchors without any box within one go on with the next, four times as far.
REACH = 40
BOX = ("x0", "y0", "x1", "y1")
#: Boxes or classes of a task, and members of a class that stay together.
PIECE, MEMBERS = 1000, 1000
#: Blocks of two pieces in a task.
BLOCKS = 64
#: Parts by hash in which a class looks for its least members.
SALTS = 4096


def near_pairs(anchors: DataFrame, boxes: DataFrame, reach: int, tasks: int) -> DataFrame:
    """image, a (anchor) and b (box) as structs, for all pairs whose boxes are within ``reach`` on both axes; no pair twice, rows with themselves too."""
    side = max(CELL, reach)
    cells = lambda lo, hi: F.sequence(F.floor(lo / side), F.floor(hi / side))

    def dealt(df: DataFrame, name: str, wider: int) -> DataFrame:
        first = [F.floor((F.col(c) - wider) / side).alias(f"{name}_{c}") for c in ("x0", "y0")]
        rows = df.select("image", F.struct("*").alias(name), *first, F.explode(cells(F.col("x0") - wider, F.col("x1") + wider)).alias("cx"), "y0", "y1")
        rows = rows.select("image", name, f"{name}_x0", f"{name}_y0", "cx", F.explode(cells(F.col("y0") - wider, F.col("y1") + wider)).alias("cy"))
        return rows.repartition(tasks, "image", "cx", "cy")

    met = dealt(anchors, "a", reach).hint("merge").join(dealt(boxes, "b", 0), ["image", "cx", "cy"])
    # Of the cells that a pair shares, the first one reports it.
    once = (F.col("cx") == F.greatest("a_x0", "b_x0")) & (F.col("cy") == F.greatest("a_y0", "b_y0"))
    return met.where(once).select("image", "a", "b")


def gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Distance of two intervals, 0 where they meet."""
    return F.greatest(low_b - high_a, low_a - high_b, F.lit(0))


def squared(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    x, y = (gap(F.col(f"{a}.{c}0"), F.col(f"{a}.{c}1"), F.col(f"{b}.{c}0"), F.col(f"{b}.{c}1")) for c in "xy")
    return (x * x + y * y).cast("long")


def squared_from_centre(a: str, b: str) -> Column:
    """Four times the squared distance from the centre of a to the box b."""
    x, y = (gap(*[F.col(f"{a}.{c}0") + F.col(f"{a}.{c}1")] * 2, 2 * F.col(f"{b}.{c}0"), 2 * F.col(f"{b}.{c}1")) for c in "xy")
    return (x * x + y * y).cast("long")


def _tasks(*rows: int) -> int:
    return max(1, -(-sum(rows) // PIECE))


def all_pairs(classes: DataFrame) -> DataFrame:
    """image, a and b as structs, for all ordered pairs of classes of an image, rows with themselves too.

    A piece has about PIECE members by hash, whichever its image; the rows of a block are all that a task sorts and holds at a time.
    """
    sizes = classes.groupBy("image").agg(F.sum(F.size("members")).alias("n"))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    large = written(sizes.where(F.col("n") > PIECE).select(F.col("image").alias("of"), F.ceil(F.col("n") / PIECE).alias("pieces")), "box-images")  # a row per PIECE boxes at most
    tasks = max(_tasks(classes.count()), int(pairs // (BLOCKS * PIECE * PIECE)) + 1)
    rows = classes.join(F.broadcast(large), F.col("image") == F.col("of"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))

    def dealt(name: str, own: str, other: str) -> DataFrame:
        piece = F.pmod(F.xxhash64("image", *BOX, "part"), F.col("pieces"))
        return rows.select("image", F.struct(*classes.columns).alias(name), piece.alias(own), every.alias(other)).repartition(tasks, "image", "of_a", "of_b")

    return dealt("a", "of_a", "of_b").hint("merge").join(dealt("b", "of_b", "of_a"), ["image", "of_a", "of_b"]).select("image", "a", "b")


def within(boxes: DataFrame, reach: int | None = None) -> DataFrame:
    """image, a, b and d2: all ordered pairs of boxes of an image with another idx and their squared distance; with ``reach`` only those that are no farther apart.

    Classes of equal boxes meet; their pairs spread into those of their members last, as nothing but rows of numbers.
    """
    key = ["image", *BOX]
    many = boxes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS)  # a row per MEMBERS boxes at most
    many = written(many.select(*(F.col(c).alias(f"m_{c}") for c in key), F.ceil(F.col("n") / MEMBERS).alias("parts")), "box-piles")
    rows = boxes.join(F.broadcast(many), [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in key], "left")
    rows = rows.select(*key, "idx", F.coalesce(F.pmod(F.xxhash64("idx"), F.col("parts")), F.lit(0)).alias("part"))
    classes = written(rows.groupBy(*key, "part").agg(F.collect_list("idx").alias("members")), "box-classes")
    pairs = all_pairs(classes) if reach is None else near_pairs(classes, classes, reach, _tasks(classes.count()))
    pairs = pairs.select("image", F.col("a.members").alias("of_a"), F.col("b.members").alias("of_b"), squared("a", "b").alias("d2"))
    if reach is not None:
        pairs = pairs.where(F.col("d2") <= reach * reach)
    spread = pairs.select("image", F.explode("of_a").alias("a"), "of_b", "d2").select("image", "a", F.explode("of_b").alias("b"), "d2")
    return spread.where("a <> b")


def _classes(rows: DataFrame) -> DataFrame:
    """image, box, n (boxes) and least: the two least members (idx and alias) of every class of equal boxes."""
    key = ["image", *BOX]
    least = lambda members: F.slice(F.array_sort(members), 1, 2)
    parts = rows.groupBy(*key, F.pmod(F.xxhash64("idx"), F.lit(SALTS)).alias("part")).agg(F.sum("n").alias("n"), least(F.collect_list(F.struct("idx", "alias"))).alias("least"))
    return parts.groupBy(*key).agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("least"))).alias("least"))


def nearest(anchors: DataFrame, boxes: DataFrame, distance: Callable[[str, str], Column], scale: int = 1) -> DataFrame:
    """image, anchor, d, ties, idx and alias: for each anchor the least distance to another box of its image, how many have it, and the least of those.

    ``distance`` gives ``scale`` times a squared distance. A box within a reach is nearer than all
    beyond it, so an anchor is done with the first reach that holds one. What a reach finds is written,
    so that the next one doesn't search again; the search ends when no anchor is left, however far its box is. Anchors
    whose image has no other box have no row.
    """
    rows = written(boxes.groupBy("image", *BOX, "idx").agg(F.count(F.lit(1)).alias("n"), F.min("alias").alias("alias")), "boxes")
    classes = written(_classes(rows), "box-classes")
    # An anchor is no neighbour of itself: its own rows don't count in the class where they are.
    own = rows.groupBy("image", "idx").agg(F.collect_list(F.struct(*BOX, "n")).alias("own"))
    several = boxes.groupBy("image").agg(F.min("idx").alias("least"), F.max("idx").alias("most"))
    inside = anchors.join(several, "image").where("least <> most OR least <> idx").select("image", "idx", *BOX)
    left, out, reach = written(inside.join(own, ["image", "idx"], "left"), "anchors"), None, REACH
    own_here = F.aggregate(
        F.filter("a.own", lambda o: F.struct(*(o[c] for c in BOX)) == F.struct(*(F.col(f"b.{c}") for c in BOX))), F.lit(0).cast("long"), lambda s, o: s + o["n"]
    )
    other = F.get(F.filter("b.least", lambda m: m["idx"] != F.col("a.idx")), F.lit(0))
    while True:
        met = near_pairs(left, classes, reach, _tasks(classes.count(), left.count()))
        pairs = met.select("image", F.col("a.idx").alias("anchor"), distance("a", "b").alias("d"), (F.col("b.n") - F.coalesce(own_here, F.lit(0))).alias("n"), other.alias("first"))
        found = pairs.where((F.col("d") <= scale * reach * reach) & (F.col("n") > 0)).groupBy("image", "anchor", "d").agg(F.sum("n").alias("ties"), F.min("first").alias("first"))
        best = found.groupBy("image", "anchor").agg(F.min(F.struct("d", "ties", "first")).alias("m")).select("image", "anchor", "m.d", "m.ties", "m.first.idx", "m.first.alias")
        best = written(best, "nearest")
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select("image", F.col("anchor").alias("idx")), ["image", "idx"], "left_anti")
        if not left.limit(1).count():
            return out
        reach *= 4
