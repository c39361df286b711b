"""Near-duplicate groups by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``m`` sub-keys, each of two minhashes, are computed per shingle set; a table key
is a pair of one sub-key from either, so ``4 * m`` minhashes serve ``m * m`` tables of four minhashes
each. ``m`` follows from the similarity and the tolerated share of missed links at exactly that
similarity.

1. Documents with equal sets collapse into classes, so exact copies cost nothing further.
2. In every table bucket each class is compared with one member, the bucket's least: if a quarter of
   their sub-keys agree (at the similarity itself three quarters are expected), they belong to one
   cluster. Where that member rejects some, a task carries on with the bucket: the rejected are compared with
   the accepted, then the least of the rejected with the others, until none is left. So each pair of
   a bucket is compared or joined by way of a third, without emitting the pairs of a bucket.
3. Inside a cluster all pairs are compared on full sets: clusters are dealt into blocks of bounded
   size, and each pair of blocks is one small group of rows, however large the cluster.
4. Confirmed links make components.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and is its own
component; with fewer words than a shingle the whole sequence is the one shingle; repeated rows
share a class and each row gets its result; an id that occurs with several texts has one result per
row; null ids never become a component's id unless the whole component has none; an empty table
gives an empty result; other columns are ignored by ``groups`` and passed through by ``keep_one``.

Shingles are 64-bit hashes: two shingles of one pair of documents are confused with probability
below 1e-11 at 20,000 words. Sets are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, materialise, small
from .graph import components

PER_KEY = 2
MISSED = 1e-4
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
REMEMBERED = 500_000
#: Classes of more copies than this, and than one row in HOT_CLASSES, meet their rows without a shuffle; there are fewer than HOT_CLASSES.
HOT_COPIES, HOT_CLASSES = 1000, 500_000
U = np.uint64


def subkeys(similarity: float, missed: float = MISSED) -> int:
    """Least m so that both collections have an agreeing sub-key with probability 1 - missed at the similarity."""
    return math.ceil(math.log(missed / 2) / math.log(1 - similarity**PER_KEY))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and shift)."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Shingler:
    """Sorted distinct shingle hashes of a text given as UTF-8 bytes; word hashes are remembered."""

    def __init__(self, width: int):
        self.width, self.memory = width, {}
        self.odd = _mix(np.arange(1, width + 1, dtype=U)) | U(1)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.memory.get, words))
        if None in found:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = self.memory[w] = self.memory.get(w) or xxhash.xxh3_64_digest(w)
        return np.frombuffer(b"".join(found), U)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").lower().split()  # bytes: A-Z only, and exactly the six blanks
        if not words:
            return np.empty(0, U)
        h = self._hashes(words)
        if len(words) < self.width:
            return _mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U))
        out = np.zeros(len(h) - self.width + 1, U)
        for k in range(self.width):
            out += h[k : k + len(out)] * self.odd[k]
        return np.unique(_mix(out))


def _features(width: int, m: int):
    rng = np.random.default_rng(8)
    mult = rng.integers(0, 2**63, 2 * PER_KEY * m, dtype=np.int64).astype(U) * U(2) + U(1)
    plus = rng.integers(0, 2**63, 2 * PER_KEY * m, dtype=np.int64).astype(U)

    def sketch(s: np.ndarray) -> np.ndarray:
        least = np.full(len(mult), np.iinfo(U).max, U)
        for a in range(0, len(s), 4096):
            np.minimum(least, (s[None, a : a + 4096] * mult[:, None] + plus[:, None]).min(1), out=least)
        pairs = least.reshape(-1, PER_KEY)
        return _mix(pairs[:, 0] * U(0x9E3779B97F4A7C15) + _mix(pairs[:, 1])).astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                s = shingle(raw.as_py())
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "keys"]
            )

    return run


def _carry_on(m: int):
    """Streams rows (bucket, ok, node, keys), sorted by bucket, into (a, b): links in buckets whose least member rejected some (not ok)."""

    def agree(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return (one == many).sum(1) * 4 >= 2 * m

    def links(nodes: list[bytes], keys: np.ndarray, ok: np.ndarray) -> list[tuple[bytes, bytes]]:
        accepted, rejected, out = np.flatnonzero(ok), np.flatnonzero(~ok), []
        while len(rejected):
            if len(accepted):  # these are one cluster already, so one link to any of them is enough
                for x in rejected:
                    if (like := agree(keys[x], keys[accepted])).any():
                        out.append((nodes[x], nodes[accepted[like.argmax()]]))
            hub, others = rejected[0], rejected[1:]
            like = agree(keys[hub], keys[others])
            accepted, rejected = others[like], others[~like]
            out += [(nodes[x], nodes[hub]) for x in accepted]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, keys, ok, out = None, [], [], [], []

        def close() -> None:
            nonlocal nodes, keys, ok
            out.extend(links(nodes, np.array(keys), np.array(ok)))
            nodes, keys, ok = [], [], []

        def ready() -> pa.RecordBatch:
            a, b = zip(*set(out), strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for i, (own, fine, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if own != bucket:
                    if nodes:
                        close()
                    bucket = own
                nodes.append(node)
                ok.append(fine)
                keys.append(batch.column(3)[i].values.to_numpy())
            if out:
                yield ready()
        if nodes:
            close()
        if out:
            yield ready()

    return run


def _clusters(classes: DataFrame, m: int) -> DataFrame:
    """(node, label): classes that share buckets and a quarter of their sub-keys, directly or by way of others."""
    tables = F.flatten(
        F.transform(
            F.slice("keys", 1, m),
            lambda a, i: F.transform(F.slice("keys", m + 1, m), lambda b, j: F.xxhash64(a, b, i, j)),
        )
    )
    rows = classes.select("node", F.explode(tables).alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub", "n")
    met = materialise(rows.join(least, "bucket").where("node <> hub").select("bucket", "node", "hub", "n"), "bucket-members")
    pairs = met.select("node", "hub").distinct()
    keys = classes.select("node", "keys")
    agreeing = F.size(F.filter(F.arrays_zip(F.col("keys").alias("x"), F.col("hub_keys").alias("y")), lambda z: z["x"] == z["y"]))
    tried = materialise(
        pairs.join(keys, "node")
        .join(keys.select(F.col("node").alias("hub"), F.col("keys").alias("hub_keys")), "hub")
        .select("node", "hub", (agreeing * 4 >= 2 * m).alias("ok")),
        "hubs-tried",
    )
    near = tried.where("ok").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    more = met.where("n > 2").join(tried.where("not ok").select("node", "hub"), ["node", "hub"], "left_semi").select("bucket").distinct()
    left = met.join(materialise(more, "open-buckets"), "bucket").join(tried, ["node", "hub"]).select("bucket", "ok", "node").join(keys, "node").select("bucket", "ok", "node", "keys")
    further = left.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_carry_on(m), "a binary, b binary")
    return components(materialise(near.unionByName(further).distinct(), "near"))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index of a set that it can reach by links of at least ``percent``."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner, (values, inverse, times) = np.repeat(np.arange(n), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    column = np.cumsum(times > 1) - 1
    row, col, width = owner[shared], column[inverse[shared]], int((times > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col, common = row[order], col[order], np.zeros((n, n), np.float32)
    for a in range(0, width, 8192):
        lo, hi = np.searchsorted(col, [a, a + 8192])
        dense = np.zeros((n, min(8192, width - a)), np.float32)
        dense[row[lo:hi], col[lo:hi] - a] = 1
        common += dense @ dense.T
    exact = common.astype(np.int64)  # counts are whole in float32; multiples of them might not be
    link = 100 * exact >= percent * (sizes[:, None] + sizes[None, :] - exact)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _confirm(percent: int):
    """Streams rows (cluster, lo, hi, node, shingles), sorted by group, into (single, a, b): spanning links of each group."""

    def links(group: dict[bytes, np.ndarray], single: bool) -> list[tuple[bool, bytes, bytes]]:
        nodes = sorted(group)
        label = linked([group[x] for x in nodes], percent) if len(nodes) > 1 else [0]
        return [(single, nodes[i], nodes[r]) for i, r in enumerate(label) if i != r]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, {}, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for i, own in enumerate(zip(*cols[:4], strict=True)):
                if own != key:
                    if group:
                        out += links(group, key[3] == 1)
                    key, group = own, {}
                group[cols[4][i]] = batch.column(5)[i].values.to_numpy().view(U)
            if out:
                yield _links(out)
                out = []
        if group and (out := links(group, key[3] == 1)):
            yield _links(out)

    return run


def _links(rows) -> pa.RecordBatch:
    single, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(single), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["single", "a", "b"])


def _shingles(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            keep, arrays = [], []
            for i, (raw, node) in enumerate(zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True)):
                s = shingle(raw.as_py())
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == node.as_py():  # an id may stand for several texts
                    keep.append(i)
                    arrays.append(s.view(np.int64))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(arrays, pa.list_(pa.int64()))], [*kept.schema.names[1:], "shingles"])

    return run


def _confirmed(rows: DataFrame, classes: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of the components that links on full sets make."""
    members = clusters.join(classes.select("node", "rep", "n_shingles"), "node")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = materialise(members.join(sizes.select("label", blocks.alias("blocks")), "label").select("node", "label", "blocks", "rep"), "cluster-members")
    texts = rows.join(small(members, 100), rows["doc_id"].eqNullSafe(members["rep"])).select("text", "node", "label", "blocks")
    arrays = texts.mapInArrow(_shingles(width), "node binary, label binary, blocks int, shingles array<long>")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = arrays.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "label", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "blocks", "node", "shingles"
    )
    # Blocks of one pair meet in one group; a block also meets itself there.
    grouped = paired.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    links = materialise(grouped.mapInArrow(_confirm(percent), "single boolean, a binary, b binary"), "links")
    alone = links.where("single").select(F.col("a").alias("node"), F.col("b").alias("label"))
    alone = alone.union(alone.select("label", "label")).distinct()
    wide = links.where("not single").select("a", "b")
    return alone.union(components(wide)) if wide.limit(1).count() else alone


def groups(docs: DataFrame, width: int = 3, percent: int = 85, missed: float = MISSED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Links: documents whose sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` per cent. ``kept`` marks the row whose id is its component's.
    """
    m = subkeys(percent / 100, missed)
    rows = id_and_text(docs, id_col, text_col)
    table = materialise(rows.mapInArrow(_features(width, m), "doc_id long, n_shingles long, node binary, keys array<long>"), "minhash")
    classes = materialise(table.where("node is not null").groupBy("node", "n_shingles", "keys").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "minhash-classes")
    clusters = materialise(_clusters(classes, m), "clusters")
    found = materialise(_confirmed(rows, classes, clusters, width, percent), "components")
    least = found.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = found.join(least, "label").select("node", "component_id")
    named = materialise(classes.select("node", "rep", "copies").join(ids, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), "copies"), "named-classes")
    out = _of_rows(table.select("doc_id", "n_shingles", "node"), named)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _of_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): rows get their class's component, those without shingles their own id.

    Rows of the largest classes find it in a broadcast table of fewer than HOT_CLASSES; the others by
    a shuffle, in which no key has more rows than a class may have without being large.
    """
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("copies") > max(HOT_COPIES, total // HOT_CLASSES)).select("node", "component_id"))
    blank, full = rows.where("node is null"), rows.where("node is not null")
    often = full.join(hot, "node")
    rest = full.join(hot.select("node"), "node", "left_anti").join(named.select("node", "component_id"), "node")
    own = blank.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(often.drop("node")).unionByName(rest.drop("node"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its group's least, with the columns they came with.

    Rows with a null id stay. The ids to drop are broadcast while they are few and shuffled otherwise.
    """
    gone = materialise(groups(docs, width, percent, id_col=id_col, text_col=text_col).where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    return docs.join(small(gone.select(F.col("doc_id").alias(key := fresh(docs, "gone"))), 16), F.col(id_col).cast("long") == F.col(key), "left_anti")
