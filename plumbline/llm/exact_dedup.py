"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition sorts its digests into a run, one entry for each distinct text. Runs are then merged
in rounds: in each, groups of 16 partitions whose numbers differ in one hex digit exchange slices of their runs, so that a partition
gets from each of its peers the slice whose digests have its digit there, and merges these slices. After as many rounds as the
number of partitions has digits every partition holds its share of all digests, in order. Copies collapse on every level, so a
group that holds a third of the corpus is one entry per run from the start and never meets in one task.

A run travels as blocks of up to 4,096 entries, in numpy arrays; merging keeps no more than a block of each run in memory. Two
entries are the same text only if digest, length in bytes and a second hash of another kind agree: that is verified in every merge, never left to the digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, small

#: Bits of a digest that one round settles, entries of a block, and blocks that wait for a merge.
BITS, BLOCK, WAITING = 4, 4096, 32

#: An entry: the digest's four words, length and second hash of the text, then what stays (whether its id is set, id, row) and the group's size.
ENTRY = np.dtype([(f"d{k}", "u8") for k in range(4)] + [("bytes", "i8"), ("check", "i8"), ("has_id", "i8"), ("id", "i8"), ("row", "i8"), ("n", "i8")])
_TEXT = ("d0", "d1", "d2", "d3", "bytes", "check")
_BLOCKS = "owner long, low binary, entries binary"


def merged(entries: np.ndarray) -> np.ndarray:
    """Sorted entries, one per text: the largest id stays (a null one last), of rows with one id the first; sizes add up."""
    e = entries[np.lexsort([-entries["row"], entries["id"], entries["has_id"], *(entries[c] for c in reversed(_TEXT))])]
    if len(e) < 2:
        return e
    other = np.zeros(len(e) - 1, bool)
    for c in _TEXT:
        other |= e[c][1:] != e[c][:-1]
    out = e[np.append(other, True)].copy()
    out["n"] = np.add.reduceat(e["n"], np.append(0, np.flatnonzero(other) + 1))
    return out


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    e = np.zeros(batch.num_rows, ENTRY)
    digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
    for k in range(4):
        e[f"d{k}"] = digests[:, k]
    for c in ("bytes", "check", "row"):
        e[c] = batch.column(c).to_numpy(zero_copy_only=False)
    e["has_id"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    e["id"] = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
    e["n"] = 1
    return e


class _Blocks:
    """Gathers sorted entries by their next owner and gives them out as blocks, in batches."""

    def __init__(self):
        self.open: dict[int, list[np.ndarray]] = {}
        self.ready: list[tuple[int, bytes, bytes]] = []

    def add(self, owners: np.ndarray, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        for owner in map(int, np.unique(owners)):
            parts = self.open.setdefault(owner, [])
            parts.append(entries[owners == owner])
            if sum(map(len, parts)) >= BLOCK:
                yield from self._close(owner)

    def _close(self, owner: int) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate(self.open.pop(owner))
        for k in range(0, len(entries), BLOCK):
            block = entries[k : k + BLOCK]
            self.ready.append((owner, _digests(block[:1]).tobytes(), block.tobytes()))
        if len(self.ready) >= WAITING:
            yield self._batch()

    def _batch(self) -> pa.RecordBatch:
        owners, lows, blocks = zip(*self.ready, strict=True)
        self.ready = []
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(lows, pa.binary()), pa.array(blocks, pa.binary())], ["owner", "low", "entries"])

    def close(self) -> Iterator[pa.RecordBatch]:
        """The run ends; another one may follow."""
        for owner in list(self.open):
            yield from self._close(owner)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.close()
        if self.ready:
            yield self._batch()


def _digests(entries: np.ndarray) -> np.ndarray:
    """The digests' bytes, 32 a row."""
    return np.stack([entries[f"d{k}"] for k in range(4)], 1).astype(">u8")


def _next_owner(owner: int, entries: np.ndarray, width: int, done: int) -> np.ndarray:
    """Owners after the digits up to bit ``done`` of ``width`` have been settled by the digests' own, from the highest down."""
    if not width:
        return np.zeros(len(entries), np.int64)
    mask = ((1 << done) - 1) << (width - done)
    top = (entries["d0"] >> np.uint64(64 - width)).astype(np.int64)
    return (top & mask) | (owner & ((1 << width) - 1 & ~mask))


def _first_runs(width: int) -> Callable:
    """Rows of a partition, sorted by part and digest, to the blocks of one run per part, addressed to the first round's owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kept, owner = _Blocks(), np.zeros(0, ENTRY), 0

        def give(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from out.add(_next_owner(owner, entries, width, min(BITS, width)), entries)

        for batch in batches:
            entries, parts = _rows(batch), batch.column("part").to_numpy(zero_copy_only=False)
            for part in map(int, np.unique(parts)):
                if part != owner:
                    yield from give(kept)
                    yield from out.close()
                    kept, owner = kept[:0], part
                kept = merged(np.concatenate([kept, entries[parts == part]]))
                yield from give(kept[:-1])  # more rows of the last digest may follow
                kept = kept[-1:]
        yield from give(kept)
        yield from out.rest()

    return run


def _merge_round(width: int, done: int) -> Callable:
    """Blocks of several runs per owner, sorted by owner and first digest, to the blocks of one run each, addressed to the next owners.

    Blocks wait until there are a few; then all that sorts before the last one's first digest is complete.
    At most one block of each run stays over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pending, owner = _Blocks(), [], None

        def give(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from out.add(_next_owner(owner, entries, width, done), entries)

        for batch in batches:
            for own, low, block in zip(*(batch.column(c).to_pylist() for c in ("owner", "low", "entries")), strict=True):
                if own != owner:
                    if pending:
                        yield from give(merged(np.concatenate(pending)))
                    yield from out.close()
                    pending, owner, waiting = [], own, 0
                pending.append(np.frombuffer(block, ENTRY))
                waiting += 1
                if waiting >= WAITING:
                    entries = merged(np.concatenate(pending))
                    end = np.searchsorted(entries["d0"], np.frombuffer(low, ">u8")[0].astype("u8"), "left")
                    yield from give(entries[:end])
                    pending, waiting = [entries[end:]], 0
        if pending:
            yield from give(merged(np.concatenate(pending)))
        yield from out.rest()

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for owner, block in zip(batch.column("owner").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            e = np.frombuffer(block, ENTRY)
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(_digests(e).tobytes())]).cast(pa.binary())
            ids = pa.array(e["id"], pa.int64(), mask=e["has_id"] == 0)
            numbers = [pa.array(np.ascontiguousarray(e[c])) for c in ("bytes", "check", "row", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), owner)), digests, *numbers[:2], ids, *numbers[2:]], ["owner", "digest", "bytes", "check", "keep_id", "keep_row", "n"])


_ENTRIES = "owner long, digest binary, bytes long, check long, keep_id long, keep_row long, n long"


def runs(table: DataFrame) -> DataFrame:
    """Entries of all texts after the tree merge of ``table``, the rows' digests by part.

    ``owner`` is the partition that holds the entry in the end: the first bits of its digest.
    """
    width = int(table.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]).bit_length()
    rows = table.select("part", "digest", "bytes", "check", "doc_id", "row").sortWithinPartitions("part", "digest")
    blocks = rows.mapInArrow(_first_runs(width), _BLOCKS)
    for done in range(BITS, max(width, 1) + BITS, BITS):  # one round at least, as a part may be read by several tasks
        met = blocks.repartition("owner").sortWithinPartitions("owner", "low")
        blocks = materialise(met.mapInArrow(_merge_round(width, min(done + BITS, width)), _BLOCKS), "digest-runs")
    return blocks.mapInArrow(_entries, _ENTRIES)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``.

    Texts are equal when identical; null counts as empty, and empty texts are equal. Of equal texts the row with the
    largest id stays. Null ids are smaller than any other; of rows that repeat text and id exactly one is kept.
    An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    table = materialise(
        id_and_text(docs, id_col, text_col).select(
            "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("check"),
            F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    repeated = materialise(runs(table).where("n > 1").drop("owner"), "repeated-digests")
    same = ["digest", "bytes", "check"]
    # What a part has to know: one row for each of its repeated texts, however many copies there are.
    asked = table.select("part", *same).distinct().join(small(repeated, 100), same)
    answers = materialise(asked, "repeated-by-part")
    out = table.join(small(answers, 100), ["part", *same], "left")
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
