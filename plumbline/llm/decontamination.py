"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-cased words. An item of n words matches a document if some span of the
document's words is within ``n * (100 - percent) // 100`` word edits of it, whatever the span's length.

An item is cut into equal pieces of at most ``PIECE`` words; one piece at least has no more than its
share of the edits, so recall does not fall with the item's length. The CGK walk reads a sequence with
a pointer that a random bit per (step, word) either moves on or leaves; what it reads at ``2 * m - 1``
steps is the embedding of a window of m words, and sequences at edit distance e get embeddings at a
Hamming distance of about e**2 at most. One repetition samples ``SAMPLED`` steps of one walk and looks
the words read there up in a table of the pieces; ``REPEATS`` independent repetitions bring at least
``RECALL`` of the items at exactly the greatest distance allowed, by tests at 15 to 500 words. What collides is
compared exactly: the whole item against the words around, free at both ends, by Myers' bit vectors.

Windows have a piece's length and start at every word. Before walking, a window must hold as many
words and neighbouring pairs of the benchmark as a match that starts there leaves in place; that
loses no match.

Documents are never shuffled and meet the stated set of items in blocks of bounded size: one read
of the documents while the benchmark is below ``BLOCK_CHARS``, one more for each further block, whose
rows are written before the next block is sent.

Defined results: null texts have no words and match nothing, as do items without words; repeated
documents and items each give their own rows; empty tables give no rows; other columns are ignored
by ``matches`` and passed through by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, materialise, small

PERCENT, PIECE, SAMPLED, REPEATS, SEED = 80, 40, 3, 40, 77
RECALL = 0.97
#: Characters of items that are sent to the executors together, at most (an item alone may have more).
BLOCK_CHARS = 8 << 20
#: Words of documents that a task looks through together, held as 32-bit numbers.
AT_ONCE = 4_000_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance long"
WORD = re.compile(r"\w+")
U = np.uint64
#: A walk reads this where the sequence has ended.
PAST = 0
#: Latin-1 bytes: blanks for all that no word holds.
_LATIN = bytes(i if WORD.match(chr(i)) else 32 for i in range(256))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def nearest(item: list[int], words: list[int], most: int) -> tuple[int, int, int] | None:
    """(start, length, distance) of the span of ``words`` nearest to the item if it is at most ``most`` edits away.

    Of equals the one that ends first, and of those the shortest. Rows of the edit matrix are bit
    vectors of their differences (Myers); a second run back from the end finds the start.
    """
    n = len(item)
    mask, high = (1 << n) - 1, 1 << (n - 1)

    def run(pattern: list[int], text: Iterable[int], anchored: int) -> Iterator[int]:
        at: dict[int, int] = {}
        for i, x in enumerate(pattern):
            at[x] = at.get(x, 0) | 1 << i
        up, down, score = mask, 0, n
        for x in text:
            same = at.get(x, 0) | down
            flat = ((up + (same & up)) ^ up) | same
            left_down, left_up = up & flat, down | (mask & ~(up | flat))
            score += bool(left_up & high) - bool(left_down & high)
            left_up = left_up << 1 | anchored
            down = left_up & flat & mask
            up = (left_down << 1 | ~(left_up | flat)) & mask
            yield score

    best, end = n, 0
    for j, d in enumerate(run(item, words, 0), 1):
        if d < best:
            best, end = d, j
    if best > most:
        return None
    if best == n:
        return (0, 0, n)
    back = run(item[::-1], reversed(words[:end]), 1)
    length = next(j for j, d in enumerate(back, 1) if d == best)
    return end - length, length, best


class Index:
    """LSH tables of a block of items, by the length of their pieces and the edits that a piece may have."""

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT, repeats: int = REPEATS, sampled: int = SAMPLED):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.other = len(vocabulary) + 1
        self.by_word = vocabulary
        self.by_bytes = {raw: k for w, k in vocabulary.items() if (raw := _latin(w)) is not None}
        rng = np.random.default_rng(SEED)
        self.code = np.concatenate([[PAST], rng.integers(1, 2**62, self.other)]).astype(U)
        self.hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in ["", *vocabulary, "\0"]], U)
        self.sampled, self.repeats = sampled, repeats
        self.coded = [np.array([vocabulary[w] for w in words], np.int64) for _, words in self.items]
        self.allowed = [len(w) * (100 - percent) // 100 for _, w in self.items]
        self.pairs = np.unique(np.concatenate([self._pairs(c) for c in self.coded])) if self.coded else np.empty(0, np.int64)
        #: (words, edits) -> pieces as (item, first word).
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, c in enumerate(self.coded):
            count = -(-len(c) // PIECE)
            cuts = [len(c) * i // count for i in range(count + 1)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                groups.setdefault((b - a, self.allowed[k] // count), []).append((k, a))
        #: By group: which pairs its pieces have, the sorted table keys of all repetitions, and the piece of each.
        self.groups: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for (m, e), pieces in sorted(groups.items()):
            rows = np.array([self.coded[k][a : a + m] for k, a in pieces])
            own = np.isin(self.pairs, np.concatenate([self._pairs(r) for r in rows]))
            keys = self.keys(rows, m)
            order = np.argsort(keys, axis=None, kind="stable")
            self.groups[m, e] = own, keys.reshape(-1)[order], order % len(pieces), np.array(pieces)

    def encode(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words: 1 up in the vocabulary, one more number for all other words."""
        if (raw := _latin((text or "").lower())) is not None:
            words, get = raw.translate(_LATIN).split(), self.by_bytes.get
        else:
            words, get = words_of(text), self.by_word.get
        return np.fromiter(map(get, words, repeat(self.other)), np.int32, len(words))

    def _pairs(self, codes: np.ndarray) -> np.ndarray:
        return codes[:-1] * (self.other + 1) + codes[1:]

    def keys(self, windows: np.ndarray, m: int) -> np.ndarray:
        """(repeats, windows) table keys of windows of m words, given as rows of word numbers; all walks go side by side."""
        rng, last = np.random.default_rng(SEED + m), max(1, 2 * m - 1)  # later steps mostly read the end
        count = min(self.sampled, last)
        chosen = np.zeros((self.repeats, last), bool)
        for r in range(self.repeats):
            chosen[r, rng.choice(last, count, replace=False)] = True
        move = rng.integers(0, 2**63, (last, self.repeats), dtype=np.int64).astype(U) * U(2) + U(1)
        padded = np.hstack([windows, np.zeros((len(windows), 1), windows.dtype)])
        lines = np.arange(len(windows))[None, :]
        at = np.zeros((self.repeats, len(windows)), np.int64)
        key = np.repeat(np.arange(1, self.repeats + 1, dtype=U)[:, None], len(windows), 1)
        for j in range(last):
            read = padded[lines, at]
            if len(take := np.flatnonzero(chosen[:, j])):
                x = (key[take] * U(0x9E3779B97F4A7C15)) ^ self.code[read[take]]
                key[take] = x ^ (x >> U(29))
            at = np.minimum(at + ((self.hashed[read] * move[j][:, None]) >> U(63)).astype(np.int64), m)
        return key

    def find(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, length, distance) for encoded texts: for each text and item the nearest span.

        The m words from the start of a span at e edits from a piece of m words hold m - e of its words
        and m - 1 - 2e of its neighbouring pairs, so windows with fewer are not walked. Where the
        text ends sooner, the window does.
        """
        if not self.items or not texts:
            return []
        codes = np.concatenate([x for part in texts for x in (part, np.zeros(1, np.int32))]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in texts])])
        known = (codes > 0) & (codes < self.other)
        both = np.flatnonzero(known[:-1] & known[1:])
        value = codes[both] * (self.other + 1) + codes[both + 1]
        number = np.searchsorted(self.pairs, value)
        if len(self.pairs):
            there = self.pairs[np.minimum(number, len(self.pairs) - 1)] == value
            both, number = both[there], number[there]
        words_to = np.concatenate([[0], np.cumsum(known)])
        places: dict[tuple[int, int], list[int]] = {}
        for (m, e), group in self.groups.items():
            need = m - 1 - 2 * e
            mine = both[group[0][number]]
            if need <= 0:
                at = np.flatnonzero(codes)
            elif len(mine) < need:
                continue
            else:
                # The last of ``need`` pairs lies at most m - 2 places after the first: only windows around such runs.
                near = np.flatnonzero(mine[need - 1 :] - mine[: len(mine) - need + 1] <= m - 2)
                reach = mine[near + need - 1][:, None] - np.arange(m - 1)[None, :]
                at = np.unique(reach[(reach <= mine[near][:, None]) & (reach >= 0)])
            at = at[codes[at] != 0]
            end = np.minimum(at + m, begin[np.searchsorted(begin, at, "right")] - 1)
            fine = words_to[end] - words_to[at] >= m - e
            if need > 0:
                fine &= np.searchsorted(mine, end - 1) - np.searchsorted(mine, at) >= need
            self._look(m, codes, at[fine], end[fine], group, begin, places)
        return self._verified(texts, places)

    def _look(self, m: int, codes: np.ndarray, at: np.ndarray, end: np.ndarray, group, begin: np.ndarray, places: dict) -> None:
        """Adds to ``places`` where items would start, by (text, item), as the tables say for these windows."""
        _, keys, owner, pieces = group
        for first in range(0, len(at), 2048):
            spot, stop = at[first : first + 2048], end[first : first + 2048]
            where = spot[:, None] + np.arange(m)
            windows = np.where(where < stop[:, None], codes[np.minimum(where, len(codes) - 1)], PAST)
            own = self.keys(windows, m).reshape(-1)
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            entry = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            for w, piece in np.unique(np.stack([np.repeat(hit % len(spot), times), owner[entry]], 1), axis=0).tolist():
                t = int(np.searchsorted(begin, spot[w], "right")) - 1
                item, offset = pieces[piece].tolist()
                places.setdefault((t, item), []).append(int(spot[w] - begin[t]) - offset)

    def _verified(self, texts: list[np.ndarray], places: dict) -> list[tuple[int, int, int, int, int]]:
        """Each item against the words around the places where it may start; stretches that meet are one."""
        out = []
        for (t, k), starts in sorted(places.items()):
            item, most = self.coded[k].tolist(), self.allowed[k]
            reach, best = len(item) + 2 * most, None
            stretches: list[list[int]] = []
            for s in sorted(set(starts)):
                low, high = max(0, s - most), min(len(texts[t]), s + reach)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            for low, high in stretches:
                found = nearest(item, texts[t][low:high].tolist(), most)
                if found and (best is None or found[2] < best[2]):
                    best = (low + found[0], *found[1:])
            if best:
                out.append((t, k, *best))
        return out


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item where a span of the document matches: the nearest span.

    The stated set of items meets all documents in blocks of ``block_chars``; the driver holds one block.
    """
    rows = id_and_text(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out: DataFrame | None = None
    block: list[tuple[int, str]] = []
    held = 0
    for item in items.toLocalIterator():
        size = len(item["text"] or "")
        if block and held + size > block_chars:
            found, sent = _against(rows, block, percent)
            found = materialise(found, "matches-of-block")
            sent.destroy()
            out, block, held = (found if out is None else out.unionByName(found)), [], 0
        block.append((item["item_id"], item["text"]))
        held += size
    last, _ = _against(rows, block, percent)
    return last if out is None else out.unionByName(last)


def _against(rows: DataFrame, block: list[tuple[int, str]], percent: int):
    sent = rows.sparkSession.sparkContext.broadcast(list(block))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, percent)
        names, docs, texts, held = [x.split()[0] for x in SCHEMA.split(", ")], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            found = [(docs[t], index.items[i][0], *rest) for t, i, *rest in index.find(texts)]
            docs.clear()
            texts.clear()
            held = 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(index.encode(text.as_py()))
                held += len(texts[-1])
                if held >= AT_ONCE:
                    yield from flush()
        if docs:
            yield from flush()

    return rows.mapInArrow(run, SCHEMA), sent


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the ids that match an item; rows with a null id that match stay."""
    gone = materialise(matches(docs, benchmark, percent, id_col, text_col).where("doc_id is not null").select("doc_id").distinct(), "contaminated")
    return docs.join(small(gone.select(F.col("doc_id").alias(key := fresh(docs, "gone"))), 16), F.col(id_col).cast("long") == F.col(key), "left_anti")
