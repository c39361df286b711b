"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep the order of their input partition. Each task collects consecutive documents up to
``CHUNK_TOKENS`` tokens and chooses the chunk's window cuts so that padding plus cut penalties are
least: cuts at document ends are free, cuts after a sentence cost ``SENTENCE_CUT`` and other cuts
``WORD_CUT`` tokens' worth of padding. With f(j) the least cost up to cut point j, a window from i
to j costs size - (c_j - c_i), so f(j) = size - c_j + penalty(j) + min(f(i) + c_i) over the points
within ``size`` tokens: a sliding-window minimum, kept by a monotone queue in linear time. A window
whose length is a power of two needs no padding, which lets the end of a chunk go without.

Nothing is shuffled, a chunk is all that a task holds, and a task that runs again gives the same
pieces. ``sequence_id`` is the partition number times 2**32 plus the task's window number.

Defined results: null and empty texts are documents of one token (the separator); repeated rows are
packed as often as they occur; null ids stay null; an empty table gives no pieces; other columns
are ignored. A document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack as to_bytes
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

WINDOW = 4096
CHUNK_TOKENS = 1_000_000
SENTENCE_CUT, WORD_CUT = 8.0, 48.0
SEPARATOR = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a Python worker remembers; the memory is emptied when full.
REMEMBERED = 1_200_000
#: Characters that Python's split takes for blanks and the tokenizer does not.
CONTROLS = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[^\\S\x1c-\x1f]+")
#: Marks that may follow the letters of a word; a run of them is one pre-token.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


class WordTokenizer:
    """A public tokenizer whose pre-tokens never cross blanks, word by word, with the ids of words remembered.

    Words of Latin letters are single pre-tokens, and so are the marks after them: new ones go to the
    tokenizer's model without its normalizer and pre-tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.inner = Tokenizer.from_file(path)
        vocab = self.inner.get_vocab()
        self.sentence_ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.sentence_ends[i] = bool(re.fullmatch(r"[\"')\]]*[.!?]+[\"')\]]*(</w>)?", token))
        self.memory: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, word: str) -> bytes:
        return np.array(self.inner.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        memory = self.memory
        by_core: dict[str, list[str]] = {}
        for w in words:
            core = w.rstrip(MARKS)
            # Latin letters only, of which none becomes two characters in lower case: one pre-token.
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                low = core.lower() if core.isascii() else core
                known = memory.get(low)
                if known is None:
                    by_core.setdefault(low, []).append(w)
                else:
                    memory[w] = known if len(w) == len(core) else known + self._tail(w[len(core) :])
            else:
                memory[w] = self._encode(w)
        tokenize, as_bytes = self.inner.model.tokenize, self.byte_level.pre_tokenize_str
        for core, own in by_core.items():
            # One pre-token in normal form needs no more than the model itself.
            word = core if core.isascii() else as_bytes(normalize("NFC", core).lower())[0][0]
            memory[core] = ids = to_bytes(f"<{len(found := tokenize(word))}I", *[t.id for t in found])
            for w in own:
                marks = w[len(core) :]
                memory[w] = ids + self._tail(marks) if marks else ids

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self._encode(marks)
        return self.tails[marks]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [[w for w in BLANK.split(t) if w] if CONTROLS.search(t) else t.split() for t in texts]
        seen = set().union(*split)
        new = seen.difference(self.memory)  # looks the batch's words up; minus keys() would walk the whole memory
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory, new = {}, seen
        self._learn(new)
        known = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), "<u4") for words in split]


@lru_cache(maxsize=1)
def tokenizer_of(call: str, path: str) -> WordTokenizer:
    """One tokenizer per Python worker and call of ``pack``: tasks that follow each other there share the words remembered."""
    return WordTokenizer(path)


def choose_cuts(points: np.ndarray, penalty: np.ndarray, size: int = WINDOW) -> list[int]:
    """Indices into ``points`` (rising, from 0, at most ``size`` apart) where windows end, of least cost.

    The cost of a window is its padding, none at a power of two, plus the penalty of its end.
    """
    at, extra = points.tolist(), penalty.tolist()
    place = {c: i for i, c in enumerate(at)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    cost, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # f(i) + c_i rises from left to right
    tail = at[-1] - size
    for j in range(1, len(at)):
        c = at[j]
        while at[queue[0]] < c - size:
            queue.popleft()
        i = queue[0]
        best, source = cost[i] + at[i] + size - c, i
        if c > tail:  # elsewhere full windows are at least as good
            for p in powers:
                i = place.get(c - p, -1)
                if i >= 0 and cost[i] < best:
                    best, source = cost[i], i
        cost[j], back[j] = best + extra[j], source
        value = cost[j] + c
        while queue and cost[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_points(lengths: list[int], sentence_ends: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All allowed cuts of a chunk and their penalties: document ends, sentence ends, points where neither
    comes within half a window, and every place in the last window."""
    total = len(sentence_ends)
    fee = np.full(total + 1, -1.0)
    grid = np.arange(0, total + 1, size // 2)
    fee[grid] = WORD_CUT
    fee[max(0, total - size) :] = WORD_CUT
    fee[np.flatnonzero(sentence_ends) + 1] = SENTENCE_CUT
    fee[np.cumsum(lengths)] = 0.0
    fee[0] = 0.0
    points = np.flatnonzero(fee >= 0)
    return points, fee[points]


def pack_chunk(docs: list[tuple[object, np.ndarray]], sentence_ends: np.ndarray, first_sequence: int, size: int = WINDOW) -> tuple[list[tuple], int]:
    """Pieces of the chunk's documents, and how many windows they fill."""
    lengths = [len(x) for _, x in docs]
    ids = np.concatenate([x for _, x in docs])
    points, fee = cut_points(lengths, sentence_ends[np.minimum(ids, len(sentence_ends) - 1)], size)
    ends = points[choose_cuts(points, fee, size)].tolist()
    pieces, w, begin, base = [], 0, 0, 0
    for (doc, own), n in zip(docs, lengths, strict=True):
        done = 0
        while done < n:
            length = min(n - done, ends[w] - (base + done))
            pieces.append((doc, done, length, zlib.crc32(own[done : done + length].astype("<u4").tobytes()), n, first_sequence + w, base + done - begin))
            done += length
            if base + done == ends[w]:
                begin, w = ends[w], w + 1
        base += n
    return pieces, len(ends)


def pack(docs: DataFrame, tokenizer: str, size: int = WINDOW, chunk_tokens: int = CHUNK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, in ``SCHEMA``. ``tokenizer``: path of a tokenizer file that every executor has."""
    call = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sequence = tokenizer_of(call, tokenizer), TaskContext.get().partitionId() << 32
        separator = np.array([SEPARATOR], "<u4")
        chunk: list[tuple[object, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held, sequence
            pieces, windows = pack_chunk(chunk, words.sentence_ends, sequence, size)
            chunk, held, sequence = [], 0, sequence + windows
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names)

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), words.ids_of(texts), strict=True):
                    chunk.append((doc, np.concatenate([ids, separator])))
                    held += len(ids) + 1
                    if held >= chunk_tokens:
                        yield flush()
        if chunk:
            yield flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
