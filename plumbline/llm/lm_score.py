"""Masked pseudo-likelihood: a window network predicts every token from both sides.

Words are hashed to classes and predicted as class, then word of the class. The network reads
``REACH`` class embeddings from either side of the masked token, mixes them in one hidden layer and
predicts the class digit by digit, each given those before it, so a prediction costs ``DIGITS``
softmaxes of ``side``. A digit's bias is the log of its share of the corpus's tokens with the same digits
before it, taken from counts, so descent learns what the context adds to the frequencies. A word's probability inside its class is its share of the class's
tokens in the corpus; so all words are told apart, and the whole is a proper distribution over
the corpus's vocabulary. The log-probabilities of all tokens of a document are summed; per token they
compare documents of different lengths.

Words are counted over all documents by Spark; there are as many classes as the vocabulary to the
power 2/3, ``SIDE ** DIGITS`` at least. The counts stay a table: the few words that make up
most tokens are broadcast, the others of each row are joined by shuffle.

Training is data-parallel: each task starts from the same weights, runs stochastic
gradient descent over all its documents, every position being a target, and returns its weights,
which Spark averages block by block, weighted by targets. The driver holds one set of weights.

Defined results: null, empty and blank texts have no tokens and a score of 0, per token too; repeated rows
are scored row by row; an empty table gives an empty result (and untrained weights); other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, one_thread, small

SIDE, DIGITS, REACH, WIDTH, HIDDEN = 16, 3, 2, 24, 64
STRIDE, ROUNDS, BATCH, RATE, SEED = 1, 1, 512, 2.0, 11
EDGE = SIDE**DIGITS  # stands before the first and after the last token; the number of classes for other sides
#: Words with at least this fraction of all tokens are broadcast: 200,000 at most, of 16 bytes each.
FREQUENT = 1 / 200_000
#: Tokens that a task holds before it counts their words.
COUNTED = 1 << 22
CHUNK, TILE = 512, 64
#: The weights that come from counts of the corpus and aren't descended.
FIXED = "share"
Weights = dict[str, np.ndarray]


def side_of(vocabulary: int) -> int:
    """Digits of a class number, for so many words."""
    return max(SIDE, math.ceil(vocabulary ** (2 / 3 / DIGITS)))


def fresh_weights(side: int = SIDE) -> Weights:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": (rng.normal(0, 0.3, (side**DIGITS + 1, WIDTH))).astype(np.float32),
        "mix": draw(2 * REACH * WIDTH, HIDDEN),
        "bias": np.zeros(HIDDEN, np.float32),
        "out": np.zeros((HIDDEN, DIGITS * side), np.float32),  # digit after digit, the highest first
        FIXED: biases(np.zeros(side**DIGITS)),
    }


def side_in(w: Weights) -> int:
    return w["out"].shape[1] // DIGITS


def biases(tokens_of: np.ndarray) -> np.ndarray:
    """(side ** (DIGITS - 1), DIGITS * side): by all digits of a class but the last, the log share of each digit given
    those before it, from the tokens of each class in the corpus and one more."""
    side = round(len(tokens_of) ** (1 / DIGITS))
    parts = []
    for k in range(DIGITS):
        n = (tokens_of + 1.0).reshape(side**k, side, -1).sum(2)
        parts.append(np.repeat(np.log(n / n.sum(1, keepdims=True)), side ** (DIGITS - 1 - k), axis=0))
    return np.concatenate(parts, 1).astype(np.float32)


def digits_of(classes: np.ndarray, side: int) -> list[np.ndarray]:
    """The digits of class numbers, the highest first."""
    heads = [classes // side**k for k in range(DIGITS, -1, -1)]
    return [own - side * before for before, own in zip(heads, heads[1:], strict=False)]


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 and so on, modulo 2^64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: Bytes as numbers, capital letters like small ones; an odd base, so that its powers can be divided by modulo 2^64.
BYTES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
BASE, SPAN = 0x9E3779B97F4A7C1B, 1 << 16
POWERS, INVERSES = _powers(BASE, SPAN), _powers(pow(BASE, -1, 1 << 64), SPAN)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit hashes of the words between these ascending places: polynomials in BASE, by one running sum."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + SPAN, "right")))
        length = int(ends[last - 1] - at)
        powers = POWERS if length <= SPAN else _powers(BASE, length)  # one very long word
        sums = np.zeros(length + 1, np.uint64)
        np.cumsum(BYTES.take(data[at : at + length]) * powers[:length], out=sums[1:])
        a, b = starts[first:last] - at, ends[first:last] - at
        out[first:last] = (sums[b] - sums[a]) * INVERSES[a]
        first = last
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return (out >> np.uint64(1)).astype(np.int64)


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of all these texts, one after the other, and how many each text has.

    A word's class is the remainder by the number of classes. Words end at blanks; null texts have none.
    """
    texts = texts.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = (data != ord(" ")) & (data - np.uint8(ord("\t")) > ord("\r") - ord("\t"))
    cut = np.zeros(len(data) + 1, bool)  # before this byte a text or a blank ends, or a blank begins
    cut[1:-1] = word[1:] != word[:-1]
    cut[offsets] = True
    places = np.flatnonzero(cut)
    inside = word[places[:-1]]
    starts, ends = places[:-1][inside], places[1:][inside]
    return _hashes(data, starts, ends), np.diff(np.searchsorted(starts, offsets))


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashed words of each text."""
    for part in parts_of(column):
        words, sizes = words_in(part)
        yield from np.split(words, np.cumsum(sizes)[:-1])


def parts_of(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in pieces of 64 rows."""
    return (column.slice(i, 64) for i in range(0, len(column), 64))


OFFSETS = np.array([k for k in range(-REACH, REACH + 1) if k])


def windows(tokens: np.ndarray, at: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The tokens on both sides of these positions; ``edge`` beyond the ends."""
    padded = np.concatenate([np.full(REACH, edge), tokens, np.full(REACH, edge)])
    out = np.empty((len(at), 2 * REACH), np.int64)
    for k, first in enumerate((REACH + OFFSETS).tolist()):
        out[:, k] = padded[first:].take(at)
    return out


def logits_of(w: Weights, context: np.ndarray, target: np.ndarray):
    """Inputs, hidden layer and the logits of all digits (n, DIGITS * side) for masked tokens of these classes."""
    x = w["embed"].take(context.reshape(-1), axis=0).reshape(len(context), -1)
    h = x @ w["mix"]
    h += w["bias"]
    return x, h, _logits(w, h, target)


def _logits(w: Weights, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logits from the hidden layer's inputs, which become its outputs."""
    np.maximum(h, _zeros(h.shape, h.dtype), out=h)
    logits = h @ w["out"]
    logits += w[FIXED].take(target // side_in(w), axis=0)
    return logits


@functools.cache
def _zeros(shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """Numpy compares with these faster than with one zero."""
    return np.zeros(shape, kind)


def places_of(target: np.ndarray, side: int) -> np.ndarray:
    """(n, DIGITS): where the logits of these classes' digits stand in the flat logits of n rows."""
    return _columns(side).take(target, axis=0) + np.arange(0, len(target) * DIGITS * side, DIGITS * side)[:, None]


@functools.cache
def _columns(side: int) -> np.ndarray:
    """(side ** DIGITS, DIGITS): where each class's digits stand in a row of logits."""
    return np.stack([k * side + own for k, own in enumerate(digits_of(np.arange(side**DIGITS), side))], 1)


def mixed(w: Weights) -> list[np.ndarray]:
    """What each class adds to the hidden layer, by its place in the window: 1 KB a class, for weights that change no more."""
    parts = [w["embed"] @ w["mix"][k * WIDTH : (k + 1) * WIDTH] for k in range(2 * REACH)]
    parts[0] += w["bias"]
    return parts


#: A digit's powers of e are as single precision holds them if their sum and its inverse are at most this.
MOST = math.exp(60)


def exponentials(logits: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The powers of e of the logits, less ``tops`` (n, DIGITS); then ``tops``, and each digit's sums (n, DIGITS).

    Rows with a sum beyond ``MOST`` have their digits' greatest logits taken off first, the others nothing; so what a row
    comes to doesn't depend on the rows beside it.
    """
    tops = np.zeros((len(logits), DIGITS), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        each = np.exp(logits)
        sums = each @ _members(side)
    if sums.size and not (sums.min() >= 1 / MOST and sums.max() <= MOST):
        far = ~((sums >= 1 / MOST) & (sums <= MOST)).all(1)
        digits = logits[far].reshape(-1, DIGITS, side)
        tops[far] = digits.max(2)
        each[far] = np.exp(digits - tops[far][:, :, None]).reshape(-1, DIGITS * side)
        sums = each @ _members(side)
    return each, tops, sums


@functools.cache
def _members(side: int) -> np.ndarray:
    """(DIGITS * side, DIGITS): which digit a logit belongs to."""
    return np.kron(np.eye(DIGITS), np.ones((side, 1))).astype(np.float32)


def log_probability(w: Weights, context: np.ndarray, target: np.ndarray, parts: list[np.ndarray] | None = None) -> np.ndarray:
    """Log-probabilities of masked tokens; ``parts`` are ``mixed(w)``, where they are known already."""
    side, parts = side_in(w), parts or mixed(w)
    h = parts[0].take(context[:, 0], axis=0)
    for k in range(1, 2 * REACH):
        h += parts[k].take(context[:, k], axis=0)
    logits = _logits(w, h, target)
    chosen = logits.reshape(-1).take(places_of(target, side)).sum(1)
    _, tops, sums = exponentials(logits, side)
    return chosen - (tops + np.log(sums)).sum(1)


def step(w: Weights, context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the mean negative log-probability, in place."""
    n, side = len(target), side_in(w)
    x, h, logits = logits_of(w, context, target)
    slope, _, sums = exponentials(logits, side)
    digits = slope.reshape(n, DIGITS, side)
    digits *= (rate / (n * sums))[:, :, None]  # every slope below has the rate in it
    slope.reshape(-1)[places_of(target, side).reshape(-1)] -= rate / n
    back = slope @ w["out"].T
    back *= h > 0
    dx = back @ w["mix"].T
    w["out"] -= (slope.T @ h).T
    w["mix"] -= x.T @ back
    w["bias"] -= np.ones(n, back.dtype) @ back
    # A class may be among the inputs many times: every one takes off its slope. Two numbers go as one complex number.
    pair = np.result_type(dx.dtype, np.complex64)
    cells = np.repeat(context.reshape(-1) * (WIDTH // 2), WIDTH // 2)
    cells += _tiled(context.size)
    np.negative(dx, out=dx)
    np.add.at(w["embed"].reshape(-1).view(pair), cells, dx.reshape(-1).view(pair))


@functools.cache
def _tiled(n: int) -> np.ndarray:
    """The places of an embedding's pairs of numbers, n times over."""
    return np.tile(np.arange(WIDTH // 2), n)


BLOCKS, BLOCK = "block long, seen long, part binary", 4096


def _blocks(numbers: Iterable[int], seen: Iterable[int], parts: Iterable[bytes]) -> pa.RecordBatch:
    columns = [pa.array(list(numbers), pa.int64()), pa.array(list(seen), pa.int64()), pa.array(list(parts), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "seen", "part"])


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each block of weights over the tasks, weighted by the targets they saw; all rows of a block are here.

    Only the sums are held: at most one set of weights.
    """
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for block, n, part in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            own = np.frombuffer(part, np.float32).astype(np.float64) * n
            sums[block] = sums[block] + own if block in sums else own
            seen[block] = seen.get(block, 0) + n
    if sums:
        yield _blocks(sums, seen.values(), [(v / seen[k]).astype(np.float32).tobytes() for k, v in sums.items()])


def train(rows: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, side: int = SIDE, counts: DataFrame | None = None) -> Weights:
    """Weights after local descent over all documents of (doc_id, text) and averaging, round by round.

    ``counts`` has these documents' words and their numbers (word, n), where they are known already.
    """
    by_class = (_counted(rows) if counts is None else counts).groupBy((F.col("word") % side**DIGITS).alias("class")).agg(F.sum("n").alias("n")).toArrow()
    tokens_of = np.zeros(side**DIGITS)
    tokens_of[by_class.column("class").to_numpy()] = by_class.column("n").to_numpy()
    weights, share = fresh_weights(side), rows.sparkSession.sparkContext.broadcast(biases(tokens_of))
    del weights[FIXED]
    shapes = [(k, v.shape, v.size) for k, v in weights.items()]
    for _ in range(rounds):
        flat = np.concatenate([v.reshape(-1) for v in weights.values()])
        sent = rows.sparkSession.sparkContext.broadcast(flat)

        def descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            w, at = {FIXED: share.value}, 0
            for name, shape, size in shapes:
                w[name] = sent.value[at : at + size].reshape(shape).copy()  # noqa: B023
                at += size
            held, count, seen = [], 0, 0

            def flush() -> None:
                nonlocal held, count, seen
                context, target = np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held])
                order = np.random.default_rng(seen).permutation(len(target))
                context, target = context.take(order, axis=0), target.take(order)
                for a in range(0, len(order), BATCH):
                    step(w, context[a : a + BATCH], target[a : a + BATCH], RATE)
                seen += len(target)
                held, count = [], 0

            for batch in batches:
                for tokens in texts_of(batch.column(1)):
                    tokens %= side**DIGITS
                    if len(tokens):
                        places = np.arange(len(tokens) % stride % len(tokens), len(tokens), stride)
                        held.append((windows(tokens, places, side**DIGITS), tokens[places]))
                        count += len(places)
                        if count >= 64 * BATCH:
                            flush()
            if held:
                flush()
            if seen:
                values = np.concatenate([w[name].reshape(-1) for name, _, _ in shapes])
                parts = [values[i : i + BLOCK].tobytes() for i in range(0, len(values), BLOCK)]
                yield _blocks(range(len(parts)), [seen] * len(parts), parts)

        sums = rows.select("doc_id", "text").mapInArrow(descend, BLOCKS).repartition("block").mapInArrow(_average, BLOCKS).toArrow()
        parts = dict(zip(sums.column("block").to_pylist(), sums.column("part").to_pylist(), strict=True))
        if parts:
            flat, at, weights = np.frombuffer(b"".join(parts[i] for i in range(len(parts))), np.float32), 0, {}
            for name, shape, size in shapes:
                weights[name] = flat[at : at + size].reshape(shape)
                at += size
    return weights | {FIXED: share.value}


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of a task, counted whenever there are ``COUNTED`` tokens."""

    def count(hashes: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(n, pa.int64())], ["word", "n"])

    held: list[np.ndarray] = []
    tokens = 0
    for batch in batches:
        for part in parts_of(batch.column(1)):
            held.append(words_in(part)[0])
            tokens += len(held[-1])
            if tokens >= COUNTED:
                yield count(held)
                held, tokens = [], 0
    if held:
        yield count(held)


def _counted(rows: DataFrame) -> DataFrame:
    """word and n: its number in all documents of (doc_id, text)."""
    return rows.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shares(counts: DataFrame, side: int) -> DataFrame:
    """word, n and share: the log of its share of the tokens of its class."""
    own = F.col("word") % side**DIGITS
    classes = materialise(counts.groupBy(own.alias("class")).agg(F.sum("n").alias("all")), "lm-classes")
    shares = counts.join(small(classes, 16), own == F.col("class")).select("word", "n", F.log(F.col("n") / F.col("all")).alias("share"))
    return materialise(shares, "lm-shares")


def _numbers(text: np.ndarray, kind: np.ndarray, words: np.ndarray, n_texts: int) -> pa.Array:
    """Each text's words with their number in it, as lists of structs; ``kind`` tells where each stands in ``words``."""
    both, times = np.unique(text * max(1, len(words)) + kind, return_counts=True)
    text, kind = np.divmod(both, max(1, len(words)))
    entries = pa.StructArray.from_arrays([pa.array(words[kind], pa.int64()), pa.array(times, pa.int64())], ["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n_texts + 1)), pa.int32()), entries)


SCORED = "doc_id long, n_tokens long, sum double, rare array<struct<word:long,times:long>>"


def score(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, pll (summed log-probability) and pll_per_token, one row per row of ``docs``.

    Words are counted over ``docs``, also where trained weights are given.
    """
    rows = id_and_text(docs, id_col, text_col)
    counts = materialise(_counted(rows), "lm-counts")
    if weights is None:
        weights = train(rows, side=side_of(counts.count()), counts=counts)
    side = side_in(weights)
    shares = _shares(counts, side)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = shares.where(F.col("n") >= total * FREQUENT).select("word", "share").orderBy("word").toArrow()
    context = docs.sparkSession.sparkContext
    sent, frequent = context.broadcast(weights), context.broadcast((often.column("word").to_numpy(), often.column("share").to_numpy()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        known, share = frequent.value
        w = sent.value
        parts = mixed(w)
        for batch in batches:
            sizes: list[int] = []
            sums: list[float] = []
            rare: list[pa.Array] = []
            # Short documents go through the network together.
            for part in parts_of(batch.column(1)):
                words, own = words_in(part)
                text = np.repeat(np.arange(len(own)), own)
                # A word is looked up once, in ascending order.
                each, kind = np.unique(words, return_inverse=True)
                at = np.minimum(np.searchsorted(known, each), max(0, len(known) - 1))
                found = known[at] == each if len(known) else np.zeros(len(each), bool)
                inside = np.bincount(text, np.where(found, share[at], 0.0)[kind], len(own)) if found.any() else np.zeros(len(own))
                rest = np.flatnonzero(~found[kind])
                sizes += own.tolist()
                sums += (inside + log_sums(w, np.split(words % side**DIGITS, np.cumsum(own)[:-1]), parts)).tolist()
                rare.append(_numbers(text[rest], kind[rest], each, len(own)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.concat_arrays(rare or [_numbers(*np.zeros((3, 0), int), 0)])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "sum", "rare"])

    # Numbered and written once, so that rows find their rare words' shares again; equal texts are rows of their own.
    found = materialise(rows.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    each = found.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
    rest = each.join(shares.select("word", "share"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("rest"))
    pll = F.when(F.col("n_tokens") > 0, F.col("sum") + F.coalesce("rest", F.lit(0.0))).otherwise(0.0)
    out = found.select("row", "doc_id", "n_tokens", "sum").join(rest, "row", "left").select("doc_id", "n_tokens", pll.alias("pll"))
    return out.select("*", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).otherwise(0.0).alias("pll_per_token"))


def log_sums(w: Weights, texts: list[np.ndarray], parts: list[np.ndarray] | None = None) -> np.ndarray:
    """Summed log-probabilities of each text's classes; REACH edges between texts keep them apart. ``parts`` are ``mixed(w)``."""
    edge = side_in(w) ** DIGITS
    sizes = [len(x) for x in texts]
    tokens, text = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
    if not len(tokens):
        return np.zeros(len(texts))
    places = np.arange(len(tokens)) + REACH * text
    apart = np.full(places[-1] + 1, edge)
    apart[places] = tokens
    # Matrix products round the last rows of odd sizes in another way: whole tiles give equal texts equal sums.
    spare = -len(tokens) % TILE
    near = np.concatenate([windows(apart, places, edge), np.full((spare, 2 * REACH), edge)])
    goal = np.concatenate([tokens, np.zeros(spare, np.int64)])
    parts = parts or mixed(w)
    each = [log_probability(w, near[a : a + CHUNK], goal[a : a + CHUNK], parts) for a in range(0, len(goal), CHUNK)]
    return np.bincount(text, np.concatenate(each)[: len(tokens)], len(texts))
