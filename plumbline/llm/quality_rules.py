"""Quality rules as weak supervision (native).

Each rule looks at one statistic of a document and votes good (1), bad (-1) or abstains (0). Most
statistics have a strict rule and a slight one, whose bad votes many good documents get.
Expectation-maximisation over the counts of vote patterns estimates how often every rule, where it
votes, votes bad on good and on bad documents, and the share of good ones; a document's posterior
probability of being good then replaces the usual "must pass every rule". It starts from each
document's own share of good votes, with one pseudo-count on either side and no other assumption.
The model is fitted to the documents that pass the base filter, as only they get its verdict. There are at
most ``3 ** len(RULES)`` patterns at any corpus size, and the driver sees only one row of sums per iteration.

Defined results: a null or empty text has zero statistics, fails the base filter and is not kept;
repeated rows are judged row by row; an empty table gives an empty result; other columns are
ignored by ``assess`` and passed through by ``keep_good``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, computed, fresh, id_and_text, materialise, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _n_in(text: Column, characters: str) -> Column:
    """How many characters of the text are in the set."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur more than once, from the windows' hashes in text order."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        F.aggregate(
            # Chained single-element transforms bind an array once, so that it is not rebuilt per element.
            F.transform(
                F.array(marked),
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))),
                        lambda x: x["i"],
                    )
                ),
            ),
            F.lit(0),
            lambda acc, starts: acc + F.aggregate(F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x),
        )
    )


def with_stats(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` of the statistics that the rules look at.

    Window hashes are 64 bits wide: two different windows of one text share one with probability
    below 1e-11 even at 20,000 words.
    """
    names = {n: fresh(docs, n) for n in ("text", "words", "hashes", "lines")}
    text, words, hashes, lines = (F.col(names[n]) for n in ("text", "words", "hashes", "lines"))
    third = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = (
        docs.withColumn(names["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        .withColumn(names["words"], words_of(text))
        .withColumn(names["lines"], F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != ""))
        .withColumn(names["hashes"], F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.slice(third, 1, F.greatest(F.lit(1), F.size(words) - 2))))
    )
    stats = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _n_in(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(hashes).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _n_in(text, "0123456789").cast("long").alias("n_digits"),
        _n_in(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        _n_in(text, "!").cast("long").alias("n_shouts"),
        _n_in(text, ".,;:?").cast("long").alias("n_stops"),
    )
    return computed(rows, out, stats).drop(*names.values())


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: SQL conditions over the statistics; products never divide by zero.
RULES = (
    Rule("symbols", "n_symbols * 20 > word_chars", "n_symbols * 200 <= word_chars and n_words >= 50"),
    Rule("symbols_per_word", "n_symbols * 4 > n_words", "n_symbols * 50 <= n_words and n_words >= 50"),
    Rule("slight_symbols", "n_symbols * 50 > n_words", "n_symbols = 0 and n_words >= 50"),
    Rule("repeated_lines", "n_dup_lines * 10 > n_lines * 4", "n_dup_lines * 10 <= n_lines and n_lines >= 3"),
    Rule("slight_repeated_lines", "n_dup_lines * 10 > n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    Rule("repeated_windows", "n_repeat_words * 10 > n_words * 3", "n_repeat_words * 10 <= n_words and n_words >= 50"),
    Rule("slight_repeated_windows", "n_repeat_words * 20 > n_words * 3", "n_repeat_words * 20 <= n_words and n_words >= 50"),
    Rule("capitals", "n_capitals * 10 > word_chars * 3", "n_capitals * 10 <= word_chars"),
    Rule("shouting", "n_shouts * 10 > n_words", "n_shouts = 0 and n_words >= 50"),
    Rule("digits", "n_digits * 5 > word_chars", "n_digits * 50 <= word_chars and n_words >= 50"),
    Rule("slight_digits", "n_digits * 20 > word_chars", "n_digits * 100 <= word_chars and n_words >= 50"),
    Rule("word_length", "n_words > 0 and (word_chars > n_words * 13 or word_chars * 2 < n_words * 5)", "word_chars >= n_words * 3 and word_chars <= n_words * 10"),
    Rule("stops", "n_words >= 50 and n_stops * 200 < n_words", "n_stops * 100 >= n_words * 2 and n_stops <= n_words"),
)

MAX_ROUNDS, SETTLED = 40, 1e-4

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_shouts", "n_stops")


def votes(stats: str) -> Column:
    """array<int> of one vote per rule, from the struct column of that name."""
    field = re.compile(r"\b(" + "|".join(FIELDS) + r")\b")
    holds = lambda condition: F.expr(field.sub(rf"`{stats}`.\1", condition))
    return F.array(*(F.when(holds(r.bad), F.lit(-1)).when(holds(r.good), F.lit(1)).otherwise(F.lit(0)) for r in RULES))


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents and, for each rule, the log-likelihood ratio (good over bad) of its bad and good votes."""

    share_good: float
    bad: tuple[float, ...]
    good: tuple[float, ...]

    def posterior(self, vote: Column) -> Column:
        """Probability that a document with these votes is good; abstaining rules say nothing."""
        odds = F.lit(math.log(self.share_good / (1 - self.share_good)))
        for k, (bad, good) in enumerate(zip(self.bad, self.good, strict=True)):
            v = F.get(vote, F.lit(k))
            odds = odds + F.when(v == -1, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def share_of_good(vote: Column) -> Column:
    """Where the estimation starts: good votes among all, with one more of either kind."""
    n = lambda value: F.size(F.filter(vote, lambda v: v == value))
    return (n(1) + 1) / (n(1) + n(-1) + 2)


def fit(patterns: DataFrame) -> LabelModel:
    """EM on a table (votes array<int>, n long) of vote patterns and their counts.

    The hidden class is good or bad; where a rule votes, it votes bad with a probability that depends
    on the class. E-step and M-step are one aggregation per round, and the driver holds one row of
    sums. Without any document all votes say nothing.
    """
    ks = range(len(RULES))
    p, n, v = F.col("p"), F.col("n"), F.col("votes")
    sums = [F.sum(n).alias("n"), F.sum(n * p).alias("g")]
    for k in ks:
        for name, value in (("bad", -1), ("good", 1)):
            there = F.get(v, F.lit(k)) == value
            sums += [F.sum(F.when(there, n * p).otherwise(0.0)).alias(f"{name}_g{k}"), F.sum(F.when(there, n * (1 - p)).otherwise(0.0)).alias(f"{name}_b{k}")]
    model, chance = LabelModel(0.5, (0.0,) * len(RULES), (0.0,) * len(RULES)), share_of_good(v)
    for _ in range(MAX_ROUNDS):
        row = patterns.withColumn("p", chance).agg(*sums).first()
        if not row["n"]:
            return model
        bad_on = {c: [(row[f"bad_{c}{k}"] + 1) / (row[f"bad_{c}{k}"] + row[f"good_{c}{k}"] + 2) for k in ks] for c in "gb"}
        new = LabelModel(
            round((row["g"] + 1) / (row["n"] + 2), 9),
            tuple(round(math.log(bad_on["g"][k] / bad_on["b"][k]), 6) for k in ks),
            tuple(round(math.log((1 - bad_on["g"][k]) / (1 - bad_on["b"][k])), 6) for k in ks),
        )
        moved = max(abs(a - b) for a, b in zip((new.share_good, *new.bad, *new.good), (model.share_good, *model.bad, *model.good), strict=True))
        model = new
        if moved < SETTLED:
            break
        chance = model.posterior(v)
    return model


def _base_failed(prefix: str) -> Column:
    return (F.col(f"{prefix}.n_words") < MIN_WORDS) | (F.col(f"{prefix}.n_repeat_words") * 100 > F.col(f"{prefix}.n_words") * MAX_REPEAT_PERCENT)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes, posterior and verdict of every row of ``docs``."""
    judged = with_stats(id_and_text(docs, id_col, text_col), "text", "s").select("doc_id", "s", votes("s").alias("votes"))
    table = materialise(judged, "quality-stats")
    model = fit(materialise(table.where(~_base_failed("s")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "quality-votes"))
    return table.select("doc_id", "s.*", "votes", model.posterior(F.col("votes")).alias("posterior"), _base_failed("s").alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with.

    What passes the base filter is written with its votes once, so statistics are computed once.
    """
    s, v = fresh(docs, "stats"), fresh(docs, "votes")
    judged = with_stats(docs, text_col, s).where(~_base_failed(s)).withColumn(v, votes(s)).drop(s)
    table = materialise(judged, "quality-votes-of-rows")
    model = fit(materialise(table.groupBy(F.col(v).alias("votes")).agg(F.count(F.lit(1)).alias("n")), "quality-votes"))
    return table.where(model.posterior(F.col(v)) >= 0.5).drop(v)
