"""Secret scans: Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio (native).

Base spans (assign, access, hex) follow fixed expressions. Other candidates are runs of key
characters with a letter, at least ``MIN_LENGTH`` long; a candidate is a secret where the bigram model
of random strings explains it better than the model of ordinary strings by ``MIN_RATIO`` nats per pair
and by ``MIN_TOTAL`` nats over the whole run, so short runs need stronger signs than long ones. Both models are trained by Spark from labelled
samples: random strings drawn by hashing, identifiers and compounds joined from common words; their
size is a parameter and the model has ``len(ALPHABET) ** 2`` numbers at any corpus size.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so
repeated rows repeat; an empty table gives an empty result; other columns are ignored by ``scan``
and passed through by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed, double_table, fresh, id_and_text
from .spans import SPAN, chunks, find_spans, joined, n_of, piece, running, without_overlaps

BASE = ("assign", "access", "hex")
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGNED = "^(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{12}"
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}+"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]++"
MIN_LENGTH, MIN_RATIO, MIN_TOTAL = 16, 0.35, 10.0

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Words that identifiers are made of (sample data).
WORDS = (
    "account action active address amount array author average batch block buffer build byte cache call change channel char check child class client clone close code column commit config "
    "connect content context control copy count create current cursor data date debug default delete depth device document domain driver element empty enable encode entry error event export "
    "factory field file filter final first flag float format frame function group handle hash header height helper image import index info input insert instance item job key label language last "
    "layer left length level library limit line link list load local lock log loop main manager map match max member memory merge message method min mode model module name network next node "
    "number object offset old open option order output owner page param parent parse path pattern point port position prefix process project proxy query queue random range read record region "
    "remote remove render request reset result return right role root route row rule run sample save scale schema score scope search section select send sequence server service session set "
    "shape size slot sort source split stack start state status step stop store stream string style sum switch sync system table target task template test text thread time title total track "
    "tree type unit update upload url user utility valid value vector version view visible width window word worker write zone"
).split()

#: Words and endings that long words of prose are made of, in four languages (sample data).
PROSE = (
    "about after again against also another because before between both could during each every found from great have here however into itself made many might more most much never other "
    "over people place same should since some still such than that their there these they this those through under until very water were what when where which while with would years "
    "aber alle auch auf aus bei beim dann das dass dem den der des die dieser durch ein eine einer für gegen haben hat heit ich immer ist jahr kann keit lich machen mehr mit nach nicht noch nur "
    "oder schaft schon sehr sein sich sie sind stadt tag über und ung unter ver viel von vor war welt wenn wer werden wie wieder wird wir zeit zu zum zur zwischen "
    "ainsi alors après aussi autre aux avant avec beaucoup bien ces cette chaque comme dans depuis deux donc elle elles encore entre être eux faire fois grand heureux jour leur lieu mais même "
    "mieux moins monde non nous nouveau ou par parce pas pendant peu peut plus pour quand que quel qui sans ses sont sous sur temps toujours tous tout très une vers vie vous yeux "
    "ahora algo ante antes años aunque cada casa como con contra cuando cual desde donde dos durante ella ellos entonces entre era esta este estos forma fue gran había hacer hasta hay hombre "
    "lado los luego lugar mayor menos mientras mismo mucho mundo muy nada nunca otra otro para parte pero poco porque puede quien según ser siempre sin sobre también tanto tiempo todo una vez vida"
).split()


def samples(spark: SparkSession, n: int = 20000) -> DataFrame:
    """(text, random boolean): ``n`` labelled strings of each kind, drawn by hashing row numbers."""
    ids = spark.range(n)
    pick = lambda k: F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    prose = lambda k: F.get(F.array(*map(F.lit, PROSE)), F.pmod(F.xxhash64("id", F.lit("prose"), F.lit(k)), F.lit(len(PROSE))).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(5))
    number = F.pmod(F.xxhash64("id", F.lit("number")), F.lit(1000)).cast("string")
    words = [pick(k) for k in range(4)]
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *words))
        .when(style == 1, F.concat(words[0], *(F.initcap(w) for w in words[1:])))
        .when(style == 3, F.concat(*(prose(k) for k in range(3))))
        .when(style == 2, F.concat(F.upper(F.concat_ws("_", *words[:3])), F.lit("_"), number))
        .otherwise(F.concat(F.concat_ws("-", *words[:3]), F.lit("/"), words[3], number))
    )
    raw = F.sha2(F.concat(F.lit("key-"), F.col("id").cast("string")), 256)
    drawn = F.when(F.col("id") % 3 == 0, F.substring(raw, 1, 40)).otherwise(F.substring(F.base64(F.unhex(raw)), 1, 40))
    return ids.select(ordinary.alias("text"), F.lit(False).alias("random")).unionByName(ids.select(drawn.alias("text"), F.lit(True).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all character pairs, row by row of ALPHABET; add-one smoothed.

    Pairs are counted by Spark; the driver gets one row per pair and label.
    """
    pairs = labelled.where("text is not null").select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 1)), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair")
    )
    found = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.length("pair") == 2).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    table: list[float] = []
    for a in ALPHABET:
        rows = {side: [found.get((side, a + b), 0) + 1 for b in ALPHABET] for side in (True, False)}
        table += [round(math.log(x / sum(rows[True])) - math.log(y / sum(rows[False])), 4) for x, y in zip(rows[True], rows[False], strict=True)]
    return table


def total_ratio(candidate: Column, table: Sequence[float]) -> Column:
    """Log-likelihood ratio of a string over ALPHABET, summed over its character pairs."""
    weights, alphabet = double_table(table), F.lit(ALPHABET)
    at = lambda i: F.position(F.substring(candidate, i, F.lit(1)), alphabet) - 1
    return F.aggregate(
        F.sequence(F.lit(1), F.length(candidate) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(weights, at(i) * len(ALPHABET) + at(i + 1)), F.lit(0.0))
    )


def ratio(candidate: Column, table: Sequence[float]) -> Column:
    """Mean log-likelihood ratio per character pair."""
    return total_ratio(candidate, table) / (F.length(candidate) - 1)


def looks_random(candidate: Column, table: Sequence[float]) -> Column:
    """Whether a run of key characters is better explained as a random string, from its letters, length and ratio."""
    least = F.greatest(F.lit(MIN_TOTAL), (F.length(candidate) - 1) * MIN_RATIO)
    return F.when((F.length(candidate) >= MIN_LENGTH) & F.regexp_like(candidate, F.lit("[A-Za-z]")), total_ratio(candidate, table) >= least).otherwise(False)


def _sorted(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), rank(s).alias("rank"), s.alias("span"))))
    return F.transform(keyed, lambda x: x["span"])


def base_spans(text: Column) -> Column:
    return _sorted(
        F.concat(
            find_spans(text, "assign", ASSIGN, lambda m: F.regexp_like(m, F.lit(ASSIGNED))),
            find_spans(text, "access", ACCESS, lambda m: F.lit(True), "AKIA"),
            find_spans(text, "hex", HEX, lambda m: F.lit(True)),
        )
    )


def random_spans(text: Column, table: Sequence[float]) -> Column:
    """Candidates that the model of random strings explains better."""
    long_run = CANDIDATE[:-2] + f"{{{MIN_LENGTH},}}+"
    return find_spans(text, "random", long_run, lambda m: looks_random(m, table))


def scan(docs: DataFrame, table: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (array<struct<kind,start,end,text>>), one row per row of ``docs``."""
    table = train(samples(docs.sparkSession)) if table is None else table
    rows = id_and_text(docs, id_col, text_col)
    rows = computed(computed(rows, "base", base_spans(F.col("text"))), "more", random_spans(F.col("text"), table))
    base = F.col("base")
    return rows.select("doc_id", base.cast(f"array<{SPAN}>").alias("base"), _sorted(F.concat(base, without_overlaps(F.col("more"), base))).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *(n_of(F.col("base"), k).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, table: Sequence[float] | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans count as one. Texts without spans stay as they are."""
    table = train(samples(docs.sparkSession)) if table is None else table
    base, more, spans, cut, ends = (fresh(docs, n) for n in ("base", "more", "spans", "cut", "ends"))
    text, found = F.col(text_col), F.col(spans)
    rows = computed(computed(docs, base, base_spans(text)), more, random_spans(text, table))
    rows = computed(rows, spans, _sorted(F.concat(F.col(base), without_overlaps(F.col(more), F.col(base)))))
    rows = computed(rows, cut, F.when(F.size(found) > 0, chunks(text)))
    rows = computed(rows, ends, running(F.transform(found, lambda s: s["end"]), F.greatest))
    before = lambda i: F.when(i > 0, F.get(F.col(ends), i - 1)).otherwise(0)
    parts = F.transform(found, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(F.col(cut), before(i), s["start"]), F.lit(mark))).otherwise(""))
    out = F.concat(F.array_join(parts, ""), piece(F.col(cut), F.element_at(F.col(ends), -1), F.length(text)))
    return rows.withColumn(text_col, F.when(F.size(found) > 0, out).otherwise(text)).drop(base, more, spans, cut, ends)
