"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score (native).

Kinds: email, ip, card (16 to 19 digits, Luhn) and phone are base spans and always stay. On top come
iban (mod-97), short_card (13 to 15 digits, Luhn), ssn and local_phone, each kept only where its
score, raised by context words within ``REACH`` characters, reaches ``THRESHOLD``, and where it
overlaps no base span.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so
repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.variants import let

from .common import computed, id_and_text
from .spans import SPAN, chunks, find_spans, joined, n_of, near, without_overlaps

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "ssn", "local_phone")
THRESHOLD, REACH = 0.7, 40

#: The contract's expressions; a match can only start where the run of its first characters does, or where the last match ended.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
DIGITS = "[0-9](?:[ -]?[0-9])++"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
#: Parts of at most 255, leading zeros allowed.
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)"
IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = "(?<![0-9+-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ -])[0-9]{3}[ -][0-9]{4}(?![0-9-])"

#: Score without context, what context words add, and those words; they count as whole words, with or without a plural.
SCORES = {
    "email": (0.9, 0.1, "e-?mail|contact|write|address"),
    "ip": (0.7, 0.2, "ip|host|server|address|login"),
    "card": (0.8, 0.2, "card|visa|master|mastercard|amex|credit|debit|payment"),
    "phone": (0.7, 0.2, "phone|telephone|telefon|tel|call|mobile|cell|fax|contact"),
    "iban": (0.75, 0.2, "iban|bank|account|konto|transfer|bic|swift"),
    "short_card": (0.4, 0.4, "card|creditcard|visa|amex|diners|credit|debit|payment"),
    "ssn": (0.4, 0.4, "ssn|social|security|taxpayer"),
    "local_phone": (0.4, 0.4, "phone|telephone|telefon|tel|call|mobile|cell|fax"),
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, c: F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["sum"] + F.when(acc["i"] % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN (blanks allowed) leaves 1 modulo 97."""
    packed = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: (acc * F.when(c > "9", 100).otherwise(10) + F.ascii(c) - F.when(c > "9", 55).otherwise(48)) % 97,
    )
    return (F.length(packed) >= 15) & (F.length(packed) <= 34) & (rest == 1)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _card(match: Column, low: int, high: int) -> Column:
    return F.when(_between(F.length(_digits(match)), low, high), luhn(_digits(match))).otherwise(False)


def base_spans(text: Column) -> Column:
    """The contract's spans, by kind as listed and then by start."""
    return F.concat(
        find_spans(text, "email", EMAIL, lambda m: F.lit(True), "@"),
        find_spans(text, "ip", IP, lambda m: F.regexp_like(m, F.lit(f"^{BYTE}\\.{BYTE}\\.{BYTE}\\.{BYTE}$")), "."),
        find_spans(text, "card", DIGITS, lambda m: _card(m, 16, 19)),
        find_spans(text, "phone", PHONE, lambda m: _between(F.length(_digits(m)), 8, 15), "+"),
    )


def added_spans(text: Column) -> Column:
    return F.concat(
        find_spans(text, "iban", IBAN, mod97),
        find_spans(text, "short_card", DIGITS, lambda m: _card(m, 13, 15)),
        find_spans(text, "ssn", SSN, lambda m: ~F.regexp_like(m, F.lit("^(?:000|666|9)|-00-|-0000$")), "-"),
        find_spans(text, "local_phone", LOCAL_PHONE, lambda m: F.lit(True)),
    )


def score(cut: Column, span: Column) -> Column:
    """The kind's score, with its context words if any stands nearby; ``cut``: the text's chunks."""
    out = F.lit(0.0)
    for kind, (alone, more, context) in SCORES.items():
        said = F.regexp_like(near(cut, span, REACH), F.lit(f"(?<![\\p{{L}}])(?:{context})s?(?![\\p{{L}}])"))
        out = F.when(span["kind"] == kind, F.lit(alone) + F.when(said, F.lit(more)).otherwise(F.lit(0.0))).otherwise(out)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array<span>) and spans (array<span with score and base>), one row per row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col)
    rows = computed(computed(rows, "base", base_spans(F.col("text"))), "more", added_spans(F.col("text")))
    base, more = F.col("base"), F.col("more")
    rows = computed(rows, "cut", F.when(F.size(base) + F.size(more) > 0, chunks(F.col("text"))))
    cut = F.col("cut")

    def scored(spans: Column, of_base: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "text")), score(cut, s).alias("score"), F.lit(of_base).alias("base")))

    added = let(scored(without_overlaps(more, base), False), lambda spans: F.filter(spans, lambda s: s["score"] >= THRESHOLD))
    return rows.select("doc_id", base.cast(f"array<{SPAN}>").alias("base"), F.concat(scored(base, True), added).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *(n_of(F.col("base"), k).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
