"""Character spans of regular-expression matches, with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` the gaps between them; a running sum of
both lengths is each match's place in code points. Patterns must not match the empty string. They
are written with possessive quantifiers and look-behinds so that Java's matcher neither recurses
nor rescans a run of characters, whatever the length of the text. Nothing here is quadratic in the matches of
a text: running sums and maxima double their reach in every pass, and pieces of a text are taken from chunks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.variants import let

SPAN = "struct<kind:string,start:int,end:int,text:string>"
#: Code points of a chunk.
CHUNK = 512


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array under an associative ``step``; as many passes as its size has binary digits."""
    reaches = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(values))
    return F.aggregate(reaches, values, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, step(F.get(a, i - d), x)).otherwise(x)))


def find_spans(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column], hint: str | None = None) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches whose text ``keep`` accepts.

    ``hint`` is a substring that every match has; texts without it skip the search.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(matches: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.length(gap) + F.coalesce(F.length(m), F.lit(0)))
        ends = let(steps, lambda lengths: running(lengths, lambda a, b: a + b))
        spans = let(ends, lambda e: F.transform(matches, lambda m, i: F.struct(F.lit(kind).alias("kind"), (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("text"))))
        return F.filter(spans, lambda s: keep(s["text"]))

    there = text.isNotNull() & (text.contains(hint) if hint else F.lit(True))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(there & F.regexp_like(text, F.lit(pattern)), found.cast(f"array<{SPAN}>")).otherwise(none)


def without_overlaps(spans: Column, others: Column) -> Column:
    """The spans, in their order, that share no character with any of the others."""
    far = (1 << 31) - 1
    tagged = F.concat(
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("place"), s.alias("span"))),
        F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), F.lit(-1).alias("place"), F.lit(None).cast(SPAN).alias("span"))),
    )

    def clear(items: Column) -> Column:
        ends = F.transform(items, lambda x: F.when(x["place"] < 0, x["end"]).otherwise(-1))
        starts = F.reverse(F.transform(items, lambda x: F.when(x["place"] < 0, x["start"]).otherwise(far)))
        before = lambda e: let(F.reverse(let(starts, lambda s: running(s, F.least))), lambda n: kept(e, n))
        kept = lambda e, n: F.filter(items, lambda x, i: (x["place"] >= 0) & (F.get(e, i) <= x["start"]) & (F.get(n, i) >= x["end"]))
        return let(let(ends, lambda e: running(e, F.greatest)), before)

    order = F.array_sort(let(F.array_sort(tagged), clear), lambda a, b: a["place"] - b["place"])
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(order, lambda x: x["span"])).otherwise(spans)


def chunks(text: Column) -> Column:
    """A text cut into pieces of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of the text that ``cut`` has the chunks of; no more than these are looked at."""
    first = F.floor(start / CHUNK).cast("int")
    whole = F.array_join(F.slice(cut, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.substring(whole, start - first * CHUNK + 1, end - start)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def near(cut: Column, span: Column, reach: int) -> Column:
    """The lower-cased text within ``reach`` characters on either side of a span, from the text's chunks."""
    return F.lower(piece(cut, F.greatest(F.lit(0), span["start"] - reach), span["end"] + reach))
