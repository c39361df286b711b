"""Literal occurrences of quotes and the status of span references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, quote: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty quote."""
    return F.when(F.length(quote) > 0, F.try_divide(F.length(text) - F.length(F.replace(text, quote, F.lit(""))), F.length(quote)).cast("int")).otherwise(0)


def starts(text: Column, quote: Column) -> Column:
    """0-based code-point starts of all non-overlapping occurrences, in order."""
    n = occurrences(text, quote)
    step = lambda acc, _: F.struct(
        (F.position(quote, text, acc["next"]) + F.length(quote)).alias("next"),
        F.concat(acc["at"], F.array(F.position(quote, text, acc["next"]) - 1)).alias("at"),
    )
    first = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), first, step, lambda acc: acc["at"])).otherwise(F.array().cast("array<int>"))


def resolve(text: Column, quote: Column, occurrence: Column) -> Column:
    """struct(status, start, end) of a 1-based occurrence: resolved_exact, unique_exact_repair_proposed, ambiguous_occurrence or quote_not_found."""
    found = starts(text, quote)
    n = F.size(found)
    exact = occurrence.between(1, n)
    at = F.when(exact, F.get(found, occurrence.cast("int") - 1)).when(n == 1, F.get(found, F.lit(0)))
    status = F.when(n == 0, "quote_not_found").when(exact, "resolved_exact").when(n == 1, "unique_exact_repair_proposed").otherwise("ambiguous_occurrence")
    return F.struct(status.alias("status"), at.cast("long").alias("start"), (at + F.length(quote)).cast("long").alias("end"))
