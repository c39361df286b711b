"""Grades of original answers under their contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import elements, members, text


def grade(kind: Column, answer: Column, accepted: Column, same_quantity: Column) -> Column:
    """1 or 0 for what can be graded automatically, null for human work.

    ``answer``: the ``answer`` of a strict object, as a VARIANT; null if there is none, which scores 0. ``accepted``: array of
    texts. choice and exact: a text that, trimmed, is accepted. choice_set: an array of texts that, trimmed, are exactly
    the accepted ones, however often and in whatever order. quantity: as ``same_quantity`` says.
    """
    said = F.trim(text(answer))
    items = elements(answer)
    texts = F.transform(items, lambda v: F.trim(text(v)))
    all_texts = F.forall(texts, lambda t: t.isNotNull())
    same_set = (F.size(F.array_except(texts, accepted)) == 0) & (F.size(F.array_except(accepted, texts)) == 0)
    right = F.when(kind.isin("choice", "exact"), F.array_contains(accepted, said)).when(kind == "choice_set", all_texts & same_set).when(kind == "quantity", same_quantity)
    return F.when(kind != "human", F.coalesce(right, F.lit(False)).cast("int"))


def answer_of(record: Column) -> Column:
    """The member ``answer`` of a JSON object's text."""
    return members(F.try_parse_json(record))["answer"]
