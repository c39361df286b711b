"""Strict JSON objects, exact quantities and OCR literals, as Arrow-batched functions.

Built-in parsers accept duplicate keys, trailing text or rounding; these do not.
"""

from __future__ import annotations

import json
import re
import unicodedata
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

_FENCE = re.compile(r"\s*```(?:json)?[ \t]*\n(.*)\n[ \t]*```\s*\Z", re.S)


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _refuse(name):
    raise ValueError(name)


def unfenced(text: str) -> str:
    """What stands within the one code fence that a text is, or the text."""
    fenced = _FENCE.match(text)
    return fenced[1] if fenced else text


def strict_object(text: str | None) -> dict | None:
    """The object that a text is, within one optional code fence; None for anything else.

    Repeated keys at any depth, NaN, infinities, other text around it and other JSON values are refused.
    """
    if text is None:
        return None
    try:
        out = json.loads(unfenced(text), object_pairs_hook=_unique, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def canonical(value) -> str:
    """Sorted keys, no blanks, non-ASCII kept, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@pandas_udf(T.StringType())
def strict_json(texts: pd.Series) -> pd.Series:
    """Canonical text of a strict object, else null."""
    return pd.Series([None if (o := strict_object(t)) is None else canonical(o) for t in texts], dtype=object)


_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_QUANTITY = re.compile(rf"\s*({_NUMBER.pattern})\s*(\S*)\s*\Z")


def quantity(text: str | None, scales: dict[str, str]) -> Fraction | None:
    """Exact value in base units; None if it isn't a number with a known unit."""
    found = _QUANTITY.match(text or "")
    if not found or found[2] not in scales:
        return None
    return Fraction(found[1]) * Fraction(scales[found[2]])


def same_quantity(a: str | None, b: str | None, scales: dict[str, str], tolerance: str = "0") -> bool:
    """Whether both are quantities at most ``tolerance`` base units apart, that limit included."""
    x, y = quantity(a, scales), quantity(b, scales)
    return x is not None and y is not None and abs(x - y) <= Fraction(tolerance)


#: Fixed values of the label grammar: units, case-sensitive; numbers; blanks before a unit; delimiters; wrappers; spacing.
UNITS = ("kg", "g", "mg", "m", "cm", "mm", "km", "s", "ms", "A", "mA", "V", "mV", "N", "J", "W", "C", "T", "Hz", "K", "Pa", "Ω")
_SIGNED = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
_MEASURE = re.compile(rf"({_SIGNED})[ \t\u00a0\u202f]*({'|'.join(UNITS)})")
_DELIMITED = re.compile(r"\$\$(?P<a>.+)\$\$|\\\((?P<b>.+)\\\)|\\\[(?P<c>.+)\\\]|\$(?P<d>.+)\$", re.S)
_WRAPPED = re.compile(r"\\(?:mathrm|text)\{([A-Za-z]+)\}")
_SPACING = ("\\,", "\\;", "\\:", "\\!", "\\ ")


def _seen(text: str | None) -> str | None:
    """NFC without outer blanks; None if nothing visible is left (format and control characters don't show)."""
    if text is None or all(unicodedata.category(c)[0] in "CZ" or c.isspace() for c in text):
        return None
    return unicodedata.normalize("NFC", text).strip()


def ocr_literal(text: str | None) -> str | None:
    """Normal form of a literal transcription."""
    return _seen(text)


def ocr_label(text: str | None) -> str | None:
    """Normal form of a label: one outer pair of math delimiters goes, then wrappers around letters, then each kind of spacing in turn.

    None for other markup. A number and a known unit are parted by one blank.
    """
    s = _seen(text)
    if s is not None and s.startswith(("$", "\\(", "\\[")):
        inner = _DELIMITED.fullmatch(s)
        s = inner[inner.lastgroup].strip() if inner else None
    if s is None:
        return None
    s = _WRAPPED.sub(r"\1", s)
    for command in _SPACING:  # what one leaves behind may be another
        s = s.replace(command, " ")
    s = None if "$" in s or "\\" in s else _seen(s.replace("\u2212", "-"))
    measure = _MEASURE.fullmatch(s) if s else None
    return " ".join(measure.groups()) if measure else s


@pandas_udf(T.StringType())
def ocr_normal(texts: pd.Series) -> pd.Series:
    """Labels; see ``ocr_label``."""
    return pd.Series([ocr_label(t) for t in texts], dtype=object)


@pandas_udf(T.StringType())
def ocr_literals(texts: pd.Series) -> pd.Series:
    return pd.Series([ocr_literal(t) for t in texts], dtype=object)


def quantity_equal(scales: dict[str, str], tolerance: str = "0"):
    """A function of two string columns."""

    @pandas_udf(T.BooleanType())
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_quantity(x, y, scales, tolerance) for x, y in zip(a, b, strict=True)])

    return equal


def owner_of(strict):
    """The stripped ``owner`` of a strict object's text."""
    return F.trim(F.get_json_object(strict, "$.owner"))
