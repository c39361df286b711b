"""Strict objects and label forms on texts made at random: right ones by a grammar, wrong ones by one fault each."""

import json
import random
import string

import pytest

from plumbline.functions.strict_json import UNITS, ocr_label, ocr_literal, strict_object


def value(rng, depth):
    pick = rng.randrange(7 if depth else 5)
    if pick == 5:
        return [value(rng, depth - 1) for _ in range(rng.randrange(3))]
    if pick == 6:
        return {w: value(rng, depth - 1) for w in (word(rng) for _ in range(rng.randrange(3)))}
    return [None, rng.random() < 0.5, rng.randint(-99, 99), rng.random() * 1e3, word(rng) + rng.choice(("", '"', "\\", "{", "é", "\n"))][pick]


def word(rng):
    return "".join(rng.choices(string.ascii_letters, k=rng.randint(1, 6)))


def objects(rng):
    return {f"k{i}": value(rng, 3) for i in range(rng.randint(1, 4))}


def twice(rng, text):
    """The first key of some object in the text stands there a second time."""
    at = rng.choice([i for i, c in enumerate(text) if text.startswith('{"k', i) or text.startswith(',"k', i)])
    return text[: at + 1] + '"k0":1,"k0":2,' + text[at + 1 :]


#: What may go wrong with the text of an object.
FAULTS = {
    "a key twice": twice,
    "a key twice, deep": lambda rng, t: '{"k":[[' + twice(rng, t) + "]]}",
    "no finite number": lambda rng, t: t[:-1] + ',"z":' + rng.choice(("NaN", "Infinity", "-Infinity")) + "}",
    "a comma too many": lambda rng, t: t[:-1] + ",}",
    "cut off": lambda rng, t: t[: rng.randrange(len(t))],
    "text around": lambda rng, t: rng.choice((word(rng) + t, t + word(rng), t + t, "so: " + t)),
    "in a list": lambda rng, t: f"[{t}]",
    "as a text": lambda rng, t: json.dumps(t),
    "single quotes": lambda rng, t: "{'k':" + t + "}",
    "text after the fence": lambda rng, t: f"```json\n{t}\n``` {word(rng)}",
    "a fence within a fence": lambda rng, t: f"```json\n```json\n{t}\n```\n```",
}


@pytest.mark.parametrize("seed", range(40))
def test_objects_come_back_as_they_were(seed):
    rng = random.Random(seed)
    want = objects(rng)
    text = json.dumps(want, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 2)))
    assert strict_object(text) == strict_object(f"  {text}\n") == strict_object(f"```json\n{text}\n```") == strict_object(f" ```\n{text}\n ``` ") == want


@pytest.mark.parametrize("fault", FAULTS)
def test_one_fault_is_enough(fault):
    rng = random.Random(fault)
    for _ in range(60):
        text = json.dumps(objects(rng), separators=(",", ":"))
        assert strict_object(FAULTS[fault](rng, text)) is None, text
    assert strict_object(None) is None


def numeral(rng):
    return rng.choice(("", "+", "-")) + rng.choice((str(rng.randint(0, 999)), f"{rng.randint(0, 9)}.{rng.randint(0, 99)}", f".{rng.randint(0, 99)}"))


GAPS = ("", " ", "  ", "\t", " ", "\\,", "\\;", "\\:", "\\!", "\\ ", "\\\\,", "\\, \\;")
PAIRS = (("", ""), ("$", "$"), ("$$", "$$"), ("\\(", "\\)"), ("\\[", "\\]"))


@pytest.mark.parametrize("seed", range(60))
def test_measures_have_one_form(seed):
    rng = random.Random(seed)
    number, unit = numeral(rng), rng.choice(UNITS)
    shown = unit if not unit.isascii() else rng.choice((unit, f"\\mathrm{{{unit}}}", f"\\text{{{unit}}}"))
    opening, closing = rng.choice(PAIRS)
    text = rng.choice(("", " ")) + opening + number.replace("-", rng.choice(("-", "−"))) + rng.choice(GAPS) + shown + closing + rng.choice(("", "\n"))
    assert ocr_label(text) == f"{number} {unit}", text
    # Other numbers and units are other labels: nothing is converted, cased or rounded.
    for other in (f"{number}0.0 {unit}", f"{number} {unit}x", f"x{number} {unit}", f"{number} {unit.swapcase()}q"):
        assert ocr_label(other) != f"{number} {unit}"


def test_other_markup_has_no_form():
    rng = random.Random(3)
    for _ in range(100):
        inside = word(rng)
        for text in (f"\\{inside}", f"\\frac{{{inside}}}{{2}}", f"{inside}$", f"${inside}", f"\\mathrm{{{inside} {inside}}}", f"\\({inside}\\]", f"$${inside}${inside}$$", "$" * rng.randint(1, 4)):
            assert ocr_label(text) is None, text
        assert ocr_label(f"{inside}_{{1}}") == f"{inside}_{{1}}" and ocr_literal(f" ${inside}$ ") == f"${inside}$"
    for blank in ("", " \t", "​﻿", "\x00", None):
        assert ocr_label(blank) is None and ocr_literal(blank) is None
    assert ocr_literal("é") == "é"
