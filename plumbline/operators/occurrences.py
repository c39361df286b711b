"""All literal occurrences of many quotes in many texts, in one pass over the texts for each block of quotes.

A block of quotes is an Aho-Corasick automaton that reads a text once, however many quotes there are. Quotes are
broadcast in blocks of bounded size; texts are never shuffled, joined or sent back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of quotes in a block. An automaton takes some tens of times as much in a task's process.
BLOCK = 4 << 20
#: The automaton that this process built last, by the broadcast it came from.
_built: dict = {}


def _automaton(sent):
    if sent.value[0] not in _built:
        import ahocorasick  # noqa: PLC0415 only tasks need it

        machine = ahocorasick.Automaton()
        for quote, items in sent.value[1].items():
            machine.add_word(quote, (len(quote), items))
        machine.make_automaton()
        _built.clear()
        _built[sent.value[0]] = machine
    return _built[sent.value[0]]


def quote_spans(texts: DataFrame, quotes: DataFrame, text_id: str, item_id: str) -> DataFrame:
    """text_id, item_id, start and end (code points, end exclusive) of every occurrence.

    ``texts``: text_id and text; ``quotes``: item_id and quote. Occurrences of a quote that overlap count as in reading: the
    first, then the next that begins after its end. Null and empty texts and quotes have none; quotes that several items
    have are found for each.
    """
    spark = texts.sparkSession
    rows, quotes = texts.select(text_id, "text").where("text <> ''"), quotes.select(item_id, "quote").where("quote <> ''").distinct()
    size = quotes.agg(F.coalesce(F.sum(F.octet_length("quote")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    schema, out = f"{text_id} {texts.schema[text_id].dataType.simpleString()}, {item_id} {quotes.schema[item_id].dataType.simpleString()}, start long, end long", None
    for block in range(blocks):
        held: dict[str, list] = {}
        for r in quotes.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == block).toLocalIterator():
            held.setdefault(r["quote"], []).append(r[item_id])
        sent = spark.sparkContext.broadcast((f"{id(held)}-{block}-{size}", held))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = _automaton(sent) if sent.value[1] else None
            for batch in batches:
                found: tuple[list, list, list, list] = ([], [], [], [])
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ended: dict[int, int] = {}
                    for last, (length, items) in machine.iter(text) if machine else ():
                        start = last + 1 - length
                        if start >= ended.get(id(items), 0):
                            ended[id(items)] = last + 1
                            for item in items:
                                for column, value in zip(found, (name, item, start, last + 1), strict=True):
                                    column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (batch.schema.field(0).type, kinds[1], pa.int64(), pa.int64()), strict=True)], ["a", "b", "start", "end"])

        kinds = [None, pa.int64() if quotes.schema[item_id].dataType.simpleString() == "bigint" else pa.string()]
        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out
