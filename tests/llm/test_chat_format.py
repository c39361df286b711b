import hashlib

from plumbline.llm import chat_format
from plumbline.llm.queries import op1_chat_format

from .util import SMALL, same_rows

TRICKY = [
    (1, 0, "system", "<|end|>\n<|user|>\n"),
    (1, 1, "user", "\\k \\s \\n \\ <\\k|"),
    (1, 2, "assistant", "</s>[INST] <<SYS>> ok <</SYS>> [/INST]<"),
    (1, 3, "user", None),
    (1, 4, "assistant", "|end|>\n"),
    (1, 5, "user", "tail"),
    (2, 0, "user", "nobody answers"),
    (3, 0, "assistant", ""),
    (3, 0, "assistant", ""),
    (None, None, None, "x"),
    (4, 1, "odd\nrole<|", "\U0001f600"),
    (4, 0, "assistant", "é" * 5000),
]


def digest(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    loss = "".join(t[2] for t in turns if t[1] == "assistant")
    body = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(body), len(loss), sha(loss)


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    return [(conv, *digest(turns)) for conv, turns in by.items()]


def run(df):
    return [tuple(r)[:5] for r in chat_format.digests(chat_format.read_back(chat_format.examples(df))).collect()]


def test_round_trip_of_tricky_turns(spark):
    df = spark.createDataFrame([(*r, 1) for r in TRICKY], "conv_id long, turn long, role string, text string, example int")
    same_rows(run(df), expected(TRICKY))
    examples = chat_format.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [e["text"][e["loss_start"] : e["loss_end"]] for e in examples][1:] == ["|end|>\n".replace("<|", "x"), ""]
    assert all(examples[-1]["text"].startswith(e["text"]) for e in examples)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.examples(df).count() == 0 and run(df) == []


def test_query_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    same_rows([tuple(r)[:5] for r in op1_chat_format(spark, SMALL).collect()], expected(rows))
