"""Small documents with every awkward case, and helpers that read them."""

SMALL = "/root/testdata/sf0.001"

AWKWARD = [
    (1, "Plain words here.\nAnd a second line."),
    (2, None),
    (3, ""),
    (4, " \t\n \x0b"),
    (5, "one"),
    (6, "one two"),
    (7, "x y z x y z x y z " * 30),
    (7, "x y z x y z x y z " * 30),
    (None, "no id at all"),
    (8, "\U0001f600 café  nbsp em " * 5),
    (9, "#*$%&|<> " * 80 + "\nsame\nsame\nsame\n\n"),
    (10, "long " * 20000),
    (11, "7" * 30000 + " " + "a." * 20000 + "@" + "b." * 20000 + " " + "1." * 20000),
]


def awkward(spark):
    """Extra columns carry names that operators use for their own."""
    rows = [(i, t, "en", "s", 0 if t is None else len(t), 1, "x", True) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, kept boolean")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same_rows(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
