"""The manifest against a plain construction of the trees."""

import hashlib
import zlib

from plumbline.llm import merkle
from plumbline.llm.queries import op11_merkle_manifest

from .util import AWKWARD, SMALL, awkward, same_rows


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    """The root, and every leaf's siblings (left, right) from the lowest level up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        own = leaf(doc_id, source, lang, n_chars, text)
        trees.setdefault(lang, []).append((doc_id, own, leaf(doc_id, source, lang, n_chars, low) if hit else own))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        grown[name] = grow([x[1] for x in trees[name]])
    root, over = grow([grown[name][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for (doc_id, own, changed), path in zip(trees[name], grown[name][1], strict=True):
            whole = path + over[k]
            folded = changed
            for left, right in whole:
                folded = sha(left, folded, right)
            out.append((doc_id, own, grown[name][0], root, sha(*(x + y for x, y in whole)), folded, folded == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(df):
    return [tuple(r) for r in merkle.manifest(df).collect()]


def test_query_over_its_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    want = expected([tuple(r) for r in docs.collect()])
    same_rows([tuple(r) for r in op11_merkle_manifest(spark, SMALL).collect()], want)
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_sizes_around_the_width_of_blocks(spark):
    """Single leaves, full runs, one more than a block, one more than a block of blocks' run."""
    rows = [(i, f"Text {i}", f"l{n}", "s", i) for n in (1, 2, 8, 9, 64, 65, 511, 512, 513, 4097) for i in range(n)]
    same_rows(run(spark.createDataFrame(rows, SCHEMA)), expected(rows))


def test_many_groups(spark):
    rows = [(i, "A", None if i == 0 else f"Ü{i % 600:05d}", None, None) for i in range(1500)]
    same_rows(run(spark.createDataFrame(rows, SCHEMA).repartition(5)), expected(rows))


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in AWKWARD]
    clash = awkward(spark).selectExpr("*", "1 AS tree", "2 AS pos", "3 AS digest", "4 AS path", "5 AS root")
    same_rows(run(clash), expected(rows))
    nulls = [(None, None, None, None, None)] * 20 + [(3, "X", None, None, 1)] * 9
    same_rows(run(spark.createDataFrame(nulls, SCHEMA)), expected(nulls))
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_one_row(spark):
    (row,) = run(spark.createDataFrame([(3, "x", "en", "s", 1)], SCHEMA))
    assert row[1] == row[2] == row[3] and row[4] == sha("") and row[6]


def test_paths_of_a_verifier(spark):
    """What a user keeps: the path and the root tell whether a row is the one that was listed."""
    df = spark.range(100).selectExpr("'t' AS tree", "id", "sha2(cast(id AS string), 256) AS digest")
    rows = merkle.proofs(df, "id")
    good = rows.where(merkle.folded(rows["digest"], rows["path"]) == rows["root"])
    bad = rows.where(merkle.folded(merkle.F.sha2(merkle.F.lit("other"), 256), rows["path"]) == rows["root"])
    assert (good.count(), bad.count()) == (100, 0)
