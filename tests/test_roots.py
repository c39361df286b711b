import hashlib
import random

from pyspark.sql import functions as F

from plumbline.operators import roots


def frame(spark, records, parts=3):
    return spark.createDataFrame(list(records.items()), "id long, digest string").repartition(parts)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_root(records, depth=2):
    level = {}
    for i, d in records.items():
        level.setdefault(sha(f"={i}")[:depth], []).append(sha(d))
    level = {p: sha(":".join(str(sum(int(h[8 * k : 8 * k + 8], 16) for h in hs)) for k in range(8)) + f":{len(hs)}") for p, hs in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for p, h in level.items():
            up.setdefault(p[:d], []).append(p[d] + h)
        level = {p: sha("".join(sorted(hs))) for p, hs in up.items()}
    return level[""]


def test_roots_depend_on_records_alone(spark):
    records = {i: sha(str(i)) for i in range(700)}
    found = {roots.snapshot(frame(spark, records, parts)).root() for parts in (1, 2, 9)}
    assert found == {plain_root(records)}
    assert roots.snapshot(frame(spark, records | {5: "other"})).root() not in found


def test_changes_are_those_of_a_dictionary(spark):
    rng = random.Random(2)
    before = {i: sha(str(i)) for i in range(900)}
    for n in (0, 1, 40):
        after = dict(before)
        for i in rng.sample(range(900), n):
            kind = rng.randrange(3)
            if kind == 0:
                after.pop(i)
            after[i + 5000 * (kind == 2)] = sha(f"new {i}") if kind else after.pop(i, None) or sha(f"back {i}")
        a, b = (roots.snapshot(frame(spark, r)) for r in (before, after))
        want = {(i, "removed") for i in before.keys() - after.keys()} | {(i, "added") for i in after.keys() - before.keys()} | {(i, "changed") for i in before.keys() & after.keys() if before[i] != after[i]}
        assert {tuple(r) for r in roots.changes(a, b).collect()} == want and (a.root() == b.root()) == (not want)


def test_below_equal_nodes_nothing_is_read(spark):
    before = {i: sha(str(i)) for i in range(2000)}
    a, b = roots.snapshot(frame(spark, before)), roots.snapshot(frame(spark, before | {77: "x"}))
    (bucket,) = roots.changed_buckets(a, b).collect()
    assert bucket.prefix == sha("=77")[:2]
    plan = roots.changes(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(bucket," in plan[plan.index("PushedFilters") :]


def test_many_changes_are_joined(spark, monkeypatch):
    monkeypatch.setattr(roots, "FEW", 3)
    before = {i: sha(str(i)) for i in range(300)}
    a, b = roots.snapshot(frame(spark, before)), roots.snapshot(frame(spark, {i: "y" for i in before}))
    assert {r.code for r in roots.changes(a, b).collect()} == {"changed"} and roots.changes(a, b).count() == 300


def test_repeated_and_null_ids(spark):
    rows = lambda *r: roots.snapshot(spark.createDataFrame(r, "id long, digest string"))
    a = rows((1, "a"), (1, "a"), (2, "b"), (None, None))
    assert roots.changes(a, rows((None, None), (1, "a"), (2, "b"), (1, "a"))).count() == 0
    got = {tuple(r) for r in roots.changes(a, rows((1, "a"), (2, "b"), (None, "c"), (3, "d"))).collect()}
    assert got == {(1, "changed"), (None, "changed"), (3, "added")}
    empty = roots.snapshot(spark.createDataFrame([], "id long, digest string"))
    assert {tuple(r) for r in roots.changes(empty, rows((4, "x"))).collect()} == {(4, "added")}


def test_volatile_fields_do_not_count(spark):
    df = spark.createDataFrame([(1, '{"b":1,"a":{"y":2,"x":[1]},"at":5}'), (2, '{"a":{"x":[1],"y":2}, "at":6,"b":1}'), (3, '{"a":{"x":[1],"y":2,"at":1},"b":1}'), (4, "[1]"), (5, '{"at":1,"a":1}')], "id int, r string")
    got = {r.id: r.d for r in df.select("id", roots.record_digest(F.col("r"), ("at",)).alias("d")).collect()}
    assert got[1] == got[2] == sha('{"a":{"x":[1],"y":2},"b":1}') and got[3] != got[1] and got[4] is None and got[5] == sha('{"a":1}')
    one = spark.createDataFrame([(1, None, 7)], "b int, a string, at int")
    assert one.select(roots.columns_digest(one, ("at",))).first()[0] == sha('{"a":null,"b":1}')
