"""Lattices of revisions against searches over dictionaries."""

import random

import pytest

from plumbline.operators import revisions


def reaches(links, a, b):
    seen, todo = set(), list(links.get(a, ()))
    while todo:
        x = todo.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            todo += links.get(x, ())
    return False


def plain(of):
    """``of``: [(rev, parents)]"""
    revs = [r for r, _ in of]
    if len(revs) != len(set(revs)):
        return None, "revision_twice"
    links = {r: [p for p in ps if p in revs] for r, ps in of}
    heads = [r for r in revs if not any(r in ps for ps in links.values())]
    if any(reaches(links, r, r) for r in revs):
        return None, "cycle"
    if len(heads) > 1:
        return None, "fork"
    return heads[0], "unknown_parent" if any(p not in revs for _, ps in of for p in ps) else None


def lattice(rng, n):
    """A random order by numbers, sometimes with a link back, a parent that isn't there, or a revision twice."""
    of = [(i, sorted(rng.sample(range(i), min(i, rng.choice((1, 1, 1, 2)))))) for i in range(n)]
    if rng.random() < 0.5 and n > 1:  # a single head
        heads = [r for r, _ in of if not any(r in ps for _, ps in of)]
        of.append((n, heads))
    draw = rng.random()
    if draw < 0.2:
        k, top = rng.randrange(len(of)), rng.randrange(len(of))
        of[k] = (of[k][0], of[k][1] + [top])
    elif draw < 0.3:
        of[0] = (0, [999])
    elif draw < 0.35:
        of.append(of[-1])
    return of


@pytest.mark.parametrize("seed", range(3))
def test_random_lattices(spark, seed):
    rng = random.Random(seed)
    objects = {o: lattice(rng, rng.randint(1, 12)) for o in range(150)}
    rows = [(o, r, ps) for o, of in objects.items() for r, ps in of]
    rng.shuffle(rows)
    got = {r.object: (r.active, r.code) for r in revisions.resolve(spark.createDataFrame(rows, "object long, rev long, parents array<long>")).collect()}
    assert got == {o: plain(of) for o, of in objects.items()}
    assert {c for _, c in got.values()} == {None, "cycle", "fork", "unknown_parent", "revision_twice"}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8])
def test_cycles_of_every_length(spark, n):
    rows = [(1, k, [(k + 1) % n]) for k in range(n)] + [(1, 100, [0]), (2, 0, []), (2, 1, [0])]
    got = {r.object: (r.active, r.code) for r in revisions.resolve(spark.createDataFrame(rows, "object long, rev long, parents array<long>")).collect()}
    assert got == {1: (None, "cycle"), 2: (1, None)}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(1, k, [k - 1] if k else []) for k in range(600)]
    rounds = []
    write = revisions.written
    monkeypatch.setattr(revisions, "written", lambda df, name: rounds.append(name) or write(df, name))
    (r,) = revisions.resolve(spark.createDataFrame(rows, "object long, rev long, parents array<long>")).collect()
    assert (r.active, r.code) == (599, None) and len(rounds) < 16


def test_bindings(spark):
    active = spark.createDataFrame([(1, 5, None), (2, None, "fork")], "object long, active long, code string")
    rows = [("o1", "a1", 1, 5), ("o2", "a2", 1, 4), ("o3", "a3", 2, 1), ("o4", "a4", 9, 1), ("o5", "a5", 1, 5), ("o5", "a6", 1, 5), ("o7", "a7", 1, 5), ("o8", "a7", 1, 5)]
    got = sorted(tuple(r) for r in revisions.binding_issues(spark.createDataFrame(rows, "observation string, anchor string, object long, rev long"), active).collect())
    assert got == [
        ("o2", "a2", "stale_version"), ("o3", "a3", "no_active_version"), ("o4", "a4", "no_active_version"), ("o5", "a5", "observation_twice"), ("o5", "a6", "observation_twice"), ("o7", "a7", "anchor_twice"), ("o8", "a7", "anchor_twice"),
    ]
