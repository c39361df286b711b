import hashlib
import random

from plumbline.operators import candidates


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def plain(probes, entities, seed):
    out = {}
    for probe, problem, kinds in probes:
        pool = {e for p, e, k, seen in entities if p == problem and seen and (kinds is None or k in kinds)}
        named = {f"E{i + 1}": t for i, t in enumerate(sorted(pool, key=lambda t: (sha(seed, probe, "alias", t), t)))}
        places = {a: i + 1 for i, a in enumerate(sorted(named, key=lambda a: sha(seed, probe, "place", a)))}
        out[probe] = {a: (t, places[a]) for a, t in named.items()}
    return out


def test_random_graphs_and_every_fault(spark):
    rng = random.Random(5)
    entities = [(p, f"n-{p}-{e}", rng.choice("abc"), rng.random() < 0.8) for p in range(20) for e in range(rng.randint(0, 8))]
    probes = [(q, rng.randrange(22), rng.choice((None, ["a"], ["a", "b"], []))) for q in range(80)]
    frames = spark.createDataFrame(probes, "probe long, problem long, kinds array<string>"), spark.createDataFrame(entities, "problem long, entity string, kind string, visual boolean")
    want = candidates.derived(*frames, "s")
    right = plain(probes, entities, "s")
    assert {(r.probe, r.alias): (r.target, r.place) for r in want.collect()} == {(q, a): x for q, m in right.items() for a, x in m.items()}

    key = [(q, a, t) for q, m in right.items() for a, (t, _) in m.items()]
    view = [(q, a, place) for q, m in right.items() for a, (_, place) in m.items()]
    text = {q: "no names here, not even n-1" for q, _, _ in probes}

    def issues(key, view, text):
        rows = candidates.candidate_issues(
            want, spark.createDataFrame(key, "probe long, alias string, target string"), spark.createDataFrame(view, "probe long, alias string, place int"), spark.createDataFrame(list(text.items()), "probe long, text string")
        )
        return {tuple(r) for r in rows.collect()}

    assert issues(key, view, text) == set()
    full = [q for q, m in right.items() if len(m) >= 3][:7]
    a, b, c, d, e, f, g = full
    t = lambda q, x: right[q][x][0]
    key = [x for x in key if x[:2] != (a, "E1")] + [(b, "E9", "stranger")]
    key = [(q, {"E1": "E2", "E2": "E1"}.get(x, x) if q == c else x, n) for q, x, n in key] + [(d, "E1", t(d, "E2"))]
    view = [x for x in view if x[:2] != (e, "E2")] + [(f, "E1", 1)]
    view = [(q, x, 99 if (q, x) == (g, "E3") else place) for q, x, place in view]
    text[g] = f"It is ({t(g, 'E1')}), not {t(g, 'E2')}0."
    got = issues(key, view, text)
    assert got == {
        (a, t(a, "E1"), "lost"), (a, "E1", "not_mapped"), (b, "stranger", "extra"), (b, "E9", "not_shown"), (c, t(c, "E1"), "alias_differs"), (c, t(c, "E2"), "alias_differs"), (d, t(d, "E2"), "alias_differs"),
        (d, "E1", "alias_twice"), (e, "E2", "not_shown"), (f, "E1", "alias_twice"), (g, "E3", "place_differs"), (g, t(g, "E1"), "leak"),
    } | ({(f, "E1", "place_differs")} if right[f]["E1"][1] > 1 else set())
