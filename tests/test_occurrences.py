import random

from pyspark.sql import functions as F

from plumbline.functions import grading
from plumbline.operators import nearest, occurrences
from plumbline.functions.strict_json import quantity_equal
from plumbline.plans import records
from plumbline.sources import tables


def plain(text, quote):
    at, out = 0, []
    while quote and (at := text.find(quote, at)) >= 0:
        out.append((at, at := at + len(quote)))
    return out


def test_all_quotes_in_all_texts(spark, monkeypatch):
    """Overlapping, nested, repeated and astral quotes, in one block and in many."""
    rng = random.Random(2)
    letters = "aab é\U0001f600\n"
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(120)] + [(500, None), (501, ""), (None, "aaaa")]
    quotes = [(i, "".join(rng.choices(letters, k=rng.randint(1, 4)))) for i in range(40)] + [(90, "aa"), (91, "aa"), (92, ""), (93, None), (90, "aa")]
    frames = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(quotes, "item_id long, quote string")
    want = sorted(((i, j, *s) for i, t in texts for j, q in set(quotes) for s in plain(t or "", q)), key=str)
    for block in (1 << 20, 16):
        monkeypatch.setattr(occurrences, "BLOCK", block)
        assert sorted(map(tuple, occurrences.quote_spans(*frames, "doc_id", "item_id").collect()), key=str) == want
    assert occurrences.quote_spans(frames[0], frames[1].where("false"), "doc_id", "item_id").count() == 0


def test_nearest_boxes_however_far(spark):
    """Boxes a million units apart, images with one box, and ties, against all pairs."""
    rng = random.Random(4)
    rows = []
    for image in range(12):
        for k in range(image % 5):
            x, y = (rng.choice((rng.randrange(100), rng.randrange(10**6))) for _ in "xy")
            rows.append((f"i{image}", len(rows), f"E{len(rows)}", x, y, x + rng.randint(0, 9), y + rng.randint(0, 9)))
    boxes = spark.createDataFrame(rows, "image string, idx long, alias string, x0 long, y0 long, x1 long, y1 long")
    gap = lambda a, b, c, d: max(c - b, a - d, 0)
    want = set()
    for a in rows:
        d = {b[1]: gap(a[3], a[5], b[3], b[5]) ** 2 + gap(a[4], a[6], b[4], b[6]) ** 2 for b in rows if b[0] == a[0] and b[1] != a[1]}
        if d:
            least = min(d.values())
            first = min(i for i, x in d.items() if x == least)
            want.add((a[0], a[1], least, sum(x == least for x in d.values()), first, f"E{first}"))
    assert {tuple(r) for r in nearest.nearest(boxes, boxes, nearest.squared).collect()} == want


def _all_pairs(rows):
    """(image, a, b, d2) of all ordered pairs of rows with another idx."""
    gap = lambda a, b, c, d: max(c - b, a - d, 0)
    return [(a[0], a[1], b[1], gap(a[3], a[5], b[3], b[5]) ** 2 + gap(a[4], a[6], b[4], b[6]) ** 2) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1]]


def test_boxes_within_reach_meet_as_classes_in_many_tasks(spark, monkeypatch):
    """Piles of equal boxes, larger than the members that stay together, against all pairs; the tasks grow with the classes, however few their bytes."""
    monkeypatch.setattr(nearest, "MEMBERS", 4)
    monkeypatch.setattr(nearest, "PIECE", 10)
    rng = random.Random(5)
    rows = []
    for k in range(160):
        x, y = (10, 10) if k < 30 else (rng.randrange(300), rng.randrange(0, 300, 20))
        rows.append((f"i{k % 3}", k, f"E{k}", x, y, x + 5, y + 5))
    boxes = spark.createDataFrame(rows, "image string, idx long, alias string, x0 long, y0 long, x1 long, y1 long")
    found = nearest.within(boxes, 50)
    assert sorted(map(tuple, found.collect())) == sorted(p for p in _all_pairs(rows) if p[3] <= 2500)
    assert found.rdd.getNumPartitions() >= 10


def test_every_pair_of_an_image_meets_in_blocks(spark, monkeypatch):
    """However far apart: piles of equal boxes, an idx that occurs twice, and images of one box, in many pieces and tasks."""
    monkeypatch.setattr(nearest, "MEMBERS", 4)
    monkeypatch.setattr(nearest, "PIECE", 10)
    monkeypatch.setattr(nearest, "BLOCKS", 2)
    rng = random.Random(6)
    rows = []
    for k in range(160):
        x, y = (10, 10) if k < 30 else (rng.randrange(10**6), rng.randrange(300))
        rows.append((f"i{k % 3}" if k < 150 else f"alone{k}", k, f"E{k}", x, y, x + 5, y + 5))
    rows += [rows[0], (*rows[1][:3], 7, 7, 9, 9)]
    boxes = spark.createDataFrame(rows, "image string, idx long, alias string, x0 long, y0 long, x1 long, y1 long")
    found = nearest.within(boxes)
    assert sorted(map(tuple, found.collect())) == sorted(_all_pairs(rows))
    assert found.rdd.getNumPartitions() > sum(r[0] == "i0" for r in rows) ** 2 * 3 // 250


def test_distances_of_boxes_have_no_limit(spark):
    """The query gives each box with every other of its image."""
    boxes = tables.boxes(spark, "/root/testdata/sf0.001")
    found = records.f30_bbox_distance(spark, "/root/testdata/sf0.001")
    assert found.count() == boxes.groupBy("image").count().selectExpr("sum(count * (count - 1)) AS n").first().n
    assert found.where("d2 > 2500").count() > 0


def test_nearest_among_copies_compares_classes(spark, monkeypatch):
    """Piles of equal boxes and an idx that occurs twice: ties count every copy but the anchor's own rows, yet an anchor meets a class once."""
    met, pairs = [], nearest.near_pairs
    monkeypatch.setattr(nearest, "near_pairs", lambda *args: met.append(pairs(*args)) or met[-1])
    rows = [("i", k, f"E{k}", x, 0, x + 5, 5) for k, x in enumerate([0] * 40 + [100] + [300, 300] + [5000])] + [("i", 40, "E40", 300, 0, 305, 5)]
    boxes = spark.createDataFrame(rows, "image string, idx long, alias string, x0 long, y0 long, x1 long, y1 long")
    want, d = {}, _all_pairs(list(dict.fromkeys(rows)))
    for a in {r[1] for r in rows}:
        least = min(p[3] for p in d if p[1] == a)
        ties = [p[2] for p in d if p[1] == a and p[3] == least]
        want[a] = (least, len(ties), min(ties))
    assert {r.anchor: (r.d, r.ties, r.idx) for r in nearest.nearest(boxes, boxes, nearest.squared).collect()} == want
    assert met[0].count() < 2 * len(rows)


def test_grades(spark):
    rows = [
        ("choice", '{"answer":" B "}', ["B", "b"], 1), ("choice", '{"answer":"BB"}', ["B"], 0), ("choice", '{"answer":["B"]}', ["B"], 0), ("exact", "nothing", ["x"], 0), ("exact", '{"answer":7}', ["7"], 0),
        ("choice_set", '{"answer":["A"," B","A"]}', ["B", "A"], 1), ("choice_set", '{"answer":["A"]}', ["B", "A"], 0), ("choice_set", '{"answer":["A","B","C"]}', ["B", "A"], 0), ("choice_set", '{"answer":["A","B",1]}', ["B", "A"], 0),
        ("choice_set", '{"answer":"A"}', ["A"], 0), ("quantity", '{"answer":"2000 g"}', ["2 kg"], 1), ("quantity", '{"answer":"2001 g"}', ["2 kg"], 0), ("quantity", '{"answer":2}', ["2 kg"], 0), ("human", '{"answer":"A"}', ["A"], None), ("human", None, ["A"], None), ("choice", None, ["A"], 0),
    ]
    df = spark.createDataFrame(rows, "kind string, response string, accepted array<string>, want int")
    answer = grading.answer_of(F.col("response"))
    same = quantity_equal({"g": "1/1000", "kg": "1"}, "0")(grading.text(answer), F.get("accepted", F.lit(0)))
    assert [r.g for r in df.select(grading.grade(F.col("kind"), answer, F.col("accepted"), same).alias("g")).collect()] == [r[3] for r in rows]
