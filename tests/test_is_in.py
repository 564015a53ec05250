"""Points in areas: where two edges bound an area, and where more or fewer do."""

import random
from collections import Counter

import pytest

from gridloom.operators import search


def test_any_edges(spark):
    """As counted edge by edge, for rectangles, other rings, and edges that don't close; pairs of closed bands aren't shuffled to be counted."""
    rng, edges = random.Random(5), []
    for area in range(60):
        n = rng.choice([1, 2, 3, 4, 5, 9])
        if n == 4:
            (s, t), (w, e) = (sorted(rng.sample(range(-90, 90), 2)) for _ in range(2))
            ring = [(s, w), (s, e), (t, e), (t, w)]
        else:
            ring = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(n)]
        pairs = list(zip(ring, [*ring[1:], ring[0]], strict=True))[: len(ring) - (rng.random() < 0.3)]
        edges += [(area, *a, *b) for a, b in pairs] * rng.choice([1, 1, 1, 2])
    points = [(i, rng.randrange(-95, 95), rng.randrange(-95, 95)) for i in range(300)]
    want = set()
    for p, lat, lon in points:
        for area in range(60):
            own = [e[1:] for e in edges if e[0] == area]
            met = [(a, b, c, d) if a < c else (c, d, a, b) for a, b, c, d in own if min(a, c) <= lat < max(a, c)]
            if sum((lon - b) * (c - a) < (lat - a) * (d - b) for a, b, c, d in met) % 2:
                want.add((p, area))
    df = spark.createDataFrame(edges, "area_id long, lat1 long, lon1 long, lat2 long, lon2 long")
    own = spark.createDataFrame(points, "point_id long, lat long, lon long")
    for cell, width in ((16, 16), (1 << 10, 7), (3, 1 << 20)):
        got = [tuple(r) for r in search.is_in(own, df, cell, width).collect()]
        assert len(got) == len(want) and set(got) == want
    plan = search.is_in(own, df, 16, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # not an aggregate over all pairs


def _plans(plan):
    """A plan as it ran, and those below it."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan
    for x in below:
        yield from _plans(x)


def _rectangle(area, s, n, w, e):
    return [(area, s, w, s, e), (area, s, e, n, e), (area, n, e, n, w), (area, n, w, s, w)]


def test_points_are_met_in_pieces(spark):
    """A join makes a row for an area and a piece of points, not for each of their pairs."""
    rng = random.Random(7)
    points = [(i, rng.randrange(1000), rng.randrange(1000)) for i in range(4000)]
    edges = [x for area in range(20) for x in _rectangle(area, -area, 1000 + area, -area, 1000 + area)]
    own = spark.createDataFrame(points, "point_id long, lat long, lon long")
    run = search.is_in(own, spark.createDataFrame(edges, "area_id long, lat1 long, lon1 long, lat2 long, lon2 long"), 256, 512)._jdf.queryExecution()
    assert run.toRdd().count() == 4000 * 20
    joined = [p.metrics().apply("numOutputRows").value() for p in _plans(run.executedPlan()) if p.nodeName().endswith("Join") and p.metrics().contains("numOutputRows")]
    assert 0 < sum(joined) < 4000 * 20 / 8


@pytest.mark.parametrize("sizes", [{}, {"PIECE": 3, "MOST_PIECES": 2, "MOST_PAIRS": 4}])
def test_dense_cells(spark, monkeypatch, sizes):
    """Many points in one place and on borders, some twice or without a place, and many areas over them; dense cells are divided."""
    for k, v in sizes.items():
        monkeypatch.setattr(search, k, v)
    places = [(5, 5)] * 300 + [(a, b) for a in range(-9, 10) for b in range(-9, 10)]
    points = [(i // 2 if i < 10 else i, *at) for i, at in enumerate(places)]
    boxes = {area: (-(area % 7), area % 5 + 1, -(area % 4), area % 6 + 1) for area in range(40)}
    want = Counter((p, area) for p, lat, lon in points for area, (s, n, w, e) in boxes.items() if s <= lat < n and w <= lon < e)
    own = spark.createDataFrame([*points, (9000, None, 1), (9001, 1, None)], "point_id long, lat long, lon long")
    df = spark.createDataFrame([x for area, box in boxes.items() for x in _rectangle(area, *box)], "area_id long, lat1 long, lon1 long, lat2 long, lon2 long")
    for cell, width in ((16, 16), (4, 3)):
        assert Counter(tuple(r) for r in search.is_in(own, df, cell, width).collect()) == want
