"""Look-back operators against plain loops, over short windows, windows longer than a grain, and windows without end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import temporal as O
from tidemark.plans.ast import UNBOUNDED

WINDOWS = [0, 3, 11, 40, UNBOUNDED]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    ts, points, events = -20, [], []
    for tp in range(260):
        ts += rng.choice([0, 0, 1, 1, 2, 9])
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        events.append((key, tp, ts, rng.choice([None, 1, 2, 3, 5]), rng.random() < 0.3)) if rng.random() < 0.6 else points.append((key, tp, ts, f"p{tp}"))
    return points, events, spark.createDataFrame(points, "u string, k long, t long, name string").cache(), spark.createDataFrame(events, "u string, tp long, ts long, v long, odd boolean").cache()


def inside(p: tuple, events: list[tuple], w: int) -> list[tuple]:
    return [e for e in events if p[0] is not None and e[0] == p[0] and e[1] <= p[1] and p[2] - e[2] <= w]


@pytest.mark.parametrize("grain", [UNBOUNDED, 10])
def test_look_back(rows, grain: int) -> None:
    points, events, p, e = rows
    looks = [x for i, w in enumerate(WINDOWS) for x in (O.Look(f"last{i}", F.col("odd"), w), O.Look(f"any{i}", F.lit(True), w), O.Look(f"n{i}", ~F.col("odd"), w, True), O.Look(f"sum{i}", F.col("odd"), w, True, F.col("v")))]
    bounded = [x for x in looks if x.w < UNBOUNDED]
    for some in (looks, bounded, [x for x in bounded if not x.total], bounded[2:3]):
        got = {r["k"]: r for r in O.look_back(p, e, ["u"], some, grain).collect()}
        assert sorted(got) == [x[1] for x in points]
        for x in points:
            r = got[x[1]]
            assert (r["u"], r["t"], r["name"]) == (x[0], x[2], x[3])
            for look in some:
                near = [y for y in inside(x, events, look.w) if look.out.startswith("any") or y[4] == (not look.out.startswith("n"))]
                if look.total:
                    want = len(near) if look.out.startswith("n") else sum(y[3] or 0 for y in near)
                    assert int(r[look.out]) == want, (look.out, x)
                else:
                    assert (tuple(r[look.out]) if r[look.out] else None) == (near[-1][1:3] if near else None), (look.out, x)


@pytest.mark.parametrize("grain", [UNBOUNDED, 10])
def test_distinct_since_and_last_pairs(rows, grain: int) -> None:
    points, events, p, e = rows
    for w in WINDOWS:
        distinct = {r["k"]: (r["n"], int(r["s"])) for r in O.window_distinct(O.window_distinct(p, e, ["u"], w, "v", "n", grain), e, ["u"], w, "v", "s", grain, F.col("v")).collect()}
        held = {r["k"]: r["h"] for r in O.since(p, e.where("odd"), e.where("not odd and v > 2"), ["u"], w, "h", grain).collect()}
        for x in points:
            near = inside(x, events, w)
            values = {y[3] for y in near} - {None}
            assert distinct[x[1]] == (len(values), sum(values)), (w, x)
            anchors = [y for y in near if y[4]]
            assert held[x[1]] == (bool(anchors) and not any(y[1] > anchors[-1][1] and not y[4] and (y[3] or 0) > 2 for y in near))
        if w < UNBOUNDED:
            pairs = O.last_join(p, e.select(F.col("u").alias("eu"), "tp", "ts", "v").where("v is not null"), [("u", "eu")], w, "v")
            got = sorted((r["k"], r["v"], r["tp"]) for r in pairs.collect())
            want = sorted((x[1], v, max(y[1] for y in inside(x, events, w) if y[3] == v)) for x in points for v in {y[3] for y in inside(x, events, w)} - {None})
            assert got == want


def test_grain() -> None:
    assert O.grain_of(None, None, 0) == UNBOUNDED and O.grain_of(0, 999, 10) == 1000 * O.BUCKET_ROWS // 10 and O.grain_of(5, 5, 1 << 30) == 1
