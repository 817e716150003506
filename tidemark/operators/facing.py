"""What is highest and what is lowest among all that stands at a point, without a pair of a point and what stands there."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dealt import by_key
from ..plans.ast import UNBOUNDED
from .temporal import BUCKET_ROWS, bucket, last_match

NONE = -(1 << 64)


class Highest:
    """Values by place, some of them gone or not there yet: the highest between two places costs a logarithm."""

    def __init__(self, n: int) -> None:
        self.n, self.tree = n, [NONE] * (2 * n)

    def put(self, i: int, value: int) -> None:
        tree, i = self.tree, i + self.n
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a > b else b

    def between(self, lo: int, hi: int) -> int:
        """The highest from place ``lo`` up to before ``hi``."""
        tree, best, lo, hi = self.tree, NONE, lo + self.n, hi + self.n
        while lo < hi:
            if lo & 1:
                best = max(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = max(best, tree[hi])
            lo >>= 1
            hi >>= 1
        return best


def stands_until(anchors: DataFrame, breaks: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Anchors (keys, tp and others) with ``out``: the place of the first break of their keys after them, or the largest number. Places tell, whatever the stamps."""
    points = anchors.withColumn("k", -F.col("tp") - 1).withColumn("t", F.col("k"))
    back = breaks.select(*keys, (-F.col("tp")).alias("tp"), (-F.col("tp")).alias("ts"))
    found = last_match(points, back, keys, UNBOUNDED, "__v", BUCKET_ROWS)
    return found.withColumn(out, F.coalesce(-F.col("__v.tp"), F.lit(UNBOUNDED))).drop("k", "t", "__v")


def some_higher(points: DataFrame, high: DataFrame, low: DataFrame, windows: tuple[int, int], equal: bool) -> DataFrame:
    """The points (g, k, t) at which some value of ``high`` is higher than some value of ``low``, or equal to it.

    high, low: g, tp, ts, end, value (a long). A row stands at the points of its g from its place up to before the place ``end`` whose windows have its stamp. Rows are dealt out by
    time bucket, as long as the longer window, so a task holds the rows of two windows at a time; each row and point costs a logarithm of their number.
    """
    length = max(windows)

    def side(n: int, df: DataFrame) -> DataFrame:
        at = [bucket(F.col("ts"), length)] if length >= UNBOUNDED // 2 else [bucket(F.col("ts"), length), bucket(F.col("ts"), length) + 1]
        return df.where(F.col("value").isNotNull()).select("g", F.explode(F.array(*at)).alias("b"), "tp", F.lit(n).alias("side"), "ts", "end", "value")

    none = F.lit(None).cast("long")
    own = points.select("g", bucket(F.col("t"), length).alias("b"), F.col("k").alias("tp"), F.lit(2).alias("side"), F.col("t").alias("ts"), none.alias("end"), none.alias("value")).distinct()
    rows = own.unionByName(side(0, high)).unionByName(side(1, low)).withColumn("deal", F.concat_ws("\x1f", "g", "b")).drop("b")

    def work():
        def each(group: Iterator[tuple]) -> Iterator[tuple]:
            held = sorted(group, key=lambda r: (r[1], r[2]))  # by place; what comes with a point stands there already
            stamps = [sorted((r[3], r[1], i) for i, r in enumerate(held) if r[2] == n) for n in (0, 1)]
            if not all(stamps):
                return
            place = {i: at for own in stamps for at, (_, _, i) in enumerate(own)}
            tss = [[s for s, _, _ in own] for own in stamps]
            trees = [Highest(len(own)) for own in stamps]
            ends = sorted((r[4], i) for i, r in enumerate(held) if r[2] < 2 and r[4] <= held[-1][1])
            gone = 0
            for i, (g, tp, n, ts, _, value, _) in enumerate(held):
                while gone < len(ends) and ends[gone][0] <= tp:
                    j = ends[gone][1]
                    trees[held[j][2]].put(place[j], NONE)
                    gone += 1
                if n < 2:
                    trees[n].put(place[i], -value if n else value)
                    continue
                top, bottom = (trees[s].between(bisect_left(tss[s], ts - windows[s]), bisect_right(tss[s], ts)) for s in (0, 1))
                if top != NONE and bottom != NONE and (top > -bottom or equal and top == -bottom):
                    yield g, tp

        return each

    return by_key(rows, "deal", "tp", work, "g string, k long")
