"""Temporal operators over DataFrames: as-of lookups, sliding counts and sums, range joins, since.

Windows look back ``w`` ticks, both ends included, from a point (k, t): events with ``tp <= k`` and ``t - ts <= w``. Rows are dealt out by key
and time bucket. Where a window is short, a bucket is as long as it: what lies in a window is in the point's own bucket or the one
before, and one shuffle does. Where it is longer than the *grain*, the time in which the whole stream has some ``BUCKET_ROWS`` rows, a
bucket is a grain, and what lies before a bucket comes from one row of totals for each bucket. So neither a hot key nor no key at
all, nor a window as long as the stream, puts a stream into one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import latest
from ..plans.ast import UNBOUNDED


#: Rows of the whole stream that a bucket holds on average where windows are longer.
BUCKET_ROWS = 1 << 20


def grain_of(lo: int | None, hi: int | None, n: int) -> int:
    """The grain of ``n`` rows stamped from ``lo`` to ``hi``."""
    return UNBOUNDED if not n or lo is None else max(1, (hi - lo + 1) * BUCKET_ROWS // n)


def bucket(ts: Column, w: int) -> Column:
    """The time bucket of a stamp; windows of no length still need buckets of one tick."""
    return F.lit(0).cast("long") if w >= UNBOUNDED // 2 else F.floor(ts / F.lit(max(1, w))).cast("long")


def _both(ts: Column, w: int) -> Column:
    """The buckets in whose windows an event can lie."""
    return F.array(bucket(ts, w)) if w >= UNBOUNDED // 2 else F.array(bucket(ts, w), bucket(ts, w) + 1)


@dataclass(frozen=True)
class Look:
    """What to look for in the window before each point: the last event where ``match`` holds (``last``), or how many there are or the sum of their ``value`` (``total``)."""

    out: str
    match: Column
    w: int
    total: bool = False
    value: Column | None = None


def look_back(points: DataFrame, events: DataFrame, keys: list[str], looks: list[Look], grain: int = UNBOUNDED) -> DataFrame:
    """``points`` (keys, k, t and others) with a column for each look, in one pass over the events (keys, tp, ts and what the looks read).

    A last event is a (tp, ts) or null, a total a decimal(38,0). Null keys match nothing, and are no key of their own. Stamps may be tied: an event after the point
    at the same stamp doesn't count.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys], F.lit(True))
    longest = max(x.w for x in looks)
    short = longest <= grain
    length = longest if short else grain
    own = [c for c in points.columns if c not in keys]
    lasts, totals = [x for x in looks if not x.total], [x for x in looks if x.total]
    amount = [F.when(x.match, F.coalesce(x.value, F.lit(0)) if x.value is not None else F.lit(1)).cast("decimal(38,0)") for x in totals]
    place = F.struct(F.col("tp").alias("tp"), F.col("ts").alias("ts"))
    values = [F.when(x.match, place).alias(f"__l{i}") for i, x in enumerate(lasts)] + [a.alias(f"__a{i}") for i, a in enumerate(amount)]
    names = [f"__l{i}" for i in range(len(lasts))] + [f"__a{i}" for i in range(len(totals))]
    # Points whose keys are null are spread: they take part in nothing
    home = F.when(known, bucket(F.col("t"), length)).otherwise(-1 - F.pmod(F.xxhash64("k"), F.lit(4096)))
    left = points.select(*keys, home.alias("__b"), F.col("k").alias("__tp"), F.col("t").alias("__ts"), F.lit(1).alias("__side"), F.struct(*own).alias("__point"))
    where = reduce(lambda a, b: a | b, [x.match for x in looks])
    right = events.where(known & where).select(*keys, (F.explode(_both(F.col("ts"), length)) if short else bucket(F.col("ts"), length)).alias("__b"), F.col("tp").alias("__tp"), F.col("ts").alias("__ts"), F.lit(0).alias("__side"), *values)
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "__b").orderBy("__ts", "__tp", "__side")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    if not short:
        return _carried(points, both, keys, own, known, lasts, totals, names, length)
    found = both.withColumns({f"{n}_": latest(F.col(n)).over(upto) if n[2] == "l" else F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in names})
    for i, x in enumerate(totals):
        if x.w < UNBOUNDED // 2:
            early = Window.partitionBy(*keys, "__b").orderBy("__ts").rangeBetween(Window.unboundedPreceding, -(x.w + 1))
            found = found.withColumn(f"__a{i}_", F.col(f"__a{i}_") - F.coalesce(F.sum(f"__a{i}").over(early), F.lit(0)))
    found = found.where("__side = 1")
    return found.select(*keys, "__point.*", *[_inside(known, F.col(f"__l{i}_"), x.w).alias(x.out) for i, x in enumerate(lasts)], *[F.when(known, F.col(f"__a{i}_")).otherwise(F.lit(0)).cast("decimal(38,0)").alias(x.out) for i, x in enumerate(totals)]).select(*points.columns, *[x.out for x in looks])


def _inside(known: Column, last: Column, w: int) -> Column:
    return F.when(known & (F.col("__ts") - last["ts"] <= F.lit(w)) if w < UNBOUNDED else known, last)


def _carried(points: DataFrame, both: DataFrame, keys: list[str], own: list[str], known: Column, lasts: list[Look], totals: list[Look], names: list[str], length: int) -> DataFrame:
    """The same for windows longer than a bucket: sums and last events up to each row within its bucket, and one row for each bucket with those of all before it.

    A total is the difference of two running totals, at the point and just before its window; for the second, each point has one more
    row for each length of window, and its rows meet at the end.
    """
    edges = sorted({x.w for x in totals if x.w < UNBOUNDED // 2})
    if edges:
        marked = both.withColumn("__side", F.when(F.col("__side") == 1, F.lit(2)).otherwise(F.col("__side"))).withColumn("__w", F.lit(None).cast("long"))
        start = F.explode(F.array(*[F.lit(w).cast("long") for w in edges]))
        early = both.where("__side = 1").select(*keys, "__point", F.col("__ts").alias("__t"), "__b", start.alias("__w"))
        at = F.col("__t") - F.col("__w") - 1
        early = early.select(*keys, "__point", F.when(known, bucket(at, length)).otherwise(F.col("__b")).alias("__b"), F.lit(None).cast("long").alias("__tp"), at.alias("__ts"), F.lit(3).alias("__side"), "__w")
        both = marked.unionByName(early, allowMissingColumns=True)
    # At one stamp events come in order with points; an edge's row is behind all events at its stamp
    order = Window.partitionBy(*keys, "__b").orderBy("__ts", F.col("__tp").asc_nulls_last(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    ran = both.withColumns({f"{n}_": latest(F.col(n)).over(order) if n[2] == "l" else F.coalesce(F.sum(n).over(order), F.lit(0)).cast("decimal(38,0)") for n in names})
    sums = both.groupBy(*keys, "__b").agg(*[F.max(n).alias(n) if n[2] == "l" else F.coalesce(F.sum(n), F.lit(0)).cast("decimal(38,0)").alias(n) for n in names])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.where(known).select(*[F.col(c).alias(f"__c_{c}") for c in keys], F.col("__b").alias("__cb"), *[(latest(F.col(n)) if n[2] == "l" else F.sum(n)).over(before).alias(f"{n}c") for n in names])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__c_{c}") for c in keys], F.col("__b") == F.col("__cb"))
    rows = ran.where(F.col("__side") > 0).join(carry, on, "left").drop(*[f"__c_{c}" for c in keys], "__cb")
    rows = rows.withColumns({f"{n}_": F.coalesce(F.col(f"{n}_"), F.col(f"{n}c")) if n[2] == "l" else F.col(f"{n}_") + F.coalesce(F.col(f"{n}c"), F.lit(0)) for n in names})
    rows = rows.withColumns({f"__l{i}_": _inside(known, F.col(f"__l{i}_"), x.w) for i, x in enumerate(lasts)})
    if edges:
        rows = rows.withColumn("__point", F.struct("__point.*", *keys)).groupBy("__point").agg(
            *[F.max(F.when(F.col("__side") == 2, F.col(f"__l{i}_"))).alias(f"__l{i}_") for i in range(len(lasts))],
            *[(F.sum(F.when(F.col("__side") == 2, F.col(f"__a{i}_"))) - F.coalesce(F.sum(F.when((F.col("__side") == 3) & (F.col("__w") == x.w), F.col(f"__a{i}_"))), F.lit(0))).alias(f"__a{i}_") for i, x in enumerate(totals)],
        ).select("__point.*", *[f"{n}_" for n in names])
    else:
        rows = rows.select(*keys, "__point.*", *[f"{n}_" for n in names])
    outs = [F.col(f"__l{i}_").alias(x.out) for i, x in enumerate(lasts)] + [F.when(known, F.col(f"__a{i}_")).otherwise(F.lit(0)).cast("decimal(38,0)").alias(x.out) for i, x in enumerate(totals)]
    return rows.select(*points.columns, *outs)


def last_match(points: DataFrame, events: DataFrame, keys: list[str], w: int, out: str, grain: int = UNBOUNDED) -> DataFrame:
    """As-of join: each point with ``out``, the (tp, ts) of the last event of its keys in its window, null if there is none.

    points: keys, k, t and others; events: keys, tp, ts. Keys that are null match nothing.
    """
    return look_back(points, events, keys, [Look(out, F.lit(True), w)], grain)


def window_total(points: DataFrame, events: DataFrame, keys: list[str], w: int, out: str, value: str | None = None, grain: int = UNBOUNDED) -> DataFrame:
    """Each point with ``out``: how many events of its keys are in its window, or the sum of their ``value`` as decimal(38,0).

    Stamps may be tied: an event after the point at the same stamp doesn't count. Null keys count nothing.
    """
    got = look_back(points, events, keys, [Look(out, F.lit(True), w, True, None if value is None else F.col(value).cast("decimal(38,0)"))], grain)
    return got if value is not None else got.withColumn(out, F.col(out).cast("long"))


def range_join(points: DataFrame, events: DataFrame, on: list[tuple[str, str]], w: int, how: Column | None = None) -> DataFrame:
    """All pairs of a point (k, t) and an event (tp, ts) in its window that agree in ``on``; ``how`` narrows the pairs further.

    The bucket is one more equality, so the join is a hash or merge join even without keys.
    """
    p = points.withColumn("__pb", bucket(F.col("t"), w))
    e = events.withColumn("__eb", F.explode(_both(F.col("ts"), w)))
    cond = F.col("__pb") == F.col("__eb")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    cond = cond & (F.col("tp") <= F.col("k")) & (F.col("ts") <= F.col("t"))
    if w < UNBOUNDED:
        cond = cond & (F.col("t") - F.col("ts") <= F.lit(w))
    return p.join(e, cond & how if how is not None else cond).drop("__pb", "__eb")


def last_join(points: DataFrame, events: DataFrame, on: list[tuple[str, str]], w: int, each: str) -> DataFrame:
    """Pairs of a point and the last event in its window for each value of the events' column ``each``: no pair twice, and none that another one implies."""
    keys = [b for _, b in on]
    e = events.withColumn("__eb", F.explode(_both(F.col("ts"), w)))
    following = F.lead("tp").over(Window.partitionBy(each, *keys, "__eb").orderBy("tp"))
    e = e.withColumn("__next", F.coalesce(following, F.lit(UNBOUNDED)))
    cond = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in on], F.col("__pb") == F.col("__eb"))
    cond = cond & (F.col("tp") <= F.col("k")) & (F.col("k") < F.col("__next"))
    if w < UNBOUNDED:
        cond = cond & (F.col("t") - F.col("ts") <= F.lit(w))
    return points.withColumn("__pb", bucket(F.col("t"), w)).join(e, cond).drop("__pb", "__eb", "__next")


def formerly(points: DataFrame, events: DataFrame, keys: list[str], w: int, out: str, grain: int = UNBOUNDED) -> DataFrame:
    """Each point with ``out``: whether an event of its keys lies in its window, its own place included."""
    return last_match(points, events, keys, w, out, grain).withColumn(out, F.col(out).isNotNull())


def since(points: DataFrame, anchors: DataFrame, breaks: DataFrame, keys: list[str], w: int, out: str, grain: int = UNBOUNDED) -> DataFrame:
    """Each point with ``out``: whether an anchor lies in its window with no break after it.

    The last anchor is the best one. A break at the anchor's own place does no harm. Breaks are looked for in the window alone,
    since one that follows the anchor is in it too. Both are found in one pass.
    """
    both = anchors.select(*keys, "tp", "ts", F.lit(True).alias("__anchor")).unionByName(breaks.select(*keys, "tp", "ts", F.lit(False).alias("__anchor")))
    found = look_back(points, both, keys, [Look("__a", F.col("__anchor"), w), Look("__v", ~F.col("__anchor"), w)], grain)
    return found.withColumn(out, unbroken(F.col("__a"), F.col("__v"))).drop("__a", "__v")


def unbroken(anchor: Column, broken: Column) -> Column:
    """Whether there is a last anchor and no break after it."""
    return anchor.isNotNull() & (broken.isNull() | (broken["tp"] <= anchor["tp"]))


def previous(events: DataFrame, within: list[str], w: int, holds: Column, out: str) -> DataFrame:
    """Each event with ``out``: whether ``holds`` was true of the event before it (of the same ``within``), at most ``w`` ticks ago."""
    order = Window.partitionBy(*within).orderBy("tp")
    near = F.col("ts") - F.lag("ts").over(order) <= F.lit(w) if w < UNBOUNDED else F.lit(True)
    return events.withColumn(out, F.coalesce(F.lag(holds).over(order) & near, F.lit(False)))


def window_distinct(points: DataFrame, events: DataFrame, keys: list[str], w: int, value: str, out: str, grain: int = UNBOUNDED, amount: Column | None = None) -> DataFrame:
    """Each point with ``out``: how many different values of ``value`` the events of its keys in its window have, or the sum of an ``amount`` of each.

    An event stands for its value from its own place up to the next one of that value, or until it leaves the window. So it adds to a running total
    there and takes off what it added where it ends; the total at a point is the answer, and no pair of a point and an event is made.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys], F.lit(True))
    short = w <= grain
    length = w if short else grain
    one = F.lit(1) if amount is None else amount
    e = events.where(known & F.col(value).isNotNull()).select(*keys, "tp", "ts", F.col(value).alias("__value"), one.cast("decimal(38,0)").alias("__one"))
    e = e.withColumn("__b", F.explode(_both(F.col("ts"), length)) if short else bucket(F.col("ts"), length))
    place = F.struct(F.col("ts").alias("ts"), F.col("tp").alias("tp"))
    e = e.withColumn("__next", F.lead(place).over(Window.partitionBy(*keys, "__value", "__b").orderBy("tp")))
    if not short:
        # The last of a value in its bucket is followed by the first one in a later bucket
        firsts = e.groupBy(*keys, "__value", "__b").agg(F.min(place).alias("__first"))
        firsts = firsts.withColumn("__later", F.lead("__first").over(Window.partitionBy(*keys, "__value").orderBy("__b"))).drop("__first")
        e = e.join(firsts, [*keys, "__value", "__b"]).withColumn("__next", F.coalesce("__next", "__later"))
    leaves = F.struct((F.col("ts") + w + 1).alias("ts"), F.lit(-1).cast("long").alias("tp")) if w < UNBOUNDED // 2 else F.lit(None).cast("struct<ts:bigint,tp:bigint>")
    end = F.least(F.col("__next"), leaves)  # the earlier one by stamp; of nulls the other
    steps = e.select(*keys, "__b", F.explode(F.array(F.struct(place.alias("at"), F.col("__one").alias("d")), F.struct(end.alias("at"), (-F.col("__one")).alias("d")))).alias("__s")).where("__s.at is not null")
    steps = steps.select(*keys, "__b", F.col("__s.at.tp").alias("tp"), F.col("__s.at.ts").alias("ts"), F.col("__s.d").alias("__d"))
    if not short:
        got = look_back(points, steps.drop("__b"), keys, [Look(out, F.lit(True), UNBOUNDED, True, F.col("__d"))], grain)
    else:
        own = [c for c in points.columns if c not in keys]
        home = F.when(known, bucket(F.col("t"), length)).otherwise(-1 - F.pmod(F.xxhash64("k"), F.lit(4096)))
        left = points.select(*keys, home.alias("__b"), F.col("k").alias("tp"), F.col("t").alias("ts"), F.struct(*own).alias("__point"))
        both = left.unionByName(steps, allowMissingColumns=True)
        order = Window.partitionBy(*keys, "__b").orderBy("ts", "tp", F.col("__point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn(out, F.coalesce(F.sum("__d").over(order), F.lit(0))).where("__point is not null").select(*keys, "__point.*", F.when(known, F.col(out)).otherwise(F.lit(0)).alias(out)).select(*points.columns, out)
    return got if amount is not None else got.withColumn(out, F.col(out).cast("long"))
