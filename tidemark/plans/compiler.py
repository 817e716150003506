"""Conditions to DataFrame plans.

Every condition is compiled as a function of a context: a frame of points at which it is asked, with columns ``g`` (pin), ``d`` (the
decision), ``k`` and ``t`` (the point's number and stamp), ``r0``... (values of the decision) and ``v_x`` (bound variables). The first context
is all decisions at once. A condition gives the context's rows that satisfy it, with the variables that it binds. Before
going down, a context is narrowed to what the condition reads and made distinct, so a part that doesn't depend on the decision is worked
out once for each point.

Where a condition just looks for events by equality, windows over key and time bucket do the work; other parts go by range joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import LONG_MAX, LONG_MIN, as_long, long_tag, saturating, saturating_sum, tag
from ..operators import facing
from ..operators import temporal as O
from ..sources.events import Trace
from . import analysis as N
from . import ast as A

NONE = "<none>"


@dataclass
class Found:
    """Rows of a condition, and its variables: True if every row binds them."""

    df: DataFrame
    bound: dict[str, bool]


class Compiler:
    """Compiles conditions over one trace. ``rate``: ticks a second. ``pins``: logged fields by which the stream is partitioned.

    The trace's numbers ``tp`` must be dense within each pin; ``id`` names an event in the whole trace.
    """

    def __init__(self, trace: Trace, rate: int = 1, pins: tuple[str, ...] = (), fast: bool = True, grain: int | None = None) -> None:
        self.trace, self.rate, self.fast = trace, max(1, rate), fast
        self._grain = grain
        df = trace.df
        if "id" not in df.columns:
            df = df.withColumn("id", F.col("tp"))
        g = F.concat_ws("\x1f", *[F.coalesce(trace.logged(p), F.lit(NONE)) for p in pins]) if pins else F.lit("")
        self.events = df.withColumn("g", g) if "g" not in df.columns else df
        self.pinned = bool(pins)
        self.depth = 0

    def ticks(self, window: int) -> int:
        return A.UNBOUNDED if window == A.UNBOUNDED else min(A.UNBOUNDED, window * self.rate)

    @property
    def grain(self) -> int:
        """The time in which the trace has ``BUCKET_ROWS`` rows, from one look at its stamps (at windows above which buckets are cut finer)."""
        if self._grain is None:
            self._grain = self.trace.grain()
        return self._grain

    # Parts of the trace
    def decisions(self, condition: Any, where: Column) -> DataFrame:
        """The first context: the decisions with the values that the condition reads of them."""
        cols = [self._resolved(r).alias(f"r{i}") for i, r in enumerate(N.refs(condition))]
        return self.events.where(where).select("g", F.col("id").alias("d"), F.col("tp").alias("k"), F.col("ts").alias("t"), *cols)

    def _resolved(self, ref: A.Ref) -> Column:
        return self.trace.term(ref.root, ref.path)

    def matching(self, pred: A.Pred) -> Column:
        """Whether an event is one that the predicate may match: by its kind, literals and the fields that must be there."""
        out = (F.col("ns") == pred.ns) & (F.col("action") == pred.action) & (F.col("kind") == pred.kind)
        for path, term in pred.args:
            value = self.trace.logged(path)
            out = out & (F.coalesce(value == F.lit(tag(term.value)), F.lit(False)) if isinstance(term, A.Lit) else value.isNotNull())
        return out

    def matches(self, pred: A.Pred) -> DataFrame:
        """Events that the predicate matches, whatever the decision: g, tp, ts, x_name for variables, y_i for values to be equal to r_i."""
        df = self.events.where((F.col("ns") == pred.ns) & (F.col("action") == pred.action) & (F.col("kind") == pred.kind))
        cols: dict[str, Column] = {}
        for path, term in pred.args:
            value = self.trace.logged(path)
            if isinstance(term, A.Lit):
                df = df.where(value == F.lit(tag(term.value)))
                continue
            df = df.where(value.isNotNull())
            name = f"x_{term.name}" if isinstance(term, A.Var) else f"y_{self.index[term]}" if isinstance(term, A.Ref) else None
            if name in cols:
                df = df.where(cols[name] == value)
            elif name:
                cols[name] = value
        return df.select("g", "tp", "ts", *[c.alias(n) for n, c in cols.items()])

    def verdicts(self, condition: Any, where: Column, extra: DataFrame | None = None) -> DataFrame:
        """d: the decisions among those ``where`` for which the condition holds."""
        self.index = {r: i for i, r in enumerate(N.refs(condition))}
        ctx = self.decisions(condition, where)
        return self.compile(condition, ctx, {}).df.select("d").distinct()

    # Contexts
    def _columns(self, node: Any, ctx: DataFrame, bound: dict[str, bool]) -> list[str]:
        """Columns of the context that the condition depends on."""
        wanted = {f"r{self.index[r]}" for r in N.refs(node)} | {f"v_{v}" for v in N.reads(node) if v in bound}
        return [c for c in ctx.columns if c in ("g", "k", "t") or c in wanted]

    @staticmethod
    def _same(columns: list[str], left: str, right: str) -> Column:
        cond = F.lit(True)
        for c in columns:
            a, b = F.col(f"{left}.{c}"), F.col(f"{right}.o_{c}")
            cond = cond & (a == b if c in ("g", "k", "t") else a.eqNullSafe(b))
        return cond

    def _back(self, ctx: DataFrame, base: list[str], rows: DataFrame, news: list[str]) -> DataFrame:
        """The context's rows for each of ``rows`` (o_ columns for ``base``, v_ columns ``news``)."""
        joined = ctx.alias("c").join(rows.alias("n"), self._same(base, "c", "n"))
        return joined.select(*[F.col(f"c.{c}") for c in ctx.columns if c not in news], *[F.col(f"n.{c}") for c in news])

    @staticmethod
    def _news(found: dict[str, bool], bound: dict[str, bool]) -> list[str]:
        """Variables that are new or were bound in some rows only."""
        return [f"v_{v}" for v in found if not bound.get(v)]

    # Where a condition can have rows at all
    def _spread(self, base: DataFrame, node: Any, bound: dict[str, bool], w: int, after: str | None = None) -> DataFrame:
        """All points (k, t) before those of ``base`` at which the condition may have rows; base's own become k0, t0, by depth.

        With ``after``, only points later than the number in that column.
        """
        n = self.depth
        found = N.support(node)
        how = F.col("tp") > F.col(after) if after else None
        if found is None:
            events = [(self.events.select(F.col("g").alias("e_g"), "tp", "ts"), [("g", "e_g")])]
        else:
            events = []
            for pred, hidden in found:
                m = self.matches(pred)
                on = [("g", "e_g")]
                for c in m.columns[3:]:
                    name = f"r{c[2:]}" if c[0] == "y" else f"v_{c[2:]}"
                    if name in base.columns and (c[0] == "y" or bound.get(c[2:]) and c[2:] not in hidden):
                        on.append((name, c))
                m = m.select(F.col("g").alias("e_g"), "tp", "ts", *dict.fromkeys(b for _, b in on[1:]))
                events.append((m.distinct(), on))
        out = None
        for m, on in events:
            pairs = O.range_join(base, m, on, w, how)
            pairs = pairs.select(*[F.col(c).alias({"k": f"k{n}", "t": f"t{n}"}.get(c, c)) for c in base.columns], F.col("tp").alias("k"), F.col("ts").alias("t"))
            out = pairs if out is None else out.unionByName(pairs)
        return out.distinct() if len(events) > 1 else out

    # Conditions
    def compile(self, node: Any, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        return getattr(self, f"_{type(node).__name__.lower()}")(node, ctx, bound)

    def _pred(self, node: A.Pred, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        m = self.matches(node).drop("ts")
        news, cond = {}, (F.col("c.g") == F.col("m.g")) & (F.col("c.k") == F.col("m.tp"))
        cols = {c: F.col(f"c.{c}") for c in ctx.columns}
        for c in m.columns[2:]:
            if c[0] == "y":
                cond = cond & (F.col(f"c.r{c[2:]}") == F.col(f"m.{c}"))
                continue
            name = c[2:]
            v = f"v_{name}"
            if bound.get(name):
                cond = cond & (F.col(f"c.{v}") == F.col(f"m.{c}"))
            elif name in bound:
                cond = cond & (F.col(f"c.{v}").isNull() | (F.col(f"c.{v}") == F.col(f"m.{c}")))
            cols[v] = F.col(f"m.{c}")
            news[name] = True
        out = ctx.alias("c").join(m.alias("m"), cond).select(*[x.alias(n) for n, x in cols.items()])
        return Found(out, bound | news)

    def _closed(self, node: Any, bound: dict[str, bool]) -> list[tuple[str, str]] | None:
        """Pairs (context column, match column) if the predicate is decided by equality with values at hand."""
        if not self.fast or not isinstance(node, A.Pred):
            return None
        out = []
        for _, term in node.args:
            if isinstance(term, A.Var):
                if not bound.get(term.name):
                    return None
                out.append((f"v_{term.name}", f"x_{term.name}"))
            elif isinstance(term, A.Ref):
                out.append((f"r{self.index[term]}", f"y_{self.index[term]}"))
        return list(dict.fromkeys(out))

    def _keyed(self, node: A.Pred, pairs: list[tuple[str, str]]) -> DataFrame:
        return self.matches(node).select("g", *[F.col(b).alias(a) for a, b in pairs], "tp", "ts")

    def _formerly(self, node: A.Formerly, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        w = self.ticks(node.window)
        pairs = self._closed(node.child, bound)
        if pairs is not None:
            out = O.formerly(ctx, self._keyed(node.child, pairs), ["g", *[a for a, _ in pairs]], w, "__holds", self.grain)
            return Found(out.where("__holds").drop("__holds"), bound)
        if self._plainly(node.child, bound):
            return self._reached(node.child, self.matches(node.child), ctx, bound, w)
        return self._over(node.child, ctx, bound, lambda base, b: self._spread(base, node.child, b, w))

    def _plainly(self, node: Any, bound: dict[str, bool]) -> bool:
        """Whether the condition is a predicate whose variables are each bound in all rows or in none."""
        return self.fast and isinstance(node, A.Pred) and all(bound.get(t.name, True) for _, t in node.args if isinstance(t, A.Var))

    def _reached(self, pred: A.Pred, m: DataFrame, ctx: DataFrame, bound: dict[str, bool], w: int, how: Column | None = None) -> Found:
        """The context's rows with the variables of each matching event (``m``) in their window: one join by window and what is known."""
        on, news = [("g", "e_g")], {}
        for c in m.columns:
            if c[:2] == "y_":
                on.append((f"r{c[2:]}", c))
            elif c[:2] == "x_":
                if bound.get(c[2:]):
                    on.append((f"v_{c[2:]}", c))
                else:
                    news[c[2:]] = c
        pairs = O.range_join(ctx, m.withColumnRenamed("g", "e_g"), on, w, how)
        return Found(pairs.select(*ctx.columns, *[F.col(c).alias(f"v_{v}") for v, c in news.items()]).distinct(), bound | dict.fromkeys(news, True))

    def _previous(self, node: A.Previous, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        n, w = self.depth, self.ticks(node.window)

        def step(base: DataFrame, _: dict[str, bool]) -> DataFrame:
            line = self.events.select(F.col("g").alias("e_g"), (F.col("tp") + 1).alias("e_k"), F.col("ts").alias("e_t"))
            pairs = base.join(line, (F.col("g") == F.col("e_g")) & (F.col("k") == F.col("e_k")))
            if w < A.UNBOUNDED:
                pairs = pairs.where(F.col("t") - F.col("e_t") <= F.lit(w))
            return pairs.select(*[F.col(c).alias({"k": f"k{n}", "t": f"t{n}"}.get(c, c)) for c in base.columns], (F.col("e_k") - 1).alias("k"), F.col("e_t").alias("t"))

        return self._over(node.child, ctx, bound, step)

    def _over(self, child: Any, ctx: DataFrame, bound: dict[str, bool], points: Any) -> Found:
        """The context's rows for which the child has rows at some of the other ``points``."""
        n = self.depth
        base = self._columns(child, ctx, bound)
        inner = {v: b for v, b in bound.items() if f"v_{v}" in base}
        spread = points(ctx.select(*base).distinct(), inner)
        soft = [v for v, b in inner.items() if not b]
        for v in soft:
            spread = spread.withColumn(f"h{n}_{v}", F.col(f"v_{v}"))
        self.depth += 1
        found = self.compile(child, spread, inner)
        self.depth -= 1
        news = self._news(found.bound, bound)
        own = {"k": f"k{n}", "t": f"t{n}"} | {f"v_{v}": f"h{n}_{v}" for v in soft}
        rows = found.df.select(*[F.col(own.get(c, c)).alias(f"o_{c}") for c in base], *news).distinct()
        return Found(self._back(ctx, base, rows, news), bound | found.bound)

    def _since(self, node: A.Since, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        w, n = self.ticks(node.window), self.depth
        anchor = self._closed(node.right, bound)
        stop = self._closed(node.left.child, bound) if isinstance(node.left, A.Not) else None
        if anchor is not None and stop is not None:
            keys = ["g", *[a for a, _ in anchor]]
            if anchor == stop:
                out = O.since(ctx, self._keyed(node.right, anchor), self._keyed(node.left.child, stop), keys, w, "__holds", self.grain)
                return Found(out.where("__holds").drop("__holds"), bound)
            out = O.last_match(ctx, self._keyed(node.right, anchor), keys, w, "__a", self.grain)
            out = O.last_match(out, self._keyed(node.left.child, stop), ["g", *[a for a, _ in stop]], w, "__v", self.grain)
            return Found(out.where(O.unbroken(F.col("__a"), F.col("__v"))).drop("__a", "__v"), bound)
        if anchor is not None and self._still(node.left):
            return self._since_still(node, anchor, ctx, bound, w)
        if self._plainly(node.right, bound) and isinstance(node.left, A.Not) and isinstance(node.left.child, A.Pred):
            own = {t.name for _, t in node.right.args if isinstance(t, A.Var)}
            if all(not isinstance(t, A.Ref) and (not isinstance(t, A.Var) or t.name in own) for _, t in node.left.child.args):
                return self._since_named(node, ctx, bound, w)
        base = list(dict.fromkeys([*self._columns(node.right, ctx, bound), *self._columns(node.left, ctx, bound)]))
        inner = {v: b for v, b in bound.items() if f"v_{v}" in base}
        spread = self._spread(ctx.select(*base).distinct(), node.right, inner, w)
        soft = [v for v, b in inner.items() if not b]
        for v in soft:
            spread = spread.withColumn(f"h{n}_{v}", F.col(f"v_{v}"))
        self.depth += 1
        found = self.compile(node.right, spread, inner)
        self.depth -= 1
        # One row for each anchor: its place (a, k before), the point (k0, t0), and everything known there
        rows = found.df.withColumnRenamed("k", f"a{n}").drop("t").withColumnRenamed(f"k{n}", "k").withColumnRenamed(f"t{n}", "t").distinct()
        negated = isinstance(node.left, A.Not)
        check = node.left.child if negated else node.left
        self.depth += 1
        steps = self._spread(rows, check, found.bound, w, f"a{n}")
        held = self.compile(check, steps, found.bound).df
        self.depth -= 1
        ids = rows.columns
        own = {"k": f"k{n + 1}", "t": f"t{n + 1}"}
        bad = held.select(*[F.col(own.get(c, c)).alias(f"o_{c}") for c in ids], F.col("k").alias("__m")).distinct()
        cond = F.lit(True)
        for c in ids:
            cond = cond & F.col(f"c.{c}").eqNullSafe(F.col(f"n.o_{c}"))
        if negated:
            kept = rows.alias("c").join(bad.drop("__m").distinct().alias("n"), cond, "left_anti")
        else:
            counts = bad.groupBy(*[f"o_{c}" for c in ids]).agg(F.count(F.lit(1)).alias("__n"))
            kept = rows.alias("c").join(counts.alias("n"), cond, "left")
            kept = kept.where(F.coalesce(F.col("n.__n"), F.lit(0)) == F.col("c.k") - F.col(f"c.a{n}")).select(*[F.col(f"c.{c}") for c in ids])
        news = self._news(found.bound, bound)
        back = {f"v_{v}": f"h{n}_{v}" for v in soft}
        out = kept.select(*[F.col(back.get(c, c)).alias(f"o_{c}") for c in base], *news).distinct()
        return Found(self._back(ctx, base, out, news), bound | found.bound)

    def _still(self, node: Any) -> bool:
        """Whether the condition looks at its own place alone, the same for all decisions and variables: a column of the events tells it."""
        if isinstance(node, (A.And, A.Or)):
            return self._still(node.left) and self._still(node.right)
        if isinstance(node, A.Not):
            return self._still(node.child)
        return isinstance(node, A.Pred) and not any(isinstance(t, (A.Ref, A.Var)) for _, t in node.args)

    def _told(self, node: Any) -> Column:
        if isinstance(node, A.And):
            return self._told(node.left) & self._told(node.right)
        if isinstance(node, A.Or):
            return self._told(node.left) | self._told(node.right)
        if isinstance(node, A.Not):
            return ~self._told(node.child)
        return self.matching(node)

    def _since_still(self, node: A.Since, anchor: list[tuple[str, str]], ctx: DataFrame, bound: dict[str, bool], w: int) -> Found:
        """since whose left side a column of the events tells: it holds if it failed nowhere after the last anchor."""
        keys = ["g", *[a for a, _ in anchor]]
        out = O.last_match(ctx, self._keyed(node.right, anchor), keys, w, "__a", self.grain)
        fails = self.events.where(~self._told(node.left)).select("g", "tp", "ts")
        out = O.last_match(out, fails, ["g"], w, "__v", self.grain)
        return Found(out.where(O.unbroken(F.col("__a"), F.col("__v"))).drop("__a", "__v"), bound)

    def _since_named(self, node: A.Since, ctx: DataFrame, bound: dict[str, bool], w: int) -> Found:
        """since where the anchor alone tells what breaks it: each anchor is looked up its first break, and stands up to there.

        The first break after an anchor is the last one before it in a stream that runs backwards.
        """
        anchors, breaks = self.matches(node.right), self.matches(node.left.child)
        keys = [c for c in breaks.columns if c not in ("tp", "ts")]
        points = anchors.withColumn("k", -F.col("tp") - 1).withColumn("t", -F.col("ts"))
        back = breaks.select(*keys, (-F.col("tp")).alias("tp"), (-F.col("ts")).alias("ts"))
        found = O.last_match(points, back, keys, w, "__v", self.grain).drop("k", "t")
        found = found.withColumn("__end", F.coalesce(-F.col("__v.tp"), F.lit(A.UNBOUNDED))).drop("__v")
        return self._reached(node.right, found, ctx, bound, w, F.col("k") < F.col("__end"))

    def _and(self, node: A.And, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        left = self.compile(node.left, ctx, bound)
        return self.compile(node.right, left.df, left.bound)

    def _or(self, node: A.Or, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        left, right = self.compile(node.left, ctx, bound), self.compile(node.right, ctx, bound)
        both = {v: left.bound.get(v, False) and right.bound.get(v, False) for v in left.bound | right.bound}
        return Found(left.df.unionByName(right.df, allowMissingColumns=True).distinct(), both)

    def _not(self, node: A.Not, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        base = self._columns(node.child, ctx, bound)
        inner = {v: b for v, b in bound.items() if f"v_{v}" in base}
        n = self.depth
        start = ctx.select(*base).distinct()
        soft = [v for v, b in inner.items() if not b]
        for v in soft:
            start = start.withColumn(f"h{n}_{v}", F.col(f"v_{v}"))
        self.depth += 1
        found = self.compile(node.child, start, inner)
        self.depth -= 1
        own = {f"v_{v}": f"h{n}_{v}" for v in soft}
        rows = found.df.select(*[F.col(own.get(c, c)).alias(f"o_{c}") for c in base]).distinct()
        return Found(ctx.alias("c").join(rows.alias("n"), self._same(base, "c", "n"), "left_anti"), bound)

    def _apart(self, node: A.Exists, bound: dict[str, bool]) -> tuple[list[str], list[Any], list[Any], list[tuple[A.Pred, int]]] | None:
        """An ``exists`` over conditions that look for events by its own variables alone, whatever the decision: the variables, the
        conditions that read them, the others, and each predicate with its window. None if it isn't one.
        """
        names, child = [], node
        while isinstance(child, A.Exists):
            names.append(child.var)
            child = child.child
        parts, todo = [], [child]
        while todo:
            x = todo.pop()
            if isinstance(x, A.And):
                todo += [x.right, x.left]
            elif isinstance(x, A.Formerly) and isinstance(x.child, A.And) and isinstance(x.child.left, A.Pred) and isinstance(x.child.right, A.Compare) and not N.refs(x.child.right) \
                    and not any(isinstance(t, (A.Agg, A.Arith, A.Items)) for t in (x.child.left, x.child.right.left, x.child.right.right)) and N.reads(x.child.right) <= N.binds(x.child.left):
                todo += [x.child.right, A.Formerly(x.window, x.child.left)]  # what compares values of the event alone can be asked later
            else:
                parts.append(x)
        if not self.fast or len(set(names)) < len(names) or set(names) & set(bound):
            return None
        own, others = [x for x in parts if N.reads(x) & set(names)], [x for x in parts if not N.reads(x) & set(names)]
        preds: list[tuple[A.Pred, int]] = []
        for x in own:
            if N.refs(x) or N.reads(x) - set(names):
                return None
            for t in [x] if isinstance(x, A.Formerly) else [y for y in (x.left, x.right) if not isinstance(y, (A.Var, A.Lit))] if isinstance(x, A.Compare) else [None]:
                look = t.body if isinstance(t, A.Agg) and t.kind == "count" and not set(t.names) & set(names) else t
                pred = look.child if isinstance(look, A.Formerly) else None
                if t is not look:  # a count of events: its total is a look back too
                    pred = pred.left if isinstance(pred, A.And) and isinstance(pred.right, A.Tp) and t.names == (pred.right.var,) else None
                if not isinstance(pred, A.Pred) or N.binds(pred) != set(names):
                    return None
                preds.append((pred, self.ticks(look.window)))
        # The first to be asked binds all variables, so that none holds for values that no event has
        if not preds or not isinstance(own[0], A.Formerly) or any(N.binds(x) for x in others):
            return None
        return names, own, others, preds

    def _standing(self, found: tuple, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        """The context's rows at which the conditions hold for some values: no pair of a decision and an event is made.

        For each values the answer can only change at a matching event, or where one leaves a window. It is worked out at these moments, in
        the order of stamps, and each change is a step of a running total of the values for which it holds.
        """
        names, own, others, preds = found
        vs = [f"v_{v}" for v in names]
        moments = None
        for pred, w in preds:
            m = self.matches(pred).select("g", *[F.col(f"x_{v}").alias(f"v_{v}") for v in names], "tp", "ts")
            ends = m.select("g", *vs, F.lit(-1).cast("long").alias("k"), (F.col("ts") + F.lit(w + 1)).alias("t")) if w < A.UNBOUNDED // 2 else None
            m = m.select("g", *vs, F.col("tp").alias("k"), F.col("ts").alias("t"))
            m = m if ends is None else m.unionByName(ends)
            moments = m if moments is None else moments.unionByName(m)
        moments = moments.distinct().withColumn("d", F.lit(0).cast("long"))
        held = moments.withColumn("__h", F.lit(True))
        inner = dict.fromkeys(names, True)
        for i, x in enumerate(own):
            held, now = self._told_by_look(x, held, inner)
            held = held.withColumn("__h", F.col("__h") & now).select("g", *vs, "k", "t", "d", "__h")
        order = Window.partitionBy("g", *vs).orderBy("t", "k")
        step = F.col("__h").cast("int") - F.coalesce(F.lag(F.col("__h").cast("int")).over(order), F.lit(0))
        steps = held.select("g", F.col("t").alias("ts"), F.col("k").alias("tp"), step.alias("__d")).where("__d <> 0")
        steps = steps.groupBy("g", "ts", "tp").agg(F.sum("__d").alias("__d")).where("__d <> 0")
        out = f"z{self.depth}_standing"
        got = O.look_back(ctx, steps, ["g"], [O.Look(out, F.lit(True), A.UNBOUNDED, True, F.col("__d"))], self.grain)
        at = Found(got.where(F.col(out) > 0).drop(out), bound)
        for x in others:
            at = self.compile(x, at.df, at.bound)
        return at

    def _told_by_look(self, x: Any, ctx: DataFrame, bound: dict[str, bool]) -> tuple[DataFrame, Column]:
        if isinstance(x, A.Formerly):
            pairs = self._closed(x.child, bound)
            self.count = getattr(self, "count", 0) + 1
            out = f"z{self.count}"
            return O.formerly(ctx, self._keyed(x.child, pairs), ["g", *[a for a, _ in pairs]], self.ticks(x.window), out, self.grain), F.col(out)
        ctx, left = self.value(x.left, ctx, bound)
        ctx, right = self.value(x.right, ctx, bound)
        return ctx, self._compared(x.op, left, right)

    def _facing(self, node: A.Exists, bound: dict[str, bool]) -> tuple[list[Any], A.Compare] | None:
        """An ``exists`` over two variables, each found by a look back of its own, whatever the decision, that are told by one being above the other:
        the two look backs, that of the higher one first, and the comparison. None if it isn't one.
        """
        if not self.fast or not isinstance(node.child, A.Exists):
            return None
        names, parts, todo = {node.var, node.child.var}, [], [node.child.child]
        while todo:
            x = todo.pop()
            if isinstance(x, A.And):
                todo += [x.right, x.left]
            else:
                parts.append(x)
        told = [x for x in parts if isinstance(x, A.Compare)]
        if len(parts) != 3 or len(told) != 1 or len(names) < 2 or names & set(bound) or told[0].op not in ("<", "<=", ">", ">="):
            return None
        sides = [told[0].left, told[0].right] if told[0].op[0] == ">" else [told[0].right, told[0].left]
        if {t.name if isinstance(t, A.Var) else None for t in sides} != names:
            return None
        looks = {}
        for x in parts:
            if x is told[0]:
                continue
            anchor = x.child if isinstance(x, A.Formerly) else x.right if isinstance(x, A.Since) else None
            preds = [anchor] + ([x.left.child if isinstance(x.left, A.Not) else None] if isinstance(x, A.Since) else [])
            if not all(isinstance(q, A.Pred) and not any(isinstance(t, A.Ref) for _, t in q.args) for q in preds):
                return None
            own = {t.name for _, t in anchor.args if isinstance(t, A.Var)}
            if len(own) != 1 or any(isinstance(t, A.Var) and t.name not in own for q in preds for _, t in q.args):
                return None
            looks[own.pop()] = x
        return None if set(looks) != names else ([looks[t.name] for t in sides], told[0])

    def _faced(self, looks: list[Any], told: A.Compare, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        """The context's rows at which a value of the first look back is above one of the second: the highest of the one and the lowest of the other tell it, so no pairs are made."""
        stand = []
        for x in looks:
            pred = x.child if isinstance(x, A.Formerly) else x.right
            m = self.matches(pred)
            if isinstance(x, A.Since):
                breaks = self.matches(x.left.child)
                m = facing.stands_until(m, breaks, [c for c in breaks.columns if c not in ("tp", "ts")], "end")
            else:
                m = m.withColumn("end", F.lit(A.UNBOUNDED))
            (name,) = {t.name for _, t in pred.args if isinstance(t, A.Var)}
            stand.append(m.select("g", "tp", "ts", "end", as_long(F.col(f"x_{name}")).alias("value")))
        windows = self.ticks(looks[0].window), self.ticks(looks[1].window)
        at = facing.some_higher(ctx.select("g", "k", "t"), *stand, windows, told.op.endswith("="))
        return Found(ctx.join(at, ["g", "k"], "left_semi").select(*ctx.columns), bound)

    def _exists(self, node: A.Exists, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        if (standing := self._apart(node, bound)) is not None:
            return self._standing(standing, ctx, bound)
        if (faced := self._facing(node, bound)) is not None:
            return self._faced(*faced, ctx, bound)
        v, kept = f"v_{node.var}", f"s{self.depth}_{node.var}"
        outer = node.var in bound
        inner = {x: b for x, b in bound.items() if x != node.var}
        self.depth += 1
        found = self.compile(node.child, ctx.withColumnRenamed(v, kept) if outer else ctx, inner)
        self.depth -= 1
        out = found.df.drop(v)
        news = {x: b for x, b in found.bound.items() if x != node.var}
        if outer:
            out, news = out.withColumnRenamed(kept, v), news | {node.var: bound[node.var]}
        return Found(out.distinct(), news)

    def _tp(self, node: A.Tp, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        now, v = long_tag(F.col("k")), f"v_{node.var}"
        if node.var in bound:
            ctx = ctx.where(F.col(v).isNull() | (F.col(v) == now))
        return Found(ctx.withColumn(v, now), bound | {node.var: True})

    def _compare(self, node: A.Compare, ctx: DataFrame, bound: dict[str, bool]) -> Found:
        columns = ctx.columns
        ctx, left = self.value(node.left, ctx, bound)
        ctx, right = self.value(node.right, ctx, bound)
        names = [t.name if isinstance(t, A.Var) and not bound.get(t.name) else None for t in (node.left, node.right)]
        plain = self._compared(node.op, left, right)
        if node.op != "==" or names == [None, None]:
            return Found(ctx.where(plain).select(*columns), bound)
        # One side may be without a value in a row: there the equation binds it, elsewhere it filters
        a, b = [F.col(f"v_{n}") if n in bound else F.lit(None).cast("string") if n else None for n in names]
        free_a = a.isNull() if names[0] else F.lit(False)
        free_b = b.isNull() if names[1] else F.lit(False)
        out = ctx.where((free_a & ~free_b & right.isNotNull()) | (free_b & ~free_a & left.isNotNull()) | (~free_a & ~free_b & plain))
        news = {}
        for name, own, other in ((names[0], left, right), (names[1], right, left)):
            if name:
                columns = [c for c in columns if c != f"v_{name}"]
                out = out.withColumn(f"v_{name}", F.coalesce(F.col(f"v_{name}"), other) if name in bound else other)
                news[name] = True
        return Found(out.select(*columns, *[f"v_{n}" for n in news]), bound | news)

    @staticmethod
    def _compared(op: str, left: Column, right: Column) -> Column:
        if op == "==":
            return F.coalesce(left == right, F.lit(False))
        if op == "!=":
            return F.coalesce(left != right, F.lit(False))
        a, b = as_long(left), as_long(right)
        return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], F.lit(False))

    # Operands
    def value(self, x: Any, ctx: DataFrame, bound: dict[str, bool]) -> tuple[DataFrame, Column]:
        """The context, perhaps with one more column, and the operand's tagged value in it, null if it has none."""
        if isinstance(x, A.Lit):
            return ctx, F.lit(tag(x.value))
        if isinstance(x, A.Var):
            return ctx, F.col(f"v_{x.name}") if x.name in bound else F.lit(None).cast("string")
        if isinstance(x, A.Ref):
            return ctx, F.col(f"r{self.index[x]}")
        if isinstance(x, A.Items):
            parts = []
            for t in x.items:
                ctx, c = self.value(t, ctx, bound)
                parts.append(c)
            whole = F.lit(True)
            for c in parts:
                whole = whole & c.isNotNull()
            quoted = [F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')) for c in parts]
            return ctx, F.when(whole, F.concat(F.lit("a:["), F.concat_ws(", ", *quoted), F.lit("]")))
        if isinstance(x, A.Arith):
            ctx, left = self.value(x.left, ctx, bound)
            ctx, right = self.value(x.right, ctx, bound)
            return ctx, F.when(as_long(left).isNotNull() & as_long(right).isNotNull(), long_tag(saturating(x.op, as_long(left), as_long(right))))
        if isinstance(x, A.Agg):
            return self._aggregated(x, ctx, bound)
        return ctx, F.lit(None).cast("string")

    def _aggregated(self, x: A.Agg, ctx: DataFrame, bound: dict[str, bool]) -> tuple[DataFrame, Column]:
        self.count = getattr(self, "count", 0) + 1
        out = f"z{self.count}"
        if (fast := self._sliding(x, ctx, bound, out)) is not None or (fast := self._distinct(x, ctx, bound, out)) is not None:
            return fast, F.col(out)
        inner = {v: b for v, b in bound.items() if v not in x.names}
        base = [c for c in self._columns(x, ctx, bound) if c[:2] != "v_" or c[2:] in inner]
        inner = {v: b for v, b in inner.items() if f"v_{v}" in base}
        n = self.depth
        start = ctx.select(*base).distinct()
        soft = [v for v, b in inner.items() if not b]
        for v in soft:
            start = start.withColumn(f"h{n}_{v}", F.col(f"v_{v}"))
        self.depth += 1
        found = self.compile(x.body, start, inner)
        self.depth -= 1
        own = {f"v_{v}": f"h{n}_{v}" for v in soft}
        names = [f"v_{v}" for v in dict.fromkeys(x.names) if v in found.bound]
        rows = found.df.select(*[F.col(own.get(c, c)).alias(f"o_{c}") for c in base], *names).distinct()
        if x.kind == "count":
            total = F.count(F.lit(1))
        else:
            total = saturating_sum(as_long(F.col(f"v_{x.bound}"))) if f"v_{x.bound}" in names else F.min(F.lit(0))
        totals = rows.groupBy(*[f"o_{c}" for c in base]).agg(total.alias("__total"))
        joined = ctx.alias("c").join(totals.alias("n"), self._same(base, "c", "n"), "left")
        return joined.select(*[F.col(f"c.{c}") for c in ctx.columns], long_tag(F.coalesce(F.col("n.__total"), F.lit(0))).alias(out)), F.col(out)

    def _sliding(self, x: A.Agg, ctx: DataFrame, bound: dict[str, bool], out: str) -> DataFrame | None:
        """count or sum over the matching events of a window, each event by its number: one window, no pairs."""
        body = x.body
        if not isinstance(body, A.Formerly) or not isinstance(body.child, A.And) or not isinstance(body.child.right, A.Tp) or not isinstance(body.child.left, A.Pred):
            return None
        pred, moment = body.child.left, body.child.right.var
        free = {v: b for v, b in bound.items() if v not in x.names}
        if moment not in x.names or x.kind == "count" and set(x.names) != {moment} or x.kind == "sum" and set(x.names) != {moment, x.bound} or x.bound == moment:
            return None
        args = [(p, t) for p, t in pred.args if not (isinstance(t, A.Var) and t.name == x.bound)]
        summed = [p for p, t in pred.args if isinstance(t, A.Var) and t.name == x.bound]
        w = self.ticks(body.window)
        pairs = self._closed(A.Pred(pred.ns, pred.action, pred.kind, tuple(args)), free)
        if pairs is None or any(t == A.Var(moment) for _, t in pred.args) or len(summed) != (x.kind == "sum"):
            return None
        m = self.matches(pred)
        value = as_long(F.col(f"x_{x.bound}")) if summed else F.lit(1).cast("long")
        events = m.select("g", *[F.col(b).alias(a) for a, b in pairs], "tp", "ts", value.alias("__value"))
        got = O.window_total(ctx, events, ["g", *[a for a, _ in pairs]], w, out, "__value" if summed else None, self.grain)
        low, high = F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")
        clamped = F.least(F.greatest(F.col(out).cast("decimal(38,0)"), low), high).cast("long")
        return got.withColumn(out, long_tag(clamped))

    def _distinct(self, x: A.Agg, ctx: DataFrame, bound: dict[str, bool], out: str) -> DataFrame | None:
        """count over the different values that matching events of a window have in some fields, or the sum of such values: one running total."""
        body = x.body
        if not self.fast or not isinstance(body, A.Formerly) or not isinstance(body.child, A.Pred):
            return None
        pred = body.child
        env = {v: b for v, b in bound.items() if v not in x.names}
        free = {t.name for _, t in pred.args if isinstance(t, A.Var) and t.name not in env}
        if free != set(x.names) or x.kind == "sum" and x.names != (x.bound,):
            return None
        pairs = self._closed(A.Pred(pred.ns, pred.action, pred.kind, tuple((p, t) for p, t in pred.args if not (isinstance(t, A.Var) and t.name in free))), env)
        if pairs is None:
            return None
        m = self.matches(pred)
        names = [f"x_{n}" for n in dict.fromkeys(x.names)]
        value = F.struct(*names)
        amount = as_long(F.col(names[0])) if x.kind == "sum" else F.lit(1)
        events = m.select("g", *[F.col(b).alias(a) for a, b in pairs], "tp", "ts", value.alias("__values"), F.coalesce(amount.cast("long"), F.lit(0)).alias("__amount"))
        got = O.window_distinct(ctx, events, ["g", *[a for a, _ in pairs]], self.ticks(body.window), "__values", out, self.grain, F.col("__amount"))
        low, high = F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")
        return got.withColumn(out, long_tag(F.least(F.greatest(F.col(out).cast("decimal(38,0)"), low), high).cast("long")))
