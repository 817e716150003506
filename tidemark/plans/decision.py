"""Decisions: scopes, plain conditions and leaf verdicts of all policies, combined for each decision event."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PolicyError
from ..functions.values import LONG_MAX, LONG_MIN, as_long, checked, long_tag, saturating, tag
from ..operators import temporal as O
from ..policy_store import Entry, Leaf, PolicySet
from ..sources.events import Trace
from . import analysis as N
from . import ast as A
from .compiler import Compiler
from .parser import EventSchema

#: So many leaves of one shape are worth a table of their parameters instead of a plan each.
SHARED_SHAPE = 8
TRUE, FALSE = "b:true", "b:false"


def ancestors(entity: Column, parents: Column) -> Column:
    """The entity and all that it is in: one step for each entity that has parents is enough."""
    none = F.array().cast("array<string>")
    steps = F.when(F.coalesce(F.size(F.map_keys(parents)), F.lit(0)) > 0, F.sequence(F.lit(1), F.size(F.map_keys(parents)))).otherwise(F.array().cast("array<int>"))
    up = lambda found: F.array_union(found, F.flatten(F.transform(found, lambda u: F.coalesce(F.try_element_at(parents, u), none))))
    return F.aggregate(steps, F.array(entity), lambda found, _: up(found))


class Plain:
    """Plain conditions as columns: tagged text, null for an evaluation error."""

    def __init__(self, trace: Trace) -> None:
        self.trace = trace

    def value(self, x: Any) -> Column:
        if isinstance(x, A.Lit):
            return F.lit(tag(x.value))
        if isinstance(x, A.Ref):
            return self.trace.term(x.root, x.path)
        if isinstance(x, A.Arith):
            total = checked(x.op, as_long(self.value(x.left)), as_long(self.value(x.right)))
            return F.when(total.isNotNull(), long_tag(total))
        return F.lit(None).cast("string")

    @staticmethod
    def _truth(c: Column) -> Column:
        return F.when(c, F.lit(TRUE)).when(~c, F.lit(FALSE))

    def holds(self, x: Any) -> Column:
        if isinstance(x, (A.And, A.Or)):
            left, right = self.holds(x.left), self.holds(x.right)
            stop = FALSE if isinstance(x, A.And) else TRUE
            return F.when(left.isNull(), F.lit(None).cast("string")).when(left == stop, F.lit(stop)).otherwise(right)
        if isinstance(x, A.Not):
            inner = self.holds(x.child)
            return F.when(inner == TRUE, F.lit(FALSE)).when(inner == FALSE, F.lit(TRUE))
        if isinstance(x, A.Compare):
            left, right = self.value(x.left), self.value(x.right)
            if x.op in ("==", "!="):
                return self._truth(left == right if x.op == "==" else left != right)
            a, b = as_long(left), as_long(right)
            return self._truth({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op])
        if isinstance(x, A.Has):
            found = self.trace.term(x.term.root, (*x.term.path, x.attr)).isNotNull()
            if x.term.path:
                return F.when(self.value(x.term).isNotNull(), self._truth(found))
            return self._truth(found)
        if isinstance(x, A.In):
            return self._truth(self.member(self.value(x.term), self.value(x.group)))
        got = self.value(x.term)
        return F.when(got.isin(TRUE, FALSE), got)

    def member(self, entity: Column, group: Column) -> Column:
        if "parents" not in self.trace.df.columns:
            return entity == group
        return F.array_contains(ancestors(entity, F.col("parents")), group)


def _scope(entry: Entry, actions: frozenset | None, plain: Plain) -> Column:
    """Whether the policy's scope covers the decision."""
    out = F.lit(True)
    if actions is not None:
        out = out & reduce(lambda a, b: a | b, [(F.col("ns") == ns) & (F.col("action") == a) for ns, a in sorted(actions)], F.lit(False))
    for root, limit in (("principal", entry.policy.scope.principal), ("resource", entry.policy.scope.resource)):
        if limit:
            op, uid = limit
            owner = plain.trace.term(root, ())
            out = out & F.coalesce(owner == tag(uid) if op == "==" else plain.member(owner, F.lit(tag(uid))), F.lit(False))
    return out


def _targets(leaf: Leaf, kinds: tuple[str, ...]) -> Column:
    out = F.col("kind").isin(*kinds)
    if leaf.actions is not None:
        out = out & reduce(lambda a, b: a | b, [(F.col("ns") == ns) & (F.col("action") == a) for ns, a in sorted(leaf.actions)], F.lit(False))
    return out


def leaf_verdicts(trace: Trace, leaves: list[Leaf], schema: EventSchema, rate: int, offset: str = "id", fast: bool = True) -> DataFrame | None:
    """(d, leaf): the decisions at which each leaf holds. Leaves that are alike are worked out once; many of one shape, together."""
    groups: dict[tuple, list[Leaf]] = defaultdict(list)
    for x in leaves:
        groups[N.key(x.condition), x.since, x.actions].append(x)
    shapes: dict[tuple, list[tuple[Leaf, tuple]]] = defaultdict(list)
    for same in groups.values():
        form, values = N.shape(same[0].condition)
        shapes[form, same[0].since, same[0].actions].append((same[0], values))
    names = {same[0].ident: [x.ident for x in same] for same in groups.values()}
    out = None
    for (form, since, _), members in shapes.items():
        t = trace if since <= 0 else trace.over(trace.df.where(F.col(offset) >= since))
        compiler = Compiler(t, rate, schema.pins, fast)
        where = _targets(members[0][0], schema.decisions)
        if shared(form, len(members)):
            parts = [_shared(compiler, form, members, where, names)]
        else:
            parts = [compiler.verdicts(m.condition, where).select("d", F.explode(F.array(*[F.lit(n) for n in names[m.ident]])).alias("leaf")) for m, _ in members]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def shared(form: Any, members: int) -> bool:
    """Whether so many leaves of one shape go through a table of their literals."""
    return members >= SHARED_SHAPE and isinstance(form, A.Formerly) and isinstance(form.child, A.Pred)


class Passes:
    """Leaves worked out as columns of the decisions themselves: those made of what a look back by equal values tells.

    All that is looked for by the same values goes through one pass over the events, whatever the leaves, their windows and starts:
    one scan and one shuffle for each set of keys.
    """

    def __init__(self, compiler: Compiler, leaves: list[Leaf]) -> None:
        self.compiler, self.looks, self.kept, self.count = compiler, {}, {}, 0
        compiler.index = {r: i for i, r in enumerate(dict.fromkeys(r for x in leaves for r in N.refs(x.condition)))}
        for x in leaves:
            taken = {k: len(v) for k, v in self.looks.items()}
            got = self._holds(N.settled(x.condition), x.since)
            if got is None:  # not all of it can be told so: forget what was begun
                self.looks = {k: v[: taken[k]] for k, v in self.looks.items() if taken.get(k)}
            else:
                self.kept[x.ident] = got if x.since <= 0 else got & (F.col("id") >= x.since)

    def _look(self, pred: A.Pred, skip: str | None, w: int, since: int, total: bool = False, value: Column | None = None) -> Column | None:
        """The column for what is found of a predicate; None if it has variables other than ``skip``."""
        pairs = []
        for path, t in pred.args:
            if isinstance(t, A.Var) and t.name != skip:
                return None
            if isinstance(t, A.Ref):
                pairs.append((f"r{self.compiler.index[t]}", path))
        match = self.compiler.matching(pred)
        match = match if since <= 0 else match & (F.col("id") >= since)
        held = self.looks.setdefault(tuple(sorted(set(pairs))), [])
        signature = (N.key(pred), skip, w, since, total)
        for name, s, _ in held:
            if s == signature:
                return F.col(name)
        self.count += 1
        name = f"look{self.count}"
        held.append((name, signature, O.Look(name, match, w, total, value)))
        return F.col(name)

    def _holds(self, node: Any, since: int) -> Column | None:
        if isinstance(node, A.Not):
            inner = self._holds(node.child, since)
            return None if inner is None else ~inner
        if isinstance(node, (A.And, A.Or)) and not N.binds(node):
            left = self._holds(node.left, since)
            right = self._holds(node.right, since) if left is not None else None
            return None if right is None else left & right if isinstance(node, A.And) else left | right
        if isinstance(node, A.Formerly) and isinstance(node.child, A.Pred):
            found = self._look(node.child, None, self.compiler.ticks(node.window), since)
            return None if found is None else found.isNotNull()
        if isinstance(node, A.Since) and isinstance(node.left, A.Not) and isinstance(node.left.child, A.Pred) and isinstance(node.right, A.Pred):
            w = self.compiler.ticks(node.window)
            anchor = self._look(node.right, None, w, since)
            stop = self._look(node.left.child, None, w, since) if anchor is not None else None
            return None if stop is None else O.unbroken(anchor, stop)
        if isinstance(node, A.Compare):
            left = self._value(node.left, since)
            right = self._value(node.right, since) if left is not None else None
            return None if right is None else Compiler._compared(node.op, left, right)
        return None

    def _value(self, x: Any, since: int) -> Column | None:
        if isinstance(x, A.Lit):
            return F.lit(tag(x.value))
        if isinstance(x, A.Ref):
            return F.col(f"r{self.compiler.index[x]}")
        if isinstance(x, A.Arith):
            left = self._value(x.left, since)
            right = self._value(x.right, since) if left is not None else None
            return None if right is None else F.when(as_long(left).isNotNull() & as_long(right).isNotNull(), long_tag(saturating(x.op, as_long(left), as_long(right))))
        if not isinstance(x, A.Agg) or not isinstance(x.body, A.Formerly) or not isinstance(x.body.child, A.And):
            return None
        pred, moment = x.body.child.left, x.body.child.right
        if not isinstance(pred, A.Pred) or not isinstance(moment, A.Tp) or set(x.names) != ({moment.var} if x.kind == "count" else {moment.var, x.bound}) or x.bound == moment.var:
            return None
        summed = [p for p, t in pred.args if t == A.Var(x.bound)]
        if len(summed) != (x.kind == "sum"):
            return None
        value = as_long(self.compiler.trace.logged(summed[0])) if summed else None
        total = self._look(pred, x.bound, self.compiler.ticks(x.body.window), since, True, value)
        if total is None:
            return None
        low, high = F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")
        return long_tag(F.least(F.greatest(total, low), high).cast("long"))

    def run(self, base: DataFrame) -> DataFrame:
        """``base`` (id, g, k, t, r0, ... and others) with the looks' columns."""
        events = self.compiler.events
        for pairs, held in self.looks.items():
            keys = [f"q{i}" for i in range(len(pairs))]
            e = events.withColumns({q: self.compiler.trace.logged(path) for q, (_, path) in zip(keys, pairs, strict=True)})
            points = base.withColumns({q: F.col(r) for q, (r, _) in zip(keys, pairs, strict=True)})
            base = O.look_back(points, e, ["g", *keys], [x for *_, x in held], self.compiler.grain).drop(*keys)
        return base


def _shared(compiler: Compiler, form: A.Formerly, members: list[tuple[Leaf, tuple]], where: Column, names: dict[str, list[str]]) -> DataFrame:
    """One plan for all leaves ``formerly within W pred`` that differ in literals: the literals are a table joined to the events."""
    pred = form.child
    free = A.Pred(pred.ns, pred.action, pred.kind, tuple((p, t) for p, t in pred.args if not (isinstance(t, A.Ref) and t.root == "parameter")))
    at = [(p, int(t.path[0])) for p, t in pred.args if isinstance(t, A.Ref) and t.root == "parameter"]
    compiler.index = {r: i for i, r in enumerate(N.refs(free))}
    spark = compiler.events.sparkSession
    rows = [(n, *[tag(values[i]) for _, i in at]) for m, values in members for n in names[m.ident]]
    params = spark.createDataFrame(rows, ", ".join(["leaf string", *[f"p{j} string" for j in range(len(at))]]))
    wide = A.Pred(pred.ns, pred.action, pred.kind, (*free.args, *[(p, A.Var(f"#{j}")) for j, (p, _) in enumerate(at)]))
    events = compiler.matches(wide)
    if at:
        cond = reduce(lambda a, b: a & b, [F.col(f"`x_#{j}`") == F.col(f"p{j}") for j in range(len(at))])
        events = events.join(params, cond)
    else:
        events = events.crossJoin(params)
    keys = [c for c in events.columns if c.startswith("y_")]
    events = events.select(F.col("g").alias("e_g"), "tp", "ts", "leaf", *keys)
    ctx = compiler.decisions(free, where)
    on = [("g", "e_g"), *[(f"r{k[2:]}", k) for k in keys]]
    return O.last_join(ctx, events, on, compiler.ticks(form.window), "leaf").select("d", "leaf")


def decide(trace: Trace, policies: PolicySet, schema: EventSchema, rate: int = 1, sliced: bool = True, fast: bool = True) -> DataFrame:
    """id, tp, ts, allowed, reason (tokens of the determining policies, sorted), errors (tokens of policies that failed), for each decision.

    A satisfied forbid denies; else a satisfied permit allows; else the decision is a denial without a reason. A policy whose
    plain condition fails counts as not satisfied and is reported. A decision without principal or resource is denied with the error
    ``missing scope``.
    """
    trace = trace.over(trace.df if "id" in trace.df.columns else trace.df.withColumn("id", F.col("tp")))
    plain = Plain(trace)
    entries, expanded = policies.entries, policies.schema
    leaves = policies.leaves(sliced)
    compiler = Compiler(trace, rate, schema.pins, fast)
    many: dict[tuple, int] = defaultdict(int)
    forms = {x.ident: (N.shape(x.condition)[0], x.since, x.actions) for x in leaves}
    for f in forms.values():
        many[f] += 1
    passes = Passes(compiler, [x for x in leaves if fast and not shared(forms[x.ident][0], many[forms[x.ident]])])
    rest = [x for x in leaves if x.ident not in passes.kept]
    others = {x.ident for x in rest}
    # A policy that is just a clause for some actions is as good as its leaf: if that is worked out apart, it needs no column of its own
    bare = [e for e in entries if sliced and f"{e.ordinal}:0" in others and not e.policy.when and len(e.policy.temporal) == 1 and e.policy.temporal[0][0] and not e.policy.scope.principal and not e.policy.scope.resource]
    plainly = {e.token for e in bare}
    rules = []
    for e in entries:
        if e.token in plainly:
            continue
        actions = expanded.expand(e.policy.scope.actions)
        ok = F.lit(TRUE)
        for holds, x in e.policy.when:
            got = plain.holds(x)
            got = got if holds else F.when(got == TRUE, F.lit(FALSE)).when(got == FALSE, F.lit(TRUE))
            ok = F.when(ok == TRUE, got).otherwise(ok)
        rules.append((e, _scope(e, actions, plain), ok))
    base = compiler.events.where(F.col("kind").isin(*schema.decisions))
    present = plain.trace.term("principal", ()).isNotNull() & plain.trace.term("resource", ()).isNotNull()
    values = [compiler._resolved(r).alias(f"r{i}") for r, i in compiler.index.items()] if passes.looks or passes.kept else []
    scoped = base.select("id", "g", F.col("tp").alias("k"), F.col("ts").alias("t"), present.alias("present"), *values, *[F.when(s, ok).otherwise(F.lit(FALSE)).alias(f"w{i}") for i, (_, s, ok) in enumerate(rules)])
    scoped = passes.run(scoped)
    truths = leaf_verdicts(trace, rest, schema, rate, fast=fast) if rest else None
    none = F.array().cast("array<string>")
    if truths is not None:
        owners = scoped.sparkSession.createDataFrame([(f"{e.ordinal}:0", e.token, e.policy.effect) for e in bare], "leaf string, token string, effect string")
        held = truths.join(owners, "leaf", "left").groupBy("d").agg(
            F.collect_set(F.when(F.col("token").isNull(), F.col("leaf"))).alias("leaves"),
            F.collect_set(F.when(F.col("effect") == "forbid", F.col("token"))).alias("bare_forbid"),
            F.collect_set(F.when(F.col("effect") == "permit", F.col("token"))).alias("bare_permit"),
        )
        scoped = scoped.join(held, scoped["id"] == held["d"], "left")
        scoped = scoped.withColumns({c: F.coalesce(c, none) for c in ("leaves", "bare_forbid", "bare_permit")})
    else:
        scoped = scoped.withColumns(dict.fromkeys(("leaves", "bare_forbid", "bare_permit"), none))

    def satisfied(i: int, e: Entry) -> Column:
        out = F.col(f"w{i}") == TRUE
        for j, (holds, _) in enumerate(e.policy.temporal):
            ident = f"{e.ordinal}:{j}"
            if ident not in passes.kept and ident not in others:
                raise PolicyError(f"the clause {ident} was not worked out")  # a clause without an answer must not pass for one that fails
            got = passes.kept[ident] if ident in passes.kept else F.array_contains("leaves", ident)
            out = out & (got if holds else ~got)
        return out

    def tokens(effect: str) -> Column:
        found = [F.when(satisfied(i, e), F.lit(e.token)) for i, (e, _, _) in enumerate(rules) if e.policy.effect == effect]
        own = F.array_compact(F.array(*found)) if found else none
        return F.array_sort(F.concat(own, F.col(f"bare_{effect}")))

    failed = F.array_compact(F.array(*[F.when(F.col(f"w{i}").isNull(), F.lit(e.token)) for i, (e, _, _) in enumerate(rules)])) if rules else F.array().cast("array<string>")
    out = scoped.select("id", F.col("k").alias("tp"), F.col("t").alias("ts"), "present", tokens("forbid").alias("forbids"), tokens("permit").alias("permits"), F.array_sort(failed).alias("failed"))
    allowed = F.col("present") & (F.size("forbids") == 0) & (F.size("permits") > 0)
    reason = F.when(~F.col("present"), none).when(F.size("forbids") > 0, F.col("forbids")).otherwise(F.col("permits"))
    errors = F.when(F.col("present"), F.col("failed")).otherwise(F.array(F.lit("missing scope")))
    return out.select("id", "tp", "ts", allowed.alias("allowed"), reason.alias("reason"), errors.alias("errors"))
