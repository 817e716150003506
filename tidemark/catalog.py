"""Registered queries over the tables ``events`` and ``conversations``, with their SQL.

In ``events`` each row is an event: its number is ``event_id``, its stamp microseconds, its action ``event_type``. Clicks are decisions.
Logged and context fields are ``input.user``, ``input.amount`` (cents) and ``input.k``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import values as V
from .functions.values import as_long, long_tag
from .operators import temporal as O
from .plans.compiler import Compiler
from .plans.decision import decide as decided
from .plans.parser import EventSchema, parse_condition
from .policy_store import Add, PolicySet
from .sources.events import Trace

Query = Callable[[SparkSession, str], DataFrame]
MICROS = 1_000_000
SCHEMA = EventSchema({"request": True, "response": False}, (), 8760 * 3600)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tp, ts, action, user, amount, k of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("tp"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type").alias("action"),
        F.col("user_id").alias("user"),
        F.round(F.col("value") * 100).cast("long").alias("amount"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def bind(e: DataFrame) -> Trace:
    """The events as a trace: fields are expressions over the table's columns."""
    fields = {f"input.{c}": F.when(F.col(c).isNotNull(), long_tag(F.col(c))) for c in ("user", "amount", "k")}
    scope = {"principal": F.concat(F.lit('e:User::"'), F.col("user").cast("string"), F.lit('"')), "resource": F.lit('e:Site::"s"')}
    kind = F.when(F.col("action") == "click", "request").otherwise("response")
    df = e.withColumn("id", F.col("tp")).withColumn("ns", F.lit("E")).withColumn("kind", kind)
    if "parents" in df.columns:
        return Trace(df, fields, fields, scope)
    return Trace(df, fields, fields, scope)


def holding(e: DataFrame, condition: str, pins: tuple[str, ...] = (), where: str = "kind = 'request'") -> DataFrame:
    """event_id and holds of each decision."""
    trace = bind(e)
    if pins:
        order = Window.partitionBy("user").orderBy("id")
        trace.df = trace.df.withColumn("tp", (F.row_number().over(order) - 1).cast("long"))
    found = Compiler(trace, MICROS, pins).verdicts(parse_condition(condition), F.expr(where))
    d = trace.df.where(F.expr(where)).select("id")
    return d.join(found, d["id"] == found["d"], "left").select(F.col("id").alias("event_id"), F.col("d").isNotNull().alias("holds"))


def p(action: str, *args: str) -> str:
    kind = "request" if action == "click" else "response"
    return f'E::Action::"{action}"::{kind}{{ {", ".join(args)} }}'


ME = "input.user: context.input.user"


def _count(window: str, pred: str) -> str:
    return f"(count for (t: Timepoint). where (formerly within {window} ({pred} && tp(t))))"


# Name: condition, pins, SQL for holds in terms of the decision d
HOUR = 3600 * MICROS


def _in(window_h: float, action: str, extra: str = "", at: str = "d") -> str:
    """SQL: events x of an action in the window of ``at``."""
    return f"x.event_type = '{action}' AND x.event_id <= {at}.event_id AND {at}.t - x.t BETWEEN 0 AND {int(window_h * HOUR)}{' AND ' + extra if extra else ''}"


U = "x.u = d.u"


def _exists(window_h: float, action: str, extra: str = U) -> str:
    return f"EXISTS (SELECT 1 FROM e x WHERE {_in(window_h, action, extra)})"


def _n(window_h: float, action: str, extra: str = U, at: str = "d") -> str:
    return f"(SELECT count(*) FROM e x WHERE {_in(window_h, action, extra, at)})"


def _since(window_h: float, anchor: str, stop: str, match: str = U, same: str = "z.u = x.u") -> str:
    return f"EXISTS (SELECT 1 FROM e x WHERE {_in(window_h, anchor, match)} AND NOT EXISTS (SELECT 1 FROM e z WHERE z.event_type = '{stop}' AND z.event_id > x.event_id AND z.event_id <= d.event_id AND {same}))"


CONDITIONS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "formerly_corr": (f"formerly within 6h {p('purchase', ME)}", (), _exists(6, "purchase")),
    "formerly_global": (f"formerly within 10m {p('error')}", (), _exists(1 / 6, "error", "")),
    "previous": (f"previous within 5m {p('purchase')}", (), f"EXISTS (SELECT 1 FROM e x WHERE x.event_id = d.event_id - 1 AND x.event_type = 'purchase' AND d.t - x.t <= {HOUR // 12})"),
    "since_not": (f"!{p('error', ME)} since within 24h {p('purchase', ME)}", (), _since(24, "purchase", "error")),
    "since_positive": (
        f"({p('view')} || {p('click')}) since within 1h {p('purchase')}", (),
        f"EXISTS (SELECT 1 FROM e x WHERE {_in(1, 'purchase')} AND NOT EXISTS (SELECT 1 FROM e z WHERE z.event_id > x.event_id AND z.event_id <= d.event_id AND z.event_type NOT IN ('view', 'click')))",
    ),
    "since_anchor_var": (f"exists (u: Long). (!{p('error', 'input.user: u')} since within 2h {p('purchase', 'input.user: u')})", (), _since(2, "purchase", "error", "")),
    "multi_since": (
        f"(!{p('error', ME)} since within 24h {p('purchase', ME)}) && (!{p('signup', ME)} since within 24h {p('view', ME)})", (),
        f"{_since(24, 'purchase', 'error')} AND {_since(24, 'view', 'signup')}",
    ),
    "count_threshold": (f"exists (n: Long). ({_count('24h', p('view', ME))} == n && n > 1)", (), f"{_n(24, 'view')} > 1"),
    "count_distinct_threshold": (f"(count for (x: Long). where (formerly within 48h {p('view', ME, 'input.k: x')})) >= 3", (), f"(SELECT count(DISTINCT x.k) FROM e x WHERE {_in(48, 'view', U)}) >= 3"),
    "count_zero": (f"{_count('12h', p('error', ME))} == 0", (), f"{_n(12, 'error')} = 0"),
    "sum_threshold": (
        f"(sum a for (a: Long), (t: Timepoint). where (formerly within 24h ({p('purchase', ME, 'input.amount: a')} && tp(t)))) > 3000", (),
        f"(SELECT coalesce(sum(x.amount), 0) FROM e x WHERE {_in(24, 'purchase', U)}) > 3000",
    ),
    "sum_distinct": (
        f"(sum a for (a: Long). where (formerly within 48h {p('view', ME, 'input.k: a')})) > 100", (),
        f"(SELECT coalesce(sum(k), 0) FROM (SELECT DISTINCT x.k FROM e x WHERE {_in(48, 'view', U)})) > 100",
    ),
    "corr_agg": (
        f"exists (u: Long). (formerly within 2h {p('signup', 'input.user: u')} && {_count('12h', p('purchase', 'input.user: u'))} >= 1)", (),
        f"EXISTS (SELECT 1 FROM e s WHERE s.event_type = 'signup' AND s.event_id <= d.event_id AND d.t - s.t <= {2 * HOUR} AND EXISTS (SELECT 1 FROM e x WHERE {_in(12, 'purchase', 'x.u = s.u')}))",
    ),
    "agg_in_window": (
        f"formerly within 24h ({p('purchase', ME)} && {_count('12h', p('view', ME))} >= 1)", (),
        f"EXISTS (SELECT 1 FROM e y WHERE y.event_type = 'purchase' AND y.u = d.u AND y.event_id <= d.event_id AND d.t - y.t <= {24 * HOUR} AND {_n(12, 'view', 'x.u = y.u', 'y')} >= 1)",
    ),
    "agg_vs_agg": (f"{_count('24h', p('purchase', ME))} > {_count('24h', p('error', ME))}", (), f"{_n(24, 'purchase')} > {_n(24, 'error')}"),
    "and_join": (
        f"exists (u: Long). (formerly within 1h {p('view', 'input.user: u', 'input.k: _')} && formerly within 3h {p('purchase', 'input.user: u')})", (),
        f"EXISTS (SELECT 1 FROM e y WHERE y.event_type = 'view' AND y.event_id <= d.event_id AND d.t - y.t <= {HOUR} AND EXISTS (SELECT 1 FROM e x WHERE {_in(3, 'purchase', 'x.u = y.u')}))",
    ),
    "or_union": (f"(formerly within 3h {p('purchase', ME)}) || (formerly within 3h {p('signup', ME)})", (), f"({_exists(3, 'purchase')} OR {_exists(3, 'signup')})"),
    "not_anti": (f"!(formerly within 12h {p('error', ME)})", (), f"NOT {_exists(12, 'error')}"),
    "exists_project": (
        f"exists (u: Long), (x: Long). (formerly within 2h ({p('purchase', 'input.user: u', 'input.k: x')} && x > 50))".replace("exists (u: Long), (x: Long). ", "exists (u: Long). (exists (x: Long). ") + ")", (),
        _exists(2, "purchase", "x.k > 50"),
    ),
    "nested": (
        f"formerly within 12h ({p('view', ME)} && formerly within 6h {p('purchase', ME)})", (),
        f"EXISTS (SELECT 1 FROM e y WHERE y.event_type = 'view' AND y.u = d.u AND y.event_id <= d.event_id AND d.t - y.t <= {12 * HOUR} AND EXISTS (SELECT 1 FROM e x WHERE {_in(6, 'purchase', 'x.u = d.u', 'y')}))",
    ),
    "neg_nested": (
        f"formerly within 12h ({p('view', ME)} && !(formerly within 6h {p('purchase', ME)}))", (),
        f"EXISTS (SELECT 1 FROM e y WHERE y.event_type = 'view' AND y.u = d.u AND y.event_id <= d.event_id AND d.t - y.t <= {12 * HOUR} AND NOT EXISTS (SELECT 1 FROM e x WHERE {_in(6, 'purchase', 'x.u = d.u', 'y')}))",
    ),
    "literal_wildcard_args": (f"formerly within 2h {p('view', 'input.k: 42', 'input.user: _')}", (), _exists(2, "view", "x.k = 42")),
    "compare_ops": (
        f'context.input.amount >= 500 && context.input.k < 80 && context.input.user != 7 && context.input.user != "7" && formerly within 24h {p("view", ME)}', (),
        f"d.amount >= 500 AND d.k < 80 AND d.u <> 7 AND {_exists(24, 'view')}",
    ),
    "eq_binding": (f"exists (n: Long). ({_count('24h', p('view', ME))} == n && n == 1)", (), f"{_n(24, 'view')} = 1"),
    "arith_threshold": (
        f"{_count('24h', p('view', ME))} * 4611686018427387904 + context.input.amount > 9000000000000000000", (),
        f"greatest(least(greatest(least({_n(24, 'view')}::HUGEINT * 4611686018427387904, 9223372036854775807), -9223372036854775808) + d.amount, 9223372036854775807), -9223372036854775808) > 9000000000000000000",
    ),
    "pin_partitioned": (f"previous within 24h {p('purchase')}", ("input.user",), f"EXISTS (SELECT 1 FROM (SELECT * FROM e y WHERE y.u = d.u AND y.event_id < d.event_id ORDER BY y.event_id DESC LIMIT 1) x WHERE x.event_type = 'purchase' AND d.t - x.t <= {24 * HOUR})"),
    "pin_since": (
        f"!{p('error')} since within 24h {p('purchase')}", ("input.user",), _since(24, "purchase", "error"),
    ),
}

E_SQL = "WITH e AS (SELECT event_id, epoch_us(ts) AS t, event_type, user_id AS u, CAST(round(value * 100) AS BIGINT) AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _condition(name: str) -> Query:
    text, pins, _ = CONDITIONS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return holding(events(spark, sf_dir), text, pins)

    return run


def _points(e: DataFrame) -> DataFrame:
    return e.where("action = 'click'").select("user", F.col("tp").alias("k"), F.col("ts").alias("t"))


def _of(e: DataFrame, action: str) -> DataFrame:
    return e.where(F.col("action") == action).select("user", "tp", "ts", "amount", F.col("k").alias("x"))


def formerly_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's views lie in the last day, with stamps cut to hours: a later event of the same hour doesn't count."""
    e = events(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / F.lit(HOUR)) * F.lit(HOUR))
    return O.window_total(_points(e), _of(e, "view"), ["user"], 24 * HOUR, "n").select(F.col("k").alias("event_id"), "n")


def formerly_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a click and a purchase of anyone in the 30 minutes before it."""
    e = events(spark, sf_dir)
    pairs = O.range_join(_points(e), _of(e, "purchase").select("tp", "ts"), [], HOUR // 2)
    return pairs.select(F.col("k").alias("event_id"), F.col("tp").alias("purchase_id"))


def count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return O.window_total(_points(e), _of(e, "view"), ["user"], 24 * HOUR, "n").select(F.col("k").alias("event_id"), "n")


def sum_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = O.window_total(_points(e), _of(e, "purchase"), ["user"], 24 * HOUR, "total", "amount")
    return out.select(F.col("k").alias("event_id"), F.col("total").cast("long").alias("total"))


def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return O.window_distinct(_points(e), _of(e, "view"), ["user"], 48 * HOUR, "x", "n").select(F.col("k").alias("event_id"), "n")


def arith_sat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturating sums, differences and products of the events' amounts with large numbers."""
    e, big = events(spark, sf_dir), F.lit(V.LONG_MAX - 1000)
    return e.select(
        F.col("tp").alias("event_id"),
        V.saturating("+", big, F.col("amount")).alias("added"),
        V.saturating("-", -big, F.col("amount")).alias("taken"),
        V.saturating("*", F.col("amount") - 500, big).alias("product"),
        V.saturating("*", V.saturating("*", F.col("amount"), big), F.lit(-1)).alias("chained"),
    )


POLICIES = f"""
@id("base") permit (principal, action == E::Action::"click", resource);
@id("buyer") permit (principal, action, resource) when temporal {{ formerly within 6h {p('purchase', ME)} }};
@id("errors") forbid (principal, action == E::Action::"click", resource) when temporal {{ formerly within 30m {p('error', ME)} }};
@id("small") forbid (principal, action, resource) when {{ context.input.amount < 300 }} unless temporal {{ formerly within 24h {p('view', ME)} }};
@id("seven") forbid (principal == User::"7", action, resource);
@id("overflow") forbid (principal, action, resource) when {{ context.input.amount * 9223372036854775 > 0 && context.input.k > 95 }};
"""


def _decided(e: DataFrame, source: str, sliced: bool = True, since: int = 0, schema: EventSchema = SCHEMA) -> DataFrame:
    policies, minted = PolicySet(max_window=8760 * 3600).fold([Add(source)], 0, since)
    names = {x.token: dict(x.policy.annotations).get("id", "") for x in policies.entries}
    out = decided(bind(e), policies, schema, MICROS, sliced)
    named = F.create_map(*[c for t, n in names.items() for c in (F.lit(t), F.lit(n))])
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda t: named[t])), ",")
    return out.select(F.col("id").alias("event_id"), "allowed", listed(F.col("reason")).alias("reason"), listed(F.col("errors")).alias("errors"))


def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits and forbids with plain and temporal conditions, a scope, and an overflow."""
    return _decided(events(spark, sf_dir), POLICIES)


def slice_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and signups decide; each clause is asked only for the actions of its policy."""
    source = f"""
    @id("a") permit (principal, action in [E::Action::"click", E::Action::"signup"], resource);
    @id("b") forbid (principal, action == E::Action::"signup", resource) when temporal {{ formerly within 3h {p('error', ME)} }};
    @id("c") forbid (principal, action == E::Action::"click", resource) when temporal {{ formerly within 3h {p('purchase', ME)} }};
    """
    schema = EventSchema({"request": True, "decided": True, "response": False}, (), 8760 * 3600)
    trace = bind(events(spark, sf_dir))
    trace.df = trace.df.withColumn("kind", F.when(F.col("action") == "signup", "decided").otherwise(F.col("kind")))
    policies, _ = PolicySet(max_window=8760 * 3600).fold([Add(source)], 0, 0)
    return decided(trace, policies, schema, MICROS).select(F.col("id").alias("event_id"), "allowed")


def many_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permit and 100 forbids ``formerly within 2h`` an error with some k: alike but for a literal, so one plan serves all."""
    source = '@id("p") permit (principal, action == E::Action::"click", resource);\n' + "\n".join(
        f'@id("f{n}") forbid (principal, action == E::Action::"click", resource) when temporal {{ formerly within 2h {p("error", f"input.k: {n}")} }};' for n in range(100)
    )
    return _decided(events(spark, sf_dir), source).select("event_id", "allowed", "reason")


def since_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy installed at event 300 sees only what comes after."""
    source = f'@id("p") permit (principal, action == E::Action::"click", resource) when temporal {{ formerly within 48h {p("purchase", ME)} }};'
    return _decided(events(spark, sf_dir), source, since=300).select("event_id", "allowed")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """principal in admins: users are in teams by their last digit, teams 0 to 2 are in admins."""
    source = '@id("m") permit (principal in Team::"admins", action == E::Action::"click", resource);'
    user = F.concat(F.lit('e:User::"'), F.col("user").cast("string"), F.lit('"'))
    team = F.concat(F.lit('e:Team::"t'), (F.col("user") % 10).cast("string"), F.lit('"'))
    e = events(spark, sf_dir)
    parents = F.when(F.col("user") % 10 < 3, F.create_map(user, F.array(team), team, F.array(F.lit('e:Team::"admins"')))).otherwise(F.create_map(user, F.array(team)))
    return _decided(e.withColumn("parents", parents), source).select("event_id", "allowed")


def conv_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose turn before, in the same conversation, was the assistant's."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("tp"), F.col("turn").alias("ts"), "role")
    out = O.previous(c, ["conv_id"], 1, F.col("role") == "assistant", "holds")
    return out.select("conv_id", F.col("tp").alias("turn"), "holds")


def conv_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with an assistant's turn at most five turns before, and no system turn since then."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    points = c.where("role = 'user'").select("conv_id", F.col("turn").alias("k"), F.col("turn").alias("t"))
    rows = c.select("conv_id", F.col("turn").alias("tp"), F.col("turn").alias("ts"), "role")
    anchors, breaks = rows.where("role = 'assistant'").drop("role"), rows.where("role = 'system'").drop("role")
    return O.since(points, anchors, breaks, ["conv_id"], 5, "holds").select("conv_id", F.col("k").alias("turn"), "holds")


OTHERS: dict[str, tuple[Query, str]] = {
    "formerly_ties": (formerly_ties, f"WITH e AS (SELECT event_id, (epoch_us(ts) // {HOUR}) * {HOUR} AS t, event_type, user_id AS u FROM events) SELECT d.event_id, {_n(24, 'view')} AS n FROM e d WHERE d.event_type = 'click'"),
    "formerly_range": (formerly_range, f"{E_SQL} SELECT d.event_id, x.event_id AS purchase_id FROM e d JOIN e x ON {_in(0.5, 'purchase')} WHERE d.event_type = 'click'"),
    "count_window": (count_window, f"{E_SQL} SELECT d.event_id, {_n(24, 'view')} AS n FROM e d WHERE d.event_type = 'click'"),
    "sum_window": (sum_window, f"{E_SQL} SELECT d.event_id, CAST((SELECT coalesce(sum(x.amount), 0) FROM e x WHERE {_in(24, 'purchase', U)}) AS BIGINT) AS total FROM e d WHERE d.event_type = 'click'"),
    "count_distinct": (count_distinct, f"{E_SQL} SELECT d.event_id, (SELECT count(DISTINCT x.k) FROM e x WHERE {_in(48, 'view', U)}) AS n FROM e d WHERE d.event_type = 'click'"),
    "arith_sat": (
        arith_sat,
        f"""{E_SQL}, m AS (SELECT event_id, amount::HUGEINT AS a, 9223372036854774807::HUGEINT AS b, 9223372036854775807::HUGEINT AS hi, -9223372036854775808::HUGEINT AS lo FROM e)
        SELECT event_id, CAST(greatest(least(b + a, hi), lo) AS BIGINT) AS added, CAST(greatest(least(-b - a, hi), lo) AS BIGINT) AS taken,
        CAST(greatest(least((a - 500) * b, hi), lo) AS BIGINT) AS product, CAST(greatest(least(-greatest(least(a * b, hi), lo), hi), lo) AS BIGINT) AS chained FROM m""",
    ),
    "decide": (
        decide,
        f"""{E_SQL}, f AS (SELECT d.event_id, {_exists(6, 'purchase')} AS buyer, {_exists(0.5, 'error')} AS errors,
            d.amount < 300 AND NOT {_exists(24, 'view')} AS small, d.u = 7 AS seven,
            d.amount::HUGEINT * 9223372036854775 > 9223372036854775807 AS failed, d.amount::HUGEINT * 9223372036854775 > 0 AND d.k > 95 AS over FROM e d WHERE d.event_type = 'click'),
        g AS (SELECT *, concat_ws(',', CASE WHEN errors THEN 'errors' END, CASE WHEN over AND NOT failed THEN 'overflow' END, CASE WHEN seven THEN 'seven' END, CASE WHEN small THEN 'small' END) AS forbids,
            concat_ws(',', 'base', CASE WHEN buyer THEN 'buyer' END) AS permits FROM f)
        SELECT event_id, forbids = '' AS allowed, CASE WHEN forbids <> '' THEN forbids ELSE permits END AS reason, CASE WHEN failed THEN 'overflow' ELSE '' END AS errors FROM g""",
    ),
    "slice": (slice_, f"{E_SQL} SELECT d.event_id, CASE WHEN d.event_type = 'signup' THEN NOT {_exists(3, 'error')} ELSE NOT {_exists(3, 'purchase')} END AS allowed FROM e d WHERE d.event_type IN ('click', 'signup')"),
    "many_policies": (
        many_policies,
        f"""{E_SQL}, f AS (SELECT d.event_id, (SELECT string_agg(DISTINCT 'f' || x.k, ',' ORDER BY 'f' || x.k) FROM e x WHERE {_in(2, 'error', 'x.k BETWEEN 0 AND 99')}) AS forbids FROM e d WHERE d.event_type = 'click')
        SELECT event_id, forbids IS NULL AS allowed, coalesce(forbids, 'p') AS reason FROM f""",
    ),
    "since_offset": (since_offset, f"{E_SQL} SELECT d.event_id, d.event_id >= 300 AND {_exists(48, 'purchase', U + ' AND x.event_id >= 300')} AS allowed FROM e d WHERE d.event_type = 'click'"),
    "membership": (membership, f"{E_SQL} SELECT event_id, u % 10 < 3 AS allowed FROM e WHERE event_type = 'click'"),
    "conv_previous": (conv_previous, "SELECT conv_id, turn, coalesce(lag(role) OVER w = 'assistant' AND turn - lag(turn) OVER w <= 1, false) AS holds FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "conv_since": (
        conv_since,
        """SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = d.conv_id AND x.role = 'assistant' AND x.turn <= d.turn AND d.turn - x.turn <= 5
        AND NOT EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = d.conv_id AND z.role = 'system' AND z.turn > x.turn AND z.turn <= d.turn)) AS holds FROM conversations d WHERE role = 'user'""",
    ),
}


def queries() -> dict[str, Query]:
    return {n: _condition(n) for n in CONDITIONS} | {n: q for n, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: f"{E_SQL} SELECT d.event_id, coalesce({sql}, false) AS holds FROM e d WHERE d.event_type = 'click'" for n, (_, _, sql) in CONDITIONS.items()}
    return out | {n: sql for n, (_, sql) in OTHERS.items()}
