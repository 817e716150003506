"""The engine: golden traces, verbs, histories, recovery, attribution, streams."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from trace_data import ENTER, LEAVE, random_trace

from tidemark.engine import Evaluator, TemporalEngine
from tidemark.functions.values import Dec, Uid, saturating, tag, untag
from tidemark.plans import analysis as N
from tidemark.plans.decision import decide
from tidemark.plans.incremental import History
from tidemark.errors import PolicyError
from tidemark.plans.parser import EventSchema, parse_action_schema, parse_condition, parse_event_schema, parse_policies
from tidemark.policy_store import Add, AppendActionSchema, Delete, DeleteAll, PolicySet, Reset, ResetAll, SetActionSchema, Update
from tidemark.sources.events import Trace, decode_event, decode_value, encode_event, encode_value, event_row, from_rows, parse_uid, read_trace, read_wire, verdict_lines
from tidemark.sources.log import Log, scan

DOOR = """
@id("badge") permit (principal, action == Lab::Action::"Badge", resource);
@id("unlock_after_badge") permit (principal, action == Lab::Action::"Unlock", resource)
when temporal { formerly within 20m Lab::Action::"Badge"::accepted{ input.holder: context.input.holder } };
"""
KINDS = "decision event <A>::asked { ...inputs(A), pin callerPrincipal: principalType(A) = principal }\nevent <A>::accepted { ...inputs(A), pin callerPrincipal: principalType(A) = principal }"
BOOKS = 'entity Member; entity Book; action "Lend", "Shelve", "Scrap", "Enter" appliesTo { principal: Member, resource: Book, context: { input: { book: String } } };'
SHELVE = 'forbid (principal, action == Action::"Shelve", resource) when temporal { formerly within 2h Action::"Lend"::request{ input.book: context.input.book } };'
ALL = 'permit (principal, action, resource);'


def door(action: str, kind: str, holder: str = "kim") -> dict:
    return {"ns": "Lab", "action": action, "kind": kind, "principal": Uid("Staff", holder), "resource": Uid("Door", "north"), "logged": {"input": {"holder": holder}}, "context": {"input": {"holder": holder}}}


def book(action: str, name: str = "atlas", **more) -> dict:
    return {"ns": "", "action": action, "kind": "request", "principal": Uid("Member", "kim"), "resource": Uid("Book", "b"), "logged": {"input": {"book": name}}, "context": {"input": {"book": name}}} | more


class Clock:
    def __init__(self) -> None:
        self.now = 0

    def __call__(self) -> int:
        return self.now


@pytest.fixture
def engine(tmp_path):
    e = TemporalEngine(None, str(tmp_path / "log"), clock=Clock())
    yield e
    e.close()


def test_door_opens_after_a_badge(spark) -> None:
    """The badge at 100 opens the door up to 1300, its window's last second, and for its holder alone."""
    e = TemporalEngine(spark, rate=1, clock=Clock())
    e.install(DOOR, event_schema=KINDS)
    steps = [(90, "Unlock", "asked", "kim"), (95, "Badge", "asked", "kim"), (100, "Badge", "accepted", "kim"), (700, "Unlock", "asked", "kim"), (710, "Unlock", "asked", "lou"), (1300, "Unlock", "asked", "kim"), (1301, "Unlock", "asked", "kim")]
    got = [e.submit(door(a, k, h), ts).decision for ts, a, k, h in steps]
    assert [d and d.allowed for d in got] == [False, True, None, True, False, True, False]
    batch = [(r["ts"], r["allowed"]) for r in e.decide_log().orderBy("id").collect()]
    assert batch == [(90, False), (95, True), (700, True), (710, False), (1300, True), (1301, False)]
    reason = e.attribution(got[3].reason[0])
    assert reason.annotation_id == "unlock_after_badge" and reason.description is None
    e.close()


def test_count_in_a_closed_window(spark, tmp_path) -> None:
    """Alarms of level 3 at 10, 25, ..., 70: five of them reach the window of 90 seconds that ends at 100, four the one that ends at 101."""
    scope = 'scope(principal: Guard::"g", resource: Site::"s")'
    lines = [f'@{t} {scope} Action::"Alarm"::noted(input: {{ level: 3 }}, ref: "a{t}")' for t in range(10, 71, 15)] + [f'@{t} Action::"Alarm"::noted(input: {{ level: 1 }})' for t in (71, 72)]
    lines += [f'@{t} {scope} Action::"Shut"::asked(input: {{ why: "{t}" }})' for t in (69, 100, 101, 160)]
    (tmp_path / "trace.log").write_text("\n".join(sorted(lines, key=lambda x: int(x[1:].split()[0]))) + "\n")
    policy = 'permit (principal, action == Action::"Shut", resource) when temporal { exists (k: Long). (count for (at: Timepoint). where formerly within 90s (Action::"Alarm"::noted{ input.level: 3 } && tp(at))) == k && k > 4 };'
    e = TemporalEngine(spark, rate=1, clock=Clock())
    e.install(policy, event_schema="decision event <A>::asked { ...inputs(A) }\nevent <A>::noted { ...inputs(A) }")
    events = read_trace(spark, str(tmp_path / "trace.log")).withColumnRenamed("line", "id").drop("tp")
    got = [r["line"] for r in verdict_lines(e.decide(events)).orderBy("tp").collect()]
    assert got == ["@69 (time point 4): false", "@100 (time point 8): true", "@101 (time point 9): false", "@160 (time point 10): false"]
    e.close()


def test_trace_of_several_files_is_in_order(spark, tmp_path) -> None:
    """Files follow one another by name, and lines by place, however Spark deals the files out."""
    (tmp_path / "t").mkdir()
    for name, stamps in (("a.log", range(1, 3)), ("b.log", range(3, 400)), ("c.log", range(400, 402))):
        (tmp_path / "t" / name).write_text("".join(f'@{t} Action::"Alarm"::noted(input: {{ level: {t} }})\n\n' for t in stamps))
    rows = read_trace(spark, str(tmp_path / "t")).orderBy("line").collect()
    assert [r["ts"] for r in rows] == list(range(1, 402))


def test_verbs_keep_and_reset_histories(engine) -> None:
    engine.install(ALL + SHELVE, BOOKS)
    _, forbid = [x.token for x in engine.list()]
    engine.submit(book("Lend"))
    assert not engine.submit(book("Shelve")).decision.allowed
    engine.batch([SetActionSchema(BOOKS)])
    assert not engine.submit(book("Shelve")).decision.allowed
    engine.batch([Reset(forbid)])
    assert engine.submit(book("Shelve")).decision.allowed
    engine.submit(book("Lend"))
    assert not engine.submit(book("Shelve")).decision.allowed
    other = SHELVE.replace('"Shelve"', '"Scrap"')
    engine.batch([Add(other)])
    assert engine.submit(book("Scrap")).decision.allowed  # a new policy starts without a history
    engine.batch([Update(forbid, SHELVE)])
    assert engine.submit(book("Shelve")).decision.allowed
    engine.batch([ResetAll()])
    engine.batch([Delete(forbid)])
    assert engine.submit(book("Shelve")).decision.allowed
    engine.batch([DeleteAll()])
    assert not engine.submit(book("Shelve")).decision.allowed
    assert engine.submit(book("Shelve")).decision.reason == ()
    minted = engine.batch([Add(ALL)]).minted
    assert engine.list()[0].ordinal == 3 and engine.get_policy(minted[0]).statement == ALL


def test_a_refused_batch_writes_nothing(engine) -> None:
    engine.install(ALL, BOOKS)
    before = engine.status()
    for verbs in ([Add(ALL), Delete("none")], [Add("")], [Update(engine.list()[0].token, ALL + ALL)], [Add('permit (principal, action == Action::"Nope", resource);')], [Add("permit (principal, action, resource) when temporal { context.a == 1 };")], [Add(SHELVE.replace("2h", "25h"))]):
        with pytest.raises(PolicyError):
            engine.batch(verbs)
    assert engine.status() == before


def test_recovery_and_checkpoint(tmp_path) -> None:
    path, clock = str(tmp_path / "log"), Clock()
    e = TemporalEngine(None, path, clock)
    e.log.segment_records = 4
    e.install(ALL + SHELVE, BOOKS)
    for i in range(12):
        e.submit(book("Lend", f"d{i}"))
    e.close()
    e = TemporalEngine(None, path, clock)
    assert [x.statement for x in e.list()] == [ALL, SHELVE]
    assert not e.submit(book("Shelve", "d3")).decision.allowed
    e.log.segment_records = 4
    assert e.checkpoint() > 0 and e.status()["watermark"] > 0
    e.submit(book("Lend", "late"))
    e.close()
    e = TemporalEngine(None, path, clock)
    for name, allowed in (("d3", False), ("late", False), ("never", True)):
        assert e.submit(book("Shelve", name)).decision.allowed == allowed
    e.checkpoint()
    e.close()
    with pytest.raises(PolicyError):
        TemporalEngine(None, path, clock, rate=1)


def test_a_cut_off_commit_is_dropped(tmp_path) -> None:
    log = Log(str(tmp_path))
    log.commit([{"ts": 1, "delete_all": {}}, {"ts": 1, "reset_all": {}}])
    log.append({"ts": 2, "reset_all": {}})
    log.close()
    segment = next(p for p in os.listdir(tmp_path) if p.startswith("segment"))
    data = (tmp_path / segment).read_bytes()
    (tmp_path / segment).write_bytes(data[:-4])
    log = Log(str(tmp_path))
    assert log.next == 2 and [o for o, _ in log.scan_from(0)] == [0, 1]
    assert log.append({"ts": 3, "reset_all": {}}) == 2
    log.close()


def test_log_batches_and_scan(spark, tmp_path) -> None:
    log = Log(str(tmp_path), segment_records=3)
    for i in range(10):
        log.append({"ts": i, "event": {"n": i}})
    assert [o for o, _ in log.read_batch(2, max_records=4)] == [2, 3, 4, 5]
    assert len(log.read_batch(0, max_bytes=1)) == 1
    rows = scan(spark, log, 4).orderBy("offset").collect()
    assert [(r["offset"], r["ts"], r["kind"], json.loads(r["body"])["n"]) for r in rows] == [(i, i, "event", i) for i in range(4, 10)]
    assert log.prune_below(7).watermark == 6
    assert [o for o, _ in log.scan_from(0)] == [6, 7, 8, 9]
    log.close()


def test_stamps(tmp_path) -> None:
    clock = Clock()
    e = TemporalEngine(None, str(tmp_path), clock)
    e.install(ALL)
    clock.now = 100
    first, second = e.submit(book("Lend")), e.submit(book("Lend"))
    assert (first.ts, second.ts) == (100, 101)
    with pytest.raises(PolicyError):
        e.submit(book("Lend"), ts=101)
    e.submit(book("Lend"), ts=10**15)
    e.close()
    with pytest.raises(PolicyError):
        TemporalEngine(None, str(tmp_path), clock)


def _decisions(spark, source: str, events: list[dict], schema: str = "", rate: int = 1) -> tuple[list, list]:
    """Batch decisions, and those of the evaluator one by one."""
    policies, _ = PolicySet(max_window=10**9, schema_text=schema).fold([Add(source)], 0, 0)
    names = {e.token: dict(e.policy.annotations).get("id") for e in policies.entries}
    kinds = EventSchema({"request": True, "response": False}, ())
    rows = decide(Trace(from_rows(spark, events)), policies, kinds, rate).orderBy("id").collect()
    batch = [(r["id"], r["allowed"], sorted(names[t] for t in r["reason"]), sorted(names.get(t, t) for t in r["errors"])) for r in rows]
    one, history, single = Evaluator(policies, rate), History(), []
    for i, e in enumerate(events):
        history.add(event_row(e, i) | {"id": i})
        if e["kind"] == "request":
            d = one.decide(history)
            single.append((i, d.allowed, sorted(names[t] for t in d.reason), sorted(names.get(t, t) for t in d.errors)))
    return batch, single


def test_attribution_errors_and_membership(spark) -> None:
    source = """
    @id("p") permit (principal, action, resource);
    @id("f") forbid (principal, action == Action::"Look", resource) when { context.input.n == 5 };
    @id("g") forbid (principal, action == Action::"Look", resource) when { context.input.n > 4 };
    @id("over") forbid (principal, action, resource) when { context.input.n + 1 < 0 };
    @id("admin") permit (principal in Group::"admins", action, resource) when { principal has dept && principal.dept == "eng" };
    @id("not") forbid (principal, action, resource) unless { context.input.n < 1000 || context has other };
    """

    def read(n: int | None, **more) -> dict:
        return {"ts": 1, "ns": "", "action": "Look", "kind": "request", "principal": Uid("User", "a"), "resource": Uid("Thing", "d"), "logged": {}, "context": {"input": {"n": n}} if n is not None else {}} | more

    up = {Uid("User", "a"): [Uid("Group", "eng")], Uid("Group", "eng"): [Uid("Group", "admins")]}
    events = [read(1), read(5), read(2**63 - 1), read(1, principal=None), read(1, parents=up, entities={Uid("User", "a"): {"dept": "eng"}}), read(None), read(1, parents=up)]
    batch, single = _decisions(spark, source, events)
    assert batch == single
    assert batch[1] == (1, False, ["f", "g"], [])
    assert batch[2] == (2, False, ["g", "not"], ["over"])
    assert batch[3] == (3, False, [], ["missing scope"])
    assert batch[4][2] == ["admin", "p"] and batch[6][2] == ["p"]


def test_unresolved_correlation_and_two_bags(spark) -> None:
    policy = '@id("x") permit (principal, action == Site::Action::"Look", resource) when temporal {{ {} }};'
    events = random_trace(5, 40)
    for text in (f"formerly within 100s {ENTER}", f"!(formerly within 100s {ENTER})", f"(count for (t: Timepoint). where (formerly within 100s ({ENTER} && tp(t)))) == 0"):
        batch, single = _decisions(spark, policy.format(text), events)
        assert batch == single and {b[1] for b in batch} == {True, False}


def test_slicing_changes_no_decision(spark) -> None:
    schema = 'namespace Site { action "Look", "Enter", "Leave", "Move" in [Action::"Any"] appliesTo { principal: U, resource: G, context: {} }; action "Any"; entity U; entity G; }'
    source = f"""
    @id("a") permit (principal, action in [Site::Action::"Any"], resource) when temporal {{ formerly within 9s {ENTER} }};
    @id("b") forbid (principal, action == Site::Action::"Look", resource) when temporal {{ formerly within 3s {LEAVE} }} unless temporal {{ formerly within 2s {ENTER} }};
    """
    policies, _ = PolicySet(schema_text=schema).fold([Add(source)], 0, 0)
    assert [len(x.actions) for x in policies.leaves()] == [5, 1, 1]
    trace, kinds = Trace(from_rows(spark, random_trace(6, 50))), EventSchema({"request": True, "response": False}, ())
    got = [decide(trace, policies, kinds, 1, sliced).select("id", "allowed", "reason").orderBy("id").collect() for sliced in (True, False)]
    assert got[0] == got[1] and len({r["allowed"] for r in got[0]}) == 2


def test_many_leaves_of_one_shape(spark) -> None:
    leaf = '@id("f{n}") forbid (principal, action == Site::Action::"Look", resource) when temporal {{ formerly within 9s Site::Action::"Move"::response{{ input.units: {n}, input.who: context.input.who }} }};'
    source = '@id("p") permit (principal, action, resource);' + "".join(leaf.format(n=n) for n in range(-2, 10))
    batch, single = _decisions(spark, source, random_trace(9, 60))
    assert batch == single and any(b[2] not in (["p"], []) for b in batch)


def test_stream_like_batch(spark, tmp_path) -> None:
    events = random_trace(11, 50, ties=False)
    e = TemporalEngine(spark, rate=1, clock=Clock())
    source = f'permit (principal, action, resource) when temporal {{ formerly within 90s {ENTER} }}; forbid (principal, action, resource) when temporal {{ previous within 2s {LEAVE} }};'
    e.install(source, event_schema="decision event <A>::request { pin callerPrincipal: principalType(A) = principal }\nevent <A>::response { pin callerPrincipal: principalType(A) = principal }")
    frame = from_rows(spark, events).withColumnRenamed("tp", "id")
    for low in range(0, 50, 20):
        frame.where((F.col("id") >= low) & (F.col("id") < low + 20)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    schema = frame.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = e.decide_stream(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r["id"], r["tp"], r["allowed"], r["reason"]) for r in spark.table("decided").collect())
    want = sorted((r["id"], r["tp"], r["allowed"], ",".join(r["reason"])) for r in e.decide(frame).collect())
    assert got == want and len({w[2] for w in want}) == 2
    e.close()


def test_values_and_codecs() -> None:
    assert tag(Dec("1.50")) == tag(Dec("01.5")) == "d:1.5" and tag(Dec("-0.0")) == tag(Dec("0.0")) and Dec("1.5") != Dec("1.51")
    assert tag("7") != tag(7) and tag(Uid("U", "a")) != tag('U::"a"') and tag(True) != tag("true")
    for v in (None, True, -5, "text ü", Uid("A::B", 'q"\\'), [1, [None, "x"]], {"b": 1, "a": {"c": Dec("2.5")}}):
        assert untag(tag(v)) == v and decode_value(encode_value(v)) == v
    e = {"ts": 3, "ns": "A::B", "action": "x::y", "kind": "request", "principal": Uid("U", "a"), "resource": None, "logged": {"input": {"d": Dec("1.50")}}, "context": {}, "entities": {Uid("U", "a"): {"n": 1}}, "parents": {Uid("U", "a"): [Uid("G", "g")]}}
    assert decode_event(json.loads(json.dumps(encode_event(e))), 3) == e
    for bad in (["i", "7"], ["i", 2**63], ["q", 1], ["b", 1], 5):
        with pytest.raises(PolicyError):
            decode_value(bad)
    assert parse_uid('A::B::"x::y"') == Uid("A::B", "x::y") and parse_uid("A::B") is None and parse_uid('"x"') is None
    w = read_wire('{"action": "D::Action::Read", "kind": "request", "principal": "U::\\"a\\"", "logged": {"input": {"u": "U::\\"b\\"", "n": 1.50, "big": 99999999999999999999}, "top": 3}}')
    assert w["principal"] == Uid("U", "a") and w["logged"] == {"input": {"u": Uid("U", "b"), "n": Dec("1.50"), "big": Dec("99999999999999999999")}}
    with pytest.raises(PolicyError):
        read_wire('{"action": "D::Action::Read", "kind": "request", "extra": 1}')


def test_saturating_arithmetic(spark) -> None:
    top, low = 2**63 - 1, -(2**63)
    cases = [("+", top, 1, top), ("-", low, 1, low), ("*", top, top, top), ("*", low, top, low), ("*", low, low, top), ("+", 3, 4, 7)]
    for op, a, b, want in cases:
        row = spark.range(1).select(saturating(op, F.lit(a).cast("long"), F.lit(b).cast("long")).alias("x")).first()
        assert row["x"] == want


def test_keys_windows_and_schemas() -> None:
    a, b = parse_condition(f"formerly within 1h {ENTER}"), parse_condition(f"formerly within 60m {ENTER}")
    assert N.key(a) == N.key(b) and N.horizon(parse_condition(f"formerly within 1h (previous within 30m {ENTER})")) == 5400
    assert len({N.key(parse_condition(c)) for c in (f"formerly within 1h {ENTER}", f"formerly within 2h {ENTER}", f"previous within 1h {ENTER}", f"formerly within 1h !{ENTER}")}) == 4
    s = parse_action_schema('namespace A { type I = { u: String, n?: Long }; entity U in [G] = { d: String } tags String; action "x" in [Action::"g"] appliesTo { principal: [U], resource: [U], context: { input: I } }; action "g"; }')
    assert s.expand((("A", "g"),)) == {("A", "g"), ("A", "x")} and s.fields["A", "x"]["input"] == {"u": "String", "n?": "Long"}
    e = parse_event_schema("max_window = 2h\ndecision event <A>::request { ...inputs(A), meta: { pin session_id: String = context.meta.session_id } }\nevent <A>::done { meta: { pin session_id: String = context.meta.session_id }, pin callerPrincipal: principalType(A) = principal }")
    assert e.pins == ("meta.session_id",) and e.max_window == 7200 and e.decisions == ("request",)
    p = parse_policies('@id("a\\u{e9}") @reviewed permit (principal == U::"x", action in [A::Action::"q::r"], resource in G::"y");')[0]
    assert p.annotations == (("id", "aé"), ("reviewed", "")) and p.scope.actions == (("A", "q::r"),)
    for bad in ("permit (principal, action, resource)", "allow (principal, action, resource);", "permit (principal, action, resource) when temporal { formerly A::Action::\"x\"::request{} };", "permit (principal, action, resource) when { 99999999999999999999 > 1 };"):
        with pytest.raises(PolicyError):
            parse_policies(bad)


def test_list_pages(engine) -> None:
    engine.install(ALL * 5)
    first = engine.list(2)
    assert [e.ordinal for e in engine.list(2, first[-1].token)] == [2, 3]
    with pytest.raises(PolicyError):
        engine.list(0)


def test_append_schema(engine) -> None:
    engine.install(ALL, BOOKS)
    engine.batch([AppendActionSchema('action "Share" appliesTo { principal: User, resource: Doc, context: {} };'), Add('permit (principal, action == Action::"Share", resource);')])
    assert ("", "Share") in engine.policies.schema.actions


def test_many_leaves_share_one_plan_per_shape() -> None:
    forms = {N.shape(parse_condition(f'formerly within 1h Site::Action::"Enter"::response{{ input.user: "u{n}", input.server: context.input.server }}'))[0] for n in range(50)}
    assert len(forms) == 1


def test_mixed_shapes_share_a_pass(spark, tmp_path) -> None:
    """Fifty clauses of many shapes over the same two key sets: the plan reads the events once for each, and the decisions once; the result is the evaluator's."""
    me, there = "input.who: context.input.who", "input.units: context.input.units"
    site = lambda action, keys: f'Site::Action::"{action}"::response{{ {keys} }}'
    shapes = []
    for k in (me, there):
        for w in (2, 5, 9, 14):
            shapes += [f"formerly within {w}s {site('Enter', k)}", f"!(formerly within {w}s {site('Leave', k)})", f"!{site('Leave', k)} since within {w}s {site('Enter', k)}",
                       f"(count for (t: Timepoint). where (formerly within {w}s ({site('Move', k)} && tp(t)))) >= 2", f"exists (n: Long). ((sum a for (a: Long), (t: Timepoint). where (formerly within {w}s ({site('Move', k + ', input.units: a')} && tp(t)))) == n && n > 3)",
                       f"(formerly within {w}s {site('Move', k)}) && (count for (t: Timepoint). where (formerly within {w}s ({site('Enter', k)} && tp(t)))) < 3 || context.input.units == 4"]
    shapes += [f"formerly within 7s {site('Look', me)}", f"(formerly within 7s {site('Enter', me)}) || (formerly within 3s {site('Leave', there)})"]
    source = "".join(f'@id("s{i}") {"forbid" if i % 5 == 4 else "permit"} (principal, action == Site::Action::"Look", resource) when temporal {{ {c} }};' for i, c in enumerate(shapes))
    assert len(shapes) == 50
    events = random_trace(13, 70)
    batch, single = _decisions(spark, source, events)
    assert batch == single and len({b[1] for b in batch}) == 2
    path = str(tmp_path / "trace")
    from_rows(spark, events).write.parquet(path)
    policies, _ = PolicySet().fold([Add(source)], 0, 0)
    plan = decide(Trace(spark.read.parquet(path)), policies, EventSchema({"request": True, "response": False}, ()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
