"""Macros, routing, error kinds, crashes at each step of the log, snapshots by themselves, state in memory."""

from __future__ import annotations

import random

import pytest
from test_engine import ALL, BOOKS, DOOR, KINDS, SHELVE, Clock, book, door
from trace_data import CONDITIONS, ENTER, random_trace

import tidemark
from tidemark import BadEvent, LocalEngine, LogError, NoPolicies, PolicyError, PolicySet, Rejected, ShardPlan, StateError, TemporalEngine
from tidemark.functions.values import Uid
from tidemark.plans.incremental import History, Reader, Relation
from tidemark.plans.interpreter import Interpreter
from tidemark.plans.parser import parse_condition, parse_event_schema, parse_macros
from tidemark.policy_store import Add, Delete
from tidemark.sources.events import event_row
from tidemark.sources.log import FAULTS, Log

LIBRARY = """
macro lent(what) = formerly within 2h Action::"Lend"::request{ input.book: what };
macro twice(what) = exists (n: Long). ((count for (t: Timepoint). where (formerly within 2h (Action::"Lend"::request{ input.book: what } && tp(t)))) == n && n >= 2);
macro both(what) = lent(what) && twice(what);
"""


def test_exports() -> None:
    assert all(hasattr(tidemark, n) for n in tidemark.__all__)


def test_macros(tmp_path) -> None:
    e = TemporalEngine(None, str(tmp_path), Clock())
    policy = 'forbid (principal, action == Action::"Shelve", resource) when temporal { both(context.input.book) };'
    e.install(ALL + policy, BOOKS, macros=LIBRARY)
    e.submit(book("Lend"))
    assert e.submit(book("Shelve")).decision.allowed
    e.submit(book("Lend"))
    assert not e.submit(book("Shelve")).decision.allowed and e.submit(book("Shelve", "other")).decision.allowed
    e.close()
    e = TemporalEngine(None, str(tmp_path), Clock())  # what was installed is read with its macros again
    assert not e.submit(book("Shelve")).decision.allowed
    e.checkpoint()
    e.close()
    e = TemporalEngine(None, str(tmp_path), Clock())
    assert not e.submit(book("Shelve")).decision.allowed
    before = e.status()
    for macros, source in ((LIBRARY + "macro more(x) = lent(x);", ALL), (None, ALL.replace(";", " when temporal { nothing(context.a) };")), (None, policy.replace("both(", "both(context.x, "))):
        with pytest.raises(Rejected):
            e.install(source, BOOKS, macros=macros)
    assert e.status() == before
    e.close()


def test_macros_keep_their_variables() -> None:
    """A variable of an argument isn't caught by one of the macro's own: the written-out condition is the one that holds."""
    macros = parse_macros(f'macro moved(w) = exists (u: String). (formerly within 9s Site::Action::"Move"::response{{ input.who: u, input.who: w }}); macro seen(w) = formerly within 9s Site::Action::"Enter"::response{{ input.who: w }};')
    short = parse_condition("exists (u: String). (seen(u) && moved(u))", macros)
    long = parse_condition('exists (u: String). ((formerly within 9s Site::Action::"Enter"::response{ input.who: u }) && exists (x: String). (formerly within 9s Site::Action::"Move"::response{ input.who: x, input.who: u }))')
    differ = 0
    for seed in range(8):
        rows = [event_row(e, i) for i, e in enumerate(random_trace(seed))]
        one = Interpreter(rows)
        got = [one.verdict(short, i) for i in range(len(rows))]
        assert got == [one.verdict(long, i) for i in range(len(rows))]
        differ += len(set(got)) == 2
    assert differ
    for bad in ("macro a(x) = lent(x);", "macro a(x) = tp(y) && z > 1;", "macro a(x, x) = tp(x);", "macro a(x) = tp(x); macro a(y) = tp(y);", "macro a(x) tp(x);"):
        with pytest.raises(PolicyError):
            parse_macros(bad)


def test_shard_plan_and_wire_keys() -> None:
    pinned = parse_event_schema(KINDS)
    plan = ShardPlan.of(pinned)
    assert plan.sharded and plan.keys == ("callerPrincipal",)
    grouped = ShardPlan.of(parse_event_schema("decision event <A>::ask { meta: { pin run: String = context.meta.run }, pin callerPrincipal: principalType(A) = principal }"))
    assert grouped.keys == ("callerPrincipal", "meta.run")
    message = {"action": "Action::X", "kind": "ask", "principal": 'U::"a"', "logged": {"meta": {"run": "1"}}}
    other = message | {"logged": {"meta": {"run": 1}}}
    assert grouped.key_of(message) == 'U::"a"\x1fs:1' and grouped.key_of(other) == 'U::"a"\x1fi:1'
    assert grouped.key_of(message | {"principal": None}) is None and grouped.key_of(message | {"logged": {"meta": {}}}) is None and grouped.key_of({"principal": "x"}) is None
    places = {grouped.shard_of(message | {"principal": f'U::"{i}"'}, 8) for i in range(200)}
    assert places == set(range(8)) and grouped.shard_of(message | {"principal": None}, 8) is None
    one_kind = parse_event_schema("decision event <A>::ask { pin callerPrincipal: principalType(A) = principal }\nevent <A>::tell { }")
    crooked = parse_event_schema("decision event <A>::ask { meta: { pin run: String = context.meta.other } }")
    assert [ShardPlan.of(s).reason for s in (one_kind, crooked, parse_event_schema("event <A>::tell { }"), parse_event_schema(""))] == [
        "callerPrincipal: not every kind of event declares it", "meta.run: the request has it at context.meta.other", "the schema declares no pin", "the schema declares no events"]
    e = TemporalEngine(None, None, Clock())
    assert not e.shard_plan().sharded and "installed" in e.shard_plan().reason
    e.install(ALL, event_schema=KINDS)
    assert e.shard_plan() == plan
    e.close()


def test_kinds_of_errors(tmp_path) -> None:
    e = TemporalEngine(None, str(tmp_path), Clock())
    with pytest.raises(NoPolicies):
        e.submit(book("Lend"))
    with pytest.raises(NoPolicies):
        e.would_decide(book("Lend"))
    for verbs in ([Add("permit")], [Delete("none")]):
        with pytest.raises(Rejected):
            e.batch(verbs)
    with pytest.raises(Rejected):
        e.install(ALL, event_schema="event")
    e.install(ALL)
    e.submit(book("Lend"), ts=5)
    with pytest.raises(BadEvent):
        e.submit(book("Lend"), ts=5)
    with pytest.raises(BadEvent):
        e.submit(book("Lend") | {"principal": Uid("no name", "x")})
    e.close()
    segment = next(tmp_path.glob("segment-*"))
    segment.write_bytes(segment.read_bytes().replace(b'{"o": 3', b'{"o": 9'))  # a hole
    with pytest.raises(LogError):
        TemporalEngine(None, str(tmp_path), Clock())


class Stop(Exception):
    pass


@pytest.mark.parametrize("point", FAULTS)
def test_a_crash_at_each_point(tmp_path, point: str) -> None:
    """A log left at any point opens again with all that was durable, whole commits only, and decides like one that never stopped."""
    armed = [False]

    def faults(reached: str) -> None:
        if armed[0] and reached == point:
            raise Stop

    e = TemporalEngine(None, str(tmp_path), Clock(), faults=faults)
    e.log.segment_records = 3
    e.install(ALL + SHELVE, BOOKS)
    for i in range(8):
        e.submit(book("Lend", f"d{i}"))
    armed[0] = True
    with pytest.raises(Stop):
        e.submit(book("Lend", "late"))
        e.batch([Add(ALL), Add(ALL)])
        e.checkpoint()
    durable = point not in ("append_before", "commit_before")
    e = TemporalEngine(None, str(tmp_path), Clock())
    assert e.submit(book("Shelve", "late")).decision.allowed == (point == "append_before")
    assert [e.submit(book("Shelve", f"d{i}")).decision.allowed for i in (0, 3, 7)] == [False] * 3 and e.submit(book("Shelve", "never")).decision.allowed
    assert len(e.list()) == (4 if durable and point.startswith(("commit", "checkpoint", "prune")) else 2)
    offsets = [o for o, _ in e.log.scan_from(0)]
    assert offsets == list(range(offsets[0], e.log.next))
    e.checkpoint()
    assert not e.submit(book("Shelve", "d0")).decision.allowed
    e.close()
    names = {p.name for p in tmp_path.iterdir()}
    log = Log(str(tmp_path))
    assert {n for n in names if n.startswith(("segment", "snapshot"))} == {f"segment-{s:020d}.jsonl" for s in log.manifest["segments"]} | {log.manifest["snapshot"]["file"]}
    log.close()


def test_snapshots_by_themselves(tmp_path) -> None:
    e = TemporalEngine(None, str(tmp_path), Clock(), snapshot_every=5)
    e.log.segment_records = 2
    e.install(ALL + SHELVE, BOOKS)
    for i in range(12):
        e.submit(book("Lend", f"d{i}"))
    found = e.log.get_snapshot()
    assert found[0] == 13 and e.status()["watermark"] > 0 and len(found[1]["history"]) == 10  # after 3 verbs and 10 events
    e.close()
    e = TemporalEngine(None, str(tmp_path), Clock())
    assert not e.submit(book("Shelve", "d0")).decision.allowed and not e.submit(book("Shelve", "d11")).decision.allowed
    e.close()


def test_what_a_batch_kept() -> None:
    e = TemporalEngine(None, None, Clock())
    first = e.install(ALL + SHELVE, BOOKS)
    assert (first.first_offset, first.offset, first.leaves_retained, first.leaves_fresh) == (0, 2, 0, 1)
    more = e.batch([Add(SHELVE), Add(SHELVE)])
    assert (more.first_offset, more.offset, more.leaves_retained, more.leaves_fresh) == (3, 4, 1, 2) and e.has_policy(more.minted[0]) and not e.has_policy("none")
    assert e.batch([]) == tidemark.BatchResult(4, (), 5, e.stamp(), 3, 0)
    e.close()


def test_unknown_tokens_fail_closed() -> None:
    e = TemporalEngine(None, None, Clock())
    token = e.install('@id("a") permit (principal, action, resource);').minted[0]
    good = e.attribute(tidemark.Decision(True, (token, token), ("x",)))
    assert good.allowed and [a.annotation_id for a in good.reason] == ["a"] and good.errors == ("x",)
    bad = e.attribute(tidemark.Decision(True, (token, "gone"), ("x",)))
    assert not bad.allowed and bad.reason == () and bad.errors[0] == "x" and len(bad.errors) == 2
    e.close()


def test_would_decide_writes_nothing() -> None:
    clock = Clock()
    e = TemporalEngine(None, None, clock, rate=1)
    e.install(DOOR, event_schema=KINDS)
    clock.now = 100
    e.submit(door("Badge", "accepted"))
    before = e.status()
    assert e.would_decide(door("Unlock", "asked")).allowed and not e.would_decide(door("Unlock", "asked", "stranger")).allowed
    assert e.status() == before and e.submit(door("Unlock", "asked")).outcome.allowed and e.submit(door("Badge", "accepted")).outcome == tidemark.RECORDED
    e.close()


def test_state_in_memory() -> None:
    """Saved and loaded at any event, an engine goes on as if nothing had happened; a state for other conditions is refused."""
    source = f'permit (principal, action, resource) when temporal {{ formerly within 9s {ENTER} }};'
    policies, _ = PolicySet().fold([Add(source)], 0, 0)
    schema = parse_event_schema("decision event <A>::request { pin callerPrincipal: principalType(A) = principal }\nevent <A>::response { pin callerPrincipal: principalType(A) = principal }")
    rows = [event_row(e) | {"id": i} for i, e in enumerate(random_trace(4, 60))]

    def run(cut: int | None) -> list[bool]:
        e, out = LocalEngine(1, schema), []
        e.prepare(policies)
        for i, row in enumerate(rows):
            if i == cut:
                state = e.save()
                e = LocalEngine(1, schema)
                e.prepare(policies)
                e.load(state)
            history = e.observe(dict(row))
            if row["kind"] == "request":
                out.append(e.evaluate(history).allowed)
        return out

    assert len({tuple(run(c)) for c in (None, 0, 20, 59)}) == 1 and set(run(None)) == {True, False}
    e = LocalEngine(1, schema)
    e.prepare(policies)
    for change in ({"fingerprint": e.fingerprint() | {"pins": []}}, {"fingerprint": e.fingerprint() | {"version": 1}}, {"shards": [["a", []], ["a", []]]}):
        with pytest.raises(StateError):
            e.load(e.save() | change)


def test_another_evaluator() -> None:
    class Odd:
        def __init__(self, policies: PolicySet, rate: int) -> None:
            self.n = len(policies.entries)

        def decide(self, history: History) -> tidemark.Decision:
            return tidemark.Decision(len(history.rows) % 2 == self.n % 2)

    e = TemporalEngine(None, None, Clock(), evaluator=Odd)
    e.install(ALL)
    assert [e.submit(book("Lend")).decision.allowed for _ in range(4)] == [True, False, True, False]
    e.close()


def test_relations() -> None:
    """The rows of a condition at each place are the interpreter's."""
    for seed, text in enumerate(CONDITIONS[:12]):
        node, rows = parse_condition(text), [event_row(e, i) | {"id": i} for i, e in enumerate(random_trace(seed, 40))]
        found, one = Relation(Reader(), History(rows), node), Interpreter(rows)
        want = {k: one.rows(node, k, {}, len(rows) - 1) for k in range(len(rows))}
        assert dict(found) == {k: v for k, v in want.items() if v} and found.is_empty() == (not any(want.values()))
        assert dict(found.range(5, 11)) == {k: v for k, v in want.items() if v and 5 <= k <= 11} and found.at(99) == set()


def test_histories_forget_what_no_window_reaches() -> None:
    """Over a long stream the rows, the matches and the keys kept stay within a few windows."""
    e = TemporalEngine(None, None, Clock(), rate=1)
    e.install(ALL + SHELVE, BOOKS, event_schema="max_window = 2h\ndecision event <A>::request { }")
    rng = random.Random(1)
    for i in range(6000):
        e.submit(book("Lend" if i % 3 else "Shelve", f"d{i}-{rng.randrange(9)}"), ts=i * 60)
    (history,) = e.histories.values()
    assert len(history.rows) <= 300 and all(len(ix.tracks) <= 400 for ix in history.indexes.values())
    e.close()
