"""Sockets, frames, the command line, durability and stale histories."""

from __future__ import annotations

import io
import json
import struct
import threading

import pytest
from test_engine import ALL, BOOKS, SHELVE, Clock, book

from tidemark.__main__ import main
from tidemark.engine import NANOS, TemporalEngine
from tidemark.errors import PolicyError
from tidemark.sources.wire import MAX_FRAME, Server, call, read_frame, write_frame

WIRE = {"action": "Action::Lend", "kind": "request", "principal": 'Member::"kim"', "resource": 'Book::"b"', "logged": {"input": {"book": "atlas", "score": 1.50}}, "context": {"input": {"book": "atlas"}}}


def test_frames() -> None:
    f = io.BytesIO()
    write_frame(f, {"a": "é"})
    write_frame(f, [1])
    f.seek(0)
    assert [json.loads(read_frame(f)), json.loads(read_frame(f)), read_frame(f)] == [{"a": "é"}, [1], None]
    for bad in (b"\0\0", struct.pack(">I", 5) + b"ab", struct.pack(">I", MAX_FRAME + 1)):
        with pytest.raises(PolicyError):
            read_frame(io.BytesIO(bad))


@pytest.fixture
def served(tmp_path):
    engine = TemporalEngine(None, str(tmp_path / "log"), clock=Clock())
    data, control = str(tmp_path / "d.sock"), str(tmp_path / "c.sock")
    server = Server(engine, data, control)
    yield engine, data, control
    server.close()
    engine.close()


def test_server(served) -> None:
    engine, data, control = served
    assert call(data, {"op": "ping"}) == {"ok": "pong"}
    minted = call(control, {"op": "install", "policies": ALL + SHELVE, "action_schema": BOOKS})["minted"]
    got = call(data, {"op": "submit", "event": WIRE})
    assert got["decision"]["decision"] == "allow" and got["decision"]["reason"][0]["id"] == minted[0]
    assert call(data, {"op": "submit", "event": WIRE | {"action": "Action::Shelve"}})["decision"]["decision"] == "deny"
    assert call(data, {"op": "submit", "event": WIRE | {"kind": "seen"}})["decision"] is None
    assert "d:1.5" in engine.histories['e:Member::"kim"'].rows[0]["logged"].values()
    assert [p["id"] for p in call(control, {"op": "list", "max_results": 1, "after": minted[0]})["policies"]] == [minted[1]]
    assert call(control, {"op": "get_policy_by_id", "id": minted[1]})["statement"] == SHELVE
    assert call(control, {"op": "batch", "verbs": [{"verb": "delete", "token": minted[1]}]})["minted"] == []
    assert "error" in call(control, {"op": "batch", "verbs": [{"verb": "drop"}]}) and "error" in call(data, {"op": "nope"})
    assert call(control, {"op": "status"})["policies"] == 1 and call(control, {"op": "get_schema"})["action_schema"] == BOOKS
    assert "pruned" in call(control, {"op": "checkpoint"}) and call(control, {"op": "get_policy"})["source"] == ALL
    before = engine.log.next
    threads = [threading.Thread(target=lambda: [call(data, {"op": "submit", "event": WIRE}) for _ in range(10)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert engine.log.next == before + 40


def test_command_line(served, tmp_path, capsys) -> None:
    _, data, control = served
    at = ["--data", data, "--control", control]
    (tmp_path / "p").write_text(ALL)
    (tmp_path / "s").write_text(BOOKS)
    (tmp_path / "e").write_text(json.dumps(WIRE))
    assert main([*at, "policy", "install", str(tmp_path / "p"), "--action-schema", str(tmp_path / "s")]) == 0
    assert main([*at, "submit", str(tmp_path / "e")]) == 0 and main([*at, "ping"]) == 0 and main([*at, "status"]) == 0
    assert main([*at, "policy", "delete-all"]) == 0 and main([*at, "submit", str(tmp_path / "e")]) == 1
    assert main([*at, "policy", "show", "none"]) == 2
    assert '"deny"' in capsys.readouterr().out


def test_durability_modes(tmp_path) -> None:
    e = TemporalEngine(None, str(tmp_path), Clock())
    assert e.durability() == (1, float("inf"))
    e.install(ALL)
    e.set_durability(100)
    e.submit(book("Lend"))
    assert e.log._waiting == 1
    e.set_durability(100, 0.0)
    e.submit(book("Lend"))
    assert e.log._waiting == 0
    e.close()


def test_stale_histories_go(tmp_path) -> None:
    clock = Clock()
    e = TemporalEngine(None, str(tmp_path), clock)
    e.install(ALL + SHELVE, BOOKS)
    from tidemark.functions.values import Uid

    for i in range(5):
        e.submit(book("Lend", principal=Uid("Member", f"u{i}")))
    clock.now = 25 * 3600 * NANOS
    e.submit(book("Lend"))
    assert e.status()["shards"] == 6 and e.maintain_all() == 5 and e.status()["shards"] == 1
    e.close()


def test_a_snapshot_for_other_conditions_is_refused(tmp_path) -> None:
    e = TemporalEngine(None, str(tmp_path), Clock())
    e.install(ALL + SHELVE, BOOKS)
    e.submit(book("Lend"))
    e.checkpoint()
    e.close()
    file = next(tmp_path.glob("snapshot-*.json"))
    file.write_text(file.read_text().replace('"pins": ["callerPrincipal"]', '"pins": []'))
    with pytest.raises(PolicyError):
        TemporalEngine(None, str(tmp_path), Clock())
