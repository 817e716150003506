"""The engine behind two Unix sockets: framed JSON messages, data on one, control on the other."""

from __future__ import annotations

import json
import os
import socket
import socketserver
import struct
import threading
from collections.abc import Callable
from typing import Any, BinaryIO

from ..engine import TemporalEngine
from ..errors import PolicyError
from ..functions.values import Dec
from ..policy_store import VERBS, Entry
from .events import read_wire_event

#: The largest frame.
MAX_FRAME = 16 << 20


def write_frame(out: BinaryIO, message: Any) -> None:
    """Four bytes of length, high byte first, then JSON."""
    body = json.dumps(message, ensure_ascii=False).encode()
    if len(body) > MAX_FRAME:
        raise PolicyError("the frame is too large")
    out.write(struct.pack(">I", len(body)) + body)
    out.flush()


def read_frame(src: BinaryIO) -> bytes | None:
    """The body of the next frame, None at the end."""
    head = src.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise PolicyError("a frame was cut off")
    (size,) = struct.unpack(">I", head)
    if size > MAX_FRAME:
        raise PolicyError("the frame is too large")
    body = src.read(size)
    if len(body) < size:
        raise PolicyError("a frame was cut off")
    return body


def _entry(e: Entry) -> dict[str, Any]:
    return {"id": e.token, "statement": e.statement, "created": e.created, "updated": e.updated, "annotations": dict(e.policy.annotations)}


def handle_data(engine: TemporalEngine, body: bytes) -> dict[str, Any]:
    """``{"op": "ping"}`` or ``{"op": "submit", "event": {...}}``"""
    message = json.loads(body)
    if message.get("op") == "ping":
        return {"ok": "pong"}
    if message.get("op") != "submit":
        raise PolicyError("no such data operation")
    # Parsed again with decimals by their digits
    event = json.loads(body, parse_float=Dec)["event"]
    got = engine.submit(read_wire_event(event))
    decision = None
    if got.decision:
        found = engine.attribute(got.decision)
        reason = [{"id": a.token, "annotations": dict(a.annotations)} for a in found.reason]
        decision = {"decision": "allow" if found.allowed else "deny", "reason": reason, "errors": list(found.errors)}
    return {"offset": got.offset, "ts": got.ts, "decision": decision}


def handle_control(engine: TemporalEngine, body: bytes) -> dict[str, Any]:
    """install, batch, list, status, get_policy, get_policy_by_id, get_schema, checkpoint."""
    m = json.loads(body)
    op = m.get("op")
    if op == "install":
        got = engine.install(m["policies"], m.get("action_schema", ""), m.get("event_schema"), m.get("macros"))
        return {"offset": got.offset, "minted": list(got.minted)}
    if op == "batch":
        verbs = []
        for v in m["verbs"]:
            kind = v.pop("verb", None)
            if kind not in VERBS:
                raise PolicyError(f"no verb {kind!r}")
            verbs.append(VERBS[kind](**v))
        got = engine.batch(verbs)
        return {"offset": got.offset, "minted": list(got.minted)}
    if op == "list":
        return {"policies": [_entry(e) for e in engine.list(m.get("max_results"), m.get("after"))]}
    if op == "status":
        return engine.status()
    if op == "get_policy":
        return {"source": engine.policy_source()}
    if op == "get_policy_by_id":
        return _entry(engine.get_policy(m["id"]))
    if op == "get_schema":
        return {"action_schema": engine.action_schema(), "event_schema": engine.event_schema.text}
    if op == "checkpoint":
        return {"pruned": engine.checkpoint()}
    raise PolicyError("no such control operation")


def _handler(engine: TemporalEngine, answer: Callable[[TemporalEngine, bytes], dict], lock: threading.Lock, slots: threading.BoundedSemaphore, idle: float) -> type:
    class Handler(socketserver.StreamRequestHandler):
        timeout = idle

        def handle(self) -> None:
            if not slots.acquire(blocking=False):
                write_frame(self.wfile, {"error": "too many connections"})
                return
            try:
                while (body := read_frame(self.rfile)) is not None:
                    try:
                        with lock:
                            reply = answer(engine, body)
                    except (PolicyError, KeyError, TypeError, ValueError) as error:
                        reply = {"error": str(error), "kind": type(error).__name__}
                    write_frame(self.wfile, reply)
            except (TimeoutError, PolicyError, OSError):
                return
            finally:
                slots.release()

    return Handler


class Server:
    """Serves an engine; one lock puts all requests in one order. At most ``most`` connections a socket; idle ones are closed."""

    def __init__(self, engine: TemporalEngine, data: str, control: str, most: int = 256, idle: float = 30.0) -> None:
        self.lock, self.servers = threading.Lock(), []
        for path, answer in ((data, handle_data), (control, handle_control)):
            if os.path.exists(path):
                os.remove(path)
            server = socketserver.ThreadingUnixStreamServer(path, _handler(engine, answer, self.lock, threading.BoundedSemaphore(most), idle))
            server.daemon_threads = True
            self.servers.append(server)
            threading.Thread(target=server.serve_forever, daemon=True).start()

    def close(self) -> None:
        for s in self.servers:
            s.shutdown()
            s.server_close()


def call(path: str, message: dict[str, Any]) -> dict[str, Any]:
    """One request over a socket."""
    with socket.socket(socket.AF_UNIX) as s:
        s.connect(path)
        with s.makefile("rwb") as f:
            write_frame(f, message)
            body = read_frame(f)
    if body is None:
        raise PolicyError("the server closed the connection")
    return json.loads(body)
