"""Command line: run the server, manage policies, submit events."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from pathlib import Path

from .engine import TemporalEngine
from .sources.wire import Server, call


def main(argv: list[str] | None = None) -> int:
    """0, or 1 for a denied event, 2 for an error."""
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--data", default="/tmp/tidemark-data.sock")
    p.add_argument("--control", default="/tmp/tidemark-control.sock")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("run").add_argument("log")
    policy = sub.add_parser("policy").add_subparsers(dest="what", required=True)
    install = policy.add_parser("install")
    install.add_argument("policies")
    install.add_argument("--action-schema")
    install.add_argument("--event-schema")
    install.add_argument("--macros")
    policy.add_parser("add").add_argument("policies")
    update = policy.add_parser("update")
    update.add_argument("id")
    update.add_argument("policies")
    for name in ("delete", "reset", "show"):
        policy.add_parser(name).add_argument("id")
    for name in ("delete-all", "reset-all", "source"):
        policy.add_parser(name)
    listed = policy.add_parser("list")
    listed.add_argument("--max-results", type=int)
    listed.add_argument("--after")
    for name in ("status", "checkpoint", "ping", "schema"):
        sub.add_parser(name)
    sub.add_parser("submit").add_argument("event", help="a file with the event's JSON, - for standard input")
    a = p.parse_args(argv)

    if a.command == "run":
        server = Server(TemporalEngine(None, a.log), a.data, a.control)
        try:
            threading.Event().wait()
        finally:
            server.close()
        return 0
    read = lambda path: Path(path).read_text() if path else None
    path, message = a.control, {"op": a.command}
    if a.command == "ping":
        path = a.data
    elif a.command == "submit":
        text = sys.stdin.read() if a.event == "-" else Path(a.event).read_text()
        path, message = a.data, {"op": "submit", "event": json.loads(text)}
    elif a.command == "schema":
        message = {"op": "get_schema"}
    elif a.command == "policy":
        verbs = {
            "add": lambda: {"verb": "add", "source": read(a.policies)},
            "update": lambda: {"verb": "update", "token": a.id, "source": read(a.policies)},
            "delete": lambda: {"verb": "delete", "token": a.id},
            "reset": lambda: {"verb": "reset", "token": a.id},
            "delete-all": lambda: {"verb": "delete_all"},
            "reset-all": lambda: {"verb": "reset_all"},
        }
        if a.what in verbs:
            message = {"op": "batch", "verbs": [verbs[a.what]()]}
        elif a.what == "install":
            message = {"op": "install", "policies": read(a.policies), "action_schema": read(a.action_schema) or "", "event_schema": read(a.event_schema), "macros": read(a.macros)}
        elif a.what == "list":
            message = {"op": "list", "max_results": a.max_results, "after": a.after}
        else:
            message = {"op": "get_policy_by_id", "id": a.id} if a.what == "show" else {"op": "get_policy"}
    reply = call(path, message)
    print(json.dumps(reply, indent=2, ensure_ascii=False))
    if "error" in reply:
        return 2
    return int(a.command == "submit" and bool(reply.get("decision")) and reply["decision"]["decision"] == "deny")


if __name__ == "__main__":
    sys.exit(main())
