"""Random traces over a small vocabulary."""

from __future__ import annotations

import random
from typing import Any

from tidemark.functions.values import Uid

USERS = ("a", "b", "c")


def random_trace(seed: int, n: int = 60, ties: bool = True) -> list[dict[str, Any]]:
    rng, ts, out = random.Random(seed), 0, []
    for _ in range(n):
        ts += rng.choice([0, 1, 1, 2, 5] if ties else [1, 2, 5])
        action = rng.choice(["Enter", "Leave", "Move", "Look"])
        kind = "request" if action == "Look" else rng.choice(["request", "response"])
        logged = {"who": rng.choice(USERS), "units": rng.randint(-2, 4)}
        context = {"input": dict(logged)} if rng.random() < 0.85 else {}
        if rng.random() < 0.1:
            logged.pop("who")
        out.append({"ts": ts, "ns": "Site", "action": action, "kind": kind, "principal": Uid("U", rng.choice(USERS)), "resource": Uid("G", "g"), "logged": {"input": logged}, "context": context, "entities": {}, "parents": {}})
    return out


def pred(action: str, *args: str, kind: str = "response") -> str:
    return f'Site::Action::"{action}"::{kind}{{ {", ".join(args)} }}'


ME = "input.who: context.input.who"
ENTER, LEAVE = pred("Enter", ME), pred("Leave", ME)
ENTER_U, LEAVE_U, MOVE_U = (pred(a, "input.who: u") for a in ("Enter", "Leave", "Move"))

CONDITIONS = [
    f"formerly within 6s {ENTER}",
    f"previous within 2s {ENTER}",
    f"!{LEAVE} since within 9s {ENTER}",
    f"({ENTER} || {LEAVE}) since within 9s {LEAVE}",
    f"exists (n: Long). ((count for (t: Timepoint). where (formerly within 9s ({ENTER} && tp(t)))) == n && n > 1)",
    f"(count for (u: String). where formerly within 6s {ENTER_U}) >= 2",
    f"exists (u: String). (formerly within 9s {ENTER_U} && (count for (t: Timepoint). where (formerly within 9s ({MOVE_U} && tp(t)))) >= 1)",
    f"formerly within 9s ({ENTER} && (count for (t: Timepoint). where (formerly within 5s ({LEAVE} && tp(t)))) >= 1)",
    f"exists (s: Long). ((sum a for (a: Long), (t: Timepoint). where (formerly within 9s ({pred('Move', ME, 'input.units: a')} && tp(t)))) == s && s > 2)",
    f"(sum a for (a: Long). where (formerly within 9s {pred('Move', 'input.units: a')})) > 3",
    f"!(formerly within 6s {ENTER})",
    f"formerly within 6s !(formerly within 2s {ENTER})",
    f"(formerly within 3s {ENTER}) || (previous within 3s {LEAVE})",
    f"exists (u: String). ((formerly within 9s {ENTER_U}) && !(formerly within 3s {MOVE_U}))",
    f"exists (u: String). ((!{MOVE_U} since within 12s {ENTER_U}) && (!{LEAVE} since within 9s {ENTER}))",
    f"exists (u: String). (({MOVE_U} || {ENTER_U}) since within 12s {ENTER_U})",
    f'exists (u: String). ((formerly within 5s ({ENTER_U} || {ENTER})) && u != "a")',
    f"exists (u: String). ((formerly within 5s ({ENTER_U} || {ENTER})) && formerly within 5s {MOVE_U})",
    f"(context.input.units + 2) * 3 > 9 && formerly within 100s {ENTER}",
    f"(count for (t: Timepoint). where ((formerly within 9s {ENTER}) && tp(t))) == 1",
    f"exists (t: Timepoint). ((formerly within 9s ({ENTER} && tp(t))) && previous within 9s (tp(t)))",
    f"formerly within 9s {pred('Move', 'input.units: 2', 'input.who: _')}",
    f"exists (u: String). (formerly within 20s ({pred('Move', 'input.who: u', 'input.units: 1')} && formerly within 5s {ENTER_U}))",
    f"(count for (t: Timepoint). where (formerly within 9s ({ENTER} && tp(t)))) > (count for (t: Timepoint). where (formerly within 9s ({LEAVE} && tp(t))))",
    f"!{ENTER} && formerly within 4s {LEAVE}",
    f"previous within 3s (previous within 3s {ENTER})",
]
