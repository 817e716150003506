"""The policy set and its verbs, as values: a fold over verbs gives a new set or refuses all of them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from .errors import PolicyError
from .plans import analysis as N
from .plans import ast as A
from .plans.parser import ActionSchema, EventSchema, parse_action_schema, parse_macros, parse_policies


@dataclass(frozen=True)
class Add:
    source: str


@dataclass(frozen=True)
class Update:
    token: str
    source: str


@dataclass(frozen=True)
class Delete:
    token: str


@dataclass(frozen=True)
class Reset:
    token: str


@dataclass(frozen=True)
class DeleteAll:
    pass


@dataclass(frozen=True)
class ResetAll:
    pass


@dataclass(frozen=True)
class SetActionSchema:
    text: str


@dataclass(frozen=True)
class AppendActionSchema:
    text: str


@dataclass(frozen=True)
class Entry:
    """A policy in the set. It sees events from offset ``since`` on: that is how history is kept, reset or started afresh."""

    ordinal: int
    token: str
    statement: str
    created: int
    updated: int
    since: int
    policy: A.Policy = field(compare=False)


@dataclass(frozen=True)
class Leaf:
    """One temporal clause of one policy: its verdict is an input of the policy."""

    ident: str
    condition: Any
    actions: frozenset | None  # the decisions that it is asked for; None for all
    since: int


def mint(ordinal: int, statement: str, ts: int) -> str:
    return hashlib.sha256(f"{ordinal}\x00{ts}\x00{statement}".encode()).hexdigest()[:24]


@dataclass(frozen=True)
class PolicySet:
    entries: tuple[Entry, ...] = ()
    next_ordinal: int = 0
    schema_text: str = ""
    max_window: int = EventSchema().max_window
    macro_text: str = ""

    @cached_property
    def macros(self) -> dict[str, Any]:
        return parse_macros(self.macro_text)

    @cached_property
    def schema(self) -> ActionSchema:
        return parse_action_schema(self.schema_text)

    def get(self, token: str) -> Entry:
        for e in self.entries:
            if e.token == token:
                return e
        raise PolicyError(f"no policy {token!r}")

    def _parsed(self, source: str, single: bool) -> list[A.Policy]:
        found = parse_policies(source, self.macros)
        if not found:
            raise PolicyError("the source has no policy")
        if single and len(found) != 1:
            raise PolicyError(f"expected one policy, found {len(found)}")
        for p in found:
            for _, c in p.temporal:
                if (w := N.longest_window(c)) > self.max_window:
                    raise PolicyError(f"a window of {w} s is longer than the event schema's {self.max_window} s")
        return found

    def fold(self, verbs: list[Any], ts: int, offset: int) -> tuple[PolicySet, list[str | None]]:
        """The set after all verbs, and the token minted by each policy added. ``offset``: the next event's offset."""
        out, minted = self, []
        for verb in verbs:
            if isinstance(verb, Add):
                new = [Entry(n, mint(n, p.text, ts), p.text, ts, ts, offset, p) for n, p in enumerate(out._parsed(verb.source, False), out.next_ordinal)]
                out = replace(out, entries=(*out.entries, *new), next_ordinal=out.next_ordinal + len(new))
                minted += [e.token for e in new]
            elif isinstance(verb, Update):
                old, (p,) = out.get(verb.token), out._parsed(verb.source, True)
                new = replace(old, statement=p.text, policy=p, updated=ts, since=offset)
                out = replace(out, entries=tuple(new if e is old else e for e in out.entries))
            elif isinstance(verb, Delete):
                old = out.get(verb.token)
                out = replace(out, entries=tuple(e for e in out.entries if e is not old))
            elif isinstance(verb, Reset):
                old = out.get(verb.token)
                out = replace(out, entries=tuple(replace(e, since=offset) if e is old else e for e in out.entries))
            elif isinstance(verb, DeleteAll):
                out = replace(out, entries=())
            elif isinstance(verb, ResetAll):
                out = replace(out, entries=tuple(replace(e, since=offset) for e in out.entries))
            elif isinstance(verb, SetActionSchema):
                parse_action_schema(verb.text)
                out = replace(out, schema_text=verb.text)
            elif isinstance(verb, AppendActionSchema):
                text = f"{out.schema_text}\n{verb.text}"
                parse_action_schema(text)
                out = replace(out, schema_text=text)
            else:
                raise PolicyError(f"no verb: {verb!r}")
        known = out.schema
        if known.actions:
            for e in out.entries:
                for a in e.policy.scope.actions or ():
                    if a not in known.actions:
                        raise PolicyError(f"the schema has no action {'::'.join(filter(None, (a[0], 'Action')))}::\"{a[1]}\"")
        return out, minted

    def leaves(self, sliced: bool = True) -> list[Leaf]:
        """All clauses, each with the actions for which its policy can apply."""
        schema, out = self.schema, []
        for e in self.entries:
            actions = schema.expand(e.policy.scope.actions) if sliced else None
            out += [Leaf(f"{e.ordinal}:{i}", c, actions, e.since) for i, (_, c) in enumerate(e.policy.temporal)]
        return out

    @cached_property
    def reach(self) -> int:
        """Seconds of history that the policies can still need."""
        return max((N.horizon(c) for e in self.entries for _, c in e.policy.temporal), default=0)


def verb_record(verb: Any, minted: list[str] | None = None) -> dict[str, Any]:
    """A verb as a log record's body."""
    kind = {Add: "add", Update: "update", Delete: "delete", Reset: "reset", DeleteAll: "delete_all", ResetAll: "reset_all", SetActionSchema: "set_action_schema", AppendActionSchema: "append_action_schema"}[type(verb)]
    return {kind: {k: getattr(verb, k) for k in ("token", "source", "text") if hasattr(verb, k)}}


VERBS = {"add": Add, "update": Update, "delete": Delete, "reset": Reset, "delete_all": DeleteAll, "reset_all": ResetAll, "set_action_schema": SetActionSchema, "append_action_schema": AppendActionSchema}


def read_verb(kind: str, body: dict[str, Any]) -> Any:
    try:
        return VERBS[kind](**body)
    except (KeyError, TypeError) as error:
        raise PolicyError(f"no verb record: {kind}") from error
