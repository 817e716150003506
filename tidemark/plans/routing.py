"""How a stream may be dealt out: by which fields, and where a wire event goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from ..functions.values import tag
from . import analysis as N
from . import ast as A
from .parser import EventSchema


@dataclass(frozen=True)
class ShardPlan:
    """The pins that every kind of event declares alike; ``reason`` says why there are none."""

    keys: tuple[str, ...] = ()
    reason: str = ""

    @property
    def sharded(self) -> bool:
        return bool(self.keys)

    @staticmethod
    def of(schema: EventSchema) -> ShardPlan:
        if schema.pins:
            return ShardPlan(schema.pins)
        if not schema.kinds:
            return ShardPlan((), "the schema declares no events")
        if not schema.refused:
            return ShardPlan((), "the schema declares no pin")
        return ShardPlan((), "; ".join(f"{path}: {why}" for path, why in sorted(schema.refused.items())))

    def key_of(self, message: Mapping[str, Any]) -> str | None:
        """The routing key of a wire event, None without a plan or if one of the fields is missing: such an event goes where all is seen.

        Values are told apart by type: the text "1" and the number 1 are different keys.
        """
        parts = []
        for path in self.keys:
            found = _looked_up(message, path)
            if found is None:
                return None
            parts.append(found)
        return "\x1f".join(parts) if parts else None

    def shard_of(self, message: Mapping[str, Any], shards: int) -> int | None:
        """One of ``shards`` places by the key, the same on every machine; None for the unsharded one."""
        key = self.key_of(message)
        return None if key is None else int.from_bytes(hashlib.md5(key.encode("utf-8", "surrogatepass")).digest()[:8], "big") % shards


def apart(conditions: Iterable[Any], path: str) -> bool:
    """Whether conditions look only at events whose logged field is the decision's own context field of that name: then a stream may be dealt out by it, and its parts decided apart.

    Places without an event of that value mustn't matter either, so ``previous``, numbers of places and a left side of ``since`` that must hold everywhere are refused.
    """

    def keyed(node: Any) -> bool:
        """Whether the condition can have rows only where an event of the key is."""
        found = N.support(node)
        return found is not None and all((path, A.Ref("context", tuple(path.split(".")))) in p.args for p, _ in found)

    def fine(node: Any) -> bool:
        if isinstance(node, A.Pred):
            return keyed(node)
        if isinstance(node, (A.And, A.Or)):
            return fine(node.left) and fine(node.right)
        if isinstance(node, (A.Not, A.Exists)):
            return fine(node.child)
        if isinstance(node, A.Formerly):
            return keyed(node.child) and fine(node.child)
        if isinstance(node, A.Since):
            return keyed(node.right) and fine(node.right) and isinstance(node.left, A.Not) and keyed(node.left.child) and fine(node.left)
        if isinstance(node, A.Compare):
            return all(not isinstance(t, (A.Agg, A.Arith, A.Items)) for t in (node.left, node.right))
        return False

    return all(map(fine, conditions))


def _looked_up(message: Mapping[str, Any], path: str) -> str | None:
    from ..sources.events import wire_value

    if path in ("callerPrincipal", "callerResource"):
        return message.get("principal" if path == "callerPrincipal" else "resource")
    at: Any = message.get("logged") or {}
    for name in path.split("."):
        if not isinstance(at, Mapping) or name not in at:
            return None
        at = at[name]
    return tag(wire_value(at))
