"""Terms, conditions and policies as immutable trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: A window without end.
UNBOUNDED = 2**63 - 1


# Terms
@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Ref:
    """A value of the decision: root is context, principal or resource."""

    root: str
    path: tuple[str, ...] = ()

    def __str__(self) -> str:
        return ".".join((self.root, *self.path))


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Items:
    """An array of terms; one without a value leaves the whole array without one."""

    items: tuple


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Agg:
    """kind: count or sum; names: the distinct projection; bound: the summed variable."""

    kind: str
    names: tuple[str, ...]
    bound: str | None
    body: Any


# Conditions
@dataclass(frozen=True)
class Pred:
    ns: str
    action: str
    kind: str
    args: tuple[tuple[str, Any], ...]  # dotted path and term


@dataclass(frozen=True)
class Formerly:
    window: int
    child: Any


@dataclass(frozen=True)
class Previous:
    window: int
    child: Any


@dataclass(frozen=True)
class Since:
    window: int
    left: Any
    right: Any


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    child: Any


@dataclass(frozen=True)
class Exists:
    var: str
    child: Any


@dataclass(frozen=True)
class Tp:
    var: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


# Plain expressions, beside comparisons, And, Or, Not
@dataclass(frozen=True)
class Has:
    term: Any
    attr: str


@dataclass(frozen=True)
class In:
    term: Any
    group: Any


@dataclass(frozen=True)
class Truth:
    """A term that must be true."""

    term: Any


# Policies
@dataclass(frozen=True)
class Scope:
    """principal, resource: None, ("==", entity) or ("in", entity); actions: None for all, else (namespace, name) pairs; groups are expanded by the schema."""

    principal: tuple[str, Any] | None = None
    actions: tuple[tuple[str, str], ...] | None = None
    resource: tuple[str, Any] | None = None


@dataclass(frozen=True)
class Policy:
    effect: str
    scope: Scope
    when: tuple[tuple[bool, Any], ...] = ()  # (must hold, plain expression)
    temporal: tuple[tuple[bool, Any], ...] = ()  # (must hold, condition)
    annotations: tuple[tuple[str, str], ...] = ()
    text: str = field(default="", compare=False)


def children(node: Any) -> tuple:
    """The conditions right below a condition; bodies of aggregates don't count."""
    if isinstance(node, (Formerly, Previous, Not, Exists)):
        return (node.child,)
    if isinstance(node, (And, Or, Since)):
        return (node.left, node.right)
    return ()
