"""What can be refused, by kind."""

from __future__ import annotations


class PolicyError(ValueError):
    """Text that is no valid policy, schema or event, or a request that can't be met."""


class NoPolicies(PolicyError):
    """An event came before any policy was installed."""


class BadEvent(PolicyError):
    """An event that can't be taken: no valid fields, or a stamp that isn't later than the last one."""


class Rejected(PolicyError):
    """A change of policies or schemas that was refused as a whole; nothing was written."""


class LogError(PolicyError):
    """The durable log can't be read or written: what can't be recorded isn't decided."""


class StateError(PolicyError):
    """Kept state that belongs to other pins, conditions or another version."""
