"""Tidemark: temporal policies over event streams, on Spark; corpus operators live in :mod:`tidemark.llm`."""

from .engine import RECORDED, Attributed, Attribution, BatchResult, Decision, Evaluator, LocalEngine, Submitted, TemporalEngine
from .errors import BadEvent, LogError, NoPolicies, PolicyError, Rejected, StateError
from .plans.incremental import History, Reader, Step
from .plans.routing import ShardPlan
from .policy_store import Add, AppendActionSchema, Delete, DeleteAll, Entry, PolicySet, Reset, ResetAll, SetActionSchema, Update
from .sources.log import Log, scan

__all__ = [
    "RECORDED", "Add", "AppendActionSchema", "Attributed", "Attribution", "BadEvent", "BatchResult", "Decision", "Delete", "DeleteAll", "Entry", "Evaluator", "History", "LocalEngine", "Log",
    "LogError", "NoPolicies", "PolicyError", "PolicySet", "Reader", "Rejected", "Reset", "ResetAll", "SetActionSchema", "ShardPlan", "StateError", "Step", "Submitted", "TemporalEngine", "Update", "scan",
]
