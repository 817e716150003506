"""Decisions over a stream: one state for each pin value, kept by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ast as A
from ..plans.parser import EventSchema
from ..policy_store import PolicySet

OUTPUT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tp", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("allowed", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("errors", T.StringType()),
    ]
)
STATE = T.StructType([T.StructField("next", T.LongType()), T.StructField("rows", T.StringType())])
NONE = "<none>"


def decide_stream(events: DataFrame, policies: PolicySet, schema: EventSchema, rate: int) -> DataFrame:
    """id, tp, ts, allowed, reason, errors (comma-joined) of each decision in the stream.

    Events are grouped by the pins; without pins all events are one group. Within a micro-batch they are taken in the order of ``id``. A
    group's state is the part of its history that policies can still look at; what is older than their horizon goes with each batch.
    """
    horizon = min(A.UNBOUNDED, policies.reach * rate)
    columns = ["id", "ts", "ns", "action", "kind", "principal", "resource", "logged", "context", "attrs", "parents"]
    g = F.concat_ws("\x1f", *[F.coalesce(F.try_element_at("logged", F.lit(p)), F.lit(NONE)) for p in schema.pins]) if schema.pins else F.lit("")
    packed = events.select(g.alias("g"), "id", F.to_json(F.struct(*columns)).alias("event"))
    decides = set(schema.decisions)

    def step(_: tuple, frames: Iterator, state: Any) -> Iterator:
        import pandas as pd

        from ..engine import Evaluator
        from ..plans.incremental import History

        at, held = state.get if state.exists else (0, "[]")
        history, evaluator, out = History(json.loads(held)), Evaluator(policies, rate), []
        new = sorted((json.loads(x) for frame in frames for x in frame["event"]), key=lambda r: r["id"])
        for row in new:
            for key in ("logged", "context", "attrs", "parents"):
                row[key] = row.get(key) or {}
            row |= {"principal": row.get("principal"), "resource": row.get("resource"), "tp": at}
            at += 1
            history.add(row)
            if row["kind"] in decides:
                d = evaluator.decide(history)
                out.append((row["id"], row["tp"], row["ts"], d.allowed, ",".join(d.reason), ",".join(d.errors)))
        if history.rows:
            oldest = history.rows[-1]["ts"] - horizon
            kept = [r for i, r in enumerate(history.rows) if r["ts"] >= oldest or i == len(history.rows) - 1]
            state.update((at, json.dumps(kept)))
        yield pd.DataFrame(out, columns=OUTPUT.names)

    return packed.groupBy("g").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
