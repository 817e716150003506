"""Events as DataFrames: trace text, log records, wire messages, and tables bound by columns.

An event is a row of :data:`EVENT`. ``logged`` and ``context`` hold each field by its dotted path, and whole groups beside their fields;
values are tagged text (see :mod:`tidemark.functions.values`). ``attrs`` has the attributes of supplied entities by entity, ``parents`` their
direct parents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PolicyError
from ..functions.values import LONG_MAX, LONG_MIN, Dec, Uid, tag
from ..plans.parser import parse_trace_line, unquote

_BAG = T.MapType(T.StringType(), T.StringType())
EVENT = T.StructType(
    [
        T.StructField("tp", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("ns", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("principal", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("logged", _BAG),
        T.StructField("context", _BAG),
        T.StructField("attrs", T.MapType(T.StringType(), _BAG)),
        T.StructField("parents", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)


def flatten(bag: Mapping[str, Any], prefix: str = "") -> dict[str, str]:
    """Tagged text of each field by dotted path; an object is there whole and by its members."""
    out: dict[str, str] = {}
    for k, v in bag.items():
        out[prefix + k] = tag(v)
        if isinstance(v, Mapping):
            out |= flatten(v, f"{prefix}{k}.")
    return out


def event_row(event: Mapping[str, Any], tp: int | None = None) -> dict[str, Any]:
    """The row of an event with Python values. The principal and resource are logged too, as callerPrincipal and callerResource."""
    given, context = event.get("logged") or {}, flatten(event.get("context") or {})
    logged = dict(context) if given is event.get("context") else flatten(given)
    scope = {k: tag(event[k]) if event.get(k) is not None else None for k in ("principal", "resource")}
    for key, alias in (("principal", "callerPrincipal"), ("resource", "callerResource")):
        if scope[key] is not None and alias not in given:
            logged[alias] = scope[key]
    return {
        "tp": event.get("tp") if tp is None else tp,
        "ts": event["ts"],
        "ns": event["ns"],
        "action": event["action"],
        "kind": event["kind"],
        **scope,
        "logged": logged,
        "context": context,
        "attrs": {tag(u): flatten(a) for u, a in (event.get("entities") or {}).items()},
        "parents": {tag(u): [tag(p) for p in ps] for u, ps in (event.get("parents") or {}).items()},
    }


def from_rows(spark: SparkSession, events: list[Mapping[str, Any]]) -> DataFrame:
    """A small list of events, numbered in its order."""
    rows = [event_row(e, i) for i, e in enumerate(events)]
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT) for r in rows], EVENT)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace text, a line for each event, as events without numbers; ``line`` orders them: by file name, then by place in the file.

    A file's lines lie one after the other in the parts that Spark cuts it into, so the start of a line's part and the line's
    number within it tell its place. Files are numbered by name, up to 2**15 of them, each of up to 2**48 bytes.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    files = text.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("number"))
    # Of one part the lines have rising numbers, whatever other parts its task reads before
    first = text.groupBy("file", "start").agg(F.min("at").alias("first"))
    lines = text.join(first, ["file", "start"]).join(files, "file")
    lines = lines.withColumn("line", F.shiftleft("number", 48) + F.col("start") + F.col("at") - F.col("first")).where(F.trim("value") != "")
    schema = T.StructType([T.StructField("line", T.LongType()), *EVENT])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [{"line": n, **event_row(parse_trace_line(t))} for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for r in rows:
                for key in ("logged", "context", "attrs", "parents"):
                    r[key] = list(r[key].items()) if key != "attrs" else [(u, list(a.items())) for u, a in r[key].items()]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return lines.select("value", "line").mapInArrow(run, schema)


def verdict_line(ts: int, tp: int, allowed: bool) -> str:
    return f"@{ts} (time point {tp}): {str(allowed).lower()}"


def verdict_lines(decisions: DataFrame) -> DataFrame:
    """The text sink of decisions: ``line`` for each."""
    return decisions.select("tp", F.concat(F.lit("@"), F.col("ts"), F.lit(" (time point "), F.col("tp"), F.lit("): "), F.col("allowed").cast("string")).alias("line"))


# Log records: tagged pairs
def encode_value(value: Any) -> list:
    if value is None:
        return ["z", None]
    if isinstance(value, bool):
        return ["b", value]
    if isinstance(value, int):
        return ["i", value]
    if isinstance(value, Dec):
        return ["d", value.text]
    if isinstance(value, str):
        return ["s", value]
    if isinstance(value, Uid):
        return ["e", {"type": value.ty, "id": value.id}]
    if isinstance(value, (list, tuple)):
        return ["a", [encode_value(v) for v in value]]
    return ["o", {k: encode_value(v) for k, v in value.items()}]


def decode_value(pair: Any) -> Any:
    if not isinstance(pair, list) or len(pair) != 2:
        raise PolicyError(f"no tagged value: {pair!r}")
    kind, body = pair
    checks: dict[str, Callable[[Any], bool]] = {
        "z": lambda b: b is None,
        "b": lambda b: isinstance(b, bool),
        "i": lambda b: isinstance(b, int) and not isinstance(b, bool) and LONG_MIN <= b <= LONG_MAX,
        "d": lambda b: isinstance(b, str),
        "s": lambda b: isinstance(b, str),
        "e": lambda b: isinstance(b, dict) and set(b) == {"type", "id"},
        "a": lambda b: isinstance(b, list),
        "o": lambda b: isinstance(b, dict),
    }
    if kind not in checks or not checks[kind](body):
        raise PolicyError(f"no tagged value: {pair!r}")
    if kind == "d":
        return Dec(body)
    if kind == "e":
        return Uid(body["type"], body["id"])
    if kind == "a":
        return [decode_value(v) for v in body]
    if kind == "o":
        return {k: decode_value(v) for k, v in body.items()}
    return body


def unique_keys(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise PolicyError("a key occurs twice")
    return out


def parse_uid(text: str) -> Uid | None:
    """``Ns::T::"id"`` as an entity, None for any other text."""
    head, sep, rest = text.partition('::"')
    if not sep or not rest.endswith('"') or not head or not all(p.isidentifier() for p in head.split("::")):
        return None
    return Uid(head, unquote('"' + rest))


def encode_event(event: Mapping[str, Any]) -> dict[str, Any]:
    """The payload of an event's log record."""
    return {
        "action": {"namespace": event["ns"].split("::") if event["ns"] else [], "id": event["action"]},
        "kind": event["kind"],
        "principal": str(event["principal"]) if event.get("principal") is not None else None,
        "resource": str(event["resource"]) if event.get("resource") is not None else None,
        "logged": {k: encode_value(v) for k, v in (event.get("logged") or {}).items()},
        "context": {k: encode_value(v) for k, v in (event.get("context") or {}).items()},
        "entities": {str(u): {k: encode_value(v) for k, v in a.items()} for u, a in (event.get("entities") or {}).items()},
        "parents": {str(u): [str(p) for p in ps] for u, ps in (event.get("parents") or {}).items()},
    }


def decode_event(payload: Mapping[str, Any], ts: int) -> dict[str, Any]:
    """The event of a payload; its fields must be exactly those of :func:`encode_event`."""
    if set(payload) != {"action", "kind", "principal", "resource", "logged", "context", "entities", "parents"}:
        raise PolicyError(f"an event record has other fields: {sorted(payload)}")

    def uid(text: str | None) -> Uid | None:
        if text is None:
            return None
        if (found := parse_uid(text)) is None:
            raise PolicyError(f"no entity: {text!r}")
        return found

    def bag(x: Mapping[str, Any]) -> dict[str, Any]:
        return {k: decode_value(v) for k, v in x.items()}

    return {
        "ts": ts, "ns": "::".join(payload["action"]["namespace"]), "action": payload["action"]["id"], "kind": payload["kind"],
        "principal": uid(payload["principal"]), "resource": uid(payload["resource"]), "logged": bag(payload["logged"]), "context": bag(payload["context"]),
        "entities": {uid(u): bag(a) for u, a in payload["entities"].items()}, "parents": {uid(u): [uid(p) for p in ps] for u, ps in payload["parents"].items()},
    }


# Wire messages: plain JSON
def wire_value(value: Any) -> Any:
    """Plain JSON as a value: texts shaped like an entity are entities, numbers that are no 64-bit integer are decimals."""
    if isinstance(value, str):
        return parse_uid(value) or value
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value if LONG_MIN <= value <= LONG_MAX else Dec(str(value))
    if isinstance(value, Dec):
        return value
    if isinstance(value, list):
        return [wire_value(v) for v in value]
    return {k: wire_value(v) for k, v in value.items()}


def read_wire(text: str | bytes) -> dict[str, Any]:
    """A wire event from its JSON text."""
    return read_wire_event(json.loads(text, parse_float=Dec))


def read_wire_event(msg: Any) -> dict[str, Any]:
    """A wire event. Only groups of fields are taken from ``logged`` and ``context``; scalars beside them are dropped."""
    known = {"action", "kind", "principal", "resource", "logged", "context", "entities", "parents"}
    if not isinstance(msg, dict) or set(msg) - known or not {"action", "kind"} <= set(msg):
        raise PolicyError("no wire event")
    names = msg["action"].split("::")
    if "Action" not in names:
        raise PolicyError(f"no action: {msg['action']!r}")
    at = names.index("Action")
    ident = "::".join(names[at + 1 :])
    ident = unquote(ident) if ident[:1] == '"' else ident

    def groups(bag: Mapping[str, Any]) -> dict[str, Any]:
        return {k: wire_value(v) for k, v in bag.items() if isinstance(v, dict)}

    return {
        "ts": 0, "ns": "::".join(names[:at]), "action": ident, "kind": msg["kind"],
        "principal": parse_uid(msg.get("principal") or ""), "resource": parse_uid(msg.get("resource") or ""),
        "logged": groups(msg.get("logged") or {}), "context": groups(msg.get("context") or {}),
        "entities": {u: wire_value(a) for k, a in (msg.get("entities") or {}).items() if (u := parse_uid(k))},
        "parents": {u: [p for x in ps if (p := parse_uid(x))] for k, ps in (msg.get("parents") or {}).items() if (u := parse_uid(k))},
    }


@dataclass
class Trace:
    """Events for the compiler: a frame with tp, ts, ns, action, kind, and how to read fields from it.

    Over :data:`EVENT` rows, fields are looked up in the bags. A table with columns of its own is bound by expressions, so that scans
    read just the columns that a policy needs.
    """

    df: DataFrame
    logged_columns: dict[str, Column] | None = None
    context_columns: dict[str, Column] | None = None
    scope_columns: dict[str, Column] = field(default_factory=dict)
    _grain: int | None = None

    def over(self, df: DataFrame) -> Trace:
        """The same fields over another frame of the stream's events; its grain stays the whole stream's."""
        out = Trace(df, self.logged_columns, self.context_columns, self.scope_columns)
        out._grain = self.grain()
        return out

    def grain(self) -> int:
        """The time in which the trace has a bucket's rows, from its stamps alone: one small scan, once a trace."""
        from ..operators.temporal import grain_of

        if self._grain is None:
            self._grain = grain_of(*self.df.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first())
        return self._grain

    def logged(self, path: str) -> Column:
        if self.logged_columns is not None:
            return self.logged_columns.get(path, F.lit(None).cast("string"))
        return F.try_element_at("logged", F.lit(path))

    def term(self, root: str, path: tuple[str, ...]) -> Column:
        """A value of the decision's own event."""
        dotted = ".".join(path)
        if root == "context":
            if self.context_columns is not None:
                return self.context_columns.get(dotted, F.lit(None).cast("string"))
            return F.try_element_at("context", F.lit(dotted))
        if self.logged_columns is not None:
            return self.scope_columns.get(".".join((root, *path)), F.lit(None).cast("string"))
        if not path:
            return F.col(root)
        return F.try_element_at(F.try_element_at("attrs", F.col(root)), F.lit(dotted))


def text_tag(c: Column) -> Column:
    return F.concat(F.lit("s:"), c.cast("string"))
