"""Values of events and policies: Python forms, the tagged text by which Spark compares them, and saturating arithmetic.

A value in a DataFrame is a string with a tag: ``z`` null, ``b:true``, ``i:7``, ``d:1.5``, ``s:text``, ``e:Type::"id"``, ``a:[...]``,
``o:{...}``. Two values are equal exactly when their tagged texts are: decimals are normalised, object keys sorted. SQL NULL
means that there is no value, which is not the null value.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from json.encoder import encode_basestring
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


@dataclass(frozen=True)
class Dec:
    """A decimal by its text; equality is numeric."""

    text: str

    @property
    def canonical(self) -> str:
        sign, body = ("-", self.text[1:]) if self.text[:1] == "-" else ("", self.text.lstrip("+"))
        whole, _, part = body.partition(".")
        whole, part = whole.lstrip("0") or "0", part.rstrip("0")
        number = f"{whole}.{part}" if part else whole
        return number if number == "0" else sign + number

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Dec) and self.canonical == other.canonical

    def __hash__(self) -> int:
        return hash(self.canonical)


@dataclass(frozen=True)
class Uid:
    """An entity."""

    ty: str
    id: str

    def __str__(self) -> str:
        return f"{self.ty}::{encode_basestring(self.id)}"


def tag(value: Any) -> str:
    """Tagged text of a Python value."""
    kind = type(value)  # the most frequent ones first
    if kind is int:
        return f"i:{value}"
    if kind is str:
        return f"s:{value}"
    if kind is Uid:
        return f"e:{value}"
    if kind is dict:
        return "o:{" + ", ".join([f"{encode_basestring(k)}: {encode_basestring(tag(value[k]))}" for k in sorted(value)]) + "}"
    if value is None:
        return "z"
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, Dec):
        return f"d:{value.canonical}"
    if isinstance(value, str):
        return f"s:{value}"
    if isinstance(value, Uid):
        return f"e:{value}"
    if isinstance(value, (list, tuple)):
        return "a:" + json.dumps([tag(v) for v in value], ensure_ascii=False)
    if isinstance(value, dict):
        return "o:" + json.dumps({k: tag(value[k]) for k in sorted(value)}, ensure_ascii=False)
    raise TypeError(f"no value: {value!r}")


def untag(text: str) -> Any:
    """The Python value of a tagged text."""
    kind, body = text[0], text[2:]
    if kind == "z":
        return None
    if kind == "b":
        return body == "true"
    if kind == "i":
        return int(body)
    if kind == "d":
        return Dec(body)
    if kind == "s":
        return body
    if kind == "e":
        ty, _, ident = body.partition('::"')
        return Uid(ty, json.loads('"' + ident))
    if kind == "a":
        return [untag(v) for v in json.loads(body)]
    return {k: untag(v) for k, v in json.loads(body).items()}


def clamp(value: int) -> int:
    return max(LONG_MIN, min(LONG_MAX, value))


def as_long(tagged: Column) -> Column:
    """The integer in a tagged column, NULL for any other kind."""
    return F.when(tagged.startswith("i:"), F.substring(tagged, 3, 20).try_cast("long"))


def long_tag(value: Column) -> Column:
    return F.concat(F.lit("i:"), value.cast("string"))


def saturating(op: str, left: Column, right: Column) -> Column:
    """``+``, ``-`` or ``*`` of two longs, held within 64 bits; NULL if a side is. Decimals keep every product exact."""
    a, b = left.cast("decimal(19,0)"), right.cast("decimal(19,0)")
    wide = {"+": a + b, "-": a - b, "*": a * b}[op].cast("decimal(38,0)")
    low, high = F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")
    return F.when(wide.isNotNull(), F.least(F.greatest(wide, low), high).cast("long"))


def checked(op: str, left: Column, right: Column) -> Column:
    """``+``, ``-`` or ``*`` of two longs, NULL on overflow."""
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](left, right)


def saturating_sum(value: Column) -> Column:
    """Exact sum of longs, held within 64 bits once at the end."""
    low, high = F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")
    total = F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.least(F.greatest(total, low), high).cast("long")
