"""Secret scans: patterns in each text, and how many owners share a candidate across the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, wide_join

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 or more; shorter runs can't hold a longer one
HEX = re.compile(r"[0-9a-f]{16,}")
#: Further candidates: long tokens with a digit, whatever stands around them.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")


def entropy(value: str) -> float:
    """Bits for each character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str, bits: float = 3.0) -> bool:
    """Letters and digits, or 16 and more of hexadecimal digits with a letter, of enough entropy."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= bits


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans (start, kind, end) in order, and candidate values (start, end, hash) for the count of owners."""
    base, found = [], {}
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, m.end()))
            found[m.span(2)] = m[2]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            base.append((m.start(), kind, m.end()))
            found[m.span()] = m[0]
    for m in TOKEN.finditer(text):
        found[m.span()] = m[0]
    values = [(a, b, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]) for (a, b), v in sorted(found.items()) if looks_random(v)]
    return sorted(base), values


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = 1, most_repositories: int = 1) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_live, base_sha256, spans of each row of ``docs``.

    Base spans come from the patterns alone. Values that look random are then counted over the whole corpus by hash: in how many
    repositories (documents; those of equal text count once) and at how many owners (``owner_col``) they occur. A value found in over
    ``most_repositories`` of them at over ``most_owners`` owners is a widely copied example; any other is specific to its
    owner or its document, and its span is added as ``live``. ``spans`` lists all
    as kind:start:end, by start, then kind; offsets are code points, the end exclusive. Only hashes leave a document.

    A null text is empty and has no spans. Null owners count as one owner. Repeated rows each get their result. An empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        value = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
        for batch in batches:
            scanned = [scan(t or "") for t in batch.column(2).to_pylist()]
            digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest() for s, _ in scanned]
            texts = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest()[:32] for t in batch.column(2).to_pylist()]
            cols = [
                batch.column(0), batch.column(1), batch.column(3), pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s, _ in scanned], span),
                pa.array([[{"start": a, "end": b, "hash": h} for a, b, h in v] for _, v in scanned], value),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", "owner", "base_sha256", "same", "base", "found"])

    chosen = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(owner_col).cast("string").alias("owner"))
    kind = chosen.schema["id"].dataType.simpleString()
    rows = materialize(chosen.mapInArrow(run, f"uid long, id {kind}, owner string, base_sha256 string, same string, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,hash:string>>"))

    values = rows.select("uid", "owner", "same", F.explode("found").alias("v")).select("uid", "owner", "same", "v.*")
    owners = values.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repositories = values.select("hash", "same").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    own = wide_join(owners, repositories, ["hash"]).where((F.col("owners") <= most_owners) | (F.col("repositories") <= most_repositories))
    live = wide_join(values.select("uid", "start", "end", "hash"), own.select("hash"), ["hash"])
    live = live.groupBy("uid").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("live"))
    out = rows.join(live, "uid", "left").withColumn("live", F.coalesce("live", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.transform(F.array_sort(F.concat("base", "live")), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.size("live").cast("long").alias("n_live"), "base_sha256", F.array_join(listed, ",").alias("spans"),
    )
