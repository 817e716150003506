"""Rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_offset


def _score(key: Column, shard: int, weight: float | None) -> Column:
    """The shard's score for a key: its MD5 as text; with a weight, -weight / ln(u) for u in (0, 1) from the MD5's first 52 bits."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    if weight is None:
        return digest
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, shards: int | Sequence[float]) -> Column:
    """The shard, from 0, that scores highest for ``key``; on a tie the higher number.

    ``shards`` is a number of equal shards or a list of weights (0 takes nothing). A shard's score depends on the key, the
    shard and its weight alone: a further shard, or a raised weight, takes rows only into that shard.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    if isinstance(shards, int):
        each: list[tuple[int, float | None]] = [(s, None) for s in range(shards)]
    else:
        each = [(s, float(w)) for s, w in enumerate(shards) if w > 0]
    if not each:
        raise ValueError("no shard has a weight")
    best = [F.struct(_score(key, s, w).alias("v"), F.lit(s).alias("s")) for s, w in each]
    return (F.greatest(*best) if len(best) > 1 else best[0])["s"]


def shard(docs: DataFrame, shards: int | Sequence[float] = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard by its id, and its gapless place (slot) in the shard, from 0.

    Returns id, size (UTF-8 bytes of the text plus 16), text_crc32, law (``key``), shard, slot, grown_shard: the shard if there
    were one more of weight 1. Slots follow the first 12 bits of the id's MD5, then the id, the CRC and the size; rows alike in these take
    neighbouring slots. A shard's rows are numbered in 4096 parts by these bits, so no task holds a whole shard.

    A null text counts as empty, a null id as the empty key. Repeated rows get slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = shards + 1 if isinstance(shards, int) else [*shards, 1.0]
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), shards).alias("shard"),
        rendezvous(F.col(id_col), more).alias("grown_shard"),
        F.lit(1).alias("__one"),
    )
    out = running_offset(rows, ["shard"], [id_col, "text_crc32", "size"], "__one", "slot", F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 3))
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
