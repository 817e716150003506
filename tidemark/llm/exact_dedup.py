"""Exact deduplication by content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, wide_join

#: So many 16-byte hashes of repeated texts may be broadcast; above it the same join is shuffled.
BROADCAST_HASHES = 1_000_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the text, 128 bits. Where a hash occurs more than once, the texts themselves are
    compared: they are grouped by their bytes, so two texts of one hash stay apart. ``keep`` says whether the
    smallest or the largest id of a group stays. Only texts with a repeated hash are shuffled.

    A null text counts as empty. A null id never stays unless all ids of its group are null. Rows that repeat an id with
    the same text all count, and all rows with the id that stays are marked as kept. An empty table gives no
    rows. Other columns are ignored.
    """
    pick = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.unhex(F.md5(text))
    rows = materialize(docs.select(F.col(id_col).alias("id"), hashed.alias("h"), F.unhex(F.sha2(text, 256)).alias("sha")))
    repeated = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    small = repeated.count() <= BROADCAST_HASHES
    texts = docs.select(F.col(id_col).alias("id"), text.alias("t"), hashed.alias("h"))
    texts = texts.join(F.broadcast(repeated) if small else repeated, "h", "left_semi")
    groups = texts.groupBy("h", "t").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size", F.lit(True).alias("many"))
    out = wide_join(rows, groups, ["h", "sha"], "left")
    keep_id = F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
