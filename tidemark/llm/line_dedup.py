"""Repeated runs of lines: suffix ranks by distributed prefix doubling, common-prefix intervals, removal of later copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, wide_join, words

#: Ranks are summed within spans of this many, so that a hot rank's followers are spread over many tasks.
SPAN = 1 << 16


def _ranked(pairs: DataFrame) -> DataFrame:
    """pairs: r1, r2, n (how many suffixes). Adds rank = r1 + suffixes of group r1 with a smaller r2: the suffix array's order.

    Within r1 the pairs are dealt out by spans of r2, and one row for each span meets the others of its r1.
    """
    p = pairs.withColumn("span", F.floor(F.col("r2") / F.lit(SPAN)).cast("long"))
    inside = Window.partitionBy("r1", "span").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("low", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    spans = pairs.groupBy("r1", F.floor(F.col("r2") / F.lit(SPAN)).cast("long").alias("span")).agg(F.sum("n").alias("all"))
    before = Window.partitionBy("r1").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    return wide_join(p, spans, ["r1", "span"]).select("r1", "r2", (F.col("r1") + F.col("base") + F.col("low")).alias("rank"))


def _line_ranks(counts: DataFrame) -> DataFrame:
    """counts: h (128-bit hash of a line), n. Ranks lines in the order of their hashes: n suffixes share a rank.

    A line's rank counts the suffixes before it. Hashes are uniform, so 4096 ranges of them are even.
    """
    c = counts.withColumn("part", F.conv(F.substring(F.hex("h"), 1, 3), 16, 10).cast("int"))
    inside = Window.partitionBy("part").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(F.conv(F.substring(F.hex("h"), 1, 3), 16, 10).cast("int").alias("part")).agg(F.sum("n").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    sums = sums.withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    c = c.withColumn("low", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return wide_join(c, sums, ["part"]).select("h", (F.col("base") + F.col("low")).alias("r"))


def double(ranks: DataFrame, step: int) -> DataFrame:
    """One round of prefix doubling. ranks: key, id, pos, r, the rank among blocks of ``step`` lines that occur more than once.

    Returns the same for blocks of twice as many lines. A block that occurs once has no rank: it shares no longer prefix.
    """
    after = ranks.select("key", (F.col("pos") - F.lit(step)).alias("pos"), F.col("r").alias("r2"))
    joined = ranks.withColumnRenamed("r", "r1").join(after, ["key", "pos"])
    counts = joined.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = _ranked(counts)
    return wide_join(joined, named, ["r1", "r2"]).select("key", "id", "pos", F.col("rank").alias("r"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null: empty), and a key that two rows share only if they have the same id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x00"), text)))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))


def repeated_runs(keyed: DataFrame, min_words: int) -> DataFrame:
    """Lines to delete, as merged spans: key, first, last (exclusive). keyed: id, key, text.

    A run is a stretch of lines in one document with at least ``min_words`` words. A line goes if some run that holds
    it also begins at an earlier place; places are ordered by (id, key, line). It is enough to look at the smallest runs
    from each first line and up to each last line: they cover every run exactly, the longest included. A run of m
    lines is named by the ranks of its first and its last 2**k lines, 2**k <= m < 2**(k+1). Runs with one name are a
    common-prefix interval of the suffix array, at depth m.
    """
    lines = keyed.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "key", "pos", F.unhex(F.md5("line")).alias("h"), words("line").alias("w"))
    counts = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = wide_join(lines, _line_ranks(counts), ["h"]).select("id", "key", "pos", "w", "r")
    first = materialize(first.dropDuplicates(["key", "pos"]))  # a row given twice is one document

    # Stretches of repeated lines, the words before each line of a stretch, and the smallest runs from and up to each
    doc = Window.partitionBy("key").orderBy("pos")
    seg = first.withColumn("seg", F.col("pos") - F.row_number().over(doc))
    whole = Window.partitionBy("key", "seg")
    seg = seg.withColumn("upto", F.sum("w").over(whole.orderBy("pos")))
    seg = seg.withColumn("s", F.col("upto") - F.col("w")).withColumn("total", F.sum("w").over(whole)).withColumn("end", F.max("pos").over(whole) + 1)
    seg = seg.where(F.col("total") >= min_words)
    on = whole.orderBy("s")
    seg = seg.withColumn("b", F.coalesce(F.min("pos").over(on.rangeBetween(min_words, Window.unboundedFollowing)), F.when(F.col("s") + min_words <= F.col("total"), F.col("end"))))
    seg = seg.withColumn("a", F.max("pos").over(on.rangeBetween(Window.unboundedPreceding, -min_words)))
    tail = F.max(F.when(F.col("s") <= F.col("total") - min_words, F.col("pos"))).over(whole)
    seg = seg.withColumn("tail", tail)
    runs = F.array(
        F.struct(F.col("pos").alias("a"), F.col("b").alias("b")),
        F.struct(F.col("a").alias("a"), F.col("pos").alias("b")),
        F.struct(F.when(F.col("pos") == F.col("end") - 1, F.col("tail")).alias("a"), F.col("end").alias("b")),
    )
    runs = seg.select("id", "key", F.explode(runs).alias("x")).select("id", "key", "x.a", "x.b").where("a is not null and b is not null").distinct()
    runs = materialize(runs.withColumn("m", F.col("b") - F.col("a")).withColumn("k", F.floor(F.log2("m") + F.lit(1e-9)).cast("int")))

    levels = runs.agg(F.max("k")).first()[0]
    ranks, flagged = first.select("key", "id", "pos", "r"), []
    for k in range((levels if levels is not None else -1) + 1):
        if k:
            ranks, old = materialize(double(ranks, 1 << (k - 1))), ranks
        mine = runs.where(F.col("k") == k)
        head = ranks.select("key", F.col("pos").alias("a"), F.col("r").alias("r1"))
        foot = ranks.select("key", (F.col("pos") + F.lit(1 << k)).alias("b"), F.col("r").alias("r2"))
        named = mine.join(head, ["key", "a"]).join(foot, ["key", "b"])
        place = F.struct("id", "key", "a")
        least = named.groupBy("m", "r1", "r2").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        later = wide_join(named, least, ["m", "r1", "r2"]).where(~place.eqNullSafe(F.col("least"))).select("key", "a", "b")
        flagged.append(materialize(later))
        if k > 1:
            release(old)
    if not flagged:
        return keyed.select("key", F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    spans = flagged[0]
    for x in flagged[1:]:
        spans = spans.unionByName(x)
    sweep = Window.partitionBy("key").orderBy("a", "b")
    spans = spans.withColumn("reach", F.max("b").over(sweep.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("part", F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("key", "part").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("part")


def _kept(lines: Column, cut: Column) -> Column:
    """The lines outside the sorted spans ``cut``, joined again."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["last"]))
    stops = F.concat(F.transform(cut, lambda c: c["first"]), F.array(F.size(lines)))
    pieces = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(pieces), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """id, text (without the lines of later copies), n_lines, n_dropped, spans of each row of ``docs``.

    ``spans`` are the deleted lines as sorted (first, last) pairs, from 0, the last exclusive. Lines end at ``\\n`` and are
    compared as they are. See :func:`repeated_runs` for what goes. Also within one document, a run that repeats an earlier one goes.

    A null text is empty: one empty line, which stays. A document all of whose lines go keeps its row with an empty text. Rows with the same
    id and text are one document and get the same result each; with the same id and different texts they are ordered by a
    hash of both. Null ids come first. An empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_runs(keyed, min_words).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cut"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    out = keyed.join(spans, "key", "left").withColumn("cut", F.coalesce("cut", none))
    lines = F.split("text", "\n", -1)
    dropped = F.aggregate("cut", F.lit(0), lambda n, c: n + c["last"] - c["first"])
    text = F.when(F.size("cut") == 0, F.col("text")).otherwise(_kept(lines, F.col("cut")))
    return out.select(F.col("id").alias(id_col), text.alias(text_col), F.size(lines).alias("n_lines"), dropped.alias("n_dropped"), F.col("cut").alias("spans"))
