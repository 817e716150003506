"""Mixing sources to target weights: token blocks, counts drawn for each output shard, pseudorandom slot permutations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, running_offset, wide_join, words

_ROUNDS = 4
#: Output shards that one row of work draws, words whose runs are told apart in a long text, and rows of a source in one bucket of its order.
SHARDS_A_ROW, WORDS_A_PART, ROWS_A_BUCKET = 4, 4096, 50_000
SPACE = r"[\x20\x09-\x0D]"


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Share ``total`` by weight; a source stops at ``most`` times its size, and the excess is shared again until none is above."""
    out = [0.0] * len(sizes)
    left, free = float(total), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def _without_replacement(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` draws out of ``good`` + ``bad`` are good: the hypergeometric law, by inversion around its mode at any size.

    Twelve standard deviations to each side are tabulated; what lies beyond has a chance below 10**-30.
    """
    total = good + bad
    low, high = max(0, take - bad), min(take, good)
    if low == high:
        return low
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))
    spread = 20 + int(12 * (take * (good / total) * (bad / total) * ((total - take) / max(1, total - 1))) ** 0.5)
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)  # ratios of neighbours: p(k + 1) / p(k)
    steps = np.log((good - k) * (take - k)) - np.log((k + 1) * (bad - take + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, last - first))


def _split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are among ``take`` slots drawn without replacement."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts).tolist():
        n = int(counts[i])
        left -= n
        out[i] = _without_replacement(rng, n, left, take)
        take -= int(out[i])
    return out


def draw_counts(slots: Sequence[int], per_shard: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, counts) of the output shards ``first`` to ``last`` (exclusive): how many slots of each source a shard gets, and how many the shards before it got.

    Each shard is a multinomial draw over the sources, given that all shards together use up each source's slots. The draws are halved
    from the top: of a run of shards, the first half's counts are drawn without replacement out of the whole run's, by a
    generator seeded by the run. So any shard's counts follow from the totals alone, whichever task asks, and the law is the same at
    every size.
    """
    totals = np.array(slots, dtype=np.int64)
    shards = -(-int(totals.sum()) // per_shard)
    last = shards if last is None else min(last, shards)

    def below(lo: int, hi: int, start: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi - lo == 1:
            yield lo, start, counts
            return
        mid = (lo + hi) // 2
        left = _split(counts, (mid - lo) * per_shard, np.random.default_rng((seed, lo, hi)))
        if first < mid:
            yield from below(lo, mid, start, left)
        if last > mid:
            yield from below(mid, hi, start + left, counts - left)

    if first < last:
        yield from (x for x in below(0, shards, np.zeros_like(totals), totals) if first <= x[0] < last)


def permutation(n: int, seed: Sequence[int]) -> Callable[[np.ndarray], np.ndarray]:
    """A pseudorandom permutation of 0 .. n - 1: a Feistel network over an even number of bits, repeated until the value is inside."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, size=(_ROUNDS, 2), dtype=np.uint64)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for a, b in keys:
            mixed = (right ^ a) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * (b | np.uint64(1))
            left, right = right, left ^ ((mixed >> np.uint64(29)) & mask)
        return left << half | right

    def run(x: np.ndarray) -> np.ndarray:
        out = network(x.astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = network(out[outside])
        return out.astype(np.int64)

    return run


def plan(rows: DataFrame, weights: Sequence[float], fraction: float, block: int, per_shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of ``rows`` (uid, id, src, size, mark).

    Returns the sources (src, source_size, target) and the pieces: uid, epoch, lo, hi (words of the document, hi exclusive), shard, slot.

    A source's words, in an order by hash of id and mark, are packed into blocks of ``block`` words; the last block is what is left.
    Slot j of a source takes block ``permutation(j mod blocks)`` of its (j div blocks)-th epoch; the last block comes last
    in each epoch, and the last slot takes the first words of its block that the target still asks for. So a source gives its target,
    rounded, and no word is taken over ``ceil(most)`` times. The driver and the tasks hold one row for each source; the counts
    of output shards are drawn where they are used, and slots, blocks and documents stay on the executors.
    """
    spark = rows.sparkSession
    stats = sorted(rows.groupBy("src").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["src"] is None, r["src"] or ""))
    sizes = [r["size"] for r in stats]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], fraction * sum(sizes))
    take = [round(t) for t in targets]
    blocks = [-(-s // block) for s in sizes]
    slots = [t // s * b + -(-(t % s) // block) if s else 0 for t, s, b in zip(take, sizes, blocks, strict=True)]

    shards = -(-sum(slots) // per_shard)

    def expand(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            chunks = batch.column(0).to_pylist()  # numbers in a row
            for number, start, counts in draw_counts(slots, per_shard, seed, chunks[0] * SHARDS_A_ROW, (chunks[-1] + 1) * SHARDS_A_ROW) if chunks else ():
                for i in np.flatnonzero(counts).tolist():
                    yield pa.RecordBatch.from_arrays(placing(number, i, int(start[i]), int(counts[i])), names=["s", "blk", "epoch", "shard", "slot", "most"])

    def placing(number: int, i: int, start: int, count: int) -> list:
        """The blocks that the slots take: those of each epoch in an order of their own."""
        import pyarrow as pa

        j = np.arange(start, start + count)
        epoch, k = j // blocks[i], j % blocks[i]
        blk, whole = k.copy(), k < blocks[i] - 1
        for e in np.unique(epoch):
            now = whole & (epoch == e)
            if now.any():
                blk[now] = permutation(blocks[i] - 1, (seed, i, int(e)))(k[now])
        most = np.full(count, block)
        if start + count == slots[i] and (rest := take[i] % sizes[i] % block):
            most[-1] = rest
        return [pa.array(c) for c in (np.full(count, i, dtype=np.int32), blk, epoch.astype(np.int32), np.full(count, number, dtype=np.int64), j, most)]

    chunks = -(-shards // SHARDS_A_ROW)
    tasks = max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))
    drawn = spark.range(0, chunks, 1, tasks).mapInArrow(expand, "s int, blk long, epoch int, shard long, slot long, most long")

    sources = spark.createDataFrame([(i, r["src"], r["size"], t) for i, (r, t) in enumerate(zip(stats, targets, strict=True))], "s int, src string, source_size long, target double")
    full = rows.where("size > 0")
    buckets = max(1024, 1 << (full.count() // ROWS_A_BUCKET).bit_length())  # grows with the rows, so a bucket doesn't
    dealt = F.pmod(F.xxhash64("id", "mark", "size"), F.lit(buckets)).cast("int")
    placed = running_offset(full, ["src"], ["id", "mark", "size"], "size", "start", dealt)
    placed = placed.join(sources.select("s", "src"), placed["src"].eqNullSafe(sources["src"])).select("uid", "s", "size", "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    placed = placed.withColumn("blk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo = F.greatest(F.lit(0), F.col("blk") * block - F.col("start"))
    placed = placed.withColumn("lo", lo).withColumn("at", F.col("start") + F.col("lo") - F.col("blk") * block)
    placed = placed.withColumn("hi", F.least("size", (F.col("blk") + 1) * block - F.col("start")))
    # The slots' number isn't known to the planner, which would take the few counts they come from for their size
    pieces = placed.join(drawn.hint("merge"), ["s", "blk"]).withColumn("hi", F.least("hi", F.col("lo") + F.col("most") - F.col("at"))).where("hi > lo")
    return sources.drop("s"), pieces.select("uid", "epoch", "lo", "hi", "shard", "slot")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    mark = F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), words(text).alias("size"), mark.alias("mark"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), fraction: float = 1.5, block: int = 1024, per_shard: int = 4096, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target and taken (words the mix takes, repeats counted) of each row of ``docs``.

    Sources in the order of code points, null last, get the weights in turn, and share ``fraction`` of all words; none gets over twice
    its size. The same rows and seed give the same mix, however they are dealt out.

    A null or wordless text has size 0 and gives nothing. A null source is a source. Repeated rows are taken each for itself.
    An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(_rows(docs, id_col, text_col, source_col))
    sources, pieces = plan(rows, weights, fraction, block, per_shard, seed)
    taken = pieces.groupBy("uid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    out = rows.join(taken, "uid", "left").alias("r").join(sources.alias("s"), F.col("r.src").eqNullSafe(F.col("s.src")))
    return out.select(F.col("id").alias(id_col), F.col("r.src").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), fraction: float = 1.5, block: int = 1024, per_shard: int = 4096, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row for each document and epoch that it is taken in, with all columns of ``docs`` and the words taken as its text.

    A document taken whole keeps its text as it is; of one taken in part, each stretch of words keeps its white space, and
    stretches are joined by a line end. See :func:`mix` for the counts and the handling of nulls.
    """
    names = docs.columns
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    kept = materialize(kept)
    place = {c: f"c{i}" if c != text_col else "text" for i, c in enumerate(names)}
    mark = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    rows = materialize(kept.select("uid", F.col(place[id_col]).alias("id"), F.col(place[source_col]).cast("string").alias("src"), words("text").alias("size"), mark.alias("mark")))
    _, pieces = plan(rows, weights, fraction, block, per_shard, seed)
    spans = pieces.groupBy("uid", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
    spans = wide_join(spans, rows.select("uid", "size").hint("merge"), ["uid"]).select("uid", F.when(F.col("got") < F.col("size"), F.col("spans")).alias("spans"))  # null: taken whole
    out = wide_join(kept, spans, ["uid"]).withColumn("text", cut(F.col("text"), F.col("spans")))
    return out.select(*[F.col(place[c]).alias(c) for c in names])


def cut(text: Column, spans: Column) -> Column:
    """The words of ``spans`` (sorted lo, hi; hi exclusive) with the white space before each; stretches that don't touch are joined by a line end. Null spans: all of the text.

    The text is split into parts of ``WORDS_A_PART`` words once, and a span looks at its own parts alone, so a long text takes time and
    memory in proportion to its length. All quantifiers are possessive: they never go back, and never go deep.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?:{SPACE}*+{WORD}+){{1,{WORDS_A_PART}}}+"), F.lit(0))

    def stretch(split: Column, spans: Column) -> Column:
        def one(span: Column, i: Column) -> Column:
            first, last = F.floor(span["lo"] / WORDS_A_PART).cast("int"), F.floor((span["hi"] - 1) / WORDS_A_PART).cast("int")
            near = F.array_join(F.slice(split, first + 1, last - first + 1), "")
            skip = (span["lo"] - first * WORDS_A_PART).cast("string")
            count = (span["hi"] - span["lo"]).cast("string")
            found = F.regexp_extract_all(near, F.concat(F.lit(f"\\A(?:{SPACE}*+{WORD}+){{"), skip, F.lit(f"}}+((?:{SPACE}*+{WORD}+){{"), count, F.lit("}+)")), F.lit(1))[0]
            touches = (i > 0) & (F.get(spans, F.greatest(i - 1, F.lit(0)))["hi"] == span["lo"])
            bare = F.regexp_replace(found, f"\\A{SPACE}+", "")
            return F.when(touches, found).when(i > 0, F.concat(F.lit("\n"), bare)).otherwise(bare)

        return F.array_join(F.transform(spans, one), "")

    held = F.transform(F.array(F.struct(parts.alias("p"), spans.alias("s"))), lambda x: stretch(x["p"], x["s"]))[0]  # the parts are bound once
    return F.when(spans.isNull(), text).otherwise(held)
