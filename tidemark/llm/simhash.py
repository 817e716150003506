"""SimHash fingerprints, near-duplicate links by pigeonhole blocks, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, materialize, measured_joins, release, trim, wide_join

FINGERPRINT_BITS = 64


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of the text's ``width``-word shingles: A-Z lower-cased, XXH64 with seed 42, a bit set if over half the hashes have it."""
    import xxhash

    tokens = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], 42) for a, b in zip(starts, stops[width - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(FINGERPRINT_BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a slice of a long text at a time
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, id_col: str = "doc_id") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row; null and wordless texts have fp 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trim()
        for batch in batches:
            fps = [fingerprint(t or "", width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def block_masks(parts: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` out of ``parts`` blocks; fingerprints at most ``parts - agree`` bits apart share one."""
    edges = [FINGERPRINT_BITS * i // parts for i in range(parts + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(whole, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree_edges(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect just what all links within ``distance`` connect: a breadth-first forest, one link for each fingerprint at most."""
    left, out = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def near_links(fps: DataFrame, distance: int = 4, parts: int = 7, most: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that give the components of all pairs within ``distance`` bits.

    Every choice of ``parts - distance`` blocks is a key; a close pair shares one. Fingerprints of a key are compared with each
    other inside its group, but a group returns only a spanning forest, so no group emits its pairs. A group of over ``most``
    distinct fingerprints isn't gathered in one task: its members are linked through midpoints. Two fingerprints within 4
    bits have one within 2 bits of both, so each member is dealt to all fingerprints within half the
    distance, and the members met there are linked to the least one. That is exact too, and linear in the group.
    """
    if distance not in (0, 2, 4):
        raise ValueError("midpoints lie within half the distance of both fingerprints only for distances 0, 2 and 4")
    masks = [_signed(m) for m in block_masks(parts, parts - distance)]
    tables = F.array(*[F.struct(F.lit(i).cast("short").alias("tbl"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", F.col("k.tbl").alias("tbl"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))
    sizes = keyed.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(wide_join(keyed, sizes, ["tbl", "key"]))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def edges(tbl, key, fp):
            """Links of whole groups, which lie one after the other."""
            same = (tbl[1:] == tbl[:-1]) & (key[1:] == key[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(fp)]
            out, pairs = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a == 2:
                    pairs.append(a)
                elif b - a > 2:
                    out += _tree_edges(fp[a:b], distance)
            p = np.array(pairs, dtype=np.int64)
            close = p[np.bitwise_count(fp[p] ^ fp[p + 1]) <= distance] if len(p) else p
            a = np.concatenate([np.array([x for x, _ in out], dtype=np.uint64), fp[close]])
            b = np.concatenate([np.array([y for _, y in out], dtype=np.uint64), fp[close + 1]])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        trim()
        held = None  # the last group of a batch may go on in the next one
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            if not len(now[0]):
                continue
            tbl, key, fp = now[0], now[1], now[2].view(np.uint64)
            last = np.flatnonzero((tbl != tbl[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield edges(tbl[:cut], key[:cut], fp[:cut])
            held = [tbl[cut:], key[cut:], fp[cut:].view(np.int64)]
        if held:
            yield edges(held[0], held[1], held[2].view(np.uint64))

    small = shared.where(F.col("n") <= most).select("tbl", "key", "fp")
    small = small.repartition("tbl", "key").sortWithinPartitions("tbl", "key", "fp").mapInArrow(compare, "a long, b long")
    flips = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i, j in combinations(range(64), 2)]]
    flips = [x for x in flips if 2 * x.bit_count() <= distance]
    big = shared.where(F.col("n") > most).select("fp").distinct()
    spread = big.mapInArrow(_midpoints(flips), "z long, fp long")
    least = spread.groupBy("z").agg(F.min("fp").alias("b"))
    large = wide_join(spread, least, ["z"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(large).distinct()


def _midpoints(flips: list[int]):
    masks = np.array(flips, dtype=np.uint64).view(np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                z = (part[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(part, len(masks)))], names=["z", "fp"])

    return run


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node it can reach) of every node in ``links`` (a, b longs), by alternating large and small stars.

    Each round is written to the shared folder. Hot nodes are joined so that AQE can split them, and minima are combined before
    each shuffle, so a star with a third of all nodes is no single task's work.
    """

    def star(sym: DataFrame, large: bool) -> DataFrame:
        """sym: u, v. Each u links its neighbours (the larger ones, or the smaller and itself) to the least node around u."""
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        if large:
            out = wide_join(sym.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = wide_join(sym, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def open_(df: DataFrame) -> bool:
        """Whether some node is both above and below a link, or above two: then the links aren't yet one from each node to its root."""
        ends = df.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))).alias("e")).select("e.*")
        return not ends.groupBy("node").agg(F.sum("above").alias("a"), F.max("below").alias("b")).where("a > 1 or a = 1 and b = 1").isEmpty()

    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if not open_(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = star(both, True)
        turned = grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after = materialize(star(turned, False))
        release(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    give_back()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, parts: int = 7, most: int = 4096) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id reachable over links of at most ``distance`` differing bits).

    Equal fingerprints meet first, so copies never make pairs. Null and wordless texts have fingerprint zero, which links like any
    other. Rows that repeat an id stay, each with its own text's component. Null ids are never a component's id unless it has
    no other. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(with_fingerprints(docs, text_col, width, id_col))
    with measured_joins(docs.sparkSession):
        unique = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
        links = materialize(near_links(unique.select("fp"), distance, parts, most))
        roots = components(links)
        members = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        members = materialize(members.select("fp", "root", "least"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = wide_join(members.select("fp", "root"), named.hint("merge"), ["root"]).select("fp", "component_id")
    out = wide_join(rows, named.hint("merge"), ["fp"])
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
