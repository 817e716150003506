"""Exact, line and near deduplication, and sharding, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, line_dedup, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, h string, key string, uid long, n long"


def frame(spark, rows: list[tuple]):
    """Rows of (doc_id, text), with clashing further columns."""
    return spark.createDataFrame([(i, t, "en", "s", "h", "k", 1, 2) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "a b c"), (5, " "), (None, "a b c"), (6, "x " * 60_000), (7, "ä\n" * 20), (2, "other"), (None, None)]


def test_exact_dedup(spark) -> None:
    rows = ODD + [(10 + i, f"t{i % 4}") for i in range(20)]
    for keep, pick in (("max", max), ("min", min)):
        got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        want = []
        for i, t in rows:
            ids = [x for x in groups[t or ""] if x is not None]
            k = pick(ids) if ids else None
            want.append((i, k, len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_hash_collisions_are_told_apart(spark, monkeypatch) -> None:
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}


def test_exact_dedup_without_broadcast(spark, monkeypatch) -> None:
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(frame(spark, [(i, f"t{i % 3}") for i in range(12)])).collect()}
    assert got == {i: i % 3 for i in range(12)}


# Lines
def brute_lines(rows: list[tuple], min_words: int) -> dict:
    """Every run of at least ``min_words`` words that also begins at an earlier place loses its lines."""
    docs = sorted({(i, t or "") for i, t in rows})
    lines = [t.split("\n") for _, t in docs]
    first: dict[tuple, tuple] = {}
    dropped = [set() for _ in docs]
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(ls[a:b])
                if sum(len(re.findall(common.WORD, x)) for x in run) >= min_words and first.setdefault(run, (d, a)) != (d, a):
                    dropped[d] |= set(range(a, b))
    return {docs[d]: "\n".join(x for k, x in enumerate(ls) if k not in dropped[d]) for d, ls in enumerate(lines)}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed: int) -> None:
    rng = random.Random(seed)
    vocabulary = ["one two three", "four five", "six", "", "seven eight nine ten", "a b c d e"]
    rows = [(i, "\n".join(rng.choice(vocabulary) if rng.random() < 0.85 else f"own {i} {k}" for k in range(rng.randint(1, 14)))) for i in range(25)]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, ""), (33, "\n".join(["", "", "six"] * 9))]
    want = brute_lines(rows, 6)
    got = line_dedup.line_dedup(frame(spark, rows), min_words=6).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], dict(rows)[r["doc_id"]]): r["text"] for r in got} == want
    assert any(r["n_dropped"] for r in got) and any(not r["n_dropped"] for r in got)


def test_line_dedup_odd_rows(spark) -> None:
    got = line_dedup.line_dedup(frame(spark, ODD), min_words=3).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["text"])
    assert len(got) == len(ODD) and by[1] == [""] and by[3] == [""] and by[4] == ["", ""] and sorted(by[None]) == ["", "a b c"] and len(by[6][0]) == 120_000
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


# Fingerprints
def slow_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(common.WORD, lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids: list, fps: list[int], distance: int) -> dict[int, int]:
    root = {f: f for f in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in distinct}


def test_near_duplicates(spark) -> None:
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows: list[tuple] = list(ODD)
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        rows.append((100 + 10 * i, " ".join(base)))
        for k in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "CHANGED"
            rows.append((101 + 10 * i + k, " ".join(copy)))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{f:016x}" for f in fps)
    want = brute_components([i for i, _ in rows], fps, 4)
    assert all(r["component_id"] == want[int(r["fingerprint"], 16)] for r in got)
    assert len(set(want.values())) < len(set(fps))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_links_in_dense_balls(spark, most: int) -> None:
    """Many fingerprints around a few centres: the forest of each group, and the midpoints of groups over ``most``, keep every component."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    ids = sorted(fps)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in ids]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), most=most).collect()
    pairs = [(int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in links]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    want = brute_components(list(range(len(ids))), ids, 4)
    nodes = simhash.components(spark.createDataFrame([(r["a"], r["b"]) for r in links], "a long, b long")).collect()
    root = {int(np.int64(r["node"]).view(np.uint64)): r["root"] for r in nodes}
    groups, expected = defaultdict(set), defaultdict(set)
    for x in ids:
        groups[root.get(x, int(np.uint64(x).view(np.int64)))].add(x)
        expected[want[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_chain_and_a_star(spark) -> None:
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160))


# Shards
def slow_shard(key: str, n: int) -> int:
    return max((hashlib.md5(f"{key}:{s}".encode()).hexdigest(), s) for s in range(n))[1]


def test_sharding(spark) -> None:
    rows = ODD + [(i, f"text {i % 50}") for i in range(20, 400)]
    got = sharding.shard(frame(spark, rows), 7).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (slow_shard(key, 7), slow_shard(key, 8))
        assert r["grown_shard"] in (r["shard"], 7)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 7
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(frame(spark, [])).count() == 0


def test_weighted_shards(spark) -> None:
    ids = spark.range(4000)
    plain = {r["id"]: r["s"] for r in ids.select("id", sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0, 0.0]).alias("s")).collect()}
    more = {r["id"]: r["s"] for r in ids.select("id", sharding.rendezvous(F.col("id"), [1.0, 3.0, 1.0, 0.0]).alias("s")).collect()}
    share = sum(s == 1 for s in plain.values()) / 4000
    assert abs(share - 0.5) < 0.04 and 3 not in plain.values()
    assert all(more[i] in (plain[i], 1) for i in plain)


def test_running_offset(spark) -> None:
    df = spark.createDataFrame([(i % 3, i, i % 7) for i in range(300)] + [(None, 1, 5)], "g long, i long, v long")
    got = common.running_offset(df, ["g"], ["i"], "v", "o").collect()
    spans = defaultdict(list)
    for r in got:
        spans[r["g"]].append((r["o"], r["o"] + r["v"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))


def test_fingerprints_that_share_most_keys_are_not_broadcast(spark, monkeypatch) -> None:
    """The groups of keys come from an explode and a count, which Spark's guess of their size leaves out: the driver gets no more than the threshold."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "xxhash64(id div 2) ^ (id % 2) AS fp")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, *_: docs)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "4m", "spark.sql.maxBroadcastTableSize": "8m"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        wrong = simhash.near_duplicates(docs).where("component_id <> doc_id - doc_id % 2").count()
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "4m"
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert wrong == 0
