"""The pipeline against a plain Python version of its decisions, stage by stage."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_components, slow_fingerprint, slow_shard
from test_models import speak

from tidemark.llm import common, jaccard, mixing, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        lang = rng.choice(["aa", "bb", "cc"])
        rows.append((i, speak(rng, lang, rng.randint(20, 200)), lang, f"s{i % 4}", 0))
    for i in range(150, 190):
        rows.append((i, rows[i - 150][1], rows[i - 150][2], "s1", 0))
    leak = " ".join(f"secret{k}word" for k in range(30))
    rows += [(200 + i, f"{speak(rng, 'aa', 40)} {leak} {speak(rng, 'aa', 40)}", "aa", "s2", 0) for i in range(5)]
    rows += [(300, None, "aa", None, 0), (301, "12345 !!!", None, None, 0), (302, "", None, "s1", None), (303, speak(rng, "bb", 9000), "bb", None, 0), (None, speak(rng, "bb", 30), "bb", "s3", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, "never seen anywhere in any of these documents at all")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, leak


def test_stages(spark, folder) -> None:
    path, rows, leak = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = [f for _, f in corpus_pipeline.STAGES]
    first = steps[0](spark, docs, path)
    assert first.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert sorted(str(i) for i, _ in kept) == sorted(str(r[0]) for r in rows if r[0] not in (300, 301, 302))
    second = steps[1](spark, first, path)
    fps = {i: slow_fingerprint(t) for i, t in kept}
    roots = brute_components(list(fps), list(fps.values()), 4)
    want = {roots[f] for f in fps.values()}
    assert sorted(r["doc_id"] for r in second.collect() if r["doc_id"] is not None) == sorted(x for x in want if x is not None)
    third = steps[2](spark, second, path)
    left = {r["doc_id"] for r in third.collect()}
    assert left == {r["doc_id"] for r in second.collect() if leak not in r["text"]} and not left & set(range(200, 205))
    fourth = steps[3](spark, third, path)
    taken = defaultdict(int)
    for r in fourth.collect():
        taken[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(third).collect() if r["taken"]}
    assert dict(taken) == plan
    last = steps[4](spark, fourth, path).collect()
    assert len(last) == fourth.count()
    assert all(r["shard"] == slow_shard("" if r["doc_id"] is None else str(r["doc_id"]), 40) for r in last)


def test_run(spark, folder) -> None:
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 100 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("slot")).alias("x")).where("x <> 0").count() == 0


def test_empty_and_further_columns(spark, tmp_path) -> None:
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string, slot int")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def near_rows(n: int = 250) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Documents and copies of them at 5-word Jaccard 0.8 to 0.95, and the pairs of ids at 0.8 or more."""
    rng = random.Random(21)
    rows, pairs = [], []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        copy = list(base)
        similarity = rng.uniform(0.8, 0.95)
        a = jaccard.shingles(" ".join(base))
        while True:
            last, at = list(copy), rng.randrange(len(copy))
            copy[at : at + 1] = [f"x{rng.randrange(5000)}"]
            b = jaccard.shingles(" ".join(copy))
            if len(a & b) / len(a | b) < similarity:
                break
        if len(a & jaccard.shingles(" ".join(last))) < len(a):
            pairs.append((2 * i, 2 * i + 1))
            rows += [(2 * i, " ".join(base), "aa", "s", 0), (2 * i + 1, " ".join(last), "aa", "s", 0)]
        else:
            rows.append((2 * i, " ".join(base), "aa", "s", 0))
    return rows, pairs


def test_near_copies_at_jaccard(spark) -> None:
    """Copies at 0.8 to 0.95 go; texts below 0.8 stay; a chain of copies is one group, though its ends differ."""
    rows, pairs = near_rows()
    words = [f"c{k}" for k in range(204)]
    chain = [" ".join([f"d{k}" if k < 10 * i else w for k, w in enumerate(words)]) for i in range(12)]  # neighbours at 0.9
    far = [" ".join(f"e{k}" for k in range(104)), " ".join(f"e{k}" if k < 82 else f"f{k}" for k in range(104))]  # at 0.64
    rows += [(1000 + i, t, "aa", "s", 0) for i, t in enumerate(chain)] + [(2000 + i, t, "aa", "s", 0) for i, t in enumerate(far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert len(pairs) > 200 and sum(b in left for _, b in pairs) <= 0.01 * len(pairs)
    assert all(a in left for a, _ in pairs) and {2000, 2001} <= left
    assert [i for i in left if 1000 <= i < 2000] == [1000]


def test_near_duplicates_keep_null_and_repeated_ids(spark) -> None:
    """Different texts all stay whatever their ids; of a group the first by id, text and source stays."""
    rng = random.Random(22)
    own = [speak(rng, "bb", 40) for _ in range(8)]
    upper = "".join(c.upper() if c.isascii() else c for c in own[6])
    rows = [(None, own[k], "bb", "s1", 0) for k in range(3)] + [(7, own[k], "bb", "s1", 0) for k in range(3, 6)]
    rows += [(None, own[6], "bb", "s1", 0), (9, own[6], "bb", "s2", 0), (9, own[6], "bb", "s1", 0), (9, upper, "bb", "s9", 0), (8, own[7], "bb", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [*rows[:6], (9, upper, "bb", "s9", 0), rows[-1]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("hold", "passing"), [(1024, 16_384), (3, 10)])
def test_near_copies_around_one_text_against_all_pairs(spark, monkeypatch, hold: int, passing: int) -> None:
    """Copies of one text with many or few edits: just the components that all pairs at Jaccard 0.8 give, however a group is dealt out."""
    monkeypatch.setattr(jaccard, "HOLD", hold)
    monkeypatch.setattr(jaccard, "PASS", passing)
    rng = random.Random(27)
    texts = []
    for family in range(3):
        base = [f"b{family}w{rng.randrange(4000)}" for _ in range(150)]
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 8])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(30)}"
            texts.append(" ".join(copy[: rng.choice([150, 150, 140, 120, 110, 90])]))
    rng.shuffle(texts)
    sets = [jaccard.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (both := len(a & sets[j])) and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    rows = spark.createDataFrame(list(enumerate(texts)), "u long, text string").repartition(5)
    got = {r["u"]: r["root"] for r in jaccard.groups(rows, "u").collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 6


def test_fingerprints_link_what_jaccard_does_not(spark) -> None:
    """Texts below Jaccard 0.8 whose fingerprints are at most 4 bits apart are one group too, and groups of both kinds of links are joined."""
    for seed in range(3000):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(9000)}" for _ in range(120)]
        a, b = " ".join(base), " ".join(f"x{i}" if i in (10, 50, 90) else w for i, w in enumerate(base))
        both, either = (len(f(jaccard.shingles(a), jaccard.shingles(b))) for f in (set.intersection, set.union))
        if (slow_fingerprint(a) ^ slow_fingerprint(b)).bit_count() <= 4 and 100 * both < 80 * either:
            break
    else:
        raise AssertionError("no such texts")
    near = " ".join([*b.split()[:-1], "end"])
    rows = [(i, t, "aa", "s", 0) for i, t in enumerate([a, b, near, speak(rng, "bb", 60)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 3]


def test_batches_of_written_tables_are_bounded(spark) -> None:
    """Long texts go to Python a few at a time, every row once, and the session's setting is as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 60, 1, 1).withColumn("text", F.repeat(F.lit("word "), 100_000))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "m"])

    before = spark.conf.get(key, None)
    seen = common.materialize(docs.mapInArrow(sizes, "n long, m long")).collect()
    assert sum(r["n"] for r in seen) == 60 and max(r["m"] for r in seen) <= common.BATCH_BYTES + 600_000
    assert spark.conf.get(key, None) == before


def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch) -> None:
    """What comes from an explode is larger than Spark's guess: no side of a join is broadcast by it."""
    docs = spark.range(0, 40_000, 1, 1).selectExpr("id AS doc_id", "concat('only ', id) AS text", "'s' AS source")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda rows, text, width, uid: rows.selectExpr(uid, f"xxhash64({uid} div 2) ^ ({uid} % 2) AS fp"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "4m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.maxBroadcastTableSize": "8m"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.agg(F.count("*"), F.max(F.col("doc_id") % 2)).first()[:] == (20_000, 0)
    finally:
        for key in conf:
            spark.conf.unset(key)
