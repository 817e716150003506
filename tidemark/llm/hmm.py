"""Hidden Markov language model over word classes: Baum-Welch across partitions, exact likelihood by scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, wide_join

#: Words with a class of their own, classes that all others share, and the class of the text's end.
OWN, SHARED = 512, 512
END = OWN + SHARED
CLASSES = END + 1


def tokenize(text: str) -> list[bytes]:
    """Words, with A-Z in lower case; bytes keep this to ASCII letters and ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shared_class(token: bytes) -> int:
    """The class of a word without its own: by its last three bytes."""
    return OWN + zlib.crc32(token[-3:]) % SHARED


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary), n, cls of every word of ``docs``; each task sums its words before they are shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: Counter) -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([shared_class(k) for k in keys], pa.int32())], names=["token", "n", "cls"])

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(tokenize(t or ""))
                if len(counts) > 1 << 19:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    chosen = docs.select(F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(run, "token binary, n long, cls int").groupBy("token", "cls").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Corpus counts that every task needs. ``frequent`` holds at most a fixed number of words; all others stay in the table of counts."""

    tokens: int
    distinct: int
    texts: int
    frequent: dict[bytes, int]
    own: dict[bytes, int]
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def class_norm(self) -> np.ndarray:
        """log10 of the denominators of P(word | class); a class of one word is certain."""
        return np.log10(self.class_total + 0.5 * (self.class_distinct + 1))


def vocabulary(counts: DataFrame, texts: int, frequent: int = 1 << 17) -> Vocabulary:
    """Totals and the most frequent words, at most ``frequent`` of them, which bounds what is gathered and broadcast.

    Words are first counted by size class, in steps of a 32nd of an octave. The least class from which on all words fit is the
    cut, so the driver gets no more words than it keeps, from however many tasks.
    """
    classes = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # SHARED rows at most
    step = F.floor(F.log2("n") * 32).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect()  # 64 * 32 rows at most
    cut, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["v"]
        if held > frequent:
            break
        cut = r["step"]
    top = counts.where(step >= (1 << 30 if cut is None else cut)).select("token", "n").collect()
    words = dict(sorted(((bytes(r["token"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0])))
    own = {w: i for i, w in enumerate(list(words)[:OWN])}
    total, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        total[r["cls"]], distinct[r["cls"]] = r["n"], r["v"]
    for w in own:
        total[shared_class(w)] -= words[w]
        distinct[shared_class(w)] -= 1
    n, v = sum(r["n"] for r in classes), sum(r["v"] for r in classes)
    return Vocabulary(n + texts, v + (texts > 0), texts, words, own, total, distinct)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states by states
    emit: np.ndarray  # classes by states
    history: list[float] = field(default_factory=list)  # log10 likelihood of the training texts before each round

    @staticmethod
    def initial(class_counts: np.ndarray, states: int, seed: int) -> Model:
        """Emissions near the classes' shares, a little apart for each state; states that tend to stay, so that they part by topic and language."""
        rng = np.random.default_rng(seed)
        emit = (class_counts + 1)[:, None] * rng.uniform(0.5, 1.5, (len(class_counts), states))
        move = np.full((states, states), 1.0) + 4 * states * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, likelihood: float) -> Model:
        """The next model from expected counts, with a little added to each so that nothing is impossible."""
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), [*self.history, likelihood])


def _batches(seqs: list[np.ndarray], most: int = 1 << 17) -> Iterator[list[int]]:
    """Sequences of like length together, about ``most`` tokens a batch; a longer one stands alone."""
    order, out = sorted(range(len(seqs)), key=lambda i: -len(seqs[i])), []
    for i in order:
        if out and len(seqs[out[0]]) * (len(out) + 1) > most:
            yield out
            out = []
        out.append(i)
    if out:
        yield out


def forward(model: Model, seqs: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 likelihood of each class sequence, by forward recursion scaled at every step.

    With ``counts`` (start, move, emit), the backward recursion runs too and expected counts are added to them. Each step is
    scaled, so single precision will do for these.
    """
    result = np.zeros(len(seqs))
    kind = np.float64 if counts is None else np.float32
    begin, move_on, emits = model.start.astype(kind), model.move.astype(kind), model.emit.astype(kind)
    for group in _batches(seqs):
        lens = np.array([len(seqs[i]) for i in group])
        longest = int(lens[0])
        ids = np.full((longest, len(group)), 0, dtype=np.int64)
        for k, i in enumerate(group):
            ids[: lens[k], k] = seqs[i]
        live = np.searchsorted(-lens, -np.arange(longest), side="left")  # sequences longer than t
        offsets = np.concatenate([[0], np.cumsum(live)])
        alpha = np.empty((int(offsets[-1]), len(begin)), dtype=kind)
        scale = np.empty(int(offsets[-1]), dtype=kind)
        flat = np.concatenate([ids[t, :n] for t, n in enumerate(live)]) if longest else np.zeros(0, dtype=np.int64)
        emitted = emits[flat]
        for t, n in enumerate(live):
            a, b = offsets[t], offsets[t + 1]
            now = begin * emitted[a:b] if t == 0 else (alpha[offsets[t - 1] : offsets[t - 1] + n] @ move_on) * emitted[a:b]
            s = now.sum(axis=1)
            alpha[a:b] = now / s[:, None]
            scale[a:b] = s
        logs = np.log10(scale.astype(np.float64))
        owner = np.concatenate([np.arange(n) for n in live]) if longest else np.zeros(0, dtype=np.int64)
        result[group] = np.bincount(owner, weights=logs, minlength=len(group))
        if counts is None:
            continue
        start, move, emit = counts
        beta = np.ones((len(group), len(begin)), dtype=kind)
        gamma = alpha  # turned into posteriors from the end on
        pairs = np.zeros_like(move)
        for t in range(longest - 1, -1, -1):
            a, n = offsets[t], live[t]
            if t + 1 < longest:
                m = live[t + 1]
                c = offsets[t + 1]
                ahead = emitted[c : c + m] * beta[:m] / scale[c : c + m, None]
                pairs += alpha[a : a + m].T @ ahead
                beta[:m] = ahead @ move_on.T
            gamma[a : a + n] = alpha[a : a + n] * beta[:n]
        start += gamma[: live[0]].sum(axis=0, dtype=np.float64) if longest else 0
        move += pairs * model.move
        for s in range(len(begin)):
            emit[:, s] += np.bincount(flat, weights=gamma[:, s], minlength=len(emit))
    return result


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<u2") for b in column.to_pylist()]


def train(encoded: DataFrame, class_counts: np.ndarray, states: int = 8, rounds: int = 4, seed: int = 7) -> Model:
    """Baum-Welch over all rows of ``encoded`` (codes: class numbers as 16-bit integers).

    Each task adds its expected counts up; their sums, states times classes numbers whatever the corpus's size, make the next model.
    """
    model = Model.initial(class_counts, states, seed)
    spark = encoded.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator, held=held) -> Iterator:
            import pyarrow as pa

            m = held.value
            parts = (np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit))
            total = 0.0
            for batch in batches:
                total += float(forward(m, _sequences(batch.column(0)), parts).sum())
            flat = np.concatenate([*[p.ravel() for p in parts], [total]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

        summed = encoded.select("codes").mapInArrow(expect, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(states + states * states + CLASSES * states + 1)
        flat[summed["i"].to_numpy()] = summed["x"].to_numpy()
        a, b = states, states + states * states
        model = model.updated(flat[:a], flat[a:b].reshape(states, states), flat[b:-1].reshape(CLASSES, states), float(flat[-1]))
        held.unpersist()
    return model


def _encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs: uid, id, held, t. Class codes of each text, what the frequent words add to the sums, and the words left to look up.

    known: words of the frequent list; logs: their log10(count + 0.5); own_logs: of these, the words with their own class;
    norms: log10 of the class denominators; rare: the other words with their numbers.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = held.value
        norm = v.class_norm
        number = {w: i for i, w in enumerate(v.frequent)}  # the words with their own class come first
        logs = np.log10(np.array([*v.frequent.values(), 0.5]) + 0.5)  # the last one is for all other words
        logs[-1] = 0.0
        classes = np.array([v.own.get(w, shared_class(w)) for w in number] + [END], dtype="<u2")
        rare_type = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("codes", "known", "logs", "own_logs", "norms", "rare")}
            for t in batch.column(3).to_pylist():
                tokens = tokenize(t or "")
                at = np.array([number.get(w, -1) for w in tokens], dtype=np.int64)
                missing = np.flatnonzero(at < 0).tolist()
                others = [tokens[i] for i in missing]
                seq = np.append(classes[at], np.uint16(END)).astype("<u2")
                seq[missing] = [shared_class(w) for w in others]
                gained = logs[at]
                out["codes"].append(seq.tobytes())
                out["known"].append(len(tokens) - len(missing))
                out["logs"].append(float(gained.sum()))
                out["own_logs"].append(float(gained[seq[:-1] < OWN].sum()))
                out["norms"].append(float(norm[seq[(seq >= OWN) & (seq < END)]].sum()))
                out["rare"].append([{"token": w, "n": n} for w, n in Counter(others).items()])
            types = {"codes": pa.binary(), "known": pa.int64(), "logs": pa.float64(), "own_logs": pa.float64(), "norms": pa.float64(), "rare": rare_type}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(out[k], types[k]) for k in types]], names=["uid", "id", "held", *types])

    return docs.mapInArrow(run, f"uid long, id {kind}, held boolean, codes binary, known long, logs double, own_logs double, norms double, rare array<struct<token:binary,n:int>>")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 4, seed: int = 7, frequent: int = 1 << 17) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``; rows not held out train the model.

    ``base_score`` is the unigram log10 probability with 0.5 added to each count. ``score`` is the hidden Markov model's: the exact
    forward likelihood of the text's word classes, times P(word | class) from the counts. The 512 most frequent words are classes of
    their own; any other word shares a class with those that end alike. An unseen word takes its class's share of 0.5.

    All training words are counted, with no cut-off. A bounded list of frequent words goes to every task; all other words of
    a text are joined with the table of counts. A null text is empty: its only token is the end. Repeated rows are scored
    each for itself. With nothing to train on, all counts are 0. An empty table gives no rows; other columns are ignored.
    """
    train_docs = docs.where(~held_out)
    counts = materialize(token_counts(train_docs, text_col))
    vocab = vocabulary(counts, train_docs.count(), frequent)
    chosen = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).cast("string").alias("t"))
    encoded = materialize(_encode(chosen, vocab))
    class_counts = np.array(vocab.class_total)
    for w, i in vocab.own.items():
        class_counts[i] = vocab.frequent[w]
    class_counts[END] = vocab.texts
    model = train(encoded.where("not held"), class_counts, states, rounds, seed)

    held = docs.sparkSession.sparkContext.broadcast(model)

    def likelihood(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            seqs = _sequences(batch.column(1))
            logs = forward(held.value, seqs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in seqs], pa.int64()), pa.array(logs)], names=["uid", "n_tokens", "hmm"])

    hmm = encoded.select("uid", "codes").mapInArrow(likelihood, "uid long, n_tokens long, hmm double")
    rare = encoded.select("uid", F.explode("rare").alias("w")).select("uid", "w.token", "w.n")
    seen = wide_join(rare, counts.select("token", F.col("n").alias("c")), ["token"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = seen.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = encoded.drop("codes", "rare").join(hmm, "uid").join(seen, "uid", "left")
    rare_logs, rare_known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    end = float(np.log10(vocab.texts + 0.5))
    words = F.col("logs") - F.col("own_logs") + rare_logs - F.col("norms")
    return out.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + rare_known + F.lit(int(vocab.texts > 0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs + F.lit(end) - F.col("n_tokens") * F.lit(vocab.base_norm)).alias("base_score"),
        (F.col("hmm") + words).alias("score"),
    )
