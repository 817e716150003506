"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answer checks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, materialize, release, with_text_columns

#: Hashed terms, latent dimensions and the surplus of the random sketch.
TERMS, DIMENSIONS, SURPLUS = 1 << 14, 128, 16
#: A passage of the fit, a chunk of the search, and the windows searched: (chunks, stride in chunks).
PASSAGE, CHUNK, WINDOWS = 32, 8, ((2, 1), (4, 2), (8, 2))
#: At most about so many passages of the corpus fit the latent space; all passages are counted and searched.
FIT_PASSAGES = 16_384
#: Items of fewer words must occur word by word; items of fewer than the least say nothing and are left out.
SHORT, LEAST = 5, 3
#: Items that are searched at a time: what a task is sent and the driver holds is bounded by them.
ITEMS_AT_A_TIME = 8_192
#: Tasks that fit the space.
FIT_TASKS = 3
#: Characters of texts that are counted or searched at a time, so that their arrays stay in a core's cache; a longer text stands alone.
BLOCK = 1 << 18


#: Bytes of lower-cased text: 0 part of a word, 1 white space, 2 punctuation, which is left out.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 2
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, b, dtype=np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


@dataclass
class Words:
    """The words of a block of texts, one text after the other: lower-cased, without ASCII punctuation."""

    data: np.ndarray  # bytes
    first: np.ndarray  # where each word begins and ends in them
    last: np.ndarray
    sizes: np.ndarray  # words of each text
    terms: np.ndarray  # the hashed term of each word

    @staticmethod
    def of(texts: list[str]) -> Words:
        encoded = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        kind = _KIND[raw]
        keep = kind != 2
        data, space = raw[keep], kind[keep] == 1
        before = np.concatenate([[True], space[:-1]])
        first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        stops = np.cumsum(keep)[np.cumsum([len(e) for e in encoded]) - 1] if encoded else np.zeros(0, dtype=np.int64)
        sizes = np.bincount(np.searchsorted(stops, first, side="right"), minlength=len(texts))
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        mixed = (sums[last] - sums[first]) * inverse[first]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_BASE)
        return Words(data, first, last, sizes, (mixed >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64))

    def listed(self, a: int, b: int) -> list[bytes]:
        return self.data[self.first[a] : self.last[b - 1]].tobytes().split() if a < b else []


def _starts(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each ``step``-word piece of each text, and the text it is in."""
    pieces = -(-sizes // step)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return (np.cumsum(sizes) - sizes)[owner] + within * step, owner


def passage_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many 32-word passages of the corpus each hashed term occurs, and how many passages there are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df = np.zeros(TERMS + 1, dtype=np.int64)
        for _, texts in blocks(batches, "t", BLOCK):
            w = Words.of(texts)
            at, _ = _starts(w.sizes, PASSAGE)
            if len(at):
                passage = np.repeat(np.arange(len(at)), np.diff(at, append=len(w.terms)))
                found = np.sort(passage * TERMS + w.terms)
                new = np.concatenate([[True], found[1:] != found[:-1]])
                df[:TERMS] += np.bincount(found[new] % TERMS, minlength=TERMS)
                df[TERMS] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(df)], names=["i", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    for i, n in rows:
        out[i] = n
    return out[:TERMS], int(out[TERMS])


def _passages(docs: DataFrame, text_col: str, share: float) -> DataFrame:
    """Terms of all passages of the documents whose hash, over all columns, falls into ``share``; other documents aren't even split."""
    most = round(share * (1 << 32))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, texts in blocks(batches, "t"):
            w = Words.of(texts)
            at, _ = _starts(w.sizes, PASSAGE)
            found = [p.astype(np.int32).tobytes() for p in np.split(w.terms, at[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["terms"])

    names = [c for c, kind in docs.dtypes if "map<" not in kind]
    chosen = docs.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(1 << 32)) < most)
    return chosen.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "terms binary")


def _product(passages: list[np.ndarray], idf: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """A'(AQ) of the passages' TF-IDF rows of length 1, or (AQ)'(AQ) if ``small``, in single precision; of A only what isn't zero is ever held."""
    out = np.zeros((q.shape[1] if small else TERMS, q.shape[1]), dtype=np.float32)
    for at in range(0, len(passages), 2048):
        some = passages[at : at + 2048]
        sizes = np.array([len(p) for p in some])
        pairs, times = np.unique(np.repeat(np.arange(len(some)), sizes) * TERMS + np.concatenate(some), return_counts=True)
        row, term = np.divmod(pairs, TERMS)
        weight = (idf[term] * times).astype(np.float32)
        weight /= np.maximum(np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(some))), 1e-9)[row].astype(np.float32)
        starts = np.searchsorted(row, np.arange(len(some)))
        y = np.add.reduceat(q[term] * weight[:, None], starts, axis=0)
        if small:
            out += y.T @ y
            continue
        order = np.argsort(term, kind="stable")
        heads = np.flatnonzero(np.diff(term[order], prepend=-1))
        out[term[order][heads]] += np.add.reduceat(y[row[order]] * weight[order][:, None], heads, axis=0)
    return out


#: Rows of a matrix that travel together.
_ROWS = 1024


def _summed(parts: DataFrame) -> DataFrame:
    """The sums, block by block, of matrices that tasks give in blocks (i, x), so that the driver gets one matrix whatever the number of tasks."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_py(), dtype=np.float32)
                held[i] = held[i] + x if i in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "x"])

    return parts.repartition("i").mapInArrow(add, "i int, x binary")


def latent_space(passages: DataFrame, idf: np.ndarray, more: list[np.ndarray], dimensions: int = DIMENSIONS, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms by dimensions) of the passages' TF-IDF matrix A, by randomised range finding.

    Each round multiplies A'A with the current basis: every task works out its part of A'(AQ), the parts are summed in blocks of rows, and the
    driver gets the sum and orthogonalises. ``more`` are further passages, of the benchmark. The last product, (AQ)'(AQ), is small
    and gives the rotation.
    """
    sc = passages.sparkSession.sparkContext

    def product(q: np.ndarray, small: bool) -> np.ndarray:
        held = sc.broadcast((q, idf))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            q, weights = held.value
            total = np.zeros((q.shape[1] if small else TERMS, q.shape[1]), dtype=np.float32)
            for batch in batches:
                rows = [x for b in batch.column(0).to_pylist() if len(x := np.frombuffer(b, dtype=np.int32))]
                total += _product(rows, weights, q, small)
            cuts = range(0, len(total), _ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array([total[c : c + _ROWS].tobytes() for c in cuts], pa.binary())], names=["i", "x"])

        total = _product(more, idf, q, small)
        for r in _summed(passages.mapInArrow(run, "i int, x binary")).toLocalIterator():
            total[r["i"] * _ROWS : (r["i"] + 1) * _ROWS] += np.frombuffer(r["x"], dtype=np.float32).reshape(-1, total.shape[1])
        held.destroy()
        return total

    q = np.random.default_rng(seed).standard_normal((TERMS, dimensions + SURPLUS), dtype=np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(product(q, False))[0]
        give_back()
    _, turn = np.linalg.eigh(product(q, True).astype(np.float64))
    return (q @ turn[:, ::-1][:, :dimensions]).astype(np.float32)


@dataclass
class Item:
    """A benchmark passage as words, and the bits at which each word stands."""

    ident: int | None
    words: list[bytes]
    masks: dict[bytes, int]

    @staticmethod
    def of(ident: int, words: list[bytes]) -> Item:
        masks: dict[bytes, int] = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        return Item(ident, words, masks)

    def common(self, text: list[bytes]) -> int:
        """Bits of the item's words, cleared where a longest common subsequence with ``text`` grows (bit-parallel)."""
        full = (1 << len(self.words)) - 1
        v = full
        for w in text:
            if m := self.masks.get(w):
                u = v & m
                v = (v + u) | (v - u)
        return len(self.words) - (v & full).bit_count()

    @property
    def answer(self) -> list[bytes]:
        return self.words[-max(3, len(self.words) // 5) :]


def contained(item: Item, region: list[bytes], strong: float, weak: float) -> float:
    """The best share of the item's words found in order within stretches 1.5 times its length; 0 if that is no match.

    A share of ``strong`` is a match. From ``weak`` on, the stretch must also hold the item's answer, its last words, in order. An item
    of under ``SHORT`` words must stand in the region as it is.
    """
    n, best = len(item.words), 0.0
    if n < SHORT:
        return float(any(region[i : i + n] == item.words for i in range(len(region) - n + 1)))
    if item.common(region) < weak * n:
        return 0.0
    answer = Item.of(0, item.answer)
    width, step = n + n // 2 + 1, max(1, n // 4)
    for at in range(0, max(1, len(region) - width + step), step):
        part = region[at : at + width]
        share = item.common(part) / n
        if share > best and (share >= strong or share >= weak and answer.common(part) == len(answer.words)):
            best = share
    return best


@dataclass
class Gate:
    """What a window must hold of the items of half to all of ``most`` words, for ``contained`` to accept a stretch of it."""

    most: int
    members: np.ndarray  # numbers of the items
    sizes: np.ndarray  # words of each
    short: np.ndarray  # whether it must occur word by word
    column: np.ndarray  # of each term, those in many items first; -1 for terms of no item
    often: np.ndarray  # terms in many items by items: how often the item has the term
    start: np.ndarray  # postings of each further column: items and how often they have it
    posted: np.ndarray
    times: np.ndarray
    answers: list[np.ndarray]  # columns of each item's answer

    @staticmethod
    def of(most: int, members: list[int], items: list[Item], terms: list[np.ndarray]) -> Gate:
        n = len(members)
        pairs, times = np.unique(np.concatenate([terms[k] * n + i for i, k in enumerate(members)]), return_counts=True)
        term, item = np.divmod(pairs, n)
        spread = np.bincount(term, minlength=TERMS)
        order = np.argsort(-spread, kind="stable")[: np.count_nonzero(spread)]
        column = np.full(TERMS + 1, -1)
        column[order] = np.arange(len(order))
        split = np.count_nonzero(spread > max(4, n // 16))
        often = np.zeros((split, n), dtype=np.float32)
        many = column[term] < split
        often[column[term[many]], item[many]] = times[many]
        rest = np.flatnonzero(~many)
        rest = rest[np.argsort(column[term[rest]], kind="stable")]
        start = np.concatenate([[0], np.cumsum(spread[order[split:]])])
        answers = [np.unique(column[terms[k][-len(items[k].answer) :]]) for k in members]
        sizes = np.array([len(items[k].words) for k in members])
        return Gate(most, np.array(members), sizes, sizes < SHORT, column, often, start, item[rest], times[rest], answers)

    def windows(self, words: Words, strong: float, weak: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, last) of all windows that may hold a stretch that ``contained`` accepts.

        No stretch is longer than ``reach``, so each lies whole in a window of twice that. A stretch's words in order are no more than
        the item's words whose terms occur in the window, and an answer in order has all its terms there: no match is lost.
        """
        n, split, wide = len(self.members), len(self.often), len(self.often) + len(self.start) - 1
        reach = self.most + self.most // 2 + 1
        at, owner = _starts(words.sizes, reach)
        if not len(at):
            return
        begin = np.cumsum(words.sizes) - words.sizes
        edges = np.append(at, len(words.terms))
        joins = np.append(owner[1:] == owner[:-1], False)  # a window is a piece and the next one of its text
        step = max(1, (1 << 21) // max(n, wide))
        for low in range(0, len(at), step):
            high = min(low + step, len(at))
            end = min(high + 1, len(at))
            col = self.column[words.terms[edges[low] : edges[end]]]
            piece = np.repeat(np.arange(end - low), np.diff(edges[low : end + 1]))
            pieces = np.zeros((end - low, wide), dtype=bool)
            pieces.ravel()[(piece * wide + col)[col >= 0]] = True
            held_terms = pieces[: high - low].copy()
            next_ = np.flatnonzero(joins[low:high])
            held_terms[next_] |= pieces[next_ + 1]
            held = held_terms[:, :split].astype(np.float32) @ self.often
            window, term = np.divmod(np.flatnonzero(held_terms[:, split:]), max(1, wide - split))
            lists = self.start[term + 1] - self.start[term]
            where = np.repeat(self.start[term] - (np.cumsum(lists) - lists), lists) + np.arange(int(lists.sum()))
            held += np.bincount(np.repeat(window * n, lists) + self.posted[where], weights=self.times[where], minlength=held.size).reshape(held.shape)
            for w, i in zip(*[x.tolist() for x in np.nonzero(held >= np.where(self.short, 1.0, weak) * self.sizes - 1e-3)], strict=True):
                if held[w, i] >= strong * self.sizes[i] - 1e-3 or held_terms[w, self.answers[i]].all():
                    t = int(owner[low + w])
                    lo = int(at[low + w] - begin[t])
                    yield t, int(self.members[i]), lo, min(lo + 2 * reach, int(words.sizes[t]))


@dataclass
class Index:
    """The benchmark in latent space."""

    idf: np.ndarray
    space: np.ndarray  # terms by dimensions, times idf; one more row of zeros, for what fills up a chunk
    items: list[Item]
    latent: np.ndarray  # items by dimensions
    terms: list[np.ndarray]  # distinct terms of each item
    weight: np.ndarray  # sum of idf over them
    words: list[np.ndarray]  # the term of each word of each item

    def gates(self) -> list[Gate]:
        """The items by length, doubling from 8 words up to the longest."""
        by: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            by.setdefault(max(8, 1 << (len(item.words) - 1).bit_length()), []).append(i)
        return [Gate.of(most, members, self.items, self.words) for most, members in sorted(by.items())]

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The items in blocks: number of the first, latent vectors, the column of each term (0 for terms of none of them), and of items by columns, one row after the other, which are the item's."""
        for at in range(0, len(self.items), 512):
            some = self.terms[at : at + 512]
            used = np.unique(np.concatenate(some))
            column = np.zeros(TERMS + 1, dtype=np.int32)
            column[used] = np.arange(1, len(used) + 1, dtype=np.int32)
            held = np.zeros((len(some), len(used) + 1), dtype=np.uint8)
            for i, t in enumerate(some):
                held[i, column[t]] = 1
            yield at, self.latent[at : at + 512], column, held


@dataclass
class Fit:
    """What the corpus gives: the passages' idf, and the latent space times it, with one more row of zeros for what fills up a chunk."""

    idf: np.ndarray
    space: np.ndarray

    def index(self, items: list[tuple]) -> Index:
        """(id, text) pairs folded into the space."""
        words = Words.of([t or "" for _, t in items])
        ends = np.cumsum(words.sizes)
        long = [(r[0], int(e - m), int(e)) for r, e, m in zip(items, ends, words.sizes, strict=True) if m >= LEAST]
        rows = [words.terms[a:b] for _, a, b in long]
        latent = np.array([self.space[r].sum(axis=0) for r in rows], dtype=np.float32).reshape(len(rows), self.space.shape[1])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        distinct = [np.unique(r) for r in rows]
        return Index(self.idf, self.space, [Item.of(i, words.listed(a, b)) for i, a, b in long], latent, distinct, np.array([self.idf[u].sum() for u in distinct]), rows)


def fit(docs: DataFrame, benchmark: DataFrame, item_col: str = "text", text_col: str = "text", fit_passages: int = FIT_PASSAGES) -> Fit:
    """Count all passages, and fit the latent space on at most about ``fit_passages`` of them and as many benchmark items, drawn by hash."""
    df, n = passage_counts(docs, text_col)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32).clip(0)
    items = benchmark.select(F.col(item_col).cast("string").alias("t")).where("t is not null").distinct()
    share = min(1.0, fit_passages / max(1, items.count()))
    some = Words.of([r[0] for r in items.where(F.pmod(F.xxhash64("t"), F.lit(1 << 32)) < round(share * (1 << 32))).orderBy("t").collect()])
    more = [r for r in np.split(some.terms, np.cumsum(some.sizes)[:-1]) if len(r) >= LEAST] if len(some.sizes) else []
    sample = materialize(_passages(docs, text_col, min(1.0, fit_passages / max(1, n))).repartition(FIT_TASKS))
    space = latent_space(sample, idf, more) * idf[:, None]
    release(sample)
    give_back()
    return Fit(idf, np.vstack([space, np.zeros((1, space.shape[1]), dtype=np.float32)]))


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", item_col: str = "text", most: int = ITEMS_AT_A_TIME) -> Iterator[list[tuple]]:
    """The distinct (id, text) pairs in lists of about ``most``; a block is told by hash, so none but its own rows come to the driver."""
    pairs = benchmark.select(F.col(id_col).alias("i"), F.col(item_col).cast("string").alias("t")).distinct()
    parts = -(-pairs.count() // most)
    for k in range(parts):
        rows = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [tuple(r) for r in rows.orderBy("i", "t").collect()]


def candidates(index: Index, parts: list, words: Words, cosine: float, cover: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first, last) for windows near an item in latent space that hold enough of its distinctive terms.

    ``cover`` is the share of the item's IDF that the window's words must reach; it is computed on terms, not in latent space.
    """
    pieces = -(-words.sizes // CHUNK)
    n = int(pieces.sum())
    if not n or not index.items:
        return
    # Each text's terms in whole chunks, filled up with the row of zeros; each text begins at an even row, with empty rows for the longest window behind it
    most = max(chunks for chunks, _ in WINDOWS)
    spaced = (pieces + most + 1) // 2 * 2
    start, begin = np.cumsum(words.sizes) - words.sizes, np.cumsum(spaced) - spaced
    padded = np.full((int(spaced.sum()), CHUNK), TERMS, dtype=np.int64)
    padded.ravel()[np.arange(len(words.terms)) + np.repeat(begin * CHUNK - start, words.sizes)] = words.terms
    owner = np.repeat(np.arange(len(spaced)), spaced)
    full = np.flatnonzero(padded[:, 0] != TERMS)
    window = np.zeros((len(padded), index.space.shape[1]), dtype=np.float32)
    taken = np.empty((256, index.space.shape[1]), dtype=np.float32)
    for a in range(0, n, 256):
        rows = full[a : a + 256]
        terms = padded[rows]
        total = np.take(index.space, terms[:, 0], axis=0)
        for c in range(1, CHUNK):
            total += np.take(index.space, terms[:, c], axis=0, out=taken[: len(rows)], mode="clip")  # no term is out of range, and "raise" would copy
        window[rows] = total
    idf = np.append(index.idf, np.float32(0))[padded]
    width, step = 1, 1
    for chunks, stride in WINDOWS:  # each twice as wide as the one before, on the same or every other row
        while width < chunks:
            ahead = width // step
            window[:-ahead] = window[:-ahead] + window[ahead:]
            width *= 2
            if step < stride:
                window, step = window[::2].copy(), 2 * step
        begins = full if step == 1 else full[full % step == 0] // step  # windows that begin in empty rows are empty
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9) * np.float32(cosine)
        for base, latent, column, items in parts:
            cols = column[padded]
            for a in range(0, len(begins), 1024):
                rows = begins[a : a + 1024]
                w, x = np.divmod(np.flatnonzero((window[rows] @ latent.T >= norm[rows, None]).ravel()), len(latent))
                for c in range(0, len(w), 16_384):
                    first, xc = rows[w[c : c + 16_384]] * step, x[c : c + 16_384]
                    at = np.minimum(first[:, None] + np.arange(chunks), len(padded) - 1)  # empty rows behind a text add nothing
                    wanted = cols[at].reshape(len(first), -1)
                    wanted += (xc * items.shape[1]).astype(np.int32)[:, None]
                    good = np.flatnonzero(np.einsum("ij,ij->i", idf[at].reshape(len(first), -1), items.ravel().take(wanted)) >= cover * index.weight[base + xc])
                    for i, k in zip(first[good].tolist(), xc[good].tolist(), strict=True):
                        t = int(owner[i])
                        lo = int(i - begin[t]) * CHUNK
                        yield t, base + k, lo, min(lo + chunks * CHUNK, int(words.sizes[t]))


def hits(index: Index, parts: list, gates: list[Gate], texts: list[str], cosine: float, cover: float, strong: float, weak: float) -> list[list[tuple]]:
    """(id, share) of the items that each text holds."""
    words = Words.of(texts)
    begin = np.cumsum(words.sizes) - words.sizes
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, item, lo, hi in candidates(index, parts, words, cosine, cover):
        spans.setdefault((t, item), []).append((lo, hi))
    for gate in gates:
        for t, item, lo, hi in gate.windows(words, strong, weak):
            spans.setdefault((t, item), []).append((lo, hi))
    out: list[list[tuple]] = [[] for _ in texts]
    for (t, k), windows in spans.items():
        item, best, regions = index.items[k], 0.0, []
        step = max(1, len(item.words) // 4)  # regions begin where the stretches of the whole text do
        for lo, hi in sorted(windows):
            lo, hi = max(0, lo - len(item.words)) // step * step, min(hi + len(item.words), int(words.sizes[t]))
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
        for lo, hi in regions:
            best = max(best, contained(item, words.listed(int(begin[t]) + lo, int(begin[t]) + hi), strong, weak))
        if best:
            out[t].append((item.ident, best))
    return out


RESULT = "contaminated boolean, n_items int, items string, best_share double"


def listed(found: list[tuple]) -> tuple[bool, int, str, float]:
    """The result's columns for the (id, share) of a text's items. Ids are of one type; those without one count as one item."""
    ids = sorted({i for i, _ in found}, key=lambda i: (i is None, *(() if i is None else (i,))))
    return bool(ids), len(ids), ",".join(str(i) for i in ids if i is not None), max((s for _, s in found), default=0.0)


def search(docs: DataFrame, index: Index, text_col: str = "text", cosine: float = 0.65, cover: float = 0.45, strong: float = 0.8, weak: float = 0.6) -> DataFrame:
    """All rows and columns of ``docs`` with contaminated, n_items, items (ids, comma-joined, in order) and best_share, for one block of items."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work() -> Callable[[list[str]], list[tuple]]:
        parts, gates = list(held.value.parts()), held.value.gates()
        return lambda texts: [listed(h) for h in hits(held.value, parts, gates, texts, cosine, cover, strong, weak)]

    return with_text_columns(docs, text_col, RESULT, work, BLOCK)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_col: str = "text", cosine: float = 0.65, cover: float = 0.45, strong: float = 0.8, weak: float = 0.6, items_at_a_time: int = ITEMS_AT_A_TIME) -> DataFrame:
    """All rows and columns of ``docs`` with contaminated, n_items, items and best_share.

    Each text is cut into overlapping windows of 16, 32 and 64 words. A window within ``cosine`` of a benchmark passage in latent
    space is a candidate; so is every window, of a length that follows the passage's, with enough of the passage's words in any
    order for the check to accept it. A candidate is held against the passage word by word: a text is contaminated if a stretch of
    1.5 times the passage's length has ``strong`` of its words in order, or ``weak`` of them and its answer (its last words). What is
    found is just what this check finds in whole texts, passage by passage.

    The benchmark is the query set. It is taken in blocks of about ``items_at_a_time``, one pass over the texts for each, so neither the
    driver nor a task holds more of it.

    Words are lower-cased, and ASCII punctuation doesn't count. Benchmark passages of three and four words must occur as they are; those of
    fewer words, or none, are in too many texts to mean anything and are left out. Those with a null id count like any other, all as
    one item in n_items, but have no id to list in items. A null or empty text is clean, as is every text if the benchmark is empty. Rows
    are handled each for itself, so repeated rows stay. Columns named like the outputs are replaced; no other name clashes with
    any. An empty table gives no rows.
    """
    space = fit(docs, benchmark, item_col, text_col)
    blocks_of = item_blocks(benchmark, id_col, item_col, items_at_a_time)
    first = space.index(next(blocks_of, []))
    second = next(blocks_of, None)
    if second is None:
        return search(docs, first, text_col, cosine, cover, strong, weak)
    # More blocks: each gives the ids that it finds by row, and a row's ids meet at the end
    names = [c for c in docs.columns if c not in ("contaminated", "n_items", "items", "best_share")]
    rows = materialize(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").cast("string").alias("t"), F.monotonically_increasing_id().alias("uid")))
    kind = benchmark.schema[id_col].dataType.simpleString()
    parts = []
    for index in itertools.chain([first, space.index(second)], map(space.index, blocks_of)):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def work(held: Any = held) -> Callable[[list[str]], list[tuple]]:
            parts, gates = list(held.value.parts()), held.value.gates()
            return lambda texts: [([{"id": i, "share": s} for i, s in h],) for h in hits(held.value, parts, gates, texts, cosine, cover, strong, weak)]

        got = with_text_columns(rows.select("uid", "t"), "t", f"h array<struct<id:{kind},share:double>>", work, BLOCK)
        parts.append(materialize(got.where(F.size("h") > 0).select("uid", F.explode("h").alias("h")).select("uid", "h.*")))
        held.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy("uid").agg(
        F.array_sort(F.collect_set("id")).alias("ids"), F.max(F.col("id").isNull().cast("int")).alias("nameless"), F.max("share").alias("share"))
    out = rows.join(found.hint("merge"), "uid", "left")
    n = F.coalesce(F.size("ids") + F.col("nameless"), F.lit(0)).cast("int")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (n > 0).alias("contaminated"), n.alias("n_items"),
                      F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("best_share"))
