"""Language identification with bit-sliced Bloom filters: one lookup gives the languages that contain an n-gram."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, with_text_columns

UNKNOWN = "und"
_GOLDEN = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of all texts, and the text each belongs to.

    Texts are lower-cased; what is no letter reads as a space. A trigram has a letter in its middle, and spaces mark word ends.
    """
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low])
    chars = np.frombuffer((" " + " ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[chars]
    chars = np.where(letter, chars, 32).astype(np.uint64)
    middle = np.flatnonzero(letter[1:-1])
    codes = chars[middle] << np.uint64(42) | chars[middle + 1] << np.uint64(21) | chars[middle + 2]
    return codes, np.searchsorted(np.cumsum(sizes), middle, side="right")


def slots(codes: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    """The places of each code in a filter of ``size`` slots, a power of two."""
    shift = np.uint64(64 - int(size).bit_length() + 1)
    mixed = codes ^ (codes >> np.uint64(29))
    return [((mixed * np.uint64(g)) ^ ((mixed * np.uint64(g)) >> np.uint64(32))) * np.uint64(g) >> shift for g in _GOLDEN[:hashes]]


class Filter:
    """Bloom filters of many languages in one table: slot by 64-language words, a bit for each language."""

    def __init__(self, langs: list[str], codes: np.ndarray, lang_of: np.ndarray, slots_per_gram: int = 16, hashes: int = 3) -> None:
        self.langs, self.hashes = langs, hashes
        self.size = 1 << max(10, int(max(1, len(np.unique(codes))) * slots_per_gram - 1).bit_length())
        self.table = np.zeros((self.size, max(1, -(-len(langs) // 64))), dtype=np.uint64)
        for at in slots(codes, self.size, hashes):
            for i in range(len(langs)):
                mine = lang_of == i
                np.bitwise_or.at(self.table[:, i // 64], at[mine].astype(np.int64), np.uint64(1 << (i % 64)))
        fill = np.array([np.count_nonzero(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / self.size for i in range(len(langs))])
        self.false = fill**hashes  # the chance that a gram no filter holds is found in a language

    def counts(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each of ``n`` texts, and how many of them each language holds, corrected for false positives."""
        total = np.bincount(owner, minlength=n).astype(float)
        at = [a.astype(np.int64) for a in slots(codes, self.size, self.hashes)]
        found = np.zeros((n, len(self.langs)))
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            mask = column[at[0]]
            for a in at[1:]:
                mask &= column[a]
            for i in range(64 * w, min(len(self.langs), 64 * w + 64)):
                found[:, i] = np.bincount(owner[(mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=n)
        return total, np.clip((found - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.99)), 0, None)

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score, the share of the text's grams that the language holds; on a tie the first by code point."""
        codes, owner = grams(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, found = self.counts(codes, owner, len(texts))
        best = found.argmax(axis=1)
        score = np.clip(found[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], [float(s) if n else 0.0 for s, n in zip(score, total, strict=True)]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ratio: float = 0.4, floor: float = 1e-5) -> Filter:
    """Fit the filters on all rows with a language.

    A trigram enters a language's filter if its share among that language's trigrams is at least ``floor`` and at least ``ratio``
    times its largest share in any language. ``floor`` bounds a language's filter at 1 / floor trigrams, whatever the corpus's size.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            codes, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for rows, texts in blocks(batches, "t"):
            by: dict[str, list[str]] = {}
            for r, t in zip(rows, texts, strict=True):
                by.setdefault(r["lang"], []).append(t)
            for lang, mine in by.items():
                codes, n = np.unique(grams(mine)[0], return_counts=True)
                held.setdefault(lang, []).append((codes, n))
                if len(held[lang]) >= 16:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > 1 << 20:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    chosen = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).where("lang is not null")
    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # One row for each language and gram: pair each with its language's total and its largest share
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= floor)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    kept = shares.join(top, "gram").where(F.col("share") >= ratio * F.col("top")).groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).orderBy("lang").collect()
    langs = [r["lang"] for r in kept]
    grams_of = [np.array(r["grams"], dtype=np.int64).view(np.uint64) for r in kept]
    none = np.zeros(0, dtype=np.uint64)
    model = Filter(langs, np.concatenate([none, *grams_of]), np.repeat(np.arange(len(langs)), [len(g) for g in grams_of]))
    give_back()
    return model


def predict(docs: DataFrame, model: Filter, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the language and its score.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned. Of languages that hold as
    many of a text's trigrams, the first by code point is given. Repeated rows each get their result. Columns named like the outputs are
    replaced; no other name clashes with any. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages / floor

    def work() -> Callable[[list[str]], list[tuple]]:
        return lambda texts: list(zip(*held.value.decide(texts), strict=True))

    return with_text_columns(docs, text_col, f"`{lang_out}` string, `{score_out}` double", work)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text has this remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")), F.lit(modulus)) == remainder
