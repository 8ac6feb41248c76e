"""Similarity of strings on a scale of 0 to 100, from the published definitions of the indel ratio, its partial and token forms and their weighted best.

Arrow-batched; the string pairs come from blocked or broadcast joins, so each batch is scored where it is made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        matched = row & places.get(c, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common length over the lengths' sum; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_length(a, b) / total


@lru_cache(100_000)
def _letters(s: str) -> Counter:
    return Counter(s)


def _shared(a: str, b: str) -> int:
    """Letters in common, an upper bound of the common length."""
    x, y = _letters(a), _letters(b)
    if len(x) > len(y):
        x, y = y, x
    return sum(n if n < y[c] else y[c] for c, n in x.items() if c in y)


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter string with any window of the longer one, cut windows at both ends included; 0 where that is below `least`."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    if 200.0 * _shared(a, b) / (2 * n) < least and n > 1:
        # Even with all letters in common in one window; cut windows are shorter and have no more of them.
        cut = max((200.0 * k / (n + k) for k in range(1, n) if k <= _shared(a, b)), default=0.0)
        if cut < least:
            return 0.0
    open_letters, shared, bounds = dict(_letters(a)), 0, []
    # Letters in common of the window, kept up to date as it moves: they bound the common subsequence.
    for start in range(1 - n, len(b)):
        end = start + n
        if end <= len(b):
            c = b[end - 1]
            if c in open_letters:
                open_letters[c] -= 1
                shared += open_letters[c] >= 0
        if start > 0:
            c = b[start - 1]
            if c in open_letters:
                open_letters[c] += 1
                shared -= open_letters[c] > 0
        low, high = max(0, start), min(len(b), end)
        bounds.append((200.0 * shared / (n + high - low), low, high))
    best = 0.0
    for bound, low, high in sorted(bounds, reverse=True):
        if bound <= best or bound < least:
            break
        best = max(best, ratio(a, b[low:high]))
    return best if best >= least else 0.0


def _tokens(s: str) -> list[str]:
    return sorted(s.split())


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(_tokens(a)), " ".join(_tokens(b)))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among common words, common words with the rest of either side, and the two sides; 100 where one side's words are in the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    common = " ".join(both)
    full_x, full_y = " ".join(filter(None, [common, " ".join(only_x)])), " ".join(filter(None, [common, " ".join(only_y)]))
    best = ratio(full_x, full_y)
    return max(best, ratio(common, full_x), ratio(common, full_y)) if common else best


def partial_token_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The better partial ratio of sorted words and of words not in common; 100 where a word is common."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    # Without common words both forms differ at most in repeated words.
    whole = partial_ratio(" ".join(_tokens(a)), " ".join(_tokens(b)), least)
    return whole if len(x) == len(a.split()) and len(y) == len(b.split()) else max(whole, partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)), least))


@lru_cache(200_000)
def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best of the plain, token and, for strings of unequal length, partial ratios, each with its weight; 0 where a string is empty or the result is below `least`."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    # No plain ratio can exceed what the letters in common allow.
    most = 200.0 * _shared(a, b) / (len(a) + len(b))
    best = ratio(a, b) if most >= least else 0.0
    if lengths < 1.5:
        if best < 95.0:
            # A set ratio of common words alone needs a common word; the others are bounded like the plain ratio.
            if most >= least - 10 or set(a.split()) & set(b.split()):
                best = max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
        return best if best >= least else 0.0
    scale = 0.9 if lengths <= 8 else 0.6
    best = max(best, scale * partial_ratio(a, b, least / scale))
    if 95.0 * scale > max(best, least):
        best = max(best, 0.95 * scale * partial_token_ratio(a, b, least / (0.95 * scale)))
    return best if best >= least else 0.0


def _column(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


weighted_ratio_of = _column(weighted_ratio)


def weighted_ratio_from(least: float):
    """As `weighted_ratio_of`, 0 below `least`, which saves most of the work."""
    return _column(partial(weighted_ratio, least=least))


token_set_ratio_of = _column(token_set_ratio)
ratio_of = _column(ratio)


#: Labels that one task compares with at a time; a larger list is met in blocks of that size.
BLOCK_LABELS = 20_000


class Labels:
    """A block of labels whose weighted ratio with a text can be bounded for all at once: no plain or token ratio exceeds what the letters in common allow, no partial
    one what the letters of the shorter side allow, and only labels with a word in common reach further."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.letters = {c: i for i, c in enumerate(sorted({c for x in labels for c in x}))}
        self.counts = np.array([self._counts(x) for x in labels], np.int16).reshape(len(labels), len(self.letters))
        self.sizes = np.array([len(x) for x in labels], np.float64)
        self.words: dict[str, list[int]] = {}
        for i, x in enumerate(labels):
            for w in set(x.split()):
                self.words.setdefault(w, []).append(i)

    def _counts(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.letters), np.int16)
        for c, n in Counter(text).items():
            if c in self.letters:
                out[self.letters[c]] = min(n, 32_000)
        return out

    def near(self, text: str, least: float) -> list[tuple[str, float]]:
        """Labels with at least `least` points, and these."""
        if not text or not self.labels:
            return []
        shared = np.minimum(self.counts, self._counts(text)).sum(axis=1).astype(np.float64)
        small, large = np.minimum(self.sizes, len(text)), np.maximum(self.sizes, len(text))
        plain = 200 * shared / (self.sizes + len(text))
        # A window of a partial ratio is at most as long as the shorter side; the best of cut windows has no letter beside those in common.
        part = np.where(large >= 1.5 * small, np.where(large <= 8 * small, 90.0, 60.0) * 2 * shared / (small + np.minimum(shared, small)), 0.0)
        wanted = (plain >= least) | (part >= least)
        wanted[[i for w in set(text.split()) for i in self.words.get(w, ())]] = True
        found = ((self.labels[i], weighted_ratio(text, self.labels[i], least)) for i in np.nonzero(wanted & (self.sizes > 0))[0])
        return [(label, points) for label, points in found if points >= least]


def near_labels(texts: DataFrame, labels: DataFrame, least: float, block: int = BLOCK_LABELS) -> DataFrame:
    """(text, label, points): the labels whose weighted ratio with a text is at least `least`. Both sides are distinct strings (`text`, `label`); the labels are a bounded
    vocabulary, broadcast in blocks of about `block`; each text meets each block once, and only labels that can reach `least` are scored."""
    spark, schema = texts.sparkSession, "text string, label string, points double"
    n = max(1, -(-labels.count() // block))
    packed = labels.filter(F.col("label").isNotNull()).groupBy(F.pmod(F.xxhash64("label"), F.lit(n)).alias("_block")).agg(F.array_sort(F.collect_set("label")).alias("_labels"))
    # Few texts may mean much scoring: they are dealt out first.
    slots = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    asked = texts.filter(F.col("text").isNotNull()).select("text").repartition(slots, "text")
    out = None
    for r in packed.toLocalIterator():
        sent = spark.sparkContext.broadcast([str(x) for x in r["_labels"]])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ready = Labels(sent.value)
            for pdf in batches:
                yield pd.DataFrame([(t, label, points) for t in pdf["text"] for label, points in ready.near(t, least)], columns=["text", "label", "points"])

        part = asked.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
