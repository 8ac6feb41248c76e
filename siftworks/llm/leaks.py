"""Evaluation items held by documents, wholly or in part.

1. One Aho-Corasick automaton holds the sentences of all items and every run of RUN words of their texts. One scan passes each document's folded text through it
   once. A document with hits leaves a narrow row: the item sentences it holds, a sketch of the text around them, and the stretches of its text around dense
   hits with their offsets. Texts are read once and never moved.
2. Sentences that many documents share are no item text. They are settled on the narrow rows: a sentence is shared if enough texts hold it (copies and near copies of
   a text counted once) and a second sign says that it isn't the item's own. `excluded` reports them.
3. The kept stretches are aligned with the items, shared sentences out on both sides. Any stretch within the error rate keeps a run of RUN words; from every such
   block the alignment is extended to both sides with furthest-reaching diagonals (a banded edit distance), which finds the longest
   stretch that holds a whole block (of all stretches that an exhaustive alignment accepts, 0.98 in the tests' random cases, which lie near the limit).

Both sides are folded to one skeleton (case, accents, look-alikes, invisible characters, markup gone); offsets lead back to the original text.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.llm.textform import _TO_LATIN, IGNORABLE, LOOK_ALIKE_MARKS
from siftworks.session import cut

#: Words of a stretch at least, words per error, and errors granted beyond that ("about one word in six").
LEAST_WORDS, WORDS_PER_ERROR, SLACK = 20, 6, 0.25
#: Words of the runs that the automaton looks for. A stretch of 20 words or more within the error rate keeps an unchanged run of 4.
RUN = 4
#: Hits of runs that make a candidate: a stretch of L words with E errors has at least L - E - (RUN - 1) * (E + 1), which is 4 or more from 20 words on.
LEAST_HITS = 4
#: Errors beyond what the words so far allow at which an alignment isn't followed further.
DROP = 3
#: A sentence can be shared from this part of all distinct texts, and this number of them, on (parameters of `scan`).
SHARED_PART, SHARED_TEXTS = 0.01, 4
#: Bands of least hashes of a text's word pairs, and hashes per band: near copies, with about 0.7 of their word pairs in common, agree in a band.
BANDS, BAND_HASHES = 6, 5
#: Bytes of a pickled automaton that are broadcast; item sets beyond that are halved and scanned for one after the other.
BROADCAST_BYTES = 128 << 20


class _Fold(dict):
    """Code point -> its folded text, worked out on first use."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        flat = IGNORABLE.sub("", unicodedata.normalize("NFKD", char))
        flat = "".join(LOOK_ALIKE_MARKS.get(c, c) for c in flat if not unicodedata.combining(c)).translate(_TO_LATIN)
        self[code] = out = unicodedata.normalize("NFKC", flat.casefold())
        return out


class _Blank(dict):
    """Code point -> its folded text with a blank for whatever is neither part of a word nor of markup."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(c if c.isalnum() or c in _MARKUP else " " for c in _FOLD[code])
        return out


_MARKUP = "<>*`/!"
_FOLD, _BLANK = _Fold(), _Blank()
_WORD = re.compile(r"[^\W_]+(?:(?:\*\*|`)[^\W_]+)*")
_TAG = re.compile(r"<[/!]?[a-z][^<>]{0,200}>")
_MARK = re.compile(r"\*\*|`")
_INNER_MARK = re.compile(r"(?<=[^\W_])(?:\*\*|`)(?=[^\W_])")
_NO_MARKUP = str.maketrans(dict.fromkeys(_MARKUP, " "))


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Folded words and their spans in the folded text; tags are no words, emphasis marks inside a word vanish."""
    folded = fold(text)
    if "<" in folded:
        folded = _TAG.sub(lambda m: " " * len(m[0]), folded)
    found = list(_WORD.finditer(folded))
    marked = "*" in folded or "`" in folded
    return [_MARK.sub("", m[0]) if marked else m[0] for m in found], [m.span() for m in found]


def _word_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in the folded text of ranges of words, in order and apart from each other."""
    folded = fold(text)
    if "<" in folded:
        folded = _TAG.sub(lambda m: " " * len(m[0]), folded)
    found, at, out = _WORD.finditer(folded), 0, []
    for a, b in ranges:
        first = next(islice(found, a - at, None))
        last = first if b == a + 1 else next(islice(found, b - a - 2, None))
        at = b
        out.append((first.start(), last.end()))
    return out


def between_blanks(text: str) -> str:
    """The words of `words`, each between single blanks, without a step per word."""
    flat = text.translate(_BLANK)
    if "<" in flat:
        flat = _TAG.sub(" ", flat)
    if "*" in flat or "`" in flat:
        flat = _INNER_MARK.sub("", flat)
    return f" {' '.join(flat.translate(_NO_MARKUP).split())} "


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets in `text` of spans of its folded text: only characters whose folded form isn't one character shift them."""
    odd = "" if text.isascii() else "".join(c for c in set(text) if len(_FOLD[ord(c)]) != 1)
    if not odd:
        return spans
    places, ends, shifts = [], [], [0]
    for m in re.finditer(f"[{re.escape(odd)}]", text):
        shifts.append(shifts[-1] + len(_FOLD[ord(m[0])]) - 1)
        places.append(m.start())
        ends.append(m.end() + shifts[-1])

    def reached(end: int) -> int:
        """The first character whose folded form ends at `end` or beyond."""
        k = bisect_left(ends, end)
        plain = max(end - 1 - shifts[k], places[k - 1] + 1 if k else 0)
        return min(plain, places[k]) if k < len(places) else plain

    return [(reached(a + 1), reached(b) + 1) for a, b in spans]


def sentences(text: str) -> list[str]:
    """Folded sentences of an item with at least RUN words, as words joined by blanks."""
    found = (words(s)[0] for s in re.split(r"(?<=[.?!;])\s+|\n+", text))
    return list(dict.fromkeys(" ".join(s) for s in found if len(s) >= RUN))


_PRIME = (1 << 31) - 1
_FACTORS, _OFFSETS = np.random.default_rng(6).integers(1, _PRIME, (2, BANDS * BAND_HASHES, 1), dtype=np.uint64)


def bands(tokens: list[str]) -> list[int]:
    """One number per band; texts that agree in one are near copies."""
    pairs = {f"{a} {b}" for a, b in zip(tokens, tokens[1:])} or set(tokens) or {""}
    hashes = np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) % _PRIME for p in pairs), np.uint64, len(pairs))
    least = np.full(BANDS * BAND_HASHES, _PRIME, np.uint64)
    for at in range(0, len(hashes), 10_000):
        least = np.minimum(least, ((_FACTORS * hashes[at : at + 10_000] + _OFFSETS) % _PRIME).min(axis=1))
    digests = (least[i : i + BAND_HASHES].tobytes() for i in range(0, len(least), BAND_HASHES))
    return [zlib.crc32(d) << 31 | zlib.adler32(d) & _PRIME for d in digests]


def spared(tokens: list, gone: list[tuple[int, int]]) -> list:
    """`tokens` without the ranges `gone`."""
    out = {i for a, b in gone for i in range(a, b)}
    return [t for i, t in enumerate(tokens) if i not in out] if out else tokens


class Items:
    """Item texts, made ready once on the driver and broadcast: words, sentences, and the one automaton over sentences and runs."""

    def __init__(self, listed: list[tuple[object, str]]):
        by_text: dict[tuple[str, ...], list] = {}
        sentence_lists = {}
        for key, text in listed:
            by_text.setdefault(t := tuple(words(text)[0]), []).append(key)
            sentence_lists.setdefault(t, sentences(text))
        by_text.pop((), None)
        self.keys = list(by_text.values())
        self.tokens = [list(t) for t in by_text]
        self.texts = list(dict.fromkeys(s for t in by_text for s in sentence_lists[t]))
        self.sizes = [s.count(" ") + 1 for s in self.texts]
        number = {s: i for i, s in enumerate(self.texts)}
        self.numbers = [frozenset(number[s] for s in sentence_lists[t]) for t in by_text]
        self.held_by: list[list[int]] = [[] for _ in self.texts]
        for j, held in enumerate(self.numbers):
            for i in held:
                self.held_by[i].append(j)
        self.occurrences = [[(i, at, at + self.sizes[i]) for i in held for at in self._places(t, self.texts[i].split())] for t, held in zip(self.tokens, self.numbers)]
        self.totals = [len(t) for t in self.tokens]
        #: Sentences that stand in unlike items, set where the items are made ready.
        self.unlike: frozenset[str] = frozenset()
        # Run -> [(item, whether one hit is enough)]: of short sentences and items, which may be all that is left of an item.
        runs: dict[str, dict[int, bool]] = {}
        for j, tokens in enumerate(self.tokens):
            n = min(RUN, len(tokens))
            tight = [(0, len(tokens))] if len(tokens) < RUN + LEAST_HITS - 1 else [(a, b) for _, a, b in self.occurrences[j] if b - a < RUN + LEAST_HITS - 1]
            for i in range(len(tokens) - n + 1):
                alone = any(a <= i and i + n <= b for a, b in tight)
                held = runs.setdefault(" ".join(tokens[i : i + n]), {})
                held[j] = held.get(j, False) or alone
            # Words that become neighbours where a shared sentence between them is taken out.
            for _, a, b in self.occurrences[j]:
                for back in range(1, RUN):
                    if a >= back and b + RUN - back <= len(tokens):
                        runs.setdefault(" ".join(tokens[a - back : a] + tokens[b : b + RUN - back]), {}).setdefault(j, False)
        self.runs = [list(x.items()) for x in runs.values()]
        self.automaton = ahocorasick.Automaton()
        for n, run in enumerate(runs):
            self.automaton.add_word(f" {run} ", (n, number.get(run, -1)))
        for i, s in enumerate(self.texts):
            if s not in runs:
                self.automaton.add_word(f" {s} ", (-1, i))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _places(tokens: list[str], sentence: list[str]) -> list[int]:
        n = len(sentence)
        return [i for i in range(len(tokens) - n + 1) if tokens[i : i + n] == sentence]

    def in_unlike_items(self, i: int) -> bool:
        """Whether sentence i stands in two items that have less than half of their other words in common."""
        first, *others = self.held_by[i]
        n = self.sizes[i]
        return any(2 * (sum(self.sizes[k] for k in self.numbers[first] & self.numbers[j]) - n) < min(self.totals[first], self.totals[j]) - n for j in others)

    def beside_the_item(self, held: set[int]) -> dict[int, bool]:
        """Sentence -> whether a document with the sentences `held` has it without a third of the other words of any item. A sentence that makes up more than half of
        an item is what that item asks, so it's no evidence where it stands alone."""
        words_of: dict[int, int] = {}
        for i in held:
            for j in self.held_by[i]:
                words_of[j] = words_of.get(j, 0) + self.sizes[i]

        def beside(i: int) -> bool:
            n = self.sizes[i]
            of = [j for j in self.held_by[i] if 2 * n <= self.totals[j]]
            return bool(of) and not any(3 * (words_of[j] - n) >= self.totals[j] - n for j in of)

        return {i: beside(i) for i in held}

    def look(self, text: str) -> tuple[dict[int, bool], list[int], list[tuple[int, str, list[tuple[int, int, int]]]]] | None:
        """What the scan keeps of a document: {item sentence held: beside_the_item}, the bands of the rest of its text, and (offset, text, sentences) of the
        stretches with dense hits, sentences as (number, first word, last word + 1) within the stretch. None without any."""
        if not len(self.automaton):
            return None
        joined = between_blanks(text)
        n, at = 0, 1
        held: list[tuple[int, int, int]] = []
        places: dict[int, list[tuple[int, bool]]] = {}
        for end, (run, sentence) in self.automaton.iter(joined):
            n += joined.count(" ", at, end + 1)
            at = end + 1
            if sentence >= 0:
                held.append((sentence, n - self.sizes[sentence], n))
            if run >= 0:
                for item, alone in self.runs[run]:
                    places.setdefault(item, []).append((n, alone))
        n += joined.count(" ", at)
        regions = self._regions(places, held, n)
        if not held and not regions:
            return None
        out = []
        if regions:
            for (low, high), (start, end) in zip(regions, original_spans(text, _word_spans(text, regions))):
                out.append((start, text[start:end], [(i, a - low, b - low) for i, a, b in held if low <= a and b <= high]))
        numbers = {i for i, _, _ in held}
        return self.beside_the_item(numbers), bands(spared(joined.split(), [(a, b) for _, a, b in held])) if held else [], out

    def _regions(self, places: dict[int, list[tuple[int, bool]]], held: list[tuple[int, int, int]], n_words: int) -> list[tuple[int, int]]:
        """Word ranges around dense hits of an item. Words of item sentences don't count as distance, for they may be taken out."""
        covered: list[int] = []
        for _, a, b in sorted(held, key=lambda x: x[1]):
            covered += range(max(a, covered[-1] + 1 if covered else a), b)
        found = []
        for item, hits in places.items():
            if len(hits) < LEAST_HITS and not any(alone for _, alone in hits):
                continue
            size = len(self.tokens[item])
            errors = size // WORDS_PER_ERROR + 2
            reach, near = size + errors + RUN, LEAST_WORDS + 2 * WORDS_PER_ERROR
            ends = [e for e, _ in hits]
            own = [e - bisect_left(covered, e) for e in ends] if covered else ends
            for k, (_, alone) in enumerate(hits):
                if alone:
                    found.append((ends[k] - reach, ends[k] + reach))
                elif k + LEAST_HITS <= len(hits) and own[k + LEAST_HITS - 1] - own[k] <= near:
                    found.append((ends[k] - reach, ends[k + LEAST_HITS - 1] + reach))
        out: list[tuple[int, int]] = []
        for low, high in sorted(found):
            low, high = max(0, low), min(n_words, high)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return out


def _reach(item: list[str], doc: list[str], i: int, j: int, step: int, most: int, gained: int) -> list[tuple[int, int, int]]:
    """(errors, item words, doc words) of the farthest alignments that go from item[i], doc[j] on in the direction of `step` and end on equal words, for ever more
    errors up to `most`; those that get no farther than with fewer errors are left out. Ends where the errors exceed what the words so far, `gained` before
    them included, allow by more than DROP."""
    n, m = (len(item) - i, len(doc) - j) if step > 0 else (i + 1, j + 1)
    x = 0
    while x < n and x < m and item[i + step * x] == doc[j + step * x]:
        x += 1
    out, far, front = [(0, x, x)] if x else [], x, [x]
    for errors in range(1, most + 1):
        if far >= n or errors > (gained + far) / WORDS_PER_ERROR + SLACK + DROP:
            break
        # front[k] is the farthest item word on diagonal k - errors: replaced, dropped and added word. -1 where there is none.
        old = [-1, -1, *front, -1, -1]
        front = []
        for k in range(2 * errors + 1):
            d = k - errors
            x = min(n, m - d, max(old[k + 1] + 1 if old[k + 1] >= 0 else -1, old[k + 2] + 1 if old[k + 2] >= 0 else -1, old[k]))
            if x + d < 0:
                x = -1
            if x >= 0:
                began = x
                while x < n and x + d < m and item[i + step * x] == doc[j + step * (x + d)]:
                    x += 1
                if x > far and x > began:
                    far = x
                    best = (errors, x, x + d)
            front.append(x)
        if far > (out[-1][1] if out else 0):
            out.append(best)
    return out


def longest_stretch(item: list[str], doc: list[str], blocks: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | None:
    """(item words, errors, first doc word, last doc word + 1) of the longest stretch of the item aligned with the document at the error rate allowed, among those
    that hold one of the blocks (first item word, first doc word, words) of equal words, longest first. The two sides of a block are independent; blocks inside the
    best stretch so far aren't extended again."""
    most = int(len(item) / WORDS_PER_ERROR + SLACK + 1e-9)
    best = None
    for q, p, n in blocks:
        if best and best[2] <= p and p + n <= best[3]:
            continue
        after = [(0, 0, 0), *_reach(item, doc, q + n, p + n, 1, most, n)]
        before = [(0, 0, 0), *_reach(item, doc, q - 1, p - 1, -1, most, n + after[-1][1])]
        for e1, w1, d1 in before:
            for e2, w2, d2 in after:
                size, errors = n + w1 + w2, e1 + e2
                if errors <= size / WORDS_PER_ERROR + SLACK + 1e-9 and (best is None or (size, -errors) > (best[0], -best[1])):
                    best = (size, errors, p - d1, p + n + d2)
        if best and best[0] == len(item):
            break
    return best


def _within_reach(own: list[str], there: set[str]) -> bool:
    """Whether some LEAST_WORDS words in a row of an item are there but for the errors that a stretch may have in them, whatever their order."""
    n = min(LEAST_WORDS, len(own))
    missing = [t not in there for t in own]
    most, now = n // WORDS_PER_ERROR + 2, sum(missing[:n])
    if now <= most:
        return True
    for i in range(n, len(own)):
        now += missing[i] - missing[i - n]
        if now <= most:
            return True
    return False


class Verifier:
    """Items without shared sentences against the stretches kept by the scan."""

    def __init__(self, items: Items, shared: frozenset[int]):
        self.items, self.shared = items, shared
        self.own = [spared(t, [(a, b) for i, a, b in o if i in shared]) for t, o in zip(items.tokens, items.occurrences)]
        self.runs: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for j, own in enumerate(self.own):
            n = min(RUN, len(own))
            for q in range(len(own) - n + 1 if n else 0):
                self.runs.setdefault(tuple(own[q : q + n]), []).append((j, q))
        self.short = sorted({len(r) for r in self.runs})

    def find(self, offset: int, text: str, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(item, words, errors, start, end) of every item the stretch of text holds; start and end are offsets in the document."""
        tokens, spans = words(text)
        gone = [(a, b) for i, a, b in held if i in self.shared]
        tokens, spans = spared(tokens, gone), spared(spans, gone)
        hits: dict[int, dict[tuple[int, int], None]] = {}
        for n in self.short:
            for p in range(len(tokens) - n + 1):
                for j, q in self.runs.get(tuple(tokens[p : p + n]), ()):
                    hits.setdefault(j, {})[q, p] = None
        found = []
        for j, at in hits.items():
            own = self.own[j]
            run = min(RUN, len(own))
            if len(at) < min(LEAST_HITS, len(own) - run + 1):
                continue
            # Hits that follow each other on one diagonal make a block of equal words.
            blocks = []
            for q, p in at:
                if (q - 1, p - 1) not in at:
                    n = 1
                    while (q + n, p + n) in at:
                        n += 1
                    n += run - 1
                    # A block of a stretch lies in LEAST_WORDS words of it with few errors, or another block does.
                    if n >= LEAST_WORDS or _within_reach(own[max(0, q + n - LEAST_WORDS) : q + LEAST_WORDS], set(tokens[max(0, p + n - LEAST_WORDS - RUN) : p + LEAST_WORDS + RUN])):
                        blocks.append((q, p, n))
            blocks.sort(key=lambda b: -b[2])
            got = longest_stretch(own, tokens, blocks)
            if got and got[0] >= min(LEAST_WORDS, len(own)):
                found.append((j, *got))
        places = original_spans(text, [(spans[a][0], spans[b - 1][1]) for _, _, _, a, b in found])
        return [(j, n, e, offset + a, offset + b) for (j, n, e, _, _), (a, b) in zip(found, places)]


_HELD = pa.list_(pa.struct([("sentence", pa.int32()), ("beside", pa.bool_())]))
_REGIONS = pa.list_(pa.struct([("start_at", pa.int32()), ("text", pa.string()), ("held", pa.list_(pa.struct([("sentence", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])))]))
_SCAN = "digest long, held array<struct<sentence:int,beside:boolean>>, bands array<long>, regions array<struct<start_at:int,text:string,held:array<struct<sentence:int,low:int,high:int>>>>"


def _ready(spark: SparkSession, listed: list[tuple[object, str]], limit: int, whole: Items | None = None) -> list[tuple[Items, object]]:
    """The items and their broadcast, in as many parts as the size bound asks for; sentences know all items they stand in whatever the parts."""
    items = Items(listed)
    whole = whole or items
    if len(listed) > 1 and len(pickle.dumps(items)) > limit:
        half = len(listed) // 2
        return _ready(spark, listed[:half], limit, whole) + _ready(spark, listed[half:], limit, whole)
    items.unlike = frozenset(s for i, s in enumerate(whole.texts) if whole.in_unlike_items(i))
    return [(items, spark.sparkContext.broadcast(items))]


def _scan(texts: DataFrame, ready: object) -> DataFrame:
    """(doc_id, digest, held, bands, regions) of every document: the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready.value
        for batch in batches:
            held, sketch, regions = [], [], []
            for text in batch.column(1).to_pylist():
                found = items.look(text)
                held.append([{"sentence": i, "beside": b} for i, b in found[0].items()] if found and found[0] else None)
                sketch.append(found[1] if found and found[0] else None)
                regions.append([{"start_at": at, "text": t, "held": [dict(zip(("sentence", "low", "high"), s)) for s in inner]} for at, t, inner in found[2]] if found and found[2] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, _HELD), pa.array(sketch, pa.list_(pa.int64())), pa.array(regions, _REGIONS)], names=["doc_id", "digest", "held", "bands", "regions"])

    return texts.select("doc_id", "text", "digest").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_SCAN}")


def _merged(seen: DataFrame) -> DataFrame:
    """(sentence, beside) once per group of near copies: the least label over all shared bands, twice. A chain of near copies longer than that counts as several."""
    rows = cut(seen.withColumn("row", F.xxhash64("bands")))
    each = rows.select("sentence", "row", F.posexplode("bands").alias("band", "value"))
    labels = rows.select("sentence", "row", F.col("row").alias("label"))
    for _ in range(2):
        least = each.join(labels, ["sentence", "row"]).groupBy("sentence", "band", "value").agg(F.min("label").alias("least"))
        labels = cut(each.join(least, ["sentence", "band", "value"]).groupBy("sentence", "row").agg(F.min("least").alias("label")))
    return rows.join(labels, ["sentence", "row"]).groupBy("sentence", "label").agg(F.max("beside").alias("beside"))


class Shared(NamedTuple):
    sentence: int
    n_texts: int
    n_beside: int
    unlike: bool


def shared_sentences(scanned: DataFrame, items: Items, limit: float) -> list[Shared]:
    """The item sentences that at least `limit` texts hold, copies and near copies merged, and that show a second sign: they stand in unlike items, or `limit` of the
    texts hold them without the rest of the item. Counted over every document; at most one row per item sentence comes to the driver."""
    each = scanned.filter(F.col("held").isNotNull()).select("bands", F.explode("held").alias("h")).select("bands", "h.sentence", "h.beside")
    # Copies of a text become one here.
    seen = each.groupBy("sentence", "bands").agg(F.max("beside").alias("beside"))
    often = [r[0] for r in seen.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).collect()]
    if not often:
        return []
    counted = _merged(seen.filter(F.col("sentence").isin(often))).groupBy("sentence").agg(F.count(F.lit(1)).alias("n"), F.count_if("beside").alias("beside"))
    rows = [Shared(r["sentence"], r["n"], r["beside"], items.texts[r["sentence"]] in items.unlike) for r in counted.filter(F.col("n") >= limit).collect()]
    return [r for r in rows if r.unlike or r.n_beside >= limit]


FOUND = "doc_id {0}, item_id {1}, words int, errors int, start_at int, end_at int"
EXCLUDED = "item_id {0}, sentence string, n_texts long, n_without_item long, in_unlike_items boolean, words_left int"


class Leaks(NamedTuple):
    found: DataFrame
    excluded: DataFrame


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "item_text", shared_part: float = SHARED_PART, shared_texts: int = SHARED_TEXTS, broadcast_bytes: int = BROADCAST_BYTES) -> Leaks:
    """`found` (doc_id, item_id, words, errors, start_at, end_at): every document that holds an item's text or a stretch of at least LEAST_WORDS of its words
    in order, with at most about one word in WORDS_PER_ERROR replaced, dropped or added; the longest stretch, and its offsets in the document.
    `excluded` (item_id, sentence, n_texts, n_without_item, in_unlike_items, words_left): the item sentences that count as shared and why, and how many words of the item are
    still looked for; 0 means that nothing of the item is.

    A sentence is shared where at least `shared_part` of all distinct texts, and `shared_texts`, hold it, near copies counted once, and it stands in unlike items too, or
    so many of the texts hold less than a third of the rest of the item. It is never shared by the second sign where it makes up more than half of the item.

    An item shorter than LEAST_WORDS is held as a whole only. NULL and empty texts hold nothing and NULL or empty items are held by nothing; repeated rows give the
    same row once, several ids of one item text a row each; empty tables give no rows; other columns, whatever their names, aren't read. Whole texts of any length are
    scanned. Items are a bounded test set: read on the driver and broadcast in parts of at most `broadcast_bytes`.
    """
    spark = docs.sparkSession
    id_type, key_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema, report = FOUND.format(id_type, key_type), EXCLUDED.format(key_type)
    listed = [(r[0], r[1]) for r in items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).distinct().orderBy(item_id, item_text).toLocalIterator()]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("digest")).filter(F.col("text").isNotNull())
    parts, shared = [], {}
    for ready, sent in _ready(spark, listed, broadcast_bytes) if listed else []:
        scanned = cut(_scan(texts, sent))
        n_texts = scanned.agg(F.count_distinct("digest")).first()[0]
        shared |= {ready.texts[s.sentence]: s for s in shared_sentences(scanned, ready, max(shared_texts, shared_part * n_texts))}
        parts.append((ready, sent, scanned))
    found, excluded = None, []
    for ready, sent, scanned in parts:
        numbers = frozenset(i for i, s in enumerate(ready.texts) if s in shared)
        left = [len(spared(t, [(a, b) for i, a, b in o if i in numbers])) for t, o in zip(ready.tokens, ready.occurrences)]
        excluded += [(key, ready.texts[i], *shared[ready.texts[i]][1:], left[j]) for i in numbers for j in ready.held_by[i] for key in ready.keys[j]]
        part = _verified(scanned, sent, numbers, schema)
        found = part if found is None else found.unionByName(part)
    if found is not None:
        # The longest stretch per document and item, whichever of its regions or rows it came from.
        best = F.max_by(F.struct("words", "errors", "start_at", "end_at"), F.struct("words", -F.col("errors"), -F.col("start_at"))).alias("b")
        found = found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
    return Leaks(spark.createDataFrame([], schema) if found is None else found, spark.createDataFrame(excluded, report))


def _verified(scanned: DataFrame, ready: object, shared: frozenset[int], schema: str) -> DataFrame:
    key_type = T.StructType.fromDDL(schema)["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        verifier, arrow_key = Verifier(ready.value, shared), to_arrow_type(key_type)
        for batch in batches:
            docs, rows = [], []
            for k, r in enumerate(batch.column(1).to_pylist()):
                for j, *rest in verifier.find(r["start_at"], r["text"], [(h["sentence"], h["low"], h["high"]) for h in r["held"]]):
                    for key in verifier.items.keys[j]:
                        docs.append(k)
                        rows.append((key, *rest))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int32())), pa.array(columns[0], arrow_key), *[pa.array(c, pa.int32()) for c in columns[1:]]], names=["doc_id", "item_id", "words", "errors", "start_at", "end_at"])

    return scanned.filter(F.col("regions").isNotNull()).select("doc_id", F.explode("regions").alias("region")).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The `found` frame of `scan`."""
    return scan(docs, items, **options).found
