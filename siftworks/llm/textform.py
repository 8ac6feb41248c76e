"""Text that looks alike, brought to one form.

Compatibility decomposition, removal of default-ignorable characters, look-alike letters resolved word by word, whitespace mapped,
full case folding and composition. The script of a word is that of its letters that look like no other script's; a word of look-alikes only
is Latin. So the form of a word depends on nothing but its appearance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from hashlib import blake2b
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.session import cut

#: Letters of one shape. Each entry is Latin, Cyrillic, Greek; `-` where a script has none.
LOOK_ALIKES = """
AАΑ BВΒ CС- EЕΕ HНΗ IІΙ JЈ- KКΚ MМΜ N-Ν OОΟ PРΡ SЅ- TТΤ XХΧ YҮΥ Z-Ζ
aа- cс- eе- iі- jј- oоο pр- sѕ- xх- yу- v-ν hһ- dԁ- qԛ- wԝ-
"""
#: Marks of one shape, and Latin letters of another block with a plain letter's shape.
LOOK_ALIKE_MARKS = {"‐": "-", "‑": "-", "‒": "-", "⁃": "-", "﹘": "-", "−": "-", ";": ";", "ʹ": "'", "ɡ": "g", "ɑ": "a", "Ӏ": "I", "ӏ": "l"}
#: Default-ignorable code points, as ranges.
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_BLANK = re.compile(r"[^\S\n]")
_BREAK = re.compile("\r\n?|[\u0085  ]")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")

_TRIPLES = LOOK_ALIKES.split()
_TO_LATIN = {ord(c): t[0] for t in _TRIPLES for c in t[1:] if c != "-"}
_TO_CYRILLIC = {ord(c): t[1] for t in _TRIPLES if t[1] != "-" for c in (t[0], t[2]) if c != "-"}
_TO_GREEK = {ord(c): t[2] for t in _TRIPLES if t[2] != "-" for c in t[:2] if c != "-"}
_MARKS = {ord(a): b for a, b in LOOK_ALIKE_MARKS.items()}
_SHARED = frozenset(c for t in _TRIPLES for c in t if c != "-")


def script(char: str) -> str:
    """L, C or G for a Latin, Cyrillic or Greek letter that no other script shares; else empty."""
    if char in _SHARED:
        return ""
    o = ord(char)
    if 0x41 <= o <= 0x5A or 0x61 <= o <= 0x7A or 0xC0 <= o <= 0x24F or 0x1E00 <= o <= 0x1EFF:
        return "L"
    if 0x400 <= o <= 0x52F:
        return "C"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G"
    return ""


class _Settled(dict):
    """A word -> the word with its look-alikes in the one script it is written in. Words recur, so most come from here; it starts again when it is full."""

    def __missing__(self, word: str) -> str:
        found = {script(c) for c in word} - {""}
        table = _TO_CYRILLIC if found == {"C"} else _TO_GREEK if found == {"G"} else _TO_LATIN
        if len(self) >= 200_000:
            self.clear()
        out = word.translate(table)
        if len(word) <= 40:
            self[word] = out
        return out


_SETTLED = _Settled()


def _settle(match: re.Match) -> str:
    return match[0] if match[0].isascii() else _SETTLED[match[0]]


def read_confusables(path: str) -> dict[str, str]:
    """Look-alikes from a file in the public Unicode confusables format (`source ; target ; class`, code points in hex): single letters of scripts that the built-in
    table doesn't settle word by word, and what they look like. A parameter of the functions below; the file is bounded and read on the driver."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        parts = [p.strip() for p in line.partition("#")[0].split(";")]
        if len(parts) < 2 or " " in parts[0] or not parts[0]:
            continue
        char, target = chr(int(parts[0], 16)), "".join(chr(int(x, 16)) for x in parts[1].split())
        if char.isalpha() and not script(char) and char not in _SHARED and not char.isascii():
            out[char] = target
    return out


def appearance(text: str, confusables: Mapping[str, str] | None = None) -> str:
    """The text in one form that keeps everything a reader sees, letter case included. `confusables` adds look-alikes of further scripts (see `read_confusables`)."""
    if text.isascii():
        return _BLANK.sub(" ", _BREAK.sub("\n", text) if "\r" in text else text)
    flat = IGNORABLE.sub("", unicodedata.normalize("NFKD", text))
    flat = _BLANK.sub(" ", _BREAK.sub("\n", flat)).translate(_MARKS)
    if confusables:
        flat = unicodedata.normalize("NFKD", flat.translate({ord(a): b for a, b in confusables.items()}))
    return unicodedata.normalize("NFKC", _WORD.sub(_settle, flat) if _OTHER_SCRIPT.search(flat) else flat)


def consistent(text: str, seen: str | None = None) -> str:
    """The consistent form: the appearance (`seen`, where known), fully case-folded and composed."""
    seen = appearance(text) if seen is None else seen
    return seen.lower() if seen.isascii() else unicodedata.normalize("NFKC", seen.casefold())


def _normaliser(confusables: Mapping[str, str] | None):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        distinct = {t: consistent(t, appearance(t, confusables)) for t in texts.dropna().unique()}
        return texts.map(distinct).astype(object).where(texts.notna(), None)

    return run


def normalise(text: Column, confusables: Mapping[str, str] | None = None) -> Column:
    """The consistent form of a text column; NULL stays NULL, an empty text empty. Worked out once per distinct value of a batch."""
    return _normaliser(confusables)(text)


#: Texts whose digests a task remembers, so that their copies aren't worked on again.
REMEMBERED = 100_000


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_keys(docs: DataFrame, text_column: str, id_column: str, confusables: Mapping[str, str] | None = None) -> DataFrame:
    """(id, raw, seen): digests of the text as stored and of its appearance. NULL texts are left out. Texts stay where they are; copies within a task are worked on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            raw, seen = [], []
            for text in batch.column(1).to_pylist():
                d = _digest(text)
                s = known.get(d)
                if s is None:
                    form = appearance(text, confusables)
                    s = d if form == text else _digest(form)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[d] = s
                raw.append(d)
                seen.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(seen, pa.binary())], names=["id", "raw", "seen"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("text").isNotNull())
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, raw binary, seen binary")


def _spellings(keys: DataFrame) -> DataFrame:
    """(seen, raw, copies) of the looks that have several spellings."""
    each = keys.groupBy("seen", "raw").agg(F.count(F.lit(1)).alias("copies"))
    several = each.groupBy("seen").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seen")
    return each.join(several, "seen", "left_semi")


def spelling_pairs(keys: DataFrame) -> DataFrame:
    """(raw_x, raw_y, copies_x, copies_y), raw_x < raw_y: different texts that look the same, each pair once, however many documents hold them."""
    spellings = _spellings(keys)
    a, b = (spellings.select("seen", F.col("raw").alias(f"raw_{s}"), F.col("copies").alias(f"copies_{s}")) for s in "xy")
    return a.join(b, "seen").filter("raw_x < raw_y").drop("seen")


def look_alike_pairs(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", confusables: Mapping[str, str] | None = None, chunk: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: documents whose texts differ in their characters but look the same.

    Identical texts are no pair. NULL texts are left out, empty texts only meet texts that look empty; repeated rows give their pair once; an empty
    input gives no rows; other columns aren't read; texts are compared whole. Documents are grouped by digests; text never moves. Distinct spellings
    are paired first and then joined with the documents that hold them, so copies of one text never meet each other. Documents of one text are dealt into chunks of about
    `chunk`, and chunks are joined, so that two spellings with very many copies are many small tasks' work. `look_alike_classes` gives the same links without
    expanding them."""
    # Narrow digests, written once: the texts are read and worked on a single time.
    keys = cut(with_keys(docs, text_column, id_column, confusables).distinct())
    pairs = cut(spelling_pairs(keys))
    x, y = (_dealt(keys, pairs, s, chunk) for s in "xy")
    met = x.join(y, ["raw_x", "chunk_x", "raw_y", "chunk_y"]).filter("id_x <> id_y")
    return met.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()


def _dealt(keys: DataFrame, pairs: DataFrame, side: str, chunk: int) -> DataFrame:
    """The documents of one side of the spelling pairs, (id, raw_x, chunk_x, raw_y, chunk_y): their own chunk, by a hash of the id, with each chunk of the other side."""
    other = "y" if side == "x" else "x"
    chunks = {s: F.ceil(F.col(f"copies_{s}") / F.lit(chunk)).cast("int") for s in "xy"}
    spread = pairs.select("raw_x", "raw_y", chunks[side].alias("n"), F.explode(F.sequence(F.lit(0), chunks[other] - 1)).alias(f"chunk_{other}"))
    # Each chunk of a text is a join key of its own: the pair side names the chunk, the document side computes the same from the text's copies.
    wanted = spread.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("raw", F.col(f"raw_{side}"))
    sizes = wanted.select("raw", "n").distinct()
    held = keys.join(sizes, "raw").select(F.col("id").alias(f"id_{side}"), "raw", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("mine"))
    return held.join(wanted.drop("n"), ["raw", "mine"]).select(f"id_{side}", "raw_x", "raw_y", F.col("mine").alias(f"chunk_{side}"), f"chunk_{other}")


def look_alike_classes(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", confusables: Mapping[str, str] | None = None) -> DataFrame:
    """(id, look, spelling, links) of every document with a text: digests (hex) of what it looks like and of the text as stored, and the number of documents that
    look the same in other characters. The links of `look_alike_pairs`, one row per document."""
    keys = cut(with_keys(docs, text_column, id_column, confusables).distinct())
    each = keys.groupBy("seen", "raw").agg(F.count(F.lit(1)).alias("copies"))
    whole = each.groupBy("seen").agg(F.sum("copies").alias("all"))
    counted = each.join(whole, "seen").select("raw", (F.col("all") - F.col("copies")).alias("links")).filter("links > 0")
    return keys.join(counted, "raw", "left").select("id", F.lower(F.hex("seen")).alias("look"), F.lower(F.hex("raw")).alias("spelling"), F.coalesce("links", F.lit(0)).alias("links"))


def forms(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", confusables: Mapping[str, str] | None = None) -> DataFrame:
    """(id, form, changed) of every document: its text in the consistent form and whether that differs from the text as stored."""
    raw = F.col(text_column)
    return docs.select(F.col(id_column), normalise(raw, confusables).alias("form"), raw.alias("_raw")).select(id_column, "form", (~F.col("form").eqNullSafe(F.col("_raw"))).alias("changed"))
