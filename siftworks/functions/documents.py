"""JSON, byte and array functions. Repairs that regular column functions can't express run as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def member(j: Column, key: str) -> Column:
    """A member as text; NULL where it is absent or null or the JSON is broken (`get_json_object` would still read a broken text's beginning)."""
    return F.try_variant_get(F.try_parse_json(j), f"$['{key}']", "string")


def shaped(j: Column, names: list[str]) -> Column:
    """A struct of some members as text, NULL where one is absent: an answer of fixed shape whatever the JSON holds. The JSON is parsed once."""
    parsed = F.try_parse_json(j)
    return F.struct(*[F.try_variant_get(parsed, f"$['{n}']", "string").alias(n) for n in names])


def number(j: Column, key: str) -> Column:
    """A member as a number; NULL where it is none."""
    return member(j, key).try_cast("double")


def is_valid(j: Column) -> Column:
    return j.isNotNull() & F.try_parse_json(j).isNotNull()


def string_array(j: Column, key: str) -> Column:
    """A member that is a JSON array, as array<string>; NULL where it is anything else."""
    text = member(j, key)
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def as_list(j: Column, key: str) -> Column:
    """A member that is a list or a single value, as a list; NULL for nothing, an empty text or an empty list."""
    text = member(j, key)
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).when(F.trim(text) != "", F.array(text))
    return F.when(F.size(listed) > 0, listed)


def without_members(j: Column, keys: list[str]) -> Column:
    """JSON object text without some members; the others keep their types (numbers, booleans, lists, objects, null). Members come out in order of their names, numbers in
    their shortest form. NULL, broken JSON and JSON that is no object give NULL."""
    members = F.try_variant_get(F.try_parse_json(j), "$", "map<string,variant>")
    return F.to_json(F.map_filter(members, lambda k, v: ~k.isin(*keys)), {"ignoreNullFields": "false"})


def promoted(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def positions_to_text(index: Column) -> Column:
    """Text from word -> positions (map<string, array<int>>): the first word put at a position stays, gaps are left out."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(placed)
    firsts = F.filter(ordered, lambda x, i: (i == 0) | (x["p"] != F.element_at(ordered, F.greatest(i, F.lit(1)))["p"]))
    return F.array_join(F.transform(firsts, lambda x: x["w"]), " ")


class _Lenient:
    """Reads one value of JSON-like text and writes it as JSON, in one pass with a stack of open lists and objects. Commas are separators at most: missing, repeated and
    trailing ones make no difference. Strings may stand in either sort of quotes, escapes that mean nothing stand for their letter, and control
    characters are blanks outside of strings and nothing within."""

    _LITERAL = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
    _PLAIN = {q: re.compile(rf"[^{q}\\\x00-\x1f]+") for q in "\"'"}

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _peek(self) -> str:
        """The next character that says something; empty at the end."""
        while self.at < len(self.text) and (self.text[self.at] <= " " or self.text[self.at] in ",\ufeff"):
            self.at += 1
        return self.text[self.at : self.at + 1]

    def _string(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while True:
            if run := self._PLAIN[quote].match(self.text, self.at):
                out.append(run[0])
                self.at = run.end()
            c, after = self.text[self.at : self.at + 1], self.text[self.at + 1 : self.at + 2]
            if not c or (c == "\\" and not after):
                raise ValueError("a string without end")
            self.at += 1
            if c == quote:
                # Escaped halves of one character become one; a half alone is no text.
                whole = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
                return json.dumps(whole, ensure_ascii=False)
            if c == "\\":
                self.at += 1
                code = self.text[self.at : self.at + 4]
                if after == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                    out.append(chr(int(code, 16)))
                    self.at += 4
                else:
                    out.append(_ESCAPES.get(after, after))
            elif c in "\n\t":
                out.append(c)

    def _scalar(self) -> str:
        if self._peek() in ("'", '"'):
            return self._string()
        found = self._LITERAL.match(self.text, self.at)
        if not found:
            raise ValueError(f"no value at {self.at}")
        self.at = found.end()
        return found[0]

    def read(self) -> str:
        open_: list[tuple[str, list[str]]] = []
        while True:
            c, name = self._peek(), ""
            if open_ and c and c == open_[-1][0]:
                self.at += 1
                closing, parts = open_.pop()
                value = ("{" if closing == "}" else "[") + ", ".join(parts) + closing
                if parts and parts[-1].endswith(": "):
                    raise ValueError("a name without value")
            else:
                if open_ and open_[-1][0] == "}" and not (open_[-1][1] and open_[-1][1][-1].endswith(": ")):
                    if c not in ("'", '"'):
                        raise ValueError(f"no name at {self.at}")
                    name = self._string()
                    if self._peek() != ":":
                        raise ValueError(f"no colon at {self.at}")
                    self.at += 1
                    open_[-1][1].append(name + ": ")
                    continue
                if c in ("{", "[") and c:
                    self.at += 1
                    open_.append(("}" if c == "{" else "]", []))
                    continue
                value = self._scalar()
            if not open_:
                if self._peek():
                    raise ValueError(f"more text at {self.at}")
                return value
            parts = open_[-1][1]
            if open_[-1][0] == "}":
                parts[-1] += value
            else:
                parts.append(value)


def repair(text: str) -> str:
    """Valid JSON text from nearly valid; text that is valid stays as it is, and what can't be read is `{}`."""
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        pass
    try:
        return _Lenient(text).read()
    except ValueError:
        return "{}"


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else repair(t))


def decode_bytes(raw: bytes) -> str:
    """Text of unknown encoding: UTF-16 by its mark or by many NULs, else UTF-8, else Latin-1; marks and NULs out."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = raw.decode("utf-16", errors="replace")
    elif len(raw) >= 4 and raw.count(0) * 4 > len(raw):
        text = raw.decode("utf-16-le" if raw[1::2].count(0) >= raw[::2].count(0) else "utf-16-be", errors="replace")
    else:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
    return text.lstrip("﻿").replace("\x00", "")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def strip_nuls(c: Column) -> Column:
    """Text or JSON text without NULs, written out or escaped."""
    return F.regexp_replace(F.regexp_replace(c, "\x00", ""), r"\\u0000", "")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
