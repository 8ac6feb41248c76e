"""Quantities recorded in several units, converted to one common unit per quantity.

Numbers and unit expressions are read by a small grammar. A unit is a vector of exponents over base dimensions with a scale and an
offset; two units convert when their vectors are equal. The unit of a value is taken, in this order, from the value's own
text, from a unit member beside it in the same JSON, from what the dataset's texts say, and from plausibility.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.operators.wide import as_text, attribute_key, is_missing, members
from siftworks.session import spread

#: Base dimensions, in the order of the exponent vectors.
DIMENSIONS = ("time", "mass", "length", "current", "temperature", "angle")
ZERO = (0,) * len(DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    """`value * scale + offset` is the value in base units of `powers`."""

    powers: tuple[int, ...] = ZERO
    scale: float = 1.0
    offset: float = 0.0

    def times(self, other: Unit, sign: int = 1) -> Unit:
        if self.offset or other.offset:
            raise ValueError("a unit with an offset stands alone")
        return Unit(tuple(a + sign * b for a, b in zip(self.powers, other.powers)), self.scale * other.scale**sign)

    def power(self, n: int) -> Unit:
        if n != 1 and self.offset:
            raise ValueError("a unit with an offset stands alone")
        return self if n == 1 else Unit(tuple(a * n for a in self.powers), self.scale**n)

    def to(self, target: Unit, value: float) -> float:
        if self.powers != target.powers:
            raise ValueError("different dimensions")
        return (value * self.scale + self.offset - target.offset) / target.scale


def _u(scale: float, offset: float = 0.0, **powers: int) -> Unit:
    return Unit(tuple(powers.get(d, 0) for d in DIMENSIONS), scale, offset)


_YEAR = 365.25 * 86400
#: SI prefixes, unit symbols (case matters) and unit names (case doesn't).
PREFIXES = {"n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "k": 1e3, "M": 1e6, "G": 1e9}
PREFIX_NAMES = {"nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "kilo": 1e3, "mega": 1e6, "giga": 1e9}
SYMBOLS = {
    "s": _u(1, time=1), "min": _u(60, time=1), "h": _u(3600, time=1), "d": _u(86400, time=1), "w": _u(7 * 86400, time=1), "y": _u(_YEAR, time=1), "a": _u(_YEAR, time=1),
    "g": _u(1e-3, mass=1), "m": _u(1, length=1), "A": _u(1, current=1), "K": _u(1, temperature=1), "°C": _u(1, 273.15, temperature=1), "°F": _u(5 / 9, 459.67 * 5 / 9, temperature=1),
    "T": _u(1, mass=1, time=-2, current=-1), "G": _u(1e-4, mass=1, time=-2, current=-1), "rad": _u(1, angle=1), "°": _u(math.pi / 180, angle=1), "Hz": _u(1, time=-1), "V": _u(1, mass=1, length=2, time=-3, current=-1),
}
NAMES = {
    "second": "s", "sec": "s", "sek": "s", "sekunde": "s", "minute": "min", "hour": "h", "hr": "h", "stunde": "h", "day": "d", "dy": "d", "tag": "d", "tage": "d", "week": "w", "wk": "w", "woche": "w", "wochen": "w",
    "year": "y", "yr": "y", "jahr": "y", "jahre": "y", "tesla": "T", "gauss": "G", "radian": "rad", "degree": "°", "deg": "°", "grad": "°", "hertz": "Hz", "gram": "g", "metre": "m", "meter": "m", "ampere": "A", "kelvin": "K", "celsius": "°C", "fahrenheit": "°F",
}
MONTH_NAMES = ("month", "mth", "mo", "mon", "monat", "monate")
_PREFIXABLE = frozenset({"s", "g", "m", "A", "K", "T", "G", "rad", "Hz", "V"})
_TOKEN = re.compile(r"\s*(?:(?P<num>[0-9]+)|(?P<word>[^\W\d_¹²³]+|°[CF]?)|(?P<op>\*\*|[\^*/·()−-])|(?P<sup>[⁻]?[¹²³]))")


def _word(word: str) -> Unit | None:
    if word in SYMBOLS:
        return SYMBOLS[word]
    for p, factor in PREFIXES.items():
        rest = word[len(p) :]
        if word.startswith(p) and rest in _PREFIXABLE:
            return SYMBOLS[rest].times(Unit(scale=factor))
    low = word.lower()
    for name in (low, low[:-1] if low.endswith("s") else low, low[:-1] if low.endswith("n") else low):
        if name in MONTH_NAMES:
            return _u(_YEAR / 12, time=1)
        if name in NAMES:
            return SYMBOLS[NAMES[name]]
        for p, factor in PREFIX_NAMES.items():
            rest = name[len(p) :]
            if name.startswith(p) and rest in NAMES:
                return SYMBOLS[NAMES[rest]].times(Unit(scale=factor))
        for p, factor in PREFIXES.items():
            rest = name[len(p) :]
            if p.islower() and name.startswith(p) and rest in NAMES:
                return SYMBOLS[NAMES[rest]].times(Unit(scale=factor))
    # Unit symbols typed in another case, as far as that leaves one reading.
    if low == "s" or low == "ms" or low == "us":
        return SYMBOLS["s"].times(Unit(scale={"s": 1.0, "ms": 1e-3, "us": 1e-6}[low]))
    if low in {"y", "w", "d"}:
        return SYMBOLS[low]
    return None


def parse_unit(text: str) -> Unit | None:
    """unit := factor (('*' | '·' | '/' | nothing) factor)*;  factor := (word | '(' unit ')') (('^' | '**')? ['-'] digits | superscript)?

    None where the text isn't a unit expression of known units."""
    tokens, at = [], 0
    text = text.strip().rstrip(".")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        return None
    try:
        unit, rest = _product(tokens, 0)
    except ValueError:
        return None
    return unit if rest == len(tokens) else None


def _product(tokens: list, i: int) -> tuple[Unit, int]:
    unit, i = _factor(tokens, i)
    while i < len(tokens) and tokens[i][1] != ")":
        sign = 1
        if tokens[i] in (("op", "*"), ("op", "·"), ("op", "/")):
            sign = -1 if tokens[i][1] == "/" else 1
            i += 1
        other, i = _factor(tokens, i)
        unit = unit.times(other, sign)
    return unit, i


def _factor(tokens: list, i: int) -> tuple[Unit, int]:
    if i >= len(tokens):
        raise ValueError("unit ends early")
    kind, text = tokens[i]
    if text == "(":
        unit, i = _product(tokens, i + 1)
        if i >= len(tokens) or tokens[i][1] != ")":
            raise ValueError("no closing bracket")
    elif kind == "word" and (unit := _word(text)) is not None:
        pass
    else:
        raise ValueError(f"no unit: {text}")
    i += 1
    if i < len(tokens) and tokens[i][0] == "sup":
        digits = tokens[i][1].translate(str.maketrans("⁻¹²³", "-123"))
        return unit.power(int(digits)), i + 1
    j = i + (i < len(tokens) and tokens[i][1] in {"^", "**"})
    sign = -1 if j < len(tokens) and tokens[j][1] in {"-", "−"} else 1
    k = j + (sign < 0)
    if k < len(tokens) and tokens[k][0] == "num":
        return unit.power(sign * int(tokens[k][1])), k + 1
    if j != i or sign < 0:
        raise ValueError("no exponent")
    return unit, i


_QUANTITY = re.compile(r"\s*(?P<number>[+\-−]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)(?P<unit>[\s\S]*)")


def parse_quantity(text: str) -> tuple[float, str] | None:
    """number [unit text]; None where no number leads."""
    m = _QUANTITY.fullmatch(text)
    if not m:
        return None
    return float(m["number"].replace(",", ".").replace("−", "-")), m["unit"].strip()


@dataclass(frozen=True)
class Measure:
    """A unit of `unit_defs` for one quantity."""

    code: str
    factor: float
    common: bool
    low: float
    high: float


class Quantity:
    """The units of one quantity; matches parsed units to their codes by dimension and scale."""

    def __init__(self, name: str, measures: list[Measure]):
        self.name, self.measures = name, measures
        self.common = next(m for m in measures if m.common)
        base = parse_unit(self.common.code)
        self.known = {m.code: parse_unit(m.code) for m in measures}
        self.base = base

    def code(self, unit_text: str) -> str | None:
        """The code a unit text means: the text itself, else the unit equal in dimension and nearly in scale (calendar units vary by 1 %)."""
        text = unit_text.strip()
        for m in self.measures:
            if text == m.code:
                return m.code
        unit = parse_unit(text)
        if unit is None:
            return None
        for code, known in self.known.items():
            if known is not None and known.powers == unit.powers and known.offset == unit.offset and abs(known.scale / unit.scale - 1) < 0.01:
                return code
        return None

    def plausible(self, value: float, low: float | None = None, high: float | None = None) -> list[str]:
        """Codes in which `value` lies in the plausible range, narrowed to [low, high] of the common unit where given."""
        found = []
        for m in self.measures:
            common = value * m.factor
            slack = 1e-9 * max(1.0, abs(common))
            if m.low - slack <= common <= m.high + slack and (low is None or low - slack <= common <= high + slack):
                found.append(m.code)
        return found

    def convert(self, value: float, code: str) -> float:
        """The value in the common unit, by the parsed units' scale and offset where known, else by the table's factor."""
        unit, base = self.known[code], self.base
        factor = next(m.factor for m in self.measures if m.code == code)
        if unit is not None and base is not None and unit.powers == base.powers and (unit.offset or base.offset):
            return unit.to(base, value)
        return value * factor


STATED, BESIDE, TEXTS, PLAUSIBLE, DEFAULT, UNREADABLE = "stated", "beside", "texts", "plausible", "default", "unreadable"


def resolve(quantity: Quantity, raw: str, beside: tuple[str, ...] = (), texts: str | None = None, low: float | None = None, high: float | None = None) -> tuple[float | None, str | None, float | None, str]:
    """(value, unit code, value in the common unit, how the unit was found). `beside` and `texts` are unit texts; low and high the texts' range in
    the common unit. Text that isn't a number with a known unit is `unreadable`, with NULL values."""
    parsed = parse_quantity(raw)
    if parsed is None or not math.isfinite(parsed[0]):
        return None, None, None, UNREADABLE
    value, unit_text = parsed
    if unit_text:
        code = quantity.code(unit_text)
        return (value, code, quantity.convert(value, code), STATED) if code else (value, None, None, UNREADABLE)
    for how, candidates in ((BESIDE, beside), (TEXTS, (texts,) if texts else ())):
        for text in candidates:
            if text and (code := quantity.code(text)):
                return value, code, quantity.convert(value, code), how
    if low is not None and high is not None and len(codes := quantity.plausible(value, low, high)) == 1:
        return value, codes[0], quantity.convert(value, codes[0]), PLAUSIBLE
    if len(codes := quantity.plausible(value)) == 1:
        return value, codes[0], quantity.convert(value, codes[0]), PLAUSIBLE
    return value, quantity.common.code, value, DEFAULT


def quantities(unit_defs: DataFrame, limit: int = 100_000) -> dict[str, Quantity]:
    """The unit table, a bounded configuration read on the driver (more than `limit` rows are refused)."""
    rows = unit_defs.orderBy("quantity", "unit_code").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} units")
    grouped: dict[str, list[Measure]] = {}
    for r in rows:
        grouped.setdefault(r["quantity"], []).append(Measure(r["unit_code"], r["to_common"], r["is_common"], r["plausible_min"], r["plausible_max"]))
    return {name: Quantity(name, sorted(ms, key=lambda m: not m.common)) for name, ms in grouped.items()}


CONVERTED = "record_id string, quantity string, raw_value string, value double, unit_code string, common_value double, found_by string"
_CACHE = 200_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "quantity", "raw_value", "value", "unit_code", "common_value", "found_by"]
    types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def convert_members(records: DataFrame, json_column: str, units: dict[str, Quantity], spellings: dict[str, list[str]], id_column: str = "id") -> DataFrame:
    """Quantities given as members of JSON text: one row per distinct (record, quantity, value, unit).

    `spellings[quantity]` lists member names, matched without regard to case, blanks, `_` and `-`; a member named like one of them plus
    `unit` or `units` gives the unit beside. NULL, missing markers, broken JSON and other JSON values give no row; a value that
    can't be read gives a row `unreadable`. Redelivered rows come out once. An empty input gives no rows; other columns aren't read.
    """
    index = {attribute_key(s): q for q, names in spellings.items() for s in [q, *names]}
    beside = {k + suffix: q for k, q in index.items() for suffix in ("unit", "units")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, keys = {}, {}
        for batch in batches:
            out = []
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, stated = [], {}
                for name, content in members(text):
                    key = keys.get(name)
                    if key is None:
                        k = attribute_key(name)
                        key = (index.get(k), beside.get(k))
                        if len(keys) < _CACHE:
                            keys[name] = key
                    quantity, unit_of = key
                    if quantity:
                        raw = as_text(content)
                        if not is_missing(raw):
                            values.append((quantity, raw.strip()))
                    elif unit_of and content is not None:
                        stated.setdefault(unit_of, []).append(as_text(content))
                for quantity, raw in values:
                    task = (quantity, raw, tuple(stated.get(quantity, ())))
                    found = cache.get(task)
                    if found is None:
                        found = resolve(units[quantity], raw, task[2])
                        if len(cache) < _CACHE:
                            cache[task] = found
                    out.append((record, quantity, raw, *found))
            yield _batch(out)

    source = records.select(F.col(id_column).cast("string").alias("record"), F.col(json_column).alias("text")).filter(F.col("text").isNotNull())
    return spread(source).mapInArrow(run, CONVERTED).distinct()


#: Sentences about ages in a dataset's texts. The unit pattern allows no digit between "age" and the unit, so ranges and follow-up times don't match.
AGE_UNIT = r"(?i)\bages?\b[^.!?\n0-9]*?\b(years?|months?|weeks?|days?)\b"
AGE_RANGE = r"(?i)(?:\bbetween\s+|\baged\s+|\bage range[^.!?\n0-9]*|\bages?\s+(?:from\s+)?)([0-9]+(?:\.[0-9]+)?)\s*(?:and|to|-|–)\s*([0-9]+(?:\.[0-9]+)?)(?:\s*(years?|months?|weeks?|days?|y)\b)?"


def age_clues(datasets: DataFrame, text_columns: list[str], id_column: str = "id") -> DataFrame:
    """Per dataset what its texts say of ages: `age_unit`, and the range `age_low`..`age_high` with `range_unit`; NULL where nothing is said.
    The first statement in column order counts; of several rows of a dataset, the smallest clue."""
    unit = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), AGE_UNIT, 1), F.lit("")) for c in text_columns])

    def part(i: int):
        return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), AGE_RANGE, i), F.lit("")) for c in text_columns])

    clues = datasets.select(F.col(id_column).alias("clue_of"), F.lower(unit).alias("age_unit"), part(1).cast("double").alias("age_low"), part(2).cast("double").alias("age_high"), F.lower(part(3)).alias("range_unit"))
    clues = clues.filter(F.col("age_unit").isNotNull() | F.col("age_low").isNotNull())
    return clues.groupBy("clue_of").agg(F.min(F.struct("age_unit", "age_low", "age_high", "range_unit")).alias("c")).select("clue_of", "c.*")


def convert_ages(participants: DataFrame, clues: DataFrame, age: Quantity, spellings: list[str], id_column: str = "id") -> DataFrame:
    """Ages of participants in the common unit, as `convert_members`. NULL, NaN, infinite and negative ages give no row. The unit is that of an
    `age_unit`-like member of `extra`, else the dataset's, else by plausibility, else the common one."""
    wanted = frozenset(attribute_key(s) for s in spellings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = {}
        for batch in batches:
            out = []
            for record, value, extra, unit, low, high, range_unit in zip(*[c.to_pylist() for c in batch.columns]):
                stated = tuple(as_text(v) for k, v in members(extra) if v is not None and attribute_key(k) in wanted) if extra else ()
                task = (value, stated, unit, low, high, range_unit)
                found = cache.get(task)
                if found is None:
                    if low is not None and range_unit and (code := age.code(range_unit)):
                        low, high = age.convert(low, code), age.convert(high, code)
                    found = resolve(age, repr(value), stated, unit, low, high)
                    if len(cache) < _CACHE:
                        cache[task] = found
                out.append((record, age.name, repr(value), *found))
            yield _batch(out)

    source = participants.filter((F.col("age") >= 0) & (F.col("age") < F.lit(float("inf")))).select(
        F.col(id_column).cast("string").alias("record"), "dataset_id", F.col("age").cast("double").alias("value"), "extra"
    )
    # A dataset may hold a third of all participants: AQE splits its partition; the clue side is one row per dataset.
    joined = source.join(clues, F.col("dataset_id") == F.col("clue_of"), "left")
    return joined.select("record", "value", "extra", "age_unit", "age_low", "age_high", "range_unit").mapInArrow(run, CONVERTED).distinct()


def off_unit(converted: DataFrame, units: dict[str, Quantity]) -> DataFrame:
    """(record_id, quantity, unit_code) of values recorded in a unit other than the common one."""
    common = [F.lit(f"{q.name}\x00{q.common.code}") for q in units.values()]
    return converted.filter(F.col("unit_code").isNotNull() & ~F.concat_ws("\x00", "quantity", "unit_code").isin(common)).select("record_id", "quantity", "unit_code").distinct()
