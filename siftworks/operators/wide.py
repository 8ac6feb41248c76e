"""Attribute-value data into wide tables: one row per entity, one typed column per attribute.

Rows of both deliveries (JSON members and single attribute rows) are sorted by entity inside hash partitions; a streaming
pass per partition encodes attribute names as column indices and appends each entity's cells to sparse columnar builders
(row numbers and values per column), which are flushed as Arrow batches with typed buffers and validity masks. State is one
entity's cells plus one batch, whatever the number of rows per entity.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that stand for "no value", compared after trimming and without regard to case.
MISSING = frozenset({"", "n/a", "na", "nan", "none", "unknown", "-"})
TRUE, FALSE = frozenset({"true", "yes", "y", "t", "1"}), frozenset({"false", "no", "n", "f", "0"})
_INT = re.compile(r"[+-]?[0-9]+(?:\.0+)?")
_DOUBLE = re.compile(r"[+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?")
_DATES = re.compile(r"(?P<y>[0-9]{4})(?P<s>[-/]?)(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})|(?P<d2>[0-9]{2})\.(?P<m2>[0-9]{2})\.(?P<y2>[0-9]{4})")
_EPOCH = date(1970, 1, 1).toordinal()
_SPARK_TYPES = {"int": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "string": T.StringType()}
UNFIT = "unfit_attributes"
PRESENT = "entity_present"


class Members(list):
    """Members of a JSON object in text order, repeated names kept."""


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(object_pairs_hook=Members, parse_int=str, parse_float=str, parse_constant=_no_constant).decode


def members(text: str | None) -> Members:
    """Members of valid JSON object text; nothing for NULL, invalid JSON or another JSON value. Numbers keep their spelling."""
    try:
        found = _decode(text) if text else None
    except (ValueError, RecursionError):
        found = None
    return found if isinstance(found, Members) else Members()


def as_text(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None or isinstance(value, str):
        return value
    return json.dumps([list(x) if isinstance(x, tuple) else x for x in value], default=str)


def attribute_key(name: str) -> str:
    """Attribute names are equal without regard to case, blanks, `_` and `-`."""
    return re.sub(r"[\s_\-]", "", name.lower())


def is_missing(text: str | None) -> bool:
    return text is None or text.strip().lower() in MISSING


def _date(text: str) -> int | None:
    if m := _DATES.fullmatch(text):
        y, mo, d = (int(m[k] or m[k + "2"]) for k in "ymd")
        try:
            return date(y, mo, d).toordinal() - _EPOCH
        except ValueError:
            return None
    return None


def fit(kind: str, text: str):
    """The typed value of trimmed `text`, or None where it doesn't fit. Dates are days since 1970-01-01."""
    text = text.strip()
    if kind == "string":
        return text
    if kind == "int":
        return int(text.partition(".")[0]) if _INT.fullmatch(text) else None
    if kind == "double":
        return float(text.replace(",", ".")) if _DOUBLE.fullmatch(text) else None
    if kind == "boolean":
        low = text.lower()
        return True if low in TRUE else False if low in FALSE else None
    if kind == "date":
        return _date(text)
    raise ValueError(f"unknown data type {kind!r}")


class Builders:
    """Sparse columns of one batch: per column the row numbers and values present, flushed as typed Arrow arrays."""

    def __init__(self, names: list[str], kinds: list[str]):
        self.names, self.kinds = names, kinds
        self.clear()

    def clear(self) -> None:
        self.ids: list[str | None] = []
        self.present: list[bool] = []
        self.unfit: list[list[str]] = []
        self.at: list[list[int]] = [[] for _ in self.names]
        self.values: list[list] = [[] for _ in self.names]

    def append(self, entity: str | None, present: bool, cells: dict[int, object], unfit: list[str]) -> None:
        row = len(self.ids)
        self.ids.append(entity)
        self.present.append(present)
        self.unfit.append(unfit)
        for column, value in cells.items():
            self.at[column].append(row)
            self.values[column].append(value)

    def _column(self, i: int) -> pa.Array:
        n, at, kind = len(self.ids), self.at[i], self.kinds[i]
        if kind == "string":
            dense: list[str | None] = [None] * n
            for row, value in zip(at, self.values[i]):
                dense[row] = value
            return pa.array(dense, pa.string())
        valid = np.zeros(n, dtype=bool)
        valid[at] = True
        mask = pa.py_buffer(np.packbits(valid, bitorder="little"))
        if kind == "boolean":
            bits = np.zeros(n, dtype=bool)
            bits[at] = self.values[i]
            return pa.Array.from_buffers(pa.bool_(), n, [mask, pa.py_buffer(np.packbits(bits, bitorder="little"))], n - len(at))
        numpy_type, arrow_type = {"int": (np.int64, pa.int64()), "double": (np.float64, pa.float64()), "date": (np.int32, pa.date32())}[kind]
        data = np.zeros(n, dtype=numpy_type)
        data[at] = self.values[i]
        return pa.Array.from_buffers(arrow_type, n, [mask, pa.py_buffer(data)], n - len(at))

    def flush(self, id_name: str) -> pa.RecordBatch:
        arrays = [pa.array(self.ids, pa.string()), pa.array(self.present, pa.bool_()), *[self._column(i) for i in range(len(self.names))], pa.array(self.unfit, pa.list_(pa.string()))]
        out = pa.RecordBatch.from_arrays(arrays, names=[id_name, PRESENT, *self.names, UNFIT])
        self.clear()
        return out


def stream(batches: Iterable[pa.RecordBatch], names: list[str], kinds: list[str], index: dict[str, int], id_name: str, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Wide batches from batches (entity, name, value) sorted by entity; a NULL name marks a row of the entity's own table, its value being JSON."""
    builders, typed, column_of = Builders(names, kinds), {}, {}
    current, started, present, seen, cells, given = None, False, False, None, {}, set()

    def put(name: str, text: str | None) -> None:
        column = column_of.get(name, -2)
        if column == -2:
            column = index.get(attribute_key(name), -1)
            if len(column_of) < 100_000:
                column_of[name] = column
        if column < 0:
            return
        key = (column, text)
        value = typed.get(key, typed)
        if value is typed:
            value = (is_missing(text), None if is_missing(text) else fit(kinds[column], text))
            if len(typed) < 200_000:
                typed[key] = value
        missing, value = value
        if missing:
            return
        given.add(column)
        if value is not None:
            cells[column] = value

    def close() -> None:
        kept = {c: v for c, v in cells.items() if kinds[c] != "int" or -(2**63) <= v < 2**63}
        builders.append(current, present, kept, sorted(names[c] for c in given - cells.keys()))

    for batch in batches:
        ids, attributes, values = (batch.column(i).to_pylist() for i in range(3))
        for entity, name, value in zip(ids, attributes, values):
            if not started or entity != current:
                if started:
                    close()
                    if len(builders.ids) >= rows:
                        yield builders.flush(id_name)
                current, started, present, cells, given = entity, True, False, {}, set()
            if name is None:
                if not present or value != seen:
                    for member, content in members(value):
                        put(member, as_text(content))
                present, seen = True, value
            else:
                put(name, value)
    if started:
        close()
    if builders.ids:
        yield builders.flush(id_name)


def definitions(defs: DataFrame, kind: str, limit: int = 10_000) -> tuple[list[str], list[str], dict[str, int]]:
    """Column names, data types and the name index of one kind of owner. The definitions become the schema, so they are read
    on the driver; more than `limit` columns are refused. Ambiguous spellings go to the first attribute by name."""
    rows = defs.filter(F.col("owner_kind") == kind).select("attr_name", "data_type", "also_written").orderBy("attr_name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes")
    index: dict[str, int] = {}
    for i, r in enumerate(rows):
        index.setdefault(attribute_key(r["attr_name"]), i)
    for i, r in enumerate(rows):
        for other in r["also_written"] or ():
            index.setdefault(attribute_key(other), i)
    return [r["attr_name"] for r in rows], [r["data_type"] for r in rows], index


def widen(entities: DataFrame, json_column: str, attribute_rows: DataFrame, defs: DataFrame, kind: str, id_column: str = "id") -> DataFrame:
    """One row per entity: `id_column`, `entity_present`, one typed column per attribute of `kind`, `unfit_attributes`.

    Where several values fit, the one recorded last wins (JSON before attribute rows; then by recorded_at, row_no and spelling,
    each NULL first). A cell is NULL where nothing fits; `unfit_attributes` names the attributes given some non-missing value none of
    which fits. Names that match no attribute are ignored. Redelivered rows change nothing. Attribute rows whose owner has no
    row of its own come out with `entity_present` false. NULL ids form one entity; an empty input gives no rows; other
    columns of the inputs, whatever their names, are not read. Values of any length are whole.

    Each JSON text moves once, to the partition of its entity, where repeats lie side by side and are read once. Attribute rows, of which an owner may have very many, are
    merged to distinct values before they move there.
    """
    names, kinds, index = definitions(defs, kind)
    if clash := {id_column, PRESENT, UNFIT} & set(names):
        raise ValueError(f"attribute names in use: {sorted(clash)}")
    own = entities.select(F.col(id_column).cast("string").alias("e"), F.col(json_column).alias("v"))
    single = (
        attribute_rows.filter(F.col("owner_kind") == kind)
        .filter(F.col("attr_name").isNotNull())
        .groupBy(F.col("owner_id").cast("string").alias("e"), F.col("attr_name").alias("a"), F.col("raw_value").alias("v"))
        .agg(F.max("recorded_at").alias("at"), F.max("row_no").alias("no"))
    )
    at, no = single.schema["at"].dataType, single.schema["no"].dataType
    both = own.select("e", F.lit(None).cast("string").alias("a"), "v", F.lit(None).cast(at).alias("at"), F.lit(None).cast(no).alias("no")).unionByName(single)
    # JSON rows have a NULL name and sort first.
    ordered = both.repartition("e").sortWithinPartitions("e", F.col("a").isNotNull(), "at", "no", "a", "v").select("e", "a", "v")
    schema = T.StructType([T.StructField(id_column, T.StringType()), T.StructField(PRESENT, T.BooleanType()), *[T.StructField(n, _SPARK_TYPES[k]) for n, k in zip(names, kinds)], T.StructField(UNFIT, T.ArrayType(T.StringType()))])
    return ordered.mapInArrow(_streamer(names, kinds, index, id_column), schema)


def _streamer(names: list[str], kinds: list[str], index: dict[str, int], id_name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream(batches, names, kinds, index, id_name)

    return run


def unfit_cells(wide: DataFrame, id_column: str = "id") -> DataFrame:
    """(owner_id, attr_name) of the cells that stay empty although something was given."""
    return wide.select(F.col(id_column).alias("owner_id"), F.explode(UNFIT).alias("attr_name"))
