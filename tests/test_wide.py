import datetime
import random

import pyarrow as pa
import pytest
from conftest import rows

from siftworks.operators import wide

DEFS = "owner_kind string, attr_name string, data_type string, also_written array<string>"
ROWS = "row_no long, owner_kind string, owner_id string, attr_name string, raw_value string, recorded_at timestamp, id string"
T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def defs(spark):
    return spark.createDataFrame([("p", "n", "int", ["how_many"]), ("p", "x", "double", None), ("p", "b", "boolean", []), ("p", "d", "date", ["the day"]), ("p", "s", "string", []), ("q", "n", "double", [])], DEFS)


def run(spark, defs, entities, single=()):
    e = spark.createDataFrame(entities, "id string, extra string, n int, unfit_attributes string")
    return wide.widen(e, "extra", spark.createDataFrame(list(single), ROWS), defs, "p")


def test_types_names_and_unfit_cells(spark, defs):
    entities = [
        ("a", '{"How-Many": "12.0", "x": "1,5", "b": "Y", "the_day": "31.12.2023", "S": 7, "note": 1}', 1, ""),
        ("b", '{"n": "1.5", "x": "1e3", "b": "maybe", "d": "2023-02-30", "s": " "}', 1, ""),
        ("c", '{"n": 3', 1, ""), ("d", None, 1, ""), ("e", "[1]", 1, ""), ("f", '{"n": null, "x": "n/a", "b": "NaN", "d": "-"}', 1, ""), ("g", '{"n": NaN}', 1, ""),
    ]
    got = {r["id"]: r for r in run(spark, defs, entities).collect()}
    assert (got["a"]["n"], got["a"]["x"], got["a"]["b"], got["a"]["d"], got["a"]["s"]) == (12, 1.5, True, datetime.date(2023, 12, 31), "7")
    assert got["b"]["x"] == 1000.0 and got["b"]["unfit_attributes"] == ["b", "d", "n"] and got["b"]["s"] is None
    assert all(got[k]["unfit_attributes"] == [] and got[k]["n"] is None for k in "cdefg")
    assert len(got) == 7


def test_attribute_rows_fill_cells_and_later_values_win(spark, defs):
    single = [
        (1, "p", "a", "n", "oops", T0, "z"), (2, "p", "a", "n", "5", T0, "z"), (2, "p", "a", "n", "5", T0, "z"), (3, "p", "a", "n", "6", T0 + datetime.timedelta(1), "z"), (4, "p", "a", "x", "bad", None, "z"),
        (5, "q", "a", "n", "9", T0, "z"), (6, "p", "lost", "n", None, T0, "z"), (7, "p", "a", None, "1", T0, "z"),
    ]
    got = {r["id"]: r for r in run(spark, defs, [("a", '{"n": 1}', 1, ""), ("a", '{"n": 1}', 1, "")], single).collect()}
    assert got["a"]["n"] == 6 and got["a"]["unfit_attributes"] == ["x"] and got["a"]["entity_present"]
    assert not got["lost"]["entity_present"] and got["lost"]["unfit_attributes"] == []


def test_empty_tables_and_null_ids(spark, defs):
    assert run(spark, defs, []).count() == 0
    got = run(spark, defs, [(None, '{"n": 1}', 1, ""), (None, '{"x": 2}', 1, "")]).collect()
    assert len(got) == 1 and (got[0]["n"], got[0]["x"]) == (1, 2.0)


def test_unfit_cells_equal_brute_force(spark, defs):
    r = random.Random(2)
    values = ["1", "2.0", "2.5", "yes", "n/a", "", "x", "2024-01-01", "20240230", "-", None]
    entities, single, given = [], [], {}
    for i in range(300):
        e = f"e{i}"
        pairs = [(r.choice("nxbds"), r.choice(values)) for _ in range(r.randrange(4))]
        entities.append((e, "{" + ", ".join(f'"{k}": {"null" if v is None else chr(34) + v + chr(34)}' for k, v in pairs) + "}", 1, ""))
        more = [(r.choice("nxbds"), r.choice(values)) for _ in range(r.randrange(3))]
        single += [(i * 10 + j, "p", e, k, v, T0, "") for j, (k, v) in enumerate(more)]
        given[e] = pairs + more
    kinds = dict(n="int", x="double", b="boolean", d="date", s="string")
    expected = sorted((e, k) for e, pairs in given.items() for k in kinds if (vs := [v for c, v in pairs if c == k and not wide.is_missing(v)]) and all(wide.fit(kinds[k], v) is None for v in vs))
    assert rows(wide.unfit_cells(run(spark, defs, entities, single))) == expected


def test_stream_keeps_entities_that_span_batches():
    batch = lambda *r: pa.record_batch([pa.array([x[i] for x in r], pa.string()) for i in range(3)], names=["e", "a", "v"])
    out = list(wide.stream([batch(("a", None, '{"n": 1}'), ("a", "x", "2")), batch(("a", "x", "3"), ("b", None, None))], ["n", "x"], ["int", "double"], {"n": 0, "x": 1}, "id", rows=1))
    assert [b.to_pylist()[0]["x"] for b in out] == [3.0, None] and out[0].column("n").null_count == 0 and out[1].column("n").null_count == 1


@pytest.mark.parametrize("kind,text,value", [("int", "+7", 7), ("int", "7.", None), ("int", "７", None), ("double", "-,5", -0.5), ("double", "1.2.3", None), ("double", "1e", None), ("boolean", "T", True), ("boolean", "2", None), ("date", "2024/02/29", 19782), ("date", "2023/02/29", None), ("date", "2024-0229", None), ("string", " a ", "a")])
def test_fit(kind, text, value):
    assert wide.fit(kind, text) == value


def test_long_values_are_whole(spark, defs):
    long = "y" * 200_000
    assert run(spark, defs, [("a", '{"s": "' + long + '"}', 1, "")]).collect()[0]["s"] == long
