import math

import pytest
from conftest import DATA, rows

from siftworks.operators import units
from siftworks.session import table


@pytest.fixture(scope="module")
def known(spark):
    return units.quantities(table(spark, DATA, "unit_defs"))


@pytest.mark.parametrize("text,powers,scale", [("ms", (1, 0, 0, 0, 0, 0), 1e-3), ("MS", (1, 0, 0, 0, 0, 0), 1e-3), ("kg*m/s^2", (-2, 1, 1, 0, 0, 0), 1.0), ("m s-2", (-2, 0, 1, 0, 0, 0), 1.0), ("(m/s)²", (-2, 0, 2, 0, 0, 0), 1.0), ("kilogauss", (-2, 1, 0, -1, 0, 0), 0.1), ("mT", (-2, 1, 0, -1, 0, 0), 1e-3), ("Wochen", (1, 0, 0, 0, 0, 0), 604800), ("°", (0, 0, 0, 0, 0, 1), math.pi / 180)])
def test_unit_grammar(text, powers, scale):
    u = units.parse_unit(text)
    assert u.powers == powers and u.scale == pytest.approx(scale)


@pytest.mark.parametrize("text", ["", "xyz", "m/", "(m", "m^", "/s", "3", "m)"])
def test_no_units(text):
    assert units.parse_unit(text) is None


def test_offsets_and_dimensions():
    c, k = units.parse_unit("°C"), units.parse_unit("K")
    assert c.to(k, 20) == pytest.approx(293.15) and units.parse_unit("Fahrenheit").to(c, 212) == pytest.approx(100)
    with pytest.raises(ValueError):
        c.to(units.parse_unit("s"), 1)
    assert units.parse_unit("°C/s") is None


@pytest.mark.parametrize("quantity,raw,beside,expected", [
    ("RepetitionTime", "2000", (), ("ms", 2.0, "plausible")), ("RepetitionTime", "2", (), ("s", 2.0, "plausible")), ("RepetitionTime", "2,5 sec", ("ms",), ("s", 2.5, "stated")), ("RepetitionTime", "2000", ("usec",), ("us", 0.002, "beside")),
    ("EchoTime", "30milliseconds", (), ("ms", 0.03, "stated")), ("FlipAngle", "1.5708", (), ("rad", 90.0, "plausible")), ("FlipAngle", "90°", (), ("deg", 90.0, "stated")), ("MagneticFieldStrength", "30", (), ("kG", 3.0, "plausible")), ("MagneticFieldStrength", "1e-9", (), ("T", 1e-9, "default")),
])
def test_resolution_order(known, quantity, raw, beside, expected):
    value, code, common, how = units.resolve(known[quantity], raw, beside)
    assert (code, how) == (expected[0], expected[2]) and common == pytest.approx(expected[1], rel=1e-4)


def test_unreadable_values(known):
    assert units.resolve(known["EchoTime"], "fast")[3] == "unreadable" and units.resolve(known["EchoTime"], "3 parsecs")[3] == "unreadable"


def test_ages(spark, known):
    datasets = spark.createDataFrame([("m", "Ages in the participant table are given in months.", None), ("r", "Volunteers were between 18 and 65 years old.", None), ("f", "Follow-up happened after 9 days.", None), ("w", None, "The age column counts weeks since birth. Aged 2 to 3.")], "id string, description_text string, readme_text string")
    people = spark.createDataFrame([("1", "m", 40.0, None), ("2", "r", 400.0, None), ("3", "r", 30.0, None), ("4", "f", 40.0, None), ("5", "f", 20000.0, "{broken"), ("6", "w", 100.0, '{"Unit of age": "Tage"}'), ("7", "w", 100.0, "[]"), ("8", "m", float("nan"), None), ("9", "m", -1.0, None), ("10", None, 5.0, '{"ageUnit": "?"}'), ("11", "m", None, None), ("1", "m", 40.0, None)], "id string, dataset_id string, age double, extra string")
    clues = units.age_clues(datasets, ["description_text", "readme_text"])
    got = units.convert_ages(people, clues, known["age"], ["age_unit", "unit_of_age"])
    assert {r["record_id"]: r["unit_code"] for r in got.collect()} == {"1": "months", "2": "months", "3": "years", "4": "years", "5": "days", "6": "days", "7": "weeks", "10": "years"}
    assert rows(units.off_unit(got, known)) == [(i, "age", u) for i, u in sorted({"1": "months", "2": "months", "5": "days", "6": "days", "7": "weeks"}.items())]


def test_members_with_clashing_columns_and_empty_input(spark, known):
    df = spark.createDataFrame([("1", '{"TR": "2000", "TR_unit": "ms", "EchoTime": "n/a"}', "x"), ("1", '{"TR": "2000", "TR_unit": "ms", "EchoTime": "n/a"}', "x"), ("2", '{"TR": 1', "x"), ("3", "", "x"), ("4", '{"repetition time": true}', "x")], "id string, other_entities string, record string")
    got = units.convert_members(df, "other_entities", known, {"RepetitionTime": ["TR", "repetition_time"], "EchoTime": []})
    assert rows(got, "record_id", "unit_code", "common_value", "found_by") == [("1", "ms", 2.0, "beside"), ("4", None, None, "unreadable")]
    assert units.convert_members(df.limit(0), "other_entities", known, {"EchoTime": []}).count() == 0
    assert units.convert_ages(spark.createDataFrame([], "id string, dataset_id string, age double, extra string"), units.age_clues(spark.createDataFrame([], "id string, t string"), ["t"]), known["age"], []).count() == 0
