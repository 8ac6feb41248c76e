import random

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from siftworks.llm import canonical
from siftworks.session import table


@pytest.fixture(scope="module")
def vocabulary(spark):
    return table(spark, DATA, "vocab_terms").cache()


def mapped(spark, vocabulary, values, synonyms=None, column="code"):
    df = spark.createDataFrame(values, "field string, value string")
    return {(r["field"], r["value"]): r[column] for r in canonical.map_values(df, vocabulary, synonyms).collect()}


#: Words around listed names, from which decorating words are learned.
AROUND = {"diagnosis": ("dx: {}", "pt with {}", "1-{}", "{} patient", "{} (confirmed)"), "sex": ("sex={}", "{} subj"), "handedness": ("mostly {}", "{} hd", "{} hand"), "task": ("task-{}", "the {} test", "{} run", "{} paradigm")}


@pytest.fixture(scope="module")
def decorated(vocabulary):
    return [(r["field_name"], pattern.format(r["label"])) for r in vocabulary.collect() for pattern in AROUND[r["field_name"]]]


CASES = [
    ("diagnosis", "Heatlhy volnuteer", "healthy_volunteer"), ("diagnosis", "Ｈｅａｌｔｈｙ ｖｏｌｕｎｔｅｅｒ", "healthy_volunteer"), ("diagnosis", "pt.WithHealthyVolunteer", "healthy_volunteer"), ("diagnosis", "volunteer), (healthy", "healthy_volunteer"), ("diagnosis", "Healthy volunteer (confirmed) patient", "healthy_volunteer"),
    ("diagnosis", "1-Juvenile myoclonic seizures", "myoclonic_juvenile"), ("diagnosis", "Autism spectrum cond.", "autism_spectrum"), ("diagnosis", "pain back chronic", "chronic_back_pain"), ("diagnosis", "ess..trem.", "essential_tremor"), ("diagnosis", "schizo", "schizophrenic_illness"),
    ("diagnosis", "family history of migraine", "unmatched"), ("diagnosis", "relative of stutterer", "unmatched"), ("diagnosis", "9", "unmatched"), ("diagnosis", "n/a", "unmatched"), ("diagnosis", "?", "unmatched"), ("diagnosis", "mild cog. imp. (conifrmed)", "mild_impairment"),
    ("sex", "womanOrGiul", "female"), ("sex", "boy;, man or", "male"), ("sex", "m", "male"), ("sex", "0", "unmatched"), ("sex", "sex=woma", "female"), ("sex", "MANoRbOY", "male"), ("sex", "girl", "female"), ("sex", "mlae", "male"),
    ("handedness", "(right hd)", "right"), ("handedness", "mostly Sinistral", "left"), ("handedness", "footed", "unmatched"), ("handedness", "Ｒ", "right"), ("handedness", "100", "unmatched"), ("handedness", "LH", "left"), ("handedness", "lfet", "left"), ("handedness", "rgiht", "right"), ("handedness", "ambi", "ambidextrous"),
    ("task", "the risky deck choice test", "card_gamble"), ("task", "rest, Quiet", "quiet_rest"), ("task", "rulesBetweenSwitching", "rule_switching"), ("task", "Rest w/ closed yees", "eyes_closed_rest"), ("task", "XX", "unmatched"), ("task", "z90", "unmatched"), ("task", "test", "unmatched"), ("task", "run1", "unmatched"), ("sex", "(womna)", "female"), ("handedness", "rihgt hd", "right"), ("diagnosis", "N/A", "unmatched"),
    ("task", "fingtap", "finger_sequence"), ("task", "inkcol", "colour_naming"), ("task", "mrot", "mental_rotation"), ("task", "vmaze", "spatial_maze"), ("task", "rest-EC", "eyes_closed_rest"), ("task", "resting", "quiet_rest"), ("task", "shimming", "unmatched"), ("task", "taskswitch", "rule_switching"), ("task", "psg", "unmatched"),
]


def test_known_spellings(spark, vocabulary, decorated):
    got = mapped(spark, vocabulary, [c[:2] for c in CASES] * 2 + [("task", None), ("task", "   "), *decorated])
    assert {c[:2]: got[c[:2]] for c in CASES} == {c[:2]: c[2] for c in CASES} and len(got) == len({c[:2] for c in CASES} | set(decorated))


def test_how_a_value_matched_and_synonyms_as_a_table(spark, vocabulary):
    synonyms = spark.createDataFrame([("task", "sleep_night", "psg", 1), ("task", "no_such_entry", "xyz", 1), ("task", "quiet_rest", None, 1)], "field_name string, standard_code string, name string, code int")
    values = [("task", "PSG"), ("task", "qiet rest"), ("task", "xyz"), ("task", "mrot"), ("task", "load letter memory under")]
    assert mapped(spark, vocabulary, values, synonyms, "matched_by") == dict(zip(values, ["synonym", "listed (edited)", None, "initials", "word order"]))


def test_decorating_words_are_learned(spark, vocabulary, decorated):
    values = spark.createDataFrame(decorated + [("task", "quiet rest zzz")], "field string, value string").select("field", canonical.words(F.col("value")).alias("t"))
    stops = {r["field"]: set(r["stop"]) for r in canonical.decorations(values, canonical._names(vocabulary, None)).collect()}
    assert stops["task"] == {"task", "the", "test", "run", "paradigm"} and {"dx", "pt", "patient", "confirmed", "1"} <= stops["diagnosis"] and {"mostly", "hd", "hand"} <= stops["handedness"]


def test_pigeonhole_join_finds_what_brute_force_finds(spark, vocabulary):
    r = random.Random(4)
    stops = spark.createDataFrame([], "field string, stop array<string>")
    refs = canonical.references(canonical._names(vocabulary, None), stops).filter("field = 'task'").collect()
    refs = [x for x in refs if x["footing"] in (canonical.LISTED, canonical.ORDERED)]
    values = set()
    while len(values) < 150:
        form = list(r.choice(refs)["form"])
        for _ in range(r.randrange(6)):
            at = r.randrange(len(form) + 1)
            form[at : at + r.randrange(2)] = r.choice(["", "q", "x"])
        values.add("".join(form))
    values = {v for v in values if v and any(c.isalpha() for c in v)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    # Of the near listed forms, one is found for each value, and none that brute force doesn't see.
    got = mapped(spark, vocabulary, [("task", v) for v in values])
    near = {v: {x["code"] for x in refs if distance(v, x["form"]) <= x["k"]} for v in values}
    single = [v for v in values if len(near[v]) == 1]
    assert len(single) > 60 and all(got["task", v] in near[v] for v in single)


def test_found_leaves_out_listed_values_and_repeats(spark, vocabulary):
    typed = spark.createDataFrame([("sex", "1", "M"), ("sex", "2", "m"), ("sex", "2", "m"), ("sex", "3", ""), ("sex", "4", None), ("sex", "5", "F "), ("other", "6", "x")], "field string, record_id string, value string")
    assert rows(canonical.canonicalise(typed, vocabulary)) == [("other", "6", "unmatched"), ("sex", "2", "male"), ("sex", "5", "female")]


def test_empty_tables_and_long_values(spark, vocabulary):
    typed = spark.createDataFrame([("task", "1", "quiet " * 5000), ("task", "2", "qiet rest")], "field string, record_id string, value string")
    assert rows(canonical.canonicalise(typed, vocabulary)) == [("task", "1", "unmatched"), ("task", "2", "quiet_rest")]
    assert canonical.canonicalise(typed.limit(0), vocabulary).count() == 0
    assert rows(canonical.canonicalise(typed, vocabulary.limit(0)).select("standard_code")) == [("unmatched",), ("unmatched",)]


def test_a_tie_is_unmatched(spark):
    v = spark.createDataFrame([(1, "f", "abcdex", "abcdex", []), (2, "f", "abcdey", "abcdey", [])], "term_id long, field_name string, standard_code string, label string, synonyms array<string>")
    assert mapped(spark, v, [("f", "abcdez"), ("f", "abcdex1")]) == {("f", "abcdez"): "unmatched", ("f", "abcdex1"): "abcdex"}
    assert mapped(spark, v.limit(0), [("f", "abcdez")]) == {("f", "abcdez"): "unmatched"}


def test_only_built_in_functions(spark, vocabulary):
    df = spark.createDataFrame([("sex", "1", "m")], "field string, record_id string, value string").filter(F.length("value") > 0)
    plan = canonical.canonicalise(df, vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
