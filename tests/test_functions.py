import json

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftworks.functions import documents, similarity, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("column,value,expected", [
    (text.without_separators, "N-Back _x", "nbackx"), (text.slug, " N-Back (2) ", "n_back_2"), (text.file_safe_tail, "https://a.b/c/d e.git/", "d_e.git"), (text.strip_task_ending, "stroop Task", "stroop"), (text.strip_task_ending, "task", "task"), (text.strip_task_ending, "x test task", "x test"),
    (text.plural_variants, "stories", ["stories", "storie", "story"]), (text.plural_variants, "memory", ["memory", "memorys", "memories"]), (text.plural_variants, "loss", ["loss", "losss"]),
    (text.keyword, "the big elephant kangaroo", "elephant"), (text.keyword, "a b", "a b"), (lambda c: text.without_words(c, text.DESCRIPTORS), "Complex Motor Task", "motor task"), (lambda c: text.without_words(c, text.DESCRIPTORS), "data", "data"),
    (text.clean_readme, " <b>Hi</b>\n\n\n\n![x](y) z ", "Hi \n\n z"), (lambda c: text.head_and_tail(c, 2), "abcdef", "ab\n…\nef"), (lambda c: text.head_and_tail(c, 3), "abcdef", "abcdef"), (text.urls, "http://a b https://c http://a", ["http://a", "https://c"]),
    (text.doi, "doi 10.1234/ab.c).", "10.1234/ab.c"), (text.doi, "none", None), (lambda c: text.first_words(c, 2), "a b c", "a b [...]"), (lambda c: text.first_words(c, 3), "a b c", "a b c"), (lambda c: text.first_match(c, text.JUNK_PATTERNS), "f12", "f{number}"), (lambda c: text.first_match(c, text.JUNK_PATTERNS), "VOL1", "vol*"),
    (text.error_category, "int32 JSON", "integer overflow"), (text.error_category, "?", "other"), (text.fingerprint, "a", "0cc175b9c0f1"), (lambda c: text.occurrences(c, F.lit("aa")), "aaaa b aa", 3),
    (lambda c: text.unknown_tables(c, ("d",)), "SELECT 1 FROM d JOIN Zed z WHERE x = 'from y'", ["zed"]), (lambda c: text.codes_in_sql(c, "task"), "o.task = 'a' AND p.task IN ('b', 'a')", ["a", "b"]), (text.content_words, "Show the Rest data rest", ["rest", "data"]),
    (lambda c: documents.member(c, "k"), '{"k": 2.50}', "2.5"), (lambda c: documents.member(c, "k"), '{"k": 2', None), (lambda c: documents.number(c, "k"), '{"k": " 2"}', 2.0), (lambda c: documents.string_array(c, "k"), '{"k": ["a", "b"]}', ["a", "b"]), (lambda c: documents.string_array(c, "k"), '{"k": "a"}', None),
    (lambda c: documents.as_list(c, "k"), '{"k": "a"}', ["a"]), (lambda c: documents.as_list(c, "k"), '{"k": []}', None), (lambda c: documents.without_members(c, ["a"]), '{"a": 1, "b": "x"}', '{"b":"x"}'), (documents.promoted, "  ", None), (documents.strip_nuls, 'a\x00\\u0000b', "ab"),
    (documents.repaired_json, "{'a': 1,}", '{"a": 1}'), (documents.repaired_json, "nope", "{}"), (documents.repaired_json, None, None),
    (lambda c: documents.without_members(c, ["k"]), '{"k": true, "b": {"c": [1, 2.50]}, "n": null, "a": 1, "s": "1"}', '{"a":1,"b":{"c":[1,2.5]},"n":null,"s":"1"}'), (lambda c: documents.without_members(c, ["k"]), '{"k": 1', None), (lambda c: documents.without_members(c, ["k"]), "[1]", None), (lambda c: documents.without_members(c, ["k"]), '{"k": 1}', "{}"),
    (text.categorise, "patients with epilepsy", "Diagnosis"), (text.categorise, "at least 20 patients", "How many"), (text.categorise, "EEG and fMRI, both", "Several kinds of data"), (text.categorise, "nothing", "Other"), (text.categorise, "a womenfolk", "Other"), (lambda c: text.categorise(c, (("X", ("lumbar  pain",)),), "-"), "Lumbar\npain", "X"),
])
def test_text_and_json(spark, column, value, expected):
    assert one(spark, column, value) == expected


@pytest.mark.parametrize("given,value", [
    ('{"a": [1, 2,, 3 4],}', {"a": [1, 2, 3, 4]}), ('{"a": {"b": 1}\n "c": 2}', {"a": {"b": 1}, "c": 2}), ('{"a": "x\\q\ty", \'b\': \'it"s\'}', {"a": "xq\ty", "b": 'it"s'}), ('\ufeff{"a": 1}', {"a": 1}), ('[{"a": 1}{"b": 2}]', [{"a": 1}, {"b": 2}]), ('{"a": -1.5e3, "b": null, "c": {}}\x00', {"a": -1500.0, "b": None, "c": {}}),
    ('{"a\x01": tru}', {}), ('{"a": "b', {}), ('{"a" 1}', {}), ("[1, 2", {}), ('{"a": 1} x', {}), ("", {}), ('{"a":}', {}), ("[,]", []), ('{"u": "\\u00e9\\ud83d\\ude00\\ud83d",}', {"u": "é😀\ufffd"}), ("[" * 5000 + "1," + "]" * 5000, None), ('"s"', "s"),
])
def test_nearly_valid_json(given, value):
    fixed = documents.repair(given)
    if value is None:
        assert fixed == "[" * 5000 + "1" + "]" * 5000
    else:
        assert json.loads(fixed) == value


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_the_lenient_reader_keeps_valid_json(value):
    assert json.loads(documents._Lenient(json.dumps(value, ensure_ascii=False)).read()) == value


def test_author_lines_and_positions(spark):
    assert one(spark, text.author_line, ["a", "b", "c", "d", "e"], "array<string>") == "a, b, c +2" and one(spark, text.author_line, ["a"], "array<string>") == "a"
    assert one(spark, documents.positions_to_text, {"b": [1, 9], "a": [0], "x": [1]}, "map<string,array<int>>") in ("a b b", "a x b")


@pytest.mark.parametrize("raw,expected", [("ä".encode("utf-16"), "ä"), ("abcd".encode("utf-16-le"), "abcd"), (b"\xef\xbb\xbfa", "a"), (b"\xe9", "é"), (b"", ""), (b"a\x00bcdefgh", "abcdefgh")])
def test_decode(raw, expected):
    assert documents.decode_bytes(raw) == expected


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(documents.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.96), None]


@pytest.mark.parametrize("score,a,b,expected", [
    (similarity.ratio, "abcd", "abxd", 75.0), (similarity.ratio, "", "", 100.0), (similarity.partial_ratio, "rest", "quiet rest now", 100.0), (similarity.token_sort_ratio, "rest quiet", "quiet rest", 100.0), (similarity.token_set_ratio, "rest", "quiet rest", 100.0), (similarity.token_set_ratio, "", "x", 0.0),
    (similarity.weighted_ratio, "rest", "rest", 100.0), (similarity.weighted_ratio, "rest quiet", "quiet rest", 95.0), (similarity.weighted_ratio, "rest", "quiet rest with closed eyes", 90.0), (similarity.weighted_ratio, "", "x", 0.0),
])
def test_scores(score, a, b, expected):
    assert score(a, b) == pytest.approx(expected)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_bit_parallel_and_bounded_scores(a, b):
    assert similarity.common_length(a, b) == lcs(a, b)
    short, long = sorted((a, b), key=len)
    if short:
        assert similarity.partial_ratio(a, b) == pytest.approx(max(similarity.ratio(short, long[max(0, s) : s + len(short)]) for s in range(1 - len(short), len(long))))
    full = similarity.weighted_ratio(a, b)
    assert similarity.weighted_ratio(a, b, 80.0) == (full if full >= 80 else 0.0)


def test_nulls(spark):
    df = spark.createDataFrame([(None, "a")], "a string, b string")
    assert rows(df.select(similarity.weighted_ratio_of("a", "b"), text.slug(F.col("a")), text.error_category(F.col("a")))) == [(None, None, "other")]
