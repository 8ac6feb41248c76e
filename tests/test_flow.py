import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftworks.functions import similarity
from siftworks.operators import curation, evaluation, ingest, resolver, vectors
from siftworks.plans import ranking, requests
from siftworks.session import ensure_checkpoint_dir, small
from siftworks.sources import sinks
from siftworks.streaming import flows


def test_label_search_finds_what_all_pairs_give(spark):
    r = random.Random(1)
    words = ["rest", "quiet", "motor", "hand", "memory", "load", "a", "eyes", "closed", "pain"]
    phrase = lambda: " ".join(r.choice(words)[: r.randrange(1, 7)] for _ in range(r.randrange(1, 5)))
    texts, labels = {phrase() for _ in range(60)} | {""}, {phrase() for _ in range(90)}
    a, b = spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), spark.createDataFrame([(x,) for x in [*labels, None]], "label string")
    for least, block in ((80.0, 20_000), (60.0, 17)):
        expected = sorted((t, x, round(p, 6)) for t, x in itertools.product(texts, labels) if (p := similarity.weighted_ratio(t, x)) >= least)
        got = sorted((x["text"], x["label"], round(x["points"], 6)) for x in similarity.near_labels(a, b, least, block).collect())
        assert got == expected and len(got) > 20
    assert similarity.near_labels(a.limit(0), b, 80.0).count() == 0 and similarity.near_labels(a, b.limit(0), 80.0).count() == 0


def test_dictionary_match_equals_brute_force(spark):
    values = ["n-back task", "NBACK", "xnbacky", "rest", "re st", "stroopstroop", "abc", "", None, "flank"]
    entries = [("n back", "nback", 2), ("rest", "rest", 1), ("stroop", "stroop", 3), ("back", "other", 4), ("abc", "short", 5), (None, "none", 6), ("abcd", "x", 7)]
    got = dict(rows(curation.dictionary_match(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(entries, "pattern string, canonical string, position int"))))
    assert got == {"n-back task": "nback", "NBACK": "nback", "xnbacky": "nback", "rest": "rest", "re st": "rest", "stroopstroop": "stroop", "abc": "short"}


def test_examples_are_filled_up_and_asked_in_order(spark):
    examples = spark.createDataFrame([("motor task", "a", ["x"]), ("motor task", "b", ["y"]), ("rest scan", "b", None), ("zzz", "c", ["y"]), ("aaa", "c", [])], "question string, family string, codes array<string>")
    asked = spark.createDataFrame([(1, "a motor scan", "b", ["y"]), (2, None, "nothing", None)], "ask int, text string, family string, codes array<string>")
    got = rows(curation.ranked_examples(examples, asked, ["c"], 3).select("ask", "place", "question", "code_overlap", "word_overlap"))
    assert got == [(1, 1, "zzz", 1, 0), (1, 2, "rest scan", 0, 1), (1, 3, "motor task", 0, 1), (2, 1, "aaa", 0, 0), (2, 2, "zzz", 0, 0), (2, 3, "motor task", 0, 0)]
    assert curation.ranked_examples(examples.limit(0), asked, ["c"]).count() == 0 and curation.ranked_examples(examples, asked.limit(0), ["c"]).count() == 0


def test_order_of_work(spark):
    nodes = spark.createDataFrame([("k1", "b", ["x", "x"], "long description"), ("k2", "a", ["x", "y"], None), ("k3", "c", None, ""), ("k4", "a2", ["z"], "")], "key string, path string, accession_ids array<string>, description string")
    assert [r["key"] for r in curation.batch_order(nodes).collect()] == ["k2", "k4", "k1", "k3"]
    assert [r["key"] for r in curation.batch_order(nodes, 1, 2, by_text=True).collect()] == ["k2", "k4"]


def test_requests_are_merged_in_order(spark):
    given = [("scan", ["eeg", "mri"]), ("diagnosis", ["Patients ", "autism"]), ("scan", ["eeg", "pet"]), ("diagnosis", ["healthy"]), ("task", [])]
    assert requests.merge_requests(given) == {"scan": ["eeg", "mri", "pet"], "diagnosis": ["autism"]}
    log = [("q", i, f, t) for i, (f, t) in enumerate((f, t) for f, ts in given for t in ts)] + [("q", 9, "task", None), ("q", 9, None, "x"), ("q", 0, "scan", "eeg")]
    got = requests.merged_requests(spark.createDataFrame(log, "query string, position int, field string, term string"))
    assert rows(got) == [("q", "diagnosis", ["autism"]), ("q", "scan", ["eeg", "mri", "pet"])]


def test_scored_codes(spark):
    codes = spark.createDataFrame([("task", "a"), ("task", "a"), ("task", "b"), ("author", "c")], "field string, code string")
    scores = spark.createDataFrame([("task", "a", 0.4), ("task", "a", 0.7)], "field string, code string, score double")
    assert rows(requests.scored_codes(codes, scores)) == [("task", "a", 0.7), ("task", "b", 1.0)] and requests.scored_codes(codes, scores.limit(0)).count() == 0


def test_resolution_paths_and_the_other_resolver(spark):
    known = spark.createDataFrame([("n_back",), ("go nogo",)], "term string")
    labels = spark.createDataFrame([("resting state",)], "label string")
    terms = spark.createDataFrame([("N back",), ("go-nogo",), ("restin state",), ("zzz",), ("zzz",)], "term string")
    assert dict(rows(resolver.resolution_path(terms, known, labels))) == {"N back": "exact", "go-nogo": "exact", "restin state": "fuzzy", "zzz": "vector"}
    groups = spark.createDataFrame([("mri", ["mri", "fmri"])], "term string, codes array<string>")
    leaves = spark.createDataFrame([("mri", "mri"), ("fmri", "fmri")], "term string, code string")
    display = spark.createDataFrame([("mri", "mri", 1.0), ("functional mri", "fmri", 1.0)], "term string, code string, weight double")
    paths = spark.createDataFrame([("fmri", ["fmri", "mri"]), ("mri", ["mri"])], "code string, path array<string>")
    asked = spark.createDataFrame([("f", "MRI"), ("f", "functionl mri"), ("g", "mri")], "field string, term string")
    assert rows(resolver.alternate(asked, groups, leaves, display, paths, "field")) == [("f", "fmri"), ("g", "mri")]


def test_pipeline_metrics(spark):
    names = list(evaluation.OUTCOMES)
    df = spark.createDataFrame([("Task", *[i % 2 == 0 for i in range(len(names))]), ("Task", *[True] * len(names)), (None, *[None] * len(names))], f"category string, {', '.join(f'{n} boolean' for n in names)}")
    got = {r["category"]: r for r in evaluation.pipeline_metrics(df).collect()}
    assert got["Task"]["pass_pct"] == 1.0 and got["Task"]["zero_result_pct"] == 0.5 and got["Other"]["pass_pct"] == 0.0 and got["Overall"]["n"] == 3 and got["Overall"]["pass_pct"] == 0.667


def test_checkouts_and_stored_answers(spark):
    listing = spark.createDataFrame([("100644 blob ab12     7\tdataset description.json",), ("120000 blob ab13    99\tsub-01/x.nii.gz",), ("160000 commit ab14       -\tcode",), ("nonsense",), (None,)], "value string")
    assert rows(ingest.checkout_manifest(listing)) == [("dataset description.json", 7, True), ("sub-01/x.nii.gz", None, False)]
    answers = spark.createDataFrame([('{"data": {"dataset": {"id": "ds1", "metadata": {"datasetName": "A", "authors": ["x"], "sex": {"maleCount": 2}}}}}',), ('{"data": {"dataset": null}}',), ("{",), (None,)], "answer string")
    r = ingest.answered_datasets(answers).collect()
    assert [(x["id"], x["name"], x["authors"], x["males"], x["females"]) for x in r] == [("ds1", "A", ["x"], 2, None)]


def test_merges_touch_the_buckets_of_the_batch_only(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = flows.merge_into(path, ["k"], ["v"], 16)
    merge(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    one = spark.createDataFrame([(7, 2), (500, 3)], "k long, v int")
    merge(one, 1)
    merge(one, 1)
    got = dict(rows(spark.read.parquet(path).select("k", "v")))
    assert len(got) == 201 and got[7] == 2 and got[500] == 3 and got[8] == 1
    kept = {p for p in (tmp_path / "t").rglob("*.parquet")} & before.keys()
    assert len(kept) >= len(before) - 2


def test_pages_are_kept_and_fetched_with_their_neighbours(spark):
    class Cat:
        pass

    cache = ranking.QueryCache(most=2)
    search = ranking.Search(Cat(), cache)
    cache.put("k", spark.range(25).orderBy("id"))
    page, counts = search.page("k", 2, 10)
    assert [r[0] for r in page.collect()] == list(range(10, 20)) and counts == {"total": 25, "page_count": 3, "has_more": True}
    assert set(cache.get("k").pages) == {(1, 10), (2, 10), (3, 10)} and cache.get("k").ranked.storageLevel.useMemory
    assert [r[0] for r in search.page("k", 3, 10)[0].collect()] == list(range(20, 25))
    held = cache.get("k").ranked
    cache.put("k", spark.range(3))
    assert not held.storageLevel.useMemory and search.page("k", 9, 10)[0].count() == 0


def test_reports_and_bounds(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "k string, n int, s string")
    sinks.write_report(df, str(tmp_path / "r"), "text")
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a: 1, x", "b: 2, -"]
    with pytest.raises(ValueError):
        sinks.write_report(df, str(tmp_path / "r"), "html")
    assert "broadcast" in small(df)._jdf.queryExecution().logical().toString().lower() or small(df) is not df
    assert small(df, most=1) is df


def test_checkpoint_folder_must_be_named_off_local_masters():
    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_vectors_of_other_groups_never_meet(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], "g" if i < 6 else None if i == 6 else f"h{i}") for i in range(12)], "id long, vector array<double>, group string")
    got = vectors.pairs_above(df, 0.9, size=2).select("id_a", "id_b")
    assert rows(got) == sorted(itertools.combinations(range(6), 2)) and vectors.packed(df, 2).filter("size(ids) > 6").count() == 0
