import json

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from siftworks.plans import ranking, sqltext
from siftworks.plans.catalogue import PROJECTION, Catalogue, contains_text
from siftworks.plans.compiler import base, compile_plan, drop_vague, fallback_word, json_test, stem, summary
from siftworks.plans.plan import Cohort, Comparison, Family, MetadataFilter, QueryPlan, Scan, ScoredCode, from_json, to_json
from siftworks.plans.ranking import QueryCache, Search


class Small(Catalogue):
    """A catalogue of hand-built tables."""

    def __init__(self, spark, datasets, objects, participants):
        super().__init__(spark, "")
        for name, df in (("datasets", datasets), ("objects", objects), ("participants", participants)):
            self.__dict__[name] = df


@pytest.fixture(scope="module")
def cat(spark):
    d = [("a", "Sleep 100%", "x_y", ["Ann", "Bob"], None, "10.1/x", "CC0"), ("b", None, None, None, ["Grant"], "", None), ("c", "rest", "Sleep", [], [], None, "PDDL"), ("d", "z", "z", ["Cy"], None, "10.1/y", "CC0")]
    datasets = spark.createDataFrame(d, "id string, name string, description_text string, authors array<string>, funding array<string>, doi string, license string")
    for c in PROJECTION:
        if c not in datasets.columns:
            datasets = datasets.withColumn(c, F.array().cast("array<string>") if c == "institutions" else F.lit(None).cast("string"))
    o = [("1", "a", "s1", "01", "rest", "bold", "func", '{"TR": 2}'), ("1", "a", "s1", "01", "rest", "bold", "func", '{"TR": 2}'), ("2", "a", "s1", "02", None, "T1w", "anat", None), ("3", "a", "s2", "01", None, "T1w", "anat", '{"TR": "x"'), ("4", "b", None, None, "rest", "bold", "func", '{"TR": "1.5"}'), ("5", "c", "s1", None, None, "T1w", "anat", "{}"), ("6", "c", "s2", None, "rest", "bold", "func", '{"TR": null}')]
    p = [("p1", "a", "1", 30.0, "M", "hc"), ("p2", "a", "2", 40.0, "F", "hc"), ("p2", "a", "2", 40.0, "F", "hc"), ("p3", "c", "1", float("nan"), "F", "x_disorder"), ("p4", "c", "2", None, "M", None)]
    return Small(spark, datasets, spark.createDataFrame(o, "id string, dataset_id string, subject string, session string, task string, suffix string, datatype string, other_entities string"), spark.createDataFrame(p, "id string, dataset_id string, participant_id string, age double, sex string, diagnosis string").withColumns({"handedness": F.lit(None).cast("string"), "extra": F.lit(None).cast("string"), "crawled_at": F.lit(None).cast("timestamp")}))


def ids(plan, cat):
    return [r["id"] for r in base(plan, cat).select("id").orderBy("id").collect()]


@pytest.mark.parametrize("plan,expected", [
    (QueryPlan(Family.SCAN, scans=(Scan(task=("rest",)),)), ["a", "b", "c"]),
    (QueryPlan(Family.ABSENCE, scans=(Scan(datatype=("anat",), required=False),)), ["b", "d"]),
    (QueryPlan(Family.MULTIMODAL, scans=(Scan(datatype=("anat",)), Scan(datatype=("func",)))), ["a", "c"]),
    (QueryPlan(Family.SUBJECT_MULTIMODAL, scans=(Scan(datatype=("anat",), same_subject=True), Scan(datatype=("func",), same_subject=True))), ["a"]),
    (QueryPlan(Family.SCAN, scans=(Scan(task=("rest",), suffix=("T1w",), any_field=False),)), []),
    (QueryPlan(Family.SESSION, min_sessions=2), ["a"]),
    (QueryPlan(Family.AGE, cohorts=(Cohort(age_min=20),)), ["a"]),
    (QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(sex=("F",), min_participants=1),)), ["a", "c"]),
    (QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(diagnosis=("hc",), min_participants=3),)), []),
    (QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(sex=("M",)), Cohort(diagnosis=("x_disorder",))), cohort_operator="OR"), ["a", "c"]),
    (QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(sex=("M",)), Cohort(diagnosis=("x_disorder",)))), ["c"]),
    (QueryPlan(Family.COMPARISON, comparison=Comparison(Cohort(sex=("M",)), ">=", Cohort(sex=("F",)))), ["a", "c"]),
    (QueryPlan(Family.AUTHOR, authors=("Bob",)), ["a"]), (QueryPlan(Family.AUTHOR, authors=("Cy", "Bob")), ["a", "d"]), (QueryPlan(Family.FUNDING, funding=("Grant",)), ["b"]),
    (QueryPlan(Family.DOI, doi_required=True), ["a", "d"]), (QueryPlan(Family.DOI, doi_required=False), ["b", "c"]),
    (QueryPlan(Family.DESCRIPTION, name_search="100%"), ["a"]), (QueryPlan(Family.DESCRIPTION, name_search="0_%"), []), (QueryPlan(Family.DESCRIPTION, description_search="_"), ["a"]),
    (QueryPlan(Family.JSON_NUMERIC, metadata=(MetadataFilter("TR", ">=", 1.5),)), ["a", "b"]), (QueryPlan(Family.METADATA, metadata=(MetadataFilter("TR", "exists"),)), ["a", "b"]), (QueryPlan(Family.METADATA, metadata=(MetadataFilter("TR", "not_exists"),)), ["a", "c"]),
    (QueryPlan(Family.DESCRIPTION, unresolved=("the sleep",)), ["a", "c"]),
    (QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(diagnosis=("sleep_disorder",)),), disease_fallback=True), ["a", "c"]),
])
def test_families(cat, plan, expected):
    assert ids(plan, cat) == expected


def test_counts_keep_datasets_without_objects_and_skip_null_subjects(cat):
    out = compile_plan(QueryPlan(Family.RANKING, order_by="subject_count"), cat)
    assert out.columns == [*PROJECTION, "subject_count"]
    assert [(r["id"], r["subject_count"]) for r in out.collect()] == [("a", 2), ("c", 2), ("b", 0), ("d", 0)]
    assert [r["id"] for r in compile_plan(QueryPlan(Family.RANKING, order_by="name", descending=False, limit=2), cat).collect()] == ["a", "c"]
    assert compile_plan(QueryPlan(Family.RANKING, min_subjects=1), cat).count() == 2


def test_metrics(cat):
    got = {r["id"]: r["metric_value"] for r in compile_plan(QueryPlan(Family.AGGREGATE, metric="avg_age"), cat).collect()}
    assert got == {"a": 35.0, "b": None, "c": None, "d": None}


def test_relevance_and_pages(cat):
    plan = QueryPlan(Family.CONCEPT, scored=(ScoredCode("task", "rest", 0.4), ScoredCode("task", "rest", 0.7), ScoredCode("diagnosis", "hc", 0.2), ScoredCode("author", "Bob", 1.0)))
    search = Search(cat)
    key, first, counts = search.search(plan, 1, 3)
    assert [(r["id"], r["relevance_score"]) for r in first.collect()] == [("a", 0.9), ("c", 0.7), ("b", 0.7)]
    assert counts == {"total": 4, "page_count": 2, "has_more": True}
    second, counts = search.page(key, 2, 3)
    assert [r["id"] for r in second.collect()] == ["d"] and not counts["has_more"]
    assert ranking.participants_of(cat, first, 1).count() == 2


def test_cache_expires_and_is_capped():
    now = [0.0]
    cache = QueryCache(ttl=10, most=2, clock=lambda: now[0])
    for i, k in enumerate("abc"):
        now[0] = i
        cache.put(k, None)
    assert cache.get("a") is None and cache.get("b") and cache.get("c")
    now[0] = 11.5
    assert cache.get("b") is None and cache.get("c")
    with pytest.raises(KeyError):
        Search(None, cache).page("b")


@pytest.mark.parametrize("page,size,expected", [(None, None, (1, 20)), (0, 0, (1, 20)), (-3, 500, (1, 100)), (2, -1, (2, 1))])
def test_clamp(page, size, expected):
    assert ranking.clamp(page, size) == expected


@pytest.mark.parametrize("plan", [
    QueryPlan(Family.METADATA, metadata=(MetadataFilter("a", "~", 1),)), QueryPlan(Family.METADATA, metadata=(MetadataFilter("a", "exists", 1),)), QueryPlan(Family.METADATA, metadata=(MetadataFilter("a", "="),)), QueryPlan(Family.METADATA, metadata=(MetadataFilter("a'b", "exists"),)),
    QueryPlan(Family.SCAN, scans=(Scan(),)), QueryPlan(Family.RANKING, limit=0), QueryPlan(Family.AGGREGATE, metric="mode"), QueryPlan(Family.PARTICIPANT, cohort_operator="XOR"),
])
def test_invalid_plans(plan):
    with pytest.raises(ValueError):
        plan.validate()


def test_plans_survive_json():
    plan = QueryPlan(Family.COMBINED, cohorts=(Cohort(sex=("F",), extra=(MetadataFilter("bmi", ">", 25.0),)),), scans=(Scan(task=("rest",)),), comparison=Comparison(Cohort(), ">", Cohort(age_min=3)), scored=(ScoredCode("task", "rest", 0.5),))
    assert from_json(QueryPlan, json.loads(json.dumps(to_json(plan)))) == plan
    with pytest.raises(ValueError):
        from_json(QueryPlan, {"family": "doi_query", "sql": "x"})
    assert "rest" in summary(plan)


def test_words():
    assert fallback_word("a big elephant walks") == "elephant" and fallback_word("abc de") == "abc de" and stem("x_disorder") == "x" and stem("disorder") == "disorder"
    assert drop_vague(["Social", "rest"]) == ["rest"]


def test_json_tests(spark):
    df = spark.createDataFrame([(1, '{"v": "Siemens AG"}'), (2, '{"v": 3}'), (3, '{"v": "3.0"}'), (4, None), (5, '{"v": 3')], "i int, j string")
    hits = lambda t: [r["i"] for r in df.filter(json_test(F.col("j"), t)).orderBy("i").collect()]
    assert hits(MetadataFilter("v", "=", 3)) == [2, 3] and hits(MetadataFilter("v", "=", "siemens")) == [1] and hits(MetadataFilter("v", "not_exists")) == [4, 5] and hits(MetadataFilter("v", "!=", 4)) == [2, 3]


def test_like_escapes(spark):
    df = spark.createDataFrame([("a%b",), ("a_b",), ("a\\b",), ("axb",), (None,)], "s string")
    assert [rows(df.filter(contains_text(F.col("s"), t))) for t in ("a%B", "A_b", "a\\b")] == [[("a%b",)], [("a_b",)], [("a\\b",)]]


def test_filters_reach_the_scan(spark):
    plan = base(QueryPlan(Family.MULTIMODAL, scans=(Scan(datatype=("anat",)), Scan(datatype=("func",)))), Catalogue(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "datatype" in plan.split("PushedFilters")[-1] and "CartesianProduct" not in plan


@pytest.mark.parametrize("answer,sql", [("x\n[SQL] SELECT 1; [/SQL] y", "SELECT 1"), ("```sql\nWITH a AS (SELECT 1) SELECT * FROM a\n```", "WITH a AS (SELECT 1) SELECT * FROM a"), ("Here:\nSELECT 1\nFROM d\n\nDone.", "SELECT 1\nFROM d"), ("nothing", None), ("```\nls\n```", None)])
def test_sql_extraction(answer, sql):
    assert sqltext.extract(answer) == sql


@pytest.mark.parametrize("sql,expected", [
    ("SELECT 1 FROM d WHERE o.task = 'rest' AND d.doi IS NOT NULL", "SELECT 1 FROM d WHERE d.doi IS NOT NULL"), ("SELECT 1 FROM d WHERE (o.suffix = 'x') GROUP BY d.id", "SELECT 1 FROM d GROUP BY d.id"), ("SELECT 1 FROM d WHERE o.task IN ('x')", "SELECT 1 FROM d WHERE o.task IN ('x')"),
    ("SELECT 1 FROM d WHERE o.task = 'a' OR d.x = 1", "SELECT 1 FROM d WHERE o.task = 'a' OR d.x = 1"), ("SELECT 1 FROM d WHERE EXISTS (SELECT 1 FROM o WHERE o.task = 'a')", "SELECT 1 FROM d WHERE EXISTS (SELECT 1 FROM o WHERE o.task = 'a')"), ("SELECT 1 FROM d WHERE d.a BETWEEN 1 AND 2 AND o.task = 'a'", "SELECT 1 FROM d WHERE d.a BETWEEN 1 AND 2"),
    ("SELECT 1 FROM p WHERE p2.diagnosis = 'g'", "SELECT 1 FROM p WHERE p2.diagnosis IN ('a', 'b')"), ("SELECT 1 FROM p WHERE diagnosis NOT IN ('g', 'c')", "SELECT 1 FROM p WHERE diagnosis NOT IN ('a', 'b', 'c')"), ("SELECT 'task = ''g''' FROM p", "SELECT 'task = ''g''' FROM p"),
    ("SELECT 1 FROM o2 WHERE o2.task ILIKE '%Cognitive%'", "SELECT 1 FROM o2 WHERE TRUE"), ("SELECT 1 FROM o2 WHERE o2.task ILIKE '%film%'", "SELECT 1 FROM o2 WHERE o2.task IN ('f1', 'f2')"), ("SELECT 1 FROM d WHERE 'v' = ANY(d.authors)", "SELECT 1 FROM d WHERE array_contains(d.authors, 'v')"), ("SELECT 1 FROM d WHERE d.a && ARRAY['x','y'] AND TRUE", "SELECT 1 FROM d WHERE arrays_overlap(d.a, array('x', 'y')) AND TRUE"),
])
def test_sql_rewrites(sql, expected):
    assert sqltext.rewrite(sql, {"g": ["a", "b"]}, {"film": ["f1", "f2"]}).sql == expected


def test_sql_runs_with_bound_words(cat):
    got = sqltext.run("SELECT {{COLS}} FROM bids_datasets d WHERE d.doi IS NULL OR d.doi = '' ORDER BY d.name", cat, unresolved=["the Sleep", "it's%"])
    assert got.count() == 0
    got = sqltext.run("SELECT d.* FROM bids_datasets d LEFT JOIN bids_objects o ON o.dataset_id = d.id GROUP BY d.id HAVING COUNT(DISTINCT o.subject) >= 2", cat, unresolved=["sleep"])
    assert [(r["id"], r["subject_count"]) for r in got.orderBy("id").collect()] == [("a", 2), ("c", 2)]
    with pytest.raises(ValueError):
        sqltext.run("DROP TABLE x", cat)
