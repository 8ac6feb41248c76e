import json

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from siftworks.operators import curation, evaluation, ingest, resolver, vocabulary
from siftworks.sources import files, sinks
from siftworks.streaming import flows

TREE = {
    "memory": {"label": "Memory", "standard_code": "memory_general", "synonyms": ["remembering"]},
    "wm": {"label": "Working memory", "standard_code": "wm", "broader": ["memory"], "synonyms": [{"term": "WM", "weight": 0.9}, {"term": "motor task", "weight": 2}], "codes": ["nback", "WM2"]},
    "span": {"label": "Span", "standard_code": "span", "broader": ["wm"], "part_of": ["loop"], "dataset_codes": [{"raw": "Z1", "accession_ids": ["ds1"]}]},
    "loop": {"label": "Loop", "broader": ["span"]},
    "stray": {"label": "", "standard_code": "stray", "broader": ["gone"], "synonyms": []},
}


@pytest.fixture(scope="module")
def concepts(spark):
    from siftworks.operators.vocabulary import CONCEPT

    return spark.createDataFrame(files.vocabulary_rows([{"task": TREE}], "task"), CONCEPT).cache()


def test_closure_ends_on_cycles_and_contains_itself(concepts):
    got = rows(vocabulary.closure(vocabulary.edges(concepts)).select("ancestor", "descendant", "depth"))
    assert {("memory", "loop", 3), ("memory", "span", 2), ("loop", "span", 1), ("span", "loop", 1), ("span", "span", 0), ("wm", "loop", 2)} <= set(got)
    reach = {(a, b) for a, b, _ in got}
    assert {b for a, b in reach if a == "memory"} == {"memory", "wm", "span", "loop"} and {b for a, b in reach if a == "loop"} == {"loop", "span"}


def test_terms_groups_and_paths(concepts):
    reach = vocabulary.closure(vocabulary.edges(concepts))
    leaves = dict(rows(vocabulary.leaf_terms(concepts)))
    assert leaves["nback"] == "wm" and leaves["z1"] == "span" and leaves["memory_general"] == "memory_general"
    display = {t: (c, w) for t, c, w in rows(vocabulary.display_terms(concepts))}
    assert display["wm"] == ("wm", 0.9) and display["motor task"] == ("wm", 1.0) and "" not in display
    groups = dict(rows(vocabulary.group_terms(concepts, reach)))
    assert groups["memory"] == ["memory_general", "span", "wm"] and groups["wm"] == ["span", "wm"]
    paths = dict(rows(vocabulary.ancestor_paths(concepts, reach)))
    assert paths["span"] == ["span", "wm", "memory_general"]
    codes = concepts.sparkSession.createDataFrame([("q", "span"), ("q", "wm"), ("q", "stray"), ("r", "wm")], "g string, code string")
    assert rows(vocabulary.prune_parents(codes, vocabulary.ancestor_paths(concepts, reach), "g")) == [("q", "span"), ("q", "stray"), ("r", "wm")]
    assert rows(vocabulary.broken_parents(concepts)) == [("gone", "stray")] and rows(vocabulary.without_terms(concepts)) == [("stray",)]
    assert {r["node"]: r["depth"] for r in vocabulary.depths(vocabulary.edges(concepts)).collect()} == {"memory": 0, "wm": 1, "span": 0, "loop": 0, "gone": 0, "stray": 1}


def test_vocabulary_edits(spark, concepts):
    s = "key string, term string, weight double"
    old, new = spark.createDataFrame([("k", "A", 0.5), ("j", "B", 1.0)], s), spark.createDataFrame([("k", "a", 1.0), ("k", "C", 3.0)], s)
    assert rows(vocabulary.merged_synonyms(old, new)) == [("j", "B", 1.0), ("k", "A", 0.5), ("k", "C", 1.0)] and rows(vocabulary.merged_synonyms(old, new, True)) == [("j", "B", 1.0), ("k", "C", 1.0), ("k", "a", 1.0)]
    assert rows(vocabulary.without_listed(old, new).select("key", "term")) == [("j", "B")]
    assert rows(vocabulary.unique_slugs(spark.createDataFrame([("A b", 1), ("a-b", 2), ("c", 3)], "name string, position int")).select("slug")) == [("a_b",), ("a_b_1",), ("c",)]
    everywhere, scoped = vocabulary.rewrites(concepts)
    assert rows(everywhere) == [("nback", "wm"), ("wm2", "wm")] and rows(scoped) == [("z1", "span", ["ds1"])]
    out, stats = vocabulary.apply_decisions(TREE, [{"action": "filter"}, {"action": "add_to_codes", "raw": "nb", "target": "wm"}, {"action": "add_to_codes", "raw": "NB", "target": "span"}, {"action": "add_to_dataset_codes", "raw": "z1", "target": "span", "accession_ids": ["ds2"]}, {"action": "new_entry", "raw": "q", "target": "quiz"}, {"action": "new_entry_scoped", "raw": "q", "target": "quiz", "accession_ids": ["ds1"]}])
    assert stats == {"filter": 1, "add_to_codes": 1, "skipped": 2, "add_to_dataset_codes": 1, "new_entry": 1} and out["span"]["dataset_codes"][0]["accession_ids"] == ["ds1", "ds2"] and "nb" not in TREE["wm"]["codes"]
    nodes, links = vocabulary.graph(concepts)
    assert nodes.count() == 5 and links.filter("parent = 'hub'").count() >= 1


def test_nested_vocabularies():
    flat = files.nested_concepts({"a": {"label": "A", "b": {"label": "B"}, "c": {"b": {"label": "again"}, "a": {"d": {"label": "D"}}}}})
    assert flat["b"] == {"label": "B", "broader": ["a"]} and flat["a_group"]["broader"] == ["c"] and flat["d"]["broader"] == ["a_group"]


def test_resolution(spark, concepts):
    reach = vocabulary.closure(vocabulary.edges(concepts))
    groups, leaves, display = vocabulary.group_terms(concepts, reach), vocabulary.leaf_terms(concepts), vocabulary.display_terms(concepts)
    terms = spark.createDataFrame([("Memorys",), ("nback",), ("workin memory",), ("zzz",), ("",)], "term string")
    got = {(r["term"], r["code"]): (r["path"], round(r["score"], 2)) for r in resolver.resolve(terms, groups, leaves, display).collect()}
    assert got["nback", "wm"] == ("exact", 1.0) and {c for t, c in got if t == "Memorys"} == {"memory_general", "wm", "span"} and got["workin memory", "span"][0] == "fuzzy"
    assert rows(resolver.unresolved(terms, resolver.resolve(terms, groups, leaves, display))) == [("",), ("zzz",)]
    vectors = spark.createDataFrame([("zzz", [1.0, 0.0])], "term string, vector array<double>"), spark.createDataFrame([(1, "far", [0.0, 1.0]), (2, "near", [0.7, 0.7]), (1, "mid", [0.6, 0.8])], "tier int, code string, vector array<double>")
    assert rows(resolver.nearest_vectors(*vectors).select("term", "code")) == [("zzz", "near")]
    listed = spark.createDataFrame([("Smith John A",), ("Doe Jane",)], "name string")
    assert rows(resolver.names(spark.createDataFrame([("john smith",)], "term string"), listed).select("name", "score")) == [("Smith John A", 1.0)]
    measures = spark.createDataFrame([("wm", "nback_task"), ("span", "digit_task")], "construct string, task_code string")
    assert rows(resolver.bridge(spark.createDataFrame([("Working memory",)], "term string"), resolver.pool(display, groups), measures)) == [("Working memory", "digit_task", 1.0), ("Working memory", "nback_task", 1.0)]
    assert rows(resolver.live_and_missing(spark.createDataFrame([("a",), ("b",)], "code string"), spark.createDataFrame([("a",), (None,)], "t string"), "t")) == [("a", True), ("b", False)]


def test_low_weight_labels_spread(spark):
    display = spark.createDataFrame([("motor task", "som", 0.1), ("simple motor task", "s1", 1.0), ("hand motor task", "s2", 1.0)], "term string, code string, weight double")
    groups = spark.createDataFrame([], "term string, codes array<string>")
    got = resolver.fuzzy(spark.createDataFrame([("motor tasks",)], "term string"), resolver.pool(display, groups))
    assert {r["code"] for r in got.collect()} == {"s1", "s2"} or {r["code"] for r in got.collect()} >= {"som"}


def test_curation(spark):
    data = spark.createDataFrame([("Ctrl", "x"), ("ctrl", "y"), ("MDD", "x"), (None, "x"), ("", "x"), ("f12", "z")], "v string, ds string")
    mapping = curation.first_rewrite(spark.createDataFrame([("CTRL", "healthy", 1), ("ctrl", "other", 2)], "raw string, canonical string, position int"))
    assert rows(mapping) == [("ctrl", "healthy")] and rows(curation.canonicalise(data, "v", mapping), "v").count(("healthy",)) == 2
    scoped = spark.createDataFrame([("mdd", "depression", ["x"]), ("ctrl", "only_y", ["y"])], "raw string, canonical string, accession_ids array<string>")
    assert rows(curation.canonicalise_scoped(data, "v", "ds", scoped), "v") == sorted([("Ctrl",), ("only_y",), ("depression",), (None,), ("",), ("f12",)], key=repr)
    assert rows(curation.rewrite_counts(data, "v", mapping)) == [("ctrl", "healthy", 2)] and rows(curation.unmapped(data, "v", mapping.select("raw"))) == [("MDD",), ("f12",)]
    states = spark.createDataFrame([("ctrl", "ctrl"), ("mdd", None)], "raw string, canonical string")
    assert dict(rows(curation.mapping_states(data, "v", states))) == {"mapped": 1, "pass-through": 1, "filtered": 1, "unknown": 1}
    assert rows(curation.coverage(spark.createDataFrame([("mdd",), ("none",)], "code string"), data, "v")) == [("mdd", True), ("none", False)] and rows(curation.junk_counts(data, "v")) == [("f{number}", 1, ["f12"])]
    assert rows(curation.value_sources(data, "v", "ds", 1).filter("value = 'Ctrl'")) == [("Ctrl", ["x"], 1)]
    terms = spark.createDataFrame([("f", "a", "Quiet rest", "label", 1.0), ("f", "b", "rest quiet", "synonym", 1.0), ("g", "c", "quiet rest", "synonym", 1.0)], "field string, key string, term string, kind string, weight double")
    assert rows(curation.fuzzy_collisions(terms), "source_key", "target_key", "severity") == [("b", "a", "HIGH")]
    weights = curation.synonym_weights(spark.createDataFrame([("k", "aa"), ("n", "x")], "key string, term string"), spark.createDataFrame([("k", "AA aa"), ("k", "none")], "key string, text string"))
    assert rows(weights) == [("k", "aa", 0.48), ("n", "x", 0.5)]
    lines = spark.createDataFrame([(1, 5, "[FAIL] ds000002 | JSON broke | indexed=0"), (1, 3, "[crawler] Error indexing ds000002: timeout"), (1, 1, "[FAIL] ds000003 | Access Denied | indexed=0")], "job int, line_no int, line string")
    assert rows(curation.first_errors(lines)) == [(1, "ds000002", "timeout", "timeout")]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "t", "v", ["x", "y"]), ("b", "t", "w", ["z"])], "term string, field string, variant string, expected array<string>")
    judged = evaluation.judged(truth, spark.createDataFrame([("a", "t", ["x", "q", "y"])], "term string, field string, codes array<string>"))
    assert rows(judged, "term", "hit_at_1", "recall_at_3", "passed") == [("a", 1.0, 1.0, 1.0), ("b", 0.0, 0.0, 0.0)]
    assert rows(evaluation.by_group(judged, "variant", ["hit_at_1"])) == [("overall", 2, 0.5), ("v", 1, 1.0), ("w", 1, 0.0)]
    assert rows(evaluation.calibration(spark.createDataFrame([(0.5, True), (1.0, False), (None, True)], "c double, ok boolean"), "c", "ok")) == [("[0.5,0.7)", 1, 1.0), ("[0.9,1.0]", 1, 0.0), ("unmatched", 1, 1.0)]


def test_contradictions(spark):
    codes = spark.createDataFrame([("datatype", "ieeg"), ("suffix", "eeg")], "field string, code string")
    rules = spark.createDataFrame([("soft1", "soft", "m", "trigger", "datatype", ["ieeg"]), ("soft1", "soft", "m", "incompatible", "suffix", ["eeg"]), ("hard1", "hard", "m", "trigger", "suffix", ["*"]), ("hard1", "hard", "m", "incompatible", "datatype", ["ieeg"]), ("no", "hard", "m", "trigger", "task", ["*"]), ("no", "hard", "m", "incompatible", "suffix", ["eeg"])], "rule_id string, severity string, message string, role string, field string, codes array<string>")
    assert [r["rule_id"] for r in resolver.contradictions(codes, rules).collect()] == ["hard1", "soft1"]


def test_ingest(spark):
    manifest = spark.createDataFrame([("a/x.nii.gz", 1), ("a/y.JSON", 1), ("a/._z.json", 1), ("README", 1)], "path string, size int")
    assert rows(ingest.classify(manifest), "extension", "action") == [("", "stub"), (".JSON", "content"), (".json", "skip"), (".nii.gz", "stub")]
    assert rows(ingest.accessions(spark.createDataFrame([("ds000001/",), ("ds1/",), ("ds000001/",)], "prefix string"))) == [("ds000001",)]
    assert ingest.accession_list(" a, ,b ") == ["a", "b"] and ingest.accession_list("", {"accessions": ["c"]}) == ["c"] and ingest.accession_list(None) == []
    counts = spark.createDataFrame([("d", 1, None, 2), ("e", 0, 0, 0)], "dataset_id string, males int, females int, others int")
    assert rows(ingest.synthetic_participants(counts)) == [("d", "sub-001", "M"), ("d", "sub-002", "O"), ("d", "sub-003", "O")]
    tasks = spark.createDataFrame([("d", ["a", "b"], ["x", "EEG"]), ("e", ["c"], None), ("f", [], ["mri"])], "dataset_id string, tasks array<string>, modalities array<string>")
    assert rows(ingest.stub_objects(tasks), "dataset_id", "task", "datatype") == [("d", "a", "eeg"), ("d", "b", "eeg"), ("e", "c", "func")]
    old, new = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k")], "id string, n int, keep string"), spark.createDataFrame([("b", 5), ("c", 6), ("c", 7)], "id string, n int")
    assert rows(ingest.upsert(old, new, ["id"], ["n"])) == [("a", 1, "k"), ("b", 5, "k"), ("c", 7, None)]
    assert rows(ingest.upsert(old, new.limit(0), ["id"], ["n"])) == rows(old) and rows(ingest.pending(old, new, "id").select("id")) == [("a",)]
    raw = spark.createDataFrame([("a", "n" * 400, '{"Authors": "Ann", "License": " ", "DatasetDOI": "10.1/x"}', "see http://a")], "id string, name string, description string, readme string")
    r = ingest.dataset_row(raw).first()
    assert (len(r["name"]), r["authors"], r["license"], r["doi"], r["paper_references"]) == (300, ["Ann"], None, "10.1/x", ["http://a"])
    objects = spark.createDataFrame([("d", '{"InstitutionName": " U "}'), ("d", '{"InstitutionName": ""}'), ("e", None)], "dataset_id string, other_entities string")
    assert rows(ingest.institutions(objects)) == [("d", ["U"])]


def test_files(spark, tmp_path):
    (tmp_path / "v.yaml").write_text("task:\n  k: {label: K, standard_code: k, synonyms: [a, {term: b, weight: 0.5}]}\n")
    (tmp_path / "w.yaml").write_text("task:\n  k: {label: K2, standard_code: k}\n  l: {label: L}\n")
    assert rows(files.read_vocabulary(spark, [str(tmp_path / "v.yaml"), str(tmp_path / "w.yaml")], "task"), "key", "label") == [("k", "K2"), ("l", "L")]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "t.jsonl"), "a int, b string")) == [(1, None), (2, None)]
    (tmp_path / "o.json").write_text(json.dumps({"x": ["y"], "z": "w"}))
    assert rows(files.read_json_object(spark, str(tmp_path / "o.json"))) == [("x", '["y"]'), ("z", "w")]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "crawl_7.log").write_text("a\nb")
    (logs / "crawl_12.log").write_text("c")
    (logs / "other_1.log").write_text("d")
    assert rows(files.read_logs(spark, str(logs))) == [(12, 0, "c"), (7, 0, "a"), (7, 1, "b")] and rows(files.read_logs(spark, str(logs), 8)) == [(12, 0, "c")]
    df = spark.createDataFrame([(["a", ""], '["b"]', 1)], "l array<string>, j string, n int")
    assert rows(files.array_elements(df, "l")) == [("a",)] and rows(files.array_elements(df, "j")) == [("b",)]
    with pytest.raises(TypeError):
        files.array_elements(df, "n")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(sinks.current_table(spark, path).filter("id > 0"), path, backup=True)
    assert sinks.current_table(spark, path).count() == 2 and sinks.previous_table(spark, path).count() == 3
    before = sinks.current_table(spark, path)
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert sinks.current_table(spark, path).count() == 2 and before.count() == 2
    sinks.replace_table(spark.range(9), path)
    assert sinks.current_table(spark, path).count() == 9 and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 1
    sinks.append_log(spark.range(1), str(tmp_path / "log"))
    sinks.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).filter("ts IS NOT NULL").count() == 2
    done = str(tmp_path / "done")
    step = lambda w: w.withColumn("r", F.lit(1))
    assert [sinks.resume(spark.range(n), done, "id", step) for n in (2, 5, 5)] == [2, 3, 0] and spark.read.parquet(done).count() == 5


def test_streams(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    source = flows.file_stream(spark, DATA, "events.parquet", schema)
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))

    def finish(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert rows(finish(flows.window_counts(source), "w1", "complete")) == rows(flows.window_counts(batch))
    assert rows(finish(flows.running_counters(source), "w2", "complete")) == rows(flows.running_counters(batch))
    closed = finish(flows.sessions(source), "w3", "append")
    assert 0 < closed.count() <= flows.sessions(batch).count()
    path = str(tmp_path / "merged")
    q = source.writeStream.foreachBatch(flows.merge_into(path, ["user_id"], ["value", "event_id"])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.read.parquet(path).count() == batch.select("user_id").distinct().count()


def test_expiring_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = flows.file_stream(spark, DATA, "events.parquet", spark.read.parquet(f"{DATA}/events.parquet").schema)
    q = flows.expiring_counts(source).writeStream.format("memory").queryName("x1").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "x1")).start()
    q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    expected = rows(spark.read.parquet(f"{DATA}/events.parquet").groupBy("user_id").agg(F.count("*").alias("used")))
    assert rows(spark.table("x1")) == expected


def test_quota(spark):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00")] * 3 + [(2, "2024-01-01 10:00:00")] * 3 + [(1, "2024-01-02 00:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(flows.daily_quota(e, 2, [2]), "user_id", "used", "rejected") == [(1, 1, 0), (1, 3, 1), (2, 3, 0)]
    lines = spark.createDataFrame([("[FAIL] ds1 | json | indexed=0",), ("[crawler] Error indexing ds2: embargoed",), ("ok",)], "value string")
    assert rows(flows.classified_errors(lines)) == [("ds1", "json", "JSON decode")]
