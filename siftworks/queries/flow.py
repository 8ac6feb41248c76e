"""Sources, sinks, requests, vocabulary edits, resolution, caches and cycles as queries over the tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions import documents, text
from siftworks.operators import curation, evaluation, ingest, resolver, vocabulary
from siftworks.plans import ranking, requests, sqltext
from siftworks.plans.catalogue import Catalogue
from siftworks.plans.compiler import compile_plan, summary
from siftworks.plans.plan import Cohort, Family, QueryPlan, Scan
from siftworks.queries.curation import _COS, _lookups, _terms, concepts
from siftworks.queries.search import _D, _listed, _spelt, _sql
from siftworks.session import ensure_checkpoint_dir, table
from siftworks.sources import files, sinks
from siftworks.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A fresh folder where all executors can reach it."""
    return f"{ensure_checkpoint_dir(spark)}/queries-{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------------------------------------------------


@_query("SELECT standard_code AS key, CASE WHEN term_id % 2 = 0 THEN upper(label) ELSE label END AS label, standard_code, array_to_string(synonyms, '|') AS synonyms FROM vocab_terms WHERE field_name = 'task'")
def src2_yaml_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary written as two YAML files, the second one overriding entries of the first, and read back."""
    import yaml

    rows = table(spark, d, "vocab_terms").filter("field_name = 'task'").collect()
    entry = lambda r, label: {"label": label, "standard_code": r["standard_code"], "synonyms": list(r["synonyms"])}
    first = {"task": {r["standard_code"]: entry(r, r["label"]) for r in rows}}
    second = {"task": {r["standard_code"]: entry(r, r["label"].upper()) for r in rows if r["term_id"] % 2 == 0}}
    paths = [f"{_folder(spark)}/{i}.yaml" for i in (1, 2)]
    for path, doc in zip(paths, (first, second)):
        sinks.write_text(spark, path, yaml.safe_dump(doc, allow_unicode=True))
    return files.read_vocabulary(spark, paths, "task").select("key", "label", "standard_code", F.array_join(F.transform("synonyms", lambda s: s["term"]), "|").alias("synonyms"))


@_query("SELECT item_id, suite, item_text FROM eval_items")
def src3_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    items = table(spark, d, "eval_items")
    items.select(F.explode(F.array(F.to_json(F.struct("item_id", "suite", "item_text")), F.lit(""))).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "item_id long, suite string, item_text string")


@_query("SELECT field_name || ':' || standard_code AS key, label AS value FROM vocab_terms")
def src4_json_object(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/index.json"
    rows = table(spark, d, "vocab_terms").collect()
    sinks.write_text(spark, path, json.dumps({f"{r['field_name']}:{r['standard_code']}": r["label"] for r in rows}))
    return files.read_json_object(spark, path)


@_query("SELECT n_regionkey AS job, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line_no, n_name AS line FROM nation WHERE n_regionkey >= 1")
def src5_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log files with a job number in their name, from job 1 on."""
    path = _folder(spark)
    jobs = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n")).collect()
    for r in jobs:
        sinks.write_text(spark, f"{path}/crawl_{r['n_regionkey']}.log", "\n".join(n["n_name"] for n in r["n"]))
    return files.read_logs(spark, path, since=1).select(F.col("job").cast("long").alias("job"), F.col("line_no").cast("long").alias("line_no"), "line")


@_query("SELECT DISTINCT id, name, doi, license, array_to_string(authors, '|') AS authors, len(name) AS males FROM bids_datasets")
def src8_stored_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a dataset service, stored as JSON, with some that hold no dataset."""
    b = table(spark, d, "bids_datasets")
    metadata = F.struct(F.col("name").alias("datasetName"), F.col("doi").alias("datasetDOI"), "license", "authors", F.struct(F.length("name").alias("maleCount")).alias("sex"))
    answer = F.to_json(F.struct(F.struct(F.struct("id", metadata.alias("metadata")).alias("dataset")).alias("data")))
    answers = b.select(F.explode(F.array(answer, F.lit('{"data": {"dataset": null}}'), F.lit('{"errors": ['))).alias("answer"))
    return ingest.answered_datasets(answers).select("id", "name", "doi", "license", F.array_join("authors", "|").alias("authors"), F.col("males").cast("long").alias("males")).distinct()


@_query("SELECT DISTINCT 'sub/' || id || extension AS path, CASE WHEN extension IN ('.json', '.tsv') THEN length(id) END AS size, extension IN ('.json', '.tsv') AS kept FROM bids_objects WHERE extension IS NOT NULL")
def src9_checkout(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a repository from its tree listing: content files beside links to annexed ones, and a folder that is no file."""
    o = table(spark, d, "bids_objects").filter("extension IS NOT NULL")
    kept = F.col("extension").isin(".json", ".tsv")
    blob = F.concat(F.when(kept, "100644").otherwise("120000"), F.lit(" blob "), F.md5("id"), F.lpad(F.length("id").cast("string"), 8, " "), F.lit("\tsub/"), F.col("id"), F.col("extension"))
    folder = F.concat(F.lit("040000 tree "), F.md5("id"), F.lit("       -\tsub/"), F.col("id"))
    return ingest.checkout_manifest(o.select(F.explode(F.array(blob, folder)).alias("value"))).select("path", "size", "kept").distinct()


@_query("SELECT n_regionkey AS setting, n_name AS accession FROM nation")
def src10_settings(spark: SparkSession, d: str) -> DataFrame:
    setting = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("setting")).agg(F.concat(F.lit(" , "), F.array_join(F.collect_list("n_name"), " ,, "), F.lit(" , ")).alias("value"))
    return setting.select("setting", F.explode(ingest.listed(F.col("value"))).alias("accession"))


# --- sinks ------------------------------------------------------------------------------------------------------------


@_query("SELECT 'new' AS version, s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'old', s_suppkey FROM supplier")
def snk2_replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced by a part of itself, with the version before kept."""
    path = _folder(spark)
    sinks.replace_table(table(spark, d, "supplier"), path)
    sinks.replace_table(sinks.current_table(spark, path).filter("s_acctbal > 0"), path, backup=True)
    return sinks.current_table(spark, path).select(F.lit("new").alias("version"), "s_suppkey").unionByName(sinks.previous_table(spark, path).select(F.lit("old").alias("version"), "s_suppkey"))


@_query("SELECT n_nationkey, true AS stamped FROM nation")
def snk3_audit_log(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    n = table(spark, d, "nation").select("n_nationkey")
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        sinks.append_log(n.filter(part), path)
    return spark.read.schema("n_nationkey long, ts string").json(path).select("n_nationkey", F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))


@_query("SELECT field_name || ': ' || count(*) || ', ' || sum(len(synonyms)) AS line FROM vocab_terms GROUP BY field_name")
def snk5_report(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    counts = table(spark, d, "vocab_terms").groupBy("field_name").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("synonyms")).alias("synonyms"))
    sinks.write_report(counts, path, "text")
    return spark.read.text(path).select(F.col("value").alias("line"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as concepts of three levels."""
    none = F.lit(None).cast("array<string>")
    rows = [(table(spark, d, "region"), F.concat(F.lit("r"), "r_regionkey"), "r_name", none), (table(spark, d, "nation"), F.concat(F.lit("n"), "n_nationkey"), "n_name", F.array(F.concat(F.lit("r"), "n_regionkey"))), (table(spark, d, "supplier"), F.concat(F.lit("s"), "s_suppkey"), "s_name", F.array(F.concat(F.lit("n"), "s_nationkey")))]
    out = None
    for df, key, label, broader in rows:
        part = df.select(key.alias("key"), F.col(label).alias("label"), broader.alias("broader"), none.alias("part_of"))
        out = part if out is None else out.unionByName(part)
    return out


_PLACES = "p AS (SELECT 'r' || r_regionkey AS key, r_name AS label, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 2 FROM supplier)"


@_query(f"""WITH {_PLACES} SELECT '{{"key":"' || key || '","label":"' || label || '","depth":' || depth || '}}' AS node FROM p""")
def snk6_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    vocabulary.graph(_places(spark, d))[0].select("key", "label", "depth").write.json(path)
    return spark.read.text(path).select(F.col("value").alias("node"))


@_query("SELECT 'hub' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier")
def on12_graph_links(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.graph(_places(spark, d))[1].select("parent", "child")


@_query("SELECT n_nationkey, true AS loaded_now FROM nation")
def dt2_load_times(spark: SparkSession, d: str) -> DataFrame:
    loaded = sinks.stamped(table(spark, d, "nation"), "loaded_at").withColumn("t", F.to_timestamp("loaded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return loaded.select("n_nationkey", F.col("t").between(F.current_timestamp() - F.expr("interval 1 hour"), F.current_timestamp() + F.expr("interval 1 hour")).alias("loaded_now"))


@_query("SELECT DISTINCT family, 'SELECT ' || family AS question FROM (SELECT DISTINCT dataset_type AS family FROM bids_datasets WHERE dataset_type IS NOT NULL)")
def ss7_query_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of questions, one appended per kind of dataset, read back."""
    path = _folder(spark)
    asked = table(spark, d, "bids_datasets").select(F.col("dataset_type").alias("family")).filter("family IS NOT NULL").distinct().withColumn("question", F.concat(F.lit("SELECT "), "family"))
    sinks.append_log(asked, path)
    return spark.read.schema("family string, question string, ts string").json(path).filter("ts IS NOT NULL").select("family", "question")


# --- shapes, rewriting, requests ----------------------------------------------------------------------------------------

_JSON = "CASE WHEN json_valid(other_entities) THEN other_entities END"


@_query(f"SELECT DISTINCT id, json_extract_string({_JSON}, '$.Manufacturer') AS \"Manufacturer\", json_extract_string({_JSON}, '$.dir') AS dir, CAST(NULL AS VARCHAR) AS absent FROM bids_objects")
def prj4_shaped_members(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "bids_objects")
    return o.select("id", documents.shaped(F.col("other_entities"), ["Manufacturer", "dir", "absent"]).alias("x")).select("id", "x.*").distinct()


def _text_plan(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return sqltext.run(sql, Catalogue(spark, d)).select("id", "subject_count")


_SUBJECTS = f"WITH {_D} SELECT d.id, coalesce(sc.n, 0) AS subject_count FROM d LEFT JOIN sc ON sc.dataset_id = d.id WHERE "


@_query(_SUBJECTS + "EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND o.datatype = 'eeg')")
def flt13_vague_words(spark: SparkSession, d: str) -> DataFrame:
    """A test for a task word that names no task is no test."""
    return _text_plan(spark, d, "SELECT {{COLS}} FROM bids_datasets d WHERE EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND o.datatype = 'eeg' AND o.task ILIKE '%Cognitive%')")


@_query(_SUBJECTS + "d.doi IS NOT NULL")
def flt15_outer_tests(spark: SparkSession, d: str) -> DataFrame:
    """Equality tests of the outer objects, which only count subjects, are left out; the others stay."""
    return _text_plan(spark, d, "SELECT {{COLS}} FROM bids_datasets d LEFT JOIN bids_objects o ON o.dataset_id = d.id WHERE o.task = 'quiet_rest' AND (o.datatype = 'eeg') AND d.doi IS NOT NULL")


@_query(f"WITH {_D}, pc AS (SELECT dataset_id, CAST(count(DISTINCT participant_id) AS DOUBLE) AS m FROM bids_participants GROUP BY dataset_id) SELECT d.id, coalesce(sc.n, 0) AS subject_count, pc.m AS metric_value FROM d LEFT JOIN sc ON sc.dataset_id = d.id LEFT JOIN pc ON pc.dataset_id = d.id WHERE EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND o.datatype = 'eeg') AND EXISTS (SELECT 1 FROM bids_participants p WHERE p.dataset_id = d.id AND p.sex IN {_listed('sex', 'female')})")
def jn17_no_cross_product(spark: SparkSession, d: str) -> DataFrame:
    """Conditions and counts on participants and objects together: each side is aggregated by itself."""
    cat = Catalogue(spark, d)
    plan = QueryPlan(Family.COMBINED, cohorts=(Cohort(sex=_spelt(cat, "sex", "female")),), scans=(Scan(datatype=("eeg",)),), metric="participant_count")
    return compile_plan(plan, cat).select("id", "subject_count", "metric_value")


_GENERIC = ", ".join(f"'{w}'" for w in requests.GENERIC_PEOPLE)


@_query(f"""WITH r AS (SELECT dataset_id AS query, id AS position, diagnosis AS term FROM bids_participants WHERE diagnosis IS NOT NULL AND lower(trim(diagnosis, ' ')) NOT IN ({_GENERIC})), f AS (SELECT query, term, min(position) AS position FROM r GROUP BY query, term)
    SELECT query, 'diagnosis' AS field, array_to_string(list(term ORDER BY position, term), '|') AS terms FROM f GROUP BY query""")
def tr11_without_generic_words(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "bids_participants").select(F.col("dataset_id").alias("query"), F.col("id").alias("position"), F.lit("diagnosis").alias("field"), F.col("diagnosis").alias("term"))
    return requests.merged_requests(p).select("query", "field", F.array_join("terms", "|").alias("terms"))


@_query("""WITH r AS (SELECT dataset_id AS query, id AS position, 'sex' AS field, sex AS term FROM bids_participants UNION ALL SELECT dataset_id, id, 'handedness', handedness FROM bids_participants), f AS (SELECT query, field, term, min(position) AS position FROM r WHERE term IS NOT NULL GROUP BY query, field, term)
    SELECT query, field, array_to_string(list(term ORDER BY position, term), '|') AS terms FROM f GROUP BY query, field""")
def tr12_merged_requests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "bids_participants")
    each = p.select(F.col("dataset_id").alias("query"), F.col("id").alias("position"), F.explode(F.create_map(F.lit("sex"), "sex", F.lit("handedness"), "handedness")).alias("field", "term"))
    return requests.merged_requests(each).select("query", "field", F.array_join("terms", "|").alias("terms"))


_SCORES = "s AS (SELECT field, code, max(score) AS score FROM (SELECT 'suffix' AS field, suffix AS code, length(id) / 100.0::DOUBLE AS score FROM bids_objects WHERE suffix IN ('bold', 'T1w') UNION ALL SELECT 'run', run, 0.3::DOUBLE FROM bids_objects WHERE run IS NOT NULL) GROUP BY field, code)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "bids_objects")
    suffixes = o.filter("suffix IN ('bold', 'T1w')").select(F.lit("suffix").alias("field"), F.col("suffix").alias("code"), (F.length("id") / F.lit(100.0)).alias("score"))
    return suffixes.unionByName(o.filter("run IS NOT NULL").select(F.lit("run").alias("field"), F.col("run").alias("code"), F.lit(0.3).alias("score")))


@_query(f"WITH {_SCORES} SELECT field, code, score FROM s")
def ag12_best_scores(spark: SparkSession, d: str) -> DataFrame:
    return requests.best_scores(_scores(spark, d))


@_query(f"WITH {_SCORES} SELECT r.field, r.code, coalesce(s.score, 1.0) AS score FROM (SELECT DISTINCT 'suffix' AS field, suffix AS code FROM bids_objects WHERE suffix IS NOT NULL UNION SELECT DISTINCT 'datatype', datatype FROM bids_objects WHERE datatype IS NOT NULL) r LEFT JOIN s ON s.field = r.field AND s.code = r.code")
def tr13_scored_codes(spark: SparkSession, d: str) -> DataFrame:
    """The codes that datasets can be scored by, from a list that also names another field."""
    o = table(spark, d, "bids_objects")
    codes = o.select(F.explode(F.create_map(F.lit("suffix"), "suffix", F.lit("datatype"), "datatype", F.lit("run"), "run")).alias("field", "code")).filter("code IS NOT NULL")
    return requests.scored_codes(codes, _scores(spark, d))


@_query("SELECT o_orderpriority, count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS page_count, 3 * 50 < count(*) AS has_more FROM orders GROUP BY o_orderpriority")
def st3_paging(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"))
    return totals.select("o_orderpriority", "total", *ranking.paging(F.col("total"), 3, 50))


@_query("SELECT line FROM (SELECT 'scan_filter' AS line UNION ALL SELECT 'with task=[' || string_agg('''' || s || '''', ', ' ORDER BY s) || ']' FROM (SELECT DISTINCT unnest(list_concat([standard_code, label], synonyms)) AS s FROM vocab_terms WHERE field_name = 'task' AND standard_code = 'tone_oddball') UNION ALL SELECT 'min_subjects: 2')")
def tr17_plan_summary(spark: SparkSession, d: str) -> DataFrame:
    plan = QueryPlan(Family.SCAN, scans=(Scan(task=_spelt(Catalogue(spark, d), "task", "tone_oddball")),), min_subjects=2)
    return spark.createDataFrame([(x,) for x in summary(plan).splitlines()], "line string")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim({})), '\\s+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"


@_query(f"""WITH a AS (SELECT DISTINCT id AS ask, coalesce({_WORDS.format('name')}, []) AS ws FROM bids_datasets), e AS (SELECT label AS question, field_name AS family, CASE WHEN standard_code IN ('quiet_rest', 'glioblastoma') THEN 1 ELSE 0 END::BIGINT AS code_overlap, {_WORDS.format('label')} AS ws FROM vocab_terms),
    m AS (SELECT ask, question, family, code_overlap, len(list_intersect(e.ws, a.ws))::BIGINT AS word_overlap, CASE family WHEN 'task' THEN 2 WHEN 'diagnosis' THEN 1 ELSE 0 END AS pr FROM a, e)
    SELECT ask, question, family, code_overlap, word_overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY code_overlap DESC, word_overlap DESC, pr DESC, question) AS place FROM m) WHERE place <= 4""")
def wn4_ranked_examples(spark: SparkSession, d: str) -> DataFrame:
    """The entries nearest to each dataset's name and to two codes."""
    examples = table(spark, d, "vocab_terms").select(F.col("label").alias("question"), F.col("field_name").alias("family"), F.array("standard_code").alias("codes"))
    asked = table(spark, d, "bids_datasets").select(F.col("id").alias("ask"), F.col("name").alias("text"), F.lit("task").alias("family"), F.array(F.lit("quiet_rest"), F.lit("glioblastoma")).alias("codes")).distinct()
    return curation.ranked_examples(examples, asked, ["diagnosis"], 4)


@_query("SELECT key, weight FROM (SELECT r_regionkey AS key, r_name AS path, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) * 10 + length(r_name) AS weight FROM region) ORDER BY weight DESC, path LIMIT 3 OFFSET 1")
def st7_batch_order(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("accession_ids"))
    nodes = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("path"), "accession_ids", F.col("r_name").alias("description"))
    return curation.batch_order(nodes, 1, 3, by_text=True).select("key", "weight")


# --- vocabulary edits ---------------------------------------------------------------------------------------------------


def _synonyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab_terms").select(F.col("standard_code").alias("key"), F.explode("synonyms").alias("term"), F.lit(1.0).alias("weight"), "term_id")


@_query("SELECT standard_code AS key, term FROM (SELECT standard_code, term_id, unnest(synonyms) AS term FROM vocab_terms) WHERE term_id % 2 = 1")
def so7_removed_synonyms(spark: SparkSession, d: str) -> DataFrame:
    s = _synonyms(spark, d)
    return vocabulary.without_listed(s, s.filter("term_id % 2 = 0").select("key", F.upper("term").alias("term"))).select("key", "term")


@_query("WITH t AS (SELECT term, max_by(standard_code, (term_id, i)) AS code FROM (SELECT term_id, standard_code, lower(trim(unnest(list_concat([label], synonyms)))) AS term, generate_subscripts(list_concat([label], synonyms), 1) AS i FROM vocab_terms) WHERE term <> '' GROUP BY term) SELECT term AS label, CASE WHEN length(code) % 3 = 0 THEN 'group' ELSE code END AS codes, 1.0::DOUBLE AS weight FROM t WHERE length(term) >= 3 UNION ALL SELECT 'another group', 'group', 1.0")
def so8_label_pool(spark: SparkSession, d: str) -> DataFrame:
    """Labels of leaves and groups as one pool, groups in place of equal leaves."""
    display = vocabulary.display_terms(concepts(spark, d))
    groups = display.filter(F.length("code") % 3 == 0).select("term").union(spark.createDataFrame([("another group",), ("gg",)], "term string")).select("term", F.array(F.lit("group")).alias("codes"))
    return resolver.pool(display, groups).select("label", F.array_join("codes", "|").alias("codes"), "weight")


@_query("SELECT id, md5(other_entities) AS result FROM (SELECT DISTINCT id, other_entities FROM bids_objects WHERE other_entities IS NOT NULL)")
def js8_nuls_out_of_json(spark: SparkSession, d: str) -> DataFrame:
    """NULs put into every text, written out and escaped, and taken out again."""
    o = table(spark, d, "bids_objects").filter("other_entities IS NOT NULL").select("id", "other_entities").distinct()
    dirty = F.regexp_replace(F.concat(F.lit("\x00"), F.col("other_entities")), ": ", ": \\\\u0000\x00")
    return o.select("id", F.md5(documents.strip_nuls(dirty)).alias("result"))


@_query("SELECT field_name AS key, CAST(NULL AS VARCHAR) AS broader, field_name AS label FROM (SELECT DISTINCT field_name FROM vocab_terms) UNION ALL SELECT field_name || ':' || standard_code, field_name, label FROM vocab_terms")
def on10_nested_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """A nested vocabulary made flat, with its reverse links."""
    tree: dict[str, dict] = {}
    for r in table(spark, d, "vocab_terms").collect():
        tree.setdefault(r["field_name"], {"label": r["field_name"]})[f"{r['field_name']}:{r['standard_code']}"] = {"label": r["label"]}
    flat = files.nested_concepts(tree)
    return spark.createDataFrame([(k, (v.get("broader") or [None])[0], v.get("label")) for k, v in flat.items()], "key string, broader string, label string")


@_query("SELECT standard_code AS key, unnest(synonyms) AS term, 1.0::DOUBLE AS weight FROM vocab_terms UNION ALL SELECT standard_code, 'new ' || standard_code, 1.0 FROM vocab_terms")
def on14_merged_synonyms(spark: SparkSession, d: str) -> DataFrame:
    old = _synonyms(spark, d).drop("term_id")
    new = old.select("key", F.upper("term").alias("term"), F.lit(0.5).alias("weight")).union(old.select("key").distinct().select("key", F.concat(F.lit("new "), "key"), F.lit(1.5)))
    return vocabulary.merged_synonyms(old, new).select("key", "term", "weight")


@_query("""WITH v AS (SELECT count(*) AS n FROM vocab_terms WHERE field_name = 'task') SELECT 'add_to_codes' AS action, n AS decisions, n AS codes, n AS scoped FROM v UNION ALL SELECT 'add_to_dataset_codes', 2 * n, n, n FROM v UNION ALL SELECT 'filter', 1, n, n FROM v UNION ALL SELECT 'skipped', n + 1, n, n FROM v""")
def on15_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on every task: a code, the same code again, scoped codes in two parts, a rejected value and an unknown target."""
    held = {r["standard_code"]: {"label": r["label"]} for r in table(spark, d, "vocab_terms").filter("field_name = 'task'").collect()}
    decisions = [{"action": a, "raw": f"raw {k}", "target": k, **more} for k in held for a, more in (("add_to_codes", {}), ("add_to_codes", {}), ("add_to_dataset_codes", {"accession_ids": ["b"]}), ("add_to_dataset_codes", {"accession_ids": ["a", "b"]}))]
    out, stats = vocabulary.apply_decisions(held, [*decisions, {"action": "filter", "raw": "x"}, {"action": "add_to_codes", "raw": "y", "target": "nowhere"}])
    codes, scoped = sum(len(v["codes"]) for v in out.values()), sum(len(x["accession_ids"]) == 2 for v in out.values() for x in v["dataset_codes"])
    return spark.createDataFrame([(a, n, codes, scoped) for a, n in stats.items()], "action string, decisions long, codes long, scoped long")


@_query("SELECT field_name || ':' || standard_code AS key FROM vocab_terms WHERE term_id % 5 = 0")
def on16_without_terms(spark: SparkSession, d: str) -> DataFrame:
    c = concepts(spark, d)
    gone = F.col("position") % 5 == 0
    blank = c.withColumn("label", F.when(gone & (F.col("position") >= 0), "  ").otherwise(F.col("label"))).withColumn("synonyms", F.when(gone & (F.col("position") % 2 == 0), F.lit(None)).when(gone, F.slice("synonyms", 1, 0)).otherwise(F.col("synonyms")))
    return vocabulary.without_terms(blank)


@_query("""WITH s AS (SELECT term_id, standard_code, unnest(list_concat([label, upper(standard_code)], synonyms)) AS t FROM vocab_terms) SELECT raw, canonical, scope FROM (SELECT lower(t) AS raw, min_by(standard_code, term_id) AS canonical, '' AS scope FROM s WHERE lower(t) <> standard_code GROUP BY lower(t)) UNION ALL SELECT lower(label), standard_code, field_name FROM vocab_terms WHERE lower(label) <> standard_code""")
def on17_rewrites(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab_terms")
    c = v.select("standard_code", F.col("term_id").alias("position"), F.concat(F.array("label", F.upper("standard_code")), "synonyms").alias("codes"), F.array(F.struct(F.col("label").alias("raw"), F.array("field_name").alias("accession_ids"))).alias("dataset_codes"))
    everywhere, scoped = vocabulary.rewrites(c)
    return everywhere.select("raw", "canonical", F.lit("").alias("scope")).unionByName(scoped.select("raw", "canonical", F.array_join("accession_ids", "|").alias("scope")))


# --- resolution -------------------------------------------------------------------------------------------------------

_NORM = "sqrt(list_sum(list_transform(range(1, 65), lambda i: {0}.embedding[i]::DOUBLE * {0}.embedding[i]::DOUBLE)))"
_FLOORS = (0.45, 0.4)


@_query(f"""WITH s AS (SELECT q.vec_id AS term, v.label % 2 + 1 AS tier, v.vec_id AS code, {_COS} / ({_NORM.format('q')} * {_NORM.format('v')}) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id % 20 <> 0),
    b AS (SELECT term, tier, max_by(code, (score, -code)) AS code, max(score) AS score FROM s GROUP BY term, tier) SELECT term, min_by(code, tier) AS code FROM b WHERE score >= CASE tier WHEN 1 THEN {_FLOORS[0]} ELSE {_FLOORS[1]} END GROUP BY term""")
def tr6_vector_tiers(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 20, the nearest of the first tier that is near enough, else of the second."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("vector"))
    index = e.filter("vec_id % 20 <> 0").select((F.col("label") % 2 + 1).alias("tier"), F.col("vec_id").cast("string").alias("code"), F.col("embedding").alias("vector"))
    return resolver.nearest_vectors(asked, index, _FLOORS).select(F.col("term").cast("long").alias("term"), F.col("code").cast("long").alias("code"))


@_query("SELECT DISTINCT field_name AS field, standard_code AS code FROM vocab_terms WHERE field_name IN ('task', 'diagnosis')")
def tr9_alternate_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Every entry asked for by its label in capitals and by the name of its field: leaves win, and groups are not among the codes."""
    c = concepts(spark, d)
    reach = vocabulary.closure(vocabulary.edges(c))
    v = table(spark, d, "vocab_terms").filter("field_name IN ('task', 'diagnosis')")
    terms = v.select("field_name", F.explode(F.array(F.upper("label"), F.col("field_name"))).alias("term")).distinct()
    return resolver.alternate(terms, vocabulary.group_terms(c, reach), vocabulary.leaf_terms(c), vocabulary.display_terms(c), vocabulary.ancestor_paths(c, reach), "field_name")


_EXACT = """WITH t AS (SELECT DISTINCT diagnosis AS term, lower(trim(diagnosis, ' ')) AS q FROM bids_participants WHERE trim(diagnosis, ' ') <> ''),
    v AS (SELECT term, q FROM t UNION ALL SELECT term, CASE WHEN q LIKE '%s' AND q NOT LIKE '%ss' THEN q[:-2] ELSE q || 's' END FROM t UNION ALL SELECT term, CASE WHEN q LIKE '%ies' THEN q[:-4] || 'y' WHEN q LIKE '%y' THEN q[:-2] || 'ies' END FROM t),
    l AS (SELECT lower(unnest(list_concat([label, standard_code], synonyms))) AS q FROM vocab_terms WHERE field_name = 'diagnosis')"""


@_query(_EXACT + " SELECT term FROM t WHERE term NOT IN (SELECT term FROM v JOIN l USING (q))")
def tr15_unresolved_terms(spark: SparkSession, d: str) -> DataFrame:
    groups, leaves, _ = _lookups(spark, d, "diagnosis")
    terms = _terms(spark, d)
    return resolver.unresolved(terms, resolver.exact(terms, groups, leaves))


@_query("""WITH t AS (SELECT DISTINCT task AS term, lower(task) AS q FROM bids_objects WHERE task IS NOT NULL), l AS (SELECT lower(unnest(list_concat([label, standard_code], synonyms))) AS q FROM vocab_terms WHERE field_name = 'task')
    SELECT term, q IN (SELECT q FROM l) OR replace(q, ' ', '_') IN (SELECT q FROM l) OR replace(q, '-', '_') IN (SELECT q FROM l) OR replace(q, '-', ' ') IN (SELECT q FROM l) AS exact FROM t""")
def tr16_exact_paths(spark: SparkSession, d: str) -> DataFrame:
    _, leaves, display = _lookups(spark, d, "task")
    terms = table(spark, d, "bids_objects").filter("task IS NOT NULL").select(F.col("task").alias("term"))
    return resolver.resolution_path(terms, leaves.select("term"), display.select(F.col("term").alias("label"))).select("term", (F.col("path") == "exact").alias("exact"))


# --- evaluation -------------------------------------------------------------------------------------------------------

_FLAGS = {"passed": "o_totalprice > 100000", "zero_result": "o_custkey % 7 = 0", "spurious_filter": "o_custkey % 11 = 0", "missing_filter": "o_custkey % 5 = 0", "sql_valid": "o_orderstatus <> 'P'", "fallback": "o_orderstatus = 'F'", "schema_hallucination": "o_custkey % 13 = 0", "self_corrected": "o_custkey % 3 = 0"}


@_query("WITH r AS (SELECT o_orderpriority AS category, " + ", ".join(f"CAST({e} AS INT)::DOUBLE AS {evaluation.OUTCOMES[n]}" for n, e in _FLAGS.items()) + " FROM orders) " + " UNION ALL ".join(f"SELECT {c} AS category, count(*) AS n, " + ", ".join(f"round(avg({x}), 3) AS {x}" for x in evaluation.OUTCOMES.values()) + " FROM r" + g for c, g in (("category", " GROUP BY category"), ("'Overall'", ""))))
def ag18_pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), *[F.expr(e).alias(n) for n, e in _FLAGS.items()])
    return evaluation.pipeline_metrics(o)


# --- repairs ----------------------------------------------------------------------------------------------------------


@_query("SELECT DISTINCT id, other_entities AS result FROM bids_objects WHERE json_valid(other_entities)")
def js9_repaired_slips(spark: SparkSession, d: str) -> DataFrame:
    """Every valid object with slips put in (a comma too many, one missing, other quotes for names, a control character) reads as before."""
    o = table(spark, d, "bids_objects").filter(documents.is_valid(F.col("other_entities"))).select("id", "other_entities").distinct()
    broken = F.regexp_replace(F.regexp_replace(F.regexp_replace("other_entities", r"\}$", ",}"), r", \"(\w+)\": ", "\n'$1':\t"), r"^\{", "\ufeff{\x01")
    return o.select("id", documents.repaired_json(broken).alias("result"))


@_query("SELECT DISTINCT id, task, coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(lower(task), '\\s+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in text.DESCRIPTORS) + ")), ' '), ''), lower(task)) AS result FROM bids_objects WHERE task IS NOT NULL")
def str7_core_term(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bids_objects").filter("task IS NOT NULL").select("id", "task", text.without_words(F.col("task"), text.DESCRIPTORS).alias("result")).distinct()


# --- streams and caches -------------------------------------------------------------------------------------------------


@_query("SELECT 3::BIGINT AS runs, 0::BIGINT AS overlapping, count(*) * 3 AS worked FROM nation")
def ss1_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Three cycles, each longer than the interval: none begins before the last one has ended."""
    spans: list[tuple[float, float]] = []
    worked = []

    def work(n: int) -> None:
        if len(spans) < 3:
            began = time.time()
            worked.append(table(spark, d, "nation").count())
            time.sleep(0.3)
            spans.append((began, time.time()))

    query = flows.cycle(spark, work, "100 milliseconds", _folder(spark))
    try:
        for _ in range(600):
            if len(spans) >= 3 or not query.isActive:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    overlapping = sum(b[0] < a[1] for a, b in zip(spans, spans[1:]))
    return spark.createDataFrame([(len(spans), overlapping, sum(worked))], "runs long, overlapping long, worked long")


@_query("SELECT user_id, max(value) AS value FROM events GROUP BY user_id")
def ss3_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """A stream merged into a table by key, twice: the second run changes nothing."""
    path, work = _folder(spark), _folder(spark)
    schema = table(spark, d, "events").schema
    for run in (1, 2):
        source = flows.file_stream(spark, d, "events.parquet", schema).select("user_id", "value")
        query = source.writeStream.foreachBatch(flows.merge_into(path, ["user_id"], ["value"], 8)).trigger(availableNow=True).option("checkpointLocation", f"{work}/{run}").start()
        query.awaitTermination()
    return spark.read.parquet(path).select("user_id", "value")


@_query("SELECT n_name AS key FROM nation WHERE n_nationkey * 100 + 1000 >= 2500 ORDER BY n_nationkey DESC LIMIT 10")
def ss4_cached_keys(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of ten entries and 1,000 seconds holds after a key every 100 seconds."""
    now = [0.0]
    cache = ranking.QueryCache(ttl=1000.0, most=10, clock=lambda: now[0])
    keys = [r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    for i, k in enumerate(keys):
        now[0] = i * 100.0
        cache.put(k, None)
    now[0] = len(keys) * 100.0
    return spark.createDataFrame([(k,) for k in keys if cache.get(k)], "key string")


@_query(_sql("d.doi IS NOT NULL AND d.doi <> ''", tail="ORDER BY subject_count DESC NULLS LAST, d.id LIMIT 30 OFFSET 10").replace("SELECT d.id, d.accession_id,", "SELECT d.id,"))
def ss8_neighbour_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages two to four of a search, the outer ones fetched with the middle one."""
    search = ranking.Search(Catalogue(spark, d))
    key, _, _ = search.search(QueryPlan(Family.DOI, doi_required=True), 1, 10)
    pages = {p: search.page(key, p, 10)[0] for p in (3,)}
    kept = search.cache.get(key).pages
    rows = [r for p in (2, 3, 4) for r in kept[p, 10]]
    return spark.createDataFrame(rows, pages[3].schema).select("id", "subject_count")

