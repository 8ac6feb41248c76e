"""Vocabulary, resolution, curation, evaluation, ingest and event queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftworks.functions import documents
from siftworks.operators import curation, evaluation, ingest, resolver, vectors, vocabulary
from siftworks.queries.ratios import scored
from siftworks.session import table
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


# --- vocabulary -------------------------------------------------------------------------------------------------------


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """The list of accepted entries as concepts under a node per field, the fields under one root; every field is also part of the root's twin, which closes a cycle."""
    v = table(spark, d, "vocab_terms")
    synonyms = F.transform("synonyms", lambda s: F.struct(s.alias("term"), F.lit(1.0).alias("weight")))
    none, raw = F.array().cast("array<string>"), F.array().cast("array<struct<raw:string,accession_ids:array<string>>>")
    leaves = v.select(F.concat("field_name", F.lit(":"), "standard_code").alias("key"), "label", "standard_code", F.array("field_name").alias("broader"), none.alias("part_of"), synonyms.alias("synonyms"), none.alias("codes"), raw.alias("dataset_codes"), F.col("term_id").alias("position"))
    no_synonyms = F.array().cast("array<struct<term:string,weight:double>>")
    fields = v.select("field_name").distinct().select(F.col("field_name").alias("key"), F.col("field_name").alias("label"), F.lit(None).cast("string").alias("standard_code"), F.array(F.lit("root")).alias("broader"), none.alias("part_of"), no_synonyms.alias("synonyms"), none.alias("codes"), raw.alias("dataset_codes"), F.lit(-1).cast("long").alias("position"))
    return leaves.unionByName(fields)


_EDGES = "e(parent, child) AS (SELECT field_name, field_name || ':' || standard_code FROM vocab_terms UNION SELECT 'root', field_name FROM vocab_terms)"


@_query(f"""WITH RECURSIVE {_EDGES}, r(ancestor, descendant, depth) AS (SELECT n, n, 0::BIGINT FROM (SELECT parent AS n FROM e UNION SELECT child FROM e)
    UNION SELECT r.ancestor, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.descendant) SELECT ancestor, descendant, min(depth) AS depth FROM r GROUP BY ancestor, descendant""")
def closure_descendants(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.closure(vocabulary.edges(concepts(spark, d))).withColumn("depth", F.col("depth").cast("long"))


@_query("WITH RECURSIVE e(parent, child) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'r0', 'r1' UNION SELECT 'r1', 'r0'), r(ancestor, descendant) AS (SELECT 'r0', 'r0' UNION SELECT r.ancestor, e.child FROM r JOIN e ON e.parent = r.descendant) SELECT * FROM r")
def closure_with_cycle(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    pairs = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")).union(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"))).union(spark.createDataFrame([("r0", "r1"), ("r1", "r0")], "parent string, child string"))
    return vocabulary.closure(pairs, spark.createDataFrame([("r0",)], "n string")).select("ancestor", "descendant")


@_query("SELECT key, depth FROM (SELECT DISTINCT field_name || ':' || standard_code AS key, 2::BIGINT AS depth FROM vocab_terms UNION SELECT field_name, 1 FROM vocab_terms UNION SELECT 'root', 0)")
def node_depth(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.depths(vocabulary.edges(concepts(spark, d))).select(F.col("node").alias("key"), F.col("depth").cast("long").alias("depth"))


@_query("SELECT term, max_by(standard_code, (term_id, i)) AS code FROM (SELECT term_id, standard_code, lower(unnest(list_concat([label, standard_code], synonyms))) AS term, generate_subscripts(list_concat([label, standard_code], synonyms), 1) AS i FROM vocab_terms) WHERE term <> '' GROUP BY term")
def on1_leaf_terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.leaf_terms(concepts(spark, d))


@_query("SELECT term, max_by(standard_code, (term_id, i)) AS code, 1.0::DOUBLE AS weight FROM (SELECT term_id, standard_code, lower(trim(unnest(list_concat([label], synonyms)))) AS term, generate_subscripts(list_concat([label], synonyms), 1) AS i FROM vocab_terms) WHERE term <> '' GROUP BY term")
def on2_display_terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.display_terms(concepts(spark, d))


@_query("SELECT field_name AS term, array_to_string(list_sort(list(DISTINCT standard_code)), '|') AS codes FROM vocab_terms GROUP BY field_name")
def on5_group_terms(spark: SparkSession, d: str) -> DataFrame:
    c = concepts(spark, d)
    return vocabulary.group_terms(c, vocabulary.closure(vocabulary.edges(c))).select("term", F.array_join("codes", "|").alias("codes"))


@_query("SELECT grp, code FROM (SELECT DISTINCT substr(standard_code, 1, 1) AS grp, standard_code AS code FROM vocab_terms)")
def prune_parents(spark: SparkSession, d: str) -> DataFrame:
    c = concepts(spark, d)
    paths = vocabulary.ancestor_paths(c, vocabulary.closure(vocabulary.edges(c)))
    codes = c.filter(F.col("standard_code").isNotNull()).select(F.substring("standard_code", 1, 1).alias("grp"), F.col("standard_code").alias("code")).distinct()
    return vocabulary.prune_parents(codes, paths, "grp")


@_query("SELECT 'root' AS parent, field_name AS child FROM (SELECT DISTINCT field_name FROM vocab_terms)")
def on9_broken_parents(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.broken_parents(concepts(spark, d))


@_query("SELECT p_partkey AS position, p_name AS name, s || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS slug FROM (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') ORDER BY p_partkey) - 1 AS n FROM part)")
def on19_unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    return vocabulary.unique_slugs(p)


@_query("SELECT field_name AS category, count(*) AS concepts FROM vocab_terms GROUP BY field_name UNION ALL SELECT 'total', count(*) FROM vocab_terms")
def ag23_concept_counts(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "vocab_terms").rollup("field_name").agg(F.count(F.lit(1)).alias("concepts"), F.grouping("field_name").alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col("field_name")).alias("category"), "concepts")


# --- resolution -------------------------------------------------------------------------------------------------------


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bids_participants").filter(F.trim("diagnosis") != "").select(F.col("diagnosis").alias("term")).distinct()


def _lookups(spark: SparkSession, d: str, field: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = concepts(spark, d).filter(F.col("key").startswith(field))
    groups = vocabulary.group_terms(c, vocabulary.closure(vocabulary.edges(c)))
    return groups, vocabulary.leaf_terms(c), vocabulary.display_terms(c)


@_query("""WITH t AS (SELECT DISTINCT diagnosis AS term, lower(trim(diagnosis, ' ')) AS q FROM bids_participants WHERE trim(diagnosis, ' ') <> ''),
    v AS (SELECT term, 0 AS i, q FROM t UNION ALL SELECT term, 1, CASE WHEN q LIKE '%s' AND q NOT LIKE '%ss' THEN q[:-2] ELSE q || 's' END FROM t UNION ALL SELECT term, 2, CASE WHEN q LIKE '%ies' THEN q[:-4] || 'y' WHEN q LIKE '%y' THEN q[:-2] || 'ies' END FROM t),
    l AS (SELECT standard_code AS code, lower(unnest(list_concat([label, standard_code], synonyms))) AS q FROM vocab_terms WHERE field_name = 'diagnosis')
    SELECT term, min_by(code, i) AS code, 1.0::DOUBLE AS score FROM v JOIN l USING (q) GROUP BY term""")
def tr1_exact(spark: SparkSession, d: str) -> DataFrame:
    groups, leaves, _ = _lookups(spark, d, "diagnosis")
    return resolver.exact(_terms(spark, d), groups, leaves)


@_query(f"""WITH t AS (SELECT DISTINCT diagnosis AS term, lower(trim(diagnosis, ' ')) AS q FROM bids_participants WHERE trim(diagnosis, ' ') <> ''),
    v AS (SELECT term, 0 AS i, q FROM t UNION ALL SELECT term, 1, CASE WHEN q LIKE '%s' AND q NOT LIKE '%ss' THEN q[:-2] ELSE q || 's' END FROM t UNION ALL SELECT term, 2, CASE WHEN q LIKE '%ies' THEN q[:-4] || 'y' WHEN q LIKE '%y' THEN q[:-2] || 'ies' END FROM t),
    l AS (SELECT standard_code AS code, lower(unnest(list_concat([label, standard_code], synonyms))) AS q FROM vocab_terms WHERE field_name = 'diagnosis'), x AS (SELECT term, min_by(code, i) AS code FROM v JOIN l USING (q) GROUP BY term),
    g AS (SELECT DISTINCT lower(trim(unnest(list_concat([label], synonyms)))) AS b, standard_code AS code FROM vocab_terms WHERE field_name = 'diagnosis' UNION ALL SELECT 'diagnosis', standard_code FROM vocab_terms WHERE field_name = 'diagnosis'),
    p AS (SELECT DISTINCT t.q AS a, g.b FROM t, g WHERE t.term NOT IN (SELECT term FROM x) AND length(g.b) >= 3), {scored('p')},
    best AS (SELECT a, b, weighted AS points FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weighted DESC, length(b) DESC, b) AS n FROM scores) WHERE n = 1)
    SELECT term, code, 1.0::DOUBLE AS score, 'exact' AS path FROM x UNION ALL SELECT t.term, g.code, round(points / 100, 6), 'fuzzy' FROM best JOIN t ON t.q = best.a JOIN g ON g.b = best.b WHERE points >= 80 AND t.term NOT IN (SELECT term FROM x)""")
def tr4_resolve(spark: SparkSession, d: str) -> DataFrame:
    groups, leaves, display = _lookups(spark, d, "diagnosis")
    return resolver.resolve(_terms(spark, d), groups, leaves, display).withColumn("score", F.round("score", 6))


_ASKED = ("Nansohut Olivia", "gregory pukgicet", "Wolceliv")


@_query(f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in _ASKED)}) v(term)), n AS (SELECT DISTINCT name FROM (SELECT unnest(authors) AS name FROM bids_datasets) WHERE name <> ''), p AS (SELECT lower(term) AS a, lower(name) AS b FROM t, n), {scored('p', False)},
    f AS (SELECT term, name, token_set, row_number() OVER (PARTITION BY term ORDER BY token_set DESC, name) AS place FROM t, n JOIN scores ON scores.b = lower(name) AND scores.a = lower(term) WHERE token_set >= 60) SELECT term, name, round(token_set / 100, 6) AS score, place FROM f WHERE place <= 20""")
def tr8_names(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "bids_datasets").select(F.explode("authors").alias("name")).filter("name <> ''").distinct()
    return resolver.names(spark.createDataFrame([(x,) for x in _ASKED], "term string"), listed).select("term", "name", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@_query("""WITH t(term) AS (SELECT DISTINCT lower(trim(task, ' ')) FROM bids_objects WHERE task IS NOT NULL) SELECT term, 'datatype' AS field FROM t UNION ALL SELECT term, 'suffix' FROM t WHERE term NOT IN ('brain scan') UNION ALL SELECT term, 'task' FROM t WHERE term NOT IN ('qr', 'brain scan')""")
def tr7_search_fields(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "bids_objects").filter(F.col("task").isNotNull()).select(F.lower(F.trim("task")).alias("term")).distinct()
    return resolver.search_fields(terms, ["qr"], ["brain scan"])


@_query("SELECT o.t AS term, v.standard_code AS code FROM (SELECT DISTINCT field_name AS t FROM vocab_terms) o JOIN vocab_terms v ON v.field_name = o.t")
def bridge_expand(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab_terms")
    terms = v.select(F.col("field_name").alias("term")).distinct()
    constructs = terms.select(F.col("term").alias("label"), F.array("term").alias("codes"), F.lit(1.0).alias("weight"))
    return resolver.bridge(terms, constructs, v.select(F.col("field_name").alias("construct"), F.col("standard_code").alias("task_code"))).select("term", "code")


@_query("SELECT 'r1' AS rule_id, 'soft' AS severity, 'invasive and scalp recordings' AS message WHERE EXISTS (SELECT 1 FROM bids_objects WHERE datatype = 'eeg') AND EXISTS (SELECT 1 FROM bids_objects WHERE suffix IN ('T1w', 'meg'))")
def tr14_contradictions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "bids_objects")
    codes = o.select(F.lit("datatype").alias("field"), F.col("datatype").alias("code")).union(o.select(F.lit("suffix"), "suffix")).distinct()
    rules = spark.createDataFrame([("r1", "soft", "invasive and scalp recordings", "trigger", "datatype", ["eeg"]), ("r1", "soft", "invasive and scalp recordings", "incompatible", "suffix", ["T1w", "meg"]), ("r2", "hard", "never", "trigger", "datatype", ["pet"]), ("r2", "hard", "never", "incompatible", "suffix", ["*"])], "rule_id string, severity string, message string, role string, field string, codes array<string>")
    return resolver.contradictions(codes, rules)


_COS = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))"


@_query(f"SELECT q.vec_id AS query_id, max_by(v.vec_id, ({_COS}, -v.vec_id)) AS vec_id FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id GROUP BY q.vec_id")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 20, the nearest of all others."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(e.filter("id % 20 = 0"), e).select("query_id", F.col("id").alias("vec_id"))


@_query("SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) >= 0.35")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))
    return curation.vector_collisions(e, 0.35).select("id_a", "id_b")


# --- curation ---------------------------------------------------------------------------------------------------------

_MAP = "m AS (SELECT lower(s) AS raw, min(standard_code) AS canonical FROM (SELECT standard_code, unnest(list_concat([label], synonyms)) AS s FROM vocab_terms WHERE field_name = '{}') WHERE lower(s) <> lower(standard_code) GROUP BY lower(s))"


def _mapping(spark: SparkSession, d: str, field: str) -> DataFrame:
    v = table(spark, d, "vocab_terms").filter(F.col("field_name") == field)
    each = v.select(F.explode(F.concat(F.array("label"), "synonyms")).alias("raw"), F.col("standard_code").alias("canonical"), F.col("standard_code").alias("position")).filter(F.lower("raw") != F.lower("canonical"))
    return curation.first_rewrite(each)


@_query(f"WITH {_MAP.format('task')} SELECT DISTINCT id, coalesce(canonical, task) AS task FROM bids_objects LEFT JOIN m ON lower(task) = m.raw")
def canonicalise_global(spark: SparkSession, d: str) -> DataFrame:
    return curation.canonicalise(table(spark, d, "bids_objects"), "task", _mapping(spark, d, "task")).select("id", "task").distinct()


@_query("SELECT DISTINCT p.id, CASE WHEN lower(p.diagnosis) IN ('9', 'grp2') AND b.accession_id IN (SELECT min(accession_id) FROM bids_datasets UNION SELECT max(accession_id) FROM bids_datasets) THEN 'healthy_volunteer' ELSE p.diagnosis END AS diagnosis FROM bids_participants p JOIN (SELECT DISTINCT id, accession_id FROM bids_datasets) b ON b.id = p.dataset_id")
def canonicalise_scoped(spark: SparkSession, d: str) -> DataFrame:
    datasets = table(spark, d, "bids_datasets").select(F.col("id").alias("b"), "accession_id").distinct()
    scope = datasets.agg(F.array(F.min("accession_id"), F.max("accession_id")).alias("accession_ids"))
    mapping = scope.select(F.explode(F.array(F.lit("9"), F.lit("grp2"))).alias("raw"), F.lit("healthy_volunteer").alias("canonical"), "accession_ids")
    people = table(spark, d, "bids_participants").join(datasets, F.col("dataset_id") == F.col("b"))
    return curation.canonicalise_scoped(people, "diagnosis", "accession_id", mapping).select("id", "diagnosis").distinct()


@_query(f"WITH {_MAP.format('task')} SELECT m.raw, m.canonical, count(*) AS rows FROM bids_objects JOIN m ON lower(task) = m.raw GROUP BY m.raw, m.canonical")
def rewrite_dryrun_counts(spark: SparkSession, d: str) -> DataFrame:
    return curation.rewrite_counts(table(spark, d, "bids_objects"), "task", _mapping(spark, d, "task"))


@_query("SELECT sex AS value, count(*) AS rows FROM bids_participants GROUP BY sex")
def value_freq(spark: SparkSession, d: str) -> DataFrame:
    return curation.value_counts(table(spark, d, "bids_participants"), "sex")


@_query("SELECT diagnosis AS value, array_to_string(list_sort(list(DISTINCT accession_id))[1:8], '|') AS sources, count(DISTINCT accession_id) AS source_count FROM bids_participants p JOIN (SELECT DISTINCT id, accession_id FROM bids_datasets) b ON b.id = p.dataset_id WHERE diagnosis <> '' GROUP BY diagnosis")
def distinct_sources_agg(spark: SparkSession, d: str) -> DataFrame:
    datasets = table(spark, d, "bids_datasets").select(F.col("id").alias("b"), "accession_id").distinct()
    people = table(spark, d, "bids_participants").join(datasets, F.col("dataset_id") == F.col("b"))
    return curation.value_sources(people, "diagnosis", "accession_id", 8).select("value", F.array_join("sources", "|").alias("sources"), "source_count")


@_query("SELECT dataset_id, array_to_string(list_sort(list(DISTINCT v)), '|') AS vendors FROM (SELECT dataset_id, trim(json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.Manufacturer'), ' ') AS v FROM bids_objects) WHERE v <> '' GROUP BY dataset_id")
def json_group_array(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "bids_objects").select("dataset_id", F.trim(documents.member(F.col("other_entities"), "Manufacturer")).alias("v")).filter("v <> ''")
    return v.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("vendors"))


@_query("SELECT DISTINCT task AS value FROM bids_objects WHERE trim(task, ' ') <> '' AND lower(trim(task, ' ')) NOT IN (SELECT lower(trim(unnest(list_concat([standard_code, label], synonyms)), ' ')) FROM vocab_terms WHERE field_name = 'task')")
def unmapped_antijoin(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab_terms").filter("field_name = 'task'").select(F.explode(F.concat(F.array("standard_code", "label"), "synonyms")).alias("code"))
    return curation.unmapped(table(spark, d, "bids_objects"), "task", v)


@_query(f"WITH {_MAP.format('diagnosis')}, n AS (SELECT raw, canonical FROM m UNION ALL SELECT * FROM (VALUES ('tbd', NULL), ('unknown', NULL), ('healthy_volunteer', 'healthy_volunteer'))), v AS (SELECT DISTINCT diagnosis AS value FROM bids_participants WHERE diagnosis <> '') SELECT CASE WHEN n.raw IS NULL THEN 'unknown' WHEN canonical IS NULL THEN 'filtered' WHEN canonical = value THEN 'pass-through' ELSE 'mapped' END AS state, count(*) AS values FROM v LEFT JOIN n ON lower(value) = n.raw GROUP BY 1")
def mapping_tri_state(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([("tbd", None), ("unknown", None), ("healthy_volunteer", "healthy_volunteer")], "raw string, canonical string")
    return curation.mapping_states(table(spark, d, "bids_participants"), "diagnosis", _mapping(spark, d, "diagnosis").unionByName(extra))


@_query("SELECT standard_code AS code, bool_or(lower(standard_code) IN (SELECT lower(task) FROM bids_objects WHERE task IS NOT NULL)) AS present FROM vocab_terms GROUP BY standard_code")
def coverage_present_absent(spark: SparkSession, d: str) -> DataFrame:
    return curation.coverage(table(spark, d, "vocab_terms").select(F.col("standard_code").alias("code")), table(spark, d, "bids_objects"), "task")


@_query("""WITH v AS (SELECT DISTINCT task AS value FROM bids_objects WHERE task IS NOT NULL), p AS (SELECT value, CASE WHEN regexp_matches(value, '^f\\d+$') THEN 'f{number}' WHEN regexp_matches(value, '^grot[a-i]$') THEN 'grot{a-i}' WHEN regexp_matches(value, '^\\d') THEN 'starts-digit'
    WHEN regexp_matches(value, '(?i)^vol') THEN 'vol*' WHEN regexp_matches(value, '^t\\d+$') THEN 't{number}' WHEN regexp_matches(value, '^sub\\d+$') THEN 'sub{number}' END AS pattern FROM v)
    SELECT pattern, count(*) AS values, array_to_string(list_sort(list(value))[1:8], '|') AS examples FROM p WHERE pattern IS NOT NULL GROUP BY pattern""")
def junk_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return curation.junk_counts(table(spark, d, "bids_objects"), "task").select("pattern", "values", F.array_join("examples", "|").alias("examples"))


_BARE = "regexp_replace(lower({}), '[\\s_\\-]+', '', 'g')"


@_query(f"""WITH d AS (SELECT {_BARE.format('label')} AS p, standard_code AS canonical, term_id AS position FROM vocab_terms WHERE field_name = 'task'), v AS (SELECT DISTINCT task AS value, {_BARE.format('task')} AS b FROM bids_objects WHERE task IS NOT NULL)
    SELECT value, min_by(canonical, (CASE WHEN b = p THEN 0 ELSE 1 END, position)) AS canonical FROM v JOIN d ON b = p OR (length(p) >= 4 AND contains(b, p)) GROUP BY value""")
def str22_dictionary_match(spark: SparkSession, d: str) -> DataFrame:
    dictionary = table(spark, d, "vocab_terms").filter("field_name = 'task'").select(F.col("label").alias("pattern"), F.col("standard_code").alias("canonical"), F.col("term_id").alias("position"))
    values = table(spark, d, "bids_objects").filter(F.col("task").isNotNull()).select(F.col("task").alias("value"))
    return curation.dictionary_match(values, dictionary)


def _vocabulary_terms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab_terms")
    labels = v.select(F.col("field_name").alias("field"), F.col("standard_code").alias("key"), F.col("label").alias("term"), F.lit("label").alias("kind"), F.lit(1.0).alias("weight"))
    return labels.unionByName(v.select(F.col("field_name").alias("field"), F.col("standard_code").alias("key"), F.explode("synonyms").alias("term"), F.lit("synonym").alias("kind"), F.lit(1.0).alias("weight")))


@_query(f"""WITH s AS (SELECT DISTINCT field_name AS field, standard_code AS source_key, lower(unnest(synonyms)) AS a FROM vocab_terms), g AS (SELECT DISTINCT field_name AS field, standard_code AS target_key, lower(label) AS b, 'label' AS target_kind FROM vocab_terms UNION SELECT field_name, standard_code, lower(unnest(synonyms)), 'synonym' FROM vocab_terms),
    m AS (SELECT * FROM s JOIN g USING (field) WHERE source_key <> target_key), p AS (SELECT DISTINCT a, b FROM m), {scored('p')}
    SELECT field, source_key, a AS source_term, target_key, b AS target_term, target_kind, round(weighted, 4) AS score, CASE WHEN weighted >= 100 THEN 'CRITICAL' WHEN weighted >= 95 THEN 'HIGH' WHEN weighted >= 90 THEN 'MEDIUM' END AS severity FROM m JOIN scores USING (a, b) WHERE weighted >= 70""")
def jn14_fuzzy_collisions(spark: SparkSession, d: str) -> DataFrame:
    found = curation.fuzzy_collisions(_vocabulary_terms(spark, d), 70.0)
    return found.select("field", "source_key", "source_term", "target_key", "target_term", "target_kind", F.round("score", 4).alias("score"), "severity")


@_query("SELECT o_orderpriority AS field, count(*) FILTER (o_totalprice >= 300000) AS \"CRITICAL\", count(*) FILTER (o_totalprice >= 150000 AND o_totalprice < 300000) AS \"HIGH\", count(*) FILTER (o_totalprice < 150000) AS \"MEDIUM\" FROM orders GROUP BY o_orderpriority")
def severity_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("severity", F.when(F.col("o_totalprice") >= 300000, "CRITICAL").when(F.col("o_totalprice") >= 150000, "HIGH").otherwise("MEDIUM"))
    out = o.groupBy(F.col("o_orderpriority").alias("field")).pivot("severity", ["CRITICAL", "HIGH", "MEDIUM"]).agg(F.count(F.lit(1)))
    return out.na.fill(0, ["CRITICAL", "HIGH", "MEDIUM"])


@_query("""WITH x AS (SELECT source AS key, lower(text) AS t FROM documents WHERE source IS NOT NULL), w(term) AS (VALUES ('contrast'), ('sleep quality'), ('sessions')),
    n AS (SELECT key, count(*) AS n_texts FROM x GROUP BY key), c AS (SELECT key, term, sum((length(t) - length(replace(t, term, ''))) // length(term)) AS c, count(*) FILTER (contains(t, term)) AS h FROM x, w GROUP BY key, term)
    SELECT key, term, round_even(greatest(0.1::DOUBLE, 0.6::DOUBLE * (h / n_texts) + 0.4::DOUBLE * least(1.0::DOUBLE, log2(1.0::DOUBLE + c) / log2(11.0::DOUBLE))), 2) AS weight FROM n JOIN c USING (key)""")
def synonym_weight(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").filter(F.col("source").isNotNull()).select(F.col("source").alias("key"), "text")
    terms = texts.select("key").distinct().select("key", F.explode(F.array(F.lit("contrast"), F.lit("sleep quality"), F.lit("sessions"))).alias("term"))
    return curation.synonym_weights(terms, texts)


# --- evaluation -------------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Typed diagnoses judged as answers: is the value a listed spelling, is it a code."""
    v = table(spark, d, "vocab_terms").filter("field_name = 'diagnosis'")
    spelt = v.select(F.explode(F.concat(F.array("standard_code", "label"), "synonyms")).alias("diagnosis")).distinct().withColumn("listed", F.lit(1.0))
    codes = v.select(F.col("standard_code").alias("diagnosis")).distinct().withColumn("coded", F.lit(1.0))
    p = table(spark, d, "bids_participants").filter(F.col("diagnosis").isNotNull()).join(spelt, "diagnosis", "left").join(codes, "diagnosis", "left")
    return p.select("dataset_id", "age", F.coalesce("handedness", F.lit("none")).alias("variant"), F.coalesce("listed", F.lit(0.0)).alias("listed"), F.coalesce("coded", F.lit(0.0)).alias("coded"))


_JUDGED = "v AS (SELECT standard_code, label, synonyms FROM vocab_terms WHERE field_name = 'diagnosis'), j AS (SELECT age, coalesce(handedness, 'none') AS variant, CASE WHEN diagnosis IN (SELECT unnest(list_concat([standard_code, label], synonyms)) FROM v) THEN 1.0::DOUBLE ELSE 0.0 END AS listed, CASE WHEN diagnosis IN (SELECT standard_code FROM v) THEN 1.0::DOUBLE ELSE 0.0 END AS coded FROM bids_participants WHERE diagnosis IS NOT NULL)"


@_query(f"WITH {_JUDGED} SELECT variant, count(*) AS n, round(avg(listed), 3) AS listed, round(avg(coded), 3) AS coded FROM j GROUP BY variant UNION ALL SELECT 'overall', count(*), round(avg(listed), 3), round(avg(coded), 3) FROM j")
def eval_by_group(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_group(_judged(spark, d), "variant", ["listed", "coded"])


@_query(f"WITH {_JUDGED} SELECT count(*) AS n, round(avg(listed), 3) AS listed FROM j")
def eval_overall_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_group(_judged(spark, d), "variant", ["listed"]).filter("variant = 'overall'").select("n", "listed")


@_query(f"WITH {_JUDGED} SELECT CASE WHEN age / 100 >= 0 AND age / 100 < 0.5 THEN '[0.0,0.5)' WHEN age / 100 >= 0.5 AND age / 100 < 0.7 THEN '[0.5,0.7)' WHEN age / 100 >= 0.7 AND age / 100 < 0.9 THEN '[0.7,0.9)' WHEN age / 100 >= 0.9 AND age / 100 < 1.01 THEN '[0.9,1.0]' ELSE 'unmatched' END AS bucket, count(*) AS n, round(avg(listed), 3) AS accuracy FROM j GROUP BY 1")
def calibration_buckets(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration(_judged(spark, d).withColumn("c", F.col("age") / 100), "c", "listed")


# --- ingest -----------------------------------------------------------------------------------------------------------


@_query("SELECT id, extension AS given, CASE WHEN extension IN ('.json', '.tsv') THEN 'content' ELSE 'stub' END AS action FROM (SELECT DISTINCT id, extension FROM bids_objects)")
def src7_classify(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "bids_objects").select("id", F.col("extension").alias("given")).distinct()
    return ingest.classify(o.withColumn("path", F.concat(F.lit("sub-01/func/x_bold"), "given"))).filter(F.col("given") == F.col("extension")).select("id", "given", "action")


@_query("SELECT accession_id FROM (SELECT DISTINCT regexp_extract(accession_id || '/', '^(xd00\\d{5})/$', 1) AS accession_id FROM bids_datasets) WHERE accession_id <> '' ORDER BY 1")
def src6_accessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.accessions(table(spark, d, "bids_datasets").select(F.concat("accession_id", F.lit("/")).alias("prefix")), r"^(xd00\d{5})/$")


@_query("""WITH n AS (SELECT c_custkey % 100 AS dataset_id, count(*) FILTER (c_mktsegment = 'BUILDING') AS m, count(*) FILTER (c_mktsegment = 'MACHINERY') AS f, count(*) FILTER (c_mktsegment = 'FURNITURE') AS o FROM customer GROUP BY 1)
    SELECT dataset_id, 'sub-' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS participant_id, CASE WHEN i <= m THEN 'M' WHEN i <= m + f THEN 'F' ELSE 'O' END AS sex FROM (SELECT *, unnest(range(1, m + f + o + 1)) AS i FROM n)""")
def src12_synthetic_participants(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy((F.col("c_custkey") % 100).alias("dataset_id"))
    return ingest.synthetic_participants(c.agg(*[F.count_if(F.col("c_mktsegment") == s).alias(n) for n, s in (("males", "BUILDING"), ("females", "MACHINERY"), ("others", "FURNITURE"))]))


@_query("SELECT dataset_id, task, CASE WHEN bool_or(lower(datatype) = 'eeg') OVER (PARTITION BY dataset_id) THEN 'eeg' ELSE 'func' END AS datatype, CAST(NULL AS VARCHAR) AS subject FROM (SELECT dataset_id, task, max(CASE WHEN datatype = 'eeg' THEN 'eeg' END) AS datatype FROM bids_objects WHERE task IS NOT NULL GROUP BY dataset_id, task)")
def src13_stub_objects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "bids_objects").filter(F.col("task").isNotNull()).groupBy("dataset_id").agg(F.array_sort(F.collect_set("task")).alias("tasks"), F.array(F.max(F.when(F.col("datatype") == "eeg", "EEG"))).alias("modalities"))
    return ingest.stub_objects(o)


@_query("SELECT o.id, coalesce(n.license, o.license) AS license, o.name FROM (SELECT DISTINCT id, name, license FROM bids_datasets) o LEFT JOIN (SELECT DISTINCT id, 'CC0' AS license FROM bids_datasets WHERE license ILIKE 'cc-0') n ON n.id = o.id UNION ALL SELECT 'new', 'CC0', NULL")
def snk1_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bids_datasets").select("id", "name", "license").distinct()
    new = old.filter(F.lower("license") == "cc-0").select("id", F.lit("CC0").alias("license")).union(spark.createDataFrame([("new", "CC0")], "id string, license string"))
    return ingest.upsert(old, new, ["id"], ["license"])


@_query("SELECT DISTINCT id FROM bids_datasets WHERE id NOT IN (SELECT DISTINCT dataset_id FROM bids_participants) ORDER BY id")
def snk4_pending(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "bids_participants").select(F.col("dataset_id").alias("id"))
    return ingest.pending(table(spark, d, "bids_datasets").select("id").distinct(), done, "id")


@_query("SELECT b.id, coalesce(v.most, b.validation_status) AS validation_status FROM (SELECT DISTINCT id, validation_status FROM bids_datasets) b LEFT JOIN (SELECT dataset_id, max(datatype) AS most FROM bids_objects GROUP BY dataset_id) v ON v.dataset_id = b.id")
def jn12_update_from_aggregate(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "bids_objects").groupBy(F.col("dataset_id").alias("id")).agg(F.max("datatype").alias("validation_status"))
    return ingest.fill(table(spark, d, "bids_datasets").select("id", "validation_status").distinct(), "id", "validation_status", values)


@_query("SELECT job, dataset, message, CASE WHEN contains(lower(message), 'json') THEN 'JSON decode' WHEN contains(lower(message), 'timeout') THEN 'timeout' ELSE 'other' END AS category FROM (SELECT event_id // 100 AS job, 'ds' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS dataset, min_by(CASE WHEN value < 5 THEN 'JSON broke' WHEN value < 20 THEN 'a Timeout' ELSE 'odd' END, event_id) AS message FROM events WHERE event_type = 'error' GROUP BY 1, 2)")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'")
    message = F.when(F.col("value") < 5, "JSON broke").when(F.col("value") < 20, "a Timeout").otherwise("odd")
    lines = e.select(F.floor(F.col("event_id") / 100).cast("long").alias("job"), F.col("event_id").alias("line_no"), F.concat(F.lit("[crawler] Error indexing ds"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(": "), message).alias("line"))
    return curation.first_errors(lines)


@_query("SELECT CASE WHEN value < 5 THEN 'JSON decode' WHEN value < 20 THEN 'timeout' ELSE 'other' END AS category, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def ag25_error_counts(spark: SparkSession, d: str) -> DataFrame:
    message = F.when(F.col("value") < 5, "JSON broke").when(F.col("value") < 20, "a Timeout").otherwise("odd")
    lines = table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("[FAIL] ds"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(" | "), message, F.lit(" | indexed=0")).alias("value"))
    return flows.classified_errors(lines).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT p_name AS from_name, max_by(p_partkey, (p_retailprice, -p_partkey)) AS best FROM part GROUP BY p_name")
def best_match_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("from_name")).agg(F.max_by("p_partkey", F.struct("p_retailprice", (-F.col("p_partkey")).alias("n"))).alias("best"))


@_query("SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5")
def wn4_topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5").select("p_brand", "p_partkey", "place")


# --- events -----------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@_query("SELECT user_id, usage_date, used, greatest(used - 20, 0) AS rejected FROM (SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) AS used FROM events GROUP BY 1, 2)")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return flows.daily_quota(_events(spark, d)).select("user_id", "usage_date", "used", "rejected")


@_query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_day_window(spark: SparkSession, d: str) -> DataFrame:
    return flows.window_counts(_events(spark, d)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@_query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def event_session_gap(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessions(_events(spark, d)).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@_query("SELECT count(*) FILTER (event_type <> 'error') AS indexed, count(*) FILTER (event_type = 'error') AS errors, strftime(max(ts) FILTER (event_type = 'error'), '%Y-%m-%d %H:%M:%S') AS last_error FROM events")
def ss2_running_counters(spark: SparkSession, d: str) -> DataFrame:
    return flows.running_counters(_events(spark, d)).select("indexed", "errors", F.date_format("last_error", "yyyy-MM-dd HH:mm:ss").alias("last_error"))
