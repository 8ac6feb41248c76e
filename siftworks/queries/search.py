"""One query per plan family, then ranking, paging and the joins, filters and aggregates behind them, on the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftworks.functions import documents
from siftworks.operators import resolver
from siftworks.plans import ranking, sqltext
from siftworks.plans.catalogue import Catalogue, contains_text, result
from siftworks.plans.compiler import base, cohort_condition, compile_plan, scan_condition
from siftworks.plans.plan import Cohort, Comparison, Family, MetadataFilter, QueryPlan, Scan, ScoredCode

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Deduplicated datasets and their subject counts, as the SQL forms use them.
_D = "d AS (SELECT DISTINCT ON (id) * FROM bids_datasets), sc AS (SELECT dataset_id, count(DISTINCT subject) AS n FROM bids_objects WHERE subject IS NOT NULL GROUP BY dataset_id)"
_SELECT = "SELECT d.id, d.accession_id, coalesce(sc.n, 0) AS subject_count FROM d LEFT JOIN sc ON sc.dataset_id = d.id"


def _sql(where: str, with_: str = "", tail: str = "") -> str:
    return f"WITH {_D}{', ' + with_ if with_ else ''} {_SELECT} WHERE {where} {tail}"


def _query(name: str, sql: str | None = None):
    def add(f):
        f.__name__ = name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _plan(name: str, plan, sql: str, columns: tuple[str, ...] = ("id", "accession_id", "subject_count")) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cat = Catalogue(spark, d)
        return compile_plan(plan(cat) if callable(plan) else plan, cat).select(*columns)

    _query(name, sql)(run)


def _listed(field: str, *codes: str) -> str:
    return f"(SELECT unnest(list_concat([standard_code, label], synonyms)) FROM vocab_terms WHERE field_name = '{field}' AND standard_code IN ({', '.join(repr(c) for c in codes)}))"


def _spelt(cat: Catalogue, field: str, *codes: str) -> tuple[str, ...]:
    return tuple(cat.spellings(field, list(codes)))


_O = "EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND {})"
_P = "EXISTS (SELECT 1 FROM bids_participants p WHERE p.dataset_id = d.id AND {})"

_plan("qf1_concept", lambda c: QueryPlan(Family.CONCEPT, scans=(Scan(task=_spelt(c, "task", "quiet_rest", "eyes_closed_rest")),), min_subjects=2, order_by="subject_count"),
      _sql(_O.format(f"o.task IN {_listed('task', 'quiet_rest', 'eyes_closed_rest')}") + " AND coalesce(sc.n, 0) >= 2"))
_plan("qf2_participant_filter", lambda c: QueryPlan(Family.PARTICIPANT, cohorts=(Cohort("patients", diagnosis=_spelt(c, "diagnosis", "major_depression", "healthy_volunteer"), sex=_spelt(c, "sex", "female"), min_participants=2),)),
      _sql(f"(SELECT count(DISTINCT participant_id) FROM bids_participants p WHERE p.dataset_id = d.id AND p.diagnosis IN {_listed('diagnosis', 'major_depression', 'healthy_volunteer')} AND p.sex IN {_listed('sex', 'female')}) >= 2"))
_plan("qf3_comparison", lambda c: QueryPlan(Family.COMPARISON, comparison=Comparison(Cohort(sex=_spelt(c, "sex", "male")), ">", Cohort(sex=_spelt(c, "sex", "female")))),
      _sql(f"(SELECT count(DISTINCT participant_id) FROM bids_participants p WHERE p.dataset_id = d.id AND p.sex IN {_listed('sex', 'male')}) > (SELECT count(DISTINCT participant_id) FROM bids_participants p WHERE p.dataset_id = d.id AND p.sex IN {_listed('sex', 'female')})"))
_plan("qf4_age", QueryPlan(Family.AGE, cohorts=(Cohort(age_min=60, age_max=75),)), _sql(_P.format("NOT isnan(p.age) AND p.age BETWEEN 60 AND 75")))
_plan("qf5_scan_filter", lambda c: QueryPlan(Family.SCAN, scans=(Scan(datatype=("eeg",), task=_spelt(c, "task", "tone_oddball")),)),
      _sql(_O.format(f"(o.datatype = 'eeg' OR o.task IN {_listed('task', 'tone_oddball')})")))
_plan("qf5_scan_task_and_suffix", lambda c: QueryPlan(Family.SCAN, scans=(Scan(suffix=("bold", "eeg"), task=_spelt(c, "task", "quiet_rest"), any_field=False),)),
      _sql(_O.format(f"o.suffix IN ('bold', 'eeg') AND o.task IN {_listed('task', 'quiet_rest')}")))
_plan("qf6_multimodal", QueryPlan(Family.MULTIMODAL, scans=(Scan(datatype=("func",)), Scan(suffix=("T1w",)), Scan(datatype=("dwi",)))),
      _sql(" AND ".join(_O.format(x) for x in ("o.datatype = 'func'", "o.suffix = 'T1w'", "o.datatype = 'dwi'"))))
_plan("qf7_absence", QueryPlan(Family.ABSENCE, scans=(Scan(datatype=("eeg",), required=False),)), _sql("NOT " + _O.format("o.datatype = 'eeg'")))
_plan("qf8_same_subject", QueryPlan(Family.SUBJECT_MULTIMODAL, scans=(Scan(suffix=("T1w",), same_subject=True), Scan(suffix=("bold",), same_subject=True))),
      _sql("d.id IN (SELECT dataset_id FROM bids_objects WHERE subject IS NOT NULL GROUP BY dataset_id, subject HAVING bool_or(suffix = 'T1w') AND bool_or(suffix = 'bold'))"))
_plan("qf9_array_member", QueryPlan(Family.AUTHOR, authors=("Rebecca Nanvahid",)), _sql("list_contains(d.authors, 'Rebecca Nanvahid')"))
_plan("qf9_array_overlap", QueryPlan(Family.AUTHOR, authors=("Olivia Nansohut", "Teresa Wolceliv", "Gregory Pukgicet")), _sql("list_has_any(d.authors, ['Olivia Nansohut', 'Teresa Wolceliv', 'Gregory Pukgicet'])"))
_plan("qf10_text_search", QueryPlan(Family.DESCRIPTION, name_search="contrast", description_search="logs"), _sql("d.name ILIKE '%contrast%' AND d.description_text ILIKE '%logs%'"))
_plan("qf10_description", QueryPlan(Family.DESCRIPTION, description_search="behavioural logs"), _sql("d.description_text ILIKE '%behavioural logs%'"))
_plan("qf11_presence", QueryPlan(Family.DOI, doi_required=True), _sql("d.doi IS NOT NULL AND d.doi <> ''"))
_plan("qf11_absence", QueryPlan(Family.DOI, doi_required=False), _sql("d.doi IS NULL OR d.doi = ''"))
_plan("qf12_license_like", QueryPlan(Family.LICENSE, license_search="cc"), _sql("d.license ILIKE '%cc%'"))
_plan("qf13_funding", QueryPlan(Family.FUNDING, funding=("Grant C-8143", "Grant B-3295")), _sql("list_has_any(d.funding, ['Grant C-8143', 'Grant B-3295'])"))
_J = "json_extract_string(CASE WHEN json_valid(o.other_entities) THEN o.other_entities END, '$.{}')"
_plan("qf14_json_numeric", QueryPlan(Family.JSON_NUMERIC, metadata=(MetadataFilter("SliceCount", ">=", 60), MetadataFilter("MultibandFactor", "<", 4))),
      _sql(_O.format(f"TRY_CAST({_J.format('SliceCount')} AS DOUBLE) >= 60 AND TRY_CAST({_J.format('MultibandFactor')} AS DOUBLE) < 4")))
_plan("qf15_json_exists", QueryPlan(Family.METADATA, metadata=(MetadataFilter("voxel_vol", "exists"), MetadataFilter("Manufacturer", "not_exists"))),
      _sql(_O.format(f"{_J.format('voxel_vol')} IS NOT NULL AND {_J.format('Manufacturer')} IS NULL")))
_plan("qf15_json_text", QueryPlan(Family.METADATA, metadata=(MetadataFilter("Manufacturer", "=", "corvex"),)), _sql(_O.format(f"{_J.format('Manufacturer')} ILIKE '%corvex%'")))
_plan("qf16_sessions", QueryPlan(Family.SESSION, min_sessions=3), _sql("d.id IN (SELECT dataset_id FROM bids_objects WHERE subject IS NOT NULL GROUP BY dataset_id, subject HAVING count(DISTINCT session) >= 3)"))
_plan("qf17_topn", QueryPlan(Family.RANKING, order_by="subject_count", limit=25), _sql("true", tail="ORDER BY subject_count DESC NULLS LAST, d.id LIMIT 25"))


@_query("qf18_avg", f"WITH {_D}, a AS (SELECT DISTINCT dataset_id, participant_id, age FROM bids_participants WHERE age >= 0 AND NOT isnan(age)) SELECT d.id, (SELECT round(avg(age), 6) FROM a WHERE a.dataset_id = d.id) AS metric_value FROM d")
def _mean_age(spark: SparkSession, d: str) -> DataFrame:
    return compile_plan(QueryPlan(Family.AGGREGATE, metric="avg_age"), Catalogue(spark, d)).select("id", F.round("metric_value", 6).alias("metric_value"))


_plan("qf18_participants", QueryPlan(Family.AGGREGATE, metric="participant_count"),
      f"WITH {_D} SELECT d.id, (SELECT CAST(count(DISTINCT participant_id) AS DOUBLE) FROM bids_participants p WHERE p.dataset_id = d.id HAVING count(*) > 0) AS metric_value FROM d", ("id", "metric_value"))
_plan("qf19_combined", lambda c: QueryPlan(Family.COMBINED, cohorts=(Cohort(handedness=_spelt(c, "handedness", "right")),), scans=(Scan(datatype=("func",)), Scan(datatype=("eeg",), required=False)), doi_required=True, min_subjects=2),
      _sql(_P.format(f"p.handedness IN {_listed('handedness', 'right')}") + " AND " + _O.format("o.datatype = 'func'") + " AND NOT " + _O.format("o.datatype = 'eeg'") + " AND d.doi <> '' AND coalesce(sc.n, 0) >= 2"))
_plan("jn7_cohorts_any", lambda c: QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(diagnosis=_spelt(c, "diagnosis", "glioblastoma")), Cohort(diagnosis=_spelt(c, "diagnosis", "concussion"))), cohort_operator="OR"),
      _sql(_P.format(f"p.diagnosis IN {_listed('diagnosis', 'glioblastoma', 'concussion')}")))
_plan("jn7_cohorts_all", lambda c: QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(diagnosis=_spelt(c, "diagnosis", "healthy_volunteer")), Cohort(diagnosis=_spelt(c, "diagnosis", "concussion")))),
      _sql(_P.format(f"p.diagnosis IN {_listed('diagnosis', 'healthy_volunteer')}") + " AND " + _P.format(f"p.diagnosis IN {_listed('diagnosis', 'concussion')}")))
_plan("disease_fallback_or", lambda c: QueryPlan(Family.PARTICIPANT, cohorts=(Cohort(diagnosis=("sleep_disorder", "essential_tremor")),), disease_fallback=True),
      _sql(_P.format("p.diagnosis IN ('sleep_disorder', 'essential_tremor')") + " OR d.name ILIKE '%sleep%' OR d.description_text ILIKE '%sleep%' OR d.name ILIKE '%essential\\_tremor%' ESCAPE '\\' OR d.description_text ILIKE '%essential\\_tremor%' ESCAPE '\\'"))
_plan("vocab_miss_and", QueryPlan(Family.DESCRIPTION, unresolved=("the sleep", "of quality")), _sql("(d.name ILIKE '%sleep%' OR d.description_text ILIKE '%sleep%') AND (d.name ILIKE '%quality%' OR d.description_text ILIKE '%quality%')"))
_plan("flt7_unnest_like", QueryPlan(Family.AUTHOR, institution_search="univ"), _sql("EXISTS (SELECT 1 FROM (SELECT unnest(d.institutions) AS x) WHERE x ILIKE '%univ%')"))


@_query("prj1_projection", f"WITH {_D} SELECT d.id, name, accession_id, bids_version, dataset_type, source_type, remote_url, validation_status, array_to_string(authors, '|') AS authors, array_to_string(institutions, '|') AS institutions, description_text, coalesce(sc.n, 0) AS subject_count FROM d LEFT JOIN sc ON sc.dataset_id = d.id")
def _projection(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    return result(cat.with_counts(cat.datasets)).withColumns({c: F.array_join(c, "|") for c in ("authors", "institutions")})


@_query("st5_fallback_sample", _sql("true", tail="ORDER BY d.name NULLS LAST, d.id LIMIT 200"))
def _fallback(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    return compile_plan(QueryPlan(Family.RANKING, order_by="name", descending=False, limit=200), cat).select("id", "accession_id", "subject_count")


_CODES = (ScoredCode("task", "quiet_rest", 1.0), ScoredCode("task", "QR", 0.8), ScoredCode("task", "QR", 0.6), ScoredCode("suffix", "bold", 0.5), ScoredCode("diagnosis", "healthy_volunteer", 0.9))
_RANK = f"""WITH {_D}, s(field, code, score) AS (VALUES ('task', 'quiet_rest', 1.0::DOUBLE), ('task', 'QR', 0.8), ('suffix', 'bold', 0.5), ('diagnosis', 'healthy_volunteer', 0.9))
SELECT d.id, coalesce(sc.n, 0) AS subject_count, round((SELECT coalesce(sum(score), 0) FROM s WHERE
    (field = 'task' AND EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND o.task = s.code))
 OR (field = 'suffix' AND EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND o.suffix = s.code))
 OR (field = 'diagnosis' AND EXISTS (SELECT 1 FROM bids_participants p WHERE p.dataset_id = d.id AND p.diagnosis = s.code))), 4) AS relevance_score
FROM d LEFT JOIN sc ON sc.dataset_id = d.id"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    return ranking.relevance(compile_plan(QueryPlan(Family.CONCEPT), cat), cat, list(_CODES)).select("id", "subject_count", "relevance_score")


@_query("relevance_rank", _RANK)
def _rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ordered(_ranked(spark, d))


@_query("page_offset", f"{_RANK} ORDER BY relevance_score DESC, subject_count DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def _page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_of(ranking.ordered(_ranked(spark, d)), 3, 20)


@_query("count_total", "SELECT count(DISTINCT id) AS total FROM bids_datasets d WHERE d.doi <> ''")
def _total(spark: SparkSession, d: str) -> DataFrame:
    return base(QueryPlan(Family.DOI, doi_required=True), Catalogue(spark, d)).agg(F.count(F.lit(1)).alias("total"))


@_query("participants_capped", """SELECT dataset_id, participant_id, position FROM (
    SELECT dataset_id, participant_id, row_number() OVER (PARTITION BY dataset_id ORDER BY participant_id NULLS FIRST, id) AS position FROM (SELECT DISTINCT ON (id) * FROM bids_participants)
    WHERE dataset_id IN (SELECT id FROM bids_datasets)) WHERE position <= 50""")
def _participants(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    return ranking.participants_of(cat, cat.datasets).select("dataset_id", "participant_id", F.col("position").cast("long").alias("position"))


@_query("jn1_left_outer_counts", "SELECT d.id, count(DISTINCT o.subject) AS subject_count, count(DISTINCT o.id) AS files FROM (SELECT DISTINCT id FROM bids_datasets) d LEFT JOIN bids_objects o ON o.dataset_id = d.id AND o.subject IS NOT NULL GROUP BY d.id")
def _left_outer(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    counts = cat.objects.filter(F.col("subject").isNotNull()).groupBy("dataset_id").agg(F.countDistinct("subject").alias("s"), F.countDistinct("id").alias("f"))
    return cat.datasets.join(counts, F.col("id") == F.col("dataset_id"), "left").select("id", F.coalesce("s", F.lit(0)).alias("subject_count"), F.coalesce("f", F.lit(0)).alias("files"))


@_query("ag3_having", "SELECT dataset_id, count(DISTINCT subject) AS subject_count FROM bids_objects WHERE subject IS NOT NULL GROUP BY dataset_id HAVING count(DISTINCT subject) >= 5")
def _having(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).subject_counts().filter("subject_count >= 5")


@_query("ag4_conditional_counts", f"""SELECT dataset_id, count(DISTINCT CASE WHEN sex IN {_listed('sex', 'male')} THEN participant_id END) AS males, count(DISTINCT CASE WHEN sex IN {_listed('sex', 'female')} THEN participant_id END) AS females
    FROM bids_participants GROUP BY dataset_id""")
def _conditional(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    m, f = (cohort_condition(Cohort(sex=_spelt(cat, "sex", s))) for s in ("male", "female"))
    return cat.participants.groupBy("dataset_id").agg(F.countDistinct(F.when(m, F.col("participant_id"))).alias("males"), F.countDistinct(F.when(f, F.col("participant_id"))).alias("females"))


@_query("ag13_mean_age", "SELECT dataset_id, round(avg(age), 6) AS mean_age, count(*) AS n FROM (SELECT DISTINCT dataset_id, participant_id, age FROM bids_participants WHERE age >= 0 AND NOT isnan(age)) GROUP BY dataset_id")
def _mean_age(spark: SparkSession, d: str) -> DataFrame:
    people = Catalogue(spark, d).participants.filter((F.col("age") >= 0) & ~F.isnan("age")).select("dataset_id", "participant_id", "age").distinct()
    return people.groupBy("dataset_id").agg(F.round(F.avg("age"), 6).alias("mean_age"), F.count(F.lit(1)).alias("n"))


@_query("ag14_sessions_per_subject", "SELECT dataset_id, subject, count(DISTINCT session) AS sessions FROM bids_objects WHERE subject IS NOT NULL GROUP BY dataset_id, subject")
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).objects.filter(F.col("subject").isNotNull()).groupBy("dataset_id", "subject").agg(F.countDistinct("session").alias("sessions"))


@_query("jn13_page_lookup", "SELECT DISTINCT id, dataset_id, participant_id FROM bids_participants WHERE dataset_id IN (SELECT id FROM (SELECT DISTINCT id FROM bids_datasets) ORDER BY id LIMIT 20)")
def _lookup(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    page = cat.datasets.select("id").orderBy("id").limit(20)
    return cat.participants.join(F.broadcast(page.withColumnRenamed("id", "k")), F.col("dataset_id") == F.col("k"), "left_semi").select("id", "dataset_id", "participant_id").distinct()


@_query("jn6_one_row_conditions", f"SELECT DISTINCT dataset_id FROM bids_participants WHERE diagnosis IN {_listed('diagnosis', 'healthy_volunteer')} AND sex IN {_listed('sex', 'male')} AND NOT isnan(age) AND age >= 20")
def _one_row(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    return cat.participants.filter(cohort_condition(Cohort(diagnosis=_spelt(cat, "diagnosis", "healthy_volunteer"), sex=_spelt(cat, "sex", "male"), age_min=20))).select("dataset_id").distinct()


@_query("flt3_not_in", "SELECT DISTINCT id, suffix FROM bids_objects WHERE suffix NOT IN ('bold', 'T1w', 'eeg')")
def _not_in(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).objects.filter(~F.col("suffix").isin("bold", "T1w", "eeg")).select("id", "suffix").distinct()


@_query("flt14_paradigm_expansion", "SELECT DISTINCT dataset_id FROM bids_objects WHERE task IN ('film_watching', 'story_listening', 'music_listening', 'WAF', 'LST', 'LMU')")
def _paradigm(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).objects.filter(scan_condition(Scan(task=("film_watching", "story_listening", "music_listening", "WAF", "LST", "LMU")))).select("dataset_id").distinct()


@_query("flt20_json_text", "SELECT DISTINCT id FROM bids_objects WHERE contains(other_entities, 'hires')")
def _json_text(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).objects.filter(F.contains("other_entities", F.lit("hires"))).select("id").distinct()


@_query("flt21_work_queue", "SELECT id, accession_id FROM (SELECT DISTINCT ON (id) * FROM bids_datasets) WHERE source_type = 'archive' AND remote_url IS NOT NULL AND doi IS NULL ORDER BY accession_id")
def _queue(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).datasets.filter("source_type = 'archive' AND remote_url IS NOT NULL AND doi IS NULL").orderBy("accession_id").select("id", "accession_id")


@_query("flt4_like_escaped", "SELECT DISTINCT id FROM bids_objects WHERE task ILIKE '%t\\_r%' ESCAPE '\\'")
def _escaped(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).objects.filter(contains_text(F.col("task"), "t_r")).select("id").distinct()


@_query("jn9_context_fetch", """SELECT dataset_id, text, place FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY strategy, text) AS place FROM (
    SELECT dataset_id, text, min(strategy) AS strategy FROM (
        SELECT o.dataset_id, d.name AS text, 1 AS strategy FROM bids_objects o JOIN bids_datasets d ON d.id = o.dataset_id WHERE o.task = 'QR' AND d.name IS NOT NULL
        UNION ALL SELECT d.id, d.description_text, 2 FROM bids_datasets d WHERE d.description_text ILIKE '%rest%') GROUP BY dataset_id, text)) WHERE place <= 3""")
def _context(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    keys = cat.objects.filter("task = 'QR'").select("dataset_id").distinct()
    first = cat.datasets.join(keys, F.col("id") == F.col("dataset_id")).filter("name IS NOT NULL").select("dataset_id", F.col("name").alias("text"), F.lit(1).alias("strategy"))
    second = cat.datasets.filter(contains_text(F.col("description_text"), "rest")).select(F.col("id").alias("dataset_id"), F.col("description_text").alias("text"), F.lit(2).alias("strategy"))
    both = first.unionByName(second).groupBy("dataset_id", "text").agg(F.min("strategy").alias("strategy"))
    w = Window.partitionBy("dataset_id").orderBy("strategy", "text")
    return both.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("dataset_id", "text", "place")


@_query("tr10_live_and_missing", "SELECT standard_code AS code, bool_or(standard_code IN (SELECT DISTINCT task FROM bids_objects WHERE task IS NOT NULL)) AS live FROM vocab_terms GROUP BY standard_code")
def _live(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    return resolver.live_and_missing(cat.vocabulary.select(F.col("standard_code").alias("code")), cat.objects, "task")


@_query("so3_spellings_in_use", "SELECT field_name, standard_code, s AS spelling FROM (SELECT field_name, standard_code, unnest(list_concat([standard_code, label], synonyms)) AS s FROM vocab_terms WHERE field_name = 'task') WHERE s IN (SELECT task FROM bids_objects WHERE task IS NOT NULL)")
def _in_use(spark: SparkSession, d: str) -> DataFrame:
    cat = Catalogue(spark, d)
    listed = cat.vocabulary.filter("field_name = 'task'").select("field_name", "standard_code", F.explode(F.concat(F.array("standard_code", "label"), "synonyms")).alias("spelling"))
    return listed.join(cat.objects.select(F.col("task").alias("spelling")).distinct(), "spelling", "left_semi").select("field_name", "standard_code", "spelling")


@_query("js1_members", "SELECT DISTINCT id, json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.Manufacturer') AS manufacturer FROM bids_objects WHERE json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.Manufacturer') IS NOT NULL")
def _members(spark: SparkSession, d: str) -> DataFrame:
    out = Catalogue(spark, d).objects.select("id", documents.member(F.col("other_entities"), "Manufacturer").alias("manufacturer"))
    return out.filter(F.col("manufacturer").isNotNull()).distinct()


@_query("js2_numbers", "SELECT DISTINCT id, TRY_CAST(trim(json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.VoxelVolume')) AS DOUBLE) AS volume FROM bids_objects WHERE TRY_CAST(trim(json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.VoxelVolume')) AS DOUBLE) > 25 AND NOT isnan(TRY_CAST(trim(json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.VoxelVolume')) AS DOUBLE))")
def _numbers(spark: SparkSession, d: str) -> DataFrame:
    out = Catalogue(spark, d).objects.select("id", documents.number(F.col("other_entities"), "VoxelVolume").alias("volume"))
    return out.filter((F.col("volume") > 25) & ~F.isnan("volume")).distinct()


_TEXT = """[SQL]
SELECT d.id, d.name, COUNT(DISTINCT o.subject) AS subject_count
FROM bids_datasets d LEFT JOIN bids_objects o ON o.dataset_id = d.id AND o.subject IS NOT NULL
WHERE EXISTS (SELECT 1 FROM bids_objects x WHERE x.dataset_id = d.id AND x.task = 'rest_group' AND (x.other_entities->>'SliceCount')::float >= 30)
  AND o.suffix = 'bold' AND d.doi IS NOT NULL AND 'Rebecca Nanvahid' = ANY(d.authors)
GROUP BY d.id HAVING COUNT(DISTINCT o.subject) > 1;
[/SQL]"""


@_query("sql_front_end", f"""WITH {_D} SELECT d.id, coalesce(sc.n, 0) AS subject_count FROM d LEFT JOIN sc ON sc.dataset_id = d.id WHERE sc.n > 1 AND d.doi IS NOT NULL AND list_contains(d.authors, 'Rebecca Nanvahid')
    AND EXISTS (SELECT 1 FROM bids_objects o WHERE o.dataset_id = d.id AND o.task IN ('quiet_rest', 'QR', 'Quiet rest') AND TRY_CAST({_J.format('SliceCount')} AS DOUBLE) >= 30)""")
def _front_end(spark: SparkSession, d: str) -> DataFrame:
    return sqltext.run(_TEXT, Catalogue(spark, d), {"rest_group": ["quiet_rest", "QR", "Quiet rest"]}).select("id", "subject_count")
