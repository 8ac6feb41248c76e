"""Queries of the general data-preparation operators (problems 2, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.operators import balance, units, wide
from siftworks.session import table

#: Share of all rows from which a dataset counts as heavy.
HEAVY_SHARE = 0.04
#: Members that state the unit of ages in `extra`.
AGE_UNIT_MEMBERS = ["age_unit", "unit_of_age", "ageUnit"]


def _wide(spark: SparkSession, d: str, name: str, column: str, kind: str) -> DataFrame:
    return wide.widen(table(spark, d, name), column, table(spark, d, "attribute_rows"), table(spark, d, "attribute_defs"), kind)


def _participants(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "bids_participants", "extra", "participant")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "bids_objects", "other_entities", "object")


def p2_participants_wide(spark: SparkSession, d: str) -> DataFrame:
    return _participants(spark, d).withColumn(wide.UNFIT, F.array_join(wide.UNFIT, "|"))


def p2_objects_wide(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).withColumn(wide.UNFIT, F.array_join(wide.UNFIT, "|"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unfit_cells(_participants(spark, d)).unionByName(wide.unfit_cells(_objects(spark, d)))


_COUNTS = {"n_subjects": "subject", "n_tasks": "task"}


def p3_dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    datasets = table(spark, d, "bids_datasets").select(F.col("id").alias("dataset_id"), "accession_id")
    return balance.balanced_counts(table(spark, d, "bids_objects"), "dataset_id", "id", _COUNTS, datasets, ["accession_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return balance.heavy_keys(table(spark, d, "bids_objects"), "dataset_id", "id", HEAVY_SHARE, _COUNTS).select("dataset_id")


def _converted(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, units.Quantity]]:
    known = units.quantities(table(spark, d, "unit_defs"))
    spellings = {r["attr_name"]: list(r["also_written"] or ()) for r in table(spark, d, "attribute_defs").filter(F.col("attr_name").isin([q for q in known if q != "age"])).collect()}
    objects = units.convert_members(table(spark, d, "bids_objects"), "other_entities", known, {q: spellings.get(q, []) for q in known if q != "age"})
    clues = units.age_clues(table(spark, d, "bids_datasets"), ["description_text", "readme_text"])
    ages = units.convert_ages(table(spark, d, "bids_participants"), clues, known["age"], AGE_UNIT_MEMBERS)
    return ages.unionByName(objects), known


def p4_common_units(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d)[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.off_unit(*_converted(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_participants_wide, p2_objects_wide, p3_found, p3_dataset_counts, p4_found, p4_common_units)}

_MISSING = "('', 'n/a', 'na', 'nan', 'none', 'unknown', '-')"

#: Values given, each with its attribute and whether it fits: the beginning of the SQL forms of problem 2.
_GIVEN = f"""
        WITH defs AS (SELECT owner_kind, attr_name, data_type, lower(regexp_replace(s, '[\\s_-]', '', 'g')) AS k FROM (SELECT owner_kind, attr_name, data_type, unnest(list_append(also_written, attr_name)) AS s FROM attribute_defs)),
        texts AS (SELECT 'participant' AS kind, id, extra AS t FROM bids_participants UNION SELECT 'object', id, other_entities FROM bids_objects),
        objects AS (SELECT kind, id, CASE WHEN json_type(t) = 'OBJECT' THEN t END AS t FROM (SELECT kind, id, CASE WHEN json_valid(t) THEN t END AS t FROM texts) WHERE t IS NOT NULL),
        members AS (SELECT kind, id, t, unnest(json_keys(t)) AS name, generate_subscripts(json_keys(t), 1) AS pos FROM objects WHERE t IS NOT NULL),
        given AS (SELECT kind, id, name, trim(json_extract_string(t, '$."' || name || '"'), ' \t\n\r') AS v, 0 AS src, pos, NULL AS given_at, NULL AS no FROM members UNION ALL SELECT owner_kind, owner_id, attr_name, trim(raw_value, ' \t\n\r'), 1, 0, recorded_at, row_no FROM attribute_rows),
        judged AS (SELECT g.*, d.attr_name, d.data_type, CASE d.data_type
              WHEN 'int' THEN regexp_full_match(v, '[+-]?[0-9]+(\\.0+)?')
              WHEN 'double' THEN regexp_full_match(v, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?')
              WHEN 'boolean' THEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f', '1', '0')
              WHEN 'date' THEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{8}}|[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') AND try_strptime(v, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d.%m.%Y']) IS NOT NULL
              ELSE true END AS fits
            FROM given g JOIN defs d ON d.owner_kind = g.kind AND d.k = lower(regexp_replace(g.name, '[\\s_-]', '', 'g')) WHERE v IS NOT NULL AND lower(v) NOT IN {_MISSING})"""

#: Columns of the wide tables: attribute -> data type, as attribute_defs lists them.
_COLUMNS = {
    "participant": {"bmi": "double", "education_years": "int", "iq_total": "int", "smoker": "boolean", "medicated": "boolean", "visit_date": "date", "recall_score": "double", "trial_arm": "string", "site": "string", "age_unit": "string"},
    "object": {"Manufacturer": "string", "SoftwareVersions": "string", "SliceCount": "int", "MultibandFactor": "int", "FatSaturation": "boolean", "ContentDate": "date", "VoxelVolume": "double", "acq": "string", "dir": "string", "RepetitionTime": "string", "EchoTime": "string", "MagneticFieldStrength": "string", "FlipAngle": "string"},
}
_TYPED = {"int": "CAST(split_part({0}, '.', 1) AS BIGINT)", "double": "CAST(replace({0}, ',', '.') AS DOUBLE)", "boolean": "lower({0}) IN ('true', 'yes', 'y', 't', '1')", "date": "CAST(try_strptime({0}, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d.%m.%Y']) AS DATE)", "string": "{0}"}


def _wide_sql(kind: str, source: str) -> str:
    """One row per owner: the last fitting value of each attribute, JSON before attribute rows, then by time, number, name and spelling."""
    cells = ", ".join('max(CASE WHEN attr_name = \'{0}\' THEN v END) AS "_{0}"'.format(a) for a in _COLUMNS[kind])
    columns = ", ".join(_TYPED[t].format(f'"_{a}"') + f' AS "{a}"' for a, t in _COLUMNS[kind].items())
    return f"""{_GIVEN},
        own AS (SELECT * FROM judged WHERE kind = '{kind}'),
        last AS (SELECT id, attr_name, max_by(v, row(src, pos, coalesce(given_at, TIMESTAMP '0001-01-01'), coalesce(no, -1), name, v)) FILTER (fits) AS v, NOT bool_or(fits) AS unfit FROM own GROUP BY id, attr_name),
        cells AS (SELECT id, {cells}, string_agg(attr_name, '|' ORDER BY attr_name) FILTER (unfit) AS unfit FROM last GROUP BY id),
        owners AS (SELECT id, bool_or(p) AS entity_present FROM (SELECT id, true AS p FROM {source} UNION ALL SELECT owner_id, false FROM attribute_rows WHERE owner_kind = '{kind}' AND attr_name IS NOT NULL) GROUP BY id)
        SELECT o.id, entity_present, {columns}, coalesce(unfit, '') AS unfit_attributes FROM owners o LEFT JOIN cells c ON c.id = o.id"""


#: Unit texts as patterns, by quantity: another reading than the grammar's, of the spellings the tables use.
_UNIT_TEXTS = {
    "age": {"years": "(?i)y|a|yrs?|years?|jahre?n?", "months": "(?i)mos?|mon|mths?|months?|monate?n?", "weeks": "(?i)w|wks?|weeks?|wochen?", "days": "(?i)d|dys?|days?|tage?n?"},
    **{q: {"s": "(?i)s|secs?|seconds?|sek|sekunden?", "ms": "(?i)ms|msecs?|millisecs?|milliseconds?", "us": "(?i)[uµμ]s|[uµμ]secs?|microsecs?|microseconds?"} for q in ("RepetitionTime", "EchoTime")},
    "MagneticFieldStrength": {"T": "T|(?i)teslas?", "mT": "mT|(?i)milliteslas?", "G": "G|(?i)gauss", "kG": "kG|(?i)kilogauss"},
    "FlipAngle": {"deg": "(?i)°|degs?|degrees?|grad", "rad": "(?i)rads?|radians?"},
}
_NUMBER = r"([+\-−]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([\s\S]*)"


def _code(quantity: str, unit: str) -> str:
    tests = [f"WHEN {quantity} = '{q}' AND regexp_full_match(rtrim(trim({unit}), '.'), '{p}') THEN '{c}'" for q, codes in _UNIT_TEXTS.items() for c, p in codes.items()]
    return f"CASE {' '.join(tests)} END"


_KEY = "lower(regexp_replace({}, '[\\s_-]', '', 'g'))"
_AGE_KEYS = ", ".join(f"'{units.attribute_key(m)}'" for m in AGE_UNIT_MEMBERS)


def _clue(pattern: str, group: int) -> str:
    each = ", ".join(f"nullif(regexp_extract(coalesce({c}, ''), '{pattern}', {group}), '')" for c in ("description_text", "readme_text"))
    return f"coalesce({each})"


_CONVERTED_SQL = f"""
        WITH spell AS (SELECT attr_name AS quantity, {_KEY.format('s')} AS k FROM (SELECT attr_name, unnest(list_append(also_written, attr_name)) AS s FROM attribute_defs WHERE owner_kind = 'object' AND attr_name IN (SELECT quantity FROM unit_defs))),
        objects AS (SELECT DISTINCT id, other_entities AS t FROM bids_objects WHERE CASE WHEN json_valid(other_entities) THEN json_type(other_entities) = 'OBJECT' END),
        members AS (SELECT id, {_KEY.format('name')} AS k, trim(json_extract_string(t, '$."' || name || '"'), ' \t\n\r') AS v, pos FROM (SELECT id, t, unnest(json_keys(t)) AS name, generate_subscripts(json_keys(t), 1) AS pos FROM objects)),
        near AS (SELECT id, quantity, min_by(code, pos) AS beside FROM (SELECT id, quantity, pos, {_code('quantity', 'v')} AS code FROM members m JOIN spell s ON m.k IN (s.k || 'unit', s.k || 'units')) WHERE code IS NOT NULL GROUP BY id, quantity),
        held AS (SELECT DISTINCT m.id, s.quantity, v AS raw FROM members m JOIN spell s ON m.k = s.k WHERE v IS NOT NULL AND lower(v) NOT IN {_MISSING}),
        typed AS (SELECT h.id, h.quantity, raw, TRY_CAST(replace(replace(regexp_extract(raw, '{_NUMBER}', 1), ',', '.'), '−', '-') AS DOUBLE) AS x, trim(regexp_extract(raw, '{_NUMBER}', 2)) AS unit_text, beside, CASE WHEN beside IS NOT NULL THEN 'beside' END AS source, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM held h LEFT JOIN near n ON n.id = h.id AND n.quantity = h.quantity WHERE regexp_full_match(raw, '{_NUMBER}')),
        says AS (SELECT DISTINCT id, lower({_clue(units.AGE_UNIT, 1)}) AS u, TRY_CAST({_clue(units.AGE_RANGE, 1)} AS DOUBLE) AS low, TRY_CAST({_clue(units.AGE_RANGE, 2)} AS DOUBLE) AS high, lower({_clue(units.AGE_RANGE, 3)}) AS ru FROM bids_datasets),
        clues AS (SELECT id, u, low * coalesce(f.to_common, 1) AS low, high * coalesce(f.to_common, 1) AS high FROM says LEFT JOIN unit_defs f ON f.quantity = 'age' AND f.unit_code = {_code("'age'", 'ru')}),
        people AS (SELECT DISTINCT id, dataset_id, age, extra AS t FROM bids_participants WHERE age >= 0 AND age < 'inf'::DOUBLE AND NOT isnan(age)),
        extras AS (SELECT id, min_by(code, pos) AS beside FROM (SELECT id, pos, {_code("'age'", 'v')} AS code FROM (SELECT id, {_KEY.format('name')} AS k, json_extract_string(t, '$."' || name || '"') AS v, pos FROM (SELECT id, t, unnest(json_keys(t)) AS name, generate_subscripts(json_keys(t), 1) AS pos FROM (SELECT DISTINCT id, t FROM people WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' END))) WHERE k IN ({_AGE_KEYS})) WHERE code IS NOT NULL GROUP BY id),
        aged AS (SELECT p.id, 'age' AS quantity, CAST(age AS VARCHAR) AS raw, age AS x, '' AS unit_text, coalesce(beside, {_code("'age'", 'u')}) AS beside, CASE WHEN beside IS NOT NULL THEN 'beside' WHEN {_code("'age'", 'u')} IS NOT NULL THEN 'texts' END AS source, low, high FROM people p LEFT JOIN extras e ON e.id = p.id LEFT JOIN clues c ON c.id = p.dataset_id),
        given AS (SELECT * FROM typed UNION ALL SELECT * FROM aged),
        fits AS (SELECT g.id, g.quantity, raw, low, count(*) FILTER (ok) AS n, max(unit_code) FILTER (ok) AS c, count(*) FILTER (ok AND narrow) AS nn, max(unit_code) FILTER (ok AND narrow) AS cn FROM (
            SELECT DISTINCT g.id, g.quantity, raw, low, unit_code, x * to_common BETWEEN plausible_min - 1e-9 * greatest(1, x * to_common) AND plausible_max + 1e-9 * greatest(1, x * to_common) AS ok, x * to_common BETWEEN low - 1e-9 * greatest(1, x * to_common) AND high + 1e-9 * greatest(1, x * to_common) AS narrow FROM given g JOIN unit_defs USING (quantity)) g GROUP BY g.id, g.quantity, raw, low),
        found AS (SELECT g.id, g.quantity, g.raw, g.x, CASE WHEN unit_text <> '' THEN {_code('g.quantity', 'unit_text')} WHEN beside IS NOT NULL THEN beside WHEN g.low IS NOT NULL AND nn = 1 THEN cn WHEN n = 1 THEN c ELSE (SELECT unit_code FROM unit_defs d WHERE d.quantity = g.quantity AND is_common) END AS unit_code,
            CASE WHEN unit_text <> '' THEN 'stated' WHEN source IS NOT NULL THEN source WHEN (g.low IS NOT NULL AND nn = 1) OR n = 1 THEN 'plausible' ELSE 'default' END AS how FROM given g JOIN fits f ON f.id = g.id AND f.quantity = g.quantity AND f.raw = g.raw AND f.low IS NOT DISTINCT FROM g.low)"""


SQL = {
    "p4_found": f"{_CONVERTED_SQL} SELECT DISTINCT f.id AS record_id, f.quantity, f.unit_code FROM found f JOIN unit_defs d ON d.quantity = f.quantity AND d.unit_code = f.unit_code WHERE NOT is_common",
    "p4_common_units": f"{_CONVERTED_SQL} SELECT DISTINCT f.id AS record_id, f.quantity, raw AS raw_value, x AS value, f.unit_code, x * to_common AS common_value, CASE WHEN f.unit_code IS NULL THEN 'unreadable' ELSE how END AS found_by FROM found f LEFT JOIN unit_defs d ON d.quantity = f.quantity AND d.unit_code = f.unit_code UNION ALL SELECT id, quantity, raw, NULL, NULL, NULL, 'unreadable' FROM held WHERE NOT regexp_full_match(raw, '{_NUMBER}')",
    "p2_found": _GIVEN + """
        SELECT id AS owner_id, attr_name FROM judged GROUP BY kind, id, attr_name HAVING NOT bool_or(fits)""",
    "p2_participants_wide": _wide_sql("participant", "bids_participants"),
    "p2_objects_wide": _wide_sql("object", "bids_objects"),
    "p3_found": "SELECT dataset_id FROM bids_objects WHERE dataset_id IS NOT NULL GROUP BY dataset_id HAVING count(*) >= 0.04 * (SELECT count(*) FROM bids_objects)",
    "p3_dataset_counts": """
        SELECT o.dataset_id, n_rows, n_files, n_subjects, n_tasks, accession_id
        FROM (SELECT dataset_id, count(*) AS n_rows, count(DISTINCT id) AS n_files, count(DISTINCT subject) AS n_subjects, count(DISTINCT task) AS n_tasks
              FROM bids_objects GROUP BY dataset_id) o
        LEFT JOIN (SELECT id, min(accession_id) AS accession_id FROM bids_datasets GROUP BY id) d ON d.id = o.dataset_id""",
}
