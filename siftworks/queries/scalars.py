"""String, JSON, array and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions import documents, similarity, text
from siftworks.queries.ratios import scored
from siftworks.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _over(name: str, source: str, key: str, column, sql: str | None = None, output: str = "result", where: str | None = None) -> None:
    """Registers key and one computed column over a whole table. `sql` is the expression of the SQL form."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        df = df.filter(where) if where else df
        return df.select(key, column().alias(output))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = f"SELECT {key}, {sql} AS {output} FROM {source}{' WHERE ' + where if where else ''}"


_over("str1_normal", "part", "p_partkey", lambda: text.normal(F.col("p_name")), "lower(trim(p_name))")
_over("str2_without_separators", "part", "p_partkey", lambda: text.without_separators(F.col("p_name")), "regexp_replace(lower(p_name), '[\\s_\\-]+', '', 'g')")
_over("slugify", "part", "p_partkey", lambda: text.slug(F.col("p_type")), "regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')")
_over("str4_file_safe", "bids_datasets", "id", lambda: text.file_safe_tail(F.col("remote_url")), "regexp_replace(list_last(string_split(regexp_replace(remote_url, '/+$', ''), '/')), '[^A-Za-z0-9._\\-]', '_', 'g')")
_over("str5_strip_task_ending", "bids_objects", "id", lambda: text.strip_task_ending(F.col("task")), "regexp_replace(trim(task, ' '), '(?i) +(task|paradigm|test|procedure|assessment)$', '')")
_over("plural_variants", "part", "p_partkey", lambda: F.array_join(text.plural_variants(F.lower("p_name")), "|"),
      "lower(p_name) || '|' || CASE WHEN lower(p_name) LIKE '%s' AND lower(p_name) NOT LIKE '%ss' THEN lower(p_name)[:-2] ELSE lower(p_name) || 's' END || CASE WHEN lower(p_name) LIKE '%ies' THEN '|' || lower(p_name)[:-4] || 'y' WHEN lower(p_name) LIKE '%y' THEN '|' || lower(p_name)[:-2] || 'ies' ELSE '' END")
_over("keyword_pick", "bids_datasets", "id", lambda: text.keyword(F.col("name")),
      "coalesce(list_reduce(list_prepend('', list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: length(x) >= 4)), lambda a, w: CASE WHEN length(w) > length(a) THEN w ELSE a END), name)", where="name IS NOT NULL")
_over("tag_strip", "documents", "doc_id", lambda: text.strip_tags(F.col("text")), "regexp_replace(text, '<[^>]+>', ' ', 'g')")
_over("str9_clean_readme", "documents", "doc_id", lambda: F.md5(text.clean_readme(F.col("text"))),
      "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'))")
_over("head_tail_slice", "documents", "doc_id", lambda: text.head_and_tail(F.col("text"), 400), "CASE WHEN length(text) > 800 THEN text[1:400] || chr(10) || '…' || chr(10) || text[-400:] ELSE text END")
_over("url_extract", "bids_datasets", "id", lambda: F.array_join(text.urls(F.concat_ws(" ", "paper_references", "remote_url")), "|"),
      None)
SQL["url_extract"] = """SELECT id, coalesce(array_to_string(list(u ORDER BY i) FILTER (u IS NOT NULL AND i <= 20), '|'), '') AS result FROM (
    SELECT k, id, u, row_number() OVER (PARTITION BY k ORDER BY i) AS i FROM (SELECT k, id, u, min(i) AS i FROM (
        SELECT k, id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS u, generate_subscripts(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END, 1) AS i FROM (
            SELECT row_number() OVER () AS k, id, regexp_extract_all(concat_ws(' ', array_to_string(paper_references, ' '), remote_url), 'https?://\\S+') AS l FROM bids_datasets)) GROUP BY k, id, u)) GROUP BY k, id"""
_over("str12_doi", "bids_datasets", "id", lambda: text.doi(F.concat_ws(" ", "readme_text", "paper_references", "doi")), "nullif(regexp_replace(regexp_extract(concat_ws(' ', readme_text, nullif(array_to_string(paper_references, ' '), ''), doi), '\\b(10\\.\\d{4,}/\\S+)', 1), '[.,;)]+$', ''), '')")
_over("str13_first_words", "documents", "doc_id", lambda: text.first_words(F.col("text"), 12),
      "CASE WHEN len(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0b\\f\\r]+')) > 12 THEN array_to_string(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0b\\f\\r]+')[1:12], ' ') || ' [...]' ELSE text END")
_over("str15_strip_nuls", "documents", "doc_id", lambda: F.md5(documents.strip_nuls(F.regexp_replace("text", "[ae]", "$0\x00\\\\u0000"))), "md5(text)")
_over("edit_distance", "part", "p_partkey", lambda: F.levenshtein("p_name", "p_type").cast("long"), "levenshtein(p_name, p_type)")
_over("str19_threshold", "part", "p_partkey", lambda: F.lit(80.0) + (F.lit(1.0) - F.col("p_size") / F.lit(50.0)) * 8.0, "80.0::DOUBLE + (1.0::DOUBLE - p_size / 50.0::DOUBLE) * 8.0::DOUBLE")
_over("str27_author_line", "bids_datasets", "id", lambda: text.author_line(F.col("authors")), "CASE WHEN len(authors) > 3 THEN array_to_string(authors[1:3], ', ') || ' +' || (len(authors) - 3) ELSE array_to_string(authors, ', ') END", where="authors IS NOT NULL")
_over("str28_fingerprint", "documents", "doc_id", lambda: text.fingerprint(F.col("text")), "md5(text)[1:12]")
_over("regex_categorise", "documents", "doc_id", lambda: text.categorise(F.col("text")),
      "CASE " + " ".join(f"WHEN regexp_matches(text, '{text.category_pattern(w)}') THEN '{n}'" for n, w in text.CATEGORIES) + " ELSE 'Other' END", where="text IS NOT NULL")
_over("str20_error_category", "documents", "doc_id", lambda: text.error_category(F.col("text")),
      "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in text.ERROR_CATEGORIES) + " ELSE 'other' END", where="text IS NOT NULL")
_over("token_overlap", "bids_datasets", "id", lambda: F.size(F.array_intersect(text.content_words(F.col("name")), F.array(*map(F.lit, ("sleep", "quality", "retired", "teachers", "contrast"))))).cast("long"),
      "len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(trim(name)), '\\s+'), lambda x: length(x) > 2)), ['sleep', 'quality', 'retired', 'teachers', 'contrast']))", where="name IS NOT NULL")
_over("str24_unknown_tables", "documents", "doc_id", lambda: F.array_join(text.unknown_tables(F.concat(F.lit("SELECT 1 FROM bids_datasets d JOIN "), "source", F.lit(" x WHERE a = 'from nowhere'")), ("bids_datasets", "readme")), "|"),
      "CASE WHEN source IN ('readme', 'bids_datasets') THEN '' ELSE regexp_extract(source, '^[a-z_][a-z0-9_]*') END", where="source IS NOT NULL")
_over("str26_codes_in_sql", "bids_objects", "id", lambda: F.array_join(text.codes_in_sql(F.concat(F.lit("o.suffix = '"), "suffix", F.lit("' AND p.suffix IN ('T1w', '"), "datatype", F.lit("')")), "suffix"), "|"),
      "CASE WHEN suffix = 'T1w' THEN suffix || CASE WHEN datatype <> suffix THEN '|' || datatype ELSE '' END ELSE suffix || '|T1w' || CASE WHEN datatype NOT IN (suffix, 'T1w') THEN '|' || datatype ELSE '' END END")
_over("str7_without_descriptors", "documents", "doc_id", lambda: F.md5(text.without_words(F.col("text"), text.DESCRIPTORS)),
      "md5(coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in text.DESCRIPTORS) + ")), ' '), ''), lower(text)))")
_over("flt19_truncate", "bids_datasets", "id", lambda: F.substring("description_text", 1, 40), "description_text[1:40]")
_over("js4_json_array", "bids_datasets", "id", lambda: F.array_join(documents.string_array(F.to_json(F.struct(F.col("authors"))), "authors"), "|"), "array_to_string(authors, '|')")
_over("js5_scalar_or_list", "bids_objects", "id", lambda: F.array_join(documents.as_list(F.col("other_entities"), "dir"), "|"), "nullif(trim(json_extract_string(CASE WHEN json_valid(other_entities) THEN other_entities END, '$.dir'), ' '), '')")
_over("js5_list_member", "bids_datasets", "id", lambda: F.array_join(documents.as_list(F.to_json(F.struct("institutions")), "institutions"), "|"), "CASE WHEN len(institutions) > 0 THEN array_to_string(institutions, '|') END")
_over("js7_promote", "bids_datasets", "id", lambda: documents.promoted(F.col("license")), "nullif(trim(license, ' '), '')")
_over("js3_member_exists", "events", "event_id", lambda: documents.member(F.col("props"), "k").isNotNull(), "json_extract_string(props, '$.k') IS NOT NULL")
_over("js2_event_number", "events", "event_id", lambda: documents.number(F.col("props"), "k"), "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)")
_over("js9_repair", "bids_objects", "id", lambda: documents.repaired_json(F.col("other_entities")), "CASE WHEN json_valid(other_entities) THEN other_entities WHEN other_entities IS NOT NULL THEN '{}' END")
_over("str14_decode", "documents", "doc_id", lambda: F.md5(documents.decoded(F.encode("text", "UTF-16"))), "md5(text)")
_over("js10_positions_to_text", "documents", "doc_id", lambda: documents.positions_to_text(F.map_from_entries(F.transform(F.array_distinct(F.slice(F.split("source", "_"), 1, 3)), lambda w, i: F.struct(w, F.array(i, i + 5))))),
      "CASE WHEN contains(source, '_') THEN string_split(source, '_')[1] || ' ' || string_split(source, '_')[2] || ' ' || string_split(source, '_')[1] || ' ' || string_split(source, '_')[2] ELSE source || ' ' || source END", where="source IS NOT NULL")
_over("ma1_weight", "part", "p_partkey", lambda: F.bround(F.greatest(F.lit(0.1), F.lit(0.4) * F.least(F.lit(1.0), F.log2(F.col("p_size") + F.lit(1.0)) / F.log2(F.lit(11.0)))), 6),
      "round(greatest(0.1::DOUBLE, 0.4::DOUBLE * least(1.0::DOUBLE, log2(p_size + 1.0::DOUBLE) / log2(11.0::DOUBLE))), 6)")
_over("ma3_circle", "nation", "n_nationkey", lambda: F.round(F.cos(F.lit(6.283185307179586) * F.col("n_nationkey") / 25.0) * 100.0, 3), "round(cos(6.283185307179586::DOUBLE * n_nationkey / 25.0::DOUBLE) * 100.0, 3)")
_over("dt1_day_and_reset", "events", "event_id", lambda: F.date_format(F.col("ts").cast("date") + F.expr("interval 1 day"), "yyyy-MM-dd"), "strftime(CAST(ts AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d')")
_over("dt3_expired", "events", "event_id", lambda: F.col("ts") + F.expr("interval 30 minutes") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), "ts + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-05 00:00:00'")
_over("str16_weighted_ratio", "part", "p_partkey", lambda: F.round(similarity.weighted_ratio_of(F.lower("p_name"), F.lower("p_type")), 4), None)
_over("str17_token_set_ratio", "part", "p_partkey", lambda: F.round(similarity.token_set_ratio_of(F.lower("p_name"), F.lower("p_type")), 4), None)
_PAIRS = "WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), "
SQL["str16_weighted_ratio"] = _PAIRS + scored("p") + " SELECT p_partkey, round(weighted, 4) AS result FROM p JOIN scores USING (a, b)"
SQL["str17_token_set_ratio"] = _PAIRS + scored("p", False) + " SELECT p_partkey, round(token_set, 4) AS result FROM p JOIN scores USING (a, b)"


def _register(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


def ar3_distinct_elements(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "bids_participants").filter(F.col("diagnosis").isNotNull()).groupBy("dataset_id").agg(F.array_sort(F.collect_set("diagnosis")).alias("d"))
    return df.select("dataset_id", F.array_join("d", "|").alias("diagnoses"))


_register(ar3_distinct_elements, "SELECT dataset_id, array_to_string(list_sort(list(DISTINCT diagnosis)), '|') AS diagnoses FROM bids_participants WHERE diagnosis IS NOT NULL GROUP BY dataset_id")


def ag9_sorted_distinct_array(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "bids_objects").groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("suffix")), "|").alias("suffixes"))
    return df


_register(ag9_sorted_distinct_array, "SELECT dataset_id, array_to_string(list_sort(list(DISTINCT suffix) FILTER (suffix IS NOT NULL)), '|') AS suffixes FROM bids_objects GROUP BY dataset_id")


def so1_distinct_elements(spark: SparkSession, d: str) -> DataFrame:
    from siftworks.sources.files import array_elements

    return array_elements(table(spark, d, "bids_datasets"), "authors")


_register(so1_distinct_elements, "SELECT DISTINCT value FROM (SELECT unnest(authors) AS value FROM bids_datasets) WHERE value <> '' ORDER BY value")


def ar2_not_empty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bids_datasets").filter(F.size("funding") > 0).select("id").distinct()


_register(ar2_not_empty, "SELECT DISTINCT id FROM bids_datasets WHERE len(funding) > 0")


def so4_scope_union(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "bids_participants").filter("diagnosis <> ''").select(F.lower("diagnosis").alias("raw"), "dataset_id").distinct()
    return df.groupBy("raw").agg(F.array_join(F.array_sort(F.collect_set("dataset_id")), "|").alias("scope"))


def js6_without_members(spark: SparkSession, d: str) -> DataFrame:
    """Members but two, with their types: numbers stay numbers and text stays text."""
    df = table(spark, d, "bids_objects").select("id", documents.without_members(F.col("other_entities"), ["dir", "acq"]).alias("j")).distinct()
    each = df.select("id", F.explode(F.try_variant_get(F.try_parse_json("j"), "$", "map<string,variant>")).alias("member", "value"))
    kind = F.schema_of_variant("value")
    number = F.try_variant_get("value", "$", "double")
    shown = F.when(kind == "STRING", F.concat(F.lit('"'), F.try_variant_get("value", "$", "string"), F.lit('"'))).when(kind == "BOOLEAN", F.try_variant_get("value", "$", "string")).otherwise(F.round(number, 6).cast("string"))
    return each.select("id", "member", shown.alias("value"))


_register(js6_without_members, """WITH o AS (SELECT DISTINCT id, json_merge_patch(other_entities, '{"dir": null, "acq": null}') AS j FROM bids_objects WHERE json_valid(other_entities) AND json_type(other_entities) = 'OBJECT'), m AS (SELECT id, j, unnest(json_keys(j)) AS member FROM o)
    SELECT id, member, CASE json_type(j, '$."' || member || '"') WHEN 'VARCHAR' THEN '"' || json_extract_string(j, '$."' || member || '"') || '"' WHEN 'BOOLEAN' THEN json_extract_string(j, '$."' || member || '"') ELSE CAST(round(CAST(json_extract_string(j, '$."' || member || '"') AS DOUBLE), 6) AS VARCHAR) END AS value FROM m""")


_register(so4_scope_union, "SELECT lower(diagnosis) AS raw, array_to_string(list_sort(list(DISTINCT dataset_id)), '|') AS scope FROM bids_participants WHERE diagnosis <> '' GROUP BY lower(diagnosis)")
