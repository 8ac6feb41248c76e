"""Queries of the operators on language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm import canonical, leaks, mixing, names, textform
from siftworks.session import table


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_values([(table(spark, d, "bids_participants"), "id", ["diagnosis", "handedness", "sex"]), (table(spark, d, "bids_objects"), "id", ["task"])])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalise(_typed(spark, d), table(spark, d, "vocab_terms"))


def p1_value_map(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(_typed(spark, d), table(spark, d, "vocab_terms"))


#: The array columns of names and what they name.
NAME_FIELDS = {"authors": names.PERSON, "institutions": names.ORGANISATION}


def _linked(spark: SparkSession, d: str) -> DataFrame:
    datasets = table(spark, d, "bids_datasets")
    parts = [datasets.select(F.lit(f).alias("field_name"), F.explode(f).alias("name")) for f in NAME_FIELDS]
    return names.link(parts[0].unionByName(parts[1]), NAME_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(_linked(spark, d))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.classes(_linked(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Item sentences that count as shared, with the counts behind that."""
    return leaks.scan(table(spark, d, "documents"), table(spark, d, "eval_items")).excluded


def p6_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.look_alike_pairs(table(spark, d, "documents")).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: what it looks like, how it is spelt, and how many documents look the same in other characters."""
    return textform.look_alike_classes(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return textform.forms(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_value_map, p5_found, p5_entities, p6_found, p6_stretches, p6_excluded, p7_mix, p7_shares, p8_found, p8_classes, p8_forms)}
SQL: dict[str, str] = {}
