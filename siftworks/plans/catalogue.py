"""The catalogue tables as the plans see them: one row per key, typed for search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.session import table

#: Dataset columns of every search result, before `subject_count`.
PROJECTION = ("id", "name", "accession_id", "bids_version", "dataset_type", "source_type", "remote_url", "validation_status", "authors", "institutions", "description_text")


def current(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key. A redelivered row has the same content, so any will do; partial aggregation keeps the shuffle to one row per key and task."""
    return df.drop("crawled_at").dropDuplicates([key])


@dataclass(frozen=True)
class Catalogue:
    """Tables of one catalogue folder. Existence tests and distinct counts read the raw tables: redelivery can't change them."""

    spark: SparkSession
    folder: str

    @cached_property
    def datasets(self) -> DataFrame:
        return current(table(self.spark, self.folder, "bids_datasets"))

    @cached_property
    def objects(self) -> DataFrame:
        return table(self.spark, self.folder, "bids_objects")

    @cached_property
    def participants(self) -> DataFrame:
        return table(self.spark, self.folder, "bids_participants")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return table(self.spark, self.folder, "vocab_terms")

    def subject_counts(self) -> DataFrame:
        """(dataset_id, subject_count): distinct subjects per dataset; NULL subjects don't count. Aggregated before any join, so wide text never moves."""
        return self.objects.filter(F.col("subject").isNotNull()).groupBy("dataset_id").agg(F.countDistinct("subject").alias("subject_count"))

    def with_counts(self, datasets: DataFrame) -> DataFrame:
        """Left join of the subject count; datasets without objects keep 0."""
        counts = self.subject_counts().withColumnRenamed("dataset_id", "_counted")
        return datasets.join(counts, F.col("id") == F.col("_counted"), "left").drop("_counted").withColumn("subject_count", F.coalesce("subject_count", F.lit(0)))

    def spellings(self, field: str, codes: list[str]) -> list[str]:
        """Listed spellings of codes of a field: what `field IN (...)` compares with. Bounded by the vocabulary."""
        rows = self.vocabulary.filter((F.col("field_name") == field) & F.col("standard_code").isin(codes)).select(F.explode(F.array_distinct(F.concat(F.array("standard_code", "label"), F.coalesce("synonyms", F.array().cast("array<string>"))))).alias("s"))
        return sorted({r["s"] for r in rows.collect()})


def result(datasets: DataFrame) -> DataFrame:
    return datasets.select(*PROJECTION, "subject_count")


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring; `%`, `_` and `\\` in the text stand for themselves. NULL never matches."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")
