"""Quality of term resolution and of whole searches, by group and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence buckets: lower end, upper end (open), name.
BUCKETS = ((0.0, 0.5, "[0.0,0.5)"), (0.5, 0.7, "[0.5,0.7)"), (0.7, 0.9, "[0.7,0.9)"), (0.9, 1.01, "[0.9,1.0]"))


def judged(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """Per question: hit_at_1, recall_at_3, passed. `truth`: term, field, variant, expected array<string>; `answers`: term, field, codes array<string> best first."""
    joined = truth.join(answers, ["term", "field"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    wanted = F.size(F.array_distinct("expected"))
    return joined.select(
        "term", "field", "variant",
        F.coalesce(F.array_contains("expected", F.get("codes", F.lit(0))), F.lit(False)).cast("double").alias("hit_at_1"),
        F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice("codes", 1, 3), "expected")), F.least(wanted, F.lit(3))), F.lit(0.0)).alias("recall_at_3"),
        F.arrays_overlap("codes", "expected").cast("double").alias("passed"),
    )


#: Outcomes of a whole search, one flag each, and the names of their ratios.
OUTCOMES = {"passed": "pass_pct", "zero_result": "zero_result_pct", "spurious_filter": "spurious_filter_pct", "missing_filter": "missing_filter_pct", "sql_valid": "sql_valid_pct", "fallback": "fallback_pct", "schema_hallucination": "schema_hallucination_pct", "self_corrected": "self_correction_pct"}


def pipeline_metrics(results: DataFrame, group: str = "category") -> DataFrame:
    """(category, n, one ratio per outcome) per category and over all (`Overall`), in one rollup. A flag that is NULL counts as not set."""
    flags = results.select(F.coalesce(F.col(group), F.lit("Other")).alias(group), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(name) for c, name in OUTCOMES.items()])
    out = by_group(flags, group, list(OUTCOMES.values()))
    return out.withColumn(group, F.when(F.col(group) == "overall", "Overall").otherwise(F.col(group)))


def by_group(rows: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Means of the measures per group and over all (`overall`), in one rollup."""
    means = [F.round(F.avg(m), 3).alias(m) for m in measures]
    out = rows.rollup(group).agg(F.count(F.lit(1)).alias("n"), *means, F.grouping(group).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(group)).alias(group), "n", *measures)


def calibration(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """(bucket, n, accuracy) by confidence; rows without confidence are `unmatched`."""
    bucket = None
    for low, high, name in BUCKETS:
        hit = (F.col(confidence) >= low) & (F.col(confidence) < high)
        bucket = F.when(hit, name) if bucket is None else bucket.when(hit, name)
    return rows.groupBy(bucket.otherwise("unmatched").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(correct).cast("double")), 3).alias("accuracy"))
