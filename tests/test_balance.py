import random

from conftest import rows
from pyspark.sql import functions as F

from siftworks.operators import balance

SCHEMA = "id string, dataset_id string, subject string, task string, n_rows int, key string"
COUNTS = {"n_subjects": "subject", "n_tasks": "task"}


def facts(n=3000):
    r = random.Random(5)
    out = [(f"f{i}", "hot" if i % 3 == 0 else f"d{r.randrange(40)}", f"s{r.randrange(50)}" if i % 7 else None, r.choice(["a", "b", "c", None]), 1, "k") for i in range(n)]
    return out + out[:200] + [(None, "hot", "s1", "a", 1, "k"), ("x", None, "s1", "a", 1, "k"), ("x", None, "s1", "a", 1, "k")]


def brute(data):
    keys = {}
    for i, k, s, t, *_ in data:
        keys.setdefault(k, []).append((i, s, t))
    return sorted(((k, len(v), len({i for i, _, _ in v} - {None}), len({s for _, s, _ in v} - {None}), len({t for _, _, t in v} - {None})) for k, v in keys.items()), key=repr)


def test_counts_equal_brute_force_with_hot_null_and_repeated_keys(spark):
    data = facts()
    got = balance.balanced_counts(spark.createDataFrame(data, SCHEMA), "dataset_id", "id", COUNTS, slots=6)
    assert rows(got) == brute(data)


def test_matching_side_reaches_every_key_and_clashing_names_do_not_matter(spark):
    data = facts(600)
    side = spark.createDataFrame([("hot", "acc-hot", 1), ("d1", "acc-1", 2), ("d1", "acc-0", 2), ("none", "acc-n", 3)], "dataset_id string, label string, id int")
    got = balance.balanced_counts(spark.createDataFrame(data, SCHEMA), "dataset_id", "id", COUNTS, side, ["label"], slots=6)
    labels = {r["dataset_id"]: r["label"] for r in got.collect()}
    assert labels["hot"] == "acc-hot" and labels["d1"] == "acc-0" and labels["d2"] is None and "none" not in labels
    assert [r[:5] for r in rows(got)] == brute(data)


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert balance.balanced_counts(empty, "dataset_id", "id", COUNTS, slots=4).count() == 0
    assert balance.heavy_keys(empty, "dataset_id", "id", 0.1, COUNTS).count() == 0


def test_packing_splits_large_keys_and_evens_out_loads():
    plan = balance.pack(8, {i: 10 for i in range(64)}, {"hot": 900, "warm": 200}, 64)
    assert len(plan.shards["hot"]) == 5 and len(set(plan.shards["hot"])) == 5
    assert sum(plan.loads) >= 1740 and max(plan.loads) <= 1.25 * sum(plan.loads) / 8


def test_rows_of_a_hot_key_are_spread(spark):
    df = spark.createDataFrame([(f"f{i}", "hot") for i in range(4000)] + [(f"g{i}", f"d{i}") for i in range(2000)], "id string, dataset_id string")
    plan = balance.estimate(df, "dataset_id", 8)
    placed = balance.place(df, plan, "dataset_id", ["dataset_id", "id"])
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1.3 * 6000 / 8
    assert placed.filter(F.spark_partition_id() != F.col("_task")).count() == 0


def test_heavy_keys_count_repeated_rows_and_ties(spark):
    data = [(str(i), "a", None, None, 1, "") for i in range(50)] + [("1", "b", None, None, 1, "")] * 10 + [(str(i), f"c{i}", None, None, 1, "") for i in range(40)]
    got = balance.heavy_keys(spark.createDataFrame(data, SCHEMA), "dataset_id", "id", 0.1, COUNTS, slots=4)
    assert [(r["dataset_id"], r["n_rows"], r["n_files"]) for r in got.orderBy("dataset_id").collect()] == [("a", 50, 50), ("b", 10, 1)]
