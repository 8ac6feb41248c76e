"""Query plans to DataFrames.

Conditions on the dataset row are predicates. All existence and absence tests on objects become flags of one aggregation per dataset, those on participants likewise,
so each fact table is read once and only one row per dataset and task is shuffled. Catalyst picks the join strategy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions import documents
from siftworks.plans.catalogue import Catalogue, contains_text, result
from siftworks.plans.plan import Cohort, MetadataFilter, QueryPlan, Scan

#: Task words too vague to filter by.
VAGUE_TASK_WORDS = frozenset({"cognitive", "social", "emotional", "linguistic", "sensory"})
#: Endings of diagnosis codes left out of the stem that is searched for in names.
STEM_ENDINGS = ("_disease", "_disorder", "_syndrome")


def compare(left: Column, operator: str, right: Column | float | str) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[operator]


def json_test(column: Column, test: MetadataFilter) -> Column:
    """A member test: numbers by `try_cast`, strings case-insensitively, presence of a non-null member. Broken JSON has no members."""
    member = documents.member(column, test.json_field)
    if test.operator == "exists":
        return member.isNotNull()
    if test.operator == "not_exists":
        return member.isNull()
    if isinstance(test.value, str):
        if test.operator in ("=", "!="):
            found = contains_text(member, test.value)
            return found if test.operator == "=" else ~found
        return compare(member, test.operator, F.lit(test.value))
    return compare(member.try_cast("double"), test.operator, F.lit(float(test.value)))


def _any_of(column: str, values: tuple[str, ...] | list[str]) -> Column:
    return F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(list(values))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def cohort_condition(cohort: Cohort) -> Column:
    """All properties on one participant row. A NULL or NaN age never matches an age bound."""
    tests = [_any_of(c, v) for c, v in (("diagnosis", cohort.diagnosis), ("sex", cohort.sex), ("handedness", cohort.handedness)) if v]
    if cohort.age_min is not None or cohort.age_max is not None:
        tests.append(~F.isnan("age"))
    if cohort.age_min is not None:
        tests.append(F.col("age") >= cohort.age_min)
    if cohort.age_max is not None:
        tests.append(F.col("age") <= cohort.age_max)
    tests += [json_test(F.col("extra"), x) for x in cohort.extra]
    return _all(tests)


def scan_condition(scan: Scan) -> Column:
    tests = [_any_of(c, v) for c, v in (("datatype", scan.datatype), ("suffix", scan.suffix), ("task", scan.task)) if v]
    return _any(tests) if scan.any_field else _all(tests)


def _keep(datasets: DataFrame, keys: DataFrame) -> DataFrame:
    """Datasets among the keys. Keys are made distinct before they meet the datasets: partial aggregation leaves one row per dataset and task."""
    return datasets.join(keys.select(F.col("dataset_id").alias("_key")).distinct(), F.col("id") == F.col("_key"), "left_semi")


def _flags(facts: DataFrame, conditions: list[Column]) -> DataFrame:
    """(_key, f0, f1, ...): which conditions any row of a dataset meets, all in one pass over the fact table and one small shuffle."""
    met = facts.filter(_any(conditions)).groupBy(F.col("dataset_id").alias("_key"))
    return met.agg(*[F.max(c).alias(f"f{i}") for i, c in enumerate(conditions)])


def _require(datasets: DataFrame, facts: DataFrame, tests: list[tuple[Column, bool]], combine=_all) -> DataFrame:
    """Datasets with a row that meets each wanted condition and none that meets an unwanted one."""
    if not tests:
        return datasets
    flags = _flags(facts, [c for c, _ in tests])
    held = [F.coalesce(F.col(f"f{i}"), F.lit(False)) for i in range(len(tests))]
    wanted = combine([h if need else ~h for h, (_, need) in zip(held, tests)])
    # Where every condition is wanted, datasets without any matching row can't pass.
    how = "inner" if all(need for _, need in tests) else "left"
    return datasets.join(flags, F.col("id") == F.col("_key"), how).filter(wanted).drop("_key", *[f"f{i}" for i in range(len(tests))])


def cohort_keys(cat: Catalogue, cohort: Cohort) -> DataFrame:
    """Datasets with a participant of the cohort, or with at least `min_participants` distinct ones."""
    people = cat.participants.filter(cohort_condition(cohort)).select("dataset_id", "participant_id")
    if cohort.min_participants:
        return people.groupBy("dataset_id").agg(F.countDistinct("participant_id").alias("n")).filter(F.col("n") >= cohort.min_participants)
    return people


def same_subject_keys(cat: Catalogue, scans: list[Scan]) -> DataFrame:
    """Datasets with a subject that has every scan: one pass with a flag per scan, aggregated by (dataset, subject)."""
    flags = [F.max(scan_condition(s).cast("int")).alias(f"has{i}") for i, s in enumerate(scans)]
    wanted = cat.objects.filter(F.col("subject").isNotNull() & _any([scan_condition(s) for s in scans]))
    return wanted.groupBy("dataset_id", "subject").agg(*flags).filter(_all([F.col(f"has{i}") == 1 for i in range(len(scans))])).select("dataset_id")


def session_keys(cat: Catalogue, least: int) -> DataFrame:
    """Datasets with a subject that has at least `least` distinct sessions; NULL sessions don't count."""
    return cat.objects.filter(F.col("subject").isNotNull()).groupBy("dataset_id", "subject").agg(F.countDistinct("session").alias("n")).filter(F.col("n") >= least).select("dataset_id")


def comparison_keys(cat: Catalogue, left: Cohort, operator: str, right: Cohort) -> DataFrame:
    """Datasets where the distinct participants of the cohorts compare as asked; both are counted in one aggregation."""
    a, b = cohort_condition(left), cohort_condition(right)
    counts = cat.participants.filter(a | b).groupBy("dataset_id").agg(F.countDistinct(F.when(a, F.col("participant_id"))).alias("a"), F.countDistinct(F.when(b, F.col("participant_id"))).alias("b"))
    return counts.filter(compare(F.col("a"), operator, F.col("b")))


def metric_values(cat: Catalogue, metric: str) -> DataFrame:
    """(dataset_id, metric_value) per dataset."""
    if metric == "avg_age":
        people = cat.participants.filter((F.col("age") >= 0) & ~F.isnan("age")).select("dataset_id", "participant_id", "age").distinct()
        return people.groupBy("dataset_id").agg(F.avg("age").alias("metric_value"))
    if metric == "participant_count":
        return cat.participants.groupBy("dataset_id").agg(F.countDistinct("participant_id").cast("double").alias("metric_value"))
    return cat.objects.groupBy("dataset_id").agg(F.countDistinct("id").cast("double").alias("metric_value"))


def fallback_word(term: str) -> str:
    """The longest word of at least four letters (the first of equals), else the whole term."""
    words = [w for w in term.split() if len(w) >= 4]
    return max(words, key=len) if words else term


def stem(code: str) -> str:
    for ending in STEM_ENDINGS:
        if code.endswith(ending):
            return code[: -len(ending)]
    return code


def drop_vague(terms: list[str]) -> list[str]:
    """Task words without those that name no task."""
    return [t for t in terms if t.lower() not in VAGUE_TASK_WORDS]


def row_conditions(plan: QueryPlan) -> list[Column]:
    """Predicates on the dataset row alone."""
    tests = []
    for column, names in (("authors", plan.authors), ("funding", plan.funding)):
        if len(names) == 1:
            tests.append(F.array_contains(column, names[0]))
        elif names:
            tests.append(F.arrays_overlap(F.col(column), F.array(*map(F.lit, names))))
    if plan.institution_search:
        tests.append(F.exists("institutions", lambda x: contains_text(x, plan.institution_search)))
    for column, text in (("name", plan.name_search), ("description_text", plan.description_search), ("license", plan.license_search)):
        if text:
            tests.append(contains_text(F.col(column), text))
    if plan.doi_required is not None:
        has = F.col("doi").isNotNull() & (F.col("doi") != "")
        tests.append(has if plan.doi_required else ~has)
    for term in plan.unresolved:
        word = fallback_word(term)
        tests.append(F.coalesce(contains_text(F.col("name"), word) | contains_text(F.col("description_text"), word), F.lit(False)))
    return tests


def base(plan: QueryPlan, cat: Catalogue) -> DataFrame:
    """Datasets that satisfy every condition of the plan, whole rows."""
    plan.validate()
    datasets = cat.datasets.filter(_all(row_conditions(plan)))
    sized = [c for c in plan.cohorts if c.min_participants]
    if plan.cohorts and plan.disease_fallback:
        datasets = _with_disease_fallback(plan, cat, datasets)
    elif sized and plan.cohort_operator == "OR":
        datasets = _keep(datasets, reduce(lambda a, b: a.unionByName(b), [cohort_keys(cat, c).select("dataset_id") for c in plan.cohorts]))
    else:
        for cohort in sized:
            datasets = _keep(datasets, cohort_keys(cat, cohort))
        present = [(cohort_condition(c), True) for c in plan.cohorts if not c.min_participants]
        datasets = _require(datasets, cat.participants, present, _any if plan.cohort_operator == "OR" else _all)
    tests = [(scan_condition(s), s.required) for s in plan.scans if not (s.required and s.same_subject)]
    if plan.metadata:
        # All tests on one object.
        tests.append((_all([json_test(F.col("other_entities"), m) for m in plan.metadata]), True))
    datasets = _require(datasets, cat.objects, tests)
    together = [s for s in plan.scans if s.required and s.same_subject]
    if together:
        datasets = _keep(datasets, same_subject_keys(cat, together))
    if plan.min_sessions:
        datasets = _keep(datasets, session_keys(cat, plan.min_sessions))
    if plan.comparison:
        datasets = _keep(datasets, comparison_keys(cat, plan.comparison.left, plan.comparison.operator, plan.comparison.right))
    return datasets


def _with_disease_fallback(plan: QueryPlan, cat: Catalogue, datasets: DataFrame) -> DataFrame:
    """A participant with the diagnosis, or the diagnosis' stem in name or description."""
    keys = reduce(lambda a, b: a.unionByName(b), [cohort_keys(cat, c).select("dataset_id") for c in plan.cohorts]).distinct().withColumnRenamed("dataset_id", "_key")
    stems = [stem(code) for c in plan.cohorts for code in c.diagnosis]
    named = _any([F.coalesce(contains_text(F.col(col), s), F.lit(False)) for s in stems for col in ("name", "description_text")])
    return datasets.join(keys, F.col("id") == F.col("_key"), "left").filter(F.col("_key").isNotNull() | named).drop("_key")


def compile_plan(plan: QueryPlan, cat: Catalogue) -> DataFrame:
    """The plan's result: the fixed projection with `subject_count`, `metric_value` for aggregate plans; ordered and cut where the plan says so."""
    out = cat.with_counts(base(plan, cat))
    if plan.min_subjects is not None:
        out = out.filter(F.col("subject_count") >= plan.min_subjects)
    extra = []
    if plan.metric:
        values = metric_values(cat, plan.metric).withColumnRenamed("dataset_id", "_of")
        out = out.join(values, F.col("id") == F.col("_of"), "left").drop("_of")
        extra = ["metric_value"]
    projected = out.select(*result(out).columns, *extra)
    if plan.order_by:
        key = F.col(plan.order_by)
        projected = projected.orderBy(key.desc_nulls_last() if plan.descending else key.asc_nulls_last(), F.col("id"))
    return projected.limit(plan.limit) if plan.limit else projected


def summary(plan: QueryPlan) -> str:
    """One line per condition of the plan, for logs and `explain`."""
    lines = [plan.family.value]
    lines += [f"cohort {c.name}: {', '.join(f'{k}={v}' for k, v in vars(c).items() if k != 'name' and v not in ((), None))}" for c in plan.cohorts]
    lines += [f"{'with' if s.required else 'without'} {' '.join(f'{k}={list(v)}' for k, v in (('datatype', s.datatype), ('suffix', s.suffix), ('task', s.task)) if v)}{' on one subject' if s.same_subject else ''}" for s in plan.scans]
    lines += [f"{m.json_field} {m.operator} {'' if m.value is None else m.value}".rstrip() for m in plan.metadata]
    lines += [f"{k}: {getattr(plan, k)}" for k in ("authors", "funding", "institution_search", "name_search", "description_search", "license_search", "doi_required", "min_sessions", "min_subjects", "metric", "unresolved", "order_by", "limit") if getattr(plan, k) not in (None, ())]
    return "\n".join(lines)
