"""Free terms to codes: exact, bridge, fuzzy, vectors. Each tier takes what the tiers before left, by anti-join; the vocabulary side is a bounded table."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.documents import norm
from siftworks.functions.similarity import near_labels, token_set_ratio
from siftworks.functions.text import DESCRIPTORS, normal, plural_variants, without_words
from siftworks.operators.vectors import nearest
from siftworks.operators.vocabulary import prune_parents
from siftworks.session import cut, small

FUZZY, FUZZY_TASK, NAME_SCORE, WEIGHT_STEP, LEAST_KEY, TOP = 80.0, 88.0, 60.0, 8.0, 3, 20
VECTOR_TIERS = (0.75, 0.65)


def exact(terms: DataFrame, groups: DataFrame, leaves: DataFrame, leaf_first: bool = False) -> DataFrame:
    """(term, code, score 1): the first variant that is a group or leaf term; groups before leaves unless `leaf_first`."""
    variants = terms.select("term", F.posexplode(plural_variants(normal(F.col("term")))).alias("v", "variant")).distinct()
    a = groups.select(F.col("term").alias("variant"), "codes", F.lit(int(leaf_first)).alias("kind"))
    b = leaves.select(F.col("term").alias("variant"), F.array("code").alias("codes"), F.lit(int(not leaf_first)).alias("kind"))
    found = variants.join(a.unionByName(b), "variant")
    best = found.groupBy("term").agg(F.min_by("codes", F.struct("v", "kind")).alias("codes"))
    return best.select("term", F.explode("codes").alias("code"), F.lit(1.0).alias("score"))


def pool(display: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, codes, weight) that fuzzy matching compares with: labels of at least three letters; a group takes the place of an equal leaf."""
    leaf = display.select(F.col("term").alias("label"), F.array("code").alias("codes"), "weight")
    group = groups.select(F.col("term").alias("label"), "codes")
    both = leaf.join(group.withColumnRenamed("codes", "g"), "label", "full").select("label", F.coalesce("g", "codes").alias("codes"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return both.filter(F.length("label") >= LEAST_KEY)


def scored(terms: DataFrame, labels: DataFrame, text: str = "term", least: float = FUZZY) -> DataFrame:
    """Every term with its TOP nearest labels of at least `least` points. Distinct texts meet only the labels that can score so high (`similarity.near_labels`)."""
    asked = terms.withColumn("_text", normal(F.col(text)))
    near = near_labels(asked.select(F.col("_text").alias("text")).distinct(), labels.select("label").distinct(), least).withColumnRenamed("text", "_text")
    pairs = asked.join(near, "_text").join(labels, "label").drop("_text")
    w = Window.partitionBy("term").orderBy(F.desc("points"), F.desc(F.length("label")), "label")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= TOP)


def fuzzy(terms: DataFrame, labels: DataFrame, least: float = FUZZY) -> DataFrame:
    """(term, code, score): the best label (the longest of equals) if it passes its weight-adjusted threshold. A best label of weight below a half is generic: the
    term without descriptive words is scored again, and every label that passes its own threshold and isn't short gives its codes."""
    need = F.lit(least) + (F.lit(1.0) - F.col("weight")) * WEIGHT_STEP
    near = cut(scored(terms.select("term").distinct(), labels, least=least).withColumn("need", need))
    best = near.filter("place = 1").filter((F.col("points") >= F.lit(least)) & (F.col("points") >= F.col("need")))
    clear = best.filter("weight >= 0.5").select("term", F.explode("codes").alias("code"), (F.col("points") / 100).alias("score"))
    vague = best.filter("weight < 0.5").select("term", F.col("codes").alias("own"), F.col("points").alias("own_points"), without_words(normal(F.col("term")), DESCRIPTORS).alias("core"))
    again = scored(vague, labels, "core", least).withColumn("need", need)
    wide = again.filter((F.col("points") >= F.col("need")) & (F.length("label") >= F.greatest(F.floor(F.length("core") / 2), F.lit(5))))
    spread = wide.select("term", F.explode("codes").alias("code"), (F.col("points") / 100).alias("score")).groupBy("term", "code").agg(F.max("score").alias("score"))
    kept = vague.join(spread.select("term").distinct(), "term", "left_anti").select("term", F.explode("own").alias("code"), (F.col("own_points") / 100).alias("score"))
    return clear.unionByName(spread).unionByName(kept)


def bridge(terms: DataFrame, constructs: DataFrame, measures: DataFrame, least: float = FUZZY) -> DataFrame:
    """(term, code, score) through constructs: the construct of the term (exact, else the nearest label), all constructs below it, and the tasks that measure them.

    `constructs` is (label, codes) as from `group_terms` or `pool`; `measures` (construct, task_code)."""
    same = terms.select("term", normal(F.col("term")).alias("label")).join(constructs.select("label", "codes"), "label").select("term", "codes", F.lit(1.0).alias("score"))
    left = terms.join(same.select("term"), "term", "left_anti")
    near = scored(left.select("term").distinct(), constructs, least=least).filter(F.col("place") == 1).filter(F.col("points") >= least).select("term", "codes", (F.col("points") / 100).alias("score"))
    found = same.unionByName(near).select("term", "score", F.explode("codes").alias("construct")).join(measures, "construct")
    return found.groupBy("term", F.col("task_code").alias("code")).agg(F.max("score").alias("score"))


def nearest_vectors(queries: DataFrame, index: DataFrame, tiers: tuple[float, ...] = VECTOR_TIERS) -> DataFrame:
    """(term, code, score): the nearest indexed vector by cosine if it reaches a tier; the first tier that has one wins. `queries` (term, vector), `index` (tier, code, vector).

    One pass of blocked products per tier over normalised vectors; zero vectors are near to nothing."""
    unit = lambda df: df.filter(norm(F.col("vector")) > 0).withColumn("vector", F.transform("vector", lambda x: x.cast("double") / norm(F.col("vector"))))
    out, asked = None, unit(queries.select(F.col("term").alias("id"), "vector"))
    for tier, floor in enumerate(tiers, 1):
        # Equal codes of a tier may have several vectors, so rows are numbered by content.
        held = unit(index.filter(F.col("tier") == tier).select("code", "vector")).withColumn("id", F.concat_ws("\u0001", "code", F.xxhash64("vector").cast("string")))
        best = nearest(asked, held.select("id", "vector")).select(F.col("query_id").alias("term"), F.split("id", "\u0001")[0].alias("code"), "score").filter(F.col("score") >= floor).withColumn("tier", F.lit(tier))
        out = best if out is None else out.unionByName(best)
    first = out.groupBy("term").agg(F.min_by(F.struct("code", "score"), F.struct("tier", (-F.col("score")).alias("s"), "code")).alias("b"))
    return first.select("term", "b.*")


def alternate(terms: DataFrame, groups: DataFrame, leaves: DataFrame, display: DataFrame, paths: DataFrame, field: str | None = None) -> DataFrame:
    """(field, code) by the other resolver: exact terms with leaves before groups, else the best of the three nearest labels with FUZZY points at least, a longer one of as
    many points before it; equal codes once, and no code that is an ancestor of another of the same field. `terms` is (term) or (field, term); `paths` as from `ancestor_paths`."""
    held = terms.withColumn("field", F.col(field) if field else F.lit("all"))
    same = exact(held.select("term").distinct(), groups, leaves, leaf_first=True).select("term", "code")
    left = held.select("term").distinct().join(same.select("term"), "term", "left_anti")
    near = scored(left, pool(display, groups)).filter("place <= 3")
    top = Window.partitionBy("term")
    best = near.withColumn("most", F.max("points").over(top)).filter(F.col("points") == F.col("most")).groupBy("term").agg(F.max_by("codes", F.struct(F.length("label"), "label")).alias("codes"))
    found = same.unionByName(best.select("term", F.explode("codes").alias("code")))
    codes = held.join(found, "term").select("field", "code").distinct()
    return prune_parents(codes, paths, "field")


def resolution_path(terms: DataFrame, known: DataFrame, labels: DataFrame, least: float = 75.0) -> DataFrame:
    """(term, path) for evaluation: `exact` where the term is known as it stands or with blanks or dashes written as underscores or dashes as blanks, `fuzzy` where a label is near, else `vector`.

    `known` is (term) of groups and leaves, in lower case; `labels` (label)."""
    low = F.lower("term")
    forms = F.array_distinct(F.array(low, F.replace(low, F.lit(" "), F.lit("_")), F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("-"), F.lit(" "))))
    distinct = terms.select("term").distinct()
    same = distinct.select("term", F.explode(forms).alias("form")).join(known.select(F.col("term").alias("form")).distinct(), "form").select("term").distinct()
    left = distinct.join(same, "term", "left_anti").withColumn("text", low)
    near = near_labels(left.select("text").distinct(), labels.select("label").distinct(), least).select("text").distinct().withColumn("_near", F.lit(True))
    rest = left.join(near, "text", "left").select("term", F.when(F.col("_near"), "fuzzy").otherwise("vector").alias("path"))
    return same.withColumn("path", F.lit("exact")).unionByName(rest)


def resolve(terms: DataFrame, groups: DataFrame, leaves: DataFrame, display: DataFrame, task: bool = False, constructs: DataFrame | None = None, measures: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(term, code, score, path) by the tiers in order."""
    out = exact(terms, groups, leaves).withColumn("path", F.lit("exact"))
    tiers = []
    if task and constructs is not None and measures is not None:
        tiers.append(("bridge", lambda left: bridge(left, constructs, measures)))
    tiers.append(("fuzzy", lambda left: fuzzy(left, pool(display, groups), FUZZY_TASK if task else FUZZY)))
    if vectors is not None:
        tiers.append(("vector", lambda left: nearest_vectors(vectors[0].join(left.select("term"), "term", "left_semi"), vectors[1])))
    for path, tier in tiers:
        left = terms.select("term").distinct().join(out.select("term"), "term", "left_anti")
        out = out.unionByName(tier(left).withColumn("path", F.lit(path)))
    return out


def unresolved(terms: DataFrame, resolved: DataFrame) -> DataFrame:
    return terms.select("term").distinct().join(resolved.select("term"), "term", "left_anti")


def live_and_missing(codes: DataFrame, data: DataFrame, column: str) -> DataFrame:
    """(code, live): whether any row of the data has the code."""
    there = data.select(F.col(column).alias("code")).distinct().withColumn("_there", F.lit(True))
    return codes.select("code").distinct().join(there, "code", "left").select("code", F.coalesce("_there", F.lit(False)).alias("live"))


def names(terms: DataFrame, listed: DataFrame, least: float = NAME_SCORE, most: int = TOP, block: int = 1_000) -> DataFrame:
    """(term, name, score): names of a list whose words agree with the term's, without regard to case, best first, at most `most`.

    The list grows with the data, the terms asked for don't: they travel with the tasks in blocks of `block`, and each task keeps its `most` best names per term and
    batch before anything is shuffled."""
    asked = [r[0] for r in terms.select("term").filter(F.col("term").isNotNull()).distinct().orderBy("term").toLocalIterator()]
    spread = listed.select("name").filter(F.col("name").isNotNull()).distinct()
    schema, out = "term string, name string, points double", None
    for at in range(0, max(1, len(asked)), block):
        some = [(t, t.lower()) for t in asked[at : at + block]]

        def run(batches: Iterator[pd.DataFrame], some: list[tuple[str, str]] = some) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                low = [(n, n.lower()) for n in pdf["name"]]
                rows = []
                for term, text in some:
                    found = ((token_set_ratio(text, x), n) for n, x in low)
                    rows += [(term, n, points) for points, n in heapq.nsmallest(most, ((p, n) for p, n in found if p >= least), key=lambda f: (-f[0], f[1]))]
                yield pd.DataFrame(rows, columns=["term", "name", "points"])

        part = spread.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("term").orderBy(F.desc("points"), "name")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("term", "name", (F.col("points") / 100).alias("score"), "place")


def search_fields(terms: DataFrame, modality: list[str], generic: list[str]) -> DataFrame:
    """(term, field) to search for a scan term: all three fields; no task for modality and generic terms, no suffix for generic ones."""
    low = normal(F.col("term"))
    fields = F.array(F.lit("datatype"), F.when(~low.isin(generic), F.lit("suffix")), F.when(~low.isin(modality + generic), F.lit("task")))
    return terms.select("term", F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("field"))


def contradictions(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, severity, message), hard ones first: rules all of whose triggers and any of whose incompatible codes are among `codes` (field, code).

    `rules`: rule_id, severity, message, role (`trigger` or `incompatible`), field, codes; the code `*` matches any code of the field."""
    have = codes.groupBy("field").agg(F.collect_set("code").alias("have"))
    met = rules.join(small(have), "field", "left").withColumn("met", F.coalesce(F.when(F.array_contains("codes", "*"), F.size("have") > 0).otherwise(F.arrays_overlap("codes", "have")), F.lit(False)))
    out = met.groupBy("rule_id", "severity", "message").agg(F.min(F.when(F.col("role") == "trigger", F.col("met").cast("int"))).alias("t"), F.max(F.when(F.col("role") == "incompatible", F.col("met").cast("int"))).alias("i"))
    return out.filter("t = 1 and i = 1").orderBy(F.when(F.col("severity") == "hard", 0).otherwise(1), "rule_id").select("rule_id", "severity", "message")
