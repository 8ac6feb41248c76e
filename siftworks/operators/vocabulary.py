"""The weighted concept hierarchy: terms, weights, closure over `broader` and `part_of`, and edits of the vocabulary.

Concepts come as one row each: key, label, standard_code, broader array<string>, part_of array<string>, synonyms array<struct<term, weight>>, codes array<string>,
dataset_codes array<struct<raw, accession_ids array<string>>>, and may come from YAML (`siftworks.sources.files`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.text import slug
from siftworks.session import cut

CONCEPT = (
    "key string, label string, standard_code string, broader array<string>, part_of array<string>, synonyms array<struct<term: string, weight: double>>, "
    "codes array<string>, dataset_codes array<struct<raw: string, accession_ids: array<string>>>, position long"
)


def edges(concepts: DataFrame) -> DataFrame:
    """(parent, child) over both relations, once each."""
    parents = F.concat(F.coalesce("broader", F.array().cast("array<string>")), F.coalesce("part_of", F.array().cast("array<string>")))
    return concepts.select(F.explode(parents).alias("parent"), F.col("key").alias("child")).distinct()


def closure(pairs: DataFrame, roots: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(ancestor, descendant, depth): everything reachable, each node reaching itself at depth 0, least depth kept. Cycles end: only new pairs go on.

    One join per level; the pairs so far are anti-joined and the lineage is cut each round."""
    nodes = pairs.select(F.col("parent").alias("n")).union(pairs.select("child")).distinct()
    if roots is not None:
        nodes = roots.select(F.col(roots.columns[0]).alias("n")).distinct()
    seen = cut(nodes.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("depth")))
    frontier, step = seen, pairs.select("parent", "child")
    for depth in range(1, most + 1):
        reached = frontier.join(step, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant")).distinct()
        frontier = cut(reached.join(seen, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        # A union of checkpointed levels: nothing is computed again.
        seen = seen.unionByName(frontier)
    raise ValueError(f"more than {most} levels")


def depths(pairs: DataFrame, most: int = 1000) -> DataFrame:
    """(node, depth): 0 for roots, else one more than the deepest parent; nodes on or below a cycle never settle and have 0. More than `most` levels are refused."""
    nodes = pairs.select(F.col("parent").alias("node")).union(pairs.select("child")).distinct()
    settled = cut(nodes.join(pairs.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))
    for _ in range(most):
        parents = pairs.join(settled.withColumnRenamed("node", "parent"), "parent", "left")
        ready = parents.groupBy("child").agg(F.max("depth").alias("d"), F.count_if(F.col("depth").isNull()).alias("open")).filter("open = 0")
        new = cut(ready.select(F.col("child").alias("node"), (F.col("d") + 1).alias("depth")).join(settled.select("node"), "node", "left_anti"))
        if new.isEmpty():
            break
        settled = settled.unionByName(new)
    else:
        raise ValueError(f"more than {most} levels")
    return nodes.join(settled, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def _synonyms(concepts: DataFrame) -> DataFrame:
    """Term and weight of each synonym, blank terms out, weights within 0..1 and 1 where none is given."""
    s = concepts.select("key", "standard_code", "position", F.posexplode("synonyms").alias("i", "s"))
    return s.select("key", "standard_code", "position", "i", F.trim("s.term").alias("term"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("s.weight", F.lit(1.0)))).alias("weight")).filter("term <> ''")


def _last(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("position"), F.desc("i"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def leaf_terms(concepts: DataFrame) -> DataFrame:
    """(term, code) for exact matches: label, code, synonyms, codes and raw data set codes in lower case; the last concept wins a term."""
    coded = concepts.filter(F.col("standard_code").isNotNull())
    none = F.array().cast("array<string>")
    terms = F.concat(F.array("label", "standard_code"), F.coalesce(F.transform("synonyms", lambda s: F.trim(s["term"])), none), F.coalesce("codes", none), F.coalesce(F.transform("dataset_codes", lambda d: d["raw"]), none))
    each = coded.select(F.posexplode(terms).alias("i", "t"), F.col("standard_code").alias("code"), "position").select(F.lower("t").alias("term"), "code", "position", "i").filter("term <> ''")
    return _last(each, "term").select("term", "code")


def display_terms(concepts: DataFrame) -> DataFrame:
    """(term, code, weight) for fuzzy matches: labels with weight 1 and synonyms with theirs; the last one wins a term."""
    coded = concepts.filter(F.col("standard_code").isNotNull())
    labels = coded.filter("label <> ''").select(F.lower("label").alias("term"), F.col("standard_code").alias("code"), F.lit(1.0).alias("weight"), "position", F.lit(-1).alias("i"))
    rest = _synonyms(coded).select(F.lower("term").alias("term"), F.col("standard_code").alias("code"), "weight", "position", "i")
    return _last(labels.unionByName(rest), "term").select("term", "code", "weight")


def group_terms(concepts: DataFrame, reach: DataFrame) -> DataFrame:
    """(term, codes) of concepts with children: key, label and synonyms to the codes of all descendants and its own; equal terms merge."""
    groups = edges(concepts).select(F.col("parent").alias("key")).distinct()
    codes = reach.join(concepts.select(F.col("key").alias("descendant"), "standard_code"), "descendant").filter(F.col("standard_code").isNotNull()).select(F.col("ancestor").alias("key"), "standard_code")
    terms = concepts.join(groups, "key", "left_semi").select("key", F.explode(F.concat(F.array("key", "label"), F.coalesce(F.transform("synonyms", lambda s: F.trim(s["term"])), F.array().cast("array<string>")))).alias("t"))
    return terms.select("key", F.lower("t").alias("term")).filter("term <> ''").join(codes, "key").groupBy("term").agg(F.array_sort(F.collect_set("standard_code")).alias("codes"))


def ancestor_paths(concepts: DataFrame, reach: DataFrame) -> DataFrame:
    """(code, path): codes of all ancestors, nearest first, itself first; concepts without code are passed through."""
    coded = concepts.filter(F.col("standard_code").isNotNull()).select("key", "standard_code")
    up = reach.join(coded.select(F.col("key").alias("descendant"), F.col("standard_code").alias("code")), "descendant").join(coded.select(F.col("key").alias("ancestor"), F.col("standard_code").alias("above")), "ancestor")
    return up.groupBy("code").agg(F.array_sort(F.collect_set(F.struct("depth", "above"))).alias("p")).select("code", F.transform("p", lambda x: x["above"]).alias("path"))


def prune_parents(codes: DataFrame, paths: DataFrame, group: str) -> DataFrame:
    """`codes` (group, code) without codes that are ancestors of another code of the same group."""
    above = codes.join(paths, "code").select(group, F.col("code").alias("from"), F.explode("path").alias("code")).filter(F.col("from") != F.col("code")).select(group, "code").distinct()
    return codes.join(above, [group, "code"], "left_anti")


def broken_parents(concepts: DataFrame) -> DataFrame:
    return edges(concepts).join(concepts.select(F.col("key").alias("parent")), "parent", "left_anti")


def without_terms(concepts: DataFrame) -> DataFrame:
    """Concepts with neither label nor synonyms."""
    return concepts.filter((F.coalesce(F.trim("label"), F.lit("")) == "") & (F.coalesce(F.size("synonyms"), F.lit(0)) <= 0)).select("key")


def merged_synonyms(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """(key, term, weight): new terms after the old ones, equal terms without regard to case once, the first kept; `replace` drops the old terms of proposed keys."""
    kept = old.join(new.select("key").distinct(), "key", "left_anti") if replace else old
    both = kept.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    w = Window.partitionBy("key", F.lower("term")).orderBy("o", F.desc("weight"), "term")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").select("key", "term", F.least("weight", F.lit(1.0)).alias("weight"))


def without_listed(synonyms: DataFrame, removals: DataFrame) -> DataFrame:
    """Synonyms without the (key, term) pairs of a removal list, without regard to case."""
    gone = removals.select("key", F.lower("term").alias("_t")).distinct()
    return synonyms.join(gone, (synonyms["key"] == gone["key"]) & (F.lower(synonyms["term"]) == F.col("_t")), "left_anti")


def unique_slugs(names: DataFrame) -> DataFrame:
    """(position, name, slug): slugs of names, later ones with `_1`, `_2`, ... where they collide, in order of position."""
    w = Window.partitionBy("_s").orderBy("position")
    return names.withColumn("_s", slug(F.col("name"))).withColumn("_n", F.row_number().over(w) - 1).select("position", "name", F.when(F.col("_n") == 0, F.col("_s")).otherwise(F.concat("_s", F.lit("_"), F.col("_n").cast("string"))).alias("slug"))


def graph(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, label, depth) and links (parent, child), with a hub linked to every node of depth 0."""
    e = edges(concepts)
    d = depths(e)
    nodes = concepts.join(d.withColumnRenamed("node", "key"), "key", "left").select("key", "label", F.coalesce("depth", F.lit(0)).alias("depth"))
    hub = nodes.filter("depth = 0").select(F.lit("hub").alias("parent"), F.col("key").alias("child"))
    return nodes, e.unionByName(hub)


def rewrites(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw codes to canonical ones: (raw, canonical) for all data sets, first concept wins a raw code; (raw, canonical, accession_ids) for some. Case-only differences are none."""
    coded = concepts.filter(F.col("standard_code").isNotNull())
    each = coded.select(F.explode("codes").alias("raw"), F.col("standard_code").alias("canonical"), "position").filter(F.lower("raw") != F.lower("canonical"))
    w = Window.partitionBy(F.lower("raw")).orderBy("position")
    everywhere = each.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.lower("raw").alias("raw"), "canonical")
    scoped = coded.select(F.explode("dataset_codes").alias("d"), F.col("standard_code").alias("canonical")).filter(F.lower("d.raw") != F.lower("canonical"))
    return everywhere, scoped.select(F.lower("d.raw").alias("raw"), "canonical", F.col("d.accession_ids").alias("accession_ids"))


def apply_decisions(concepts: dict[str, dict], decisions: list[dict]) -> tuple[dict[str, dict], dict[str, int]]:
    """The vocabulary after curation decisions in order, and how many of each action were applied or skipped.

    Actions: filter, add_to_codes, add_to_dataset_codes, new_entry, new_entry_scoped. A decision builds on those before it, and a vocabulary is small, so
    this is a fold on the driver. Codes already held by any concept, unknown targets and taken keys are skipped."""
    out = {k: {**v, "codes": list(v.get("codes") or ()), "dataset_codes": [dict(d) for d in v.get("dataset_codes") or ()]} for k, v in concepts.items()}
    stats: dict[str, int] = {}
    held = {str(c).lower() for v in out.values() for c in v["codes"]}

    def scope(entry: dict, raw: str, ids: list[str]) -> None:
        for d in entry["dataset_codes"]:
            if d["raw"].lower() == raw.lower():
                d["accession_ids"] = sorted({*d.get("accession_ids", ()), *ids})
                return
        entry["dataset_codes"].append({"raw": raw, "accession_ids": sorted(set(ids))})

    for d in decisions:
        action, raw, target = d["action"], d.get("raw", ""), d.get("target")
        done = True
        if action == "filter":
            pass
        elif action == "add_to_codes" and target in out and raw.lower() not in held:
            out[target]["codes"].append(raw)
            held.add(raw.lower())
        elif action == "add_to_dataset_codes" and target in out and d.get("accession_ids"):
            scope(out[target], raw, d["accession_ids"])
        elif action == "new_entry" and target and target not in out and raw.lower() not in held:
            out[target] = {"label": d.get("label", target), "standard_code": d.get("standard_code", target), "codes": [raw], "dataset_codes": []}
            held.add(raw.lower())
        elif action == "new_entry_scoped" and target and target not in out and d.get("accession_ids"):
            out[target] = {"label": d.get("label", target), "standard_code": d.get("standard_code", target), "codes": [], "dataset_codes": []}
            scope(out[target], raw, d["accession_ids"])
        else:
            done = False
        key = action if done else "skipped"
        stats[key] = stats.get(key, 0) + 1
    return out, stats
