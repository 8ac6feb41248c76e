"""Normalising and auditing stored values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.similarity import near_labels
from siftworks.functions.text import JUNK_PATTERNS, content_words, first_match, without_separators
from siftworks.operators.vectors import pairs_above

#: Severities of collisions by score.
SEVERITIES = ((100.0, "CRITICAL"), (95.0, "HIGH"), (90.0, "MEDIUM"))
HIGH_WEIGHT, VECTOR_COLLISION = 0.7, 0.85


def first_rewrite(mapping: DataFrame) -> DataFrame:
    """(raw, canonical) in lower-case raw, the first by position per raw."""
    w = Window.partitionBy(F.lower("raw")).orderBy("position", "canonical")
    return mapping.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.lower("raw").alias("raw"), "canonical")


def canonicalise(data: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """`column` rewritten where its lower-case value is a raw value of the mapping. NULL stays NULL."""
    m = mapping.select(F.lower("raw").alias("_raw"), F.col("canonical").alias("_canonical"))
    return data.join(m, F.lower(column) == F.col("_raw"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_raw", "_canonical")


def canonicalise_scoped(data: DataFrame, column: str, scope: str, mapping: DataFrame) -> DataFrame:
    """As `canonicalise`, for the data sets a mapping row names (`accession_ids`); runs after the global one, on values still raw."""
    m = mapping.select(F.lower("raw").alias("_raw"), F.col("canonical").alias("_canonical"), F.explode("accession_ids").alias("_scope")).groupBy("_raw", "_scope").agg(F.min("_canonical").alias("_canonical"))
    return data.join(m, (F.lower(column) == F.col("_raw")) & (F.col(scope) == F.col("_scope")), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_raw", "_canonical", "_scope")


def rewrite_counts(data: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Dry run: (raw, canonical, rows) that a rewrite would touch; values are counted before they meet the mapping."""
    counts = data.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("raw")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(mapping.select(F.lower("raw").alias("raw"), "canonical"), "raw").select("raw", "canonical", "rows")


def value_counts(data: DataFrame, column: str) -> DataFrame:
    return data.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def value_sources(data: DataFrame, column: str, source: str, most: int | None = None) -> DataFrame:
    """(value, sources, source_count): the sources of each value, sorted; at most `most` are shown."""
    pairs = data.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value"), F.col(source).alias("source")).distinct()
    grouped = pairs.groupBy("value").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("source").alias("source_count"))
    return grouped.withColumn("sources", F.slice("sources", 1, most)) if most else grouped


def unmapped(data: DataFrame, column: str, covered: DataFrame) -> DataFrame:
    """Distinct values that no covered code equals, without regard to case and outer blanks."""
    codes = covered.select(F.lower(F.trim(covered.columns[0])).alias("_code")).distinct()
    values = data.filter(F.col(column).isNotNull() & (F.trim(column) != "")).select(F.col(column).alias("value")).distinct()
    return values.join(codes, F.lower(F.trim("value")) == F.col("_code"), "left_anti")


def mapping_states(data: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """(state, values): how many distinct values are mapped, filtered (mapped to nothing), passed through as they are, or unknown. `mapping` is (raw, canonical or NULL)."""
    m = mapping.select(F.lower("raw").alias("_raw"), F.col("canonical").alias("_canonical")).withColumn("_known", F.lit(True))
    values = data.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value")).distinct().join(m, F.lower("value") == F.col("_raw"), "left")
    state = F.when(F.col("_known").isNull(), "unknown").when(F.col("_canonical").isNull(), "filtered").when(F.col("_canonical") == F.col("value"), "pass-through").otherwise("mapped")
    return values.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("values"))


def coverage(codes: DataFrame, data: DataFrame, column: str) -> DataFrame:
    """(code, present): whether the data has a code, without regard to case."""
    there = data.filter(F.col(column).isNotNull()).select(F.lower(column).alias("_c")).distinct().withColumn("_there", F.lit(True))
    return codes.select("code").distinct().join(there, F.lower("code") == F.col("_c"), "left").select("code", F.coalesce("_there", F.lit(False)).alias("present"))


def junk_counts(data: DataFrame, column: str, examples: int = 8) -> DataFrame:
    """(pattern, values, examples): distinct values that match a junk pattern, with the first ones."""
    found = data.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("pattern", first_match(F.col("value"), JUNK_PATTERNS)).filter(F.col("pattern").isNotNull())
    w = Window.partitionBy("pattern").orderBy("value")
    counts = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"))
    first = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= examples).groupBy("pattern").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return counts.join(first, "pattern").select("pattern", "values", "examples")


def dictionary_match(values: DataFrame, dictionary: DataFrame, least: int = 4) -> DataFrame:
    """(value, canonical): exact match of the value without separators, else the first dictionary pattern (by position) of at least `least` letters it contains.

    Equal values are joined first. The rest is blocked by the first `least` letters of the patterns: a value that contains a pattern contains those at some place, so
    its substrings of that length are joined with them and only the pairs that agree are compared."""
    d = dictionary.select(without_separators(F.col("pattern")).alias("_p"), "canonical", "position").filter("_p IS NOT NULL")
    v = values.select("value").distinct().withColumn("_v", without_separators(F.col("value")))
    same = v.join(d, F.col("_v") == F.col("_p")).groupBy("value").agg(F.min_by("canonical", F.struct("position", "canonical")).alias("canonical"))
    rest = v.join(same, "value", "left_anti").filter(F.length("_v") >= least)
    pieces = rest.withColumn("_g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_v") - (least - 1)), lambda i: F.substring("_v", i, F.lit(least))))))
    keyed = d.filter(F.length("_p") >= least).withColumn("_g", F.substring("_p", 1, least))
    held = pieces.join(keyed, "_g").filter(F.contains(F.col("_v"), F.col("_p"))).groupBy("value").agg(F.min_by("canonical", F.struct("position", "canonical")).alias("canonical"))
    return same.unionByName(held)


def ranked_examples(examples: DataFrame, asked: DataFrame, families: list[str], most: int = 5) -> DataFrame:
    """(ask, question, family, code_overlap, word_overlap, place): the examples nearest to each request, by codes in common, then content words, then the family's
    priority (the request's own family 2, `families` 1, others 0), then the question; equal questions once.

    `examples`: question, family, codes; `asked`: ask, text, family, codes. Examples are a curated table; each request meets those with a code or a word in common through
    an equality join, and the others only where too few of these are there: by the family alone, which needs no pair."""
    words = lambda c: F.coalesce(content_words(c), F.array().cast("array<string>"))
    e = examples.groupBy("question").agg(F.min_by(F.struct("family", F.coalesce("codes", F.array().cast("array<string>")).alias("codes")), F.struct("family")).alias("x")).select("question", "x.family", "x.codes", words(F.col("question")).alias("words"))
    a = asked.select("ask", F.col("family").alias("_family"), F.coalesce("codes", F.array().cast("array<string>")).alias("_codes"), words(F.col("text")).alias("_words"))
    mark = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    keys_e = e.select("question", F.explode(F.concat(mark("c", F.col("codes")), mark("w", F.col("words")))).alias("k")).distinct()
    keys_a = a.select("ask", F.explode(F.concat(mark("c", F.col("_codes")), mark("w", F.col("_words")))).alias("k")).distinct()
    shared = keys_a.join(keys_e, "k").groupBy("ask", "question").agg(F.count_if(F.col("k").startswith("c")).alias("code_overlap"), F.count_if(F.col("k").startswith("w")).alias("word_overlap"))
    near = shared.join(e.select("question", "family"), "question").join(a.select("ask", "_family"), "ask")
    priority = lambda own: F.when(F.col("family") == own, 2).when(F.col("family").isin(families), 1).otherwise(0)
    # The first examples of the request's family, of the listed ones and of all: enough to fill up any request.
    each = e.select("question", "family")
    w = Window.partitionBy("family").orderBy("question")
    own = a.select("ask", "_family").join(each.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2 * most).drop("n"), F.col("_family") == F.col("family"))
    first = [r for part in (each.filter(F.col("family").isin(families)), each) for r in part.orderBy("question").limit(2 * most).collect()]
    fixed = F.array(*[F.struct(F.lit(r["question"]).alias("question"), F.lit(r["family"]).alias("family")) for r in first])
    other = a.select("ask", "_family", F.explode(fixed).alias("x")).select("ask", "_family", "x.*") if first else own.limit(0)
    spare = own.select("ask", "_family", "question", "family").unionByName(other.select("ask", "_family", "question", "family")).dropDuplicates(["ask", "question"])
    spare = spare.join(shared.select("ask", "question"), ["ask", "question"], "left_anti").select("ask", "question", F.lit(0).cast("long").alias("code_overlap"), F.lit(0).cast("long").alias("word_overlap"), "family", "_family")
    order = Window.partitionBy("ask").orderBy(F.desc("code_overlap"), F.desc("word_overlap"), F.desc(priority(F.col("_family"))), "question")
    return near.select(*spare.columns).unionByName(spare).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most).select("ask", "question", "family", "code_overlap", "word_overlap", "place")


def batch_order(nodes: DataFrame, offset: int = 0, most: int | None = None, by_text: bool = False) -> DataFrame:
    """Nodes (key, path, accession_ids, description) in the order of work: most datasets first, then the path; `by_text` weighs ten letters of description like a dataset. With
    offset and cap, a plan for the top rows only."""
    n = F.coalesce(F.size(F.array_distinct("accession_ids")), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    weight = 10 * n + F.coalesce(F.length("description"), F.lit(0)) if by_text else n
    out = nodes.withColumn("weight", weight.cast("long")).orderBy(F.desc("weight"), "path").offset(offset)
    return out.limit(most) if most is not None else out


def severity(score: Column) -> Column:
    out = F.when(score >= SEVERITIES[0][0], SEVERITIES[0][1])
    for least, name in SEVERITIES[1:]:
        out = out.when(score >= least, name)
    return out


def fuzzy_collisions(terms: DataFrame, least: float = 90.0) -> DataFrame:
    """Synonyms of a concept that read like the label or a high-weight synonym of another: severity, score and both sides.

    `terms`: field, key, term, kind (`label`/`synonym`), weight. The targets are the bounded vocabulary; synonyms meet the targets that can score high enough only (see
    `similarity.near_labels`), not all of them."""
    a = terms.filter("kind = 'synonym'").select("field", F.col("key").alias("source_key"), F.lower("term").alias("source_term"), F.col("weight").alias("source_weight")).distinct()
    b = terms.filter((F.col("kind") == "label") | (F.col("weight") >= HIGH_WEIGHT)).select("field", F.col("key").alias("target_key"), F.lower("term").alias("target_term"), F.col("kind").alias("target_kind")).distinct()
    near = near_labels(a.select(F.col("source_term").alias("text")).distinct(), b.select(F.col("target_term").alias("label")).distinct(), least)
    pairs = a.join(near.select(F.col("text").alias("source_term"), F.col("label").alias("target_term"), F.col("points").alias("score")), "source_term").join(b, ["field", "target_term"]).filter("source_key <> target_key")
    return pairs.select("field", "source_key", "source_term", "source_weight", "target_key", "target_term", "target_kind", "score").withColumn("severity", severity(F.col("score")))


def vector_collisions(vectors: DataFrame, least: float = VECTOR_COLLISION) -> DataFrame:
    """(id_a, id_b, cosine) of normalised vectors (id, vector, group) of one group, id_a < id_b."""
    return pairs_above(vectors, least).withColumnRenamed("score", "cosine")


def synonym_weights(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, term, weight) from a concept's texts: 0.6 times the part of texts with the term plus 0.4 times the occurrences on a log scale, at least 0.1; 0.5 without texts."""
    from siftworks.functions.text import occurrences

    n = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n_texts"))
    counted = terms.join(texts, "key").withColumn("c", occurrences(F.lower("text"), F.lower("term"))).groupBy("key", "term").agg(F.sum("c").alias("count"), F.count_if(F.col("c") > 0).alias("hits"))
    joined = terms.select("key", "term").distinct().join(n, "key", "left").join(counted, ["key", "term"], "left")
    part = F.col("hits") / F.col("n_texts")
    scale = F.least(F.lit(1.0), F.log2(F.lit(1.0) + F.col("count")) / F.log2(F.lit(11.0)))
    return joined.select("key", "term", F.when(F.col("n_texts").isNull(), 0.5).otherwise(F.bround(F.greatest(F.lit(0.1), 0.6 * part + 0.4 * scale), 2)).alias("weight"))


def first_errors(lines: DataFrame) -> DataFrame:
    """(job, dataset, message, category): the first failure of a data set per log. `lines`: job, line_no, line; messages about restricted data are none."""
    from siftworks.functions.text import error_category, is_restricted

    fail, crawl = r"\[FAIL\]\s+(ds\w+)\s+\|\s+(.+?)\s+\|\s+indexed=", r"\[crawler\]\s+Error indexing\s+(ds\w+):\s+(.+)"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract("line", fail, i), F.lit("")), F.nullif(F.regexp_extract("line", crawl, i), F.lit("")))
    found = lines.select("job", "line_no", part(1).alias("dataset"), part(2).alias("message")).filter(F.col("dataset").isNotNull()).filter(~is_restricted(F.col("message")))
    first = found.groupBy("job", "dataset").agg(F.min_by("message", "line_no").alias("message"))
    return first.withColumn("category", error_category(F.col("message")))
