"""Typed values mapped to the entries of a list, by a partition-based pigeonhole join; built-in SQL functions only.

1. Distinct (field, value) pairs are reduced to a compact form: full-width forms and accents folded, camel case split, lower case, letters and digits only; once with
   all words and once without the words people put around a value. Those words are learned: they stand beside listed spellings of several entries.
2. Every spelling of an entry (code, label, synonyms) is reduced alike and varied by rule: word order, words of the entry alone or in pairs, words cut short, initials.
   A form that several entries share on the same footing is none.
3. Equal forms match at once. The rest goes through the pigeonhole join: with at most k edits, one of k+1 segments of the reference string
   is in the value unchanged, at a position shifted by at most the edits before or behind it. Equal (field, length, segment number,
   segment text) give candidates, verified with `levenshtein`.
4. The nearest entry wins; a tie between entries is no match. What is left by an anti-join is reported as `unmatched`.

No spelling of any entry is held in the code. Names that no rule reaches from the list (other languages, everyday words) can be given as a table of synonyms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.session import BROADCAST_ROWS, cut, task_slots

UNMATCHED = "unmatched"
#: Edits allowed by the length of the undecorated reference string: (from length, edits).
EDITS = ((0, 0), (4, 1), (6, 2), (10, 3), (14, 4))
#: Letters up to which a swap of two letters counts as one edit where one is allowed.
LONGEST_SWAP = 5
#: Forms that cut words short are compared with one edit from this length on; shorter ones, and initials, must be equal.
LEAST_FUZZY_CUT = 7
#: Different entries of a field beside whose listed spellings a word must stand to count as a decorating word: this part of the field's entries, at least two.
DECORATED_PART = 0.2
#: Footing of the forms of an entry, best first; `matched_by` in the results.
LISTED, GIVEN, ORDERED, SHORTENED, WORDS, CUT, INITIALS = range(7)
RULES = ("listed", "synonym", "word order", "shortened word", "words of the entry", "cut words", "initials")

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
#: Accented letters and their plain forms.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Letters from which on word order is disregarded.
LEAST_SORTED = 4
#: Compact forms that mean no entry whatever they look like.
PLACEHOLDERS = ("na", "nan", "none", "null", "unknown", "unspecified", "missing", "tbd", "notasked", "declined", "excluded", "notavailable", "notapplicable", "other", "seenotes")
#: Endings that a word of a name may be given.
ENDINGS = ("s", "ing", "ed", "er", "ers")
#: Words that join the words of a name.
JOINING = ("a", "an", "and", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "under", "with")


def words(value: Column) -> Column:
    """The lower-case words of a value, as an array."""
    flat = F.translate(F.translate(value, _WIDE, _NARROW), _ACCENTED, _PLAIN)
    flat = F.regexp_replace(F.regexp_replace(flat, "ß", "ss"), "[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", "")
    flat = F.regexp_replace(flat, r"(\p{Ll})(\p{Lu})", "$1 $2")
    flat = F.regexp_replace(F.lower(flat), "['’]s\\b", "s")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\bw/", " with "), "&", " and ")
    return F.split(F.trim(F.regexp_replace(flat, "[^a-z0-9]+", " ")), " ")


def is_blank(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s   -   　]+", "") == ""


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def edits(length: Column) -> Column:
    out = F.lit(EDITS[0][1])
    for least, k in EDITS[1:]:
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def plain(tokens: Column, stop: Column) -> Column:
    """The words without the field's decorating words, long ones with a slip too; all of them where nothing else is left."""
    kept = F.filter(tokens, lambda t: ~F.array_contains(stop, t) & ~F.exists(stop, lambda s: (F.length(s) >= 5) & (F.levenshtein(t, s) <= F.when(F.length(s) >= 8, 2).otherwise(1))))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def _shortened(tokens: Column) -> Column:
    """Arrays with one word cut to its first three or four letters."""
    none = F.array().cast("array<array<string>>")

    def replaced(letters: int) -> Column:
        return F.transform(tokens, lambda w, i: F.transform(tokens, lambda x, j: F.when(j == i, F.substring(x, 1, letters)).otherwise(x)))

    return F.when(F.size(tokens) >= 2, F.concat(replaced(3), replaced(4))).otherwise(none)


def _orders(tokens: Column) -> Column:
    """As given, reversed, last word first, first word last, sorted."""
    n = F.size(tokens)
    return F.array(tokens, F.array_sort(tokens), F.reverse(tokens), F.concat(F.slice(tokens, n, F.lit(1)), F.slice(tokens, F.lit(1), n - 1)), F.concat(F.slice(tokens, F.lit(2), n - 1), F.slice(tokens, F.lit(1), F.lit(1))))


def _names(vocabulary: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """(field, code, name, footing, t) of every name of every entry, t its words; synonyms for entries that aren't listed are left out."""
    listed = vocabulary.select(F.col("field_name").alias("field"), F.col("standard_code").alias("code"), F.explode(F.concat(F.array("standard_code", "label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"), F.lit(LISTED).alias("footing"))
    if synonyms is not None:
        extra = synonyms.select(F.col("field_name").alias("field"), F.col("standard_code").alias("code"), "name", F.lit(GIVEN).alias("footing"))
        listed = listed.unionByName(extra.join(listed.select("field", "code").distinct(), ["field", "code"], "left_semi"))
    return listed.filter(F.col("name").isNotNull()).withColumn("t", words(F.col("name"))).filter(joined(F.col("t")) != "")


def _hint(vocabulary: DataFrame, most: int = BROADCAST_ROWS):
    """The broadcast hint for what is derived from the list, a bounded number of rows per entry: given if the list has at most `most` entries, which is counted."""
    return F.broadcast if vocabulary.limit(most + 1).count() <= most else lambda df: df


def decorations(values: DataFrame, names: DataFrame, hint=lambda df: df) -> DataFrame:
    """(field, stop): the words that stand before or after listed names of at least DECORATED_PART of the field's entries (two at least) in the values (field, t).

    Counted over all distinct values. A name's own words are none. One row per field; `stop` is bounded by the entries a word must decorate."""
    known = names.select("field", "code", joined(F.col("t")).alias("form")).distinct()
    n = F.size("t")
    # One or two words before, behind, or one on either side.
    split = lambda before, behind: F.struct(F.concat(F.slice("t", 1, before), F.slice("t", n - behind + 1, F.lit(behind)) if behind else F.slice("t", 1, 0)).alias("extra"), F.slice("t", before + 1, n - (before + behind)).alias("core"))
    sides = F.filter(F.array(*[F.when(n > before + behind, split(before, behind)) for before, behind in ((1, 0), (2, 0), (0, 1), (0, 2), (1, 1))]), lambda x: x.isNotNull())
    beside = values.filter(n >= 2).select("field", F.explode(sides).alias("s")).select("field", joined(F.col("s.core")).alias("form"), "s.extra")
    met = beside.join(hint(known), ["field", "form"]).select("field", "code", F.explode("extra").alias("word"))
    own = names.select("field", F.explode("t").alias("word")).distinct()
    entries = names.groupBy("field").agg(F.countDistinct("code").alias("entries"))
    counted = met.groupBy("field", "word").agg(F.countDistinct("code").alias("codes")).join(hint(own), ["field", "word"], "left_anti").join(hint(entries), "field")
    return counted.filter(F.col("codes") >= F.greatest(F.lit(2), F.col("entries") * DECORATED_PART)).groupBy("field").agg(F.array_sort(F.collect_set("word")).alias("stop"))


def _pairs(left: Column, right: Column, make) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: make(x, y))))


def references(names: DataFrame, stops: DataFrame, hint=lambda df: df) -> DataFrame:
    """(field, form, code, k, footing): every compact spelling of every entry and the edits allowed for it; a form that several entries have on its best footing is left
    out. Bounded by the list: a few thousand forms per entry."""
    base = names.join(hint(stops), "field", "left").withColumn("stop", F.coalesce("stop", F.array().cast("array<string>")))
    whole = base.withColumn("t", F.explode(F.array_distinct(F.array("t", plain(F.col("t"), F.col("stop"))))))
    t = F.col("t")
    ordered = F.when(F.length(joined(t)) >= LEAST_SORTED, _orders(t)).otherwise(F.array(t))
    none = F.array().cast("array<string>")
    as_listed = whole.select("field", "code", joined(t).alias("form"), "footing")
    in_order = whole.select("field", "code", F.explode(F.transform(ordered, joined)).alias("form"), F.lit(ORDERED).alias("footing"))
    shortened = whole.select("field", "code", F.explode(F.flatten(F.transform(_shortened(t), lambda s: F.transform(_orders(s), joined)))).alias("form"), F.lit(SHORTENED).alias("footing"))
    # The words of all names of an entry. A word is met whole or cut to three letters or more.
    content = F.filter(t, lambda w: ~w.isin(*JOINING))
    letters = lambda ws: joined(F.transform(ws, lambda w: F.substring(w, 1, 1)))
    # A letter of a word and the beginning of a later one.
    led = F.flatten(F.transform(content, lambda w, i: F.flatten(F.transform(F.slice(content, i + 2, F.size(content)), lambda y: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length(y))), lambda n: F.concat(F.substring(w, 1, 1), F.substring(y, F.lit(1), n)))))))
    pooled = base.groupBy("field", "code").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(content)))).alias("pool"),
        F.array_distinct(F.flatten(F.collect_list(F.array(letters(content), letters(F.reverse(content)), letters(t))))).alias("initials"),
        F.array_distinct(F.flatten(F.collect_list(led))).alias("led"),
        F.min(F.when(F.size("t") > 1, F.length(joined(t)))).alias("span"),
    )
    # Many forms come of few rows: entries are dealt out first.
    pooled = pooled.repartition(task_slots(names.sparkSession), "field", "code")
    pool = F.filter("pool", lambda w: F.length(w) >= 3)
    cuts = F.array_distinct(F.flatten(F.transform(pool, lambda w: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.length(w), F.lit(12)))), lambda n: F.struct(w.alias("w"), F.substring(w, F.lit(1), n).alias("p"))))))
    short = F.flatten(F.transform(pool, lambda w: F.array(F.struct(w.alias("w"), F.substring(w, 1, 3).alias("p")), F.struct(w.alias("w"), F.substring(w, 1, 4).alias("p")), F.struct(w.alias("w"), w.alias("p")))))
    both = F.filter(_pairs(short, cuts, lambda x, y: F.when(x["w"] != y["w"], F.concat(x["p"], y["p"]))), lambda f: f.isNotNull())
    swapped = F.filter(_pairs(cuts, short, lambda x, y: F.when(x["w"] != y["w"], F.concat(x["p"], y["p"]))), lambda f: f.isNotNull())
    thirds = F.array_distinct(F.transform(short, lambda x: F.struct(x["w"].alias("w"), F.substring(x["p"], 1, 4).alias("p"))))
    three = F.filter(_pairs(_pairs(thirds, thirds, lambda x, y: F.when(x["w"] != y["w"], F.struct(x["w"].alias("a"), y["w"].alias("b"), F.concat(x["p"], y["p"]).alias("p")))), thirds, lambda x, y: F.when(x.isNotNull() & (x["a"] != y["w"]) & (x["b"] != y["w"]), F.concat(x["p"], y["p"]))), lambda f: f.isNotNull())
    marks = F.filter("initials", lambda x: F.length(x) >= 2)
    bent = F.flatten(F.transform(pool, lambda w: F.concat(F.array(w), F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(F.when(w.endswith("e") & ~e.startswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w), e)))))
    from_words = F.concat(bent, F.filter(_pairs(pool, pool, lambda x, y: F.when(x != y, F.concat(x, y))), lambda f: f.isNotNull()))
    beside = F.concat(
        _pairs(pool, F.filter("initials", lambda x: F.length(x) >= 1), lambda w, i: F.when(i.startswith(F.substring(w, 1, 1)), F.concat(w, F.substring(i, F.lit(2), F.length(i)))).when(i.endswith(F.substring(w, 1, 1)), F.concat(w, F.substring(i, F.lit(1), F.length(i) - 1)))),
        _pairs(pool, marks, lambda w, i: F.concat(w, i)), _pairs(pool, marks, lambda w, i: F.concat(i, w)),
        F.col("led"),
    )

    def footed(made: Column, rule: int) -> Column:
        return F.transform(F.array_distinct(F.coalesce(made, none)), lambda f: F.struct(f.alias("form"), F.lit(rule).alias("footing")))

    by_rule = [(from_words, WORDS), (F.filter(F.transform(cuts, lambda c: c["p"]), lambda p: F.length(p) >= 3), CUT), (both, CUT), (swapped, CUT), (three, CUT), (marks, INITIALS), (beside, INITIALS)]
    made = pooled.select("field", "code", "span", F.explode(F.concat(*[footed(forms, rule) for forms, rule in by_rule])).alias("x")).select("field", "code", "span", "x.form", "x.footing")
    forms = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [as_listed, in_order, shortened, made]).filter(F.length("form") >= F.when(F.col("footing") >= CUT, 2).otherwise(1))
    # A word of several entries stands for the one of whose shortest name it makes the largest part.
    standing = F.struct("footing", F.when(F.col("footing") == WORDS, F.coalesce("span", F.lit(0))).otherwise(0).alias("span"))
    best = forms.withColumn("s", standing).groupBy("field", "form").agg(F.min("s").alias("best"), F.collect_set(F.struct("s", "code")).alias("all"))
    alone = best.withColumn("codes", F.filter("all", lambda x: x["s"] == F.col("best"))).filter(F.size("codes") == 1).withColumn("footing", F.col("best.footing"))
    n = F.length("form")
    k = F.when(F.col("footing") >= INITIALS, 0).when(F.col("footing") == CUT, F.when(n >= LEAST_FUZZY_CUT, 1).otherwise(0)).when((F.col("footing") == WORDS) & (n < 5), 0).otherwise(edits(n))
    return alone.select("field", "form", F.col("codes")[0]["code"].alias("code"), k.alias("k"), "footing")


def _parts(length: Column) -> Column:
    """Segments of a string: one more than the edits allowed; one more again where a swap, which changes two letters, counts as one edit."""
    return F.col("k") + F.when((F.col("k") == 1) & (length <= LONGEST_SWAP), 2).otherwise(1)


def _segments(refs: DataFrame) -> DataFrame:
    """Even segments of each reference string, with the string's length and the segment's number."""
    n = F.length("form")
    cut = refs.filter("k > 0").withColumn("parts", _parts(n)).withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    start, end = F.floor(F.col("i") * n / F.col("parts")), F.floor((F.col("i") + 1) * n / F.col("parts"))
    return cut.select("field", "form", "code", "k", "footing", n.alias("l"), "i", F.substring("form", (start + 1).cast("int"), (end - start).cast("int")).alias("segment"))


def _probes(values: DataFrame, lengths: DataFrame) -> DataFrame:
    """The substrings of each value that may equal a segment: for length l, k edits and segment i, the starts shifted by as many edits as there are segments before and behind."""
    shape = values.withColumn("n", F.length("form")).join(lengths, "field").filter(F.abs(F.col("n") - F.col("l")) <= F.col("k"))
    shape = shape.withColumn("parts", _parts(F.col("l"))).withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    shape = shape.withColumn("start", F.floor(F.col("i") * F.col("l") / F.col("parts")).cast("int")).withColumn("size", F.floor((F.col("i") + 1) * F.col("l") / F.col("parts")).cast("int") - F.col("start"))
    shift, behind = F.col("n") - F.col("l"), F.col("parts") - 1 - F.col("i")
    low = F.greatest(F.lit(0), F.col("start") - F.col("i"), F.col("start") + shift - behind)
    high = F.least(F.col("n") - F.col("size"), F.col("start") + F.col("i"), F.col("start") + shift + behind)
    shape = shape.withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("p", F.explode(F.expr("sequence(low, high)")))
    return shape.select("field", "value", F.col("form").alias("typed"), "l", "k", "i", F.expr("substring(form, p + 1, size)").alias("segment")).distinct()


def map_values(values: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(field, value, code, distance, matched_by) for distinct (field, value) pairs: the code of the entry meant, or `unmatched` with NULL distance and rule.

    `matched_by` is `listed`, `synonym` or another of RULES, with ` (edited)` where the pigeonhole join found it. `synonyms` (field_name, standard_code, name) adds names to
    entries, as a curator would; none are needed. NULL and blank values are left out. Values without a letter (numbers, marks) mean no entry unless an entry is spelt so. Ties between
    entries are unmatched. An empty vocabulary leaves every value unmatched; an empty input gives no rows; values of any length are compared whole.
    """
    # The distinct values are few and used by every step; so are the references. Cutting their lineage keeps the plan small and the sources read once.
    slots = task_slots(values.sparkSession)
    distinct = cut(values.filter(F.col("value").isNotNull() & ~is_blank(F.col("value"))).select("field", "value").distinct())
    tokens = distinct.withColumn("t", words(F.col("value"))).filter(~joined(F.col("t")).isin(*PLACEHOLDERS))
    hint, names = _hint(vocabulary), _names(vocabulary, synonyms)
    stops = cut(decorations(tokens.select("field", "t").distinct(), names, hint))
    refs = cut(references(names, stops, hint))
    tokens = tokens.join(hint(stops), "field", "left").withColumn("stop", F.coalesce("stop", F.array().cast("array<string>"))).withColumn("plain", plain(F.col("t"), F.col("stop")))
    forms = tokens.select("field", "value", "t", "stop", F.explode(F.array_distinct(F.array(joined(F.col("t")), joined(F.col("plain"))))).alias("form")).filter("form <> ''")
    # Exact forms, sorted words included; where the forms of a value mean different entries, the best footing and then the one with most letters wins.
    ordered = tokens.select("field", "value", joined(F.array_sort("plain")).alias("form")).filter(F.length("form") >= LEAST_SORTED)
    # A decorating word written together with the rest.
    led = tokens.select("field", "value", joined(F.col("t")).alias("all"), F.explode("stop").alias("w")).filter((F.length("w") >= 4) & F.col("all").startswith(F.col("w")) & (F.length("all") >= F.length("w") + 4))
    glued = led.select("field", "value", F.substring(F.col("all"), F.length("w") + 1, F.length("all")).alias("form"))
    found = forms.select("field", "value", "form").unionByName(ordered).unionByName(glued).join(refs.select("field", "form", "code", "footing"), ["field", "form"])
    same = cut(found.groupBy("field", "value").agg(F.max_by(F.struct("code", "footing"), F.struct(-F.col("footing"), F.length("form"), "code")).alias("b")).select("field", "value", "b.code", F.lit(0).alias("distance"), "b.footing", F.lit("").alias("how")))
    # Values of decorating words alone are near to nothing.
    rest = forms.filter(F.col("form").rlike("[a-z]") & ~F.forall("t", lambda w: F.array_contains(F.col("stop"), w))).select("field", "value", "form").join(same, ["field", "value"], "left_anti")
    # A field has a bounded number of lengths, but a value many probes: values are dealt out before they are taken apart.
    rest = rest.repartition(slots, "field", "value")
    segments, probes = _segments(refs), _probes(rest, hint(refs.filter("k > 0").select("field", F.length("form").alias("l"), "k").distinct()))
    pairs = probes.join(segments, ["field", "l", "k", "i", "segment"]).select("field", "value", "typed", "form", "code", "k", "footing").distinct()
    # In the shortest strings a swap of two letters counts as one edit.
    letters = lambda c: F.array_sort(F.split(c, ""))
    swap = (F.col("k") == 1) & (F.col("distance") == 2) & (F.length("form") <= LONGEST_SWAP) & (letters("typed") == letters("form"))
    near = pairs.withColumn("distance", F.levenshtein("typed", "form")).filter((F.col("distance") <= F.col("k")) | swap)
    # Single words of an entry are changed at their end at most: other words are too near.
    near = near.filter((F.col("footing") != WORDS) | (F.col("distance") <= 1) | (F.substring("typed", 1, 4) == F.substring("form", 1, 4))).groupBy("field", "value", "code").agg(F.min(F.struct("distance", "footing")).alias("d"))
    best = near.groupBy("field", "value").agg(F.min(F.struct("d", "code")).alias("b"), F.collect_list("d").alias("all"))
    alone = best.filter(F.size(F.filter("all", lambda x: x == F.col("b.d"))) == 1)
    fuzzy = alone.select("field", "value", "b.code", "b.d.distance", "b.d.footing", F.lit(" (edited)").alias("how"))
    matched = cut(same.unionByName(fuzzy).select("field", "value", "code", "distance", F.concat(F.element_at(F.array(*map(F.lit, RULES)), F.col("footing") + 1), "how").alias("matched_by")))
    left = distinct.join(matched, ["field", "value"], "left_anti").select("field", "value", F.lit(UNMATCHED).alias("code"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("string").alias("matched_by"))
    return matched.unionByName(left)


def typed_values(sources: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(field, record_id, value) of several tables' fields; each source is (table, id column, fields)."""
    out = None
    for df, identity, fields in sources:
        part = df.select(F.col(identity).cast("string").alias("record_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.field", "record_id", "x.value")
        out = part if out is None else out.unionByName(part)
    return out


def canonicalise(typed: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(field_name, record_id, standard_code) of every non-blank value that isn't, character for character, in the list of its field. Redelivered rows come out once."""
    listed = vocabulary.select(F.col("field_name").alias("field"), F.explode(F.concat(F.array("standard_code", "label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("value")).distinct()
    cases = typed.filter(F.col("value").isNotNull() & ~is_blank(F.col("value"))).join(_hint(vocabulary)(listed), ["field", "value"], "left_anti")
    mapping = map_values(cases, vocabulary, synonyms).select("field", "value", "code")
    return cases.join(mapping, ["field", "value"]).select(F.col("field").alias("field_name"), "record_id", F.col("code").alias("standard_code")).distinct()
