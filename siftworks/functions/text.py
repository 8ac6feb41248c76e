"""String functions as column expressions. NULL in, NULL out unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say what kind of procedure a task name means.
TASK_ENDINGS = ("task", "paradigm", "test", "procedure", "assessment")
#: Words that describe a task without naming it.
DESCRIPTORS = ("complex", "simple", "basic", "advanced", "various", "different", "specific", "typical", "standard", "common", "regular", "experiment", "experiments", "paradigm", "paradigms", "study", "studies", "data", "trial", "trials")
#: Code patterns that name nothing, first match wins.
JUNK_PATTERNS = (("f{number}", r"^f\d+$"), ("grot{a-i}", r"^grot[a-i]$"), ("starts-digit", r"^\d"), ("vol*", r"(?i)^vol"), ("t{number}", r"^t\d+$"), ("sub{number}", r"^sub\d+$"))
#: Error categories by words in the lower-case message, first match wins.
ERROR_CATEGORIES = (
    ("pybids / BIDS parsing", ("pybids", "dictionary update")), ("integer overflow", ("int32", "overflow", "out of range")), ("JSON decode", ("json", "decode")), ("timeout", ("timeout", "timed out")),
    ("network / connection", ("connection", "network", "socket")), ("empty / missing", ("empty", "no objects", "not found")), ("encoding", ("unicode", "encoding")),
)
#: Phrases of messages about restricted data, which are no errors.
RESTRICTED = ("accessdenied", "access denied", "access-denied", "restricted", "embargoed", "graphql fallback", "falling back to graphql", "is access-denied")
#: Categories of questions by the words they use, first match wins. A `+` ties words that must both be there; a parameter of `categorise`.
CATEGORIES = (
    ("How many", ("how many", "at least", "more than", "less than", "fewer than", "no more than", "number of participants", "number of subjects", "sample size")),
    ("Several kinds of data", ("together with", "simultaneous", "multimodal", "both + fmri", "both + eeg", "both + meg", "as well as + eeg", "as well as + fmri")),
    ("Age and sex", ("child", "children", "infants", "adolescents", "teenagers", "older adults", "elderly", "women", "men", "girls", "boys", "retired")),
    ("Diagnosis", ("patients", "diagnosis", "disorder", "disease", "syndrome", "epilepsy", "seizures", "depression", "schizophrenia", "dementia", "autism", "stroke", "tumour", "anxiety", "dyslexia", "insomnia", "migraine", "tinnitus", "healthy controls")),
    ("Kind of recording", ("fmri", "mri", "eeg", "meg", "pet", "dwi", "dti", "ieeg", "fnirs", "bold", "anatomical", "diffusion weighted", "electrodes", "scanner")),
    ("Task", ("task", "paradigm", "resting", "memory", "attention", "motor", "reward", "naming", "reading", "listening", "imagery", "oddball", "sleep")),
)
STOP_WORDS = ("the", "and", "for", "with", "that", "have", "has", "are", "all", "any", "show", "find", "list", "give", "which", "what", "datasets", "dataset", "from")


def normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def without_separators(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_\-]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_safe_tail(url: Column) -> Column:
    """The last part of a URL with everything but letters, digits, dot, dash and underscore replaced by `_`."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"[^A-Za-z0-9._\-]", "_")


def strip_task_ending(c: Column) -> Column:
    """One trailing procedure word removed, once."""
    return F.regexp_replace(F.trim(c), f"(?i) +({'|'.join(TASK_ENDINGS)})$", "")


def plural_variants(c: Column) -> Column:
    """The term and its simple singular and plural forms, in trial order."""
    first = F.when(c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(F.concat(c, F.lit("s")))
    second = F.when(c.endswith("ies"), F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit("y"))).when(c.endswith("y"), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit("ies")))
    return F.filter(F.array(c, first, second), lambda x: x.isNotNull())


def without_words(c: Column, words: tuple[str, ...]) -> Column:
    """The text without some words; itself where nothing would be left."""
    kept = F.array_join(F.filter(F.split(F.lower(c), r"\s+"), lambda w: ~w.isin(*words)), " ")
    return F.when(kept == "", F.lower(c)).otherwise(kept)


def keyword(c: Column, least: int = 4) -> Column:
    """The longest word of at least `least` letters (the first of equals), else the whole text."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) >= least)
    best = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(best == "", c).otherwise(best)


def clean_readme(c: Column) -> Column:
    """Tags to blanks, images out, at most one empty line, NULs and outer blanks out."""
    out = F.regexp_replace(c, "\x00", "")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def head_and_tail(c: Column, half: int = 4000) -> Column:
    """Texts longer than twice `half`: the first and the last `half` characters."""
    return F.when(F.length(c) > 2 * half, F.concat(F.substring(c, 1, half), F.lit("\n…\n"), F.substring(c, F.length(c) - (half - 1), F.lit(half)))).otherwise(c)


def urls(c: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://\S+"), F.lit(0))), 1, most)


def doi(c: Column) -> Column:
    """The first DOI, without trailing punctuation; NULL if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"\b(10\.\d{4,}/\S+)", 1), "[.,;)]+$", ""), F.lit(""))


def first_words(c: Column, n: int) -> Column:
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" [...]"))).otherwise(c)


def first_match(c: Column, patterns: tuple[tuple[str, str], ...], other: str | None = None) -> Column:
    """The name of the first pattern that matches."""
    out = reduce(lambda a, p: a.when(c.rlike(p[1]), F.lit(p[0])), patterns[1:], F.when(c.rlike(patterns[0][1]), F.lit(patterns[0][0])))
    return out.otherwise(F.lit(other))


def category_pattern(words: tuple[str, ...]) -> str:
    """One pattern for the words of a category: whole words, any blanks between them, tied words in either order."""
    def phrase(words: str) -> str:
        return r"\b" + r"\s+".join(words.split()) + r"\b"

    each = [[phrase(p) for p in w.split("+")] for w in words]
    return "(?is)" + "|".join(p[0] if len(p) == 1 else f"{p[0]}.*{p[1]}|{p[1]}.*{p[0]}" for p in each)


def categorise(c: Column, categories: tuple[tuple[str, tuple[str, ...]], ...] = CATEGORIES, other: str = "Other") -> Column:
    """The first category one of whose words stands in the text, whatever the case."""
    return first_match(c, tuple((name, category_pattern(words)) for name, words in categories), other)


def error_category(c: Column) -> Column:
    low = F.lower(c)
    out = None
    for name, words in ERROR_CATEGORIES:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def is_restricted(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w)) for w in RESTRICTED])


def fingerprint(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def author_line(c: Column, most: int = 3) -> Column:
    """The first authors and how many more there are."""
    return F.when(F.size(c) > most, F.concat(F.array_join(F.slice(c, 1, most), ", "), F.lit(" +"), (F.size(c) - most).cast("string"))).otherwise(F.array_join(c, ", "))


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term in a text."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def unknown_tables(sql: Column, known: tuple[str, ...]) -> Column:
    """Tables named after FROM or JOIN that don't exist; quoted strings are no SQL."""
    bare = F.regexp_replace(F.lower(sql), "'[^']*'", "''")
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)"), F.lit(1))), F.array(*map(F.lit, known))))


def codes_in_sql(sql: Column, column: str) -> Column:
    """Codes a SQL text compares a column with, by `=` or `IN`, in order."""
    equal = F.regexp_extract_all(sql, F.lit(rf"\.{column}\s*=\s*'([^']*)'"), F.lit(1))
    lists = F.regexp_extract_all(sql, F.lit(rf"(?i)\.{column}\s+IN\s*\(([^)]*)\)"), F.lit(1))
    inner = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit("'([^']*)'"), F.lit(1))))
    return F.array_distinct(F.concat(equal, inner))
