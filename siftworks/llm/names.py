"""Spellings of one person or organisation, linked.

1. Every distinct string is read into a key: for people surname, first given name and further initials; for organisations the place or proper
   name and the words of its kind. Titles, accents, case, separators and the order of parts are gone. Two bare words are put in the order in which
   the strings that show their order use them. Words of a kind are met whole, with a slip, or shortened; no table of names or of their short forms is used.
2. Short forms of given names are learned: a name most of whose rare surnames another, ampler name has too stands for that name.
3. A symmetric-delete index on tokens (the token and what is left of it without one letter, or two of a long one) finds keys whose parts are a few edits apart; keys with
   an initial or an acronym in place of words are found by the equal part and that initial.
4. Candidate keys are aligned by optimal assignment of their tokens (Hungarian method); equal tokens, edits, short forms, initials and abbreviations may
   pair, and every full token of both must be paired.
5. Links between full names make connected components; a name with a bare initial or acronym joins the one component it fits, and none if it fits several.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.session import cut, task_slots

PERSON, ORGANISATION = "person", "organisation"
#: From so many distinct spellings on, the keys of two people (or organisations) whose surnames (or places) are an edit apart are names of their own and no slip of
#: each other, unless one has this many times the spellings of the other.
OWN_NAME_FORMS = 3
#: Letters from which on two edits are a slip; shorter words may have one.
LONG = 9
#: A surname says something about short forms if at most so many given names bear it. Of such surnames of a short form, LEAST_BOTH at least and this part are the full
#: name's too, and at least MORE_THAN_CHANCE times as many as its own part of all surnames would give.
RARE_SURNAME, LEAST_BOTH, BOTH_PART, MORE_THAN_CHANCE = 20, 2, 0.6, 5.0

#: Words for kinds of organisations, in the order in which an abbreviation is read.
KIND_WORDS = (
    "university hospital medical school centre institute technology children clinic brain imaging college department laboratory research science national academy "
    "faculty society foundation museum company council agency ministry association network consortium"
).split()
#: Words of other endings for a kind word.
SAME_KIND = {"medicine": "medical"}
JOINING_WORDS = frozenset("of for the and at in f d der die das fuer fur und de la le".split())
#: Entries that name nobody.
PLACEHOLDERS = frozenset("na n none null unknown tbd tba et al etal anonymous anon nobody various others home hospital clinic university author authors see readme missing".split()) | {"n a", "et al", "see readme", "not available", "to be determined"}
_TITLES = re.compile(r"\b(?:dr|prof|professor|mr|mrs|ms|phd|ph\.d|md|m\.d|msc|bsc|jr|sr)\b\.?", re.I)


def fold(text: str) -> str:
    """Compatibility forms, accents and separators removed; case kept."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    flat = flat.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("æ", "ae").replace("_", " ")
    return re.sub(r"\s+", " ", flat).strip()


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, replacement or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def within(a: str, b: str) -> int | None:
    """Edits between two words (a swap of neighbours is one): 0, 1, or 2 where the longer one is long and they begin alike; None beyond that. Few slips hit the first
    letter, and coined names of one ending differ in their first letters."""
    if a == b:
        return 0
    if one_edit(a, b):
        return 1
    if max(len(a), len(b)) < LONG or abs(len(a) - len(b)) > 2 or a[0] != b[0]:
        return None
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > 2:
            return None
        before, row = row, new
    return 2 if row[-1] <= 2 else None


def deletions(token: str, least: int = 5, depth: int = 1) -> set[str]:
    """The token and what is left of it without up to `depth` letters; short tokens stand for themselves."""
    if len(token) < least:
        return {token}
    return {"".join(c for i, c in enumerate(token) if i not in gone) for n in range(depth + 1) for gone in combinations(range(len(token)), n)}


def read_person(text: str) -> tuple[str, list[str], bool] | None:
    """(surname, given names and initials, order is certain); None where the string names nobody."""
    flat = fold(text)
    flat = re.sub(r"\s+", " ", _TITLES.sub(" ", flat)).strip(" ,.;")
    if re.sub(r"[^a-z]+", " ", flat.lower()).strip() in PLACEHOLDERS:
        return None
    if "," in flat:
        last, _, given = flat.partition(",")
        surname = " ".join(re.findall(r"[^\W\d]+", last)).lower()
        rest = re.findall(r"[^\W\d]+", given)
        if not surname or not rest:
            return None
        return surname, _given(rest), True
    tokens = re.findall(r"[^\W\d]+", flat)
    if len(tokens) < 2:
        return None
    if len(tokens[-1]) <= 3 and tokens[-1].isupper() and len(tokens[-2]) > 3:
        return " ".join(tokens[:-1]).lower(), list(tokens[-1].lower()), True
    low = [t.lower() for t in tokens]
    return low[-1], _given(tokens[:-1]), len(tokens) > 2 or len(low[0]) == 1


def _given(tokens: list[str]) -> list[str]:
    return [x for t in tokens for x in (list(t.lower()) if t.isupper() and 2 <= len(t) <= 3 else [t.lower()])]


def _shortens(token: str, word: str) -> bool:
    """Whether a token is an abbreviation of a word: its beginning, or some of its letters in order without vowels or up to the last one."""
    if not 3 <= len(token) < len(word) or token[0] != word[0]:
        return False
    if word.startswith(token):
        return True
    letters = iter(word)
    return len(token) <= 4 and all(c in letters for c in token) and (not set(token) & set("aeiou") or token[-1] == word[-1])


@lru_cache(100_000)
def kind_word(token: str) -> tuple[str, bool] | None:
    """(kind word, whether it's written out) that a token stands for: itself, with another ending, with a slip, or shortened."""
    if token in SAME_KIND:
        return SAME_KIND[token], True
    for w in KIND_WORDS:
        if token == w or (len(w) >= 8 and token[:8] == w[:8]) or (len(w) >= 6 and token[:-1] == w):
            return w, True
    for w in KIND_WORDS:
        if min(len(token), len(w)) >= 5 and within(token, w) is not None:
            return w, True
    for full, w in SAME_KIND.items():
        if min(len(token), len(full)) >= 5 and within(token, full) is not None:
            return w, True
    return next(((w, False) for w in KIND_WORDS if _shortens(token, w)), None)


def read_organisation(text: str) -> tuple[str, list[str], list[str], bool] | None:
    """(proper name, sorted kind words, initials, whether the kind words are written out); None for strings that name nobody: placeholders and kind words alone.

    The initials are those of the kind words in their order, and of all words from three on, with and without the joining ones."""
    flat = fold(text)
    low = flat.lower().replace("'s", "s").replace("’s", "s")
    if re.sub(r"[^a-z]+", " ", low).strip() in PLACEHOLDERS:
        return None
    tokens = re.findall(r"[^\W\d]+", low)
    kinds, proper, out = [], [], True
    for t in tokens:
        if t in JOINING_WORDS:
            continue
        if len(t) > 1 and (k := kind_word(t)):
            kinds.append(k[0])
            out &= k[1]
        else:
            proper.append(t)
    if not kinds:
        # A single letter is short for the only kind word that begins with it.
        for t in [t for t in proper if len(t) == 1]:
            begun = [w for w in KIND_WORDS if w[0] == t]
            if len(begun) == 1:
                kinds, out = begun, True
                proper.remove(t)
                break
    if not proper:
        return None
    content = [t for t in tokens if t not in JOINING_WORDS]
    marks = ["".join(k[0] for k in kinds)] if len(kinds) > 1 else []
    marks += ["=" + "".join(t[0] for t in ts) for ts in (content, tokens) if len(ts) > 2]
    # A string of capitals alone may be such initials.
    if not kinds and len(proper) == 1 and 3 <= len(proper[0]) <= 6 and flat.strip(" .,").isupper():
        marks.append("?" + proper[0])
    return " ".join(sorted(proper)), sorted(set(kinds)), sorted(set(marks)), out


def assignment(costs: list[list[int]]) -> int:
    """Least total of a square cost matrix with one entry per row and column (Hungarian method, cubic)."""
    n = len(costs)
    u, v, match = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[at]:
            done[at] = True
            row, delta, nxt = match[at], float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    reduced = costs[row - 1][j - 1] - u[row] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, at
                    if least[j] < delta:
                        delta, nxt = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nxt
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return sum(costs[match[j] - 1][j - 1] for j in range(1, n + 1))


def _short_form(a: str, b: str) -> bool:
    """Whether the shorter given name can be made from the longer one: its beginning or a part of it, three letters or more, perhaps with a pet ending."""
    if len(a) > len(b):
        a, b = b, a
    stem = re.sub(r"(?:ie|ey|y|i)$", "", a)
    stem = stem[:-1] if len(stem) > 3 and stem[-1] == stem[-2] else stem
    return len(stem) >= 3 and len(stem) < len(b) and (stem in b)


def _pair_cost(a: str, b: str, kind: str) -> int | None:
    """Cost of pairing two tokens; None where they can't stand for one another."""
    if a == b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return 1 if a[0] == b[0] else None
    if kind == PERSON and _short_form(a, b):
        return 1
    edits = within(a, b) if min(len(a), len(b)) >= 4 else None
    return None if edits is None else 1 + edits


_NEVER = 1_000_000


def align(a: list[str], b: list[str], kind: str) -> int | None:
    """Least total cost of an assignment that pairs every full token of both lists; initials may stay alone. None where there is none. Exact for lists of any length."""
    if not a or not b:
        rest = [*a, *b]
        return len(rest) if all(len(t) == 1 for t in rest) else None
    n = len(a) + len(b)
    alone_a, alone_b = ([1 if len(t) == 1 else _NEVER for t in x] for x in (a, b))
    costs = [[_NEVER if (c := _pair_cost(x, y, kind)) is None else c for y in b] + [alone] * len(a) for x, alone in zip(a, alone_a)]
    costs += [alone_b + [0] * len(a) for _ in b]
    total = assignment(costs) if n else 0
    return total if total < _NEVER else None


def same_person(a: tuple[str, list[str], set[str]], b: tuple[str, list[str], set[str]]) -> bool:
    """Surnames within a slip, first given names able to stand for one another (learned forms included), further given names not in conflict."""
    if a[0] != b[0] and (min(len(a[0]), len(b[0])) < 5 or within(a[0], b[0]) is None):
        return False
    first_a, first_b = a[1][0], b[1][0]
    initial = len(first_a) == 1 or len(first_b) == 1
    if initial and not any(x[0] == y[0] for x in (first_a, *a[2]) for y in (first_b, *b[2])):
        return False
    known = initial or bool({first_a, *a[2]} & {first_b, *b[2]})
    if not known and _pair_cost(first_a, first_b, PERSON) is None:
        return False
    if len(a[1]) > 1 and len(b[1]) > 1 and _pair_cost(a[1][1], b[1][1], PERSON) is None:
        return False
    rest_a, rest_b = (x[1][1:] if known else x[1] for x in (a, b))
    return align([*a[0].split(), *rest_a], [*b[0].split(), *rest_b], PERSON) is not None


def same_organisation(a: tuple[str, list[str]], b: tuple[str, list[str]]) -> bool:
    """Proper names within a slip a word and the same kind words."""
    return a[1] == b[1] and align(a[0].split(), b[0].split(), ORGANISATION) is not None


_READ = "field_name string, name string, main string, rest array<string>, certain boolean, marks array<string>, spelt boolean"


def _read(kinds: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, name in zip(pdf["field_name"], pdf["name"]):
                if kinds[field] == PERSON:
                    if found := read_person(name):
                        rows.append((field, name, *found, [], True))
                elif found := read_organisation(name):
                    rows.append((field, name, found[0], found[1], True, found[2], found[3]))
            yield pd.DataFrame(rows, columns=["field_name", "name", "main", "rest", "certain", "marks", "spelt"])

    return run


def short_forms(people: DataFrame) -> DataFrame:
    """(field_name, first, forms): the full given names that a given name is learned to stand for. `people` has field_name, main (surname) and first.

    Surnames that many given names bear are no evidence, so each group of the pairing is bounded by RARE_SURNAME; every name is counted over all rare surnames."""
    each = people.filter(F.length("first") > 1).select("field_name", "main", "first").distinct()
    rare = each.groupBy("field_name", "main").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("n") <= RARE_SURNAME)).select("field_name", "main")
    # Surnames of one given name alone are no evidence for a pair, but they are evidence against one.
    lone = each.groupBy("field_name", "main").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE_SURNAME).select("field_name", "main")
    sizes = each.join(lone, ["field_name", "main"], "left_semi").groupBy("field_name", "first").agg(F.count(F.lit(1)).alias("size"))
    total = lone.groupBy("field_name").agg(F.count(F.lit(1)).alias("total"))
    shared = each.join(rare, ["field_name", "main"], "left_semi")
    a, b = (shared.select("field_name", "main", F.col("first").alias(x)) for x in ("first", "full"))
    both = a.join(b, ["field_name", "main"]).filter("first <> full").groupBy("field_name", "first", "full").agg(F.count(F.lit(1)).alias("both"))
    known = both.filter(F.col("both") >= LEAST_BOTH).join(sizes, ["field_name", "first"]).join(sizes.select("field_name", F.col("first").alias("full"), F.col("size").alias("full_size")), ["field_name", "full"]).join(F.broadcast(total), "field_name")
    part, chance = F.col("both") / F.col("size"), F.col("full_size") / F.col("total")
    fit = known.filter((F.col("full_size") > F.col("size")) & (part >= BOTH_PART) & (part >= MORE_THAN_CHANCE * chance))
    best = fit.groupBy("field_name", "first").agg(F.max(part).alias("most"), F.collect_list(F.struct(part.alias("part"), "full")).alias("all"))
    return best.select("field_name", "first", F.transform(F.filter("all", lambda x: x["part"] == F.col("most")), lambda x: x["full"]).alias("forms"))


def _index(batches: Iterator[pd.DataFrame], kinds: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Symmetric-delete index rows of keys. Slots that begin with `i|` are for initials and acronyms: a bare key there meets full ones."""
    for pdf in batches:
        out: list[tuple] = []
        for field, node, main, rest, forms, marks, partial in zip(pdf["field_name"], pdf["nid"], pdf["main"], pdf["rest"], pdf["forms"], pdf["marks"], pdf["partial"]):
            rest, forms, marks = list(rest), list(forms), list(marks)
            deep = deletions(main, depth=2 if len(main) >= LONG - 1 else 1)
            near = deletions(main)
            if kinds[field] == PERSON:
                if len(rest[0]) == 1:
                    out += [(field, node, f"i|{d}|{rest[0]}", True) for d in near]
                    continue
                firsts = {rest[0], *forms}
                out += [(field, node, f"x|{d}|{f}", False) for d in deep for f in firsts]
                out += [(field, node, f"x|{d}|{e}", False) for d in near for f in firsts for e in deletions(f, 4)]
                out += [(field, node, f"s|{main}|{f[:3]}", False) for f in firsts] + [(field, node, f"s|{main}|{f[i:i + 3]}", False) for f in firsts for i in range(1, len(f) - 2)]
                out += [(field, node, f"i|{d}|{x}", False) for x in {f[0] for f in firsts} for d in near]
                continue
            whole = " ".join(rest)
            out += [(field, node, f"x|{d}|{whole}", False) for d in deep]
            if partial:
                out += [(field, node, f"i|{d}|+{k}", True) for k in rest for d in near]
            else:
                out += [(field, node, f"i|{d}|+{k}", False) for k in rest for d in near]
            for m in marks:
                if m[0] == "?":
                    out.append((field, node, f"i||{m[1:]}", True))
                elif m[0] == "=":
                    out.append((field, node, f"i||{m[1:]}", False))
                else:
                    out += [(field, node, f"i|{d}|{m}", False) for d in near]
            # One of the proper words may be an acronym of the kind.
            tokens = main.split()
            if not rest and len(tokens) > 1:
                for t in tokens:
                    if 2 <= len(t) <= 5:
                        others = " ".join(x for x in tokens if x != t)
                        out += [(field, node, f"i|{d}|{t}", True) for d in deletions(others)]
        yield pd.DataFrame(out, columns=["field_name", "nid", "slot", "bare"]).drop_duplicates()


def _same_bare(a: tuple, b: tuple) -> bool:
    """Whether an organisation with an acronym or a shortened kind (a) can be the full one (b)."""
    (main_a, rest_a, marks_a, partial), (main_b, rest_b, marks_b, _) = a, b
    if any(m[0] == "?" and "=" + m[1:] in marks_b for m in marks_a):
        return True
    if partial:
        return set(rest_a) < set(rest_b) and align(main_a.split(), main_b.split(), ORGANISATION) is not None
    tokens = main_a.split()
    return any(t in marks_b and align([x for x in tokens if x != t], main_b.split(), ORGANISATION) is not None for t in tokens if 2 <= len(t) <= 5)


def _verify(batches: Iterator[pd.DataFrame], kinds: dict[str, str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for r in pdf.itertuples(index=False):
            if kinds[r.field_name] == PERSON:
                ok = same_person((r.main_a, list(r.rest_a), set(r.forms_a)), (r.main_b, list(r.rest_b), set(r.forms_b)))
            elif r.bare_a:
                ok = not r.bare_b and _same_bare((r.main_a, list(r.rest_a), list(r.marks_a), r.partial_a), (r.main_b, list(r.rest_b), list(r.marks_b), r.partial_b))
            else:
                ok = same_organisation((r.main_a, list(r.rest_a)), (r.main_b, list(r.rest_b)))
            few, many = sorted((r.spellings_a, r.spellings_b))
            keep.append(ok and (r.main_a == r.main_b or r.bare_a or few < OWN_NAME_FORMS or OWN_NAME_FORMS * few <= many))
        yield pdf.loc[keep, ["field_name", "node_a", "node_b", "bare_a", "bare_b"]]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph: least node reachable. Label propagation with pointer jumping, distributed, lineage cut each round."""
    both = cut(edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(edges.select(F.col("node_b").alias("a"), F.col("node_a").alias("b"))).distinct())
    linked = both.select(F.col("a").alias("node")).distinct()
    labels = cut(linked.select("node", F.col("node").alias("component")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("heard"))
        stepped = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("component"))
        targets = stepped.select(F.col("node").alias("t"), F.col("component").alias("jump"))
        nxt = cut(stepped.join(targets, F.col("component") == F.col("t"), "left").select("node", "old", F.coalesce("jump", "component").alias("component")))
        changed = nxt.filter("old <> component").limit(1).count()
        labels = nxt.select("node", "component")
        if not changed:
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def link(strings: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(field_name, name, entity) for the strings that name somebody; spellings of one person or organisation share `entity`.

    `strings` has field_name and name, in any multiplicity; `kinds` says per field what is named. NULL, blank and placeholder strings, people without a
    second part and kind words alone name nobody and are left out. Repeats don't matter; ties (a bare initial or acronym that fits several) are not
    linked; an empty input gives no rows; other columns are not read; long strings are compared whole.
    """
    distinct = strings.filter(F.col("name").isNotNull() & F.col("field_name").isin(list(kinds))).select("field_name", "name").distinct()
    read = cut(distinct.mapInPandas(_read(kinds), _READ))
    is_person = F.col("field_name").isin([f for f, kind in kinds.items() if kind == PERSON])
    # Order of two bare words, by how the strings of certain order use them.
    used = read.filter(F.col("certain") & is_person).select("field_name", F.explode("rest").alias("token")).filter(F.length("token") > 1).groupBy("field_name", "token").agg(F.count(F.lit(1)).alias("n"))
    first, last = (used.select("field_name", F.col("token").alias(f"t{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    placed = read.withColumn("t1", F.get("rest", F.lit(0))).withColumn("t2", F.col("main")).join(first, ["field_name", "t1"], "left").join(last, ["field_name", "t2"], "left")
    swap = ~F.col("certain") & (F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0)))
    keyed = placed.select("field_name", "name", F.when(swap, F.col("t1")).otherwise(F.col("main")).alias("main"), F.when(swap, F.array("t2")).otherwise(F.col("rest")).alias("rest"), "marks", "spelt")
    keyed = keyed.withColumn("first", F.when(is_person, F.get("rest", F.lit(0))))
    keyed = cut(keyed.withColumn("node", F.concat_ws("|", "field_name", "main", F.array_join("rest", " "))))
    # Spellings per person (surname and first given name) or organisation: others of the same surname or place say nothing about a slip in this name.
    own = F.coalesce("first", F.array_join("rest", " "))
    spellings = keyed.groupBy("field_name", "main", own.alias("own")).agg(F.countDistinct("name").alias("spellings"))
    # Kinds that are only ever written shortened are parts of longer ones.
    spelt = keyed.filter(~is_person & (F.col("spelt") | (F.size("rest") != 1))).select("field_name", "rest").distinct().withColumn("_spelt", F.lit(True))
    none = F.array().cast("array<string>")
    nodes = keyed.groupBy("field_name", "node", "main", "rest", "first", own.alias("own")).agg(F.array_distinct(F.flatten(F.collect_set("marks"))).alias("marks"))
    nodes = nodes.join(spellings, ["field_name", "main", "own"]).drop("own").join(short_forms(keyed.filter(is_person)), ["field_name", "first"], "left").join(spelt, ["field_name", "rest"], "left")
    # Few rows make many slots: they are dealt out first, and the slots are written once for both sides of the join.
    nodes = nodes.select("field_name", "node", F.xxhash64("node").alias("nid"), "main", "rest", "marks", "spellings", F.coalesce("forms", none).alias("forms"), (~is_person & (F.size("rest") > 0) & F.col("_spelt").isNull()).alias("partial"))
    nodes = cut(nodes.repartition(task_slots(strings.sparkSession), "node"))
    index = nodes.drop("spellings", "node").mapInPandas(lambda it: _index(it, kinds), "field_name string, nid long, slot string, bare boolean")
    index = cut(index.select("nid", F.xxhash64("field_name", "slot").alias("slot"), F.col("slot").startswith("i|").alias("by_initial"), "bare"))
    a, b = (index.select("slot", "by_initial", F.col("nid").alias(f"nid_{x}"), F.col("bare").alias(f"bare_{x}")) for x in "ab")
    # A bare initial pairs with every key of its slot; two full keys never meet in an "i" slot, so the work there is linear in full keys.
    met = a.join(b, ["slot", "by_initial"]).filter((~F.col("by_initial") & (F.col("nid_a") < F.col("nid_b"))) | (F.col("by_initial") & F.col("bare_a") & (F.col("nid_a") != F.col("nid_b")) & (~F.col("bare_b") | (F.col("nid_a") < F.col("nid_b")))))
    candidates = met.select("nid_a", "nid_b", "bare_a", "bare_b").distinct()
    details = ("node", "main", "rest", "marks", "spellings", "forms", "partial")
    na = nodes.select("field_name", F.col("nid").alias("nid_a"), *[F.col(c).alias(f"{c}_a") for c in details])
    nb = nodes.select(F.col("nid").alias("nid_b"), *[F.col(c).alias(f"{c}_b") for c in details])
    verified = cut(candidates.join(na, "nid_a").join(nb, "nid_b").mapInPandas(lambda it: _verify(it, kinds), "field_name string, node_a string, node_b string, bare_a boolean, bare_b boolean"))
    # One pass over links of the same sort: full names among themselves, bare ones among themselves. Bare ones that fit one component join it.
    groups = cut(components(nodes, verified.filter("bare_a = bare_b").select("node_a", "node_b").distinct()))
    fits = verified.filter("bare_a and not bare_b").join(groups, F.col("node_b") == F.col("node")).groupBy("node_a").agg(F.min("component").alias("fit"), F.countDistinct("component").alias("fitting"))
    entity = groups.join(fits, F.col("node") == F.col("node_a"), "left").select("node", F.when(F.col("fitting") == 1, F.col("fit")).when(F.col("fitting") > 1, F.col("node")).otherwise(F.col("component")).alias("entity"))
    return keyed.join(entity, "node").select("field_name", "name", "entity")


def pairs(linked: DataFrame) -> DataFrame:
    """(field_name, name_a, name_b): every pair of different spellings of one entity, name_a < name_b by code point."""
    a, b = (linked.select("field_name", "entity", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, ["field_name", "entity"]).filter("name_a < name_b").select("field_name", "name_a", "name_b")


def classes(linked: DataFrame) -> DataFrame:
    """(field_name, name, entity, links): one row per string, with the number of other spellings of its entity. The links of `pairs`, not expanded."""
    sizes = linked.groupBy("field_name", "entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return linked.join(sizes, ["field_name", "entity"]).select("field_name", "name", "entity", "links")
