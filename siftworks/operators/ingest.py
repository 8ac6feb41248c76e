"""From listings, manifests and descriptions to catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions.documents import as_list, promoted
from siftworks.functions.text import clean_readme, head_and_tail, urls

#: Extensions whose content is mirrored; other files are kept as empty stubs.
CONTENT = (".json", ".tsv")
DATATYPES = {"mri": "func", "fmri": "func", "eeg": "eeg", "ieeg": "ieeg", "meg": "meg", "pet": "pet", "dwi": "dwi", "anat": "anat", "beh": "beh"}


def extension(path: Column) -> Column:
    """The file extension; `.nii.gz` and its like are one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"(\.[A-Za-z0-9]+(?:\.gz)?)$", 1)


def classify(manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, size) with extension and action: `content`, `stub` or `skip` (resource forks)."""
    name = F.element_at(F.split("path", "/"), -1)
    e = extension(F.col("path"))
    return manifest.withColumn("extension", e).withColumn("action", F.when(name.startswith("._"), "skip").when(F.lower(e).isin(*CONTENT), "content").otherwise("stub"))


def checkout_manifest(listing: DataFrame) -> DataFrame:
    """(path, size, kept) of a repository's tree from its long listing (`value`: mode, type, object, size, tab, path): the same manifest as of an object store. Links are
    annexed content that isn't there (`kept` is false, size NULL); folders, sub-repositories and lines of another form are left out. Cloning itself is the work of
    the repository's own program."""
    part = lambda i: F.regexp_extract("value", r"^(\d{6}) (\w+) ([0-9a-f]+) +(\d+|-)\t(.+)$", i)
    rows = listing.select(part(1).alias("mode"), part(2).alias("kind"), part(4).alias("size"), part(5).alias("path")).filter("kind = 'blob' AND path <> ''")
    kept = F.col("mode") != "120000"
    return rows.select("path", F.when(kept, F.col("size").try_cast("long")).alias("size"), kept.alias("kept"))


#: Members of a stored answer about a dataset, and their types.
ANSWER = (
    "data struct<dataset: struct<id: string, metadata: struct<datasetName: string, datasetDOI: string, license: string, authors: array<string>, fundingSource: string, modalities: array<string>, tasks: array<string>, "
    "sex: struct<maleCount: int, femaleCount: int, otherCount: int>, numberOfParticipants: int>>>"
)


def answered_datasets(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(id, name, doi, license, authors, funding, modalities, tasks, males, females, others) from stored answers of a dataset service; answers without a dataset, or broken ones,
    give no rows, absent members NULL."""
    d = F.from_json(column, ANSWER)["data"]["dataset"]
    m = d["metadata"]
    fields = {"name": "datasetName", "doi": "datasetDOI", "license": "license", "authors": "authors", "funding": "fundingSource", "modalities": "modalities", "tasks": "tasks"}
    return answers.filter(d["id"].isNotNull()).select(d["id"].alias("id"), *[m[f].alias(n) for n, f in fields.items()], *[m["sex"][f].alias(n) for n, f in (("males", "maleCount"), ("females", "femaleCount"), ("others", "otherCount"))])


def accessions(prefixes: DataFrame, pattern: str = r"^(ds\d{6})/$") -> DataFrame:
    """Accession ids among the top-level prefixes of a listing, sorted, once each."""
    return prefixes.select(F.regexp_extract("prefix", pattern, 1).alias("accession_id")).filter("accession_id <> ''").distinct().orderBy("accession_id")


def listed(text: Column) -> Column:
    """The entries of a comma-separated setting, trimmed, empty ones out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def accession_list(text: str | None, listed: list[str] | dict | None = None) -> list[str]:
    """Accessions from a comma-separated setting, else from a list or `{accessions: [...]}`."""
    if text and text.strip():
        return [x.strip() for x in text.split(",") if x.strip()]
    found = listed.get("accessions") if isinstance(listed, dict) else listed
    return [str(x).strip() for x in found or () if str(x).strip()]


def dataset_row(raw: DataFrame) -> DataFrame:
    """Dataset columns from the description JSON and readme: lists coerced, texts promoted, references from the readme before it is cleaned, names cut to 300 characters.

    `raw`: id, name, description (JSON), readme."""
    d = F.col("description")
    return raw.select(
        "id", F.substring("name", 1, 300).alias("name"),
        as_list(d, "Authors").alias("authors"), as_list(d, "Funding").alias("funding"),
        promoted(F.get_json_object(d, "$.License")).alias("license"), promoted(F.get_json_object(d, "$.DatasetDOI")).alias("doi"),
        urls(F.col("readme")).alias("paper_references"), head_and_tail(clean_readme(F.col("readme"))).alias("readme_text"),
    )


def synthetic_participants(counts: DataFrame) -> DataFrame:
    """(dataset_id, participant_id, sex): rows for known numbers of M, F and O, `sub-001` on across the groups. Numbers NULL or below one give no rows."""
    groups = counts.select("dataset_id", F.posexplode(F.array(*[F.struct(F.lit(s).alias("sex"), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias("n")) for s, c in (("M", "males"), ("F", "females"), ("O", "others"))])).alias("g", "x"), "males", "females")
    offset = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, F.greatest(F.coalesce("males", F.lit(0)), F.lit(0))).otherwise(F.greatest(F.coalesce("males", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("females", F.lit(0)), F.lit(0)))
    each = groups.filter("x.n > 0").select("dataset_id", "x.sex", offset.alias("o"), F.explode(F.sequence(F.lit(1), F.col("x.n").cast("int"))).alias("i"))
    return each.select("dataset_id", F.format_string("sub-%03d", (F.col("o") + F.col("i")).cast("int")).alias("participant_id"), "sex")


def stub_objects(tasks: DataFrame) -> DataFrame:
    """(dataset_id, task, datatype, subject NULL): one object per task; the datatype is that of the first known modality, else func."""
    known = F.create_map(*[F.lit(x) for pair in DATATYPES.items() for x in pair])
    mapped = F.filter(F.transform("modalities", lambda m: F.element_at(known, F.lower(m))), lambda x: x.isNotNull())
    return tasks.select("dataset_id", F.explode("tasks").alias("task"), F.coalesce(F.get(mapped, F.lit(0)), F.lit("func")).alias("datatype"), F.lit(None).cast("string").alias("subject"))


def institutions(objects: DataFrame) -> DataFrame:
    """(dataset_id, institutions) from the objects' JSON; datasets without any are left out."""
    name = F.trim(F.get_json_object("other_entities", "$.InstitutionName"))
    return objects.select("dataset_id", name.alias("n")).filter("n <> ''").groupBy("dataset_id").agg(F.array_sort(F.collect_set("n")).alias("institutions"))


def fill(target: DataFrame, key: str, column: str, values: DataFrame) -> DataFrame:
    """`target` with `column` from `values` (key, column) where given: UPDATE ... FROM as a left join."""
    v = values.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return target.join(v, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Copy-on-write merge: `columns` of matching rows overwritten, other columns kept, unknown keys added. One row of `new` per key is expected; equal keys keep the largest values."""
    given = new.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_new"))
    rest = [c for c in old.columns if c not in keys and c not in columns]
    return old.withColumn("_old", F.lit(True)).join(given, keys, "full").select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns], *rest).select(*old.columns)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has no result yet, in key order."""
    return work.join(done.select(key).distinct(), key, "left_anti").orderBy(key)
