"""Readers of the file formats the catalogue is made from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.operators.vocabulary import CONCEPT


def vocabulary_rows(documents: list[dict], category: str) -> list[tuple]:
    """Concept rows of one category from YAML documents {category: {key: concept}}; keys of later documents replace earlier ones."""
    merged: dict[str, dict] = {}
    for doc in documents:
        merged.update((doc or {}).get(category) or {})
    rows = []
    for i, (key, c) in enumerate(merged.items()):
        synonyms = c.get("synonyms") or []
        synonyms = [synonyms] if isinstance(synonyms, str) else synonyms
        pairs = [(s["term"], float(s.get("weight", 1.0))) if isinstance(s, dict) else (str(s), 1.0) for s in synonyms if not isinstance(s, dict) or "term" in s]
        raw = [(str(d["raw"]), list(d.get("accession_ids") or d.get("datasets") or ())) for d in c.get("dataset_codes") or () if isinstance(d, dict) and "raw" in d]
        rows.append((str(key), c.get("label") or "", c.get("standard_code"), list(c.get("broader") or ()), list(c.get("part_of") or ()), pairs, [str(x) for x in c.get("codes") or ()], raw, i))
    return rows


def _whole(spark: SparkSession, path: str) -> str:
    """The text of one small file, in whatever file system."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_vocabulary(spark: SparkSession, paths: list[str], category: str) -> DataFrame:
    """Concepts of one category from YAML files. A vocabulary is a small curated file, so it is read on the driver."""
    import yaml

    return spark.createDataFrame(vocabulary_rows([yaml.safe_load(_whole(spark, p)) for p in paths], category), CONCEPT)


def nested_concepts(tree: dict, parent: str | None = None) -> dict[str, dict]:
    """A nested vocabulary made flat: children get `broader`; a key met again gets the ending `_group` for groups, else the first one is kept."""
    flat: dict[str, dict] = {}

    def walk(node: dict, above: str | None) -> None:
        for key, value in node.items():
            if not isinstance(value, dict):
                continue
            own = {k: v for k, v in value.items() if not isinstance(v, dict)}
            children = {k: v for k, v in value.items() if isinstance(v, dict)}
            name = key
            if name in flat:
                if not children:
                    continue
                name = f"{key}_group"
            flat[name] = {**own, **({"broader": [above]} if above else {})}
            walk(children, name)

    walk(tree, parent)
    return flat


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines give no rows."""
    df = spark.read.schema(schema).json(path)
    return df.filter(~F.forall(F.array(*[F.col(c).isNull() for c in df.columns]), lambda x: x))


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the members of one JSON object; values as JSON text."""
    found = json.loads(_whole(spark, path))
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in found.items()], "key string, value string")


def read_logs(spark: SparkSession, folder: str, since: int | None = None, pattern: str = "crawl_*.log") -> DataFrame:
    """(job, line_no, line) of log files, the job being the number in the file name; `since` keeps jobs from that one on. Lines are numbered within files as they are read."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    job = F.coalesce(F.regexp_extract("file", r"(\d+)", 1).try_cast("long"), F.lit(0))
    lines = df.select(job.alias("job"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.filter(F.col("job") >= since) if since is not None else lines


def array_elements(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty elements of a list column in order; text columns are read as JSON lists. Other types are refused."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "array<string>":
        values = F.col(column)
    elif kind == "string":
        values = F.from_json(column, "array<string>")
    else:
        raise TypeError(f"{column} is {kind}")
    return df.select(F.explode(values).alias("value")).filter("value <> ''").distinct().orderBy("value")
