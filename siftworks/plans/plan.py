"""The typed query plan: what a search asks for, independent of how it runs."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass
from enum import Enum
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints


class Family(str, Enum):
    CONCEPT = "concept_query"
    PARTICIPANT = "participant_filter"
    COMPARISON = "comparison_query"
    AGE = "age_query"
    SCAN = "scan_filter"
    MULTIMODAL = "multimodal_query"
    ABSENCE = "absence_query"
    SUBJECT_MULTIMODAL = "subject_multimodal"
    AUTHOR = "author_query"
    DESCRIPTION = "description_search"
    DOI = "doi_query"
    LICENSE = "license_query"
    FUNDING = "funding_query"
    JSON_NUMERIC = "json_numeric_query"
    METADATA = "metadata_query"
    SESSION = "session_query"
    RANKING = "ranking_query"
    AGGREGATE = "aggregate_query"
    COMBINED = "combined_filter"


OPERATORS = ("=", ">", "<", ">=", "<=", "!=", "exists", "not_exists")
SCAN_FIELDS = ("datatype", "suffix", "task")
METRICS = ("avg_age", "participant_count", "file_count")


@dataclass(frozen=True)
class MetadataFilter:
    """A test of a member of the objects' JSON."""

    json_field: str
    operator: str
    value: float | str | None = None


@dataclass(frozen=True)
class Cohort:
    """Participants with all the given properties; values are codes or spellings of the tables."""

    name: str = "all_participants"
    diagnosis: tuple[str, ...] = ()
    sex: tuple[str, ...] = ()
    handedness: tuple[str, ...] = ()
    age_min: float | None = None
    age_max: float | None = None
    min_participants: int | None = None
    extra: tuple[MetadataFilter, ...] = ()


@dataclass(frozen=True)
class Scan:
    """Objects with one of the codes of any of the three fields (`any_field`), or with a code of each field given."""

    datatype: tuple[str, ...] = ()
    suffix: tuple[str, ...] = ()
    task: tuple[str, ...] = ()
    required: bool = True
    same_subject: bool = False
    any_field: bool = True


@dataclass(frozen=True)
class Comparison:
    """Participants of the first cohort against those of the second, per dataset."""

    left: Cohort
    operator: str
    right: Cohort


@dataclass(frozen=True)
class ScoredCode:
    field: str
    code: str
    score: float = 1.0


@dataclass(frozen=True)
class QueryPlan:
    family: Family
    cohorts: tuple[Cohort, ...] = ()
    cohort_operator: str = "AND"
    scans: tuple[Scan, ...] = ()
    authors: tuple[str, ...] = ()
    funding: tuple[str, ...] = ()
    institution_search: str | None = None
    name_search: str | None = None
    description_search: str | None = None
    license_search: str | None = None
    doi_required: bool | None = None
    metadata: tuple[MetadataFilter, ...] = ()
    min_sessions: int | None = None
    comparison: Comparison | None = None
    min_subjects: int | None = None
    metric: str | None = None
    unresolved: tuple[str, ...] = ()
    disease_fallback: bool = False
    scored: tuple[ScoredCode, ...] = ()
    order_by: str | None = None
    descending: bool = True
    limit: int | None = None

    def validate(self) -> QueryPlan:
        """The plan itself; ValueError where it can't be run."""
        tests = [*self.metadata, *(x for c in self.cohorts for x in c.extra)]
        for m in tests:
            if m.operator not in OPERATORS:
                raise ValueError(f"operator {m.operator!r}")
            if (m.operator in ("exists", "not_exists")) != (m.value is None):
                raise ValueError(f"{m.json_field} {m.operator}: value {m.value!r}")
            if not m.json_field or "'" in m.json_field:
                raise ValueError(f"member name {m.json_field!r}")
        if self.cohort_operator not in ("AND", "OR"):
            raise ValueError(f"cohort operator {self.cohort_operator!r}")
        if self.comparison and self.comparison.operator not in ("=", ">", "<", ">=", "<="):
            raise ValueError(f"comparison {self.comparison.operator!r}")
        if self.metric is not None and self.metric not in METRICS:
            raise ValueError(f"metric {self.metric!r}")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit")
        for s in self.scans:
            if not (s.datatype or s.suffix or s.task):
                raise ValueError("a scan without codes")
        return self


def to_json(plan: Any) -> Any:
    """Plain lists, dicts and scalars, for a plan store or an API."""
    if is_dataclass(plan):
        return {f.name: to_json(getattr(plan, f.name)) for f in fields(plan)}
    if isinstance(plan, (tuple, list)):
        return [to_json(x) for x in plan]
    return plan.value if isinstance(plan, Enum) else plan


def from_json(kind: Any, data: Any) -> Any:
    """The inverse of `to_json` for `kind`; unknown members are refused."""
    if data is None:
        return None
    origin = get_origin(kind)
    if origin in (Union, UnionType):
        return from_json(next(a for a in get_args(kind) if a is not type(None)), data) if len([a for a in get_args(kind) if a is not type(None)]) == 1 else data
    if origin is tuple:
        return tuple(from_json(get_args(kind)[0], x) for x in data)
    if is_dataclass(kind):
        hints = get_type_hints(kind)
        if unknown := set(data) - set(hints):
            raise ValueError(f"unknown members {sorted(unknown)}")
        return kind(**{k: from_json(hints[k], v) for k, v in data.items()})
    if isinstance(kind, type) and issubclass(kind, Enum):
        return kind(data)
    return data


