"""Index settings: defaults, validation, patches."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from lodestone.errors import InvalidInput

SCORE_FIELD = "~score"
FILTERS_FIELD = "~filters"


@dataclass(frozen=True)
class RankingCriterion:
    field: str
    order: str = "desc"


@dataclass(frozen=True)
class IndexSettings:
    """``min_word_size_*`` of 0 or less disables that typo distance. With
    ``typo_field_exclusions`` the listed ``no_typo_tolerance_fields`` take no typo
    matches; by default the list is stored and reported only."""

    name: str
    searchable_fields: tuple[str, ...] = ()
    filterable_fields: tuple[str, ...] = ()
    ranking_criteria: tuple[RankingCriterion, ...] = ()
    min_word_size_for_1_typo: int = 4
    min_word_size_for_2_typos: int = 7
    fields_without_prefix_search: tuple[str, ...] = ()
    no_typo_tolerance_fields: tuple[str, ...] = ()
    non_typo_tolerant_words: tuple[str, ...] = ()
    distinct_field: str = ""
    typo_field_exclusions: bool = False

    @property
    def prefix_fields(self) -> tuple[str, ...]:
        return tuple(f for f in self.searchable_fields if f not in self.fields_without_prefix_search)

    def with_defaults(self) -> IndexSettings:
        """V8: missing thresholds get defaults; the second never undercuts the first."""
        one = self.min_word_size_for_1_typo or 4
        two = self.min_word_size_for_2_typos or 7
        return replace(self, min_word_size_for_1_typo=one, min_word_size_for_2_typos=two if two >= one else one + 1)

    def problems(self) -> list[str]:
        """V3, V9: every broken rule."""
        out = []
        if not self.name or not self.name.strip():
            out.append("name is required")
        lists = {k: getattr(self, k) for k in ("searchable_fields", "filterable_fields", "fields_without_prefix_search", "no_typo_tolerance_fields", "non_typo_tolerant_words")}
        for key, values in lists.items():
            if len(set(values)) < len(values):
                out.append(f"{key} has duplicates")
            if any(not v or not v.strip() for v in values):
                out.append(f"{key} has a blank name")
        for key in ("fields_without_prefix_search", "no_typo_tolerance_fields"):
            out += [f"{key}: '{v}' is not a searchable field" for v in lists[key] if v not in self.searchable_fields]
        for c in self.ranking_criteria:
            if c.order not in ("asc", "desc"):
                out.append(f"ranking order of '{c.field}' must be asc or desc")
            if not c.field or not c.field.strip():
                out.append("a ranking criterion has a blank field")
        return out

    def validated(self) -> IndexSettings:
        if found := self.problems():
            raise InvalidInput(found)
        return self.with_defaults()

    def to_dict(self) -> dict[str, Any]:
        return json.loads(self.to_json())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_dict(data: dict[str, Any]) -> IndexSettings:
        known = IndexSettings.__dataclass_fields__
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known and v is not None}
        kept["ranking_criteria"] = tuple(c if isinstance(c, RankingCriterion) else RankingCriterion(c["field"], c.get("order", "desc")) for c in data.get("ranking_criteria") or ())
        return IndexSettings(**{"name": "", **kept})


_STRING_LISTS = ("searchable_fields", "filterable_fields", "fields_without_prefix_search", "no_typo_tolerance_fields", "non_typo_tolerant_words")
_NUMBERS = ("min_word_size_for_1_typo", "min_word_size_for_2_typos")


def patch_settings(old: IndexSettings, patch: dict[str, Any]) -> IndexSettings:
    """Present keys replace, null clears, values of a wrong type are ignored and
    list elements that are no strings become ''. A patch without a known key fails."""
    changes: dict[str, Any] = {}
    known = False
    for key in _STRING_LISTS:
        if key in patch:
            known = True
            value = patch[key]
            if value is None:
                changes[key] = ()
            elif isinstance(value, list | tuple):
                changes[key] = tuple(x if isinstance(x, str) else "" for x in value)
    for key in _NUMBERS:
        if key in patch:
            known = True
            if isinstance(patch[key], int | float) and not isinstance(patch[key], bool):
                changes[key] = int(patch[key])
    if "distinct_field" in patch:
        known = True
        if patch["distinct_field"] is None or isinstance(patch["distinct_field"], str):
            changes["distinct_field"] = patch["distinct_field"] or ""
    if "ranking_criteria" in patch:
        known = True
        value = patch["ranking_criteria"]
        if value is None:
            changes["ranking_criteria"] = ()
        elif isinstance(value, list | tuple):
            changes["ranking_criteria"] = tuple(RankingCriterion(str(c.get("field", "")), str(c.get("order", ""))) for c in value if isinstance(c, dict))
    if not known:
        raise InvalidInput("no known setting to update")
    return replace(old, **changes)


def needs_reindex(old: IndexSettings, new: IndexSettings) -> bool:
    """Postings hold whole words of the searchable fields, so only that list
    matters; prefix search is derived at query time."""
    return set(old.searchable_fields) != set(new.searchable_fields)


def validate_name(name: str, what: str = "index name") -> str:
    """V1, V2: non-empty and without surrounding blanks."""
    if not name or not name.strip():
        raise InvalidInput(f"{what} is required")
    if name != name.strip():
        raise InvalidInput(f"{what} must not start or end with blanks")
    return name


def validate_rename(old: str, new: str) -> None:
    """V6."""
    validate_name(new, "new name")
    if old == new:
        raise InvalidInput("new name must differ")


def page_bounds(page: int | None, size: int | None, most: int | None = None) -> tuple[int, int]:
    """V5: page and size default to 1 and 10; ``most`` caps the size."""
    page = page if page and page > 0 else 1
    size = size if size and size > 0 else 10
    return page, min(size, most) if most else size


@dataclass(frozen=True)
class SearchQuery:
    """One search (M9). ``filters`` is the JSON filter tree."""

    query: str
    filters: dict[str, Any] | None = None
    page: int = 1
    page_size: int = 10
    restrict_searchable_fields: tuple[str, ...] = ()
    retrievable_fields: tuple[str, ...] = ()
    min_word_size_for_1_typo: int | None = None
    min_word_size_for_2_typos: int | None = None
    name: str = ""
    extra: dict[str, Any] = field(default_factory=dict, compare=False, hash=False)

    @staticmethod
    def from_dict(data: dict[str, Any]) -> SearchQuery:
        known = SearchQuery.__dataclass_fields__
        return SearchQuery(**{"query": "", **{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known and v is not None}})
