"""Study parameters: what to search, what to keep, what to report."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

# Patterns that mark a post as written by a content creator.
CREATOR_PATTERNS = (
    r"my video",
    r"my videos",
    r"my channel",
    r"meu canal",
    r"meus v[ií]deos",
    r"tested",
    r"tried",
    r"testei",
    r"experimentei",
    r"my followers",
    r"my niche",
)

# Monitored vocabulary, in report order.
VOCABULARY = (
    "shadowban",
    "fyp",
    "algorithm",
    "retention",
    "engagement",
    "reach",
    "viral",
    "300 view jail",
    "metrics",
)

# The two report expressions.
TACTICS_PATTERN = r"\b(tested|tried|experimented|changed my|adjusted|worked|didn[''`]?t work)\b"
THEORIES_PATTERN = r"(post \d+ times?|best time to post|retention rate|3 seconds?|watch time)"

# Exploration lexicons.
ACTION_TERMS = ("tested", "tried", "experimented", "changed", "adjusted", "worked")
NATIVE_TERMS = ("shadowban", "algorithm", "retention", "engagement", "reach", "viral", "300 view", "fyp")
ANXIETY_PATTERNS = (
    "hate", "weird", "dropped", "confused", "jail", "struggle", "flop", "shadowban", "stuck", "chokes",
)
ACTANTS = {
    "Humano/Ação": ("tested", "tried", "changed", "post", "hook", "strategy"),
    "Máquina/Métrica": ("algorithm", "retention", "shadowban", "views", "fyp", "reach"),
}

STUDY_ID_SHAPE = re.compile(r"[a-zA-Z0-9_]+")


def _nonblank(values: Any, what: str) -> tuple[str, ...]:
    if isinstance(values, str) or not all(isinstance(v, str) and v.strip() for v in values):
        raise ValueError(f"{what}: expected non-blank strings")
    out = tuple(v.strip() for v in values)
    if not out:
        raise ValueError(f"{what}: at least one entry is needed")
    return out


def _kept(values: Any, what: str) -> tuple[str, ...]:
    """Optional entries: stripped, blank ones dropped."""
    if isinstance(values, str) or not all(isinstance(v, str) for v in values):
        raise ValueError(f"{what}: expected strings")
    return tuple(v.strip() for v in values if v.strip())


def _settle(params: Any, **values: Any) -> None:
    for name, value in values.items():
        object.__setattr__(params, name, value)


@dataclass(frozen=True)
class SearchParams:
    time_filter: str = "year"
    max_posts_per_search: int = 40
    max_comments_per_post: int = 20

    def __post_init__(self) -> None:
        _settle(
            self, time_filter=str(self.time_filter).strip() or "year",
            max_posts_per_search=int(self.max_posts_per_search), max_comments_per_post=int(self.max_comments_per_post),
        )
        if self.max_posts_per_search < 1 or self.max_comments_per_post < 0:
            raise ValueError("search: need max_posts_per_search >= 1 and max_comments_per_post >= 0")


@dataclass(frozen=True)
class Filters:
    min_comments: int = 3
    min_chars: int = 30
    creator_patterns: tuple[str, ...] = CREATOR_PATTERNS
    exclude_terms: tuple[str, ...] = ()
    require_any_terms: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _settle(
            self, min_comments=int(self.min_comments), min_chars=int(self.min_chars),
            creator_patterns=_kept(self.creator_patterns, "creator_patterns") or CREATOR_PATTERNS,
            **{name: _kept(getattr(self, name), name) for name in ("exclude_terms", "require_any_terms")},
        )


@dataclass(frozen=True)
class Analysis:
    vocabulary_terms: tuple[str, ...] = VOCABULARY
    tactics_pattern: str = TACTICS_PATTERN
    theories_pattern: str = THEORIES_PATTERN

    def __post_init__(self) -> None:
        _settle(
            self, vocabulary_terms=_nonblank(self.vocabulary_terms, "vocabulary_terms"),
            tactics_pattern=str(self.tactics_pattern or "").strip() or TACTICS_PATTERN,
            theories_pattern=str(self.theories_pattern or "").strip() or THEORIES_PATTERN,
        )


@dataclass(frozen=True)
class StudyProfile:
    study_id: str
    theme_label: str
    subreddits: tuple[str, ...]
    keyword_groups: Mapping[str, tuple[str, ...]]
    search: SearchParams = field(default_factory=SearchParams)
    filters: Filters = field(default_factory=Filters)
    analysis: Analysis = field(default_factory=Analysis)

    def __post_init__(self) -> None:
        check_study_id(self.study_id)
        if not self.theme_label.strip():
            raise ValueError("theme_label: must not be blank")
        object.__setattr__(self, "subreddits", _nonblank(self.subreddits, "subreddits"))
        groups = {g.strip(): _nonblank(kws, f"keyword_groups[{g!r}]") for g, kws in self.keyword_groups.items()}
        if not groups or "" in groups:
            raise ValueError("keyword_groups: needs named groups")
        object.__setattr__(self, "keyword_groups", groups)

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> "StudyProfile":
        """Profile from an already decoded configuration mapping; unknown keys are ignored."""
        return cls(
            study_id=raw["study_id"],
            theme_label=raw["theme_label"],
            subreddits=raw["subreddits"],
            keyword_groups=raw["keyword_groups"],
            search=_section(SearchParams, raw.get("search")),
            filters=_section(Filters, raw.get("filters")),
            analysis=_section(Analysis, raw.get("analysis")),
        )


def _section(kind: type, raw: Mapping[str, Any] | None) -> Any:
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in (raw or {}).items() if k in known and v is not None})


def check_study_id(study_id: str) -> str:
    if not STUDY_ID_SHAPE.fullmatch(study_id):
        raise ValueError("study_id: only letters, digits and underscore are allowed")
    return study_id
