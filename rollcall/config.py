"""Settings of a run: every key is optional and falls back to the defaults here."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

# Match weights, trust order, source scores, field weights and skill methods of the specification.
WEIGHTS = {
    "email_match": 100, "phone_match": 80, "linkedin_match": 100, "github_match": 100, "name_similarity": 30,
    "location_match": 10, "company_overlap": 20, "education_overlap": 15, "skill_overlap": 10,
}
TRUST = ["resume_json", "linkedin_json", "github", "ats_csv", "hr_system", "portfolio_web", "pdf"]
CODE_TRUST = ["resume_json", "linkedin_json", "github", "ats_csv", "ats_json", "hr_system", "portfolio_web", "pdf"]
SOURCE_SCORES = {
    "resume_json": 0.95, "linkedin_json": 0.85, "github_repo_language": 0.80, "github_readme_keyword": 0.60, "pdf_keyword": 0.50,
    "portfolio_keyword": 0.50, "ats_csv": 0.70, "hr_system": 0.90, "inferred": 0.40,
}
CODE_SOURCE_SCORES = SOURCE_SCORES | {"github": 0.80, "pdf": 0.50, "portfolio_web": 0.50, "ats_json": 0.70}
FIELD_WEIGHTS = {
    "full_name": 15, "emails": 15, "phones": 10, "location": 5, "links": 5,
    "headline": 5, "years_experience": 5, "skills": 15, "experience": 15, "education": 10,
}
SKILL_METHODS = {
    "resume_json": "direct_assertion", "linkedin_json": "direct_assertion", "github": "repo_language_analysis", "pdf": "keyword_extraction",
    "portfolio_web": "keyword_extraction", "ats_csv": "direct_assertion", "ats_json": "direct_assertion", "hr_system": "direct_assertion",
}
STRONG = ("email_match", "phone_match", "linkedin_match", "github_match")


@dataclass(frozen=True)
class Config:
    """One run's settings, flat; ``from_dict`` takes the nested JSON form."""

    default_phone_region: str = "IN"
    max_github_repos: int = 50
    request_timeout_seconds: int = 30
    log_level: str = "INFO"
    merge_threshold: float = 80
    require_strong_signal_for_merge: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    name_similarity_threshold: float = 0.85
    skill_overlap_threshold: float = 0.50
    trust_hierarchy: list[str] = field(default_factory=lambda: list(TRUST))
    source_base_scores: dict[str, float] = field(default_factory=lambda: dict(SOURCE_SCORES))
    taxonomy_path: str | None = None

    @classmethod
    def from_dict(cls, data: dict[str, Any] | None) -> Config:
        """Keys may stand in any section; weights that are not given keep their defaults, other lists and maps are replaced."""
        known, given = {f.name for f in fields(cls)}, {}
        for section, value in (data or {}).items():
            for key, inner in value.items() if isinstance(value, dict) and section not in known else [(section, value)]:
                if key in known:
                    given[key] = inner
        if "weights" in given:
            given["weights"] = WEIGHTS | given["weights"]
        return cls(**given)

    @classmethod
    def load(cls, path: str | None) -> Config:
        """From a JSON file; the defaults if there is none or it can't be read."""
        return cls.from_dict(read_json(path))


def read_json(path: str | None) -> dict[str, Any] | None:
    """A JSON file's object, None if it is missing, broken or something else."""
    try:
        with open(path or "", encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return None
    return data if isinstance(data, dict) else None
