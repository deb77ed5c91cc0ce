"""Whom postings are judged for: a profile of a user's own, read from TOML, which prompts are headed with.

    name = "..."
    location = "..."
    current_role = "..."
    background = "..."
    languages = { english = "intermediate" }
    goal = "..."
    target_roles = ["..."]
    [skills]
    analytics = ["..."]
    [preferences]
    statement = "..."
    [application]
    availability = "..."

Nothing is filled in: a profile without one of the first six, or with a value of another kind, is an error that names it.
What ``application`` holds answers forms and never reaches a prompt that scores postings.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from functools import cache
from pathlib import Path


class BadProfile(ValueError):
    """A profile that cannot be used, and why."""


@dataclass(frozen=True)
class Profile:
    name: str
    location: str
    current_role: str
    background: str
    goal: str
    target_roles: tuple[str, ...]
    languages: dict[str, str] = field(default_factory=dict)
    skills: dict[str, tuple[str, ...]] = field(default_factory=dict)
    preferences: dict[str, str | bool] = field(default_factory=dict)
    application: dict[str, str | int] = field(default_factory=dict)

    def head(self) -> str:
        """The head of a prompt: everything but ``application``."""
        told = {
            "CANDIDATE": self.name, "LOCATION": self.location, "ROLE": self.current_role, "BACKGROUND": self.background,
            "LANGUAGES": ", ".join(f"{k}: {v}" for k, v in self.languages.items()),
            "TARGET ROLES": ", ".join(self.target_roles),
            "SKILLS": ", ".join(s for group in self.skills.values() for s in group),
            "GOAL": self.goal.strip(),
            "PREFERENCES": "; ".join(v.strip() if isinstance(v, str) else f"{k}: {'yes' if v else 'no'}" for k, v in self.preferences.items()),
        }
        return "\n".join(f"{k}: {v}" for k, v in told.items() if v)


#: What each field may hold, and how it is kept.
_STRING = (lambda v: isinstance(v, str), lambda v: v, "a string")
_STRINGS = (lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), tuple, "a list of strings")


def _table(value, what: str):
    good = lambda v: isinstance(v, dict) and all(value[0](x) for x in v.values())
    return good, lambda v: {k: value[1](x) for k, x in v.items()}, f"a table of {what}"


_SCALAR = (lambda v: isinstance(v, str | int | bool), lambda v: v, "a value")
_KINDS = {
    **dict.fromkeys(("name", "location", "current_role", "background", "goal"), _STRING), "target_roles": _STRINGS,
    "languages": _table(_STRING, "strings"), "skills": _table(_STRINGS, "lists of strings"), "preferences": _table(_SCALAR, "values"), "application": _table(_SCALAR, "values"),
}


def from_table(data: dict) -> Profile:
    """A profile of what a TOML file holds."""
    known = {f.name: f for f in fields(Profile)}
    if strange := sorted(data.keys() - known.keys()):
        raise BadProfile(f"no such field: {', '.join(strange)}")
    needed = [n for n in ("name", "location", "current_role", "background", "goal", "target_roles") if n not in data]
    if needed:
        raise BadProfile(f"missing: {', '.join(needed)}")
    kept = {}
    for name, value in data.items():
        good, keep, what = _KINDS[name]
        if not good(value):
            raise BadProfile(f"{name} must be {what}")
        kept[name] = keep(value)
    return Profile(**kept)


@cache
def load(path: str | Path) -> Profile:
    """The profile of a file; read once, since it does not change during a run."""
    return from_table(tomllib.loads(Path(path).read_text(encoding="utf-8")))
