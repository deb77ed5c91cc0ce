"""Rules as data, compiled into column expressions. Matching is by substring, as rules of this kind are written."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "array<string>"


@dataclass(frozen=True)
class RuleSet:
    """Everything that decides about a posting. Phrases are lower case and in order of precedence."""

    excluded_companies: tuple[str, ...] = ()
    excluded_title_keywords: tuple[str, ...] = ()
    title_caution_words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reject_phrases: tuple[str, ...] = ()
    reject_regex: tuple[str, ...] = ()
    indeterminate_phrases: tuple[str, ...] = ()
    indeterminate_regex: tuple[str, ...] = ()
    positive_phrases: tuple[str, ...] = ()
    hybrid_phrases: tuple[str, ...] = ()
    onsite_phrases: tuple[str, ...] = ()
    per_week_regex: tuple[str, ...] = ()
    per_month_regex: tuple[str, ...] = ()
    max_onsite_days_per_month: int = 1
    role_weights: dict[str, int] = field(default_factory=dict)
    skill_weights: dict[str, int] = field(default_factory=dict)
    remote_bonus: int = 20
    recency_bonus: tuple[tuple[int, int], ...] = ()
    reject_floor: int = 20
    cap: int = 50

    @classmethod
    def load(cls, path: str | Path) -> RuleSet:
        """From a TOML file with one key per field."""
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        return cls(**{k: _frozen(v) for k, v in data.items()})


def _frozen(value):
    if isinstance(value, list):
        return tuple(_frozen(v) for v in value)
    return {k: _frozen(v) for k, v in value.items()} if isinstance(value, dict) else value


def default_rules() -> RuleSet:
    return RuleSet.load(Path(__file__).with_name("rules.toml"))


def _has(text: Column, phrase: str) -> Column:
    return F.contains(text, F.lit(phrase))


def _any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | _has(text, p)
    return F.coalesce(found, F.lit(False))


def _first(text: Column, phrases) -> Column:
    """The first phrase in list order, whatever its place in the text; null without one."""
    return F.coalesce(*[F.when(_has(text, p), F.lit(p)) for p in phrases], F.lit(None).cast("string"))


def _first_match(text: Column, patterns) -> Column:
    found = [F.when(text.rlike(f"(?U){p}"), F.regexp_extract(text, f"(?U){p}", 0)) for p in patterns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def lowered(title: Column, description: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))


def company_excluded(company: Column, rules: RuleSet) -> Column:
    return _any(F.lower(F.trim(company)), rules.excluded_companies)


def title_excluded(title: Column, rules: RuleSet) -> Column:
    return _any(F.lower(title), rules.excluded_title_keywords)


def title_rejected(title: Column, company: Column, rules: RuleSet) -> Column:
    return company_excluded(company, rules) | title_excluded(title, rules)


def caution_flags(title: Column, rules: RuleSet, also_rescued_by: Column | None = None) -> Column:
    """Trigger words of the title that no rescue word of the title (or of another text) answers, in rule order."""
    t = F.lower(F.coalesce(title, F.lit("")))
    found = []
    for trigger, rescue in rules.title_caution_words.items():
        hit = _has(t, trigger) & ~_any(t, rescue)
        if also_rescued_by is not None:
            hit = hit & ~_any(F.lower(also_rescued_by), rescue)
        found.append(F.when(hit, F.lit(trigger)))
    return F.array_compact(F.array(*found)) if found else F.array().cast(_EMPTY)


def english(text: Column, rules: RuleSet) -> Column:
    """struct(status, evidence) of a lower-cased text: reject beats indeterminate beats compatible."""

    def evidence(phrases, patterns) -> Column:
        return F.array_compact(F.array(_first(text, phrases), _first_match(text, patterns)))

    reject, unclear = evidence(rules.reject_phrases, rules.reject_regex), evidence(rules.indeterminate_phrases, rules.indeterminate_regex)
    return (
        F.when(F.size(reject) > 0, F.struct(F.lit("reject").alias("status"), reject.alias("evidence")))
        .when(F.size(unclear) > 0, F.struct(F.lit("indeterminate").alias("status"), unclear.alias("evidence")))
        .otherwise(F.struct(F.lit("compatible").alias("status"), F.array().cast(_EMPTY).alias("evidence")))
    )


def _days(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, f"(?U){pattern}", 1).try_cast("int")


def remote(text: Column, rules: RuleSet) -> Column:
    """struct(status, evidence) of a lower-cased text. Signs of presence beat signs of remoteness."""
    verdict = F.when(
        _first(text, rules.hybrid_phrases).isNotNull(),
        F.struct(F.lit("hybrid").alias("status"), F.array(_first(text, rules.hybrid_phrases)).alias("evidence")),
    )

    def hybrid(pattern: str) -> Column:
        return F.struct(F.lit("hybrid").alias("status"), F.array(F.regexp_extract(text, f"(?U){pattern}", 0)).alias("evidence"))

    for p in rules.per_week_regex:
        verdict = verdict.when(_days(text, p) >= 1, hybrid(p))
    tolerated = []
    for p in rules.per_month_regex:
        days = _days(text, p)
        verdict = verdict.when(days > rules.max_onsite_days_per_month, hybrid(p))
        tolerated.append(F.when(days.isNotNull(), F.regexp_extract(text, f"(?U){p}", 0)))
    onsite, positive = _first(text, rules.onsite_phrases), _first(text, rules.positive_phrases)

    def with_last(last: Column) -> Column:
        return F.array_compact(F.array(*tolerated, last))

    return (
        verdict.when(onsite.isNotNull(), F.struct(F.lit("onsite").alias("status"), with_last(onsite).alias("evidence")))
        .when(positive.isNotNull(), F.struct(F.lit("remote").alias("status"), with_last(positive).alias("evidence")))
        .otherwise(F.struct(F.lit("unknown").alias("status"), with_last(F.lit(None).cast("string")).alias("evidence")))
    )


def recency_bonus(days_old: Column, rules: RuleSet) -> Column:
    bonus = F.lit(0)
    for days, points in reversed(rules.recency_bonus):
        bonus = F.when(days_old <= days, points).otherwise(bonus)
    return bonus


CAUTION_PENALTY = 5


def prefilter_score(title: Column, description: Column, remote_status: Column, days_old: Column, rules: RuleSet) -> Column:
    """0 to 100 from role and skill words, remoteness and recency, less a penalty for unanswered caution words."""
    text = lowered(title, description)
    raw = F.lit(0)
    for word, weight in [*rules.role_weights.items(), *((w.lower(), n) for w, n in rules.skill_weights.items())]:
        raw = raw + F.when(_has(text, word), weight).otherwise(0)
    raw = raw + F.when(remote_status == "remote", rules.remote_bonus).otherwise(0) + recency_bonus(days_old, rules)
    raw = raw - F.when(F.size(caution_flags(title, rules, description)) > 0, CAUTION_PENALTY).otherwise(0)
    return F.greatest(F.lit(0), F.least(raw, F.lit(100))).cast("int")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A+").when(score >= 80, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("D")


def fit(score: Column) -> Column:
    return (
        F.when(score >= 95, "ideal").when(score >= 85, "strong").when(score >= 70, "good").when(score >= 50, "moderate").when(score >= 30, "weak").otherwise("poor")
    )
