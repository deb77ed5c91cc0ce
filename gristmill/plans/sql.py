"""The rules as DuckDB SQL text, for cross-checks of the column expressions."""

from __future__ import annotations

from gristmill.functions.text import VOLATILE_WORDS
from gristmill.operators.rules import CAUTION_PENALTY, RuleSet


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has_any(text: str, phrases) -> str:
    return "(" + (" OR ".join(f"contains({text}, {q(p)})" for p in phrases) or "false") + ")"


def first(text: str, phrases) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {q(p)}) THEN {q(p)}" for p in phrases) + " END" if phrases else "NULL"


def first_match(text: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p)}) THEN regexp_extract({text}, {q(p)}, 0)" for p in patterns) + " END" if patterns else "NULL"


def joined(*parts: str) -> str:
    return f"concat_ws('; ', {', '.join(parts)})"


def normalize(text: str) -> str:
    folded = f"lower(strip_accents({text}))"
    dated = rf"regexp_replace({folded}, '\b(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}})\b', ' ', 'g')"
    plain = rf"regexp_replace({dated}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    words = ", ".join(map(q, VOLATILE_WORDS))
    return rf"array_to_string(list_filter(regexp_split_to_array({plain}, '\s+'), lambda t: t <> '' AND t NOT IN ({words}) AND NOT regexp_matches(t, '^[a-z]{{0,3}}\d{{4,}}$')), ' ')"


def rejected(rules: RuleSet) -> str:
    return f"({has_any('lower(trim(company))', rules.excluded_companies)} OR {has_any('lower(title)', rules.excluded_title_keywords)})"


LOWERED = "lower(title || chr(10) || description)"


def english_status(t: str, r: RuleSet) -> str:
    def hit(phrases, patterns):
        return f"(coalesce({first(t, phrases)}, {first_match(t, patterns)}) IS NOT NULL)"

    return f"CASE WHEN {hit(r.reject_phrases, r.reject_regex)} THEN 'reject' WHEN {hit(r.indeterminate_phrases, r.indeterminate_regex)} THEN 'indeterminate' ELSE 'compatible' END"


def english_evidence(t: str, r: RuleSet) -> str:
    s = english_status(t, r)
    return (
        f"CASE {s} WHEN 'reject' THEN {joined(first(t, r.reject_phrases), first_match(t, r.reject_regex))} "
        f"WHEN 'indeterminate' THEN {joined(first(t, r.indeterminate_phrases), first_match(t, r.indeterminate_regex))} ELSE '' END"
    )


def _days(t: str, p: str) -> str:
    return f"try_cast(regexp_extract({t}, {q(p)}, 1) AS INT)"


def remote(t: str, r: RuleSet) -> tuple[str, str]:
    """(status, evidence)."""
    status = [f"WHEN {has_any(t, r.hybrid_phrases)} THEN 'hybrid'"]
    evidence = [f"WHEN {has_any(t, r.hybrid_phrases)} THEN {first(t, r.hybrid_phrases)}"]
    for p in r.per_week_regex:
        status.append(f"WHEN {_days(t, p)} >= 1 THEN 'hybrid'")
        evidence.append(f"WHEN {_days(t, p)} >= 1 THEN regexp_extract({t}, {q(p)}, 0)")
    tolerated = []
    for p in r.per_month_regex:
        status.append(f"WHEN {_days(t, p)} > {r.max_onsite_days_per_month} THEN 'hybrid'")
        evidence.append(f"WHEN {_days(t, p)} > {r.max_onsite_days_per_month} THEN regexp_extract({t}, {q(p)}, 0)")
        tolerated.append(f"CASE WHEN {_days(t, p)} IS NOT NULL THEN regexp_extract({t}, {q(p)}, 0) END")
    for name, phrases in (("onsite", r.onsite_phrases), ("remote", r.positive_phrases)):
        status.append(f"WHEN {has_any(t, phrases)} THEN '{name}'")
        evidence.append(f"WHEN {has_any(t, phrases)} THEN {joined(*tolerated, first(t, phrases))}")
    return f"CASE {' '.join(status)} ELSE 'unknown' END", f"CASE {' '.join(evidence)} ELSE {joined(*tolerated, 'NULL')} END"


def caution(r: RuleSet, description: bool = False) -> str:
    parts = []
    for trigger, rescue in r.title_caution_words.items():
        hit = f"contains(lower(title), {q(trigger)}) AND NOT {has_any('lower(title)', rescue)}"
        if description:
            hit += f" AND NOT {has_any('lower(description)', rescue)}"
        parts.append(f"CASE WHEN {hit} THEN {q(trigger)} END")
    return joined(*parts)


def recency(days: str, r: RuleSet) -> str:
    return "CASE " + " ".join(f"WHEN {days} <= {d} THEN {p}" for d, p in r.recency_bonus) + " ELSE 0 END"


def score(status: str, r: RuleSet) -> str:
    t = LOWERED
    parts = [f"CASE WHEN contains({t}, {q(w.lower())}) THEN {n} ELSE 0 END" for w, n in [*r.role_weights.items(), *r.skill_weights.items()]]
    parts += [f"CASE WHEN {status} = 'remote' THEN {r.remote_bonus} ELSE 0 END", recency("days_old", r)]
    parts.append(f"CASE WHEN {caution(r, True)} <> '' THEN -{CAUTION_PENALTY} ELSE 0 END")
    return f"greatest(0, least({' + '.join(parts)}, 100))::INT"


def grade(s: str) -> str:
    return f"CASE WHEN {s} >= 90 THEN 'A+' WHEN {s} >= 80 THEN 'A' WHEN {s} >= 70 THEN 'B' WHEN {s} >= 55 THEN 'C' ELSE 'D' END"


def fit(s: str) -> str:
    return f"CASE WHEN {s} >= 95 THEN 'ideal' WHEN {s} >= 85 THEN 'strong' WHEN {s} >= 70 THEN 'good' WHEN {s} >= 50 THEN 'moderate' WHEN {s} >= 30 THEN 'weak' ELSE 'poor' END"
