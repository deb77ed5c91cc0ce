"""Explicit schemas of postings, scores and logs."""

from pyspark.sql import types as T

_S, _I, _B, _D, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DateType(), T.TimestampType()
_LIST = T.ArrayType(T.StringType())

#: Age of a posting whose date is unknown.
UNKNOWN_AGE = 999


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


JOB = _struct(
    source=_S, source_job_id=_S, signature=_S, title=_S, company=_S, description=_S, url=_S, remote_status=_S,
    remote_evidence=_LIST, posted_at=_D, days_old=_I, location_raw=_S, english_requirement=_S, english_evidence=_LIST,
    seniority_hint=_S, thin_description=_B, title_caution_flags=_LIST, collected_at=_TS,
)
SCORED = _struct(
    job=JOB, prefilter_score=_I, prefilter_passed=_B, ai_evaluated=_B, ai_score=_I, final_score=_I, grade=_S, fit=_S,
    pros=_LIST, contras=_LIST, summary=_S, flags=_LIST,
)
AI_RESULT = _struct(signature=_S, ai_score=_I, pros=_LIST, contras=_LIST, summary=_S)
CACHE = _struct(signature=_S, first_seen=_D, last_seen=_D, final_score=_I, title=_S, company=_S, source=_S)
#: Logs carry ``seq``: the latest entry of a key is the last one written, whatever its time says.
HISTORY = _struct(seq=T.LongType(), signature=_S, source=_S, title=_S, company=_S, shown_at=_TS)
TRACKING = _struct(seq=T.LongType(), signature=_S, action=_S, tracked_at=_TS)
INBOX = _struct(seq=T.LongType(), signature=_S, first_seen_at=_TS, scored=SCORED)
LABEL = _struct(seq=T.LongType(), signature=_S, label=_S, reason=_S, labeled_at=_TS)
APPLICATION = _struct(seq=T.LongType(), signature=_S, status=_S, answers=T.MapType(_S, _S), resume_path=_S, note=_S, updated_at=_TS)
YIELD = _struct(seq=T.LongType(), run_started_at=_TS, source=_S, yielded=_I, status=_S, duration_seconds=T.DoubleType())
USAGE = _struct(run_ts=_S, provider=_S, date=_S, requests=T.LongType(), exhausted=T.BooleanType())

#: Closed vocabularies; a record with another value is skipped on read.
ENUMS = {
    "remote_status": ("remote", "hybrid", "onsite", "unknown"),
    "english_requirement": ("compatible", "indeterminate", "reject"),
    "seniority_hint": ("junior", "mid", "senior", "unknown"),
    "grade": ("A+", "A", "B", "C", "D"),
    "fit": ("ideal", "strong", "good", "moderate", "weak", "poor"),
    "action": ("applied", "dismissed"),
    "label": ("good", "bad"),
    "reason": ("not_remote", "off_role", "english", "other"),
    "application_status": ("draft_ready", "manual_required", "submitted", "failed"),
    "run_status": ("running", "success", "paused", "error"),
    "health": ("ok", "low", "zero", "error"),
}
