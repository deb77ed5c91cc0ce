"""Ages of postings. ``now`` is always a parameter: a timestamp column or literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.schemas import UNKNOWN_AGE

#: Month names of the relative-date format, fixed values.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def elapsed_days(then: Column, now: Column) -> Column:
    """Full periods of 24 hours, not calendar days; never negative, and the sentinel where the time is unknown."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)
    return F.when(days.isNull(), UNKNOWN_AGE).when(days < 0, 0).otherwise(days).cast("int")  # greatest() would skip the null


def parse_time(text: Column) -> Column:
    """ISO dates and times, with or without a zone (UTC then), and RFC 2822 mail dates."""
    mail = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")),
    )


def relative_age(text: Column, now: Column) -> Column:
    """A Spanish relative date to days. The order of the cases matters, and all digits of the text make one number."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    digits = F.regexp_replace(t, r"[^0-9]", "")
    number = digits.try_cast("int")
    parts = F.split(t, " de ")
    day = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.trim(F.get(parts, F.lit(1)))).cast("int")
    posted = F.try_to_timestamp(
        F.concat_ws("-", F.year(now).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")
    )
    has = lambda *words: F.greatest(*[F.contains(t, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when(t == "", UNKNOWN_AGE)
        .when(has("más de 30", "mas de 30"), 31)
        .when(t == "ayer", 1)
        .when(has("hora", "minuto", "hoy", "recién"), 0)
        .when(has("semana"), F.coalesce(number, F.lit(1)) * 7)
        .when(has("mes"), F.coalesce(number, F.lit(1)) * 30)
        .when(has("día", "dia"), F.coalesce(number, F.lit(0)))
        .otherwise(elapsed_days(posted, now))
        .cast("int")
    )
