"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and written with the middle last.

An Arrow-batched pandas UDF walks the units of a text with one ``finditer`` and keeps where each ends in an array of four
bytes a unit; the two cuts are two look-ups in it and three slices. A unit is whatever the pattern matches from left to
right, a code point by default. SHA-256 of ``seed:doc_id`` gives four numbers: two cuts, whether the text is changed at
all, and in which form. Nothing but the row itself decides, so a task that runs again writes the same.

The digest of the restored text is taken from a text that is put together again from output and form alone.

Defined results: a null text is an empty one, which stays plain, as does a text that holds a marker; a row without doc_id
is seeded with ``seed:`` alone; rows that repeat a doc_id are cut by the same numbers. Other columns are passed on
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, from which number on they stay plain, and below which the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = "1"
CODE_POINT = r"(?s:.)"

_FIELDS = "n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output_sha256: string, restored_sha256: string"


@dataclass(frozen=True)
class Cuts:
    """How texts are cut: what a unit is, the seed, and the shares of the forms."""

    unit: str = CODE_POINT
    seed: str = SEED
    plain_from: int = PLAIN_FROM
    suffix_first_below: int = SUFFIX_FIRST_BELOW


@dataclass(frozen=True)
class Cut:
    """A text as it is written; ``prefix`` and ``middle`` are code points, or None where it is plain."""

    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def numbers(seed: str, doc_id: str | None) -> list[int]:
    """The first four groups of eight digits of the seed's SHA-256."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in range(0, 16, 4)]


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, from left to right, with the start of the text before the first."""
    ends = array("I", (0,))
    ends.extend(map(regex.Match.end, unit.finditer(text)))
    return ends


def cut(text: str, doc_id: str | None, how: Cuts, unit: regex.Pattern) -> Cut:
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = numbers(how.seed, doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= how.plain_from:
        return Cut(n, "plain", None, None, text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.suffix_first_below:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text behind an output. A text holds no marker, so the first of each kind is the one that was written."""
    if form == "plain":
        return output
    opens, then = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, _, rest = output.removeprefix(opens).partition(then)
    second, _, middle = rest.partition(MIDDLE)
    return second + middle + first if form == "spm" else first + middle + second


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _udf(how: Cuts, with_output: bool):
    @F.pandas_udf(f"struct<{_FIELDS}{', output: string' * with_output}>")
    def fim(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
        unit, rows = regex.compile(how.unit), []
        for d, t in zip(doc_id, text, strict=True):
            c = cut(t or "", d, how, unit)
            # what is plain is its own restored text
            digest = _sha(c.output)
            restored = digest if c.form == "plain" else _sha(restore(c.output, c.form))
            rows.append((c.n, c.form, c.prefix, c.middle, digest, restored, *((c.output,) if with_output else ())))
        names = [f.split(":")[0].strip() for f in _FIELDS.split(",")] + ["output"] * with_output
        kinds = {"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"}
        return pd.DataFrame(rows, columns=names).astype(kinds)

    return fim


def _told(doc_id: Column, text: Column, how: Cuts, with_output: bool) -> Column:
    # as text, since a series of numbers with nulls would be one of floats
    return _udf(how, with_output)(doc_id.cast("bigint").cast("string"), text.cast("string"))


def cuts(docs: DataFrame, how: Cuts = Cuts()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text, one row per document."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _told(F.col("doc_id"), F.col("text"), how, False).alias("r")).select("doc_id", "r.*")


def transform(docs: DataFrame, how: Cuts = Cuts()) -> DataFrame:
    """The documents with ``text`` as it is written, all columns kept; ``n_chars`` follows the text if it is there."""
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).withColumn("r", _told(F.col("d.doc_id"), F.col("d.text"), how, True))
    cols = []
    for c in docs.columns:
        value = F.col(f"d.`{c}`")
        if c == "text":
            value = F.when(value.isNotNull(), F.col("r.output"))
        elif c == "n_chars":
            value = F.when(F.col("r.form") == "plain", value).otherwise(F.char_length("r.output").cast(docs.schema[c].dataType))
        cols.append(value.alias(c))
    return told.select(*cols)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('{SEED}:' || doc_id) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS c1, ('0x' || s[9:16])::BIGINT % (n + 1) AS c2,
             ('0x' || s[17:24])::BIGINT % 100 AS p, ('0x' || s[25:32])::BIGINT % 100 AS q FROM t),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}') OR p >= {PLAIN_FROM} THEN 'plain'
                  WHEN q < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, (CASE WHEN form <> 'plain' THEN a END)::BIGINT AS prefix_chars,
       (CASE WHEN form <> 'plain' THEN b - a END)::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid
                        ELSE '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM o
"""
