"""Quality rules: a table of thresholds compiled into one projection of native expressions.

A rule is a row ``(name, numerator, denominator, lowest, highest)`` over the measures of a text. ``measures`` builds the
measures, ``verdict`` turns the table into one boolean column. There is no user function and no exchange: a document is
judged where it is read, whatever its source.

Defined results: a null or empty text has no words and is rejected; a repeated row is judged again; other columns are
passed on untouched, whatever their names.

The five-word windows of a text are compared by a 64-bit hash of their words, within the text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import SPACE, let, spaced_words, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in a is that it was for on are with as be at this have from or by not an "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par au sur pas avec "
    "el los y del se las por con no su para al lo como"
).split()
#: The words as they stand in a text: in lower case, at the start of a sentence, and in capitals.
STOP_FORMS = tuple(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())))

#: Lines that begin as items of a list, and lines that break off; alike in both engines.
BULLET, BREAKS_OFF = r"\A[\x20\x09-\x0D]*[-*•]", r"(\.\.\.|…)[\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``lowest <= numerator / denominator <= highest`` (a None bound is open).

    A text of fewer than ``from_words`` words is too short for the ratio to say anything and passes the rule.
    """

    name: str
    numerator: str
    denominator: str | None
    lowest: float | None
    highest: float | None
    from_words: int = 0


#: The production table. A ratio with denominator 0 counts as 0.
RULES = (
    Rule("words", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbols", "n_symbols", "word_chars", None, 0.07),
    Rule("shouting", "n_bangs", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, from_words=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 0.9, from_words=30),
    Rule("broken_lines", "n_broken_lines", "n_lines", None, 0.3, from_words=30),
)


def _windows(words: Column) -> Column:
    """Hash of each window of WINDOW words, in order."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words that stand in a window found more than once."""

    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(rows: Column) -> Column:
            twice = F.filter(
                F.transform(
                    rows,
                    lambda r, k: F.when(
                        (r["h"] == F.get(rows, k - 1)["h"]) | (r["h"] == F.get(rows, k + 1)["h"]), r["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.array_sort(twice)

        def total(at: Column) -> Column:
            widths = F.transform(
                at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
            )
            return F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, w: a + w)

        return let(let(ordered, positions), total)

    return let(
        windows,
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            repeated(hashes)
        ),
    )


def _char_count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("bigint")


def measures(text: Column) -> Column:
    """One struct with every measure that a rule may name."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("bigint").alias("n_stop_words"),
            _covered(_windows(words)).alias("n_repeat_words"),
        )

    def joined(part: Column) -> Column:
        return F.struct(
            part["n_words"].alias("n_words"),
            part["n_stop_words"].alias("n_stop_words"),
            part["n_repeat_words"].alias("n_repeat_words"),
            F.char_length(F.translate(whole, SPACE, "")).cast("bigint").alias("word_chars"),
            _char_count(whole, SYMBOLS).alias("n_symbols"),
            _char_count(whole, "!").alias("n_bangs"),
            let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("bigint").alias("n_lines"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                    F.size(F.filter(x, lambda y: y.rlike(BULLET))).cast("bigint").alias("n_bullet_lines"),
                    F.size(F.filter(x, lambda y: y.rlike(BREAKS_OFF))).cast("bigint").alias("n_broken_lines"),
                ),
            ).alias("by_line"),
        )

    return let(let(spaced_words(text), of_words), joined)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True while every rule of the table holds."""
    kept = F.lit(True)
    for rule in rules:
        short = m["n_words"] < rule.from_words
        value = _measure(m, rule.numerator)
        if rule.denominator:
            below = _measure(m, rule.denominator)
            value = F.when(below > 0, value / below).otherwise(F.lit(0.0))
        if rule.lowest is not None:
            kept = kept & (short | (value >= rule.lowest))
        if rule.highest is not None:
            kept = kept & (short | (value <= rule.highest))
    return kept


def _measure(m: Column, name: str) -> Column:
    return m["by_line"][name] if name.endswith("_lines") else m[name]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed and kept."""
    m = docs.select(F.col("doc_id"), measures(F.col("text")).alias("m"))
    m = m.select("doc_id", "m", base_failed(F.col("m")).alias("base_failed"), verdict(F.col("m"), rules).alias("passed"))
    return m.select(
        "doc_id",
        F.col("m.n_words").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.by_line.n_dup_lines").alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"),
        "base_failed",
        (~F.col("base_failed") & F.col("passed")).alias("kept"),
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    ok = let(measures(F.col("text")), lambda m: ~base_failed(m) & verdict(m, rules))
    return docs.where(ok)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    checks = []
    for r in RULES:
        value = r.numerator if not r.denominator else f"(CASE WHEN {r.denominator} > 0 THEN {r.numerator}::DOUBLE / {r.denominator} ELSE 0 END)"
        bounds = [f"{value} >= {r.lowest}"] * (r.lowest is not None) + [f"{value} <= {r.highest}"] * (r.highest is not None)
        checks += [f"(n_words < {r.from_words} OR {x})" for x in bounds]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(*) AS n_repeat_words FROM
            (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs,
             len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}')))::BIGINT AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '{BREAKS_OFF}')))::BIGINT AS n_broken_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(checks)}) AS kept
FROM j
"""


ORACLE_SQL = _sql()
