"""The shared tables in the shape of postings and logs, and a rule set whose words occur in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.rules import RuleSet

NOW = "2024-06-30 12:00:00"
TODAY = "2024-06-30"
ZONE = "America/Mexico_City"

RULES = RuleSet(
    excluded_companies=("src13", "src7 "),
    excluded_title_keywords=("thwh", "keitver", "hr "),
    title_caution_words={"the": ("and", "tion"), "des": ("que",), "ein": ("und", "heit"), "las": ("ción",)},
    reject_phrases=("stupid", "réeux", "achkeit"),
    reject_regex=(r"\bidiot\b", r"\b\d{16}\b"),
    indeterminate_phrases=("thbleing", "thing", "elleque"),
    indeterminate_regex=(r"\b9\d{15}\b",),
    positive_phrases=("this", "dans", "sich", "para", "from"),
    hybrid_phrases=("threrewh", "ouvioi", "schkeit"),
    onsite_phrases=("whblest", "anouan"),
    per_week_regex=(r"(\d+)\s*days?\s*(?:a|per)\s*week",),
    per_month_regex=(r"\b(\d{2})\.\d+\.\d+",),
    max_onsite_days_per_month=50,
    role_weights={"thing": 15, "tion of": 20, "que de": 25, "der die": 25, "ción de": 25},
    skill_weights={"Thble": 20, "Ound": 10, "Ment": 15, "Keit": 15, "Cias": 20},
    remote_bonus=20,
    recency_bonus=((3, 10), (7, 8), (14, 5), (30, 2)),
    reject_floor=40,
    cap=50,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line is the title, the source the company, the language the board."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("source"),
        F.col("doc_id").cast("string").alias("source_job_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("source").alias("company"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id")).alias("url"),
        (F.col("doc_id") % 19).cast("int").alias("days_old"),
    )


JOBS_SQL = """jobs AS (SELECT doc_id AS ord, lang AS source, string_split(text, chr(10))[1] AS title, source AS company,
  text AS description, (doc_id % 19)::INT AS days_old FROM documents)"""


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: the user is the signature, the type of event the action."""
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "click", "dismissed")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("signature"), F.coalesce(action, F.lit("seen")).alias("action"),
        F.col("event_type"), F.col("ts").alias("tracked_at"), F.col("value"),
    )


TRACK_SQL = """track AS (SELECT event_id AS seq, 'u' || user_id AS signature, event_type, ts AS tracked_at, value,
  CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'click' THEN 'dismissed' ELSE 'seen' END AS action FROM events)"""
