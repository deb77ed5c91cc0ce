"""What a reader of the stores asks for: one function per view, each a DataFrame."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.dates import UNKNOWN_AGE
from gristmill.operators import stores as S
from gristmill.plans.stage import stage

#: Bits of monotonically_increasing_id for the place in a partition; the number of the partition is above them.
_IN_PARTITION = 33


def age_label(days: Column) -> Column:
    return (
        F.when(days.isNull() | (days >= UNKNOWN_AGE), "unknown").when(days <= 0, "today").when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def status(spark: SparkSession, root: str) -> DataFrame:
    """The state of the last run with its counts; one row."""
    return spark.read.json(f"{root.rstrip('/')}/status")


def results(ranked: DataFrame, tracking: DataFrame) -> DataFrame:
    """The last run, best first, with what was decided about each posting since."""
    action = S.latest(tracking).select("signature", "action")
    return ranked.join(action, "signature", "left").orderBy(F.desc("final_score"), "part", "ord")


def inbox(entries: DataFrame, tracking: DataFrame, now: Column, zone: str) -> DataFrame:
    """Open entries by bucket (newest first), score and time."""
    rows = S.open_entries(entries, tracking).withColumn("bucket", S.bucket(F.col("first_seen_at"), now, zone))
    place = F.array_position(F.array(*map(F.lit, ("today", "yesterday", "this_week", "older"))), F.col("bucket"))
    return rows.orderBy(place, F.desc("scored.final_score"), F.desc("first_seen_at"), F.desc("seq"))


def with_places(listed: DataFrame, *columns: str) -> DataFrame:
    """The places of an ordered listing, from 1, whatever its size.

    The ordering has dealt it by range, so a row's place is its place inside its partition and what the partitions before
    hold: one number for each of them. It is written once, so that both are of the same partitions.
    """
    put = stage(listed.sparkSession, "places")
    told = put(listed.select(*columns).withColumn("_at", F.monotonically_increasing_id()), "listed")
    part, inside = F.shiftright("_at", _IN_PARTITION), F.col("_at").bitwiseAND((1 << _IN_PARTITION) - 1)
    sizes = sorted((r["part"], r["n"]) for r in told.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    first = F.broadcast(listed.sparkSession.createDataFrame(before, "_part bigint, _first bigint"))  # one row per partition
    return told.join(first, part == F.col("_part")).select(*columns, (F.col("_first") + inside + 1).alias("place"))


def applications(log: DataFrame) -> DataFrame:
    return S.latest(log)


def labels(log: DataFrame) -> DataFrame:
    return S.latest(log)


def cache(snapshot: DataFrame) -> DataFrame:
    return S.cache_records(snapshot)


def drafts(applications_: DataFrame, entries: DataFrame) -> DataFrame:
    """Applications that are ready, with their inbox entry; ``missing`` where there is none, such drafts are skipped."""
    ready = S.latest(applications_).where("status = 'draft_ready'").select("signature")
    latest = S.latest(entries).select("signature", "scored")
    return ready.join(latest, "signature", "left").withColumn("missing", F.col("scored").isNull())


def pending(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """Selected rows that have no result yet, for a run that goes on."""
    return selected.join(scored.select("signature").distinct(), "signature", "left_anti")


def label_entry(label: Column, reason: Column) -> Column:
    """The reason of a label: only bad ones have one."""
    return F.when(label == "bad", reason)


def report_lines(report: DataFrame, reasons: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """The precision report as rows (section, rank, line), for a table as for a terminal."""
    share = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    head = report.select(
        F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("rank"),
        F.when(F.col("precision").isNull(), "no labels yet").otherwise(F.concat(F.lit("precision: "), share("precision"), F.format_string(" (%d/%d)", "good", "total_labeled"))).alias("line"),
    )
    rest = reasons.select(F.lit(1).alias("section"), (-F.col("n")).alias("rank"), F.format_string("  %s: %d", "reason", "n").alias("line"))
    out = head.unionByName(rest)
    if baseline is not None:
        both = report.select("precision").join(F.broadcast(baseline.select(F.col("precision").alias("then"))))  # one row each
        change = F.round((F.col("precision") - F.col("then")) * 100).cast("int")
        text = F.concat(F.lit("baseline "), share("then"), F.lit(", change "), F.when(change >= 0, "+").otherwise(""), change.cast("string"), F.lit("%"))
        out = out.unionByName(both.where("precision IS NOT NULL AND then IS NOT NULL").select(F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("rank"), text.alias("line")))
    return out


def report_text(report: dict, reasons: list[tuple[str, int]], baseline: dict | None = None) -> str:
    """What a terminal shows of a report that is on the driver."""
    if not report.get("total_labeled") and report["precision"] is None:
        return "no labels yet"
    told = [f"precision: {report['precision']:.0%} ({report['good']}/{report['total_labeled']})"]
    for reason, n in sorted(reasons, key=lambda r: (-r[1], r[0])):
        told.append(f"  {reason}: {n}")
    then = (baseline or {}).get("precision")
    return "\n".join(told if then is None else [*told, f"baseline {then:.0%}, change {report['precision'] - then:+.0%}"])
