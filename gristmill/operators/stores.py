"""Append-only logs, latest-wins views, the signature cache, the inbox, reports and health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill import schemas

LOW_RATIO = 0.3
BASELINE_RUNS = 10
BASELINE_MIN_RUNS = 2


def read_log(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ("signature",), enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """JSON lines read tolerantly: corrupt lines, missing required fields and unknown words are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    for name, words in (enums or {}).items():
        rows = rows.where(F.col(name).isNull() | F.col(name).isin(*words))
    return rows


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def file_system(spark: SparkSession, path: str):
    """(path, its file system) of Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> set[str]:
    """The commits of a log that :func:`append_once` writes."""
    top, fs = file_system(spark, path)
    names = [str(x.getPath().getName()) for x in fs.listStatus(top)] if fs.exists(top) else []
    return {n.removeprefix("commit=") for n in names if n.startswith("commit=")}


def append_once(rows: DataFrame, path: str, commit: str) -> bool:
    """Appends ``rows`` under the name ``commit``; does nothing if the log has this commit. True if it appended.

    The rows are staged where readers do not look and become part of the log by one rename of their folder, which file
    systems with atomic renames do or do not do. So whoever writes again after a crash, at whatever point, writes once.
    """
    spark = rows.sparkSession
    there, fs = file_system(spark, f"{path}/commit={commit}")
    if fs.exists(there):
        return False
    staged, _ = file_system(spark, f"{path}/_staged/{commit}")
    rows.write.mode("overwrite").parquet(staged.toString())
    if not fs.rename(staged, there) and not fs.exists(there):
        raise OSError(f"{there.toString()} could not be committed")
    return True


def read_appends(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all commits of a log, and of files that :func:`append` has put beside them."""
    top, fs = file_system(spark, path)
    rows = spark.createDataFrame([], schema)
    names = [str(x.getPath().getName()) for x in fs.listStatus(top)] if fs.exists(top) else []
    for start in ("commit=", "part-"):
        if any(n.startswith(start) for n in names):
            found = spark.read.schema(rows.schema).option("basePath", path).parquet(f"{path}/{start}*").select(*rows.columns)
            rows = rows.unionByName(found)
    return rows


def _closed(kind: str, word: str | None) -> None:
    if word not in schemas.ENUMS[kind]:
        raise ValueError(f"no such {kind}: {word!r}")


def record(spark: SparkSession, root: str, log: str, entry: dict) -> int:
    """Appends one entry to a log under the next free number, which it returns; two writers never get the same one."""
    if not entry.get("signature"):
        raise ValueError("an entry needs a signature")
    path, schema = f"{root.rstrip('/')}/{log}", LOG_SCHEMAS[log]
    seq = (read_appends(spark, path, schema).agg(F.max("seq")).first()[0] or 0) + 1
    while not append_once(spark.createDataFrame([tuple({**entry, "seq": seq}.get(c) for c in schema.names)], schema), path, f"{seq:020d}"):
        seq += 1
    return seq


def track(spark: SparkSession, root: str, signature: str, action: str, at: datetime) -> int:
    """What the user did with a posting; any other action is refused before it reaches the log."""
    _closed("action", action)
    return record(spark, root, "tracking", {"signature": signature, "action": action, "tracked_at": at})


def label(spark: SparkSession, root: str, signature: str, word: str, at: datetime, reason: str | None = None) -> int:
    """What the user thinks of a posting's place in the list; the reason stays with bad ones only."""
    _closed("label", word)
    if reason is not None:
        _closed("reason", reason)
    return record(spark, root, "labels", {"signature": signature, "label": word, "reason": reason if word == "bad" else None, "labeled_at": at})


def overwrite_by(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replaces only the partitions that occur in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_document(rows: DataFrame, path: str) -> None:
    """One JSON file in place of another: readers see the old one or the new one, never none or half of one.

    For documents of a few rows; the new file is staged beside the old one and takes its name in one step.
    """
    spark = rows.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    staged, fs = file_system(spark, f"{folder}/_staged-{name}")
    rows.coalesce(1).write.mode("overwrite").json(staged.toString())
    made = next((x.getPath() for x in fs.listStatus(staged) if str(x.getPath().getName()).startswith("part-")), None)
    if made is None:  # no rows, no file
        made, _ = file_system(spark, f"{staged.toString()}/part-none")
        fs.create(made).close()
    target, _ = file_system(spark, path)
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        fs.delete(target, True)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    how[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, target, how)
    fs.delete(staged, True)


def replace_table(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A table of any size in place of another; written beside it first, so it is missing only between two renames."""
    spark = rows.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    staged, fs = file_system(spark, f"{folder}/_staged-{name}")
    old, _ = file_system(spark, f"{folder}/_old-{name}")
    target, _ = file_system(spark, path)
    rows.write.mode("overwrite").format(kind).save(staged.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(staged, target)
    fs.delete(old, True)


def latest(log: DataFrame, key: str = "signature", order: str = "seq") -> DataFrame:
    """The last written entry of each key; times do not count. Partial sums keep a frequent key cheap."""
    rest = [c for c in log.columns if c != key]
    picked = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e"))
    return picked.select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def dismissed(tracking: DataFrame) -> DataFrame:
    return latest(tracking).where("action = 'dismissed'").select("signature")


def mark_new(ranked: DataFrame, history: DataFrame) -> DataFrame:
    """``is_new``: never shown before. Materialise this before the history is appended to."""
    known = history.select(F.col("signature").alias("_s")).distinct().withColumn("_known", F.lit(True))
    return ranked.join(known, ranked["signature"] == known["_s"], "left").withColumn("is_new", F.col("_known").isNull()).drop("_s", "_known")


def merge_cache(cache: DataFrame, shown: DataFrame, today: Column) -> DataFrame:
    """The next snapshot: new signatures are inserted, known ones get today's date and whatever values are given."""
    s = shown.groupBy("signature").agg(*[F.max_by(c, "ord").alias(f"_{c}") for c in ("final_score", "title", "company", "source")])
    s = s.withColumn("_shown", F.lit(True))
    both = cache.join(s, "signature", "full_outer")
    shown_now = F.coalesce("_shown", F.lit(False))

    def text(name: str) -> Column:
        given = F.when(F.coalesce(f"_{name}", F.lit("")) != "", F.col(f"_{name}"))
        return F.coalesce(given, name, F.lit("")).alias(name)

    return both.select(
        "signature",
        F.coalesce("first_seen", today).alias("first_seen"),
        F.when(shown_now, today).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("_final_score", "final_score").cast("int").alias("final_score"),
        text("title"), text("company"), text("source"),
    )


def cache_records(cache: DataFrame) -> DataFrame:
    return cache.orderBy(F.desc("last_seen"), "signature")


def with_first_seen(entries: DataFrame, inbox: DataFrame, now: Column) -> DataFrame:
    """New inbox entries that keep the time at which their signature was first seen."""
    first = inbox.groupBy(F.col("signature").alias("_s")).agg(F.min("first_seen_at").alias("_first"))
    return entries.join(first, entries["signature"] == first["_s"], "left").withColumn("first_seen_at", F.coalesce("_first", now)).drop("_s", "_first")


def open_entries(inbox: DataFrame, tracking: DataFrame) -> DataFrame:
    """Latest entries whose signature is neither applied to nor dismissed, last seen first."""
    resolved = latest(tracking).select("signature")
    return latest(inbox).join(resolved, "signature", "left_anti").orderBy(F.desc("first_seen_at"), F.desc("seq"))


def bucket(first_seen: Column, now: Column, zone: str) -> Column:
    """today, yesterday, this_week or older, by calendar days of the user's zone."""
    days = F.date_diff(F.to_date(F.from_utc_timestamp(now, zone)), F.to_date(F.from_utc_timestamp(first_seen, zone)))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "this_week").otherwise("older")


def apply_candidates(inbox: DataFrame, tracking: DataFrame, applications: DataFrame) -> DataFrame:
    """Open entries of sources with a plain form and a grade above D, not yet prepared."""
    prepared = latest(applications).where("status <> 'failed'").select("signature")
    eligible = F.col("scored.job.source").isin("greenhouse", "lever") & (F.col("scored.grade") != "D")
    return open_entries(inbox, tracking).join(prepared, "signature", "left_anti").where(eligible)


def overlay(entries: DataFrame, tracking: DataFrame, labels: DataFrame, applications: DataFrame) -> DataFrame:
    """Entries with the latest action, label and application status of their signature."""
    out = entries
    for log, column, name in ((tracking, "action", "action"), (labels, "label", "label"), (applications, "status", "application_status")):
        out = out.join(latest(log).select("signature", F.col(column).alias(name)), "signature", "left")
    return out


# -- counts and reports ----------------------------------------------------------------------------------------------


def funnel(gated: DataFrame) -> DataFrame:
    """Rejected postings by source and reason. The filter stands behind the sum: before it, the rules would run twice."""
    counted = gated.groupBy("source", "reject_reason").agg(F.count("reject_reason").alias("n"))
    return counted.where("n > 0")


def funnel_map(gated: DataFrame) -> DataFrame:
    """The same as one nested map per source."""
    return funnel(gated).groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reject_reason", "n")))).alias("reasons"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label log, empty where nothing was labelled yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schemas.LABEL).parquet(path) if found else spark.createDataFrame([], schemas.LABEL)


def precision_report(labels: DataFrame) -> DataFrame:
    """good, bad, total and precision (null without labels) of the latest labels; one row."""
    return labels.agg(
        F.count_if(F.col("label") == "good").alias("good"), F.count_if(F.col("label") == "bad").alias("bad")
    ).select("good", "bad", (F.col("good") + F.col("bad")).alias("total_labeled"), F.try_divide("good", F.col("good") + F.col("bad")).alias("precision"))


def false_positive_reasons(labels: DataFrame) -> DataFrame:
    """Reasons of bad labels, the most frequent first."""
    return labels.where("label = 'bad'").groupBy(F.coalesce("reason", F.lit("unspecified")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def against_baseline(report: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """The report with the change of precision since the baseline; both are one row."""
    if baseline is None:
        return report.withColumn("delta", F.lit(None).cast("double"))
    then = baseline.select(F.col("precision").alias("_then"))
    return report.join(F.broadcast(then)).withColumn("delta", F.col("precision") - F.col("_then")).drop("_then")


def next_baseline(report: dict, existing: dict | None, reset: bool = False) -> dict | None:
    """The first report with labels becomes the baseline; an empty one never does; ``reset`` replaces it."""
    return report if report["total_labeled"] and (reset or existing is None) else existing


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved report that others are compared with, one row, if there is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema("good bigint, bad bigint, total_labeled bigint, precision double").json(path) if found else None


def report_against(labels: DataFrame, path: str, reset: bool = False) -> DataFrame:
    """The report of the latest labels with its change since the baseline at ``path``, which is kept up there.

    The first report with labels becomes the baseline and has no change to show, nor has one that replaces it.
    """
    spark = labels.sparkSession
    report, before = precision_report(labels), load_baseline(spark, path)
    now, then = report.first().asDict(), before.first().asDict() if before is not None else None
    chosen = next_baseline(now, then, reset)
    if chosen is not None and chosen is not then:
        write_document(report, path)
        return against_baseline(report, None)
    return against_baseline(report, None if then is None else spark.createDataFrame([tuple(then.values())], before.schema))


def grade_counts(scored: DataFrame) -> DataFrame:
    """Postings by tier; C and D count as one."""
    tier = F.when(F.col("grade").isin("C", "D"), "C/D").otherwise(F.col("grade"))
    return scored.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def source_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def view(scored: DataFrame, grade: str | None = None, source: str | None = None, search: str = "") -> DataFrame:
    """What a list shows: D only when asked for, one source, and a part of title and company."""
    out = scored.where(F.col("grade") == grade) if grade else scored.where("grade <> 'D'")
    if source:
        out = out.where(F.col("source") == source)
    return out.where(F.contains(F.lower(F.concat_ws(" ", "title", "company")), F.lit(search.lower()))) if search else out


def provider_usage(requests: DataFrame, today: Column) -> DataFrame:
    """Requests by provider on one day."""
    return requests.where(F.col("date") == today).groupBy("provider").agg(F.sum("requests").alias("requests"), F.max("exhausted").alias("exhausted"))


# -- health ----------------------------------------------------------------------------------------------------------


def with_baseline(yields: DataFrame) -> DataFrame:
    """Each run with the mean yield of its source's last runs before it, null with too few of them."""
    w = Window.partitionBy("source").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.avg("yielded").over(w.rowsBetween(-BASELINE_RUNS, -1))
    return yields.withColumn("baseline", F.when(F.count("*").over(before) >= BASELINE_MIN_RUNS, mean))


def health_status(status: Column, yielded: Column, baseline: Column) -> Column:
    return (
        F.when(status == "error", "error").when(yielded == 0, "zero").when((baseline > 0) & (yielded < baseline * LOW_RATIO), "low").otherwise("ok")
    )


def check_sources(results: DataFrame, yields: DataFrame) -> DataFrame:
    """This run's results against the baseline of the runs before; records nothing."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("seq")))
    past = yields.withColumn("_r", rn).groupBy(F.col("source").alias("_source")).agg(
        F.count("*").alias("_n"), F.avg(F.when(F.col("_r") <= BASELINE_RUNS, F.col("yielded"))).alias("_mean")
    )
    out = results.join(past, results["source"] == past["_source"], "left").withColumn("baseline", F.when(F.col("_n") >= BASELINE_MIN_RUNS, F.col("_mean")))
    return out.drop("_source", "_n", "_mean").withColumn("health", health_status(F.col("status"), F.col("yielded"), F.col("baseline")))


def reset(spark: SparkSession, root: str, cache_only: bool = False) -> None:
    """Removes run data, or the signature cache only. What the user decided (tracking, labels, inbox, applications) stays."""
    names = ("signatures",) if cache_only else ("raw", "gated", "scored", "prefiltered", "answers", "ranked", "results", "status", "history", "yields", "signatures", "manifest")
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


LOG_SCHEMAS = {"history": schemas.HISTORY, "tracking": schemas.TRACKING, "inbox": schemas.INBOX, "labels": schemas.LABEL, "applications": schemas.APPLICATION, "yields": schemas.YIELD, "usage": schemas.USAGE}
