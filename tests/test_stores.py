import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gristmill import schemas
from gristmill.operators import stores as S

DAY = dt.date


def today():
    return F.lit("2024-06-30").cast("date")


def test_latest_is_by_sequence_not_by_time(spark):
    log = spark.createDataFrame([(1, "a", "applied", "2024-06-09"), (2, "a", "dismissed", "2024-06-01"), (3, "b", "applied", "2024-01-01")], "seq bigint, signature string, action string, at string")
    assert {(r["signature"], r["action"]) for r in S.latest(log.repartition(3)).collect()} == {("a", "dismissed"), ("b", "applied")}
    assert [r[0] for r in S.dismissed(log).collect()] == ["a"]


def test_tolerant_log_reading(spark, tmp_path):
    path = tmp_path / "tracking.jsonl"
    good = {"seq": 1, "signature": "a", "action": "applied", "tracked_at": "2024-01-01T00:00:00Z"}
    lines = [json.dumps(good), "", "not json", json.dumps({**good, "signature": None}), json.dumps({**good, "action": "flew"}), json.dumps({**good, "seq": "x"}), json.dumps({**good, "action": None, "signature": "b"})]
    path.write_text("\n".join(lines))
    got = S.read_log(spark, str(path), schemas.TRACKING, enums={"action": schemas.ENUMS["action"]}).collect()
    assert [(r["signature"], r["action"]) for r in got] == [("a", "applied"), ("b", None)]


def test_cache_merge_and_window(spark):
    cache = spark.createDataFrame([("old", DAY(2024, 1, 1), DAY(2024, 5, 1), 40, "T", "C", "s"), ("kept", DAY(2024, 1, 1), DAY(2024, 6, 1), 10, "t", "c", "z")], schemas.CACHE)
    shown = spark.createDataFrame([("old", 1, None, "", "New", "s"), ("new", 2, 77, "N", "", "s")], "signature string, ord bigint, final_score int, title string, company string, source string")
    got = {r["signature"]: tuple(r)[1:] for r in S.merge_cache(cache, shown, today()).collect()}
    assert got == {
        "old": (DAY(2024, 1, 1), DAY(2024, 6, 30), 40, "T", "New", "s"), "kept": (DAY(2024, 1, 1), DAY(2024, 6, 1), 10, "t", "c", "z"), "new": (DAY(2024, 6, 30), DAY(2024, 6, 30), 77, "N", "", "s")
    }
    assert [r["signature"] for r in S.cache_records(S.merge_cache(cache, shown, today())).collect()] == ["new", "old", "kept"]


def test_new_flag_first_seen_and_open_entries(spark):
    history = spark.createDataFrame([("a",)], "signature string")
    assert {r["signature"]: r["is_new"] for r in S.mark_new(spark.createDataFrame([("a",), ("b",)], "signature string"), history).collect()} == {"a": False, "b": True}
    inbox = spark.createDataFrame([(1, "a", "2024-06-01"), (2, "b", "2024-06-02"), (3, "a", "2024-06-05"), (4, "c", "2024-06-03")], "seq bigint, signature string, t string").select("seq", "signature", F.to_timestamp("t").alias("first_seen_at"))
    fresh = S.with_first_seen(spark.createDataFrame([("a",), ("z",)], "signature string"), inbox, F.lit("2024-06-30").cast("timestamp"))
    assert {r["signature"]: r["first_seen_at"].date() for r in fresh.collect()} == {"a": DAY(2024, 6, 1), "z": DAY(2024, 6, 30)}
    tracking = spark.createDataFrame([(1, "b", "applied")], "seq bigint, signature string, action string")
    assert [(r["signature"], r["seq"]) for r in S.open_entries(inbox, tracking).collect()] == [("a", 3), ("c", 4)]


def test_buckets_are_days_of_the_user(spark):
    now = F.lit("2024-06-30 05:30:00").cast("timestamp")  # 29 June, 23:30 there
    seen = {"2024-06-30 05:00:00": "today", "2024-06-29 05:59:00": "yesterday", "2024-06-29 06:01:00": "today", "2024-06-22 07:00:00": "this_week", "2024-06-22 05:00:00": "older", "2024-07-02 00:00:00": "today"}
    rows = spark.createDataFrame([(k,) for k in seen], "t string").select("t", S.bucket(F.col("t").cast("timestamp"), now, "America/Mexico_City").alias("b"))
    assert {r["t"]: r["b"] for r in rows.collect()} == seen


def test_health_needs_two_runs_and_uses_the_last_ten(spark):
    yields = spark.createDataFrame([(i, "s", y) for i, y in enumerate([1000, 1000, *[100] * 10])] + [(0, "t", 5)], "seq bigint, source string, yielded int")
    base = {(r["source"], r["seq"]): r["baseline"] for r in S.with_baseline(yields).collect()}
    assert base["s", 0] is None and base["s", 1] is None and base["s", 2] == 1000 and base["s", 11] == (1000 + 9 * 100) / 10 and base["t", 0] is None
    results = spark.createDataFrame([("s", "ok", 29), ("t", "ok", 1), ("u", "ok", 0), ("v", "error", 3)], "source string, status string, yielded bigint")
    got = {r["source"]: (r["health"], r["baseline"]) for r in S.check_sources(results, yields).collect()}
    assert got == {"s": ("low", 100.0), "t": ("ok", None), "u": ("zero", None), "v": ("error", None)}
    assert S.check_sources(results.where("source = 's'").withColumn("yielded", F.lit(30)), yields).first()["health"] == "ok"


def test_reports(spark):
    labels = spark.createDataFrame([("good", None), ("bad", "english"), ("bad", None), ("good", None)], "label string, reason string")
    report = S.precision_report(labels)
    assert tuple(report.first()) == (2, 2, 4, 0.5)
    assert {(r["reason"], r["n"]) for r in S.false_positive_reasons(labels).collect()} == {("english", 1), ("unspecified", 1)}
    assert S.precision_report(labels.where("false")).first()["precision"] is None
    assert S.against_baseline(report, S.precision_report(labels.where("label = 'good'"))).first()["delta"] == -0.5
    assert S.against_baseline(report, None).first()["delta"] is None
    empty, full = {"total_labeled": 0}, {"total_labeled": 4}
    assert S.next_baseline(empty, None) is None and S.next_baseline(full, None) is full and S.next_baseline(full, {"old": 1}) == {"old": 1} and S.next_baseline(full, {"old": 1}, reset=True) is full


def test_views_and_counts(spark):
    rows = spark.createDataFrame([("a", "A", "Data Lead", "Acme"), ("a", "D", "Data", "Beta"), ("b", "C", "Ops", "Acme")], "source string, grade string, title string, company string")
    assert S.view(rows).count() == 2 and S.view(rows, grade="D").count() == 1 and S.view(rows, source="b").count() == 1 and S.view(rows, search="ACME").count() == 2
    assert {(r["tier"], r["n"]) for r in S.grade_counts(rows).collect()} == {("A", 1), ("C/D", 2)}
    assert [(r["source"], r["n"]) for r in S.source_counts(rows).collect()] == [("a", 2), ("b", 1)]
    gated = spark.createDataFrame([("a", "stale"), ("a", "stale"), ("a", None), ("b", "gone")], "source string, reject_reason string")
    assert {(r["source"], tuple(r["reasons"].items())) for r in S.funnel_map(gated).collect()} == {("a", (("stale", 2),)), ("b", (("gone", 1),))}


def test_overlay_and_candidates(spark):
    t = "seq bigint, signature string, "
    tracking = spark.createDataFrame([(1, "a", "applied")], t + "action string")
    labels = spark.createDataFrame([(1, "b", "good"), (2, "b", "bad")], t + "label string")
    applications = spark.createDataFrame([(1, "a", "failed"), (1, "b", "draft_ready"), (1, "d", "failed")], t + "status string")
    entries = spark.createDataFrame([("a",), ("b",)], "signature string")
    got = {r["signature"]: (r["action"], r["label"], r["application_status"]) for r in S.overlay(entries, tracking, labels, applications).collect()}
    assert got == {"a": ("applied", None, "failed"), "b": (None, "bad", "draft_ready")}
    inbox = spark.createDataFrame(
        [(i, s, None, (((src,), g))) for i, (s, src, g) in enumerate([("a", "lever", "A"), ("b", "lever", "A"), ("c", "occ", "A"), ("d", "greenhouse", "B"), ("e", "lever", "D")])],
        t + "first_seen_at timestamp, scored struct<job: struct<source: string>, grade: string>",
    )
    assert [r["signature"] for r in S.apply_candidates(inbox, tracking, applications).collect()] == ["d"]


def test_partition_overwrite_and_reset(spark, tmp_path):
    path = str(tmp_path / "raw")
    S.overwrite_by(spark.createDataFrame([("a", 1), ("b", 1)], "source string, x int"), path, "source")
    S.overwrite_by(spark.createDataFrame([("a", 2)], "source string, x int"), path, "source")
    assert {(r["source"], r["x"]) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}
    for name in ("signatures", "tracking"):
        (tmp_path / name).mkdir()
    S.reset(spark, str(tmp_path), cache_only=True)
    assert not (tmp_path / "signatures").exists() and (tmp_path / "raw").exists()
    S.reset(spark, str(tmp_path))
    assert not (tmp_path / "raw").exists() and (tmp_path / "tracking").exists()


def test_the_first_report_with_labels_is_the_baseline(spark, tmp_path):
    path = str(tmp_path / "baseline")

    def labels(good, bad):
        return spark.createDataFrame([("good", None)] * good + [("bad", "other")] * bad, "label string, reason string")

    assert S.report_against(labels(0, 0), path).first()["delta"] is None and S.load_baseline(spark, path) is None
    assert S.report_against(labels(1, 1), path).first()["delta"] is None
    assert S.report_against(labels(3, 1), path).first()["delta"] == 0.25
    assert S.report_against(labels(4, 0), path, reset=True).first()["delta"] is None
    assert S.report_against(labels(1, 1), path).first()["delta"] == -0.5
    reasons = spark.createDataFrame([("bad", "b"), ("bad", "b"), ("bad", "a"), ("bad", None)], "label string, reason string")
    assert [(r["reason"], r["n"]) for r in S.false_positive_reasons(reasons).collect()] == [("b", 2), ("a", 1), ("unspecified", 1)]


def test_entries_of_users_are_closed_and_numbered(spark, tmp_path):
    root, at = str(tmp_path), dt.datetime(2024, 6, 30, 12)
    assert [S.track(spark, root, "a", "applied", at), S.track(spark, root, "b", "applied", at), S.track(spark, root, "a", "dismissed", at)] == [1, 2, 3]
    for bad in (("a", "liked"), ("", "applied"), ("a", None)):
        with pytest.raises(ValueError):
            S.track(spark, root, *bad, at)
    with pytest.raises(ValueError):
        S.label(spark, root, "a", "bad", at, "a reason of my own")
    log = S.read_appends(spark, f"{root}/tracking", S.LOG_SCHEMAS["tracking"])
    assert {(r["signature"], r["action"]) for r in S.latest(log).collect()} == {("a", "dismissed"), ("b", "applied")}
    assert S.label(spark, root, "a", "bad", at, "english") == 1 and S.label(spark, root, "b", "good", at, "english") == 2
    labels = S.read_appends(spark, f"{root}/labels", S.LOG_SCHEMAS["labels"]).orderBy("seq").collect()
    assert [(r["label"], r["reason"]) for r in labels] == [("bad", "english"), ("good", None)]


def test_two_writers_never_take_one_number(spark, tmp_path, monkeypatch):
    root, at, real = str(tmp_path), dt.datetime(2024, 6, 30), S.read_appends
    S.track(spark, root, "a", "applied", at)
    with monkeypatch.context() as m:  # the other writer has not seen the first entry
        m.setattr(S, "read_appends", lambda spark, path, schema: real(spark, path + "-none", schema))
        assert S.track(spark, root, "b", "applied", at) == 2
    assert S.committed(spark, f"{root}/tracking") == {f"{1:020d}", f"{2:020d}"}
