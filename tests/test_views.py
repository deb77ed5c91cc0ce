from pyspark.sql import functions as F

from gristmill.plans import views as V


def test_inbox_order(spark):
    rows = [(1, "a", "2024-06-30 10:00:00", 50), (2, "b", "2024-06-30 11:00:00", 90), (3, "c", "2024-06-29 10:00:00", 99), (4, "d", "2024-01-01 00:00:00", 100), (5, "e", "2024-06-30 12:00:00", 50)]
    frame = spark.createDataFrame(rows, "seq bigint, signature string, t string, s int").select("seq", "signature", F.to_timestamp("t").alias("first_seen_at"), F.struct(F.col("s").alias("final_score")).alias("scored"))
    none = spark.createDataFrame([(1, "zz", "applied")], "seq bigint, signature string, action string")
    got = V.inbox(frame, none, F.lit("2024-06-30 13:00:00").cast("timestamp"), "UTC").collect()
    assert [(r["signature"], r["bucket"]) for r in got] == [("b", "today"), ("e", "today"), ("a", "today"), ("c", "yesterday"), ("d", "older")]


def test_results_and_drafts(spark):
    ranked = spark.createDataFrame([("a", 1, 0, 50), ("b", 2, 0, 90)], "signature string, ord int, part int, final_score int")
    tracking = spark.createDataFrame([(1, "a", "applied")], "seq bigint, signature string, action string")
    assert [(r["signature"], r["action"]) for r in V.results(ranked, tracking).collect()] == [("b", None), ("a", "applied")]
    log = spark.createDataFrame([(1, "a", "draft_ready"), (2, "b", "draft_ready"), (3, "b", "submitted"), (1, "c", "draft_ready")], "seq bigint, signature string, status string")
    entries = spark.createDataFrame([(1, "a", 5)], "seq bigint, signature string, scored int")
    assert {(r["signature"], r["missing"]) for r in V.drafts(log, entries).collect()} == {("a", False), ("c", True)}
    assert [r["signature"] for r in V.pending(ranked, entries).collect()] == ["b"]


def test_labels_and_report(spark):
    assert [r[0] for r in spark.createDataFrame([("bad", "english"), ("good", "english")], "l string, r string").select(V.label_entry(F.col("l"), F.col("r"))).collect()] == ["english", None]
    assert [r[0] for r in spark.createDataFrame([(None,), (999,), (0,), (1,), (5,)], "d int").select(V.age_label(F.col("d"))).collect()] == ["unknown", "unknown", "today", "yesterday", "5 days ago"]
    assert V.report_text({"precision": None}, []) == "no labels yet"
    text = V.report_text({"precision": 0.5, "good": 2, "total_labeled": 4}, [("a", 1), ("b", 3)], {"precision": 0.25})
    assert text.split("\n") == ["precision: 50% (2/4)", "  b: 3", "  a: 1", "baseline 25%, change +25%"]


def test_report_of_a_root(spark, tmp_path):
    from gristmill import report, schemas
    from gristmill.operators import stores

    root = str(tmp_path)
    assert report.report(spark, root) == "no labels yet"

    def label(seq, signature, word, reason=None):
        stores.append(spark.createDataFrame([(seq, signature, word, reason, None)], schemas.LABEL), f"{root}/labels")

    label(1, "a", "good")
    label(2, "b", "bad", "english")
    assert report.report(spark, root) == "precision: 50% (1/2)\n  english: 1"
    label(3, "b", "good")
    assert report.report(spark, root) == "precision: 100% (2/2)\nbaseline 50%, change +50%"
