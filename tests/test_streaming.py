import time

import pytest
from pyspark.sql import functions as F

from gristmill.operators import rules as R
from gristmill.operators import gate as G
from gristmill.operators import stores
from gristmill.streaming import shown as N
from gristmill.streaming import suppress as S


def feed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        yield i


def drain(frame, tmp_path, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.sql(f"SELECT * FROM {name}").collect()


SHOWN = "signature string, shown_at timestamp"


def test_showing_restarts_the_window(spark, tmp_path):
    days = ["2024-01-01", "2024-01-20", "2024-02-10", "2024-03-20", "2024-04-18"]
    rows = [("a", d) for d in days] + [("b", "2024-01-05")]
    frame = spark.createDataFrame(rows, "signature string, t string").select("signature", F.to_timestamp("t").alias("shown_at"))
    frame.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SHOWN).json(str(tmp_path / "in"))
    got = drain(S.suppress_seen(stream), tmp_path, "seen")
    assert [(r["signature"], str(r["shown_at"].date()), r["fresh"]) for r in sorted(got)] == [("a", "2024-01-01", True), ("a", "2024-01-20", False), ("a", "2024-02-10", False), ("a", "2024-03-20", True), ("a", "2024-04-18", False), ("b", "2024-01-05", True)]


def test_state_goes_when_the_window_has_passed(spark, tmp_path):
    def say(*rows):
        frame = spark.createDataFrame(list(rows), "signature string, t string").select("signature", F.to_timestamp("t").alias("shown_at"))
        frame.coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        stream = S.suppress_seen(spark.readStream.schema(SHOWN).json(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    say(("a", "2024-01-01"), ("b", "2024-01-02"))
    assert run() == 2
    say(("c", "2024-03-01"))
    assert run() == 1  # a and b are forgotten
    say(("a", "2024-03-02"), ("c", "2024-03-10"))
    run()
    got = sorted((r["signature"], str(r["shown_at"].date()), r["fresh"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "2024-01-01", True), ("a", "2024-03-02", True), ("b", "2024-01-02", True), ("c", "2024-03-01", True), ("c", "2024-03-10", False)]


def test_gate_stream(spark, tmp_path):
    schema = "ord bigint, source string, title string, company string, description string, days_old int"
    spark.createDataFrame([(1, "s", "Analyst", "c", "remote", 1), (2, "s", "Analyst", "c", "presencial", 1)], schema).write.json(str(tmp_path / "in"))
    got = []
    q = S.gate_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), R.default_rules(), lambda df, n: got.extend(df.select("ord", "reject_reason").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r["ord"], r["reject_reason"]) for r in got) == [(1, None), (2, "not_remote:onsite")]


def test_windows(spark, tmp_path):
    schema = "source string, shown_at timestamp"
    frame = spark.createDataFrame([("s", "2024-01-01 01:00:00"), ("s", "2024-01-01 02:00:00"), ("s", "2024-01-02 02:00:00")], "source string, t string").select("source", F.to_timestamp("t").alias("shown_at"))
    frame.write.json(str(tmp_path / "in"))
    got = drain(S.yields_per_window(spark.readStream.schema(schema).json(str(tmp_path / "in"))), tmp_path, "wins", "complete")
    assert sorted(r["yielded"] for r in got) == [1, 2]


@pytest.fixture
def show(spark, tmp_path):
    """Shows signatures in a query of its own that goes on from the checkpoint: what is fresh so far, rows of state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(*signatures, window_days, day_ms):
        spark.createDataFrame([(s,) for s in signatures], "signature string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = N.shown_before(spark.readStream.schema("signature string").json(str(tmp_path / "in")), window_days, day_ms)
        # by the clock there is always another batch, so a query has to be told to end
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(120)
        rows = spark.read.schema("signature string, fresh boolean").parquet(str(tmp_path / "out")).collect()
        return sorted((r["signature"], r["fresh"]) for r in rows), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_showing_counts_for_the_window_and_over_restarts(show):
    first, _ = show("a", "b", "a", window_days=30, day_ms=N.DAY_MS)
    assert first == [("a", False), ("a", True), ("b", True)]
    again, n = show("a", "c", window_days=30, day_ms=N.DAY_MS)
    assert again == [("a", False), ("a", False), ("a", True), ("b", True), ("c", True)] and n == 3


def test_state_goes_when_the_window_has_passed_by_the_clock(show):
    show("a", "b", window_days=2, day_ms=1000)
    time.sleep(4)
    later, n = show("a", "c", window_days=2, day_ms=1000)
    assert later == [("a", True), ("a", True), ("b", True), ("c", True)] and n == 2  # b has gone without being shown


POSTING = "ord bigint, source string, title string, company string, description string, days_old int"


@pytest.mark.parametrize("batches", [1, 4])
def test_the_gate_over_micro_batches_keeps_what_the_batch_gate_keeps(spark, tmp_path, batches):
    base = "remote work with data pipelines and reports for a team of analysts in many countries "
    texts = [base * 3, base * 3 + "x", base * 2 + "quite another text about cooking and gardens, with remote work", base * 3 + "xy z", "remote " + base, "presencial", base * 3]
    rows = [(k, "s", f"Analyst {k}", "Acme" if k % 7 else "Other", texts[k % len(texts)], 1) for k in range(14)]
    frame = spark.createDataFrame(rows, POSTING)
    today = F.lit("2024-06-30").cast("date")
    dismissed = G.with_identity(frame.where("ord = 4")).select("signature")
    want = {r["ord"]: r["reject_reason"] for r in G.gate(frame, R.default_rules(), today=today, dismissed=dismissed).collect()}
    assert "duplicate_within_run" in want.values() and None in want.values() and "dismissed_by_user" in want.values()
    place, size = tmp_path / "in", -(-len(rows) // batches)
    gate = N.StreamGate(spark, str(tmp_path / "gate"), R.default_rules(), today, dismissed=dismissed)
    for k in range(batches):
        frame.where((F.col("ord") >= k * size) & (F.col("ord") < (k + 1) * size)).coalesce(1).write.mode("append").json(str(place))
        gate.start(spark.readStream.schema(POSTING).json(str(place)), str(tmp_path / "cp")).awaitTermination(180)
    got = {r["ord"]: r["reject_reason"] for r in gate.gated().select("ord", "reject_reason").collect()}
    assert got == want and gate.gated().count() == len(rows)
    gate(frame, 0)  # a batch that comes again writes nothing
    assert gate.gated().count() == len(rows) and len(stores.committed(spark, str(tmp_path / "gate/kept"))) == batches
