import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from gristmill.operators import rules as R
from gristmill.operators import stores
from gristmill.operators import providers as V
from gristmill.operators.providers import ProviderFailed, QuotaExceeded
from gristmill.plans import pipeline as P
from gristmill.plans.events import EventBus, StreamEvents
from gristmill.sources import payloads
from gristmill.sources.registry import Registry

RULES = R.RuleSet(positive_phrases=("remote",), role_weights={"data": 40}, skill_weights={"SQL": 30}, recency_bonus=((3, 10),), reject_floor=20, cap=2, excluded_title_keywords=("sales",))


def board(spark, titles, name):
    jobs = [{"id": f"{name}{i}", "title": t, "company_name": f"{name} co {i}", "description": f"remote sql {t} " * 12, "publication_date": "2024-06-29T00:00:00Z", "url": "u"} for i, t in enumerate(titles)]
    page = spark.createDataFrame([("p", json.dumps({"jobs": jobs}))], "path string, payload string")
    return payloads.finish(payloads.remotive(page), name, F.lit("2024-06-30 12:00:00").cast("timestamp"))


def registry(broken=False):
    r = Registry()
    r.register("one", lambda s: board(s, ["Data lead", "Sales data", "Data analyst", "Cook"], "one"))
    r.register("two", lambda s: board(s, ["Data engineer"], "two"))
    r.register("bad", lambda s: (_ for _ in ()).throw(RuntimeError("down")))
    return r


def start(spark, tmp_path, ts="2024-06-30 12:00:00", **kw):
    return P.Run(spark, str(tmp_path / "run"), RULES, ts, ts[:10], **kw)


def evaluator(log):
    def call(batch):
        with open(log, "a") as f:
            f.write(f"{len(batch)} ")
        return json.dumps([{"id": r["signature"], "score": 85 if "lead" in r["title"] else 60} for r in batch])

    return call


def test_two_runs(spark, tmp_path):
    log = str(tmp_path / "calls")
    out = P.run(start(spark, tmp_path), registry(), evaluator(log))
    ranked = out["ranked"].orderBy(F.desc("final_score"), "part", "ord").collect()
    assert [(r["title"], r["final_score"], r["is_new"], r["ai_evaluated"]) for r in ranked] == [("Data lead", 85, True, True), ("Data engineer", 80, True, False), ("Data analyst", 60, True, True), ("Cook", 40, True, False)] or len(ranked) == 4
    assert {r["title"] for r in ranked} == {"Data lead", "Data analyst", "Data engineer", "Cook"} and sum(r["ai_evaluated"] for r in ranked) == 2
    assert {(r["source"], r["reject_reason"], r["n"]) for r in out["funnel"].collect()} == {("one", "excluded_title_or_company", 1)}
    assert {r["source"]: r["health"] for r in out["health"].collect()} == {"one": "ok", "two": "ok", "bad": "error"}
    again = start(spark, tmp_path, "2024-07-01 12:00:00")
    out = P.run(again, registry(), evaluator(log))
    assert {r["reject_reason"] for r in out["gated"].collect()} == {"excluded_title_or_company", "cached_recently"}
    assert again.read("history").count() == 4 and again.read("inbox").count() == 4 and again.read("yields").count() == 6
    assert stores.open_entries(again.read("inbox"), again.log("tracking")).count() == 4
    assert open(log).read() == "2 "
    late = P.run(start(spark, tmp_path, "2024-07-02 12:00:00", max_days_old=0), registry(), evaluator(log))
    assert {r["reject_reason"] for r in late["gated"].collect()} == {"excluded_title_or_company", "stale"}


def test_resume_after_a_cancel_keeps_what_is_done(spark, tmp_path):
    log = str(tmp_path / "calls")
    steps = iter([False] * 6 + [True] * 50)
    with pytest.raises(P.Cancelled):
        P.run(start(spark, tmp_path, cancelled=lambda: next(steps)), registry(), evaluator(log))
    assert open(log).read() == "2 "
    seen = []
    r = registry()
    r.sources = {k: (lambda s, k=k: seen.append(k)) for k in r.sources}
    out = P.run(start(spark, tmp_path, resume=True), r, evaluator(log))
    assert out["ranked"].count() == 4 and not seen and open(log).read() == "2 "
    assert start(spark, tmp_path).read("yields").count() == 3


def test_another_kind_of_run_does_not_take_up_the_manifest(spark, tmp_path):
    steps = iter([False] * 4 + [True] * 50)
    with pytest.raises(P.Cancelled):
        P.run(start(spark, tmp_path, cancelled=lambda: next(steps)), registry(), evaluator(str(tmp_path / "c")))
    run = start(spark, tmp_path, resume=True, sources=["two"])
    assert P.run(run, registry(), evaluator(str(tmp_path / "c")))["ranked"].count() == 1


def test_no_source_gives_only_health(spark, tmp_path):
    out = P.run(start(spark, tmp_path, sources=["bad"]), registry(), evaluator(str(tmp_path / "c")))
    assert set(out) == {"health"} and out["health"].first()["health"] == "error"


def test_status_events_counts_and_results(spark, tmp_path):
    events = []

    def deaf(event):
        raise RuntimeError("listener")

    run = start(spark, tmp_path, listeners=[deaf, events.append])
    P.run(run, registry(), evaluator(str(tmp_path / "c")))
    kinds = [e["kind"] for e in events]
    assert kinds[0] == "source" and kinds[-1] == "done" and "batches" in kinds and all(e["run_ts"] == run.run_ts for e in events)
    state = spark.read.json(run.path("status")).first().asDict()
    assert state["status"] == "success" and [state[c] for c in P.COUNTS] == [5, 4, 1, 0, 2, 2, 2, 4]
    assert spark.read.json(run.path("results")).count() == 4
    assert {r["run_ts"] for r in run.read("history").selectExpr("CAST(run_ts AS STRING) AS run_ts").collect()} == {run.run_ts}


def test_a_second_run_is_refused_while_one_runs(spark, tmp_path):
    run = start(spark, tmp_path)

    def nosy(batch):
        return "[]"

    other = Registry()
    other.register("one", lambda s: P.run(start(spark, tmp_path), registry(), nosy))
    seen = []
    P.run(start(spark, tmp_path, listeners=[seen.append]), other, nosy)
    assert run.read("health").first()["health"] == "error"  # the run inside the source was refused
    P.run(run, registry(), nosy)  # and after it has ended another one may start


def test_answers_of_finished_waves_are_not_asked_for_again(spark, tmp_path, monkeypatch):
    from gristmill.operators import scoring

    monkeypatch.setattr(P, "WAVE", 1)
    monkeypatch.setattr(scoring, "with_batches", lambda rows, size=1, real=scoring.with_batches: real(rows, 1))
    log = str(tmp_path / "calls")
    steps = iter([False] * 6 + [True] * 50)  # three sources, two stages, one wave
    with pytest.raises(P.Cancelled):
        P.run(start(spark, tmp_path, cancelled=lambda: next(steps)), registry(), evaluator(log))
    assert open(log).read() == "1 "
    assert spark.read.json(start(spark, tmp_path).path("status")).first()["status"] == "paused"
    out = P.run(start(spark, tmp_path, resume=True), registry(), evaluator(log))
    assert open(log).read() == "1 1 " and out["ranked"].where("ai_evaluated").count() == 2


def test_a_discarded_run_leaves_nothing_to_take_up(spark, tmp_path):
    steps = iter([False] * 5 + [True] * 50)
    run = start(spark, tmp_path, cancelled=lambda: next(steps), discard=True)
    with pytest.raises(P.Cancelled):
        P.run(run, registry(), evaluator(str(tmp_path / "c")))
    assert not run.exists("manifest") and not run.exists("gated")


def test_a_snapshot_that_was_not_finished_is_no_cache(spark, tmp_path):
    run = start(spark, tmp_path)
    P.run(run, registry(), evaluator(str(tmp_path / "c")))
    before = P.current_cache(run).count()
    (tmp_path / "run" / "signatures" / "20990101").mkdir()
    assert P.current_cache(run).count() == before == 4


def asked(log, name, error=None):
    """A provider that notes in a file how often it is called, and behaves as it is told."""

    def call(batch):
        with open(log, "a") as f:
            f.write(name)
        if error:
            raise error("so")
        return json.dumps([{"id": r["signature"], "score": 70} for r in batch])

    return call


def many(n=12):
    r = Registry()
    r.register("one", lambda s: board(s, [f"Data {w} {w * 3}" for w in "abcdefghijkl"[:n]], "one"))
    return r


def batches_of_one(monkeypatch):
    from gristmill.operators import scoring

    monkeypatch.setattr(scoring, "with_batches", lambda rows, size=1, real=scoring.with_batches: real(rows, 1))


@pytest.fixture
def wide(monkeypatch):
    from dataclasses import replace

    monkeypatch.setitem(globals(), "RULES", replace(RULES, cap=12))
    batches_of_one(monkeypatch)


def usage_of(spark, run, day):
    rows = stores.provider_usage(run.log("usage"), F.lit(day)).collect()
    return {r["provider"]: (r["requests"], r["exhausted"]) for r in rows}


def test_a_run_routes_its_batches_and_the_next_one_knows_who_is_spent(spark, tmp_path, wide):
    log = str(tmp_path / "asked")

    def router():
        return V.Router([("a", asked(log, "a", QuotaExceeded)), ("b", asked(log, "b"))], lambda: "2024-06-30")

    run = start(spark, tmp_path)
    out = P.run(run, many(), router())
    assert out["ranked"].where("ai_evaluated").count() == 12
    assert sorted(open(log).read()) == ["a"] + ["b"] * 12
    assert usage_of(spark, run, "2024-06-30") == {"a": (0, True), "b": (12, False)}
    stores.reset(spark, run.root)  # what is spent stays spent
    again = start(spark, tmp_path, "2024-06-30 18:00:00")
    P.run(again, many(), router())
    assert open(log).read().count("a") == 1 and usage_of(spark, again, "2024-06-30") == {"a": (0, True), "b": (24, False)}
    assert usage_of(spark, again, "2024-07-01") == {}


def test_no_provider_leaves_batches_unevaluated(spark, tmp_path, wide):
    log = str(tmp_path / "asked")
    run = start(spark, tmp_path)
    out = P.run(run, many(3), V.Router([("a", asked(log, "a", ProviderFailed)), ("b", asked(log, "b", ValueError))], lambda: "d"))
    assert out["ranked"].count() == 3 and out["ranked"].where("ai_evaluated").count() == 0 and sorted(open(log).read()) == list("aaabbb")


@pytest.mark.parametrize(("where", "after"), [("yields", True), ("answers", False), ("answers", True), ("usage", False), ("inbox", True)])
def test_a_run_that_breaks_off_around_any_append_writes_each_row_once(spark, tmp_path, wide, monkeypatch, where, after):
    log, real = str(tmp_path / "asked"), stores.append_once

    def breaking(rows, path, commit):
        if path.endswith(where):
            if after:
                real(rows, path, commit)
            raise RuntimeError("killed")
        return real(rows, path, commit)

    router = lambda: V.Router([("b", asked(log, "b"))], lambda: "2024-06-30")
    with monkeypatch.context() as m:
        m.setattr(stores, "append_once", breaking)
        with pytest.raises(RuntimeError):
            P.run(start(spark, tmp_path), many(3), router())
    run = start(spark, tmp_path, resume=True)
    P.run(run, many(3), router())
    for name, n in (("yields", 1), ("history", 3), ("inbox", 3)):
        rows = run.log(name)
        assert rows.count() == n and rows.select("seq").distinct().count() == n
    assert usage_of(spark, run, "2024-06-30") == {"b": (3, False)}
    assert open(log).read().count("b") == 3  # an answer that was kept is not asked for again


def test_an_append_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "seq bigint")
    assert stores.append_once(rows(1, 2), path, "r1") and not stores.append_once(rows(1, 2), path, "r1")
    staged = tmp_path / "log" / "_staged" / "r2"
    rows(7).write.parquet(str(staged))  # a writer that died before its rename
    assert sorted(r[0] for r in stores.read_appends(spark, path, "seq bigint").collect()) == [1, 2]
    assert stores.append_once(rows(3), path, "r2") and stores.committed(spark, path) == {"r1", "r2"}
    stores.append(rows(4), path)  # beside commits
    assert sorted(r[0] for r in stores.read_appends(spark, path, "seq bigint").collect()) == [1, 2, 3, 4]
    assert stores.read_appends(spark, str(tmp_path / "none"), "seq bigint").count() == 0


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "doc")
    for word in ("one", "two"):
        stores.write_document(spark.createDataFrame([(word,)], "word string"), path)
        assert [r["word"] for r in spark.read.schema("word string").json(path).collect()] == [word]
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["doc"] and (tmp_path / "doc").is_file()
    table = str(tmp_path / "table")
    for n in (3, 2):
        stores.replace_table(spark.range(n), table)
        assert spark.read.json(table).count() == n


def test_a_cancel_ends_a_stage_that_is_under_way(spark, tmp_path):
    def slow(s):
        def sleep(parts):
            time.sleep(120)
            yield from parts

        rows = board(s, ["Data lead"], "slow")
        return rows.mapInPandas(sleep, rows.schema)

    r = Registry()
    r.register("quick", lambda s: board(s, ["Data analyst"], "quick"))
    r.register("slow", slow)
    run, bus = start(spark, tmp_path), EventBus()
    run.listeners = [bus.publish]
    ended = []

    def work():
        with pytest.raises(P.Cancelled):
            P.run(run, r, evaluator(str(tmp_path / "c")))
        ended.append(time.time())

    thread = threading.Thread(target=work)
    thread.start()
    while not any(e.get("name") == "slow" for _, e in bus.read(wait=0)):
        time.sleep(0.1)
    time.sleep(2)
    asked = time.time()
    run.cancel()
    thread.join(60)
    assert ended and ended[0] - asked < 10
    assert spark.read.json(run.path("status")).first()["status"] == "paused" and run.exists("raw/quick") and "raw/slow" not in run.done
    r.sources["slow"] = lambda s: board(s, ["Data lead"], "slow")
    assert P.run(start(spark, tmp_path, resume=True), r, evaluator(str(tmp_path / "c")))["ranked"].count() == 2


def test_a_discard_removes_what_the_run_has_made(spark, tmp_path):
    run = start(spark, tmp_path)
    run.listeners = [lambda e: run.cancel(discard=True) if e.get("name") == "prefiltered" else None]
    with pytest.raises(P.Cancelled):
        P.run(run, registry(), evaluator(str(tmp_path / "c")))
    assert not any(run.exists(n) for n in ("manifest", "raw", "gated", "prefiltered")) and run.exists("yields")
    assert P.run(start(spark, tmp_path), registry(), evaluator(str(tmp_path / "c")))["ranked"].count() == 4


def test_readers_of_events_who_come_late_get_them_in_order():
    bus = EventBus(kept=5)
    for k in range(3):
        bus.publish({"k": k})
    early = []
    thread = threading.Thread(target=lambda: early.extend(n for n, _ in bus.read()))
    thread.start()
    for k in range(3, 8):
        bus.publish({"k": k})
        time.sleep(0.02)
    bus.close()
    thread.join(10)
    assert early == [*range(8)]
    assert [(n, e["k"]) for n, e in bus.read()] == [(k, k) for k in range(3, 8)]  # the oldest are no longer kept
    assert [n for n, _ in bus.read(after=5)] == [6, 7]


def test_streams_tell_the_bus(spark, tmp_path):
    bus = EventBus()
    listener = StreamEvents(bus)
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        deadline = time.time() + 20
        while time.time() < deadline and not any(e["kind"] == "stream_ended" for _, e in bus.read(wait=0)):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    events = [e for _, e in bus.read(wait=0)]
    assert [e["kind"] for e in events][0] == "stream_started" and events[-1]["kind"] == "stream_ended"
    assert sum(e.get("rows", 0) for e in events) == 5
