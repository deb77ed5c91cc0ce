import datetime as dt

from pyspark.sql import functions as F

from gristmill.operators import stores
from gristmill.operators.cache import SignatureCache

SHOWN = "signature string, ord bigint, final_score int, title string, company string, source string"


def shown(spark, *rows):
    return spark.createDataFrame([(s, k, score, f"t{s}", "c", "x") for k, (s, score) in enumerate(rows)], SHOWN)


def day(n):
    return F.lit(dt.date(2024, 6, n))


def told(cache):
    return {r["signature"]: (r["first_seen"].day, r["last_seen"].day, r["final_score"]) for r in cache.read().collect()}


def test_runs_write_what_they_have_shown_and_no_more(spark, tmp_path):
    cache = SignatureCache(spark, str(tmp_path / "s"), every=3)
    assert not cache.exists() and cache.read().count() == 0
    cache.update(shown(spark, ("a", 50), ("b", 60)), day(1), "r1")
    cache.update(shown(spark, ("b", None), ("c", 70)), day(2), "r2")
    assert told(cache) == {"a": (1, 1, 50), "b": (1, 2, 60), "c": (2, 2, 70)}
    deltas = sorted((tmp_path / "s/deltas").glob("commit=*"))
    assert [spark.read.parquet(str(d)).count() for d in deltas] == [2, 2] and not (tmp_path / "s/current").exists()
    cache.update(shown(spark, ("b", 99)), day(3), "r2")  # a run that goes on has written its delta
    assert told(cache)["b"] == (1, 2, 60)
    assert {r["signature"] for r in cache.read(shown(spark, ("b", 0), ("zz", 0))).collect()} == {"b"}


def test_folding_changes_nothing_that_readers_see(spark, tmp_path):
    cache, root = SignatureCache(spark, str(tmp_path / "s"), every=2), tmp_path / "s"
    want = {}
    for k in range(1, 8):
        names = [f"s{k}", f"s{k - 1}", "hot"]
        cache.update(shown(spark, *((n, 10 * k) for n in names)), day(k), f"r{k}")
        for n in names:
            want[n] = (want.get(n, (k,))[0], k, 10 * k)
        assert told(cache) == want
        assert {r["signature"]: r["last_seen"].day for r in cache.last_seen().collect()} == {n: v[1] for n, v in want.items()}
    assert len(list(root.glob("base-*"))) == 2 and cache._base()[1] == 6 and len(cache._deltas(6)) == 1


def test_a_fold_that_breaks_off_does_not_count(spark, tmp_path, monkeypatch):
    cache = SignatureCache(spark, str(tmp_path / "s"), every=9)
    cache.update(shown(spark, ("a", 1)), day(1), "r1")
    with monkeypatch.context() as m:
        m.setattr(stores, "write_document", lambda *a: 1 / 0)
        try:
            cache.fold()
        except ZeroDivisionError:
            pass
    assert cache._base() == (None, 0) and told(cache) == {"a": (1, 1, 1)}
    cache.fold()
    assert cache._base()[1] == 1 and told(cache) == {"a": (1, 1, 1)}
