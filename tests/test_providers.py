from gristmill.operators import providers as P
from gristmill.operators import routing as V


class Failure(Exception):
    def __init__(self, text, code=None):
        super().__init__(text)
        if code:
            self.status_code = code


def test_only_a_spent_day_spends_a_provider():
    spent = P.Adapter().spent
    assert spent(Failure("Quota: requests per day", 429)) and spent(Failure("429: daily limit reached")) and spent(Failure("Quota exceeded", 429)) and spent(Failure("10 per-day", 429))
    assert not spent(Failure("slow down", 429)) and not spent(Failure("daily limit", 500)) and not spent(Failure("quota of requests per minute", 429)) and not spent(Failure("daily", 429))
    assert not spent(Failure("429 per day", 503))


def test_retries_and_fall_back():
    calls, waits = [], []

    def flaky(rows):
        calls.append(1)
        if len(calls) < 3:
            raise Failure("overloaded", 503)
        return "[]"

    assert P.guarded(flaky, sleep=waits.append)([{}]) == "[]" and waits == [1, 2]

    def spent(rows):
        raise Failure("daily limit", 429)

    def broken(rows):
        raise Failure("no")

    router = P.Router([("a", P.guarded(spent)), ("b", P.guarded(broken)), ("c", lambda r: "ok")], lambda: "d")
    assert router([{}]) == "ok" and router.usage["a", "d"]["exhausted"] and not router.usage["b", "d"]["exhausted"]


def test_router_remembers_quota_for_the_day_and_over_runs(spark):
    def spent(_):
        raise P.QuotaExceeded

    def broken(_):
        raise P.ProviderFailed

    day = ["d1"]
    providers = P.in_order({"c": lambda rows: "[]", "b": broken, "a": spent}, ["a", "b", "zz"])
    assert [n for n, _ in providers] == ["a", "b", "c"]
    router = P.Router(providers, lambda: day[0])
    assert router([]) == "" and not router.usage
    assert router([{}]) == "[]" and router([{}]) == "[]"
    # a request counts when it is answered
    want = [("a", "d1", 0, True), ("b", "d1", 0, False), ("c", "d1", 2, False)]
    assert [tuple(r) for r in router.usage_frame(spark).collect()] == want
    again = P.Router(providers, lambda: day[0]).take_up(router.usage_frame(spark))
    assert again([{}]) == "[]" and ("a", "d1", 0, True) in [*again.usage_rows()] and ("c", "d1", 3, False) in [*again.usage_rows()]
    day[0] = "d2"
    router([{}])
    assert ("a", "d2", 0, True) in [*router.usage_rows()]
    assert P.Router([("a", spent)], lambda: "d")([{}]) == ""


def test_order_of_the_default_router(spark):
    named = {"b": lambda r: "b", "a": lambda r: "a", "c": lambda r: "c"}
    assert [n for n, _ in P.default_router(spark, named, lambda: "d").providers] == ["a", "b", "c"]
    spark.conf.set(P.ORDER_SETTING, "c, zz,a")
    try:
        assert [n for n, _ in P.default_router(spark, named, lambda: "d").providers] == ["c", "a"]
    finally:
        spark.conf.unset(P.ORDER_SETTING)


def waves(behaviour, batches=10, most=8, usage=None):
    """Plays waves: behaviour(provider, batch) is what comes of a batch."""
    router = P.Router([("a", None), ("b", None)], lambda: "d", usage or {})
    w, log = V.Waves(router, [*range(batches)], most), []
    while wave := w.next():
        provider, these = wave
        log.append((provider, these))
        w.told(provider, {b: behaviour(provider, b) if provider else V.NONE for b in these})
    return log, router


def test_waves_double_and_end():
    log, router = waves(lambda p, b: V.ANSWERED, 12)
    assert [len(t) for _, t in log] == [1, 2, 4, 5] and router.usage["a", "d"] == {"requests": 12, "exhausted": False}
    assert waves(lambda p, b: V.ANSWERED, 0)[0] == []


def test_a_spent_provider_is_asked_once_in_all():
    log, router = waves(lambda p, b: V.SPENT if p == "a" else V.ANSWERED, 9)
    assert [p for p, _ in log].count("a") == 1 and log[0] == ("a", [0])
    assert router.usage == {("a", "d"): {"requests": 0, "exhausted": True}, ("b", "d"): {"requests": 9, "exhausted": False}}
    log, _ = waves(lambda p, b: V.ANSWERED, 3, usage={("a", "d"): {"requests": 5, "exhausted": True}})
    assert {p for p, _ in log} == {"b"}


def test_a_failure_skips_a_provider_for_its_batch_only():
    log, router = waves(lambda p, b: V.FAILED if p == "a" and b == 1 else V.ANSWERED, 4)
    asked = [(p, b) for p, these in log for b in these]
    assert ("b", 1) in asked and asked.count(("a", 1)) == 1 and router.usage["b", "d"]["requests"] == 1 and router.usage["a", "d"]["requests"] == 3
    log, _ = waves(lambda p, b: V.FAILED, 3)
    assert sorted(b for p, these in log if p is None for b in these) == [0, 1, 2]
