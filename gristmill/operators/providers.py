"""Providers of evaluations: adapters that sort their errors, retries, ordered fall-back, and usage that outlives a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[list[dict]], str]
USAGE = "provider string, date string, requests bigint, exhausted boolean"


class QuotaExceeded(Exception):
    """A provider is spent for the day."""


class ProviderFailed(Exception):
    """A provider failed for this batch."""


#: What a message says of a quota that is spent for the day, fixed values. A limit per minute says none of them and is
#: tried again.
DAY_QUOTA = ("per day", "perday", "per-day", "daily limit", "daily quota", "quota exceeded")
TOO_MANY = 429


@dataclass(frozen=True)
class Told:
    """What a client's error tells: its status, if it has one, and its text."""

    status: int | None
    text: str


@dataclass(frozen=True)
class Adapter:
    """How the errors of a provider's client are read; a client of another kind brings a ``read`` of its own."""

    status_fields: tuple[str, ...] = ("status_code", "code")

    def read(self, error: Exception) -> Told:
        told = [v for f in self.status_fields if isinstance(v := getattr(error, f, None), int)]
        return Told(told[0] if told else None, str(error))

    def spent(self, error: Exception) -> bool:
        """Whether the day's quota is gone: a refusal for too many requests whose text names the day."""
        told = self.read(error)
        refused = told.status == TOO_MANY or (told.status is None and str(TOO_MANY) in told.text)
        return refused and any(hint in told.text.lower() for hint in DAY_QUOTA)


def guarded(provider: Provider, attempts: int = 3, sleep: Callable[[float], None] | None = None, adapter: Adapter = Adapter()) -> Provider:
    """A provider with retries, which raises nothing but the two errors the router knows."""

    def call(rows: list[dict]) -> str:
        last: Exception | None = None
        for attempt in range(attempts):
            if attempt and sleep:
                sleep(2.0 ** (attempt - 1))
            try:
                return provider(rows)
            except Exception as error:
                if adapter.spent(error):
                    raise QuotaExceeded from error
                last = error
        raise ProviderFailed from last

    return call


@dataclass
class Router:
    """Ordered fall-back over providers. A quota error spends a provider for the day, another skips it for this batch.

    Called on the driver it asks by itself; a run deals batches over executors by :mod:`gristmill.operators.routing`,
    which asks ``choose`` and tells ``record``. A request counts when it is answered.
    """

    providers: list[tuple[str, Provider]]
    today: Callable[[], str]
    usage: dict[tuple[str, str], dict] = field(default_factory=dict)

    def _day(self, name: str) -> dict:
        return self.usage.setdefault((name, self.today()), {"requests": 0, "exhausted": False})

    def choose(self, failed: set[str] | frozenset[str] = frozenset()) -> str | None:
        """The first provider that is not spent today and has not ``failed``."""
        return next((name for name, _ in self.providers if name not in failed and not self._day(name)["exhausted"]), None)

    def record(self, name: str, answered: int, spent: bool = False) -> None:
        day = self._day(name)
        day["requests"] += answered
        day["exhausted"] |= spent

    def __call__(self, rows: list[dict]) -> str:
        named, failed = dict(self.providers), set()
        while rows and (name := self.choose(failed)):
            failed.add(name)
            try:
                said = named[name](rows)
            except QuotaExceeded:
                self.record(name, 0, spent=True)
            except ProviderFailed:
                continue
            else:
                self.record(name, 1)
                return said
        return ""

    def usage_rows(self) -> Iterator[tuple[str, str, int, bool]]:
        for (name, day), u in sorted(self.usage.items()):
            yield name, day, u["requests"], u["exhausted"]

    def usage_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*self.usage_rows()], USAGE)

    def take_up(self, usage: DataFrame) -> Router:
        """Goes on from the usage log of earlier runs: a provider that was spent stays so for the day."""
        today = usage.where(F.col("date") == self.today()).groupBy("provider", "date").agg(F.sum("requests").alias("requests"), F.max("exhausted").alias("exhausted"))
        for r in today.collect():  # one row per provider
            self.usage[r["provider"], r["date"]] = {"requests": r["requests"], "exhausted": r["exhausted"]}
        return self


def in_order(named: dict[str, Provider], order: list[str]) -> list[tuple[str, Provider]]:
    """The providers that are there, those that ``order`` names first and in its order."""
    return [(n, named[n]) for n in (*(n for n in order if n in named), *sorted(named.keys() - {*order}))]


#: The session setting that names providers in the order they are asked, with commas between.
ORDER_SETTING = "spark.gristmill.providers"


def default_router(spark: SparkSession, named: dict[str, Provider], today: Callable[[], str]) -> Router:
    """A router over the providers that the setting names, in its order; without the setting over all, by name."""
    order = [n.strip() for n in (spark.conf.get(ORDER_SETTING, None) or "").split(",") if n.strip()]
    return Router([(n, named[n]) for n in order if n in named] if order else in_order(named, []), today)
