"""Batches dealt to providers in waves.

Executors ask, the driver routes: a wave is a few batches that one provider is asked about in parallel, and what came of
each is known before the next wave is dealt. So a provider that is spent for the day is not asked again, by whatever
task. Waves of a provider start with one batch and double with every wave it answers, and a provider that has not
answered yet costs one request at most to be found spent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.providers import Provider, QuotaExceeded, Router

#: What may come of asking about a batch. ``none``: every provider is spent or has failed.
ANSWERED, SPENT, FAILED, NONE = "answered", "spent", "failed", "none"
OUTCOME = "batch_id int, answer string, outcome string, provider string"


@dataclass
class Waves:
    """Which provider is asked next about which batches. No batch is asked about twice at one provider."""

    router: Router
    waiting: list[int]
    most: int = 8
    _width: dict[str, int] = field(default_factory=dict)
    _failed: dict[int, set[str]] = field(default_factory=dict)

    def next(self) -> tuple[str | None, list[int]] | None:
        """(provider, batches); without a provider for batches that none is left for; None when all are done."""
        if not self.waiting:
            return None
        chosen = {b: self.router.choose(self._failed.get(b, set())) for b in self.waiting}
        provider = chosen[self.waiting[0]]
        same = [b for b in self.waiting if chosen[b] == provider]
        return provider, same if provider is None else same[: self._width.get(provider, 1)]

    def told(self, provider: str | None, outcomes: dict[int, str]) -> None:
        """What came of a wave."""
        answered = [b for b, what in outcomes.items() if what == ANSWERED]
        done = {*answered, *(b for b, what in outcomes.items() if what == NONE)}
        self.waiting = [b for b in self.waiting if b not in done]
        if provider is None:
            return
        for b, what in outcomes.items():
            if what in (FAILED, SPENT):
                self._failed.setdefault(b, set()).add(provider)
        self.router.record(provider, len(answered), SPENT in outcomes.values())
        if len(answered) == len(outcomes):
            self._width[provider] = min(self.most, 2 * self._width.get(provider, 1))
        else:
            self._width[provider] = 1


def ask_provider(batches: DataFrame, name: str, provider: Provider) -> DataFrame:
    """(batch_id, answer, outcome, provider): one call per batch, on the executors. Write the outcome before using it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["prefilter_score", "ord"], ascending=[False, True])
        said, outcome = None, ANSWERED
        try:
            said = provider(rows[["signature", "title", "company", "description"]].to_dict("records"))
        except QuotaExceeded:
            outcome = SPENT
        except Exception:  # whatever else a provider raises is a failure for this batch
            outcome = FAILED
        return pd.DataFrame({"batch_id": [int(group["batch_id"].iloc[0])], "answer": [said], "outcome": [outcome], "provider": [name]})

    rows = batches.select("batch_id", "prefilter_score", "ord", "signature", "title", "company", "description")
    return rows.groupBy("batch_id").applyInPandas(run, OUTCOME)


def evaluate_routed(batches: DataFrame, router: Router, write: Callable[[DataFrame, int], DataFrame], first: int = 0, known: frozenset[int] = frozenset(), go_on: Callable[[int, int], None] = lambda done, all_: None, most: int = 8) -> None:
    """Asks about every batch of ``batches`` that is not ``known``, wave by wave.

    ``write`` keeps a wave (frame, number) and returns it as kept; ``go_on`` is called before each wave and may raise.
    """
    numbers = sorted(r["batch_id"] for r in batches.select("batch_id").distinct().collect())  # as many as the cap allows
    named = dict(router.providers)
    waves = Waves(router, [b for b in numbers if b not in known], most)
    k = first
    while wave := waves.next():
        go_on(len(numbers) - len(waves.waiting), len(numbers))
        provider, these = wave
        if provider is None:
            nothing = batches.sparkSession.createDataFrame([(b, None, NONE, None) for b in these], OUTCOME)
            kept = write(nothing, k)
        else:
            kept = write(ask_provider(batches.where(F.col("batch_id").isin(these)), provider, named[provider]), k)
        waves.told(provider, {r["batch_id"]: r["outcome"] for r in kept.select("batch_id", "outcome").collect()})
        k += 1
