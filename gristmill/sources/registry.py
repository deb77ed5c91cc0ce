"""Named sources: registered, enabled, chosen and run, each apart from the others' failures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RESULT = T.StructType(
    [T.StructField(n, t) for n, t in (("source", T.StringType()), ("status", T.StringType()), ("yielded", T.LongType()), ("duration_seconds", T.DoubleType()), ("error", T.StringType()))]
)


@dataclass
class Result:
    """How a source did: error beats ok, and ok needs at least one posting. What came before an error is kept and counted."""

    source: str
    status: str
    yielded: int
    duration_seconds: float
    error: str | None = None
    parts: int = 0


#: A source is a frame of postings, or frames one after the other.
Source = Callable[[SparkSession], DataFrame | Iterator[DataFrame]]


@dataclass
class Registry:
    sources: dict[str, Source] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, name: str, read: Source, enabled: bool = True) -> None:
        self.sources[name] = read
        (self.disabled.discard if enabled else self.disabled.add)(name)

    def _known(self, name: str) -> str:
        if name not in self.sources:
            raise KeyError(name)
        return name

    def enable(self, name: str) -> None:
        self.disabled.discard(self._known(name))

    def disable(self, name: str) -> None:
        self.disabled.add(self._known(name))

    def is_enabled(self, name: str) -> bool:
        return self._known(name) not in self.disabled

    def names(self) -> list[str]:
        return [*self.sources]

    def enabled_names(self) -> list[str]:
        return [n for n in self.sources if n not in self.disabled]

    def choose(self, mode: str = "full", wanted: list[str] | None = None, slow: frozenset[str] = frozenset()) -> list[str]:
        """Enabled sources, by name: those wanted, or all, or without the slow ones in fast mode."""
        names = set(self.enabled_names())
        if wanted:
            names &= set(wanted)
        elif mode == "fast":
            names -= slow
        return sorted(names)

    def run(self, spark: SparkSession, name: str, put: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame | None, Result]:
        """One source, written part by part by ``put``. Never raises for what the source does."""
        read = self.sources[self._known(name)]
        began = time.monotonic()
        kept: list[DataFrame] = []
        error = None
        n = 0
        try:
            found = read(spark)
            for part in [found] if isinstance(found, DataFrame) else found:
                rows = put(part, f"{name}/{len(kept):04d}")
                kept.append(rows)
                n += rows.count()
        except Exception as failure:  # a source's failure is its result
            error = str(failure)[:500]
        status = "error" if error is not None else "ok" if n else "empty"
        return (reduce(DataFrame.unionByName, kept) if kept else None), Result(name, status, n, time.monotonic() - began, error, len(kept))

    def run_enabled(self, spark: SparkSession, put: Callable[[DataFrame, str], DataFrame]) -> list[tuple[DataFrame | None, Result]]:
        return [self.run(spark, n, put) for n in sorted(self.enabled_names())]


def result_rows(spark: SparkSession, results: list[Result]) -> DataFrame:
    return spark.createDataFrame([(r.source, r.status, r.yielded, r.duration_seconds, r.error) for r in results], RESULT)
