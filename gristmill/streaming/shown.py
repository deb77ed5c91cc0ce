"""Streams of postings whose state lives by the day of processing, and the whole gate over micro-batches (extensions).

:func:`shown_before` keeps the last day a signature was shown, by the clock of whoever processes it. Every showing starts
the window anew, a row may be as late as it likes, and a signature that is not shown for the window leaves the state.

:class:`StreamGate` puts each micro-batch through the gate against what earlier ones have kept, so postings that arrive in
one batch or in many end alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gristmill.functions import text as X
from gristmill.operators import fuzzy, stores
from gristmill.operators import gate as G
from gristmill.operators.rules import RuleSet

DAY_MS = 86_400_000
#: The state store that state with an expiry needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastShown(StatefulProcessor):
    def __init__(self, window_days: int, day_ms: int):
        self.window, self.day_ms = window_days, day_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # kept for as long as it can still count; an update starts that time anew
        self.last = handle.getValueState("last_day", "day bigint", ttlDurationMs=self.window * self.day_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        today = timerValues.getCurrentProcessingTimeInMs() // self.day_ms
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            fresh = [False] * len(part)
            if len(part):
                fresh[0] = last is None or today - last >= self.window  # rows of one batch are shown together
                last = today
            yield part.assign(fresh=fresh)
        self.last.update((today,))

    def close(self) -> None:
        pass


def shown_before(postings: DataFrame, window_days: int = G.SEEN_WINDOW_DAYS, day_ms: int = DAY_MS) -> DataFrame:
    """``postings`` (signature, ...) with ``fresh``: not shown in the last ``window_days`` days of processing.

    Of rows with one signature in a micro-batch one is fresh. The session keeps state in RocksDB, which expiry needs. State
    that lives by the clock may change in any batch, so with ``availableNow`` a query never ends: give it an interval.
    """
    postings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = T.StructType([*postings.schema.fields, T.StructField("fresh", T.BooleanType())])
    return postings.groupBy("signature").transformWithStateInPandas(_LastShown(window_days, day_ms), out, "append", "ProcessingTime")


@dataclass
class StreamGate:
    """The gate over micro-batches in the order of ``ord``.

    What a batch kept is appended once, under the number of the batch, so a batch that runs again after a crash finds its
    own rows set aside and writes the same. A new posting is compared with what its own company has kept, which is what
    the batch gate compares it with.
    """

    spark: SparkSession
    root: str
    rules: RuleSet
    today: Column
    cache: DataFrame | None = None
    dismissed: DataFrame | None = None
    max_days_old: int = G.MAX_DAYS_OLD

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _kept_before(self, number: int) -> DataFrame:
        rows = stores.read_appends(self.spark, self._path("kept"), "batch bigint, ord bigint, company string, description string")
        return rows.where(F.col("batch") < number).drop("batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        if f"{number:012d}" in stores.committed(self.spark, self._path("kept")):
            return
        # the rules first; ord tells postings apart
        judged = G.gate(batch, self.rules, today=self.today, dedup=False, max_days_old=self.max_days_old)
        open_ = judged.where("reject_reason IS NULL").select(F.col("ord").cast("bigint").alias("ord"), "company", "description")
        met = open_.select(X.normalize(F.col("company")).alias("_block")).distinct()
        earlier = self._kept_before(number).withColumn("_block", X.normalize(F.col("company"))).join(met, "_block", "left_semi").drop("_block")
        gone = fuzzy.duplicates(earlier.unionByName(open_)).withColumnRenamed("ord", "_ord").withColumn("_dup", F.lit(True))
        told = judged.join(gone, judged["ord"] == gone["_ord"], "left")
        told = told.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & F.coalesce("_dup", F.lit(False)), "duplicate_within_run").otherwise(F.col("reject_reason"))).drop("_ord", "_dup")
        # a posting that the cache or the user rejects still stands for its copies, as in the batch gate
        stands = told.where("reject_reason IS NULL").select(F.lit(number).cast("bigint").alias("batch"), F.col("ord").cast("bigint").alias("ord"), "company", "description")
        if self.cache is not None:
            told = G._mark(told, G.recently_seen(self.cache, self.today), "cached_recently")
        if self.dismissed is not None:
            told = G._mark(told, self.dismissed, "dismissed_by_user")
        stores.append_once(told, self._path("gated"), f"{number:012d}")
        stores.append_once(stands, self._path("kept"), f"{number:012d}")

    def gated(self) -> DataFrame:
        """All postings so far with their reject_reason."""
        return self.spark.read.option("basePath", self._path("gated")).parquet(self._path("gated") + "/commit=*").drop("commit")

    def start(self, postings: DataFrame, checkpoint: str, trigger: dict | None = None):
        writer = postings.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
