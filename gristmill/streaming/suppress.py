"""Streams of postings (an extension: batch runs are the model here).

``suppress_seen`` is the seen-recently cache as keyed state: a signature passes when it was not shown for the window, and
every showing starts the window anew. ``gate_stream`` writes each micro-batch through the gate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators import gate as G
from gristmill.operators.rules import RuleSet

STATE = T.StructType([T.StructField("last_day", T.LongType())])


#: Ordinal of 1970-01-01, and the milliseconds of a day.
_EPOCH, _DAY = 719_163, 86_400_000


def suppress_seen(postings: DataFrame, window_days: int = G.SEEN_WINDOW_DAYS, late: str = "2 days") -> DataFrame:
    """``postings``: signature, shown_at (timestamp). Adds ``fresh``.

    State is one number per signature, and it goes when the watermark has passed the last showing by the window: from then
    on the signature is fresh whether it is remembered or not. Showings may be ``late`` by so much.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in batches:
            rows = rows.sort_values("shown_at")
            fresh = []
            for day in rows["shown_at"].map(lambda t: t.toordinal()):
                fresh.append(last is None or day - last >= window_days)
                last = day if last is None else max(last, day)
            yield rows.assign(fresh=fresh)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last - _EPOCH + window_days) * _DAY, state.getCurrentWatermarkMs() + 1))

    out = T.StructType([*postings.schema.fields, T.StructField("fresh", T.BooleanType())])
    return postings.withWatermark("shown_at", late).groupBy("signature").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def gate_stream(postings: DataFrame, rules: RuleSet, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Starts a query that gates every micro-batch (record rules only) and hands it to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(G.classify(G.with_identity(batch), rules), number)

    writer = postings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def yields_per_window(postings: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Postings per source and event-time window, with late ones up to the watermark."""
    return postings.withWatermark("shown_at", late).groupBy(F.window("shown_at", width), "source").agg(F.count("*").alias("yielded"))
