"""Progress events for several readers: a bounded history that a late reader gets first, then what comes."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

from pyspark.sql.streaming import StreamingQueryListener

#: Events that are kept for readers who come late, and that a slow reader may lag behind.
KEPT = 1000


class EventBus:
    """Events in the order they were published, each with its number. Give ``publish`` to a run as a listener."""

    def __init__(self, kept: int = KEPT):
        self._events: deque[tuple[int, dict]] = deque(maxlen=kept)
        self._next, self._closed = 0, False
        self._change = threading.Condition()

    def publish(self, event: dict) -> None:
        with self._change:
            self._events.append((self._next, event))
            self._next += 1
            self._change.notify_all()

    def close(self) -> None:
        """Readers end when they have read what is there."""
        with self._change:
            self._closed = True
            self._change.notify_all()

    def read(self, after: int = -1, wait: float | None = None) -> Iterator[tuple[int, dict]]:
        """(number, event) from the first kept one after ``after``; ends when the bus is closed or nothing came for ``wait``.

        Readers do not see each other; one that lags by more than is kept goes on from the oldest event.
        """
        while True:
            with self._change:
                self._change.wait_for(lambda seen=after: self._closed or self._next > seen + 1, wait)
                here = [(n, e) for n, e in self._events if n > after]
                closed = self._closed
            yield from here
            if not here and (closed or wait is not None):
                return
            after = here[-1][0] if here else after


class StreamEvents(StreamingQueryListener):
    """Tells a bus of the streaming queries of a session. Register it with ``spark.streams.addListener``."""

    def __init__(self, bus: EventBus):
        self._bus = bus

    def onQueryStarted(self, event) -> None:
        self._bus.publish({"kind": "stream_started", "query": str(event.runId), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._bus.publish({"kind": "stream_progress", "query": str(p.runId), "name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self._bus.publish({"kind": "stream_idle", "query": str(event.runId)})

    def onQueryTerminated(self, event) -> None:
        self._bus.publish({"kind": "stream_ended", "query": str(event.runId), "error": event.exception})
