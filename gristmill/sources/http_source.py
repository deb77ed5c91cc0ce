"""A Python data source that fetches board pages: one partition per request, retried with growing pauses.

    spark.dataSource.register(HttpPages)
    spark.read.format("http_pages").option("urls", json.dumps([...])).option("maxPages", 5).load()
    spark.readStream.format("http_pages").option("urls", json.dumps([...])).option("perBatch", 20).load()

As a stream it visits the addresses in their order, ``perBatch`` of them in a micro-batch, and then waits for more; its
offset is how many it has visited, so a query that starts again from its checkpoint fetches none twice, and one that is
given a longer list goes on with what is new.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RETRIES = 4
LONGEST_PAUSE = 20.0


class Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


def fetch(url: str, timeout: float, opener=urllib.request.urlopen, sleep=time.sleep) -> str | None:
    """The body; None where there is no page. Server trouble and rate limits are retried, other errors raise."""
    for attempt in range(RETRIES):
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": "gristmill"}), timeout=timeout) as response:
                return response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            if error.code != 429 and error.code < 500 or attempt == RETRIES - 1:
                raise
        except urllib.error.URLError:
            if attempt == RETRIES - 1:
                raise
        sleep(min(LONGEST_PAUSE, 2.0**attempt))
    return None


def over_http(timeout: float = 30.0, pause: float = 0.0, tasks: int = 4):
    """Fetches the pages of a frame with ``path``: the same rows with ``payload``, without what has no page."""

    def pages(asked: DataFrame) -> DataFrame:
        schema = T.StructType([*asked.schema.fields, T.StructField("payload", T.StringType())])

        def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in rows:
                bodies = []
                for url in part["path"]:
                    if pause:
                        time.sleep(random.uniform(0.8, 2.2) * pause)
                    try:
                        bodies.append(fetch(url, timeout))
                    except (urllib.error.URLError, OSError):  # a page that cannot be fetched is left out
                        bodies.append(None)
                yield part.assign(payload=bodies)[[b is not None for b in bodies]]

        return asked.repartition(tasks, "path").mapInPandas(batches, schema)

    return pages


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        urls = json.loads(options["urls"])
        self.urls = urls[: int(options["maxPages"])] if "maxPages" in options else urls
        self.timeout = float(options.get("timeout", 30))
        self.pause = float(options.get("pause", 0))

    def partitions(self):
        return [Page(u) for u in self.urls]

    def read(self, partition):
        if self.pause:
            time.sleep(random.uniform(0.8, 2.2) * self.pause)
        body = fetch(partition.url, self.timeout)
        if body is not None:
            yield partition.url, body


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self._pages = _Reader(options)
        self._per_batch = int(options.get("perBatch", 20))
        self._done = 0

    def initialOffset(self) -> dict:
        return {"visited": 0}

    def latestOffset(self) -> dict:
        # a batch ends where the last one that was planned ended, or a batch later
        return {"visited": min(len(self._pages.urls), self._done + self._per_batch)}

    def partitions(self, start: dict, end: dict):
        self._done = max(self._done, end["visited"])
        return [Page(u) for u in self._pages.urls[start["visited"] : end["visited"]]]

    def commit(self, end: dict) -> None:
        self._done = max(self._done, end["visited"])

    def read(self, partition):
        return self._pages.read(partition)


class HttpPages(DataSource):
    @classmethod
    def name(cls):
        return "http_pages"

    def schema(self):
        return "path string, payload string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
