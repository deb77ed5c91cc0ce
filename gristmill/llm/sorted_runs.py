"""Sorted runs: tables of one bucketing, each bucket one sorted file, which meet in merge joins without exchange or sort.

A run is a folder below ``root`` and, while a session uses it, an external table of the session catalog; the catalog is
only how Spark learns of buckets and order, so a run that another session wrote is registered again and read alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import settings

BUCKETS_MOST = 100_000


class SortedRuns:
    """Runs of one root. A ``with`` block takes their names out of the catalog when it ends, whatever happens inside."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), keys, schema, buckets
        self._tables: dict[str, str] = {}

    def __enter__(self) -> SortedRuns:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def settings(self):
        """What must hold while runs are planned: their buckets and order count, and nothing small is broadcast instead."""
        return settings(
            self.spark,
            {
                "spark.sql.shuffle.partitions": str(self.buckets),
                "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
                "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.sources.bucketing.maxBuckets": str(BUCKETS_MOST),
            },
        )

    def write(self, rows: DataFrame, what: str = "run") -> str:
        """A new run; an exchange on the keys inside ``rows`` deals them alike, so a task writes whole buckets."""
        name = f"{what}-{uuid.uuid4().hex}"
        table = "sorted_run_" + name.rpartition("-")[2]
        self._tables[name] = table
        rows.write.format("parquet").option("path", f"{self.root}/{name}").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(table)
        return name

    def read(self, name: str) -> DataFrame:
        if name not in self._tables:
            table, keys = "sorted_run_" + uuid.uuid4().hex, ", ".join(self.keys)
            self.spark.sql(f"CREATE TABLE {table} ({self.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def drop(self, *names: str) -> None:
        """The runs and their files."""
        for name in names:
            self._forget(name)
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for name in [*self._tables]:
            self._forget(name)

    def _forget(self, name: str) -> None:
        if table := self._tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
