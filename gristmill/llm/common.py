"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings that hold while the block plans and runs its jobs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where the setting is missing in local mode, as in
    tests, a folder below the warehouse is used; a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return place.rstrip("/")


class Workspace:
    """Tables of one operator run, written to the shared folder so that a lost executor costs no recomputation.

    ``put`` writes and rereads a frame, which cuts its lineage; ``drop`` removes the tables that are no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        # results may be read as long as the driver lives; the folder goes with it
        path, fs = self._place(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _place(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        """A place of the workspace for something that is not written by ``put``."""
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, what: str = "t", batch_rows: int | None = None) -> DataFrame:
        """``batch_rows``: rows that Python gets at once while this table is made, for rows that are large."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{what}"
        with settings(self.spark, {_BATCH: str(batch_rows)} if batch_rows else {}):
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, fs = self._place(df._workspace_path)
            fs.delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once: the optimizer cannot copy it into a lambda that runs per element."""
    return F.transform(F.array(value), body)[0]


def spaced_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    parts = F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


