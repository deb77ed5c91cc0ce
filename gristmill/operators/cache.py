"""The signature cache on disk: a base and the deltas of the runs since, so a run writes what it has shown and no more.

A delta has the merged rows of the signatures a run has shown, under a version of its own; of the rows of a signature the
one with the highest version counts. It is appended once, under the name of the run, so a run that goes on does not write it
again. When ``every`` deltas have gathered they are folded into a new base; the old one counts until a document names the
new one, and readers that began with it still find its files until the next fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import schemas
from gristmill.operators import stores

#: Deltas that are read beside the base, at most.
EVERY = 8
_NAMES = schemas.CACHE.names
_VERSIONED = T.StructType([*schemas.CACHE.fields, T.StructField("version", T.LongType())])


@dataclass
class SignatureCache:
    spark: SparkSession
    root: str
    every: int = EVERY

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _base(self) -> tuple[str | None, int]:
        """The base that counts and the version it reaches."""
        place, fs = stores.file_system(self.spark, self._path("current"))
        if not fs.exists(place):
            return None, 0
        r = self.spark.read.schema("path string, version bigint").json(self._path("current")).first()
        return r["path"], r["version"]

    def _deltas(self, after: int) -> list[str]:
        return sorted(c for c in stores.committed(self.spark, self._path("deltas")) if int(c[:12]) > after)

    def _rows(self) -> DataFrame:
        """Base and deltas, each row with its version."""
        base, after = self._base()
        rows = self.spark.createDataFrame([], _VERSIONED)
        if base:
            rows = rows.unionByName(self.spark.read.schema(_VERSIONED).parquet(self._path(base)))
        if deltas := self._deltas(after):
            rows = rows.unionByName(self.spark.read.schema(_VERSIONED).parquet(*(self._path(f"deltas/commit={d}") for d in deltas)))
        return rows

    def exists(self) -> bool:
        base, after = self._base()
        return base is not None or bool(self._deltas(after))

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The cache, one row per signature; ``of`` (signature): only those, which is asked before anything is grouped."""
        rows = self._rows()
        if of is not None:
            rows = rows.join(of.select("signature").distinct(), "signature", "left_semi")
        rest = [c for c in _NAMES if c != "signature"]
        newest = rows.groupBy("signature").agg(F.max_by(F.struct(*rest), "version").alias("r"))
        return newest.select("signature", *[F.col(f"r.{c}").alias(c) for c in rest])

    def last_seen(self) -> DataFrame:
        """(signature, last_seen): a partial maximum per file, without what else is known."""
        return self._rows().groupBy("signature").agg(F.max("last_seen").alias("last_seen"))

    def update(self, shown: DataFrame, today: Column, run: str) -> None:
        """Takes in what a run has shown (signature, ord, final_score, title, company, source)."""
        _, after = self._base()
        known = stores.committed(self.spark, self._path("deltas"))
        if any(c.partition("-")[2] == run for c in known):
            return
        version = max([after, *(int(c[:12]) for c in known)]) + 1
        delta = stores.merge_cache(self.read(shown), shown, today).select(*_NAMES).withColumn("version", F.lit(version).cast("bigint"))
        stores.append_once(delta, self._path("deltas"), f"{version:012d}-{run}")
        if len(self._deltas(after)) >= self.every:
            self.fold()

    def fold(self) -> None:
        """Base and deltas as a new base."""
        old, after = self._base()
        deltas = self._deltas(after)
        if not deltas:
            return
        version = int(deltas[-1][:12])
        name = f"base-{version:012d}"
        self.read().withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(self._path(name))
        stores.write_document(self.spark.createDataFrame([(name, version)], "path string, version bigint"), self._path("current"))
        top, fs = stores.file_system(self.spark, self._path(""))
        # what the last fold has left for readers goes now
        for entry in fs.listStatus(top):
            gone = str(entry.getPath().getName())
            if gone.startswith("base-") and gone not in (name, old):
                fs.delete(entry.getPath(), True)
