"""A keyed table kept as versions in files.

Rows lie in buckets of their key's hash. An upsert writes new files for the buckets it touches
and then a manifest, which says for every bucket which folder holds it; that one write commits
the version. Other buckets keep their files, earlier versions stay readable, and a batch that was
committed before changes nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.frames import written
from loomspark.operators import store

_MANIFEST = "bucket int, folder string, batch string, top long, columns string"


class VersionedTable:
    """path: data/<folder>/bucket=<k> with rows, versions/v=<n> with manifests."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", order: str = "ord", buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(f"`{self.key}`"), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int) -> str:
        """rows with bucket into a new folder; a large bucket is several files."""
        folder = f"{version}-{uuid.uuid4().hex}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, version: int, entries: list[tuple]) -> int:
        """A version is there once its manifest is; a second writer of the same version fails."""
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/versions/v={version}")
        return version

    def create(self, rows: DataFrame) -> int:
        """Version 0 from rows with unique keys."""
        rows = written(self._bucketed(rows), "rows")
        found = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        top = rows.agg(F.coalesce(F.max(self.order), F.lit(-1))).first()[0]
        columns = rows.drop("bucket").schema.json()
        folder = self._write(rows, 0)
        # without rows the manifest has one line that names no bucket
        return self._commit(0, [(b, folder, "", top, columns) for b in found] or [(None, None, "", top, columns)])

    def manifests(self) -> DataFrame:
        """At most one line a bucket and version."""
        return self.spark.read.schema(f"{_MANIFEST}, v int").parquet(f"{self.path}/versions")

    def latest(self) -> int:
        return self.manifests().agg(F.max("v")).first()[0]

    def _lines(self, version: int | None) -> list:
        return self.manifests().filter(F.col("v") == (self.latest() if version is None else version)).collect()

    def _rows(self, columns: str, lines: list) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(columns))
        paths = [f"{self.path}/data/{x['folder']}/bucket={x['bucket']}" for x in lines if x["bucket"] is not None]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the latest."""
        lines = self._lines(version)
        return self._rows(lines[0]["columns"], lines)

    def upsert(self, batch: DataFrame, batch_id: str, now: Column | None = None) -> int:
        """The version after the batch, whose last row a key replaces the table's. Its rows come
        last in order, and created, if there is such a column, becomes now (the current time)."""
        done = self.manifests().filter(F.col("batch") == batch_id).agg(F.min("v")).first()[0]
        if done is not None:
            return done
        lines = self._lines(None)
        version, top, columns = lines[0]["v"] + 1, lines[0]["top"], lines[0]["columns"]
        if now is None:
            now = F.current_timestamp()
        start = self.spark.range(1).select(F.lit(top).cast("long").alias("_top"))
        fresh = store.continued(store.last_rows(batch, self.key, self.order), self.order, start, now if "created" in batch.columns else None)
        fresh = written(self._bucketed(fresh), "fresh")
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        old = self._rows(columns, [x for x in lines if x["bucket"] in touched])
        keys = fresh.select(F.col(f"`{self.key}`").alias("_key"))
        kept = self._bucketed(old.join(keys, F.col(f"`{self.key}`").eqNullSafe(F.col("_key")), "left_anti"))
        folder = self._write(kept.unionByName(fresh), version)
        top = max(top, fresh.agg(F.coalesce(F.max(self.order), F.lit(-1))).first()[0])
        entries = [(x["bucket"], x["folder"], batch_id, top, columns) for x in lines if x["bucket"] is not None and x["bucket"] not in touched]
        entries += [(b, folder, batch_id, top, columns) for b in sorted(touched)]
        return self._commit(version, entries or [(None, None, batch_id, top, columns)])
