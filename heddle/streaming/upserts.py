"""Continuous upsert of crawled pages into the store, one micro-batch after the other."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.operators.crawl import upsert


class VersionedStore:
    """A store kept in buckets by url; a version names for each bucket the folder that holds its rows.

    A batch rewrites the buckets that it touches and no others. A version counts once its manifest exists, which is put in
    its place by one rename; a batch that is repeated after a failure finds it and changes nothing, so each batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def _manifest(self) -> dict[str, str]:
        """Bucket to folder of the current version."""
        versions = self._versions()
        if not versions:
            return {}
        fs, path = self._at(f"manifests/{versions[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets))

    def current(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of the current version, or of some of its buckets; None where there are none."""
        manifest = self._manifest()
        paths = [f"{self.path}/{folder}" for b, folder in manifest.items() if buckets is None or int(b) in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, df: DataFrame, version: int, buckets: list[int] | None = None) -> None:
        """Makes ``df`` the content of ``buckets`` (of all where none are named) in a new version, unless it exists."""
        if self.has(version):
            return
        data = f"data/v-{version}"
        if df.columns:
            df.withColumn("_bucket", self.bucket(F.col("url"))).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{data}")
        manifest = {b: f for b, f in self._manifest().items() if buckets is not None and int(b) not in buckets}
        manifest |= {n.split("=")[1]: f"{data}/{n}" for n in self._names(data) if n.startswith("_bucket=")}
        fs, temporary = self._at(f"manifests/.{version}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.rename(temporary, self._at(f"manifests/{version}")[1])

    def has(self, version: int) -> bool:
        return version in self._versions()


def stream_upserts(crawled: DataFrame, store: VersionedStore, initial: DataFrame, checkpoint: str, recheck_days: int = 30) -> StreamingQuery:
    """Starts a query that merges every micro-batch of ``crawled`` (url, title, content, source, crawled_at) into the store.

    Of several states of a page in one batch the newest by ``crawled_at`` is taken, with its time; ``initial`` is the store before
    the first batch. Only the buckets of the batch's urls are read and written.
    """
    if not store._versions():
        store.write(initial, 0)
    schema = initial.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if store.has(version):
            return
        known = batch.where("url IS NOT NULL")
        touched = [r[0] for r in known.select(store.bucket(F.col("url"))).distinct().collect()]  # at most one row per bucket
        if not touched:
            return
        now = batch.agg(F.max("crawled_at")).first()[0]
        held = store.current(touched)
        held = store.spark.createDataFrame([], schema) if held is None else held
        merged = upsert(held, known, F.lit(now).cast("timestamp"), recheck_days).drop("action")
        store.write(merged, version, touched)

    return crawled.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
