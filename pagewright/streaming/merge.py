"""A table that a stream merges into: versioned folders, and a manifest that is replaced last.

Keys are dealt to ``buckets`` folders by hash. A micro-batch rewrites only the buckets that its keys fall into, under a
new name, and then replaces the manifest, which says for each bucket the folder in force and for each stream
the last micro-batch that it holds. Until then readers see what was before; a micro-batch that is replayed after
the manifest was replaced changes nothing, and what one that died before has written is never read and goes with
``vacuum``. One writer at a time: a stream's own micro-batches are in order.

The manifest has one entry for each bucket, whatever the number of keys; it is read and written on the driver through
Hadoop's file system, so that the table may lie wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MergedTable:
    """Of each key the row with the greatest ``version``; of equal versions the one that came first."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str, buckets: int = 64):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path, key, version, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def manifest(self) -> dict:
        at = self._at(f"{self.path}/manifest.json")
        if not self._fs.exists(at):
            return {"buckets": {}, "batches": {}}
        lines = self.spark.read.text(f"{self.path}/manifest.json").collect()
        return json.loads("".join(r.value for r in lines))

    def _replace(self, manifest: dict) -> None:
        temporary = self._at(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._at(f"{self.path}/manifest.json"), option)

    def _read(self, spark: SparkSession, buckets: dict[str, str]) -> DataFrame:
        if not buckets:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}/_bucket={b}" for b, folder in sorted(buckets.items())])

    def read(self) -> DataFrame:
        return self._read(self.spark, self.manifest()["buckets"])

    def merge(self, rows: DataFrame, batch_id: int, stream: str = "stream") -> bool:
        """Merge a micro-batch; False if the table holds it already. Keys may repeat in ``rows``; null keys are one key's."""
        manifest = self.manifest()
        if manifest["batches"].get(stream, -1) >= batch_id:
            return False
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rest = [n for n in names if n != self.key]
        latest = lambda df: df.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.version, "_old")).alias("_r")).select(self.key, "_r.*").select(*names)
        new = latest(rows.select(*names).withColumn("_old", F.lit(0))).persist()
        try:
            touched = {str(r.b) for r in new.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
            if touched:
                old = self._read(rows.sparkSession, {b: f for b, f in manifest["buckets"].items() if b in touched})
                merged = latest(old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0))))
                folder = f"data-{uuid.uuid4().hex}"
                merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                manifest["buckets"] |= dict.fromkeys(touched, folder)
        finally:
            new.unpersist()
        manifest["batches"][stream] = batch_id
        self._replace(manifest)
        return True

    def vacuum(self) -> int:
        """Delete the folders that no bucket is in force in; a reader that began before may lose its files."""
        live, gone = set(self.manifest()["buckets"].values()), 0
        for status in self._fs.listStatus(self._at(self.path)):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in live:
                gone += self._fs.delete(status.getPath(), True)
        return gone


def drain(rows: DataFrame, table: MergedTable, checkpoint: str, stream: str = "stream") -> None:
    """Run a stream into the table until its source is exhausted."""
    query = rows.writeStream.foreachBatch(lambda batch, batch_id: table.merge(batch, batch_id, stream) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
