"""Records that are kept: dealt into buckets by their keys, of which a change rewrites only those it touches."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, parts array<struct<bucket: int, folder: string>>"


class Store:
    """Records of one schema by a key, in a folder.

    A change reads the buckets of its keys, writes their new contents beside the old, and
    appends a line to the manifest last: readers see all of it or nothing, and a writer that
    fails leaves what was there.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The latest version, and the folder of each bucket that has records; (0, {}) before the first change."""
        try:
            self.spark.read.text(f"{self.path}/manifest").schema
        except AnalysisException:  # nothing there yet
            return 0, {}
        last = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").orderBy(F.desc("version")).limit(1).collect()
        return (last[0]["version"], {p["bucket"]: p["folder"] for p in last[0]["parts"]}) if last else (0, {})

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.manifest()[1].values()))

    def _change(self, touching: DataFrame, merge) -> int:
        """Rewrite the buckets of ``touching`` (key); ``merge`` maps their present records to the new ones.  Returns how many buckets that were."""
        version, parts = self.manifest()
        touched = sorted(r["b"] for r in touching.where(F.col(self.key).isNotNull()).select(self._bucket().alias("b")).distinct().collect())  # ``buckets`` numbers at most
        folder = f"{self.path}/data/{version + 1}-{uuid.uuid4().hex[:8]}"
        if touched:
            new = merge(self._read([parts[b] for b in touched if b in parts])).select(*self.schema.names)
            new.withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
            written = {r["b"] for r in self.spark.read.parquet(folder).select(F.col("__bucket").alias("b")).distinct().collect()} if not new.isEmpty() else set()
            parts = {b: f for b, f in parts.items() if b not in touched} | {b: f"{folder}/__bucket={b}" for b in written}
            self.spark.createDataFrame([(version + 1, sorted(parts.items()))], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return len(touched)

    def upsert(self, records: DataFrame) -> int:
        """New records, and records that replace those of the same key; without a key they go, of several with one key the least by hash stays."""
        first = Window.partitionBy(self.key).orderBy(F.xxhash64(*[F.col(c) for c in self.schema.names]))
        new = records.where(F.col(self.key).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*self.schema.names)
        return self._change(new, lambda old: old.join(new, self.key, "left_anti").select(*self.schema.names).unionByName(new))

    def insert_new(self, records: DataFrame) -> int:
        """Records whose key is not there yet."""
        return self.upsert(records.join(self.read().select(self.key), self.key, "left_anti"))

    def delete(self, keys: DataFrame) -> int:
        """Records of the given keys; unknown keys do not matter."""
        return self._change(keys.select(self.key), lambda old: old.join(keys.select(self.key), self.key, "left_anti"))
