"""Tables in buckets of their key: a load reads and rewrites the buckets of its own keys only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.sources import statements as store

BUCKETS = 256


class BucketedTable:
    """Parquet below ``path``, partitioned by a hash of ``keys``.

    A load first writes the new content of its buckets to a staged folder and then moves it over the old one. A load that was cut off between the two is
    finished by ``recover``, which every load calls first; one that was cut off earlier has changed nothing. Loads of one table run one at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _staged(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/staged")
        return [f.getPath().toString() for f in fs.listStatus(p)] if fs.exists(p) else []

    # rows

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, df: DataFrame) -> None:
        self._with_bucket(df).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._rows().drop("_bucket")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def load(self, source: DataFrame, change) -> list[int]:
        """Replace the touched buckets by ``change(their rows, source)``; gives their numbers."""
        self.recover()
        touched = sorted(r._bucket for r in self._with_bucket(source.select(*self.keys)).select("_bucket").distinct().collect())  # at most one row per bucket
        if touched:
            old = self._rows().filter(F.col("_bucket").isin(touched)).drop("_bucket")
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            self._with_bucket(change(old, source)).repartition("_bucket").write.partitionBy("_bucket").parquet(staged)
            self._apply(staged)
        return touched

    def _apply(self, staged: str) -> None:
        new = self.spark.read.parquet(staged)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        self._delete(staged)

    def recover(self) -> None:
        """Finish a load whose staged rows are complete; drop those of one that never got so far."""
        for staged in self._staged():
            if self._exists(f"{staged}/_SUCCESS"):
                self._apply(staged)
            else:
                self._delete(staged)

    def upsert(self, source: DataFrame, order=None) -> list[int]:
        """Insert or overwrite on the key, as ``statements.upsert``."""
        return self.load(source, lambda old, new: store.upsert(old, new, self.keys, order))

    def merge_facts(self, wide: DataFrame) -> list[int]:
        """Insert missing keys and set the provided fields, as ``statements.merge_facts``."""
        return self.load(wide, lambda old, new: store.merge_facts(old, new, self.keys))
