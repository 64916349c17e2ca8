"""Tables of the latest row of each key, kept in buckets of companies, of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dedup import upsert

MANIFEST = "n long, bucket int, version long"


class Snapshots:
    """Rows in folders data/v=<version>/_b=<bucket>; a manifest says which version of each bucket holds.

    A company is in one bucket, by the hash of its id. put() reads and rewrites the
    buckets of the rows it gets and writes the next manifest; until that stands, readers
    see the state before. The manifests and versions before the last two go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def _bucket(self):
        return F.pmod(F.xxhash64("company_id"), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _manifests(self) -> dict[int, dict[int, int]]:
        """Of each change that is still told, the last three or a few more, the version of each bucket that had rows: a row a bucket."""
        if not self._exists(f"{self.path}/manifest"):
            return {}
        out: dict[int, dict[int, int]] = {}
        for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect():
            out.setdefault(r["n"], {})[r["bucket"]] = r["version"]
        return out

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(number of the last change, version of each bucket that has rows)."""
        every = self._manifests()
        last = max(every, default=0)
        return last, every.get(last, {})

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/_b={b}" for b, v in sorted(held.items())])

    def read(self) -> DataFrame:
        """All rows."""
        return self._read(self.manifest()[1])

    def put(self, fresh: DataFrame, keys: list[str], version: str) -> list[int]:
        """Rows of the same keys are replaced where they are not newer (D07). Returns the buckets that were rewritten."""
        n, held = self.manifest()
        fresh = fresh.select(*self.schema.fieldNames())
        touched = sorted(r["b"] for r in fresh.select(self._bucket().alias("b")).distinct().collect())  # a row a bucket
        if not touched:
            return []
        old = self._read({b: held[b] for b in touched if b in held})
        both = upsert(old, fresh, keys, version).withColumn("_b", self._bucket())
        both.repartition("_b").write.partitionBy("_b").mode("overwrite").parquet(f"{self.path}/data/v={n + 1}")
        now = held | dict.fromkeys(touched, n + 1)
        rows = self.spark.createDataFrame([(n + 1, b, v) for b, v in sorted(now.items())], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._tidy()
        return touched

    def _tidy(self) -> None:
        """What neither the last manifest nor the one before, which readers may hold, names goes. From 16 manifests on these two become one file."""
        every = self._manifests()
        *old, before, now = [0, 0, *sorted(every)]
        used = {x for n in (before, now) for x in every.get(n, {}).items()}
        for bucket, version in {x for n in old for x in every.get(n, {}).items()} - used:
            self._delete(f"{self.path}/data/v={version}/_b={bucket}")
        if len(every) >= 16:
            rows = self.spark.createDataFrame([(n, b, v) for n in (before, now) for b, v in sorted(every[n].items())], MANIFEST)
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")


def rescored(fresh_fingerprints: DataFrame, stored: Snapshots, keys: list[str]) -> DataFrame:
    """The pairs whose fingerprint is not the stored one: what is to be scored anew."""
    return fresh_fingerprints.join(stored.read().select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti").select(*keys)
