"""Tables that are written again and again: versions in a folder, a cache of keyed values, saved cases.

A version is a folder v=N that Spark's own committer marks whole; readers take the last whole one, so a write that fails
halfway, or is still going on, is not seen, and its folder is overwritten by the next. Older versions than KEPT are deleted
after a write. One writer at a time is assumed; readers may be many.

Defined results: a store that was never written is empty; upserts keep, of each key, the newest value, of equally new ones
the greatest; rows with a null key are left out; purging counts what it drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 2
CACHE = "namespace string, key string, value string, created_at long"


class Versions:
    """A table in versions."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The whole versions there are, in order."""
        files = self._files()
        if not files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(""))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and files.exists(self._path(f"{n}/_SUCCESS")))

    def read(self, number: int | None = None) -> DataFrame:
        """The last version, or the one asked for."""
        there = self.numbers()
        if number is None and not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={there[-1] if number is None else number}")

    def write(self, rows: DataFrame) -> int:
        """Makes the rows the next version, which is seen once it is whole; its number."""
        number = (self.numbers() or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        for old in self.numbers()[:-KEPT]:
            self._files().delete(self._path(f"v={old}"), True)
        return number


class Cache:
    """Values by namespace and key that count for `ttl` seconds."""

    def __init__(self, spark: SparkSession, folder: str, ttl: int):
        self.table, self.ttl = Versions(spark, folder, CACHE), ttl

    def put(self, rows: DataFrame) -> None:
        """Upserts (namespace, key, value, created_at)."""
        every = self.table.read().unionByName(rows.select("namespace", "key", "value", F.col("created_at").cast("long"))).filter("namespace is not null and key is not null")
        newest = every.groupBy("namespace", "key").agg(F.max(F.struct("created_at", "value")).alias("r"))
        self.table.write(newest.select("namespace", "key", "r.value", "r.created_at"))

    def get(self, asked: DataFrame, now: Column | int) -> DataFrame:
        """asked (namespace, key) with `value`, null where the cache has none that still counts."""
        alive = self.table.read().filter(F.col("created_at") >= F.lit(now) - self.ttl if isinstance(now, int) else F.col("created_at") >= now - self.ttl)
        return asked.join(alive.select("namespace", "key", "value"), ["namespace", "key"], "left")

    def purge(self, now: int) -> int:
        """Drops what no longer counts; how many."""
        held = self.table.read()
        gone = held.filter((F.col("created_at") < now - self.ttl) & (F.col("created_at") > 0))
        n = gone.count()
        if n:
            self.table.write(held.filter(~((F.col("created_at") < now - self.ttl) & (F.col("created_at") > 0))))
        return n


def save_cases(cases: DataFrame, path: str, order: str) -> None:
    """Cases as lines of JSON, in order of a column; each file a part of them."""
    cases.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").json(path)


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases from lines, a list, or an object with a list `cases`; what is no object is passed over."""
    text = spark.read.text(path, wholetext=False)
    one = F.col("value")
    listed = F.coalesce(F.try_variant_get(F.try_parse_json(one), "$.cases", "array<variant>"), F.try_variant_get(F.try_parse_json(one), "$", "array<variant>"), F.array(F.try_parse_json(one)))
    each = text.select(F.explode(listed).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    return each.select(F.from_json(F.to_json("v"), schema).alias("c")).select("c.*")
