"""Streams that remember: a cache whose entries expire, budgets that run, an index that grows, snapshots that are compared.

Cache and budgets keep value and map state by key; the rows of a key in one micro-batch are put in the order of their time and
number. Expiry goes by the time of the events: an entry too old at an event's time is gone for that event, whenever the
watermark passes, and a timer frees its state once it has. Index and snapshots keep tables by micro-batch, in folders that
a repeated batch overwrites with the same rows, so a batch that is run again after a failure changes nothing.

Defined results: rows with a null time are left out; null keys are keys like any other; repeated rows are events of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seine.functions import names
from seine.operators.greedy import first_matches
from seine.operators.namejoin import similar_pairs
from seine.session import scratch, stored

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _long(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.LongType()) for f in fields])


def _in_order(rows: Iterator[Row], *names: str) -> list[tuple]:
    """(microseconds, number, ...) of one key's rows in one micro-batch."""
    return sorted((tuple(r[n] for n in ("seine_at", "seine_number", *names)) for r in rows), key=lambda r: r[:2])


class _Cache(StatefulProcessor):
    """State: when the entry was written and by which event."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", _long("at", "by"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        entry, out, written = self.entry.get(), [], False
        for at, number in _in_order(rows):
            hit = entry is not None and at - entry[0] <= self.ttl
            if not hit:
                entry, written = (at, number), True
            out.append(Row(number=number, hit=hit, written_by=entry[1]))
        if written:
            self.entry.update(entry)
            self.handle.registerTimer((entry[0] + self.ttl) // 1000 + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (entry := self.entry.get()) is not None and (entry[0] + self.ttl) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Budget(StatefulProcessor):
    """State: calls that were allowed, in all and by provider, and the time of the last event."""

    def __init__(self, most: int, most_of_one: int, idle: int):
        self.most, self.most_of_one, self.idle = most, most_of_one, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _long("used", "last"))
        self.of_one = handle.getMapState("used", T.StructType([T.StructField("provider", T.StringType())]), _long("used"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        used, last = self.run.get() or (0, None)
        own = {} if last is None else {k[0]: v[0] for k, v in self.of_one.iterator()}
        held, out = dict(own), []  # what the map holds, so that only what changes is written
        for at, number, provider in _in_order(rows, "seine_provider"):
            if last is not None and at - last > self.idle:
                used, own = 0, {}
            last, name = at, "" if provider is None else provider
            allowed = used < self.most and own.get(name, 0) < self.most_of_one
            if allowed:
                used, own[name] = used + 1, own.get(name, 0) + 1
            out.append(Row(number=number, allowed=allowed, left=self.most - used, left_of_one=self.most_of_one - own.get(name, 0)))
        self.run.update((used, last))
        if held.keys() - own.keys():
            self.of_one.clear()
            held = {}
        for name, n in own.items():
            if held.get(name) != n:
                self.of_one.updateValue((name,), (n,))
        self.handle.registerTimer((last + self.idle) // 1000 + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (run := self.run.get()) is not None and (run[1] + self.idle) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.run.clear()
            self.of_one.clear()
        return iter([])

    def close(self) -> None:
        pass


def _events(stream: DataFrame, keys: list[str], at: str, number: str, *others: str) -> DataFrame:
    """The stream by keys, with its time in microseconds, its number and what else the state needs."""
    stream.sparkSession.conf.set(STORE, ROCKS)
    rows = stream.filter(F.col(at).isNotNull()).withWatermark(at, "0 seconds")
    return rows.select(F.unix_micros(at).alias("seine_at"), F.col(number).cast("long").alias("seine_number"), *others, *keys, at)


def _grouped(rows: DataFrame, keys: list[str], state: StatefulProcessor, schema: str) -> DataFrame:
    """By rows, not by pandas frames: keys are many and hold few rows each, and a frame costs more than they do."""
    return rows.groupBy(*keys).transformWithState(state, schema, "Append", "EventTime")


def cache(stream: DataFrame, keys: list[str], at: str, number: str, ttl_seconds: int) -> DataFrame:
    """(number, hit, written_by) of each event: whether the cache held its key, and the event that wrote what it finds.

    A miss writes an entry, which answers for ttl_seconds; an older one is a miss and is written anew.
    """
    return _grouped(_events(stream, keys, at, number), keys, _Cache(ttl_seconds * 1_000_000), "number long, hit boolean, written_by long")


def budget(stream: DataFrame, run: list[str], provider: str, at: str, number: str, most: int, most_of_one: int, idle_seconds: int) -> DataFrame:
    """(number, allowed, left, left_of_one) of each call: whether its run may make it, by the caps on all calls and on one
    provider's, and what is left then. Only allowed calls count. A run that is idle for longer starts anew."""
    rows = _events(stream, run, at, number, F.col(provider).cast("string").alias("seine_provider"))
    return _grouped(rows, run, _Budget(most, most_of_one, idle_seconds * 1_000_000), "number long, allowed boolean, left long, left_of_one long")


# --- tables by micro-batch ---------------------------------------------------------------------------------------------

#: Places of one batch in the order of all: ids of records lie below it.
PLACES = 1 << 40


def _before(spark: SparkSession, folder: str, schema: str, n: int, only_last: bool = False) -> DataFrame:
    """What the batches before number n left."""
    if n == 0:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/batch={k}" for k in ([n - 1] if only_last else range(n))]
    return spark.read.schema(schema).parquet(*paths)


def growing_index(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, over (seq, company_name): records in the order of batches and seq, each accepted unless its name is
    similar to an accepted one's, of its own or an earlier batch. Decisions (seq, accepted, duplicate_of) go to
    {folder}/decided/batch=N, the names that were added to the index to {folder}/index/batch=N."""
    schema = "place long, seq long, clean string, short string"

    def decide(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        with scratch():
            own = stored(batch.select("seq", names.clean_name(F.col("company_name")).alias("clean"), names.acronym(F.col("company_name")).alias("short")).withColumn("place", F.col("seq") + F.lit(n * PLACES)), "arrived")
            known = _before(spark, f"{folder}/index", schema, n)
            first = own.filter("clean <> ''").groupBy("clean").agg(F.min_by(F.struct("place", "seq", "short"), "place").alias("r")).select("clean", "r.*")
            # an indexed name stands for the same name in the batch: it came first
            every = known.select("place", "clean", "short", F.lit(False).alias("fresh")).unionByName(first.join(known.select("clean"), "clean", "left_anti").select("place", "clean", "short", F.lit(True).alias("fresh")))
            met = similar_pairs(every.withColumnRenamed("place", "id"), fresh="fresh")
            ties = first_matches(met.select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))).select(F.col("seq").alias("place"), "head")
            headed = stored(every.join(ties, "place", "left").select("clean", F.coalesce("head", "place").alias("head")), "heads")
            found = own.join(headed, "clean", "left").select("seq", "clean", "short", "place", F.when(F.col("head") != F.col("place"), F.col("head") % PLACES).alias("duplicate_of"))
            found.select("seq", F.col("duplicate_of").isNull().alias("accepted"), "duplicate_of").write.mode("overwrite").parquet(f"{folder}/decided/batch={n}")
            found.filter("duplicate_of is null and clean <> ''").select("place", "seq", "clean", "short").write.mode("overwrite").parquet(f"{folder}/index/batch={n}")

    return decide


def snapshots(folder: str, key: str, kind: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a snapshot of keys; (key, status) against the one before, added, removed or kept, goes to
    {folder}/changes/batch=N, the snapshot to {folder}/snapshot/batch=N, which is whole before the next batch reads it."""
    schema = f"`{key}` {kind}"

    def compare(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.select(key).filter(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{folder}/snapshot/batch={n}")
        new = spark.read.schema(schema).parquet(f"{folder}/snapshot/batch={n}").withColumn("there", F.lit(1))
        old = _before(spark, f"{folder}/snapshot", schema, n, only_last=True).withColumn("was", F.lit(1))
        status = F.when(F.col("was").isNull(), "added").when(F.col("there").isNull(), "removed").otherwise("kept")
        old.join(new, key, "full").select(key, status.alias("status")).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    return compare


def run_in_batches(parts: list[DataFrame], folder: str, build: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Feeds a stream part by part, each as one micro-batch that starts from the last one's checkpoint. Returns the folder of the
    rows, or, with a function for each batch, the given folder."""
    spark = parts[0].sparkSession
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part={k}")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{folder}/in").select(*[F.col(f"`{c}`") for c in part.columns]))
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        (writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{folder}/rows").start()).awaitTermination()
    return folder if each else f"{folder}/rows"
