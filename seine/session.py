"""Session defaults shared by tests, bench and the examples."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(app: str = "seine", cpus: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings a cluster would get from its own configuration."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that stand in where a local session names none, by application.
_stand_ins: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a local folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _stand_ins:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            _stand_ins[app] = "file://" + tempfile.mkdtemp(prefix="seine-shared-")
        named = _stand_ins[app]
    return named.rstrip("/")


#: Folders stored inside the scratch() blocks that are open, innermost last.
_open: list[list[tuple[SparkSession, str]]] = []


def stored(df, label: str):
    """df written to the folder that the driver and all executors share and read again, which cuts its lineage. The table stays
    until the scratch() block ends in which it was stored, if it was stored in one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seine-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[Callable]:
    """Deletes at its end what was stored inside it. What shall outlive it goes through the function it gives, keep(df, label),
    which stores as if outside."""
    own: list[tuple[SparkSession, str]] = []
    _open.append(own)

    def keep(df, label: str):
        _open.remove(own)
        try:
            return stored(df, label)
        finally:
            _open.append(own)

    try:
        yield keep
    finally:
        _open.remove(own)
        for spark, path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
