"""Helpers shared by the operators: shared-folder tables, joins with hot keys, and digests.

Defined results: store() keeps every row, null and repeated ones included, and the columns' names and types; an empty
table is stored with its schema. salted_join() gives the rows of the plain join; null keys join nothing, as there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.session import shared_folder


#: Tables stored inside the scratch() blocks that are open, innermost last.
_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what was stored inside it with keep=False. What comes out must have been stored to be kept."""
    _open.append([])
    try:
        yield
    finally:
        for df in _open.pop():
            discard(df)


def store(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage.

    A lost executor then costs a reread of files, not a recomputation of everything before. Tables stay until
    discard() or the end of the scratch() block they were stored in; a query's result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seine-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seine_path = path
    if _open and not keep:
        _open[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes what store() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_seine_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What this Python worker remembers between batches and tasks, of one operator at a time.
_worker: dict = {}


def remembered(owner, make):
    """What make() gave this worker for `owner`. Workers serve one operator after another: the next one's memory takes the place
    of the last one's, so that they do not add up."""
    if owner not in _worker:
        _worker.clear()
        _worker[owner] = make()
    return _worker[owner]


def slices(batches: Iterator, rows: int = 1_000) -> Iterator:
    """Arrow batches in pieces of at most `rows` rows, so that what a step makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def forget() -> None:
    """Frees what this worker remembers; for steps that remember nothing themselves and need the room."""
    _worker.clear()


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """many join few on columns that may have hot keys in `many`: its rows are dealt to `salts` tasks a key by the column
    `spread`, and each row of `few`, which has one row a key, goes to all of them."""
    dealt = many.withColumn("seine_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = few.withColumn("seine_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "seine_salt"], how).drop("seine_salt")


def least_by_hash(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """About the `most` rows of least hash, never more: the same ones however df is dealt.

    Rows are let through by a bound on the hash that their number gives, so what a last sort meets is little over `most`.
    """
    n, of = df.count(), F.xxhash64(*columns)
    if n > most:
        whole = 2**64 - 1
        df = df.filter(of <= -(2**63) + min(whole, whole * (11 * most + 10_000) // (10 * n)))
    return df.orderBy(of, *columns).limit(most)


def sha256_of(column: Column) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def once(column: Column, use) -> Column:
    """use(x) with x bound to the value of `column`, so that lambdas inside `use` don't evaluate it again each time."""
    return F.get(F.transform(F.array(column), use), F.lit(0))


def fenced(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that later filters and projections can only refer to, not repeat: a generator's output."""
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = f"seine_{name}"
    while out.lower() in taken:
        out += "_"
    return out
