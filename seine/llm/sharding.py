"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has a permutation of the slots of a table of prime size, given by an offset and a skip. Shards take
turns; each claims the first slot of its permutation that is free, until none is. A row's key is hashed to a slot
and the slot says the shard: one broadcast join with a table whose size is a parameter, whatever the corpus holds.
Shards differ by one slot at most per round, and when a shard leaves most slots keep their owner.

Defined results: a null key is placed like the text "null"; equal keys share a shard, so repeated rows do; `salt`
columns, if named, join the key, which is the way to spread one hot key over shards; an empty table gives no rows;
other columns are kept by ``place``; input columns named slot or shard may be keys, and give way to the result's.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.session import table

SHARDS = 64
SLOTS = 6553  # prime, over a hundred slots a shard


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str, modulus: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % modulus


def preferences(shards: list[str], slots: int) -> list[tuple[int, int]]:
    """(offset, skip) of each shard's permutation offset, offset + skip, ... modulo slots."""
    return [(_number(f"offset:{s}", slots), _number(f"skip:{s}", slots - 1) + 1) for s in shards]


def fill(shards: list[str], slots: int) -> list[int]:
    """Shard index by slot. Its cost and size depend on these two parameters alone."""
    if not _prime(slots) or slots < len(shards) or not shards:
        raise ValueError("slots must be a prime not below the number of shards, of which there must be one")
    owner, left = [-1] * slots, slots
    at = preferences(shards, slots)
    while left:
        for k, (slot, skip) in enumerate(at):
            while owner[slot] >= 0:
                slot = (slot + skip) % slots
            owner[slot] = k
            at[k] = ((slot + skip) % slots, skip)
            left -= 1
            if not left:
                break
    return owner


def place(rows: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, salt: list[str] | None = None) -> DataFrame:
    """rows with slot (int) and shard (string), in place of columns of these names."""
    owners = rows.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(fill(shards, slots))], "seine_slot int, seine_shard string")
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in [*keys, *(salt or [])]])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    placed = rows.withColumn("seine_slot", F.pmod(number, F.lit(slots)).cast("int")).join(F.broadcast(owners), "seine_slot")
    own = {"slot": F.col("seine_slot"), "shard": F.col("seine_shard")}
    kept = [own.pop(c).alias(c) if c in own else F.col(f"`{c}`") for c in rows.columns]
    return placed.select(*kept, *[v.alias(n) for n, v in own.items()])


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by its doc_id."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], names()).select("doc_id", "slot", "shard")


ORACLE_SQL = f"""
WITH RECURSIVE
pref AS MATERIALIZED (SELECT i AS k, ('0x' || substr(md5('offset:' || s), 1, 15))::BIGINT % {SLOTS} AS off, ('0x' || substr(md5('skip:' || s), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 4, '0') AS s FROM range({SHARDS}) t(i))),
lists AS MATERIALIZED (SELECT list(off ORDER BY k) AS offs, list(skip ORDER BY k) AS skips FROM pref),
turn AS (
  SELECT 0 AS step, list_transform(range({SLOTS}), lambda x: -1) AS owner, -1::BIGINT AS slot, -1::BIGINT AS k, offs, skips FROM lists
  UNION ALL
  SELECT step + 1, list_transform(owner, lambda x, i: CASE WHEN i = new + 1 THEN step % {SHARDS} ELSE x END), new, step % {SHARDS}, offs, skips
  FROM (SELECT step, owner, offs, skips, list_filter(list_transform(range({SLOTS}), lambda j: (offs[step % {SHARDS} + 1] + j * skips[step % {SHARDS} + 1]) % {SLOTS}), lambda p: owner[p + 1] = -1)[1] AS new
    FROM turn WHERE step < {SLOTS})),
o AS MATERIALIZED (SELECT slot, k FROM turn WHERE step > 0),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot::INTEGER AS slot, 'shard-' || lpad(k::VARCHAR, 4, '0') AS shard FROM d JOIN o USING (slot)
"""
