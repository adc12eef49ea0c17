"""Prefix trie of conversations: a Cartesian tree over the common prefixes of neighbours in sorted order.

Conversations become sequences of turn digests and are sorted. The common prefix of each with the one before it (LCP) makes
the trie: a node of depth d is a widest run of neighbours whose LCPs are d or more, so its ends are the nearest smaller
values on both sides. They are found in parallel: the sorted order lies in blocks; inside a block a stack closes each node
at the next smaller LCP, equal LCPs being one node, and depths that no LCP names are expanded on the way. Nodes that run over
a block's edge are left as parts. A part that was open before its block is the node that opened in the nearest block to the
left whose least LCP is smaller (the block minima), so (that block, depth) names the node; parts are then summed by name.
All measures are sums or minima over the rows of the run, so parts need no second look at the rows.

What is passed on: a row carries 16 bytes a turn until it is sorted and four bytes a turn after; a block's part of the path
is one row a depth. The driver holds two sequences and one number for each block. A block holds about ROWS conversations.
The digest of a node's member ids is one SHA-256 over all of them, which is sequential by definition: blocks deliver their
pieces joined, and the pieces of one node are streamed in order.

Defined results: rows without conv_id belong to no conversation; turns are ordered by turn (null first), role and the
text's digest, so repeated rows are turns of their own; a null role or text is an empty one; conv_id % 100 takes the sign
of conv_id, as in SQL; a conversation that is rebuilt without turns is a member of the root only; an empty table has no
root; other columns are ignored, whatever their names; texts of any length are digested whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

GROUP, HEADS = 100, 6
#: Bytes of a turn's digest, and conversations a block.
DIGEST, ROWS = 16, 20_000

SORTED = "block int, place long, conv_id long, lcp int, sizes array<int>, edge binary"
#: home and depth name a node that runs over a block's edge, up the block in which its parent opened; both null inside a block.
NODE = "home int, depth int, up int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, block int, ends string"


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): turns as array<struct<digest, size>> in order; size is the text's code points."""
    said, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, body), 256), 1, 2 * DIGEST))
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), said.alias("role"), digest.alias("digest"), F.length(body).alias("size")).alias("t"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return packed.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the first turns of the group's first conversation, then the own ones after as many."""
    at = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h"))
    heads = convs.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    taken = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    both = F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns")))
    joined = at.join(heads, "base", "left").select("conv_id", both.alias("t"))
    key = F.coalesce(F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), "")), F.lit(b""))
    return joined.select("conv_id", key.alias("key"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests begin with alike."""
    most = min(len(a), len(b)) // DIGEST
    low, high = 0, most
    while low < high:  # the longest equal prefix, by halving
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def in_blocks(convs: DataFrame, blocks: int) -> DataFrame:
    """SORTED rows: conversations in the order of their sequences, then ids. A block's first row has LCP -1; its first and last
    rows carry their sequences in `edge`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, before = TaskContext.get().partitionId(), 0, None
        held = None  # the last row goes out once it is known whether another follows
        for batch in batches:
            ids, keys, sizes = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for conv, key, size in zip(ids, keys, sizes, strict=True):
                if held:
                    rows.append(held)
                held = [block, place, conv, -1 if before is None else shared_turns(before, key), size, key if before is None else None]
                before, place = key, place + 1
            if rows:
                yield _batch(rows)
        if held:
            held[5] = before
            yield _batch([held])

    schema = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("lcp", pa.int32()), ("sizes", pa.list_(pa.int32())), ("edge", pa.binary())])

    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return convs.select("conv_id", "key", "sizes").repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, SORTED)


class Summary:
    """Of each block its cross LCP (with the block before) and its least LCP; blocks without rows are left out."""

    def __init__(self, edges: list):
        """edges: (block, first sequence, last sequence, least LCP after the first row) in the order of blocks."""
        self.blocks = [e[0] for e in edges]
        self.cross = [shared_turns(edges[k - 1][2], e[1]) if k else -1 for k, e in enumerate(edges)]
        self.least = [min(c, e[3]) if e[3] is not None else c for c, e in zip(self.cross, edges, strict=True)]

    def homes(self, at: int) -> list[int]:
        """For each depth 0..cross of block number `at` the number of the block in which the node open there began: the nearest to
        the left with a least LCP below the depth. One walk to the left serves all depths, for they only get smaller."""
        out, d, k = [0] * (self.cross[at] + 1), self.cross[at], at
        while d >= 0:
            k -= 1
            while d > self.least[k] and d >= 0:
                out[d] = self.blocks[k]
                d -= 1
        return out


class _Node:
    __slots__ = ("depth", "size", "home", "began", "low", "convs", "children", "leaves", "saved", "ends", "inner")

    def __init__(self, depth: int, size: int, home: int | None):
        self.depth, self.size, self.home, self.began = depth, size, home, home is None
        self.low, self.convs, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, []
        self.inner: list[list] = []  # children that wait for this node's least id


def nodes_of_block(rows: list[tuple], block: int, cross: int, homes: list[int], after: int) -> list[list]:
    """NODE rows of one block's (conv_id, lcp, sizes): whole nodes, and parts of those that run over an edge.

    cross: LCP of the first row with the block before, -1 for the first block; homes: where the nodes of depths 0..cross began;
    after: LCP of the next block's first row with the last row here, -1 after the last block.
    """
    out: list[list] = []
    path: list[_Node] = []

    def close(down_to: int, last: bool) -> None:
        """Ends open nodes deeper than down_to; with `last`, those up to `after` go on in the next block."""
        while len(path) > down_to + 1:
            node = path.pop()
            up = path[-1] if path else None
            whole = node.began and not (last and node.depth <= after)
            ends = ",".join(map(str, sorted(node.ends)))
            saved = node.saved + node.convs * node.size - (node.size if node.began else 0)
            row = [None if whole else block if node.began else node.home, node.depth, None, node.low, None, node.convs, node.children, node.leaves, saved, block, hashlib.sha256(ends.encode()).hexdigest() if whole else ends]
            for child in node.inner:  # its parent is this node
                if whole:
                    child[4] = node.low
                else:
                    child[2] = row[0]
            out.extend(node.inner)
            if up is None:
                out.append(row)
                continue
            up.inner.append(row)
            up.low = node.low if up.low is None else min(up.low, node.low)
            up.convs += node.convs
            up.children += node.began
            up.leaves += node.leaves
            up.saved += saved

    for k, (conv, lcp, sizes) in enumerate(rows):
        if k == 0:
            path.extend(_Node(d, sizes[d - 1] if d else 0, homes[d]) for d in range(cross + 1))
        else:
            close(lcp, False)
        for d in range(len(path), len(sizes) + 1):
            path.append(_Node(d, sizes[d - 1] if d else 0, None))
        end = path[len(sizes)]
        following = rows[k + 1][1] if k + 1 < len(rows) else after
        end.low = conv if end.low is None else min(end.low, conv)
        end.convs += 1
        end.ends.append(conv)
        end.leaves += following < len(sizes)  # the last of those that end a branch
    close(-1, True)
    return out


def parts(ordered: DataFrame, summary: Summary, tasks: int) -> DataFrame:
    """NODE rows of all blocks."""
    number = {b: i for i, b in enumerate(summary.blocks)}
    cross, n = summary.cross, len(summary.blocks)
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.string()]
    names = [c.split()[0] for c in NODE.split(", ")]

    def finished(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        at = number[block]
        made = nodes_of_block(rows, block, cross[at], summary.homes(at) if at else [], cross[at + 1] if at + 1 < n else -1)
        for i in range(0, len(made), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[i : i + 10_000], strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for block, conv, lcp, sizes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    if rows:
                        yield from finished(now, rows)
                    now, rows = block, []
                rows.append((conv, lcp, sizes))
        if rows:
            yield from finished(now, rows)

    dealt = ordered.repartitionById(tasks, F.col("block")).sortWithinPartitions("block", "place")
    return dealt.select("block", "conv_id", "lcp", "sizes").mapInArrow(run, NODE)


def digests_of_ends(pieces: DataFrame) -> DataFrame:
    """(home, depth, ends_sha256) from (home, depth, block, ends): each node's ids, block by block, hashed as they stream by.

    Ids of one node ascend over its blocks, because equal sequences are ordered by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, None, False
        for batch in batches:
            done = []
            for home, depth, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (home, depth) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state, some = (home, depth), hashlib.sha256(), False
                if ends:
                    state.update((("," if some else "") + ends).encode())
                    some = True
            yield _digests(done)
        if now:
            yield _digests([(*now, state.hexdigest())])

    def _digests(done: list[tuple]) -> pa.RecordBatch:
        home, depth, digest = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(depth, pa.int32()), pa.array(digest, pa.string())], ["home", "depth", "ends_sha256"])

    dealt = pieces.select("home", "depth", "block", "ends").repartition("home", "depth").sortWithinPartitions("home", "depth", "block")
    return dealt.mapInArrow(run, "home int, depth int, ends_sha256 string")


def trie(turns: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    convs = common.store(rebuilt(common.store(sequences(turns), "turns")), "convs")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = max(tasks, -(-convs.count() // rows))
    ordered = common.store(in_blocks(convs, blocks), "ordered")
    first, last = F.min_by("edge", "place"), F.max_by("edge", "place")
    edges = ordered.groupBy("block").agg(first.alias("first"), last.alias("last"), F.min(F.when(F.col("place") > 0, F.col("lcp"))).alias("least")).orderBy("block").collect()
    found = common.store(parts(ordered, Summary([tuple(e) for e in edges]), blocks), "nodes")
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    over = found.filter("home is not null")
    summed = over.groupBy("home", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("up").alias("up"), *[F.sum(m).alias(m) for m in measures])
    wide = common.store(summed.join(digests_of_ends(over), ["home", "depth"]), "wide")
    inner = found.filter("home is null").select("conv_id", "depth", "up", "parent_conv_id", *measures, F.col("ends").alias("ends_sha256"))
    # whole nodes below a wide one: many may hang on one parent, so its row goes to several tasks
    parents = wide.select(F.col("home").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    below = inner.filter("up is not null").drop("parent_conv_id")
    tied = common.salted_join(below, parents, ["up", "depth"], "conv_id").withColumnRenamed("parent", "parent_conv_id")
    broad = wide.join(parents, ["up", "depth"], "left").withColumnRenamed("parent", "parent_conv_id")
    columns = [F.col(c).cast("long") if c != "ends_sha256" else F.col(c) for c in ("conv_id", "depth", "parent_conv_id", *measures, "ends_sha256")]
    return inner.filter("up is null").select(columns).unionByName(tied.select(columns)).unionByName(broad.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every node."""
    return trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
o AS MATERIALIZED (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS seq FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, seq, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % {HEADS} AS h FROM o, crc),
b AS MATERIALIZED (SELECT h.conv_id, coalesce(p.seq[1:h], []) || h.seq[h + 1:] AS seq FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % {GROUP}),
k AS MATERIALIZED (SELECT conv_id, seq, list_transform(seq, lambda x: sha256(length(x.r) || ':' || x.r || x.t)) AS keys FROM b),
m AS (SELECT conv_id, d, sha256(array_to_string(keys[1:d], '')) AS id, sha256(array_to_string(keys[1:d - 1], '')) AS up, length(seq[d].t) AS size, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM k)),
n AS MATERIALIZED (SELECT d, id, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(size), 0) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, id),
c AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
a AS (SELECT a, sha256(array_to_string(keys[1:a], '')) AS id, (n_convs - 1) * size AS saved, (n_children IS NULL)::INT AS leaf
      FROM (SELECT n.*, c.n_children, keys, unnest(range(0, n.d + 1)) AS a FROM n LEFT JOIN c USING (d, id) JOIN k USING (conv_id))),
s AS (SELECT a AS d, id, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM a GROUP BY a, id)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (d, id) LEFT JOIN c USING (d, id) LEFT JOIN n p ON p.d = n.d - 1 AND p.id = n.up AND n.d > 0
"""
