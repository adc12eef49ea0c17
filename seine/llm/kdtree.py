"""Exact top-k by inner product: a KD-tree in every shard, searched best first.

Vectors are dealt by space into shards of bounded bytes: the top of the tree is a few median splits along the widest
coordinate, made from a bounded sample (SAMPLE_BYTES), which every vector walks down; a part that holds more than a shard,
of equal vectors say, is dealt on by hash. Each shard is cut by median splits until a leaf is small enough; every node,
inner ones included, has a tight bounding box. A shard is one row with its packed tree.

Shards answer in rounds, each of as many as all rounds before it and ROUND_BYTES of root boxes at most. The boxes go ahead of
the queries: a query travels to the trees alone whose root box may beat its k-th score so far. It searches a tree from the
root with a heap of nodes ordered by the most that a point of their boxes can score, opens the best node first, and stops
when that is below its k-th score. The k-th score is propagated: queries carry the k scores known so far. So a round adds
about k rows a query, whatever the number of shards.

Defined results: a null or empty vector, or one with a null or non-finite component, takes no part, as query or candidate;
vectors are compared with those of their own length only; candidates are all rows but those with the query's own id;
repeated candidate rows are candidates each; equal (id, vector) query rows are asked once, and different vectors of one
query id share its k places; ties go to the smaller vec_id; fewer candidates than k give fewer rows; a null id takes no
part; an empty table gives no rows. Scores are sums of doubles: exact for integers while they stay below 2 ** 53, and
a sum without a value (infinity less infinity) counts as the least. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

SHARD_BYTES = 16_000_000
LEAF_ROWS = 128
#: Copies of a shard in a round; queries are dealt among them, so one tree is no single task's work.
COPIES = 8
#: Bytes of the sample that the top splits are made of, of the root boxes of a round, and rows of the sample a part.
SAMPLE_BYTES, ROUND_BYTES, PART_ROWS = 8_000_000, 16_000_000, 16
#: Lengths of vectors that are split by space, the most frequent ones.
LENGTHS = 32
GREATEST = float(np.finfo(np.float64).max)


def floored(x: Column) -> Column:
    """The greatest integer up to x, as a double; doubles beyond 2 ** 53 are integers already."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, F.lit(GREATEST)), F.lit(-GREATEST)))


def clean(vectors: DataFrame, key: str, vector: str, scale: int | None) -> DataFrame:
    """(id, v, dim) of the vectors that take part; with `scale`, v holds floor(scale * x) of each component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if scale is not None:
        v = F.transform(v, lambda x: floored(F.lit(float(scale)) * x))
    return vectors.filter(F.coalesce(ok, F.lit(False)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim"))


# --- trees -----------------------------------------------------------------------------------------------------------


class Tree:
    """A KD-tree. The rows of node i are start[i] .. end[i] - 1; its children, if it has any, are child[i] and child[i] + 1."""

    PARTS = (("ids", np.int64), ("points", np.float64), ("start", np.int64), ("end", np.int64), ("child", np.int64), ("low", np.float64), ("high", np.float64))

    def __init__(self, dim: int, **parts: np.ndarray):
        self.dim = dim
        for name, _ in self.PARTS:
            setattr(self, name, parts[name].reshape(-1, dim) if name in ("points", "low", "high") else parts[name])
        self.most = float(np.abs(self.points).max()) if len(self.points) else 0.0

    @classmethod
    def grow(cls, ids: np.ndarray, points: np.ndarray, leaf: int) -> Tree:
        """Median splits along the widest coordinate. Equal points can't be told apart by value; they are halved as they lie."""
        order, nodes, child, low, high = np.arange(len(ids)), [(0, len(ids))], [], [], []
        for a, b in nodes:  # grows on the way
            inside = points[order[a:b]]
            low.append(inside.min(0))
            high.append(inside.max(0))
            if b - a <= leaf:
                child.append(-1)
                continue
            half, widest = (b - a) // 2, (high[-1] / 2 - low[-1] / 2).argmax()
            order[a:b] = order[a:b][np.argpartition(inside[:, widest], half)]
            child.append(len(nodes))
            nodes += [(a, a + half), (a + half, b)]
        start, end = np.array(nodes, np.int64).T
        return cls(points.shape[1], ids=ids[order], points=points[order], start=start, end=end, child=np.array(child, np.int64), low=np.stack(low), high=np.stack(high))

    def bounds(self, first: int, last: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The most that points of the nodes first .. last - 1 can score: each coordinate at its better side."""
        return self.high[first:last] @ up + self.low[first:last] @ down

    def search(self, own: int, q: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of this tree that may be among the k best, beside the k best scores known from elsewhere."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        slack = 4e-16 * self.dim * float(np.abs(q).sum()) * self.most
        wild = not slack < 1e280  # products may overflow: what has no value is no ground to leave a node out, nor a score
        kth = known.min() if len(known) >= k else -np.inf
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        heap = [(-np.inf, 0)] if wild else [(-float(self.bounds(0, 1, up, down)[0]), 0)]
        while heap:
            bound, node = heappop(heap)
            if -bound + slack < kth:
                break
            c = self.child[node]
            if c >= 0:
                for n, b in enumerate(self.bounds(c, c + 2, up, down).tolist()):
                    if wild or b + slack >= kth:
                        heappush(heap, (-np.inf if wild else -b, int(c) + n))
                continue
            a, b = self.start[node], self.end[node]
            got = self.points[a:b] @ q
            if wild:
                got = np.nan_to_num(got, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            keep = np.flatnonzero((got >= kth) & (self.ids[a:b] != own))
            if len(keep):
                found, scores = np.concatenate([found, self.ids[a:b][keep]]), np.concatenate([scores, got[keep]])
                best = np.lexsort((found, -scores))[:k]
                found, scores = found[best], scores[best]
                both = np.concatenate([known, scores])
                if len(both) >= k:
                    kth = max(kth, np.partition(both, len(both) - k)[len(both) - k])
        keep = scores >= kth
        return found[keep], scores[keep]


TREE = "dim int, shard long, " + ", ".join(f"`{n}` binary" for n, _ in Tree.PARTS)


def splits(points: np.ndarray, parts: int) -> np.ndarray:
    """The top of a tree with about `parts` leaves: rows (coordinate, value, child), a leaf's child being -1 - its number."""
    nodes, leaves = [], 0
    todo: list[tuple[np.ndarray, int]] = [(np.arange(len(points)), max(parts, 1))]
    for rows, n in todo:  # grows on the way
        inside = points[rows]
        widest = (inside.max(0) / 2 - inside.min(0) / 2).argmax() if len(rows) else 0
        value = float(np.median(inside[:, widest])) if len(rows) else 0.0
        right = inside[:, widest] > value if len(rows) else np.zeros(0, bool)
        if n < 2 or len(rows) < 2 * PART_ROWS or not right.any():
            nodes.append((0.0, 0.0, -1.0 - leaves))
            leaves += 1
            continue
        nodes.append((float(widest), value, float(len(todo))))
        todo += [(rows[~right], n - n // 2), (rows[right], n // 2)]
    return np.array(nodes)


def walk(top: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    while True:
        child = top[node, 2].astype(np.int64)
        inner = np.flatnonzero(child >= 0)
        if not len(inner):
            return -1 - child
        at = node[inner]
        node[inner] = child[inner] + (points[inner, top[at, 0].astype(np.int64)] > top[at, 1])


def shards(rows: DataFrame, per_shard: Column, leaf: int) -> DataFrame:
    """One row for each shard: dim, shard number from 0 and the packed tree."""

    def pack(pdf):
        import pandas as pd

        dim = int(pdf["dim"].iloc[0])
        tree = Tree.grow(pdf["id"].to_numpy().astype(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64), leaf)
        return pd.DataFrame({"dim": [dim], "shard": [int(pdf["shard"].iloc[0])]} | {n: [np.ascontiguousarray(getattr(tree, n)).tobytes()] for n, _ in Tree.PARTS})

    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / per_shard).cast("long").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    wide = max((r.dim for r in sizes if r.n > 1), default=0)
    tops: dict[int, np.ndarray] = {}
    if wide:
        large = rows.filter(F.col("dim").isin([r.dim for r in sizes if r.n > 1])).select("id", "v", "dim")
        some = common.least_by_hash(large, ["id", "v"], max(1, SAMPLE_BYTES // (8 * wide))).collect()
        tops = {r.dim: splits(np.array([x.v for x in some if x.dim == r.dim]).reshape(-1, r.dim), r.n) for r in sizes if r.n > 1}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out, vs = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int32), batch.column(2)
            for dim in set(dims.tolist()) & tops.keys():
                at = np.flatnonzero(dims == dim)
                out[at] = walk(tops[dim], np.stack([vs[i].values.to_numpy() for i in at.tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["id", "dim", "v", "part"])

    parted = common.store(rows.select("id", "dim", "v").mapInArrow(part, "id long, dim int, v array<double>, part int"), "kd-parts")
    counts = parted.groupBy("dim", "part").agg(F.ceil(F.count("*") / per_shard).cast("long").alias("pieces"))
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a few numbers for each part, and there are as many parts as a sample has, for LENGTHS lengths, and one for each other length
    first = counts.withColumn("first", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    dealt = common.salted_join(parted, first, ["dim", "part"], "id").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id", "v"), "pieces"))
    return dealt.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInPandas(pack, TREE)


# --- rounds ----------------------------------------------------------------------------------------------------------


def rounds(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) shard of each round: the first shard, then as many as there were before, `most` at most."""
    first, last = 0, 1
    while first < n:
        yield first, min(last, n)
        first, last = last, last + min(last, most)


def roots(some: DataFrame, first: int, last: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: shard numbers, low and high corners of their root boxes, and the greatest size of a component."""
    corner = lambda c: F.substring(c, F.lit(1), F.col("dim") * 8)
    got = some.filter((F.col("shard") >= first) & (F.col("shard") < last)).select("dim", "shard", corner(F.col("low")).alias("low"), corner(F.col("high")).alias("high")).collect()
    out = {}
    for dim in {r.dim for r in got}:
        own = [r for r in got if r.dim == dim]
        low, high = (np.stack([np.frombuffer(r[c], np.float64) for r in own]) for c in ("low", "high"))
        out[dim] = np.array([r.shard for r in own], np.int64), low, high, np.maximum(np.abs(low), np.abs(high)).max(1)
    return out


def _routed(boxes, k: int):
    """Queries (id, v, dim, known) -> themselves and a shard, for each whose root box may hold one of their k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, which = [], []
            for i, (v, dim, known) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                if dim not in boxes.value:
                    continue
                numbers, low, high, most = boxes.value[dim]
                q, scores = v.values.to_numpy(), known.values.to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                    slack = 4e-16 * dim * float(np.abs(q).sum()) * most
                    open_ = np.ones(len(numbers), bool) if len(scores) < k else ~(bound + slack < scores.min()) | ~(slack < 1e280)
                to.append(numbers[open_])
                which.append(np.full(int(open_.sum()), i))
            if to and sum(map(len, to)):
                picked = batch.take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(to))], ["id", "v", "dim", "known", "shard"])

    return run


def _answer(k: int):
    """Rows in order of (dim, shard, copy, tree first) -> (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            trees = {n: batch.column(n) for n, _ in Tree.PARTS}
            is_tree, dims, qids = batch.column("is_tree").to_pylist(), batch.column("dim"), batch.column("id")
            v, known = batch.column("v"), batch.column("known")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, packed in enumerate(is_tree):
                if packed:
                    tree = Tree(dims[i].as_py(), **{n: np.frombuffer(trees[n][i].as_buffer(), t) for n, t in Tree.PARTS})
                    continue
                own = qids[i].as_py()
                with np.errstate(over="ignore", invalid="ignore"):
                    found, scores = tree.search(own, v[i].values.to_numpy(), known[i].values.to_numpy(), k)
                out.append((np.full(len(found), own), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def meet(asked: DataFrame, some: DataFrame, first: int, last: int, k: int, copies: int) -> DataFrame:
    """The answers of the shards first .. last - 1 to all queries. asked: (id, v, dim, known)."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = [F.lit(None).cast("binary").alias(n) for n, _ in Tree.PARTS]
    boxes = asked.sparkSession.sparkContext.broadcast(roots(some, first, last))  # ROUND_BYTES at most
    sent = asked.select("id", "v", "dim", "known").mapInArrow(_routed(boxes, k), "id long, v array<double>, dim int, known array<double>, shard long")
    there = sent.select("dim", "shard", F.pmod(F.xxhash64("id", "v"), F.lit(copies)).cast("int").alias("copy"), F.lit(False).alias("is_tree"), "id", "v", "known", *nothing)
    none = F.lit(None).cast("array<double>")
    held = some.filter((F.col("shard") >= first) & (F.col("shard") < last)).select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(True).alias("is_tree"),
        F.lit(None).cast("long").alias("id"), none.alias("v"), none.alias("known"), *[n for n, _ in Tree.PARTS],
    )
    place = ["dim", "shard", "copy"]
    dealt = held.unionByName(there).repartition(parts, *place).sortWithinPartitions(*place, F.desc("is_tree"))
    return dealt.mapInArrow(_answer(k), "query_id long, vec_id long, score double")


def top_k(
    vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int | None = None,
    shard_bytes: int = SHARD_BYTES, leaf: int = LEAF_ROWS, copies: int = COPIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each row where `is_query`, a column over (id, v), holds.

    Work grows with queries x rows where boxes can't prune; a task holds one shard of `shard_bytes`, or of one leaf.
    """
    rows = clean(vectors, key, vector, scale)
    per_shard = F.greatest(F.lit(leaf).cast("double"), F.floor(F.lit(shard_bytes) / (8 * F.col("dim"))).cast("double"))
    made = common.store(shards(rows, per_shard, leaf), "kd")
    queries = common.store(rows.filter(is_query).dropDuplicates(["id", "v"]), "kd-queries")
    count, widest = made.agg(F.max("shard"), F.max("dim")).first()
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = made.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    for n, (first, last) in enumerate(rounds(0 if count is None else count + 1, max(1, ROUND_BYTES // (16 * (widest or 1))))):
        scores = best.groupBy("query_id").agg(F.collect_list("score").alias("known")).withColumnRenamed("query_id", "id")
        known = F.coalesce("known", F.array().cast("array<double>")) if n else F.array().cast("array<double>")
        asked = (queries.join(scores, "id", "left") if n else queries).select("id", "v", "dim", known.alias("known"))
        found = meet(asked, made, first, last, k, copies).unionByName(best.drop("rank"))
        best = common.store(found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k), "kd-best")
    return best.select("query_id", "rank", "vec_id", "score")


def as_long(score: Column) -> Column:
    """The score as a long; what a long cannot hold becomes the nearest long."""
    return F.when(score >= 2.0**63, F.lit(2**63 - 1)).when(score <= -(2.0**63), F.lit(-(2**63))).otherwise(score.cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vec_id divisible by 20, over floor(64 * x)."""
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20, scale=64)
    return found.select("query_id", "rank", "vec_id", as_long(F.col("score")).alias("score"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
