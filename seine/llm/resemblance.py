"""Near-duplicates by resemblance: five-word shingle sets of Jaccard similarity 0.8 or more, checked exactly.

Texts with the same set of shingles are one node. Candidates come from SimHash fingerprints of the sets by the generalised
pigeonhole of simhash: bits that go together are grouped into partitions, a dynamic program over estimated candidate counts
gives each partition a threshold (-1 leaves it out), and two nodes are compared if they agree in a partition but for so many
bits. At J = 0.8 a bit differs with probability 0.15, 10 of 64 on average, where no threshold on 64 bits tells pairs apart;
so fingerprints have 512 bits here, and thresholds are given such that two nodes of J = 0.8 share no probe with a probability
of LOST (2e-5) or less. Sets of up to SMALL shingles, of whose pairs up to 0.19 of the bits differ, are probed by all
partitions. Candidates whose sizes rule out 0.8 are not looked at, nor are those that differ in more bits than
J = 0.8 lets expect by over four standard deviations, of the first 64 (probability below 4e-5) or of all 512 (below 1e-5).

Candidates are not passed on as pairs but as the groups that they hang together in. A first round compares each row with
NEXT neighbours in its part of a bucket, whose rows agree in two partitions, which ties large groups together for a few
comparisons a row; a second one takes every candidate across what the first tied, buckets of one group apart, which are skipped. Each task passes on a spanning
forest. Within a group all texts are then compared with each other on their shingle sets (of 64-bit hashes), in pairs of
blocks of HELD texts, the fingerprints first; a task passes on a spanning forest of the links that hold. So every link that
joins two texts was verified, and no table has a row for each pair.

Defined results: null, empty and blank texts have the empty set and are one node; a text of up to five words is one
shingle; null ids, repeated ids and repeated rows are settled as in simhash.keep_one; texts of any length are taken
whole; other columns are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm import common, simhash
from seine.llm.components import components

WIDTH, LOST = 5, 2e-5
#: The probability that a bit differs at J = 0.8: the angle between the sets, by pi.
DIFFER = math.acos(8 / 9) / math.pi
#: Most bits that candidates differ in, of the first word and of all; of sets of up to SMALL shingles.
TAU, SMALL, TAU_SMALL = (22, 116), 10, (28, 136)
#: Neighbours in its part of a bucket that the first round compares a row with.
NEXT = 6
KEYS = ["value", "a", "b"]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(simhash.hashes(text, WIDTH))


def _node(found: np.ndarray) -> int:
    return simhash._signed(xxhash.xxh64_intdigest(found.tobytes(), 42))


def _close(words: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows i and j whose fingerprints differ in no more bits than a similarity of 0.8 lets expect."""
    small = np.minimum(size[i], size[j]) <= SMALL
    near = np.bitwise_count(words[0][i] ^ words[0][j]) <= np.where(small, TAU_SMALL[0], TAU[0])
    i, j, small = i[near], j[near], small[near]
    differ = np.zeros(len(i), np.int64)
    for word in words:
        differ += np.bitwise_count(word[i] ^ word[j])
    near = differ <= np.where(small, TAU_SMALL[1], TAU[1])
    return i[near], j[near]


def _words(column: pa.ListArray) -> np.ndarray:
    """The fingerprints of rows, a word after the other."""
    return np.ascontiguousarray(column.flatten().to_numpy().view(np.uint64).reshape(-1, simhash.WORDS).T)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, size and the words of the fingerprint of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in common.slices(batches):
            node, size, words = [], [], []
            for text in batch.column(0).to_pylist():
                found = shingle_set(text)
                node.append(_node(found))
                size.append(len(found))
                words.append(simhash.wide_majority(found).view(np.int64).tolist())
            numbers = [pa.array(x, pa.int64()) for x in (node, size)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *numbers, pa.array(words, pa.list_(pa.int64()))], ["doc_id", "node", "size", "words"])

    kept = docs.select(F.col("text").alias("seine_text"), "doc_id")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, node long, size long, words array<long>")


def pigeonhole(distinct: DataFrame) -> tuple[list[list[int]], list[int]]:
    """Partitions of the fingerprints' bits and their thresholds: partitions of more bits for more texts."""
    n = distinct.count()
    some = distinct.orderBy(F.xxhash64("node"), "node").limit(simhash.SAMPLE // 2).select("words").collect()  # SAMPLE / 2 fingerprints at most
    bits = np.unpackbits(np.array([r.words for r in some], np.int64).reshape(-1, simhash.WORDS).view(np.uint8), axis=1, bitorder="little")
    return simhash.allocate_likely(n, bits, 8 + (n > 1 << 20) + (n > 1 << 22), DIFFER, LOST)


def probed(distinct: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """distinct with its keys: `bands`, the probes of the partitions, and `pairs`, of two partitions each. The empty set, which is
    one node, has none."""
    used = [k for k, t in enumerate(thresholds) if t >= 0]
    probes = [(k, sum(1 << b for b in range(len(parts[k])) if b not in hidden)) for k in used for hidden in combinations(range(len(parts[k])), thresholds[k])]
    spare = [(k, (1 << len(parts[k])) - 1) for k in range(len(parts)) if thresholds[k]]  # for small sets: exact agreement
    two = [*zip(used[::2], used[1::2], strict=False)]

    def keys(values: np.ndarray, asked: list[tuple[int, int]], start: int) -> np.ndarray:
        return np.stack([np.int64(start + at << 32) | values[k] & mask for at, (k, mask) in enumerate(asked)], 1) if asked else np.zeros((values.shape[1], 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in common.slices(batches):
            if not batch.num_rows:
                continue
            size = batch.column(batch.schema.get_field_index("size")).to_numpy()
            words = np.ascontiguousarray(_words(batch.column(batch.schema.get_field_index("words"))).T)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            values = np.stack([bits[:, part] @ (1 << np.arange(len(part))) for part in parts])
            usual, more = keys(values, probes, 0), keys(values, spare, len(probes))
            pairs = np.stack([np.int64(at << 32) | values[a] << 16 | values[b] for at, (a, b) in enumerate(two)], 1) if two else usual
            bands = [[*x, *y] if 0 < n <= SMALL else x if n else [] for n, x, y in zip(size.tolist(), usual.tolist(), more.tolist(), strict=True)]
            both = [x if n else [] for n, x in zip(size.tolist(), pairs.tolist(), strict=True)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands, kind), pa.array(both, kind)], [*batch.schema.names, "bands", "pairs"])

    none = F.array().cast("array<long>")
    return distinct.mapInArrow(run, distinct.withColumn("bands", none).withColumn("pairs", none).schema)


def sets(docs: DataFrame) -> DataFrame:
    """node and its whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                found = shingle_set(text)
                yield pa.RecordBatch.from_arrays([pa.array([_node(found)], pa.int64()), pa.array([found.view(np.int64).tolist()], pa.list_(pa.int64()))], ["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes"))


def dealt(nodes: DataFrame, keys: str, block: int, whole: bool) -> DataFrame:
    """Rows of buckets by (value, a, b), from (node, size, words, part) and their keys; what is compared travels with them.

    A bucket of over `block` rows is parted into blocks; whole: it then appears for each two of them, else its blocks are apart.
    """
    rows = nodes.select("node", "size", "words", "part", F.explode(keys).alias("value"))
    counts = nodes.select(F.explode(keys).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    large = common.store(counts.filter(F.col("n") > block).select("value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "near-buckets")
    if large.isEmpty():
        return rows.withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    member = common.salted_join(rows, large, ["value"], "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = member.withColumn("mine", F.pmod(F.xxhash64("node", "value"), F.col("blocks")).cast("int"))
    columns = ["node", "size", "words", "part", "value"]
    if not whole:
        return member.select(*columns, F.col("mine").alias("a"), F.col("mine").alias("b"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("a"), F.greatest("mine", o).alias("b")))
    return member.select(*columns, F.explode(others).alias("o")).select(*columns, "o.a", "o.b")


#: A batch of dealt rows as arrays by name.
Rows = dict[str, np.ndarray]
NUMBERS = ("node", "size", "part", *KEYS)


def _rows(batch: pa.RecordBatch) -> Rows:
    out = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in NUMBERS}
    return out | {"words": _words(batch.column("words")).T}


def _taken(rows: Rows, which: np.ndarray) -> Rows:
    return {k: v[which] for k, v in rows.items()}


def _buckets(rows: Rows) -> np.ndarray:
    """The number of each row's bucket, of rows sorted by bucket."""
    differ = np.zeros(len(rows["node"]), bool)
    for key in KEYS:
        differ[1:] |= rows[key][1:] != rows[key][:-1]
    return np.cumsum(differ)


def _of_several_parts(rows: Rows) -> Rows:
    """The rows of buckets with two or more parts."""
    bucket, part = _buckets(rows), rows["part"]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    mixed = np.minimum.reduceat(part, first) < np.maximum.reduceat(part, first)
    return _taken(rows, mixed[bucket])


def _near(rows: Rows, farthest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the candidates among rows sorted by bucket, by their distance in the order, up to the farthest."""
    bucket, words, size, part = _buckets(rows), np.ascontiguousarray(rows["words"].T), rows["size"], rows["part"]
    at, d = np.arange(len(bucket) - 1), 1
    at = at[bucket[at] == bucket[at + 1]]
    while len(at) and d <= farthest:
        at = at[size[at] * 5 >= size[at + d] * 4]  # sizes grow within a bucket: what is too far stays so
        apart = at[part[at] != part[at + d]]
        i, j = _close(words, size, apart, apart + d)
        if len(i):
            yield i, j
        d += 1
        at = at[at + d < len(bucket)]
        at = at[bucket[at] == bucket[at + d]]


def candidates(rows: DataFrame, whole: bool) -> DataFrame:
    """(src, dst): a spanning forest, for each batch of the dealt buckets, of its candidates in different parts: of all of them,
    or of those that are near in the order of sizes."""

    def forest(rows: Rows) -> pa.RecordBatch:
        node, at = np.unique(rows["node"], return_inverse=True)  # one may stand in several buckets of a batch
        n = len(node)
        root, left, right, held = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def settled() -> tuple[np.ndarray, np.ndarray]:
            return simhash.forest(np.concatenate([*left, np.arange(n)]), np.concatenate([*right, root]), n)

        for i, j in _near(rows, len(at) if whole else NEXT) if n > 1 else ():
            left.append(at[i])
            right.append(at[j])
            held += len(i)
            if held > 1_000_000:
                hung, top = settled()
                root, left, right, held = np.arange(n), left[:1], right[:1], 0
                root[hung] = top
        hung, top = settled()
        return pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[top])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        carried: Rows | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _rows(batch)
            if carried is not None:
                now = {k: np.concatenate([carried[k], v]) for k, v in now.items()}
            bucket = _buckets(now)
            last = bucket == bucket[-1]
            carried = _taken(now, last)
            if not last.all():
                yield forest(_of_several_parts(_taken(now, ~last)))
        if carried is not None:
            yield forest(_of_several_parts(carried))

    # by size, so that neighbours can be alike, and by node, so that the forests of buckets with the same members hang on the same node
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "size", "node").mapInArrow(run, "src long, dst long").distinct()


#: Texts in a block of a group.
HELD = 256
PLACE = ["root", "a", "b"]


def _held(own: np.ndarray, other: np.ndarray) -> bool:
    """Whether two shingle sets have a similarity of 0.8 or more."""
    few, many = (own, other) if len(own) <= len(other) else (other, own)
    if not len(many):
        return True
    shared = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return shared * 9 >= (len(few) + len(many)) * 4  # Jaccard 0.8: shared / (both - shared) >= 4 / 5


def _linked(node: list[int], mine: list[int], words: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between all texts of a pair of blocks, the likelier ones first."""
    n = len(node)
    size, block = np.array([*map(len, sets)]), np.array(mine)
    i, j = np.triu_indices(n, 1)
    if n and block.min() != block.max():
        cross = block[i] != block[j]  # pairs within a block are compared where it meets itself
        i, j = i[cross], j[cross]
    fits = np.minimum(size[i], size[j]) * 5 >= np.maximum(size[i], size[j]) * 4
    i, j = _close(words, size, i[fits], j[fits])
    order = np.argsort(np.bitwise_count(words[0][i] ^ words[0][j]), kind="stable")
    root, src, dst = [*range(n)], [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        u, v = top(x), top(y)
        if u != v and _held(sets[x], sets[y]):
            root[u] = v
            src.append(node[x])
            dst.append(node[y])
    return src, dst


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, a, b, mine, node, words, hashes) in the order of (root, a, b) -> the links (src, dst) that hold."""
    common.forget()
    place, rows = None, []

    def done() -> pa.RecordBatch:
        mine, node, words, sets = zip(*rows, strict=True)
        src, dst = _linked([*node], [*mine], np.ascontiguousarray(np.array(words, np.int64).view(np.uint64).T), [*sets])
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (*PLACE, "mine", "node", "words")]
        hashes = batch.column("hashes")
        offsets, values = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
        for k, (root, a, b, *row) in enumerate(zip(*columns, strict=True)):
            if (root, a, b) != place:
                if rows:
                    yield done()
                place, rows = (root, a, b), []
            rows.append((*row, values[offsets[k] : offsets[k + 1]].copy()))
    if rows:
        yield done()


def verified(docs: DataFrame, distinct: DataFrame, grouped: DataFrame) -> DataFrame:
    """(src, dst): links of a similarity of 0.8 or more that connect, in each group (node, root), what its links connect.

    A group's texts are dealt into blocks of about HELD; each two blocks meet in a task, with the texts' sets.
    """
    blocks = grouped.groupBy("root").agg(F.ceil(F.count("*") / HELD).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")
    member = common.salted_join(grouped, blocks, ["root"], "node").select("root", "node", "blocks", mine)
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("a"), F.greatest("mine", o).alias("b")))
    placed = common.store(member.select("root", "node", "mine", F.explode(others).alias("o")).select("root", "node", "mine", "o.a", "o.b"), "near-places")
    # stored, so that its size is known: few ids go to where the documents are
    ids = common.store(distinct.join(grouped, "node", "left_semi").select(F.col("least").alias("seine_id")).distinct(), "near-ids")
    held = sets(docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("seine_id")), "left_semi")).join(distinct.select("node", "words"), "node")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = placed.join(held, "node").repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
    return moved.select(*PLACE, "mine", "node", "words", "hashes").mapInArrow(_verify, "src long, dst long")


def cluster(docs: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """doc_id, node, root and component: component is the least doc_id among all that links reach, root their least node."""
    prints = common.store(sketches(docs), "near")
    distinct = common.store(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("words").alias("words")), "near-distinct")
    keyed = common.store(probed(distinct, *pigeonhole(distinct)), "near-keys")

    near = common.store(candidates(dealt(keyed.withColumn("part", F.col("node")), "pairs", block, False), False), "near-neighbours")
    parted = keyed.join(components(near).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    far = common.store(candidates(dealt(common.store(parted.drop("pairs"), "near-parted"), "bands", block, True), True), "near-across")
    grouped = common.store(components(near.unionByName(far)), "near-groups")
    joined = components(common.store(verified(docs, distinct, grouped), "near-links"))
    of = simhash.named_by_least(distinct, joined, "node")
    return prints.select("doc_id", "node").join(of, "node").select("doc_id", "node", "root", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: the one with the least doc_id.

    Ids that several such rows share (repeated rows, null ids) are settled by nodes: each component keeps one.
    """
    found = common.store(cluster(docs), "near-components")
    head, of, root, component = (common.unused(docs, n) for n in ("head", "of", "root", "component"))
    heads = common.store(found.filter(F.col("doc_id").eqNullSafe(F.col("component"))).groupBy(F.col("doc_id").alias(head)).agg(F.count("*").alias("n")), "near-heads")
    single, several = (heads.filter(n).select(head) for n in ("n = 1", "n > 1"))
    kept = docs.join(single, F.col("doc_id").eqNullSafe(F.col(head)), "left_semi")
    if several.isEmpty():
        return kept
    again = docs.join(several, F.col("doc_id").eqNullSafe(F.col(head)), "left_semi")
    node = common.unused(docs, "node")
    root_of = found.select(F.col("node").alias(of), F.col("root").alias(root), F.col("component").alias(component)).distinct()
    settled = nodes(again, node).join(root_of, F.col(node) == F.col(of))
    settled = settled.filter(F.col("doc_id").eqNullSafe(F.col(component))).dropDuplicates([root]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(settled)


def nodes(docs: DataFrame, name: str) -> DataFrame:
    """docs and each row's node under a new name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [_node(shingle_set(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema)
