"""SimHash near-duplicates by a generalised pigeonhole.

Fingerprints of whole texts are made distinct first, so copies cost one row. Their 64 bits are grouped by how
they go together in the corpus into partitions; a dynamic program over candidate counts, estimated from the pairs of
a bounded sample of fingerprints, gives each partition a threshold of its own (the sample decides what is cheap, never
what is found). If the thresholds t_i of m partitions sum to tau - m + 1, two fingerprints that
differ in tau bits or fewer differ in t_i bits or fewer within some partition i (a threshold of -1 leaves a
partition out), so probing the partitions loses no link. A threshold of t is probed by keys that mask t bits.

Rows that share a probe key form a bucket. Large buckets are split by a second pigeonhole: two rows that differ in tau
bits or fewer agree wholly in one of any tau + 1 disjoint sets of bits, so a bucket's rows are dealt by these. What is
then still beyond a block's size is cut into blocks, and pairs of blocks are compared, so no task holds an unbounded
group. A comparison returns the edges of a spanning forest of the links that it found, never all pairs. Components of the edges follow by alternating star
contractions.

For similarities at which a good part of the bits differs (resemblance), fingerprints of WORDS * 64 bits are grouped into
partitions in the same way, and the dynamic program gives thresholds by the probability that no partition is shared.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other; equal fingerprints
share a component; null ids take part and can be a component's id only if every member's id is null; repeated
rows each come out; columns of the input other than the named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.llm.components import components, forest
from seine.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BITS, BLOCK = 64, 2048
#: Blocks from which on a bucket is split by the second pigeonhole; fingerprints that costs are estimated from.
SPLIT, SAMPLE = 4, 4096


def hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `width` words, repeats included; of all words where there are no more."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(" ".join(words).encode(), 42)], np.uint64)
    flat = [w.encode() for w in words]
    joined = b" ".join(flat)
    ends = np.cumsum([len(w) + 1 for w in flat]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(flat) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(whole: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(whole), 65_536):
        counts += np.unpackbits(whole[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(whole), bitorder="little").view(np.uint64)[0])


#: Fixed odd numbers and shifts by which a hash gives the words of a wide fingerprint after the first, which is the hash itself.
WORDS = 8
_rng = np.random.default_rng(20)
_XOR, _ODD = (_rng.integers(0, 1 << 63, WORDS - 1, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def wide_majority(whole: np.ndarray) -> np.ndarray:
    """The fingerprint of WORDS * 64 bits of hashes, as words: majority() of the hashes, then of what each is mixed to."""
    counts = np.zeros(WORDS * BITS, np.int64)
    for at in range(0, len(whole), 4080):
        some = whole[at : at + 4080]
        mixed = (some[:, None] ^ _XOR) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        flat = np.hstack([some[:, None], mixed ^ (mixed >> np.uint64(29))])
        bits = np.unpackbits(flat.view(np.uint8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # sums of at most 255 fit a byte
            counts += bits[part : part + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(whole), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority of the bits of XXH64 (seed 42) over shingles of `width` words, repeats included; 0 without words."""
    return majority(hashes(text, width))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), width: int = 4, name: str = "fp") -> DataFrame:
    """The carried columns and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t, width)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], [*batch.schema.names[1:], name])

    kept = docs.select(F.col(text).alias("seine_text"), *carry)
    return kept.mapInArrow(run, kept.drop("seine_text").withColumn(name, F.lit(0).cast("long")).schema)


# --- partitions and thresholds ---------------------------------------------------------------------------------


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each two bits how many fingerprints have both: 64 x 64 numbers at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            n += len(bits)
            both += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel().tolist()], pa.list_(pa.int64()))], ["n", "both"])

    parts = distinct.select("fp").mapInArrow(run, "n long, both array<long>")
    cells = parts.select("n", F.posexplode("both").alias("cell", "c")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for r in cells:
        both[r.cell] = r.c
    return int(cells[0].n or 0) if cells else 0, both.reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps.astype(np.int64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal size; each takes, one by one, the bit most correlated with those it has."""
    width = len(both)
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(var, var))
    np.fill_diagonal(strength, 0)
    left, out = set(range(width)), []
    for k in range(m):
        size = (width - sum(map(len, out))) // (m - k)
        part = [min(left, key=lambda b: (-strength[b, list(left)].sum(), b))]
        left.discard(part[0])
        while len(part) < size:
            best = min(left, key=lambda b: (-strength[b, part].sum(), b))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def agreement(sample: np.ndarray, part: list[int], most: int) -> list[float]:
    """Share of the sample's pairs that differ in at most t bits of a partition, for t = 0 .. most; bits that go together
    count as they do. A pair more than was seen is added, as shares below one pair can't be told."""
    bits = sample.astype(np.int64).view(np.uint64) & np.uint64(sum(1 << b for b in part))
    found = np.zeros(len(part) + 1, np.int64)
    for i in range(len(bits) - 1):
        found += np.bincount(np.bitwise_count(bits[i + 1 :] ^ bits[i]), minlength=len(part) + 1)
    return ((np.cumsum(found) + 1) / (found.sum() + 1))[: most + 1].tolist()


def allocate(n: int, both: np.ndarray, sample: np.ndarray, tau: int, row_cost: float = 2e-6, pair_cost: float = 5e-9) -> tuple[list[list[int]], list[int]]:
    """(partitions, thresholds) of least estimated cost: for each count of partitions, a dynamic program over the
    thresholds left to give, where a threshold costs its probe rows and its expected candidates."""
    best: tuple[float, list[list[int]], list[int]] = (float("inf"), [], [])
    for m in range(max(1, tau // 2 + 1), tau + 2):
        parts = group_bits(n, both, m)
        total = tau - m + 1
        most = min(2, total)
        # state: sum of thresholds so far, shifted by the -1 that each partition may take
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            share = agreement(sample, part, max(most, 0))
            price = {-1: 0.0} | {t: n * keys * row_cost + n * n / 2 * share[t] * pair_cost for t in range(most + 1) if (keys := sum(1 for _ in combinations(part, t)))}
            following: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, given) in states.items():
                for t, more in price.items():
                    if (new := (cost + more, [*given, t]))[0] < following.get(s + t, (float("inf"), []))[0]:
                        following[s + t] = new
            states = following
        if total in states and states[total][0] < best[0]:
            best = (states[total][0], parts, states[total][1])
    return best[1], best[2]


def allocate_likely(n: int, sample: np.ndarray, width: int, differ: float, lost: float, row_cost: float = 2e-6, pair_cost: float = 5e-9) -> tuple[list[list[int]], list[int]]:
    """(partitions, thresholds) of least estimated cost by which two fingerprints, each bit of which differs with the given
    probability, share no probe with a probability of `lost` or less; all partitions at 0 if that is out of reach.

    sample: bits of fingerprints, a row each, on which costs are estimated. As in allocate(), but a threshold gives what it adds to
    -log(probability of no probe), in hundredths, in place of its part of tau.
    """
    parts = group_bits(len(sample), sample.T.astype(np.float32) @ sample.astype(np.float32), sample.shape[1] // width)
    need = math.ceil(-100 * math.log(lost))
    states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        keys = sample[:, part].astype(np.int64) @ (1 << np.arange(len(part)))
        share, same, given = agreement(keys, [*range(len(part))], 1), 0.0, {-1: (0, 0.0)}
        for t in (0, 1):
            rows = math.comb(len(part), t)
            same += rows * differ**t * (1 - differ) ** (len(part) - t)
            given[t] = int(-100 * math.log(1 - same)), n * rows * row_cost + n * n / 2 * share[t] * pair_cost
        following: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, so_far) in states.items():
            for t, (gain, more) in given.items():
                to = min(need, s + gain)
                if to not in following or cost + more < following[to][0]:
                    following[to] = (cost + more, [*so_far, t])
        states = following
    return parts, states[need][1] if need in states else [0] * len(parts)


# --- probing and verifying ---------------------------------------------------------------------------------------


def probes(distinct: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(fp, probe, value): for each partition, its bits with every choice of t of them masked."""
    masks = []
    for part, t in zip(parts, thresholds, strict=True):
        if t >= 0:
            masks += [sum(1 << b for b in part) & ~sum(1 << b for b in hidden) for hidden in combinations(part, t)]
    keys = F.array(*[F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("value")) for i, mask in enumerate(masks)])
    return distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.probe", "k.value")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of buckets with two or more members, with n, their number."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return common.salted_join(rows, counts, keys, "fp", salts=8)


def dealt(rows: DataFrame, block: int, tau: int, split: int = SPLIT) -> DataFrame:
    """Rows of buckets with two or more members, by (probe, value, sub, a, b). Buckets of more than `split` blocks are split
    into those of the second pigeonhole first; one that still has several blocks appears once for each two of them."""
    kept = ["fp", "probe", "value", "sub", "n"]
    member = _shared(rows, ["probe", "value"]).withColumn("sub", F.lit(0).cast("long"))
    sets = [sum(1 << b for b in range(c, BITS, tau + 1)) for c in range(tau + 1)]
    finer = F.array(*[F.struct((F.col("probe") * (tau + 2) + c + 1).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("sub")) for c, m in enumerate(sets)])
    fine = member.filter(F.col("n") > split * block).select("fp", "value", F.explode(finer).alias("k")).select("fp", "value", "k.probe", "k.sub")
    usual = member.filter(F.col("n") <= split * block).withColumn("probe", F.col("probe") * (tau + 2))
    whole = usual.select(kept).unionByName(_shared(fine, ["probe", "value", "sub"]).select(kept)).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    whole = whole.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("a"), F.greatest("mine", o).alias("b")))
    return whole.select("fp", "probe", "value", "sub", F.explode(others).alias("o")).select("fp", "probe", "value", "sub", "o.a", "o.b")


def _links(values: np.ndarray, bucket: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (as fingerprints) among rows sorted by bucket. Rows at distance d in the order are compared for
    d = 1, 2, ..., as long as some bucket is that long, and folded as they come, so pairs never pile up."""
    n, bits = len(values), values.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    at = np.arange(max(n - 1, 0))
    at = at[bucket[at] == bucket[at + 1]]
    root, d = np.arange(n), 1
    left, right = [], []
    held = 0

    def settle():
        nonlocal left, right, held, root
        if left:
            node, top = forest(np.concatenate([*left, np.arange(n)]), np.concatenate([*right, root]), n)
            root = np.arange(n)
            root[node] = top
            left, right, held = [], [], 0

    while len(at):
        near = np.bitwise_count(bits[at] ^ bits[at + d]) <= tau
        hit = at[near]
        if len(hit):
            left.append(hit)
            right.append(hit + d)
            held += len(hit)
            if held > 4_000_000:
                settle()
        d += 1
        at = at[at + d < n]
        at = at[bucket[at] == bucket[at + d]]
    settle()
    node = np.flatnonzero(root != np.arange(n))
    return values[node], values[root[node]]


def compare(rows: DataFrame, tau: int, block: int) -> DataFrame:
    """(src, dst) forest edges of the links in each bucket's pairs of blocks.

    Rows come sorted by bucket; a batch ends with a bucket that may go on, which is carried over. A carried bucket
    has two blocks of rows at most.
    """

    names = ["probe", "value", "sub", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pd.DataFrame | None = None

        def edges(pdf: pd.DataFrame) -> pa.RecordBatch:
            keys = pdf[names].to_numpy()
            bucket = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))]) if len(pdf) else np.zeros(0, np.int64)
            src, dst = _links(np.ascontiguousarray(pdf["fp"].to_numpy()), bucket, tau)
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        for batch in batches:
            pdf = batch.to_pandas()
            if carried is not None:
                pdf = pd.concat([carried, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf[names] == pdf[names].iloc[-1]).all(axis=1).to_numpy()
            carried = pdf[last]
            if not last.all():
                yield edges(pdf[~last])
        if carried is not None:
            yield edges(carried)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *names).sortWithinPartitions(*names).mapInArrow(run, "src long, dst long").distinct()


def links(distinct: DataFrame, tau: int, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """Edges that connect exactly what links of tau or fewer bits connect; distinct: one row for each fp."""
    n, both = bit_counts(distinct)
    if n < 2:
        return distinct.sparkSession.createDataFrame([], "src long, dst long")
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()  # SAMPLE numbers at most
    parts, thresholds = allocate(n, both, np.array([r.fp for r in some], np.int64), tau)
    return compare(dealt(probes(distinct, parts, thresholds), block, tau, split), tau, block)


def named_by_least(distinct: DataFrame, joined: DataFrame, node: str) -> DataFrame:
    """(node, root, component) of each row of distinct (node, least): the least of what its component has; a node without
    links stands for itself. A component may be large, so its nodes meet what they share in several tasks."""
    named = distinct.select(node, "least").join(joined.select(F.col("node").alias(node), "root"), node, "left")
    linked = named.filter(F.col("root").isNotNull())
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    alone = named.filter(F.col("root").isNull()).select(node, F.col(node).alias("root"), F.col("least").alias("component"))
    return alone.unionByName(common.salted_join(linked, least, ["root"], node).select(node, "root", "component"))


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, tau: int = 4, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """(key, fp, root, component): component is the least key among all that links reach, root their least fingerprint."""
    prints = common.store(fingerprints(docs, text, (key,), width), "simhash")
    distinct = common.store(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    joined = components(common.store(links(distinct.select("fp"), tau, block, split), "simhash-links"))
    of = named_by_least(distinct, joined, "fp")
    return prints.join(of, "fp").select(key, "fp", "root", "component")


def keep_one(docs: DataFrame, width: int = 4, tau: int = 4) -> DataFrame:
    """The rows of docs that stand for their component: the one with the least doc_id.

    Ids that several such rows share (repeated rows, null ids) are settled by fingerprints: each component keeps one.
    """
    found = common.store(cluster(docs, width=width, tau=tau), "components")
    head, of, root, component, fp = (common.unused(docs, n) for n in ("head", "of", "root", "component", "fp"))
    heads = found.filter(F.col("doc_id").eqNullSafe(F.col("component"))).groupBy(F.col("doc_id").alias(head)).agg(F.count("*").alias("n"))
    is_head = F.col("doc_id").eqNullSafe(F.col(head))
    kept = docs.join(heads.filter("n = 1").select(head), is_head, "left_semi")
    again = docs.join(heads.filter("n > 1").select(head), is_head, "left_semi")
    root_of = found.select(F.col("fp").alias(of), F.col("root").alias(root), F.col("component").alias(component)).distinct()
    settled = fingerprints(again, "text", tuple(docs.columns), width, fp).join(root_of, F.col(fp) == F.col(of))
    settled = settled.filter(F.col("doc_id").eqNullSafe(F.col(component))).dropDuplicates([root]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(settled)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
