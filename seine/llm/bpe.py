"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by joining pieces.

Texts are cut into words by the tokenizer's pattern. Each worker keeps the words it has met; only a word that is
new to it is encoded, by folding merges over its byte pieces, lowest rank first (leftmost among equals).
The rank map is read once from a vocabulary file whose size the format bounds, and travels with the task.

The fold over a literal rank map is also written with Spark's higher-order functions (``fold_words``): it needs
no Python, and gives the same ids. It serves tables of distinct words; for whole corpora see README for why the
registered query folds inside Arrow batches instead.

Defined results: null and empty texts have no ids; ill-formed surrogates cannot occur in Spark strings; repeated
rows are encoded alike; columns other than the named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words a worker remembers; beyond it the memory starts anew, which costs time and changes no result.
REMEMBERED = 450_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def fold_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What fold() gives, in n log n steps, for words of any length (a run of a million spaces is one word)."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i] if piece[i] is not None else n
        if j >= n or len(piece[i]) + len(piece[j]) != length:
            continue
        piece[i], piece[j] = piece[i] + piece[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            joined = piece[i] + piece[after[i]]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, i, len(joined)))
        if before[i] >= 0:
            joined = piece[before[i]] + piece[i]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, before[i], len(joined)))
    return [ranks[p] for p in piece if p is not None]


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: again and again the adjacent pair of least rank is joined, the leftmost of equals.

    The plain form, which the others must equal.
    """
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    far = len(ranks) + 1
    while len(parts) > 1:
        best = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(best)
        if least == far:
            break
        i = best.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Merges:
    """fold() for many words at once: rows of byte ids, one join in every row at each step."""

    FAR = 1 << 40
    LONGEST = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.width = max(ranks.values(), default=0) + 1
        pairs = {ranks[p[:i]] * self.width + ranks[p[i:]]: r for p, r in ranks.items() if len(p) > 1 for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
        bits = max(10, len(pairs).bit_length() + 3)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.FAR, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values, at = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(keys)
        while len(keys):  # open addressing: whoever finds a slot free takes it, the rest go one further
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            self.found[at[free]] = values[free]
            lost = self.keys[at] != keys
            self.found[at[~lost]] = values[~lost]
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, FAR if it is none; ids below zero stand for no piece."""
        keys = np.where((left < 0) | (right < 0), -2, left * self.width + right)
        at = self._slot(keys)
        out, there = self.found[at], self.keys[at]
        out[there != keys] = self.FAR
        wrong = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            there = self.keys[at[wrong]]
            hit = there == keys[wrong]
            out[wrong[hit]] = self.found[at[wrong[hit]]]
            wrong = wrong[~hit & (there >= 0)]
        return out

    def fold(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        rows: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.ranks:
                out[k] = [self.ranks[w]]
            elif len(w) > self.LONGEST:
                out[k] = fold_heap(w, self.ranks)
            elif w:
                rows.setdefault(-(-len(w) // 4) * 4, []).append(k)
        for length, members in rows.items():
            self._fold_rows([words[k] for k in members], length, np.array(members), out)
        return out

    def _fold_rows(self, words: list[bytes], length: int, at: np.ndarray, out: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(w.ljust(length, b"\0") for w in words), np.uint8).reshape(-1, length)]
        ids[np.arange(length) >= sizes[:, None]] = -1
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), length - 1)
        while len(ids):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            least = ranks[np.arange(len(ids)), best] if ranks.shape[1] else np.full(len(ids), self.FAR)
            done = least >= self.FAR
            if done.any():
                for k, row, n in zip(at[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(1).tolist(), strict=True):
                    out[k] = row[:n]
                ids, ranks, at, best, least = ids[~done], ranks[~done], at[~done], best[~done], least[~done]
                if not len(ids):
                    break
            n, width = ids.shape
            row = np.arange(n)
            ids[row, best] = least
            ids = ids[np.arange(width) != best[:, None] + 1].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1) != best[:, None]].reshape(n, width - 2)
            if width > 2:
                some = row[best < width - 2]
                ranks[some, best[some]] = self.rank(ids[some, best[some]], ids[some, best[some] + 1])
                some = row[best > 0]
                ranks[some, best[some] - 1] = self.rank(ids[some, best[some] - 1], ids[some, best[some]])


#: The pattern in plain `re` terms, which takes half the time; the two agree on the characters that ODD lacks.
SAME_PATTERN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f]")


class Words(dict):
    """word -> ids; a word asked for that isn't there gets an empty list, to be filled from `fresh`."""

    def __init__(self):
        self.fresh: dict[str, list[int]] = {}

    def __missing__(self, word: str) -> list[int]:
        self[word] = self.fresh[word] = []
        return self[word]


class Encoder:
    """Encodes texts with a memory of words; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.by_pattern = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN
        self.seen = Words()

    def words(self, text: str) -> list[str]:
        return SAME_PATTERN.findall(text) if self.plain and not ODD.search(text) else self.by_pattern(text)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; what is new in some texts together is folded together."""
        seen = self.seen
        of = seen.__getitem__
        for some in _runs(texts):
            if len(seen) > REMEMBERED:
                seen.clear()
            cut = [list(map(of, self.words(t))) for t in some]
            for ids, folded in zip(seen.fresh.values(), self.merges.fold([w.encode() for w in seen.fresh]), strict=True):
                ids += folded
            seen.fresh = {}
            for words in cut:
                yield list(chain.from_iterable(words))


def _runs(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoder_of(path: str, pattern: str) -> Encoder:
    """The worker's encoder; workers that Spark uses again keep what they know."""
    return common.remembered((path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>)."""
    schema = docs.select("*").withColumn(ids, F.array().cast("array<int>")).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for batch in batches:
            found = pa.array(list(encoder.encode([t or "" for t in batch.column(at).to_pylist()])), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode_udf(path: str):
    """Column function: array<int> of ids -> binary, the pieces joined."""
    memo: dict[str, list[bytes]] = {}

    @F.pandas_udf("binary")
    def decode(ids):
        if path not in memo:
            ranks = read_ranks(path)
            pieces = [b""] * (max(ranks.values(), default=-1) + 1)
            for piece, rank in ranks.items():
                pieces[rank] = piece
            memo[path] = pieces
        piece = memo[path].__getitem__
        return ids.map(lambda row: None if row is None else b"".join(map(piece, row)))

    return decode


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text and returns only counts and digests, so ids need not travel back to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        pieces = [b""] * (max(encoder.ranks.values(), default=-1) + 1)
        for piece, rank in encoder.ranks.items():
            pieces[rank] = piece
        said = [str(i) for i in range(len(pieces))]
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(said.__getitem__, ids)).encode()).hexdigest())
                back_sha.append(hashlib.sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, ids, n_tokens, and whether the pieces of the ids are the text's bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        pieces = [b""] * (max(encoder.ranks.values(), default=-1) + 1)
        for piece, rank in encoder.ranks.items():
            pieces[rank] = piece
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            ids = list(encoder.encode(texts))
            same = [b"".join(map(pieces.__getitem__, x)) == t.encode() for x, t in zip(ids, texts, strict=True)]
            flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), pa.array(np.fromiter(chain.from_iterable(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat, pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())], [*batch.schema.names[1:], "ids", "n_tokens", "intact"])

    kept = docs.select(F.col(text).alias("seine_text"), *carry)
    schema = kept.drop("seine_text").withColumns({"ids": F.array().cast("array<int>"), "n_tokens": F.lit(0).cast("long"), "intact": F.lit(True)}).schema
    return kept.mapInArrow(run, schema)


def fold_words(words: DataFrame, ranks: DataFrame, column: str = "word") -> DataFrame:
    """words with array<int> ids, merged by higher-order functions over byte pieces.

    ranks: one row (table: array<array<struct<piece,rank>>>) as ``rank_frame`` gives it. Each step of the outer
    fold joins one pair, so a word of n bytes takes n - 1 steps at most.
    """
    wide = words.crossJoin(F.broadcast(ranks))  # one row on the right
    pieces = F.transform(F.sequence(F.lit(1), F.length(F.col(column).cast("binary"))), lambda i: F.substring(F.col(column).cast("binary"), i, F.lit(1)))
    buckets = F.size("table")
    far = F.lit(2**31 - 1)

    def rank(piece: Column) -> Column:
        slot = F.get(F.col("table"), F.pmod(F.xxhash64(piece), buckets).cast("int"))
        return F.coalesce(F.get(F.filter(slot, lambda e: e["piece"] == piece), F.lit(0))["rank"], far)

    def step(parts: Column, _: Column) -> Column:
        ranked = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(rank(F.concat(p, F.get(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(ranked)
        joined = F.concat(
            F.slice(parts, F.lit(1), best["i"]),
            F.array(F.concat(F.get(parts, best["i"]), F.get(parts, best["i"] + 1))),
            F.slice(parts, best["i"] + 3, F.size(parts)),
        )
        return F.when(best.isNull() | (best["r"] == far), parts).otherwise(joined)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(F.col(column).cast("binary")), F.lit(1))), pieces, step)
    full = F.when(F.length(column) == 0, F.array().cast("array<binary>")).otherwise(folded)
    return wide.withColumn("pieces", full).withColumn("ids", F.transform("pieces", rank)).drop("table", "pieces")


def rank_frame(spark: SparkSession, path: str, buckets: int = 16_384) -> DataFrame:
    """One row with the bucketed rank map; its size is that of the vocabulary file."""
    rows = spark.createDataFrame(list(read_ranks(path).items()), "piece binary, rank int")
    by = rows.groupBy(F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int").alias("b")).agg(F.collect_list(F.struct("piece", "rank")).alias("slot"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(by, "b", "left")
    empty = F.array().cast("array<struct<piece:binary,rank:int>>")
    return every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("slot", empty).alias("slot")))).alias("t")).select(F.transform("t", lambda s: s["slot"]).alias("table"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest columns for every document."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
