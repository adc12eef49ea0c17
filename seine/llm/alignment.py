"""Alignment of two tokenizers' tokens over the same bytes.

A text's tokens in both vocabularies are laid over its bytes. Packed bitsets mark where tokens end; their AND has the cuts
that both share, which part the tokens into groups; ranks by popcount map a byte to the number of the token that holds it.
Between two neighbouring ends of either (the OR) lies exactly one piece of one A and one B token, and each overlapping pair
has exactly one such piece: the links expand from the bits of the OR by their ranks.

Both tokenizers cut where a single space or line feed stands between two other characters: A's pattern always does, and no
piece of B holds a space after another sign, or a line feed (checked when B is loaded; else a text is one segment). So a
text is a list of segments, and each worker tokenizes and aligns a segment once, as long as it remembers it.

Two passes over the texts: the first counts linked id pairs, added up in each task before they are shuffled; the second
gives each document's columns with the counts at hand. The table of counts is broadcast if it has at most PAIRS rows;
beyond that documents' pairs are joined with it, many to one, hot pairs dealt to several tasks.

Defined results: a null or empty text has no tokens, nor has one whose joined A or B bytes differ from space and text (one
with U+2581, say); zeros and '' then, and it adds to no count; repeated rows count each, and give equal rows; special
tokens' strings are plain text; an empty table gives no rows; other columns are ignored, whatever their names; a text of
any length is taken whole, and what is known of its own segments must fit its worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of the table of pair counts up to which it is broadcast: 16 bytes each.
PAIRS = 4_000_000
#: Segments and characters of them that a worker remembers; beyond, it starts anew, which changes no result.
REMEMBERED, CHARACTERS = 900_000, 24_000_000
SPACE = "▁"
#: What plain splitting at spaces and line feeds does not serve, and the segments of such texts.
ODD = re.compile(r"[^\S \n]|[ \n]{2}|\A\s|\s\Z")
SEGMENTS = re.compile(r"\s+\S*(?:(?![ \n]\S)\s+\S*)*")


def letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others, in order, for
    the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-max(size, 1) // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set below each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        word = np.minimum(word, len(self.words) - 1)
        inside = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        return np.where(places >> 6 < len(self.words), self.before[word] + inside, self.before[-1])

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Laid:
    """Segments laid end to end, by the sizes in bytes of their tokens and their own."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray, segment_sizes: np.ndarray):
        size, self.ends = int(segment_sizes.sum()), np.cumsum(segment_sizes)
        self.a_last, self.b_last = np.cumsum(a_sizes) - 1, np.cumsum(b_sizes) - 1
        self.a, self.b = Bits.at(self.a_last, size), Bits.at(self.b_last, size)
        self.shared, self.either = Bits(self.a.words & self.b.words), Bits(self.a.words | self.b.words)
        cuts = self.shared.select() + 1
        #: A and B tokens before each shared cut.
        self.a_cut, self.b_cut = self.a.rank(cuts), self.b.rank(cuts)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The A and the B token of each link."""
        pieces = self.either.select()
        return self.a.rank(pieces), self.b.rank(pieces)

    def spelled(self, a_codes: np.ndarray, b_codes: np.ndarray, a_far: int, b_far: int) -> np.ndarray:
        """The tokens' codes group by group, A's before B's; the last of a group's A codes plus a_far, of its B codes plus b_far."""
        a_group, b_group = self.shared.rank(self.a_last), self.shared.rank(self.b_last)
        i, j = np.arange(len(a_codes)), np.arange(len(b_codes))
        out = np.empty(len(a_codes) + len(b_codes), np.int64)
        out[i + np.concatenate([[0], self.b_cut])[a_group]] = a_codes + a_far * (i + 1 == self.a_cut[a_group])
        out[j + self.a_cut[b_group]] = b_codes + b_far * (j + 1 == self.b_cut[b_group])
        return out


class Tokenizers:
    """Both tokenizers, with the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = letters_of_bytes()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, piece)) if all(c in letters for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        self.cuts = not any("\n" in p or (p.strip(SPACE) and SPACE in p[1:]) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.width = len(pieces)  # a pair's number is its A id times this plus its B id
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: What is written for a token: A ids before another A id or before a bar, B ids before another or before a semicolon.
        self.said = [f"{i}{sign}" for of, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(of))]
        #: Then an A token's bytes never differ from the text's: no normalization, and each byte is a token.
        rules = json.loads(self.a.to_str())
        self.lossless = rules["normalizer"] is None and rules["pre_tokenizer"]["type"] == "ByteLevel" and not rules["model"].get("unk_token") and all(c in vocabulary for c in letters)

    def segments(self, text: str) -> list:
        """Keys of the segments of space + text: without the space that most begin with, a tuple where that would mislead."""
        if not self.cuts:
            return [("", " " + text)]
        if not ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        first, *rest = SEGMENTS.findall(" " + text)
        return [("", first), *(s[1:] if s[0] == " " else s for s in rest)]

    def encode(self, keys: list) -> tuple[list[bytes], list[list[int]], list[list[int]]]:
        """Bytes of the segments, A ids and B ids."""
        segments = [k[1] if isinstance(k, tuple) else k if k[:1] == "\n" else " " + k for k in keys]
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        # a segment that begins with a line feed has no space before it: the one that B adds is its own token
        return [s.encode() for s in segments], a, [ids if s[0] == " " else ids[1:] if ids[0] == self.space else [] for ids, s in zip(b, segments, strict=True)]


class Known(dict):
    """key -> number; a key asked for that isn't there gets the next number and waits in `fresh`."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class Memory:
    """What a worker knows of segments: n_a (-1: bytes differ), n_b, n_groups, n_links, and, where counts are given, n_best and
    count_sum; the spelled groups; and the numbers of the linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.counts = tokenizers, None
        self.clear()

    def clear(self) -> None:
        self.known, self.characters = Known(), 0
        self.table = np.zeros((1024, 6), np.int64)
        self.spelled: list[str] = []
        self.first, self.pairs = [0], []

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's segments."""
        if len(self.known) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
        of, cut = self.known.__getitem__, self.tokenizers.segments
        out = [np.fromiter(map(of, cut(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        fresh, self.known.fresh = self.known.fresh, []
        while len(self.known) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for start in range(0, len(fresh), 20_000):
            self._learn(fresh[start : start + 20_000])
        return out

    def _learn(self, keys: list) -> None:
        t = self.tokenizers
        whole, a_ids, b_ids = t.encode(keys)
        a_of, b_of = t.a_bytes.__getitem__, t.b_bytes.__getitem__
        ok = [b"".join(map(b_of, b)) == w and (t.lossless or b"".join(map(a_of, a)) == w) for w, a, b in zip(whole, a_ids, b_ids, strict=True)]
        at, n = len(self.spelled), len(keys)
        if not all(ok):
            whole, a_ids, b_ids = ([x if k else x[:0] for x, k in zip(xs, ok, strict=True)] for xs in (whole, a_ids, b_ids))
        sizes = np.fromiter(map(len, whole), np.int64, n)
        rows = np.zeros((n, 6), np.int64)
        rows[:, 0], rows[:, 1] = (np.fromiter(map(len, ids), np.int64, n) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(rows[:, k].sum())) for k, ids in enumerate((a_ids, b_ids)))
        laid = Laid(t.a_sizes[a], t.b_sizes[b], sizes)
        rows[:, 2], rows[:, 3] = (np.diff(bits.rank(laid.ends), prepend=0) for bits in (laid.shared, laid.either))
        n_a, n_b = len(t.a_bytes), len(t.b_bytes)
        said = [*map(t.said.__getitem__, laid.spelled(a, b + 2 * n_a, n_a, n_b).tolist())]
        begin = 0
        for end in np.cumsum(rows[:, 0] + rows[:, 1]).tolist():
            self.spelled.append("".join(said[begin:end]))
            begin = end
        a_link, b_link = laid.links()
        pairs = a[a_link] * t.width + b[b_link]
        first = np.concatenate([[0], np.cumsum(rows[:, 3])])
        if self.counts is not None:
            rows[:, 4:6] = self._counted(pairs, first)
        rows[~np.array(ok), 0] = -1
        self.characters += int(sizes.sum())
        self.table[at : at + n] = rows
        self.pairs.append(pairs)
        self.first += (self.first[-1] + first[1:]).tolist()

    def _counted(self, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(n_best, count_sum) of segments whose pairs lie between neighbours of first."""
        _, numbers, times, best = self.counts
        sums = np.zeros((len(pairs) + 1, 2), np.int64)
        if len(pairs) and len(numbers):
            found = np.minimum(np.searchsorted(numbers, pairs), len(numbers) - 1)  # of texts without tokens some may be unknown
            sums[1:, 0], sums[1:, 1] = np.cumsum(best[found]), np.cumsum(times[found])
        return np.diff(sums[first], axis=0)

    def look_up(self, counts: tuple) -> None:
        """Takes a table of counts: its name, pairs in order, their times, and whether a pair is its B id's most frequent."""
        self.counts = counts
        if self.pairs:
            self.pairs = [np.concatenate(self.pairs)]
            self.table[: len(self.spelled), 4:6] = self._counted(self.pairs[0], np.asarray(self.first))

    def expanded(self, numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, times) of segments that occur so often: distinct pairs with their links."""
        if len(self.pairs) > 1:
            self.pairs = [np.concatenate(self.pairs)]
        first = np.asarray(self.first)
        size = first[numbers + 1] - first[numbers]
        at = np.repeat(first[numbers] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pairs, place = np.unique(self.pairs[0][at] if self.pairs else np.zeros(0, np.int64), return_inverse=True)
        return pairs, np.bincount(place, np.repeat(times, size), len(pairs)).astype(np.int64)


def memory_of(paths: tuple[str, str], shared=None) -> Memory:
    """The worker's memory for a pair of tokenizers, what it knows stays when counts come or change."""
    memory = common.remembered(paths, lambda: Memory(Tokenizers(*paths)))
    if shared is not None and (memory.counts is None or memory.counts[0] != shared.value[0]):
        memory.look_up(shared.value)
    return memory


def _runs(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _sums(memory: Memory, cut: list[np.ndarray]) -> np.ndarray:
    """Rows of the memory's columns summed for each text; a text with a segment whose bytes differ gets zeros."""
    rows = np.concatenate([memory.table[np.concatenate(cut)], np.zeros((1, 6), np.int64)]) if cut else np.zeros((1, 6), np.int64)
    sizes = np.array([*map(len, cut)], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.add.reduceat(rows, starts) if len(cut) else rows[:0]
    bad = np.add.reduceat(rows[:, 0] < 0, starts) > 0 if len(cut) else rows[:0, 0]
    out[(sizes == 0) | bad] = 0
    return out


def pair_counts(docs: DataFrame, paths: tuple[str, str], text: str = "text") -> DataFrame:
    """(pair, times): in how many links of the corpus each pair of ids is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(paths)
        seen = np.zeros(0, np.int64)  # how often each known segment occurred
        whole: list[tuple[np.ndarray, np.ndarray]] = []

        def emptied() -> pa.RecordBatch:
            some = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([*map(pa.array, memory.expanded(some, seen[some]))], ["pair", "times"])

        for batch in batches:
            for texts in _runs([t or "" for t in batch.column(0).to_pylist()]):
                if len(memory.known) > REMEMBERED or memory.characters > CHARACTERS:
                    yield emptied()
                    seen = np.zeros(0, np.int64)
                cut = memory.numbers(texts)
                good = [c for c, n in zip(cut, _sums(memory, cut)[:, 0], strict=True) if n]
                more = np.bincount(np.concatenate(good), minlength=len(memory.known)) if good else np.zeros(len(memory.known), np.int64)
                more[: len(seen)] += seen
                seen = more
        if len(seen):
            yield emptied()

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, times long")
    return found.groupBy("pair").agg(F.sum("times").alias("times"))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _documents(paths: tuple[str, str], shared, with_pairs: bool, key: str) -> Callable:
    """Batches of (key, text) -> key, MEASURES, groups_sha256; with_pairs: and the document's pairs and their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(paths, shared)
        for batch in batches:
            at = 0
            for texts in _runs([t or "" for t in batch.column(1).to_pylist()]):
                cut = memory.numbers(texts)
                sums = _sums(memory, cut)
                spelled = memory.spelled.__getitem__
                digests = [hashlib.sha256("".join(map(spelled, c.tolist()))[:-1].encode()).hexdigest() if n else "" for c, n in zip(cut, sums[:, 0].tolist(), strict=True)]
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array(sums[:, k]) for k in range(6)), pa.array(digests, pa.string())]
                names = [key, *MEASURES, "groups_sha256"]
                if with_pairs:
                    none = np.zeros(0, np.int64)
                    held = [memory.expanded(*np.unique(c, return_counts=True)) if n else (none, none) for c, n in zip(cut, sums[:, 0], strict=True)]
                    columns += [pa.array([h[k] for h in held], pa.list_(pa.int64())) for k in (0, 1)]
                    names += ["pairs", "times"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", most_pairs: int = PAIRS) -> DataFrame:
    """One row for each of docs: key, MEASURES, groups_sha256."""
    paths, spark = (a_path, b_path), docs.sparkSession
    counts = common.store(pair_counts(docs, paths, text), "pairs")
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("seine_text"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {', '.join(f'{m} long' for m in MEASURES)}, groups_sha256 string"
    if counts.count() <= most_pairs:
        got = counts.orderBy("pair").toArrow()
        numbers, times = (got.column(c).to_numpy() for c in ("pair", "times"))
        width = Tokenizers(a_path, b_path).width
        best = np.zeros(width, np.int64)
        np.maximum.at(best, numbers % width, times)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, numbers, times, (times == best[numbers % width]).astype(np.int8)))
        return rows.mapInArrow(_documents(paths, shared, False, key), schema)
    width = Tokenizers(a_path, b_path).width
    best = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("times").alias("best"))
    judged = counts.withColumn("b", F.col("pair") % width).join(best, "b").select("pair", F.col("times").alias("corpus"), (F.col("times") == F.col("best")).cast("long").alias("is_best"))
    found = common.store(rows.mapInArrow(_documents(paths, None, True, key), schema + ", pairs array<bigint>, times array<bigint>").withColumn("seine_row", F.monotonically_increasing_id()), "aligned")
    each = found.select("seine_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("seine_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("held"))
    summed = common.salted_join(each, judged, ["pair"], "seine_row").groupBy("seine_row").agg(F.sum(F.col("held") * F.col("is_best")).alias("best"), F.sum(F.col("held") * F.col("corpus")).alias("sum"))
    out = found.drop("pairs", "times").join(summed, "seine_row", "left")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", F.lit(0)).alias("n_best"), F.coalesce("sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
