"""Pairs of similar names without comparing all of them letter by letter, and without losing one.

Two names are similar by `names.similar`, each of whose conditions has a join of its own:

* words contained, or shared for 92 % (23/27 of the characters of one name): a name asks for pairs of its rarest words, so many
  that not all of them can lie outside what is shared; for single words where one alone may be shared;
* one text inside the other, but not all words: its first word is only the end of a word there, or its last one only the
  beginning, so ends and beginnings of up to EDGE characters meet beside the whole word next to them;
* two words shared and one name nearly a piece of the other: pairs of words meet (names of more than WIDE words ask for each of
  their words). Of a name of n characters at most 2/21 may be missing, and n / 10 may be missing or put in, each of which takes
  three triples of letters at most and one step of edit distance;
* sorted words 85 % alike, or sets of words 92 %: letter counts may differ by 15 % of both lengths. Counts are kept as bits,
  as many bits of a letter set as it stands in the text, so that the bits in which two names differ bound their distance from
  below; each letter that differs changes three pairs of letters at most. All names of fitting lengths are compared so, in
  pairs of blocks of BLOCK names in the order of their lengths;
* acronyms meet by equality.

The first two and the last are decided where they meet; the others are compared letter by letter. A word or a pair of words
that many names hold is dealt to several tasks. The steps that grow with the square of the names are the blocks', at some
nanoseconds a pair, and the pairs of words', at some tens for two names that hold one; both in bounded memory.

Defined results: empty names are similar to none; equal names meet as one, their least id; a name of any length is taken
whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.functions import names
from seine.session import stored

#: Names of a block, and rows of a word or a pair of words that one task takes.
BLOCK = 16_384
#: What `str.split` parts words at.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: Characters of a word's end and beginning that meet, and distinct words of a name whose pairs are listed.
EDGE, WIDE = 6, 24
#: Bits of each letter's count, in two words of 64, the first counts of all letters in the first; other characters share the last ones.
_BITS = (
    {"e": 5, "n": 4, "t": 4, "a": 4, "i": 4, "h": 4, "r": 3, "s": 3, "o": 3, "u": 3, "l": 3, "d": 3, "c": 3, "g": 2, "m": 2, "p": 2, "b": 2, "f": 2, "v": 1, "k": 1, "z": 1, "w": 1, "y": 1, "q": 1, "j": 1, "x": 1},
    {"e": 2, "n": 2, "t": 2, "a": 2, "i": 2, "h": 1, "r": 3, "s": 3, "o": 2, "u": 1, "l": 2, "d": 2, "c": 2, "g": 3, "m": 2, "p": 2, "b": 2, "f": 1, "v": 2, "k": 2, "z": 2, "w": 1, "y": 2, "j": 1, "x": 1, "other": 17},
)


def _places() -> dict[str, list[int]]:
    """The bits of each letter, in the order in which its occurrences take them; those of the second word behind 64."""
    out: dict[str, list[int]] = {}
    for word, bits in enumerate(_BITS):
        at = 64 * word
        for c, room in bits.items():
            out.setdefault(c, []).extend(range(at, at + room))
            at += room
    return out


_PLACES = _places()


def _halves(bits: int) -> tuple[int, int]:
    """128 bits as two longs."""
    return tuple(w - (1 << 64) if w >> 63 else w for w in (bits & (1 << 64) - 1, bits >> 64))  # type: ignore[return-value]


def counted(text: str) -> tuple[int, int]:
    """Letter counts as bits. Texts that are d insertions and deletions apart differ in d bits at most."""
    seen: dict[str, int] = {}
    bits = 0
    for c in "".join(text.split()):
        c = c if c in _PLACES else "other"
        n = seen.get(c, 0)
        if n < len(_PLACES[c]):
            bits |= 1 << _PLACES[c][n]
            seen[c] = n + 1
    return _halves(bits)


@lru_cache(200_000)
def _bit(piece: str) -> int:
    return 1 << zlib.crc32(piece.encode()) % 128


def marked(text: str, n: int) -> tuple[int, int]:
    """Pieces of n characters as bits."""
    bits = 0
    for i in range(len(text) - n + 1):
        bits |= _bit(text[i : i + n])
    return _halves(bits)


def beside(words: list[str]) -> tuple[list[str], list[str]]:
    """What a text of these words asks for to find the texts that it stands in with a first or last word that is not whole
    there, and what it holds for others. Of three words or more it also knows a letter of the third one."""
    known, lengths = {*words}, {len(w) for w in words}
    ends, starts = ([{w[-i:] for i in range(1, min(EDGE, len(w) - 1) + 1)} for w in words], [{w[:i] for i in range(1, min(EDGE, len(w) - 1) + 1)} for w in words])
    held = set()
    for k, (a, b) in enumerate(pairwise(words)):
        held |= {f"<{x} {b}" for x in ends[k]} | {f">{a} {y}" for y in starts[k + 1]}
        # both words in part, of texts of two words, one of which stands elsewhere
        some = {a[-i:][-EDGE:] for i in lengths if i < len(a) and a[-i:] in known}, {b[:i][:EDGE] for i in lengths if i < len(b) and b[:i] in known}
        held |= {f"={x} {y}" for x in some[0] for y in starts[k + 1]} | {f"={x} {y}" for x in ends[k] for y in some[1]}
    for k, (a, b, c) in enumerate(zip(words, words[1:], words[2:], strict=False)):
        held |= {f"<{x} {b} {c[0]}" for x in ends[k]} | {f">{a[-1]} {b} {y}" for y in starts[k + 2]}
    if len(words) > 2:
        asked = [f"<{words[0][-EDGE:]} {words[1]} {words[2][0]}", f">{words[-3][-1]} {words[-2]} {words[-1][:EDGE]}"]
    elif len(words) == 2:
        asked = [f"<{words[0][-EDGE:]} {words[1]}", f">{words[0]} {words[1][:EDGE]}", f"={words[0][-EDGE:]} {words[1][:EDGE]}"]
    else:
        asked = []
    return asked, sorted(held)


_LONGS = ("low", "high", "two_low", "two_high")
_TEXT = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _LONGS], T.StructField("text", T.StringType()), T.StructField("kind", T.IntegerType())])
_FEATURES = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(_TEXT)), T.StructField("three_low", T.LongType()), T.StructField("three_high", T.LongType()), T.StructField("asked", T.ArrayType(T.StringType())), T.StructField("edges", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FEATURES)
def _features(clean: pd.Series) -> pd.DataFrame:
    """Distinct words; the sorted words and the set of words as length and bits of letters and of pairs of letters within
    words; bits of triples of letters; the keys by which a text meets those it stands in."""

    def of(x: str) -> tuple:
        words = x.split()
        once = len({*words}) == len(words)
        texts = [(" ".join(sorted(words)), 3 if once else 1)]  # kind: 1 all words, 2 the set of words
        if not once:
            texts.append((" ".join(sorted({*words})), 2))
        rows = [dict(zip(_TEXT.names, (len(t), *counted(t), *marked(f" {t} ", 2), t, kind), strict=True)) for t, kind in texts]
        return sorted({*words}), rows, *marked(x, 3), *beside(words)

    return pd.DataFrame([of(x) for x in clean], columns=_FEATURES.names)


_ASKS = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("alone", "rarest", "pairs")])


@F.pandas_udf(_ASKS)
def _asks(ranked: pd.Series) -> pd.DataFrame:
    """Of a name's distinct words, the rarest first: those that one must ask for which may share no other word; the rarest, one
    of which is shared; pairs of words, one of which is shared by what shares two. Of more than WIDE words no pairs."""

    def of(words: list[str]) -> tuple:
        cost = [len(w) + 1 for w in words]
        most = 4 * (sum(cost) - 1)  # 27 times what may be missing, words with their blanks
        before = np.cumsum([0, *cost]).tolist()
        first = [i for i in range(len(words)) if 27 * before[i] <= most]
        if len(words) > WIDE:
            return [words[i] for i in first], [], []
        alone = [i for i in first if 27 * (before[-1] - cost[i]) <= most]
        two = [(words[i], words[j]) for i in first if i not in alone for j in range(i + 1, len(words)) if 27 * (before[j] - cost[i]) <= most]
        return [words[i] for i in alone], [words[i] for i in first], [" ".join(sorted(p)) for p in two]

    return pd.DataFrame([of([*x]) for x in ranked], columns=_ASKS.names)


def _far(a: tuple[np.ndarray, ...], i: np.ndarray, b: tuple[np.ndarray, ...], j: np.ndarray) -> np.ndarray:
    """In how many of 128 bits the pairs differ."""
    return sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(a, b, strict=True))


def _near(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], same: bool, rows: int = 64, cols: int = 4096, some: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b, both by length, of texts that may be 85 % alike, some at a time; same: a and b are one, each pair counts once."""
    n, m, at = a[0], b[0], 0
    room = np.empty(rows * cols, np.uint64), np.empty(rows * cols, np.uint8), np.empty(rows * cols, bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    found = 0
    while at < len(n):
        # texts of one length at once, in pieces that stay in a core's cache
        to = min(at + rows, int(np.searchsorted(n, n[at], "right")))
        first, last = np.searchsorted(m, -(-85 * n[at] // 115)), np.searchsorted(m, n[at] * 115 // 85, "right")
        first = max(first, at) if same else first
        for start in range(first, last, cols):
            end = min(start + cols, last)
            xor, bits, fit = (r[: (to - at) * (end - start)].reshape(to - at, end - start) for r in room)
            np.bitwise_xor(a[1][at:to, None], b[1][None, start:end], out=xor)
            np.bitwise_count(xor, out=bits)
            np.less_equal(bits, np.minimum((n[at] + m[start:end]) * 3 // 20, 64).astype(np.uint8)[None, :], out=fit)
            i, j = np.divmod(np.flatnonzero(fit), end - start)
            i, j = i + at, j + start
            most = (n[i] + m[j]) * 3 // 20
            fits = (_far(a[1:3], i, b[1:3], j) <= most) & ((i < j) if same else True)
            i, j, most = i[fits], j[fits], most[fits]
            fits = _far(a[3:], i, b[3:], j) <= 3 * most
            out.append((i[fits], j[fits]))
            found += len(out[-1][0])
            if found >= some:
                yield tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[misc]
                out, found = [], 0
        at = to
    if found:
        yield tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[misc]


def _codes(texts: list[str]) -> np.ndarray:
    """Texts of up to 64 characters as rows of characters' numbers from 1, without gaps; 0 stands behind their ends, other texts are all 0."""
    size = np.array([len(t) if len(t) <= 64 else 0 for t in texts])
    joined = "".join(t.ljust(64) if len(t) <= 64 else " " * 64 for t in texts)
    out = (np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, 64).astype(np.int64) + 1) * (np.arange(64) < size[:, None])
    number = np.zeros(int(out.max(initial=0)) + 1, np.int32)
    number[out.ravel()] = 1
    number[0] = 0
    return np.where(number > 0, np.cumsum(number), 0).astype(np.int32)[out]


def _walk(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, Iterator[np.ndarray]]]:
    """Pairs of left[i] and right[j], texts of up to 64 characters, some thousands at once: their places, and for each
    character of the right texts in turn where it stands in the left ones, as bits."""
    if not len(i):
        return
    codes = _codes([*left, *right])
    mine, other, chars = codes[: len(left)], codes[len(left) :], int(codes.max(initial=0)) + 1
    long_of = np.count_nonzero(other, axis=1)
    some = max(256, min(8192, 4_000_000 // chars))
    order = np.lexsort((i, long_of[j]))
    for start in range(0, len(i), some):
        at = order[start : start + some]
        here, x = np.unique(i[at], return_inverse=True)
        masks = np.zeros((len(here), chars), np.uint64)
        for k in range(64):
            masks[np.arange(len(here)), mine[here, k]] |= np.uint64(1 << k)
        masks[:, 0] = 0
        flat, of, y = masks.ravel(), x * chars, np.ascontiguousarray(other[j[at]].T)
        yield at, (flat[of + y[k]] for k in range(int(long_of[j[at]].max())))


def _common(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`names.longest_common` of left[i] and right[j], texts of up to 64 characters, for many pairs at once."""
    out = np.zeros(len(i), np.int64)
    for at, places in _walk(left, right, i, j):
        rows = np.full(len(at), ~np.uint64(0))
        for here in places:
            met = rows & here
            rows = (rows + met) | (rows - met)
        out[at] = np.bitwise_count(~rows)
    return out


def _edits(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least edit distance of left[i], texts of 1 to 64 characters, to any piece of right[j], of up to 64 (Myers' bits)."""
    size = np.array([len(t) for t in left], np.int64)
    out, one = size[i], np.uint64(1)
    for at, places in _walk(left, right, i, j):
        more, less, now, best = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64), size[i[at]], size[i[at]]
        last = (now - 1).astype(np.uint64)
        for here in places:
            across = (((here & more) + more) ^ more) | here
            down, up = less | ~(across | more), more & across
            now = now + (down >> last & one).astype(np.int64) - (up >> last & one).astype(np.int64)
            best = np.minimum(best, now)
            down, up, here = down << one, up << one, here | less
            more, less = up | ~(here | down), down & here
        out[at] = best
    return out


def _tile(across: bool):
    """Two blocks' texts against each other: pairs that are alike by sorted words, and those that words must be read for."""

    def side(t: pa.Table, fresh: bool | None) -> tuple:
        t = t.sort_by([("n", "ascending"), ("id", "ascending")])
        own = np.asarray(t["fresh"].to_numpy(), bool)
        t = t.filter(pa.array(np.ones(len(t), bool) if fresh is None else own == fresh))
        bits = (t[c].to_numpy().astype(np.int64).view(np.uint64) for c in _LONGS)
        return t["id"].to_numpy(), (t["n"].to_numpy().astype(np.int64), *bits), t["text"].to_pylist(), t["kind"].to_numpy().astype(np.int64)

    def pairs(x: tuple, y: tuple, same: bool) -> pa.Table:
        (ids, a, texts, kind), (of, b, others, kind_b) = x, y
        out = [pa.table({"id": pa.array([], pa.int64()), "of": pa.array([], pa.int64()), "sure": pa.array([], pa.bool_())})]
        for i, j in _near(a, b, same):
            both, size = kind[i] & kind_b[j], a[0][i] + b[0][j]
            whole = np.maximum(a[0][i], b[0][j]) > 64  # texts too long for a word of bits are read elsewhere
            sure = (200 * _common(texts, others, i, j) >= 85 * size) & (both & 1 > 0) & ~whole
            most = 8 * size // 100
            open_ = ~sure & (whole | ((both & 2 > 0) & (_far(a[1:3], i, b[1:3], j) <= most) & (_far(a[3:], i, b[3:], j) <= 3 * most)))
            some = (sure | open_) & (ids[i] != of[j])
            out.append(pa.table({"id": pa.array(ids[i][some], pa.int64()), "of": pa.array(of[j][some], pa.int64()), "sure": pa.array(sure[some])}))
        return pa.concat_tables(out)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        sides = [(True, False)] if across else [(True, True), (True, False)]
        if not same:
            sides.append((False, True))
        return pa.concat_tables([pairs(side(left, x), side(right, y), same and x == y) for x, y in sides])

    return meet


def _alike(one: DataFrame, block: int, across: bool) -> DataFrame:
    """(id, of, sure) of names that are alike by their sorted words, or may be by the set of them."""
    spark = one.sparkSession
    texts = one.select("id", "fresh", F.explode("texts").alias("t")).select("id", "fresh", "t.*")
    sizes = [(r.n, r["count"]) for r in texts.groupBy("n").count().orderBy("n").collect()]  # a row for each length
    if not sizes:
        return spark.createDataFrame([], "id long, of long, sure boolean")
    starts = np.cumsum([0, *(c for _, c in sizes)])
    least, most = {}, {}
    for (n, c), start in zip(sizes, starts, strict=False):
        for k in range(int(start) // block, (int(start) + c - 1) // block + 1):
            least.setdefault(k, n)
            most[k] = n
    last = len(least) - 1
    lows = [int(np.searchsorted([most[k] for k in range(last + 1)], -(-85 * least[i] // 115))) for i in range(last + 1)]
    highs = [max(i for i in range(j, last + 1) if lows[i] <= j) for j in range(last + 1)]
    by_length = spark.createDataFrame([(n, int(s), c) for (n, c), s in zip(sizes, starts, strict=False)], "n int, start long, c long")
    reach = spark.createDataFrame([(k, lows[k], highs[k]) for k in range(last + 1)], "own long, lowest long, highest long")
    at = F.floor((F.col("start") + F.pmod(F.xxhash64("id"), F.col("c"))) / block).cast("long")
    dealt = texts.join(F.broadcast(by_length), "n").withColumn("own", at).join(F.broadcast(reach), "own")
    tiles = min(sum(i - low + 1 for i, low in enumerate(lows)), 4096)
    cols = ["id", "fresh", *_TEXT.names]
    left = dealt.select(F.col("own").alias("i"), F.explode(F.sequence("lowest", "own")).alias("j"), *cols).repartition(tiles, "i", "j")
    right = dealt.select(F.explode(F.sequence("own", "highest")).alias("i"), F.col("own").alias("j"), *[F.col(c).alias(c) for c in cols]).repartition(tiles, "i", "j")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_tile(across), "id long, of long, sure boolean")


def piece_alike(a: str, b: str) -> bool:
    """Whether `names.part_ratio` is 95 or more; pieces shorter than 19/21 of the shorter name can't reach that."""
    a, b = sorted((a, b), key=len)
    n = len(a)
    ends = range(max(1, -(-19 * n // 21)), n)
    pieces = (*(b[i : i + n] for i in range(len(b) - n + 1)), *(p for i in ends for p in (b[:i], b[-i:])))
    if any(names.ratio(a, p) >= 95 for p in pieces):
        return True
    return len(b) == n and any(names.ratio(p, b) >= 95 for i in ends for p in (a[:i], a[-i:]))


def likeness(a: str, b: str, piece: bool) -> bool:
    """Whether texts are alike: one nearly a piece of the other (19/21 of the shorter stand in the other then), else as a whole."""
    if piece:
        return piece_alike(a, b)
    return names.sorted_ratio(a, b) >= 85 or names.set_ratio(a, b) >= 92


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (a, b) whose texts have ``likeness``; too little in common is seen for all rows at once."""
    for pdf in batches:
        a, b, piece = pdf["a_clean"], pdf["b_clean"], pdf["piece"]
        n, m = a.str.len().to_numpy(), b.str.len().to_numpy()
        at = np.arange(len(pdf))
        common = _common([*a], [*b], at, at)
        may = ~piece.to_numpy(bool) | (np.maximum(n, m) > 64) | (common * 21 >= 19 * np.minimum(n, m))
        yield pdf.loc[[bool(k) and likeness(*x) for k, x in zip(may, zip(a, b, piece, strict=True), strict=True)], ["a", "b"]]


def _dealt(asked: DataFrame, there: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows x of asked and y of there, both structs, with key and block, by which they meet; keys that many rows hold in blocks."""
    # of n rows at most n / block keys are held so often, so these go to where the rows are, which are dealt out only once
    often = F.broadcast(there.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    held = there.join(often, "key", "left").select("key", F.pmod(F.xxhash64("y.id"), blocks).alias("block"), "y")
    return asked.join(often, "key", "left").select("key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "x"), held


def _met(asked: DataFrame, there: DataFrame, block: int, wanted: Column) -> DataFrame:
    """Rows x of asked and y of there with one key, both structs; keys that many rows hold in blocks."""
    sent, held = _dealt(asked, there, block)
    return sent.join(held, ["key", "block"]).filter((F.col("x.id") != F.col("y.id")) & wanted)


_SIZED = ("id", "fresh", "wide", "n", "low", "high", "three_low", "three_high", "clean")


def _pieces(across: bool, some: int = 500_000):
    """Pairs of names with one key of which one may nearly be a piece of the other; of a key and block, held rows come first."""

    def close(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a is a tenth of its characters from a piece of b; of equally long texts each is tried as the shorter."""
        n, m = c["n"][a], c["n"][b]
        here, at = np.unique(np.r_[a, b], return_inverse=True)
        texts, (i, j) = c["clean"][here].tolist(), (at[: len(a)], at[len(a) :])
        fits, even = _edits(texts, texts, i, j) <= n // 10, np.flatnonzero(n == m)
        fits[even] |= _edits(texts, texts, j[even], i[even]) <= n[even] // 10
        return fits | (m > 64)

    def may(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        short = c["n"][x] <= c["n"][y]
        a, b = np.where(short, x, y), np.where(short, y, x)
        lost = lambda low, high: sum(np.bitwise_count(c[k][a] & ~c[k][b]).astype(np.int64) for k in (low, high))
        fits = (lost("three_low", "three_high") <= 3 * (c["n"][a] // 10)) & (c["id"][x] != c["id"][y])
        x, y, a, b, at = x[fits], y[fits], a[fits], b[fits], np.flatnonzero(fits)
        fresh = (c["fresh"][x] != c["fresh"][y]) if across else (c["fresh"][x] | c["fresh"][y])
        fits = (lost("low", "high") * 21 <= 2 * c["n"][a]) & fresh & (c["wide"][x] | (c["id"][x] < c["id"][y]))
        return at[fits][close(c, a[fits], b[fits])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: v.to_numpy(zero_copy_only=False) for k, v in zip(batch.schema.names, batch.columns, strict=True)}
            c = {k: np.concatenate([kept[k], v]) if kept else v for k, v in c.items()}
            starts = np.flatnonzero(np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["block"][1:] != c["block"][:-1])])
            held = np.add.reduceat((~c["asks"]).astype(np.int64), starts)
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(c["key"])]))
            asking = np.flatnonzero(c["asks"] & (held[of] > 0))
            total = np.cumsum(held[of[asking]])
            done = 0
            while done < len(asking):
                # as many asking rows as make some pairs, one at least
                to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + some, "right")))
                mine = asking[done:to]
                n = held[of[mine]]
                x = np.repeat(mine, n)
                y = np.arange(len(x)) + np.repeat(starts[of[mine]] - (np.cumsum(n) - n), n)
                bits = {k: v.view(np.uint64) if k in ("low", "high", "three_low", "three_high") else v for k, v in c.items()}
                at = may(bits, x, y)
                one, two = c["id"][x[at]], c["id"][y[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])
                done = to
            last = starts[-1] + np.flatnonzero(~c["asks"][starts[-1] :])
            kept = {k: v[last] for k, v in c.items()}

    return run


def _nearly(asked: DataFrame, there: DataFrame, block: int, parts: int, across: bool) -> DataFrame:
    """(a, b) of names that share a key of two words and may nearly be pieces of each other, from (key, x) and (key, y). All that
    ask meet all that is held of a key, so blocks are smaller here, and pairs of a task stay few."""
    sent, held = _dealt(asked, there, block)
    rows = held.select("key", "block", F.lit(False).alias("asks"), "y.*").unionByName(sent.select("key", "block", F.lit(True).alias("asks"), "x.*"))
    return rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "asks").mapInArrow(_pieces(across), "a long, b long")


def similar_pairs(rows: DataFrame, block: int = BLOCK, fresh: str | None = None, across: bool = False) -> DataFrame:
    """(a, b): ids a < b of distinct cleaned names that are similar, from (id, clean, short); short is the acronym.

    fresh: a boolean column of rows; only pairs with a fresh name are looked for, or, across, with one that is and one that isn't.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.filter("clean <> ''").select("id", (F.col(fresh) if fresh else F.lit(True)).alias("fresh"), "clean", "short").repartition(parts)
    one = stored(kept.select("*", _features("clean").alias("f")).select("id", "fresh", "clean", "short", "f.*"), "names")
    wanted = F.col("x.fresh") != F.col("y.fresh") if across else F.col("x.fresh") | F.col("y.fresh")
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    long_of = lambda words: F.length(F.array_join(words, " "))

    def keyed(df: DataFrame, side: str, kind: int, key: Column, words: Column | None = None, text: Column | None = None) -> DataFrame:
        """One side of the meetings of a kind; what travels with a key is what the kind's condition reads."""
        none = F.lit(None)
        of = F.struct("id", "fresh", F.lit(kind).alias("kind"), (none if words is None else words).cast("array<string>").alias("words"), (none if text is None else text).cast("string").alias("text"))
        return df.select(F.xxhash64(F.lit(kind), key).alias("key"), of.alias(side))

    # contained and shared words: 0 one word, 3 one word of wide names, 4 two words
    key, words = F.col("key"), F.col("words")
    wide = F.size("words") > WIDE
    two = F.flatten(F.transform("words", lambda w, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda v: F.concat_ws(" ", w, v))))
    held = one.select(F.explode("words").alias("key"), "id", "fresh", "words")
    counts = stored(held.groupBy("key").agg(F.count("*").alias("n")), "words")
    ranked = held.select("id", "key").join(counts, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("ranked"))
    asks = stored(ranked.select("id", _asks(F.col("ranked.key")).alias("f")).select("id", "f.*").join(one.select("id", "fresh", "words"), "id"), "asks")
    asked_by = lambda c: asks.select(F.explode(c).alias("key"), "id", "fresh", "words")
    paired = one.filter(~wide).select(F.explode(two).alias("key"), "id", "fresh", "words")
    both = long_of(F.array_intersect("x.words", "y.words"))
    by_word = 100.0 * 2 * both / (both + long_of(F.col("x.words"))) >= 92

    # 1: one text inside the other
    own, other = (F.array_distinct(F.filter(F.split(f"{side}.text", BLANKS), lambda w: w != "")) for side in ("x", "y"))
    clean = F.col("clean")
    inside, edges = (one.select(F.explode(c).alias("key"), "id", "fresh", "clean") for c in ("asked", "edges"))
    by_text = F.contains("y.text", "x.text") & (F.size(F.array_intersect(own, other)) >= F.greatest(F.lit(1), F.least(F.size(own), F.size(other)) - 1))

    # 2: acronyms
    brief = F.replace("clean", F.lit(" "), F.lit(""))
    several = one.filter(F.length("clean") <= 5), one.filter("short <> '' and size(words) > 1")

    asking = keyed(asked_by("alone"), "x", 0, key, words).unionByName(keyed(asked_by("rarest"), "x", 3, key, words)).unionByName(keyed(asked_by("pairs"), "x", 4, key, words))
    asking = asking.unionByName(keyed(inside, "x", 1, key, text=clean)).unionByName(keyed(several[0], "x", 2, brief, text=brief))
    there = keyed(held, "y", 0, key, words).unionByName(keyed(held.filter(wide), "y", 3, key, words)).unionByName(keyed(paired, "y", 4, key, words))
    there = there.unionByName(keyed(edges, "y", 1, key, text=clean)).unionByName(keyed(several[1], "y", 2, F.col("short"), text=F.col("short")))
    holds = F.when(F.col("x.kind").isin(0, 3, 4), by_word).when(F.col("x.kind") == 1, by_text).otherwise(F.col("x.text") == F.col("y.text"))
    sure = _met(asking, there, block, wanted & (F.col("x.kind") == F.col("y.kind")) & holds).select(*pair)

    # nearly a piece of the other, with two words shared
    text = F.col("texts")[0]
    sized = one.filter("size(words) > 2").select("words", "id", "fresh", F.length("clean").cast("long").alias("n"), text["low"].alias("low"), text["high"].alias("high"), "three_low", "three_high", "clean")
    # keys of two words hold a blank, those of one word don't
    as_side = lambda df, side: df.withColumn("wide", wide).select(F.xxhash64("key").alias("key"), F.struct(*_SIZED).alias(side))
    narrow, single = sized.filter(~wide).select("*", F.explode(two).alias("key")), sized.select("*", F.explode("words").alias("key"))
    by_two = _nearly(as_side(narrow, "x").unionByName(as_side(single.filter(wide), "x")), as_side(narrow, "y").unionByName(as_side(single, "y")), max(1, block // 8), parts, across)

    near = stored(_alike(one, block, across).select(F.least("id", "of").alias("a"), F.greatest("id", "of").alias("b"), "sure"), "near")
    sure = stored(sure.unionByName(near.filter("sure").select("a", "b")).distinct(), "sure")
    whole, piece = (F.lit(k).alias("piece") for k in (False, True))
    asked = near.filter("not sure").select("a", "b", whole).unionByName(by_two.select("a", "b", piece)).distinct().join(sure, ["a", "b"], "left_anti")
    side = lambda s: one.select(F.col("id").alias(s), F.col("clean").alias(f"{s}_clean"))
    # rows are few bytes but take long, so they are dealt by number; a filter would be moved ahead of that
    read = asked.join(side("a"), "a").join(side("b"), "b").repartition(parts)
    return sure.unionByName(read.mapInPandas(_read, "a long, b long").distinct())
