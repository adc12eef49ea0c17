"""Removal of repeated 100-byte strings by run-length indexes over the passages that may repeat.

Each byte that lies in a string of `length` bytes which also starts earlier (smaller doc_id, or earlier in the same
document) is removed. No task sees the corpus; equal strings meet in three steps, each exact:

1. Every window of `length` bytes names an anchor, the least hashed k-gram inside it, so equal windows have equal
   anchors at equal places. Windows in a row with one anchor form a passage: (anchor, digest of the passage's
   bytes, place). Inside a task, passages met before are marked at once and not sent on: those that a chunk of
   documents repeats, and in later chunks those that were repeated often. So a passage that a third of all documents
   holds is a few rows for each task, whatever its size.
2. Passages are grouped by anchor and digest. All but the first of equal passages are marked.
3. Different passages with one anchor may still share windows (around edits, or where a quotation begins). Two that
   share a window have the `near` bytes left or right of the anchor in common, so they are dealt by these. Each
   task builds a run-length index of what it was dealt: suffixes are ordered to the depth `length`, the
   Burrows-Wheeler transform is kept as runs with the rows of the passages' ends sampled, and rows between which
   `length` bytes agree form intervals that know their first place. Passages are streamed backwards through the
   index, run by run; wherever the interval's first place is earlier than their own, the window is marked.
   Groups are counted before they are dealt: those of more than `crowd` passages go through a grouping of their
   single windows instead, so no task holds or streams one.

Marks are gathered for each document and its bytes are cut.

Defined results: null and empty texts have no bytes; texts shorter than `length` stay; null ids count as smaller than
all others; rows with equal ids form one document as far as order goes (none of them is earlier at the same place),
and what is marked in one of them is cut in each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

LENGTH, GRAM, CROWD = 100, 32, 20_000
CHUNK = 6_000_000
#: Times that a chunk has a passage for its task to remember it, and passages that a task remembers. These decide what is
#: sent on, never what is marked.
OFTEN, REMEMBERED = 16, 200_000
LOWEST = -(2**63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of k bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def passages(texts: list[bytes], length: int, k: int) -> dict[str, np.ndarray]:
    """For each passage: text (index), start, windows (their number), at (the anchor's place from start), anchor and
    digest (hashes)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    names = ("text", "start", "windows", "at", "anchor", "digest")
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return {n: np.zeros(0, np.int64) for n in names}
    whole = b"".join(texts[i] for i in long)
    data = np.frombuffer(whole, np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes[long])[:-1]])
    grams = _grams(data, k)
    least = _sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    inside = sizes[long] - length + 1
    owner = np.repeat(np.arange(len(long)), inside)
    place = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside) + begins[owner]
    anchor_at = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor_at[1:] != anchor_at[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    start, own = place[first], owner[first]
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(whole)
    hashes = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)], np.uint64)
    at = anchor_at[first]
    return {"text": long[own], "start": start - begins[own], "windows": count, "at": at - start, "anchor": grams[at].view(np.int64), "digest": hashes.view(np.int64)}


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts as bytes) of some megabytes each."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= chunk:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


FOUND = "id long, start int, windows short, at short, anchor long, digest long, again boolean"


def find(docs: DataFrame, length: int, k: int) -> DataFrame:
    """All passages; again: the same task has met an equal one that starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = {n: np.zeros(0, np.int64) for n in ("name", "anchor", "digest", "id", "start")}
        for ids, texts in _chunks(batches, CHUNK):
            p = passages(texts, length, k)
            who = ids[p["text"]]
            order = np.lexsort((p["start"], who, p["digest"], p["anchor"]))
            a, d, w, s = (x[order] for x in (p["anchor"], p["digest"], who, p["start"]))
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])[: len(a)]
            top = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            again = (w != w[top]) | (s != s[top])
            firsts = np.flatnonzero(new)
            name = a[firsts] ^ (d[firsts] * np.int64(0x5851F42D4C957F2D))
            at = np.minimum(np.searchsorted(often["name"], name), max(len(often["name"]) - 1, 0))
            known = np.zeros(len(firsts), bool)
            if len(often["name"]) and len(firsts):
                known = (often["anchor"][at] == a[firsts]) & (often["digest"][at] == d[firsts])
                id_then, start_then = often["id"][at], often["start"][at]
                earlier = known & ((id_then < w[firsts]) | ((id_then == w[firsts]) & (start_then < s[firsts])))
                again |= earlier[np.cumsum(new) - 1]
                sooner = known & ~earlier
                often["id"][at[sooner]], often["start"][at[sooner]] = w[firsts[sooner]], s[firsts[sooner]]
            count = np.diff(np.append(firsts, len(a)))
            more = firsts[(count >= OFTEN) & ~known][: REMEMBERED - len(often["name"])]
            if len(more):
                added = {"name": a[more] ^ (d[more] * np.int64(0x5851F42D4C957F2D)), "anchor": a[more], "digest": d[more], "id": w[more], "start": s[more].astype(np.int64)}
                often = {n: np.concatenate([often[n], added[n]]) for n in often}
                by = np.argsort(often["name"], kind="stable")
                often = {n: x[by] for n, x in often.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(w), pa.array(s.astype(np.int32)), pa.array(p["windows"][order].astype(np.int16)), pa.array(p["at"][order].astype(np.int16)), pa.array(a), pa.array(d), pa.array(again)],
                ["id", "start", "windows", "at", "anchor", "digest", "again"],
            )

    return docs.select("id", "text").mapInArrow(run, FOUND)


# --- the run-length index --------------------------------------------------------------------------------------


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of passages, with sampled ends and intervals of agreeing rows.

    order: a number for each passage by which its place precedes others'. Rows are suffixes of the joined passages,
    each closed by a sign of its own order, sorted to the depth of `length` symbols (ties in any order inside an
    interval of agreeing windows, which is all that is asked of them).
    """

    def __init__(self, texts: list[bytes], order: np.ndarray, length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum() + len(texts))
        symbols = np.zeros(n, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        body = np.ones(n, bool)
        body[ends] = False
        symbols[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        rank, depth = symbols, 1
        while depth < length:
            step = min(depth, length - depth)
            rank = self._deepen(rank, step, n, ends, owner)
            depth += step
        # rows: suffixes by their ranks; rows of one rank agree in `length` symbols. Ranks don't separate further.
        rows = np.argsort(rank, kind="stable")
        before = np.where(rows > 0, symbols[rows - 1], 0)
        before[np.isin(rows, np.concatenate([[0], ends[:-1] + 1]))] = 0
        # intervals of agreeing rows and the earliest passage of each that holds the window whole
        ranked = rank[rows]
        self.starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        left = ends[owner[rows]] - rows
        place = np.where(left >= length, order[owner[rows]], np.iinfo(np.int64).max)
        self.first = np.minimum.reduceat(place, self.starts)
        # sampled rows: where each passage's last window starts. Runs are rows with one symbol before them that step
        # back side by side; ties in the order may cut a run of the transform in two. A run keeps its symbol (0 before a
        # passage's begin) and the row that its first row steps back to.
        row_of = np.empty(n, np.int64)
        row_of[rows] = np.arange(n)
        self.sampled = row_of[np.maximum(ends - length, 0)]
        self.sizes, self.length = sizes, length
        stepped = row_of[np.maximum(rows - 1, 0)]
        broken = np.concatenate([[True], (before[1:] != before[:-1]) | (stepped[1:] != stepped[:-1] + 1)])
        self.runs = np.flatnonzero(broken)
        self.symbols, self.back = before[self.runs], stepped[self.runs]

    @staticmethod
    def _deepen(rank: np.ndarray, step: int, n: int, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Ranks by the first symbols and what stands `step` further; past a passage's end there is nothing."""
        further = np.arange(n) + step
        inside = further <= ends[owner]
        second = np.zeros(n, np.int64)
        second[inside] = rank[further[inside]] + 1
        key = rank * (int(rank.max()) + 2) + second
        _, out = np.unique(key, return_inverse=True)
        return out

    def stream(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """From the last window of each passage to its first: (how many from the last, passages, their windows' first
        places)."""
        alive = np.flatnonzero(self.sizes >= self.length)
        row, back = self.sampled[alive], 0
        while len(alive):
            yield back, alive, self.first[np.searchsorted(self.starts, row, "right") - 1]
            run = np.searchsorted(self.runs, row, "right") - 1
            more = self.symbols[run] != 0
            alive, row, run = alive[more], row[more], run[more]
            row, back = self.back[run] + row - self.runs[run], back + 1


def repeats(texts: list[bytes], order: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(passage, first window, windows) of the runs of windows that an earlier passage has too."""
    index = RunIndex(texts, order, length)
    hits = []
    for back, who, first in index.stream():
        found = who[first < order[who]]
        if len(found):
            hits.append((found, index.sizes[found] - length - back))
    if not hits:
        return []
    who, at = (np.concatenate(x) for x in zip(*hits, strict=True))
    by = np.lexsort((at, who))
    who, at = who[by], at[by]
    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.concatenate([new, [len(at)]]))
    return list(zip(who[new].tolist(), at[new].tolist(), count.tolist(), strict=True))


FIRST = "id long, start int, windows int, at int, anchor long, later boolean"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (again, anchor, digest, id, start) -> what is not the first of equal passages (later), and the
    first of each kind of passage of an anchor that has several kinds.

    Only the last row, the first of its kind, and whether its anchor had several kinds go from batch to batch, so an
    anchor of any number of rows streams through.
    """
    state = None  # (anchor, digest, id, start) of the last first row; its row if that is still unsent

    for batch in batches:
        c = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
        n = len(c["id"])
        if not n:
            continue
        again = c["again"].astype(bool)
        anchor, digest, who, start = c["anchor"], c["digest"], c["id"], c["start"]
        new_anchor, new_kind = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_kind[1:] = new_anchor[1:] | (digest[1:] != digest[:-1])
        new_anchor[again] = new_kind[again] = False
        fresh = np.flatnonzero(~again)
        sent = []
        if len(fresh):
            f = fresh[0]
            new_anchor[f] = state is None or anchor[f] != state["anchor"]
            new_kind[f] = new_anchor[f] or digest[f] != state["digest"]
        # place of the first row of each row's kind; -1: it came in an earlier batch
        top = np.maximum.accumulate(np.where(new_kind, np.arange(n), -1))
        first_id, first_start = np.where(top < 0, state["id"] if state else 0, who[top]), np.where(top < 0, state["start"] if state else 0, start[top])
        later = again | (~new_kind & ((who != first_id) | (start != first_start)))
        # kinds of anchors that have several: all but an anchor's first kind surely, that one if another follows
        kinds = np.flatnonzero(new_kind)
        opens = new_anchor[kinds]
        follows = np.concatenate([~opens[1:], [False]]) if len(kinds) else np.zeros(0, bool)
        several = kinds[~opens | follows]
        if len(kinds) and not opens[0] and state and state["row"] is not None:
            sent.append(state["row"])
        keep = np.zeros(n, bool)
        keep[several] = True
        if len(kinds):
            k = kinds[-1]
            unsent = None if keep[k] else tuple(int(c[x][k]) for x in ("id", "start", "windows", "at", "anchor"))
            state = {"anchor": anchor[k], "digest": digest[k], "id": who[k], "start": start[k], "row": unsent}
        take = np.flatnonzero(later | keep)
        columns = [np.concatenate([[r[m] for r in sent], c[x][take]]) for m, x in enumerate(("id", "start", "windows", "at", "anchor"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0].astype(np.int64)), *[pa.array(x.astype(np.int32)) for x in columns[1:4]], pa.array(columns[4].astype(np.int64)), pa.array(np.concatenate([np.zeros(len(sent), bool), later[take]]))],
            ["id", "start", "windows", "at", "anchor", "later"],
        )


MARKED = "id long, start int, windows int"
GROUP = ["anchor", "side", "near"]


def _resolve(length: int, most_bytes: int = 1_500_000):
    """Rows sorted by group -> (id, start, windows) of marked windows. Groups of one passage say nothing; several groups of
    some bytes share an index."""

    def settle(rows: list[dict]) -> pa.RecordBatch:
        # one passage may come in two groups; it is indexed once
        unique = list({(r["id"], r["start"]): r for r in rows}.values())
        places = np.array([(r["id"], r["start"] + r["at"]) for r in unique], np.int64)
        by = np.lexsort((places[:, 1], places[:, 0]))
        order = np.empty(len(unique), np.int64)
        order[by] = np.concatenate([[0], np.cumsum((places[by][1:] != places[by][:-1]).any(1))])
        marked = [(unique[w]["id"], unique[w]["start"] + a, count) for w, a, count in repeats([r["body"] for r in unique], order, length)]
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in marked], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["id", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        group: list[dict] = []
        last, size = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                name = tuple(r[n] for n in GROUP)
                if name != last:
                    if len(group) > 1:
                        held += group
                        size += sum(len(x["body"]) for x in group)
                    group, last = [], name
                    if size >= most_bytes:
                        yield settle(held)
                        held, size = [], 0
                group.append(r)
        if len(group) > 1:
            held += group
        if held:
            yield settle(held)

    return run


def _bodies(length: int, k: int):
    """Documents beside the passages asked of them -> passages with bytes, for the sides on which others can agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = (length - k + 1) // 2
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("anchor", "side", "near", "id", "start", "at", "body")}
            for who, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for q in asked:
                    body = text[q["start"] : q["start"] + q["windows"] + length - 1]
                    at = q["at"]
                    for side, part in (("l", body[at - near : at] if at >= near else None), ("r", body[at + k : at + k + near] if len(body) >= at + k + near else None)):
                        if part is not None:
                            for n, v in zip(out, (q["anchor"], side, _signed(xxhash.xxh3_64_intdigest(part)), who, q["start"], at, body), strict=True):
                                out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], list(out))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def marks(docs: DataFrame, length: int = LENGTH, k: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(id, start, windows): runs of windows that start earlier too. docs: (id long without nulls, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what its own task has seen before only passes through, so it is spread by document and not sent to its anchor
    spread = F.when(F.col("again"), F.xxhash64("id", "start")).otherwise(F.col("anchor"))
    dealt = find(docs, length, k).repartition(parts, spread).sortWithinPartitions("again", "anchor", "digest", "id", "start")
    classes = common.store(dealt.mapInArrow(_classes, FIRST), "passages")
    equal = classes.filter("later").select("id", "start", "windows")
    by_doc = classes.filter("not later").groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "windows", "at")).alias("asked"))
    bodies = docs.join(by_doc, "id").select("id", "text", "asked").mapInArrow(_bodies(length, k), "anchor long, side string, near long, id long, start int, at int, body binary")
    bodies = common.store(bodies, "bodies")
    # at most one group for each `crowd` passages, so a few numbers
    hot = common.store(bodies.groupBy(*GROUP).count().filter(F.col("count") > crowd).select(*GROUP), "crowds")
    grouped = bodies.join(hot, GROUP, "left_anti").repartition(parts, *GROUP).sortWithinPartitions(*GROUP)
    resolved = common.store(grouped.mapInArrow(_resolve(length), MARKED), "resolved")
    return equal.unionByName(resolved).unionByName(_crowded(bodies.join(hot, GROUP, "left_semi"), length))


def _crowded(dealt: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for a task: their windows one by one, with the first place of each."""
    single = dealt.select("id", "start", "at", "anchor", F.explode(F.sequence(F.lit(0), F.length("body") - length)).alias("w"), "body")
    single = single.select("id", "start", "at", "w", "anchor", F.sha2(F.substring("body", F.col("w") + 1, F.lit(length)), 256).alias("window"))
    place = F.struct("id", (F.col("start") + F.col("at")).alias("place"))
    firsts = single.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = common.salted_join(single, firsts, ["window"], "id").filter(place > F.col("first"))
    return late.select("id", (F.col("start") + F.col("w")).cast("int").alias("start"), F.lit(1).alias("windows"))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, starts, windows in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text or b""
                pieces, at, removed, runs = [], 0, 0, 0
                if starts:
                    edge = np.zeros(len(text) + 1, np.int32)
                    a = np.minimum(np.array(starts), len(text))
                    np.add.at(edge, a, 1)
                    np.add.at(edge, np.minimum(a + np.array(windows) + length - 1, len(text)), -1)
                    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                    turns = np.flatnonzero(covered[1:] != covered[:-1])
                    for x, y in turns.reshape(-1, 2).tolist():
                        pieces.append(text[at:x])
                        at, removed, runs = y, removed + y - x, runs + 1
                sizes.append(len(text))
                gone.append(removed)
                spans.append(runs)
                kept.append(b"".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for each row; kept is the remaining bytes."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("id"), F.col(text).alias("text"))
    found = common.store(marks(rows.filter(F.length("text") > 0), length, k, crowd), "marks")
    by_doc = found.groupBy("id").agg(F.collect_list(F.struct("start", "windows")).alias("m"))
    beside = rows.join(by_doc, "id", "left").select("id", "text", F.col("m.start").alias("starts"), F.col("m.windows").alias("windows"))
    cut = beside.mapInArrow(_cut(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(F.when(F.col("id") != LOWEST, F.col("id")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
