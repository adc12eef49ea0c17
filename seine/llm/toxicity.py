"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words is the sum, over all strings u of four symbols, of the weights of u's occurrences as a
gapped subsequence in either, an occurrence over a span of n symbols weighing DECAY ** n; it is normalised. A sign
marks each word's begin, and the end of a word of three letters, which has no other string. So an insult with letters
inserted or left out keeps most of its likeness. Signs between letters are left out, digits that stand for letters are
read as these, and accents are taken off.

A linear SVM of squared hinge loss learns from sentences of labelled texts. A sentence is what its worst word is, the
one of greatest margin (its witness): clean sentences are examples against, toxic texts' sentences are examples for if
their witness has a positive margin or is the text's worst, and is a witness in far more toxic than clean sentences.
Witnesses depend on the model, so it is fitted ROUNDS times; the first time witnesses are the words that stand, or
whose beginnings stand, in far more different sentences of toxic texts than of clean ones. A word is seen through its
likeness to landmarks, witnesses that differ from each other, whitened by their own kernel matrix (Nyström).

A word's margin is linear in its weights of the strings u, apart from its norm. Landmarks, whitening and SVM are
therefore folded into one number for each u, so scoring a word is a sum over its gapped strings, whatever the number
of landmarks. Words are scored once for each Python worker. A text's greatest margins, and how many of its words
have a positive one, go into a logistic layer fitted on the labelled texts, which gives the score.

Bounds: at most SAMPLE labelled texts of each label are learnt from, taken by hash; of their sentences' witnesses at
most POSITIVES and NEGATIVES words with the numbers of their sentences, and a few numbers for each sampled text, reach
the driver, never texts.

Defined results: null and empty texts, and texts without a word, get the score of no margin; labels that are null or
not 0 or 1 are left out, a doc_id with both labels counts as toxic; without labels of both kinds every score is 0;
rows with equal texts are scored alike, and learnt from once; texts of any length are scored whole; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

SAMPLE, POSITIVES, NEGATIVES, LANDMARKS, ROUNDS = 4000, 1_000, 8_000, 160, 3
DECAY, LENGTH, SYMBOLS, LONGEST, TOP = 0.6, 4, 32, 20, 4
REMEMBERED = 250_000
#: Standard deviations by which a later witness, or a beginning of it, leans to toxic sentences.
SURE = 3.0
SENTENCE = r"[.!?\n]+\s*"
STRIP = ".,;:!?\"'()[]{}«»„“”‘’…"
SPACED = re.compile(r"(?<!\S)\w(?:[ \-_.*]\w){2,}(?!\w)")
LETTERS = re.compile(r"[^\W\d_]+")
#: Digits and signs that stand for letters inside words.
STANDS_FOR = str.maketrans("013457@$", "oieastas")
ACCENTS = re.compile("[\u0300-\u036f]")
BEGIN, END = 31, 30


# --- words and kernel ----------------------------------------------------------------------------------------


def units(text: str) -> list[str]:
    """The words of a text, lower-cased and without marks around them, and what single symbols with gaps between them spell."""
    text = text.lower()
    found = [w.strip(STRIP) for w in text.split()]
    if (spaced := SPACED.findall(text)):
        found += ["".join(LETTERS.findall(s)) for s in spaced]
    return found


def variants(unit: str) -> list[str]:
    """What is compared for a unit: its stripped form, without inserted signs, in overlapping pieces if it is long."""
    word = unit.strip(STRIP)
    if not word.isalpha() and LETTERS.search(word):
        word = word.translate(STANDS_FOR)
    if not word.isascii():
        word = ACCENTS.sub("", unicodedata.normalize("NFD", word))
    plain = "".join(LETTERS.findall(word)) or word
    if len(plain) <= LONGEST:
        return [plain]
    return [plain[i : i + LONGEST] for i in range(0, len(plain) - LONGEST // 2, LONGEST // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Symbols of equally long words between their signs: a-z are 0-25, letters of other scripts take these places too."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    symbols = np.where((points >= 97) & (points <= 122), points - 97, points % 26)
    signs = [np.full((len(words), 1), BEGIN), symbols, np.full((len(words), 1), END)]
    return np.hstack(signs if symbols.shape[1] == LENGTH - 1 else signs[:2])


def self_kernel(code: np.ndarray) -> np.ndarray:
    """k(w, w) of equally long words: cross_kernel's recursion, of which both halves are the same; words lie side by side."""
    symbols = np.ascontiguousarray(code.T)
    n, rows = symbols.shape
    same = [[(symbols[i] == symbols[j]) * DECAY**2 for j in range(i + 1)] for i in range(n)]
    before = np.ones((n + 1, n + 1, rows))
    for _ in range(LENGTH - 1):
        now = np.zeros((n + 1, n + 1, rows))
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, i + 1):
                run *= DECAY
                run += same[i - 1][j - 1] * before[i - 1, j - 1]
                now[i, j] = DECAY * (now[i - 1, j] if j < i else now[i, i - 1]) + run
                now[j, i] = now[i, j]
        before = now
    total = np.zeros(rows)
    for i in range(n):
        for j in range(i + 1):
            total += (1 + (j < i)) * same[i][j] * before[i, j]
    return total


def cross_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """k(s_i, t_i) for rows of symbols; either side may be one row."""
    rows, n, m = max(len(s), len(t)), s.shape[1], t.shape[1]
    same = (s[:, :, None] == t[:, None, :]).astype(np.float64)
    before = np.ones((rows, n + 1, m + 1))
    for _ in range(LENGTH - 1):
        now = np.zeros((rows, n + 1, m + 1))
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, m + 1):
                run = DECAY * run + DECAY**2 * same[:, i - 1, j - 1] * before[:, i - 1, j - 1]
                now[:, i, j] = DECAY * now[:, i - 1, j] + run
        before = now
    return DECAY**2 * (same * before[:, :-1, :-1]).sum((1, 2))


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gapped(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all gapped strings in n symbols, and their weights."""
    if n not in _PLACES:
        at = np.array(list(combinations(range(n), LENGTH)), np.int64).reshape(-1, LENGTH)
        _PLACES[n] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return _PLACES[n]


def keys(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the string of each gapped place in rows of symbols, and the places' weights."""
    at, weight = gapped(code.shape[1])
    key = code[:, at[:, 0]]
    for k in range(1, LENGTH):
        key = key * SYMBOLS + code[:, at[:, k]]
    return key, weight


def feature(word: str) -> dict[int, float]:
    """The normalised weight of each string in a word."""
    out: dict[int, float] = {}
    if len(word) + 1 >= LENGTH:
        key, weight = keys(codes([word]))
        for k, w in zip(key[0].tolist(), weight.tolist(), strict=True):
            out[k] = out.get(k, 0.0) + w
        norm = sum(w * w for w in out.values()) ** 0.5
        out = {k: w / norm for k, w in out.items()}
    return out


def dot(f: dict[int, float], g: dict[int, float]) -> float:
    return sum(w * g[k] for k, w in f.items() if k in g)


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def sums(words: list[str], tables: np.ndarray) -> np.ndarray:
    """words x tables: the normalised weighted sums of each table's numbers over a word's gapped strings."""
    out = np.zeros((len(words), len(tables)))
    for n, members in by_length(words).items():
        if n + 1 < LENGTH:
            continue
        step = max(1, min(8_000, 1_000_000 // len(gapped(n + 1 + (n == LENGTH - 1))[0])))
        for start in range(0, len(members), step):
            some = members[start : start + step]
            code = codes([words[i] for i in some])
            key, weight = keys(code)
            norm = np.sqrt(self_kernel(code))
            for k, values in enumerate(tables):
                out[some, k] = (values[key] @ weight) / norm
    return out


# --- learning ------------------------------------------------------------------------------------------------


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    rate = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + ridge)
    w = z = np.zeros(x.shape[1])
    for step in range(steps):
        gap = np.maximum(0, 1 - y * (x @ z))
        grad = -2 * (x.T @ (weight * y * gap)) + ridge * np.append(z[:-1], 0)
        w, last = z - rate * grad, w
        z = w + step / (step + 3) * (w - last)
    return w[:-1], float(w[-1])


def landmarks(positive: list[str], negative: list[str], most: int) -> list[dict[int, float]]:
    """Features of the words to compare with: toxic ones that differ from each other, then clean ones."""
    features: list[dict[int, float]] = []
    for words, bound in ((positive, most * 2 // 3), (negative, most)):
        for w in words:
            if len(features) >= bound:
                break
            f = feature(w)
            if f and all(dot(f, g) < 0.9 for g in features):
                features.append(f)
    return features


def likeness(words: list[str], marks: list[dict[int, float]]) -> np.ndarray:
    """words x marks: the kernel of each word with each mark."""
    strings = {k: i for i, k in enumerate(sorted({k for f in marks for k in f}), 1)}
    place = np.zeros(SYMBOLS**LENGTH, np.int32)
    place[list(strings)] = list(strings.values())
    weights = np.zeros((len(strings) + 1, len(marks)), np.float32)
    for j, f in enumerate(marks):
        weights[[strings[k] for k in f], j] = list(f.values())
    out = np.zeros((len(words), len(marks)))
    for n, members in by_length(words).items():
        if n + 1 < LENGTH:
            continue
        step = max(1, 2_000_000 // (len(gapped(n + 1)[0]) * len(marks)))
        for start in range(0, len(members), step):
            some = members[start : start + step]
            code = codes([words[i] for i in some])
            key, weight = keys(code)
            out[some] = np.einsum("wpm,p->wm", weights[place[key]], weight) / np.sqrt(self_kernel(code))[:, None]
    return out


def fold(positive: dict[str, int], negative: dict[str, int], n_landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """(table, bias): the SVM over Nyström features, folded into one number for each string. The examples are sentences, given
    by their witnesses and how many sentences have each; a witness counts with the root of that."""
    words = [*positive, *negative]
    marks = landmarks([*positive], [*negative], n_landmarks)
    gram = np.array([[dot(f, g) for g in marks] for f in marks])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-8
    white = vectors[:, keep] / np.sqrt(values[keep])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    share = lambda counts: np.sqrt(np.array([*counts.values()], float))
    weight = np.concatenate([w / w.sum() for w in (share(positive), share(negative))])
    w, bias = fit_svm(likeness(words, marks) @ white, y, weight)
    out = np.zeros(SYMBOLS**LENGTH)
    for f, alpha in zip(marks, white @ w, strict=True):
        for k, v in f.items():
            out[k] += alpha * v
    return out, bias


def fit_logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients, the last one of the constant, by damped Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    ridge = np.diag([1e-3] * (x.shape[1] - 1) + [1e-6])
    p = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (weight * (q - label)) + ridge @ p
        p = p - 0.7 * np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-5))[:, None]).T @ x + ridge, grad)
    return p


def bag(margins: list[float]) -> list[float]:
    """What the logistic layer sees of a text: its greatest margins, and the number and share of positive ones."""
    values = np.array(margins) if margins else np.zeros(0)
    top = np.sort(values[np.argpartition(values, -TOP)[-TOP:]] if len(values) > TOP else values)[::-1]
    top = np.concatenate([np.clip(top, -1.5, 1.5), np.full(TOP - len(top), -1.5)])
    above = int((values > 0).sum())
    return [*top.tolist(), np.log1p(above), min(1.0, 20 * above / max(len(values), 1)), np.log1p(len(values)) / 10]


class Model:
    """The folded table, bias and logistic layer; some megabytes, whatever was learnt from."""

    def __init__(self, values: np.ndarray, bias: float, layer: np.ndarray | None = None):
        self.values, self.bias, self.layer = values.astype(np.float32), bias, layer
        self.name = hashlib.sha256(self.values.tobytes()).hexdigest()

    def margins(self, fresh: list[str]) -> list[float]:
        pieces = [(i, v) for i, u in enumerate(fresh) for v in variants(u)]
        out = np.full(len(fresh), self.bias)
        if pieces:
            got = sums([v for _, v in pieces], self.values[None, :])[:, 0] + self.bias
            np.maximum.at(out, [i for i, _ in pieces], got)
        return out.tolist()


def known_to(model: Model) -> dict[str, float]:
    """Margins of words that this Python worker has met, by one model at a time."""
    return common.remembered(("margins", model.name), dict)


def _judge(shared):
    """Batches whose first column is text -> that column replaced by (features of the bag, its worst word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = known_to(model)
        for batch in common.slices(batches, 2_000):
            bags, tops = [], []
            for start in range(0, batch.num_rows, 400):
                cut = [units(t or "") for t in batch.column(0).slice(start, 400).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                fresh = list({u for words in cut for u in words if u not in known})
                known.update(zip(fresh, model.margins(fresh), strict=True))
                for words in cut:
                    margins = list(map(known.__getitem__, words))
                    bags.append(bag(margins))
                    tops.append(max(variants(words[margins.index(max(margins))]), key=len) if margins else "")
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.float64())), pa.array(tops, pa.string()), *batch.columns[1:]], ["bag", "top", *batch.schema.names[1:]])

    return run


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, learn, sample: int) -> DataFrame:
    """(text, label) of at most `sample` texts of each label, by hash of the key; equal texts count once."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max("toxic").cast("int").alias("label"))
    marks = marks.filter(F.col("key").isNotNull() & learn(F.col("key")))
    chosen = None
    for label in (0, 1):
        some = marks.filter(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # chosen holds two times `sample` keys at most
    return rows.join(F.broadcast(chosen), "key").groupBy(F.sha2("text", 256).alias("of")).agg(F.first("text").alias("text"), F.max("label").alias("label"))


def sentences_of(sample: DataFrame) -> DataFrame:
    """(s, of, label): the different sentences of the texts, each with a text that has it. One that a clean text has is clean."""
    rows = sample.select("of", "label", F.explode(F.split(F.lower("text"), SENTENCE)).alias("s")).filter(F.length("s") > 2)
    return rows.groupBy("s").agg(F.min("of").alias("of"), F.min("label").alias("label"))


def word_counts(sentences: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many different sentences of toxic and of clean texts a word stands."""
    found = sentences.select("label", F.explode(F.array_distinct(F.split("s", r"[^\p{L}\p{M}]+"))).alias("word")).filter(F.length("word") >= LENGTH - 1)
    return found.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def indicative(counts: DataFrame, ratio: float) -> DataFrame:
    """counts with z, how far a word, or the beginning of it that does so most, leans to toxic sentences."""
    lean = (F.col("toxic") - ratio * F.col("clean")) / F.sqrt(F.col("toxic") + ratio**2 * F.col("clean") + 1e-9)
    begins = F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.lit(9), F.length("word")))), lambda n: F.substring("word", F.lit(1), n))
    flat = counts.select("word", "toxic", "clean", F.explode(begins).alias("begin"))
    by = flat.groupBy("begin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).select("begin", lean.alias("z"))
    best = flat.select("word", "begin").join(by, "begin").groupBy("word").agg(F.max("z").alias("of_begin"))
    return counts.withColumn("own", lean).join(best, "word").select("word", "toxic", "clean", F.greatest("own", "of_begin").alias("z"))


def _plain(counts: dict[str, int]) -> dict[str, int]:
    """Counts by what is compared of the words."""
    out: dict[str, int] = {}
    for w, n in counts.items():
        for v in variants(w):
            if len(v) + 1 >= LENGTH:
                out[v] = out.get(v, 0) + n
    return out


def first_witnesses(sentences: DataFrame) -> tuple[dict[str, int], dict[str, int], float] | None:
    """(for, against, ratio): the words to begin with, with numbers of sentences; None without both labels. ratio: toxic
    sentences for each clean one."""
    counts = common.store(word_counts(sentences), "toxicity-words")
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not total.t or not total.c:
        return None
    ratio = total.t / total.c
    leaning = indicative(counts, ratio).filter(F.col("toxic") > 3 * ratio * F.col("clean")).orderBy(F.desc("z"), F.desc("toxic"), "word").limit(POSITIVES).collect()
    sure = next((found for least in (5.0, 4.0, 3.0) if len(found := [r for r in leaning if r.z >= least]) >= 30), leaning[:30])
    positive = _plain({r.word: r.toxic for r in sure})
    often = counts.filter("clean > 0").orderBy(F.desc(F.log2(F.col("clean")) + F.pmod(F.xxhash64("word"), F.lit(1000)) / 100), "word").limit(NEGATIVES).collect()
    negative = {w: n for w, n in _plain({r.word: r.clean for r in often}).items() if w not in positive}
    return (positive, negative, ratio) if positive and negative else None


def witnesses(sentences: DataFrame, model: Model, ratio: float) -> tuple[dict[str, int], dict[str, int]]:
    """(for, against): the witnesses of labelled sentences by a model, with numbers of sentences."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)
    judged = sentences.select("s", "of", "label").mapInArrow(_judge(shared), "bag array<double>, top string, of string, label int")
    judged = common.store(judged.select("top", "of", "label", F.get("bag", F.lit(0)).alias("margin")).filter("top <> ''"), "toxicity-witnesses")
    worst = judged.filter("label = 1").groupBy("of").agg(F.max("margin").alias("worst"))
    toxic = judged.filter("label = 1").join(worst, "of").filter("margin > 0 or margin = worst").groupBy(F.col("top").alias("word")).agg(F.count("*").alias("toxic"))
    clean = judged.filter("label = 0").groupBy("top").agg(F.count("*").alias("c"), F.max("margin").alias("margin"))
    counts = common.store(toxic.join(clean.withColumnRenamed("top", "word"), "word", "left").select("word", "toxic", F.coalesce("c", F.lit(0)).alias("clean")), "toxicity-leaning")
    leaning = indicative(counts, ratio).filter((F.col("z") >= SURE) & (F.col("toxic") > 3 * ratio * F.col("clean")))
    positive = {r.word: r.toxic for r in leaning.orderBy(F.desc("toxic"), "word").limit(POSITIVES).collect()}
    against = clean.orderBy(F.desc("margin"), "top").limit(NEGATIVES).collect()
    return positive, {r.top: r.c for r in against if r.top not in positive}


def train(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """A model from labelled rows whose key `learn` (a function of columns) lets through; None without both labels."""
    share = {r.toxic: r.n for r in labels.filter(F.col("toxic").isin(0, 1) & learn(F.col(key))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = common.store(sampled(docs, labels, key, text, learn, sample), "toxicity-sample")
    sentences = common.store(sentences_of(rows), "toxicity-sentences")
    begun = first_witnesses(sentences)
    if begun is None:
        return None
    positive, negative, ratio = begun
    known = dict(negative)
    model = Model(*fold(positive, negative))
    for _ in range(rounds - 1):
        found, against = witnesses(sentences, model, ratio)
        if found and against:
            positive = found
            # the worst clean witnesses first, so that they are landmarks too
            negative = {w: n for w, n in (against | {w: n for w, n in known.items() if w not in against}).items() if w not in positive}
            known = dict(list(negative.items())[: 2 * NEGATIVES])
            model = Model(*fold(positive, known))
    judged = rows.select("text", "label").mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model)), "bag array<double>, top string, label int")
    seen = judged.select("bag", "label").collect()  # a few numbers for each text of the bounded sample
    label = np.array([r.label for r in seen])
    if not 0 < label.sum() < len(label):
        return None
    weight = np.where(label == 1, 1.5 * share.get(1, 1) / max(label.sum(), 1), share.get(0, 1) / max((label == 0).sum(), 1))
    return Model(model.values, model.bias, fit_logistic(np.array([r.bag for r in seen]), label, weight))


def score(docs: DataFrame, model: Model | None, carry: list[str], text: str = "text", names: tuple[str, str] = ("score", "word")) -> DataFrame:
    """The carried columns, score (0 to 1) and word, the one with the greatest margin, the latter two under `names`."""
    if model is None:
        return docs.select(*carry, F.lit(0.0).alias(names[0]), F.lit("").alias(names[1]))
    kept = docs.select(F.col(text).alias("seine_text"), *carry)
    schema = "seine_bag array<double>, seine_top string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    judged = kept.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model)), schema)
    layer = model.layer.tolist()
    power = F.aggregate(F.zip_with("seine_bag", F.array(*[F.lit(x) for x in layer[:-1]]), lambda a, b: a * b), F.lit(layer[-1]), lambda a, b: a + b)
    return judged.select(*carry, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), power))))).alias(names[0]), F.col("seine_top").alias(names[1]))


def reject(docs: DataFrame, model: Model | None, most: float = 0.5) -> DataFrame:
    """The rows of docs whose score stays below `most`."""
    return score(docs, model, docs.columns, names=("seine_score", "seine_word")).filter(F.col("seine_score") < most).select(*docs.columns)


def held_out(key):
    """Rows that are never learnt from: the CRC-32 of the key as text leaves no remainder by five."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    found = score(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "word")
