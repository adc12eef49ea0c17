"""The pipeline against its stages by hand on a small corpus, and on the smallest tables."""

import math
import random

import numpy as np

import corpus_pipeline
from seine.llm import resemblance, simhash, toxicity
from tests.llm.test_operators import SF, brute_fingerprint, docs


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in out.collect()}
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "simhash_near_dedup":
            prints = {i: brute_fingerprint(t) for i, t in before.items()}
            kept = [prints[i] for i in after]
            assert all(any((prints[i] ^ k).bit_count() <= 4 for k in prints.values()) for i in before)
            assert all((a ^ b).bit_count() > 4 for n, a in enumerate(kept) for b in kept[:n])
        if name == "secret_scan":
            assert set(after) == set(before)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), lambda k: ~toxicity.held_out(k))
    assert model is not None
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == set(after) and all(r.intact for r in final) and len(final) < len(rows)


def test_near_duplicates_by_resemblance(spark):
    """Every two texts of five-word-shingle similarity 0.8 or more are joined, and none below."""
    rng = random.Random(8)
    texts = [None, "", " ", "one two", "ONE two", "one three"]
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 150, 600]))]
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.022, 0.025, 0.03, 0.06):
            texts.append(" ".join("edited" + str(rng.random()) if rng.random() < share else w for w in base))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    reached = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                reached += len(sets[i]) > 1 and (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 4
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert reached
    for block in (3, 2048):
        assert {r.doc_id: r.component for r in resemblance.cluster(docs(spark, texts), block).collect()} == dict(enumerate(root))
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, texts), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == docs(spark, []).columns


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = "some words of one text here", "quite other words in this text"
    assert sorted([r.doc_id for r in resemblance.keep_one(docs(spark, [a, a, b, b], [1, 1, None, None])).collect()], key=str) == [1, None]


def test_near_duplicates_meet_by_fingerprints(spark):
    """Sets of similarity 0.8 share a probe of the pigeonhole and pass its bounds, small sets too; unlike ones don't pass."""
    rng = np.random.default_rng(3)
    pairs = []
    for shared, own in [(4, 1)] * 150 + [(8, 1)] * 150 + [(160, 20)] * 150:
        x = rng.integers(0, 1 << 63, shared + 2 * own, np.uint64)
        pairs.append((np.sort(x[: shared + own * (shared > 4)]), np.sort(np.concatenate([x[:shared], x[shared + own :][:own]]))))
    rows = [(2 * n + k, len(s), simhash.wide_majority(s).view(np.int64).tolist()) for n, p in enumerate(pairs) for k, s in enumerate(p)]
    assert all(simhash._signed(simhash.majority(s)) == rows[2 * n + k][2][0] for n, p in enumerate(pairs) for k, s in enumerate(p))
    distinct = spark.createDataFrame(rows, "node long, size long, words array<long>")
    parts, thresholds = resemblance.pigeonhole(distinct)
    assert sorted(b for p in parts for b in p) == list(range(512)) and max(thresholds) >= 0
    keys = {r.node: set(r.bands) for r in resemblance.probed(distinct, parts, thresholds).collect()}
    assert all(keys[2 * n] & keys[2 * n + 1] for n in range(len(pairs)))
    words, size = np.array([r[2] for r in rows], np.int64).view(np.uint64).T.copy(), np.array([r[1] for r in rows])
    left = np.arange(0, len(rows), 2)
    assert len(resemblance._close(words, size, left, left + 1)[0]) == len(pairs)
    assert not len(resemblance._close(words, size, left[300:-1], left[301:])[0])
    assert resemblance.probed(distinct.limit(0), *resemblance.pigeonhole(distinct.limit(0))).isEmpty()


def test_thresholds_of_likely_agreement():
    """What the dynamic program gives reaches the probability asked for, with partitions left out where fewer do."""
    bits = np.random.default_rng(4).integers(0, 2, (300, 512)).astype(np.uint8)
    parts, thresholds = simhash.allocate_likely(300, bits, 8, 0.15, 1e-3)
    lost = 1.0
    for part, t in zip(parts, thresholds, strict=True):
        lost *= 1 - sum(math.comb(len(part), k) * 0.15**k * 0.85 ** (len(part) - k) for k in range(t + 1))
    assert lost <= 1e-3 and -1 in thresholds
    assert simhash.allocate_likely(300, bits, 32, 0.15, 1e-9)[1] == [0] * 16
