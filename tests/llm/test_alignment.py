"""The alignment against whole-text encoding by both libraries and links spelled out pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seine.llm import alignment
from tests.llm.test_operators import SF, docs, odd_texts

PATHS = tuple(map(public_tokenizers.path, (alignment.A_FILE, alignment.B_FILE)))
ZERO = (0, 0, 0, 0, 0, 0, "")


def brute(texts):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = alignment.letters_of_bytes()
    rows, counts = [], Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        p = [bytes(letters[c] for c in token) for token in x.tokens]
        q = [bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace("▁", " ").encode() for i in y for s in [b.id_to_piece(i)]]
        if b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            rows.append(None)
            continue
        spans = [[(sum(map(len, s[:i])), sum(map(len, s[: i + 1]))) for i in range(len(s))] for s in (p, q)]
        links = [(x.ids[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [
            ",".join(str(k) for k, (_, e) in zip(x.ids, spans[0], strict=True) if lo < e <= hi) + "|" + ",".join(str(k) for k, (_, e) in zip(y, spans[1], strict=True) if lo < e <= hi)
            for lo, hi in zip([0, *cuts], cuts, strict=False)
        ]
        counts.update(links)
        rows.append((len(x.ids), len(y), groups, links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        ZERO if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[k] == best[k[1]] for k in r[3]), sum(counts[k] for k in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
        for r in rows
    ]


def texts():
    rng = random.Random(4)
    odd = ["a▁b", "  two  spaces ", "\nline", "line\n", "a\n\nb\nc d", "tab\tand\x0bmore", "x y z　w", "<|endoftext|> and <s> </s> <0x41> <unk>", "it's we'll 12,345 + 67", "дурак 你好", "nul\0byte", "\x85 next\x1cline", "▁", " ", "\n"]
    words = ["alpha", "be", "it's", "\n", "  ", " ", "9", "...", "été", "\U0001f600", "-", "Zz", "\t"]
    mixed = ["".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(150)]
    spaced = [" ".join(rng.choices(["la", "là,", "over.", "x\ny", "und", "stst"], k=30)) for _ in range(20)]
    return [t and t[:1500] for t in odd_texts()] + odd + mixed + spaced


@pytest.mark.parametrize("most", [alignment.PAIRS, 0])
def test_against_whole_texts(spark, most):
    given = texts()
    got = alignment.align(docs(spark, given).repartition(3), *PATHS, most_pairs=most)
    assert got.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert [tuple(r)[1:] for r in sorted(got.collect(), key=lambda r: r.doc_id)] == brute(given)


def test_real_texts_and_forgetting(spark, monkeypatch):
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    given = [t and t[:2000] for t in given]
    want = brute(given)
    memory = alignment.Memory(alignment.Tokenizers(*PATHS))
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    got = [alignment._sums(memory, memory.numbers([t or ""]))[0].tolist()[:4] for t in given]
    assert got == [list(w[:4]) for w in want]


def test_without_safe_cuts():
    t = alignment.Tokenizers(*PATHS)
    assert t.cuts and t.segments("a b\nc  d ") == [("", " a"), "b", "\nc  d "] and t.segments("a b\nc") == ["a", "b", "\nc"]
    t.cuts = False
    memory = alignment.Memory(t)
    assert [alignment._sums(memory, memory.numbers([x]))[0].tolist()[:4] for x in ("a b\nc", "it's  x")] == [list(r[:4]) for r in brute(["a b\nc", "it's  x"])]


def test_bits():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        marks = rng.random(n) < 0.3
        bits = alignment.Bits.at(np.flatnonzero(marks), n)
        assert bits.select().tolist() == np.flatnonzero(marks).tolist()
        assert bits.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(marks)]).tolist()
