"""Organisations resolved in passes against the same passes spelled out on the driver; evidence, labels and likeness on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seine.functions import geo, labels, names, text
from seine.operators import evidence, greedy, namejoin, reports, resolve

FIELDS = "seq long, company_name string, website string, domain string, description string, email string, phone string, linkedin_url string, contact_page string, country string, hq_country string, page_type string, is_directory_or_media boolean, confidence_score double, source_provider string"


def records(spark, rows):
    full = [(i, n, "", d, "", "", "", "", "", c, "", "company", False, float(s), "exa") for i, n, d, c, s in rows]
    return spark.createDataFrame(full, FIELDS)


def brute_heads(rows, clean, short, key):
    """Greedy passes two and three: seq -> head."""

    def same(a, b):
        (_, _, da, ca, _), (_, _, db, cb, _) = a, b
        apart = bool(da and db and da != db)
        alike = names.similar(clean[a[0]], clean[b[0]], short[a[0]], short[b[0]])
        return bool(da and da == db) or ((da or clean[a[0]]) == (db or clean[b[0]]) != "" and not apart) or (alike and not apart and not (ca and cb and ca != cb))

    first, kept, head = {}, [], {}
    for r in rows:
        k = key[r[0]]
        if k and k in first and same(r, first[k]):
            head[r[0]] = first[k][0]
        else:
            first.setdefault(k, r)
    for r in rows:
        if r[0] not in head:
            match = next((x for x in kept if same(r, x)), None)
            if match is None:
                kept.append(r)
            else:
                head[r[0]] = match[0]
    return head, kept


def test_dedup_in_three_passes(spark):
    rng = random.Random(3)
    heads = ["delta well", "nile drilling", "north sea data", "alpha pump", "delta wells"]
    rows = []
    for i in range(60):
        base = rng.choice(heads)
        name = rng.choice([base, base.title() + " Ltd", base + " services", base.upper(), base + " " + rng.choice("xy"), ""])
        rows.append((i, name, rng.choice(["", "", f"d{i}.org"]), rng.choice(["", "egypt", "norway"]), 0))
    plain = records(spark, [(i, n, "", "", 0) for i, n, _, _, _ in rows])
    got = plain.select("seq", names.clean_name(F.col("company_name")).alias("c"), names.acronym(F.col("company_name")).alias("a"), names.name_key(F.col("company_name")).alias("k")).collect()
    clean, short, key = ({r.seq: r[n] for r in got} for n in ("c", "a", "k"))
    head, kept = brute_heads([(i, n, "", "", 0) for i, n, _, _, _ in rows], clean, short, key)
    assert sorted(r.seq for r in resolve.dedup(plain).collect()) == sorted(r[0] for r in kept)
    assert resolve.dedup(records(spark, [])).count() == 0


def test_conflicts_keep_organisations_apart(spark):
    rows = [
        (0, "Delta Well Ltd", "d0.org", "egypt", 0), (1, "delta well", "d1.org", "egypt", 0), (2, "Nile Drilling", "", "egypt", 0), (3, "Nile drilling", "", "norway", 0),
        (4, "North Sea Data", "", "egypt", 0), (5, "North Sea Datas", "", "norway", 0), (6, "Alpha Pumps", "", "egypt", 0), (7, "Alpha Pump", "", "", 0), (8, "", "d0.org", "", 0),
    ]
    assert sorted(r.seq for r in resolve.dedup(records(spark, rows)).collect()) == [0, 1, 2, 4, 5, 6]


@pytest.mark.parametrize("seed", range(4))
def test_first_matches_as_in_order(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b}
    head, kept = {}, []
    for i in range(40):
        m = next((k for k in kept if (k, i) in edges), None)
        if m is None:
            kept.append(i)
        else:
            head[i] = m
    for rounds, most in ((4, 2_000_000), (1, 10), (1, 2_000_000)):
        got = greedy.first_matches(spark.createDataFrame(sorted(edges), "seq_a long, seq_b long"), rounds, most).collect()
        assert {r.seq: r.head for r in got} == head and len(got) == len(head)


def test_a_long_chain(spark):
    got = greedy.first_matches(spark.range(1000).selectExpr("id as seq_a", "id + 1 as seq_b")).collect()
    assert {r.seq: r.head for r in got} == {i: i - 1 for i in range(1, 1001, 2)}


def some_names(rng, n):
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 5))) for _ in range(90)] + ["energy"] * 30 + ["oil", "gas", "the", "of"] * 6
    out = []
    for _ in range(n):
        words = rng.choices(stems, k=rng.choice([1, 1, 2, 2, 3, 3, 4, 6]))
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(words))
                w = words[k]
                at = rng.choice([0, 0, rng.randrange(len(w) + 1)])
                words[k] = rng.choice([w[:at] + rng.choice("abcxyz") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("xyz") + w[at + 1 :]]) or w
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words) + 1), rng.choice(stems))
            if rng.random() < 0.2:
                rng.shuffle(words)
            if rng.random() < 0.1:
                words = [rng.choice(words), *words]
            if rng.random() < 0.1 and len(words) > 1:
                words = ["".join(w[0] for w in words)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("seed", "n", "block"), [(0, 900, 4096), (1, 500, 7)])
def test_no_similar_names_are_lost(spark, seed, n, block):
    rng = random.Random(seed)
    distinct = sorted({*some_names(rng, n), "schlumberger", "shlumberger", "alpha zeta", "beta alpha zeta", "ta energy", "delta energy", "a", "a b", "\u00e9t\u00e9 oil", "\u00e8t\u00e8 oil", "x" * 90, "x" * 85 + " y"})
    rows = [(i, c, "".join(w[0] for w in c.split()) if " " in c else "") for i, c in enumerate(distinct)]
    got = {tuple(r) for r in namejoin.similar_pairs(spark.createDataFrame(rows, "id long, clean string, short string"), block).collect()}
    want = {(i, j) for i, a, x in rows for j, b, y in rows if i < j and names.similar(a, b, x, y)}
    assert got == want and len(want) > 300


def test_similar_names_by_edges_repeats_and_width(spark):
    odd = ["lpha zet", "alpha zeta zet", "r s r", "ur s ra", "l alpha p", "xl alpha pxl", "l l", "ll l", "\u00a0", "\u2003", " ".join(f"w{i}" for i in range(30)), "z " + " ".join(f"w{i}" for i in range(3, 30)), "w4 w5 w6"]
    rows = [(i, c, "".join(w[0] for w in c.split()) if " " in c else "", i % 2 == 0) for i, c in enumerate(odd)]
    frame = spark.createDataFrame(rows, "id long, clean string, short string, new boolean")
    want = {(i, j) for i, a, x, _ in rows for j, b, y, _ in rows if i < j and names.similar(a, b, x, y)}
    assert len(want) > 4
    for across, kept in ((False, lambda i, j: i % 2 == 0 or j % 2 == 0), (True, lambda i, j: i % 2 != j % 2)):
        got = [tuple(r) for r in namejoin.similar_pairs(frame, 5, fresh="new", across=across).collect()]
        assert sorted(got) == sorted(p for p in want if kept(*p))


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in range(2))
        assert names.longest_common(a, b) == plain(a, b)


def test_accepted_in_order(spark):
    rng = random.Random(9)
    given = [*some_names(rng, 150), "", None, "Energy"]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "seq long, company_name string")
    own = {r.seq: (r.c, r.a) for r in frame.select("seq", names.clean_name(F.col("company_name")).alias("c"), names.acronym(F.col("company_name")).alias("a")).collect()}
    kept, want = [], []
    for i, (c, a) in sorted(own.items()):
        head = next((k for k in kept if c and names.similar(own[k][0], c, own[k][1], a)), None)
        if head is None:
            kept.append(i)
        want.append((i, head is None, head))
    assert sorted(map(tuple, resolve.accepted(frame).collect())) == want


def test_similar_in_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(90, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, None), (91, []), (92, [0.0] * 5), (None, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in reports.top_similar(frame, frame.filter("vec_id % 30 = 0"), 4, block=16).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in (0, 30, 60):
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(90) if i != q)[:4]
        assert [got[q, n] for n in range(1, 5)] == [i for _, i in best]
    assert len(got) == 12


def test_evidence_and_labels_of_odd_values(spark):
    row = spark.createDataFrame([(None, None), ("", " n "), ("Oslo and KSA", None)], "t string, notes string")
    items = F.array_compact(F.array(evidence.of_text(F.col("t"), geo.countries_in(F.col("t")), F.lit("page")), evidence.of_keywords(F.col("t"), ["and", "AND", "x"], F.lit("page"))))
    got = row.select(evidence.summary(items).alias("s"), evidence.united(items, "matched_countries").alias("c"), evidence.united(items, "matched_terms").alias("w"), evidence.noted(F.col("notes"), items).alias("n")).collect()
    assert [(r.s, r.c, r.w) for r in got] == [("page", [], []), ("page", [], []), ("page: Oslo and KSA | keywords: Oslo and KSA", ["norway", "saudi arabia"], ["and", "AND"])]
    assert [r.n for r in got] == ["evidence:page", "n | evidence:page", "evidence:page: Oslo and KSA | keywords: Oslo and KSA"]
    one = spark.range(1).select(labels.category(F.lit(None)).alias("a"), labels.level(F.lit("HR lead")).alias("b"), labels.file_name(F.lit(" a.PDF "), F.lit("csv")).alias("c"), labels.json_in(F.lit("no json")).alias("d"), geo.contains_country(F.lit("from Houston"), "USA").alias("e"), geo.contains_country(F.lit("in Peru"), "Peru").alias("f"), text.hits(F.lit("ab"), []).alias("g")).first()
    assert tuple(one) == ("General", "HR and talent acquisition", "a.csv", None, True, True, 0)


def test_meetings_deal_rows_once(spark):
    """Rows that ask and rows that are there are shuffled once by their key, however often a key is held; before, three times."""
    rows = spark.createDataFrame([(k % 3, k) for k in range(40)], "key int, id int")
    asked, there = (rows.select("key", F.struct("id").alias(s)) for s in ("x", "y"))
    met = namejoin._met(asked, there, 4, F.lit(True))
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Join") == 3
    assert sorted((r.x.id, r.y.id) for r in met.collect()) == [(a, b) for a in range(40) for b in range(40) if a != b and a % 3 == b % 3]


def test_texts_in_others_meet_by_cut_words():
    """Texts that stand in others with a word cut off meet them by a key; those whose words are all there don't ask for it."""
    rng = random.Random(5)
    stems = ["a", "ab", "b", "ba", "abcdefghi", "cdefghi", "abcdefg", "xabcdefghi"]
    lists = [rng.choices(stems, k=rng.choice([1, 2, 2, 3, 4])) for _ in range(400)]
    keys, n = [namejoin.beside(w) for w in lists], 0
    for x, (asked, _) in zip(lists, keys, strict=True):
        for y, (_, held) in zip(lists, keys, strict=True):
            shared = len({*x} & {*y})
            if " ".join(x) in " ".join(y) and not {*x} <= {*y} and shared >= max(1, min(len({*x}), len({*y})) - 1):
                assert {*asked} & {*held}
                n += 1
    assert n > 50 and not {*namejoin.beside(["the", "energy"])[0]} & {*namejoin.beside(["of", "the", "energy"])[1]}


def test_edits_to_a_piece():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    rng = random.Random(2)
    texts = ["".join(rng.choices("abc \x00\U0001f600", k=rng.choice([1, 2, 5, 20, 63, 64]))) for _ in range(40)]
    i, j = (x.ravel() for x in np.mgrid[:40, :40])
    assert namejoin._edits(texts, texts, i, j).tolist() == [plain(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]
    assert namejoin._common(texts, texts, i, j).tolist() == [names.longest_common(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]


def test_few_candidates_of_common_words(spark):
    """Names that share frequent words only aren't read letter by letter; before, all pairs of fitting letters were, which grew
    with the square of the names. Names ask for pairs of words, not for a frequent one; before, for "the" here."""
    rng = random.Random(4)
    odd = ["".join(rng.choices("aeionrst", k=5)) for _ in range(300)]
    rows = [(i, f"the {w} and energy") for i, w in enumerate(odd)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["north delta wells", "xx north delta well"])]
    frame = spark.createDataFrame(rows, "id long, clean string")
    sides = frame.select("id", "clean", F.explode(F.array(F.lit(1), F.lit(2))).alias("key"), F.lit(True).alias("fresh"), F.lit(False).alias("wide"), F.length("clean").cast("long").alias("n"), namejoin._features("clean").alias("f"))
    sides = sides.select("key", F.struct("id", "fresh", "wide", "n", F.col("f.texts")[0]["low"].alias("low"), F.col("f.texts")[0]["high"].alias("high"), "f.three_low", "f.three_high", "clean").alias("x"))
    for block in (7, 10_000):
        got = {tuple(r) for r in namejoin._nearly(sides, sides.withColumnRenamed("x", "y"), block, 4, False).collect()}
        true = {(i, j) for i, a in rows for j, b in rows if i < j and namejoin.piece_alike(a, b)}
        assert true <= got and (300, 301) in got and len(got) < 3 * len(true) + 600
    asks = spark.createDataFrame([(["zeta", "alpha", "energy"],), (["the", "energy"],), (["energy"],), (["w" * 90, "a", "b"],)], "w array<string>").select(namejoin._asks("w").alias("f")).select("f.*").collect()
    assert [(r.alone, r.pairs) for r in asks] == [([], ["alpha zeta"]), ([], ["energy the"]), (["energy"], []), (["w" * 90], [])]
