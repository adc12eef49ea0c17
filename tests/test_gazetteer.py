"""Places by the automaton against one pattern for each spelling, and by phrases."""

import random
import re

from pyspark.sql import functions as F

from seine.functions import places
from seine.operators import gazetteer


def brute(text, rows):
    low = re.sub(r"\s+", " ", (text or "").strip().lower())
    low = places.ARABIC_REGIONS.get(low, low)
    around = {True: ("(?<![a-zA-Z])", "(?![a-zA-Z])"), False: (r"\b", r"\b")}
    return sorted({country for s, country, strict in rows if re.search(around[strict][0] + re.escape(s) + around[strict][1], low)})


def texts(rows, seed=1, n=300):
    rng = random.Random(seed)
    filler = ["oman's", "woman", "(usa)", "thousand", "u.s.", "u.s.a", "new  york", "in", "ca", "x_us", "us_x", "TX.", "2tx", "ab", "Perú", "é", "مصر", "the", "\n", "-", "dc9"]
    out = [None, "", " ", "الخليج", "GCC", "in the Gulf", "Washington D.C. and guam", "عمان و قطر"]
    for _ in range(n):
        words = rng.choices(filler, k=6) + [rng.choice(rows)[0] for _ in range(rng.randrange(3))]
        rng.shuffle(words)
        out.append(rng.choice([" ", ", ", "/", ""]).join(w.upper() if rng.random() < 0.2 else w for w in words))
    return out


def test_automaton(spark):
    rows = gazetteer.default_rows() + [("houston", "usa", False), ("são paulo", "brazil", False)]
    given = texts(rows)
    frame = spark.createDataFrame([*enumerate(given)], "i long, t string")
    cities = spark.createDataFrame([("Houston", "usa"), ("São  Paulo", "brazil")], "spelling string, country string")
    g = gazetteer.Gazetteer(spark, gazetteer.table_of(spark, cities))
    got = {r.i: (r.all, r.first) for r in frame.select("i", g.countries(F.col("t")).alias("all"), g.first(F.col("t")).alias("first")).collect()}
    for i, t in enumerate(given):
        want = brute(t, rows)
        assert got[i] == (want, want[0] if want else ""), t


def test_windows_after_phrases(spark):
    g = gazetteer.Gazetteer(spark)
    cells = ["We are Headquartered in Oslo, Norway. Offices in Egypt and Qatar", "head office: none. HQ: Ontario", "based in " + "x " * 200 + "France", "our offices " + "y " * 100 + "Kuwait; active in Texas", None, "Norway"]
    got = [tuple(r) for r in spark.createDataFrame([*enumerate(cells)], "i int, t string").orderBy("i").select(g.headquarters(F.col("t")), g.presence(F.col("t"))).collect()]
    assert got == [("egypt", ["egypt", "qatar"]), ("canada", []), ("", []), ("", ["kuwait", "usa"]), ("", []), ("", [])]


def test_by_phrases(spark):
    rows = [r for r in gazetteer.default_rows() if not r[2] and re.fullmatch(r"[\w ]+", r[0])]
    given = ["from New  York to Egypt", "Saudi Arabia, GCC", "nothing", None, "northern ireland or ireland"]
    docs = spark.createDataFrame([*enumerate(given)], "i long, t string")
    table = spark.createDataFrame(rows, gazetteer.SCHEMA)
    got = {r.i: r.countries for r in gazetteer.find_by_phrases(docs, table, "i", "t").collect()}
    assert got == {i: w for i, t in enumerate(given) if (w := brute(t, rows))}


def test_names_and_members(spark):
    names = ["U.S.A.", " texas ", "Deutschland", "Atlantis", None, "الخليج", "GCC", "ca", "Georgia State"]
    frame = spark.createDataFrame([*enumerate(names)], "i int, n string")
    table = gazetteer.table_of(spark)
    got = {r.i: (r.country, len(r.m)) for r in gazetteer.resolved(frame, "n", table).withColumn("m", gazetteer.members(F.col("n"))).collect()}
    assert got == {0: ("usa", 0), 1: ("usa", 0), 2: ("germany", 0), 3: ("atlantis", 0), 4: ("", 0), 5: ("gcc", 6), 6: ("gcc", 6), 7: ("canada", 0), 8: ("usa", 0)}
