"""Stores that are written again and again, broken off and resumed."""

from pyspark.sql import functions as F

from seine.sources import store

ROW = "namespace string, key string, value string, created_at long"


def test_versions_and_broken_writes(spark, tmp_path):
    v = store.Versions(spark, f"file://{tmp_path}/t", "a int")
    assert v.read().collect() == [] and v.numbers() == []
    for k in range(4):
        assert v.write(spark.createDataFrame([(k,)], "a int")) == k + 1
    assert v.numbers() == [3, 4] and [r.a for r in v.read().collect()] == [3] and [r.a for r in v.read(3).collect()] == [2]
    (tmp_path / "t" / "v=5").mkdir()  # a write that broke off
    assert [r.a for r in v.read().collect()] == [3] and v.write(spark.createDataFrame([(9,)], "a int")) == 5
    assert [r.a for r in v.read().collect()] == [9]


def test_cache(spark, tmp_path):
    c = store.Cache(spark, f"file://{tmp_path}/c", 10)
    put = lambda *rows: c.put(spark.createDataFrame(rows, ROW))
    get = lambda now: {r.key: r.value for r in c.get(spark.createDataFrame([("n", "a"), ("n", "b"), ("m", "c"), ("m", "d")], "namespace string, key string"), now).collect()}
    assert get(0) == dict.fromkeys("abcd")
    put(("n", "a", "1", 100), ("n", "a", "2", 100), ("n", "b", "old", 90), ("m", "c", "x", 95), (None, "c", "no", 100))
    put(("n", "a", "older", 99), ("n", "b", "new", 105))
    assert get(105) == {"a": "2", "b": "new", "c": "x", "d": None} and get(106)["c"] is None
    assert c.purge(111) == 2 and c.purge(111) == 0 and get(100) == {"a": None, "b": "new", "c": None, "d": None}


def test_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cases": [{"case": 1, "expected": ["x"]}, 5, "no"]}\n[{"case": 2}]\n{"case": 3, "prompt": "p"}\nbroken\n')
    got = store.load_cases(spark, f"file://{tmp_path}/a.json", "case long, prompt string, expected array<string>").orderBy("case").collect()
    assert [(r.case, r.prompt, r.expected) for r in got] == [(1, None, ["x"]), (2, None, None), (3, "p", None)]
    store.save_cases(spark.range(30).select(F.col("id").alias("case")), f"file://{tmp_path}/b", "case")
    assert sorted(r.case for r in store.load_cases(spark, f"file://{tmp_path}/b", "case long").collect()) == list(range(30))
