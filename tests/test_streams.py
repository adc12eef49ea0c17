"""Stateful streams against their batch twins, with restarts between micro-batches and expiry inside the data."""

import random

from pyspark.sql import functions as F

from seine.operators import resolve
from seine.session import shared_folder
from seine.streaming import state
from tests.test_resolution import some_names

EVENTS = "number long, at timestamp, k string, p string"


def folder(spark, name):
    return f"{shared_folder(spark)}/test-{name}-{random.randrange(1 << 60):x}"


def events(spark, seed, n=400):
    rng = random.Random(seed)
    seconds = sorted(rng.randrange(100_000) for _ in range(n))
    rows = [(i, s, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None])) for i, s in enumerate(seconds)]
    frame = spark.createDataFrame([*rows, (n, None, "a", "x")], "number long, s long, k string, p string")
    frame = frame.select("number", F.timestamp_seconds("s").alias("at"), "k", "p")
    return rows, [frame.filter(F.col("number") < n // 3), frame.filter(F.col("number").between(n // 3, n // 2)), frame.filter(F.col("number") > n // 2)]


def test_cache(spark):
    rows, parts = events(spark, 1)
    got = spark.read.parquet(state.run_in_batches(parts, folder(spark, "cache"), lambda s: state.cache(s, ["k"], "at", "number", 900))).collect()
    entry, want = {}, {}
    for i, s, k, _ in rows:
        hit = k in entry and s - entry[k][0] <= 900
        if not hit:
            entry[k] = (s, i)
        want[i] = (hit, entry[k][1])
    assert {r.number: (r.hit, r.written_by) for r in got} == want and len(got) == len(want)
    assert 20 < sum(h for h, _ in want.values()) < 380


def test_budget(spark):
    rows, parts = events(spark, 2)
    got = spark.read.parquet(state.run_in_batches(parts, folder(spark, "budget"), lambda s: state.budget(s, ["k"], "p", "at", "number", 7, 3, 1000))).collect()
    runs, want = {}, {}
    for i, s, k, p in rows:
        run = runs.get(k)
        if run is None or s - run["last"] > 1000:
            run = runs[k] = {"used": 0, "own": {}}
        run["last"] = s
        ok = run["used"] < 7 and run["own"].get(p, 0) < 3
        if ok:
            run["used"], run["own"][p] = run["used"] + 1, run["own"].get(p, 0) + 1
        want[i] = (ok, 7 - run["used"], 3 - run["own"].get(p, 0))
    assert {r.number: (r.allowed, r.left, r.left_of_one) for r in got} == want and len(got) == len(want)
    assert 0 < sum(w[0] for w in want.values()) < len(want)


def test_growing_index_equals_the_batch(spark):
    given = [*some_names(random.Random(5), 120), "", None, "Energy Ltd", "energy"]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "seq long, company_name string")
    parts = [frame.filter(F.col("seq").between(a, b)) for a, b in ((0, 50), (51, 60), (61, 999))]
    at = folder(spark, "index")
    state.run_in_batches(parts, at, lambda s: s, state.growing_index(at))
    got = lambda: sorted(map(tuple, spark.read.parquet(f"{at}/decided").select("seq", "accepted", "duplicate_of").collect()))
    want = sorted(map(tuple, resolve.accepted(frame).collect()))
    assert got() == want and 10 < sum(w[1] for w in want) < len(want)
    state.growing_index(at)(parts[1], 1)  # a batch that is run again decides the same
    assert got() == want


def test_snapshots(spark):
    sets = [{"a", "b"}, {"b", "c", "d"}, set(), {"a"}]
    at = folder(spark, "snapshots")
    compare = state.snapshots(at, "key", "string")
    for n, keys in enumerate(sets):
        compare(spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "key string"), n)
    got = {(r.batch, r.key, r.status) for r in spark.read.parquet(f"{at}/changes").collect()}
    want = set()
    for n, keys in enumerate(sets):
        old = sets[n - 1] if n else set()
        want |= {(n, k, "kept" if k in old and k in keys else "added" if k in keys else "removed") for k in old | keys}
    assert got == want


def test_states_meet_rows_not_frames(spark):
    """One key's few rows cost no pandas frame; before, each key of each micro-batch made two."""
    stream = spark.readStream.format("rate").load().selectExpr("timestamp as at", "value as number", "value % 9 as k")
    for rows in (state.cache(stream, ["k"], "at", "number", 9), state.budget(stream, ["k"], "k", "at", "number", 7, 3, 9)):
        plan = rows._jdf.queryExecution().analyzed().toString()
        assert "TransformWithState" in plan and "InPandas" not in plan
