"""Ties of a pass in order, which puts each record to the earliest kept one it matches and keeps it if it matches none.

Rounds decide all that doesn't wait for others; what still waits after a few of them are chains, which are settled
component by component, each in order in one task. Components of more than MOST matches go on in rounds, for as many as it takes.

Defined results: repeated matches count once; an empty table gives no rows; records that are kept don't come out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.session import scratch, stored

ROUNDS, MOST = 4, 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of (seq_a, seq_b); root is the least node. Each round hangs every neighbourhood on its least
    node and halves the paths; it takes some log n rounds."""
    both = stored(edges.select(F.col("seq_a").alias("u"), F.col("seq_b").alias("v")).unionByName(edges.select(F.col("seq_b").alias("u"), F.col("seq_a").alias("v"))).distinct(), "both")
    now = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "roots")
    while True:
        of = now.select(F.col("node").alias("v"), F.col("root").alias("low"))
        seen = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("low").alias("low"))
        better = now.join(seen, "node").select("node", "root", F.least("root", "low").alias("low"))
        # what a neighbour brought is also told to the old root, and paths are halved
        told = better.groupBy("root").agg(F.min("low").alias("told")).select(F.col("root").alias("at"), "told")
        hung = better.join(told, F.col("root") == F.col("at"), "left").select("node", "root", F.least("low", "told").alias("up"))
        jump = hung.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        after = stored(hung.join(jump, F.col("up") == F.col("mid"), "left").select("node", F.col("root").alias("was"), F.least("up", "top").alias("root")), "roots")
        if after.filter("was <> root").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component's ties: records in order, each to its earliest kept match."""
    matches = pdf.drop_duplicates(["seq_a", "seq_b"]).sort_values(["seq_b", "seq_a"])
    tied: dict[int, int] = {}
    for a, b in zip(matches["seq_a"].tolist(), matches["seq_b"].tolist(), strict=True):
        if b not in tied and a not in tied:  # a's own matches are all earlier, so a is settled
            tied[b] = a
    return pd.DataFrame({"seq": list(tied), "head": list(tied.values())}, dtype="int64")


def first_matches(edges: DataFrame, rounds: int = ROUNDS, most: int = MOST) -> DataFrame:
    """(seq, head) from matches (seq_a, seq_b) with seq_a < seq_b.

    A record is kept once no earlier match of its is undecided or kept; it is tied once its earliest match left is kept.
    Each round decides at least the earliest record that is open, and all that don't wait for others.
    """
    with scratch() as keep:
        left = stored(edges.distinct(), "matches")
        done = left.sparkSession.createDataFrame([], "seq long, head long")
        n = 0
        while not left.isEmpty():
            if n and n % rounds == 0:
                root = components(left)
                sized = left.join(root.withColumnRenamed("node", "seq_a"), "seq_a")
                sizes = stored(sized.groupBy("root").agg(F.count("*").alias("n")), "sizes")
                small = stored(sized.join(sizes.filter(F.col("n") <= most), "root").drop("n"), "chains")
                # within a component what is kept already comes first, for its records have no earlier matches left
                done = done.unionByName(small.groupBy("root").applyInPandas(_in_order, "seq long, head long"))
                left = stored(sized.join(sizes.filter(F.col("n") > most), "root").select("seq_a", "seq_b"), "matches")
                if left.isEmpty():
                    break
            # what is kept stays without earlier matches, so those of what is left tell it anew
            earliest = left.groupBy(F.col("seq_b").alias("seq")).agg(F.min("seq_a").alias("head"))
            tied = earliest.join(earliest.select(F.col("seq").alias("head")), "head", "left_anti")
            gone = tied.select("seq")
            still = left.join(gone, left.seq_a == gone.seq, "left_anti").join(gone, F.col("seq_b") == gone.seq, "left_anti").select("seq_a", "seq_b", F.lit(False).alias("tie"))
            told = stored(still.unionByName(tied.select(F.col("head").alias("seq_a"), F.col("seq").alias("seq_b"), F.lit(True).alias("tie"))), "matches")
            done = done.unionByName(told.filter("tie").select(F.col("seq_b").alias("seq"), F.col("seq_a").alias("head")))
            left = told.filter("not tie").select("seq_a", "seq_b")
            n += 1
        return keep(done, "ties")
