"""Aggregations over records: gaps, clusters, footprints, evaluation, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_counts(df: DataFrame, field: Column) -> DataFrame:
    """(cluster, n), blank values as Unknown."""
    name = F.when(F.trim(F.coalesce(field.cast("string"), F.lit(""))) == "", "Unknown").otherwise(F.trim(field.cast("string")))
    return df.groupBy(name.alias("cluster")).agg(F.count("*").alias("n"))


def keyword_clusters(df: DataFrame, text: Column, keywords: list[str]) -> DataFrame:
    """(cluster, n): a row counts for every keyword that it holds, else as Unclustered."""
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: text.contains(k))
    return df.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unclustered")))).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


def gaps(df: DataFrame, low: float = 40.0) -> DataFrame:
    """(measure, value, n): counts by country, page type and provider, and three counts of what is weak or missing."""
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lower(F.trim(F.col(c))).alias("value")) for m, c in (("country", "country"), ("page_type", "page_type"), ("provider", "source_provider"))])))
    grouped = stacked.filter("value <> ''").groupBy("measure", "value").agg(F.count("*").alias("n"))
    weak = df.agg(F.count_if((F.col("email") == "") & (F.col("phone") == "")).alias("no_contact"), F.count_if(F.col("website") == "").alias("no_website"), F.count_if(F.col("confidence_score") < low).alias("low_score"))
    return grouped.unionByName(weak.select(F.inline(F.array(*[F.struct(F.lit("gap").alias("measure"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in weak.columns]))))


def critic(df: DataFrame, low: float = 40.0) -> DataFrame:
    """(issue, share): what holds for more than half of the rows."""
    parts = df.agg(F.count("*").alias("n"), F.count_if(F.col("confidence_score") < low).alias("low_scores"), F.count_if((F.col("country") == "") & (F.col("hq_country") == "")).alias("weak_geography"))
    rows = parts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("issue"), F.round(F.col(c) / F.col("n"), 4).alias("share")) for c in ("low_scores", "weak_geography")])))
    return rows.filter("share > 0.5")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): added, removed or kept, over filled keys."""
    sides = [d.select(key).filter(F.col(key).isNotNull()).distinct() for d in (old, new)]
    a, b = sides[0].withColumn("before", F.lit(True)), sides[1].withColumn("after", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("kept").alias("status"))


def evaluate(cases: DataFrame, results: DataFrame, most_terms: str = "terms") -> DataFrame:
    """(case, n_terms, n_hit, recall, passed): which of a case's terms stand in some result of the case.

    cases: (case, terms array); results: (case, text).
    """
    wanted = cases.select("case", F.explode(most_terms).alias("term"))
    hit = wanted.join(results, "case", "left").groupBy("case", "term").agg(F.max(F.coalesce(F.col("text").contains(F.col("term")), F.lit(False))).alias("hit"))
    out = hit.groupBy("case").agg(F.count("*").alias("n_terms"), F.count_if("hit").alias("n_hit"))
    return out.select("case", "n_terms", "n_hit", F.round(F.col("n_hit") / F.col("n_terms"), 4).alias("recall"), (F.col("n_hit") == F.col("n_terms")).alias("passed"))


def suite(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), F.round(F.avg("recall"), 4).alias("mean_recall"))


def top_keywords(df: DataFrame, words: Column, stop: list[str], n: int) -> DataFrame:
    """The n most frequent words and their counts, the alphabetically first of equals."""
    return df.select(F.explode(words).alias("word")).filter(~F.col("word").isin(*stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def running_budget(calls: DataFrame, group: list[str], by: str, order: list[str], cap: int, cap_each: int) -> DataFrame:
    """calls with allowed: fewer than `cap` calls of the group and `cap_each` of its `by` came before."""
    before = lambda *keys: F.count("*").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return calls.withColumn("allowed", (before(*group) < cap) & (before(*group, by) < cap_each))


def budget_summary(calls: DataFrame, by: str, cap: int) -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("used")).select(by, "used", F.lit(cap).cast("long").alias("most"), F.greatest(F.lit(0), F.lit(cap) - F.col("used")).cast("long").alias("remaining"))


def weights(df: DataFrame, name: str, priority: str) -> DataFrame:
    """Each row's share of all priorities."""
    total = df.agg(F.sum(priority).alias("total"))
    return df.crossJoin(F.broadcast(total)).select(name, F.round(F.col(priority) / F.col("total"), 4).alias("weight"))  # one row on the right


def latest(entries: DataFrame, keys: list[str], at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The newest entry of each key, if it hasn't expired."""
    alive = entries.filter(F.unix_timestamp(at) >= F.unix_timestamp(now) - ttl_seconds)
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("event_id"))
    return alive.withColumn("seine_n", F.row_number().over(w)).filter("seine_n = 1").drop("seine_n")


def top_similar(vectors: DataFrame, asked: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, rank) by cosine likeness of every other vector with each asked one.

    Likeness is rounded to six digits before ranking, so that ties are ties on every engine. Both sides are dealt into
    blocks; a task compares two blocks at a time by one product of matrices and keeps the k best of each query.
    """

    def packed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        dealt = df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name))
        return dealt.agg(F.collect_list(F.struct("vec_id", "embedding")).alias(f"{name}_rows")), n

    filled = lambda df: df.select("vec_id", "embedding").filter("vec_id is not null and size(embedding) > 0")
    (v, n), (q, _) = packed(filled(vectors), "v"), packed(filled(asked), "q")
    met = q.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(v, "v").select("q_rows", "v_rows")

    def compare(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for asked_rows, rows in zip(frame["q_rows"], frame["v_rows"], strict=True):
                left, right = (np.array([r["embedding"] for r in x], np.float64) for x in (asked_rows, rows))
                ids, own = np.array([r["vec_id"] for r in rows]), np.array([r["vec_id"] for r in asked_rows])
                with np.errstate(invalid="ignore", divide="ignore"):
                    likeness = np.round((left @ right.T) / np.outer(np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)), 6)
                for i, query in enumerate(own):
                    there = np.flatnonzero((ids != query) & ~np.isnan(likeness[i]))
                    best = there[np.lexsort((ids[there], -likeness[i][there]))[:k]]
                    yield pd.DataFrame({"query_id": np.full(len(best), query), "vec_id": ids[best], "likeness": likeness[i][best]})

    found = met.mapInPandas(compare, "query_id long, vec_id long, likeness double")
    w = Window.partitionBy("query_id").orderBy(F.desc("likeness"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank")
