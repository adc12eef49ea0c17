"""What a task may cost: effective mode, queries for each provider, candidates and pages, as columns over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions.text import first_of_each

# Queries for each provider (ddg, exa, tavily, serpapi), least candidates and candidates per result, by mode.
CAPS = {"fast": ((4, 2, 0, 0), 30, 3), "balanced": ((7, 5, 4, 0), 100, 3), "deep": ((12, 8, 6, 4), 200, 4)}
PEOPLE = {"fast": (4, 10, 0, 4), "balanced": (4, 15, 0, 5), "deep": (6, 20, 0, 8)}
PROVIDERS = ("ddg", "exa", "tavily", "serpapi")


def effective_mode(mode: Column, max_results: Column, channel: Column, rich: Column) -> Column:
    """The mode after promotion: many results, channel searches and rich keywords ask for more than was asked."""
    m = F.lower(mode)
    one = F.when((m == "balanced") & (max_results > 60), "deep").when((m == "fast") & (max_results > 30), "balanced").otherwise(m)
    two = F.when((one == "fast") & (channel | rich), "balanced").otherwise(one)
    return F.when((two == "balanced") & (max_results >= 50) & channel & rich, "deep").otherwise(two)


def plan(tasks: DataFrame) -> DataFrame:
    """tasks(mode, max_results, intent, category, task_type, n_keywords) with effective mode, candidates and caps."""
    channel = F.col("intent").isin("agent_or_distributor", "reseller", "partner")
    software = F.col("category") == "software_company"
    rich, richer = software & (F.col("n_keywords") >= 2), software & (F.col("n_keywords") >= 4)
    people = F.col("task_type") == "people_search"
    df = tasks.withColumn("effective_mode", effective_mode(F.col("mode"), F.col("max_results"), channel, software & (F.col("n_keywords") >= 3)))
    pick = lambda f: F.when(F.col("effective_mode") == "fast", f("fast")).when(F.col("effective_mode") == "deep", f("deep")).otherwise(f("balanced"))
    extra = lambda test, n: F.when(test, n).otherwise(0)
    more = {"ddg": extra(rich, 1) + extra(channel, 1), "exa": extra(rich, 1) + extra(richer, 1) + extra(channel, 2), "tavily": extra(richer, 1) + extra(channel & (F.col("effective_mode") != "fast"), 1), "serpapi": F.lit(0)}
    allowed = {"ddg": F.lit(True), "exa": F.lit(True), "tavily": ~people & (F.col("effective_mode") != "fast"), "serpapi": people | (F.col("effective_mode") == "deep")}
    least = F.when(people, F.greatest(F.lit(200), F.col("max_results") * 5)).otherwise(pick(lambda m: F.greatest(F.lit(CAPS[m][1]), F.col("max_results") * CAPS[m][2])))
    df = df.withColumn("max_candidates", (least + extra(rich, 20) + extra(richer, 25) + extra(channel, 25)).cast("int"))
    for k, p in enumerate(PROVIDERS):
        base = F.when(people, pick(lambda m, k=k: F.lit(PEOPLE[m][k]))).otherwise(pick(lambda m, k=k: F.lit(CAPS[m][0][k])))
        df = df.withColumn(f"q_{p}", F.when(allowed[p], base + more[p]).otherwise(0).cast("int"))
    return df


def provider_order(tasks: DataFrame) -> DataFrame:
    """(task columns, provider, priority, place) of the providers of each task, the most fitting first."""
    mode, entity, category = F.lower("mode"), F.col("entity"), F.col("category")
    rows = F.array(
        F.struct(F.lit("ddg").alias("provider"), F.when(mode == "fast", 90).otherwise(70).alias("priority")),
        F.struct(F.lit("exa").alias("provider"), F.least(F.lit(100), F.when(entity.isin("paper", "person"), 95).otherwise(85) + F.when(category == "software_company", 5).otherwise(0)).alias("priority")),
        F.struct(F.lit("tavily").alias("provider"), (F.when(mode.isin("balanced", "deep"), 80).otherwise(45) + F.when(entity.isin("paper", "event", "tender"), 5).otherwise(0)).alias("priority")),
        F.struct(F.lit("serpapi").alias("provider"), F.when(entity == "person", 88).otherwise(60).alias("priority")),
    )
    ordered = F.array_sort(rows, lambda a, b: F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).when(a["provider"] < b["provider"], -1).when(a["provider"] > b["provider"], 1).otherwise(0))
    return tasks.select("*", F.posexplode(ordered).alias("place", "p")).select(*tasks.columns, "p.provider", "p.priority", (F.col("place") + 1).alias("place"))


def queries(tasks: DataFrame, terms: Column, entity: Column, places: Column, most: int) -> DataFrame:
    """(task columns, n, query): terms x entity x places, the first `most` different ones of each task."""
    texts = F.flatten(F.transform(terms, lambda t: F.transform(F.when(F.size(places) == 0, F.array(F.lit(""))).otherwise(places), lambda p: F.trim(F.concat_ws(" ", t, entity, p)))))
    once = first_of_each(F.filter(texts, lambda q: q != ""))
    return tasks.select("*", F.posexplode(F.slice(once, 1, most)).alias("n", "query"))
