"""Benchmark decontamination by templates, in DataFrame functions only.

Texts and benchmark items become sequences of typed tokens: numbers, units after numbers and names (capitalised
words inside a sentence) give way to placeholders, everything else is lower-cased. Windows of five tokens are
hashed and joined with those of the items. Where a window holds placeholders, the values behind them are checked:
along one alignment of an item with a text, equal values of the item must stand for equal values of the text, as
they do when a question is asked anew with other numbers or names. An item counts as leaked into a document when
consistent alignments hold half or more of its windows.

Windows that many items have (numbers and names alone, say) would tie most texts to most items. An item of n windows
that needs m of them cannot leak into a text that has none of any n - m + 1 of them, so texts are first matched with
each item's n - m + 1 windows that the fewest items share; all windows are matched for the texts and items that are
left. This loses nothing.

Defined results: null and empty texts match nothing; a text or item of fewer than five tokens is one window of what
it has; rows of equal doc_id count as one document, null included; repeated items are found each, rows of equal
item_id count as one item; texts of any length are matched whole; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

WINDOW = 5
LEAKED = 0.5
#: Bytes of item windows that are broadcast at most, counted before; more are shuffled, with hot windows salted.
BROADCAST_BYTES = 32_000_000
TOKEN = r"[\p{L}\p{M}]+[.!?:]?|[0-9]+(?:[.,:/-][0-9]+)*|[%$€£°]"
# Words that are units when they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "mph", "kmh", "w", "kw", "v", "a", "hz",
    "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "foot", "feet", "gram", "grams", "kilogram", "kilograms",
    "pound", "pounds", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees",
)


def _digit(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def typed(raw: Column) -> Column:
    """array<string> of typed tokens for an array of raw ones; raw must be a column, not an expression."""

    def one(t: Column, i: Column) -> Column:
        before = F.get(raw, i - 1)
        plain = F.lower(F.rtrim(t, F.lit(".!?:")))
        inside = before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
        return (
            F.when(_digit(t), "<num>").when(t.isin("%", "$", "€", "£", "°"), "<unit>")
            .when(_digit(before) & plain.isin(*UNITS), "<unit>")
            .when(inside & (F.substring(t, 1, 1) != F.substring(plain, 1, 1)), "<name>")
            .otherwise(plain)
        )

    return F.transform(raw, one)


def templates(rows: DataFrame, key: str, text: str, width: int, verbatim: bool = False, carry: str | None = None) -> DataFrame:
    """(key, hashes, slots, n, carried): the hash of each window by place, (place, value) of each placeholder, the windows'
    number and a column of the rows.

    verbatim: as many hashes again follow, of the windows' own words with case folded; null where they are the same.
    """
    carried = F.col(carry) if carry else F.lit(None).cast("long")
    raw = rows.select(F.col(key).alias("key"), carried.alias("carried"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("raw"))
    canon = raw.select("key", "carried", "raw", typed(F.col("raw")).alias("canon"))
    at = lambda i, j: F.get(F.col("canon"), i + j)
    starts = F.when(F.size("canon") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size("canon") - width, F.lit(0))))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[at(i, j) for j in range(width)]))
    if verbatim:
        folded = lambda i, j: F.lower(F.rtrim(F.get(F.col("raw"), i + j), F.lit(".!?:")))
        own = F.transform(starts, lambda i: F.nullif(F.xxhash64(*[folded(i, j) for j in range(width)]), F.xxhash64(*[at(i, j) for j in range(width)])))
        hashes = F.concat(hashes, own)
    held = F.transform("canon", lambda c, i: F.when(c.startswith("<"), F.struct(i.alias("at"), F.lower(F.rtrim(F.get(F.col("raw"), i), F.lit(".!?:"))).alias("value"))))
    return canon.select("key", hashes.alias("hashes"), F.filter(held, lambda s: s.isNotNull()).alias("slots"), F.size(starts).alias("n"), "carried")


def flattened(made: DataFrame) -> DataFrame:
    """A row for each window. The outer form keeps the optimizer from repeating the tokenizing in a filter that it
    would push below, where it would run for every token."""
    flat = made.select("key", "carried", "slots", "n", F.posexplode_outer("hashes").alias("place", "hash"))
    return flat.select("key", "carried", F.when(F.col("place") < F.col("n"), F.col("slots")).otherwise(F.slice("slots", 1, 0)).alias("slots"), (F.col("place") % F.nullif("n", F.lit(0))).alias("at"), "hash")


def windows(made: DataFrame, width: int) -> DataFrame:
    """(key, at, hash, values): a row for each window, with the values behind its placeholders."""
    flat = flattened(made)
    inside = F.filter("slots", lambda s: (s["at"] >= F.col("at")) & (s["at"] < F.col("at") + width))
    return flat.select("key", "at", "hash", F.transform(inside, lambda s: s["value"]).alias("values"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW, leaked: float = LEAKED, verbatim: bool = False) -> DataFrame:
    """(key, item_key, n_windows, coverage) of each document and item that leaked into it.

    verbatim: windows that equal the item's word for word (case folded) count whatever their alignment's other values
    are, and of the others only those that contradict what most of the alignment says don't.
    """
    own = templates(items, item_key, item_text, width, verbatim)
    totals = own.groupBy(F.col("key").alias("item")).agg(F.max("n").alias("item_windows"))
    asked = windows(own, width).filter(F.col("hash").isNotNull()).select(F.col("key").alias("item"), F.col("at").alias("item_at"), "hash", F.col("values").alias("item_values"))
    asked = common.store(asked, "item-windows")
    suspects = common.store(_suspects(docs, asked, totals, key, text, width, verbatim, leaked), "suspects")
    # each suspected document meets the windows of its own items alone; a document has few, whatever the corpus holds
    of = suspects.groupBy("key").agg(F.collect_set("item").alias("seine_items"), F.max(F.col("item").isNull()).alias("nameless"))
    of = of.select(F.col("key").alias("seine_key"), F.struct("seine_items", "nameless").alias("seine_asked"))
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(of, F.col("key").eqNullSafe(F.col("seine_key")))
    # the values are cut out after the join, of windows that matched alone
    flat = flattened(templates(some, "key", "text", width, verbatim, "seine_asked"))
    inside = F.filter("slots", lambda s: (s["at"] >= F.col("at")) & (s["at"] < F.col("at") + width))
    met = _on_hash(flat, asked).filter(F.coalesce(F.array_contains("carried.seine_items", F.col("item")), F.col("carried.nameless")))
    hits = met.select("key", "item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", F.arrays_zip(F.col("item_values").alias("asked"), F.transform(inside, lambda s: s["value"]).alias("told")).alias("pairs"))
    hits = common.store(hits, "template-hits")
    place = ["key", "item", "shift"]
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    sound = _prevailing(hits, place) if verbatim else _consistent(hits, place)
    covered = sound.groupBy("key", "item").agg(F.countDistinct("item_at").cast("long").alias("n_windows"))
    joined = covered.alias("c").join(totals.alias("t"), same("c", "t", ["item"])).select("key", F.col("c.item").alias("item"), "n_windows", F.round(F.col("n_windows") / F.col("item_windows"), 6).alias("coverage"))
    return joined.filter(F.col("coverage") >= leaked).select(F.col("key").alias(key), F.col("item").alias(item_key), "n_windows", "coverage")


def _on_hash(flat: DataFrame, asked: DataFrame) -> DataFrame:
    """flat join asked on the hash: broadcast if asked is small, by its bytes, else dealt with hot hashes salted."""
    text_bytes = F.coalesce(F.aggregate("item_values", F.lit(0), lambda a, v: a + F.octet_length(v) + 16), F.lit(0)) if "item_values" in asked.columns else F.lit(0)
    size = asked.agg(F.sum(text_bytes + 40).alias("b")).first().b or 0
    if size <= BROADCAST_BYTES:
        return flat.join(F.broadcast(asked), "hash")
    return common.salted_join(flat, asked, ["hash"], "key")


def _suspects(docs: DataFrame, asked: DataFrame, totals: DataFrame, key: str, text: str, width: int, verbatim: bool, leaked: float) -> DataFrame:
    """(key, item) of documents that have one of the windows without which the item cannot have leaked."""
    shared = asked.groupBy("hash").agg(F.countDistinct(F.struct("item")).alias("n_items"))
    places = asked.join(shared, "hash").groupBy("item", "item_at").agg(F.max("n_items").alias("n_items"))
    rarest = Window.partitionBy("item").orderBy("n_items", "item_at")
    needed = F.greatest(F.ceil((F.lit(leaked) - 1e-6) * F.col("item_windows")), F.lit(1))
    ranked = places.withColumn("nth", F.row_number().over(rarest)).join(totals.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of")))
    first = ranked.filter(F.col("nth") <= F.col("item_windows") - needed + 1).select(F.col("item").alias("of_item"), F.col("item_at").alias("of_at"))
    probes = asked.join(first, F.col("item").eqNullSafe(F.col("of_item")) & (F.col("item_at") == F.col("of_at")), "left_semi").select("hash", "item").distinct()
    flat = flattened(templates(docs, key, text, width, verbatim)).select("key", "hash")
    return _on_hash(flat, common.store(probes, "item-probes")).select("key", "item").distinct()


def _consistent(hits: DataFrame, place: list[str]) -> DataFrame:
    """Hits of alignments in which no value of the item stands for two values of the text."""
    pairs = hits.select(*place, F.explode("pairs").alias("p")).groupBy(*place, F.col("p.asked").alias("asked")).agg((F.min("p.told") != F.max("p.told")).alias("differ"))
    broken = pairs.filter("differ").select(*place).distinct()
    return hits.alias("h").join(broken.alias("b"), [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place], "left_anti")


def _prevailing(hits: DataFrame, place: list[str]) -> DataFrame:
    """Hits but those with a value other than the one that mostly stands for the item's value along the alignment; of
    values that are as frequent the item's own is taken, then the least. Hits without values all stay."""
    told = hits.select(*place, F.explode("pairs").alias("p")).groupBy(*place, F.col("p.asked").alias("asked"), F.col("p.told").alias("told")).agg(F.count("*").alias("c"))
    ranked = told.select("*", F.struct(-F.col("c"), F.col("told") != F.col("asked"), F.col("told")).alias("order"))
    best = ranked.groupBy(*place, "asked").agg(F.min_by("told", "order").alias("best"))
    against = told.alias("o").join(best.alias("b"), [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*place, "asked"]]).filter("told <> best")
    odd = against.groupBy(*[F.col(f"o.{c}").alias(c) for c in place]).agg(F.collect_set(F.struct(F.col("o.asked").alias("asked"), F.col("o.told").alias("told"))).alias("odd"))
    joined = hits.alias("h").join(odd.alias("b"), [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place], "left")
    verbatim = ~F.exists("pairs", lambda p: ~p["asked"].eqNullSafe(p["told"]))
    return joined.filter(verbatim | F.col("odd").isNull() | ~F.arrays_overlap("pairs", "odd")).select("h.*")


def clean(docs: DataFrame, items: DataFrame, verbatim: bool = False) -> DataFrame:
    """The rows of docs into which no item leaked."""
    leaked = common.unused(docs, "leaked")
    return docs.join(leaks(docs, items, verbatim=verbatim).select(F.col("doc_id").alias(leaked)).distinct(), F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaked into it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _windows_sql(source: str, key: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
  SELECT key, pos, array_to_string(list(canon) OVER w, chr(31)) AS win, count(*) OVER w AS n, total, list(value) FILTER (value IS NOT NULL) OVER w AS vals FROM (
    SELECT *, CASE WHEN canon IN ('<num>', '<unit>', '<name>') THEN plain END AS value FROM (
      SELECT key, pos, total, plain, CASE WHEN t >= '0' AND t < ':' THEN '<num>' WHEN t IN ('%', '$', '€', '£', '°') THEN '<unit>'
        WHEN before >= '0' AND before < ':' AND plain IN ({units}) THEN '<unit>'
        WHEN before IS NOT NULL AND before[-1] NOT IN ('.', '!', '?', ':') AND t[1] <> plain[1] THEN '<name>' ELSE plain END AS canon
      FROM (SELECT key, rid, pos, total, t, lower(rtrim(t, '.!?:')) AS plain, lag(t) OVER (PARTITION BY rid ORDER BY pos) AS before
        FROM (SELECT rid, key, len(toks) AS total, unnest(toks) AS t, unnest(range(len(toks))) AS pos
          FROM (SELECT row_number() OVER () AS rid, {key} AS key, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS toks FROM {source}))) x) y) z
  WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)"""


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT * FROM ({_windows_sql("documents", "doc_id")}) WHERE n = {WINDOW} OR (pos = 0)),
b AS MATERIALIZED (SELECT * FROM ({_windows_sql("benchmark", "item_id")}) WHERE n = {WINDOW} OR (pos = 0)),
hits AS MATERIALIZED (SELECT d.key AS doc_id, b.key AS item_id, d.pos - b.pos AS shift, b.pos AS item_at, b.vals AS asked, d.vals AS told FROM d JOIN b ON d.win = b.win AND d.n = b.n),
broken AS (SELECT DISTINCT doc_id, item_id, shift FROM (
  SELECT doc_id, item_id, shift, a FROM (SELECT doc_id, item_id, shift, unnest(asked) AS a, unnest(told) AS o FROM hits) GROUP BY ALL HAVING min(o) <> max(o))),
c AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS n_windows FROM hits ANTI JOIN broken USING (doc_id, item_id, shift) GROUP BY ALL),
t AS (SELECT key AS item_id, count(*) AS total FROM b GROUP BY key)
SELECT doc_id, item_id, n_windows, round(n_windows / total, 6) AS coverage FROM c JOIN t USING (item_id) WHERE round(n_windows / total, 6) >= {LEAKED}
"""
