"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds of span are found in whole texts. Every candidate value is hashed, and the hashes are
aggregated over the corpus by distinct repositories and owners. A value that several owners share, or that lies in
many repositories even of one owner, is a copied example; a value that one owner alone holds in few repositories is
specific to the owner, and if it looks random it is taken to be a live credential. The spans of such values are added
under the kind ``live``; base spans always stay.

Defined results: a null or empty text has no spans; rows with equal keys or texts are each judged by
themselves; null keys, owners and repositories are values like any other (a null owner or repository counts as none);
an empty table gives an empty result; columns of the input other than the named ones are ignored, whatever their
names; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

# The patterns of the three base kinds, in the order that breaks ties between them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live")

#: Distinct owners, and distinct repositories, from which on a value is taken for a copied example: a credential in use
#: is kept in few places of one owner.
OWNERS, REPOSITORIES = 2, 10

SPAN = "struct<start:int,k:int,end:int,vstart:int,value:string>"


def _cut(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches whose group has `least` characters or more.

    The gaps between matches and the matches themselves alternate, so running sums of their lengths
    (Spark's length counts code points) are the places.
    """
    pair = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("k"), stop.alias("end"), (stop - F.length(value)).alias("vstart"), value.alias("value"))
        keep = x["hit"].isNotNull() & (F.length(value) >= least)
        return F.struct(stop.alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pair, start, step, lambda acc: acc["found"])
    return F.coalesce(F.when(text.rlike(pattern), found), F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start and kind, as array<SPAN>; the secret itself is `value`, at `vstart`."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(_cut(text, ASSIGN, 0, 1, 6), _cut(text, ACCESS, 1, 0, 20), _cut(text, HEX, 2, 0, 24)))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def live_looking(value: Column) -> Column:
    """Random to look at: letters and digits, eight or more characters that differ, no word of a placeholder."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.length(value) >= 12) & (chars >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        & ~value.rlike("(?i)example|sample|dummy|test|changeme|placeholder|xxxx")
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repositories) over the corpus from rows (digest, owner, repository).

    Rows are made distinct with partial aggregation before each shuffle, so a value that fills a third of
    the corpus arrives as one row from each task.
    """
    owners = candidates.select("digest", "owner").distinct().groupBy("digest").agg(F.count("owner").alias("n_owners"))
    repositories = candidates.select("digest", "repository").distinct().groupBy("digest").agg(F.count("repository").alias("n_repositories"))
    return owners.join(repositories, "digest")


def found_in(docs: DataFrame, key: str, text: str, owner: str, repository: str | None) -> DataFrame:
    """(key, owner, repository, spans) of each row; spans carry the value's digest and whether it looks live, not the value."""
    found = docs.select(
        F.col(key).alias("key"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository or key).cast("string").alias("repository"),
        base_spans(F.col(text)).alias("spans"),
    )
    return found.withColumn("spans", F.transform("spans", hashed))


def hashed(s: Column) -> Column:
    return F.struct(s["start"], s["k"], s["end"], s["vstart"], F.sha2(s["value"], 256).alias("digest"), live_looking(s["value"]).alias("looks"))


def specific(found: DataFrame, owners_from: int, repositories_from: int) -> DataFrame:
    """(judged_key, own): for each key the digests of its values that are specific to their owner, by the whole corpus.

    A value that fills a third of the corpus is dealt to many tasks by its rows' keys; what it meets there is one row,
    and only of values in few repositories.
    """
    candidates = found.select("key", "owner", "repository", F.explode("spans.digest").alias("digest"))
    few = ownership(candidates).filter((F.col("n_owners") < owners_from) & (F.col("n_repositories") < repositories_from)).select("digest")
    held = common.salted_join(candidates.select("key", "digest").distinct(), few, ["digest"], "key")
    return held.groupBy(F.col("key").alias("judged_key")).agg(F.collect_set("digest").alias("own"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, owners_from: int = OWNERS, repositories_from: int = REPOSITORIES) -> DataFrame:
    """One row for each of docs: key, base and live spans (start, kind index, end), and n_copied, the copied values in it.

    `repository` defaults to the key: each document is then a repository of its own.
    """
    found = common.store(found_in(docs, key, text, owner, repository), "secrets")
    judged = specific(found, owners_from, repositories_from)
    out = found.join(judged, F.col("key").eqNullSafe(F.col("judged_key")), "left").select("key", "spans", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    live_spans = F.transform(
        F.filter("spans", lambda s: s["looks"] & F.array_contains("own", s["digest"])),
        lambda s: F.struct(s["vstart"].alias("start"), F.lit(3).alias("k"), s["end"].alias("end")),
    )
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    copied = F.size(F.array_except(F.array_distinct("spans.digest"), "own"))
    return out.select(F.col("key").alias(key), base.alias("base"), F.array_distinct(live_spans).alias("live"), copied.cast("long").alias("n_copied"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest columns for every document."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_copied",
    )


def redact(docs: DataFrame, owners_from: int = OWNERS, repositories_from: int = REPOSITORIES) -> DataFrame:
    """docs with the value of every base span masked in `text`: <secret> where it is live, <credential> elsewhere.

    What is live depends on the value alone, so documents are joined with their ids' values; rows of one id need not
    be told apart.
    """
    found = common.store(found_in(docs, "doc_id", "text", "source", None).filter(F.size("spans") > 0), "secrets")
    judged = specific(found, owners_from, repositories_from)
    spans = common.fenced(docs, "seine_spans", F.transform(base_spans(F.col("text")), hashed))
    joined = spans.join(judged.select(F.col("judged_key").alias("seine_key"), F.col("own").alias("seine_own")), F.col("doc_id").eqNullSafe(F.col("seine_key")), "left")
    own = F.coalesce("seine_own", F.array().cast("array<string>"))
    values = F.transform("seine_spans", lambda s: F.struct(s["vstart"].alias("start"), s["end"].alias("end"), (s["looks"] & F.array_contains(own, s["digest"])).alias("live")))

    def step(acc: Column, v: Column) -> Column:
        mask = F.when(v["live"], "<secret>").otherwise("<credential>")
        out = F.when(v["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, v["start"] - acc["at"]), mask))
        return F.struct(F.greatest(acc["at"], v["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.array_sort(values), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.size("seine_spans") == 0, F.col("text")).otherwise(masked)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _kind_sql(pattern: str, kind: int, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract(hit, '{quoted}', {group})"
    return f"""
    SELECT rid, {kind} AS k, start, stop, {value} AS value FROM (
      SELECT rid, hit, stop - length(hit) AS start, stop FROM (
        SELECT rid, hits[i] AS hit,
          list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(hits[1:i], lambda x: length(x)))::BIGINT AS stop
        FROM (SELECT rid, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT rid, string_split_regex(body, '{quoted}') AS gaps, regexp_extract_all(body, '{quoted}') AS hits
          FROM d WHERE regexp_matches(body, '{quoted}')))))
    WHERE length({value}) >= {least}"""


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
s AS MATERIALIZED ({_kind_sql(ASSIGN, 0, 1, 6)} UNION ALL {_kind_sql(ACCESS, 1, 0, 20)} UNION ALL {_kind_sql(HEX, 2, 0, 24)}),
c AS (SELECT d.doc_id, d.source, s.* FROM s JOIN d USING (rid)),
o AS (SELECT value, count(DISTINCT source) >= {OWNERS} OR count(DISTINCT doc_id) >= {REPOSITORIES} AS copied,
        length(value) >= 12 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND NOT regexp_matches(value, '(?i)example|sample|dummy|test|changeme|placeholder|xxxx') AS looks
      FROM c GROUP BY value),
live AS (SELECT DISTINCT rid, stop - length(value) AS start, 3 AS k, stop FROM c JOIN o USING (value) WHERE looks AND NOT copied),
named AS (SELECT rid, start, k, stop, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || start || ':' || stop AS word FROM (SELECT rid, start, k, stop FROM s UNION ALL SELECT rid, start, k, stop FROM live)),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_live,
        string_agg(word, ',' ORDER BY start, k, stop) FILTER (k < 3) AS base, string_agg(word, ',' ORDER BY start, k, stop) AS spans FROM named GROUP BY rid),
p AS (SELECT rid, count(DISTINCT value) AS n_copied FROM c JOIN o USING (value) WHERE copied GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (rid) LEFT JOIN p USING (rid)
"""
