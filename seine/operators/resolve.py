"""Resolution of records of the same organisation.

Records with one domain, then with one name key, become one; what is left is compared by name (`namejoin`). Merging takes each field from the best record that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import names
from seine.operators.greedy import first_matches
from seine.operators.namejoin import similar_pairs
from seine.operators.score import quality
from seine.session import scratch, stored

FIELDS = ("company_name", "email", "phone", "linkedin_url", "contact_page", "country", "hq_country")


def _best(c: str) -> Column:
    """The column's value of the best record that has one; the earlier of equals."""
    return F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct(F.col("seine_quality"), -F.col("seq")))), F.lit("")).alias(c)


def _least(c: str) -> Column:
    """The shortest filled value, the earlier of equals."""
    return F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct(F.length(c), F.col("seq")))), F.lit("")).alias(c)


def merge(df: DataFrame, key: Column) -> DataFrame:
    """One record for each key; rows whose key is empty stay by themselves."""
    own = df.withColumn("seine_quality", quality()).withColumn("seine_key", F.when(key != "", key).otherwise(F.concat(F.lit("\x00"), F.col("seq").cast("string"))))
    longest = F.coalesce(F.max_by("description", F.struct(F.length("description"), -F.col("seq"))), F.lit("")).alias("description")
    page = F.when(F.max((F.col("page_type") == "company").cast("int")) == 1, "company").otherwise(F.max_by("page_type", F.struct("seine_quality", -F.col("seq")))).alias("page_type")
    return own.groupBy("seine_key").agg(
        F.min("seq").alias("seq"), *[_best(c) for c in FIELDS], _least("website"), _least("domain"), longest, page,
        F.min("is_directory_or_media").alias("is_directory_or_media"), F.max("confidence_score").alias("confidence_score"), F.count("*").alias("n_merged"),
    ).drop("seine_key")


def by_domain(df: DataFrame) -> DataFrame:
    return merge(df, F.col("domain"))


def by_name(df: DataFrame) -> DataFrame:
    return merge(df, names.name_key(F.col("company_name")))


def pairs(df: DataFrame) -> DataFrame:
    """(seq_a, seq_b) of records with similar names. Records with one clean name meet as one, the earliest."""
    return _alike(_cleaned(df))


def _cleaned(df: DataFrame) -> DataFrame:
    return df.select("seq", names.clean_name(F.col("company_name")).alias("clean"), names.acronym(F.col("company_name")).alias("short"))


def _alike(n: DataFrame) -> DataFrame:
    """`pairs` of (seq, clean, short)."""
    one = n.filter("clean <> ''").groupBy("clean").agg(F.min("seq").alias("id"), F.min_by("short", "seq").alias("short"))
    with scratch() as keep:
        return keep(similar_pairs(one).select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b")), "similar")


def _conflict(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def same_entity(a: str, b: str) -> Column:
    """Whether two records, as structs, may be one organisation: their domains agree; or their keys do and no domains
    conflict; or their names are similar and neither domains nor countries conflict."""
    x, y = F.col(a), F.col(b)
    key = lambda r: F.when(r["domain"] != "", r["domain"]).otherwise(names.clean_name(r["company_name"]))
    place = lambda r: F.lower(F.trim(F.when(r["hq_country"] != "", r["hq_country"]).otherwise(r["country"])))
    apart = _conflict(x["domain"], y["domain"])
    clean, short = (lambda r: names.clean_name(r["company_name"])), (lambda r: names.acronym(r["company_name"]))
    alike = names.similar_names(clean(x), clean(y), short(x), short(y))
    return ((x["domain"] != "") & (x["domain"] == y["domain"])) | ((key(x) != "") & (key(x) == key(y)) & ~apart) | (alike & ~apart & ~_conflict(place(x), place(y)))


def dedup(df: DataFrame) -> DataFrame:
    """One record for each organisation, in three passes: by domain; by name key where a record may be one with the key's
    first record; by similar names, each record tied to the earliest kept one that it may be one with.

    Records are compared as the pass before left them; what they take over within a pass doesn't tie further ones.
    """
    with scratch() as keep:
        one = stored(by_domain(df).drop("n_merged"), "by-domain")
        fields = ["seq", "company_name", "domain", "country", "hq_country"]
        rec = one.select("seq", F.struct(*fields).alias("rec"), names.name_key(F.col("company_name")).alias("key"))
        first = rec.filter("key <> ''").groupBy("key").agg(F.min_by("rec", "seq").alias("of"), F.min("seq").alias("head"))
        named = rec.join(first, "key").filter(F.col("seq") != F.col("head")).withColumn("same", same_entity("rec", "of")).filter("same").select("seq", "head")
        two = stored(_tied(one, named), "by-name")
        other = two.select("seq", F.struct(*fields).alias("rec"))
        met = pairs(two).join(other.select(F.col("seq").alias("seq_a"), F.col("rec").alias("a")), "seq_a").join(other.select(F.col("seq").alias("seq_b"), F.col("rec").alias("b")), "seq_b")
        return keep(_tied(two, first_matches(met.withColumn("same", same_entity("a", "b")).filter("same").select("seq_a", "seq_b"))), "resolved")


def accepted(df: DataFrame) -> DataFrame:
    """(seq, accepted, duplicate_of): records in order of seq, each accepted unless an accepted one has a similar name, the
    earliest of which it duplicates. Records without a name are accepted."""
    with scratch() as keep:
        own = stored(_cleaned(df), "names")
        first = own.filter("clean <> ''").groupBy("clean").agg(F.min("seq").alias("first"))
        ties = first_matches(_alike(own))
        # of equal names the first one stands for all: what it duplicates, or it itself, is what the others duplicate
        headed = first.join(ties.withColumnRenamed("seq", "first"), "first", "left").select("clean", F.coalesce("head", "first").alias("head"))
        found = own.join(headed, "clean", "left").select("seq", F.when(F.col("head") != F.col("seq"), F.col("head")).alias("duplicate_of"))
        return keep(found.select("seq", F.col("duplicate_of").isNull().alias("accepted"), "duplicate_of"), "accepted")


def _tied(df: DataFrame, ties: DataFrame) -> DataFrame:
    headed = df.join(ties, "seq", "left").withColumn("seine_head", F.coalesce("head", "seq").cast("string")).drop("head")
    return merge(headed, F.col("seine_head")).drop("n_merged")


def anti_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key, if filled, is not among the known ones."""
    return df.join(known.select(F.col(key).alias("seine_known")).filter("seine_known <> ''").distinct(), F.col(key) == F.col("seine_known"), "left_anti")
