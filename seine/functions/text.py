"""Column functions over text: cleaning, extraction and small classifiers. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?<![0-9])(?:\+?[0-9][0-9\s\-().]{7,18}[0-9])(?![0-9])"
JUNK_MAIL_DOMAINS = ("example.com", "test.com", "domain.com", "email.com", "yoursite.com", "website.com", "sentry.io", "wixpress.com")
URL = r"https?://[^\s)>\"']+"
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
ARXIV = r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})"
PATENT = r"\b(?:US|EP|WO|CN|JP|DE|GB|FR)\s?[0-9]{6,12}\s?[A-Z]?[0-9]?\b"
YEAR = r"\b(19[0-9]{2}|20[0-9]{2}|2100)\b"
FROM_ARABIC, TO_ARABIC = "أإآىةؤئ", "ااايهوي"
CONTACT_WORDS = ("contact", "about", "team", "support", "office", "location")


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bound(column: Column, use) -> Column:
    """use(x) with x bound to the column's value: lambdas inside `use` would else evaluate the column for each element."""
    return F.get(F.transform(F.array(column), lambda x: use(x)), F.lit(0))


def first_of_each(array: Column) -> Column:
    """Strings of an array whose lower-cased form didn't come before, in order."""
    return bound(array, lambda a: bound(F.transform(a, lambda x: F.lower(x)), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def clean(c: Column) -> Column:
    """Stripped, with runs of white space as one blank; null is empty."""
    return F.regexp_replace(F.regexp_replace(text_of(c), r"(?U)\s+", " "), "^ | $", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or a spelled-out nothing."""
    return F.lower(F.trim(text_of(c))).isin("", "nan", "none", "null")


def first_filled(*columns: Column) -> Column:
    """The first column with more than white space, stripped; else empty."""
    return F.coalesce(*[F.nullif(F.trim(text_of(c)), F.lit("")) for c in columns], F.lit(""))


def fold_arabic(c: Column) -> Column:
    """Marks dropped and variants of letters made one."""
    bare = F.regexp_replace(text_of(c), "[ؐ-ًؚ-ٰٟۖ-ۭ]", "")
    return clean(F.translate(bare, FROM_ARABIC, TO_ARABIC))


def normal(c: Column) -> Column:
    return F.lower(fold_arabic(c))


def label(c: Column) -> Column:
    """Lower case without tatweel and marks."""
    return clean(F.regexp_replace(F.lower(text_of(c)), "[ـؐ-ًؚ-ٰٟ]", ""))


def has_arabic(c: Column) -> Column:
    return text_of(c).rlike("[؀-ۿ]")


def has_latin(c: Column) -> Column:
    return text_of(c).rlike("[A-Za-z]")


def languages(c: Column) -> Column:
    """The scripts' languages that a text shows; English where it shows none."""
    found = F.array_compact(F.array(F.when(has_latin(c), "en"), F.when(has_arabic(c), "ar")))
    return F.when(F.size(found) == 0, F.array(F.lit("en"))).otherwise(found)


def sentences(c: Column) -> Column:
    """Split behind . ! or ?; empty pieces are dropped."""
    return F.filter(F.split(clean(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def first_sentences(c: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(c), 1, n), " ")


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last three of them dots where something was cut."""
    # n + 1 characters that stay are enough, however long the text is
    c = clean(F.regexp_extract(text_of(c), rf"(?U)^(?:\s*+\S){{0,{n + 1}}}", 0))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("...")))


def slug(c: Column, most: int = 60) -> Column:
    # each letter and digit is one of the slug, so what stands behind as many as it may have is not in it
    head = F.regexp_extract(F.lower(text_of(c)), rf"^(?:[^a-z0-9]*+[a-z0-9]){{0,{most}}}", 0)
    words = F.regexp_replace(F.regexp_replace(head, r"[^a-z0-9_\s-]", ""), r"[\s_-]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(cut == "", "report").otherwise(cut)


def emails(c: Column) -> Column:
    """Distinct lower-cased addresses in order, without those of placeholder domains."""
    found = F.transform(F.regexp_extract_all(text_of(c), F.lit(EMAIL), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda e: ~F.substring_index(e, "@", -1).isin(*JUNK_MAIL_DOMAINS)))


def digits(c: Column) -> Column:
    return F.regexp_replace(text_of(c), "[^0-9]", "")


def phones(c: Column) -> Column:
    """Distinct numbers of 7 to 15 digits in order."""
    found = F.transform(F.regexp_extract_all(text_of(c), F.lit(PHONE), F.lit(0)), clean)
    return F.array_distinct(F.filter(found, lambda p: F.length(digits(p)).between(7, 15)))


def urls(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;"))))


def doi(c: Column) -> Column:
    return F.rtrim(F.regexp_extract(text_of(c), DOI, 0), F.lit(").,;"))


def arxiv_id(c: Column) -> Column:
    return F.regexp_extract(F.lower(text_of(c)), ARXIV, 1)


def year(c: Column) -> Column:
    return F.regexp_extract(text_of(c), YEAR, 1)


def patents(c: Column) -> Column:
    """Distinct numbers, in capitals and without blanks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(text_of(c)), F.lit(PATENT), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", "")))


def authors(c: Column) -> Column:
    """Names between commas, semicolons and "and", two characters or more, first spelling kept of each."""
    names = F.filter(F.transform(F.split(text_of(c), r"(?i)\s*[,;]\s*|\s+and\s+"), clean), lambda a: F.length(a) >= 2)
    return first_of_each(names)


def tender_deadline(c: Column) -> Column:
    return F.regexp_extract(text_of(c), r"(?i)(?:deadline|closing date|due date)[:\s]+([A-Za-z0-9,/\- ]{6,30})", 1)


def tender_buyer(c: Column) -> Column:
    return clean(F.regexp_extract(text_of(c), r"(?i)(?:buyer|issuer|authority|ministry)[:\s]+([A-Za-z0-9&.,\- ]{3,80})", 1))


def exhibitors(c: Column) -> Column:
    """Names on lines, bullets or between bars: capitalised, 2 to 120 characters, first of each kept."""
    names = F.transform(F.split(text_of(c), r"[\n•|]+"), lambda s: clean(F.regexp_replace(s, r"^[\s\-*0-9.)]+", "")))
    return F.array_distinct(F.filter(names, lambda s: F.length(s).between(2, 120) & s.rlike("^[A-Z]")))


def standing(c: Column, terms: list[str]) -> Column:
    """The terms that stand in the text, as plain strings, in their order. The text is evaluated once for all of them."""
    return bound(c, lambda t: F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda x: t.contains(x)))


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text, as a plain string."""
    return bound(c, lambda t: F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda x: t.contains(x)))


def hits(c: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text."""
    return F.size(standing(c, terms))


def fenced(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """df with columns that later expressions refer to and the optimizer doesn't repeat in each of them: what a generator
    gives."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in names.items()]))).alias("seine_row")
    return df.select("*", row).select(*df.columns, *[F.col(f"seine_row.{n}").alias(n) for n in names])


def meaningful(s: Column) -> Column:
    """A sentence worth quoting: 45 to 320 characters, no address, few digits, thirty letters or more."""
    return F.length(s).between(45, 320) & ~s.rlike(r"(?i)https?://|www\.") & (F.length(F.regexp_replace(s, "[^0-9]", "")) <= 12) & (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 30)


def keywords(c: Column) -> Column:
    """Lower-cased words of four letters or more."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z]{4,}"), F.lit(0))


# Words that topics leave out, lines that name no exhibitor, words of organisations' names.
NO_TOPIC = (
    "find", "show", "search", "get", "companies", "company", "people", "papers", "paper", "profiles", "with", "and", "for", "the", "that", "this", "from",
    "inside", "outside", "operating", "working", "في", "من", "على", "عن", "الى", "إلى", "مع", "شركة", "شركات", "بحث", "ابحث", "أبحث",
)
NO_EXHIBITOR = ("exhibitors", "sponsors", "partners", "conference", "event", "download", "register", "login")
OF_COMPANIES = r"(?i)\b(company|services|solutions|engineering|technology|systems|group|ltd|llc|inc|corp)\b"
ACADEMIC_HINTS = ("doi", "abstract", "journal", "conference", "proceedings", "pdf", "scholar", "research")
EVENT_HINTS = ("conference", "summit", "expo", "event", "speaker", "exhibitor", "workshop", "forum")


def topic_terms(c: Column, most: int = 12) -> Column:
    """The first different words of two characters or more that say what a text is about."""
    words = F.regexp_extract_all(label(c), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_\-]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*NO_TOPIC))), 1, most)


def exhibitor_names(items: Column) -> Column:
    """Names of 2 to 120 characters without bullets, the first of each whatever its case, and no headings."""
    names = F.transform(items, lambda s: F.regexp_replace(F.regexp_replace(text_of(s), r"\s+", " "), r"^[ \-•\t]+|[ \-•\t]+$", ""))
    return first_of_each(F.filter(names, lambda s: F.length(s).between(2, 120) & ~F.lower(s).isin(*NO_EXHIBITOR)))


def company_lines(c: Column) -> Column:
    """Lines of up to 120 characters with a word of organisations' names, the first of each whatever its case."""
    lines = F.transform(F.split(text_of(c), r"\r\n|\n|\r"), clean)
    return first_of_each(F.filter(lines, lambda s: (s != "") & (F.length(s) <= 120) & s.rlike(OF_COMPANIES)))


def mask(c: Column) -> Column:
    """The first four and last two characters of a secret; short ones give stars alone."""
    return F.when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("***"), F.substring(c, -2, 2)))
