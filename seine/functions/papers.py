"""Column functions over papers: authors in running text, pages that are no papers, and words of reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import bound, clean, first_filled, text_of

# Words that no list of authors begins with.
NO_AUTHORS = (
    "abstract", "using", "results", "methods", "study", "approach", "analysis", "based", "show", "data", "research", "presented", "model", "method", "technique", "system", "maximizing", "improving",
    "considering", "alongside", "consistent", "poor", "deploying", "background", "objective", "conclusion", "findings", "introduction",
)
# How authors are written, the part that names them, and what is taken out of it, in the order in which they are tried.
AUTHORS = (
    (r"[*]\s*([A-Z][a-zA-Zéàüöçõã-]+,\s+[A-Z][a-zA-Zéàüöçõã-]+(?:;\s*[*]?\s*[A-Z][a-zA-Zéàüöçõã-]+,\s+[A-Z][a-zA-Zéàüöçõã-]+)+)", r"[*]\s*"),
    (r"([A-Z][a-z]+ [A-Z][.] [A-Za-z]+\d*[,*]*(?:,? [A-Z][a-z]+ [A-Z][.] [A-Za-z]+\d*[,*]*)*(?: and [A-Z][a-z]+ [A-Z][.] [A-Za-z]+)?)", r"[\d*]+"),
    (r"([A-Z][a-zéáúóí]+ [A-Z][a-zéáúóí]+(?:\s*\d+)?,\s*[A-Z][a-zéáúóí]+ [A-Z][a-zéáúóí]+)", r"\s*\d+"),
    (r"(?i)written\s+by\s+([A-Z][a-z]+ [A-Z][a-z]+(?:,\s+[A-Z][a-z]+ [A-Z][a-z]+)*)", ""),
    (r"([A-Z][a-z]+,\s+[A-Z][a-z]+(?: [A-Z][.])?(?:;\s+[A-Z][a-z]+,\s+[A-Z][a-z]+(?: [A-Z][.])?)+)", ""),
    (r"[Bb]y ([A-Z][a-z]+ [A-Z][a-z]+(?: and [A-Z][a-z]+ [A-Z][a-z]+)*)", ""),
)
# What tells a page about papers from a paper.
TITLES = ("journal", "for authors", "articles in press", "volume", "issue", "homepage", "guide", "database", "submission", "editorial board", "table of contents")
BODIES = (
    "submit your manuscript", "for authors", "aim and scope", "editorial board", "instructions for authors", "quarterly journal", "articles in press", "browse volumes", "journal homepage", "subscription database",
)
PLACES = ("for-authors", "articles-in-press")
SHORT = ("journal", "onepetro", "sciengine")
REPORT_TITLES = ("latest research papers", "journal", "conclusion -", "(pdf)", "water pump", "sewage", "transfer", "koi pond", "fish tank", "services", "sciencegate", "sciencedirect.com/journal")
REPORT_REFERENCES = ("sciencegate", "sciencedirect.com/journal", "/keyword/", "/journal/")
#: Characters of a text that are searched for authors, as a head of a paper is, and of authors that are kept.
HEAD, MOST = 6000, 300


def authors(c: Column) -> Column:
    """The longest list of authors, in any of the ways they are written, that does not begin like a sentence; empty if none."""
    head = F.substring(text_of(c), 1, HEAD)

    def found(h: Column) -> Column:
        tried = []
        for n, (pattern, off) in enumerate(AUTHORS):
            said = F.regexp_extract(h, pattern, 1)
            said = F.trim(F.regexp_replace(said, off, "")) if off else said
            said = F.rtrim(said, F.lit(",")) if n == 1 else said
            begins = F.slice(F.filter(F.split(F.lower(said), r"\s+"), lambda w: w != ""), 1, 3)
            tried.append(F.when((F.length(said) >= 5) & ~F.arrays_overlap(begins, F.array(*map(F.lit, NO_AUTHORS))), F.struct((-F.length(said)).alias("n"), F.lit(n).alias("k"), said.alias("s"))))
        return F.substring(F.coalesce(F.array_min(F.array_compact(F.array(*tried)))["s"], F.lit("")), 1, MOST)

    return bound(head, found)


def _any(c: Column, pieces) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | c.contains(p)
    return out


def no_paper(title: Column, abstract: Column, address: Column) -> Column:
    """Whether a summariser passes over what it was given: a journal's own pages, and stubs."""
    t, a, d = (F.lower(clean(x)) for x in (title, abstract, address))
    return _any(t, TITLES) | _any(a, BODIES) | _any(d, PLACES) | ((F.length(a) < 80) & _any(t, SHORT))


def no_paper_for_report(title: Column, reference: Column) -> Column:
    """Whether a report leaves a page out, by its title or reference."""
    return _any(F.lower(text_of(title)), REPORT_TITLES) | _any(F.lower(text_of(reference)), REPORT_REFERENCES)


def summary(*columns: Column) -> Column:
    """The first of summary, description, snippet, notes and abstract that says something."""
    return first_filled(*columns)


def context_line(n: Column, title: Column, who: Column, year: Column, reference: Column, abstract: Column, most: int = 700) -> Column:
    """The lines of one paper in a context block: what is blank is left out, long abstracts are cut."""
    cut = bound(clean(abstract), lambda a: F.when(F.length(a) <= most, a).otherwise(F.concat(F.rtrim(F.substring(a, 1, most - 3)), F.lit("..."))))
    lines = [F.concat(n.cast("string"), F.lit(". "), text_of(title))]
    lines += [F.when(text_of(v) != "", F.concat(F.lit(f"   {name}: "), text_of(v))) for name, v in (("Authors", who), ("Year", year), ("Source", reference), ("Abstract", cut))]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def packet(n: Column, title: Column, who: Column, year: Column, reference: Column, abstract: Column) -> Column:
    """The section of one paper in a packet for review."""
    lines = [F.format_string("## %s. %s", n.cast("string"), text_of(title)), F.concat(F.lit("- Authors: "), text_of(who))]
    lines += [F.when(text_of(v) != "", F.concat(F.lit(f"- {name}: "), text_of(v))) for name, v in (("Year", year), ("Reference", reference))]
    lines.append(F.when(text_of(abstract) != "", F.concat(F.lit("\n### Abstract / Context\n"), text_of(abstract))))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
