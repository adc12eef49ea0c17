"""Column functions over addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import text_of

# Public suffixes of two labels that are told apart; others count as one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "org.au", "com.eg", "edu.eg", "gov.eg", "com.sa", "com.br", "co.jp", "co.in", "co.nz", "co.za", "com.tr", "com.mx", "com.cn", "com.sg", "com.my")


def host(c: Column) -> Column:
    """Lower-cased host without scheme, www, port and path."""
    bare = F.regexp_replace(F.lower(F.trim(text_of(c))), "^[a-z][a-z0-9+.-]*://", "")
    return F.rtrim(F.regexp_replace(F.regexp_replace(bare, "[/?#:].*$", ""), "^www[0-9]*[.]", ""), F.lit("."))


def domain(c: Column) -> Column:
    """The registrable part of the host."""
    h = host(c)
    two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def normal_url(c: Column) -> Column:
    """https, no www, port, query, fragment or closing slash; empty stays empty."""
    raw = F.trim(text_of(c))
    rest = F.regexp_replace(F.regexp_replace(raw, "^https?://", ""), "[?#].*$", "")
    path = F.regexp_extract(rest, "^[^/]*(/.*)$", 1)
    return F.when(raw == "", "").otherwise(F.rtrim(F.concat(F.lit("https://"), host(raw), path), F.lit("/")))


def root_url(c: Column) -> Column:
    return F.when(F.trim(text_of(c)) == "", "").otherwise(F.concat(F.lit("https://"), host(c)))


def join_url(base: Column, path: Column) -> Column:
    """A link on a page: absolute, from the root, or beside the page."""
    return (
        F.when(path.rlike("^[a-z][a-z0-9+.-]*:"), path).when(path.startswith("//"), F.concat(F.lit("https:"), path))
        .when(path.startswith("/"), F.concat(root_url(base), path))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^/])/[^/]*$", ""), F.lit("/"), path))
    )


def is_profile(c: Column) -> Column:
    return c.contains("/in/") & ~c.contains("/company/")


def is_company_profile(c: Column) -> Column:
    return c.contains("linkedin.com/company/")


def kept_by_gate(c: Column, people: bool) -> Column:
    """What a search for people, or for others, takes of results: personal profiles alone, or nothing of that network."""
    low = F.lower(text_of(c))
    return low.contains("linkedin.com/in/") if people else ~low.contains("linkedin.com")
