"""Pages as arrays of nodes, and column functions over them.

A node has its place (`at`, which is its index in the array), its parent's, the place of its last descendant, its depth, tag,
attributes and, if it is a piece of text, the text. What lies inside a node is thus a slice of the array, and text comes in
the order of the page. Node 0 stands for the page. Tags that never hold anything are leaves; items, rows, cells, options and
paragraphs that the page leaves open end where the next one begins; a closing tag ends what was left open inside, and one
that closes nothing is passed over. Text of scripts, styles and templates has the tag #script, other text #text.

Defined results: null and empty pages have node 0 alone; of an attribute that stands twice the first counts; an attribute
without a value is empty; a character reference counts where a semicolon ends it, else it is text as it stands.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.functions.text import bound, clean

NODE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("at", "parent", "last", "depth")]
    + [T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]
)
_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))
# Fixed values of HTML: elements without content, and what an opening tag ends if it was left open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {b: ("p",) for b in BLOCKS}
HIDDEN = ("script", "style", "template")
#: Pages that a task holds as Python objects.
AT_ONCE = 32
#: Comments, scripts and styles, in which references are not read; and an ampersand that begins no whole reference.
_BARE = re.compile(r"<!--.*?-->|<(script|style)\b.*?(?:</\1|\Z)|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)", re.I | re.S)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [{"at": 0, "parent": -1, "last": 0, "depth": 0, "tag": "#page", "attrs": [], "text": None}]
        self.open = [0]

    def add(self, tag: str, attrs: list[tuple[str, str]], text: str | None) -> int:
        at, up = len(self.nodes), self.open[-1]
        self.nodes.append({"at": at, "parent": up, "last": at, "depth": self.nodes[up]["depth"] + 1, "tag": tag, "attrs": attrs, "text": text})
        return at

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.nodes[self.open[-1]]["tag"] in ENDS.get(tag, ()):
            self.open.pop()
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        at = self.add(tag, [*first.items()], None)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.add("#script" if self.nodes[self.open[-1]]["tag"] in HIDDEN else "#text", [], data)


def read(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(_BARE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html or ""))
    reader.close()
    for node in reversed(reader.nodes[1:]):
        up = reader.nodes[node["parent"]]
        up["last"] = max(up["last"], node["last"])
    return reader.nodes


@F.arrow_udf(T.ArrayType(NODE))
def nodes(html: pa.Array) -> pa.Array:
    """The nodes of pages, read a few at a time: as Python objects they take many times their room in Arrow."""
    some = [pa.array([read(h.as_py()) for h in html[k : k + AT_ONCE]], _ARROW) for k in range(0, len(html), AT_ONCE)]
    return pa.concat_arrays(some) if some else pa.array([], _ARROW)


def attribute(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def named(of: Column, *tags: str) -> Column:
    """The nodes with one of these tags, in order."""
    return F.filter(of, lambda n: n["tag"].isin(*tags))


def inside(of: Column, node: Column) -> Column:
    """All that lies inside a node."""
    return F.slice(of, node["at"] + 2, node["last"] - node["at"])


def joined(of: Column) -> Column:
    """The pieces of text among nodes, stripped, with blanks between them."""
    return clean(F.array_join(F.filter(F.transform(named(of, "#text"), lambda n: F.btrim(n["text"], F.lit(" \t\n\r\f\x0b"))), lambda t: t != ""), " "))


def text_in(of: Column, node: Column) -> Column:
    return joined(inside(of, node))


def title(of: Column) -> Column:
    return bound(of, lambda ns: F.coalesce(F.get(F.transform(named(ns, "title"), lambda n: text_in(ns, n)), F.lit(0)), F.lit("")))


def metas(of: Column) -> Column:
    """array<struct<key,content>> of meta tags with content: the lower-cased name, else property."""
    key = lambda n: F.lower(F.trim(F.when(attribute(n, "name") != "", attribute(n, "name")).otherwise(attribute(n, "property"))))
    return F.filter(F.transform(named(of, "meta"), lambda n: F.struct(key(n).alias("key"), clean(attribute(n, "content")).alias("content"))), lambda m: m["content"] != "")


def meta(of: Column, *keys: str) -> Column:
    """The content of the first tag with the first of these keys that has any."""

    def first(ms: Column, key: str) -> Column:
        return F.get(F.filter(ms, lambda m: m["key"] == key), F.lit(0))["content"]

    return bound(metas(of), lambda ms: F.coalesce(*[first(ms, k) for k in keys], F.lit("")))


def anchors(of: Column) -> Column:
    """array<struct<href,text>> of links, in order."""
    return bound(of, lambda ns: F.transform(F.filter(named(ns, "a"), lambda n: F.trim(attribute(n, "href")) != ""), lambda n: F.struct(F.trim(attribute(n, "href")).alias("href"), text_in(ns, n).alias("text"))))


def properties(of: Column, *names: str) -> Column:
    """array<struct<name,text>> of nodes with one of these itemprops: what they say, else their content."""
    said = lambda ns, n: bound(text_in(ns, n), lambda t: F.when(t != "", t).otherwise(clean(attribute(n, "content"))))
    return bound(of, lambda ns: F.transform(F.filter(ns, lambda n: attribute(n, "itemprop").isin(*names)), lambda n: F.struct(attribute(n, "itemprop").alias("name"), said(ns, n).alias("text"))))


def cards(of: Column) -> Column:
    """What business cards (classes vcard and h-card) say, in order; cards inside cards too."""
    is_card = lambda n: F.arrays_overlap(F.split(attribute(n, "class"), r"\s+"), F.array(F.lit("vcard"), F.lit("h-card")))
    return bound(of, lambda ns: F.transform(F.filter(ns, is_card), lambda n: text_in(ns, n)))


def scripts(of: Column, kind: str) -> Column:
    """The bodies of scripts of a type."""
    return bound(of, lambda ns: F.transform(F.filter(named(ns, "script"), lambda n: F.lower(F.trim(attribute(n, "type"))) == kind), lambda n: F.array_join(F.transform(inside(ns, n), lambda x: x["text"]), "")))


#: What is no part of a page's main text.
ASIDE = ("nav", "header", "footer", "aside", "form", "button", "noscript", "select", "title", "head")


def main_text(of: Column) -> Column:
    """The text of the page's articles, else of its main part, else of all of it, without menus, heads, feet, asides and forms."""

    def without(ns: Column, n: Column) -> Column:
        return bound(inside(ns, n), lambda part: bound(named(part, *ASIDE), lambda off: joined(F.filter(part, lambda x: ~F.exists(off, lambda o: (x["at"] > o["at"]) & (x["at"] <= o["last"]))))))

    def parts(ns: Column, tag: str) -> Column:
        """Texts of the outermost nodes with a tag."""
        return bound(named(ns, tag), lambda all_: F.transform(F.filter(all_, lambda n: ~F.exists(all_, lambda o: (n["at"] > o["at"]) & (n["at"] <= o["last"]))), lambda n: without(ns, n)))

    def of_nodes(ns: Column) -> Column:
        article, body = clean(F.array_join(parts(ns, "article"), " ")), clean(F.array_join(parts(ns, "main"), " "))
        return bound(article, lambda a: bound(body, lambda b: F.when(a != "", a).when(b != "", b).otherwise(without(ns, F.get(ns, F.lit(0))))))

    return bound(of, of_nodes)


def visible(of: Column) -> Column:
    """All text of a page."""
    return joined(of)


