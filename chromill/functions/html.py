"""Tags and attributes of HTML text as columns, and a parser for what patterns cannot tell."""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A quoted or bare attribute value.
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: A comment, or a script or style element, whichever begins first.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|(<(?:script|style)\b[^>]*>)(.*?)(</(?:script|style)\s*>|\z)"


def visible(html: Column, bodies: bool = False) -> Column:
    """html without comments, and without what stands in scripts and styles unless bodies is set."""
    return F.regexp_replace(html, _HIDDEN, "$1$2$3" if bodies else "$1$3")


def tags(html: Column, name: str) -> Column:
    """All start tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value; null where the tag lacks it."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*{_VALUE}"
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), found)


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")


@F.pandas_udf(StringType())
def decoded(values: pd.Series) -> pd.Series:
    """Attribute values with their character references resolved; a name without ';' before '=' or a letter is none.

    The table of names is the standard library's, so this one short string a page goes through Python.
    """
    return values.map(lambda v: _REFERENCE.sub(lambda m: unescape(m[0]), v) if v and "&" in v else v)


def first_meta(html: Column, key: str, value: str) -> Column:
    """The content of the first meta tag whose key attribute has the value; '' or null where it is empty or missing."""
    hit = F.get(F.filter(tags(html, "meta"), lambda t: attribute(t, key) == value), 0)
    return attribute(hit, "content")


def json_ld(html: Column) -> Column:
    """The bodies of all JSON-LD scripts, in order; comments should be out."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\stype\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s>]))[^>]*>(.*?)</script\s*>"""), F.lit(1))


def dimension(text: Column) -> Column:
    """The digits of a width or height as a number; null where there are none."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("int")


def image_of(data: object) -> str | None:
    """The image of a JSON-LD value: that of the first object that names one, objects before their parts, in document order.

    An object's image is a string or its url, or that of the first of a list; where it is of that form, even
    if empty, the object's other parts are not looked at.
    """
    if isinstance(data, dict):
        named = data.get("image")
        if isinstance(named, list) and named:
            named = named[0]
        if isinstance(named, dict) and "url" in named:
            named = named["url"]
            return named if isinstance(named, str) and named else None
        if isinstance(named, str):
            return named or None
    parts = data.values() if isinstance(data, dict) else data if isinstance(data, list) else ()
    return next((found for found in map(image_of, parts) if found), None)


@F.pandas_udf(StringType())
def json_ld_image(scripts: pd.Series) -> pd.Series:
    """Per row of script bodies the first image in document order; a body that is no JSON is passed over.

    A parser is used here as Spark's own JSON types sort an object's keys, which changes what comes first.
    """

    def one(bodies) -> str | None:
        for body in () if bodies is None else bodies:
            try:
                if found := image_of(json.loads(body)):
                    return found
            except (ValueError, RecursionError):
                continue
        return None

    return scripts.map(one)


class _Details(HTMLParser):
    """Texts of list items."""

    def __init__(self):
        super().__init__()
        self.items, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.depth += 1
            self.items.append("")

    def handle_endtag(self, tag):
        if tag == "li" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and self.items:
            self.items[-1] += data


def list_items(html: str) -> list[str]:
    parser = _Details()
    parser.feed(html)
    return [" ".join(x.split()) for x in parser.items]


def detail_map(items: Column) -> Column:
    """'key: value' strings as a map; later colons vanish, later keys win."""
    pairs = F.transform(items, lambda x: F.struct(F.get(F.split(x, ":"), 0).alias("k"), F.array_join(F.slice(F.split(x, ":"), F.lit(2), F.size(F.split(x, ":"))), "").alias("v")))
    empty = F.create_map().cast("map<string,string>")
    put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p.k), F.create_map(p.k, p.v))
    return F.aggregate(pairs, empty, put)
