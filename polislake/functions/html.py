"""Stored HTML as text, links, list items and table cells; JVM-side expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from polislake.functions.text import collapse, let

#: Named references of HTML 4 and ``&apos;``, by name without the marks.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
#: A no-break space shows as a space.
ENTITIES["nbsp"] = " "


def _reference(part: Column) -> Column:
    """What follows an ``&``, its reference turned into the character; anything else keeps its ``&``."""
    digits, hexed = (F.regexp_extract(part, r"^#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));?", i) for i in (1, 2))
    code = F.when(digits != "", digits.try_cast("bigint")).when(hexed != "", F.conv(hexed, 16, 10).try_cast("bigint"))
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    numeric = F.when(good, F.concat(char, F.regexp_replace(part, r"^#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")))
    known = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]{1,9});", 1)
    named = F.when(name != "", F.concat(F.try_element_at(known, name), F.substr(part, F.length(name) + 2)))
    return F.coalesce(F.when(F.startswith(part, F.lit("#")), numeric).otherwise(named), F.concat(F.lit("&"), part))


def unescape(c: Column) -> Column:
    """Every reference decoded once, in one pass: ``&#38;lt;`` and ``&amp;lt;`` both give ``&lt;``."""

    def decoded(v: Column) -> Column:
        parts = F.split(v, "&")
        return F.when(F.contains(v, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _reference), ""))).otherwise(v)

    return let(c, decoded)


def strip_tags(c: Column) -> Column:
    """Inner text of a fragment."""
    return collapse(unescape(F.regexp_replace(c, r"<[^>]*>", " ")))


def visible_text(c: Column) -> Column:
    """T-01: what a reader sees; scripts, styles and comments are gone."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    return strip_tags(F.regexp_replace(t, r"(?s)<!--.*?-->", " "))


def element_text(c: Column, tag: str) -> Column:
    """Text of the first ``tag``; empty when there is none."""
    return strip_tags(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def class_text(c: Column, pattern: str) -> Column:
    """Text of the first element whose class matches ``pattern``, nested elements of its own kind included."""
    opened = rf"(?is)<([a-z0-9]+)\b[^>]*\bclass=(?:[\"'][^\"'>]*(?:{pattern})[^\"'>]*[\"']|[^\s\"'>]*(?:{pattern})[^\s\"'>]*)[^>]*>(.*)"
    return strip_tags(balanced(F.regexp_extract(c, opened, 2), F.regexp_extract(c, opened, 1)))


def balanced(rest: Column, name: Column) -> Column:
    """The head of ``rest`` up to the end tag that closes an element ``name`` opened before it."""
    pieces = F.regexp_extract_all(rest, F.concat(F.lit("(?is).*?(?:</?"), name, F.lit(r"\b[^>]*>|\z)")), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        move = F.when(F.regexp_like(piece, F.concat(F.lit("(?is)</"), name, F.lit(r"\b[^>]*>\z"))), -1).when(F.regexp_like(piece, F.concat(F.lit("(?is)<"), name, F.lit(r"\b[^>]*>\z"))), 1).otherwise(0)
        open_ = acc["depth"] > 0
        held = F.when(acc["depth"] + move == 0, F.regexp_replace(piece, F.concat(F.lit("(?is)</"), name, F.lit(r"\b[^>]*>\z")), F.lit(""))).otherwise(piece)
        return F.struct(F.when(open_, acc["depth"] + move).otherwise(0).alias("depth"), F.when(open_, F.concat(acc["text"], held)).otherwise(acc["text"]).alias("text"))

    return F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit("").alias("text")), step, lambda acc: acc["text"])


def meta_content(c: Column, key: str) -> Column:
    """Content of a meta tag named by ``property`` or ``name``, NULL if absent or empty."""
    tag = rf"(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*[\"']?\Q{key}\E[\"'\s/>])[^>]*?\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    found = F.concat(*[F.regexp_extract(c, tag, i) for i in (1, 2, 3)])
    return F.nullif(F.trim(unescape(found)), F.lit(""))


def links(c: Column) -> Column:
    """``array<struct(href, label)>`` in page order."""
    tags = F.regexp_extract_all(c, F.lit(r"(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>"), F.lit(0))
    href = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

    def bare(v: Column) -> Column:
        return F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    return F.transform(tags, lambda a: F.struct(F.trim(unescape(let(F.regexp_extract(a, href, 1), bare))).alias("href"), strip_tags(a).alias("label")))


def elements(c: Column, name: str, attributes: str = "") -> Column:
    """Inner HTML of every ``name`` element in page order, nested ones of the same kind included.

    ``attributes`` is a pattern that the opening tag must hold, wherever in it.
    """
    opened = rf"(?is)^<{name}\b" + (rf"(?=[^>]*{attributes})" if attributes else "") + r"[^>]*>"
    parts = F.split(c, rf"(?i)(?=<{name}\b)")
    cut = F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.length(p).alias("n"), F.regexp_replace(p, opened, "").alias("p")))
    heads = F.filter(cut, lambda x: F.length(x["p"]) < x["n"])

    def inner(x: Column) -> Column:
        # Elements without nested ones, nearly all, end in their own part at its first end tag.
        rest = F.array_join(F.slice(parts, x["i"] + 1, F.size(parts) - x["i"]), "")
        return let(
            F.split(x["p"], rf"(?i)</{name}\b[^>]*>", 2),
            lambda own: F.when(F.size(own) > 1, F.get(own, F.lit(0))).otherwise(balanced(F.regexp_replace(rest, opened, ""), F.lit(name))),
        )

    return F.transform(heads, inner)


def with_class(name: str) -> str:
    """A pattern for ``elements``: the class ``name`` among others, quoted or not."""
    return rf"\bclass\s*=\s*(?:[\"'](?:[^\"'>]*\s)?{name}(?:\s[^\"'>]*)?[\"']|{name}(?=[\s>]))"


def list_items(c: Column) -> Column:
    """Inner HTML of every list item; one that holds a nested list has its items inside as well."""
    return elements(c, "li")


def table_rows(c: Column) -> Column:
    """Inner HTML of every table row, those of nested tables included."""
    return elements(c, "tr")


def _flat(row: Column) -> Column:
    """A row in which nested tables are plain text of their cell."""
    pieces = F.split(row, r"(?i)(?=<table\b)|(?<=</table>)")

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(F.regexp_like(piece, F.lit(r"(?i)^<table\b")), 1).otherwise(0)
        plain = F.when(depth > 0, F.regexp_replace(piece, r"(?i)</?(?:table|thead|tbody|tfoot|t[rdh])\b[^>]*>", " ")).otherwise(piece)
        return F.struct((depth - F.when(F.regexp_like(piece, F.lit(r"(?i)</table>$")), 1).otherwise(0)).alias("depth"), F.concat(acc["text"], plain).alias("text"))

    nested = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step, lambda acc: acc["text"])
    return F.when(F.regexp_like(row, F.lit(r"(?i)<table\b")), nested).otherwise(row)


def cells(row: Column, kind: str = "t[dh]") -> Column:
    """Texts of the cells of one row; a nested table is text of its cell."""
    return F.transform(F.regexp_extract_all(_flat(row), F.lit(rf"(?is)<({kind})\b[^>]*>(.*?)(?=</\1\s*>|<t[dh]\b|\z)"), F.lit(2)), strip_tags)


def title(c: Column, site_suffix: str = "| PMG") -> Column:
    """T-02: heading, else social title, else document title."""

    def cut(v: Column) -> Column:
        return F.trim(F.replace(v, F.lit(site_suffix), F.lit("")))

    return F.coalesce(
        F.nullif(element_text(c, "h1"), F.lit("")), cut(meta_content(c, "og:title")), cut(meta_content(c, "twitter:title")),
        F.nullif(cut(element_text(c, "title")), F.lit("")),
    )


