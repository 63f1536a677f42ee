"""Text helpers as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from polislake import vocab

#: Whitespace as Unicode sees it; the Java class alone stops at ASCII.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"
#: The same characters, for functions that take a set of them.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"
#: A word boundary that does not depend on the regex engine's idea of \b.
BEFORE, AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Column expressions are trees: a value used ten times is ten copies. Bound
    to a lambda variable it is planned and evaluated a single time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space, ends are trimmed."""

    def spaced(v: Column) -> Column:
        # As many bytes as letters are ASCII; most of these hold single spaces only and need no search for others.
        plain = (F.octet_length(v) == F.length(v)) & ~F.contains(v, F.lit("  ")) & ~v.rlike(r"[\x00-\x1F]")
        return F.when(plain, v).otherwise(F.regexp_replace(v, rf"(?: {SPACE}|[[^ -~]&&{SPACE}]){SPACE}*", " "))

    return F.trim(let(c, spaced))


def constant_words(words: Sequence[str]) -> Column:
    """A constant array of words, planned as one literal."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def blank_to_null(c: Column) -> Column:
    """P-22: trimmed value, NULL when nothing is left."""
    return F.nullif(strip_chars(c, SPACES), F.lit(""))


def limit_string(c: Column, limit: int | None = None) -> Column:
    """P-22: collapsed, cut to ``limit`` characters if there is a limit, blank becomes NULL."""
    whole = collapse(c)
    return F.nullif(whole if limit is None else F.left(whole, F.lit(limit)), F.lit(""))


def is_blank(c: Column) -> Column:
    """F-08: NULL or nothing but spaces."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def title_case(c: Column) -> Column:
    """Capital after every non-letter (``O'Brien``), unlike ``initcap``."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 2147483647))), ""
    )


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """``c`` holds at least one of the literal ``needles``."""
    return let(c, lambda v: reduce(or_, [F.contains(v, F.lit(n)) for n in needles]))


def keyword_case(c: Column, rules: Sequence[tuple[str, object]], default: object = None, strict: bool = False) -> Column:
    """P-20: value of the first rule whose keyword occurs in ``c``.

    Plain containment by default; ``strict`` asks for whole words.
    """

    def chain(low: Column) -> Column:
        out = None
        for keyword, value in rules:
            hit = low.rlike(BEFORE + keyword + AFTER) if strict else F.contains(low, F.lit(keyword))
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return out.otherwise(F.lit(default)) if default is not None else out

    return let(F.lower(c), chain)


def code_map(c: Column, codes: Mapping[str, str], default: str, upper: bool = True) -> Column:
    """P-21: exact lookup of a trimmed code."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    key = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(table, F.upper(key) if upper else F.lower(key)), F.lit(default))


def excerpt(c: Column, limit: int = vocab.MAX_EXCERPT) -> Column:
    """P-24: collapsed text, cut with an ellipsis beyond ``limit``."""
    return let(
        collapse(c),
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.regexp_replace(F.left(t, F.lit(limit)), SPACE + "+$", ""), F.lit("..."))
        ).otherwise(F.when(t != "", t)),
    )


def snippet(text: Column, start: Column, length: Column, radius: int = vocab.SNIPPET_RADIUS) -> Column:
    """P-23: text around a hit; ``start`` counts from 0, cut sides get an ellipsis."""
    left = F.greatest(start - radius, F.lit(0))
    right = F.least(start + length + radius, F.length(text))
    body = collapse(F.substr(text, (left + 1).cast("int"), (right - left).cast("int")))
    return F.concat(
        F.when(left > 0, F.lit("...")).otherwise(""), body, F.when(right < F.length(text), F.lit("...")).otherwise("")
    )


def clean_display(c: Column) -> Column:
    """P-25: typographic and wrongly decoded marks become plain ones."""

    def mended(v: Column) -> Column:
        t = v
        for bad, good in vocab.DISPLAY_REPLACEMENTS:
            t = F.replace(t, F.lit(bad), F.lit(good))
        # Every mark holds a bracket or a character beyond plain ASCII.
        return F.when(v.rlike(r"[^ -~]|\["), collapse(t)).otherwise(v)

    return let(collapse(F.coalesce(c, F.lit(""))), mended)


def redact(c: Column) -> Column:
    """P-26: hide secrets, URL credentials and access tokens."""
    t = F.regexp_replace(
        c,
        r"(?i)\b(database_url|password|passwd|secret|token|api_key|authorization)\b(\s*[:=]\s*)([^\s,;]+)",
        "$1$2[REDACTED]",
    )
    t = F.regexp_replace(t, r"(?i)\b([a-z][a-z0-9+.-]*://)([^/\s:@]+):([^@\s/]+)@", "$1[REDACTED]:[REDACTED]@")
    return F.regexp_replace(t, r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[REDACTED]")


def redact_url(c: Column) -> Column:
    """Credentials inside a URL, shown as one mark."""
    return F.regexp_replace(c, r"(?i)([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1[REDACTED]@")


def fingerprint(c: Column, base: int = 31, modulus: int = 1_000_000_007) -> Column:
    """P-29: polynomial fingerprint over code points."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(
        chars,
        F.lit(0).cast("long"),
        lambda acc, ch: (acc * base + F.ascii(ch)) % modulus,
    )


def unique_values(values: Column) -> Column:
    """D-06: order-keeping distinct that ignores case and spacing."""
    clean = F.filter(F.transform(values, collapse), lambda v: v.isNotNull() & (v != ""))
    marked = F.array_sort(F.transform(clean, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("at"), v.alias("v"))))
    # Sorted by key and place, the first of every run of equal keys is the one to keep.
    first = let(marked, lambda m: F.filter(m, lambda x, i: (i == 0) | (x["low"] != F.get(m, F.greatest(i - 1, F.lit(0)))["low"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["at"], x["v"]))), lambda x: x["v"])


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a one-character ``needle``."""
    return F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))


def search_terms(question: Column, limit: int = vocab.MAX_TERMS) -> Column:
    """I-05: words of three letters or more, stop words removed, repeats kept.

    A question of nothing but stop words is searched for as a whole.
    """
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([a-zA-Z][a-zA-Z0-9+-]{2,})"), F.lit(1))
    stop = constant_words(vocab.SEARCH_STOP_WORDS)
    kept = F.slice(F.filter(words, lambda w: ~F.array_contains(stop, w)), 1, limit)
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.trim(question))))


def sentences(text: Column) -> Column:
    """Chunks ending at a sentence mark or a line break, blanks dropped."""
    return F.filter(
        F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != ""
    )
