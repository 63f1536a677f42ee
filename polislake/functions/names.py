"""Names of people, parties, committees and roles."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions.text import blank_to_null, clean_display, collapse, constant_words, keyword_case, let, strip_chars, title_case


@lru_cache(maxsize=1)
def _ascii_folding() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has an ASCII part.

    Built from the Unicode tables: one-to-one foldings for ``translate`` and
    the few that give several letters.
    """
    src, dst, many = [], [], {}
    blocks = [range(0x80, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200)]
    for block in blocks:
        for cp in block:
            ch = chr(cp)
            folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
            if len(folded) == 1:
                src.append(ch)
                dst.append(folded)
            elif folded:
                many[ch] = folded.replace("|", " ")
    return "".join(src), "".join(dst), many


def to_ascii(c: Column) -> Column:
    """Compatibility decomposition reduced to its ASCII part, without Python workers.

    Pure ASCII values pass through; only values holding a character that
    expands to several letters take the per-character route.
    """
    src, dst, many = _ascii_folding()
    codes = sorted(map(ord, many))
    ranges, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], None]):
        if b != a + 1:
            ranges.append((start, a))
            start = b
    klass = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    table = F.map_from_arrays(F.split(F.lit("".join(many)), ""), F.split(F.lit("|".join(many.values())), r"\|"))

    def spread(v: Column) -> Column:
        return F.array_join(
            F.transform(F.split(v, ""), lambda ch: F.when(ch.rlike(klass), F.element_at(table, ch)).otherwise(ch)), ""
        )

    return let(
        c,
        lambda v: F.when(v.rlike(r"^[\x00-\x7F]*$"), v).otherwise(
            F.regexp_replace(F.translate(F.when(v.rlike(klass), spread(v)).otherwise(v), src, dst), r"[^\x00-\x7F]", "")
        ),
    )


def slug(c: Column) -> Column:
    """P-01: lower-case ASCII words joined by hyphens."""
    return strip_chars(F.regexp_replace(F.lower(to_ascii(c)), "[^a-z0-9]+", "-"), "-")


def person_name(c: Column) -> Column:
    """P-02: collapsed, title-cased name."""
    return title_case(collapse(c))


def committee_name(c: Column) -> Column:
    """P-03: committee name without its 'committee on/for' prefix."""
    kind = "(committee|portfolio committee|standing committee|select committee|joint committee)"
    t = F.regexp_replace(collapse(c), rf"(?i)^{kind}\s+on\s+", "")
    t = F.regexp_replace(t, rf"(?i)^{kind}\s+for\s+", "")
    t = F.regexp_replace(t, r"\s+([,.;:])", "$1")
    t = F.regexp_replace(t, r"([,.;:]){2,}", "$1")
    return strip_chars(t, " -,.;:")


def party(c: Column) -> Column:
    """P-04: party as ``struct(name, short_name)``."""
    clean = strip_chars(collapse(F.coalesce(c, F.lit(""))), " .,-")
    pattern = r"^(.+?)\s*\(([^)]+)\)\s*$"
    known = F.map_from_arrays(
        F.array(*[F.lit(k) for k in vocab.PARTY_ALIASES]),
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("short_name")) for n, a in vocab.PARTY_ALIASES.values()]),
    )

    def split(v: Column) -> Column:
        paired = v.rlike(pattern)
        return F.struct(
            F.when(paired, F.trim(F.regexp_extract(v, pattern, 1))).otherwise(v).alias("long"),
            F.when(paired, F.trim(F.regexp_extract(v, pattern, 2))).otherwise(v).alias("short"),
        )

    def key(v: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9+]+", " "))

    def named(x: Column) -> Column:
        short = x["short"]
        shown = F.when((F.length(short) <= 20) & (F.upper(short) == short) & (F.lower(short) != short), short)
        made = F.struct(
            collapse(x["long"]).alias("name"), F.coalesce(shown, F.left(F.upper(slug(short)), F.lit(20))).alias("short_name")
        )
        blank = F.struct(F.lit("Unknown").alias("name"), F.lit("UNKNOWN").alias("short_name"))
        return F.when(x["long"] == "", blank).otherwise(
            F.coalesce(F.try_element_at(known, key(short)), F.try_element_at(known, key(x["long"])), made)
        )

    return let(let(clean, split), named)


def role(c: Column, strict: bool = False, most: int | None = None) -> Column:
    """P-05: role by the first keyword contained; anything else is kept (``most`` characters, if given)."""
    clean = strip_chars(collapse(F.replace(F.coalesce(c, F.lit("")), F.lit(":"), F.lit(" "))), " .,-")
    named = let(
        clean,
        lambda v: F.when(v == "", F.lit("Unknown")).otherwise(F.coalesce(keyword_case(v, vocab.ROLE_KEYWORDS, strict=strict), v if most is None else F.left(v, F.lit(most)))),
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Member")).otherwise(named)


def strip_honorific(c: Column) -> Column:
    """P-06: name without one leading title."""
    return F.regexp_replace(F.trim(c), r"(?i)^(mr|ms|mrs|miss|dr|adv|prof|hon)\.?\s+", "")


def attendee_name(c: Column) -> Column:
    """P-07: a person's name from an attendance line, NULL when it names no person."""
    edge = " ,.;:-"
    clean = strip_chars(collapse(F.regexp_replace(strip_chars(collapse(c), edge), r"\([^)]*\)", " ")), edge)
    titles = constant_words(vocab.HONORIFICS)

    def words(v: Column) -> Column:
        parts = F.transform(F.split(v, " "), lambda p: strip_chars(p, "()[]{}.,;:"))
        return F.array_join(F.filter(parts, lambda p: (p != "") & ~F.array_contains(titles, F.lower(p))), " ")

    def arranged(v: Column) -> Column:
        given = words(collapse(F.substr(v, F.instr(v, ",") + 1)))
        flipped = F.trim(F.concat(given, F.lit(" "), F.trim(F.substring_index(v, ",", 1))))
        return strip_chars(collapse(F.when(F.instr(v, ",") > 0, flipped).otherwise(words(v))), edge)

    def accepted(v: Column) -> Column:
        low = F.lower(v)
        skip = low.isin(vocab.NON_PERSON_NAMES) | low.rlike(r"\b(" + "|".join(vocab.NON_PERSON_WORDS) + r")\b")
        return F.when((v != "") & ~skip, arranged(v))

    name = let(clean, accepted)
    return let(name, lambda n: F.when((F.length(n) >= 3) & n.rlike("[A-Za-z]"), title_case(n)))


def display_name(c: Column) -> Column:
    """P-08: first and last word when there are more than two."""
    parts = F.split(collapse(c), " ")
    return F.when(F.size(parts) <= 2, c).otherwise(let(parts, lambda p: F.concat_ws(" ", F.element_at(p, 1), F.element_at(p, -1))))


def name_tokens(c: Column) -> Column:
    """P-09: lower-case name words of two letters or more, titles and labels dropped."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]+\)", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\b", " ")
    words = F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z'-]*)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower)


def last_word(c: Column) -> Column:
    return F.element_at(F.split(collapse(c), " "), -1)


def alias_forms(full: Column, display: Column) -> Column:
    """P-10: ``array<struct(alias, alias_type)>``; the first type wins for a repeated form."""
    def form(value: Column, kind: str) -> Column:
        return F.struct(value.alias("alias"), F.lit(kind).alias("alias_type"))

    def build(x: Column) -> Column:
        parts, shown, surname = x["parts"], x["display"], x["surname"]
        given = F.filter(parts, lambda p, i: i < F.size(parts) - 1)
        initials = F.transform(given, lambda p: F.upper(F.left(p, F.lit(1))))
        return F.struct(initials.alias("initials"), F.array_join(parts, " ").alias("full"), shown.alias("display"), surname.alias("surname"))

    def forms(x: Column) -> Column:
        initials, surname = x["initials"], x["surname"]
        has = F.size(initials) > 0
        return F.array(
            form(x["full"], "FULL_NAME"),
            form(x["display"], "DISPLAY_NAME"),
            form(F.when(has, F.concat(F.get(initials, F.lit(0)), F.lit(" "), surname)), "INITIAL_SURNAME"),
            form(F.when(has, F.concat(F.array_join(initials, ""), F.lit(" "), surname)), "INITIAL_SURNAME"),
            form(F.when(has, F.concat(F.array_join(initials, ". "), F.lit(". "), surname)), "INITIAL_SURNAME"),
            *[form(F.concat(F.lit(f"{t} "), surname), "TITLE_SURNAME") for t in ("Hon", "Mr", "Ms", "Dr")],
            form(surname, "SURNAME_ONLY"),
        )

    shown = F.coalesce(collapse(display), F.lit(""))
    base = F.struct(
        F.split(collapse(full), " ").alias("parts"), shown.alias("display"),
        F.when(shown != "", last_word(display)).otherwise(last_word(full)).alias("surname"),
    )
    kept = F.filter(let(let(base, build), forms), lambda f: F.coalesce(f["alias"], F.lit("")) != "")

    def first_of_each(fs: Column) -> Column:
        return let(
            F.transform(fs, lambda f: f["alias"]),
            lambda seen: F.filter(fs, lambda f, i: F.array_position(seen, f["alias"]) == i + 1),
        )

    return let(kept, first_of_each)


def asker_candidates(c: Column) -> Column:
    """P-11: spellings to try for an asker, best first."""
    comma = r"^([^,]+),\s*(.+)$"

    def forms(raw: Column) -> Column:
        surname = F.trim(F.regexp_extract(raw, comma, 1))
        given = F.trim(F.regexp_extract(raw, comma, 2))
        return F.array(
            raw,
            F.trim(F.regexp_replace(raw, r"(?i)^(hon|mr|ms|mrs|dr|adv|prof)\.?\s+", "")),
            F.when(raw.rlike(comma), F.concat_ws(" ", given, surname)),
            F.when(raw.rlike(comma), surname),
            F.when(F.contains(raw, F.lit(" ")), F.substring_index(raw, " ", -1)),
        )

    kept = F.filter(let(clean_person_value(c), forms), lambda f: f.isNotNull() & (f != ""))
    return F.array_distinct(kept)


def clean_person_value(c: Column) -> Column:
    """P-37: collapsed value without a trailing parenthesis."""
    return blank_to_null(F.regexp_replace(collapse(c), r"\s*\([^)]{1,80}\)\s*$", ""))


def without_party_label(c: Column, short_name: Column) -> Column:
    """P-37: a name without its ``(PARTY)`` label, whatever its case."""
    label = F.concat(F.lit(r"(?i)\s*\(\s*\Q"), short_name, F.lit(r"\E\s*\)\s*"))
    cleaned = clean_display(strip_chars(collapse(F.regexp_replace(c, label, F.lit(" "))), " ,.;"))
    return F.nullif(cleaned, F.lit(""))


def is_unknown_label(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(["", *vocab.UNKNOWN_LABELS])
