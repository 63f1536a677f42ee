"""URL handling on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions.names import slug
from polislake.functions.text import contains_any, let

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 1)


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 2)


def path(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 3)


def query_string(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 4)


def absolute(href: Column, base: Column) -> Column:
    """A link as seen from the page at ``base``."""

    def joined(h: Column) -> Column:
        # The base is taken apart only where a branch asks for it.
        root = F.concat(scheme(base), F.lit("://"), netloc(base))
        folder = let(F.regexp_replace(path(base), r"[^/]*$", ""), lambda f: F.when(f == "", F.lit("/")).otherwise(f))
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
            .when(F.startswith(h, F.lit("/")), F.concat(root, h))
            .when(h == "", base)
            .when(h.rlike(r"^[?#]"), F.concat(root, path(base), h))
            .otherwise(F.concat(root, folder, h))
        )

    return let(F.trim(href), joined)


def canonical(c: Column) -> Column:
    """P-12: https, lower-case host, single slashes, trailing slash, only ``page`` kept of the query."""

    def built(u: Column) -> Column:
        p = F.regexp_replace(F.concat(path(u), F.lit("/")), "/+", "/")
        pairs = F.array_sort(
            F.filter(F.split(query_string(u), "&"), lambda kv: F.lower(F.substring_index(kv, "=", 1)) == "page")
        )
        q = F.array_join(F.transform(pairs, lambda kv: F.when(F.contains(kv, F.lit("=")), kv).otherwise(F.concat(kv, F.lit("=")))), "&")
        return F.regexp_replace(F.concat(F.lit("https://"), F.lower(netloc(u)), p, F.lit("?"), q), r"\?$", "")

    return let(F.trim(c), built)


def canonical_path(c: Column) -> Column:
    """The path of ``canonical(c)``, without building the rest of it."""
    single = let(F.concat(path(F.trim(c)), F.lit("/")), lambda p: F.when(F.contains(p, F.lit("//")), F.regexp_replace(p, "/+", "/")).otherwise(p))
    # Without a host, what comes before the first slash is taken for one.
    return let(single, lambda p: F.substr(p, F.instr(p, "/")))


def linked_path(href: Column, base: Column) -> Column:
    """The canonical path of a link on the page at ``base``, which a path from the root does not ask for."""
    rooted = lambda h: F.startswith(h, F.lit("/")) & ~F.startswith(h, F.lit("//"))
    return let(F.trim(href), lambda h: F.when(rooted(h), canonical_path(h)).otherwise(canonical_path(absolute(h, base))))


def stable(c: Column) -> Column:
    """P-13: lower-case scheme and host, no fragment, no trailing slash, query kept."""
    u = F.trim(c)
    q = query_string(u)
    return F.concat(
        F.lower(scheme(u)), F.lit("://"), F.lower(netloc(u)), F.regexp_replace(path(u), "/+$", ""),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def host(c: Column) -> Column:
    """P-14: host without credentials and port."""
    h = F.regexp_replace(F.regexp_replace(F.lower(netloc(c)), "^.*@", ""), ":.*$", "")
    return F.when(h != "", h)


def on_domain(c: Column, domain: str) -> Column:
    """P-14: the host is ``domain`` or lies below it."""
    h = F.coalesce(host(c), F.lit(""))
    return (h == domain) | F.endswith(h, F.lit("." + domain))


def detail_api_url(c: Column, site: str, kind: str, api: str) -> Column:
    """P-15: page address of a numbered record to the address of its API record."""
    found = F.regexp_extract(c, rf"\Q{site}\E/{kind}/(\d+)", 1)
    return F.when(found != "", F.concat(F.lit(f"{api}/{kind}/"), found, F.lit("/")))


def file_name(c: Column) -> Column:
    """Last path segment."""
    return F.regexp_extract(F.regexp_replace(path(c), "/+$", ""), r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def is_pdf(c: Column) -> Column:
    """P-34: the decoded path ends in ``.pdf``."""
    return F.endswith(F.lower(F.coalesce(F.try_url_decode(path(c)), path(c))), F.lit(".pdf"))


def title_from_file(c: Column) -> Column:
    """P-34: a readable title from the file name of a document address."""
    name = F.trim(F.translate(stem(file_name(c)), "-_", "  "))
    return F.when(name != "", name).otherwise(F.concat(F.lit("Parliamentary question PDF: "), c))


def title_is_from_url(title: Column, url: Column) -> Column:
    """P-34: the title says nothing beyond the address."""
    name = stem(file_name(url))
    return (
        F.coalesce(title, F.lit("")).isin([""])
        | (title == F.concat(F.lit("Parliamentary question: "), url))
        | (F.trim(title) == name)
        | (F.trim(title) == F.trim(F.translate(name, "-_", "  ")))
    )


def archive_key(c: Column) -> Column:
    """S-07: readable name plus the head of the address's SHA-256."""
    name = file_name(c)
    shown = slug(F.when(name != "", name).otherwise(netloc(c)))
    return F.concat_ws("-", shown, F.left(F.sha2(c, 256), F.lit(10)))


def media_url(location: Column, root: str = "https://www.parliament.gov.za") -> Column:
    """P-35: stored file location to an address without query and fragment."""
    loc = F.trim(F.replace(location, F.lit("\\/"), F.lit("/")))
    folder = F.lit(root + "/storage/app/media/")
    full = (
        F.when(F.startswith(loc, F.lit("http")), loc)
        .when(F.startswith(loc, F.lit("/")), F.concat(F.lit(root), loc))
        .when(F.contains(loc, F.lit("/Docs/")), F.concat(F.lit(root + "/storage/app/"), loc))
        .otherwise(F.concat(folder, F.lit("Docs/"), loc))
    )
    return F.when(loc != "", F.concat(scheme(full), F.lit("://"), netloc(full), path(full)))


def file_format(url: Column, content_type: Column) -> Column:
    """P-30: format by extension, then by content type."""
    u = F.lower(F.substring_index(url, "?", 1))
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    out = None
    for ext, fmt in vocab.FORMAT_BY_EXTENSION:
        hit = F.endswith(u, F.lit(ext))
        out = F.when(hit, fmt) if out is None else out.when(hit, fmt)
    for word, fmt in vocab.FORMAT_BY_CONTENT:
        out = out.when(F.contains(ct, F.lit(word)), fmt)
    return out.otherwise("unknown")


def readiness(fmt: Column, reachable: Column) -> Column:
    """P-30: what a parser could do with the format."""
    table = F.create_map(*[F.lit(x) for kv in vocab.READINESS_BY_FORMAT.items() for x in kv])
    return F.when(~F.coalesce(reachable, F.lit(False)), F.lit("unreachable")).otherwise(
        F.coalesce(F.try_element_at(table, fmt), F.lit("unknown"))
    )


def content_family(content_type: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.contains(ct, F.lit("csv")), "csv").when(F.contains(ct, F.lit("json")), "json")
        .when(contains_any(ct, ["spreadsheet", "excel"]), "xlsx").when(F.contains(ct, F.lit("pdf")), "pdf")
        .when(F.contains(ct, F.lit("html")), "html").when(F.contains(ct, F.lit("octet-stream")), "octet-stream")
        .otherwise("other")
    )


def looks_question_related(url: Column, text: Column) -> Column:
    """T-26: the link points to questions or replies."""
    low = F.lower(F.concat_ws(" ", url, text))
    return (is_pdf(url) & contains_any(low, vocab.QUESTION_PDF_TOKENS)) | contains_any(low, vocab.QUESTION_LINK_TOKENS)


