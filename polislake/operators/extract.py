"""Typed records from stored pages, documents and listings (T-*, P-32, P-33, P-36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import dates, html, names, text, urls


def overlay_metadata(parsed: DataFrame, metadata: DataFrame) -> DataFrame:
    """P-32: fill what a document did not yield from its listing entry.

    Both sides are keyed by ``source_url``; the names of the fields taken over
    end up in ``applied``.
    """
    fields = [c for c in ("question_number", "asked_date", "answered_date") if c in parsed.columns and c in metadata.columns]
    meta = metadata.select("source_url", *[F.col(c).alias(f"_m_{c}") for c in ("title", "status", *fields) if c in metadata.columns])
    df = parsed.join(meta, "source_url", "left")
    take = {
        "title": F.col("_m_title").isNotNull() & urls.title_is_from_url(F.col("title"), F.col("source_url")),
        **{c: F.col(c).isNull() & F.col(f"_m_{c}").isNotNull() for c in fields},
        "status": F.col("_m_status").isNotNull() & (F.upper(F.coalesce("status", F.lit("UNANSWERED"))) == "UNANSWERED"),
    }
    out = {c: F.when(cond, text.limit_string(F.col("_m_title"), 500) if c == "title" else F.col(f"_m_{c}")).otherwise(F.col(c)) for c, cond in take.items()}
    out["applied"] = F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in take.items()]))
    return df.withColumns(out).select(*parsed.columns, "applied")


def file_metadata(records: DataFrame, max_year: int) -> DataFrame:
    """P-33: title, number, date and status carried by a file listing (``name``, ``date``, ``type``)."""
    stem = F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), r"\.[A-Za-z0-9]{1,5}$", "")
    kind = F.upper(F.trim(F.coalesce("type", F.lit(""))))

    def looked_up(i: int, default: str | None) -> Column:
        out = None
        for code, row in vocab.QUESTION_DOC_TYPES.items():
            out = F.when(kind == code, F.lit(row[i])) if out is None else out.when(kind == code, F.lit(row[i]))
        return out.otherwise(F.lit(default))

    number = F.regexp_extract(F.upper(stem), r"^R?([A-Z]{1,4}\d{1,6})\b", 1)
    df = records.withColumns(
        {
            "_stem": stem, "question_number": F.when(number != "", number),
            "_date": F.coalesce(dates.sane(F.col("date"), max_year), dates.sane_from_name(stem, max_year)),
            "_label": looked_up(0, "Parliamentary question document"), "_house": looked_up(1, None), "_field": looked_up(2, "asked_date"),
        }
    )
    title = F.concat_ws(
        " ", "_label", "question_number", F.concat(F.lit("("), "_house", F.lit(")")), F.concat(F.lit("— "), F.col("_date").cast("string"))
    )
    known = F.col("question_number").isNotNull() | F.col("_date").isNotNull()
    answered = F.col("_field") == "answered_date"
    return df.withColumns(
        {
            "title": F.when(known, title).when(F.col("_stem") != "", F.col("_stem")),
            "answered_date": F.when(answered, F.col("_date")), "asked_date": F.when(~answered, F.col("_date")),
            "status": F.when(answered, F.lit("ANSWERED")),
        }
    ).drop("_stem", "_date", "_label", "_house", "_field")


_HOUSE_HEADER = r"(?i)^NATIONAL ASSEMBLY(?:\s+\(NA\))?\s+(?:QUESTION|WRITTEN REPLY QUESTION).*?\b\d+\.\s*"


def clean_question_text(c: Column, asker: Column) -> Column:
    """P-36: question or answer text without header, asker prefix and label."""
    t = F.trim(F.regexp_replace(F.replace(text.collapse(c), F.lit("—"), F.lit("-")), _HOUSE_HEADER, ""))
    who = F.coalesce(asker, F.lit(""))
    rest = F.substr(t, F.length(who) + 1)
    asked = (who != "") & (F.lower(F.left(t, F.length(who))) == F.lower(who)) & rest.rlike(r"(?i)^\s+to ask\s+")
    t = F.when(asked, F.regexp_replace(F.regexp_replace(rest, r"(?i)^\s+to ask\s+the\s+", "asked the "), r"(?i)^\s+to ask\s+", "asked ")).otherwise(t)
    t = F.trim(F.regexp_replace(t, r"(?i)^(Question|Answer):\s*", ""))
    return text.excerpt(t)


def clean_answer_excerpt(c: Column) -> Column:
    """P-36: excerpt without asker and header, cut at 220."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"^Asked by [^|]+\|\s*", "")), _HOUSE_HEADER, ""))
    return text.excerpt(F.replace(t, F.lit("—"), F.lit("-")), 220)


def clean_question_title(c: Column) -> Column:
    """P-36: collapsed title in plain dashes."""
    t = F.replace(text.collapse(c), F.lit("Written question reply"), F.lit("Written question"))
    return F.replace(t, F.lit("—"), F.lit("-"))


# --------------------------------------------------------------------------- pages


def page_links(pages: DataFrame, path_pattern: str, keep: list[str] = ()) -> DataFrame:
    """T-03: absolute, normalised links of every page whose path matches, once each."""
    out = pages.select("page_id", "url", F.explode(html.links(F.col("html"))).alias("l"))
    out = out.select("page_id", urls.canonical(urls.absolute(F.col("l.href"), F.col("url"))).alias("link"), "l.label", *keep)
    return out.where(urls.path(F.col("link")).rlike(f"^(?:{path_pattern})$")).select("page_id", "link").distinct()


def publication_date(html_col: Column, visible: Column) -> Column:
    """T-04: date of the meta tags, else the first written date of the text."""
    metas = [dates.parse(F.left(html.meta_content(html_col, k), F.lit(10))) for k in ("article:published_time", "date", "DC.date")]
    inner = F.regexp_extract(visible, r"\b(\d{1,2} [A-Z][a-z]+ \d{4})\b", 1)
    return F.coalesce(*metas, text.let(inner, dates.parse))


def committee_of(html_col: Column, visible: Column) -> Column:
    """T-05: committee shown on the page, else named in its text."""
    named = F.regexp_extract(visible, r"\b((?:Portfolio|Standing) Committee on [A-Za-z ,&-]+)\b", 1)
    return F.coalesce(
        F.nullif(html.class_text(html_col, r"\bcommittee(?:-name)?\b"), F.lit("")),
        F.nullif(F.regexp_replace(named, r"(?i)\s+(meeting|briefing|report)\s*$", ""), F.lit("")),
    )


def document_type(url: Column, title: Column, body: Column, head: int | None = None) -> Column:
    """T-06: kind of document by its path, then by address, title and text (its first ``head`` characters, if given)."""
    body = F.coalesce(body, F.lit(""))
    p = F.lower(urls.path(url))
    low = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), body if head is None else F.left(body, F.lit(head))))
    return (
        F.when(F.contains(p, F.lit("committee-meeting")), "PMG_COMMITTEE_MEETING").when(F.contains(p, F.lit("report")), "PMG_REPORT")
        .when(F.contains(p, F.lit("briefing")), "PMG_BRIEFING").when(F.contains(low, F.lit("report")), "PMG_REPORT")
        .when(F.contains(low, F.lit("briefing")), "PMG_BRIEFING").when(F.contains(low, F.lit("meeting")), "PMG_COMMITTEE_MEETING").otherwise("PMG_DOCUMENT")
    )


def vote_table_records(pages: DataFrame) -> DataFrame:
    """T-07: rows of division tables: party counts (three cells) or one person's vote (two cells)."""
    rows = pages.select("page_id", F.posexplode(html.table_rows(F.col("html"))).alias("row", "r")).select("page_id", "row", html.cells(F.col("r"), "td").alias("c")).where(F.size("c") >= 2)
    counts = F.array(
        F.struct(F.lit("party").alias("level"), F.col("c")[0].alias("name"), F.lit("yes").alias("value"), dates.int_with_commas(F.col("c")[1]).alias("n")),
        F.struct(F.lit("party").alias("level"), F.col("c")[0].alias("name"), F.lit("no").alias("value"), dates.int_with_commas(F.get("c", F.lit(2))).alias("n")),
    )
    person = F.array(
        F.struct(F.lit("individual").alias("level"), F.col("c")[0].alias("name"), text.code_map(F.col("c")[1], vocab.VOTE_VALUES, "unknown", upper=False).alias("value"), F.lit(None).cast("int").alias("n"))
    )
    long = rows.select("page_id", "row", F.explode(F.when(F.size("c") >= 3, counts).otherwise(person)).alias("v")).select("page_id", "row", "v.*")
    return long.where("level = 'individual' or (n is not null and name <> '')")


def bill_table_rows(pages: DataFrame, site: str) -> DataFrame:
    """T-07: bills of an index page: linked title, year and status."""
    rows = pages.select("page_id", F.explode(html.table_rows(F.col("html"))).alias("r"))
    df = rows.select("page_id", html.cells(F.col("r")).alias("c"), html.links(F.regexp_extract("r", r"(?is)(<t[dh]\b.*?</t[dh]\s*>)", 1)).alias("l")).where("size(c) >= 2 and size(l) > 0")
    title, year_text = F.col("l")[0]["label"], F.col("c")[1]
    href = F.col("l")[0]["href"]
    return df.where(title != "").select(
        "page_id", title.alias("title"), dates.bill_number(title).alias("bill_number"), dates.year_in(F.when(year_text != "", year_text).otherwise(title)).alias("year"),
        text.keyword_case(F.element_at("c", -1), vocab.BILL_STATUS_KEYWORDS, "unknown").alias("status"),
        F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(site), href)).alias("source_url"),
    )


def bill_history(pages: DataFrame) -> DataFrame:
    """T-08: life-cycle events of table rows and list items, repeats dropped."""
    parts = F.transform(F.concat(html.table_rows(F.col("html")), html.list_items(F.col("html"))), html.strip_tags)
    rows = pages.select("page_id", F.explode(parts).alias("t")).where("t <> ''")
    ev = rows.select("page_id", text.keyword_case(F.col("t"), vocab.BILL_EVENT_KEYWORDS, "unknown").alias("event_type"), dates.first_in_text(F.col("t")).alias("event_date"), F.col("t").alias("description"))
    kept = ev.where("event_type <> 'unknown' or event_date is not null")
    return kept.distinct()


def label_fields(body: Column) -> Column:
    """T-09: map of label to value; a value runs to the next label, the last one wins a repeated label."""
    names_ = "|".join(vocab.QUESTION_LABELS)
    marked = F.regexp_replace(F.replace(body, F.lit("\x00"), F.lit("")), rf"(?i)\b({names_})\s*[:\-]\s*", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda p: F.contains(p, F.lit("\x02")))

    def entry(p: Column) -> Column:
        value = F.substring_index(p, "\x02", -1)
        return F.struct(F.lower(F.substring_index(p, "\x02", 1)).alias("k"), text.strip_chars(text.collapse(value), " :-").alias("v"))

    return F.map_from_entries(F.filter(F.transform(parts, entry), lambda e: e["v"] != ""))


def _first(fields: Column, *labels: str) -> Column:
    picks = [F.try_element_at(fields, F.lit(k)) for k in labels]
    return F.coalesce(*picks)


def question_records(docs: DataFrame, body: str) -> DataFrame:
    """T-09…T-12: one typed question record per text."""
    df = docs.withColumn("_t", F.replace(F.coalesce(body, F.lit("")), F.lit("\x00"), F.lit(""))).withColumn("_f", label_fields(F.col("_t")))
    f, t = F.col("_f"), F.col("_t")
    pattern = r"(?i)\b(question)\b\s*[:\-]\s*(.+?)\b(answer|reply)\b\s*[:\-]\s*(.+)"
    q, a = _first(f, "question"), _first(f, "answer", "reply")
    split_q, split_a = F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 4)
    none = q.isNull() & a.isNull()
    question = F.when(~none, q).when(split_q != "", text.collapse(split_q)).when(t != "", t)
    answer = F.when(~none, a).when(split_q != "", text.collapse(split_a))
    labelled = _first(f, "question number", "question no", "number", "no")
    free = F.regexp_extract(t, r"(?i)\b(?:question|parliamentary question)\s+(?:number|no\.?|num)?\s*[:#]?\s*([A-Z]{0,4}\s*\d+/?\d*)", 1)
    number = F.when(labelled.isNotNull(), F.regexp_extract(labelled, r"(?i)\b([A-Z]{0,4}\s*\d{1,6}(?:/\d{1,6})?)\b", 1)).otherwise(free)
    df = df.withColumns({"question_text": question, "answer_text": answer})
    return df.withColumns(
        {
            "question_number": text.limit_string(number),
            "asked_by_name": text.limit_string(names.clean_person_value(_first(f, "asked by", "member", "mp", "question by"))),
            "department": text.limit_string(_first(f, "department", "portfolio", "to department")),
            "minister": text.limit_string(names.clean_person_value(_first(f, "minister", "answered by", "reply by"))),
            "asked_date": dates.parse(_first(f, "asked date", "date asked", "question date", "asked on")),
            "answered_date": dates.parse(_first(f, "answered date", "date answered", "reply date", "answered on")),
            "status": text.limit_string(F.coalesce(_first(f, "status"), F.when(F.col("answer_text").isNotNull(), "ANSWERED").otherwise("UNANSWERED"))),
            "parse_status": F.when(t != "", "PARSED").otherwise("PARTIAL"),
        }
    ).drop("_t", "_f")


def binary_record(body: Column, head: int | None = None) -> Column:
    """T-13: the body is a binary file: ZIP signature, or more than four NULs (in its first ``head`` characters, if given)."""
    read = body if head is None else F.left(body, F.lit(head))
    return F.startswith(body, F.lit("PK\x03\x04")) | (text.count_of(read, "\x00") > 4)


def vote_signal(body: Column) -> Column:
    """T-14: ``struct(vote_type, result)`` if the text reports a division, else NULL."""
    low = F.lower(F.coalesce(body, F.lit("")))
    kind = text.keyword_case(low, [(p, k) for p, k, _ in vocab.VOTE_SIGNALS], "unknown")
    result = text.keyword_case(low, [(p, r) for p, _, r in vocab.VOTE_SIGNALS])
    return F.when(text.contains_any(low, vocab.DIVISION_MARKERS), F.struct(kind.alias("vote_type"), result.alias("result")))


def vote_counts(body: Column) -> Column:
    """T-15: explicit aggregate counts as ``array<struct(vote_value, n)>``."""
    found = []
    for pattern, value in vocab.COUNT_PATTERNS:
        n = F.regexp_extract(body, "(?i)" + pattern, 1)
        found.append(F.when(n != "", F.struct(F.lit(value).alias("vote_value"), n.cast("int").alias("n"))))
    return F.array_compact(F.array(*found))


def vote_events(meetings: DataFrame, body: str, title_length: int | None = None) -> DataFrame:
    """T-16: vote events reported by meeting minutes, with their explicit counts; titles are cut if ``title_length`` is given."""
    title = F.concat(F.lit("Committee decision: "), "title")
    df = meetings.withColumn("_body", html.visible_text(F.col(body))).where("_body <> ''").withColumn("_s", vote_signal(F.col("_body"))).where("_s is not null")
    return df.select(
        "id", (title if title_length is None else F.left(title, F.lit(title_length))).alias("title"), "date", "committee_name", "source_url",
        F.when(F.col("_s.vote_type") == "unknown", "committee_decision").otherwise(F.col("_s.vote_type")).alias("vote_type"),
        F.col("_s.result").alias("result"), vote_counts(F.col("_body")).alias("counts"),
    )


def source_status(html_col: Column, url: Column) -> Column:
    """T-17: current or former office holder by the wording of the page."""
    return text.let(
        F.lower(html.visible_text(html_col)),
        lambda low: F.when(text.contains_any(low, vocab.CURRENT_SIGNALS), "CURRENT").when(text.contains_any(low, vocab.FORMER_SIGNALS), "FORMER")
        .when(F.contains(url, F.lit(vocab.CURRENT_URL_PART)), "CURRENT").otherwise("UNKNOWN"),
    )


# Words that show a member page carries a field.
FIELD_SIGNALS = {
    "person name": ["member name", "full name", "surname", "members"], "party": ["political party", "party"],
    "role": ["position", "role", "whip", "chairperson"], "house/chamber": ["national assembly", "ncop", "chamber"],
    "province": ["province", "provincial"], "contact/profile URL": ["contact", "profile", "email"],
}


def field_presence(body: Column) -> Column:
    """T-18: fields a page seems to offer."""
    low = F.lower(text.collapse(F.regexp_replace(F.coalesce(body, F.lit("")), "<[^>]+>", " ")))
    return text.let(low, lambda t: F.array_compact(F.array(*[F.when(text.contains_any(t, words), F.lit(f)) for f, words in FIELD_SIGNALS.items()])))


def _alias_in(chunk: Column, alias: Column) -> Column:
    words = names.name_tokens(chunk)
    return text.let(words, lambda w: (F.size(names.name_tokens(alias)) > 0) & F.forall(names.name_tokens(alias), lambda a: F.array_contains(w, a)))


def person_contexts(body: Column, aliases: Column) -> Column:
    """T-19: chunks naming the person together with their neighbours, once each."""
    def around(chunks: Column) -> Column:
        hits = F.transform(
            chunks,
            lambda c, i: F.when(
                F.exists(aliases, lambda a: _alias_in(c, a)),
                text.clean_display(F.array_join(F.slice(chunks, F.greatest(i, F.lit(1)), F.least(i + 2, F.size(chunks)) - F.greatest(i, F.lit(1)) + 1), " ")),
            ),
        )
        return text.unique_values(F.array_compact(hits))

    return F.coalesce(text.let(text.sentences(body), around), F.array().cast("array<string>"))


def topic_excerpt(body: Column, aliases: Column) -> Column:
    """T-20: the first three chunks that do not name the person."""
    others = F.filter(text.sentences(body), lambda c: ~F.exists(aliases, lambda a: _alias_in(c, a)))
    return text.excerpt(F.coalesce(F.nullif(F.array_join(F.slice(others, 1, 3), " "), F.lit("")), body))


def infer_asker(body: Column) -> Column:
    """T-21: ``Mr X (PARTY) to ask`` names the asker."""
    title = r"\b((?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\s+[A-Z][A-Za-z .'-]{2,90}"
    first = F.regexp_extract(body, title + r"\s+\([^)]+\))\s+to ask", 1)
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(F.regexp_extract(body, title + r")\s+to ask", 1)), F.lit("")))


def committee_members(pages: DataFrame) -> DataFrame:
    """T-22: members listed on a committee page with the role shown next to them."""
    items = pages.select("page_id", "url", F.posexplode(html.list_items(F.col("html"))).alias("pos", "item"))
    one = items.select("page_id", "url", "pos", "item", F.explode(F.slice(html.links(F.col("item")), 1, 1)).alias("l"))
    one = one.where(urls.linked_path(F.col("l.href"), F.col("url")).rlike(r"^/person/[a-z0-9-]+/$"))
    rest = F.replace(html.strip_tags(F.col("item")), F.col("l.label"), F.lit(" "))
    near = F.regexp_extract(rest, r"(?i)\b(chairperson|chair|alternate member|alternate|whip|minister|deputy minister|member)\b", 1)
    # Exploded, a name is made once: a test of a column is computed again below the projection that makes it.
    member = F.struct(names.person_name(names.strip_honorific(F.col("l.label"))).alias("name"), text.let(near, lambda v: names.role(v)).alias("role"))
    named = one.select("page_id", "pos", F.explode(F.array(member)).alias("m")).select("page_id", "pos", "m.*")
    named = named.where(~F.lower("name").isin("", "profile", "person"))
    g = named.groupBy("page_id", F.lower("name").alias("_n"), "role").agg(F.min(F.struct("pos", "name")).alias("b"))
    return g.select("page_id", F.col("b.name").alias("name"), names.slug(F.col("b.name")).alias("slug"), "role")


def profiles(pages: DataFrame) -> DataFrame:
    """T-23: person, party, photo and status of profile pages."""
    h = F.col("html")
    first, last = html.meta_content(h, "profile:first_name"), html.meta_content(h, "profile:last_name")
    heading = F.coalesce(F.nullif(html.class_text(h, r"\bmp-name\b"), F.lit("")), F.nullif(html.element_text(h, "h1"), F.lit("")))
    full = F.coalesce(
        F.when(first.isNotNull() & last.isNotNull(), F.concat_ws(" ", first, last)), names.strip_honorific(heading),
        F.substring_index(html.element_text(h, "title"), "::", 1),
    )
    block = F.regexp_extract(h, r"(?is)class=[\"'][^\"']*mp-block__title[^\"']*[\"'][^>]*>(?:[^<]|<(?!/?a\b))*?political party.*?<a\b[^>]*>(.*?)</a>", 1)
    source = r"(?is)<img\b(?=[^>]*\bclass\s*=\s*[\"']?[^\"'>]*mp-image)[^>]*?\ssrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    photo = F.trim(html.unescape(F.concat(*[F.regexp_extract(h, source, i) for i in (1, 2, 3)])))
    df = pages.withColumns({"full_name": names.person_name(full), "_p": names.party(html.strip_tags(block))})
    return df.select(
        "page_id", "url", "full_name", names.display_name(F.col("full_name")).alias("display_name"), names.slug(F.col("full_name")).alias("slug"),
        F.col("_p.name").alias("party_name"), F.col("_p.short_name").alias("party_short_name"),
        F.coalesce(F.when(photo != "", urls.absolute(photo, F.col("url"))), html.meta_content(h, "og:image")).alias("photo_url"),
        source_status(h, F.col("url")).alias("source_status"), "html",
    )


def profile_committees(profile_rows: DataFrame) -> DataFrame:
    """T-23: current committees of profile pages, party and constituency entries left out."""
    df = profile_rows.select("page_id", "party_name", F.explode(html.elements(F.col("html"), "div", html.with_class("text-link"))).alias("i"))
    link = F.get(html.links(F.col("i")), F.lit(0))["label"]
    shown = html.class_text(F.col("i"), r"text-link__text")
    df = df.select("page_id", "party_name", names.committee_name(link).alias("committee"), shown.alias("shown"), html.class_text(F.col("i"), r"text-link__date").alias("since"))
    raw = F.trim(F.replace(F.trim(F.substring_index("shown", " at ", 1)), F.col("committee"), F.lit("")))
    low = F.lower("committee")
    keep = ~(F.contains(low, F.lower("party_name")) | text.contains_any(low, ["constituency office", "election list"]))
    return df.where((F.col("committee") != "") & keep).select("page_id", "committee", names.role(F.nullif(raw, F.lit(""))).alias("role"), dates.since(F.col("since")).alias("start_date"))


def bill_links(pages: DataFrame, site: str) -> DataFrame:
    """T-24: linked bills of a list, facts read from the surrounding item."""
    items = pages.select("page_id", F.explode(html.list_items(F.col("html"))).alias("i"))
    df = items.select("page_id", html.strip_tags(F.col("i")).alias("around"), F.explode(html.links(F.col("i"))).alias("l")).where(F.contains("l.href", F.lit("/bill")) & (F.length("l.label") >= 5))
    href, title = F.col("l.href"), F.col("l.label")
    return df.select(
        "page_id", title.alias("title"), dates.bill_number(title).alias("bill_number"), dates.year_in(F.col("around")).alias("year"),
        text.keyword_case(F.col("around"), vocab.HOUSE_KEYWORDS).alias("house"), text.keyword_case(F.col("around"), vocab.BILL_STATUS_KEYWORDS, "unknown").alias("status"),
        F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(site), href)).alias("source_url"),
    )


def meeting_pages(pages: DataFrame) -> DataFrame:
    """T-25: title, date and summary of meeting pages."""
    h = F.col("html")
    return pages.select(
        "page_id", html.element_text(h, "h1").alias("title"), dates.first_in_text(html.class_text(h, "date|meta")).alias("date"),
        F.nullif(html.class_text(h, "summary|content|body"), F.lit("")).alias("summary"),
    ).where("title <> ''")


def meeting_page_attendance(pages: DataFrame) -> DataFrame:
    """T-25: attendance lists (0.9) and tables (0.85) under their headings."""
    # Each part of a page begins with a heading; a list or table right behind it belongs to the heading.
    part = r"(?is)^<h([2-6])\b[^>]*>(.*?)</h\1\s*>\s*<(ul|ol|table)\b[^>]*>(.*)"
    df = pages.select("page_id", F.explode(F.split("html", r"(?i)(?=<h[2-6]\b)")).alias("p")).where(F.col("p").rlike(part))
    df = df.select("page_id", html.strip_tags(F.regexp_extract("p", part, 2)).alias("heading"), F.lower(F.regexp_extract("p", part, 3)).alias("kind"), html.balanced(F.regexp_extract("p", part, 4), F.regexp_extract("p", part, 3)).alias("inner"))
    df = df.where(F.col("heading").rlike(r"(?i)attendance|members present|apologies"))
    status = lambda c: text.keyword_case(c, vocab.ATTENDANCE_KEYWORDS, "unknown")
    lists = df.where("kind <> 'table'").select("page_id", "heading", F.explode(html.list_items(F.col("inner"))).alias("i"))
    lists = lists.select("page_id", html.strip_tags(F.col("i")).alias("name_raw"), status(F.col("heading")).alias("attendance_status"), F.lit(0.9).alias("confidence"))
    tables = df.where("kind = 'table'").select("page_id", "heading", F.explode(html.table_rows(F.col("inner"))).alias("r")).select("page_id", "heading", html.cells(F.col("r"), "td").alias("c")).where("size(c) > 0")
    shown = F.coalesce(F.nullif(F.get("c", F.lit(1)), F.lit("")), F.col("heading"))
    tables = tables.select("page_id", F.col("c")[0].alias("name_raw"), status(shown).alias("attendance_status"), F.lit(0.85).alias("confidence"))
    return lists.unionByName(tables).where("name_raw <> ''")


def first_pdf_link(pages: DataFrame) -> DataFrame:
    """T-26: first link of a page that leads to a PDF."""
    def is_pdf(link: Column) -> Column:
        return F.contains(F.lower(link["href"]), F.lit(".pdf")) | F.contains(F.lower(link["label"]), F.lit("pdf"))

    found = pages.select("page_id", "url", F.get(F.filter(html.links(F.col("html")), is_pdf), F.lit(0)).alias("l")).where("l is not null")
    return found.select("page_id", urls.absolute(F.col("l.href"), F.col("url")).alias("pdf_url"))
