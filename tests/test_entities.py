"""Resolution, mentions, substring search and merges against brute force."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from polislake.operators import linking, mentions, merge, resolve, tables

PEOPLE = [
    (1, "Resolution Test Person", "Resolution Person", "resolution-test-person"), (2, "Anna Maria Dlamini", "Anna Dlamini", "anna-maria-dlamini"),
    (3, "Ben Dlamini", "Ben Dlamini", "ben-dlamini"), (4, "Zoë Mokoena", "Zoë Mokoena", "zoe-mokoena"),
]


def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, full_name string, display_name string, slug string")


def test_resolution_order_and_ambiguity(spark):
    p = people(spark)
    al = resolve.alias_table(p)
    rows = ["resolution test PERSON", "Resolution  Person", "Hon Person", "Person", "Dlamini", "anna-maria-dlamini", "A Dlamini", "Mokoena", "Nobody", " ", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r["i"]: (r["person_id"], r["confidence"], r["reason"]) for r in resolve.resolve(df, p, al, "raw").collect()}
    assert got[0] == (1, 0.99, "exact_full_name") and got[1] == (1, 0.95, "display_name")
    assert got[2] == (1, 0.9, "alias:TITLE_SURNAME") and got[3] == (1, 0.72, "unique_surname_alias")
    assert got[4] == (None, None, None)
    assert got[5] == (2, 0.93, "slug") and got[6][:2] == (2, 0.9) and got[7][:2] == (4, 0.72)
    assert got[8] == got[9] == got[10] == (None, None, None)


def test_assess_flags_ambiguous(spark):
    p = people(spark)
    df = spark.createDataFrame([(1, "Dlamini"), (2, "Ben Dlamini"), (3, "Nobody")], "id int, raw_value string")
    found = resolve.candidates(df, p, resolve.alias_table(p), "raw_value")
    got = {r["id"]: r for r in resolve.assess(df, found, "raw_value").collect()}
    assert got[1]["ambiguous"] and got[1]["bucket"] == "low" and got[1]["candidates"] == "2,3"
    assert got[2]["bucket"] == "high" and got[2]["recommended"] and got[3]["bucket"] == "low"


def brute_mentions(texts, spellings, solved):
    out = {}
    for key, body in texts:
        for form in sorted(spellings, key=lambda f: (-len(f), f)):
            m = re.search(rf"\b{re.escape(form)}\b", body, flags=re.IGNORECASE)
            if m and form in solved and (key, solved[form]) not in out:
                left, right = max(0, m.start() - 250), min(len(body), m.end() + 250)
                cut = " ".join(body[left:right].split())
                out[(key, solved[form])] = (form, ("..." if left else "") + cut + ("..." if right < len(body) else ""))
    return out


def test_mentions_equal_a_regex_for_every_name(spark):
    p = people(spark)
    al = resolve.alias_table(p)
    texts = [
        (1, "Ms Dlamini and ANNA  DLAMINI spoke; later Anna Dlamini, again."), (2, "x " * 300 + "Zoë Mokoena asked. " + "y " * 300), (3, "Mokoenas and Zoëx and B. Dlamini."),
        (4, "resolution-test-person: Hon Person"), (5, "nothing"), (6, "(Mokoena)"), (7, ""), (8, "Zo Mokoena_ Mokoena"),
    ]
    forms = [r["form"] for r in mentions.mention_forms(p, al).collect()]
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    solved = {r["form"]: r["person_id"] for r in resolve.resolve_distinct(df, p, al, "form").collect()}
    want = brute_mentions(texts, forms, solved)
    docs = spark.createDataFrame(texts, "id int, body string")
    got = {(r["id"], r["person_id"]): (r["form"], r["snippet"]) for r in mentions.detect(docs, "id", "body", p, al).collect()}
    assert got == want and len(got) >= 5


def test_contained_equals_nested_loop(spark):
    titles = ["Portfolio Committee on Health: budget", "party of arts", "Arts and Culture", "", "healthy arts", "x"]
    names_ = ["health", "arts", "arts and culture", "party", "committee on health", "zzzz"]
    t = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    n = spark.createDataFrame([(x,) for x in names_], "_name string")
    got = {(r["id"], r["_name"]) for r in tables.contained(t, "id", "title", n, 4).collect()}
    assert got == {(i, x) for i, v in enumerate(titles) for x in names_ if x in v.lower()}
    d = spark.createDataFrame(list(enumerate(names_)), "e int, name string")
    best = {r["id"]: r["matched_name"] for r in tables.longest_contained(t, "id", "title", d, "e", "name", 4).collect()}
    assert best == {0: "committee on health", 1: "party", 2: "arts and culture", 4: "health"}


def test_merge_is_idempotent_and_null_safe(spark):
    old = spark.createDataFrame([("a", None, 1, "x"), ("b", "u", 2, None)], "k string, u string, n int, t string")
    new = spark.createDataFrame([("a", None, 5, ""), ("b", "u", 1, "y"), ("c", None, 9, "z"), ("c", None, 8, "w")], "k string, u string, n int, t string")
    rules = {"n": "greatest", "t": "keep_if_null_new"}
    once = merge.merge_upsert(old, new, ["k", "u"], rules, order=[F.desc("n")])
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [("a", None, 5, "x", "updated"), ("b", "u", 2, "y", "updated"), ("c", None, 9, "z", "created")]
    twice = merge.merge_upsert(once.drop("change"), new, ["k", "u"], rules, order=[F.desc("n")]).drop("change")
    assert sorted(tuple(r) for r in twice.collect()) == [r[:4] for r in rows]


def test_two_key_match(spark):
    old = spark.createDataFrame([(1, "u1", "B1", 2020, None), (2, None, "B2", 2020, "NA"), (3, None, "B2", 2020, "NCOP")], "id long, url string, no string, year int, house string")
    new = spark.createDataFrame([("u1", "B9", 2020, None), (None, "B2", 2020, "NCOP"), (None, "B2", 2020, None), ("u7", "B7", 2021, None)], "url string, no string, year int, house string")
    got = [tuple(r) for r in merge.match_two_keys(new, old, "id", ["url"], ["no", "year"], ["house"]).select("no", "house", "matched_id").collect()]
    assert sorted(got, key=str) == sorted([("B9", None, 1), ("B2", "NCOP", 3), ("B2", None, 2), ("B7", None, None)], key=str)


def test_parties_stay_open_on_conflict(spark):
    att = spark.createDataFrame([("Dlamini, Ms A", "u1", 1), ("A Dlamini", "u2", 1), ("Mr B Zulu", "u3", 1), ("B Zulu", "u4", 2), ("Staff", "u5", 3)], "name_raw string, source_url string, party_id int")
    q = spark.createDataFrame([("Adv C Cele", "q1"), ("A Dlamini", "q2")], "asked_by_name string, source_url string")
    got = {r["slug"]: (r["full_name"], r["party_id"]) for r in linking.people_hints(att, q).collect()}
    assert got == {"a-dlamini": ("A Dlamini", 1), "b-zulu": ("B Zulu", None), "c-cele": ("C Cele", None)}


def test_hot_key_stays_whole(spark):
    """A key with most of the rows loses nothing in top-k, resolution and merge."""
    facts = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, "Ben Dlamini").otherwise(F.concat(F.lit("n"), "id")).alias("raw"))
    p = people(spark)
    out = resolve.resolve(facts, p, resolve.alias_table(p), "raw")
    assert out.count() == 20_000 and out.where("person_id = 3").count() == 18_000
    assert tables.top_k(facts, ["raw"], [F.desc("id")], 3).where("raw = 'Ben Dlamini'").count() == 3
