"""Records from pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from polislake.operators import answers
from polislake.operators import evidence as ev
from polislake.operators import extract as ex


def one(spark, body, fn):
    return spark.createDataFrame([(body,)], "b string").select(fn(F.col("b")).alias("o")).first()["o"]


def test_vote_signals(spark):
    assert one(spark, "The agenda was adopted.", ex.vote_signal) is None
    assert tuple(one(spark, "Following a division, the report was adopted.", ex.vote_signal)) == ("unknown", "adopted")
    assert tuple(one(spark, "8 votes in favour. The Bill was agreed to.", ex.vote_signal)) == ("bill_vote", "agreed_to")
    assert tuple(one(spark, "A division was called.", ex.vote_signal)) == ("unknown", None)
    assert [tuple(x) for x in one(spark, "8 votes in favour, 3 voted against, 1 abstention", ex.vote_counts)] == [("yes", 8), ("no", 3), ("abstain", 1)]


def test_question_record(spark):
    body = "Question Number: NW12 Asked By: Ms A Dlamini (ANC) Department: Health Status: Answered Question: Why - now? Answer: Because. Reply: Final."
    r = ex.question_records(spark.createDataFrame([(body,)], "body string"), "body").first()
    assert (r["question_number"], r["asked_by_name"], r["department"], r["status"]) == ("NW12", "Ms A Dlamini", "Health", "Answered")
    assert r["question_text"] == "Why - now?" and r["answer_text"] == "Because."


def test_binary_bodies(spark):
    assert one(spark, "PK\x03\x04rest", ex.binary_record) and one(spark, "a\x00\x00\x00\x00\x00", ex.binary_record)
    assert not one(spark, "a\x00b", ex.binary_record)


def test_contexts_and_topic(spark):
    body = "Opening. Mr Zulu asked about water. It was noted.\nBudget closed. Done."
    df = spark.createDataFrame([(body, ["Mr Zulu", "Zulu"])], "b string, a array<string>")
    r = df.select(ex.person_contexts(F.col("b"), F.col("a")).alias("c"), ex.topic_excerpt(F.col("b"), F.col("a")).alias("t")).first()
    assert r["c"] == ["Opening. Mr Zulu asked about water. It was noted."] and r["t"] == "Opening. It was noted. Budget closed."


def test_involvement(spark):
    rows = [(["He sent an apology"], "present"), (["She asked why"], None), ([], "Present"), (["Named"], None), ([], None)]
    df = spark.createDataFrame(rows, "c array<string>, s string")
    assert [r[0] for r in df.select(ev.involvement(F.col("c"), F.col("s"))).collect()] == ["apology", "intervention", "present", "mentioned", "not_found"]


def test_answer_text(spark):
    asked = spark.createDataFrame([(1, "bills", "Which bill?"), (2, "votes", "Which vote?")], "question_id int, intent string, question string")
    routed = spark.createDataFrame([(1, "bills", "Water Bill", "2020", "passed", 1), (1, "bills", "Fire Bill", None, None, 2)], "question_id int, intent string, title string, date string, excerpt string, rank int")
    got = {r["question_id"]: r["answer"] for r in answers.build(asked, routed, asked.select("question_id")).collect()}
    assert got[1].split("\n")[:3] == ["Based on the source-backed records currently imported, I found 2 relevant records for: Which bill?", "- Water Bill: 2020 | passed", "- Fire Bill"]
    assert got[2].startswith("I could not find source-backed records")


def test_field_presence_and_status(spark):
    assert one(spark, "<p>Full name and Political party, province</p>", ex.field_presence) == ["person name", "party", "province"]
    df = spark.createDataFrame([("Former member", "u"), ("x", "https://e.org/position/member/parliament/"), ("x", "u")], "h string, u string")
    assert [r[0] for r in df.select(ex.source_status(F.col("h"), F.col("u"))).collect()] == ["FORMER", "CURRENT", "UNKNOWN"]


def test_html_as_it_comes(spark):
    """Nested elements, any attribute order, unquoted values, numeric references."""
    from polislake.functions import html

    c = F.col("h")

    def one(source, column):
        return spark.createDataFrame([(source,)], "h string").select(column.alias("v")).first()["v"]

    assert one('<div class="summary"><div>first</div>second</div>third', html.class_text(c, "summary")) == "first second"
    assert one("<p><span class=date>1 May</span> x</p>", html.class_text(c, "date")) == "1 May"
    assert one("<ul><li>a<ul><li>b</li></ul>c</li><li>d</li></ul>", F.transform(html.list_items(c), html.strip_tags)) == ["a b c", "b", "d"]
    assert one('<meta content="Some title" property="og:title">', html.meta_content(c, "og:title")) == "Some title"
    assert one("<meta name=date content=2020-01-02>", html.meta_content(c, "date")) == "2020-01-02"
    assert [tuple(x) for x in one("<a class=k href=/x/y>one</a><a href='/z'>two</a>", html.links(c))] == [("/x/y", "one"), ("/z", "two")]
    assert one("<p>it&#8217;s &#x1F600; &amp;#39; &#99999999;</p>", html.visible_text(c)) == "it’s \U0001f600 &#39; &#99999999;"
