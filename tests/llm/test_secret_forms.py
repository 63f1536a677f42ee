"""Secrets in forms other than AKIA keys and assigned lower-case hex."""

from __future__ import annotations

import random
import string

from polislake.llm import secret_scan
from polislake.llm.queries import known_format

RNG = random.Random(6)


def some(chars: str, n: int) -> str:
    return "a1" + "".join(RNG.choice(chars) for _ in range(n - 2))


WORDS = string.ascii_letters + string.digits
FORMS = [
    (lambda: ('TOKEN = "', some("0123456789abcdef", 40).upper()), 1),
    (lambda: ("password: ", some("0123456789abcdef", 18)), 1),
    (lambda: ("\"api_key\": \"", some("0123456789ABCDEF", 32)), 1),
    (lambda: ("use ", "ghp_" + some(WORDS, 36)), 1),
    (lambda: ("use ", "sk_live_" + some(WORDS, 24)), 1),
    (lambda: ("password: ", some(WORDS, 24)), None),
    (lambda: ("it is ", some(WORDS, 40)), None),
    (lambda: ("secret = ", "correcthorsebatterystaple"), None),
    (lambda: ("the ", "internationalization" + RNG.choice("abcdefgh")), 0),
    (lambda: ("the number ", "9807915762804490"), 0),
]


def test_labels_and_verdicts_by_form(spark):
    rows, want = [], {}
    for i in range(30):
        for k, (form, label) in enumerate(FORMS):
            lead, value = form()
            text = f"Some words of an ordinary text {lead}{value}\" and more of it"
            rows.append((len(rows), text, "src"))
            want[len(rows) - 1] = (k, label)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    picked = docs.selectExpr("doc_id as _row", "text as _text", "source as _path")
    got = {r["_row"]: r["label"] for r in secret_scan.candidates(picked, 16).withColumn("label", known_format()).collect()}
    assert got == {d: label for d, (_, label) in want.items()}
    said = {r["_id"]: r["secret"] for r in secret_scan.scan_secrets(docs, label=known_format()).collect()}
    for d, (k, label) in want.items():
        if label is not None or k in (5, 6):
            assert said[d] == (label != 0), rows[d]
