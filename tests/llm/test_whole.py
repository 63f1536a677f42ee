"""Places where an operator once did less than the whole: each test would have failed then."""

from __future__ import annotations

import random

import numpy as np
import pytest

from polislake.llm import pii

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))


def test_written_out_address_in_plain_prose(tagger):
    prose = "Those who want to hear more of the garden and the people who look after it may write to "
    address = "lore.senta at mail dot example dot com"
    text = prose * 2 + address + " and they will answer. " + prose
    assert not any(c.isdigit() or c == "@" for c in text)
    _, (every,) = pii.find([text], tagger)
    at = 2 * len(prose)
    assert any(k == 0 and (s, e) == (at, at + len(address)) for s, k, e in every), pii.written(every)


def test_windows_equal_the_whole_text(tagger):
    """The spans are those of decoding every window, with a trained tagger and with ones that tag at random."""
    rng = random.Random(8)
    words = ["at", "AT", " at ", "dot", "(at)", "b.org", "x@y.de", "7", "+1 262", "²", "٣", "\n", ".", "-", "rather", "long words", "été"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += ["far from anything " * rng.randint(0, 20) + rng.choice(["me at a dot b", "9", "nothing"]) + " nor near" * rng.randint(0, 20) for _ in range(100)]

    def whole(text: str, model: pii.Tagger) -> list[pii.Span]:
        found, codes = [], pii.encode(text)
        for start in range(0, len(text), pii.STEP):
            tags, soft = model.decode(pii._cut(codes, start)[None])
            row, p, i = tags[0][: len(text) - start], soft[0], 0
            while i < min(len(row), pii.WIDTH):
                j = i + 1
                if row[i]:
                    while j < len(row) and row[j] == 2 + 2 * ((row[i] - 1) // 2):
                        j += 1
                    found.append((start + i, int((row[i] - 1) // 2), start + j, float(p[i:j].mean())))
                i = j
        return pii.reconcile(found, pii.base_spans(text), text, sure)

    for model, sure in ((tagger, 0.8), (pii.Tagger(seed=1), 0.0), (pii.Tagger(seed=2), 0.0)):
        if sure == 0:  # long runs of one kind
            model.p["move"] = (3 * np.eye(pii.TAGS)).astype(np.float32)
        _, every = pii.find(texts, model, sure)
        assert every == [whole(t, model) for t in texts]
