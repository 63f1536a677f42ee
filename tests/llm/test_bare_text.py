"""Text that stands beside the blocks of a page."""

from __future__ import annotations

import pytest

from polislake.llm.html_extract import main_text


def prose(word: str, n: int) -> str:
    return " ".join([word] * (n // (len(word) + 1) + 1))


BODY = [prose(f"paragraph{i}", 400) for i in range(5)]
INNER = "".join(f"<p>{b}</p>" for b in BODY)


@pytest.mark.parametrize("chars", [40, 300, 900])
def test_lead_outside_the_paragraphs(chars):
    lead, tail = prose("lead", chars), prose("tail", chars)
    assert main_text(f"<body><article>{lead}<p><div>{INNER}</div></article></body>") == "\n".join([lead, *BODY])
    assert main_text(f"<article>{lead}<div>{INNER}</div>{tail}<div>{INNER}</div></article>") == "\n".join([lead, *BODY, tail, *BODY])
    with_links = lead.replace("lead", "<b>lead</b>", 1)
    assert main_text(f"<article>{with_links}<br>more<div>{INNER}</div></article>") == "\n".join([f"{lead} more", *BODY])


def test_long_text_beside_the_chosen_block_without_an_article():
    beside = prose("beside", 1500)
    assert main_text(f"<body>{beside}<div>{INNER}</div></body>") == "\n".join([beside, *BODY])
    assert main_text(f"<body>All rights<div>{INNER}</div></body>") == "\n".join(BODY)
