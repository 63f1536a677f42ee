"""Pieces of DuckDB SQL shared by the checks."""

from __future__ import annotations

from collections.abc import Sequence


def case_contains(col: str, rules: Sequence[tuple[str, str]], default: str | None = None) -> str:
    """``CASE`` over the first keyword contained in a column."""
    whens = " ".join(f"when contains(lower({col}), '{k}') then '{v}'" for k, v in rules)
    return f"case {whens} else {'null' if default is None else repr(default)} end"


def regex_title(expr: str) -> str:
    """Capital after every non-letter."""
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda r: concat(upper(r[1]), substr(r, 2))), '')"
    )
