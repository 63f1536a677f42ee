"""Content keys: repeatable, order-free and independent of the cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from polislake.functions.text import collapse


def row_checksum(fields: Mapping[str, Column]) -> Column:
    """P-27: SHA-256 of compact JSON with sorted keys, NULLs kept."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def result_key(manifest: Column, contest: Column, geography: Column, party: Column, candidate: Column) -> Column:
    """P-27: identity of one vote-total row."""
    identity = {
        "manifest_key": manifest, "contest_id": contest, "geography_id": geography,
        "party_id": party, "candidate_id": candidate,
    }
    return F.concat(F.lit("iec-vote:"), row_checksum(identity))


def universe_key(parts: Sequence[Column]) -> Column:
    """P-28: SHA-256 of the JSON list of lower-case, collapsed parts."""
    clean = [collapse(F.lower(F.coalesce(p, F.lit("")))) for p in parts]
    return F.sha2(F.to_json(F.array(*clean)), 256)


def surrogate_id(*parts: Column) -> Column:
    """A repeatable 64-bit id from a natural key."""
    return F.xxhash64(*parts)
