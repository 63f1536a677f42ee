"""Cheapest repair of a conversation's turn structure, rebuilt by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept,
given another role, deleted, or an empty turn is inserted; blank rows and
repeats must go. Four states (nothing yet, after ``s``, ``u``, ``a``) tell what
may follow. A forward pass gives the least cost of reaching each state in the
middle, a backward pass the least cost from there; they meet in the crossing
with the least sum, and either half is solved the same way. Only vectors of
four numbers are kept, so memory stays linear in the conversation (one byte and
one digest a row) and time is n log n.

Ties go to the ASCII-least audit. The forward vector therefore also ranks the
states by their least cheapest audits so far. Crossings lie right behind a
consumed row; such audits are never prefixes of each other (a longer one would
have to go on with inserts only, and ends in a consumed row), so the rank of
the crossing decides before anything that follows.

Two streams over sorted rows. The first reads digests, initials and flags and
gives each conversation its counts, cost and audit; the second reads the texts
in the same order and applies the audit to them, hashing as it goes. Neither
holds the texts of a conversation.

Defined cases: a null role or text counts as one space; null turns come first;
rows of one turn are ordered by the digest of role and text, so that repeats
stay side by side; rows without a conversation id are one conversation; a
conversation without rows after damage has zeros, an empty audit and the digest
of nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.llm.common import pick
from polislake.llm.prefix_trie import CRC32

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a row that stays though it is cut off.
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
CUT_OFF = 3
INITIALS = "sua"
#: States: nothing yet, after s, after u, after a; the turn that may be inserted or rerolled to in each, and where it leads.
NEXT = [2, 2, 3, 2]
ROLE = {2: "user", 3: "assistant"}
_FAR = 1 << 60
#: How a row may be treated: as it is, with the cut-off cost, deleted only.
WHOLE, TRUNCATED, UNFIT = range(3)


def _inserts(state: int) -> list[tuple[int, int, str]]:
    """States that inserts lead to, their cost and letters; three inserts lead where one does."""
    first, second = NEXT[state], NEXT[NEXT[state]]
    return [(state, 0, ""), (first, COST[INSERT], INSERT), (second, 2 * COST[INSERT], 2 * INSERT)]


def _moves(initial: int, mode: int) -> list[list[tuple[int, int, str] | None]]:
    """``[from][to]``: cost and letters of the cheapest, then ASCII-least way over one row (initial 0 to 2, or 3 for any other)."""
    best: list[list] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        for at, cost, letters in _inserts(state):
            ways = [(at, COST[DELETE], DELETE)]
            if mode != UNFIT:
                extra = CUT_OFF * (mode == TRUNCATED)
                ways.append((NEXT[at], COST[REROLE] + extra, REROLE))
                if initial < 3 and (NEXT[at] == initial + 1 or initial == 0 == at):
                    ways.append((initial + 1, COST[KEEP] + extra, KEEP))
            for to, more, letter in ways:
                way = (cost + more, letters + letter)
                if best[state][to] is None or way < best[state][to]:
                    best[state][to] = way
    return best


#: By kind of row: 3 * initial + mode.
_STEPS = [_moves(kind // 3, kind % 3) for kind in range(12)]
_TAILS = [min((cost, letters) for to, cost, letters in _inserts(state) if to in (0, 3)) for state in range(4)]


def _forward(kinds: bytes, start: int) -> tuple[list[int], list[int]]:
    """Least cost of each state behind the last row, and the states' order by their least cheapest audits."""
    cost, rank = [_FAR] * 4, [9] * 4
    cost[start] = rank[start] = 0
    for kind in kinds:
        step, found = _STEPS[kind], [(_FAR, 9, "")] * 4
        for state in range(4):
            if (c := cost[state]) < _FAR:
                r, ways = rank[state], step[state]
                for to in range(4):
                    if (way := ways[to]) and (c + way[0], r, way[1]) < found[to]:
                        found[to] = (c + way[0], r, way[1])
        cost = [f[0] for f in found]
        rank = [9] * 4
        for place, to in enumerate(sorted((to for to in range(4) if cost[to] < _FAR), key=lambda to: found[to][1:])):
            rank[to] = place
    return cost, rank


def _backward(kinds: bytes, end: int) -> list[int]:
    """Least cost from each state before the first row to ``end`` behind the last."""
    cost = [_FAR] * 4
    cost[end] = 0
    for kind in reversed(kinds):
        cost = [min((way[0] + cost[to] for to, way in enumerate(ways) if way), default=_FAR) for ways in _STEPS[kind]]
    return cost


def _letters(kinds: bytes, start: int, end: int) -> str:
    """The ASCII-least cheapest audit from one state to another."""
    if len(kinds) == 1:
        return _STEPS[kinds[0]][start][end][1]
    half = len(kinds) // 2
    (before, rank), after = _forward(kinds[:half], start), _backward(kinds[half:], end)
    meet = min(range(4), key=lambda s: (before[s] + after[s], rank[s]))
    return _letters(kinds[:half], start, meet) + _letters(kinds[half:], meet, end)


def repair(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's rows, one byte each: 3 * initial + mode."""
    cost, rank = _forward(kinds, 0)
    end = min(range(4), key=lambda s: (cost[s] + _TAILS[s][0], rank[s]))
    return cost[end] + _TAILS[end][0], (_letters(kinds, 0, end) if kinds else "") + _TAILS[end][1]


@lru_cache(1 << 14)
def _short(kinds: bytes) -> tuple[int, str]:
    return repair(kinds)


def _text_or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def rows_of(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(_conv, _turn, _role, _text, _here)``; a row that is not ``_here`` only says that its conversation exists."""
    rows = pick(chats, _conv=(conv_col, "bigint"), _turn=(turn_col, "bigint"), _role=(role_col, "string"), _text=(text_col, "string"))
    return rows.select("_conv", "_turn", _text_or_space("_role").alias("_role"), _text_or_space("_text").alias("_text"), F.lit(True).alias("_here"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows_of`` rows, each fifth or so dropped, emptied, cut off, repeated or given to the user, by ``crc32(conv:turn) % 20``."""
    dealt = F.crc32(F.concat(_text_or_space("_conv"), F.lit(":"), _text_or_space("_turn"))) % 20
    text = F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(dealt == 4, "user").otherwise(F.col("_role"))
    copies = F.when(dealt == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(dealt != 0))
    return rows.select("_conv", "_turn", role.alias("_role"), text.alias("_text"), F.explode(copies).alias("_here"))


_COUNTS = ["_gaps", "_blank", "_duplicate", "_truncated", "_illegal", "_cost"]


def _judge(batches):
    """Counts, cost and audit of each conversation, from rows sorted by conversation, turn and digest."""
    names = ["_conv", *_COUNTS, "_audit"]
    fresh = object()
    conv = fresh
    kinds, digests, turns, out = bytearray(), [], [None, None, 0, None], []
    illegal, before = 0, None

    def close() -> None:
        n = len(kinds)
        states = np.frombuffer(bytes(kinds), np.uint8)
        initials, blank, cut = states // 4, (states & 1).astype(bool), (states & 2).astype(bool)
        seen = np.zeros(n, bool)
        if n > 1:
            keys = np.frombuffer(b"".join(digests), np.dtype("V16"))
            seen[:] = True
            seen[np.unique(keys, return_index=True)[1]] = False
        seen &= ~blank
        cut &= ~blank & ~seen
        mode = np.where(blank | seen, UNFIT, np.where(cut, TRUNCATED, WHOLE))
        row = (3 * initials + mode).astype(np.uint8).tobytes()
        cost, audit = _short(row) if n <= 16 else repair(row)
        first, last, distinct, _ = turns
        out.append((conv, 0 if first is None else last - first + 1 - distinct, int(blank.sum()), int(seen.sum()), int(cut.sum()), illegal, cost, audit))

    def batch() -> pa.RecordBatch:
        kind = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names)

    for part in batches:
        for c, turn, initial, flags, digest in zip(*[part.column(x).to_pylist() for x in ("_conv", "_turn", "_initial", "_flags", "_digest")], strict=True):
            if c != conv:
                if conv is not fresh:
                    close()
                conv, illegal, before = c, 0, None
                kinds, digests, turns = bytearray(), [], [None, None, 0, None]
            if digest is None:
                continue
            if turn is not None:
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + (turn != turns[3]), turn]
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            kinds.append(4 * (INITIALS.find(initial) if initial and initial in INITIALS else 3) + flags)
            digests.append(digest)
        if out:
            yield batch()
            out.clear()
    if conv is not fresh:
        close()
        yield batch()


def _apply(batches):
    """Digests of repaired conversations: a row with the audit comes first, then the rows in the audit's order."""
    names = ["_conv", *_COUNTS, "_audit", "_repaired_sha256"]
    fact, out = None, []
    sha, at, state, first = hashlib.sha256(), 0, 0, True

    def say(role: str, text: str) -> None:
        nonlocal first
        sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def insert() -> None:
        """The inserts that come next in the audit."""
        nonlocal at, state
        while fact[-1][at : at + 1] == INSERT:
            state = NEXT[state]
            say(ROLE[state], "")
            at += 1

    def batch() -> pa.RecordBatch:
        kind = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names)

    for part in batches:
        for *facts, role, text in zip(*[part.column(x).to_pylist() for x in ("_conv", *_COUNTS, "_audit", "_role", "_text")], strict=True):
            if facts[-1] is not None:
                if fact is not None:
                    insert()
                    out.append((*fact, sha.hexdigest()))
                fact = facts
                sha, at, state, first = hashlib.sha256(), 0, 0, True
                continue
            insert()
            letter = fact[-1][at]
            at += 1
            if letter == REROLE:
                state = NEXT[state]
                say(ROLE[state], text)
            elif letter == KEEP:
                state = INITIALS.index(role[0]) + 1
                say(role, text)
        if out:
            yield batch()
            out.clear()
    if fact is not None:
        insert()
        out.append((*fact, sha.hexdigest()))
        yield batch()


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows_of`` rows: ``_conv``, ``_gaps`` to ``_cost``, ``_audit``, ``_repaired_sha256``."""
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)), 1, 16)
    rows = rows.withColumn("_digest", F.when(F.col("_here"), digest))
    solid = F.rtrim(F.col("_text"), F.lit(" \t\n\x0b\x0c\r"))
    flags = F.when(solid == "", 1).otherwise(0) + F.when(F.right(solid, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    order = [F.col("_turn").asc_nulls_first(), F.col("_digest")]
    small = rows.select("_conv", "_turn", F.substring("_role", 1, 1).alias("_initial"), flags.cast("int").alias("_flags"), "_digest")
    schema = "_conv bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", _audit string"
    facts = small.repartition("_conv").sortWithinPartitions("_conv", *order).mapInArrow(_judge, schema)
    none = {c: F.lit(None).cast("string" if c == "_audit" else "bigint") for c in [*_COUNTS, "_audit"]}
    lines = rows.filter("_here").select("_conv", *[v.alias(c) for c, v in none.items()], "_role", "_text", "_turn", "_digest")
    heads = facts.select("_conv", *none, *[F.lit(None).cast(t).alias(c) for c, t in (("_role", "string"), ("_text", "string"), ("_turn", "bigint"), ("_digest", "binary"))])
    both = heads.unionByName(lines).repartition("_conv").sortWithinPartitions("_conv", F.col("_audit").isNull(), *order)
    return both.select("_conv", *none, "_role", "_text").mapInArrow(_apply, schema + ", _repaired_sha256 string")


ORACLE = f"""
with recursive z as (select conv_id as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC32.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as x from conversations),
w as (select c, turn, case x when 4 then 'user' else role end as role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case x when 3 then [1, 2] else [1] end) from z where x <> 0)),
n as (select *, row_number() over (partition by c order by turn nulls first, role, text) as i from w),
o as (select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid,
  min(i) over (partition by c, role, text) < i as again from n),
f as (select *, solid = '' as blank, solid <> '' and again as dup, solid <> '' and not again and right(solid, 1) not in ('.', '!', '?') as cut,
  left(role, 1) as ini, lag(left(role, 1)) over (partition by c order by i) as pre from o),
-- States 0 nothing yet, 1 after s, 2 after u, 3 after a; up to two inserts, then a row.
ins(q, r, cost, w) as (values (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
eat(r, t, cost, w, ini) as (values (0, 0, 4, 'D', null), (1, 1, 4, 'D', null), (2, 2, 4, 'D', null), (3, 3, 4, 'D', null), (0, 2, 3, 'R', null), (1, 2, 3, 'R', null), (2, 3, 3, 'R', null), (3, 2, 3, 'R', null),
  (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a')),
go as (select i.q, e.t, i.cost + e.cost as cost, i.w || e.w as w, e.w as kind, e.ini, i.q as a, i.w as ins from ins i join eat e using (r)),
gap(q, ins, said) as (values (0, '', []), (0, 'I', ['user:']), (0, 'II', ['user:', 'assistant:']), (1, '', []), (1, 'I', ['user:']), (1, 'II', ['user:', 'assistant:']), (2, '', []), (2, 'I', ['assistant:']), (3, '', []), (3, 'I', ['user:'])),
run as (select distinct c, 0::bigint as i, 0 as q, {{'cost': 0, 'audit': '', 'said': []::varchar[]}} as b from f
  union all
  select r.c, r.i + 1, g.t, min({{'cost': r.b.cost + g.cost + case when g.kind <> 'D' and f.cut then 3 else 0 end, 'audit': r.b.audit || g.w, 'said': r.b.said || p.said ||
    case g.kind when 'K' then [f.role || ':' || f.text] when 'R' then [case g.t when 2 then 'user:' else 'assistant:' end || f.text] else []::varchar[] end}})
  from run r join f on f.c is not distinct from r.c and f.i = r.i + 1 join go g on g.q = r.q and (g.ini is null or g.ini = f.ini) and (g.kind = 'D' or not f.blank and not f.dup) join gap p on p.q = g.q and p.ins = g.ins
  group by all),
fin as (select r.c, min({{'cost': r.b.cost + t.cost, 'audit': r.b.audit || t.w, 'said': r.b.said || t.said}}) as b
  from run r join (select c, max(i) as n from f group by c) m on m.c is not distinct from r.c and m.n = r.i
  join (values (0, 0, '', []), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', [])) t(q, cost, w, said) on t.q = r.q group by r.c),
cnt as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where dup) as duplicate, count(*) filter (where cut) as truncated,
  count(*) filter (where i > 1 and pre || ini not in ('su', 'ua', 'au')) as illegal from f group by c)
select o.c as conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(fin.b.cost, 0)::bigint as cost, coalesce(fin.b.audit, '') as audit, sha256(coalesce(array_to_string(fin.b.said, chr(10)), '')) as repaired_sha256
from (select distinct c from z) o left join cnt on cnt.c is not distinct from o.c left join fin on fin.c is not distinct from o.c
"""
