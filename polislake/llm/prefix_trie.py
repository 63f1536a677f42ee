"""Trie of conversation prefixes in minimal-perfect-hash node tables.

Every prefix of a conversation (its first d turns) has a 128-bit digest, chained
from turn to turn; equal prefixes are one node. Texts are reduced to turn digests
and lengths before anything is shuffled.

1. Prefix rows are taken in shards of at most ``SHARD`` rows. A shard gives its
   distinct digests the slots of a minimal perfect hash (``Slots``; the digest
   kept in a slot verifies every lookup), scatters member counts, smallest ids
   and ends into flat arrays and hands on one row per node. Their sums over all
   shards are the node facts.
2. The smallest member of a node owns it. Conversations, each with the facts of
   the nodes it owns, are taken in shards again; slots of parents are looked up,
   the owned values scattered, and accumulated from the deepest nodes upward
   through the parent-slot array. A node's subtree is the disjoint union of what
   its members own in it, so the sums over all shards are exact, and no shard
   has to hold a subtree: a first turn or a conversation that a third of all
   rows share is spread over many shards, with one row handed on by each.

A conversation longer than a shard is accumulated in parts, from its end to its
root, with the sums so far carried on. Digests of conversations that end in a
node are made as a stream over sorted blocks of ids, in constant memory.

Defined cases: a null role or text is empty; a null turn comes first; turns of
one number are ordered by the digest of role and text; repeated rows are
repeated turns; rows without a conversation id are left out; an empty table has
no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polislake.llm.common import pick, stored
from polislake.llm.words import constants, mix

SHARD = 1 << 17
#: Ids that agree above this many low bits share one block of the list that a node's digest covers.
BLOCK_BITS = 10
_ODD = constants(64, 41)
_NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = np.frombuffer(hashlib.sha256(b"root").digest()[:16], np.int64)


class Slots:
    """A minimal perfect hash: the n distinct digests of ``keys`` (rows of two 64-bit numbers) get the slots 0 to n - 1.

    On each level a digest that has its place for itself stays there, the
    others go on to the next; a slot is the rank of the place among all taken.
    """

    def __init__(self, keys: np.ndarray) -> None:
        keys = keys.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]).any(1)
        left = keys[fresh]
        self.held = np.empty_like(left)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        used = 0
        while len(left):
            at = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left))[at] == 1
            taken = np.zeros(2 * len(left), bool)
            taken[at[alone]] = True
            slot = np.cumsum(taken) - 1 + used
            self.held[slot[at[alone]]] = left[alone]
            self.levels.append((taken, slot))
            used += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        k = 2 * (level % 32)
        return (mix(keys[:, 0] * _ODD[k] + keys[:, 1] * _ODD[k + 1] + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.held)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        keys = keys.view(np.uint64).reshape(-1, 2)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (taken, slot) in enumerate(self.levels):
            at = self._place(keys[left], level, len(taken))
            hit = taken[at]
            out[left[hit]] = slot[at[hit]]
            left = left[~hit]
        known = out >= 0
        out[known] = np.where((self.held[out[known]] == keys[known]).all(1), out[known], -1)
        return out


def turns(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(_conv, _k, _key, _size)``: each conversation's turns numbered from 0, with a digest of role and text and the text's length."""
    rows = pick(chats, _conv=(conv_col, "bigint"), _turn=(turn_col, "bigint"), _role=(role_col, "string"), _text=(text_col, "string")).filter("_conv is not null")
    role, text = F.coalesce("_role", F.lit("")), F.coalesce("_text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = rows.select("_conv", "_turn", key.alias("_key"), F.char_length(text).cast("bigint").alias("_size"))
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_key")
    return stored(rows.select("_conv", (F.row_number().over(order) - 1).cast("bigint").alias("_k"), "_key", "_size"), "turns")


def grafted(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt: conversation c takes its first ``crc32(c) % most`` turns from conversation ``c - c % every``.

    One row with ``_k`` of -1 stands for each conversation, also where no turn is left.
    """
    head = F.crc32(F.col("_conv").cast("string")) % most
    lent = rows.filter((F.col("_conv") % every == 0) & (F.col("_k") < most - 1)).select(F.col("_conv").alias("_from"), "_k", "_key", "_size")
    convs = rows.filter("_k = 0").select("_conv", (F.col("_conv") - F.col("_conv") % every).alias("_from"), head.alias("_head"))
    taken = convs.filter("_head > 0").join(lent, "_from").filter("_k < _head").select("_conv", "_k", "_key", "_size")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("_key", "binary"), ("_size", "bigint"))]
    return rows.filter(F.col("_k") >= head).unionByName(taken).unionByName(convs.select("_conv", F.lit(-1).cast("bigint").alias("_k"), *none))


def _chain(batches):
    """Prefix rows of conversations that come turn by turn: depth, digest, length of the last text, and whether one ends there."""
    names = ["_conv", "_depth", "_hi", "_lo", "_size", "_ends"]
    conv, depth, digest, waiting = None, 0, b"", None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                                           pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.bool_())], names)

    for part in batches:
        rows = []
        for c, key, size in zip(part.column("_conv").to_pylist(), part.column("_key").to_pylist(), part.column("_size").to_pylist(), strict=True):
            if waiting is not None:
                rows.append((*waiting, c != conv))
            if c != conv:
                conv, depth, digest, size = c, 0, ROOT.tobytes(), 0
            else:
                depth, digest = depth + 1, hashlib.blake2b(digest + key, digest_size=16).digest()
            waiting = (conv, depth, digest, size)
        if rows:
            yield batch(rows)
    if waiting is not None:
        yield batch([(*waiting, True)])


def _columns(part: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [part.column(n).to_numpy(zero_copy_only=False) for n in names]


def _facts(size: int):
    """Shards of prefix rows to one row per node: members, smallest member, ends, depth, length."""

    def run(batches):
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            conv, depth, hi, lo, size_, ends = (np.concatenate(c) for c in zip(*held, strict=True))
            keys = np.stack([hi, lo], 1)
            slots = Slots(keys)
            at, total = slots.find(keys), len(slots)
            members, stop, owner = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
            np.add.at(members, at, 1)
            np.add.at(stop, at, ends.astype(np.int64))
            np.minimum.at(owner, at, conv)
            deep, long_ = np.empty(total, np.int64), np.empty(total, np.int64)
            deep[at], long_[at] = depth, size_
            own = slots.held.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (own[:, 0].copy(), own[:, 1].copy(), deep, long_, members, stop, owner)], ["_hi", "_lo", "_depth", "_size", "_n", "_stop", "_conv"])

        for part in batches:
            if part.num_rows:
                held.append(_columns(part, ["_conv", "_depth", "_hi", "_lo", "_size", "_ends"]))
                n += part.num_rows
            if n >= size:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _climb(size: int):
    """Shards of conversations, deepest prefix first, to sums over what they own of each node's subtree.

    A row with ``_n`` holds the facts of the prefix row before it, which its conversation owns.
    """
    names = ["_conv", "_depth", "_hi", "_lo", "_size", "_n", "_stop"]
    kinds = [("_hi", pa.int64()), ("_lo", pa.int64()), ("_children", pa.int64()), ("_leaves", pa.int64()), ("_saved", pa.int64()), ("_up_hi", pa.int64()), ("_up_lo", pa.int64()), ("_stays", pa.bool_())]

    def run(batches):
        held, count = [], 0
        carry = np.zeros(3, np.int64)

        def flush(rows: list[np.ndarray], after: np.ndarray | None) -> pa.RecordBatch:
            nonlocal carry
            conv, depth, hi, lo, length, n, stop = rows
            path = n == 0
            row = np.cumsum(path)[~path] - 1  # of each fact
            keys, conv, depth = np.stack([hi, lo], 1)[path], conv[path], depth[path]
            above = np.concatenate([keys[1:], after[None] if after is not None else ROOT[None]])
            slots = Slots(keys)
            at, total = slots.find(keys), len(slots)
            deep, parent = np.zeros(total, np.int64), np.full(total, -1, np.int64)
            deep[at] = depth
            inner = depth > 0
            parent[at[inner]] = slots.find(above[inner])
            # Children, childless nodes, saved tokens.
            sums = np.zeros((total, 3), np.int64)
            sums[at[0]] += carry
            owned = np.zeros(len(keys), bool)
            owned[row] = True
            sums[at[row], 1] += n[~path] == stop[~path]
            sums[at[row], 2] += (n[~path] - 1) * length[~path]
            up = parent[at[row]]
            np.add.at(sums[:, 0], up[up >= 0], 1)
            order = np.argsort(-deep, kind="stable")
            edges = np.flatnonzero(np.diff(deep[order])) + 1
            for level in np.split(order, edges):
                level = level[parent[level] >= 0]
                np.add.at(sums[:, 1:], parent[level], sums[level, 1:])
            last = at[-1]
            carry = np.zeros(3, np.int64)
            if depth[-1] > 0 and parent[last] < 0:
                carry = np.array([int(owned[-1]), *sums[last, 1:]])
            top = np.zeros(total, bool)
            up_keys, stays = np.zeros((total, 2), np.int64), np.zeros(total, bool)
            mine = np.flatnonzero(owned & inner)
            top[at[mine]], up_keys[at[mine]] = True, above[mine]
            stays[at[mine]] = np.append(owned[1:], False)[mine]
            own = slots.held.view(np.int64)
            arrays = [own[:, 0].copy(), own[:, 1].copy(), *sums.T.copy()]
            return pa.RecordBatch.from_arrays([*[pa.array(a) for a in arrays], *[pa.array(u.copy(), mask=~top) for u in up_keys.T], pa.array(stays, mask=~top)], [k for k, _ in kinds])

        for part in batches:
            if not part.num_rows:
                continue
            held.append(_columns(part, names))
            count += part.num_rows
            if count >= size:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.flatnonzero(rows[5] == 0)[-1])
                if cut:
                    yield flush([r[:cut] for r in rows], np.array([rows[2][cut], rows[3][cut]]))
                    held = [[r[cut:] for r in rows]]
                    count -= cut
        if count:
            yield flush([np.concatenate(c) for c in zip(*held, strict=True)], None)

    return run


def _digests(batches):
    """Blocks of ids, sorted by node and id, to one digest per node."""
    names = ["_hi", "_lo", "_ends_sha256"]
    node, sha = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)

    for part in batches:
        rows = []
        for hi, lo, ids in zip(part.column("_hi").to_pylist(), part.column("_lo").to_pylist(), part.column("_ids").to_pylist(), strict=True):
            if (hi, lo) == node:
                sha.update(b"," + ids.encode())
            else:
                if node is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = (hi, lo), hashlib.sha256(ids.encode())
        if rows:
            yield batch(rows)
    if node is not None:
        yield batch([(*node, sha.hexdigest())])


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the named columns, null where it lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node, from ``turns`` rows with a row of ``_k`` -1 for each conversation (``grafted``, ``rooted``)."""
    long_ = "bigint"
    paths = rows.repartition("_conv").sortWithinPartitions("_conv", "_k").select("_conv", "_key", "_size")
    paths = stored(paths.mapInArrow(_chain, "_conv bigint, _depth bigint, _hi bigint, _lo bigint, _size bigint, _ends boolean"), "paths")
    node = ["_hi", "_lo"]
    facts = paths.mapInArrow(_facts(shard), "_hi bigint, _lo bigint, _depth bigint, _size bigint, _n bigint, _stop bigint, _conv bigint")
    facts = stored(facts.groupBy(*node).agg(F.max("_depth").alias("_depth"), F.max("_size").alias("_size"), F.sum("_n").alias("_n"), F.sum("_stop").alias("_stop"), F.min("_conv").alias("_conv")), "facts")
    zero = F.lit(0).cast(long_)
    both = paths.select("_conv", "_depth", *node, "_size", zero.alias("_n"), zero.alias("_stop")).unionByName(facts.select("_conv", "_depth", *node, "_size", "_n", "_stop"))
    both = both.repartition("_conv").sortWithinPartitions("_conv", F.col("_depth").desc(), "_n")
    sums = both.mapInArrow(_climb(shard), "_hi bigint, _lo bigint, _children bigint, _leaves bigint, _saved bigint, _up_hi bigint, _up_lo bigint, _stays boolean")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("_conv")), lambda c: c.cast("string")), ",")
    ends = paths.filter("_ends").groupBy(*node, F.shiftright("_conv", BLOCK_BITS).alias("_block")).agg(ids.alias("_ids"))
    ends = ends.repartition(*node).sortWithinPartitions(*node, "_block").select(*node, "_ids").mapInArrow(_digests, "_hi bigint, _lo bigint, _ends_sha256 string")
    columns = {"_hi": long_, "_lo": long_, "_conv": long_, "_depth": long_, "_n": long_, "_children": long_, "_leaves": long_, "_saved": long_, "_up_hi": long_, "_up_lo": long_, "_stays": "boolean", "_ends_sha256": "string"}
    every = _with(facts, columns).unionByName(_with(sums, columns)).unionByName(_with(ends, columns))
    how: dict[str, Column] = {c: F.max(c) for c in columns if c not in node} | {c: F.sum(c) for c in ("_children", "_leaves", "_saved")}
    nodes = stored(every.groupBy(*node).agg(*[f.alias(c) for c, f in how.items()]), "nodes")
    # The parent's smallest member is the node's own one along a chain; only the tops of chains look it up.
    apart = (F.col("_depth") > 0) & ~F.col("_stays")
    names = nodes.select(F.col("_hi").alias("_up_hi"), F.col("_lo").alias("_up_lo"), F.col("_conv").alias("_parent"))
    tops = nodes.filter(apart).join(names, ["_up_hi", "_up_lo"], "left")
    rest = nodes.filter(~apart | F.col("_stays").isNull()).withColumn("_parent", F.when(F.col("_depth") > 0, F.col("_conv")))
    out = [F.col("_conv").alias("conv_id"), F.col("_depth").alias("depth"), F.col("_parent").alias("parent_conv_id"), F.col("_n").alias("n_convs"), F.col("_children").alias("n_children"),
           F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"), F.coalesce("_ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")]
    return rest.select(*out).unionByName(tops.select(*out))


def rooted(rows: DataFrame) -> DataFrame:
    """Conversations as they are, with the row that stands for each."""
    return rows.unionByName(rows.filter("_k = 0").withColumn("_k", F.lit(-1).cast("bigint")))


#: crc32 of the string ``{}`` in SQL.
CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
ORACLE = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as k, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
v as (select c, c - c % 100 as b, {CRC32.format("c::varchar")} % 6 as h from (select distinct c from t)),
r as (select v.c, t.k, t.role, t.text from v join t on t.c = v.b and t.k < v.h union all select v.c, t.k, t.role, t.text from v join t on t.c = v.c and t.k >= v.h),
p as (select c, 0 as d, '' as key, 0 as size from v union all
  select c, row_number() over w as d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over w as key, length(text) as size from r window w as (partition by c order by k)),
e as (select *, lead(d) over (partition by c order by d) is null as ends from p),
n as (select d, key, min(c) as c, count(*) as n, max(size) as size, count(*) filter (where ends) as stop, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256 from e group by d, key),
s as (select p.d, p.key, count(*) filter (where n.d = p.d + 1) as n_children, count(*) filter (where n.stop = n.n) as n_leaves, sum((n.n - 1) * n.size) as saved_tokens
  from n join p on p.c = n.c and p.d <= n.d group by p.d, p.key)
select n.c as conv_id, n.d as depth, u.c as parent_conv_id, n.n as n_convs, s.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from n join s using (d, key) left join p on p.c = n.c and p.d = n.d - 1 left join n u on u.d = p.d and u.key = p.key
"""
