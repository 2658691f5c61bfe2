"""Prefix trie of conversations: who shares how many first turns, and what storing these once would save.

A turn is known by 128 bits of its SHA-256. Conversations, as sequences of turns, are
dealt by ranges of (sequence, id), so that neighbours share a shard and copies of
one sequence may fill several. A shard numbers its turns by rank (its dictionary)
and puts its sequences, medians first, into a ternary search tree, whose nodes are
the trie's. A walk without recursion adds up members, leaves and savings from the
leaves upwards. Only nodes on the paths of a shard's first and last sequence can go
on in another shard: these boundary nodes are merged by their prefix, group by
first turn, and everything else is final where it is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.llm.common import CRC32_SQL, as_table, bounded_batches, join_small, named, read, release_memory

FIRST_TURNS, EVERY = 5, 100
SHARD_TURNS = 1 << 18
PIECE_BYTES = 1 << 20
NOBODY = hashlib.sha256(b"").digest()


def turn_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, keys array<binary>, points array<int>): turns of each conversation in order, a null turn first.

    turns: (conv_id, turn, role, text); null roles and texts are empty, ties go by the
    SHA-256 of length of role, role and text. Rows without conv_id belong to nobody and go. One conversation's
    keys, 20 bytes a turn, lie in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    one = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"), key.alias("key"), F.length(text).alias("points"))
    found = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    return found.select("conv_id", F.col("t.key").alias("keys"), F.col("t.points").alias("points"))


def with_shared_heads(sequences: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 100, h = crc32(c as text) % 6."""
    heads = sequences.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("keys", 1, FIRST_TURNS).alias("head"), F.slice("points", 1, FIRST_TURNS).alias("head_points"))
    own = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (FIRST_TURNS + 1)).cast("int"))
    joined = own.join(heads, "base", "left")
    both = lambda first, rest, kind: F.expr(f"concat(coalesce(slice({first}, 1, h), cast(array() as array<{kind}>)), slice({rest}, h + 1, size({rest})))").alias(rest)
    return joined.select("conv_id", both("head", "keys", "binary"), both("head_points", "points", "int"))


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1, each range's middle before its halves."""
    open_ = [(0, n)]
    while open_:
        low, high = open_.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            open_ += [(middle + 1, high), (low, middle)]


class Tree:
    """Ternary search tree; node 0 is the root of the trie and has no turn."""

    def __init__(self) -> None:
        self.turn, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]
        self.up, self.points = [-1], [0]  # parent in the trie; code points of the turn

    def _new(self, turn: int, points: int, up: int) -> int:
        for column, value in ((self.turn, turn), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.points, points)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], points: list[int]) -> int:
        """The node of the whole sequence, made where it isn't there."""
        top = 0
        for turn, size in zip(turns, points, strict=True):
            x = self.equal[top]
            if x < 0:
                x = self.equal[top] = self._new(turn, size, top)
            while self.turn[x] != turn:
                side = self.low if turn < self.turn[x] else self.high
                if side[x] < 0:
                    side[x] = self._new(turn, size, top)
                x = side[x]
            top = x
        return top

    def walk(self) -> list[int]:
        """All nodes, each after its parent in the trie."""
        order, open_ = [], [0]
        while open_:
            x = open_.pop()
            order.append(x)
            open_ += [y for y in (self.high[x], self.low[x], self.equal[x]) if y >= 0]
        return order


@dataclass
class Found:
    """Rows of one shard: final nodes, parts of boundary nodes, and pieces of boundary nodes' lists of ends."""

    nodes: list[tuple] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)
    pieces: list[tuple] = field(default_factory=list)


def pieces_of(ids: list[int]) -> Iterator[tuple[int, bytes]]:
    """Ascending ids as decimal text with commas, in pieces of about PIECE_BYTES with their first id."""
    step = PIECE_BYTES // 20
    for i in range(0, len(ids), step):
        yield ids[i], ",".join(map(str, ids[i : i + step])).encode()


def build(ids: list[int], sequences: list[list[bytes]], points: list[list[int]]) -> Found:
    """The trie of a shard, which is sorted by (sequence, id)."""
    rank = {key: i for i, key in enumerate(sorted({k for s in sequences for k in s}))}
    starts = [i for i in range(len(ids)) if not i or sequences[i] != sequences[i - 1]]
    tree, ends = Tree(), {}
    for j in medians_first(len(starts)):
        i = starts[j]
        node = tree.insert([rank[k] for k in sequences[i]], points[i])
        ends[node] = (i, starts[j + 1] if j + 1 < len(starts) else len(ids))

    # Prefixes of the first and the last sequence, by a digest of the turns so far; the root's is empty.
    known, first_turn = {0: b""}, {0: None}
    edge = {}
    for i in (0, len(ids) - 1):
        x, so_far = 0, hashlib.blake2b(digest_size=16)
        for d, key in enumerate(sequences[i]):
            so_far.update(key)
            y, turn = tree.equal[x], rank[key]
            while tree.turn[y] != turn:
                y = tree.low[y] if turn < tree.turn[y] else tree.high[y]
            known[y], first_turn[y] = so_far.digest(), key if not d else first_turn[x]
            x = y
    n = len(tree.turn)
    members, children, leaves, saved, depth, least = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [None] * n
    order = tree.walk()
    for x in order[1:]:
        depth[x] = depth[tree.up[x]] + 1
    for x, (a, b) in ends.items():
        members[x], least[x] = b - a, min(ids[a:b])
    for x in reversed(order):
        own = children[x], leaves[x], saved[x]  # of the final children alone, where x is at the edge
        if x in known:
            edge[x] = own
        else:
            leaves[x] += not children[x]
            saved[x] += (members[x] - 1) * tree.points[x]
        up = tree.up[x]
        if up >= 0:
            members[up] += members[x]
            least[up] = least[x] if least[up] is None else min(least[up], least[x])
            if x not in known:
                children[up] += 1
                leaves[up] += leaves[x]
                saved[up] += saved[x]

    found = Found()
    for x in order:
        span = ends.get(x)
        up = tree.up[x]
        if x in known:
            found.parts.append((known[x], known[up] if up >= 0 else None, first_turn[x], depth[x], tree.points[x], least[x], members[x], *edge[x]))
            if span:
                found.pieces += [(known[x], first, text) for first, text in pieces_of(ids[span[0] : span[1]])]
        else:
            digest = hashlib.sha256(",".join(map(str, ids[span[0] : span[1]])).encode()).digest() if span else NOBODY
            at_edge = up in known
            found.nodes.append((least[x], depth[x], None if at_edge else least[up], members[x], children[x], leaves[x], saved[x], digest, known[up] if at_edge else None))
    return found


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, parent_key binary"
PART = "key binary, parent_key binary, top binary, depth long, points long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
PIECE = "key binary, first long, ids binary"
SHARD = f"node struct<{NODE.replace(' ', ':').replace(',:', ',')}>, part struct<{PART.replace(' ', ':').replace(',:', ',')}>, piece struct<{PIECE.replace(' ', ':').replace(',:', ',')}>"
ROWS = 20_000


def _arrow(kind: str) -> pa.DataType:
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.struct([(f.split()[0], types[f.split()[1]]) for f in kind.split(", ")])


def _batches(found: Found) -> Iterator[pa.RecordBatch]:
    kinds = (("node", NODE, found.nodes), ("part", PART, found.parts), ("piece", PIECE, found.pieces))
    for name, kind, rows in kinds:
        step = ROWS if name != "piece" else 16
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            columns = []
            for other, of, _ in kinds:
                t = _arrow(of)
                values = [dict(zip([f.name for f in t], r, strict=True)) for r in some] if other == name else [None] * len(some)
                columns.append(pa.array(values, t))
            yield pa.RecordBatch.from_arrays(columns, names=[k[0] for k in kinds])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sequences, points = [], [], []
    for batch in batches:
        for into, column in ((ids, "conv_id"), (sequences, "keys"), (points, "points")):
            into += batch.column(batch.schema.get_field_index(column)).to_pylist()
    if ids:
        yield from _batches(build(ids, sequences, points))
    release_memory()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; one piece is held at a time."""
    now, so_far = None, None
    for batch in batches:
        done: list[tuple[bytes, bytes]] = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if so_far is not None and key == now:
                so_far.update(b"," + ids)
                continue
            if so_far is not None:
                done.append((now, so_far.digest()))
            now, so_far = key, hashlib.sha256(ids)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.binary())], names=["key", "ends"])
    if so_far is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([so_far.digest()], pa.binary())], names=["key", "ends"])


def _sum_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """Merged boundary nodes below one first turn: what their boundary children add, deepest first."""
    rows = rows.sort_values("depth", ascending=False, kind="stable").reset_index(drop=True)
    at = {bytes(k): i for i, k in enumerate(rows["key"])}
    children, leaves, saved = (rows[c].tolist() for c in ("n_children", "n_leaves", "saved_tokens"))
    for i, (up, n, size) in enumerate(zip(rows["parent_key"], rows["n_convs"].tolist(), rows["points"].tolist(), strict=True)):
        leaves[i] += not children[i]
        saved[i] += (n - 1) * size
        j = at.get(bytes(up))
        if j is not None:
            children[j] += 1
            leaves[j] += leaves[i]
            saved[j] += saved[i]
    return rows.assign(n_children=children, n_leaves=leaves, saved_tokens=saved).drop(columns=["top", "points"])


EDGE = "key binary, parent_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of (conv_id, keys, points): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    shards: some SHARD_TURNS turns each if None. Boundary nodes are 2 * (depth + 1) a shard
    at most, and those below one first turn lie in a task. A node's list of ends is
    hashed in the order of its ids, as SHA-256 must be, a piece at a time. Rows of one
    id are members each; without rows there is no node.
    """
    sequences = as_table(sequences, "trie-sequences")
    shards = shards or 1 + (sequences.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0]) // SHARD_TURNS
    dealt = bounded_batches(sequences).repartitionByRange(shards, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    found = as_table(dealt.mapInArrow(_shards, SHARD), "trie-shards")
    nodes, parts, pieces = (found.where(f"{kind} is not null").select(f"{kind}.*") for kind in ("node", "part", "piece"))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("depth > 0").groupBy("key", "parent_key", "top", "depth", "points").agg(F.min("conv_id").alias("conv_id"), *sums)
    edges = merged.groupBy("top").applyInPandas(lambda rows: _sum_edges(rows)[EDGE_NAMES], EDGE)
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digests, "key binary, ends binary")
    edges = as_table(edges.join(ends.where("length(key) > 0"), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NOBODY))), "trie-edges")

    # The root, from its children; turnless conversations are members of the root alone.
    below = nodes.where("depth = 1").select("n_leaves", "saved_tokens").unionByName(edges.where("depth = 1").select("n_leaves", "saved_tokens"))
    below = below.agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    top = parts.where("depth = 0").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")).where("conv_id is not null")
    turnless = ends.where("length(key) = 0").agg(F.coalesce(F.max("ends"), F.lit(NOBODY)).alias("ends"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731 - each has one row at most
    root = one(top).join(one(below), "_one").join(one(turnless), "_one").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")

    heads = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")).unionByName(top.select(F.lit(b"").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    open_ = nodes.where("parent_key is not null").drop("parent_conv_id").unionByName(edges.drop("key"))
    joined = join_small(open_, heads, ["parent_key"])
    every = nodes.where("parent_key is null").select(*COLUMNS, "ends").unionByName(joined.select(*COLUMNS, "ends")).unionByName(root)
    return every.select(*COLUMNS, F.lower(F.hex("ends")).alias("ends_sha256"))


EDGE_NAMES = [f.split()[0] for f in EDGE.split(", ")]


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with its hundred's first turns."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(with_shared_heads(turn_sequences(turns)))


OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, ({CRC32_SQL.format('conv_id::VARCHAR')} % 6)::INT AS h FROM own),
re AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
pre AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM re),
nodes AS (
  SELECT sha256(array_to_string(list_transform(l[1:d], lambda x: x.k), ',')) AS p, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(l[1:d - 1], lambda x: x.k), ',')) END AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(l) = d), '')) AS ends_sha256, any_value(l) AS l, any_value(CASE WHEN d > 0 THEN l[d].n ELSE 0 END) AS points FROM pre GROUP BY 1, 2, 3),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
sized AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM nodes x LEFT JOIN kids ON kids.up = x.p),
above AS (SELECT sha256(array_to_string(list_transform(l[1:a], lambda x: x.k), ',')) AS p, (n_children = 0)::INT AS leaf, (n_convs - 1) * points AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM sized)),
sums AS (SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY p)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM sized x JOIN sums USING (p) LEFT JOIN nodes y ON y.p = x.up
"""
