"""MinHash near-dedup with an LSH forest.

Every distinct shingle set gets POOL min-hashes. A tree is a sorted order of the sets
by DEPTH of them, each tree's own choice in its own sequence; neighbours in it with a
common prefix of at least LEAST levels are candidates, within WINDOW places. Sets for
which a window was too small in any tree (crowded ones, in dense regions) are also met
by an exact prefix-filter join of their shingles across the components known by then,
so no group is ever expanded into all its pairs. Links are confirmed on full shingle
sets; groups are connected components of confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.llm.common import as_table, bounded_batches, map_texts, named, packed, read, release_memory
from lrforge.llm.graph import components_by_tasks
from lrforge.llm.shingles import common, mix, shingle_set

POOL, TREES, DEPTH, LEAST, WINDOW = 160, 40, 12, 2, 8
DEEP, OFTEN = 6, 3  # a pair in a window counts if it is close at this depth, or in so many trees
BITS = (15,) * 4 + (7,) * 8  # of the levels of a key; a key is two longs, of four levels and of eight
SPLIT = 4
WORD_BITS, WORDS = 16, 4  # min-hashes in one long of a signature
LIKELY = 0.5  # pairs whose signatures agree less aren't confirmed; the standard error there is 0.04
SPANNING_ROUNDS, FEW_OPEN = 3, 8
SPANNING_TREES = 6  # trees whose direct neighbours the spanning rounds try; all trees are searched after them
FILTER_BITS = 1 << 26  # of the bitmap by which texts are filtered before they are shuffled; 8 MB at any input size
PERCENT = 75
SLOT_BITS, SLOT_PARTS = 20, 64  # slots by which shingles are counted when crowded sets are ordered, at any input size, and their parts; results don't depend on them
BLOCK = 1 << 22  # pairs of one shingle's sets that are looked at together
MOST_ENDS = 200_000  # rows at partitions' ends that one task matches

_random = np.random.default_rng(8)
_A = (_random.integers(0, 2**31, POOL, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _random.integers(0, 2**32, POOL, np.uint32)
_CHOICE = np.stack([_random.permutation(POOL)[:DEPTH] for _ in range(TREES)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """POOL min-hashes of WORD_BITS bits, WORDS of them in a long."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(POOL, 2**32 - 1, np.uint32)
    for start in range(0, len(x), 1024):
        least = np.minimum(least, ((x[start : start + 1024, None] ^ _B) * _A).min(axis=0))
    # Minima are small numbers: they are mixed before the leading bits are taken.
    words = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)).reshape(-1, WORDS)
    return (words << (np.uint64(WORD_BITS) * np.arange(WORDS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).astype(np.int64)


def keys(signatures: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets x trees) keys: the leading bits of a tree's min-hashes, first level highest."""
    words = np.stack([signatures.astype(np.uint64) >> np.uint64(WORD_BITS * i) & np.uint64(0xFFFF) for i in range(WORDS)], axis=2).reshape(len(signatures), POOL)
    out = []
    for levels in (range(SPLIT), range(SPLIT, DEPTH)):
        key = np.zeros((len(signatures), trees), np.uint64)
        for level in levels:
            key = key << np.uint64(BITS[level]) | words[:, _CHOICE[:trees, level]] >> np.uint64(WORD_BITS - BITS[level])
        out.append(key.astype(np.int64))
    return out[0], out[1]


SKETCH = [T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))]


def _sketch(texts: list[str | None]) -> list[pa.Array]:
    """Set size, two order-free digests of the set and its signature; digests and signature null for empty sets."""
    sizes, d1, d2, sigs = [], [], [], []
    for text in texts:
        s = shingle_set(text)
        sizes.append(len(s))
        d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
        d2.append(int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
        sigs.append(signature(s) if len(s) else None)
    return [pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]


def prefix_levels(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Common levels of two keys, given the exclusive ors of their longs."""
    count = lambda x, n, bits: sum(((x >> bits * (n - i)) == 0).astype(np.int64) for i in range(1, n + 1))
    return count(x1, SPLIT, BITS[0]) + np.where(x1 == 0, count(x2, DEPTH - SPLIT, BITS[-1]), 0)


def _neighbours(window: int, ends: bool):
    """Candidates among sorted rows (tree, k1, k2, id, comp); with ends, also the rows near a partition's ends.

    A window wider than 1 also gives its crowded rows, as pairs of an id with itself:
    LEAST levels are common with the row `window` places on, so others may lie beyond.
    """

    def pairs(rows: pd.DataFrame, fresh: int) -> pd.DataFrame:
        """Pairs whose later row is at or after `fresh`."""
        tree, k1, k2, ids, comp = (rows[c].to_numpy() for c in ("tree", "k1", "k2", "id", "comp"))
        found = []
        crowded = np.zeros(len(rows), bool)
        if 1 < window < len(rows):
            at = np.arange(window, len(rows))
            at = at[(tree[at] == tree[at - window]) & (prefix_levels(k1[at] ^ k1[at - window], k2[at] ^ k2[at - window]) >= LEAST)]
            crowded[at] = crowded[at - window] = True
            at = at[at >= fresh]
            marked = np.unique(ids[np.concatenate([at, at - window])])
            found.append(np.stack([marked, marked, np.zeros(len(marked), np.int64)]))
        for o in range(1, min(window, len(rows) - 1) + 1):
            at = np.arange(max(fresh, o), len(rows))
            before = at - o
            near = (tree[at] == tree[before]) & (comp[at] != comp[before])
            if o > 1:
                near &= ~(crowded[at] & crowded[before])  # the exact join meets these
            at, before = at[near], before[near]
            levels = prefix_levels(k1[at] ^ k1[before], k2[at] ^ k2[before])
            near = levels >= LEAST
            at, before = at[near], before[near]
            found.append(np.stack([np.minimum(ids[at], ids[before]), np.maximum(ids[at], ids[before]), levels[near]]))
        a, b, levels = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"a": a, "b": b, "levels": levels})

    empty = {"tree": -1, "k1": 0, "k2": 0, "id": 0, "comp": 0}

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, heads, n_heads = None, [], 0
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            yield pairs(rows, len(rows) - len(batch)).assign(**empty)
            if ends and n_heads < window:
                heads.append(batch.head(window - n_heads))
                n_heads += len(heads[-1])
            held = rows.tail(window).reset_index(drop=True)
        if ends and held is not None:
            yield pd.concat([*heads, held]).drop_duplicates().assign(a=0, b=0, levels=0)[["a", "b", "levels", *empty]]

    return go


FOUND = "a long, b long, levels long, tree int, k1 long, k2 long, id long, comp long"


def _planted(trees: int):
    """A row a tree and set."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if len(ids):
                sigs = batch.column(2).values.slice(batch.column(2).offset * POOL // WORDS).to_numpy(zero_copy_only=False)[: len(ids) * POOL // WORDS].reshape(len(ids), POOL // WORDS)
                k1, k2 = keys(sigs, trees)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(k1[:, t]), pa.array(k2[:, t]), pa.array(ids), pa.array(comps)], names=["tree", "k1", "k2", "id", "comp"])

    return go


def candidates(sets: DataFrame, window: int, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of neighbours, from rows (id, sig, comp), and the distinct ids of crowded sets (none if window is 1).

    Pairs of one comp are left out; of two crowded sets direct neighbours alone are given.

    With window 1 a pair counts in any tree. In a wider window a pair, direct neighbours
    too, counts if it is close OFTEN, or once with DEEP common levels: what a dense region of
    dissimilar sets brings together by chance is close in few trees, at a small depth.
    Each tree is range-sorted as a whole, so a region of near copies may span many
    partitions; rows at their ends, 2 * window a partition, are matched in the same way,
    in partitions again while they are more than MOST_ENDS. Rows between which others were
    left out may meet there too: they are candidates like any, and what they have in common
    all rows between them have.
    """
    order = ["tree", "k1", "k2", "id"]
    rows = sets.select("id", "comp", "sig").mapInArrow(_planted(trees), "tree int, k1 long, k2 long, id long, comp long")
    met, parts = None, []
    while True:
        ordered = bounded_batches(rows.repartitionByRange(*parts, *order).sortWithinPartitions(*order))
        found = as_table(ordered.mapInPandas(_neighbours(window, True), FOUND), "forest-pairs")
        inside = found.where("tree < 0").select("a", "b", "levels")
        met = inside if met is None else met.union(inside)
        rows = found.where("tree >= 0").select(*order, "comp")
        if (n := rows.count()) <= MOST_ENDS:
            break
        parts = [n // (MOST_ENDS // 20)]
    ends = rows.coalesce(1).sortWithinPartitions(*order)
    met = met.union(ends.mapInPandas(_neighbours(window, False), FOUND).select("a", "b", "levels"))
    pairs, crowded = met.where("a <> b"), met.where("a = b").select(F.col("a").alias("id")).distinct()
    if window == 1:
        return pairs.select("a", "b").distinct(), crowded
    return pairs.groupBy("a", "b").agg(F.count("*").alias("trees"), F.max("levels").alias("levels")).where((F.col("trees") >= OFTEN) | (F.col("levels") >= DEEP)).select("a", "b"), crowded


def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles.astype(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each slot."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            np.add.at(total, slot_of(shingle_set(text)), 1)
    for part, counts in enumerate(total.reshape(SLOT_PARTS, -1)):
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(counts)], pa.binary())], names=["part", "counts"])
    release_memory()


def _packed(counts: np.ndarray) -> bytes:
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32).tobytes()


def _added_up(rows: pd.DataFrame) -> pd.DataFrame:
    """All tasks' counts of one part of the slots; beyond 31 bits they count as that."""
    total = np.zeros((1 << SLOT_BITS) // SLOT_PARTS, np.int64)
    for counts in rows["counts"]:
        total += np.frombuffer(counts, np.int32)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [_packed(total)]})


def _prefixes(shared):
    """A row for each shingle of a set's prefix: of so many of its rarest that two linked sets have one in common."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for i, comp, text in zip(*(batch.column(c).to_pylist() for c in ("id", "comp", "text")), strict=True):
                s = shingle_set(text).astype(np.int64)
                n = len(s)
                if n:
                    s = s[np.lexsort((s, counts[slot_of(s)]))][: n - -(-PERCENT * n // 100) + 1]
                    same = lambda x: pa.array(np.full(len(s), x, np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(s), same(i), same(comp), same(n), pa.array(np.arange(len(s)))], names=["s", "id", "comp", "n", "pos"])
        release_memory()

    return go


def _meet(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of different comps among sets that share a shingle, sorted by size, which sizes and the shingle's places allow to be linked."""
    end = np.searchsorted(n, n * 100 // PERCENT, "right")
    step = max(1, BLOCK // len(ids))
    for start in range(0, len(ids), step):
        stop = min(start + step, len(ids))
        last = end[stop - 1]
        i, j = np.arange(start, stop)[:, None], np.arange(start, last)[None, :]
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])  # of the intersection, if no earlier shingle is common
        i, j = np.nonzero((j > i) & (j < end[i]) & (comp[i] != comp[j]) & ((100 + PERCENT) * most >= PERCENT * (n[i] + n[j])))
        i, j = ids[i + start], ids[j + start]
        yield np.stack([np.minimum(i, j), np.maximum(i, j)])


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates from rows (s, id, comp, n, pos) sorted by s and n. A shingle's rows may span batches."""

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s, ids, comp, n, pos = (rows[c].to_numpy() for c in ("s", "id", "comp", "n", "pos"))
        starts = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
        ends = np.concatenate([starts[1:], [len(s)]])
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        found, size = [], 0
        for x, y in zip(starts[mixed], ends[mixed], strict=True):
            for block in _meet(ids[x:y], comp[x:y], n[x:y], pos[x:y]):
                found.append(block)
                size += block.shape[1]
                if size >= BLOCK:
                    yield pd.DataFrame(np.unique(np.concatenate(found, axis=1), axis=1).T, columns=["a", "b"])
                    found, size = [], 0
        if size:
            yield pd.DataFrame(np.unique(np.concatenate(found, axis=1), axis=1).T, columns=["a", "b"])

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        s = batch["s"].to_numpy()
        first = int(np.searchsorted(s, s[-1]))  # the last shingle's rows wait for the next batch
        if first or held and held[-1]["s"].iloc[-1] != s[-1]:
            yield from pairs(pd.concat([*held, batch.iloc[:first]]))
            held = []
        held.append(batch.iloc[first:])
    if held:
        yield from pairs(pd.concat(held))
    release_memory()


def prefixes(region: DataFrame) -> DataFrame:
    """(s, id, comp, n, pos): the prefix of each set of rows (id, comp, text), its rarest shingles by count.

    Shingles are counted by slot of their hash, in 2^SLOT_BITS slots, a table of 4 MB that is broadcast: a
    shingle counts for what it shares its slot with, too, which is the same for all sets, so
    any two sets order their shingles alike, and what many sets have in common comes last.
    """
    spark = region.sparkSession
    parts = bounded_batches(region.select("text")).mapInArrow(_slot_counts, "part int, counts binary").groupBy("part").applyInPandas(_added_up, "part int, counts binary")
    counts = np.zeros((SLOT_PARTS, (1 << SLOT_BITS) // SLOT_PARTS), np.int32)
    for row in parts.toLocalIterator():
        counts[row["part"]] = np.frombuffer(row["counts"], np.int32)
    counts = counts.ravel()
    return bounded_batches(region.select("id", "comp", "text")).mapInArrow(_prefixes(spark.sparkContext.broadcast(counts)), "s long, id long, comp long, n long, pos long")


def exact_candidates(region: DataFrame) -> DataFrame:
    """All pairs (a < b) of different comps that can be linked, from rows (id, comp, text), by a prefix filter on shingles.

    Any one order of shingles gives all links; from rare to common, what a region has in
    common stays out of the prefixes, so that sets which only share a passage don't meet on it.
    """
    return prefixes(region).repartition("s").sortWithinPartitions("s", "n").mapInPandas(_meetings, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) for which 100 * intersection >= PERCENT * union of the full shingle sets; texts: (id, text)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (a, ta, tb) in enumerate(zip(batch["a"], batch["ta"], batch["tb"], strict=True)):
                if a != last:
                    last, held = a, shingle_set(ta)
                other = shingle_set(tb)
                both = common(held, other)
                good[i] = 100 * both >= PERCENT * (len(held) + len(other) - both)
            yield batch.loc[good, ["a", "b"]]
        release_memory()

    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return bounded_batches(joined.select("a", "b", "ta", "tb")).mapInPandas(go, "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, text) whose id is in ids, distinct: a bitmap of hashed ids, broadcast, drops most of the others
    where they are read; the exact semi-join sees what passes. With more ids than bits the join does it all."""
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(spot.alias("s")).groupBy(F.expr("s div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("s % 32768")).alias("bits"))
    marked = docs.where("id is not null").withColumn("s", spot).join(F.broadcast(words), F.expr("s div 32768") == F.col("part"))
    bit = "shiftright(cast(conv(hex(substring(bits, cast((s % 32768) div 8 as int) + 1, 1)), 16, 10) as int), cast(s % 8 as int)) & 1"
    return marked.where(F.expr(f"({bit}) = 1")).select("id", "text").join(ids, "id", "left_semi")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with these as ca and cb; a node that comps lacks is its own."""
    met = pairs.join(comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return met.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _agree(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in LIKELY of their min-hashes or more."""
    mask = (1 << WORD_BITS) - 1
    sig = lambda c, s: sets.select(F.col("id").alias(c), F.col("sig").alias(s))
    same = " + ".join(f"int((shiftrightunsigned(x ^ y, {WORD_BITS * i}) & {mask}L) = 0)" for i in range(WORDS))
    agree = F.expr(f"aggregate(zip_with(sa, sb, (x, y) -> {same}), 0, (s, e) -> s + e)")
    return pairs.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").where(agree >= int(LIKELY * POOL)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_shingles, component_id, kept (id = component_id) for every row.

    Sets: distinct shingles of five words, A-Z lower-cased; of fewer words their
    whole sequence; null, empty and blank texts have none, and each is its own
    component. Equal sets are one node from the start, whatever their number.
    Links need 100 * intersection >= 75 * union on full sets. component_id is the
    smallest id that links reach. Ids are whole numbers of up to 64 bits; other types
    are an error. Rows of one id belong together; a row with a null id is linked with
    nothing and kept, component_id null. Other columns are not looked at, whatever
    their names; an empty table gives no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    plain = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    sketches = as_table(map_texts(plain, "text", _sketch, SKETCH), "sketches")
    known = sketches.where("id is not null and n > 0")
    # One row a distinct set: its smallest id and its signature, which equal sets share.
    reps = as_table(known.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "sets")
    sets = reps.select(F.col("rep").alias("id"), "sig", F.col("rep").alias("comp"))

    strong = as_table(candidates(sets, 1, SPANNING_TREES)[0], "strong-pairs")
    n_strong = strong.count()
    ids = as_table(strong.select(F.col("a").alias("id")).union(strong.select("b")).distinct(), "candidate-ids")
    texts = as_table(texts_of(plain, ids), "candidate-texts")

    # Spanning rounds: each component tries the link to its smallest neighbour, so that
    # a large group is joined by about as many confirmations as it has members. Pairs that
    # are open after them, or when few are, wait for the last round.
    open_pairs = strong.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    tried = links = comps = None
    for _ in range(SPANNING_ROUNDS):
        both = open_pairs.select(F.col("ca").alias("at"), F.col("cb").alias("to"), "a", "b").union(open_pairs.select("cb", "ca", "a", "b"))
        chosen = as_table(both.groupBy("at").agg(F.min(F.struct("to", "a", "b")).alias("m")).select("m.a", "m.b").distinct(), "chosen-pairs")
        if chosen.isEmpty() and comps is not None:
            break
        good = as_table(confirm(chosen, texts), "links")
        tried, links = (chosen, good) if tried is None else (tried.union(chosen), links.union(good))
        comps = components_by_tasks(links)
        open_pairs = as_table(_across(open_pairs.select("a", "b"), comps).join(chosen, ["a", "b"], "left_anti"), "open-pairs")
        if open_pairs.count() * FEW_OPEN <= n_strong:
            break

    labelled = sets.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "sig", F.coalesce("component", "id").alias("comp"))
    labelled = as_table(labelled, "labelled-sets")
    rest, crowded = candidates(labelled, WINDOW)
    crowded = as_table(crowded, "crowded-ids")
    # Pairs which the spanning rounds left open are tried here, whether or not a window gives them again.
    rest = as_table(_agree(rest.union(open_pairs.select("a", "b")).join(tried, ["a", "b"], "left_anti"), sets), "last-pairs")
    more = as_table(rest.select(F.col("a").alias("id")).union(rest.select("b")).union(crowded).distinct().join(ids, "id", "left_anti"), "more-ids")
    texts = texts.union(as_table(texts_of(plain, more), "more-texts"))
    if not rest.isEmpty():
        links = links.union(as_table(confirm(rest, texts), "links"))
        comps = components_by_tasks(links)
    if not crowded.isEmpty():
        # Last, when components are nearly whole, as only pairs across them are looked at.
        region = texts.join(crowded, "id", "left_semi").join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
        region = as_table(region.select("id", F.coalesce("component", "id").alias("comp"), "text"), "crowded-texts")
        exact = as_table(exact_candidates(region), "exact-pairs")  # the prefix filter and full sets decide, no signature
        comps = components_by_tasks(links.union(confirm(exact, texts)))

    labels = reps.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    joined = sketches.select("id", "n", "d1", "d2").join(labels, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their group, columns unchanged, whatever their names.

    Rows of one id stay or go together; a null id stays; texts without a word are
    nobody's copy. An empty table stays empty.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(named(id_col).alias("_gone")).distinct()
    rows = docs.select(packed(docs), named(id_col).cast("long").alias("_doc"))
    return rows.join(as_table(gone, "near-copies"), F.col("_doc") == F.col("_gone"), "left_anti").select("row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every pair of documents that share a shingle is counted: for small tables.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT w.doc_id, count(shingle)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
both_sets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n_shingles, component_id, component_id = doc_id AS kept
FROM (SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON a = n.doc_id GROUP BY n.doc_id, n.n)
"""
