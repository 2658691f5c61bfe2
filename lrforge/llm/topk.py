"""Exact top-k inner products over integer vectors, with block-at-a-time pruning.

Vectors are range-sorted by id into shards; a shard is a forward index of blocks,
each with the largest and smallest value of every term. A chunk of queries orders
a shard's blocks by the sum of term maxima (query value times the block's largest
or smallest), scores them block by block, and stops where the bound falls below
the query's k-th score. A task takes a chunk of queries through a group of shards,
one after the other, and carries the k-th scores on, so that it returns k rows a
query, whatever the number of shards; a window merges the few groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.llm.common import as_table, bounded_batches, named, read

SHARD_ROWS, BLOCK_ROWS = 8192, 256
CHUNK_ROWS, LEAST_CHUNK, GROUPS = 8192, 64, 4  # queries of a chunk, at most and at least; groups of shards that a chunk meets, at most, where chunks are few
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others
PACKED = "part long, n int, dims int, bytes int, ids binary, values binary"


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale)))


def _pack(part: int, ids: pa.Array, vectors: pa.Array) -> pa.RecordBatch:
    """Ids and vectors as bytes; values as integers of the fewest bytes that hold them all, shorter vectors filled with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    values = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    values[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(flat) or -(1 << 8 * w - 1) <= flat.min() and flat.max() < 1 << 8 * w - 1)
    numbers = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
    row = {"part": part, "n": len(ids), "dims": values.shape[1], "bytes": width, "ids": numbers.tobytes(), "values": values.astype(f"i{width}").tobytes()}
    return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("bytes", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())]))


def _unpacked(ids: bytes, values: bytes, n: int, dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, f"i{width}").reshape(n, dims).astype(np.int64)


def _packer(rows_each: int, keyed: bool = False):
    """Packs a partition's rows (id, v, key), in their order: rows_each at a time, or all of a key together.

    A part's number is its key, or else the partition's number in the upper half of a long and a count in the lower.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, at, key = 0, TaskContext.get().partitionId() << 32, None

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, v = (table.column(c).combine_chunks() for c in ("id", "v"))
            return _pack(at if key is None else key, ids, v)

        for batch in batches:
            if not batch.num_rows:
                continue
            if keyed:
                keys = batch.column(2).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), batch.num_rows]
            else:
                cuts = [0, *range(rows_each - count % rows_each, batch.num_rows, rows_each), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and (keyed and key != int(keys[a]) or not keyed and count >= rows_each):
                    yield out()
                    held, count, at = [], 0, at + 1
                key = int(keys[a]) if keyed else None
                held.append(batch.slice(a, b - a))
                count += b - a
        if held:
            yield out()

    return pack


def _dots(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products; a sum beyond 64 bits is held at their limit."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0)) * q.shape[1]
    if largest < 2**24:
        return (q.astype(np.float32) @ d.T.astype(np.float32)).astype(np.int64)
    if largest < 2**53:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    if largest < 2**63:
        return q @ d.T
    limit = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ d.T.astype(object), limit.min + 2, limit.max).astype(np.int64)


LOWEST = np.iinfo(np.int64).min + 1  # its negative is in range


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
    """Brings each query's k best (score, found), best first, up to date with one shard; rows with its own id are left out."""
    dims, k = min(queries.shape[1], values.shape[1]), score.shape[1]  # what one side lacks counts as 0
    queries, values = queries[:, :dims], values[:, :dims]
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    high, low = np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)
    bound = _dots(np.maximum(queries, 0), high) + _dots(np.minimum(queries, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(queries))
    for rank in range(len(starts)):
        block = order[live, rank]
        go = bound[live, block] >= score[live, -1]
        live, block = live[go], block[go]
        if not len(live):
            break
        for b in np.unique(block):
            own = live[block == b]
            at = slice(starts[b], starts[b] + BLOCK_ROWS)
            got = _dots(queries[own], values[at])
            got[query_ids[own][:, None] == ids[at][None, :]] = LOWEST
            better = (got >= score[own, -1:]).any(axis=1)
            own, got = own[better], got[better]
            if len(own):
                all_scores = np.hstack([score[own], got])
                all_ids = np.hstack([found[own], np.broadcast_to(ids[at], got.shape)])
                best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                score[own], found[own] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)


def _search(k: int):
    """From rows of a chunk of queries and a shard, all of a (chunk, group) together: its queries' k best of the group."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, qids, queries, score, found = None, None, None, None, None

        def out() -> pa.RecordBatch:
            i, j = np.nonzero(score > LOWEST)
            return pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(found[i, j]), pa.array(score[i, j])], names=["query_id", "id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names) if name in ("chunk", "grp")}
                if (row["chunk"], row["grp"]) != at:
                    if at is not None:
                        yield out()
                    at = (row["chunk"], row["grp"])
                    q = {name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names) if name.startswith("q")}
                    qids, queries = _unpacked(q["qids"], q["qvalues"], q["qn"], q["qdims"], q["qbytes"])
                    score, found = np.full((len(qids), k), LOWEST, np.int64), np.full((len(qids), k), NO_ID, np.int64)
                s = {name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names) if not name.startswith("q")}
                search_shard(qids, queries, *_unpacked(s["ids"], s["values"], s["n"], s["dims"], s["bytes"]), score, found)
        if at is not None:
            yield out()

    return go


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Returns query_id, rank (from 1), id_col, score: the k rows with the highest inner products, ties to the smaller id.

    Vectors become floor(scale * component). Null vectors and those with null or
    non-finite components take no part; a shorter vector counts as filled with
    zeros. Rows with the query's own id are no candidates for it; repeated ids are
    separate candidates, and repeated equal queries are answered once (queries of one
    id with different vectors share one ranking, of the best of their scores). A row
    without id is a candidate after all others of its score, null in the result, never
    a query. Fewer candidates than k give fewer rows, an empty table none; other
    columns are not looked at, whatever their names.

    Each chunk of queries meets all shards, in at most GROUPS groups where there are
    fewer chunks than tasks can run at once: the result of the scoring step is at most
    k * GROUPS rows a query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(named(id_col).cast("long").alias("id"), quantized(named(vector_col), scale).alias("v"), is_query.alias("asks")).where("v is not null")
    rows = bounded_batches(as_table(rows, "topk-rows"))
    n, asking = rows.agg(F.count("*"), F.count_if(F.expr("asks and id is not null"))).first()
    if not asking:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = max(-(-asking // CHUNK_ROWS), min(-(-tasks // GROUPS), -(-asking // LEAST_CHUNK)))
    n_shards = -(-n // SHARD_ROWS)
    groups = max(1, min(-(-tasks // chunks), n_shards, GROUPS))
    every = lambda m, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(name)

    shards = rows.select("id", "v").repartitionByRange(n_shards, "id", F.hash("v")).sortWithinPartitions("id").mapInArrow(_packer(SHARD_ROWS), PACKED)
    shards = as_table(shards, "topk-shards").withColumn("grp", F.pmod(F.xxhash64("part"), F.lit(groups)))
    asked = rows.where("asks and id is not null").select("id", "v").distinct().withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)))
    asked = asked.repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(_packer(CHUNK_ROWS, True), PACKED)
    asked = as_table(asked, "topk-queries").select(F.col("part").alias("chunk"), every(groups, "grp"), *[F.col(c).alias(f"q{c}") for c in ("n", "dims", "bytes", "ids", "values")])

    # Blocks of a stated query set against blocks of all rows. Merged, so that a (chunk, group) lies together.
    met = shards.select("*", every(chunks, "chunk")).join(asked.hint("merge"), ["chunk", "grp"])
    met = met.select("chunk", "grp", "n", "dims", "bytes", "ids", "values", "qn", "qdims", "qbytes", "qids", "qvalues").sortWithinPartitions("chunk", "grp")
    scored = met.mapInArrow(_search(k), "query_id long, id long, score long")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("id") != int(NO_ID), F.col("id")).alias(id_col), "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
