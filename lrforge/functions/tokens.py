"""Tokens of texts by byte-pair merging in the order of ranks, over a dictionary of distinct pieces.

Texts are cut into pieces (words with the space before them, numbers, signs, white space)
by Spark; each different piece is encoded once, and its number of tokens joined back. So
the merging costs what the vocabulary of a corpus costs, not its length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how texts are cut before merging, as the public vocabularies of 50,000 ranks were fitted;
# (?U) gives classes such as \s their Unicode meaning in Java.
PIECES = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks from a file with a token in base64 and its rank a line; a vocabulary, so some 10^5 lines."""
    rows = spark.read.text(path).where("value <> ''").collect()
    return {base64.b64decode(token): int(rank) for token, rank in (r["value"].split() for r in rows)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a piece's tokens: of all neighbours whose union has a rank, those of the least are joined, the leftmost first, until none is left.

    A queue holds the unions that are possible; time grows with n log n of the piece's length.
    """
    if not piece:
        return []
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n))  # beginning of the part to the left; one more for the end
    open_ = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(open_)
    while open_:
        _, i, middle, stop = heapq.heappop(open_)
        if end[i] != middle or middle >= n or end[middle] != stop or before[middle] != i:
            continue  # one of the two has been joined otherwise
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(open_, (rank, i, stop, end[stop]))
        if before[i] >= 0 and (rank := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(open_, (rank, before[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def encoded_pieces(distinct: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(piece, ids) of a column of distinct pieces. Ranks are broadcast: they are a vocabulary, some megabytes."""
    known = distinct.sparkSession.sparkContext.broadcast(ranks)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [merged(p.encode("utf-8", "surrogatepass"), known.value) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])

    return distinct.select("piece").mapInArrow(go, T.StructType([T.StructField("piece", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(df: DataFrame, key: list[str], text: str, ranks: dict[bytes, int]) -> DataFrame:
    """(key, tokens long): tokens of the texts of each key, 0 for null and empty texts; texts of one key are counted together, each by itself.

    A row's pieces are counted before they are joined, so that a piece of every row, such
    as " the", is a row a text; where one piece makes a join partition too large, adaptive execution splits it.
    """
    rows = df.select(*key, F.explode(pieces(F.col(text))).alias("piece")).groupBy(*key, "piece").agg(F.count("*").alias("n"))
    known = encoded_pieces(rows.select("piece").distinct(), ranks).select("piece", F.size("ids").alias("size"))
    counted = rows.join(known, "piece").groupBy(*key).agg(F.sum(F.col("n") * F.col("size")).alias("tokens"))
    every = df.select(*key).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return every.alias("a").join(counted.alias("b"), same, "left").select(*[f"a.{k}" for k in key], F.coalesce("b.tokens", F.lit(0)).cast("long").alias("tokens"))
