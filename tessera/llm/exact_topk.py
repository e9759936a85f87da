"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(scale * x). Candidates are dealt into blocks, queries into batches. A task holds one
block as postings (for each dimension the candidates with a non-zero weight there and the weights; a dimension that
most candidates have is kept whole) and takes the query batches one after another: for each non-zero weight of a
query it scatters weight * posting into a dense array of scores, then selects the block's best k by partition.
The best of the blocks meet in a second step, k rows a query and block.

Every query meets every block, so queries are repeated once a block: a block's size grows with the number of queries,
up to what a task can hold (MOST_BLOCK), to keep the repetition low. Sizes are counted, nothing is broadcast.

Defined cases: null vectors and vectors with a null, NaN or infinite component take no part, and neither do rows with
a null id; a component beyond the range of a long is the nearest long, and so is a score, which is computed exactly
before; vectors of different lengths meet on the dimensions that both have; rows with the query's id are not its
candidates; a query id with several rows is answered for the smallest of its vectors; repeated candidates repeat; ties
go to the smaller id; an empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import cut, ship


#: A block of this many vectors of 64 dimensions takes 64 MB.
MOST_BLOCK = 1 << 17


def quantised(vectors: DataFrame, scale: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.col("x")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("x")).where(ok).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


class Postings:
    """A block of candidates by dimension; ids ascending, so that of equal scores the smaller index is the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        sort = np.argsort(ids, kind="stable")
        self.ids = ids[sort]
        wide = max(map(len, vectors), default=0)
        dense = np.zeros((wide, len(ids)), np.int64)
        for at, k in enumerate(sort):
            dense[: len(vectors[k]), at] = vectors[k]
        self.top = float(np.abs(dense.astype(float)).max(initial=0.0))
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for row in dense:
            at = np.flatnonzero(row)
            self.lists.append((None, row) if 4 * len(at) > len(ids) else (at, row[at]))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to the smaller id."""
        #: Python integers where a sum of products might not fit a long
        fits = float(np.abs(query.astype(float)).max(initial=0.0)) * self.top * max(len(query), 1) < 2.0**62
        kind = np.int64 if fits else object
        scores = np.zeros(len(self.ids), kind)
        query = query.astype(kind)
        for term in np.flatnonzero(query[: len(self.lists)]):
            at, weights = self.lists[term]
            if at is None:
                scores += query[term] * weights.astype(kind, copy=False)
            else:
                scores[at] += query[term] * weights.astype(kind, copy=False)
        if not fits:
            scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        a, b = np.searchsorted(self.ids, (query_id, query_id + 1))
        pick = np.concatenate([np.arange(a), np.arange(b, len(scores))])
        if len(pick) > k:
            s = scores[pick]
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = pick[s > least]
            pick = np.concatenate([above, pick[s == least][: k - len(above)]])
        return self.ids[pick], scores[pick]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = 16384, batch: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where is_query (of vec_id) holds, against all rows."""
    rows = cut(quantised(vectors, scale, vec_id, vector))
    asked = rows.where(is_query)
    n, q = rows.count(), asked.select("vec_id").distinct().count()
    blocks = max(1, -(-n // min(max(block, q // 4), MOST_BLOCK)), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    number = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    one = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    every = one.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    dealt = rows.select(number.alias("block"), F.lit(0).alias("asks"), "vec_id", "v").unionByName(every)
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, held, postings, now = [], [], None, None
        for b in batches:
            out: list[list] = [[], [], []]
            values, edges = b.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column("v").value_lengths().to_numpy(zero_copy_only=False))])
            for at, (blk, asks, key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "asks", "vec_id")), strict=True)):
                v = values[edges[at] : edges[at + 1]].astype(np.int64)
                if blk != now:
                    ids, held, postings, now = [], [], None, blk
                if not asks:
                    ids.append(key)
                    held.append(v)
                    continue
                if postings is None:
                    postings, held = Postings(np.array(ids, np.int64), held), []
                found, scores = postings.best(key, v, k)
                out[0].append(np.full(len(found), key))
                out[1].append(found)
                out[2].append(scores)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    ship(vectors.sparkSession)
    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
