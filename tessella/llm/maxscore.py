"""Exact top-k search by inner product with MaxScore over shards of dense postings.

A component of a vector is a term, ``floor(256 c)`` its weight, so scores are whole numbers.  The
index (:func:`build`) consists of shards of a few thousand rows: one posting row per term, with the
lowest and highest weight in it.  The queries come in blocks of at most ``block`` rows, each of
which is broadcast once; shards never move, and every shard meets every block in one pass.

In a shard (:func:`search`) a query's terms are ordered by the bound of what they can add.  The
terms of the smallest bounds, as long as these add up to less than ``SHARE`` of the query's
threshold (its k-th score so far), are non-essential.  Postings of the essential terms are
traversed for many queries at once as one matrix product; rows whose score so far and the open
bounds together stay below the threshold are done.  The others are probed in the non-essential
terms, one by one, as long as they compete.  Pruning is strict, so ties survive and the smaller
identifier wins.  A task keeps k rows a query and hands them out once, and Spark merges them.

Null vectors and vectors with null or non-finite components (or beyond 2**31) take no part, nor
do rows without identifier.  Shorter vectors end in zeros; empty ones score 0.  Every row with
another identifier than the query's is a candidate, repeated rows as often as they occur; equal
query rows are one query.  With fewer candidates than k there are fewer rows.  Scores are exact
below 2**53.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import part_no, parts_of, stage, whole_vectors

K, EVERY = 5, 50
SHARE = 0.25  # of the threshold that non-essential terms may reach together
BLOCK = 32_768  # queries of one broadcast
SHARD_BYTES = 1 << 21  # of one shard's postings as 64-bit numbers
_QUERIES = 256  # that traverse a shard at once


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as the columns of a matrix, shorter ones filled with zeros."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(ends[0], ends[-1]) - ends[at], at] = values[ends[0] : ends[-1]]
    return out


def build(vectors: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(ids, terms, postings, low, high) from (vec_id, x): one row per shard."""
    kinds = [np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]

    def shard_of(ids: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        terms = max(m.shape[0] for m in held)
        posted = np.concatenate([np.pad(m, ((0, terms - m.shape[0]), (0, 0))) for m in held], axis=1)
        low, high = (posted.min(axis=1), posted.max(axis=1)) if terms else (np.zeros(0, np.int64),) * 2
        kind = next(k for k in kinds if k == kinds[-1] or (low.min(initial=0) >= np.iinfo(k).min and high.max(initial=0) <= np.iinfo(k).max))
        return pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate(ids)]), pa.array([terms], pa.int32()), pa.array([posted.astype(kind).tobytes()], pa.binary()), pa.array([low]), pa.array([high])],
            names=["ids", "terms", "postings", "low", "high"])

    def run(batches):
        ids, held, size = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                longest = batch.column(1).value_lengths()
                longest = max(1, max(longest.to_pylist()))
                room = max(1, shard_bytes // (8 * longest) - size)
                part = batch.slice(at, room)
                ids.append(part.column(0).to_numpy())
                held.append(_matrix(part.column(1)))
                at, size = at + part.num_rows, size + part.num_rows
                if part.num_rows == room:
                    yield shard_of(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield shard_of(ids, held)

    return vectors.select("vec_id", "x").mapInArrow(run, "ids array<long>, terms int, postings binary, low array<long>, high array<long>")


class Best:
    """The k best rows so far of many queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k  # queries: one row each
        self.row = self.doc = self.score = np.zeros(0, np.int64)
        self.threshold = np.full(len(ids), -np.inf)

    def add(self, row: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        row, doc, score = np.r_[self.row, row], np.r_[self.doc, doc], np.r_[self.score, score]
        order = np.lexsort((doc, -score, row))
        row, doc, score = row[order], doc[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.doc, self.score = (v[place < self.k] for v in (row, doc, score))
        last = place == self.k - 1
        self.threshold[row[last]] = score[last]


def search(postings: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Add what a shard holds to ``best``; the number of (query, row) pairs probed, for tests."""
    probed = 0
    terms = min(len(postings), best.queries.shape[1])
    postings, low, high = postings[:terms].astype(np.float64), low[:terms], high[:terms]
    for start in range(0, len(best.ids), _QUERIES):
        q = best.queries[start : start + _QUERIES, :terms].astype(np.float64)
        own = best.ids[start : start + len(q), None] == ids
        threshold = best.threshold[start : start + len(q)].copy()
        bound = np.maximum(q * low, q * high)
        order = np.argsort(bound, axis=1)
        open_to = np.concatenate([np.zeros((len(q), 1)), np.cumsum(np.take_along_axis(bound, order, 1), axis=1)], axis=1)
        split = (np.logical_and.accumulate(open_to[:, 1:] < SHARE * threshold[:, None], axis=1)).sum(axis=1)
        rank = np.argsort(order, axis=1)
        score = np.where(rank >= split[:, None], q, 0.0) @ postings
        score[own] = -np.inf
        new = np.isneginf(threshold)
        if new.any() and score.shape[1] >= best.k:  # nothing known yet: the k-th score of this shard
            threshold[new] = np.partition(score[new], -best.k, axis=1)[:, -best.k]
        rest = np.take_along_axis(open_to, split[:, None], 1)
        row, doc = np.nonzero((score + rest >= threshold[:, None]) & ~own)
        score = score[row, doc]
        for j in range(int(split.max(initial=0)) - 1, -1, -1):
            mine = np.flatnonzero(split[row] > j)
            probed += len(mine)
            term = order[row[mine], j]
            score[mine] += q[row[mine], term] * postings[term, doc[mine]]
            keep = np.ones(len(row), bool)
            keep[mine] = score[mine] + open_to[row[mine], j] >= threshold[row[mine]]
            row, doc, score = row[keep], doc[keep], score[keep]
        if len(row):
            best.add(row + start, ids[doc], score.astype(np.int64))
    return probed


def _pass(shared, k: int) -> Callable:
    def run(batches):
        ids, queries = shared.value
        best = Best(ids, queries, k)
        for batch in batches:
            for r in range(batch.num_rows):
                names, terms, held, low, high = (batch.column(c)[r] for c in range(5))
                names = names.values.to_numpy()
                held = held.as_buffer()
                kind = f"<i{held.size // max(1, len(names) * terms.as_py())}" if held.size else "<i2"
                posted = np.frombuffer(held, kind).reshape(terms.as_py(), len(names))
                search(posted, names, low.values.to_numpy(), high.values.to_numpy(), best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.row.astype(np.int32)), pa.array(ids[best.row]), pa.array(best.doc), pa.array(best.score)], names=["row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
          block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``is_query`` (over ``vec_id``) chooses."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, vec_id, vector).where("vec_id IS NOT NULL")
    index = stage(build(whole, shard_bytes), "maxscore-index")
    queries = stage(whole.where(is_query).distinct().withColumn("key", F.monotonically_increasing_id()), "maxscore-queries")
    found, n = None, parts_of(queries, "key", block)
    for b in range(n):
        rows = queries.where(part_no("key", n) == b).select("vec_id", "x").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), _matrix(rows["x"].combine_chunks()).T.copy()))
        part = index.mapInArrow(_pass(shared, k), "row int, query_id long, vec_id long, score long")
        part = stage(part.withColumn("block", F.lit(b)), "maxscore-found")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "row int, query_id long, vec_id long, score long, block int")
    rank = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
