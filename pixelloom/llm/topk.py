"""Exact top-k inner-product search by columnar branch and bound.

Candidates stream through each task as chunks in vertical layout (one row of numbers per dimension). A tile of queries
adds up its scores one block of dimensions at a time; after each block, what is left of a score is bounded by the product
of the norms of the dimensions not yet seen (Cauchy-Schwarz), and the chunk is compacted to the candidates that some query
of the tile may still want. The scores are sums of whole numbers, exact in the float type that is chosen from the largest
magnitudes.

Queries pass in blocks of a stated size, each sent to all tasks, so that neither a task nor the driver holds more than
one block; each block is one pass over the candidates. A task gives up to k rows per query and only such as reach a lower
bound known beforehand: the k-th best score among a bounded part of the block itself, whose rows are candidates too.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do those with a null id;
a query sees only vectors of its own length; rows that repeat the query's id are the query's own and no candidates, and a
repeated id is one query (its smallest vector); other repeated rows are candidates each; ties go to the smaller id; fewer
than k candidates give as many rows; a score that 64 bits don't hold counts as the nearest that they do, as do components;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import scratch, stored

TILE, DIM_BLOCK, SEEDS = 64, 16, 2048


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * component) of each vector that takes part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def _columns(vectors: pa.Array, width: int) -> np.ndarray:
    """width x n, a contiguous row per dimension."""
    return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).T)


def _scored(q: np.ndarray, c: np.ndarray, floor: np.ndarray, order: np.ndarray):
    """For each of the queries q (rows): positions in c (columns) and scores of all that reach its floor; more may come."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, len(order))
    if exact >= 2.0**52:  # floats would round: whole numbers, all of them
        if exact >= 2.0**62:  # beyond 64 bits: numbers of any length, cut to the nearest that fits
            scores = np.clip(q.astype(object) @ c.astype(object), -(2**63), 2**63 - 1).astype(np.int64)
        else:
            scores = q @ c
        return [(np.flatnonzero(s >= f), s[s >= f]) for s, f in zip(scores, floor, strict=True)]
    kind = np.float32 if exact < 2.0**23 else np.float64
    q, c = q[:, order].astype(kind), c[order].astype(kind)
    blocks = range(0, len(order), DIM_BLOCK)
    square = lambda x, axis: np.stack([np.square(x.take(range(b, min(b + DIM_BLOCK, len(order))), axis)).sum(axis, dtype=np.float64) for b in blocks])
    rest_q = np.sqrt(np.maximum(0, square(q, 1)[::-1].cumsum(0)[::-1]))
    rest_c = np.sqrt(np.maximum(0, square(c, 0)[::-1].cumsum(0)[::-1]))
    at, total = np.arange(c.shape[1]), np.zeros((len(q), c.shape[1]), kind)
    for j, b in enumerate(blocks):
        total += q[:, b : b + DIM_BLOCK] @ c[b : b + DIM_BLOCK]
        if j + 1 < len(rest_q):
            may = (total + rest_q[j + 1][:, None] * rest_c[j + 1][None] * (1 + 1e-6) + 1e-3 >= floor[:, None]).any(0)
            if may.sum() < 0.8 * len(may):
                at, total, c, rest_c = at[may], total[:, may], c[:, may], rest_c[:, may]
    return [(at[w], s[w].astype(np.int64)) for s, f in zip(total, floor, strict=True) for w in [np.flatnonzero(s >= f)]]


def _best(ids: np.ndarray, scores: np.ndarray, k: int):
    if len(ids) > 4 * k:  # drop what is below the k-th score before the full sort
        keep = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[keep], scores[keep]
    first = np.lexsort((ids, -scores))[:k]
    return ids[first], scores[first]


def _search(block, k: int):
    """block: {width: (query ids, query vectors, known floors, order of dimensions)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = block.value
        best = {w: [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(x[0]) for w, x in sent.items()}
        floors = {w: x[2].copy() for w, x in sent.items()}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy()) if batch.num_rows else np.empty(0)
            for w in set(lengths) & set(sent):
                some = pa.array(np.flatnonzero(lengths == w))
                ids = batch.column(0).take(some).to_numpy(zero_copy_only=False)
                c = _columns(batch.column(1).take(some), int(w)) if w else np.zeros((0, len(ids)), np.int64)
                q_ids, q, _, order = sent[w]
                for a in range(0, len(q_ids), TILE):
                    for i, (at, scores) in enumerate(_scored(q[a : a + TILE], c, floors[w][a : a + TILE], order), a):
                        other = ids[at] != q_ids[i]
                        if other.any():
                            x, y = best[w][i]
                            best[w][i] = x, y = _best(np.concatenate((x, ids[at][other])), np.concatenate((y, scores[other])), k)
                            if len(y) == k:
                                floors[w][i] = max(floors[w][i], float(y[-1]))
        for w, found in best.items():
            n = [len(x) for x, _ in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sent[w][0], n)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([y for _, y in found]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_queries: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all vectors but its own row."""
    spark = vectors.sparkSession
    candidates = quantised(vectors, scale)
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    asked = stored(asked, "queries")
    n_blocks = -(-asked.count() // block_queries)
    if n_blocks > 1:  # so many more blocks that the fullest stays within the stated size in all likelihood
        n_blocks = -(-5 * n_blocks // 4)
    found, path = spark.createDataFrame([], "query_id long, vec_id long, score long"), scratch(spark, "found")
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()
        lengths = np.array([len(x) for x in rows["q"].to_pylist()])
        block = {}
        for w in set(lengths.tolist()):
            some = pa.array(np.flatnonzero(lengths == w))
            ids = rows["vec_id"].take(some).to_numpy()
            q = np.array(rows["q"].take(some).to_pylist(), np.int64).reshape(len(ids), w)
            order = np.argsort(-np.square(q.astype(float)).sum(0), kind="stable")
            floor, seeds = np.full(len(ids), -np.inf), q[:SEEDS].T
            if len(ids) > k:
                for a in range(0, len(ids), TILE):
                    for i, (at, scores) in enumerate(_scored(q[a : a + TILE], seeds, floor[a : a + TILE], order), a):
                        scores = scores[at != i]
                        if len(scores) >= k:
                            floor[i] = np.partition(scores, -k)[-k]
            block[w] = (ids, q, floor, order)
        sent = spark.sparkContext.broadcast(block)
        found = candidates.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        if n_blocks > 1:  # each is written before the next is gathered, so that driver and tasks hold one block
            found.write.mode("append").parquet(path)
            sent.unpersist()
    if n_blocks > 1:
        found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
