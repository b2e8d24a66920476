"""Hard-negative mining by the threshold algorithm over sorted lists.

A task takes its candidates in blocks and sorts each dimension of a block once. Anchors pass in tiles: every list is read
from the end that an anchor's sign asks for, a few more places a round; rows seen for the first time are scored whole, in
whole numbers. What no list has shown yet scores at most the threshold, the sum of each dimension's last value times the
anchor's component; an anchor is done with a block once that falls strictly below the kth score of each of its windows (or
below the window itself). The best rows found so far hold for the blocks that follow in the task.

A first search, of one open window an anchor over rows of its label, finds the positives; a second one, of a window a
positive over rows of other labels, the negatives. Anchors are taken in blocks of a stated size, each one pass over the
candidates a search; a task gives at most k rows a window, of which Spark keeps the first k.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; an anchor
sees only vectors of its own length; a repeated anchor id is one anchor (its smallest label and vector), rows that repeat
it are its own and neither positive nor negative; other repeated rows are candidates each; ties go to the smaller id, of
those to either row; a positive of negative score has no negatives; fewer than k rows give as many; a score that 64 bits
don't hold counts as the nearest that they do, as do components; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import Held, scratch
from pixelloom.llm.vectors import by_width, usable, whole

#: Anchors in a tile; places of each list in the first round, and times as many in each that follows; numbers in a block.
TILE, FIRST, MORE, BLOCK = 64, 16, 4, 1 << 22
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "anchor_id long, at int, vec_id long, score long"


def candidates_of(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, q) of the rows that take part."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(x)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(x, scale).alias("q"))


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """anchors x rows, exact whole numbers."""
    most = float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(anchors.astype(float)).max(initial=0)) * max(1, rows.shape[1])
    if most < 2.0**23:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 2.0**52:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return anchors @ rows.T
    return np.clip(anchors.astype(object) @ rows.astype(object).T, LEAST, MOST).astype(np.int64)


class Windows:
    """An anchor's windows: scores from low to high, and the best k rows of each so far."""

    def __init__(self, low, high, k: int):
        self.low, self.high, self.k = low, high, k
        self.ids = [np.empty(0, np.int64)] * len(low)
        self.scores = [np.empty(0, np.int64)] * len(low)
        self.floors = list(low)
        self.floor = min(low, default=MOST)

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for i, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            ok = (scores >= max(low, self.floors[i])) & (scores <= high)
            if ok.any():
                x, y = np.concatenate((self.ids[i], ids[ok])), np.concatenate((self.scores[i], scores[ok]))
                if len(y) > 4 * self.k:  # drop what is below the kth score before the full sort
                    keep = y >= np.partition(y, -self.k)[-self.k]
                    x, y = x[keep], y[keep]
                first = np.lexsort((x, ~y))[: self.k]
                self.ids[i], self.scores[i] = x[first], y[first]
                if len(first) == self.k:
                    self.floors[i] = max(low, int(y[first[-1]]))
        self.floor = min(self.floors)


def search_block(ids, labels, rows, anchor_ids, anchor_labels, anchors, windows: list[Windows], same: bool) -> int:
    """Brings the windows of a tile of anchors up to date with a block of rows; how many rows it had to score."""
    n, d = rows.shape
    order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
    ordered = np.take_along_axis(rows, order, axis=0).astype(float)
    scored = 0
    for a in range(0, len(anchors), TILE):
        live = np.array([i for i in range(a, min(a + TILE, len(anchors))) if windows[i].low], np.int64)
        seen, depth = np.zeros(n, bool), 0
        while len(live):
            tile = anchors[live]
            new = min(n, max(FIRST, depth * MORE))
            up, down = np.flatnonzero((tile > 0).any(0)), np.flatnonzero((tile < 0).any(0))
            fresh = np.zeros(n, bool)
            fresh[order[n - new : n - depth, up].ravel()] = True
            fresh[order[depth:new, down].ravel()] = True
            fresh &= ~seen
            if new == n:
                fresh = ~seen  # an anchor of zeros asks no list
            seen |= fresh
            depth = new
            at = np.flatnonzero(fresh)
            if len(at):
                scored += len(at)
                scores = inner_products(rows[at], tile)
                own = (labels[at][None] == anchor_labels[live][:, None]) == same
                own &= ids[at][None] != anchor_ids[live][:, None]
                hits = own & (scores >= np.array([windows[i].floor for i in live])[:, None])
                for j in np.flatnonzero(hits.any(1)):
                    h = np.flatnonzero(hits[j])
                    windows[live[j]].take(ids[at[h]], scores[j, h])
            if depth >= n or seen.all():
                break
            positive, negative = np.maximum(tile, 0).astype(float), np.minimum(tile, 0).astype(float)
            threshold = positive @ ordered[n - depth] + negative @ ordered[depth - 1]
            slack = 1e-9 * (positive @ np.abs(ordered[n - depth]) - negative @ np.abs(ordered[depth - 1]))
            live = live[threshold + slack >= np.array([float(windows[i].floor) for i in live])]
    return scored


def _search(block, k: int, same: bool):
    """block: {width: (ids, labels, vectors, lows, highs)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = block.value
        kept = {w: [Windows(low, high, k) for low, high in zip(x[3], x[4], strict=True)] for w, x in sent.items()}
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w, at, rows in by_width(batch.column(2)):
                if w in sent:
                    step = max(1, BLOCK // max(1, w))
                    for a in range(0, len(at), step):
                        some = at[a : a + step]
                        search_block(ids[some], labels[some], rows[a : a + step], *sent[w][:3], kept[w], same)
        for w, windows in kept.items():
            out = [(i, j, len(x.ids[j])) for i, x in enumerate(windows) for j in range(len(x.low)) if len(x.ids[j])]
            if out:
                i, j, n = np.array(out).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(sent[w][0][i], n)), pa.array(np.repeat(j, n).astype(np.int32)), pa.array(np.concatenate([windows[x].ids[y] for x, y, _ in out])), pa.array(np.concatenate([windows[x].scores[y] for x, y, _ in out]))],
                    names=["anchor_id", "at", "vec_id", "score"],
                )

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k_positive: int = 5, k_negative: int = 5, share: tuple[int, int] = (4, 5), scale: float = 256.0, block_anchors: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    k_positive nearest rows of its label, the k_negative nearest rows of other labels whose scores lie between the given
    share of the positive's score and that score."""
    spark = vectors.sparkSession
    held = Held(spark)
    candidates = candidates_of(vectors, scale)
    asked = held.stored(candidates_of(anchors, scale).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.*"), "anchors")
    n_blocks = -(-asked.count() // block_anchors)
    if n_blocks > 1:  # so many more blocks that the fullest stays within the stated size in all likelihood
        n_blocks = -(-5 * n_blocks // 4)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result, path = spark.createDataFrame([], kind), scratch(spark, "negatives")
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        block = {}
        for w, at, q in by_width(rows["q"]):
            ids, labels = rows["vec_id"].to_numpy()[at], rows["label"].to_numpy()[at]
            block[w] = (ids, labels, q, [[LEAST]] * len(at), [[MOST]] * len(at))
        sent = spark.sparkContext.broadcast(block)
        positives = held.stored(_first(candidates.mapInArrow(_search(sent, k_positive, True), FOUND), k_positive).select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        sent.unpersist()
        of: dict[int, list[int]] = {}
        for r in positives.select("anchor_id", "positive_score").distinct().toArrow().to_pylist():
            of.setdefault(r["anchor_id"], []).append(r["positive_score"])
        for w, (ids, labels, q, _, _) in block.items():
            highs = [sorted(p for p in of.get(i, []) if p >= 0) for i in ids.tolist()]
            block[w] = (ids, labels, q, [[-(-share[0] * p // share[1]) for p in high] for high in highs], highs)
        numbered = [(i, j, p) for ids, _, _, _, highs in block.values() for i, high in zip(ids.tolist(), highs, strict=True) for j, p in enumerate(high)]
        windows = spark.createDataFrame(numbered, "anchor_id long, at int, positive_score long")
        sent = spark.sparkContext.broadcast(block)
        negatives = _first(candidates.mapInArrow(_search(sent, k_negative, False), FOUND), k_negative)
        found = negatives.join(windows, ["anchor_id", "at"]).join(positives.drop("rank"), ["anchor_id", "positive_score"])
        found = found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.write.mode("append").parquet(path)
        sent.unpersist()
    if n_blocks:
        result = spark.read.schema(kind).parquet(path)
    held.close()
    return result
