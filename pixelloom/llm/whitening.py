"""Embedding whitening by a blockwise QR and a bidiagonal qd solver.

Vectors become whole numbers x = floor(256 * component); the fit takes each distinct x once. Its sums give exact means. Each
task reduces its centred rows to a triangle by QR, a block of rows after the other; triangles are stacked and reduced again
in three rounds of grouped tasks, so that none holds more than a share of them. The last triangle R (width x width) is
brought to bidiagonal form; differential qd steps find its singular values, twisted factorisations the directions
(``bidiagonal``). The covariance matrix is never formed.

Defined cases: vectors that are null or hold a null or a non-finite component give no row; rows with a null id, repeated
ids and repeated vectors give rows like others; vectors of each length are a fit of their own; a vector without components
gives no row, one with fewer than four has as many components; a direction whose variance is zero to rounding (as for a
single vector) has whitened null, and identity_error is of the others (0.0 without any); explained is 0.0 if all variance is
zero; equal variances have any orthonormal directions; a direction's entry of largest size is positive; a deviation that 64
bits don't hold counts as the largest that they do; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.bidiagonal import EPS, right_vectors
from pixelloom.llm.common import Held
from pixelloom.llm.vectors import by_width, usable, whole

#: Rows that one QR takes in; numbers of a model that are sent to the tasks at once; triangles that a round puts together.
ROWS, SENT, FAN = 2048, 1_000_000, (1024, 32, 1)


def fit_list(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(x): each distinct vector of whole numbers."""
    x = F.col("embedding")
    return vectors.where(usable(x) & (F.size(x) > 0)).select(whole(x, scale).alias("x")).distinct()


def _sums(fit: DataFrame) -> DataFrame:
    """(width, place, n, s decimal): exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        s: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, at, x in by_width(batch.column(0)):
                whole_ints = float(np.abs(x.astype(float)).max(initial=0)) * len(x) >= 2.0**62
                part = (x.astype(object) if whole_ints else x).sum(0).astype(object)
                n[w], s[w] = n.get(w, 0) + len(at), s[w] + part if w in s else part
        for w in n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w, np.int32)), pa.array(np.arange(w, dtype=np.int32)), pa.array(np.full(w, n[w], np.int64)), pa.array([str(v) for v in s[w]])], names=["width", "place", "n", "s"])

    parts = fit.select("x").mapInArrow(run, "width int, place int, n long, s string")
    return parts.groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n in doubles, with n * x - S in whole numbers where 64 bits hold them."""
    size = float(np.abs(x.astype(float)).max(initial=0))
    if n * size < 2.0**62:
        return (x * n - s.astype(np.int64)) / float(n)
    return x.astype(float) - np.array([float(v) / n for v in s])


def _deviation(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact; the largest of 64 bits beyond."""
    rough = np.square(x.astype(float) * n - s.astype(float)).sum(1)
    most = float(n) * np.abs(x.astype(float)).max(initial=0)
    if rough.max(initial=0) < 2.0**62 and most < 2.0**62:
        return np.square(x * n - s.astype(np.int64)).sum(1)
    out = np.full(len(x), 2**63 - 1, np.int64)
    near = np.flatnonzero(rough < 2.0**63 * (1 + 1e-6))
    exact = np.square(x[near].astype(object) * n - s).sum(1) if len(near) else []
    out[near] = [min(int(v), 2**63 - 1) for v in exact]
    return out


def _triangles(fit: DataFrame, known) -> DataFrame:
    """(width, part, r): the triangle of each task's centred rows, put together in rounds to one a width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, _, x in by_width(batch.column(0)):
                if w not in known.value:
                    continue
                n, s = known.value[w][:2]
                for a in range(0, len(x), ROWS):
                    rows = centred(x[a : a + ROWS], n, s)
                    held[w] = np.linalg.qr(np.vstack([held[w], rows]) if w in held else rows, mode="r")
        k = TaskContext.get().partitionId()
        for w, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([k], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["width", "part", "r"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        w = int(group["width"].iloc[0])
        held = None
        for r in group.sort_values("part")["r"]:
            r = np.frombuffer(r).reshape(-1, w)
            held = np.linalg.qr(r if held is None else np.vstack([held, r]), mode="r")
        return pd.DataFrame({"width": [w], "part": [int(group["part"].min())], "r": [held.tobytes()]})

    kind = "width int, part long, r binary"
    found = fit.select("x").mapInArrow(run, kind)
    for fan in FAN:
        found = found.groupBy("width", F.pmod(F.col("part"), F.lit(fan)).alias("of")).applyInPandas(together, kind)
    return found


def _models(fit: DataFrame, sums: dict[int, tuple], k: int) -> dict[int, tuple]:
    """{width: (n, S, directions, variances or 0, shares of the variance)}."""
    context = fit.sparkSession.sparkContext
    sent = context.broadcast(sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w, r in zip(batch["width"], batch["r"], strict=True):
                r = np.frombuffer(r).reshape(-1, w)
                values, vectors = right_vectors(r, k)
                yield pd.DataFrame({"width": [w], "squares": [values[:k].tolist()], "vectors": [vectors.ravel().tolist()], "total": [float(np.square(r).sum())]})

    solved = _triangles(fit, sent).select("width", "r").mapInPandas(solve, "width int, squares array<double>, vectors array<double>, total double")
    out = {}
    for row in solved.collect():
        n, s = sums[row.width]
        squares = np.array(row.squares)
        none = squares <= np.square(EPS * row.width * 8) * row.total
        shares = squares / row.total if row.total > 0 else squares * 0
        out[row.width] = (n, s, np.array(row.vectors).reshape(len(squares), row.width), np.where(none, 0.0, squares / n), shares)
    sent.unpersist()
    return out


def _whitened(x: np.ndarray, model: tuple) -> np.ndarray:
    """Rows x components; not a number where a component has no variance."""
    n, s, vectors, variances, _ = model[:5]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(variances > 0, (centred(x, n, s) @ vectors.T) / np.sqrt(variances), np.nan)


def _identity_errors(fit: DataFrame, sent) -> dict[int, float]:
    """{width: largest entry of the difference between the whitened fit list's covariance and the identity}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, _, x in by_width(batch.column(0)):
                if w in sent.value:
                    y = np.nan_to_num(_whitened(x, sent.value[w]))
                    y = np.hstack([y, np.ones((len(y), 1))])
                    held[w] = held.get(w, 0) + y.T @ y
        for w, both in held.items():
            i, j = np.indices(both.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(both.size, w, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(both.ravel())], names=["width", "i", "j", "s"])

    sums = fit.select("x").mapInArrow(run, "width int, i int, j int, s double").groupBy("width", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = {}
    for w, model in sent.value.items():
        k = len(model[3])
        both = np.zeros((k + 1, k + 1))
        for row in (r for r in sums if r.width == w):
            both[row.i, row.j] = row.s
        n, mean = model[0], both[:k, k] / model[0]
        live = model[3] > 0
        out[w] = float(np.abs((both[:k, :k] / n - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]).max(initial=0))
    return out


def whitened(vectors: DataFrame, k: int = 4, scale: float = 256.0, held: Held | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to k rows for each vector that takes part."""
    spark = vectors.sparkSession
    own = held or Held(spark)
    fit = own.stored(fit_list(vectors, scale), "fit")
    sums: dict[int, tuple] = {}
    for w, rows in pd.DataFrame([tuple(r) for r in _sums(fit).collect()], columns=["width", "place", "n", "s"]).groupby("width"):
        rows = rows.sort_values("place")
        sums[int(w)] = (int(rows["n"].iloc[0]), np.array([int(v) for v in rows["s"]], object))
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found, block = None, {}
    x = F.col("embedding")
    asked = vectors.where(usable(x) & (F.size(x) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(x, scale).alias("x"))

    def project(block):
        models = _models(fit, block, k)
        sent = spark.sparkContext.broadcast(models)
        errors = _identity_errors(fit, sent)
        sent = spark.sparkContext.broadcast({w: (*m, errors[w]) for w, m in models.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w, at, x in by_width(batch.column(1)):
                    if w not in sent.value:
                        continue
                    model = sent.value[w]
                    y = _whitened(x, model)
                    c = y.shape[1]
                    ids = batch.column(0).take(pa.array(np.repeat(at, c)))
                    tile = lambda v: pa.array(np.tile(v, len(at)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, tile(np.arange(1, c + 1, dtype=np.int32)), tile(np.full(c, model[0], np.int64)), pa.array(np.repeat(_deviation(x, *model[:2]), c)), pa.array(y.ravel(), from_pandas=True), tile(model[4]), tile(np.full(c, model[5]))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

        return asked.mapInArrow(run, kind)

    for w in sorted(sums):  # widths in blocks, so that the models sent at once are bounded
        if block and sum(block) * (k + 2) + w * (k + 2) > SENT:
            found, block = project(block) if found is None else found.unionByName(project(block)), {}
        block[w] = sums[w]
    if block:
        found = project(block) if found is None else found.unionByName(project(block))
    if held is None:
        own.close()
    return spark.createDataFrame([], kind) if found is None else found
