"""Quality scores from histogram gradient-boosted trees over document statistics.

Tasks turn whole texts into a fixed set of statistics (byte classes, words, lines). Trees are fitted on the driver to a
sample of labelled rows whose bound is a parameter: the rows with the smallest hashes of their id, so that the choice is
the same on every run. Numbers are binned at quantiles of the sample; a tree grows level by level from sums of gradients
a bin. Fitted trees are complete and flat: arrays of features and thresholds, walked for all rows of a batch at once.

Defined cases: null text is empty and is scored like any other; a text of any length is scored whole; a null doc_id counts as empty text in the split; rows that
repeat are scored alike; labels that are null or have no document are left out; without labels of both kinds every score
is the share of label 1 (one half without any); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import free_name, held_in, text_or_empty

_CLASSES = ["lower", "upper", "digit", "space", "newline", "end", "bar", "bang", "mark", "other_ascii", "high"]
_CLASS_OF = np.full(256, _CLASSES.index("other_ascii"))
for _name, _bytes in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t\r"), ("newline", b"\n"), ("end", b".,;:?"), ("bar", b"|"), ("bang", b"!"), ("mark", b"*$%#&@^~"), ("high", bytes(range(128, 256)))):
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)
N_FEATURES = len(_CLASSES) + 13


def statistics(text: str) -> list[float]:
    """The statistics of one text; all are defined for the empty text."""
    raw = text.encode()
    n = max(1, len(raw))
    shares = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES)) / n
    words, lines = raw.split(), raw.split(b"\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    sizes = list(map(len, words))
    counts = Counter(words)
    ends = Counter(map(bytes.__getitem__, words, (slice(-1, None),) * len(words)))
    marked = sum(ends[bytes([c])] for c in b"*$%#&!|") / n_words
    shouted = sum(map(bytes.isupper, words)) / n_words
    line_sizes = list(map(len, lines))
    return [
        *shares.tolist(),
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(sizes) / n_words,
        max(sizes, default=0),
        len(counts) / n_words,
        counts.most_common(1)[0][1] / n_words if counts else 0.0,
        sum(map(eq, words, words[1:])) / n_words,
        marked,
        shouted,
        np.log1p(n_lines),
        sum(line_sizes) / n_lines,
        len(set(lines)) / n_lines,
        sum(b"|" in x for x in lines) / n_lines,
    ]


class Trees:
    """Complete trees of one depth: feature and threshold of inner node i, whose children are 2 i + 1 and 2 i + 2."""

    def __init__(self, start: float, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray):
        self.start, self.features, self.thresholds, self.leaves = start, features, thresholds, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss."""
    n, f = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    if n < 2 or y.min() == y.max():
        return Trees(start, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    cells = binned + np.arange(f) * bins
    inner, total = 2**depth - 1, np.full(n, start)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * bins) + cells).ravel()
            sums = [np.bincount(at, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                j, cut = divmod(int(b), bins)
                if gain[i, j, cut] > 1e-6 and cut < len(edges[j]):
                    feature[first + i], threshold[first + i] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        values = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += values[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(values)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of up to most labelled rows outside the held-out fifth."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_in(0)).select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("__id"))  # a label without a document takes no place in the sample
    chosen = ids.join(chosen, "__id").distinct().orderBy(F.xxhash64("__id"), "__id", "__y").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "y"])

    # at most `most` ids are sent to all tasks, whatever the size of the tables
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "__id").select("__id", "text", "__y")
    made = rows.mapInArrow(run, "id long, x array<double>, y int").orderBy(F.xxhash64("id"), "id", "y", "x").limit(most)
    found = made.toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.array(found["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    return x, (found["y"].to_numpy() == 1).astype(float)


def scored(docs: DataFrame, labels: DataFrame, most: int = 20000, name: str = "score") -> DataFrame:
    """docs with the column ``name``, 0 to 1."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, most)))

    def score(batches):
        import pandas as pd

        for text in batches:
            x = np.array([statistics(t) for t in text], float).reshape(-1, N_FEATURES)
            yield pd.Series(trees.value.score(x))

    from collections.abc import Iterator as Batches

    import pandas as pd

    score.__annotations__ = {"batches": Batches[pd.Series], "return": Batches[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(score, "double")(text_or_empty()))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scored(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", held_in(0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold; columns as they came."""
    name = free_name(docs, "score")
    return scored(docs, labels, name=name).where(F.col(name) >= threshold).drop(name)
