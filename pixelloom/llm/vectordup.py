"""Near copies among embeddings by product quantisation.

Equal vectors of a label are one class. A coarse quantiser (unit centroids) deals the classes into inverted lists, one for
each label, length and cell; a class is stored in its list as a code of its residual, a centroid number for each of up to
eight parts of the dimensions, with the exact length of what the code leaves out. A class asks the lists of the cells
that a vector within the distance can lie in: y lies in cell j only if y . c_j >= y . c_k for all k, so a mean m of any of
x's centroids gives |x - y| >= x . (m - c_j) / |m - c_j|; cells beyond by any of four such means aren't asked. In a list, table
lookups give the distance from the vector to a member's code; members further off than the distance and the code's own
error are passed over, the others compared by cosine in doubles. With ``reach`` 1 no link can be missed; a smaller one
asks fewer cells.

Of two cells the class of the smaller one asks. Classes within half the angle of their centroid, as most of a large group
of near copies is, are linked to each other without being compared, and only counted. Long lists are cut into blocks of
members and many askers into shares, each pair of which is a group of its own. A group gives a row for each class that has
links in it: their number and one edge of a spanning tree, so that nothing grows with the pairs.

The quantisers are fitted on up to ``sample`` classes of each length with the smallest hashes, at most 2^22 numbers.

Defined cases: vectors that are null, zero or hold a null or non-finite component, and rows without a label, link with
nothing; vectors of different lengths don't either; equal vectors of one label link; rows that share an id with different
vectors are one node of the graph; a null id is passed on, comes after all ids, and its component_id is null where no member
of its group has an id; ids are below 2^62; classes are told apart by 96 bits of hashes; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import Held
from pixelloom.llm.simhash import components
from pixelloom.llm.vectors import by_width, usable

#: Parts of a code and centroids of each; means that rule cells out; members of a block and askers of a share; rows that a
#: table sent to all tasks may have; shares of the rows of equal vectors.
PARTS, CODES, MEANS, MEMBERS, ASKERS, SENT, SALTS = 8, 256, (1, 2, 4, 8), 4096, 16384, 1 << 20, 32
NO_ID = 1 << 62


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, by way of their largest component so that squares stay in range."""
    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _clusters(x: np.ndarray, k: int, rounds: int, sphere: bool, rng) -> np.ndarray:
    """Up to k centroids of the rows of x; the first are drawn by their squared distance from those before."""
    k = min(k, len(x))
    c = np.empty((k, x.shape[1]))
    c[0] = x[0]
    far = np.square(x - c[0]).sum(1)
    for i in range(1, k):
        total = far.sum()
        if total <= 1e-18:
            c = c[:i]
            break
        c[i] = x[min(len(x) - 1, np.searchsorted(np.cumsum(far), rng.random() * total))]
        far = np.minimum(far, np.square(x - c[i]).sum(1))
    for _ in range(rounds):
        of = (x @ c.T - np.square(c).sum(1) / 2).argmax(1)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1)
        ok = (n > 0) & (size > 1e-9)
        c[ok] = sums[ok] / (size[ok] if sphere else n[ok])[:, None]
    return c


class Index:
    """A coarse quantiser and the codebooks of its residuals, fitted on the unit vectors x."""

    def __init__(self, x: np.ndarray, cells: int):
        rng = np.random.default_rng(11)
        self.centroids = _clusters(x, max(1, cells), 6, True, rng)
        self.gram = self.centroids @ self.centroids.T
        cell = (x @ self.centroids.T).argmax(1)
        rest = x - self.centroids[cell]
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), PARTS) if len(p)]
        self.books = [_clusters(np.ascontiguousarray(rest[:, p]), CODES, 3, False, rng) for p in self.parts]

    def encode(self, x: np.ndarray, reach: float):
        """(cell, whether it lies in the cell's core is left to the caller: cosine to the centroid, code, error, cells to ask)."""
        s = x @ self.centroids.T
        rows = np.arange(len(x))
        cell = s.argmax(1)
        rest = x - self.centroids[cell]
        code = np.empty((len(x), len(self.parts)), np.uint8)
        for i, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            code[:, i] = (rest[:, p] @ book.T - np.square(book).sum(1) / 2).argmax(1)
            rest[:, p] -= book[code[:, i]]
        error = np.sqrt(np.einsum("ij,ij->i", rest, rest))
        k = len(self.centroids)
        top = np.argpartition(-s, min(MEANS[-1], k) - 1, axis=1)[:, : MEANS[-1]] if k > 1 else np.zeros((len(x), 1), int)
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        may = np.ones(s.shape, bool)
        score, near = np.zeros(len(x)), np.zeros(s.shape)
        for m in range(1, top.shape[1] + 1):
            score += s[rows, top[:, m - 1]]
            near += self.gram[top[:, m - 1]]
            if m in MEANS:
                size = np.take_along_axis(near, top[:, :m], 1).sum(1) / (m * m)
                apart = np.sqrt(np.maximum(1e-30, 1 - 2 * near / m + size[:, None]))
                may &= score[:, None] / m - s <= (reach + 1e-6) * apart + 1e-9
        return cell, s[rows, cell], code, error, may

    def tables(self, x: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each part the squared distances of the rows' residuals from all of its codes."""
        rest = x - self.centroids[cell]
        return [(np.square(rest[:, p]).sum(1)[:, None] + np.square(book).sum(1)[None] - 2 * rest[:, p] @ book.T).astype(np.float32) for p, book in zip(self.parts, self.books, strict=True)]


def _linked(index: Index, cell: int, asking, members, least: float, distance: float):
    """Places (in asking, in members) of the pairs with a cosine of at least least."""
    found = []
    limit = np.square(distance + members["error"] + 1e-3).astype(np.float32)
    step = max(1, (1 << 20) // max(1, len(members["x"])))
    for a in range(0, len(asking["x"]), step):
        x = asking["x"][a : a + step]
        far = np.zeros((len(x), len(members["x"])), np.float32)
        for i, table in enumerate(index.tables(x, cell)):
            far += table[:, members["code"][:, i]]
        i, j = np.nonzero(far <= limit)
        for b in range(0, len(i), 1 << 15):
            p, q = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
            ok = np.einsum("ij,ij->i", x[p], members["x"][q]) >= least
            found.append((p[ok] + a, q[ok]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_MEMBER = "label long, cell int, node long, h long, mult long, x {kind}, code binary, error double, core boolean, ask array<int>"
_LINKS = "node long, h long, links long, other long"


def _pairs(grouped: DataFrame, indexes, least: float, distance: float) -> DataFrame:
    """(node, h, links, other) out of rows dealt by (label, width, cell, block, share), members before askers."""

    def arrays(rows: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(rows)
        n = len(t)
        x = next(by_width(t["x"]))[2]
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(n, -1)
        return {"x": _unit(x), "code": code} | {c: t[c].to_numpy() for c in ("node", "h", "mult", "error", "core", "home")}

    def answer(key, members, rows):
        _, width, cell = key[:3]
        asking = arrays(rows)
        i, j = _linked(indexes.value[width], cell, asking, members, least, distance)
        own = asking["home"][i] == cell
        keep = ~own | (asking["node"][i] != members["node"][j]) | (asking["h"][i] != members["h"][j])
        i, j, own = i[keep], j[keep], own[keep]
        if not len(i):
            return
        n = len(asking["x"])
        links = np.zeros(n + len(members["x"]), np.int64)
        np.add.at(links, i, members["mult"][j])
        both = ~own | members["core"][j]  # two of a list outside its core ask for each other
        np.add.at(links, n + j[both], asking["mult"][i[both]])
        root = _roots(len(links), i, n + j)
        at = np.flatnonzero((links > 0) | (root != np.arange(len(links))))
        name = np.concatenate([asking["node"], members["node"]])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (name[at], np.concatenate([asking["h"], members["h"]])[at], links[at], name[root[at]])], names=["node", "h", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, members, asked = None, [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("label", "width", "cell", "block", "share", "asks")], 1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                now, asks = tuple(keys[a, :5].tolist()), keys[a, 5]
                if now != key:
                    if asked:
                        yield from answer(key, members, asked)
                    key, waiting, members, asked = now, [], None, []
                rows = batch.slice(a, b - a)
                if not asks:
                    waiting.append(rows)
                elif waiting or members is not None:
                    if members is None:
                        members, waiting = arrays(waiting), []
                    asked.append(rows)
                    if sum(r.num_rows for r in asked) >= MEMBERS:
                        yield from answer(key, members, asked)
                        asked = []
        if asked:
            yield from answer(key, members, asked)

    return grouped.mapInArrow(run, _LINKS)


def _class_key(label: Column, x: Column) -> list[Column]:
    return [F.xxhash64(label, x).alias("h"), F.hash(x, label).alias("h2")]


def _with_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """df left join small; small goes to all tasks if it has few enough rows."""
    return df.join(F.broadcast(small) if small.limit(SENT + 1).count() <= SENT else small, on, "left")


def near_vectors(vectors: DataFrame, least: float = 0.98, sample: int = 16384, reach: float = 1.0, members: int = MEMBERS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each of vectors' rows; links join rows of one label whose cosine is
    at least least."""
    spark = vectors.sparkSession
    held = Held(spark)
    angle = float(np.arccos(min(1.0, max(-1.0, least))))
    distance, half = 2 * np.sin(angle / 2), float(np.cos(angle / 2)) + 1e-12
    x = F.col("embedding")
    ok = F.coalesce(F.col("label").isNotNull() & usable(x) & F.exists(x, lambda v: v != 0), F.lit(False))
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    plain = F.transform(x, lambda v: F.when(v == 0, 0).otherwise(v)).cast(kind)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), plain.alias("x"), ok.alias("ok"))
    taking = rows.where("ok").select("vec_id", "label", "x")
    first = F.coalesce("vec_id", F.xxhash64("label", "x").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))
    classes = taking.groupBy("label", "x").agg(F.count("*").alias("mult"), F.min("vec_id").alias("vec_id"))
    classes = held.stored(classes.select("label", "x", "mult", first.alias("node"), *_class_key(F.col("label"), F.col("x"))), "classes")

    # an index for each length
    sizes = classes.groupBy(F.size("x").alias("width"), "label").count().groupBy("width").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()
    indexes = {}
    for r in sizes:
        take = max(1, min(sample, (1 << 22) // r.width))
        some = classes.where(F.size("x") == r.width).select("x", "h").orderBy("h", "x").limit(take).select("x").toArrow()
        some = _unit(next(by_width(some["x"]))[2])
        indexes[r.width] = Index(some, min(1024, len(some) // 8, round(np.sqrt(r.most) / 2)))
    sent = spark.sparkContext.broadcast(indexes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, at, values in by_width(batch.column(1)):
                index = sent.value[w]
                step = max(1, (1 << 21) // max(w, len(index.centroids)))
                for a in range(0, len(at), step):
                    some = batch.take(pa.array(at[a : a + step]))
                    cell, cosine, code, error, may = index.encode(_unit(values[a : a + step]), reach * distance)
                    core = cosine >= half
                    may &= np.arange(may.shape[1])[None] > cell[:, None]
                    may[np.arange(len(cell)), cell] = ~core
                    i, j = np.nonzero(may)
                    ask = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(cell) + 1)).astype(np.int32)), pa.array(j.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), pa.array(cell.astype(np.int32)), some.column(3), some.column(4), some.column(2), some.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(core), ask],
                        names=["label", "cell", "node", "h", "mult", "x", "code", "error", "core", "ask"],
                    )

    coded = held.stored(classes.select("label", "x", "mult", "node", "h").mapInArrow(encode, _MEMBER.format(kind=kind)).withColumn("width", F.size("x")), "coded")

    # lists in blocks of members, their askers in shares; only lists that need more than one of either have a row here
    at = ["label", "width", "cell"]
    asks = coded.select("label", "width", F.explode("ask").alias("cell"))
    counted = coded.select(*at, F.lit(1).alias("m"), F.lit(0).alias("a")).unionByName(asks.select(*at, F.lit(0).alias("m"), F.lit(1).alias("a")))
    counted = counted.groupBy(at).agg(F.sum("m").alias("m"), F.sum("a").alias("a")).where(F.col("a") > 0)
    long_lists = counted.select(*at, F.ceil(F.col("m") / members).cast("int").alias("blocks"), F.ceil(F.col("a") / (4 * members)).cast("int").alias("shares")).where("blocks > 1 OR shares > 1")
    long_lists = held.stored(long_lists, "lists")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    part = lambda c: F.pmod(F.xxhash64("node", "h"), one(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    body = ["node", "h", "mult", "x", "code", "error", "core"]
    stored = _with_small(coded, long_lists, at).withColumn("share", every("shares")).select(*at, part("blocks").alias("block"), "share", F.lit(0).alias("asks"), F.col("cell").alias("home"), *body)
    askers = _with_small(coded.withColumn("home", F.col("cell")).withColumn("cell", F.explode("ask")), long_lists, at)
    askers = askers.withColumn("block", every("blocks")).select(*at, "block", part("shares").alias("share"), F.lit(1).alias("asks"), "home", *body)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [*at, "block", "share"]
    grouped = stored.unionByName(askers).repartition(n, *key).sortWithinPartitions(*key, "asks")
    pairs = held.stored(_pairs(grouped, sent, least, distance), "pairs")

    # cores: all linked to each other
    cores = held.stored(coded.where("core").groupBy(at).agg(F.count("*").alias("n"), F.sum("mult").alias("all"), F.min("node").alias("other")).where("n > 1").drop("n"), "cores")
    inner = _with_small(coded.where("core").select(*at, "node", "h", "mult"), cores, at).where("other IS NOT NULL")
    links = pairs.unionByName(inner.select("node", "h", (F.col("all") - F.col("mult")).alias("links"), "other"))
    edges = links.where("node <> other").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    groups = components(edges, held)
    counts = links.groupBy("node", "h").agg(F.sum("links").alias("links"))
    named = classes.select("node", "h", "h2", "mult").join(counts, ["node", "h"], "left").join(groups, "node", "left")
    named = held.stored(named.select("node", "h", "h2", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("c")), "named")
    component = F.when(F.col("c") < NO_ID, F.col("c"))
    single = named.where("mult = 1").select(F.when(F.col("node") < NO_ID, F.col("node")).alias("vec_id"), "n_links", component.alias("component_id"))
    salted = named.where("mult > 1").select("h", "h2", "n_links", component.alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    repeated = taking.select("vec_id", *_class_key(F.col("label"), F.col("x")), F.pmod(F.xxhash64("vec_id", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt"))
    repeated = repeated.join(salted, ["h", "h2", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = single.unionByName(repeated).unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    from pixelloom.llm.common import stored as kept

    result = kept(result, "vectors")
    held.close()
    return result
