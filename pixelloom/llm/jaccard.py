"""Groups of texts whose sets of distinct word shingles have a Jaccard similarity of at least 4/5, counted, none missed.

Sets have SimHash fingerprints; pairs that the search by generalised pigeonhole (simhash.near_edges) finds within DISTANCE
bits are counted first and make the first groups. Fingerprints of sets at 4/5 lie up to 17 bits apart, so that a second
search follows, among sets of different groups alone.

Two sets of that similarity share one of the first n - ceil(4 n / 5) + 1 shingles of either, in any order that holds for
the whole corpus (prefix filter). The order puts rare shingles first, by counts over a part of the documents; counts that
are off cost time and change no result. Texts that meet under a shingle, and whose sizes and places allow 4/5, are joined
to their sets and counted. Equal sets are one class, searched once.

Under a shingle of many classes each is paired with its next eight by size; when those links are known, what is left are
pairs of different components; of those, pairs go whose 512-bit parities differ in more bits than two sets at 4/5 have
shingles apart, which bounds the difference from below. So a large group of near copies costs about its size in links and
counts, and no pair is left out. Shingles are read in ranges and cut into blocks of BLOCK classes by size; of a shingle with
several blocks, pairs of blocks are compared, each pair on its own, but for those whose sizes are too far apart and those
that lie in one component.

Defined cases: see simhash.one_per_group, which is how this is used; a text of any length is one set, held whole in its task.
Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Held, identity, text_or_empty
from pixelloom.llm.simhash import components, majority, near_edges

SEED = 42
COUNTERS = 1 << 20
PART = 8  # one document in so many is counted for the order
NEXT = 8
DISTANCE = 7  # bits
BLOCK = 1024  # at most so many rows of a shingle on either side meet in a task
MIX = np.uint64(0x9E3779B97F4A7C15)
ID = ["__id", "__no_id", "__th"]


class Sets:
    """text -> sorted distinct hashes of its shingles of lower-cased (A-Z) words; a shorter text is one shingle."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > 1 << 18:
            self.known = {}
        known, w = self.known, text.encode().lower().split()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x, SEED)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        k = min(self.words, len(h))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ out >> np.uint64(29)) * MIX + h[i : i + len(out)]
        out = (out ^ out >> np.uint64(32)) * MIX
        return np.unique(out ^ out >> np.uint64(29))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - 2**63


def _parity(shingles: np.ndarray) -> bytes:
    """512 bits, each the parity of the number of shingles that fall to it; two sets' differ in no more than the sets do."""
    return np.packbits(np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=512) & 1).tobytes()


def _order(docs: DataFrame, words: int) -> np.ndarray:
    """How many counted documents hold a shingle of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, n = Sets(words), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(n, sets(t) % np.uint64(COUNTERS), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    some = docs.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0)
    found = some.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.zeros(COUNTERS, np.uint32)
    out[found["at"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return out


def classes_of(docs: DataFrame, words: int, held: Held) -> DataFrame:
    """node (the set's hash), first (the smallest document), n, prefix, parity, fp: a row for each distinct set.

    A document is its doc_id and its text; null ids come after all others.
    """
    order = docs.sparkSession.sparkContext.broadcast(_order(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rank = Sets(words), order.value
        for batch in batches:
            nodes, sizes, prefixes, parities, prints = [], [], [], [], []
            for t in batch.column(3).to_pylist():
                s = sets(t)
                nodes.append(_node(s))
                sizes.append(len(s))
                parities.append(_parity(s))
                prints.append(majority(s[a : a + (1 << 16)] for a in range(0, len(s), 1 << 16)))
                first = np.lexsort((s, rank[s % np.uint64(COUNTERS)]))[: len(s) - (4 * len(s) + 4) // 5 + 1]
                prefixes.append(s[first].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(parities, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=[*ID, "node", "n", "prefix", "parity", "fp"])

    prints = _texts(docs).mapInArrow(run, "__id long, __no_id boolean, __th long, node long, n long, prefix binary, parity binary, fp long")
    first = F.min(F.struct("__no_id", "__id", "__th")).alias("first")
    return held.stored(prints.groupBy("node").agg(first, F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("prefix", "parity", "fp"))), "classes")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*identity(F.col("doc_id"), F.col("text")), text_or_empty().alias("text"))


def _printed(classes: DataFrame, held: Held) -> DataFrame:
    """Pairs (a, b), a < b, that join the nodes whose fingerprints lie within DISTANCE bits; equal ones by their smallest node."""
    one = held.stored(classes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    equal = classes.select("fp", F.col("node").alias("b")).join(one.withColumnRenamed("node", "a"), "fp").where("a < b").select("a", "b")
    near = near_edges(one.select("fp", F.lit(0).cast("long").alias("fp2"), "node"), DISTANCE)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().unionByName(equal)


def _listed(classes: DataFrame) -> DataFrame:
    """(token, node, n, i): a row for each shingle of a prefix and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in prefixes], np.int64)
            if sizes.sum():
                of = np.repeat(np.arange(len(sizes)), sizes)
                i = np.arange(len(of)) - np.repeat(sizes.cumsum() - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), *(c.take(pa.array(of)) for c in batch.columns[:2]), pa.array(i.astype(np.int32))], names=["token", "node", "n", "i"])

    return classes.select("node", F.col("n").cast("int"), "prefix").mapInArrow(run, "token long, node long, n int, i int")


def _may(n, i, a, b):
    """Sizes and places of rows a and b leave room for 4/5, if this is the first shingle that they share."""
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * np.minimum(na - i[a], nb - i[b]) >= 4 * (na + nb))


def _pair_batch(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """Distinct pairs of the nodes at places a and b, the smaller first."""
    x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    keep = x != y
    both = np.unique(np.stack([x[keep], y[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys."""
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    return starts, np.diff(np.append(starts, len(key)))


def _near(listed: DataFrame) -> DataFrame:
    """kind, a, b, n, i, block out of (token, node, n, i). kind 0: a pair of nodes. Others: a row of a shingle, a its node, b the
    shingle. kind 1: the shingle has more than NEXT + 1 rows and at most BLOCK. kind 2: a row of a block of at most BLOCK rows
    of a shingle that has more, or that may lie in two tasks.

    Tasks are ranges of (token, n, node) and hold a block and a batch at a time, whatever the size of a shingle.
    """

    def batch_of(kind: int, a, b, n=None, i=None, block=None) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(a), np.int32))
        more = [zero if x is None else pa.array(x) for x in (n, i)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, b, *more, pa.array(np.zeros(len(a), np.int64) if block is None else block)], names=["kind", "a", "b", "n", "i", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = TaskContext.get().partitionId() << 32
        held, cut = None, True  # rows of the last shingle so far; whether earlier rows of it may lie elsewhere

        def of(rows, open_end: bool):
            """Pairs and rows of whole shingles, but for the first (if cut) and the last (if open_end)."""
            nonlocal blocks
            token, node, n, i = rows
            starts, sizes = _runs(token)
            ends, at = np.repeat(starts + sizes, sizes), np.arange(len(token))
            a, b = [], []
            for d in range(1, NEXT + 1):
                x = at[at + d < ends]
                x = x[_may(n, i, x, x + d)]
                a.append(x)
                b.append(x + d)
            yield batch_of(0, *_pair_batch(node, np.concatenate(a), np.concatenate(b)))
            wide = sizes > BLOCK
            wide[0] |= cut
            wide[-1] |= open_end
            whole = np.repeat((sizes > NEXT + 1) & ~wide, sizes)
            if whole.any():
                yield batch_of(1, pa.array(node[whole]), pa.array(token[whole]), n[whole], i[whole])
            if wide.any():
                some = np.repeat(wide, sizes)
                # a new block where a shingle begins and after each BLOCK rows of it
                number = np.cumsum((at - np.repeat(starts, sizes)) % BLOCK == 0)
                yield batch_of(2, pa.array(node[some]), pa.array(token[some]), n[some], i[some], blocks + number[some])
                blocks += int(number[-1])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from of([x[:last] for x in rows], False)
                cut = False
            held = [x[last:] for x in rows]
            if len(held[0]) >= BLOCK:
                yield from of(held, True)
                held, cut = None, True
        if held is not None:
            yield from of(held, True)

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartitionByRange(parts, "token", "n", "node").sortWithinPartitions("token", "n", "node").mapInArrow(run, "kind int, a long, b long, n int, i int, block long")


def _apart(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, among the rows (key, side, node, n, i, component, parity) of a key.

    Of rows with sides 0 and 1 only those of different sides are paired, a row of side -1 with every other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows):
            key, side, node, n, i, component, parity = rows
            for s, size in zip(*_runs(key), strict=True):
                mine, sides = component[s : s + size], side[s : s + size]
                if (mine == mine[0]).all():
                    continue
                last = np.searchsorted(n[s : s + size], (5 * n[s : s + size].astype(np.int64)) // 4, "right")
                bits = np.frombuffer(b"".join(parity[s : s + size]), "<u8").reshape(-1, 8)
                step = max(1, (1 << 20) // size)
                for x in range(0, size, step):
                    some = np.arange(x, min(size, x + step))[:, None]
                    to = np.arange(size)[None]
                    a, b = np.nonzero((to > some) & (to < last[some]) & (mine[None] != mine[some]) & ((sides[None] != sides[some]) | (sides[None] < 0)))
                    a += x
                    ok = _may(n, i, s + a, s + b)
                    a, b = a[ok], b[ok]
                    if len(a):
                        ok = 9 * np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= n[s + a].astype(np.int64) + n[s + b]
                        yield pa.RecordBatch.from_arrays(_pair_batch(node, s + a[ok], s + b[ok]), names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and (cut or held[0][0][0] != rows[0][0]):
                yield from of([np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows], strict=True)])
                held = []
            elif cut:
                yield from of([x[:cut] for x in rows])
            held.append([x[cut:] for x in rows])
        if held:
            yield from of([np.concatenate(x) for x in zip(*held, strict=True)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("key", "side", "node", "n", "i", "component", "parity")
    return rows.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long")


def _met(rows: DataFrame) -> DataFrame:
    """Rows (token, block, node, n, i, component) once for each pair of blocks of a shingle that may hold a similar pair of
    different components, with the pair's key and the row's side; key: a hash, pairs that share one only cost time."""
    blocks = rows.groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("from"), F.max("component").alias("to"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sized = (4 * F.col("x.least") <= 5 * F.col("y.most")) & (4 * F.col("y.least") <= 5 * F.col("x.most"))
    one = (F.col("x.from") == F.col("x.to")) & (F.col("y.from") == F.col("y.to")) & (F.col("x.from") == F.col("y.from"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")) & sized & ~one)
    side = lambda k, n: F.struct(F.col(f"{k}.block").alias("block"), F.lit(n).alias("side"))
    sides = F.when(F.col("x.block") == F.col("y.block"), F.array(side("x", -1))).otherwise(F.array(side("x", 0), side("y", 1)))
    sent = pairs.select(F.col("x.token").alias("token"), F.xxhash64("x.block", "y.block").alias("key"), F.explode(sides).alias("s")).select("token", "key", "s.block", "s.side")
    return rows.join(sent, ["token", "block"])


def _counted(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, results: Held) -> DataFrame:
    """The pairs (a, b) whose similarity, counted over the sets, is at least 4/5; the sets are removed again."""
    held = Held(docs.sparkSession)
    nodes = held.stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    first = classes.join(nodes, "node", "left_semi").select("first.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in batches:
            found = [sets(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "set"])

    texts = _texts(docs).join(first, ID, "left_semi").select("text")
    sets = held.stored(texts.mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")), "sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"))
    found = results.stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(count, "a long, b long"), "edges")
    held.close()
    return found


def similar(docs: DataFrame, words: int, held: Held) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, components, links): classes_of(docs); node, component of those that have a similar one; the counted pairs."""
    classes = classes_of(docs, words, held)
    edges = _counted(held.stored(_printed(classes, held), "printed"), docs, classes, words, held)
    first = components(edges, held)
    found = held.stored(_near(_listed(classes)), "pairs")
    of = lambda k: first.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
    pairs = found.where("kind = 0").select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = held.stored(pairs.where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b"), "distinct")
    edges = edges.unionByName(_counted(pairs, docs, classes, words, held))
    groups = components(edges, held)
    many = found.where("kind > 0").select("kind", F.col("b").alias("token"), "block", F.col("a").alias("node"), "n", "i")
    many = held.stored(many.join(groups, "node", "left").select("kind", "token", "block", "node", "n", "i", F.coalesce("component", "node").alias("component")), "many")
    whole = many.where("kind = 1").select(F.col("token").alias("key"), F.lit(-1).alias("side"), "node", "n", "i", "component")
    # shingles all of whose rows are of one component are done
    mixed = whole.groupBy("key").agg(F.min("component").alias("from"), F.max("component").alias("to")).where(F.col("from") < F.col("to")).select("key")
    rows = whole.join(mixed, "key", "left_semi").unionByName(_met(many.where("kind = 2")).select(*whole.columns))
    rest = _apart(rows.join(classes.select("node", "parity"), "node"))
    rest = held.stored(rest.distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        edges = edges.unionByName(_counted(rest, docs, classes, words, held))
        groups = components(edges, held)
    return classes, groups, edges
