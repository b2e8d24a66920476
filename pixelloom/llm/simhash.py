"""SimHash near-duplicate groups by generalised pigeonhole search.

A document's fingerprint has a bit for each of 64 hash bits, set if more than half of its shingles' hashes set it. Two
fingerprints that differ in at most T bits, cut into partitions with thresholds t_i that satisfy sum(t_i + 1) = T + 1,
are within t_i in some partition i. Bits that move together in a sample are put into one partition; a dynamic program
gives each partition its threshold (-1: not searched) from the number of candidates that the sample lets expect. Every
distinct fingerprint is then written under its bits of each partition and under all values within t_i of them; those
that meet under one key are compared in full.

Only distinct fingerprints are searched; copies follow their class. A key's fingerprints are linked by a spanning forest,
not by all pairs. Keys with too many fingerprints are dealt again by exact pigeonhole over the bits not yet used, and what
is still too large is compared as pairs of bounded blocks, so that nothing is capped or left out. Connected components
come from alternating star contractions.

Defined cases: null or empty texts have the fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle; a null doc_id forms no smallest id (a class of nulls alone is named by a hash of its fingerprint);
repeated rows are rows of one class; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import Held, identity, removed, scratch, stored, text_or_empty, unwrapped, wrapped

SEED = 42
SAMPLE = 2048
LIMIT = 8192
ROW_COST = 400  # a row that is written, sent and sorted costs about as much as so many comparisons


def shingles(text: str, words: int) -> list[bytes]:
    """The text's word shingles, repeats included, of lower-cased (A-Z) UTF-8; bytes.split() parts at [\\x20\\x09-\\x0D]."""
    w = text.encode().lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return w if words == 1 else list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes of the blocks set; zero without hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(parts: list[bytes]) -> int:
    """The unsigned fingerprint; zero without shingles."""
    return majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts[a : a + (1 << 16)]], "<u8") for a in range(0, len(parts), 1 << 16))


def with_fingerprints(docs: DataFrame, words: int = 3, coarse: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), fp2. coarse: fp is taken over the distinct words, fp2 over the shingles;
    else fp is over the shingles and fp2 is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for t in batch.column(1).to_pylist():
                fine = fingerprint(shingles(t, words))
                a.append(fingerprint(list(set(shingles(t, 1)))) if coarse else fine)
                b.append(fine if coarse else 0)
            signed = lambda x: pa.array(np.array(x, "<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(a), signed(b)], names=["doc_id", "fp", "fp2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, "doc_id long, fp long, fp2 long")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits of about equal size; each grows from a bit by those most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0)
    norm = np.sqrt(np.square(bits).sum(0)) + 1e-9
    tie = np.abs(bits.T @ bits) / norm[:, None] / norm[None]
    left, parts = set(range(64)), []
    for i in range(m):
        part = [min(left)]
        left -= set(part)
        while len(part) < 64 * (i + 1) // m - 64 * i // m:
            best = max(left, key=lambda b: (tie[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def thresholds(sample: np.ndarray, parts: list[list[int]], distance: int, n: int) -> tuple[float, list[int]]:
    """(estimated cost, threshold of each partition). Cost: rows written plus pairs compared among n fingerprints."""
    masks = [mask_of(p) for p in parts]
    a, b = sample[: len(sample) // 2], sample[len(sample) // 2 : len(sample) // 2 * 2]
    pairs = max(1, len(a) * len(b))
    most = min(3, distance)
    cost = []
    for part, mask in zip(parts, masks, strict=True):
        seen = np.zeros(most + 1)
        for x in a:
            seen += np.bincount(np.minimum(np.bitwise_count((x ^ b) & mask), most + 1), minlength=most + 2)[: most + 1]
        near = np.maximum(seen.cumsum() / pairs, [_ball(len(part), r) / 2.0 ** len(part) for r in range(most + 1)])
        cost.append([0.0, *(n * _ball(len(part), r) * ROW_COST + n * (n / 2) * near[r] for r in range(most + 1))])
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for row in cost:  # by the number of errors that the partitions so far account for
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, t) in best[-1].items():
            for r in range(-1, most + 1):
                u = min(distance + 1, used + r + 1)
                if u not in step or c + row[r + 1] < step[u][0]:
                    step[u] = (c + row[r + 1], [*t, r])
        best.append(step)
    return best[-1].get(distance + 1, (float("inf"), []))


def _ball(width: int, radius: int) -> float:
    total, term = 0.0, 1.0
    for r in range(radius + 1):
        total += term
        term = term * (width - r) / (r + 1)
    return total


def mask_of(bits) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def plan(sample: np.ndarray, distance: int, n: int) -> list[tuple[int, list[int]]]:
    """[(mask, patterns to flip)] of the partitions to search, the cheapest over all numbers of partitions."""
    found = []
    for m in range(1, min(distance + 1, 8) + 1):
        parts = correlated_parts(sample, m)
        cost, t = thresholds(sample, parts, distance, n)
        if t:
            found.append((cost, m, parts, t))
    _, _, parts, t = min(found, key=lambda x: x[:2])
    out = []
    for part, r in zip(parts, t, strict=True):
        if r >= 0:
            flips = [sum(1 << b for b in c) for k in range(r + 1) for c in combinations(part, k)]
            out.append((int(mask_of(part)), flips))
    return out


_KEYED = "part long, key long, fp long, fp2 long, node long"


def _keys(classes: DataFrame, searched) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, (mask, flips) in enumerate(searched):
                values = fp & np.uint64(mask)
                for a in range(0, len(flips), 64):
                    some = np.array(flips[a : a + 64], np.uint64)
                    keys = (values[None] ^ some[:, None]).ravel()
                    take = pa.array(np.tile(np.arange(len(fp)), len(some)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int64)), pa.array(keys.view(np.int64)), *(c.take(take) for c in batch.columns)], names=["part", "key", "fp", "fp2", "node"])

    return classes.select("fp", "fp2", "node").mapInArrow(run, _KEYED)


def _near(a, a2, b, b2, distance, distance2):
    return (np.bitwise_count(a ^ b) <= distance) & (np.bitwise_count(a2 ^ b2) <= distance2)


def _forest(fp, fp2, node, distance, distance2):
    """Edges (node, node) that join all of a bucket's members that are linked, at most one fewer than the members."""
    left, edges = np.arange(len(fp)), []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            for a in range(0, len(front), step):
                f = front[a : a + step, None]
                reached |= _near(fp[f], fp2[f], fp[left], fp2[left], distance, distance2).any(0)
            front, left = left[reached], left[~reached]
            edges += [(node[seed], node[x]) for x in front]
    return edges


def _links(keyed: DataFrame, distance: int, distance2: int) -> DataFrame:
    """Edges among the rows that share (part, key); such groups are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def linked(rows):
            part, key, fp, fp2, node = rows
            fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)
            change = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.append(starts, len(part)))
            ends = np.repeat(starts + sizes, sizes)
            at, size = np.arange(len(part)), np.repeat(sizes, sizes)
            a, b = [], []
            for d in range(1, 9):
                i = at[(size <= 9) & (at + d < ends)]
                i = i[_near(fp[i], fp2[i], fp[i + d], fp2[i + d], distance, distance2)]
                a.append(node[i])
                b.append(node[i + d])
            for s, n in zip(starts[sizes > 9], sizes[sizes > 9], strict=True):
                e = _forest(fp[s : s + n], fp2[s : s + n], node[s : s + n], distance, distance2)
                if e:
                    x, y = np.array(e).T
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) if len(rows[0]) else np.zeros(0, bool)
            cut = int(np.argmax(last)) if last.any() else 0
            if cut:
                yield linked([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield linked(held)

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "a long, b long").where("a <> b")


def _again(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Rows of overfull keys under finer keys: the bits that their partition left over, in distance + 1 exact parts."""
    finer = []
    for mask in masks:
        rest = [b for b in range(64) if not mask >> b & 1]
        finer.append([int(mask_of(rest[len(rest) * j // (distance + 1) : len(rest) * (j + 1) // (distance + 1)])) for j in range(distance + 1)])
    signed = np.array(finer, np.uint64).view(np.int64).tolist()
    cut = F.array(*(F.array(*(F.lit(x) for x in row)) for row in signed))
    parts = rows.select("*", F.posexplode(F.element_at(cut, (F.col("part") + 1).cast("int"))).alias("j", "m"))
    return parts.select((F.col("part") * 64 + F.col("j")).alias("part"), F.xxhash64("key", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp", "fp2", "node")


def _in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of overfull keys under a key per pair of blocks of about LIMIT / 2 rows."""
    blocks = rows.join(sizes, ["part", "key"]).withColumn("blocks", F.ceil(F.col("count") * 2 / LIMIT).cast("long")).withColumn("block", F.pmod(F.xxhash64("fp", "fp2"), F.col("blocks")))
    pairs = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return pairs.select("part", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp", "fp2", "node")


def near_edges(classes: DataFrame, distance: int, distance2: int = 64) -> DataFrame:
    """(a, b), a > b: edges that connect the nodes of classes (fp, fp2, node) within the distances."""
    spark = classes.sparkSession
    n = classes.count()
    order = F.xxhash64("fp", "fp2", F.lit(7))
    sample = np.array([r[0] for r in classes.select("fp", order.alias("o")).orderBy("o").limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    if len(sample) < 2:
        return spark.createDataFrame([], "a long, b long")
    searched = plan(sample, distance, n)
    rows = _keys(classes, searched)
    edges = None
    for level in range(3):
        sizes = rows.groupBy("part", "key").count().where(F.col("count") > LIMIT)
        sizes = stored(sizes, "overfull")
        full = sizes.limit(1).count() > 0
        if not full:
            found = _links(rows, distance, distance2)
            return found if edges is None else edges.unionByName(found)
        fits = rows.join(sizes, ["part", "key"], "left_anti")
        found = _links(fits.select("part", "key", "fp", "fp2", "node"), distance, distance2)
        edges = found if edges is None else edges.unionByName(found)
        over = rows.join(sizes.drop("count"), ["part", "key"], "left_semi").select("part", "key", "fp", "fp2", "node")
        if level == 0:
            rows = _again(over, [m for m, _ in searched], distance)
        else:
            return edges.unionByName(_links(_in_blocks(over, sizes), distance, distance2))
    return edges


def components(edges: DataFrame, results: Held | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches, by large-star and small-star steps.

    The last step's table stays, or is left to results to remove.
    """
    spark = edges.sparkSession
    kept: list[str] = []

    def held(df: DataFrame) -> DataFrame:
        path = scratch(spark, "stars")
        df.write.parquet(path)
        kept.append(path)
        for old in kept[:-1]:
            removed(spark, old)
        del kept[:-1]
        return spark.read.schema("a long, b long").parquet(path)

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    now = held(edges.select("a", "b").distinct())
    before = None
    while (after := state(now)) != before:
        before = after
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = held(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
    if results is not None:
        results.paths += kept
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def near_groups(docs: DataFrame, words: int = 3, distance: int = 3, coarse: bool = False, distance2: int = 64) -> DataFrame:
    """doc_id, fp, fp2, component_id: a row per document."""
    prints = stored(with_fingerprints(docs, words, coarse), "prints")
    node = F.coalesce(F.min("doc_id"), F.xxhash64("fp", "fp2"))
    classes = stored(prints.groupBy("fp", "fp2").agg(node.alias("node")), "classes")
    found = components(near_edges(classes, distance, distance2))
    named = classes.join(found, "node", "left").select(F.col("fp").alias("f1"), F.col("fp2").alias("f2"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, (F.col("fp") == F.col("f1")) & (F.col("fp2") == F.col("f2"))).drop("f1", "f2")


def simhash_report(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = near_groups(docs, words, distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without near copies: of each group the document with the smallest id stays (of those, the smallest text hash).

    A link is a counted Jaccard similarity of at least 0.8 of the distinct shingles. Pairs come from the search of
    fingerprints; as these spread too far at 0.8 to find them all, jaccard.similar then searches by prefixes among what they
    left in different groups. A document is its id and its text: two texts under one id
    are two documents, and of rows that repeat both, one stays. Null ids come after all others. Texts of any length are
    compared whole; texts without words are equal to each other; an empty table gives an empty result.
    """
    from pixelloom.llm import jaccard

    held = Held(docs.sparkSession)
    classes, found, _ = jaccard.similar(docs, words, held)
    named = classes.join(found, "node", "left").select("first", F.coalesce("component", "node").alias("component_id"))
    keep = stored(named.groupBy("component_id").agg(F.min("first").alias("first")).select("first.*"), "keep")
    held.close()
    rows = wrapped(docs, *identity(F.col("doc_id"), F.col("text"))).join(keep, jaccard.ID, "left_semi")
    plain = [F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind]
    order = Window.partitionBy(*jaccard.ID).orderBy(F.xxhash64(*plain))
    return unwrapped(rows.withColumn("__n", F.row_number().over(order)).where("__n = 1"), docs.columns)
