"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become sequences of word hashes (letters and digits, lower case). Places where a document
shares a run of ``least`` words with an item are seeds. An item whose seeds cover enough of its words is tiled against the
document: of all unmarked common runs the longest is marked in both, again and again, until none of ``least`` words is
left; Karp-Rabin hashes of runs, halved in length whenever none is left, find the long ones first. A document is
contaminated by an item if tiles cover at least ``coverage`` of the item's words, in whatever order they stand.

The benchmark goes to the tasks in blocks of at most ``block_words`` words and one item, one block after the other (a larger
benchmark takes more passes over the documents), so that what is sent is bounded and documents are never shuffled; a task
works on one document at a time.

Defined cases: null and empty texts match nothing, and items without words take no part; items shorter than ``least``
words must stand whole; a text of any length is searched whole; repeated item rows are searched once and give a row each; a null doc_id or item_id is carried through; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import Held, scratch, stored, text_or_empty
from pixelloom.plans.running import running_sum

LEAST, COVERAGE, BLOCK_WORDS = 5, 0.6, 2_000_000
_WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15


_hash_of: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    if len(_hash_of) > 300_000:
        _hash_of.clear()
    out = []
    for w in _WORD.findall(text.lower()):
        h = _hash_of.get(w)
        if h is None:
            h = _hash_of[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of length words at each place where one fits (Karp-Rabin, modulo 2^64, from prefix sums)."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - length + 1, np.uint64)
        done, width, piece = 0, 1, words
        # binary powers: hashes of runs of 1, 2, 4, ... words, put together by the bits of length
        step = np.uint64(BASE)
        while width <= length:
            if length & width:
                part = piece[done : done + len(out)]
                out = out * step + part if done else part.copy()
                done += width
            if width * 2 > length:
                break
            piece = piece[: len(piece) - width] * step + piece[width:]
            step, width = step * step, width * 2
    return out ^ (out >> np.uint64(31))


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of the greedy tiling; longer first, then by place in the document, in the item."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    found = []
    length = min(len(doc), len(item))
    while length >= least:
        a, b = _free_runs(free_doc, length), _free_runs(free_item, length)
        if len(a) and len(b):
            ha, hb = run_hashes(doc, length)[a], run_hashes(item, length)[b]
            a = a[np.isin(ha, hb)]
        else:
            a = a[:0]
        if not len(a):
            # nothing of this length: below it, try the length halfway to the least
            length = length - 1 if length <= 2 * least else max(least, length // 2)
            continue
        best = _longest(doc, item, free_doc, free_item, a, b, length)
        if best[2] > length:  # a search at a shorter length has met a longer run: mark the longest
            length = best[2]
        i, j, n = best
        free_doc[i : i + n] = False
        free_item[j : j + n] = False
        found.append(best)
    return found


def _free_runs(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of length unmarked words."""
    if len(free) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(sums[length:] - sums[:-length] == length)


def _longest(doc, item, free_doc, free_item, a, b, length):
    """The longest unmarked common run that starts with one of the given runs of this length."""
    at = {}
    for j, h in zip(b.tolist(), run_hashes(item, length)[b].tolist(), strict=True):
        at.setdefault(h, []).append(j)
    best = (0, 0, 0)
    for i, h in zip(a.tolist(), run_hashes(doc, length)[a].tolist(), strict=True):
        for j in at.get(h, ()):
            n, most = length, min(len(doc) - i, len(item) - j)
            if best[2] >= most:
                continue
            more = (doc[i + n : i + most] == item[j + n : j + most]) & free_doc[i + n : i + most] & free_item[j + n : j + most]
            n += int(np.argmin(more)) if not more.all() else len(more)
            if n > best[2]:
                best = (i, j, n)
    return best


class Items:
    """A block of the benchmark and the index of its seeds."""

    def __init__(self, rows: list[tuple], least: int):
        self.items = [(item_id, w, copies) for item_id, text, copies in rows if len(w := word_hashes(text or ""))]
        self.least = least
        keys: dict[int, list] = {}
        for no, (_, w, _) in enumerate(self.items):
            k = min(least, len(w))
            h = run_hashes(w, k)
            keys.setdefault(k, []).append((h, np.full(len(h), no), np.arange(len(h))))
        self.seeds = {}
        for k, parts in keys.items():
            h, no, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], no[order], at[order])

    def matches(self, doc: np.ndarray, coverage: float) -> Iterator[tuple[int, list]]:
        """(number of the item, its tiles) of each item that the document covers."""
        for k, (h, no, at) in self.seeds.items():
            mine = np.unique(run_hashes(doc, k))
            first, end = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            hit = end > first
            if not hit.any():
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in zip(first[hit], end[hit], strict=True)])
            owner, place = no[rows], at[rows]
            for item in np.unique(owner).tolist():
                w = self.items[item][1]
                seeded = np.zeros(len(w), bool)
                for d in range(k):
                    seeded[place[owner == item] + d] = True
                # tiles lie within seeds, so these words are the most that can be covered
                if seeded.sum() >= coverage * len(w):
                    found = tiles(doc, w, k)
                    if sum(n for _, _, n in found) >= coverage * len(w):
                        yield item, found


_SCHEMA = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles int, longest_tile int"


def _blocks(benchmark: DataFrame, least: int, block_words: int) -> Iterator[Broadcast]:
    """The benchmark's distinct items in blocks of at most block_words words and one item, one sent at a time."""
    spark = benchmark.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sum(1 for _ in _WORD.finditer(t.lower())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64())], names=["item_id", "text", "copies", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    held = Held(spark)
    sized = held.stored(items.mapInArrow(count, "item_id long, text string, copies long, words long").where("words > 0"), "items")
    total = sized.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    if total > block_words:
        keyed = sized.withColumn("h", F.xxhash64("item_id", "text"))
        upto = running_sum(keyed, ["h", "item_id", "text"], F.col("words"), "upto")
        sized = held.stored(upto.withColumn("block", F.floor((F.col("upto") - F.col("words")) / block_words)).drop("h", "upto"), "blocks")
        n = -(-total // block_words)
    else:
        n, sized = 1, sized.withColumn("block", F.lit(0).cast("long"))
    for b in range(n):
        rows = [(r["item_id"], r["text"], r["copies"]) for r in sized.where(F.col("block") == b).select("item_id", "text", "copies").collect()]
        if rows:
            yield spark.sparkContext.broadcast(Items(sorted(rows, key=lambda r: (r[0] is None, r)), least))
    held.close()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and item that it covers: doc_id, item_id, words of the item, covered words, their share, tiles."""
    spark = docs.sparkSession
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    path, first = None, None
    for block in _blocks(benchmark, least, block_words):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value
            for batch in batches:
                out = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for item, found in items.matches(word_hashes(text), coverage):
                        item_id, w, copies = items.items[item]
                        covered = sum(x for _, _, x in found)
                        out += [(doc_id, item_id, len(w), covered, covered / len(w), len(found), found[0][2])] * copies
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                    names = [x.split()[0] for x in _SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        found = asked.mapInArrow(run, _SCHEMA)
        if first is None:
            first = (found, block)
            continue
        if path is None:  # of several blocks each is written before the next is sent
            path = scratch(spark, "pairs")
            first[0].write.parquet(path)
            first[1].unpersist()
        found.write.mode("append").parquet(path)
        block.unpersist()
    if first is None:
        return spark.createDataFrame([], _SCHEMA)
    return first[0] if path is None else spark.read.schema(_SCHEMA).parquet(path)


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the contaminated ones; columns as they came.

    Each row is judged by its own text, so that rows that share an id, and rows without one, stay or go by themselves, and
    nothing is shuffled. Of several blocks each but the last is written before the next is sent.
    """

    def clean(block):
        def run(batches):
            items = block.value
            for texts in batches:
                yield pd.Series([next(items.matches(word_hashes(t), coverage), None) is None for t in texts], dtype=bool)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "boolean")

    left, before = docs, None
    for block in _blocks(benchmark, least, block_words):
        if before is not None:
            left = stored(left, "clean")
            before.unpersist()
        left, before = left.where(clean(block)(text_or_empty())), block
    return left


def worst_items(pairs: DataFrame, k: int = 1) -> DataFrame:
    """Of each document the k items that it covers most."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("coverage"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
