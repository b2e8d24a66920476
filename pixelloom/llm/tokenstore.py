"""Token ids in a content-addressed store.

Each document becomes a stream of token ids, ended by an end id. A rolling hash over the last WINDOW ids cuts the stream
into chunks at places that depend on content alone, so that copies and near copies cut alike. A folder holds

- rows/kind=1/: every distinct chunk once, under its BLAKE2b-128 digest, ids as little-endian integers of ``width`` bytes;
- recipes/: in ascending doc_id order, each document's list of digests, number of ids, and the Merkle root of its list;
- manifest/: one row per recipe file: documents, ids, and the root of a Merkle tree over the documents' roots.

Reading joins recipes to chunks by digest, checks every chunk against its digest and every list against its root, and takes
the places of files from the manifest; verify_manifest checks the files themselves against it.

Defined cases: null text is empty (the end id alone); a text of any length is one document, held whole in its task; a null
doc_id sorts first; rows that repeat a doc_id are documents
each, in the order of their roots; other columns are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import removed, text_or_empty

WINDOW, MEAN_IDS, LEAST_IDS, MOST_IDS = 12, 256, 64, 4096
CACHE_PIECES = 1_500_000  # about 300 MB in a worker
#: Letters and signs on which all patterns agree.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-/:-@\\[-`{-~"
#: A unit starts where white space follows other text, after a single newline before text, and where a sign follows a
#: letter; no token of a byte-level BPE of words, numbers and signs reaches over such a place.
_UNIT = re.compile(rf"\n(?=[^ \n])|[ \n]*[{_LETTERS}]+(?![^ \n{_SIGNS}])|[ \n]*[^ \n]+|[ \n]+")
_WORD = re.compile(f"[{_LETTERS}]+")
#: Other characters that some pattern may hold for white space, and the mark of exact keys; texts with them are encoded whole.
_OTHER_BLANKS = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
EXACT = "\0"  # a key that begins so stands for the rest of it; any other for itself after a space
_cached: dict = {}


class _Places(dict):
    """key -> its number; a new key gets the next one and is listed in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Ids of whole texts, with a bounded cache of the pieces (words between blanks) that texts are made of.

    Pieces are put together only for a byte-level BPE with its own split into words, and only in texts without characters
    that such a split may treat otherwise; any other tokenizer or text is encoded whole.
    """

    def __init__(self, path: str, width: int, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.end_id = Tokenizer.from_file(path), f"<u{width}", end_id
        if max(self.tokenizer.get_vocab_size() - 1, end_id) >= 1 << 8 * width:
            raise ValueError(f"the ids of {path} need more than {width} bytes")
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_pieces = made["model"]["type"] == "BPE" and made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        #: Whether a token begins with the space of a byte-level vocabulary.
        self.opens = np.zeros(1 << 8 * width if width < 3 else self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.places = _Places()
        self.first, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, self.kind), 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def keys(self, text: str) -> str | list[str] | None:
        """Pieces that stand for the text, as a list or with spaces between them, or None if it is to be encoded whole."""
        if not self.by_pieces or _OTHER_BLANKS.search(text) or any(s in text for s in self.special):
            return None
        marked = text.replace("\n", " \n")
        if "  " in marked or "\n " in marked or marked[:1] == " " or marked[-1:] in (" ", "\n"):
            return [EXACT + u for u in _UNIT.findall(text)]  # runs of blanks
        return EXACT + marked

    def _numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces with these numbers on end, and the end of each."""
        each = self.size[at]
        ends = np.cumsum(each)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[at] - (ends - each), each)], ends

    def _keep(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes down the ids of the pieces with these numbers."""
        most = int(at.max(initial=-1)) + 1
        if most > len(self.size):
            self.first, self.size = (np.concatenate((x, np.zeros(max(most, len(x)), np.int64))) for x in (self.first, self.size))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(ids), len(self.pool)), self.kind)))
        self.size[at], self.first[at] = sizes, self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of new pieces: a word after a space, another unit by itself, or units on end, which are pieces of their own."""
        letters = _WORD.fullmatch
        words, other, split, counts, units = [], [], [], [], []  # words, others and compounds by number

        def take(begin: int, new: list[str], compounds: bool) -> None:
            for n, k in enumerate(new, begin):
                if letters(k):
                    words.append((n, k))
                    continue
                if compounds:
                    parts = _UNIT.findall(k[1:] if k[0] == EXACT else k if k[0] == "\n" else " " + k)
                    parts = [u[1:] if u[0] == " " and letters(u, 1) else EXACT + u for u in parts]
                    if parts != [k]:
                        split.append(n)
                        counts.append(len(parts))
                        units.extend(parts)
                        continue
                other.append((n, k))

        new, self.places.new = self.places.new, []
        take(len(self.places) - len(new), new, True)
        composed = self._numbers(units)
        new, self.places.new = self.places.new, []  # units that were no pieces before
        take(len(self.places) - len(new), new, False)
        for a in range(0, len(words), 1000):  # in one text: no token but a word's first begins with a space
            at, some = zip(*words[a : a + 1000], strict=True)
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            self._keep(np.array(at), ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        for a in range(0, len(other), 4096):
            at, some = zip(*other[a : a + 4096], strict=True)
            found = self._direct([k[1:] for k in some])
            self._keep(np.array(at), np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // int(self.kind[-1]))
        if split:
            ids, ends = self._gathered(composed)
            self._keep(np.array(split), ids, np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each with the end id after it, and how many each has."""
        if len(self.places) > CACHE_PIECES:
            self.clear()
        split = [self.keys(t) for t in texts]
        spaced = pc.split_pattern(pa.array([k for k in split if isinstance(k, str)], pa.large_string()), " ")
        pieces = spaced.flatten().dictionary_encode()
        lists = [k for k in split if isinstance(k, list)]
        # numbers of the pieces of spaced texts, then of listed ones
        at = np.concatenate((self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()], self._numbers([x for k in lists for x in k])))
        ends, more = spaced.offsets.to_numpy().astype(np.int64), len(pieces) + np.concatenate(([0], np.cumsum([len(k) for k in lists], dtype=np.int64)))
        if self.places.new:
            self._learn()
        ids, upto = self._gathered(at)
        upto = np.concatenate(([0], upto))
        first, then = [np.array([upto[x[:-1]], upto[x[1:]]]).T.tolist() for x in (ends, more)]
        whole = iter(self._direct([t for t, k in zip(texts, split, strict=True) if k is None]))
        spans, listed, end, out = iter(first), iter(then), np.array([self.end_id], self.kind), []
        for k in split:
            if k is None:
                out.append(np.frombuffer(next(whole), self.kind))
            else:
                a, b = next(spans if isinstance(k, str) else listed)
                out.append(ids[a:b])
            out.append(end)
        return np.concatenate(out), np.fromiter(map(len, out[::2]), np.int64, len(texts)) + 1


def encoder(path: str, width: int, end_id: int) -> Encoder:
    """One per Python worker."""
    if (path, width, end_id) not in _cached:
        _cached[path, width, end_id] = Encoder(path, width, end_id)
    return _cached[path, width, end_id]


def cuts(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Ends of the chunks of each of several streams that lie on end in ids.

    A chunk has LEAST_IDS ids at least, more than the window, so that the stream before has no say in a stream's cuts.
    """
    n = len(ids)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        # sums over 1, 2, 4, ... ids before, put together by the bits of WINDOW
        rolled, seen, weight, width, done = np.zeros(n, np.uint64), mixed, np.uint64(0xBF58476D1CE4E5B9), 1, 0
        step = np.uint64(1)
        while width <= WINDOW:
            if WINDOW & width and done < n:
                rolled[done:] += seen[: n - done] * step
                done, step = done + width, step * weight
            if 2 * width <= WINDOW and width < n:
                seen = np.concatenate((seen[:width], seen[width:] + seen[:-width] * weight))
            width, weight = 2 * width, weight * weight
    wanted = np.flatnonzero(rolled >> np.uint64(40) & np.uint64(MEAN_IDS - 1) == 0) + 1  # MEAN_IDS: a power of two
    out, begin = [], 0
    for size in sizes:
        a, b = np.searchsorted(wanted, (begin, begin + size))
        ends, last = [], 0
        for end in [*(wanted[a:b] - begin).tolist(), size]:
            while end - last > MOST_IDS:
                last += MOST_IDS
                ends.append(last)
            if end - last >= LEAST_IDS or end == size and end > last:
                ends.append(end)
                last = end
        out.append(ends)
        begin += size
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(nodes: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and inner nodes are hashed with different marks, an odd node moves up."""
    level = [digest(b"\0" + x) for x in nodes] or [digest(b"")]
    while len(level) > 1:
        pairs = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


class Tree:
    """merkle() of leaves that are added one by one; holds a node a level."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, digest(b"\0" + leaf)
        while self.peaks and self.peaks[-1][0] == level:
            node = digest(b"\1" + self.peaks.pop()[1] + node)
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        if not self.peaks:
            return digest(b"")
        node = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            node = digest(b"\1" + left + node)
        return node


_ROWS = "kind int, key long, hash binary, ids binary, doc_id long, n_tokens long, root binary, hashes array<binary>"
_SEEN = 500_000


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2) -> None:
    """Texts are encoded once: recipes and chunks leave the tasks as rows of two kinds and go through one shuffle.

    A task sends a chunk once as long as it remembers it, so that a chunk that many documents share has about a row a task.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, seen = encoder(tokenizer, width, end_id), set()
        key = lambda h: int.from_bytes(h[:8], "little", signed=True)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                rows, (ids, sizes) = [], encoding.encode(batch.column(1).to_pylist())
                data, sizes, begin = ids.tobytes(), sizes.tolist(), 0
                for doc_id, size, ends in zip(batch.column(0).to_pylist(), sizes, cuts(ids, sizes), strict=True):
                    parts = [data[(begin + b) * width : (begin + e) * width] for b, e in zip([0, *ends], ends, strict=False)]
                    begin += size
                    hashes = [digest(x) for x in parts]
                    root = merkle(hashes)
                    rows.append((0, key(digest(root + str(doc_id).encode())), None, None, doc_id, size, root, hashes))
                    for h, x in zip(hashes, parts, strict=True):
                        if h not in seen:
                            seen.add(h)
                            rows.append((1, key(h), h, x, None, None, None, None))
                if len(seen) > _SEEN:
                    seen.clear()
                if rows:
                    yield batch_of(rows)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of chunks in order of their digests the first of each; recipes as they come."""
        last = None
        for batch in batches:
            kept = []
            for i, h in enumerate(batch.column(2).to_pylist()):
                if h is None or h != last:
                    kept.append(i)
                last = h
            yield batch.take(pa.array(kept, pa.int64()))

    sent = docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(encode, _ROWS)
    sorted_rows = sent.repartition(n_parts, "key").sortWithinPartitions("kind", "hash")
    sorted_rows.mapInArrow(unique, _ROWS).drop("key").write.partitionBy("kind").parquet(f"{path}/rows")
    recipes = _rows(spark, path, 0).select("doc_id", "n_tokens", "root", "hashes")
    ordered = recipes.repartitionByRange(n_parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the file's number and the ids before each document in that file."""
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), *batch.columns], names=["part", "start_in_part", *batch.schema.names])

    ordered.mapInArrow(numbered, "part int, start_in_part long, doc_id long, n_tokens long, root binary, hashes array<binary>").write.parquet(f"{path}/recipes")
    _manifest(spark, path).write.parquet(f"{path}/manifest")
    removed(spark, f"{path}/rows/kind=0")


def _rows(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema("hash binary, ids binary, doc_id long, n_tokens long, root binary, hashes array<binary>, kind int").parquet(f"{path}/rows").where(F.col("kind") == kind)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, 1).select("hash", "ids")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per recipe file: its documents, their ids, and the root of a Merkle tree over their roots, in order."""
    recipes = spark.read.parquet(f"{path}/recipes")

    def manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, n_docs, n_tokens = None, Tree(), 0, 0
        row = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "root": [tree.root()]})
        for batch in batches:
            for p, n, root in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield row()
                    part, tree, n_docs, n_tokens = p, Tree(), 0, 0
                tree.add(root)
                n_docs, n_tokens = n_docs + 1, n_tokens + n
        if part is not None:
            yield row()

    by_file = recipes.select("part", "start_in_part", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start_in_part")
    return by_file.mapInArrow(manifest, "part int, n_docs long, n_tokens long, root binary")


def verify_manifest(spark: SparkSession, path: str, n_docs: int | None = None) -> None:
    """Raises ValueError if a recipe file differs from its manifest row, or if the store doesn't hold n_docs documents."""
    read = lambda df: sorted(map(tuple, df.select("part", "n_docs", "n_tokens", "root").collect()))  # noqa: E731  a row a file
    written = read(spark.read.parquet(f"{path}/manifest"))
    if written != read(_manifest(spark, path)):
        raise ValueError(f"the recipes of {path} differ from their manifest")
    if n_docs is not None and sum(r[1] for r in written) != n_docs:
        raise ValueError(f"{path} does not hold all documents")


def recipes_with_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, root, hashes. The manifest has a row per recipe file, so the offsets stay few."""
    files = sorted((r["part"], r["n_tokens"]) for r in spark.read.parquet(f"{path}/manifest").select("part", "n_tokens").collect())
    offsets, before = [], 0
    for part, n in files:
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return spark.read.parquet(f"{path}/recipes").join(starts, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "root", "hashes")


def read_store(spark: SparkSession, path: str, width: int = 2, fold=None, schema: str = "ids array<long>") -> DataFrame:
    """doc_id, start, n_tokens and what fold makes of each document's ids (numpy array), by default the ids themselves.

    start, which no two documents share, brings a document's chunks together; they are joined in order as they stream by.
    """
    fold = fold or (lambda ids: (ids.tolist(),))
    recipes = recipes_with_starts(spark, path)
    wanted = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("seq", "hash"))
    found = wanted.join(read_chunks(spark, path), "hash", "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = found.select("doc_id", "start", "n_tokens", "root", "seq", "hash", "ids").repartition(n, "start").sortWithinPartitions("start", "seq")
    names = [x.split()[0] for x in schema.split(", ")]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, hashes, parts = [], None, [], []

        def closed():
            ids = np.frombuffer(b"".join(parts), f"<u{width}")
            if merkle(hashes) != now[3] or len(ids) != now[2]:
                raise ValueError(f"document {now[0]} differs from its recipe")
            return (*now[:3], *fold(ids))

        for batch in batches:
            for doc_id, start, n_tokens, root, _, name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[1] != start:
                    if now is not None:
                        out.append(closed())
                    now, hashes, parts = (doc_id, start, n_tokens, root), [], []
                if ids is None or digest(ids) != name:
                    raise ValueError(f"a chunk of document {doc_id} is missing or damaged")
                hashes.append(name)
                parts.append(ids)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pydict(dict(zip(["doc_id", "start", "n_tokens", *names], map(list, zip(*out, strict=True)), strict=True)))
                out = []
        if now is not None:
            out.append(closed())
        if out:
            table = dict(zip(["doc_id", "start", "n_tokens", *names], map(list, zip(*out, strict=True)), strict=True))
            table["doc_id"] = pa.array(table["doc_id"], pa.int64())
            yield pa.RecordBatch.from_pydict(table)

    return lined.mapInArrow(assemble, f"doc_id long, start long, n_tokens long, {schema}")


def crc_shift(length: int, known: dict[int, list[int]] = {}) -> list[int]:  # noqa: B006
    """What each bit of a CRC-32 becomes when length zero bytes follow."""
    if length not in known:
        if length == 0:
            return [1 << i for i in range(32)]
        half = crc_shift(length // 2)
        columns = [_apply(half, x) for x in half]
        if length & 1:
            columns = [_apply(_BYTE, x) for x in columns]
        known[length] = columns
    return known[length]


def _apply(columns: list[int], crc: int) -> int:
    out, i = 0, 0
    while crc:
        if crc & 1:
            out ^= columns[i]
        crc >>= 1
        i += 1
    return out


def _zero_byte(crc: int) -> int:
    for _ in range(8):
        crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


_BYTE = [_zero_byte(1 << i) for i in range(32)]


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings on end, from theirs and the second one's length."""
    return _apply(crc_shift(length), first) ^ second


def read_checksums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) as read from the store.

    Each distinct chunk is read, checked and summed once; documents put their chunks' sums together by their recipes, so
    that no ids move.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(digest(x) != h for h, x in zip(hashes, rows, strict=True)):
                raise ValueError("a chunk is damaged")
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array([len(x) // width for x in rows], pa.int32())], names=["hash", "crc", "n"])

    chunks = read_chunks(spark, path).mapInArrow(summed, "hash binary, crc long, n int")
    wanted = recipes_with_starts(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("seq", "hash"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = wanted.join(chunks, "hash", "left").select("doc_id", "start", "n_tokens", "root", "seq", "hash", "crc", "n").repartition(n_parts, "start").sortWithinPartitions("start", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, hashes, crc, ids = [], None, [], 0, 0

        def closed():
            if merkle(hashes) != now[3] or ids != now[2]:
                raise ValueError(f"document {now[0]} differs from its recipe")
            out.append((*now[:3], crc))

        def flushed():
            columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for doc_id, start, n_tokens, root, _, name, part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[1] != start:
                    if now is not None:
                        closed()
                    now, hashes, crc, ids = (doc_id, start, n_tokens, root), [], 0, 0
                if part is None:
                    raise ValueError(f"a chunk of document {doc_id} is missing")
                hashes.append(name)
                crc, ids = crc_joined(crc, part, 4 * n), ids + n
            if len(out) >= 5000:
                yield flushed()
        if now is not None:
            closed()
        if out:
            yield flushed()

    return lined.mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_report(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the store and reads it back: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids).

    The written recipes are held against the manifest first, and the number of their documents against docs. Sums come
    from the chunks as read (read_checksums): CRC-32 of parts on end follows from the parts' sums and lengths, so the ids
    of a document are not moved into one place for it; read_store does that.
    """
    write_store(docs, path, tokenizer, end_id)
    verify_manifest(docs.sparkSession, path, docs.count())
    return read_checksums(docs.sparkSession, path)
