"""An n-gram language model of order 3 in Elias-Fano tries, built and queried by Spark tasks.

Level 1 holds the distinct words of the training documents, as sorted 64-bit hashes whose rank is the word's id, with
exact counts as differences of a running sum. Level 2 holds, for each word as context, the ids of the words that follow
it: a monotone sequence of pointers marks each context's range, and the successors are stored relative to the range
before, so that the whole level rises and a search in a context is one successor search from the range's base. Level 3
holds the words that follow each pair in the same way; a pair's place in level 2 is its context. Probabilities and the
weights of shorter contexts are quantised to 256 values a file. Levels 2 and 3 are cut into files of bounded size, in order
of the mass that comes before a pair under independence, so that a frequent context takes as many files as its pairs need.
Tasks map the files into memory (a store without local paths is read instead; at most OPEN_BYTES of it stay) and ask for
their documents' pairs and triples in sorted batches. A file's blocks of counts are summed by ranges of pairs, PIECE entries at a time.

Smoothing is Bayesian with Dirichlet priors: p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu), with p(w) = (c(w) + 0.5) /
(N + 0.5 (V + 1)), and p(w | u v) = (c(u v w) + mu3 p(w | v)) / (c(u v) + mu3). The end token opens a text: its first word
has that one word of context. All pairs and triples of all training documents are counted, none is pruned; counts are
summed in tasks before they move.

Defined cases: null text is empty (the end token alone); a text of any length is one sequence, held whole in its task; a
null doc_id is held as empty text for the split; repeated rows are documents each; unknown words have p(w) with c = 0 and,
as contexts, add nothing; without training documents N and V are 0; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import eliasfano
from pixelloom.llm.common import file_system, held_in, scratch, stored, text_or_empty

END = b"\n"  # no word holds white space
TOKENS_A_FILE = 4_000_000
TOKENS_A_BATCH = 600_000
OPEN_BYTES = 1 << 29
BYTES_A_SLICE = 1 << 18
PIECE = 1 << 19
SIGN = 1 << 63


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words): [^\\x20\\x09-\\x0D] with A-Z lowered, without end tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return np.diff(before[lists.offsets.to_numpy()]), words.filter(some)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def _save(path: str, name: str, *parts: bytes) -> int:
    """Writes a file under its name once it is complete; a task that runs again writes the same file."""
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    fs.move(part, f"{folder}/{name}")
    return sum(map(len, parts))


def _load(path: str, name: str):
    from pyarrow.fs import LocalFileSystem

    fs, folder = file_system(path)
    if isinstance(fs, LocalFileSystem):
        return np.memmap(f"{folder}/{name}", np.uint8, "r")
    with fs.open_input_stream(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(256 values, code of each): the values are means of bins of equal width, so that no value moves by more than one."""
    if not len(values):
        return np.zeros(256), np.zeros(0, np.uint8)
    least, most = values.min(), values.max()
    scale, codes = 256 / max(most - least, 1e-12), np.empty(len(values), np.uint8)
    sums, counts = np.zeros(256), np.zeros(256, np.int64)
    for a in range(0, len(values), 1 << 18):
        part = values[a : a + (1 << 18)]
        code = np.minimum(((part - least) * scale).astype(np.int64), 255)
        sums += np.bincount(code, part, 256)
        counts += np.bincount(code, minlength=256)
        codes[a : a + (1 << 18)] = code
    return np.where(counts > 0, sums / np.maximum(counts, 1), 0.0), codes


class Words:
    """Level 1: ids, counts and probabilities of words."""

    def __init__(self, path: str, files: list[tuple[str, int, int, int]], total: int, words: int):
        self.total, self.size = total, words
        self.firsts = np.array([f[1] for f in files], np.uint64)
        self.bases = np.array([f[2] for f in files], np.int64)
        self.before = np.array([f[3] for f in files], np.int64)
        self.files = []
        for name, *_ in files:
            buffer = _load(path, name)
            hashes = eliasfano.Sequence(buffer)
            sums = eliasfano.Sequence(buffer, hashes.end)
            table = np.frombuffer(buffer, "<f8", 256, sums.end)
            self.files.append((hashes, sums, table, np.frombuffer(buffer, np.uint8, hashes.n, sums.end + 2048)))
        self.end = int(self.ids(pa.array([END]))[0])
        self.unseen = np.log10(0.5 / (total + 0.5 * (words + 1)))

    def _each(self, keys: np.ndarray, starts: np.ndarray):
        """(file, positions among keys) for keys sorted into the files' ranges."""
        at = np.searchsorted(starts, keys, "right") - 1
        for f in np.unique(at[at >= 0]):
            yield int(f), np.flatnonzero(at == f)

    def ids(self, words: pa.Array) -> np.ndarray:
        """The ids of distinct words, -1 for unknown ones."""
        hashes = _hashes(words)
        found = np.full(len(words), -1, np.int64)
        order = np.argsort(hashes)
        for f, some in self._each(hashes[order], self.firsts):
            at, sequence = order[some], self.files[f][0]
            rank = sequence.rank(hashes[at]) - 1
            hit = rank >= 0
            hit[hit] = sequence.get(rank[hit]) == hashes[at[hit]]
            found[at[hit]] = self.bases[f] + rank[hit]
        return found

    def facts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all smaller ids, count, quantised log10 p) of ids; an id of -1 is unknown."""
        before, count, p = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), self.unseen)
        for f, some in self._each(ids, self.bases):
            some = some[ids[some] >= 0]
            _, sums, table, codes = self.files[f]
            i = ids[some] - self.bases[f]
            to = sums.get(i).astype(np.int64)
            begin = np.where(i > 0, sums.get(np.maximum(i - 1, 0)).astype(np.int64), 0)
            before[some], count[some], p[some] = self.before[f] + begin, to - begin, table[codes[i]]
        return before, count, p

    def at_mass(self, mass: np.ndarray) -> np.ndarray:
        """The id of the word in whose tokens this position of the running sum lies."""
        out = np.zeros(len(mass), np.int64)
        for f, some in self._each(mass, self.before):
            out[some] = self.bases[f] + self.files[f][1].rank((mass[some] - self.before[f]).astype(np.uint64))
        return np.minimum(out, max(0, self.size - 1))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _rising(sizes: np.ndarray, word: np.ndarray) -> tuple[bytes, bytes]:
    """A level out of the contexts' numbers of words and these, sorted in each: pointers to ranges, and words above the range before."""
    pointers, rising, base = np.zeros(len(sizes) + 1, np.uint64), np.empty(len(word), np.uint64), np.uint64(0)
    np.cumsum(sizes, dtype=np.uint64, out=pointers[1:])
    for a in range(0, len(sizes), 1 << 18):
        some = a + np.flatnonzero(sizes[a : a + (1 << 18)])
        if len(some):
            end = pointers[some + 1].astype(np.int64)
            piece = slice(int(pointers[some[0]]), int(end[-1]))
            tops = word[end - 1].astype(np.uint64) + np.uint64(1)
            ends = base + np.cumsum(tops)
            rising[piece] = np.repeat(ends - tops, sizes[some]) + word[piece] + np.uint64(1)
            base = ends[-1]
    return eliasfano.encode(pointers, len(word) + 1), eliasfano.encode(rising, int(base) + 1)


class Level:
    """Pointers and words of a level as read; find() is a successor search from a context's base."""

    def __init__(self, buffer, offset: int):
        self.pointers = eliasfano.Sequence(buffer, offset)
        self.rising = eliasfano.Sequence(buffer, self.pointers.end)
        self.end = self.rising.end

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of (context, word), context sorted; -1 for those that are not there."""
        out = np.full(len(context), -1, np.int64)
        inside = np.flatnonzero(context < self.pointers.n - 1)
        if not len(inside) or not self.rising.n:
            return out
        context = context[inside]
        new = np.concatenate(([True], context[1:] != context[:-1]))
        where, some = new.cumsum() - 1, context[new]
        begin, end = self.pointers.get(some).astype(np.int64), self.pointers.get(some + 1).astype(np.int64)
        base = np.where(begin > 0, self.rising.get(np.maximum(begin - 1, 0)), 0).astype(np.uint64)
        target, size, at = base[where] + word[inside].astype(np.uint64) + np.uint64(1), (end - begin)[where], begin[where]
        many = np.flatnonzero(size > 1)  # a range of one needs no search
        at[many] = self.rising.rank(target[many]) - 1
        hit = (size > 0) & (at >= begin[where]) & (at < end[where])
        hit[hit] = self.rising.get(at[hit]) == target[hit]
        out[inside[hit]] = at[hit]
        return out


def _values(buffer, offset: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(256 values, codes of n entries, end)."""
    return np.frombuffer(buffer, "<f8", 256, offset), np.frombuffer(buffer, np.uint8, n, offset + 2048), offset + 2048 + n


def _bytes_of(values: np.ndarray) -> list[bytes]:
    table, codes = quantised(values)
    return [table.astype("<f8").tobytes(), codes.tobytes()]


class Grams:
    """Levels 2 and 3: in which file a pair and the words after it lie, and their quantised numbers."""

    def __init__(self, path: str, words: Words):
        self.path, self.words, self.n = path, words, max(1, -(-words.total // TOKENS_A_FILE))
        self.bases = words.at_mass(np.arange(self.n, dtype=np.int64) * words.total // self.n) if words.total else np.zeros(1, np.int64)
        self.open: dict[int, tuple | None] = {}
        self.bytes = 0

    def place(self, first: np.ndarray, second: np.ndarray, facts1, facts2) -> tuple[np.ndarray, np.ndarray]:
        """(file, code in that file) of known pairs; codes rise with (first, second)."""
        total = max(1, self.words.total)
        mass = facts1[0] + facts1[1] * (facts2[0] / total)
        file = np.minimum((mass * (self.n / total)).astype(np.int64), self.n - 1)
        # rounding may put a pair one file off where a context begins; then its code would be below zero
        file -= first < self.bases[file]
        return file, (first - self.bases[file]).astype(np.uint64) * np.uint64(self.words.size) + second.astype(np.uint64)

    def save(self, file: int, pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], mu: float, mu3: float) -> int:
        """Writes both levels of a file from distinct, sorted (code of a pair, 1 + word after it or 0) and their counts.

        They come in pieces, none of which ends within a pair.
        """
        size = np.uint64(self.words.size)
        contexts, found = [], []
        for codes, after, counts in pieces:
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            pairs, n2 = codes[starts], np.add.reduceat(counts, starts)
            relative, second = (pairs // size).astype(np.int64), (pairs % size).astype(np.int64)
            some, where = np.unique(second, return_inverse=True)
            p = (10 ** self.words.facts(some)[2])[where]
            some, times = np.unique(relative, return_counts=True)
            context = np.repeat(self.words.facts(some + self.bases[file])[1], times)
            contexts.append((some, times))
            follows = after > 0
            sizes = np.add.reduceat(follows.astype(np.int64), starts)
            log_p = np.log10((n2 + mu * p) / (context + mu))
            found.append([log_p, *map(_narrow, (second, n2, sizes, after[follows] - np.uint64(1), counts[follows]))])

        def column(i: int) -> np.ndarray:
            return np.concatenate([x.pop(i) for x in found])

        counts, after, sizes, n2, second, log_p = (column(i) for i in range(5, -1, -1))
        ranges = np.zeros(int(contexts[-1][0][-1]) + 1, np.int64)
        for some, times in contexts:
            ranges[some] += times
        parts = [*_rising(ranges, second), *_bytes_of(log_p)]
        del ranges, second, log_p
        parts += [*_bytes_of(np.log10(mu3 / (n2 + mu3))), *_rising(sizes, after)]
        share = np.repeat(n2 + float(mu3), sizes)
        np.log10(np.divide(counts, share, out=share), out=share)
        parts += _bytes_of(share)
        _save(self.path, f"grams-{file}", *parts)
        return len(n2)

    def _file(self, file: int):
        if file not in self.open:
            if self.bytes > OPEN_BYTES:
                self.open.clear()
                self.bytes = 0
            try:
                buffer = _load(self.path, f"grams-{file}")
            except FileNotFoundError:  # no pair of the corpus lies there
                self.open[file] = None
                return None
            two = Level(buffer, 0)
            table, codes, end = _values(buffer, two.end, two.rising.n)
            weights, weight_codes, end = _values(buffer, end, two.rising.n)
            three = Level(buffer, end)
            shares, share_codes, _ = _values(buffer, three.end, three.rising.n)
            self.open[file] = (two, table, codes, weights, weight_codes, three, shares, share_codes)
            self.bytes += len(buffer)
        return self.open[file]

    def _runs(self, file: np.ndarray):
        """(level, slice) of bounded pieces of sorted files."""
        ends = np.flatnonzero(np.append(file[1:] != file[:-1], True)) + 1 if len(file) else []
        begin = 0
        for end in ends:
            level = self._file(int(file[begin]))
            if level is not None:
                for a in range(begin, end, 1 << 17):
                    yield level, slice(a, min(end, a + (1 << 17)))
            begin = end

    def pairs(self, file: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, log10 p, log10 of the weight of the shorter context) of pairs; file and codes: sorted."""
        place, p, weight = np.full(len(codes), -1, np.int64), np.zeros(len(codes)), np.zeros(len(codes))
        size = np.uint64(self.words.size)
        for (two, table, quant, weights, quant2, *_), piece in self._runs(file):
            c = codes[piece]
            at = two.find((c // size).astype(np.int64), c % size)
            hit = at >= 0
            place[piece] = at
            p[piece][hit], weight[piece][hit] = table[quant[at[hit]]], weights[quant2[at[hit]]]
        return place, p, weight

    def triples(self, file: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of c(u v w) / (c(u v) + mu3), minus infinity for triples that the corpus doesn't hold; sorted by file, place."""
        out = np.full(len(word), -np.inf)
        for (*_, three, shares, quant), piece in self._runs(file):
            at = three.find(place[piece], word[piece])
            hit = at >= 0
            out[piece][hit] = shares[quant[at[hit]]]
        return out


_opened: dict[str, tuple[Words, Grams]] = {}


def _model(path: str, files, total: int, words: int) -> tuple[Words, Grams]:
    """The model's files, opened once in a Python worker; those of another model are let go."""
    if path not in _opened:
        _opened.clear()
        level = Words(path, files, total, words)
        _opened[path] = (level, Grams(path, level))
    return _opened[path]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; those of rising small differences are nearly empty."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _from_planes(data: pa.Buffer, kind: str) -> np.ndarray:
    size = struct.unpack_from("<q", data)[0]
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(data.slice(8), size, asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _summed(codes: np.ndarray, after: np.ndarray, counts: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, after), sorted, and how often they occur; after is at most words."""
    step = np.uint64(words + 1)
    if not len(codes):
        return codes, after, np.zeros(0, np.int64)
    if int(codes.max()) < (1 << 64) // (words + 1) - 1:  # both in one number
        key = codes * step + after
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        codes, after = key[starts] // step, key[starts] % step
    else:
        order = np.lexsort((after, codes))
        codes, after, counts = codes[order], after[order], None if counts is None else counts[order]
        starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (after[1:] != after[:-1]))))
        n, codes, after = len(codes), codes[starts], after[starts]
        key = range(n)
    return codes, after, np.diff(np.append(starts, len(key))) if counts is None else np.add.reduceat(counts, starts)


def _pieces(table: pa.Table, words: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (code, after), sorted, and how often they occur in all blocks, by ranges of codes with about most entries."""
    blocks = []
    for code, after, counts in zip(*(table.column(x) for x in ("codes", "after", "counts")), strict=True):
        codes = np.cumsum(_from_planes(code.as_buffer(), "<u8"), dtype=np.uint64)
        blocks.append((codes, _narrow(_from_planes(after.as_buffer(), "<u8")), _narrow(_from_planes(counts.as_buffer(), "<u4"))))
    n = -(-sum(len(b[0]) for b in blocks) // most)
    some = np.sort(np.concatenate([b[0][::16] for b in blocks]))
    cuts = np.unique(some[np.arange(1, n) * len(some) // n])
    bounds = [[0, *np.searchsorted(b[0], cuts).tolist(), len(b[0])] for b in blocks]
    for i in range(len(cuts) + 1):
        codes, after, counts = (np.concatenate([b[k][at[i] : at[i + 1]] for b, at in zip(blocks, bounds, strict=True)]) for k in range(3))
        if len(codes):
            yield _summed(codes, after, counts.astype(np.int64), words)


def _texts(batches: Iterator[pa.RecordBatch], most: int):
    """(other columns, numbers of words, words with a dictionary) of whole texts with about most tokens; a column of texts comes last."""
    rows, n = [], 0

    def joined():
        *other, counts, words = ([r[i] for r in rows] for i in range(len(rows[0])))
        rows.clear()
        return [pa.concat_arrays(x) for x in other], np.concatenate(counts), pa.concat_arrays(words).dictionary_encode()

    for batch in batches:
        place = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy()) // BYTES_A_SLICE
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                *other, texts = batch.slice(a, b - a).columns
                counts, words = words_of(texts)
                rows.append((*other, counts, words))
                n += len(words) + len(counts)
                if n >= most:
                    yield joined()
                    n = 0
    if rows:
        yield joined()


def _indexed(counts: np.ndarray, tokens: pa.DictionaryArray, words: Words):
    """(ids of all tokens in a row, lengths, first tokens' places, distinct ids, place among them of each and of the one before).

    An end token closes a text, and opens it.
    """
    lengths = counts + 1
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ids, inner = np.full(int(lengths.sum()), words.end), np.ones(int(lengths.sum()), bool)
    inner[first + counts] = False
    ids[inner] = words.ids(tokens.dictionary)[tokens.indices.to_numpy()]
    some, where = np.unique(ids, return_inverse=True)
    before = np.concatenate(([0], where[:-1]))
    before[first] = where[first + counts]
    return ids, lengths, first, some, where, before


def _by_file(file: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Order by file, then code."""
    most = int(file.max(initial=0))
    if most > 256:
        return np.lexsort((codes, file))
    order = np.argsort(file.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(file, minlength=most + 1)).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        order[a:b] = order[a:b][np.argsort(codes[order[a:b]])]
    return order


def train(texts: DataFrame, path: str, mu: float, mu3: float):
    """Writes all levels of the model of a DataFrame of texts; returns what _model needs to open it."""
    spark = texts.sparkSession
    texts = texts.select(text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lengths, words in (x[1:] for x in _texts(batches, 3 * TOKENS_A_BATCH)):
            h = np.append(_hashes(words.dictionary), np.uint64(xxhash.xxh64_intdigest(END))) ^ np.uint64(SIGN)
            n = np.append(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)), len(lengths))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = stored(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        columns = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not columns:
            return
        h, n = (np.concatenate(x) for x in zip(*columns, strict=True))
        h, sums = h.view(np.uint64) ^ np.uint64(SIGN), np.cumsum(n)
        log_p = np.log10((n + 0.5) / (float(total) + 0.5 * (size + 1)))
        table, codes = quantised(log_p)
        name = f"words-{TaskContext.get().partitionId()}"
        _save(path, name, eliasfano.encode(h, 1 << 64), eliasfano.encode(sums.astype(np.uint64), int(sums[-1]) + 1), table.astype("<f8").tobytes(), codes.tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [str(int(h[0]))], "words": [len(h)], "tokens": [int(sums[-1])]})

    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, size = int(known[0]), int(known[1])
    # about 50 bytes a word while a file is built
    parts = max(parts, -(-size // 2_000_000))
    made = counts.repartitionByRange(parts, "h").sortWithinPartitions("h").mapInArrow(level1, "name string, first string, words long, tokens long").collect()
    files, words_before, tokens_before = [], 0, 0
    for r in sorted(made, key=lambda r: int(r["first"])):
        files.append((r["name"], int(r["first"]), words_before, tokens_before))
        words_before, tokens_before = words_before + r["words"], tokens_before + r["tokens"]
    opened = (path, files, total, size)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level = _model(*opened)
        for _, *texts in _texts(batches, TOKENS_A_BATCH):
            ids, lengths, first, some, where, before = _indexed(*texts, words)
            mass, count, _ = words.facts(some)
            after = np.concatenate((ids[1:] + 1, [0])).astype(np.uint64)
            after[first + lengths - 1] = 0  # nothing follows the end
            file, codes = level.place(some[before], ids, (mass[before], count[before]), (mass[where], count[where]))
            order = np.argsort(file.astype(np.uint16) if level.n <= 1 << 16 else file, kind="stable")
            file, codes, after = file[order], codes[order], after[order]
            starts = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(file)), strict=True):
                c, w, n = _summed(codes[a:b], after[a:b], None, words.size)
                c[1:] -= c[:-1].copy()
                yield pa.RecordBatch.from_arrays([pa.array([int(file[a])]), *(pa.array([_planes(x)]) for x in (c, w, n.astype("<u4")))], names=["file", "codes", "after", "counts"])

    def levels(table: pa.Table) -> pa.Table:
        words, level = _model(*opened)
        file = table.column("file")[0].as_py()
        return pa.table({"file": [file], "pairs": [level.save(file, _pieces(table, words.size), mu, mu3)]})

    if total:
        blocks = texts.mapInArrow(grams, "file long, codes binary, after binary, counts binary")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TOKENS_A_FILE))  # about a file a task
        blocks.repartition(parts, "file").groupBy("file").applyInArrow(levels, "file long, pairs long").agg(F.sum("pairs")).collect()
    return opened


def score(docs: DataFrame, opened, mu: float, columns: list[str]) -> DataFrame:
    """columns of docs, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text)."""
    kept = docs.select(*columns, text_or_empty().alias("text"))
    schema = kept.drop("text").schema
    arrow = [*kept.drop("text").columns, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level = _model(*opened)
        scale = words.total + 0.5 * (words.size + 1)

        for lists, *texts in _texts(batches, TOKENS_A_BATCH):
            ids, lengths, first, some, where, before = _indexed(*texts, words)
            mass, count, log_p = words.facts(some)
            out = np.log10(mu / (count[before] + mu)) + log_p[where]
            both = np.flatnonzero((ids >= 0) & (some[before] >= 0))
            w, p = where[both], before[both]
            file, codes = level.place(some[p], ids[both], (mass[p], count[p]), (mass[w], count[w]))
            order = _by_file(file, codes)
            file, codes, token = file[order], codes[order], both[order]
            starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (file[1:] != file[:-1])))) if len(codes) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(codes)))
            place, found, weight = (np.repeat(x, times) for x in level.pairs(file[starts], codes[starts]))
            hit = place >= 0
            out[token[hit]] = found[hit]
            # a known pair is the context of the token after it, but for one that ends a text
            last = np.zeros(len(ids), bool)
            last[first + lengths - 1] = True
            hit &= ~last[token]
            file, place, weight, token = file[hit], place[hit], weight[hit], token[hit] + 1
            out[token] += weight
            known = np.flatnonzero(ids[token] >= 0)
            share = level.triples(file[known], place[known], ids[token[known]])
            out[token[known]] = np.log10(10**share + 10 ** out[token[known]])
            base = np.log10((count + 0.5) / scale)[where]
            known = np.add.reduceat((count[where] > 0).astype(np.int64), first)
            lists += [pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), words.total)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(out, first))]
            yield pa.RecordBatch.from_arrays(lists, names=arrow)

    for name in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(name, "long")
    return kept.mapInArrow(run, schema.add("base_score", "double").add("score", "double"))


def lm_report(docs: DataFrame, mu: float = 100.0, mu3: float = 20.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learned from documents not held out."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_in(1).alias("held_out"), "text")
    opened = train(marked.where(~F.col("held_out")), scratch(docs.sparkSession, "lm"), mu, mu3)
    return score(marked, opened, mu, ["doc_id", "held_out"])
