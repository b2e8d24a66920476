"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

A text's pieces are a path through a graph whose nodes are pieces at their places. In a unigram model a path's score is
the sum of its pieces' scores and the best path wins. In a BPE model a sequence is the encoding if and only if each two
neighbours, merged alone, stay two pieces; such steps score 0 and all others minus infinity, and one path is left. Either
way the scores add along a path and the larger wins, so that a stretch of text is a matrix over (max, +) from the pieces
that may cover its left end to those that may cover its right end, and matrices of neighbours combine associatively.

Documents over ``giant`` code points are cut into chunks that are dealt out over the cluster; each yields its matrix, the
matrices of a document are multiplied in order, which fixes the piece at every cut, and each chunk is then traced back on
its own. Within a chunk, units that start at a space which no piece of the vocabulary reaches over are looked up whole in
a bounded cache; the graph is walked only from a cut to the next such place, or all along where there is none. Shorter
documents are joined from the same units. For both kinds of models the ids are the library's.

Defined cases: null or empty text has no ids; text that holds the space mark U+2581 decodes with spaces in its place, as
in the library; a null doc_id is carried through; repeated rows are encoded each; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import stored, text_or_empty

MARK = "▁"
GIANT, CHUNK, CACHE_UNITS = 32768, 16384, 400_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2
NEVER = -np.inf
_models: dict[str, Pieces] = {}


class Pieces:
    """A model file: its pieces, the library's processor, and what the scan needs."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = proto.ModelProto.SentencePiece.NORMAL
        rules, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.score = [p.score for p in model.pieces]
        self.unknown = self.library.unk_id()
        self.unknown_score = min(self.score) - 10
        self.longest = max(map(len, self.ids))
        crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.plain = rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not crosses and self.kind in (UNIGRAM, BPE) and all(p.type != proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        byte = proto.ModelProto.SentencePiece.BYTE
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        spelled = {byte: lambda p: bytes([int(p.piece[1:-1], 16)]), normal: lambda p: p.piece.replace(MARK, " ").encode()}
        self.bytes_of = [spelled.get(p.type, lambda p: b"")(p) for p in model.pieces]
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def spell(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes, or the unknown id."""
        out = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best pair, leftmost first, merged until no pair is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def step(self, before: str, piece: str) -> float:
        """What piece adds to a path after the piece before ("" at the start)."""
        if self.kind == UNIGRAM:
            k = self.ids.get(piece)
            return self.unknown_score if k is None else self.score[k]
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) > CACHE_UNITS:
                self.pairs.clear()
            known = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return 0.0 if known else NEVER

    def fill(self, units: set[str]) -> None:
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        new = [u for u in units if u not in self.units]
        plain = [u for u in new if len(u) > 1]  # the library adds the first mark itself
        for u, ids in zip(plain, self.library.encode([u[1:] for u in plain], num_threads=1) if plain else [], strict=True):
            self.units[u] = np.array(ids, "<i4").tobytes()
        for u in new:
            if len(u) == 1:
                self.units[u] = np.array(self.spell([u]), "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if not self.plain:
            return [np.array(x, "<i4") for x in self.library.encode(texts, num_threads=1)]
        split = [_UNIT.findall(marked(t)) for t in texts]
        self.fill({u for units in split for u in units})
        get = self.units.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), "<i4") for units in split]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    """One per Python worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class Chunk:
    """Text from cut a to cut b (of the marked text of n characters), with up to the longest piece on either side."""

    def __init__(self, model: Pieces, text: str, a: int, b: int, n: int):
        offset = max(0, a - model.longest)
        self.model, self.text, self.begins = model, text, a == 0
        self.a, self.b, self.n = a - offset, b - offset, n - offset
        # places that no piece reaches over, far enough from the right cut that pieces over it start behind them
        safe = [m.end() - 1 for m in re.finditer(f"[^{MARK}]{MARK}", text) if self.a < m.end() - 1 <= self.b - model.longest]
        self.first, self.last = (safe[0], safe[-1]) if safe else (None, None)

    def _at(self, i: int) -> Iterator[int]:
        """Ends of the pieces that start at i; an unknown character is a piece of its own."""
        text, ids = self.text, self.model.ids
        if text[i] not in ids:
            yield i + 1
        for e in range(i + 1, min(i + self.model.longest, self.n, len(text)) + 1):
            if text[i:e] in ids:
                yield e

    def states(self, p: int) -> list[tuple[int, int]]:
        """The pieces that may cover the character before cut p, as (start, end), in order; the start of the text is one."""
        if self.begins and p == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, p - self.model.longest), p) for e in self._at(s) if e >= p]

    def _walk(self, seeds, stop: int, trace: bool):
        """Paths on from seeds [(start, end, value)], by end: {end: [(start, value, node before)]}.

        Every piece that starts before ``stop`` is entered; values are arrays that add and compare elementwise.
        """
        ends: dict[int, list] = {}
        for s, e, value in seeds:
            ends.setdefault(e, []).append((s, value, None))
        final: dict[int, list] = {}
        i = min(ends, default=stop)
        text, step = self.text, self.model.step
        while i < stop:
            nodes = ends.pop(i, None) if not trace else ends.get(i)
            if nodes:
                for e in self._at(i):
                    piece, best, back = text[i:e], None, None
                    for node in nodes:
                        gain = step(text[node[0] : i], piece)
                        if gain > NEVER:
                            value = node[1] + gain
                            if best is None:
                                best, back = value, node
                            elif trace:
                                if value > best:
                                    best, back = value, node
                            else:
                                best = np.maximum(best, value)
                    if best is not None:
                        (ends if e < stop else final).setdefault(e, []).append((i, best, back))
            i += 1
        for e, nodes in ends.items():
            if e >= stop:
                final.setdefault(e, []).extend(nodes)
        return final

    def matrix(self) -> list[tuple[int, int, float]]:
        """Finite entries (state at a, state at b, score)."""
        into, out = self.states(self.a), self.states(self.b)
        one = np.where(np.eye(len(into), dtype=bool), 0.0, NEVER)
        seeds = [(s, e, one[i]) for i, (s, e) in enumerate(into)]
        if self.first is not None:
            head = self._walk(seeds, self.first, False)
            whole = [node[1] for node in head.get(self.first, [])]
            if not whole:
                return []
            start = np.max(whole, 0) + self._between_score()
            seeds = [(self.last, self.last, start)]
        final = self._walk(seeds, self.b, False)
        index = {x: j for j, x in enumerate(out)}
        found: dict[int, np.ndarray] = {}
        for e, nodes in final.items():
            for s, value, _ in nodes:
                if (j := index.get((s, e))) is not None:
                    found[j] = np.maximum(found[j], value) if j in found else value
        return [(i, j, float(v)) for j, value in found.items() for i, v in enumerate(value) if v > NEVER]

    def _middle(self) -> list[int]:
        """Ids of the units between the first and the last safe place."""
        units = _UNIT.findall(self.text[self.first : self.last])
        self.model.fill(set(units))
        return np.frombuffer(b"".join(map(self.model.units.__getitem__, units)), "<i4").tolist()

    def _between_score(self) -> float:
        return sum(self.model.score[i] for i in self._middle()) if self.model.kind == UNIGRAM else 0.0

    def trace(self, i: int, j: int) -> list[int]:
        """Ids of the pieces after state i, up to and with state j."""
        s, e = self.states(self.a)[i]
        goal = self.states(self.b)[j]
        out, seeds = [], [(s, e, 0.0)]
        if self.first is not None:
            head = self._walk(seeds, self.first, True)
            out += self._spelled(max(head[self.first], key=lambda x: x[1]), self.first)
            out += self._middle()
            seeds = [(self.last, self.last, 0.0)]
        final = self._walk(seeds, self.b, True)
        node = max((x for x in final[goal[1]] if x[0] == goal[0]), key=lambda x: x[1])
        return out + self._spelled(node, goal[1])

    def _spelled(self, node, end: int) -> list[int]:
        found = []
        while node[2] is not None:
            found.append(self.text[node[0] : end])
            end, node = node[0], node[2]
        return self.model.spell(found[::-1])


def combined(x: list[tuple[int, int, float]], y: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The product of two matrices over (max, +), given and returned as finite entries."""
    rows: dict[int, list] = {}
    for k, j, v in y:
        rows.setdefault(k, []).append((j, v))
    best: dict[tuple[int, int], float] = {}
    for i, k, u in x:
        for j, v in rows.get(k, ()):
            if u + v > best.get((i, j), NEVER):
                best[i, j] = u + v
    return [(i, j, v) for (i, j), v in best.items()]


def states_at_cuts(matrices: list[list[tuple[int, int, float]]]) -> list[int]:
    """The state at every cut on the best path from state 0 at the start; of equal ends the first."""
    prefixes = [[(0, 0, 0.0)]]
    for m in matrices:
        prefixes.append(combined(prefixes[-1], m))
    _, state, _ = max(prefixes[-1], key=lambda x: (x[2], -x[1]))
    path = [state]
    for prefix, m in zip(prefixes[-2::-1], matrices[::-1], strict=True):
        before = {j: v for _, j, v in prefix}
        state = max((before[i] + v, -i) for i, j, v in m if j == path[-1] and i in before)[1]
        path.append(-state)
    return path[::-1]


def chunk_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """Cuts of a marked text of n characters; the last chunk takes what would be shorter than half a chunk."""
    count = max(1, round(n / size))
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


_CHUNKS = "key string, no int, a long, b long, n long, piece string"


def encode_giants(texts: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """(key, ids) of distinct (key, text): chunks dealt out, matrices, states at cuts, chunks traced back."""
    n_parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(model).longest
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = marked(text)
                rows = [(key, i, a, b, len(text), text[max(0, a - reach) : b + reach]) for i, (a, b) in enumerate(chunk_bounds(len(text), chunk))]
                yield _batch(rows, _CHUNKS)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, no, a, b, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = Chunk(pieces(model), piece, a, b, n).matrix()
                rows.append((key, no, a, b, n, piece, np.array(m, "<f8").tobytes()))
            if rows:
                yield _batch(rows, _CHUNKS + ", matrix binary")

    def cuts(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        found = [[(int(i), int(j), v) for i, j, v in np.frombuffer(m, "<f8").reshape(-1, 3)] for m in table["matrix"].to_pylist()]
        path = states_at_cuts(found)
        return pa.table({"key": table["key"], "no": table["no"], "i": pa.array(path[:-1], pa.int32()), "j": pa.array(path[1:], pa.int32())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, no, a, b, n, piece, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = Chunk(pieces(model), piece, a, b, n).trace(i, j)
                rows.append((key, no, np.array(ids, "<i4").tobytes()))
            if rows:
                yield _batch(rows, "key string, no int, ids binary")

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        return pa.table({"key": table["key"][:1], "ids": pa.array([b"".join(table["ids"].to_pylist())])})

    dealt = texts.mapInArrow(cut, _CHUNKS).repartition(n_parts, "key", "no")
    scanned = stored(dealt.mapInArrow(matrices, _CHUNKS + ", matrix binary"), "chunks")
    at = scanned.select("key", "no", "matrix").groupBy("key").applyInArrow(cuts, "key string, no int, i int, j int")
    chunks = scanned.drop("matrix").join(at, ["key", "no"]).select("key", "no", "a", "b", "n", "piece", "i", "j")
    return chunks.mapInArrow(traced, "key string, no int, ids binary").groupBy("key").applyInArrow(joined, "key string, ids binary")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def encoded(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, round_trip (whether the ids decode to the text, marks as spaces)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    large = F.length("text") > giant
    # copies of a giant are encoded once; the digest is its key
    giants = stored(docs.where(large).withColumn("key", F.sha2("text", 256)), "giants")
    found = encode_giants(giants.select("key", "text").dropDuplicates(["key"]), model, chunk)
    rest = docs.where(~large).withColumn("given", F.lit(None).cast("binary"))
    whole = giants.join(found, "key").select("doc_id", "text", F.col("ids").alias("given"))
    schema = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts, given = part.column(1).to_pylist(), part.column(2).to_pylist()
                ids = coder.encode([t if g is None else "" for t, g in zip(texts, given, strict=True)])
                ids = [x if g is None else np.frombuffer(g, "<i4") for x, g in zip(ids, given, strict=True)]
                sizes = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(ids)))
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                same = [coder.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"])

    return rest.mapInArrow(run, schema).unionByName(whole.mapInArrow(run, schema))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows with the column text, decoded from ids."""

    def text(ids):
        import pandas as pd

        return pd.Series([pieces(model).decode(x.tolist()) if x is not None else None for x in ids], dtype=object)

    return rows.withColumn("text", F.pandas_udf(text, "string")("ids"))
