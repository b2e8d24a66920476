"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds more by shape and context.

Words are tagged as the beginning of a secret, its inside, or outside. Features are a word's shape, length and characters,
the words beside it, and counts over the file. The field is trained on the driver, by full-batch gradients over windows of
words of four kinds: around the patterns' finds; around the same finds in disguise (the key word is another word of the
text, the key's first letters and the value's alphabet are others), so that what no pattern covers is learned too; around
words outside that hold digits or signs; around any words outside. Of each kind the distinct windows with the smallest
hashes are taken, up to a bound that is a parameter. Tags are decoded by Viterbi over whole texts. A word whose score for
"outside" exceeds the others by more than all that two transitions can bring is outside on every best path, so that only
the stretches between such words need decoding; the result is that of the whole chain.

The patterns' finds always stay; the field adds spans that meet none of them. Spans are in code points, end exclusive; a
found pattern counts whole (key word and value).

Defined cases: null text is empty and has no spans; a text of any length is scanned whole; a null doc_id is carried
through; rows that repeat give the same spans each; without training windows the field adds nothing; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import Held, text_or_empty

#: Fixed patterns of the contract: kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a maximal run; shorter runs fail whole
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ["assign", "access", "hex", "crf"]
OUT, BEGIN, INSIDE = 0, 1, 2
AROUND = 10
BOUNDARY = b""
CACHE_WORDS = 400_000
FOUND, DISGUISED, ODD, ANY = 3, 2, 1, 0  # kinds of training windows
_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256))
_REPEATS = re.compile(rb"(.)\1+", re.DOTALL)


def base_spans(raw: bytes, words: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes, by start, then kind."""
    found = []
    lowered = raw.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if max(map(len, words), default=0) >= 24:  # no run of hexadecimal digits is longer than its word
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(raw)]
    return sorted(found)


def word_starts(raw: bytes, words: list[bytes]) -> list[int]:
    out, at = [], 0
    for w in words:
        at = raw.index(w, at)
        out.append(at)
        at += len(w)
    return out


def _collapsed(w: bytes) -> bytes:
    return _REPEATS.sub(rb"\1", w.translate(_SHAPE))[:14]


def own_features(w: bytes) -> list[tuple]:
    full = w.translate(_SHAPE)
    shape, size, upper = _REPEATS.sub(rb"\1", full)[:14], min(len(w) // 4, 4), b"A" in full and b"a" not in full
    if shape == b"a":
        return [("s", shape), ("z", size)]
    lowered = w.lower()
    out = [("s", shape), ("z", size), ("sz", shape[:3], size), ("t", len(shape), size), ("u", upper, size, b"9" in full), ("k", _key(lowered))]
    if b"9" in full:
        core = w.strip(b"\"'.,;:()[]{}<>")
        out += [("d", min(full.count(b"9"), 4)), ("h", not core.strip(b"0123456789abcdef"), size), ("p", lowered[:4])]
    return out


def _key(lowered: bytes) -> bytes:
    if b"pass" in lowered or b"ecre" in lowered or b"oken" in lowered or b"api" in lowered:
        return next((k for k in KEYWORDS if k in lowered), b"")
    return b""


def _core(w: bytes) -> bytes:
    return w.lower().strip(b"\"'.,;:=()")[:24]


def context_features(side: str, w: bytes) -> list[tuple]:
    return [(side, "edge")] if w == BOUNDARY else [(side, _core(w)), (side, "s", _collapsed(w)[:8])]


def file_features(raw: bytes) -> list[tuple]:
    bucket = lambda n: min(int(n).bit_length(), 6)
    return [("f=", bucket(raw.count(b"="))), ("f:", bucket(raw.count(b":"))), ('f"', bucket(raw.count(b'"'))), ("fl", bucket(len(raw) >> 8))]


class Field:
    """Weights of a trained field: features to rows of three, and transitions[from, to]."""

    def __init__(self, rows: dict, weights: np.ndarray, transitions: np.ndarray):
        self.rows, self.weights, self.transitions = rows, weights, transitions
        self.triples = weights.tolist()
        self.seen = {f[1] for f in rows if f[0] in ("a", "b") and len(f) == 2}
        self.margin = 2 * float(transitions.max() - transitions.min()) + 1e-6 if len(rows) else -np.inf
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1024, 9))
        self.plain: dict[bytes, tuple] = {}

    def __getstate__(self):
        return self.rows, self.weights, self.transitions

    def __setstate__(self, state):
        self.__init__(*state)

    def _add(self, features) -> tuple[float, float, float]:
        a = b = c = 0.0
        for f in features:
            if (i := self.rows.get(f)) is not None:
                x, y, z = self.triples[i]
                a, b, c = a + x, b + y, c + z
        return a, b, c

    def _word(self, w: bytes) -> tuple:
        """Scores of a word as itself, as the word before, as the word after."""
        if w == BOUNDARY:
            return (0.0, 0.0, 0.0, *self._add(context_features("b", w)), *self._add(context_features("a", w)))
        full, key = w.translate(_SHAPE), None
        if b"9" not in full and _core(w) not in self.seen and not _key(w.lower()):
            # most words: no digits, not seen in training; all their features follow from their shape
            key = full
            if key in self.plain:
                return self.plain[key]
        scores = (*self._add(own_features(w)), *self._add(context_features("b", w)), *self._add(context_features("a", w)))
        if key:
            self.plain[key] = scores
        return scores

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table of word scores: as itself, as the word before, as the word after."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        values, known = [], len(self.index)
        for w in set(words).difference(self.index):
            self.index[w] = known + len(values)
            values.append(self._word(w))
        if values:
            end = known + len(values)
            if end > len(self.table):
                self.table = np.concatenate((self.table, np.zeros((max(end, len(self.table)), 9))))
            self.table[known:end] = values
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def scores(self, docs: list[tuple[bytes, list[bytes]]]) -> list[np.ndarray]:
        """Scores (words x 3) of each document's words."""
        chain = [BOUNDARY]
        for _, words in docs:
            chain += words
            chain.append(BOUNDARY)
        ids = self.ids(chain)
        e = self.table[ids[1:-1], :3] + self.table[ids[:-2], 3:6] + self.table[ids[2:], 6:] if len(ids) > 2 else np.zeros((0, 3))
        out, at = [], 0
        for raw, words in docs:
            out.append(e[at : at + len(words)] + np.array(self._add(file_features(raw))))
            at += len(words) + 1
        return out

    def tags(self, e: np.ndarray) -> list[tuple[int, int]]:
        """(place, tag) of the words that are not outside."""
        if not len(self.rows) or not len(e):
            return []
        open_ = np.flatnonzero(e[:, OUT] - e[:, 1:].max(1) < self.margin)
        found = []
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            path = viterbi(e[part], self.transitions)
            found += [(int(i), t) for i, t in zip(part, path, strict=True) if t != OUT]
        return found


def viterbi(e: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best tags of a chain with "outside" before and after it; of equal paths the one with smaller tags from the end."""
    best, back = transitions[OUT] + e[0], []
    for row in e[1:]:
        step = best[:, None] + transitions
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int((best + transitions[:, OUT]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Chains:
    """Training windows as arrays: words with one on either side for context, tags of the inner ones, file features."""

    def __init__(self, windows: list[tuple[list[bytes], list[int], list[tuple]]], least: int = 1):
        self.rows: dict[tuple, int] = {}
        self.n, length = len(windows), max(len(t) for _, t, _ in windows)
        at, feature = [], []
        tags, self.real = np.zeros((self.n, length), np.int64), np.zeros((self.n, length), bool)
        for n, (words, t, file) in enumerate(windows):
            tags[n, : len(t)], self.real[n, : len(t)] = t, True
            for i in range(len(t)):
                for f in (*own_features(words[i + 1]), *context_features("b", words[i]), *context_features("a", words[i + 2]), *file):
                    at.append(n * length + i)
                    feature.append(self.rows.setdefault(f, len(self.rows)))
        self.at, self.feature, self.shape = np.array(at), np.array(feature), (self.n, length, 3)
        often = np.bincount(self.feature) >= least
        keep, number = often[self.feature], np.cumsum(often) - 1
        self.rows = {f: int(number[i]) for f, i in self.rows.items() if often[i]}
        self.at, self.feature = self.at[keep], number[self.feature[keep]]
        one = self.one = np.eye(3)
        self.tags, self.gold, self.last = tags, one[tags] * self.real[..., None], self.real.sum(1) - 1
        gold, every = self.gold, np.arange(self.n)
        self.pairs = np.einsum("nia,nib->ab", gold[:, :-1], gold[:, 1:]) + gold[:, 0].sum(0)[None] * one[OUT][:, None]
        self.pairs += gold[every, self.last].sum(0)[:, None] * one[OUT][None]

    def gradient(self, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood of the tags, its gradients by w and by trans); chains begin and end outside."""
        shape, length, one, every = self.shape, self.shape[1], self.one, np.arange(self.n)
        log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        e = np.stack([np.bincount(self.at, w[self.feature, k], shape[0] * length) for k in range(3)], 1).reshape(shape)
        told = float((e * self.gold).sum() + (self.pairs * trans).sum())
        e[~self.real] = [0, -1e9, -1e9]  # beyond a window's end all is outside
        a, b = np.empty(shape), np.empty(shape)
        a[:, 0] = trans[OUT] + e[:, 0]
        for i in range(1, length):
            a[:, i] = log_sum(a[:, i - 1, :, None] + trans[None], 1) + e[:, i]
        b[every, self.last] = trans[:, OUT]
        for i in range(length - 2, -1, -1):
            on = self.real[:, i + 1]
            b[on, i] = log_sum(trans[None] + (e[on, i + 1] + b[on, i + 1])[:, None], 2)
        z = log_sum(a[every, self.last] + trans[:, OUT], 1)
        p = np.where(self.real[..., None], np.exp(np.where(self.real[..., None], a + b - z[:, None, None], 0.0)), 0.0)
        linked = self.real[:, 1:, None, None]
        both = np.where(linked, np.exp(np.where(linked, a[:, :-1, :, None] + trans + (e[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None], 0.0)), 0.0)
        pairs = both.sum((0, 1)) + p[:, 0].sum(0)[None] * one[OUT][:, None] + p[every, self.last].sum(0)[:, None] * one[OUT][None]
        rest = (self.gold - p).reshape(-1, 3)[self.at]
        return told - float(z.sum()), np.stack([np.bincount(self.feature, rest[:, k], len(w)) for k in range(3)], 1), self.pairs - pairs


def fit(windows: list[tuple[list[bytes], list[int], list[tuple]]], rounds: int = 50, ridge: float = 0.02, least: int = 3) -> Field:
    """Maximum likelihood with a Gaussian prior, by L-BFGS steps. Features that fewer than ``least`` words have are left out."""
    if not windows:
        return Field({}, np.zeros((0, 3)), np.zeros((3, 3)))
    chains = Chains(windows, least)
    n = len(chains.rows)

    def loss(x):
        value, gw, gt = chains.gradient(x[: 3 * n].reshape(-1, 3), x[3 * n :].reshape(3, 3))
        return ridge / 2 * x @ x - value, ridge * x - np.concatenate((gw.ravel(), gt.ravel()))

    x = np.zeros(3 * n + 9)
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(past):
            kept.append(a := (s @ d) / (s @ y))
            d = d - a * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])) if past else d / max(1.0, np.linalg.norm(d))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0
        for _ in range(20):
            to = x + step * d
            f2, g2 = loss(to)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, y = to - x, g2 - g
        if s @ y > 1e-10:
            past = [*past[-6:], (s, y)]
        done = f - f2 < 1e-5 * max(1.0, abs(f2))
        x, f, g = to, f2, g2
        if done:
            break
    return Field(chains.rows, x[: 3 * n].reshape(-1, 3), x[3 * n :].reshape(3, 3))


_UPPER, _ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def disguised(raw: bytes, spans: list[tuple[int, int, int, int]], words: list[bytes]) -> list[bytes] | None:
    """The text's words with every find made one that no pattern covers; None if one still does or words don't line up."""
    out, end = [], 0
    seed = xxhash.xxh64_intdigest(raw)
    for start, kind, stop, value in spans:
        if start < end:
            continue
        part = raw[value:stop]
        mix = np.random.default_rng((seed + start) & (2**63 - 1))
        if kind == 1:
            part = bytes(_UPPER[i] for i in mix.integers(0, 26, 4)) + part[4:]
        elif kind == 2 or HEX.fullmatch(part) or mix.random() < 0.5:
            part = bytes(_ALNUM[i] for i in mix.integers(0, len(_ALNUM), int(mix.integers(12, 45))))  # of another length
        key = raw[start:value]
        for k in KEYWORDS:  # another word of the text in the key word's place
            if (at := key.lower().find(k)) >= 0:
                other = words[int(mix.integers(0, len(words)))].strip(b"\"'.,;:=()|!*$%#&")
                key = key[:at] + (other if other and not any(48 <= c <= 57 for c in other) else b"of") + key[at + len(k) :]
                break
        out += [raw[end:start], key, part]
        end = stop
    changed = b"".join([*out, raw[end:]])
    new = changed.split()
    return new if len(new) == len(words) and not base_spans(changed, new) else None


def windows_of(text: str) -> Iterator[tuple[int, list[bytes], list[int], list[tuple]]]:
    """(kind, window): around each value that the patterns find, as it is and disguised, and around two words outside."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return
    spans = base_spans(raw, words)
    tags = np.zeros(len(words), np.int64)
    other = None
    if spans:
        starts = np.array(word_starts(raw, words))
        ends = starts + list(map(len, words))
        for _, _, end, value in spans:
            inside = np.flatnonzero((starts < end) & (ends > value))
            tags[inside] = np.where(tags[inside] == BEGIN, BEGIN, INSIDE)
            tags[inside[:1]] = BEGIN
        other = disguised(raw, spans, words)
    file = file_features(raw)
    padded = [BOUNDARY, *words, BOUNDARY]
    pick = xxhash.xxh64_intdigest(raw)
    centres = [(FOUND, int(i), padded) for i in np.flatnonzero(tags == BEGIN)]
    if other:
        centres += [(DISGUISED, i, [BOUNDARY, *other, BOUNDARY]) for _, i, _ in centres]
    odd = [i for i, w in enumerate(words) if not tags[i] and not w.isalpha() and len(w) > 3 and not w[:-1].isalpha() and w[:1] < b"\x80"]
    if odd:
        centres.append((ODD, odd[pick % len(odd)], padded))
    centres.append((ANY, pick % len(words), padded))
    for kind, i, line in centres:
        a, b = max(0, i - AROUND), min(len(words), i + AROUND + 1)
        yield kind, line[a : b + 2], tags[a:b].tolist(), file


def training_windows(docs: DataFrame, most: int) -> list:
    """Of each kind up to most distinct windows, those with the smallest hashes.

    A task gives its own smallest, so that copies and frequent windows come once a task; equal ones of all tasks are one
    row. A bound on the hash, from the number of rows, leaves about twice as many as are wanted for the last sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        best: dict[int, dict[int, bytes]] = {k: {} for k in (FOUND, DISGUISED, ODD, ANY)}
        bound = dict.fromkeys(best, 1 << 63)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, *window in windows_of(text):
                    data = pickle.dumps(window, 5)
                    h = xxhash.xxh64_intdigest(data) >> 1
                    if h < bound[kind]:
                        best[kind][h] = data
                        if len(best[kind]) > 2 * most:
                            kept = sorted(best[kind])[:most]
                            bound[kind], best[kind] = kept[-1] + 1, {x: best[kind][x] for x in kept}
        rows = [(k, h, found[h]) for k, found in best.items() for h in sorted(found)[:most]]
        for a in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pydict(dict(zip(["kind", "h", "data"], map(list, zip(*rows[a : a + 1000], strict=True)), strict=True)))

    import pickle

    held = Held(docs.sparkSession)
    made = docs.select(text_or_empty().alias("text")).mapInArrow(run, "kind long, h long, data binary")
    made = held.stored(made.groupBy("kind", "h").agg(F.min("data").alias("data")), "windows")
    out = []
    for kind, n in sorted((r["kind"], r["n"]) for r in made.groupBy("kind").agg(F.count("*").alias("n")).collect()):
        mine = made.where(F.col("kind") == kind)
        low = mine.where(F.col("h") <= min(2**63 - 1, (2 * most + 100) * 2**63 // n))
        rows = low.orderBy("h").limit(most).select("data").collect()
        if len(rows) < min(n, most):  # hashes that lie unevenly
            rows = mine.orderBy("h").limit(most).select("data").collect()
        out += [tuple(pickle.loads(bytes(r["data"]))) for r in rows]
    held.close()
    return out


def trained(docs: DataFrame, most: int = 1500) -> Field:
    return fit(training_windows(docs, most))


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and base (spans of the patterns) and spans (all): arrays of (kind, start, end), in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = [(raw := t.encode(), raw.split()) for t in batch.column(1).to_pylist()]
                base_out, all_out = [], []
                for (raw, words), e in zip(texts, model.scores(texts), strict=True):
                    base = [(s, k, t) for s, k, t, _ in base_spans(raw, words)]
                    spans = list(base)
                    tags = model.tags(e)
                    if tags:
                        starts = word_starts(raw, words)
                        for a, b in _runs(tags):
                            s, t = starts[a], starts[b] + len(words[b])
                            while s < t and raw[s] in b"\"'([{<":
                                s += 1
                            while s < t and raw[t - 1] in b"\"')]}>.,;:":
                                t -= 1
                            if s < t and all(t <= x or s >= y for x, _, y in base):
                                spans.append((s, 3, t))
                    points = _code_points(raw) if spans else None
                    for out, some in ((base_out, base), (all_out, sorted(spans))):
                        out.append([{"kind": KINDS[k], "start": int(points[s]), "end": int(points[t])} for s, k, t in some])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, kind), pa.array(all_out, kind)], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def _runs(tags: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """First and last word of each secret: a beginning, or an inside without one, and the insides that follow it."""
    first = last = None
    for i, t in tags:
        if first is not None and (t == BEGIN or i != last + 1):
            yield first, last
            first = None
        first, last = i if first is None else first, i
    if first is not None:
        yield first, last


def _code_points(raw: bytes) -> np.ndarray:
    """Code points before each byte, and before the end."""
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins))) if len(raw) else np.zeros(1, np.int64)


def secrets_report(docs: DataFrame, most: int = 1500) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs, trained(docs, most))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
