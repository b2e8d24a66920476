"""Line dedup: repeated lines found by one range partition of line hashes.

Each non-empty line key becomes a 40-byte row (two 64-bit hashes, document, position). The rows are range-partitioned by
(hash, document, position), so that a line that a third of all documents hold spreads over as many partitions as its rows
need, and sorted inside each partition. A stream over each partition decides all runs of equal hashes that lie wholly
inside it; of the runs at its two ends it reports counts, which are summed over partitions (two rows a partition at most)
and settle the rest. What comes back is one compressed keep bitmap per document that loses lines, never text.

Defined cases: a null or empty text is one empty line; a text of any length is split whole (a row a line, so that only
lines, never texts, are sorted); empty keys are never repeated lines; a document is a row, so rows
that repeat doc_id with other text are other documents, while exact repeats of a row are one document (each row keeps its
place in the result); a null doc_id is an id like any other; other columns pass through untouched; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import BLANKS, LOWER, UPPER, scratch, text_or_empty, unwrapped, wrapped

#: Names of the helper columns beside a caller's row.
ID, TEXT_HASH, MAP = "__id", "__text_hash", "__keep"
_FOUND = "kind int, h1 long, h2 long, id long, th long, pos int, part int, n_docs long, last_id long, last_th long"


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row (h1, h2, id, th, pos) per line whose key has at least min_chars code points."""
    lines = F.split(text_or_empty(), "\n", -1)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("id", "th", "pos", F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER).alias("key"))
    rows = rows.where(F.length("key") >= max(1, min_chars))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "id", "th", "pos")


def _decided(min_docs: int, keep_first: bool):
    """The stream over one sorted partition.

    Rows out, by kind: 0, a line to drop; 1, a line of a run at either end of the partition; 2, such a run's summary.
    Kind 1 rows carry whether they open the run in ``n_docs``, as only the first line of all partitions may stay.
    """

    def out(kind, rows, part, n_docs=0, last=(None, None)):
        n = len(rows[0])
        full = lambda x, t: pa.array([x] * n, t)
        arrays = [full(kind, pa.int32()), *(pa.array(x) for x in rows[:2]), rows[2], pa.array(rows[3]), pa.array(rows[4]), full(part, pa.int32())]
        counts = n_docs if isinstance(n_docs, np.ndarray) else np.full(n, n_docs, np.int64)
        arrays += [pa.array(counts), full(last[0], pa.int64()), full(last[1], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "h1", "h2", "id", "th", "pos", "part", "n_docs", "last_id", "last_th"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        run = None  # the open run: [h1, h2, its documents so far, rows held back, whether it is the first run, first row's id, last row's id]
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, th, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            ids = batch.column(2)
            id_values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            id_null = np.asarray(ids.is_null())
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            new_doc = ~(same & (id_values[1:] == id_values[:-1]) & (id_null[1:] == id_null[:-1]) & (th[1:] == th[:-1]))
            starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
            ends = np.append(starts[1:], len(h1))
            doc_no = np.concatenate(([0], np.cumsum(new_doc)))
            who = lambda i: (None if id_null[i] else int(id_values[i]), int(th[i]))  # noqa: E731, B023
            rows = lambda a, b: (h1[a:b], h2[a:b], ids.slice(a, b - a), th[a:b], pos[a:b])  # noqa: E731, B023
            drop = np.zeros(len(h1), bool)
            for k in sorted({0, len(starts) - 1}):  # the runs that may go on before or after this batch
                a, b = int(starts[k]), int(ends[k])
                n = int(doc_no[b - 1] - doc_no[a]) + 1
                if run is not None and k == 0 and run["h"] == (h1[a], h2[a]):
                    run["n"] += n - (run["last"] == who(a))
                    run["last"] = who(b - 1)
                    opening = False
                else:
                    if run is not None:
                        yield from _closed(run, part, False)
                        first = False
                    run = {"h": (h1[a], h2[a]), "n": n, "rows": [], "edge": first, "first": who(a), "last": who(b - 1)}
                    opening = True
                lead = np.zeros(b - a, np.int64)
                lead[0] = opening
                if run["edge"]:  # the partition's first run: nothing can be said about it here
                    yield out(1, rows(a, b), part, lead)
                elif run["n"] >= min_docs:
                    for held, its_lead in run["rows"]:
                        yield from _dropped(held, its_lead, part)
                    run["rows"] = []
                    run["done"] = True
                    yield from _dropped(rows(a, b), lead, part)
                else:
                    run["rows"].append((rows(a, b), lead))
            inner = slice(1, max(1, len(starts) - 1))
            a, b = starts[inner], ends[inner]
            if len(a):
                bad = doc_no[b - 1] - doc_no[a] + 1 >= min_docs
                drop[a[0] : b[-1]] = np.repeat(bad, b - a)
                if keep_first:
                    drop[a] = False
                if drop.any():
                    where = np.flatnonzero(drop)
                    yield out(0, (h1[where], h2[where], ids.take(pa.array(where)), th[where], pos[where]), part)
        if run is not None:
            yield from _closed(run, part, True)

    def _dropped(rows, lead, part):
        # A run that may go on in the next partition has enough documents already: its lines go in any case.
        keep = slice(1, None) if keep_first and lead[0] else slice(None)
        if len(rows[0][keep]):
            yield out(0, (rows[0][keep], rows[1][keep], rows[2].slice(keep.start or 0), rows[3][keep], rows[4][keep]), part)

    def _closed(run, part, last):
        if run["edge"] or last:
            one = (np.array([run["h"][0]]), np.array([run["h"][1]]), pa.array([run["first"][0]], pa.int64()), np.array([run["first"][1]]), np.array([-1], np.int32))
            yield out(2, one, part, run["n"], run["last"])
        if last and not run["edge"]:
            for rows, lead in run["rows"]:
                yield out(1, rows, part, lead)

    return stream


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, partitions: int | None = None) -> DataFrame:
    """(__id, __text_hash, __keep): a zlib-packed bitmap, bit i set if line i stays, per document that loses lines.

    Lines whose key stands in at least min_docs documents are dropped; keep_first lets the first of them, by document id
    and position, stay.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = line_rows(docs, min_chars).repartitionByRange(n, "h1", "h2", "id", "th", "pos").sortWithinPartitions("h1", "h2", "id", "th", "pos")
    path = scratch(spark, "lines")
    rows.mapInArrow(_decided(min_docs, keep_first), _FOUND).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(_FOUND).parquet(path)
    totals: dict[tuple[int, int], list] = {}
    # At most two rows a partition, whatever the input.
    for r in sorted(found.where("kind = 2").collect(), key=lambda r: r["part"]):
        seen = totals.setdefault((r["h1"], r["h2"]), [0, None, r["part"]])
        seen[0] += r["n_docs"] - (seen[1] == (r["id"], r["th"]))
        seen[1] = (r["last_id"], r["last_th"])
    hot = [(a, b, part) for (a, b), (docs_with, _, part) in totals.items() if docs_with >= min_docs]
    hot = spark.createDataFrame(hot, "h1 long, h2 long, opens int")
    late = found.where("kind = 1").join(F.broadcast(hot), ["h1", "h2"])
    if keep_first:  # the run's first line is the one that opens it in the partition where it begins
        late = late.where(~((F.col("part") == F.col("opens")) & (F.col("n_docs") == 1)))
    gone = found.where("kind = 0").select("id", "th", "pos").unionByName(late.select("id", "th", "pos"))

    @F.pandas_udf("binary")
    def packed(positions):
        out = []
        for x in positions:
            bits = np.ones(int(max(x)) // 8 * 8 + 8, np.uint8)  # whole bytes: lines past the last one that goes stay
            bits[np.asarray(x)] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        import pandas as pd

        return pd.Series(out)

    lists = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("positions"))
    return lists.select(F.col("id").alias(ID), F.col("th").alias(TEXT_HASH), packed("positions").alias(MAP))


def _kept_lines(text: str, packed: bytes | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    if packed is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")
    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs as the column row, beside __keep, null for documents that lose nothing."""
    keyed = wrapped(docs, F.col("doc_id").cast("long").alias(ID), F.xxhash64(text_or_empty()).alias(TEXT_HASH))
    other = bitmaps.select(F.col(ID).alias("__id2"), F.col(TEXT_HASH).alias("__th2"), MAP)
    joined = keyed.join(other, F.col(ID).eqNullSafe(F.col("__id2")) & (F.col(TEXT_HASH) == F.col("__th2")), "left")
    return joined.select("row", MAP)


def _kept_text(text, packed):
    import pandas as pd

    return pd.Series([_kept_lines(t, k)[0] for t, k in zip(text, packed, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with their repeated lines gone from text; columns as they came."""
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first))
    kept = F.when(F.col(MAP).isNull(), F.col("row.text")).otherwise(F.pandas_udf(_kept_text, "string")(text_or_empty("row.text"), F.col(MAP)))
    return unwrapped(marked, docs.columns, text=kept)


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text, a row per document."""
    marked = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars))

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def digest(text, packed):
        import pandas as pd

        rows = [_kept_lines(t, k) for t, k in zip(text, packed, strict=True)]
        return pd.DataFrame([(n, d, hashlib.sha256(t.encode()).hexdigest()) for t, n, d in rows], columns=["n_lines", "n_dropped", "kept_sha256"])

    return marked.select("row.doc_id", digest(text_or_empty("row.text"), F.col(MAP)).alias("x")).select("doc_id", "x.*")
