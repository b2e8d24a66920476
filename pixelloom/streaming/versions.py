"""Documents as versions of a log: edits, undo and redo replayed side by side, snapshots, and the state at a version.

A log has a row (doc, seq, op) for each edit, undo or redo; seq orders a document's rows and is unique in it. An edit makes
the version named by its seq and ends what could be redone. A version's level is the number of edits that lead to it, so
that the version that stands is the last edit at the present level. Undo goes back at most depth edits.

Of a document no more than (how much can be undone, how much that and what can be redone come to) decides what a row does,
both at most depth. What a range of the log does to every such state is a table; tables of ranges compose in any grouping.
So the log is cut into ranges by (doc, seq), however long a document's part is; only documents that cross a cut need
tables, at most one a cut; then all ranges are replayed at once, a row at a time from their known states. A version that an
earlier range made is looked up by level among the last edits a range makes at each.

Defined cases: a row without doc or seq takes no part; an op that is none of the three, an undo of nothing and a redo of
nothing change nothing (applied is false); the version of a document without standing edits is null; an empty log gives
empty results; other columns are not read by history() and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.plans.store import scratch

DEPTH = 50
EDIT, UNDO, REDO, NONE, HEAD = range(5)


@dataclass(frozen=True)
class Snapshot:
    """heads: doc, level, undo, redo of each document; slots: the edit (doc, level, version) at each level up to what can be redone."""

    heads: DataFrame
    slots: DataFrame


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Transfer:
    """What rows do to each state (s edits to undo, m of them and of those to redo) and to the level."""

    def __init__(self, depth: int):
        self.depth = depth
        self.m, self.s = np.tril_indices(depth + 1)
        self.level = np.zeros(len(self.s), np.int64)
        self.fixed = False

    def run(self, op: int, times: int) -> None:
        """times equal rows."""
        if op == EDIT:
            self.level += times
            self.s = np.minimum(self.s + times, self.depth)
            self.m = self.s
        elif op == UNDO:
            back = np.minimum(self.s, times)
            self.s, self.level = self.s - back, self.level - back
        elif op == REDO:
            on = np.minimum(self.m - self.s, times)
            self.s, self.level = self.s + on, self.level + on

    def start(self, level: int, undo: int, redo: int) -> None:
        self.level, self.s, self.m = (np.full(len(self.s), x) for x in (level, undo, undo + redo))
        self.fixed = True

    def table(self) -> bytes:
        return np.stack([self.s, self.m, self.level]).astype("<i8").tobytes()


def _carried(tables: Iterator[tuple[int, bytes, bool]]):
    """(part, level, undo, redo) at the begin of each part, from a document's tables in order."""
    level = s = m = 0
    for part, table, fixed in tables:
        yield part, level, s, m - s
        found = np.frombuffer(table, "<i8").reshape(3, -1)[:, m * (m + 1) // 2 + s].tolist()
        s, m, level = found[0], found[1], found[2] + (0 if fixed else level)


def _segments(batches: Iterator[pa.RecordBatch]):
    """(whether a new (part, doc) begins, batch of its rows), from sorted batches."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, parts = batch.column("doc"), np.asarray(batch.column("part"))
        coded = docs.dictionary_encode()
        codes = np.asarray(coded.indices)
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (parts[1:] != parts[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = (int(parts[a]), docs[a].as_py())
            yield key != last, batch.slice(a, b - a)
            last = key


def history(log: DataFrame, depth: int = DEPTH, start: Snapshot | None = None) -> DataFrame:
    """Every row of a log as doc, seq, op, applied, version, level, undo, redo: what stands after it and how far one can go.

    With start, the log goes on from that snapshot; its versions are found among the snapshot's slots.
    """
    spark = log.sparkSession
    kind = F.when(F.col("op") == "edit", EDIT).when(F.col("op") == "undo", UNDO).when(F.col("op") == "redo", REDO).otherwise(NONE)
    nothing = F.lit(0).cast("long")
    rows = log.where("doc IS NOT NULL AND seq IS NOT NULL").select("doc", F.lit(1).alias("late"), F.col("seq").cast("long").alias("seq"), "op", kind.cast("int").alias("kind"), *(nothing.alias(c) for c in ("level", "undo", "redo")))
    if start is not None:
        heads = start.heads.select("doc", F.lit(0).alias("late"), nothing.alias("seq"), F.lit("").alias("op"), F.lit(HEAD).alias("kind"), *(F.col(c).cast("long").alias(c) for c in ("level", "undo", "redo")))
        rows = rows.unionByName(heads)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = _kept(rows.repartitionByRange(parts, "doc", "late", "seq").withColumn("part", F.spark_partition_id()), "ranges")
    doc = cut.schema["doc"].dataType
    named = doc.simpleString()
    crossing = cut.groupBy("doc", "part").agg(F.count("*").alias("n")).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None

        def row():
            return pa.RecordBatch.from_arrays([key[0], key[1], pa.array([state.table()]), pa.array([state.fixed])], names=["doc", "part", "table", "fixed"])

        for new, piece in _segments(batches):
            if new:
                if state is not None:
                    yield row()
                state, key = Transfer(depth), (piece.column("doc").slice(0, 1), piece.column("part").slice(0, 1))
            kinds = np.asarray(piece.column("kind"))
            cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
                if kinds[a] == HEAD:
                    state.start(*(piece.column(c)[a].as_py() for c in ("level", "undo", "redo")))
                else:
                    state.run(int(kinds[a]), b - a)
        if state is not None:
            yield row()

    def carry(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("part")
        states = list(_carried(zip(found["part"].tolist(), found["table"], found["fixed"].tolist(), strict=True)))
        return pd.DataFrame({"doc": found["doc"].to_numpy(), **{c: [s[i] for s in states] for i, c in enumerate(("part", "from_level", "from_undo", "from_redo"))}})

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = s = m = 0
        own: dict[int, int] = {}  # the segment's own edits by level, those in reach
        for new, piece in _segments(batches):
            if new:
                level, s, m = (piece.column(c)[0].as_py() or 0 for c in ("from_level", "from_undo", "from_redo"))
                m += s
                own = {}
            out: list[tuple] = []
            for seq, kind, *head in zip(*(piece.column(c).to_pylist() for c in ("seq", "kind", "level", "undo", "redo")), strict=True):
                applied = True
                if kind == EDIT:
                    level, s = level + 1, min(s + 1, depth)
                    m = s
                    own[level] = seq
                    if len(own) > 4 * depth + 4:
                        own = {k: own[k] for k in range(level - s, level + 1) if k in own}
                elif kind == UNDO and s > 0:
                    level, s = level - 1, s - 1
                elif kind == REDO and m > s:
                    level, s = level + 1, s + 1
                elif kind == HEAD:
                    level, s, m = head[0], head[1], head[1] + head[2]
                else:
                    applied = False
                version = own.get(level)
                out.append((applied, version, level, s, m - s, version is None and level > 0))
            applied, version, levels, undo, redo, asks = zip(*out, strict=True)
            columns = [piece.column(c) for c in ("doc", "part", "seq", "op", "kind")]
            columns += [pa.array(applied), pa.array(version, pa.int64()), *(pa.array(x, pa.int64()) for x in (levels, undo, redo)), pa.array(asks)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "part", "seq", "op", "kind", "applied", "version", "level", "undo", "redo", "asks"])

    def laid(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions("part", "doc", "late", "seq").drop("late")

    # at most a document a cut, and two ranges' tables a cut
    straddling = cut.join(F.broadcast(crossing), "doc", "left_semi").repartition(parts, "part")
    begun = laid(straddling).mapInArrow(tables, f"doc {named}, part int, table binary, fixed boolean")
    begun = begun.groupBy("doc").applyInPandas(carry, f"doc {named}, part int, from_level long, from_undo long, from_redo long")
    replayed = laid(cut.repartition(parts, "part").join(F.broadcast(begun), ["doc", "part"], "left"))
    found = _kept(replayed.mapInArrow(replay, f"doc {named}, part int, seq long, op string, kind int, applied boolean, version long, level long, undo long, redo long, asks boolean"), "versions")

    last = found.where(F.col("kind") == EDIT).groupBy("doc", "part", "level").agg(F.max("seq").alias("made"))
    if start is not None:
        last = last.unionByName(start.slots.select("doc", F.lit(-1).alias("part"), F.col("level").cast("long").alias("level"), F.col("version").alias("made")))
    asked = found.where("asks").select("doc", "part", "level").distinct()
    both = last.withColumn("made_here", F.lit(1)).unionByName(asked.withColumns({"made": F.lit(None).cast("long"), "made_here": F.lit(0)}))
    before = F.last("made", ignorenulls=True).over(Window.partitionBy("doc", "level").orderBy("part", "made_here").rowsBetween(Window.unboundedPreceding, -1))
    answers = both.withColumn("earlier", before).where("made_here = 0").select("doc", "part", "level", "earlier")
    columns = ["doc", "seq", "op", "applied", "version", "level", "undo", "redo"]
    own = found.where((F.col("kind") != HEAD) & ~F.col("asks")).select(*columns)
    other = found.where((F.col("kind") != HEAD) & F.col("asks")).join(answers, ["doc", "part", "level"], "left").withColumn("version", F.col("earlier"))
    return own.unionByName(other.select(*columns))


def snapshot(entries: DataFrame, start: Snapshot | None = None) -> Snapshot:
    """Where documents stand after the rows that history() gave, for a later log to go on from; start as given to history()."""
    heads = entries.groupBy("doc").agg(F.max(F.struct("seq", "level", "undo", "redo")).alias("v")).select("doc", "v.level", "v.undo", "v.redo")
    made = entries.where("op = 'edit'").groupBy("doc", "level").agg(F.max("seq").alias("version"))
    if start is not None:
        heads = heads.unionByName(start.heads.select("doc", "level", "undo", "redo").join(heads, "doc", "left_anti"))
        made = made.unionByName(start.slots.select("doc", "level", "version").join(made, ["doc", "level"], "left_anti"))
    reach = heads.select("doc", (F.col("level") + F.col("redo")).alias("reach"))
    return Snapshot(heads, made.join(reach, "doc").where("level <= reach").select("doc", "level", "version"))


def checkout(log: DataFrame, at: Snapshot, keys: list[str]) -> DataFrame:
    """What stands at a snapshot: of each document and keys the other columns of the log's last standing edit.

    The log holds every edit that the snapshot's slots name; keys, seq and op are not among the values.
    """
    values = [c for c in log.columns if c not in ("doc", "seq", "op", *keys)]
    standing = at.slots.join(at.heads.select("doc", F.col("level").alias("top")), "doc").where("level <= top")
    edits = log.where("op = 'edit'").withColumnRenamed("seq", "version").join(standing.select("doc", "version", F.col("level").alias("__level")), ["doc", "version"])
    best = F.max(F.struct("__level", "version", *values)).alias("v")
    return edits.groupBy("doc", *keys).agg(best).select("doc", *keys, F.col("v.version").alias("version"), *(F.col("v")[c].alias(c) for c in values))
