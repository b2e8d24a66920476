"""Undo, redo and snapshots of a log against stacks that take one row after the other."""

import random

import pytest
from pyspark.sql import functions as F

from pixelloom.streaming import versions


def by_stacks(log, depth):
    out, docs = {}, {}
    for doc, seq, op in sorted(log):
        undo, redo, at, path = docs.get(doc, ([], [], None, []))
        applied = True
        if op == "edit":
            undo, redo, at, path = [*undo, at][-depth:], [], seq, [*path, seq]
        elif op == "undo" and undo:
            undo, redo, at, path = undo[:-1], [*redo, at], undo[-1], path[:-1]
        elif op == "redo" and redo:
            undo, redo, at, path = [*undo, at], redo[:-1], redo[-1], [*path, redo[-1]]
        else:
            applied = False
        docs[doc] = undo, redo, at, path
        out[doc, seq] = (applied, at, len(path), len(undo), len(redo))
    return out, {doc: path for doc, (_, _, _, path) in docs.items()}


def made(rows, hot, seed, ops=("edit", "edit", "undo", "undo", "redo", "other")):
    draw = random.Random(seed)
    return [("hot" if draw.random() < hot else f"d{draw.randrange(40)}", seq, draw.choice(ops)) for seq in range(rows)]


def found(df):
    return {(r.doc, r.seq): (r.applied, r.version, r.level, r.undo, r.redo) for r in df.collect()}


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_history_of_a_document_over_all_ranges(spark, depth):
    log = made(3000, 0.6, depth) + [("long", 10 * s, "edit" if s < 400 or s % 7 == 0 else ("undo", "redo")[s % 3 == 0]) for s in range(900)]
    df = spark.createDataFrame(log, "doc string, seq long, op string")
    assert found(versions.history(df, depth)) == by_stacks(log, depth)[0]


def test_going_on_from_snapshots(spark):
    log = made(2400, 0.5, 9)
    expected, paths = by_stacks(log, 50)
    df = spark.createDataFrame([(*r, r[1] % 4, f"v{r[1]}") for r in log], "doc string, seq long, op string, layer int, name string")
    start, seen = None, {}
    for a in (0, 700, 1500):
        piece = versions.history(df.where(F.col("seq").between(a, {0: 699, 700: 1499, 1500: 9999}[a])), start=start)
        seen.update(found(piece))
        start = versions.snapshot(piece, start)
    assert seen == expected
    state = {(doc, seq % 4): seq for doc, path in paths.items() for seq in sorted(path)}
    assert {(r.doc, r.layer): (r.version, r.name) for r in versions.checkout(df, start, ["layer"]).collect()} == {k: (s, f"v{s}") for k, s in state.items()}


def test_rows_that_take_no_part(spark):
    df = spark.createDataFrame([(None, 1, "edit"), ("a", None, "edit"), ("a", 2, "undo"), ("a", 3, None), ("a", 4, "edit"), ("a", 5, "redo")], "doc string, seq long, op string")
    assert found(versions.history(df)) == {("a", 2): (False, None, 0, 0, 0), ("a", 3): (False, None, 0, 0, 0), ("a", 4): (True, 4, 1, 1, 0), ("a", 5): (False, 4, 1, 1, 0)}
    assert versions.history(df.limit(0)).count() == 0


def test_tables_compose_in_any_grouping():
    draw = random.Random(4)
    runs = [(draw.randrange(3), draw.randrange(1, 5)) for _ in range(60)]
    whole = versions.Transfer(6)
    for r in runs:
        whole.run(*r)
    tables = []
    for a in range(0, 60, 13):
        t = versions.Transfer(6)
        for r in runs[a : a + 13]:
            t.run(*r)
        tables.append((a, t.table(), False))
    last = versions.Transfer(6)
    *_, (_, level, undo, redo) = versions._carried([*tables, (99, last.table(), False)])
    assert (level, undo, undo + redo) == (whole.level[0], whole.s[0], whole.m[0])
