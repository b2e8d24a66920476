"""Changes to documents as a stream: what they make stale, newest-wins tables, and late results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.store import removed

CASCADE = {
    # kind of change: (stage, whether only the changed tile, whether only the changed layer)
    "raw": [("raw", True, True), ("processed", True, True), ("composite", True, False)],
    "filter": [("processed", False, True), ("composite", False, False)],
    "properties": [("composite", False, False)],
    "mask": [("processed", True, True), ("composite", True, False)],
}


def stale(tiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Distinct tiles (doc, layer, tx, ty, stage) that changes (doc, layer, tx, ty, kind) reach.

    A semi-join per rule; each goes by equality on document, stage and what the rule names.
    """
    found = None
    for kind, rules in CASCADE.items():
        for stage, same_tile, same_layer in rules:
            keys = ["doc", *(["tx", "ty"] if same_tile else []), *(["layer"] if same_layer else [])]
            hit = tiles.where(F.col("stage") == stage).join(changes.where(F.col("kind") == kind).select(*keys).distinct(), keys, "left_semi")
            found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def structure_stale(tiles: DataFrame, changes: DataFrame) -> DataFrame:
    """All distinct composites of every document if any change adds, removes or moves a layer (kind structure), else none."""
    any_change = F.broadcast(changes.where("kind = 'structure'").select(F.lit(1).alias("__any")).limit(1))
    hit = tiles.where("stage = 'composite'").withColumn("__any", F.lit(1)).join(any_change, "__any", "left_semi")
    return hit.select("doc", "layer", "tx", "ty", "stage").distinct()


def palette_changes(changed: DataFrame, references: DataFrame) -> DataFrame:
    """Changed palettes (doc, palette) as filter changes (doc, layer, kind) of the layers that refer to them (doc, layer, palette)."""
    layers = references.join(changed.select("doc", "palette").distinct(), ["doc", "palette"], "left_semi")
    return layers.select("doc", "layer").distinct().select("doc", "layer", F.lit(None).cast("long").alias("tx"), F.lit(None).cast("long").alias("ty"), F.lit("filter").alias("kind"))


def newest(rows: DataFrame, keys: list[str], version: str = "generation") -> DataFrame:
    """Of each key the row of the newest version; of equal versions the one with the largest values."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(version, *[c for c in rest if c != version])).alias("v")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col("v")[c].alias(c) for c in rest)).select(*rows.columns)


def current_only(results: DataFrame, generations: DataFrame) -> DataFrame:
    """Results made for the document's and the layer's current generation; all others are late."""
    return results.join(generations, ["doc", "layer", "doc_generation", "layer_generation"], "left_semi")


def ready(tiles: DataFrame) -> DataFrame:
    return tiles.where(~F.col("dirty") & (F.col("generation") >= F.col("doc_generation")))


def coalesced(requests: DataFrame) -> DataFrame:
    """One refresh per document and busy period: whether any asks to clear, and the layer of the last."""
    return requests.groupBy("doc", "period").agg(F.max(F.col("clear").cast("int")).alias("clear"), F.max_by("layer", "at").alias("layer"), F.count("*").alias("requests"))


def live_runs(batches: int, fan: int = 8) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold the first so many batches: fan runs of a level become one of the next."""
    out, level, left = [], 0, batches
    while left:
        out += [(level, left // fan * fan + i) for i in range(left % fan)]
        level, left = level + 1, left // fan
    return out


def upserted(spark, path: str, schema, batches: int, keys: list[str], version: str = "generation", fan: int = 8) -> DataFrame:
    """The newest-wins table of the first so many batches of an upsert_stream: at most fan runs a level."""
    runs = [f"{path}/level={level}/run={run}" for level, run in live_runs(batches, fan)]
    if not runs:
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(*runs), keys, version)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, version: str = "generation", then: Callable | None = None, fan: int = 8):
    """Starts a query that keeps the newest-wins table of a stream in path as runs; returns the running query.

    A batch writes its own newest rows as a run and reads nothing else. Every fan-th run of a level is merged with the
    fan - 1 before it into one of the next, so that a row is written again once a level and the table is never rewritten for
    a batch. Rows of an older version than one that is kept, in whatever batch they come, lose when runs are merged or
    read. A batch that runs again after a failure writes the same runs; those that a merge has replaced are removed a
    batch later. then(batch number, table so far) is called after each batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, number + 1
        newest(batch, keys, version).write.mode("overwrite").parquet(f"{path}/level=0/run={number}")
        level, size = 1, fan
        while done % size == 0:
            run = done // size - 1
            inputs = [f"{path}/level={level - 1}/run={run * fan + i}" for i in range(fan)]
            newest(spark.read.schema(batch.schema).parquet(*inputs), keys, version).write.mode("overwrite").parquet(f"{path}/level={level}/run={run}")
            level, size = level + 1, size * fan
        level, size = 1, fan  # what the batch before has merged
        while number and number % size == 0:
            for i in range(fan):
                removed(spark, f"{path}/level={level - 1}/run={(number // size - 1) * fan + i}")
            level, size = level + 1, size * fan
        if then is not None:
            then(upserted(spark, path, batch.schema, done, keys, version, fan), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
