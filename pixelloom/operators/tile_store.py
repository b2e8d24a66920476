"""A store of tiles that is asked by URL: what an answer is, and where its tile lies.

Tiles are partitioned by stage and level, and sorted in files by document, layer and Morton order of their place, so that a
lookup opens the folders of the stages and levels that are asked for alone, and skips in them by the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["doc", "layer", "stage", "level", "tx", "ty"]
STAGES = ("raw", "processed", "composite")
U32 = 2**32 - 1


def morton(x: Column, y: Column) -> Column:
    """Bits of x and y by turns, of places below 2^24."""
    bits = [F.shiftleft(F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 2 * i + k) for i in range(24) for k, v in ((0, x), (1, y))]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def tile_url(doc: Column, layer: Column, stage: Column, level: Column, tx: Column, ty: Column) -> Column:
    """The URL of a tile; a null layer is the whole document's composite."""
    name = F.coalesce(layer.cast("string"), F.lit("composite"))
    return F.concat(F.lit("tile://doc/"), doc.cast("string"), F.lit("/layer/"), name, F.lit("/stage/"), stage, F.lit("/l/"), level.cast("string"), F.lit("/"), tx.cast("string"), F.lit("/"), ty.cast("string"))


def parsed(requests: DataFrame) -> DataFrame:
    """requests (url, ...) with doc, layer (0 for the composite), stage, level, tx, ty, and whether the URL is well formed.

    After the scheme (and a host named localhost) and without query or fragment there are ten parts between slashes, empty
    ones not counted: four names, and numbers that 32 bits (of level, 8 bits) hold.
    """
    path = F.regexp_extract("url", r"^tile://(?:localhost/)?([^?#]*)", 1)
    parts = requests.withColumn("__p", F.filter(F.split(path, "/"), lambda s: s != ""))
    part = lambda i: F.get("__p", F.lit(i))
    number = lambda i: F.when(part(i).rlike(r"^\+?[0-9]+$") & (F.length(F.regexp_replace(part(i), r"^\+?0*", "")) <= 10), F.regexp_replace(part(i), r"^\+", "").try_cast("long"))
    bounded = lambda i, most: F.when(number(i) <= most, number(i))
    found = parts.withColumns({
        "doc": bounded(1, U32), "layer": F.when(part(3) == "composite", F.lit(0).cast("long")).otherwise(bounded(3, U32)), "whole": F.coalesce(part(3) == "composite", F.lit(False)),
        "stage": F.when(part(5).isin(*STAGES), part(5)), "level": bounded(7, 255).cast("int"), "tx": bounded(8, U32), "ty": bounded(9, U32),
    })
    names = (F.size("__p") == 10) & (part(0) == "doc") & (part(2) == "layer") & (part(4) == "stage") & (part(6) == "l")
    complete = names & F.expr(" AND ".join(f"{c} IS NOT NULL" for c in KEY)) & F.col("url").startswith("tile://")
    return found.withColumn("well_formed", F.coalesce(complete, F.lit(False))).drop("__p")


def write_store(tiles: DataFrame, path: str) -> None:
    """Tiles (doc, layer, stage, level, tx, ty, generation, dirty, ...), one a key, as a store in path."""
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tiles.withColumn("place", morton(F.col("tx"), F.col("ty")))
    placed.repartitionByRange(parts, "stage", "level", "doc", "layer", "place").sortWithinPartitions("stage", "level", "doc", "layer", "place").write.mode("overwrite").partitionBy("stage", "level").parquet(path)


def read_store(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The tiles of the stages and levels (at most 3 x 256) that wanted names."""
    named = [(r["stage"], r["level"]) for r in wanted.select("stage", "level").distinct().collect()]
    store = spark.read.parquet(path)
    if not named:
        return store.limit(0)
    pruned = F.lit(False)
    for stage in {s for s, _ in named}:
        pruned = pruned | ((F.col("stage") == stage) & F.col("level").isin([n for s, n in named if s == stage]))
    return store.where(pruned)


def answered(requests: DataFrame, documents: DataFrame, layers: DataFrame, path: str, tile: int = 256) -> DataFrame:
    """requests with status and, for 200, the tile's generation (and what else the store holds of it).

    400: the URL is malformed. 404: no such document (doc, width, height, generation), no such layer (doc, layer) of it,
    or a place outside of the level's grid. 200: the store has the tile, clean and not behind the document's generation.
    202: it is yet to be made.
    """
    spark = requests.sparkSession
    asked = parsed(requests)
    docs = documents.select(F.col("doc").alias("__doc"), "width", "height", F.col("generation").alias("__live"))
    known = layers.select(F.col("doc").alias("__d"), F.col("layer").alias("__l")).distinct().withColumn("__known", F.lit(True))
    rows = asked.join(docs, (asked["doc"] == docs["__doc"]) & asked["well_formed"], "left").join(known, (F.col("doc") == F.col("__d")) & (F.col("layer") == F.col("__l")), "left")
    side = F.pow(F.lit(2.0), F.col("level")) * tile
    inside = (F.col("tx") < F.ceil(F.col("width") / side)) & (F.col("ty") < F.ceil(F.col("height") / side))
    valid = F.col("__doc").isNotNull() & (F.col("whole") | F.col("__known").isNotNull()) & inside
    rows = rows.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    wanted = rows.where("__valid").select("stage", "level")
    store = read_store(spark, path, wanted)
    rest = [c for c in store.columns if c not in (*KEY, "generation", "dirty", "place")]
    store = store.select(*(F.col(c).alias(f"__s_{c}") for c in KEY), F.col("generation"), F.col("dirty").alias("__dirty"), *rest)
    on = F.col("__valid")
    for c in KEY:
        on = on & (F.col(c) == F.col(f"__s_{c}"))
    joined = rows.join(store, on, "left")
    ready = F.coalesce(~F.col("__dirty") & (F.col("generation") >= F.col("__live")), F.lit(False))
    status = F.when(~F.col("well_formed"), 400).when(~F.col("__valid"), 404).when(ready, 200).otherwise(202)
    kept = [F.when(status == 200, F.col(c)).alias(c) for c in ("generation", *rest)]
    return joined.select(*(F.col(c) for c in requests.columns), status.alias("status"), *kept)
