"""Parameters of filters as rows: their ranges, and defaults for loose JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least and the largest that each parameter may be.
LIMITS = {
    "levels": (2.0, 256.0),
    "scale": (0.1, 4.0),
    "pixel_size": (1.0, 32.0),
    "cell": (2.0, 64.0),
    "wavelength": (2.0, 256.0),
    "amplitude": (0.0, 1.0),
    "bias": (-0.5, 0.5),
    "channel_levels": (2.0, 16.0),
    "gamma": (0.1, 10.0),
    "glow_radius": (0.5, 2.0),
    "glow_intensity": (0.0, 4.0),
    "crt_period": (2.0, 8.0),
    "adjust": (-1.0, 1.0),
    "noise": (0.0, 1.0),
    "opacity": (0.0, 1.0),
}
# What a filter's parameters are where nothing is said.
DEFAULTS = {"glitch": {"intensity": 0.5, "seed": 42.0}, "glow": {"radius": 2.0, "intensity": 1.0, "threshold": 0.0}, "crt": {"period": 2.0, "strength": 0.5}}


def violations(params: DataFrame) -> DataFrame:
    """params (name, value and others) with reason: the rows whose value is missing, not finite, out of its range, or of no known name."""
    limits = F.create_map(*(x for name, (low, high) in LIMITS.items() for x in (F.lit(name), F.array(F.lit(low), F.lit(high)))))
    range_ = limits[F.col("name")]
    value = F.col("value").cast("double")
    reason = F.when(range_.isNull(), "name").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not a number").when(~value.between(range_[0], range_[1]), "range")
    return params.withColumn("reason", reason).where(F.col("reason").isNotNull())


def with_defaults(kind: str, json: Column) -> dict[str, Column]:
    """The parameters of a kind of filter out of loose JSON: keys that it lacks, or whose value is no number, take the default."""
    loose = F.from_json(json, ", ".join(f"{name} double" for name in DEFAULTS[kind]))
    return {name: F.coalesce(loose[name], F.lit(value)) for name, value in DEFAULTS[kind].items()}


def updated(kind: str, old: dict[str, Column], json: Column) -> dict[str, Column]:
    """A filter's parameters after an update: {} keeps them, an adjustment merges the keys that are there, others fall back to defaults."""
    names = list(old)
    loose = F.from_json(json, ", ".join(f"{name} double" for name in names))
    empty = F.size(F.json_object_keys(json)) == 0
    rest = lambda n: old[n] if kind == "adjust" else F.when(empty, old[n]).otherwise(F.lit(DEFAULTS.get(kind, {}).get(n, 0.0)))
    return {n: F.coalesce(loose[n], rest(n)) for n in names}


# The version in which each kind of filter, and each mode of a dither, first was there.
SINCE = {"curves": "0.1.0", "levels": "0.1.0", "dither": "0.1.0", "palette_quantize": "0.1.0", "glitch": "0.1.0", "placeholder": "0.1.0", "glow": "0.1.0", "crt": "0.1.0", "adjust": "0.2.0"}
MODES_SINCE = {m: "0.1.0" for m in ("bayer2", "bayer4", "bayer8", "map", "wave", "halftone", "floyd_steinberg", "atkinson", "jarvis_judice_ninke", "stucki", "burkes", "sierra")}


def version(text: Column) -> Column:
    """(major, minor, patch) of a text like 1.2.3, which compare as versions do; null for any other text."""
    part = lambda k: F.split(text, r"\.")[k].cast("int")
    return F.when(text.rlike(r"^[0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}$"), F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def min_versions(filters: DataFrame, keys: list[str], current: str) -> DataFrame:
    """keys, needs: the least version that knows all of a key's filters (kind, mode); a kind, or a dither's mode, of no known
    version needs the current one."""
    since = lambda table, c: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(c)], F.lit(current))
    mode = F.when((F.col("kind") == "dither") & F.col("mode").isNotNull(), version(since(MODES_SINCE, "mode")))
    best = F.max(F.greatest(version(since(SINCE, "kind")), mode))
    text = lambda v: F.concat_ws(".", *(v[x].cast("string") for x in ("major", "minor", "patch")))
    return filters.groupBy(*keys).agg(best.alias("v")).select(*keys, text(F.col("v")).alias("needs"))
