"""Palette files as DataFrames (name, i, r, g, b in bytes): GPL, CSV, JSON, ASE, ACO and RIFF PAL, and the way back.

Files are read by Spark (binaryFile) and parsed one file a row; a palette has 1 to 65,536 colours.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 65536
#: As many colours as a file of any kind takes: ACO and RIFF PAL count them in 16 bits.
A_FILE = 65535
Byte3 = tuple[int, int, int]


class PaletteError(ValueError):
    """A file that is no palette of its kind, is empty, or is too large."""


def _checked(colors: list[Byte3]) -> list[Byte3]:
    if not colors:
        raise PaletteError("an empty palette")
    if len(colors) > MOST:
        raise PaletteError(f"more than {MOST} colours")
    return colors


def _byte(text: str) -> int:
    v = int(text)
    if not 0 <= v <= 255:
        raise PaletteError(f"{text} is no byte")
    return v


def parse_gpl(data: bytes) -> list[Byte3]:
    lines = data.decode("utf-8", "replace").splitlines()
    if not lines or lines[0].strip() != "GIMP Palette":
        raise PaletteError("no GIMP palette")
    out = []
    for line in lines[1:]:
        line = line.strip()
        if not line or line.startswith("#") or re.match(r"(Name|Columns):", line):
            continue
        parts = line.split()
        if len(parts) < 3:
            raise PaletteError(f"not a colour: {line}")
        out.append(tuple(_byte(p) for p in parts[:3]))
    return out


def parse_csv(data: bytes) -> list[Byte3]:
    rows = [x.split(",") for x in data.decode("utf-8", "replace").splitlines() if x.strip()]
    if rows and re.match(r"\s*[A-Za-z]", rows[0][0]):
        rows = rows[1:]
    return [tuple(_byte(p.strip()) for p in row[:3]) for row in rows]


def parse_json(data: bytes) -> list[Byte3]:
    """An array of objects (r, R, red, Red and so on) or of arrays of three or more; numbers are clamped and cut off."""
    names = [("r", "R", "red", "Red"), ("g", "G", "green", "Green"), ("b", "B", "blue", "Blue")]
    clip = lambda v: int(min(max(float(v), 0), 255))
    out = []
    for x in json.loads(data):
        if isinstance(x, dict):
            out.append(tuple(clip(next((x[n] for n in group if n in x), 0)) for group in names))
        elif isinstance(x, list) and len(x) >= 3:
            out.append(tuple(clip(v) for v in x[:3]))
        else:
            raise PaletteError(f"not a colour: {x}")
    return out


def parse_ase(data: bytes) -> list[Byte3]:
    """Big-endian blocks; colour entries in RGB, others are passed over."""
    if data[:4] != b"ASEF":
        raise PaletteError("no ASE file")
    out, at = [], 12
    for _ in range(struct.unpack_from(">I", data, 8)[0]):
        kind, size = struct.unpack_from(">HI", data, at)
        if kind == 1:
            name = struct.unpack_from(">H", data, at + 6)[0]
            model = at + 8 + 2 * name
            if data[model : model + 4] == b"RGB ":
                out.append(tuple(int(min(max(v, 0.0), 1.0) * 255 + 0.5) for v in struct.unpack_from(">3f", data, model + 4)))
        at += 6 + size
    return out


def parse_aco(data: bytes) -> list[Byte3]:
    """Version 1 or 2; the high bytes of colours in the RGB space."""
    version, n = struct.unpack_from(">HH", data)
    if version not in (1, 2):
        raise PaletteError("no ACO file")
    out, at = [], 4
    for _ in range(n):
        space, *v = struct.unpack_from(">5H", data, at)
        at += 10
        if version == 2:
            at += 4 + 2 * struct.unpack_from(">I", data, at)[0]
        if space == 0:
            out.append(tuple(x >> 8 for x in v[:3]))
    return out


def parse_pal(data: bytes) -> list[Byte3]:
    """RIFF chunks; the one named data has a count and four bytes a colour."""
    if data[:4] != b"RIFF" or data[8:12] != b"PAL ":
        raise PaletteError("no RIFF palette")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"data":
            n = struct.unpack_from("<H", data, at + 10)[0]
            return [tuple(data[at + 12 + 4 * i : at + 15 + 4 * i]) for i in range(n)]
        at += 8 + size + size % 2
    raise PaletteError("a RIFF palette without data")


PARSERS = {"gpl": parse_gpl, "csv": parse_csv, "json": parse_json, "ase": parse_ase, "aco": parse_aco, "pal": parse_pal}


def parse(data: bytes, kind: str) -> list[Byte3]:
    if kind.lower() not in PARSERS:
        raise PaletteError(f"no palette format {kind}")
    return _checked(PARSERS[kind.lower()](data))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of colours a file; bodies are parsed where they lie, one after the other."""
    for files in batches:
        for name, kind, body in zip(*files.columns, strict=True):
            colors = np.array(parse(body.as_py(), kind.as_py()), np.int32)
            rgb = [pa.array(np.ascontiguousarray(c)) for c in colors.T]
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(colors), pa.string()), pa.array(np.arange(len(colors), dtype=np.int32)), *rgb], names=["name", "i", "r", "g", "b"])


def parsed(bodies: DataFrame) -> DataFrame:
    """bodies: name, kind, body (bytes)."""
    return bodies.select("name", "kind", F.col("body").cast("binary").alias("body")).mapInArrow(_rows, "name string, i int, r int, g int, b int")


def read_palettes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return parsed(files.select(F.col("path").alias("name"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), F.col("content").alias("body")))


def to_gpl(colors: list[Byte3], name: str = "palette") -> bytes:
    return "".join([f"GIMP Palette\nName: {name}\nColumns: 0\n#\n", *(f"{r:3d} {g:3d} {b:3d}\tUntitled\n" for r, g, b in colors)]).encode()


def to_csv(colors: list[Byte3], name: str = "") -> bytes:
    return "".join(["r,g,b\n", *(f"{r},{g},{b}\n" for r, g, b in colors)]).encode()


def to_json(colors: list[Byte3], name: str = "") -> bytes:
    return ("[" + ", ".join(['{"r": %d, "g": %d, "b": %d}' % tuple(c) for c in colors]) + "]").encode()


def to_ase(colors: list[Byte3], name: str = "") -> bytes:
    out = [b"ASEF", struct.pack(">HHI", 1, 0, len(colors))]
    for i, c in enumerate(colors):
        label = f"{i}\0".encode("utf-16-be")
        body = struct.pack(">H", len(label) // 2) + label + b"RGB " + struct.pack(">3fH", *(v / 255 for v in c), 2)
        out.append(struct.pack(">HI", 1, len(body)) + body)
    return b"".join(out)


def to_aco(colors: list[Byte3], name: str = "") -> bytes:
    return struct.pack(">HH", 1, len(colors)) + b"".join(struct.pack(">5H", 0, *(v * 257 for v in c), 0) for c in colors)


def to_pal(colors: list[Byte3], name: str = "") -> bytes:
    body = struct.pack("<HH", 0x300, len(colors)) + b"".join(bytes((*c, 0)) for c in colors)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"PAL data" + struct.pack("<I", len(body)) + body


WRITERS = {"gpl": to_gpl, "csv": to_csv, "json": to_json, "ase": to_ase, "aco": to_aco, "pal": to_pal}


def encoded(colors: DataFrame, kind: str) -> DataFrame:
    """(name, kind, body) of palettes given as name, i, r, g, b; a palette, bounded in size, is one group."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        name = rows.column("name")[0].as_py()
        body = WRITERS[kind](_checked(list(zip(*(rows.column(c).to_pylist() for c in "rgb"), strict=True))), name)
        return pa.table({"name": pa.array([name], pa.string()), "kind": [kind], "body": pa.array([body], pa.binary())})

    return colors.groupBy("name").applyInArrow(pack, "name string, kind string, body binary")


def parsed_text(bodies: DataFrame) -> DataFrame:
    """GPL text (name, body) by Spark's own functions: a row per colour, lines that are none left out."""
    lines = bodies.select("name", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    at = lambda k: F.regexp_extract("text", r"^\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})(\s|$)", k)
    found = lines.select("name", "line", *(at(k).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b")))).where("r <> ''")
    return found.select("name", "line", *(F.col(c).cast("int").alias(c) for c in "rgb")).where("r <= 255 AND g <= 255 AND b <= 255")
