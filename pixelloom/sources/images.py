"""PNG files to and from pixel rows, and SVG documents; the decoder needs nothing but zlib."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 8192


class ImageError(ValueError):
    """A file that is no image this reader knows, or is too large."""


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 4 bytes. Grey, RGB, palette, with or without alpha, of 8 bits (grey and palette of 1 too)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ImageError("no PNG file")
    at, packed, plte, trns = 8, [], b"", b""
    width = height = depth = kind = 0
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if not (1 <= width <= MOST and 1 <= height <= MOST) or interlace or depth not in (1, 8) or (depth == 1 and kind not in (0, 3)):
                raise ImageError("a kind of PNG that is not read")
        packed += [body] if name == b"IDAT" else []
        plte, trns = (body if name == b"PLTE" else plte), (body if name == b"tRNS" else trns)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, stride + 1)
    out, before = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if rule == 2:
            line = line + before
        elif rule in (1, 3, 4):
            line, up = line.tolist(), before.tolist()
            for x in range(stride):
                a = line[x - step] if x >= step else 0
                c = up[x - step] if x >= step else 0
                if rule == 1:
                    p = a
                elif rule == 3:
                    p = (a + up[x]) // 2
                else:
                    e = a + up[x] - c
                    p = min((a, up[x], c), key=lambda v: abs(e - v))
                line[x] = (line[x] + p) & 255
        out[y] = before = np.asarray(line).astype(np.uint8)
    if depth == 1:
        out = np.unpackbits(out, axis=1)[:, :width] * (255 if kind == 0 else 1)
    px = out.reshape(height, width, channels)
    full = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(plte) // 3, :3] = np.frombuffer(plte, np.uint8).reshape(-1, 3)
        table[: len(trns), 3] = np.frombuffer(trns, np.uint8)
        return table[px[..., 0]]
    full[..., :3] = px[..., :1] if channels < 3 else px[..., :3]
    if channels in (2, 4):
        full[..., 3] = px[..., -1]
    return full


def encode_png(px: np.ndarray) -> bytes:
    """From height x width x 4 bytes."""
    height, width, _ = px.shape
    raw = np.concatenate((np.zeros((height, 1), np.uint8), px.reshape(height, -1)), 1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, gx, gy, r, g, b, a): bytes over 255, no transfer curve; a file a row while it is decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for name, body in zip(some["path"], some["content"], strict=True):
                px = decode_png(bytes(body))
                for y, line in enumerate(px / 255.0):
                    yield pd.DataFrame({"name": name, "gx": np.arange(len(line), dtype=np.int32), "gy": np.int32(y), **{c: line[:, i] for i, c in enumerate("rgba")}})

    return files.mapInPandas(rows, "name string, gx int, gy int, r double, g double, b double, a double")


def to_png(pixels: DataFrame, mode: str = "export") -> DataFrame:
    """(image, png) of pixels (image, gx, gy, r, g, b, a) of images of up to 8192 x 8192, deflated in bands of rows."""
    from pixelloom.sources import png_files

    return png_files.to_png(pixels, mode)


def import_layer(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """An image at the origin of a canvas: clipped to it, and nothing where the image has no pixel."""
    n = pixels.sparkSession.range(width * height)
    grid = n.select((F.col("id") % width).cast("int").alias("gx"), F.floor(F.col("id") / width).cast("int").alias("gy"))
    return grid.join(pixels.select("gx", "gy", *"rgba"), ["gx", "gy"], "left").select("gx", "gy", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgba"))


def greedy_rectangles(px: np.ndarray) -> list[tuple[int, int, int, int, tuple]]:
    """(x, y, width, height, rgba) of rectangles of one colour: from each free pixel in row order wide first, then tall."""
    height, width, _ = px.shape
    key = px.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    free, out = px[..., 3] > 0, []
    for y in range(height):
        x = 0
        while x < width:
            if not free[y, x]:
                x += 1
                continue
            same = free[y, x:] & (key[y, x:] == key[y, x])
            w = int(np.argmin(same)) if not same.all() else len(same)
            h = 1
            while y + h < height and (free[y + h, x : x + w] & (key[y + h, x : x + w] == key[y, x])).all():
                h += 1
            free[y : y + h, x : x + w] = False
            out.append((x, y, w, h, tuple(int(v) for v in px[y, x])))
            x += w
    return out


def svg_document(rectangles: list[tuple[int, int, int, int, tuple]], width: int, height: int) -> str:
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" shape-rendering="crispEdges">']
    for x, y, w, h, (r, g, b, a) in rectangles:
        clear = "" if a == 255 else f' fill-opacity="{a / 255:.4f}"'
        parts.append(f'<rect x="{x}" y="{y}" width="{w}" height="{h}" fill="#{r:02x}{g:02x}{b:02x}"{clear}/>')
    return "\n".join([*parts, "</svg>\n"])


def allowed(path: str, extensions=(".png", ".gpl", ".ase", ".aco", ".pal", ".csv", ".json"), root: str | None = None, export: bool = False) -> str:
    """The real path of a file under root (the home folder); an export's folder is what is checked."""
    root = os.path.realpath(root or os.path.expanduser("~"))
    if os.path.splitext(path)[1].lower() not in extensions:
        raise PermissionError(f"files like {os.path.basename(path)} are not opened")
    real = os.path.join(os.path.realpath(os.path.dirname(path)), os.path.basename(path)) if export else os.path.realpath(path)
    if os.path.commonpath([root, real]) != root:
        raise PermissionError("a path outside of the allowed folder")
    return real
