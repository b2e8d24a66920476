"""PNG files as a data source and a sink.

Reading: files are planned into partitions by size; a file's header is read first, and a file that a filter on name, width
or height rejects is not decoded. Writing: an image is deflated in bands of rows, each by itself up to a full flush, so
that bands put together are one stream; checksums of bands are joined, and only deflated bands of an image meet.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pixelloom.functions.color import to_u8
from pixelloom.plans.store import file_system
from pixelloom.sources.images import MOST, ImageError, decode_png

#: Rows of a band.
BAND = 64
SCHEMA = "name string, width int, height int, gx int, gy int, r double, g double, b double, a double"
_BASE = 65521  # fixed value: the modulus of Adler-32


def joined_adler(first: int, second: int, size: int) -> int:
    """The Adler-32 of two texts put together, by their own and the size of the second."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return ((b1 + b2 + size % _BASE * (a1 - 1)) % _BASE) << 16 | (a1 + a2 - 1) % _BASE


def _deflated(rows: np.ndarray) -> tuple[bytes, int, int]:
    """(data up to a full flush, Adler-32, size) of rows of bytes, none of them filtered."""
    raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows.reshape(len(rows), -1)), 1).tobytes()
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    return press.compress(raw) + press.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_bands(pixels: DataFrame, mode: str = "export", band: int = BAND) -> DataFrame:
    """(image, width, height, band, data, adler, size) of pixels (image, gx, gy, r, g, b, a); clear where there is none."""
    bytes_ = pixels.select(F.col("image").cast("long").alias("image"), "gx", "gy", *(to_u8(F.col(c), mode).cast("int").alias(c) for c in "rgba"))
    sizes = bytes_.groupBy("image").agg((F.max("gx") + 1).cast("int").alias("width"), (F.max("gy") + 1).cast("int").alias("height"))
    few = sizes.limit((1 << 20) + 1).count() <= 1 << 20
    placed = bytes_.join(F.broadcast(sizes) if few else sizes, "image").withColumn("band", F.floor(F.col("gy") / band))

    def press(rows: pd.DataFrame) -> pd.DataFrame:
        width, height, n = int(rows["width"].iloc[0]), int(rows["height"].iloc[0]), int(rows["band"].iloc[0])
        if max(width, height) > MOST:
            raise ImageError(f"an image is at most {MOST} on a side")
        px = np.zeros((min(band, height - n * band), width, 4), np.uint8)
        px[rows["gy"] - n * band, rows["gx"]] = rows[list("rgba")]
        data, adler, size = _deflated(px)
        return pd.DataFrame({"image": [rows["image"].iloc[0]], "width": [width], "height": [height], "band": [n], "data": [data], "adler": [adler], "size": [size]})

    return placed.groupBy("image", "band").applyInPandas(press, "image long, width int, height int, band long, data binary, adler long, size long")


def to_png(pixels: DataFrame, mode: str = "export", band: int = BAND) -> DataFrame:
    """(image, png) of images of up to 8192 x 8192: a file of one IDAT chunk a band."""

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        width, height = int(rows["width"].iloc[0]), int(rows["height"].iloc[0])
        found = {int(r.band): (r.data, int(r.adler), int(r.size)) for r in rows.itertuples()}
        parts = [b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), _chunk(b"IDAT", b"\x78\x9c")]
        adler = 1
        for n in range(-(-height // band)):
            data, own, size = found.get(n) or _deflated(np.zeros((min(band, height - n * band), width, 4), np.uint8))
            parts.append(_chunk(b"IDAT", data))
            adler = joined_adler(adler, own, size)
        parts += [_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)), _chunk(b"IEND", b"")]
        return pd.DataFrame({"image": [rows["image"].iloc[0]], "png": [b"".join(parts)]})

    return png_bands(pixels, mode, band).groupBy("image").applyInPandas(together, "image long, png binary")


def write_png(pixels: DataFrame, folder: str, mode: str = "export") -> int:
    """Writes image-<image>.png for each image into a shared folder; returns how many.

    A file gets its name when it is complete, so that a task that runs again leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, to = file_system(folder)
        fs.create_dir(to, recursive=True)
        for batch in batches:
            for image, png in zip(batch.column(0), batch.column(1), strict=True):
                part = f"{to}/.image-{image}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(part) as out:
                    out.write(png.as_buffer())
                fs.move(part, f"{to}/image-{image}.png")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return to_png(pixels, mode).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PngReader(DataSourceReader):
    _SIZES = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxPartitionBytes", 16 << 20))
        self.names: list[set] = []
        self.sizes: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names by equality or as a list, width and height by comparison; the rest goes back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column == "name" and isinstance(f, (EqualTo, In)):
                self.names.append({f.value} if isinstance(f, EqualTo) else set(f.value))
            elif column in ("width", "height") and type(f) in self._SIZES:
                self.sizes.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, path = file_system(self.path)
        files = sorted((x.path, x.size) for x in fs.get_file_info(FileSelector(path, allow_not_found=True)) if x.path.endswith(".png"))
        plan, room = [], 0
        for name, size in files:
            if not all(name.rsplit("/", 1)[-1] in some for some in self.names):
                continue
            if size > room or not plan:
                plan.append([])
                room = self.most
            plan[-1].append(name)
            room -= size
        return [_Files(x) for x in plan]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path in partition.paths if partition else []:
            with fs.open_input_file(path) as f:
                head = f.read(33)
                if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
                    raise ImageError(f"no PNG file: {path}")
                size = dict(zip(("width", "height"), struct.unpack(">II", head[16:24]), strict=True))
                if not all(self._SIZES[kind](size[column], value) for column, kind, value in self.sizes):
                    continue
                px = decode_png(head + f.read())
            name, (height, width) = path.rsplit("/", 1)[-1], px.shape[:2]
            step = max(1, (1 << 20) // width)
            for y in range(0, height, step):
                some = px[y : y + step].reshape(-1, 4) / 255.0
                at = np.arange(len(some))
                n = len(at)
                columns = [pa.array([name] * n), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32)), pa.array((at % width).astype(np.int32)), pa.array((at // width + y).astype(np.int32)), *(pa.array(np.ascontiguousarray(some[:, i])) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class PngSource(DataSource):
    """format("png_pixels").load(folder); option maxPartitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "png_pixels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PngReader:
        return PngReader(self.options)


def read_png(spark: SparkSession, folder: str) -> DataFrame:
    """(name, width, height, gx, gy, r, g, b, a) of a folder's PNG files; channels are bytes over 255."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PngSource)
    return spark.read.format("png_pixels").load(folder)
