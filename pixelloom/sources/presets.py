"""Built-in palettes by id, and the map of thresholds that a grey PNG file holds."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pixelloom.sources.images import ImageError, decode_png

MOST_MAP = 4096


@dataclass(frozen=True)
class Preset:
    id: str
    name: str
    colors: tuple[tuple[int, int, int], ...]


def _hex(text: str) -> tuple[tuple[int, int, int], ...]:
    return tuple(tuple(bytes.fromhex(x)) for x in text.split())


# The colours of well-known palettes. The last one but one is all mixes of three steps a channel.
PRESETS = (
    Preset("gameboy", "Game Boy", ((15, 56, 15), (48, 98, 48), (139, 172, 15), (155, 188, 15))),
    Preset(
        "apple2",
        "Apple II",
        ((0, 0, 0), (114, 38, 64), (64, 51, 127), (228, 52, 254), (14, 89, 64), (128, 128, 128), (27, 154, 254), (191, 179, 255), (64, 76, 0), (228, 101, 1), (128, 128, 128), (241, 166, 191), (27, 203, 1), (191, 204, 128), (141, 217, 191), (255, 255, 255)),
    ),
    Preset("pico_8", "PICO-8", _hex("000000 1D2B53 7E2553 008751 AB5236 5F574F C2C3C7 FFF1E8 FF004D FFA300 FFEC27 00E436 29ADFF 83769C FF77A8 FFCCAA")),
    Preset(
        "endesga_32",
        "Endesga 32",
        _hex("BE4A2F D77643 EAD4AA E4A672 B86F50 733E39 3E2731 A22633 E43B44 F77622 FEAE34 FEE761 63C74D 3E8948 265C42 193C3E 124E89 0099DB 2CE8F5 FFFFFF C0CBD0 8B9BB4 5A6988 3A4466 262B44 181425 FF0044 68386C B55088 F6757A E8B796 C28569"),
    ),
    Preset("vic_20", "Commodore VIC-20", _hex("000000 FFFFFF 782922 87D6DD AA38B0 59AC30 3227A6 D7DE65 A15400 CF8272 B869C8 98E2EA C8D890 8A7ECE 8ECE78 A1A1A1")),
    Preset("solar8", "Solar8", _hex("10141F 3C233D 851747 D9383A E86A17 F2A65A F0E6A3 FFFFFF")),
    Preset("msx_system", "MSX System", _hex("000000 3EB849 74D07D 5955E0 8076F1 B95E51 65DBEF DB6559 FF897D CCC35E DED087 3AA246 B666B8 CCCCCC FFFFFF")),
    Preset("dawnbringer_16", "DawnBringer 16", _hex("140C1C 442434 30346D 4E4A4E 854C30 346524 D04648 757161 597DCE D27D2C 8595A1 6DAA2C D2AA99 6DC2CA DAD45E DEEED6")),
    Preset("amstrad_cpc", "Amstrad CPC Full", tuple((r, g, b) for g in (0, 128, 255) for r in (0, 128, 255) for b in (0, 128, 255))),
    Preset("synthwave_8", "Synthwave Neon 8", _hex("11052C 3D087B F43B86 FFE459 00F5D4 7B2CBF FF007F 3A0CA3")),
)


def find_preset(id: str) -> Preset | None:
    return next((p for p in PRESETS if p.id == id), None)


def preset_colors(spark: SparkSession) -> DataFrame:
    """The palettes as rows: id, name, i, r, g, b."""
    rows = [(p.id, p.name, i, *c) for p in PRESETS for i, c in enumerate(p.colors)]
    return spark.createDataFrame(rows, "id string, name string, i int, r int, g int, b int")


def threshold_map(data: bytes) -> tuple[tuple[float, ...], ...]:
    """Rows of thresholds from 0 to 1, for Dither(mode="map"), out of a grey PNG of 1 or 8 bits and up to 4096 x 4096."""
    if len(data) < 26 or data[12:16] != b"IHDR":
        raise ImageError("no PNG file")
    width, height, depth, kind = struct.unpack_from(">IIBB", data, 16)
    if kind != 0 or depth not in (1, 8):
        raise ImageError("a map of thresholds is grey, of 1 or 8 bits")
    if max(width, height) > MOST_MAP:
        raise ImageError(f"a map of thresholds is at most {MOST_MAP} on a side")
    return tuple(tuple(float(v) for v in row) for row in decode_png(data)[..., 0] / 255.0)
