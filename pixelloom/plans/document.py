"""Documents as plans: filter stacks, layer trees and palettes, and the edits that a document takes.

A document is small and lives on the driver; rendering it builds one DataFrame plan. Filters run from the last of a layer's
list to the first. Disabled filters, invisible layers and blends that change nothing are left out of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import BLEND_MODES
from pixelloom.operators import compose, ordered, point, tiles
from pixelloom.operators.compose import Layer as Laid


def _by_tile(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stencil over tiles as a filter of an image's pixels, from (0, 0) to the largest gx and gy; other columns are kept."""

    def run(pixels: DataFrame, **params) -> DataFrame:
        size = pixels.agg(F.max("gx").alias("x"), F.max("gy").alias("y")).first()
        if size["x"] is None:
            return pixels
        width, height = size["x"] + 1, size["y"] + 1
        found = tiles.core(f(tiles.decompose(pixels, width, height), **params), width, height)
        return pixels.drop(*"rgba").join(found, ["gx", "gy"]).select(*pixels.columns)

    return run


#: Filters by kind. Others are added with register(), which takes any function of pixels and parameters.
FILTERS: dict[str, Callable[..., DataFrame]] = {
    "curves": point.curves,
    "levels": point.levels,
    "adjust": point.adjust,
    "noise": point.noise,
    "crt": point.crt,
    "placeholder": lambda pixels: pixels,
    "halftone": ordered.halftone,
    "palette_quantize": ordered.lut_nearest,
    "blur": _by_tile(tiles.blur),
    "unsharp": _by_tile(tiles.unsharp),
    "glow": _by_tile(tiles.glow),
    "glitch": _by_tile(tiles.glitch_shift),
    "glitch_blocks": _by_tile(tiles.glitch_blocks),
    "dither": lambda pixels, **p: ordered.dither(pixels, ordered.Dither(**p)),
}
#: New ones of these go to the end of a list, where they run first.
TONE = {"adjust", "curves", "levels"}


def register(kind: str, f: Callable[..., DataFrame]) -> None:
    FILTERS[kind] = f


@dataclass(frozen=True)
class Filter:
    kind: str
    params: Mapping = field(default_factory=dict)
    enabled: bool = True
    opacity: float = 1.0
    mode: str = "normal"

    def __post_init__(self):
        if self.kind not in FILTERS:
            raise ValueError(f"no filter {self.kind}")
        if self.mode not in BLEND_MODES or not 0 <= self.opacity <= 1:
            raise ValueError("a filter blends in a known mode with an opacity of 0 to 1")


@dataclass(frozen=True)
class Node:
    """A layer (pixels by id in the document's sources) or, with children, a group; children from the bottom up."""

    id: int
    name: str = ""
    filters: tuple[Filter, ...] = ()
    children: tuple[Node, ...] = ()
    mode: str = "normal"
    opacity: float = 1.0
    visible: bool = True
    mask: int | None = None


def apply_filters(pixels: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    for f in reversed([f for f in filters if f.enabled]):
        pixels = point.with_blend(pixels, lambda p, f=f: FILTERS[f.kind](p, **f.params), f.mode, f.opacity)
    return pixels


def render(nodes: Sequence[Node], sources: Mapping[int, DataFrame]) -> DataFrame:
    """The laid out image of a tree; sources: pixels by layer id, a layer without any is transparent."""

    def laid(node: Node) -> Laid:
        mask = None
        if node.mask is not None and node.mask in sources:
            owner = next((n for n in walk(nodes) if n.id == node.mask), None)
            mask = apply_filters(sources[node.mask], owner.filters if owner else ())
        if node.children:
            return Laid(children=[laid(c) for c in node.children], mode=node.mode, opacity=node.opacity, visible=node.visible and any(c.visible for c in node.children), mask=mask)
        pixels = apply_filters(sources[node.id], node.filters) if node.id in sources else None
        return Laid(pixels, (), node.mode, node.opacity, node.visible, mask)

    return compose.composite([laid(n) for n in nodes])


def walk(nodes: Sequence[Node]):
    for n in nodes:
        yield n
        yield from walk(n.children)


def add_layer(nodes: tuple[Node, ...], name: str, **properties) -> tuple[Node, ...]:
    """On top, with the next id; an unknown blend mode becomes normal, opacity is clamped."""
    new = Node(max((n.id for n in walk(nodes)), default=0) + 1, name)
    return set_properties((*nodes, new), new.id, **properties)


def edit(nodes: Sequence[Node], id: int, change: Callable[[Node], Node | None]) -> tuple[Node, ...]:
    """The tree with node id changed, or removed where change gives None."""
    out = []
    for n in nodes:
        if n.id == id:
            n = change(n)
            if n is None:
                continue
        elif n.children:
            n = replace(n, children=edit(n.children, id, change))
        out.append(n)
    return tuple(out)


def remove_layer(nodes, id: int) -> tuple[Node, ...]:
    return edit(nodes, id, lambda n: None)


def set_properties(nodes, id: int, **properties) -> tuple[Node, ...]:
    if "mode" in properties and properties["mode"] not in BLEND_MODES:
        properties["mode"] = "normal"
    if "opacity" in properties:
        properties["opacity"] = min(max(properties["opacity"], 0.0), 1.0)
    return edit(nodes, id, lambda n: replace(n, **properties))


def move_layer(nodes: tuple[Node, ...], id: int, to: int, parent: int | None = None) -> tuple[Node, ...]:
    """A layer or group, wherever it lies, to place ``to`` from the bottom of a parent's children or of the document; beyond the
    end it goes on top. Raises for an id or parent that there is not, and for a parent inside the node itself."""
    one = next((n for n in walk(nodes) if n.id == id), None)
    if one is None:
        raise ValueError(f"no layer {id}")
    rest = edit(nodes, id, lambda n: None)

    def put(among: tuple[Node, ...]) -> tuple[Node, ...]:
        return (*among[:to], one, *among[to:])

    if parent is None:
        return put(rest)
    if all(n.id != parent for n in walk(rest)):
        raise ValueError(f"no place in {parent} for layer {id}")
    return edit(rest, parent, lambda n: replace(n, children=put(n.children)))


def add_filter(nodes, id: int, f: Filter) -> tuple[Node, ...]:
    return edit(nodes, id, lambda n: replace(n, filters=(*n.filters, f) if f.kind in TONE else (f, *n.filters)))


def update_filter(nodes, id: int, at: int, params: Mapping) -> tuple[Node, ...]:
    """No parameters keep those there are; adjust takes over those not named, all other kinds fall back to defaults."""

    def change(n: Node) -> Node:
        old = n.filters[at]
        new = dict(old.params) if not params else {**old.params, **params} if old.kind == "adjust" else dict(params)
        return replace(n, filters=(*n.filters[:at], replace(old, params=new), *n.filters[at + 1 :]))

    return edit(nodes, id, change)


def remove_filter(nodes, id: int, at: int) -> tuple[Node, ...]:
    """Without the filter at this place; a place that there is not changes nothing."""
    return edit(nodes, id, lambda n: replace(n, filters=tuple(f for i, f in enumerate(n.filters) if i != at)))


def move_filter(nodes, id: int, at: int, to: int) -> tuple[Node, ...]:
    """The filter at a place goes to another; beyond the end it goes last."""

    def change(n: Node) -> Node:
        rest = [f for i, f in enumerate(n.filters) if i != at]
        rest.insert(min(to, len(rest)), n.filters[at])
        return replace(n, filters=tuple(rest))

    return edit(nodes, id, change)


def uses_palette(f: Filter, palette) -> bool:
    return f.params.get("palette") == palette


def delete_palette(nodes, palette) -> tuple[Node, ...]:
    """Dithers fall back to levels; filters that are nothing without the palette go."""

    def clean(n: Node) -> Node:
        kept = []
        for f in n.filters:
            if uses_palette(f, palette):
                if f.kind != "dither":
                    continue
                f = replace(f, params={k: v for k, v in f.params.items() if k not in ("palette", "palette_mode")})
            kept.append(f)
        return replace(n, filters=tuple(kept), children=tuple(clean(c) for c in n.children))

    return tuple(clean(n) for n in nodes)


def remove_palette(nodes, palette) -> None:
    """Raises if a filter refers to the palette."""
    if any(uses_palette(f, palette) for n in walk(nodes) for f in n.filters):
        raise ValueError("a filter refers to the palette")


@dataclass(frozen=True)
class Palette:
    """Named colours of a document; every change of the colours makes a new revision."""

    id: int
    name: str
    colors: tuple[tuple[float, float, float], ...]
    revision: int = 1


def add_palette(palettes: tuple[Palette, ...], name: str, colors: Sequence) -> tuple[Palette, ...]:
    """Last, with the next id and revision 1."""
    return (*palettes, Palette(max((p.id for p in palettes), default=0) + 1, name, tuple(map(tuple, colors))))


def _recolored(palettes: tuple[Palette, ...], id: int, change: Callable[[list], None]) -> tuple[Palette, ...]:
    if all(p.id != id for p in palettes):
        raise ValueError(f"no palette {id}")

    def one(p: Palette) -> Palette:
        colors = list(p.colors)
        change(colors)
        return replace(p, colors=tuple(colors), revision=p.revision + 1)

    return tuple(one(p) if p.id == id else p for p in palettes)


def _place(colors: Sequence, at: int) -> int:
    if not 0 <= at < len(colors):
        raise ValueError(f"no colour at {at}")
    return at


def add_color(palettes, id: int, color) -> tuple[Palette, ...]:
    return _recolored(palettes, id, lambda colors: colors.append(tuple(color)))


def update_color(palettes, id: int, at: int, color) -> tuple[Palette, ...]:
    return _recolored(palettes, id, lambda colors: colors.__setitem__(_place(colors, at), tuple(color)))


def remove_color(palettes, id: int, at: int, nodes: Sequence[Node] = ()) -> tuple[Palette, ...]:
    """Raises for the last colour of a palette that a filter of nodes refers to (by id)."""

    def change(colors: list) -> None:
        _place(colors, at)
        if len(colors) == 1:
            remove_palette(nodes, id)
        del colors[at]

    return _recolored(palettes, id, change)


def move_color(palettes, id: int, at: int, to: int) -> tuple[Palette, ...]:
    """The colour at a place goes to another of the palette's; a move to its own place is no new revision."""

    def change(colors: list) -> None:
        _place(colors, to)
        colors.insert(to, colors.pop(_place(colors, at)))

    moved = _recolored(palettes, id, change)
    return palettes if at == to else moved
