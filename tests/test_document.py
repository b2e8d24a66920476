"""Moves of layers in a tree, and palettes with revisions."""

import pytest

from pixelloom.plans import document as doc

TREE = (doc.Node(1), doc.Node(2, children=(doc.Node(3), doc.Node(4, children=(doc.Node(5),)))), doc.Node(6))


def shape(nodes):
    return [(n.id, shape(n.children)) if n.children else n.id for n in nodes]


def test_layers_move_between_groups():
    assert shape(doc.move_layer(TREE, 1, 1, 2)) == [(2, [3, 1, (4, [5])]), 6]
    assert shape(doc.move_layer(TREE, 5, 0)) == [5, 1, (2, [3, 4]), 6]
    assert shape(doc.move_layer(TREE, 4, 9, 2)) == shape(TREE)
    assert shape(doc.move_layer(TREE, 1, 9)) == [(2, [3, (4, [5])]), 6, 1]
    for bad in ((2, 0, 4), (2, 0, 2), (1, 0, 77), (77, 0)):
        with pytest.raises(ValueError):
            doc.move_layer(TREE, *bad)


def test_palettes_take_edits_and_revisions():
    red, green, blue = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
    palettes = doc.add_palette(doc.add_palette((), "one", [red]), "two", [red, green])
    assert [(p.id, p.revision) for p in palettes] == [(1, 1), (2, 1)]
    palettes = doc.add_color(palettes, 2, blue)
    palettes = doc.move_color(palettes, 2, 0, 2)
    assert (palettes[1].colors, palettes[1].revision, palettes[0].revision) == ((green, blue, red), 3, 1)
    assert doc.move_color(palettes, 2, 1, 1) == palettes
    palettes = doc.remove_color(doc.update_color(palettes, 2, 0, blue), 2, 2)
    assert (palettes[1].colors, palettes[1].revision) == ((blue, blue), 5)
    nodes = (doc.Node(1, filters=(doc.Filter("palette_quantize", {"palette": 1}),)),)
    with pytest.raises(ValueError):
        doc.remove_color(palettes, 1, 0, nodes)
    assert doc.remove_color(palettes, 1, 0)[0].colors == ()
    for change in (lambda: doc.add_color(palettes, 9, red), lambda: doc.update_color(palettes, 1, 1, red), lambda: doc.move_color(palettes, 1, 0, 1)):
        with pytest.raises(ValueError):
            change()
