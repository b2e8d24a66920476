"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(x: Column) -> Column:
    """True where a vector is not null and all of its components are finite numbers; never null."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(x: Column, scale: float = 256.0) -> Column:
    """array<long>: floor(scale * component), what 64 bits don't hold as the nearest that they do."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * scale))


def by_width(vectors: pa.Array):
    """(width, places, matrix) for each length of vector in an array of lists without nulls."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return
    lengths = np.diff(vectors.offsets.to_numpy())
    for w in np.unique(lengths):
        at = np.flatnonzero(lengths == w)
        some = vectors if len(at) == len(lengths) else vectors.take(pa.array(at))
        yield int(w), at, some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(w))
