"""Slice geometry: plane from orientation, position along the normal, letterbox layout, slice choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PLANES


def normal(orientation: Column) -> Column:
    """ARRAY<DOUBLE> of three: cross product of the row and column directions of a 6-vector."""
    row, col = [orientation[i] for i in range(3)], [orientation[i] for i in range(3, 6)]
    return F.when(orientation.isNotNull(), F.array(
        row[1] * col[2] - row[2] * col[1],
        row[2] * col[0] - row[0] * col[2],
        row[0] * col[1] - row[1] * col[0]))


def dominant_axis(vector: Column) -> Column:
    """Index of the component with the largest magnitude; the first on a tie."""
    a, b, c = (F.abs(vector[i]) for i in range(3))
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def plane_from_orientation(orientation: Column) -> Column:
    """Plane perpendicular to the normal; NULL without a usable one."""
    n = normal(orientation)
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    usable = n.isNotNull() & ~F.isnan(length) & (length < float("inf")) & (length >= 1e-6)
    names = F.array(*[F.lit(p) for p in PLANES])
    return F.when(usable, F.element_at(names, dominant_axis(n) + 1))


def along_normal(position: Column, orientation: Column) -> Column:
    """Position along the normal, whose sign is set so its dominant component is positive."""
    n = normal(orientation)
    sign = F.when(F.element_at(n, dominant_axis(n) + 1) < 0, -1.0).otherwise(1.0)
    return sign * F.aggregate(F.zip_with(position, n, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def vector_or_null(values: Column, n: int) -> Column:
    """The array as doubles if it has n finite entries, else NULL."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    whole = (F.size(numbers) == n) & F.forall(
        numbers, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(whole, numbers)


def letterbox(h: Column, w: Column, size: int, row_mm: Column, col_mm: Column) -> Column:
    """STRUCT<new_h, new_w, top, left>: scaled size with the physical aspect kept, centred in a square."""
    phys_h, phys_w = h * row_mm, w * col_mm
    scale = F.lit(float(size)) / F.greatest(phys_h, phys_w)

    def fit(extent: Column) -> Column:
        return F.greatest(F.lit(1), F.least(F.lit(size), F.rint(extent * scale).cast("int")))

    new_h, new_w = fit(phys_h), fit(phys_w)
    return F.struct(new_h.alias("new_h"), new_w.alias("new_w"),
                    F.floor((size - new_h) / 2).cast("int").alias("top"),
                    F.floor((size - new_w) / 2).cast("int").alias("left"))


def selected_number(index: Column, n: Column, limit: int) -> Column:
    """The number of slice `index` of n among at most `limit` evenly spaced ones; NULL if it is not chosen.

    Number j of the choice is slice rint(j * (n - 1) / (limit - 1)); only the values of j next to a slice's own share can be it.
    """
    whole = F.when((n <= limit) | F.lit(limit <= 0), index.cast("long"))
    if limit <= 1:
        return whole if limit <= 0 else F.coalesce(whole, F.when(index == 0, index.cast("long")))
    step = (n - 1) / F.lit(float(limit - 1))
    own = F.floor(index / step)
    near = [F.greatest(F.lit(0), F.least(F.lit(limit - 1), own + d)) for d in (-1, 0, 1, 2)]
    return F.coalesce(whole, *[F.when(F.rint(j * step) == index, j.cast("long")) for j in near])


def is_selected(index: Column, n: Column, limit: int) -> Column:
    """Whether slice `index` of n is among at most `limit` evenly spaced ones."""
    return selected_number(index, n, limit).isNotNull()
