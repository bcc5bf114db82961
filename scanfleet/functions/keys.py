"""Spatial keys and neighbour stencils."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the spatial hash (Teschner et al., VMV 2003) and of the tile grid.
HASH_PRIMES = (73856093, 471943, 83492791)
HASH_BUCKETS = 10_000_000
TILE_SIZE = 100.0


def round_key(value: Column, rounding: str) -> Column:
    """``value`` to an integer cell: ``floor``, ``round`` (half away from 0) or ``trunc``."""
    if rounding == "floor":
        return F.floor(value).cast("bigint")
    if rounding == "round":
        return F.when(value < 0, F.ceil(value - 0.5)).otherwise(F.floor(value + 0.5)).cast("bigint")
    if rounding == "trunc":
        return value.cast("bigint")
    raise ValueError(f"unknown rounding {rounding!r}")


def voxel_key(
    df: DataFrame,
    leaf: float,
    rounding: str = "floor",
    cols: Sequence[str] = ("x", "y", "z"),
    names: Sequence[str] = ("vx", "vy", "vz"),
) -> DataFrame:
    """Add the integer voxel of each point. ``leaf`` is in the unit of the coordinates."""
    return df.withColumns(
        {n: round_key(F.col(c) / float(leaf), rounding) for c, n in zip(cols, names)}
    )


def tile_key(df: DataFrame, size: float = TILE_SIZE) -> DataFrame:
    """Add the map tile ``(gx, gy)``; tiles are centred on multiples of ``size``."""
    return df.withColumns(
        {
            n: F.floor(F.col(c) / float(size) + 0.5).cast("bigint")
            for c, n in (("x", "gx"), ("y", "gy"))
        }
    )


def occ_key(df: DataFrame, res: float, block: int = 4) -> DataFrame:
    """Add occupancy cell, its block of ``2^block`` cells and the position inside the block."""
    cell = {n: F.floor(F.col(c) / float(res)).cast("bigint") for c, n in (("x", "cx"), ("y", "cy"))}
    out = df.withColumns(cell)
    out = out.withColumns({f"b{a}": F.shiftright(f"c{a}", block) for a in "xy"})
    return out.withColumns(
        {f"s{a}": F.col(f"c{a}") - F.shiftleft(F.col(f"b{a}"), block) for a in "xy"}
    )


def spatial_hash(*cells: Column) -> Column:
    """64-bit XOR hash of a 2-D or 3-D cell, in [0, 10 000 000)."""
    parts = [c.cast("bigint") * F.lit(p).cast("bigint") for c, p in zip(cells, HASH_PRIMES)]
    acc = parts[0]
    for part in parts[1:]:
        acc = acc.bitwiseXOR(part)
    return F.pmod(acc, F.lit(HASH_BUCKETS).cast("bigint"))


def hilbert_index(cells: Sequence[Column], order: int) -> Column:
    """Hilbert curve position of a cell with coordinates in [0, 2^order) (Skilling, 2004).

    The transform is unrolled into bit operations per level, so it stays in codegen; ``aggregate``
    folds over the levels with the three axes as the accumulator.
    """
    axes = F.struct(*(c.cast("bigint").alias(f"a{i}") for i, c in enumerate(cells)))
    dims = len(cells)
    levels = F.array(*(F.lit(1 << b).cast("bigint") for b in range(order - 1, 0, -1)))

    def undo(acc: Column, bit: Column) -> Column:
        vals = [acc.getField(f"a{i}") for i in range(dims)]
        low = bit - 1
        for i in range(dims):
            mask = vals[i].bitwiseAND(bit) != 0
            swap = vals[0].bitwiseXOR(vals[i]).bitwiseAND(low)
            first = F.when(mask, vals[0].bitwiseXOR(low)).otherwise(vals[0].bitwiseXOR(swap))
            if i:
                vals[i] = F.when(mask, vals[i]).otherwise(vals[i].bitwiseXOR(swap))
            vals[0] = first
        return F.struct(*(v.alias(f"a{i}") for i, v in enumerate(vals)))

    folded = F.aggregate(levels, axes, undo) if order > 1 else axes

    # Each step binds its values, so that none is worked out again for every bit that asks for it.
    def gray(acc: Column) -> Column:
        vals = [acc.getField(f"a{i}") for i in range(dims)]
        for i in range(1, dims):
            vals[i] = vals[i].bitwiseXOR(vals[i - 1])
        return F.struct(*(v.alias(f"a{i}") for i, v in enumerate(vals)))

    def flipped(acc: Column) -> Column:
        flip, last = F.lit(0).cast("bigint"), acc.getField(f"a{dims - 1}")
        for b in range(order - 1, 0, -1):
            hit = last.bitwiseAND(F.lit(1 << b).cast("bigint")) != 0
            flip = F.when(hit, flip.bitwiseXOR(F.lit((1 << b) - 1).cast("bigint"))).otherwise(flip)
        return F.struct(*(acc.getField(f"a{i}").alias(f"a{i}") for i in range(dims)), flip.alias("flip"))

    def straight(acc: Column) -> Column:
        return F.struct(*(acc.getField(f"a{i}").bitwiseXOR(acc.getField("flip")).alias(f"a{i}") for i in range(dims)))

    def woven(acc: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(order - 1, -1, -1):
            for i in range(dims):
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(acc.getField(f"a{i}"), b).bitwiseAND(F.lit(1).cast("bigint")))
        return out

    found = F.array(folded)
    for step in (gray, flipped, straight, woven):
        found = F.transform(found, step)
    return found[0]


def hilbert_key(df: DataFrame, leaf: float, order: int = 6, name: str = "hilbert") -> DataFrame:
    """Hilbert position of each point's sub-cube inside its (rounded) voxel."""
    side = float(leaf) / (1 << order)
    top = (1 << order) - 1
    subs = []
    for c in ("x", "y", "z"):
        centre = round_key(F.col(c) / float(leaf), "round") * float(leaf)
        raw = ((F.col(c) - (centre - float(leaf) / 2)) / side).cast("bigint")
        subs.append(F.greatest(F.lit(0), F.least(F.lit(top), raw)))
    return df.withColumn(name, hilbert_index(subs, order))


def stencil(size: int) -> list[tuple[int, int, int]]:
    """Neighbour offsets: 1 (own cell), 7 (faces), 19 (+ edges), 27 (full cube), 26 (cube, no centre)."""
    cube = list(product((-1, 0, 1), repeat=3))
    reach = {1: 0, 7: 1, 19: 2, 27: 3, 26: 3}
    if size not in reach:
        raise ValueError(f"no stencil of size {size}")
    out = [o for o in cube if sum(map(abs, o)) <= reach[size]]
    return [o for o in out if any(o)] if size == 26 else out


def diamond(radius: int) -> list[tuple[int, int]]:
    """2-D offsets within a Manhattan distance."""
    span = range(-radius, radius + 1)
    return [(i, j) for i, j in product(span, span) if abs(i) + abs(j) <= radius]


def fan_out(df: DataFrame, offsets: Sequence[tuple[int, ...]], keys: Sequence[str]) -> DataFrame:
    """One row per offset with ``keys`` shifted: a fixed-size array explode, no cross join.

    Turns every neighbourhood (theta) join into an equi join on integer keys.
    """
    shifts = F.array(
        *(F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in zip(keys, o))) for o in offsets)
    )
    cols = [c for c in df.columns if c not in keys]
    out = df.withColumn("_shift", F.explode(shifts))
    return out.select(*cols, *((F.col(k) + F.col(f"_shift.{k}")).alias(k) for k in keys))


def planar_cells(radius: float, cell: float) -> list[tuple[int, int]]:
    """Grid offsets that cover a disc of ``radius`` with cells of size ``cell``."""
    n = math.ceil(radius / cell)
    return list(product(range(-n, n + 1), repeat=2))
