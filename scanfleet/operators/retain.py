"""Sorting inside scans, top-k retention and set operations over maps and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanfleet.functions.keys import tile_key, voxel_key
from scanfleet.operators.ordered import Carry, latest, running

VOXEL = ["vx", "vy", "vz"]
NODE_POINTS = 9
DROP_SHARE = 0.7
OVERFULL = 1.5
MATCH_POINTS = 5


def sort_by_offset(points: DataFrame, by: Sequence[str] = ("run_id", "scan_id"), offset: str = "t_off_ms") -> DataFrame:
    """Points of each scan in time order: rows of a scan share a partition and are sorted in it."""
    return points.repartition(*by).sortWithinPartitions(*by, offset, "idx")


def offset_rank(
    points: DataFrame, by: Sequence[str], offset: str, span: float
) -> DataFrame:
    """Position of each point in its scan's time order as a column."""
    return running(points, by, [offset, "idx"], span, [Carry("rank", "count")])


def retain_latest(
    points: DataFrame, leaf: float, seq: Sequence[str], n: int = NODE_POINTS, by: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` newest points of each voxel. The limit is applied before the shuffle as well."""
    keyed = voxel_key(points, leaf, "round")
    w = Window.partitionBy(*by, *VOXEL).orderBy(*(F.col(s).desc() for s in seq))
    return keyed.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def retain_voxels(
    points: DataFrame, leaf: float, seq: str, capacity: int, by: Sequence[str], span: float
) -> DataFrame:
    """Points of the ``capacity − 1`` most recently touched voxels of each key."""
    keyed = voxel_key(points, leaf, "round")
    touched = keyed.groupBy(*by, *VOXEL).agg(F.max(seq).alias("_touch"))
    kept = latest(touched, by, ["_touch", *VOXEL], span, capacity - 1)
    return keyed.join(kept.drop("_touch"), [*by, *VOXEL], "left_semi")


def cap_tile(
    points: DataFrame, max_points: int, seq: str, span: float, tile: float = 100.0, leaf: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Bound the size of each tile: thin an overfull tile to voxel means, then drop the oldest 70 %.

    A thinned voxel takes the newest ``seq`` of its points. Output: key, tile, ``x, y, z``, ``seq``.
    """
    key = [*by, "gx", "gy"]
    keyed = tile_key(points, tile).select(*key, "x", "y", "z", seq)
    size = keyed.groupBy(*key).agg((F.count(F.lit(1)) > OVERFULL * max_points).alias("_over"))
    marked = keyed.join(size, key)
    thin = (
        voxel_key(marked.filter("_over"), leaf, "floor")
        .groupBy(*key, *VOXEL)
        .agg(*(F.avg(c).alias(c) for c in "xyz"), F.max(seq).alias(seq))
        .drop(*VOXEL)
    )
    small = marked.filter("NOT _over").select(*key, *(F.col(c).cast("double").alias(c) for c in "xyz"), seq)
    both = small.unionByName(thin)
    out = running(both, key, [seq, "x", "y", "z"], span, [Carry("_pos", "count"), Carry("_n", "total")])
    cut = F.when(F.col("_n") > max_points, F.floor(F.col("_n") * DROP_SHARE)).otherwise(0)
    return out.filter(F.col("_pos") > cut).drop("_pos", "_n")


def admit_points(
    points: DataFrame, knn: DataFrame, key: Sequence[str], leaf: float, eps: float = 1e-6
) -> DataFrame:
    """Map increment rule: which points enter the map.

    ``knn`` has the key and an array ``near`` (nearest first) of structs with ``nx, ny, nz``, or rows with ``rank``
    (1 = nearest) and these. A point enters
    when it has no neighbour, when its nearest one lies outside its leaf box in all three axes, or
    unless one of the first five (with at least five present) is closer to the leaf centre.
    """
    if "near" not in knn.columns:
        knn = knn.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "nx", "ny", "nz"))).alias("near"))
    j = points.join(knn.select(*key, F.col("near").alias("_near")), list(key), "left")
    centre = [(F.floor(F.col(c) / leaf) + 0.5) * leaf for c in "xyz"]
    j = j.withColumns({f"_c{i}": c for i, c in enumerate(centre)})
    gap = lambda p: [p[n] - F.col(f"_c{i}") for i, n in enumerate(("nx", "ny", "nz"))]
    square = lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    own = square([F.col(c) - F.col(f"_c{i}") for i, c in enumerate("xyz")])
    d = gap(F.col("_near")[0])
    outside = (F.abs(d[0]) > 0.5 * leaf) & (F.abs(d[1]) > 0.5 * leaf) & (F.abs(d[2]) > 0.5 * leaf)
    closer = F.exists(F.slice("_near", 1, MATCH_POINTS), lambda p: square(gap(p)) < own + eps)
    keep = F.col("_near").isNull() | outside | (F.size("_near") < MATCH_POINTS) | ~closer
    return j.filter(keep).select(*points.columns)


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, span: float) -> DataFrame:
    """Bounded queue: the ``n`` newest rows of each key."""
    return latest(df, by, order, span, n)


def all_map(static: DataFrame, dynamic: DataFrame, resident: DataFrame) -> DataFrame:
    """Static and dynamic points on resident tiles."""
    both = static.withColumn("layer", F.lit("static")).unionByName(dynamic.withColumn("layer", F.lit("dynamic")))
    return both.join(resident.select("gx", "gy"), ["gx", "gy"], "left_semi")


def touched_keys(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.select(*keys).distinct()


def apply_edge_levels(edges: DataFrame, delta: float) -> DataFrame:
    """Outliers go to level 1 (excluded); inliers lose their robust kernel."""
    out = F.col("chi2") > delta
    return edges.withColumns(
        {"level": F.when(out, 1).otherwise(0).cast("bigint"), "kernel": F.when(out, F.col("kernel"))}
    )


def valid_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with two different, existing endpoints, without duplicates of (type, v0, v1)."""
    v = vertices.select("v_id")
    return (
        edges.filter(F.col("v0") != F.col("v1"))
        .join(v.withColumnRenamed("v_id", "v0"), "v0", "left_semi")
        .join(v.withColumnRenamed("v_id", "v1"), "v1", "left_semi")
        .dropDuplicates(["etype", "v0", "v1"])
    )


def active_vertices(vertices: DataFrame, edges: DataFrame, orphan: bool = False) -> DataFrame:
    """Vertices with at least one active edge (or, with ``orphan``, those without)."""
    used = (
        edges.filter(F.col("level") == 0)
        .select(F.explode(F.array("v0", "v1")).alias("v_id"))
        .distinct()
    )
    return vertices.join(used, "v_id", "left_anti" if orphan else "left_semi")
