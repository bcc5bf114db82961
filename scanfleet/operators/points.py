"""Point-level projections and filters.

Frames carry ``run_id, scan_id, idx`` and coordinates ``x, y, z`` (any length unit; limits are given
in the same unit unless a parameter says otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfleet.functions import geom
from scanfleet.operators.ordered import Carry, running

SCAN = ["run_id", "scan_id"]
# Points of one scan that share a task when a scan is cut along its point index.
SCAN_SPAN = 1 << 17

# Fixed values that results depend on.
VELODYNE_OMEGA = 3.61  # degrees per millisecond
VELODYNE_RAD2DEG = 57.2957
LIVOX_RETURN_MASK = 0x30
LIVOX_RETURNS = (0x10, 0x00)
LIVOX_STEP = 1e-7


def range2() -> Column:
    return F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")


def velodyne_offsets(points: DataFrame) -> DataFrame:
    """Offset (ms) of each point from the first return of its ring, from azimuth alone.

    One turn is added from the first place where the raw offset decreases, since a corrected
    offset exceeds every raw one. Adds ``t_off_ms`` and ``ring_first``.
    """
    yaw = F.atan2(F.col("y"), F.col("x")) * VELODYNE_RAD2DEG
    key = [*SCAN, "ring"]
    first = points.groupBy(*key).agg(F.min_by(yaw, "idx").alias("_fp"), F.min("idx").alias("_i0"))
    raw = (F.col("_fp") - yaw + F.when(yaw > F.col("_fp"), 360.0).otherwise(0.0)) / VELODYNE_OMEGA
    out = points.join(first, key).withColumn("_raw", raw)
    out = running(out, key, ["idx"], SCAN_SPAN, [Carry("_prev", "last_before", F.col("_raw"))], split=False)
    drop = F.when(F.col("_raw") < F.col("_prev"), F.col("idx"))
    turn = out.groupBy(*key).agg(F.min(drop).alias("_turn"))
    turned = F.coalesce(F.col("idx") >= F.col("_turn"), F.lit(False))
    return (
        out.join(turn, key)
        .withColumn("ring_first", F.col("idx") == F.col("_i0"))
        .withColumn(
            "t_off_ms",
            F.col("_raw") + F.when(turned, 360.0 / VELODYNE_OMEGA).otherwise(0.0),
        )
        .drop("_fp", "_i0", "_raw", "_prev", "_turn")
    )


def normalize_velodyne(
    points: DataFrame, stride: int = 1, blind: float = 0.1, time_scale: float = 1e-3
) -> DataFrame:
    """Keep every ``stride``-th point beyond ``blind``; offsets from ``time`` or rebuilt.

    A scan whose last point carries no time gets offsets from azimuth and loses the first return of
    every ring.
    """
    given = points.groupBy(*SCAN).agg((F.max_by("time", "idx") > 0).alias("_given"))
    tagged = points.join(given, SCAN)
    timed = tagged.filter("_given").withColumn("t_off_ms", F.col("time") * float(time_scale))
    built = velodyne_offsets(tagged.filter("NOT _given")).filter(~F.col("ring_first"))
    out = timed.unionByName(built.drop("ring_first")).drop("_given")
    return out.filter((F.col("idx") % stride == 0) & (range2() > blind * blind))


def normalize_ouster(points: DataFrame, stride: int = 1, blind: float = 0.1) -> DataFrame:
    """Keep every ``stride``-th point at or beyond ``blind``; nanosecond offsets to milliseconds."""
    return points.filter((F.col("idx") % stride == 0) & (range2() >= blind * blind)).withColumn(
        "t_off_ms", F.col("t_ns") / 1e6
    )


def normalize_livox(
    points: DataFrame,
    stride: int = 1,
    blind: float = 0.1,
    lines: int = 6,
    compat: bool = True,
    step: float = LIVOX_STEP,
) -> DataFrame:
    """Keep valid returns that moved from the previous slot (an unused slot counts as the origin).

    With ``compat`` a point that moved in x or y skips the blind-range test; otherwise every point
    must pass it.
    """
    tag = F.col("tag").bitwiseAND(LIVOX_RETURN_MASK)
    used = (
        (F.col("idx") >= 1)
        & (F.col("line") < lines)
        & tag.isin(*LIVOX_RETURNS)
        & (F.col("idx") % stride == 0)
    )
    zero = F.lit(0.0)
    slot = F.struct(*(F.when(used, F.col(c)).otherwise(zero).alias(c) for c in "xyz"))
    out = running(points, SCAN, ["idx"], SCAN_SPAN, [Carry("_prev", "last_before", slot)], split=False)
    moved = [F.abs(F.col(c) - F.coalesce(F.col(f"_prev.{c}"), zero)) > step for c in "xyz"]
    far = range2() > blind * blind
    keep = moved[0] | moved[1] | (moved[2] & far) if compat else (moved[0] | moved[1] | moved[2]) & far
    return out.filter(used & keep).withColumn("t_off_ms", F.col("offset_time") / 1e6).drop("_prev")


def remove_ground(points: DataFrame, z_min: float) -> DataFrame:
    return points.filter(F.col("z") > z_min)


def pass_through(points: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return points.filter(F.col(col).between(lo, hi))


def usable_range(points: DataFrame, max_r: float = 50.0, dims: int = 2, min_r: float = 0.01) -> DataFrame:
    """Planar range ≤ ``max_r``, or 3-D range in (``min_r``, ``max_r``] with NaN rows removed."""
    if dims == 2:
        r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
        return points.filter(r <= max_r)
    r = F.sqrt(range2()).cast("double")
    return points.filter((r > min_r) & (r <= max_r) & ~F.isnan(r))


def min_points(points: DataFrame, n: int) -> DataFrame:
    """Points of the scans with at least ``n`` points."""
    big = points.groupBy(*SCAN).count().filter(F.col("count") >= n)
    return points.join(big, SCAN, "left_semi")


def stride_scans(
    scans: DataFrame, n: int, phase: str = "first", order: str = "scan_id", span: float = 1 << 17
) -> DataFrame:
    """Of every ``n`` scans of a run keep the first (or the ``nth``)."""
    if n <= 1:
        return scans
    out = running(scans, ["run_id"], [order], span, [Carry("_k", "count")])
    want = 1 if phase == "first" else 0
    return out.filter(F.col("_k") % n == want % n).drop("_k")


def drop_rollback(
    msgs: DataFrame, by: Sequence[str], arrival: Sequence[str], ts: str, span: float
) -> DataFrame:
    """Drop rows older than the newest already accepted. A dropped row never raises the maximum."""
    out = running(msgs, by, arrival, span, [Carry("_max", "max_before", F.col(ts))])
    return out.filter(F.col("_max").isNull() | (F.col(ts) >= F.col("_max"))).drop("_max")


def split_on_rollback(
    msgs: DataFrame, by: Sequence[str], arrival: Sequence[str], ts: str, span: float
) -> DataFrame:
    """Start a new ``segment_id`` wherever time goes back, keeping every row."""
    out = running(msgs, by, arrival, span, [Carry("_prev", "last_before", F.col(ts))])
    back = F.when(F.col(ts) < F.col("_prev"), 1).otherwise(0).cast("bigint")
    out = out.withColumn("_back", back).drop("_prev")
    total = [Carry("segment_id", "sum", F.col("_back"))]
    return running(out, by, arrival, span, total).drop("_back")


def transform_points(
    points: DataFrame, poses: DataFrame, key: Sequence[str], inverse: bool = False
) -> DataFrame:
    """Points moved by the pose of their key: ``R p + t`` (or the inverse motion).

    ``poses`` has the key and ``tx ty tz qw qx qy qz``. The join carries no broadcast hint: poses
    grow with the data, and adaptive execution broadcasts them when they are small.
    """
    small = poses.select(*key, *geom.POSE_COLUMNS)
    pose = geom.Pose.of()
    if inverse:
        pose = geom.pose_inverse(pose)
    moved = geom.transform(pose, geom.Vec.of("x", "y", "z"))
    out = points.join(small, list(key)).withColumns(dict(zip(("_x", "_y", "_z"), moved)))
    keep = [c for c in points.columns if c not in ("x", "y", "z")]
    return out.select(*keep, F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"))


def transform_between(
    points: DataFrame, pairs: DataFrame, poses: DataFrame, source: str, target: str, key: str
) -> DataFrame:
    """Points of frame ``source`` expressed in frame ``target``: ``T_target⁻¹ T_source p``."""
    a = poses.select(F.col(key).alias(target), *(F.col(c).alias(f"a_{c}") for c in geom.POSE_COLUMNS))
    b = poses.select(F.col(key).alias(source), *(F.col(c).alias(f"b_{c}") for c in geom.POSE_COLUMNS))
    rel = geom.pose_between(geom.Pose.of("a"), geom.Pose.of("b"))
    motion = pairs.join(a, target).join(b, source).select(source, target, *rel.columns())
    moved = points.join(motion, source)
    return moved.withColumns(
        dict(zip(("x", "y", "z"), geom.transform(geom.Pose.of(), geom.Vec.of("x", "y", "z"))))
    ).drop(*geom.POSE_COLUMNS)


def height_above_floor(
    points: DataFrame, plane: Sequence[float] = (0.0, 0.0, 1.0, 1.0), name: str = "h"
) -> DataFrame:
    """Signed height over a floor plane ``n·p + d``; the default floor lies at z = −1."""
    a, b, c, d = (float(v) for v in plane)
    return points.withColumn(name, F.col("x") * a + F.col("y") * b + F.col("z") * c + d)


def azimuth_bin(points: DataFrame) -> DataFrame:
    """Whole-degree azimuth in [0, 360) and planar distance of each point."""
    deg = F.atan2(F.col("y"), F.col("x")) * (180.0 / 3.141592653589793)
    near = F.when(deg < 0, F.ceil(deg - 0.5)).otherwise(F.floor(deg + 0.5)).cast("bigint")
    return points.withColumns(
        {
            "azimuth": F.pmod(near + 360, F.lit(360).cast("bigint")),
            "dist": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")),
        }
    )
