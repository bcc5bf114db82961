"""Spatial, as-of and interval joins.

Neighbourhood joins are equi joins on integer cells after a fixed fan-out of the query side; as-of
joins are unions with carried values (no pairing of rows at all). No side carries a broadcast hint
unless its size has been checked: adaptive execution picks broadcast or a skew-split shuffle join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfleet.functions import geom
from scanfleet.functions.keys import diamond, fan_out, planar_cells, stencil, tile_key, voxel_key
from scanfleet.operators.aggregate import INFO_NAMES, plane_fit, voxel_downsample
from scanfleet.operators.ordered import Carry, needs_split, running
from scanfleet.operators.points import transform_points
from scanfleet.operators.sweep import Counts, Picks, sweep
from scanfleet.operators.windows import spaced_fold
from scanfleet.session import cut

VOXEL = ["vx", "vy", "vz"]

# Fixed values.
OUTLIER_RATIO = 0.55
NEAREST_TOLERANCE_S = 0.5
SCAN_PERIOD_S = 0.1
MIN_PAIR_GAP_S = 0.05
LOOP_KF_GAP = 20
LOOP_MIN_AGE = 50
LOOP_RADIUS = 30.0
LOOP_SKIP = 20
SUBMAP_IDS = (-40, 36, 4)
EFFECTIVE_RATIO = 81.0
# Map points one cell may hold before kNN starts from finer cells.
DENSE_CELL = 512
# Queries of one cell that go to one task, and distances a task holds at once.
CELL_QUERIES = 200_000
NEAR_BLOCK = 1 << 17


def lookup_cells(points: DataFrame, cells: DataFrame, leaf: float, rounding: str = "round", by: Sequence[str] = ()) -> DataFrame:
    """Each point with the cell it falls into."""
    return voxel_key(points, leaf, rounding).join(cells, [*by, *VOXEL])


def neighbour_cells(
    points: DataFrame, cells: DataFrame, leaf: float, size: int = 7, min_pts: int = 1,
    rounding: str = "round", by: Sequence[str] = (),
) -> DataFrame:
    """Each point with every populated cell of its stencil."""
    wide = fan_out(voxel_key(points, leaf, rounding), stencil(size), VOXEL)
    return wide.join(cells.filter(F.col("n") >= min_pts), [*by, *VOXEL])


# --- nearest neighbours ------------------------------------------------------------------------


def _in_stencil(size: int, d: Sequence[Column]) -> Column:
    """Whether a voxel offset belongs to the stencil."""
    box = F.greatest(*(F.abs(c) for c in d)) <= 1
    steps = F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])
    reach = {1: 0, 7: 1, 19: 2, 27: 3, 26: 3}[size]
    ok = box & (steps <= reach)
    return ok & (steps > 0) if size == 26 else ok


NEAR = ["map_id", "nx", "ny", "nz", "d2"]


def _squared() -> Column:
    d = [F.col(a) - F.col(b) for a, b in zip(("nx", "ny", "nz"), ("_qx", "_qy", "_qz"))]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _near(q: DataFrame, m: DataFrame, key: Sequence[str], by: Sequence[str], cell: float, offsets, size: int, k: int, max_range: float) -> DataFrame:
    """The k nearest map points of each query among the cells of ``offsets`` at one cell size."""
    grid = ["_cx", "_cy", "_cz"]
    qc = fan_out(voxel_key(q, cell, "round", ("_qx", "_qy", "_qz"), grid), offsets, grid)
    mc = voxel_key(m, cell, "round", ("nx", "ny", "nz"), grid)
    voxel = [F.col(f"_m{c}") - F.col(f"_q{c}") for c in VOXEL]
    pairs = qc.join(mc, [*by, *grid]).withColumn("d2", _squared())
    pairs = pairs.filter((F.col("d2") < max_range * max_range) & _in_stencil(size, voxel))
    w = Window.partitionBy(*key).orderBy("d2", "map_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return as_lists(ranked.select(*key, "rank", *NEAR), key)


def as_lists(near: DataFrame, key: Sequence[str]) -> DataFrame:
    """Neighbours in rows (with ``rank``, where they have one) as one array ``near`` for each query; arrays stay."""
    if "near" in near.columns:
        return near
    cols = [c for c in ["rank", *NEAR] if c in near.columns]
    packed = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("near"))
    return packed.withColumn("near", F.transform("near", lambda p: F.struct(*(p[c].alias(c) for c in cols if c != "rank"))))


def _near_bounded(
    q: DataFrame, m: DataFrame, key: Sequence[str], by: Sequence[str], cell: float, offsets, size: int | None, k: int,
    max_range: float, share: int,
) -> DataFrame:
    """As :func:`_near` when no cell holds many map points.

    The map is fanned out instead of the queries. Map points and queries are sorted by cell, map points
    first and in the order of ties, so a task streams through its cells: it holds the map points of one
    and ranks that cell's queries against them in arrays. A cell with more than ``share`` queries is
    dealt to several groups, each with the cell's map points.
    """
    grid = ["_cx", "_cy", "_cz"]
    group = [*by, *grid, "_salt"]
    key = list(key)
    mv, qv = ([f"_{p}{c}" for c in VOXEL] if size else [] for p in "mq")
    known = lambda df: df.dropna(subset=[*by, *grid])
    mc = known(fan_out(voxel_key(m.select(*by, "map_id", "nx", "ny", "nz", *mv), cell, "round", ("nx", "ny", "nz"), grid), offsets, grid))
    own = [f"_k{i}" for i in range(len(key))]
    qc = known(voxel_key(q, cell, "round", ("_qx", "_qy", "_qz"), grid))
    crowd = qc.groupBy(*by, *grid).agg(F.ceil(F.count(F.lit(1)) / share).alias("_parts"))
    if (crowd.agg(F.max("_parts")).first()[0] or 0) > 1:
        deal = F.coalesce("_parts", F.lit(1))
        mc = mc.join(crowd, [*by, *grid], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), deal - 1)))
        qc = qc.join(crowd, [*by, *grid], "left").withColumn("_salt", F.pmod(F.xxhash64(*key), deal))
    else:
        mc, qc = (df.withColumn("_salt", F.lit(0).cast("bigint")) for df in (mc, qc))
    mc = mc.select(*group, F.lit(0).alias("_kind"), "map_id", "nx", "ny", "nz", *mv)
    qc = qc.select(*group, F.lit(1).alias("_kind"), "_qx", "_qy", "_qz", *qv, *(F.col(c).alias(n) for n, c in zip(own, key)))
    d2 = q.limit(0).select("_qx", "_qy", "_qz").crossJoin(m.limit(0).select("map_id", "nx", "ny", "nz")).select(*NEAR[:4], _squared().alias("d2")).schema
    kinds = {f.name: f.dataType.simpleString() for f in d2}
    kept = {c: q.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.items()) + f", near array<struct<{','.join(f'{c}:{t}' for c, t in kinds.items())}>>"
    both = mc.unionByName(qc, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "_kind", "map_id", "nx", "ny", "nz")
    reach = {1: 0, 7: 1, 19: 2, 27: 3, 26: 3}[size] if size else None
    whole = {"bigint": np.int64, "int": np.int32, "float": np.float32}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            at = {c: rows.column(c).fill_null(0).to_numpy() for c in ("nx", "ny", "nz", "_qx", "_qy", "_qz", *mv, *qv)}
            place = [[at[c] for c in cols] for cols in (("nx", "ny", "nz"), ("_qx", "_qy", "_qz"))]
            exact = all(v.dtype.kind == "i" for side in place for v in side)
            if exact and max(np.abs(v).max() for side in place for v in side) < 1 << 24:
                # Whole numbers this small have exact squares and sums as doubles, too.
                place = [[v.astype(float) for v in side] for side in place]
            query = rows.column("_kind").to_numpy() == 1
            edge = np.zeros(rows.num_rows, bool)
            edge[0] = True
            for c in group:
                v = rows.column(c)
                edge[1:] |= pc.not_equal(v.slice(1), v.slice(0, rows.num_rows - 1)).to_numpy()
            lo = np.flatnonzero(edge)
            hi = np.append(lo[1:], rows.num_rows)
            mid = hi - np.add.reduceat(query.astype(np.int64), lo)
            found = []
            for a, b, c in zip(lo, mid, hi):
                step = max(1, NEAR_BLOCK // max(1, b - a))
                for s in range(b, c, step) if b > a else ():
                    who = slice(s, min(s + step, c))
                    d = [n[None, a:b] - p[who, None] for n, p in zip(*place)]
                    far = d[0] * d[0]
                    far += d[1] * d[1]
                    far += d[2] * d[2]
                    none = np.inf if far.dtype.kind == "f" else np.iinfo(far.dtype).max
                    ok = far < max_range * max_range
                    if size:
                        v = [np.abs(at[n][None, a:b] - at[p][who, None]) for n, p in zip(mv, qv)]
                        steps = v[0] + v[1] + v[2]
                        ok &= (np.maximum(np.maximum(v[0], v[1]), v[2]) <= 1) & (steps <= reach)
                        ok &= (steps > 0) if size == 26 else True
                    far[~ok] = none
                    line, picks = np.arange(len(far)), []
                    for _ in range(min(k, b - a)):
                        best = far.argmin(axis=1)
                        picks.append((best + a, far[line, best]))
                        far[line, best] = none
                    rank, dist = (np.stack(v, axis=1) for v in zip(*picks))
                    hit = dist < none
                    n = hit.sum(axis=1)
                    some = n > 0
                    found.append((line[some] + s, n[some], rank[hit], dist[hit]))
            begin = lo[-1]
            held = rows.slice(begin, mid[-1] - begin).to_batches()
            if found:
                who, n, rank, dist = (np.concatenate(v) for v in zip(*found))
                near = rows.select(NEAR[:4]).take(pa.array(rank)).combine_chunks()
                dist = pa.array(dist.astype(whole.get(kinds["d2"], float)))
                fields = [near.column(c).combine_chunks() for c in NEAR[:4]] + [dist]
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, NEAR))
                keys = rows.select(own).take(pa.array(who)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() for c in own), lists], names=[*key, "near"])

    return both.mapInArrow(search, schema)


def _fullest(m: DataFrame, by: Sequence[str], cell: float) -> int:
    """Map points in the fullest cell of the given size."""
    grid = ["_cx", "_cy", "_cz"]
    keyed = voxel_key(m, cell, "round", ("nx", "ny", "nz"), grid)
    return keyed.groupBy(*by, *grid).count().agg(F.max("count")).first()[0] or 0


def knn_lists(
    queries: DataFrame, points: DataFrame, key: Sequence[str], map_id: str, k: int = 5,
    max_range: float = 5.0, leaf: float = 0.5, size: int = 19, by: Sequence[str] = (),
    dense: int = DENSE_CELL, share: int = CELL_QUERIES,
) -> DataFrame:
    """The ``k`` nearest map points of each query inside its voxel stencil as an array ``near`` of structs
    ``map_id, nx, ny, nz, d2``, nearest first (ties by ``map_id``). Queries with none are left out.

    While no voxel holds more than ``dense`` points (measured), each query is ranked against the
    candidates of its voxel. Dense places never pair everything with everything: coincident map
    points are first cut to ``k`` (the others can never rank) and the search starts from finer
    cells. A query is settled at a level as soon as its k-th neighbour is nearer than the cell size,
    which proves that no closer point was missed; the rest goes on to the next coarser level and
    finally to the voxels themselves.
    """
    m = cut(points.select(*by, F.col(map_id).alias("map_id"), *(F.col(c).alias(f"n{c}") for c in "xyz")))
    q = queries.select(*dict.fromkeys([*by, *key]), *(F.col(c).alias(f"_q{c}") for c in "xyz"))
    if _fullest(m, by, leaf) <= dense:
        return _near_bounded(q, m, key, by, leaf, stencil(size), None, k, max_range, share)
    same = Window.partitionBy(*by, "nx", "ny", "nz").orderBy("map_id")
    m = m.withColumn("_dup", F.row_number().over(same)).filter(F.col("_dup") <= k).drop("_dup")
    m = cut(voxel_key(m, leaf, "round", ("nx", "ny", "nz"), [f"_m{c}" for c in VOXEL]))
    q = voxel_key(q, leaf, "round", ("_qx", "_qy", "_qz"), [f"_q{c}" for c in VOXEL])
    cells, full = [leaf], [_fullest(m, by, leaf)]
    while full[-1] > max(dense, k):
        cells.append(cells[-1] / 2)
        full.append(_fullest(m, by, cells[-1]))

    def search(q: DataFrame, cell: float, most: int, size_at: int) -> DataFrame:
        args = (q, m, key, by, cell, stencil(size_at), size, k, max_range)
        return _near_bounded(*args, share) if most <= dense else _near(*args)

    done = None
    for cell, most in list(zip(cells, full))[:0:-1]:
        found = cut(search(q, cell, most, 27))
        settled = found.filter((F.size("near") >= k) & (F.element_at("near", -1)["d2"] <= cell * cell))
        done = settled if done is None else done.unionByName(settled)
        q = cut(q.join(settled.select(*key), list(key), "left_anti"))
    last = search(q, leaf, full[0], size)
    return last if done is None else done.unionByName(last)


def knn(
    queries: DataFrame, points: DataFrame, key: Sequence[str], map_id: str, k: int = 5,
    max_range: float = 5.0, leaf: float = 0.5, size: int = 19, by: Sequence[str] = (),
    dense: int = DENSE_CELL, share: int = CELL_QUERIES,
) -> DataFrame:
    """:func:`knn_lists` in rows: key, ``map_id, nx, ny, nz, d2`` and ``rank`` from 1."""
    near = knn_lists(queries, points, key, map_id, k, max_range, leaf, size, by, dense, share)
    out = near.select(*key, F.posexplode("near").alias("_r", "_n"))
    return out.select(*key, *(F.col(f"_n.{c}").alias(c) for c in NEAR), (F.col("_r") + 1).cast("bigint").alias("rank"))


def nearest(
    queries: DataFrame, points: DataFrame, key: Sequence[str], map_id: str, max_range: float = 5.0,
    leaf: float = 0.5, size: int = 19, by: Sequence[str] = (),
) -> DataFrame:
    """Nearest map point of every query; null columns when there is none in the stencil."""
    one = knn(queries, points, key, map_id, 1, max_range, leaf, size, by).drop("rank")
    return queries.join(one, list(key), "left")


# --- as-of and interval ------------------------------------------------------------------------


def _asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], lt: Column, rt: Column, value: Column,
    span: float, carries: Sequence[tuple[str, str]], strict: bool = False, tie: Sequence[str] = (),
) -> DataFrame:
    """Left rows with carried right values: ``carries`` are (name, kind) of the right ``value``.

    At equal times a right row counts as earlier than the left one (or later with ``strict``).
    """
    row = F.struct(*(F.col(c) for c in left.columns))
    order = 0 if strict else 1
    ties = [f"_k{i}" for i in range(len(tie))]
    lhs = left.select(*by, lt.alias("_t"), F.lit(order).alias("_kind"), row.alias("_row"))
    rhs = right.select(*by, rt.alias("_t"), F.lit(1 - order).alias("_kind"), value.alias("_val"), *(F.col(c).alias(k) for c, k in zip(tie, ties)))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    out = running(both, by, ["_t", "_kind", *ties], span, [Carry(n, kind, F.col("_val")) for n, kind in carries])
    out = out.filter(F.col("_row").isNotNull())
    return out.select(*(F.col(f"_row.{c}").alias(c) for c in left.columns), *(n for n, _ in carries))


def sync_nearest(
    scans: DataFrame, imu: DataFrame, by: Sequence[str], span: float, odom: DataFrame | None = None,
    t: str = "t", tolerance: float = NEAREST_TOLERANCE_S, period: float = SCAN_PERIOD_S,
) -> DataFrame:
    """Each scan with the IMU (and odometry) sample nearest to its end, both within the tolerance.

    Samples keep their columns in structs ``imu`` and ``odom``; the earlier one wins ties. Scans
    without a sample in reach are dropped; odometry is not asked of keys that have none at all.
    """
    end = F.col(t) + period
    out = scans
    for name, side in (("imu", imu), ("odom", odom)):
        if side is None:
            continue
        out = _asof(out, side, by, end, F.col(t), F.struct(*side.columns), span, [("_p", "last"), ("_n", "next")])
        dp, dn = end - F.col(f"_p.{t}"), F.col(f"_n.{t}") - end
        first = F.col("_n").isNull() | (F.col("_p").isNotNull() & (dp <= dn))
        best = F.when(first, F.col("_p")).otherwise(F.col("_n"))
        out = out.withColumn(name, best).drop("_p", "_n")
        near = F.abs(F.col(f"{name}.{t}") - end) < tolerance
        if name == "odom":
            near = F.col("odom").isNull() | near
        out = out.filter(near)
    return out


def group_imu_by_scan(
    scans: DataFrame, imu: DataFrame, by: Sequence[str], span: float, t_end: str = "t_end", t: str = "t",
    scan_id: str = "scan_id",
) -> DataFrame:
    """IMU rows with the scan whose interval (previous end, own end] they fall into."""
    ids = F.struct(F.col(scan_id).alias("scan_id"), F.col(t_end).alias("t_end"))
    out = _asof(imu, scans, by, F.col(t), F.col(t_end), ids, span, [("_s", "next")], strict=True, tie=[scan_id])
    return out.filter(F.col("_s").isNotNull()).select("*", "_s.scan_id").drop("_s")


def interpolate_pose(
    queries: DataFrame, poses: DataFrame, by: Sequence[str], span: float, t: str = "t",
    pose_id: str = "pose_id", within: float = 0.5, min_pair: float = MIN_PAIR_GAP_S,
) -> DataFrame:
    """Pose at each query time: interpolated between neighbours, first pose shortly before the
    track, extrapolated from the last usable pair shortly after it, otherwise null.

    Adds ``tx … qz`` and ``best_match`` (the pose row the answer is closest to in time order).
    """
    by = list(by)
    now = F.struct(F.col(t).alias("t"), F.col(pose_id).alias("id"), *geom.POSE_COLUMNS)
    out = _asof(queries, poses, by, F.col(t), F.col(t), now, span, [("_p", "last"), ("_n", "next")], strict=True, tie=[pose_id])
    ends = poses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_count"), F.max(t).alias("_tmax"), F.max_by(now, F.struct(t, pose_id)).alias("_last")
    )
    pair = (
        poses.join(ends.select(*by, "_tmax"), by)
        .filter(F.col("_tmax") - F.col(t) >= min_pair)
        .groupBy(*by)
        .agg(F.max_by(now, F.struct(t, pose_id)).alias("_pair"))
    )
    out = out.join(ends.drop("_tmax"), by, "left").join(pair, by, "left")
    q = F.col(t)
    after = F.col("_n").isNull() & (q > F.col("_last.t"))
    before = F.col("_p").isNull()
    # One bracket for all cases: between two poses, or the last usable pair continued.
    a = F.when(after, F.col("_pair")).otherwise(F.col("_p"))
    b = F.when(after, F.col("_last")).otherwise(F.col("_n"))
    out = out.withColumns({"_a": a, "_b": b, "_after": after, "_before": before})
    out, pa = geom.stage(out, "_a", geom.Pose.field("_a"))
    out, pb = geom.stage(out, "_b", geom.Pose.field("_b"))
    dt = F.col("_b.t") - F.col("_a.t")
    s = F.when(F.col("_after"), (q - F.col("_b.t")) / dt).otherwise((q - F.col("_a.t")) / dt)
    out = out.withColumn("_s", s)
    s = F.col("_s")
    out, rel = geom.stage(out, "_r", geom.pose_between(pa, pb))
    # Twist of the pair, scaled by s and put back on the last pose; each step is its own column.
    out, w = geom.stage(out, "_w", geom.quat_log(rel.q))
    out, rho = geom.stage(out, "_h", geom.so3_left_jacobian_apply(w, rel.t, inverse=True))
    out, w = geom.stage(out, "_u", w.times(s))
    out, rho = geom.stage(out, "_v", rho.times(s))
    out, shift = geom.stage(out, "_g", geom.so3_left_jacobian_apply(w, rho))
    out, delta = geom.stage(out, "_d", geom.Pose(geom.so3_exp(w, 1.0, 1e-12), shift))
    out, ahead = geom.stage(out, "_x", geom.pose_compose(pb, delta))
    out, weights = geom.stage_slerp(out, "_k", pa.q, pb.q, s)
    mixed = geom.Pose(
        geom.Quat(*(p * weights[0] + q * weights[1] for p, q in zip(pa.q, pb.q))), pa.t.times(1.0 - s).plus(pb.t.times(s))
    )
    no_pair = F.col("_a").isNull()
    ok = (F.col("_count") >= 2) & F.when(F.col("_after"), q < F.col("_b.t") + within).when(
        F.col("_before"), q >= F.col("_b.t") - within
    ).otherwise(True)
    result = {}
    flat = lambda p: [*p.t, *p.q]
    for i, c in enumerate(geom.POSE_COLUMNS):
        v = (
            F.when(F.col("_before") | no_pair, flat(pb)[i])
            .when(F.col("_after"), flat(ahead)[i])
            .when(F.abs(dt) < 1e-6, flat(pa)[i])
            .otherwise(flat(mixed)[i])
        )
        result[c] = F.when(ok, v)
    match = F.when(F.col("_after") | F.col("_before") | no_pair, F.col("_b.id")).when(
        s < within, F.col("_a.id")
    ).otherwise(F.col("_b.id"))
    result["best_match"] = F.when(ok, match)
    return out.select(*queries.columns, *(e.alias(n) for n, e in result.items()))


def deskew(
    points: DataFrame, imu_poses: DataFrame, ends: DataFrame, by: Sequence[str], span: float,
    t_point: str = "t", t_pose: str = "off", extrinsic: Sequence[float] = (0, 0, 0, 1, 0, 0, 0),
) -> DataFrame:
    """Points moved to the sensor frame at the scan end.

    ``imu_poses`` holds, per scan and offset, ``qw..qz``, ``px..pz``, ``vx..vz`` and the rates
    ``gx..gz``, ``ax..az``; a point uses the last pose with an offset before its time and the rates
    of the pose after it. ``ends`` holds the end pose (``tx … qz``) per scan. Points before the
    first pose stay as they are.
    """
    by = list(by)
    rates = F.struct(*(F.col(c) for c in ("gx", "gy", "gz", "ax", "ay", "az")))
    heads = running(imu_poses, by, [t_pose], span, [Carry("_next", "next_after", rates)])
    heads = heads.filter(F.col("_next").isNotNull())
    val = F.struct(F.col(t_pose).alias("t"), *("qw qx qy qz px py pz vx vy vz").split(), F.col("_next").alias("r"))
    j = _asof(points, heads, by, F.col(t_point), F.col(t_pose), val, span, [("_i", "last")], strict=True)
    j = j.join(ends.select(*by, *(F.col(c).alias(f"_e_{c}") for c in geom.POSE_COLUMNS)), by)
    tx, ty, tz, qw, qx, qy, qz = (F.lit(float(v)) for v in extrinsic)
    mount = geom.Pose(geom.Quat(qw, qx, qy, qz), geom.Vec(tx, ty, tz))
    dt = F.col(t_point) - F.col("_i.t")
    j, spin = geom.stage(j, "_g", geom.Vec.of("_i.r.gx", "_i.r.gy", "_i.r.gz"))
    j = j.withColumn("_dt", dt)
    dt = F.col("_dt")
    turn = geom.so3_exp(spin, dt)
    j = j.withColumns(dict(zip(("_tw", "_tx", "_ty", "_tz"), turn)))
    j, body = geom.stage(j, "_y", geom.transform(mount, geom.Vec.of("x", "y", "z")))
    turn = geom.Quat(*(F.col(f"_t{c}") for c in "wxyz"))
    j, turned = geom.stage(j, "_u", geom.rotate(turn, body))
    pose = geom.Pose(geom.Quat(*(F.col(f"_i.q{c}") for c in "wxyz")), geom.Vec.of("_i.px", "_i.py", "_i.pz"))
    vel, acc = geom.Vec.of("_i.vx", "_i.vy", "_i.vz"), geom.Vec.of("_i.r.ax", "_i.r.ay", "_i.r.az")
    end = geom.Pose.of("_e")
    shift = pose.t.plus(vel.times(dt)).plus(acc.times(0.5).times(dt).times(dt)).minus(end.t)
    j, world = geom.stage(j, "_w", geom.rotate(pose.q, turned).plus(shift))
    j, local = geom.stage(j, "_v", geom.rotate(geom.quat_inv(end.q), world))
    back = geom.rotate(geom.quat_inv(mount.q), local.minus(mount.t))
    moved = [F.when(F.col("_i").isNotNull(), b).otherwise(F.col(c).cast("double")) for b, c in zip(back, "xyz")]
    keep = [c for c in points.columns if c not in ("x", "y", "z")]
    return j.select(*keep, *(m.alias(c) for m, c in zip(moved, "xyz")))


# --- places and tiles ----------------------------------------------------------------------------


def _near_in_plane(keyframes: DataFrame, by: Sequence[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """Later keyframes fanned out over the grid and earlier keyframes on their own cell."""
    cell = {n: F.floor(F.col(c) / radius).cast("bigint") for n, c in (("_gx", "tx"), ("_gy", "ty"))}
    grid = keyframes.select(*by, "kf_id", "tx", "ty").withColumns(cell)
    late = fan_out(grid, planar_cells(radius, radius), ["_gx", "_gy"])
    early = grid.select(*by, "_gx", "_gy", F.col("kf_id").alias("kf1"), F.col("tx").alias("_x1"), F.col("ty").alias("_y1"))
    return late, early


def _close(radius: float, min_age: int) -> Column:
    dx, dy = F.col("tx") - F.col("_x1"), F.col("ty") - F.col("_y1")
    return (F.col("kf_id") - F.col("kf1") >= min_age) & (dx * dx + dy * dy < radius * radius)


def loop_pairs(
    keyframes: DataFrame, by: Sequence[str] = ("run_id",), radius: float = LOOP_RADIUS, min_age: int = LOOP_MIN_AGE
) -> DataFrame:
    """All (earlier, later) keyframes of a run closer than ``radius`` in the plane."""
    late, early = _near_in_plane(keyframes, by, radius)
    out = late.join(early, [*by, "_gx", "_gy"]).filter(_close(radius, min_age))
    return out.select(*by, "kf1", F.col("kf_id").alias("kf2"))


def loop_ranges(
    keyframes: DataFrame, by: Sequence[str] = ("run_id",), radius: float = LOOP_RADIUS, min_age: int = LOOP_MIN_AGE
) -> DataFrame:
    """Count, first and last of the earlier keyframes that ``loop_pairs`` finds for each later one."""
    visit = partial(Counts, radius=radius, min_age=min_age, any_=False)
    return sweep(keyframes, keyframes, by, radius, min_age, visit, Counts.columns)


def loop_candidates(
    keyframes: DataFrame, by: Sequence[str] = ("run_id",), radius: float = LOOP_RADIUS,
    min_age: int = LOOP_MIN_AGE, gap: int = LOOP_KF_GAP, skip: int = LOOP_SKIP,
) -> DataFrame:
    """Revisit candidates: sparse tests along the run and one candidate per stretch of ids.

    Whether a keyframe has any candidate needs the first found only; the greedy spacing runs over
    those keyframes, and only the tested ones pick their candidates. No near pair becomes a row before it is picked.
    """
    by = list(by)
    own = keyframes.select(*by, "kf_id", "tx", "ty")
    found = partial(Counts, radius=radius, min_age=min_age, any_=True)
    having = sweep(own, own, by, radius, min_age, found, Counts.columns).select(*by, F.col("kf2").alias("kf_id"))
    first = keyframes.groupBy(*by).agg(F.min("kf_id").alias("_first"))
    start = having.join(first, by)

    def spaced(last, row):
        now, begin = int(row[0]), int(row[1])
        last = begin if last is None else last
        take = now - last > gap
        return (now if take else last), (take,)

    tested = spaced_fold(start, by, ["kf_id"], ["kf_id", "_first"], lambda: None, spaced, "_take boolean")
    tested = cut(own.join(tested.filter("_take").select(*by, "kf_id"), [*by, "kf_id"], "left_semi"))
    picked = partial(Picks, radius=radius, min_age=min_age, skip=skip)
    return sweep(tested, own, by, radius, min_age, picked, Picks.columns).select(*by, "kf1", "kf2")


def with_relative_pose(
    pairs: DataFrame, poses: DataFrame, by: Sequence[str], a: str = "kf1", b: str = "kf2"
) -> DataFrame:
    """Pairs with ``T_a⁻¹ T_b`` as ``tx … qz``."""
    out = pairs
    for side, p in ((a, "_a"), (b, "_b")):
        named = poses.select(*by, F.col("kf_id").alias(side), *(F.col(c).alias(f"{p}_{c}") for c in geom.POSE_COLUMNS))
        out = out.join(named, [*by, side])
    rel = geom.pose_between(geom.Pose.of("_a"), geom.Pose.of("_b"))
    return out.select(*pairs.columns, *rel.columns())


def submaps(
    candidates: DataFrame, poses: DataFrame, kf_points: DataFrame, by: Sequence[str] = ("run_id",),
    centre: str = "kf1", world: bool = True, ids: Sequence[int] = SUBMAP_IDS,
) -> DataFrame:
    """Points of the keyframes around each candidate, in world axes or in the centre's frame."""
    by = list(by)
    lo, hi, step = ids
    around = candidates.select(*by, centre).distinct().withColumn("_o", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))
    around = around.withColumn("kf_id", F.col(centre) + F.col("_o")).drop("_o")
    if world:
        motion = around.join(poses.select(*by, "kf_id", *geom.POSE_COLUMNS), [*by, "kf_id"])
    else:
        motion = with_relative_pose(around, poses, by, centre, "kf_id")
    j = kf_points.join(motion, [*by, "kf_id"])
    moved = geom.transform(geom.Pose.of(), geom.Vec.of("x", "y", "z"))
    keep = [c for c in kf_points.columns if c not in ("x", "y", "z")]
    return j.select(centre, *keep, *(m.alias(c) for m, c in zip(moved, "xyz")))


def odometry_edges(poses: DataFrame, back: int = 2, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Relative poses to the 1 … ``back`` preceding keyframes (ids are consecutive), as equi joins."""
    later = poses.select(*by, "kf_id").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(back))))
    pairs = later.select(*by, (F.col("kf_id") - F.col("_i")).alias("kf1"), F.col("kf_id").alias("kf2"))
    return with_relative_pose(pairs, poses, by)


def tiles_near(poses: DataFrame, tiles: DataFrame, radius: int = 2, size: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """Existing tiles within a Manhattan distance of each pose's tile. Poses use ``x, y``.

    The tiles near a place are found once for each tile; poses meet that list, so none is fanned out before the join.
    """
    by, home = list(by), ["_hx", "_hy"]
    here = tile_key(poses, size).withColumnsRenamed({"gx": "_hx", "gy": "_hy"})
    around = tiles.select(*by, "gx", "gy", *(F.col(g).alias(h) for g, h in zip(("gx", "gy"), home)))
    around = fan_out(around, diamond(radius), home)
    around = around.groupBy(*by, *home).agg(F.collect_list(F.struct("gx", "gy")).alias("_near"))
    found = here.join(around, [*by, *home]).withColumn("_near", F.explode("_near"))
    return found.select(*(c for c in poses.columns if c not in by and c not in ("gx", "gy")), *by, "_near.gx", "_near.gy")


def tile_residency(
    poses: DataFrame, tiles: DataFrame, by: Sequence[str], order: str, span: float, load: int = 2,
    unload: int = 3, size: float = 100.0,
) -> DataFrame:
    """Tiles in memory after each tile change of a run.

    A tile within ``load`` is loaded and stays until it is farther than ``unload``. Only changes of
    tile count (``step`` numbers them); between changes nothing happens.
    """
    by = list(by)
    here = tile_key(poses, size).withColumn("_g", F.struct("gx", "gy"))
    split = needs_split(poses, by)
    here = running(here, by, [order], span, [Carry("_p", "last_before", F.col("_g"))], split)
    moved = here.filter(F.col("_p").isNull() | (F.col("_p") != F.col("_g"))).drop("_p", "_g")
    moved = running(moved, by, [order], span, [Carry("step", "count")], split, settle=True)
    base = moved.select(*by, "step", order, F.col("gx").alias("_hx"), F.col("gy").alias("_hy"), "gx", "gy")
    wide = fan_out(base, diamond(unload), ["gx", "gy"])
    wide = wide.join(tiles.select("gx", "gy").distinct(), ["gx", "gy"], "left_semi")
    near = F.abs(F.col("gx") - F.col("_hx")) + F.abs(F.col("gy") - F.col("_hy")) <= load
    wide = wide.withColumn("_in", near)
    key = [*by, "gx", "gy"]
    wide = running(wide, key, ["step"], 4096, [Carry("_prev", "last_before", F.col("step"))], split, settle=True)
    fresh = F.col("_prev").isNull() | (F.col("_prev") != F.col("step") - 1)
    wide = running(
        wide, key, ["step"], 4096,
        [Carry("_start", "last", F.when(fresh, F.col("step"))), Carry("_load", "last", F.when(F.col("_in"), F.col("step")))],
        split, settle=True,
    )
    return wide.filter(F.col("_load") >= F.col("_start")).select(*by, order, "step", "gx", "gy")


def points_in_areas(points: DataFrame, areas: DataFrame, key: Sequence[str], cell: float, enabled: bool = True) -> DataFrame:
    """``area_id`` of the first polygon that strictly contains each point, else −1.

    ``areas`` has ``area_id`` and ``ring`` (array of structs x, y). Each polygon is entered in the grid
    cells of its bounding box, so only points in those cells are tested.
    """
    if not enabled:
        return points.withColumn("area_id", F.lit(1).cast("bigint"))
    xs, ys = F.col("ring.x"), F.col("ring.y")
    box = areas.select(
        "area_id", "ring",
        *(F.floor(f(a) / cell).cast("bigint").alias(n) for a, n, f in ((xs, "_x0", F.array_min), (xs, "_x1", F.array_max), (ys, "_y0", F.array_min), (ys, "_y1", F.array_max))),
    )
    cells = box.withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")
    n = F.size("ring")
    edges = F.transform("ring", lambda v, i: F.struct(v.alias("a"), F.col("ring")[(i + 1) % n].alias("b")))
    cells = cells.withColumn("_edges", edges).drop("ring")
    px, py = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = (px - a["x"]) * (b["y"] - a["y"]) - (py - a["y"]) * (b["x"] - a["x"])
        return ((a["y"] > py) != (b["y"] > py)) & F.when(b["y"] > a["y"], side < 0).otherwise(side > 0)

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = (px - a["x"]) * (b["y"] - a["y"]) - (py - a["y"]) * (b["x"] - a["x"])
        inside = px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & py.between(
            F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
        )
        return (side == 0) & inside

    grid = points.withColumns({"_cx": F.floor(px / cell).cast("bigint"), "_cy": F.floor(py / cell).cast("bigint")})
    inside = (F.size(F.filter("_edges", crosses)) % 2 == 1) & ~F.exists("_edges", touches)
    hit = grid.join(cells, ["_cx", "_cy"]).filter(inside).groupBy(*key).agg(F.min("area_id").alias("area_id"))
    out = points.join(hit, list(key), "left")
    return out.withColumn("area_id", F.coalesce("area_id", F.lit(-1).cast("bigint")))


def dynamic_on_static(points: DataFrame, static_tiles: DataFrame, size: float = 100.0, rejected: bool = False) -> DataFrame:
    """Dynamic points on tiles of the static map (or the rejected rest)."""
    how = "left_anti" if rejected else "left_semi"
    return tile_key(points, size).join(static_tiles.select("gx", "gy").distinct(), ["gx", "gy"], how)


# --- scores and residuals ------------------------------------------------------------------------


def ndt_constants(resolution: float, outlier_ratio: float = OUTLIER_RATIO) -> tuple[float, float]:
    """The two parameters of the normal-plus-uniform mixture (Magnusson 2009, eq. 6.8)."""
    c1 = 10.0 * (1.0 - outlier_ratio)
    c2 = outlier_ratio / resolution**3
    d3 = -math.log(c2)
    d1 = -math.log(c1 + c2) - d3
    d2 = -2.0 * math.log((-math.log(c1 * math.exp(-0.5) + c2) - d3) / d1)
    return d1, d2


def ndt_pairs(
    points: DataFrame, cells: DataFrame, res: float, by: Sequence[str] = (), size: int = 7, scale: float = 1.0
) -> DataFrame:
    """World points with the cells around them: offsets ``ux, uy, uz`` (m) and inverse covariance."""
    wide = fan_out(voxel_key(points, res, "round"), stencil(size), VOXEL)
    j = wide.join(cells.select(*by, *VOXEL, "mx", "my", "mz", *INFO_NAMES), [*by, *VOXEL])
    return j.withColumns({f"u{c}": F.col(c) * scale - F.col(f"m{c}") for c in "xyz"})


def ndt_term(d1: float, d2: float) -> tuple[Column, Column]:
    """(score, exponential) of one point-cell pair; null when the pair is invalid."""
    x, y, z = F.col("ux"), F.col("uy"), F.col("uz")
    ixx, ixy, ixz, iyy, iyz, izz = (F.col(n) for n in INFO_NAMES)
    m = x * (ixx * x + ixy * y + ixz * z) + y * (ixy * x + iyy * y + iyz * z) + z * (ixz * x + iyz * y + izz * z)
    e = F.exp(m * (-d2 / 2.0))
    ok = (e * d2 <= 1.0) & (e * d2 >= 0.0) & ~F.isnan(e)
    return F.when(ok, e * -d1), F.when(ok, e)


def ndt_score(
    points: DataFrame, poses: DataFrame, cells: DataFrame, res: float, key: Sequence[str], by: Sequence[str] = (),
    metre_res: float | None = None, scale: float = 1.0,
) -> DataFrame:
    """Mean match score of each scan's points against the map cells around them."""
    d1, d2 = ndt_constants(metre_res or res)
    world = transform_points(points, poses, key)
    score, _ = ndt_term(d1, d2)
    terms = ndt_pairs(world, cells, res, by, 7, scale).groupBy(*key).agg(F.sum(score).alias("_s"))
    size = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"))
    return size.join(terms, list(key), "left").select(
        *key, "n_points", (F.coalesce("_s", F.lit(0.0)) / F.col("n_points")).alias("score")
    )


def point_to_plane(
    body: DataFrame, world: DataFrame, neighbours: DataFrame, key: Sequence[str], max_dist: float = 0.1,
    scale: float = 1.0,
) -> DataFrame:
    """Plane residual of each point and whether the correspondence is effective.

    ``body`` and ``world`` hold ``x, y, z`` of the same points in both frames, ``neighbours`` the
    result of :func:`knn` or :func:`knn_lists` for the world points.
    """
    planes = plane_fit(neighbours, key, max_dist, scale)
    w = world.select(*key, *(F.col(c).alias(f"w{c}") for c in "xyz"))
    b = body.select(*key, *(F.col(c).alias(f"b{c}") for c in "xyz"))
    j = planes.join(w, list(key)).join(b, list(key))
    r = F.col("pa") * (F.col("wx") * scale) + F.col("pb") * (F.col("wy") * scale) + F.col("pc") * (F.col("wz") * scale) + F.col("pd")
    reach = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz")) * scale
    j = j.withColumn("residual", r)
    return j.filter(reach > EFFECTIVE_RATIO * F.col("residual") * F.col("residual"))


def global_map(
    kf_points: DataFrame, poses: DataFrame, leaf: float, by: Sequence[str] = ("run_id",),
    fields: Sequence[str] = ("x", "y", "z"),
) -> DataFrame:
    """One voxel map per run: thin every keyframe, move it by its pose, thin the union again."""
    thin = voxel_downsample(kf_points, leaf, [*by, "kf_id"], fields).drop(*VOXEL, "n")
    return voxel_downsample(transform_points(thin, poses, [*by, "kf_id"]), leaf, by, fields)
