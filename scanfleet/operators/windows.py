"""Sequence operators along a vehicle's or run's time order.

All use :func:`scanfleet.operators.ordered.running`, so one long key is spread over many tasks.
``span`` is the chunk width in units of the first order column. Rules that select rows greedily
(each choice depends on the last chosen row) run in all ranges of a key at once and are put right
at the borders (:func:`spaced_fold`); the running mean of scan times, which never forgets, streams a
key's sorted rows through one task with constant memory.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfleet.functions import geom
from scanfleet.operators.ordered import Carry, running, with_halo
from scanfleet.session import cut

# Limits of the streams' health checks.
IMU_GAP_S = 0.1
SCAN_GAP_S = 0.5
IMU_SILENT_S = 1.0
KEYFRAME_DISTANCE = 2.0
KEYFRAME_ANGLE_DEG = 15.0
LOW_SCORE = 0.5
LOW_SCORE_STREAK = 10
FOLLOW_AFTER = 100
FAIL_AFTER = 300
MISSING_ERROR = -999.0


def time_deltas(
    msgs: DataFrame, by: Sequence[str], order: Sequence[str], span: float, per_second: float = 1e6,
    imu_gap: float = IMU_GAP_S, scan_gap: float = SCAN_GAP_S, silent: float = IMU_SILENT_S,
) -> DataFrame:
    """Seconds to the previous message of the key, with gap flags."""
    out = running(msgs, by, order, span, [Carry("_p", "last_before", F.col(order[0]))])
    dt = (F.col(order[0]) - F.col("_p")) / per_second
    flags = {"imu_gap": imu_gap, "scan_gap": scan_gap, "imu_silent": silent}
    out = out.withColumn("dt", dt).drop("_p")
    return out.withColumns({k: F.coalesce(F.col("dt") > v, F.lit(False)) for k, v in flags.items()})


def rolling_mean_score(
    results: DataFrame, by: Sequence[str], order: Sequence[str], span: float, n: int = 20, block: int = 1 << 16
) -> DataFrame:
    """Mean over the newest ``n`` scores up to each row."""
    pos = running(results, by, order, span, [Carry("_pos", "count")])
    cut, part = with_halo(pos, by, "_pos", block, n - 1)
    w = Window.partitionBy(*part).orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = cut.withColumn("mean_score", F.avg("score").over(w))
    return out.filter(~F.col("_halo")).drop("_halo", "_block", "_pos")


def rows_since(
    df: DataFrame, by: Sequence[str], order: Sequence[str], span: float, event: Column, name: str
) -> DataFrame:
    """Rows after the last row where ``event`` holds (0 on it; row position when there is none).

    Adds ``name`` and ``name_seen`` (whether an event has happened).
    """
    out = running(df, by, order, span, [Carry("_pos", "count")])
    mark = F.when(event, F.col("_pos"))
    out = running(out, by, order, span, [Carry("_at", "last", mark)])
    return out.withColumns(
        {name: F.col("_pos") - F.coalesce(F.col("_at"), F.lit(0)), f"{name}_seen": F.col("_at").isNotNull()}
    ).drop("_pos", "_at")


def low_score_streak(
    results: DataFrame, by: Sequence[str], order: Sequence[str], span: float,
    threshold: float = LOW_SCORE, limit: int = LOW_SCORE_STREAK,
) -> DataFrame:
    """Length of the current run of scores under ``threshold``; ``unusual`` beyond ``limit``."""
    out = rows_since(results, by, order, span, F.col("score") >= threshold, "streak").drop("streak_seen")
    return out.withColumn("unusual", F.col("streak") > limit)


def match_status(
    results: DataFrame, by: Sequence[str], order: Sequence[str], span: float,
    follow_after: int = FOLLOW_AFTER, fail_after: int = FAIL_AFTER,
) -> DataFrame:
    """GOOD, FOLLOWING_DR or FAIL by the number of failures since the last success."""
    out = rows_since(results, by, order, span, F.col("ok"), "_f").drop("_f_seen")
    fails = F.least(F.col("_f"), F.lit(fail_after))
    status = F.when(fails < follow_after, "GOOD").when(fails < fail_after, "FOLLOWING_DR").otherwise("FAIL")
    return out.withColumns({"fail_count": fails, "status": status}).drop("_f")


def hysteresis(
    df: DataFrame, by: Sequence[str], order: Sequence[str], span: float, good: Column, hold: int,
    recover_in_step: bool, name: str = "valid",
) -> DataFrame:
    """A bad sample holds the flag down until enough good ones came.

    Recovery is on the ``hold``-th good sample (``recover_in_step``) or on the one after it.
    """
    out = rows_since(df, by, order, span, ~good, "_g")
    held = F.col("_g") < hold if recover_in_step else F.col("_g") <= hold
    return out.withColumn(name, ~(F.col("_g_seen") & held)).drop("_g", "_g_seen")


def smooth_flag(
    df: DataFrame, actual: geom.Pose, predicted: geom.Pose, max_step: float = 0.5, max_deg: float = 2.0
) -> DataFrame:
    d = actual.t.minus(predicted.t)
    _, angle = geom.pose_distance(actual, predicted)
    ok = (F.abs(d.x) < max_step) & (F.abs(d.y) < max_step) & (angle < math.radians(max_deg))
    return df.withColumn("smooth", ok)


def odom_consistency(
    results: DataFrame, by: Sequence[str], order: Sequence[str], span: float,
    odom: str = "odom", loc: str = "loc", threshold: float = 0.3,
) -> DataFrame:
    """Planar gap between the odometry step and the localization step of consecutive rows."""
    now = F.struct(F.col(odom).alias("o"), F.col(loc).alias("l"))
    out = running(results, by, order, span, [Carry("_p", "last_before", now)])
    steps = []
    for k, c in (("o", odom), ("l", loc)):
        out, before = geom.stage(out, f"_b{k}", geom.Pose.field(F.col("_p").getField(k)))
        out, here = geom.stage(out, f"_n{k}", geom.Pose.field(c))
        out, step = geom.stage(out, f"_s{k}", geom.rotate(geom.quat_inv(before.q), here.t.minus(before.t)))
        steps.append(step)
    d = steps[0].minus(steps[1])
    out = out.withColumn("delta", F.sqrt(d.x * d.x + d.y * d.y)).drop("_p")
    out = geom.unstage(out, *(f"_{p}{k}" for p in "bns" for k in "ol"))
    return out.withColumn("consistent", F.coalesce(F.col("delta") <= threshold, F.lit(True)))


def pose_error_body(
    results: DataFrame, by: Sequence[str], order: Sequence[str], span: float,
    fused: str = "fused", loc: str = "loc", odom: str = "odom", window: int = 5,
) -> DataFrame:
    """Absolute x/y error of localization and odometry in the body axes of the fused pose.

    Odometry is carried from the oldest frame of the window; it is −999 when missing at either end.
    """
    pos = running(results, by, order, span, [Carry("_pos", "count")])
    pos = pos.withColumn("_ref", F.greatest(F.col("_pos") - (window - 1), F.lit(1)))
    ref = pos.select(*by, F.col("_pos").alias("_ref"), F.struct(F.col(fused).alias("f"), F.col(odom).alias("o")).alias("_r"))
    j = pos.join(ref, [*by, "_ref"])
    j, body = geom.stage(j, "_f", geom.Pose.field(fused))
    j, at = geom.stage(j, "_l", geom.Pose.field(loc).t)
    j, first = geom.stage(j, "_g", geom.Pose.field(F.col("_r").getField("f")))
    j, o0 = geom.stage(j, "_a", geom.Pose.field(F.col("_r").getField("o")))
    j, o1 = geom.stage(j, "_b", geom.Pose.field(odom))
    inv = geom.quat_inv(body.q)
    e_loc = geom.rotate(inv, at.minus(body.t))
    # Translation of first · (o0⁻¹ o1), one rotation at a time.
    j, local = geom.stage(j, "_u", geom.rotate(geom.quat_inv(o0.q), o1.t.minus(o0.t)))
    j, gap = geom.stage(j, "_v", geom.rotate(first.q, local).plus(first.t).minus(body.t))
    e_odo = geom.rotate(inv, gap)
    have = F.col(odom).isNotNull() & F.col("_r.o").isNotNull()
    j = j.withColumns(
        {
            "loc_err_x": F.abs(e_loc.x),
            "loc_err_y": F.abs(e_loc.y),
            "odom_err_x": F.when(have, F.abs(e_odo.x)).otherwise(MISSING_ERROR),
            "odom_err_y": F.when(have, F.abs(e_odo.y)).otherwise(MISSING_ERROR),
        }
    )
    return geom.unstage(j, *"_f _l _g _a _b _u _v".split()).drop("_pos", "_ref", "_r")


def path_length(
    poses: DataFrame, by: Sequence[str], order: Sequence[str], span: float,
    per_second: float = 1e3, quantum: float = 1e-6,
) -> DataFrame:
    """Step, speed and travelled distance per pose.

    The running sum adds whole ``quantum`` steps, so it is the same for every partitioning.
    """
    now = F.struct(F.col(order[0]).alias("t"), *(F.col(c) for c in ("tx", "ty", "tz")))
    out = running(poses, by, order, span, [Carry("_p", "last_before", now)])
    step = geom.Vec.of("tx", "ty", "tz").minus(geom.Vec.of("_p.tx", "_p.ty", "_p.tz")).norm()
    out = out.withColumn("_q", F.floor(F.coalesce(step, F.lit(0.0)) / quantum + 0.5).cast("bigint"))
    out = out.withColumn("_dt", (F.col(order[0]) - F.col("_p.t")) / per_second).drop("_p")
    out = running(out, by, order, span, [Carry("_sum", "sum", F.col("_q"))])
    return out.withColumns(
        {
            "step": F.col("_q") * quantum,
            "speed": F.when(F.col("_dt") > 0, F.col("_q") * quantum / F.col("_dt")),
            "path": F.col("_sum") * quantum,
        }
    ).drop("_q", "_dt", "_sum")


def propagate_opt_pose(
    keyframes: DataFrame, by: Sequence[str], order: Sequence[str], span: float,
    lio: str = "lio", opt: str = "opt",
) -> DataFrame:
    """Optimised pose of every keyframe from the last anchor: ``opt_a · lio_a⁻¹ · lio_k``.

    Rows with a non-null ``opt`` are anchors; rows before the first keep their odometry pose.
    """
    anchor = F.when(F.col(opt).isNotNull(), F.struct(F.col(opt).alias("o"), F.col(lio).alias("l")))
    out = running(keyframes, by, order, span, [Carry("_a", "last", anchor)])
    out, o = geom.stage(out, "_o", geom.Pose.field(F.col("_a").getField("o")))
    out, l0 = geom.stage(out, "_m", geom.Pose.field(F.col("_a").getField("l")))
    out, l1 = geom.stage(out, "_k", geom.Pose.field(lio))
    out, step = geom.stage(out, "_s", geom.pose_between(l0, l1))
    out, moved = geom.stage(out, "_w", geom.pose_compose(o, step))
    moved = F.when(F.col("_a").isNotNull(), moved.struct())
    out = out.withColumn("opt_pose", F.coalesce(moved, F.col(lio))).drop("_a")
    return geom.unstage(out, *"_o _m _k _s _w".split())


def trajectory_decimate(
    poses: DataFrame, by: Sequence[str], order: Sequence[str], span: float, max_size: int
) -> DataFrame:
    """Rows left when the oldest half is dropped each time the size exceeds ``max_size``."""
    half = (max_size + 1) // 2
    out = running(poses, by, order, span, [Carry("_pos", "count"), Carry("_n", "total")])
    over = F.col("_n") - (max_size + 1)
    dropped = F.when(over >= 0, (F.floor(over / half) + 1) * half).otherwise(0)
    return out.filter(F.col("_pos") > dropped).drop("_pos", "_n")


# --- greedy selections -----------------------------------------------------------------------


def ordered_fold(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, np.ndarray], tuple[object, tuple]],
    out: str,
) -> DataFrame:
    """Run a sequential rule over each key's rows in order, one Arrow batch at a time.

    Rows are shuffled by key and sorted inside the partition (an external, spillable sort);
    ``step(state, values)`` sees one row's ``columns`` and returns the new state and the added
    fields named in ``out`` (a DDL string). A key's rows are never held together: only the state
    passes from batch to batch.
    """
    keys = list(by)
    added = [f.strip().split()[0] for f in out.split(",")]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            ids = list(zip(*(pdf[k].tolist() for k in keys))) if keys else [()] * len(pdf)
            values = pdf[list(columns)].to_numpy()
            rows = []
            for key, row in zip(ids, values):
                if key != current:
                    current, state = key, start()
                state, extra = step(state, row)
                rows.append(extra)
            yield pdf.assign(**{a: [r[i] for r in rows] for i, a in enumerate(added)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def spaced_fold(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, np.ndarray], tuple[object, tuple]],
    out: str,
) -> DataFrame:
    """:func:`ordered_fold` for rules that soon forget where they began; a key of any size is spread over all tasks.

    Rows are range-partitioned by key and order once, so a key's rows are consecutive and only the key at
    a partition's border goes on in the next. Every partition first runs as if its border key began there; then
    partitions whose predecessor ended in another state than they assumed run again from that state, all at
    once, until none changes. A selection that keeps its last pick meets the assumed one after a few picks, so
    few rounds are needed; a rule that never forgets would take one round for each partition. What the driver
    holds is one state for each partition. ``order`` must be a total order within ``by``; nulls come first.
    """
    keys, names = list(by), list(columns)
    by_order = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.repartitionByRange(parts, *by_order).sortWithinPartitions(*by_order) if by_order else df.coalesce(1)
    base = cut(base.withColumn("_part", F.spark_partition_id()))
    added = [f.strip().split() for f in out.split(",")]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + out
    kinds = {"boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64(), "long": pa.int64()}

    def walked(batches: Iterator[pa.RecordBatch], begin: dict[int, bytes]) -> Iterator[tuple[pa.RecordBatch, list, tuple]]:
        """Each batch with its added fields and (part, first key, last key, state) so far."""
        first, key, state = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            values = [batch.column(c) for c in names]
            values = np.column_stack([(v.fill_null(False) if pa.types.is_boolean(v.type) else v).to_numpy(zero_copy_only=False).astype(float) for v in values])
            rows = []
            for k, row in zip(ids, values, strict=True):
                if first is None:
                    first, key = k, k
                    state = pickle.loads(begin[part]) if part in begin else start()
                elif k != key:
                    key, state = k, start()
                state, extra = step(state, row)
                rows.append(extra)
            yield batch, rows, (part, first, key, state)

    def ends(begin: dict[int, bytes], only: set[int] | None) -> dict[int, tuple]:
        """First key, last key and last state of the partitions in ``only`` (None: all)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                if only is not None and batch.num_rows and batch.column("_part")[0].as_py() not in only:
                    return
                for _, _, last in walked(chain([batch], batches), begin):
                    pass
            if last:
                yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), *(pa.array([pickle.dumps(v)]) for v in last[1:])], names=["part", "first", "last", "state"])

        found = base.select(*keys, *(n for n in dict.fromkeys(names) if n not in keys), "_part").mapInArrow(run, "part int, first binary, last binary, state binary")
        return {r["part"]: (bytes(r["first"]), bytes(r["last"]), bytes(r["state"])) for r in found.collect()}  # a row for each partition

    begin: dict[int, bytes] = {}
    known = ends(begin, None)
    while True:
        due, before = {}, None
        for part in sorted(known):
            if before is not None and known[before][1] == known[part][0] and begin.get(part) != known[before][2]:
                due[part] = known[before][2]
            before = part
        if not due:
            break
        begin |= due
        known |= ends(begin, set(due))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _ in walked(batches, begin):
            more = [pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(added)]
            own = [c for c in batch.schema.names if c != "_part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *more], names=[*own, *(n for n, _ in added)])

    return base.mapInArrow(final, schema)


def _turned(q0: np.ndarray, q1: np.ndarray) -> float:
    """Rotation angle between two unit quaternions (w, x, y, z)."""
    dot = min(1.0, abs(float(np.dot(q0, q1))))
    return 2.0 * math.acos(dot)


def keyframe_step(distance: float, angle: float, max_gap: float | None):
    """The selection rule over rows (t, tx, ty, tz, qw, qx, qy, qz); state is the last chosen row."""

    def step(last, row):
        row = np.asarray(row, dtype=float)
        take = (
            last is None
            or np.linalg.norm(row[1:4] - last[1:4]) > distance
            or _turned(row[4:], last[4:]) > angle
            or (max_gap is not None and row[0] - last[0] > max_gap)
        )
        return (row if take else last), (bool(take),)

    return step


def select_keyframes(
    poses: DataFrame, by: Sequence[str], t: str, distance: float = KEYFRAME_DISTANCE,
    angle_deg: float = KEYFRAME_ANGLE_DEG, max_gap: float | None = None,
) -> DataFrame:
    """First pose, then each pose farther or more turned than the limits from the last chosen one."""
    rule = keyframe_step(distance, math.radians(angle_deg), max_gap)
    out = spaced_fold(poses, by, [t], [t, *geom.POSE_COLUMNS], lambda: None, rule, "_take boolean")
    return out.filter("_take").drop("_take")


def pick_update_frames(
    results: DataFrame, by: Sequence[str], t: str, distance: float = 2.0, max_gap: float = 10.0,
    min_score: float = 1.0, ties: Sequence[str] = (),
) -> DataFrame:
    """Frames that update the dynamic layer: moved or waited enough since the last update, with a
    good score. Uses columns ``t, x, y, z, score, ok``; equal times go by ``ties``."""

    def step(last, row):
        now = np.asarray(row[:4], dtype=float)
        due = last is None or np.linalg.norm(now[1:] - last[1:]) > distance or abs(now[0] - last[0]) > max_gap
        take = bool(row[5]) and due and float(row[4]) > min_score
        return (now if take else last), (bool(take),)

    out = spaced_fold(results, by, [t, *ties], [t, "x", "y", "z", "score", "ok"], lambda: None, step, "_take boolean")
    return out.filter("_take").drop("_take")


def mean_scan_time(scans: DataFrame, by: Sequence[str], order: str, start: float = 0.1) -> DataFrame:
    """Scan end times and the running mean scan length.

    ``length`` is the last point offset (s), ``n_points`` the size, ``t`` the begin. A length under
    half of the running mean, or a scan of at most one point, uses the mean and does not enter it.
    """

    def step(state, row):
        n, mean = state
        begin, points, length = (float(v) for v in row)
        if points <= 1 or length < 0.5 * mean:
            return state, (begin + mean, mean)
        n += 1
        mean += (length - mean) / n
        return (n, mean), (begin + length, mean)

    cols = ["t", "n_points", "length"]
    return ordered_fold(scans, by, [order], cols, lambda: (0, start), step, "t_end double, mean_length double")
