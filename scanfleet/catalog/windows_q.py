"""Sequence operators, retention and set operations."""

from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.catalog.registry import keyframe_poses, q6, r6, register, view
from scanfleet.functions import geom, keys
from scanfleet.operators import retain as T
from scanfleet.operators import windows as W

DAY_US = 86_400_000_000
VEH = ["vehicle_id"]
ORDER = ["t_us", "seq"]
WV = "PARTITION BY vehicle_id ORDER BY t_us, seq"


def results(spark, sf):
    return fixtures.view(spark, sf, "loc_results")


@register(
    "w2_time_deltas",
    f"""WITH d AS (SELECT vehicle_id, imu_id, (t_us - lag(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us, imu_id)) / 1e6 AS dt FROM imu)
    SELECT vehicle_id, imu_id, {q6("dt")} AS dt, coalesce(dt > 600e0, false) AS imu_gap, coalesce(dt > 1800e0, false) AS scan_gap, coalesce(dt > 3600e0, false) AS imu_silent FROM d""",
)
def _(spark, sf):
    out = W.time_deltas(fixtures.view(spark, sf, "imu"), VEH, ["t_us", "imu_id"], DAY_US, 1e6, 600.0, 1800.0, 3600.0)
    return out.select("vehicle_id", "imu_id", r6("dt").alias("dt"), "imu_gap", "scan_gap", "imu_silent")


@register(
    "w3_rolling_mean_score",
    f"SELECT vehicle_id, seq, {q6(f'avg(score) OVER ({WV} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 1e-9')} AS mean_score FROM loc_results",
)
def _(spark, sf):
    # 1e-9 moves means of two-decimal scores off the rounding ties of six decimals.
    out = W.rolling_mean_score(results(spark, sf), VEH, ORDER, DAY_US)
    return out.select("vehicle_id", "seq", r6(F.col("mean_score") + 1e-9).alias("mean_score"))


def _since(event: str) -> str:
    return f"""(SELECT *, rn - coalesce(max(CASE WHEN {event} THEN rn END) OVER ({WV} ROWS UNBOUNDED PRECEDING), 0) AS since,
      max(CASE WHEN {event} THEN rn END) OVER ({WV} ROWS UNBOUNDED PRECEDING) IS NOT NULL AS seen
      FROM (SELECT *, row_number() OVER ({WV}) AS rn FROM loc_results))"""


@register(
    "w7_low_score_streak",
    f"SELECT vehicle_id, seq, since AS streak, since > 10 AS unusual FROM {_since('score >= 0.5e0')}",
)
def _(spark, sf):
    return W.low_score_streak(results(spark, sf), VEH, ORDER, DAY_US).select("vehicle_id", "seq", "streak", "unusual")


@register(
    "w8_match_status",
    f"""SELECT vehicle_id, seq, least(since, 3) AS fail_count, CASE WHEN since < 1 THEN 'GOOD' WHEN since < 3 THEN 'FOLLOWING_DR' ELSE 'FAIL' END AS status FROM {_since("ok")}""",
)
def _(spark, sf):
    out = W.match_status(results(spark, sf), VEH, ORDER, DAY_US, 1, 3)
    return out.select("vehicle_id", "seq", "fail_count", "status")


@register(
    "w9_hysteresis",
    f"""SELECT a.vehicle_id, a.seq, NOT (seen AND since < 10) AS odom_valid, NOT (seen AND since <= 10) AS fusion_valid FROM {_since("NOT ok")} a""",
)
def _(spark, sf):
    out = W.hysteresis(results(spark, sf), VEH, ORDER, DAY_US, F.col("ok"), 10, True, "odom_valid")
    out = W.hysteresis(out, VEH, ORDER, DAY_US, F.col("ok"), 10, False, "fusion_valid")
    return out.select("vehicle_id", "seq", "odom_valid", "fusion_valid")


@register(
    "w10_smooth_flag",
    """SELECT run_id, kf_id, abs(x_mm - ox_mm) < 500 AND abs(y_mm - oy_mm) < 500 AND (kf_id % 5)/1e2 < 2*pi()/180 AS smooth FROM keyframes""",
)
def _(spark, sf):
    a = keyframe_poses(spark, sf)
    b = keyframe_poses(spark, sf, opt=True).select("run_id", "kf_id", *(F.col(c).alias(f"b_{c}") for c in geom.POSE_COLUMNS))
    turn = geom.so3_exp(geom.Vec(F.lit(0.0), F.lit(0.0), (F.col("kf_id") % 5) / 100.0))
    pred = geom.Pose.of("b")
    out = W.smooth_flag(a.join(b, ["run_id", "kf_id"]), geom.Pose.of(), geom.Pose(geom.quat_mul(pred.q, turn), pred.t))
    return out.select("run_id", "kf_id", "smooth")


def _two_tracks(spark, sf):
    kf = keyframe_poses(spark, sf)
    opt = keyframe_poses(spark, sf, opt=True)
    a = kf.select("run_id", "kf_id", geom.Pose.of().struct().alias("odom"))
    b = opt.select("run_id", "kf_id", geom.Pose.of().struct().alias("loc"))
    return a.join(b, ["run_id", "kf_id"])


@register(
    "w11_odom_consistency",
    f"""WITH p AS (SELECT run_id, kf_id, x_mm - lag(x_mm) OVER w AS dx, y_mm - lag(y_mm) OVER w AS dy, ox_mm - lag(ox_mm) OVER w AS ex, oy_mm - lag(oy_mm) OVER w AS ey FROM keyframes WINDOW w AS (PARTITION BY run_id ORDER BY kf_id))
    SELECT run_id, kf_id, {q6("sqrt((dx-ex)*(dx-ex) + (dy-ey)*(dy-ey))/1000e0")} AS delta, coalesce(sqrt((dx-ex)*(dx-ex) + (dy-ey)*(dy-ey)) <= 2, true) AS consistent FROM p""",
)
def _(spark, sf):
    out = W.odom_consistency(_two_tracks(spark, sf), ["run_id"], ["kf_id"], 4096, threshold=0.002)
    return out.select("run_id", "kf_id", r6("delta").alias("delta"), "consistent")


@register(
    "w12_pose_error_body",
    f"""WITH p AS (SELECT run_id, kf_id, x_mm, y_mm, ox_mm, oy_mm, r00, r10, kf_id % 13 <> 0 AS have, ox_mm - x_mm - 20*(kf_id % 7) AS lx, oy_mm - y_mm + 10*(kf_id % 3) AS ly FROM keyframes),
      j AS (SELECT a.*, b.have AS have0, b.ox_mm AS fx, b.oy_mm AS fy, b.x_mm AS x0, b.y_mm AS y0 FROM p a JOIN p b ON a.run_id = b.run_id AND b.kf_id = greatest(a.kf_id - 4, 0)),
      e AS (SELECT *, fx + x_mm - x0 - ox_mm AS ux, fy + y_mm - y0 - oy_mm AS uy, -lx AS vx, -ly AS vy FROM j)
    SELECT run_id, kf_id, {q6("abs(r00*vx + r10*vy)/1000e0")} AS loc_err_x, {q6("abs(-r10*vx + r00*vy)/1000e0")} AS loc_err_y,
      CASE WHEN have AND have0 THEN {q6("abs(r00*ux + r10*uy)/1000e0")} ELSE -999e0 END AS odom_err_x, CASE WHEN have AND have0 THEN {q6("abs(-r10*ux + r00*uy)/1000e0")} ELSE -999e0 END AS odom_err_y FROM e""",
)
def _(spark, sf):
    t = _two_tracks(spark, sf)
    o = geom.Pose.field("odom")
    shifted = geom.Pose(o.q, geom.Vec(o.t.x + (F.col("kf_id") % 7) * 0.02, o.t.y - (F.col("kf_id") % 3) * 0.01, o.t.z))
    df = t.select(
        "run_id", "kf_id", F.col("loc").alias("fused"), shifted.struct().alias("loc"),
        F.when(F.col("kf_id") % 13 != 0, F.col("odom")).alias("odom"),
    )
    out = W.pose_error_body(df, ["run_id"], ["kf_id"], 4096)
    return out.select("run_id", "kf_id", *(r6(c).alias(c) for c in ("loc_err_x", "loc_err_y", "odom_err_x", "odom_err_y")))


@register(
    "w13_path_length",
    f"""WITH d AS (SELECT run_id, kf_id, t_ms, CAST(floor(coalesce(sqrt((x_mm-lag(x_mm) OVER w)/1000e0*((x_mm-lag(x_mm) OVER w)/1000e0) + (y_mm-lag(y_mm) OVER w)/1000e0*((y_mm-lag(y_mm) OVER w)/1000e0) + (z_mm-lag(z_mm) OVER w)/1000e0*((z_mm-lag(z_mm) OVER w)/1000e0)), 0e0) / 1e-6 + 0.5e0) AS BIGINT) AS q,
        (t_ms - lag(t_ms) OVER w)/1e3 AS dt FROM keyframes WINDOW w AS (PARTITION BY run_id ORDER BY t_ms))
    SELECT run_id, kf_id, {q6("q*1e-6 + 1e-9")} AS step, {q6("CASE WHEN dt > 0 THEN q*1e-6/dt END + 1e-9")} AS speed, {q6("CAST(sum(q) OVER (PARTITION BY run_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS BIGINT)*1e-6 + 1e-9")} AS path FROM d""",
)
def _(spark, sf):
    out = W.path_length(keyframe_poses(spark, sf), ["run_id"], ["t_ms"], 4_096_000)
    return out.select("run_id", "kf_id", *(r6(F.col(c) + 1e-9).alias(c) for c in ("step", "speed", "path")))


@register(
    "w6_propagate_opt_pose",
    f"""WITH a AS (SELECT *, last_value(CASE WHEN kf_id % 50 = 7 THEN ox_mm - x_mm END IGNORE NULLS) OVER w AS dx, last_value(CASE WHEN kf_id % 50 = 7 THEN oy_mm - y_mm END IGNORE NULLS) OVER w AS dy FROM keyframes
      WINDOW w AS (PARTITION BY run_id ORDER BY kf_id ROWS UNBOUNDED PRECEDING))
    SELECT run_id, kf_id, {q6("(x_mm + coalesce(dx, 0))/1000e0")} AS tx, {q6("(y_mm + coalesce(dy, 0))/1000e0")} AS ty, {q6("z_mm/1000e0")} AS tz FROM a""",
)
def _(spark, sf):
    t = _two_tracks(spark, sf).withColumn("opt", F.when(F.col("kf_id") % 50 == 7, F.col("loc")))
    out = W.propagate_opt_pose(t.withColumnRenamed("odom", "lio"), ["run_id"], ["kf_id"], 4096)
    return out.select("run_id", "kf_id", *(r6(F.col(f"opt_pose.{c}")).alias(c) for c in ("tx", "ty", "tz")))


@register(
    "w15_trajectory_decimate",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kf_id) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM keyframes)
    SELECT run_id, kf_id FROM n WHERE k > CASE WHEN n > 200 THEN ((n - 201) // 100 + 1) * 100 ELSE 0 END""",
)
def _(spark, sf):
    return W.trajectory_decimate(keyframe_poses(spark, sf), ["run_id"], ["kf_id"], 4096, 200).select("run_id", "kf_id")


def walked(rows: str, key: str, start: str, step: str) -> str:
    """Recursive DuckDB text: ``s`` walks the numbered ``rows`` of a key; ``start`` and ``step`` select its columns."""
    return f"""WITH RECURSIVE r AS MATERIALIZED ({rows}),
      s AS (SELECT r.{key}, r.k, {start} FROM r WHERE r.k = 1
        UNION ALL SELECT r.{key}, r.k, {step} FROM s JOIN r ON r.{key} = s.{key} AND r.k = s.k + 1)"""


_USED = "(r.n_points > 1 AND r.len >= 0.5e0 * {0})"


@register(
    "w4_mean_scan_time",
    walked(
        "SELECT run_id, scan_id, n_points, t_begin_ms/1000e0 AS t, (t_end_ms - t_begin_ms)/1000e0 AS len, row_number() OVER (PARTITION BY run_id ORDER BY scan_id) AS k FROM scans",
        "run_id",
        f"""r.scan_id, CASE WHEN {_USED.format("0.1e0")} THEN 1 ELSE 0 END AS n, CASE WHEN {_USED.format("0.1e0")} THEN 0.1e0 + (r.len - 0.1e0)/1 ELSE 0.1e0 END AS mean,
          CASE WHEN {_USED.format("0.1e0")} THEN r.t + r.len ELSE r.t + 0.1e0 END AS t_end""",
        f"""r.scan_id, CASE WHEN {_USED.format("s.mean")} THEN s.n + 1 ELSE s.n END, CASE WHEN {_USED.format("s.mean")} THEN s.mean + (r.len - s.mean)/(s.n + 1) ELSE s.mean END,
          CASE WHEN {_USED.format("s.mean")} THEN r.t + r.len ELSE r.t + s.mean END""",
    )
    + f" SELECT run_id, scan_id, {q6('t_end')} AS t_end, {q6('mean')} AS mean_length FROM s",
)
def _(spark, sf):
    scans = fixtures.view(spark, sf, "scans").select(
        "run_id", "scan_id", (F.col("t_begin_ms") / 1000.0).alias("t"), "n_points", ((F.col("t_end_ms") - F.col("t_begin_ms")) / 1000.0).alias("length")
    )
    out = W.mean_scan_time(scans, ["run_id"], "scan_id")
    return out.select("run_id", "scan_id", r6("t_end").alias("t_end"), r6("mean_length").alias("mean_length"))


_FAR = """(sqrt((r.x - s.x)*(r.x - s.x) + (r.y - s.y)*(r.y - s.y) + (r.z - s.z)*(r.z - s.z)) > 3e0
          OR 2e0 * acos(least(1e0, abs(r.qw*s.qw + r.qz*s.qz))) > radians(15e0))"""


@register(
    "w5_select_keyframes",
    walked(
        """SELECT run_id, kf_id, x_mm/1000e0 AS x, y_mm/1000e0 AS y, z_mm/1000e0 AS z, sqrt((1 + r00)/2e0) AS qw,
          sqrt((1 - r00)/2e0)*CASE WHEN r10 < 0 THEN -1e0 ELSE 1e0 END AS qz, row_number() OVER (PARTITION BY run_id ORDER BY t_ms) AS k FROM keyframes""",
        "run_id",
        "r.kf_id, true AS take, r.x, r.y, r.z, r.qw, r.qz",
        f"r.kf_id, {_FAR}, " + ", ".join(f"CASE WHEN {_FAR} THEN r.{c} ELSE s.{c} END" for c in ("x", "y", "z", "qw", "qz")),
    )
    + " SELECT run_id, kf_id FROM s WHERE take",
)
def _(spark, sf):
    return W.select_keyframes(keyframe_poses(spark, sf), ["run_id"], "t_ms", 3.0, 15.0).select("run_id", "kf_id")


_DUE = "(r.ok AND r.score > 0.1e0 AND (s.t IS NULL OR sqrt((r.x - s.x)*(r.x - s.x) + (r.y - s.y)*(r.y - s.y)) > 0.5e0 OR abs(r.t - s.t) > 36000e0))"


@register(
    "w14_pick_update_frames",
    walked(
        """SELECT vehicle_id, seq, t_us/1e6 AS t, x_mm/1000e0 AS x, y_mm/1000e0 AS y, score, ok,
          row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, seq) AS k FROM loc_results""",
        "vehicle_id",
        "r.seq, r.ok AND r.score > 0.1e0 AS take, " + ", ".join(f"CASE WHEN r.ok AND r.score > 0.1e0 THEN r.{c} END AS {c}" for c in "txy"),
        f"r.seq, {_DUE}, " + ", ".join(f"CASE WHEN {_DUE} THEN r.{c} ELSE s.{c} END" for c in "txy"),
    )
    + " SELECT vehicle_id, seq FROM s WHERE take",
)
def _(spark, sf):
    res = results(spark, sf).select("vehicle_id", "seq", (F.col("t_us") / 1e6).alias("t"), (F.col("x_mm") / 1000.0).alias("x"), (F.col("y_mm") / 1000.0).alias("y"), F.lit(0.0).alias("z"), "score", "ok")
    return W.pick_update_frames(res, VEH, "t", 0.5, 36000.0, 0.1, ["seq"]).select("vehicle_id", "seq")


@register(
    "t1_sort_by_offset",
    """SELECT run_id, scan_id, idx, row_number() OVER (PARTITION BY run_id, scan_id ORDER BY (idx*7919) % 1009, idx) AS rank FROM points""",
)
def _(spark, sf):
    pts = view(spark, sf, "points").withColumn("off", (F.col("idx") * 7919) % 1009)
    return T.offset_rank(T.sort_by_offset(pts, offset="off"), ["run_id", "scan_id"], "off", 256).select("run_id", "scan_id", "idx", "rank")


RK = "CAST(round({0}_mm/500e0) AS BIGINT)"
VOX = ", ".join(RK.format(c) for c in "xyz")


@register(
    "t2_retain_latest",
    f"SELECT scan_id, idx FROM (SELECT scan_id, idx, row_number() OVER (PARTITION BY {VOX} ORDER BY scan_id DESC, idx DESC) AS k FROM points) WHERE k <= 9",
)
def _(spark, sf):
    return T.retain_latest(view(spark, sf, "points"), 500, ["scan_id", "idx"]).select("scan_id", "idx")


@register(
    "t3_retain_voxels",
    f"""WITH v AS (SELECT run_id, scan_id, idx, scan_id*100000 + idx AS seq, {", ".join(f"{RK.format(c)} AS v{c}" for c in "xyz")} FROM points),
      t AS (SELECT run_id, vx, vy, vz, row_number() OVER (PARTITION BY run_id ORDER BY max(seq) DESC) AS k FROM v GROUP BY run_id, vx, vy, vz)
    SELECT v.scan_id, v.idx FROM v JOIN t ON v.run_id = t.run_id AND v.vx = t.vx AND v.vy = t.vy AND v.vz = t.vz WHERE k <= 1499""",
)
def _(spark, sf):
    pts = view(spark, sf, "points").withColumn("seq", F.col("scan_id") * 100000 + F.col("idx"))
    return T.retain_voxels(pts, 500, "seq", 1500, ["run_id"], 1_000_000).select("scan_id", "idx")


@register(
    "t4_cap_tile",
    """WITH k AS (SELECT scan_id*100000 + idx AS seq, x_mm, y_mm, z_mm, CAST(floor(x_mm/5000e0 + 0.5e0) AS BIGINT) AS gx, CAST(floor(y_mm/5000e0 + 0.5e0) AS BIGINT) AS gy FROM points),
      s AS (SELECT *, count(*) OVER (PARTITION BY gx, gy) > 1.5e0*1500 AS over FROM k),
      u AS (SELECT gx, gy, CAST(x_mm AS DOUBLE) AS x, CAST(y_mm AS DOUBLE) AS y, CAST(z_mm AS DOUBLE) AS z, seq FROM s WHERE NOT over
        UNION ALL SELECT gx, gy, avg(x_mm), avg(y_mm), avg(z_mm), max(seq) FROM s WHERE over GROUP BY gx, gy, floor(x_mm/1000e0), floor(y_mm/1000e0), floor(z_mm/1000e0)),
      r AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY seq, x, y, z) AS p, count(*) OVER (PARTITION BY gx, gy) AS n FROM u)
    SELECT gx, gy, x, y, z, seq FROM r WHERE p > CASE WHEN n > 1500 THEN floor(n*0.7e0) ELSE 0 END""",
)
def _(spark, sf):
    pts = view(spark, sf, "points").withColumn("seq", F.col("scan_id") * 100000 + F.col("idx"))
    return T.cap_tile(pts, 1500, "seq", 1_000_000, 5000, 1000)


@register(
    "t6_keep_last",
    f"SELECT vehicle_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, seq DESC) AS k FROM loc_results) WHERE k <= 20",
)
def _(spark, sf):
    return T.keep_last(results(spark, sf), VEH, ORDER, 20, DAY_US).select("vehicle_id", "seq")


TILE = "CAST(floor({0}/4000e0 + 0.5e0) AS BIGINT)"


@register(
    "u1_all_map",
    f"""WITH p AS (SELECT run_id, scan_id, idx, {TILE.format("x_mm")} AS gx, {TILE.format("y_mm")} AS gy FROM points)
    SELECT scan_id, idx, gx, gy, CASE WHEN run_id < 2 THEN 'static' ELSE 'dynamic' END AS layer FROM p WHERE abs(gx) + abs(gy) <= 2""",
)
def _(spark, sf):
    pts = keys.tile_key(view(spark, sf, "points"), 4000)
    near = pts.select("gx", "gy").distinct().filter(F.abs("gx") + F.abs("gy") <= 2)
    out = T.all_map(pts.filter("run_id < 2"), pts.filter("run_id >= 2"), near)
    return out.select("scan_id", "idx", "gx", "gy", "layer")


@register("u2_touched_keys", f"SELECT DISTINCT run_id, {', '.join(f'{RK.format(c)} AS v{c}' for c in 'xyz')} FROM points")
def _(spark, sf):
    return T.touched_keys(keys.voxel_key(view(spark, sf, "points"), 500, "round"), ["run_id", "vx", "vy", "vz"])


CHI = "(mx_mm*mx_mm + my_mm*my_mm + mz_mm*mz_mm) % 99991 / 1000e0"


@register(
    "u3_apply_edge_levels",
    f"SELECT v0, v1, CAST(CASE WHEN {CHI} > 40e0 THEN 1 ELSE 0 END AS BIGINT) AS level, CASE WHEN {CHI} > 40e0 THEN 'cauchy' END AS kernel FROM graph_edges",
)
def _(spark, sf):
    e = fixtures.view(spark, sf, "graph_edges").withColumns({"chi2": F.expr(CHI.replace("1000e0", "1000D")), "kernel": F.lit("cauchy")})
    return T.apply_edge_levels(e, 40.0).select("v0", "v1", "level", "kernel")


@register(
    "u4_valid_edges",
    """WITH e AS (SELECT etype, v0, v1 FROM graph_edges UNION ALL SELECT etype, v0, v1 FROM graph_edges WHERE etype = 'odom'
        UNION ALL SELECT 'odom', v0, v0 FROM graph_edges UNION ALL SELECT 'loop', v0, v1 + 500000 FROM graph_edges)
    SELECT DISTINCT etype, v0, v1 FROM e WHERE v0 <> v1 AND v0 IN (SELECT v_id FROM graph_vertices) AND v1 IN (SELECT v_id FROM graph_vertices)""",
)
def _(spark, sf):
    e = fixtures.view(spark, sf, "graph_edges").select("etype", "v0", "v1")
    dirty = (
        e.unionByName(e.filter("etype = 'odom'"))
        .unionByName(e.select(F.lit("odom").alias("etype"), "v0", F.col("v0").alias("v1")))
        .unionByName(e.select(F.lit("loop").alias("etype"), "v0", (F.col("v1") + 500000).alias("v1")))
    )
    return T.valid_edges(dirty, fixtures.view(spark, sf, "graph_vertices")).select("etype", "v0", "v1")
