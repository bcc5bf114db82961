"""Spatial, as-of and interval joins."""

from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.catalog.aggregate_q import SYM, moments_sql, sql_inverse
from scanfleet.catalog.registry import ENTRIES, keyframe_poses, q6, r6, register, view
from scanfleet.functions import geom, keys
from scanfleet.operators import aggregate as A
from scanfleet.operators import joins as J
from scanfleet.operators import retain as T

RK = "CAST(round({0}_mm/500e0) AS BIGINT)"
V = ["vx", "vy", "vz"]
PID = ["run_id", "scan_id", "idx"]
DAY_US = 86_400_000_000


def cells_sql(leaf: int = 1000) -> str:
    key = ", ".join(f"CAST(round({c}_mm/{leaf}e0) AS BIGINT) AS v{c}" for c in "xyz")
    return f"(SELECT {key}, count(*) AS n FROM points GROUP BY ALL)"


@register(
    "j1_lookup_cells",
    f"""SELECT run_id, scan_id, idx, n FROM (SELECT *, {", ".join(f"CAST(round({c}_mm/1000e0) AS BIGINT) AS v{c}" for c in "xyz")} FROM points) JOIN {cells_sql()} USING (vx, vy, vz)""",
)
def _(spark, sf):
    pts = view(spark, sf, "points")
    cells = keys.voxel_key(pts, 1000, "round").groupBy(*V).agg(F.count(F.lit(1)).alias("n"))
    return J.lookup_cells(pts, cells, 1000).select(*PID, "n")


@register(
    "j2_neighbour_cells",
    f"""WITH o AS (SELECT i, j, k FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), (SELECT unnest([-1,0,1]) AS k) WHERE abs(i)+abs(j)+abs(k) <= 1),
      p AS (SELECT run_id, scan_id, idx, CAST(round(x_mm/1000e0) AS BIGINT) + i AS vx, CAST(round(y_mm/1000e0) AS BIGINT) + j AS vy, CAST(round(z_mm/1000e0) AS BIGINT) + k AS vz FROM points, o)
    SELECT run_id, scan_id, idx, count(*) AS cells, CAST(sum(n) AS BIGINT) AS total FROM p JOIN {cells_sql()} USING (vx, vy, vz) WHERE n >= 6 GROUP BY run_id, scan_id, idx""",
)
def _(spark, sf):
    pts = view(spark, sf, "points")
    cells = keys.voxel_key(pts, 1000, "round").groupBy(*V).agg(F.count(F.lit(1)).alias("n"))
    out = J.neighbour_cells(pts.select(*PID, "x", "y", "z"), cells, 1000, 7, 6)
    return out.groupBy(*PID).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total"))


MAP_SQL = f"""m AS MATERIALIZED (SELECT * FROM (SELECT scan_id*100000 + idx AS map_id, x_mm AS nx, y_mm AS ny, z_mm AS nz, {", ".join(f"{RK.format(c)} AS v{c}" for c in "xyz")},
      row_number() OVER (PARTITION BY {", ".join(RK.format(c) for c in "xyz")} ORDER BY scan_id DESC, idx DESC) AS r FROM points) WHERE r <= 9)"""


def knn_sql(k: int, reach: int = 2) -> str:
    """CTEs: retained map ``m`` and the k nearest neighbours ``n`` of every point."""
    return f"""{MAP_SQL},
      o AS MATERIALIZED (SELECT i, j, k FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), (SELECT unnest([-1,0,1]) AS k) WHERE abs(i)+abs(j)+abs(k) <= {reach}),
      q AS (SELECT scan_id, idx, x_mm, y_mm, z_mm, {", ".join(f"{RK.format(c)} + {o} AS v{c}" for c, o in zip("xyz", "ijk"))} FROM points, o),
      d AS (SELECT scan_id, idx, map_id, nx, ny, nz, (nx-x_mm)*(nx-x_mm) + (ny-y_mm)*(ny-y_mm) + (nz-z_mm)*(nz-z_mm) AS d2 FROM q JOIN m USING (vx, vy, vz)),
      n AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, idx ORDER BY d2, map_id) AS rank FROM d WHERE d2 < 25000000) WHERE rank <= {k})"""


def recent_map(pts):
    kept = T.retain_latest(pts, 500, ["scan_id", "idx"])
    return kept.select((F.col("scan_id") * 100000 + F.col("idx")).alias("map_id"), "x", "y", "z")


def five_nearest(pts, k: int = 5, find=J.knn_lists):
    return find(pts, recent_map(pts), ["scan_id", "idx"], "map_id", k, 5000, 500, 19)


@register("j3_knn", f"WITH {knn_sql(5)} SELECT scan_id, idx, map_id, d2, rank FROM n")
def _(spark, sf):
    return five_nearest(view(spark, sf, "points"), find=J.knn).select("scan_id", "idx", "map_id", "d2", "rank")


@register("j4_nearest", f"WITH {knn_sql(1)} SELECT scan_id, idx, map_id, d2 FROM points LEFT JOIN n USING (scan_id, idx)")
def _(spark, sf):
    pts = view(spark, sf, "points")
    return J.nearest(pts, recent_map(pts), ["scan_id", "idx"], "map_id", 5000, 500, 19).select("scan_id", "idx", "map_id", "d2")


@register(
    "j5_sync_nearest",
    """WITH s AS (SELECT scan_id, vehicle_id, t_us + 100000 AS te FROM scan_stamps),
      p AS (SELECT s.*, i.imu_id AS pi, i.t_us AS pt FROM s ASOF LEFT JOIN imu i ON s.vehicle_id = i.vehicle_id AND s.te >= i.t_us),
      n AS (SELECT p.*, i.imu_id AS ni, i.t_us AS nt FROM p ASOF LEFT JOIN imu i ON p.vehicle_id = i.vehicle_id AND p.te <= i.t_us),
      b AS (SELECT scan_id, vehicle_id, te, CASE WHEN nt IS NULL OR te - pt <= nt - te THEN pi ELSE ni END AS imu_id, least(coalesce(te - pt, 1e18), coalesce(nt - te, 1e18)) AS gap FROM n)
    SELECT scan_id, vehicle_id, imu_id FROM b WHERE gap < 1800000000""",
)
def _(spark, sf):
    scans = fixtures.view(spark, sf, "scan_stamps").withColumnRenamed("t_us", "t")
    imu = fixtures.view(spark, sf, "imu").select("vehicle_id", "imu_id", F.col("t_us").alias("t"))
    out = J.sync_nearest(scans, imu, ["vehicle_id"], DAY_US, tolerance=1_800_000_000, period=100_000)
    return out.select("scan_id", "vehicle_id", F.col("imu.imu_id").alias("imu_id"))


@register(
    "j6_group_imu_by_scan",
    """SELECT imu_id, vehicle_id, scan_id FROM (SELECT i.imu_id, i.vehicle_id, s.scan_id FROM imu i ASOF LEFT JOIN (SELECT vehicle_id, scan_id, t_us + 100000 AS te FROM scan_stamps) s ON i.vehicle_id = s.vehicle_id AND i.t_us <= s.te) WHERE scan_id IS NOT NULL""",
)
def _(spark, sf):
    scans = fixtures.view(spark, sf, "scan_stamps").withColumn("t_end", F.col("t_us") + 100_000)
    imu = fixtures.view(spark, sf, "imu").select("vehicle_id", "imu_id", F.col("t_us").alias("t"))
    return J.group_imu_by_scan(scans, imu, ["vehicle_id"], DAY_US).select("imu_id", "vehicle_id", "scan_id")


@register(
    "j7_interpolate_pose",
    f"""WITH k AS (SELECT run_id, kf_id, t_ms, x_mm, y_mm, z_mm, atan2(r10, r00) AS yaw FROM keyframes),
      l AS (SELECT run_id AS lr, max(t_ms) AS tl, max_by(kf_id, t_ms) AS kl FROM k GROUP BY 1),
      j AS (SELECT q.*, tl, kl, CASE WHEN q.t_ms > tl THEN tl - 1000 ELSE (ceil(q.t_ms/1000e0) - 1)*1000 END AS ta FROM pose_queries q JOIN l ON run_id = lr),
      b AS (SELECT j.run_id, q_id, j.t_ms, tl, a.kf_id AS ka, b.kf_id AS kb, (j.t_ms - ta)/1000e0 AS s, a.x_mm AS ax, a.y_mm AS ay, a.z_mm AS az, b.x_mm AS bx, b.y_mm AS b_y, b.z_mm AS bz, a.yaw AS aw,
          CASE WHEN b.yaw - a.yaw > 3.2e0 THEN b.yaw - a.yaw - 2*pi() WHEN b.yaw - a.yaw < -3.2e0 THEN b.yaw - a.yaw + 2*pi() ELSE b.yaw - a.yaw END AS dw
        FROM j LEFT JOIN k a ON a.run_id = j.run_id AND a.t_ms = ta LEFT JOIN k b ON b.run_id = j.run_id AND b.t_ms = ta + 1000),
      w AS (SELECT *, t_ms > tl AS after, t_ms - tl AS late FROM b)
    SELECT run_id, q_id, CASE WHEN t_ms < -500 OR late >= 500 THEN NULL WHEN after THEN kb WHEN ka IS NULL THEN kb WHEN s < 0.5e0 THEN ka ELSE kb END AS best_match,
      {q6("CASE WHEN t_ms < -500 OR late >= 500 THEN NULL WHEN ka IS NULL THEN bx/1000e0 WHEN after AND abs(dw) < 1e-9 THEN (bx + (s-1)*(bx-ax))/1000e0 WHEN after THEN NULL ELSE (ax*(1e0-s) + bx*s)/1000e0 END + 1e-9")} AS tx,
      {q6("CASE WHEN t_ms < -500 OR late >= 500 THEN NULL WHEN ka IS NULL THEN b_y/1000e0 WHEN after AND abs(dw) < 1e-9 THEN (b_y + (s-1)*(b_y-ay))/1000e0 WHEN after THEN NULL ELSE (ay*(1e0-s) + b_y*s)/1000e0 END + 1e-9")} AS ty,
      {q6("CASE WHEN t_ms < -500 OR late >= 500 THEN NULL WHEN ka IS NULL THEN bz/1000e0 WHEN after THEN (bz + (s-1)*(bz-az))/1000e0 ELSE (az*(1e0-s) + bz*s)/1000e0 END + 1e-9")} AS tz
    FROM w""",
)
def _(spark, sf):
    poses = keyframe_poses(spark, sf).withColumns({"t": F.col("t_ms") / 1000.0, "pose_id": F.col("kf_id")})
    q = fixtures.view(spark, sf, "pose_queries").withColumn("t", F.col("t_ms") / 1000.0)
    out = J.interpolate_pose(q, poses, ["run_id"], 4096.0)
    return out.select("run_id", "q_id", "best_match", *(r6(F.col(c) + 1e-9).alias(c) for c in ("tx", "ty", "tz")))


@register(
    "j8_deskew",
    f"""WITH s AS (SELECT run_id, scan_id FROM scans), h AS (SELECT run_id, scan_id, k, k*12e0 AS off, k*0.01e0 AS yaw, k*0.05e0 AS px, (k+1)*0.001e0 AS gz, (k+1)*0.0001e0 AS acc FROM s, (SELECT unnest([0,1,2,3,4,5,6,7]) AS k)),
      p AS (SELECT run_id, scan_id, idx, x_mm/1000e0 AS x, y_mm/1000e0 AS y, z_mm/1000e0 AS z, idx*0.15e0 AS t FROM points),
      i AS (SELECT p.*, h.k, h.off, yaw, px, gz, acc, t - h.off AS dt FROM p ASOF LEFT JOIN (SELECT * FROM h WHERE k < 7) h ON p.run_id = h.run_id AND p.scan_id = h.scan_id AND p.t > h.off),
      w AS (SELECT *, yaw + gz*dt AS a, px + 0.004e0*dt + 0.5e0*acc*dt*dt - 0.35e0 AS sx FROM i),
      v AS (SELECT *, cos(a)*x - sin(a)*y + sx AS wx, sin(a)*x + cos(a)*y AS wy FROM w)
    SELECT run_id, scan_id, idx, {q6("CASE WHEN k IS NULL THEN x ELSE cos(0.07e0)*wx + sin(0.07e0)*wy END + 1e-9")} AS x, {q6("CASE WHEN k IS NULL THEN y ELSE -sin(0.07e0)*wx + cos(0.07e0)*wy END + 1e-9")} AS y, {q6("z + 1e-9")} AS z FROM v""",
)
def _(spark, sf):
    key = ["run_id", "scan_id"]
    pts = view(spark, sf, "points", metres=True).withColumn("t", F.col("idx") * 0.15)
    k = F.col("k")
    zero = F.lit(0.0)
    imu = fixtures.view(spark, sf, "scans").select(*key, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    turn = geom.so3_exp(geom.Vec(zero, zero, k * 0.01), 1.0, 1e-12)
    imu = imu.select(
        *key, (k * 12.0).alias("off"), *(c.alias(f"q{n}") for n, c in zip("wxyz", turn)), (k * 0.05).alias("px"), zero.alias("py"), zero.alias("pz"),
        F.lit(0.004).alias("vx"), zero.alias("vy"), zero.alias("vz"), zero.alias("gx"), zero.alias("gy"), (k * 0.001).alias("gz"), (k * 0.0001).alias("ax"), zero.alias("ay"), zero.alias("az"),
    )
    end = geom.Pose(geom.so3_exp(geom.Vec(zero, zero, F.lit(0.07)), 1.0), geom.Vec(F.lit(0.35), zero, zero))
    ends = fixtures.view(spark, sf, "scans").select(*key, *end.columns())
    out = J.deskew(pts, imu, ends, key, 1000.0)
    return out.select(*key, "idx", *(r6(F.col(c) + 1e-9).alias(c) for c in "xyz"))


@register(
    "j9_loop_pairs",
    """SELECT a.run_id, a.kf_id AS kf1, b.kf_id AS kf2 FROM keyframes a JOIN keyframes b ON a.run_id = b.run_id AND b.kf_id - a.kf_id >= 50
    WHERE (a.x_mm - b.x_mm)*(a.x_mm - b.x_mm) + (a.y_mm - b.y_mm)*(a.y_mm - b.y_mm) < 9000000""",
)
def _(spark, sf):
    # 3 m instead of 30 m; the all-pairs report still grows with the square of the laps driven.
    return J.loop_pairs(keyframe_poses(spark, sf, metres=False), radius=3000.0)


@register(
    "j9_loop_candidates",
    """WITH RECURSIVE c AS (SELECT DISTINCT b.run_id AS r, b.kf_id AS k FROM keyframes a JOIN keyframes b ON a.run_id = b.run_id AND b.kf_id - a.kf_id >= 50
        WHERE (a.x_mm - b.x_mm)*(a.x_mm - b.x_mm) + (a.y_mm - b.y_mm)*(a.y_mm - b.y_mm) < 900000000),
      t(r, k) AS (SELECT r, min(k) FROM c WHERE k > 20 GROUP BY r UNION ALL SELECT t.r, (SELECT min(c.k) FROM c WHERE c.r = t.r AND c.k > t.k + 20) FROM t WHERE t.k IS NOT NULL),
      p AS (SELECT t.r, t.k AS kf2, a.kf_id AS kf1 FROM t JOIN keyframes b ON b.run_id = t.r AND b.kf_id = t.k JOIN keyframes a ON a.run_id = t.r AND t.k - a.kf_id >= 50
        WHERE (a.x_mm - b.x_mm)*(a.x_mm - b.x_mm) + (a.y_mm - b.y_mm)*(a.y_mm - b.y_mm) < 900000000),
      g(r, kf2, kf1) AS (SELECT r, kf2, min(kf1) FROM p GROUP BY r, kf2 UNION ALL SELECT g.r, g.kf2, (SELECT min(p.kf1) FROM p WHERE p.r = g.r AND p.kf2 = g.kf2 AND p.kf1 > g.kf1 + 20) FROM g WHERE g.kf1 IS NOT NULL)
    SELECT r AS run_id, kf1, kf2 FROM g WHERE kf1 IS NOT NULL""",
)
def _(spark, sf):
    return J.loop_candidates(keyframe_poses(spark, sf, metres=False), radius=30_000.0)


@register(
    "j9_loop_ranges",
    """SELECT a.run_id, b.kf_id AS kf2, count(*) AS n, min(a.kf_id) AS first_kf1, max(a.kf_id) AS last_kf1 FROM keyframes a JOIN keyframes b ON a.run_id = b.run_id AND b.kf_id - a.kf_id >= 50
    WHERE (a.x_mm - b.x_mm)*(a.x_mm - b.x_mm) + (a.y_mm - b.y_mm)*(a.y_mm - b.y_mm) < 900000000 GROUP BY ALL""",
)
def _(spark, sf):
    return J.loop_ranges(keyframe_poses(spark, sf, metres=False), radius=30_000.0)


@register(
    "j10_loop_submaps",
    f"""WITH c AS (SELECT DISTINCT run_id, kf1 FROM ({ENTRIES["j9_loop_candidates"].sql})),
      w AS (SELECT c.run_id, c.kf1, p.kf_id, p.idx, k.x_mm + k.r00*p.x_mm - k.r10*p.y_mm AS x, k.y_mm + k.r10*p.x_mm + k.r00*p.y_mm AS y, k.z_mm + p.z_mm AS z, z.x_mm AS cx, z.y_mm AS cy, z.z_mm AS cz, z.r00 AS c0, z.r10 AS c1
        FROM c JOIN (SELECT unnest(range(-40, 37, 4)) AS o) ON true JOIN keyframes k ON k.run_id = c.run_id AND k.kf_id = kf1 + o JOIN kf_points p ON p.run_id = k.run_id AND p.kf_id = k.kf_id JOIN keyframes z ON z.run_id = c.run_id AND z.kf_id = kf1)
    SELECT run_id, kf1, kf_id, idx, {q6("(c0*(x-cx) + c1*(y-cy))/1000e0")} AS x, {q6("(-c1*(x-cx) + c0*(y-cy))/1000e0")} AS y, {q6("(z-cz)/1000e0")} AS z FROM w""",
)
def _(spark, sf):
    centres = J.loop_candidates(keyframe_poses(spark, sf, metres=False), radius=30_000.0)
    out = J.submaps(centres, keyframe_poses(spark, sf), view(spark, sf, "kf_points", metres=True), world=False)
    return out.select("run_id", "kf1", "kf_id", "idx", *(r6(c).alias(c) for c in "xyz"))


@register(
    "j11_odometry_edges",
    f"""SELECT a.run_id, a.kf_id AS kf1, b.kf_id AS kf2, {q6("(a.r00*(b.x_mm-a.x_mm) + a.r10*(b.y_mm-a.y_mm))/1000e0")} AS tx, {q6("(-a.r10*(b.x_mm-a.x_mm) + a.r00*(b.y_mm-a.y_mm))/1000e0")} AS ty, {q6("(b.z_mm-a.z_mm)/1000e0")} AS tz
    FROM keyframes a JOIN keyframes b ON a.run_id = b.run_id AND b.kf_id - a.kf_id BETWEEN 1 AND 2""",
)
def _(spark, sf):
    out = J.odometry_edges(keyframe_poses(spark, sf), 2)
    return out.select("run_id", "kf1", "kf2", *(r6(c).alias(c) for c in ("tx", "ty", "tz")))


TK = "CAST(floor({0}/20000e0 + 0.5e0) AS BIGINT)"


@register(
    "j13_tiles_near",
    f"""WITH k AS (SELECT run_id, kf_id, {TK.format("x_mm")} AS hx, {TK.format("y_mm")} AS hy FROM keyframes), t AS (SELECT DISTINCT hx AS gx, hy AS gy FROM k)
    SELECT run_id, kf_id, gx, gy FROM k JOIN t ON abs(gx-hx) + abs(gy-hy) <= 2""",
)
def _(spark, sf):
    kf = view(spark, sf, "keyframes").select("run_id", "kf_id", "x", "y")
    tiles = keys.tile_key(kf, 20_000).select("gx", "gy").distinct()
    return J.tiles_near(kf, tiles, 2, 20_000).select("run_id", "kf_id", "gx", "gy")


@register(
    "j14_tile_residency",
    f"""WITH k AS (SELECT run_id, kf_id, {TK.format("x_mm")} AS hx, {TK.format("y_mm")} AS hy FROM keyframes), t AS (SELECT DISTINCT hx AS gx, hy AS gy FROM k),
      c AS (SELECT *, lag(hx) OVER w AS lx, lag(hy) OVER w AS ly FROM k WINDOW w AS (PARTITION BY run_id ORDER BY kf_id)),
      s AS (SELECT run_id, kf_id, hx, hy, row_number() OVER (PARTITION BY run_id ORDER BY kf_id) AS step FROM c WHERE lx IS NULL OR lx <> hx OR ly <> hy),
      e AS (SELECT run_id, kf_id, step, gx, gy, abs(gx-hx) + abs(gy-hy) AS d FROM s, t),
      f AS (SELECT *, max(CASE WHEN d <= 2 THEN step END) OVER w AS lin, max(CASE WHEN d > 3 THEN step END) OVER w AS lout FROM e WINDOW w AS (PARTITION BY run_id, gx, gy ORDER BY step ROWS UNBOUNDED PRECEDING))
    SELECT run_id, kf_id, step, gx, gy FROM f WHERE lin IS NOT NULL AND (lout IS NULL OR lin > lout)""",
)
def _(spark, sf):
    kf = view(spark, sf, "keyframes").select("run_id", "kf_id", "x", "y")
    tiles = keys.tile_key(kf, 20_000).select("gx", "gy").distinct()
    return J.tile_residency(kf, tiles, ["run_id"], "kf_id", 4096, 2, 3, 20_000)


@register(
    "j15_points_in_areas",
    """WITH e AS (SELECT area_id, x_mm AS x1, y_mm AS y1, lead(x_mm, 1, first_value) OVER w AS x2, lead(y_mm, 1, fy) OVER w AS y2 FROM (SELECT *, first_value(x_mm) OVER v AS first_value, first_value(y_mm) OVER v AS fy FROM dyn_areas WINDOW v AS (PARTITION BY area_id ORDER BY k)) WINDOW w AS (PARTITION BY area_id ORDER BY k)),
      h AS (SELECT run_id, scan_id, idx, area_id, min((x2-x1)*(y_mm-y1) - (y2-y1)*(x_mm-x1)) AS inside FROM points, e GROUP BY ALL)
    SELECT p.run_id, p.scan_id, p.idx, coalesce(min(area_id), -1) AS area_id FROM points p LEFT JOIN (SELECT * FROM h WHERE inside > 0) h ON p.run_id = h.run_id AND p.scan_id = h.scan_id AND p.idx = h.idx GROUP BY p.run_id, p.scan_id, p.idx""",
)
def _(spark, sf):
    rings = fixtures.view(spark, sf, "dyn_areas").groupBy("area_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "x_mm", "y_mm"))), lambda v: F.struct(v["x_mm"].alias("x"), v["y_mm"].alias("y"))).alias("ring")
    )
    return J.points_in_areas(view(spark, sf, "points"), rings, PID, 1000.0).select(*PID, "area_id")


@register(
    "j16_dynamic_on_static",
    """WITH p AS (SELECT *, CAST(floor(x_mm/2000e0 + 0.5e0) AS BIGINT) AS gx, CAST(floor(y_mm/2000e0 + 0.5e0) AS BIGINT) AS gy FROM points), s AS (SELECT DISTINCT gx, gy FROM p WHERE run_id = 0 AND (gx + gy) % 2 = 0)
    SELECT run_id, scan_id, idx, 'kept' AS fate FROM p SEMI JOIN s USING (gx, gy) UNION ALL SELECT run_id, scan_id, idx, 'rejected' FROM p ANTI JOIN s USING (gx, gy)""",
)
def _(spark, sf):
    pts = view(spark, sf, "points")
    tiles = keys.tile_key(pts.filter("run_id = 0"), 2000).filter("(gx + gy) % 2 = 0").select("gx", "gy").distinct()
    parts = [J.dynamic_on_static(pts, tiles, 2000, r).select(*PID, F.lit(n).alias("fate")) for r, n in ((False, "kept"), (True, "rejected"))]
    return parts[0].unionByName(parts[1])


def _info_cells(spark, sf):
    cells = A.ndt_cells(view(spark, sf, "points"), 1000, scale=1e-3, clamp=False).filter("n >= 6")
    return geom.add_sym3_inverse(cells, [F.col(c) for c in SYM], A.INFO_NAMES)


D1, D2 = J.ndt_constants(1.0)


@register(
    "j17_ndt_score",
    f"""WITH m AS (SELECT vx, vy, vz, mx, my, mz, {", ".join(f"({c} * 1e-6 + {1 if c in ('cxx', 'cyy', 'czz') else 0}e0) / n * (n - 1) / n AS {c}" for c in SYM)} FROM {moments_sql("points", 1000, "round")} WHERE n >= 6),
      c AS (SELECT vx, vy, vz, mx, my, mz, {", ".join(f"{e} AS {n}" for n, e in zip(A.INFO_NAMES, sql_inverse(SYM)))} FROM m),
      o AS (SELECT i, j, k FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), (SELECT unnest([-1,0,1]) AS k) WHERE abs(i)+abs(j)+abs(k) <= 1),
      w AS (SELECT run_id, scan_id, x_mm + (scan_id % 5)*40 AS x, y_mm - (scan_id % 3)*30 AS y, z_mm AS z FROM points),
      p AS (SELECT *, CAST(round(x/1000e0) AS BIGINT) + i AS vx, CAST(round(y/1000e0) AS BIGINT) + j AS vy, CAST(round(z/1000e0) AS BIGINT) + k AS vz FROM w, o),
      u AS (SELECT run_id, scan_id, x*0.001e0 - mx AS ux, y*0.001e0 - my AS uy, z*0.001e0 - mz AS uz, c.* FROM p JOIN c USING (vx, vy, vz)),
      e AS (SELECT run_id, scan_id, exp((ux*(ixx*ux + ixy*uy + ixz*uz) + uy*(ixy*ux + iyy*uy + iyz*uz) + uz*(ixz*ux + iyz*uy + izz*uz)) * {-D2 / 2!r}) AS e FROM u),
      t AS (SELECT run_id, scan_id, sum(CASE WHEN e * {D2!r} BETWEEN 0 AND 1 THEN e * {-D1!r} END) AS s FROM e GROUP BY ALL)
    SELECT n.run_id, n.scan_id, n.n_points, {q6("coalesce(s, 0e0)/n.n_points")} AS score FROM (SELECT run_id, scan_id, count(*) AS n_points FROM points GROUP BY ALL) n LEFT JOIN t ON n.run_id = t.run_id AND n.scan_id = t.scan_id""",
)
def _(spark, sf):
    pts = view(spark, sf, "points").select(*PID, "x", "y", "z")
    one, zero = F.lit(1.0), F.lit(0.0)
    poses = fixtures.view(spark, sf, "scans").select(
        "run_id", "scan_id", ((F.col("scan_id") % 5) * 40).alias("tx"), ((F.col("scan_id") % 3) * -30).alias("ty"), F.lit(0).alias("tz"),
        one.alias("qw"), zero.alias("qx"), zero.alias("qy"), zero.alias("qz"),
    )
    out = J.ndt_score(pts, poses, _info_cells(spark, sf), 1000, ["run_id", "scan_id"], metre_res=1.0, scale=1e-3)
    return out.select("run_id", "scan_id", "n_points", r6("score").alias("score"))


def plane_sql() -> str:
    """CTE ``pl``: plane per query from CTE ``n``, in the operation order of the library."""
    s = [f"(s{i}{j} * 1e-6)" for i, j in A.SYM3]
    inv = sql_inverse(s)
    rows = [(0, 1, 2), (1, 3, 4), (2, 4, 5)]
    sol = [" + ".join(f"{inv[i]}*(b{k} * 0.001e0)" for k, i in enumerate(r)) for r in rows]
    c = ("nx", "ny", "nz")
    sums = ", ".join(f"CAST(sum({c[i]}*{c[j]}) AS DOUBLE) AS s{i}{j}" for i, j in A.SYM3)
    det = "(" + "{0}*({3}*{5} - {4}*{4}) - {1}*({1}*{5} - {4}*{2}) + {2}*({1}*{4} - {3}*{2})".format(*s) + ")"
    return f"""a AS (SELECT scan_id, idx, count(*) AS n, {sums}, {", ".join(f"CAST(sum(-{v}) AS DOUBLE) AS b{i}" for i, v in enumerate(c))} FROM n GROUP BY ALL),
      w AS (SELECT scan_id, idx, n, {sol[0]} AS w0, {sol[1]} AS w1, {sol[2]} AS w2 FROM a WHERE n >= 3 AND {det} <> 0),
      pn AS (SELECT *, 1.0e0 / sqrt(w0*w0 + w1*w1 + w2*w2) AS k FROM w),
      pf AS (SELECT scan_id, idx, n, w0*k AS pa, w1*k AS pb, w2*k AS pc, k AS pd FROM pn),
      pl AS (SELECT pf.*, md FROM pf JOIN (SELECT n.scan_id, n.idx, max(abs(pa*(nx*0.001e0) + pb*(ny*0.001e0) + pc*(nz*0.001e0) + pd)) AS md FROM n JOIN pf ON n.scan_id = pf.scan_id AND n.idx = pf.idx GROUP BY ALL) m ON pf.scan_id = m.scan_id AND pf.idx = m.idx WHERE md <= 0.1e0)"""


@register(
    "a21_plane_fit",
    f"""WITH {knn_sql(5)}, {plane_sql()} SELECT scan_id, idx, n, {q6("pa")} AS pa, {q6("pb")} AS pb, {q6("pc")} AS pc, {q6("pd")} AS pd FROM pl""",
)
def _(spark, sf):
    out = A.plane_fit(five_nearest(view(spark, sf, "points")), ["scan_id", "idx"], 0.1, 1e-3)
    return out.select("scan_id", "idx", "n", *(r6(c).alias(c) for c in ("pa", "pb", "pc", "pd")))


@register(
    "j18_point_to_plane",
    f"""WITH {knn_sql(5)}, {plane_sql()},
      r AS (SELECT p.scan_id, p.idx, pa*(x_mm*0.001e0) + pb*(y_mm*0.001e0) + pc*(z_mm*0.001e0) + pd AS residual, sqrt(x_mm*x_mm + y_mm*y_mm + z_mm*z_mm)*0.001e0 AS reach FROM points p JOIN pl ON p.scan_id = pl.scan_id AND p.idx = pl.idx)
    SELECT scan_id, idx, {q6("residual")} AS residual FROM r WHERE reach > 81e0*residual*residual""",
)
def _(spark, sf):
    pts = view(spark, sf, "points")
    out = J.point_to_plane(pts, pts, five_nearest(pts), ["scan_id", "idx"], 0.1, 1e-3)
    return out.select("scan_id", "idx", r6("residual").alias("residual"))


@register(
    "t5_admit_points",
    f"""WITH {knn_sql(5)}, c AS (SELECT scan_id, idx, x_mm, y_mm, z_mm, {", ".join(f"(floor({a}_mm/500e0)+0.5e0)*500e0 AS c{a}" for a in "xyz")} FROM points),
      v AS (SELECT c.scan_id, c.idx, count(rank) AS n, bool_or(rank = 1 AND abs(nx-cx) > 250 AND abs(ny-cy) > 250 AND abs(nz-cz) > 250) AS outside,
        bool_or((nx-cx)*(nx-cx) + (ny-cy)*(ny-cy) + (nz-cz)*(nz-cz) < (x_mm-cx)*(x_mm-cx) + (y_mm-cy)*(y_mm-cy) + (z_mm-cz)*(z_mm-cz) + 1) AS closer FROM c LEFT JOIN n ON c.scan_id = n.scan_id AND c.idx = n.idx GROUP BY ALL)
    SELECT scan_id, idx FROM v WHERE n = 0 OR outside OR n < 5 OR NOT closer""",
)
def _(spark, sf):
    pts = view(spark, sf, "points")
    return T.admit_points(pts, five_nearest(pts), ["scan_id", "idx"], 500.0, 1.0).select("scan_id", "idx")


GLOBAL_MAP = f"""WITH t AS (SELECT run_id, kf_id, avg(x_mm) AS x, avg(y_mm) AS y, avg(z_mm) AS z FROM kf_points GROUP BY run_id, kf_id, floor(x_mm/1000e0), floor(y_mm/1000e0), floor(z_mm/1000e0)),
      k AS (SELECT run_id, kf_id, x_mm, y_mm, z_mm, sqrt((1 + r00)/2e0) AS qw, sqrt((1 - r00)/2e0)*CASE WHEN r10 < 0 THEN -1e0 ELSE 1e0 END AS qz FROM keyframes),
      u AS (SELECT t.run_id, t.x, t.y, t.z, x_mm, y_mm, z_mm, qw, qz, (0e0*z - qz*y)*2e0 AS ux, (qz*x - 0e0*z)*2e0 AS uy FROM t JOIN k ON t.run_id = k.run_id AND t.kf_id = k.kf_id),
      w AS (SELECT run_id, x + ux*qw + (0e0 - qz*uy) + x_mm AS x, y + uy*qw + (qz*ux - 0e0) + y_mm AS y, z + z_mm AS z FROM u)
    SELECT run_id, vx, vy, vz, {q6("avg(x)/1000e0 + 1e-8")} AS x, {q6("avg(y)/1000e0 + 1e-8")} AS y, {q6("avg(z)/1000e0 + 1e-8")} AS z, count(*) AS n
    FROM (SELECT *, CAST(floor(x/1000e0) AS BIGINT) AS vx, CAST(floor(y/1000e0) AS BIGINT) AS vy, CAST(floor(z/1000e0) AS BIGINT) AS vz FROM w) GROUP BY run_id, vx, vy, vz"""


@register("j19_global_map", GLOBAL_MAP)
def _(spark, sf):
    out = J.global_map(view(spark, sf, "kf_points"), keyframe_poses(spark, sf, metres=False), 1000)
    return out.select("run_id", *V, *(r6(F.col(c) / 1000.0 + 1e-8).alias(c) for c in "xyz"), "n")
