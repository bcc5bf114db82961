"""Point filters, normalisation and per-point geometry."""

from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.catalog.registry import keyframe_poses, q6, r6, register, view
from scanfleet.operators import points as P

COLS = ["run_id", "scan_id", "idx"]
M = "x_mm/1000e0 AS x, y_mm/1000e0 AS y, z_mm/1000e0 AS z"


@register(
    "p1_normalize_velodyne",
    f"""
    WITH v AS (SELECT run_id, scan_id, idx, ring, time_us, {M},
          atan2(y_mm/1000e0, x_mm/1000e0) * 57.2957e0 AS yaw FROM points_velodyne),
      g AS (SELECT run_id AS gr, scan_id AS gs, max_by(time_us, idx) > 0 AS given FROM v GROUP BY 1, 2),
      f AS (SELECT v.*, given, first_value(yaw) OVER w AS fp, row_number() OVER w AS rn
            FROM v JOIN g ON run_id = gr AND scan_id = gs WINDOW w AS (PARTITION BY run_id, scan_id, ring ORDER BY idx)),
      r AS (SELECT *, (fp - yaw + CASE WHEN yaw > fp THEN 360e0 ELSE 0e0 END) / 3.61e0 AS raw FROM f),
      b AS (SELECT *, CASE WHEN raw < lag(raw) OVER w THEN 1 ELSE 0 END AS brk FROM r
            WINDOW w AS (PARTITION BY run_id, scan_id, ring ORDER BY idx)),
      t AS (SELECT *, max(brk) OVER (PARTITION BY run_id, scan_id, ring ORDER BY idx ROWS UNBOUNDED PRECEDING) AS turned FROM b)
    SELECT run_id, scan_id, idx, {q6("CASE WHEN given THEN time_us * 0.001e0 ELSE raw + CASE WHEN turned = 1 THEN 360e0/3.61e0 ELSE 0e0 END END")} AS t_off_ms
    FROM t WHERE (given OR rn > 1) AND idx % 2 = 0 AND x*x + y*y + z*z > 4.0e0""",
)
def _(spark, sf):
    pts = view(spark, sf, "points_velodyne", metres=True).withColumnRenamed("time_us", "time")
    return P.normalize_velodyne(pts, 2, 2.0, 0.001).select(*COLS, r6("t_off_ms").alias("t_off_ms"))


@register(
    "p2_normalize_ouster",
    f"""SELECT run_id, scan_id, idx, t_ns / 1e6 AS t_off_ms FROM (SELECT *, {M} FROM points_ouster)
    WHERE idx % 3 = 0 AND x*x + y*y + z*z >= 16e0""",
)
def _(spark, sf):
    return P.normalize_ouster(view(spark, sf, "points_ouster", metres=True), 3, 4.0).select(*COLS, "t_off_ms")


@register(
    "p3_normalize_livox",
    f"""
    WITH u AS (SELECT *, {M}, idx >= 1 AND line < 6 AND (tag & 48) IN (16, 0) AND idx % 1 = 0 AS used FROM points_livox),
      s AS (SELECT *, CASE WHEN used THEN x ELSE 0e0 END AS sx, CASE WHEN used THEN y ELSE 0e0 END AS sy,
              CASE WHEN used THEN z ELSE 0e0 END AS sz FROM u),
      l AS (SELECT *, lag(sx) OVER w AS px, lag(sy) OVER w AS py, lag(sz) OVER w AS pz FROM s
            WINDOW w AS (PARTITION BY run_id, scan_id ORDER BY idx))
    SELECT run_id, scan_id, idx, offset_time / 1e6 AS t_off_ms FROM l
    WHERE used AND (abs(x - px) > 1e-7 OR abs(y - py) > 1e-7 OR (abs(z - pz) > 1e-7 AND x*x + y*y + z*z > 4e0))""",
)
def _(spark, sf):
    return P.normalize_livox(view(spark, sf, "points_livox", metres=True), 1, 2.0, 6).select(*COLS, "t_off_ms")


@register("p4_remove_ground", "SELECT run_id, scan_id, idx FROM points WHERE z_mm / 1000e0 > -1.0e0")
def _(spark, sf):
    return P.remove_ground(view(spark, sf, "points", metres=True), -1.0).select(*COLS)


@register("p5_pass_through", "SELECT run_id, scan_id, idx FROM points WHERE z_mm / 1000e0 BETWEEN 0.5e0 AND 30e0")
def _(spark, sf):
    return P.pass_through(view(spark, sf, "points", metres=True), "z", 0.5, 30.0).select(*COLS)


@register(
    "p6_usable_range",
    f"""SELECT run_id, scan_id, idx FROM (SELECT *, {M} FROM points)
    WHERE sqrt(x*x + y*y) <= 8e0 AND sqrt(x*x + y*y + z*z) > 0.01e0 AND sqrt(x*x + y*y + z*z) <= 8e0""",
)
def _(spark, sf):
    planar = P.usable_range(view(spark, sf, "points", metres=True), 8.0, 2)
    return P.usable_range(planar, 8.0, 3).select(*COLS)


@register(
    "p7_min_points",
    """SELECT run_id, scan_id, idx FROM points
    WHERE (run_id, scan_id) IN (SELECT (run_id, scan_id) FROM points GROUP BY run_id, scan_id HAVING count(*) >= 600)""",
)
def _(spark, sf):
    return P.min_points(view(spark, sf, "points"), 600).select(*COLS)


@register(
    "p8_stride_scans",
    """SELECT run_id, scan_id, which FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY scan_id) AS k FROM scans),
    (VALUES ('first', 1), ('nth', 0)) v(which, rest) WHERE k % 4 = rest""",
)
def _(spark, sf):
    scans = fixtures.view(spark, sf, "scans")
    parts = [
        P.stride_scans(scans, 4, phase).select("run_id", "scan_id", F.lit(phase).alias("which"))
        for phase in ("first", "nth")
    ]
    return parts[0].unionByName(parts[1])


ARRIVAL = "(seq * 7919) % 100003"


@register(
    "p9_drop_rollback",
    f"""SELECT log_id, seq, t_ns FROM (SELECT *, max(t_ns) OVER (PARTITION BY log_id ORDER BY {ARRIVAL}, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM messages) WHERE top IS NULL OR t_ns >= top""",
)
def _(spark, sf):
    msgs = fixtures.view(spark, sf, "messages").withColumn("arrival", F.expr(ARRIVAL))
    return P.drop_rollback(msgs, ["log_id"], ["arrival", "seq"], "t_ns", 20_000).select("log_id", "seq", "t_ns")


@register(
    "p10_split_on_rollback",
    f"""WITH a AS (SELECT *, {ARRIVAL} AS arrival FROM messages),
      b AS (SELECT *, CASE WHEN t_ns < lag(t_ns) OVER (PARTITION BY log_id ORDER BY arrival, seq) THEN 1 ELSE 0 END AS back FROM a)
    SELECT log_id, seq, CAST(sum(back) OVER (PARTITION BY log_id ORDER BY arrival, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM b""",
)
def _(spark, sf):
    msgs = fixtures.view(spark, sf, "messages").withColumn("arrival", F.expr(ARRIVAL))
    out = P.split_on_rollback(msgs, ["log_id"], ["arrival", "seq"], "t_ns", 20_000)
    return out.select("log_id", "seq", "segment_id")


@register(
    "p11_transform_points",
    f"""SELECT p.run_id, p.kf_id, p.idx, {q6("(k.x_mm + k.r00*p.x_mm - k.r10*p.y_mm)/1000e0")} AS x,
      {q6("(k.y_mm + k.r10*p.x_mm + k.r00*p.y_mm)/1000e0")} AS y, {q6("(k.z_mm + p.z_mm)/1000e0")} AS z
    FROM kf_points p JOIN keyframes k ON p.run_id = k.run_id AND p.kf_id = k.kf_id""",
)
def _(spark, sf):
    out = P.transform_points(
        view(spark, sf, "kf_points", metres=True), keyframe_poses(spark, sf), ["run_id", "kf_id"]
    )
    return out.select("run_id", "kf_id", "idx", *(r6(c).alias(c) for c in "xyz"))


@register(
    "p12_height_above_floor",
    f"SELECT run_id, scan_id, idx, {q6('z_mm/1000e0 + 1.25e0')} AS h FROM points",
)
def _(spark, sf):
    pts = P.height_above_floor(view(spark, sf, "points", metres=True), (0, 0, 1, 1.25))
    return pts.select(*COLS, r6("h").alias("h"))


@register(
    "p13_azimuth_bin",
    f"""SELECT run_id, scan_id, idx, (CAST(round(atan2(y_mm/1000e0, x_mm/1000e0) * (180e0/3.141592653589793e0)) AS BIGINT) + 360) % 360 AS azimuth,
      {q6("sqrt((x_mm/1000e0)*(x_mm/1000e0) + (y_mm/1000e0)*(y_mm/1000e0))")} AS dist FROM points""",
)
def _(spark, sf):
    pts = P.azimuth_bin(view(spark, sf, "points", metres=True))
    return pts.select(*COLS, "azimuth", r6("dist").alias("dist"))


@register(
    "w1_velodyne_offsets",
    f"""
    WITH v AS (SELECT run_id, scan_id, idx, ring, atan2(y_mm/1000e0, x_mm/1000e0) * 57.2957e0 AS yaw FROM points_velodyne),
      f AS (SELECT *, first_value(yaw) OVER w AS fp, row_number() OVER w AS rn FROM v WINDOW w AS (PARTITION BY run_id, scan_id, ring ORDER BY idx)),
      r AS (SELECT *, (fp - yaw + CASE WHEN yaw > fp THEN 360e0 ELSE 0e0 END) / 3.61e0 AS raw FROM f),
      b AS (SELECT *, CASE WHEN raw < lag(raw) OVER w THEN 1 ELSE 0 END AS brk FROM r
            WINDOW w AS (PARTITION BY run_id, scan_id, ring ORDER BY idx)),
      t AS (SELECT *, max(brk) OVER (PARTITION BY run_id, scan_id, ring ORDER BY idx ROWS UNBOUNDED PRECEDING) AS turned FROM b)
    SELECT run_id, scan_id, idx, {q6("raw + CASE WHEN turned = 1 THEN 360e0/3.61e0 ELSE 0e0 END")} AS t_off_ms, rn = 1 AS ring_first FROM t""",
)
def _(spark, sf):
    out = P.velodyne_offsets(view(spark, sf, "points_velodyne", metres=True))
    return out.select(*COLS, r6("t_off_ms").alias("t_off_ms"), "ring_first")
