"""Sources and sinks: every query writes and reads data derived from the whole tables."""

from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.catalog.joins_q import GLOBAL_MAP, V
from scanfleet.catalog.registry import keyframe_poses, q6, r6, register, view
from scanfleet.functions import geom
from scanfleet.operators import joins as J
from scanfleet.operators.ordered import Carry, running
from scanfleet.session import scratch_path
from scanfleet.sources import exports, messages, text, tiles

# Example routing table of one dataset.
ROUTES = [("fleet", "lidar", "/click"), ("fleet", "imu", "/view"), ("fleet", "rtk", "/purchase"), ("other", "imu", "/signup")]


def typed_messages(spark, sf):
    return fixtures.view(spark, sf, "messages").withColumn("type", F.concat(F.lit("msg_"), (F.col("seq") % 3).cast("string")))


@register(
    "s1_merge_logs",
    """WITH m AS (SELECT *, 'msg_' || (seq % 3) AS type, (log_id + 1) % 3 AS new_id FROM messages)
    SELECT topic, min_by(type, (new_id, t_ns, seq)) AS type, count(*) AS messages, min(new_id) AS first_log FROM m GROUP BY topic""",
)
def _(spark, sf):
    msgs = typed_messages(spark, sf)
    logs = [msgs.filter(F.col("log_id") == i).drop("log_id") for i in (2, 0, 1)]
    merged = messages.merge_logs(logs)
    first = merged.groupBy("topic").agg(F.min("log_id").alias("first_log"))
    return messages.topic_catalogue(merged).join(first, "topic")


@register("s2_discover_logs")
def _(spark, sf):
    return messages.discover_logs(spark, sf, "*.parquet")


@register(
    "s3_route_topics",
    """SELECT log_id, seq, topic, CASE topic WHEN '/click' THEN 'lidar' WHEN '/view' THEN 'imu' ELSE 'rtk' END AS role FROM messages WHERE topic IN ('/click', '/view', '/purchase')""",
)
def _(spark, sf):
    return messages.route_topics(fixtures.view(spark, sf, "messages"), ROUTES, "fleet").select("log_id", "seq", "topic", "role")


@register(
    "s4_decode_imu",
    "SELECT vehicle_id, t_us/1e6 AS t, gx_mrad/1000e0 AS gx, gy_mrad/1000e0 AS gy, gz_mrad/1000e0 AS gz, ax_mms2/1000e0 AS ax, ay_mms2/1000e0 AS ay, az_mms2/1000e0 AS az FROM imu",
)
def _(spark, sf):
    imu = fixtures.view(spark, sf, "imu")
    imu = running(imu, ["vehicle_id"], ["t_us", "imu_id"], 86_400_000_000, [Carry("i", "count")])
    rows = imu.select(
        "vehicle_id", (F.col("i") - 1).alias("i"), (F.col("t_us") / 1e6).alias("t"),
        *((F.col(f"{a}_mrad") / 1000.0).alias(a) for a in ("gx", "gy", "gz")), *((F.col(f"{a}_mms2") / 1000.0).alias(a) for a in ("ax", "ay", "az")),
    )
    packed = messages.encode_records(rows, messages.IMU_LAYOUT, ["vehicle_id"], "i", 64).drop("part")
    return messages.decode_imu(packed)


@register(
    "s5_decode_points",
    "SELECT run_id, scan_id, idx, CAST(x_mm AS DOUBLE) AS x, CAST(y_mm AS DOUBLE) AS y, CAST(z_mm AS DOUBLE) AS z, CAST(intensity AS DOUBLE) AS intensity, idx*150e0 AS time, CAST(ring AS INTEGER) AS ring FROM points",
)
def _(spark, sf):
    pts = view(spark, sf, "points").withColumn("time", F.col("idx") * 150.0)
    packed = messages.encode_records(pts, messages.POINT_LAYOUTS["velodyne"], ["run_id", "scan_id"], "idx", 100)
    out = messages.decode_points(packed, "velodyne")
    return out.select("run_id", "scan_id", (F.col("part") * 100 + F.col("idx")).alias("idx"), "x", "y", "z", "intensity", "time", "ring")


TILED = """(SELECT *, CAST(floor(x/20000e0 + 0.5e0) AS BIGINT) AS gx, CAST(floor(y/20000e0 + 0.5e0) AS BIGINT) AS gy FROM
      (SELECT run_id, kf_id, x_mm AS x, y_mm AS y, z_mm AS z FROM keyframes))"""
THINNED = f"(SELECT gx, gy, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM {TILED} GROUP BY gx, gy, floor(x/400e0), floor(y/400e0), floor(z/400e0))"


def _tile_map(spark, sf):
    return tiles.write_tile_map(view(spark, sf, "keyframes"), scratch_path(spark, "tiles"), 400, 20_000)


@register("s7_write_tile_map", f"SELECT gx, gy, count(*) AS n_points FROM {THINNED} GROUP BY gx, gy")
def _(spark, sf):
    return spark.read.parquet(f"{_tile_map(spark, sf)}/manifest")


@register("s6_read_tile_map", f"SELECT gx, gy, x, y, z, n FROM {THINNED} WHERE (gx, gy) IN ((0, 0), (1, 0), (5, 3))")
def _(spark, sf):
    out = tiles.read_tile_map(spark, _tile_map(spark, sf), [(0, 0), (1, 0), (5, 3)])
    return out.select(F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"), "x", "y", "z", "n")


@register(
    "s8_write_dynamic_layer",
    f"""WITH t AS (SELECT * FROM {TILED}), u AS (SELECT DISTINCT gx, gy FROM t WHERE run_id >= 8 AND gx <= 2)
    SELECT gx, gy, run_id, kf_id FROM t WHERE run_id >= 8 AND gx <= 2 UNION ALL SELECT gx, gy, run_id, kf_id FROM t ANTI JOIN u USING (gx, gy) WHERE run_id < 8""",
)
def _(spark, sf):
    kf = view(spark, sf, "keyframes").select("run_id", "kf_id", "x", "y", "z")
    path = scratch_path(spark, "dynamic")
    tiles.write_dynamic_layer(kf.filter("run_id < 8"), path, 20_000)
    # A second batch replaces the tiles it touches and leaves the others.
    tiles.write_dynamic_layer(kf.filter("run_id >= 8 AND floor(x / 20000D + 0.5D) <= 2"), path, 20_000)
    out = spark.read.parquet(path)
    return out.select(F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"), "run_id", "kf_id")


@register("s9_read_dynamic_areas", "SELECT area_id, CAST(k AS BIGINT) AS k, x_mm - 100e0 AS x, y_mm + 50e0 AS y FROM dyn_areas")
def _(spark, sf):
    path = scratch_path(spark, "areas")
    rows = fixtures.view(spark, sf, "dyn_areas").orderBy("area_id", "k")
    rows.select(F.concat_ws(" ", "area_id", "x_mm", "y_mm").alias("value")).write.text(path)
    out = tiles.read_dynamic_areas(spark, path, (100.0, -50.0), together=True)
    return out.select("area_id", F.posexplode("ring").alias("k", "p")).select("area_id", F.col("k").cast("bigint").alias("k"), "p.x", "p.y")


def _graph_text(spark, sf):
    v = keyframe_poses(spark, sf).withColumn("v_id", F.col("run_id") * 1000000 + F.col("kf_id"))
    e = fixtures.view(spark, sf, "graph_edges").select(
        "v0", "v1", *((F.col(f"m{c}_mm") / 1000.0).alias(f"t{c}") for c in "xyz"), F.lit(1.0).alias("qw"), *(F.lit(0.0).alias(f"q{c}") for c in "xyz"),
        F.array(*(((F.col("v0") % 7 + min(i, j) * 6 + max(i, j)) * (0.25 if i >= 3 and j >= 3 else 1.0)).cast("double") for i in range(6) for j in range(6))).alias("info"),
    )
    return text.write_graph_text(v, e, scratch_path(spark, "graph"))


@register(
    "s10_read_graph_text",
    """SELECT v0, v1, mx_mm/1000e0 AS tx, my_mm/1000e0 AS ty, mz_mm/1000e0 AS tz, v0 % 7 + 1e0 AS i01, v0 % 7 + 1e0 AS i10, (v0 % 7 + 3*6 + 5)*0.25e0 AS i35, v0 % 7 + 2*6 + 4e0 AS i42 FROM graph_edges""",
)
def _(spark, sf):
    _, e = text.read_graph_text(spark, _graph_text(spark, sf))
    info = lambda i, j: F.col("info")[i * 6 + j].alias(f"i{i}{j}")
    return e.select("v0", "v1", "tx", "ty", "tz", info(0, 1), info(1, 0), info(3, 5), info(4, 2))


@register(
    "s11_write_graph_text",
    f"""SELECT run_id*1000000 + kf_id AS v_id, x_mm/1000e0 AS tx, y_mm/1000e0 AS ty, z_mm/1000e0 AS tz, {q6("sqrt((1 + r00)/2e0)")} AS qw, {q6("sqrt((1 - r00)/2e0)*CASE WHEN r10 < 0 THEN -1e0 ELSE 1e0 END")} AS qz FROM keyframes""",
)
def _(spark, sf):
    v, _ = text.read_graph_text(spark, _graph_text(spark, sf))
    return v.select("v_id", "tx", "ty", "tz", r6("qw").alias("qw"), r6("qz").alias("qz"))


@register(
    "s12_read_bal",
    """SELECT 'obs' AS section, o.cam_id AS a, dense_pt AS b, CAST(u AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y FROM bal_obs o JOIN (SELECT pt_id, row_number() OVER (ORDER BY pt_id) - 1 AS dense_pt FROM bal_points) p ON o.pt_id = p.pt_id
    UNION ALL SELECT 'cam', cam_id, NULL, tx_mm/1000e0, CAST(f AS DOUBLE) FROM bal_cams
    UNION ALL SELECT 'pt', row_number() OVER (ORDER BY pt_id) - 1, NULL, x_mm/1000e0, y_mm/1000e0 FROM bal_points""",
)
def _(spark, sf):
    zero = F.lit(0.0)
    cams = fixtures.view(spark, sf, "bal_cams").select(
        "cam_id", zero.alias("rx"), zero.alias("ry"), zero.alias("rz"), (F.col("tx_mm") / 1000.0).alias("tx"), zero.alias("ty"), zero.alias("tz"),
        F.col("f").cast("double").alias("f"), (F.col("k1_e4") / 1e4).alias("k1"), (F.col("k2_e6") / 1e6).alias("k2"),
    )
    # Part keys already count from 0 without gaps.
    pts = fixtures.view(spark, sf, "bal_points").select("pt_id", *((F.col(f"{c}_mm") / 1000.0).alias(c) for c in "xyz"))
    path = text.write_bal(fixtures.view(spark, sf, "bal_obs"), cams, pts, scratch_path(spark, "bal"))
    obs, cams, pts = text.read_bal(spark, path, together=True)
    none = F.lit(None).cast("bigint")
    return (
        obs.select(F.lit("obs").alias("section"), F.col("cam_id").alias("a"), F.col("pt_id").alias("b"), F.col("u").alias("x"), F.col("v").alias("y"))
        .unionByName(cams.select(F.lit("cam").alias("section"), F.col("cam_id").alias("a"), none.alias("b"), F.col("tx").alias("x"), F.col("f").alias("y")))
        .unionByName(pts.select(F.lit("pt").alias("section"), F.col("pt_id").alias("a"), none.alias("b"), "x", "y"))
    )


@register("s13_export_global_map", GLOBAL_MAP)
def _(spark, sf):
    path = exports.export_global_map(view(spark, sf, "kf_points"), keyframe_poses(spark, sf, metres=False), 1000, scratch_path(spark, "global"))
    out = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("bigint"))
    return out.select("run_id", *V, *(r6(F.col(c) / 1000.0 + 1e-8).alias(c) for c in "xyz"), "n")


@register(
    "s15_latest_pose",
    "SELECT vehicle_id, t_us, seq, x_mm, y_mm FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, seq DESC) AS k FROM loc_results) WHERE k = 1",
)
def _(spark, sf):
    return exports.latest_pose(fixtures.view(spark, sf, "loc_results"), ["vehicle_id"], ["t_us", "seq"], ["x_mm", "y_mm"])


@register(
    "s16_timings_wide",
    f"SELECT seq, {', '.join(f'max(ms) FILTER (name = {chr(39)}{n}{chr(39)}) AS {n}' for n in ('click', 'error', 'purchase', 'signup', 'view'))} FROM timings GROUP BY seq",
)
def _(spark, sf):
    return exports.timings_wide(fixtures.view(spark, sf, "timings"), ["click", "error", "purchase", "signup", "view"])
