"""Geometry functions, robust kernels and graph residuals."""

import math

from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.catalog.aggregate_q import SYM, moments_sql
from scanfleet.catalog.registry import keyframe_poses, q6, r6, register, view
from scanfleet.functions import geom, kernels
from scanfleet.operators import aggregate as A
from scanfleet.operators import graph as G

PID = ["run_id", "scan_id", "idx"]
ID = ", ".join(PID)
KF = ["run_id", "kf_id"]


def pts(spark, sf):
    return view(spark, sf, "points").select(*PID, "x", "y", "z")


def quats(spark, sf):
    q = geom.quat_normalize(geom.Quat(F.lit(5000.0), F.col("x"), F.col("y"), F.col("z")))
    return pts(spark, sf).select(*PID, *(c.alias(f"q{n}") for c, n in zip(q, "wxyz")))


QUAT = f"(SELECT {ID}, 5000/n AS w, x_mm/n AS x, y_mm/n AS y, z_mm/n AS z FROM (SELECT *, sqrt(25000000 + x_mm*x_mm + y_mm*y_mm + z_mm*z_mm) AS n FROM points))"


@register(
    "g1_quaternions",
    f"""SELECT {ID}, {q6("w*w+x*x-y*y-z*z")} AS m00, {q6("2*(x*y-w*z)")} AS m01, {q6("2*(x*z+w*y)")} AS m02, {q6("2*(x*y+w*z)")} AS m10, {q6("w*w-x*x+y*y-z*z")} AS m11, {q6("2*(y*z-w*x)")} AS m12,
      {q6("2*(x*z-w*y)")} AS m20, {q6("2*(y*z+w*x)")} AS m21, {q6("w*w-x*x-y*y+z*z")} AS m22, {q6("w*w-x*x-y*y-z*z")} AS sw, {q6("2*w*x")} AS sx,
      {q6("abs(w)")} AS bw, {q6("abs(x)")} AS bx FROM {QUAT}""",
)
def _(spark, sf):
    q = geom.Quat(*(F.col(f"q{n}") for n in "wxyz"))
    df = quats(spark, sf)
    m = geom.quat_to_matrix(q)
    df = df.withColumns({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    back = geom.matrix_to_quat([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    square = geom.quat_mul(q, q)
    return df.select(
        *PID, *(r6(f"m{i}{j}").alias(f"m{i}{j}") for i in range(3) for j in range(3)), r6(square.w).alias("sw"), r6(square.x).alias("sx"),
        r6(F.abs(back.w)).alias("bw"), r6(F.abs(back.x)).alias("bx"),
    )


@register(
    "g2_so3_exp_log",
    f"""WITH w AS (SELECT {ID}, x_mm/5000e0 AS x, y_mm/5000e0 AS y, z_mm/5000e0 AS z, sqrt(x_mm/5000e0*(x_mm/5000e0) + y_mm/5000e0*(y_mm/5000e0) + z_mm/5000e0*(z_mm/5000e0)) AS n FROM points)
    SELECT {ID}, {q6("cos(n*0.35e0)")} AS qw, {q6("sin(n*0.35e0)*x/n")} AS qx, {q6("x*0.7e0 + 1e-8")} AS lx, {q6("y*0.7e0 + 1e-8")} AS ly, {q6("z*0.7e0 + 1e-8")} AS lz FROM w""",
)
def _(spark, sf):
    w = geom.Vec(*(F.col(c) / 5000.0 for c in "xyz"))
    df = pts(spark, sf).withColumns(dict(zip(("qw", "qx", "qy", "qz"), geom.so3_exp(w, 0.7))))
    m = geom.quat_to_matrix(geom.Quat(*(F.col(f"q{n}") for n in "wxyz")))
    df = df.withColumns({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    log = geom.so3_log([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return df.select(*PID, r6("qw").alias("qw"), r6("qx").alias("qx"), *(r6(c + 1e-8).alias(f"l{n}") for c, n in zip(log, "xyz")))


@register(
    "g3_rpy",
    f"SELECT {ID}, {q6('x_mm*0.00029e0 + 1e-8')} AS roll, {q6('y_mm*0.00014e0 + 1e-8')} AS pitch, {q6('z_mm*0.0005e0 + 1e-8')} AS yaw FROM points",
)
def _(spark, sf):
    p = geom.pose_from_rpy(geom.Vec.of("x", "y", "z"), F.col("x") * 0.00029, F.col("y") * 0.00014, F.col("z") * 0.0005)
    df = pts(spark, sf).select(*PID, *p.columns("p"))
    m = geom.quat_to_matrix(geom.Pose.of("p").q)
    df = df.withColumns({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    rpy = geom.rpy_from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return df.select(*PID, *(r6(c + 1e-8).alias(n) for c, n in zip(rpy, ("roll", "pitch", "yaw"))))


def fixed_pose():
    q, t = (math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)), (1.0, -2.0, 0.5)
    return geom.Pose(geom.Quat(*map(F.lit, q)), geom.Vec(*map(F.lit, t)))


@register(
    "g4_pose_algebra",
    f"""SELECT run_id, kf_id, {q6("(x_mm + 1000*r00 + 2000*r10)/1000e0")} AS cx, {q6("(y_mm + 1000*r10 - 2000*r00)/1000e0")} AS cy, {q6("(z_mm + 500)/1000e0")} AS cz,
      {q6("-(r00*x_mm + r10*y_mm)/1000e0")} AS ix, {q6("-(-r10*x_mm + r00*y_mm)/1000e0")} AS iy, {q6("(r00*(1000-x_mm) + r10*(-2000-y_mm))/1000e0")} AS bx, {q6("(-r10*(1000-x_mm) + r00*(-2000-y_mm))/1000e0")} AS b_y FROM keyframes""",
)
def _(spark, sf):
    a, fixed = geom.Pose.of(), fixed_pose()
    c, i, b = geom.pose_compose(a, fixed), geom.pose_inverse(a), geom.pose_between(a, fixed)
    cols = {"cx": c.t.x, "cy": c.t.y, "cz": c.t.z, "ix": i.t.x, "iy": i.t.y, "bx": b.t.x, "b_y": b.t.y}
    return keyframe_poses(spark, sf).select(*KF, *(r6(e).alias(n) for n, e in cols.items()))


@register(
    "g5_pose_distance",
    f"SELECT run_id, kf_id, {q6('sqrt((x_mm-1000)*(x_mm-1000) + (y_mm+2000)*(y_mm+2000) + (z_mm-500)*(z_mm-500))/1000e0')} AS dist, {q6('acos(CASE WHEN r10 = 1 THEN 1e0 WHEN r10 = -1 THEN -1e0 ELSE 0e0 END)')} AS angle FROM keyframes",
)
def _(spark, sf):
    d, a = geom.pose_distance(geom.Pose.of(), fixed_pose())
    return keyframe_poses(spark, sf).select(*KF, r6(d).alias("dist"), r6(a).alias("angle"))


@register(
    "g6_slerp",
    f"""WITH a AS (SELECT {ID}, x_mm*0.0001e0 AS a, y_mm*0.0001e0 AS b, (z_mm + 1230)/3031e0 AS s FROM points)
    SELECT {ID}, {q6("cos((a + s*(b-a))/2)")} AS qw, {q6("sin((a + s*(b-a))/2)")} AS qz FROM a""",
)
def _(spark, sf):
    def spin(angle):
        return geom.Quat(F.cos(angle / 2), F.lit(0.0), F.lit(0.0), F.sin(angle / 2))

    q = geom.slerp(spin(F.col("x") * 0.0001), spin(F.col("y") * 0.0001), (F.col("z") + 1230) / 3031.0)
    return pts(spark, sf).select(*PID, r6(q.w).alias("qw"), r6(q.z).alias("qz"))


@register(
    "g7_angles",
    f"""WITH a AS (SELECT {ID}, x_mm/1000e0 AS a FROM points)
    SELECT {ID}, {q6("CASE WHEN a BETWEEN -pi() AND pi() THEN a ELSE a - 2*pi()*round(a/(2*pi())) END")} AS wrap, {q6("CASE WHEN a > 0 AND a <= 2*pi() THEN a ELSE a - 2*pi()*(ceil(a/(2*pi())) - 1) END")} AS wrap2, {q6("radians(a)")} AS rad, {q6("degrees(a)")} AS deg, greatest(least(a, 2e0), -1e0) AS clamped FROM a""",
)
def _(spark, sf):
    a = F.col("x") / 1000.0
    cols = {"wrap": geom.wrap_pi(a), "wrap2": geom.wrap_2pi(a), "rad": geom.deg2rad(a), "deg": geom.rad2deg(a)}
    return pts(spark, sf).select(*PID, *(r6(e).alias(n) for n, e in cols.items()), geom.clamp(a, -1.0, 2.0).alias("clamped"))


@register(
    "g8_time",
    "SELECT log_id, seq, t_ns/1e9 AS sec, CAST(trunc(seq*0.37e0) AS INTEGER) AS stamp_sec, CAST(trunc((seq*0.37e0 - trunc(seq*0.37e0))*1e9) AS INTEGER) AS stamp_nsec FROM messages",
)
def _(spark, sf):
    sec, nsec = geom.sec_to_stamp(F.col("seq") * 0.37)
    return fixtures.view(spark, sf, "messages").select("log_id", "seq", geom.ns_to_sec(F.col("t_ns")).alias("sec"), sec.alias("stamp_sec"), nsec.alias("stamp_nsec"))


@register(
    "g9_force_2d",
    f"SELECT {ID}, x_mm/1000e0 AS tx, y_mm/1000e0 AS ty, 0e0 AS tz, {q6('cos(z_mm*0.00025e0)')} AS qw, {q6('sin(z_mm*0.00025e0)')} AS qz FROM points",
)
def _(spark, sf):
    t = geom.Vec(*(F.col(c) / 1000.0 for c in "xyz"))
    p = geom.pose_from_rpy(t, F.col("x") * 0.0001, F.col("y") * 0.0001, F.col("z") * 0.0005)
    f = geom.force_2d(geom.Pose.of("p"))
    df = pts(spark, sf).select(*PID, *p.columns("p"))
    return df.select(*PID, f.t.x.alias("tx"), f.t.y.alias("ty"), f.t.z.alias("tz"), r6(f.q.w).alias("qw"), r6(f.q.z).alias("qz"))


@register(
    "g10_sym3_rotate",
    f"""SELECT run_id, kf_id, {q6("r00*r00*2e0 + r10*r10*3e0 - 2*r00*r10*0.5e0")} AS cxx, {q6("r00*r10*2e0 + 0.5e0*(r00*r00 - r10*r10) - r10*r00*3e0")} AS cxy, {q6("r00*0.25e0 - r10*0.75e0")} AS cxz, {q6("1e0")} AS czz FROM keyframes""",
)
def _(spark, sf):
    cov = [F.lit(v) for v in (2.0, 0.5, 0.25, 3.0, 0.75, 1.0)]
    c = geom.sym3_rotate(cov, geom.quat_to_matrix(geom.Pose.of().q))
    return keyframe_poses(spark, sf).select(*KF, r6(c[0]).alias("cxx"), r6(c[1]).alias("cxy"), r6(c[2]).alias("cxz"), r6(c[5]).alias("czz"))


COV = f"(SELECT vx, vy, vz, {', '.join(f'{c} * 1e-6 / n AS {c}' for c in SYM)} FROM {moments_sql('points', 1000, 'round')} WHERE n >= 6)"


@register(
    "g11_sym3_eigen",
    f"""WITH c AS (SELECT *, (cxx + cyy + czz)/3 AS q FROM {COV}),
      p AS (SELECT *, sqrt(((cxx-q)*(cxx-q) + (cyy-q)*(cyy-q) + (czz-q)*(czz-q) + 2*(cxy*cxy + cxz*cxz + cyz*cyz))/6) AS p FROM c),
      r AS (SELECT *, acos(greatest(-1e0, least(1e0, ((cxx-q)*((cyy-q)*(czz-q) - cyz*cyz) - cxy*(cxy*(czz-q) - cyz*cxz) + cxz*(cxy*cyz - (cyy-q)*cxz))/(2*p*p*p))))/3 AS phi FROM p)
    SELECT vx, vy, vz, {q6("q + 2*p*cos(phi + 2*pi()/3)")} AS lo, {q6("3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3))")} AS mid, {q6("q + 2*p*cos(phi)")} AS hi FROM r""",
)
def _(spark, sf):
    m = A._moments(view(spark, sf, "points"), 1000, (), "round", 1e-3).filter("n >= 6")
    m = m.withColumns({c: F.col(c) * 1e-6 / F.col("n") for c in SYM})
    lo, mid, hi = geom.sym3_eigenvalues([F.col(c) for c in SYM])
    return m.select("vx", "vy", "vz", r6(lo).alias("lo"), r6(mid).alias("mid"), r6(hi).alias("hi"))


@register(
    "g12_s2_gravity",
    f"""WITH a AS (SELECT imu_id, ax_mms2/1000e0 AS x, ay_mms2/1000e0 AS y, az_mms2/1000e0 AS z FROM imu) SELECT imu_id, {", ".join(f"{q6(f'-9.809e0*{c}/sqrt(x*x + y*y + z*z)')} AS g{c}" for c in "xyz")} FROM a""",
)
def _(spark, sf):
    g = geom.s2_gravity(geom.Vec(*(F.col(f"a{c}_mms2") / 1000.0 for c in "xyz")))
    return fixtures.view(spark, sf, "imu").select("imu_id", *(r6(v).alias(f"g{c}") for v, c in zip(g, "xyz")))


# --- robust kernels ----------------------------------------------------------------------------

CHI = "(mx_mm*mx_mm + my_mm*my_mm + mz_mm*mz_mm) % 99991 / 1000e0"
DELTA = 3.0
KERNEL_SQL = {
    "huber": ("CASE WHEN e <= 9 THEN e ELSE 6*sqrt(e) - 9 END", "CASE WHEN e <= 9 THEN 1e0 ELSE 3/sqrt(e) END", "CASE WHEN e <= 9 THEN 0e0 ELSE -1.5e0/(e*sqrt(e)) END"),
    "cauchy": ("9*ln(1 + e/9)", "1/(1 + e/9)", "-1/(9*(1 + e/9)*(1 + e/9))"),
    "tukey": ("CASE WHEN e <= 9 THEN 3*(1 - pow(1 - e/9, 3)) ELSE 3e0 END", "CASE WHEN e <= 9 THEN pow(1 - e/9, 2) ELSE 0e0 END", "CASE WHEN e <= 9 THEN -2*(1 - e/9)/9 ELSE 0e0 END"),
    "fair": ("18*(sqrt(e)/3 - ln(1 + sqrt(e)/3))", "1/(1 + sqrt(e)/3)", "CASE WHEN e > 0 THEN -1/(6*sqrt(e)*pow(1 + sqrt(e)/3, 2)) END"),
    "dcs": ("CASE WHEN e <= 3 THEN e ELSE 36*e/pow(3 + e, 2) END", "CASE WHEN e <= 3 THEN 1e0 ELSE 36*(3 - e)/pow(3 + e, 3) END", "CASE WHEN e <= 3 THEN 0e0 ELSE -72*(6 - e)/pow(3 + e, 4) END"),
    "pseudo_huber": ("18*(sqrt(1 + e/9) - 1)", "1/sqrt(1 + e/9)", "-0.5e0/(9*pow(1 + e/9, 1.5e0))"),
    "welsch": ("9*(1 - exp(-e/9))", "exp(-e/9)", "-exp(-e/9)/9"),
    "saturated": ("least(e, 9e0)", "CASE WHEN e <= 9 THEN 1e0 ELSE 0e0 END", "0e0"),
    "geman_mcclure": ("3*e/(3 + e)", "9/pow(3 + e, 2)", "-18/pow(3 + e, 3)"),
}


def chi_edges(spark, sf):
    return fixtures.view(spark, sf, "graph_edges").withColumn("chi2", F.expr(CHI.replace("1000e0", "1000D")))


for _i, _k in enumerate(kernels.KERNELS, 1):

    def _kernel(spark, sf, kernel=_k):
        rho = kernels.robust_weight(F.col("chi2"), kernel, DELTA)
        return chi_edges(spark, sf).select("v0", "v1", *(r6(e + 1e-9).alias(f"rho{n}") for n, e in enumerate(rho)))

    _sql = ", ".join(f"{q6(f'{e} + 1e-9')} AS rho{n}" for n, e in enumerate(KERNEL_SQL[_k]))
    register(f"k{_i}_{_k}", f"SELECT v0, v1, {_sql} FROM (SELECT v0, v1, {CHI} AS e FROM graph_edges)")(_kernel)


# --- graph residuals ---------------------------------------------------------------------------


def graph(spark, sf):
    v = keyframe_poses(spark, sf).withColumn("v_id", F.col("run_id") * 1000000 + F.col("kf_id"))
    e = fixtures.view(spark, sf, "graph_edges").select(
        "run_id", "v0", "v1", "etype", "level", *((F.col(f"m{c}_mm") / 1000.0).alias(f"m_t{c}") for c in "xyz"),
        F.lit(1.0).alias("m_qw"), *(F.lit(0.0).alias(f"m_q{c}") for c in "xyz"),
    )
    return v, e


ERR = """(SELECT e.run_id, v0, v1, (a.r00*(b.x_mm-a.x_mm) + a.r10*(b.y_mm-a.y_mm) - mx_mm)/1000e0 AS e0, (-a.r10*(b.x_mm-a.x_mm) + a.r00*(b.y_mm-a.y_mm) - my_mm)/1000e0 AS e1, (b.z_mm - a.z_mm - mz_mm)/1000e0 AS e2, a.r00*b.r00 + a.r10*b.r10 AS rc
      FROM graph_edges e JOIN graph_vertices a ON v0 = a.v_id JOIN graph_vertices b ON v1 = b.v_id)"""


@register(
    "j12_edge_errors",
    f"SELECT v0, v1, {q6('e0')} AS e0, {q6('e1')} AS e1, {q6('e2')} AS e2, {q6('sqrt((1 - rc)/2e0)')} AS qz_abs, {q6('e0*e0 + e1*e1 + e2*e2 + (1 - rc)/2e0 + 1e-9')} AS chi2 FROM {ERR}",
)
def _(spark, sf):
    v, e = graph(spark, sf)
    out = G.se3_error(e, v).withColumn("chi2", G.chi2(6))
    return out.select("v0", "v1", *(r6(f"e{i}").alias(f"e{i}") for i in range(3)), r6(F.abs("e5")).alias("qz_abs"), r6(F.col("chi2") + 1e-9).alias("chi2"))


@register(
    "j12_se2_errors",
    f"""WITH e AS (SELECT v0, v1, (a.r00*(b.x_mm-a.x_mm) + a.r10*(b.y_mm-a.y_mm) - mx_mm)/1000e0 AS dx, (-a.r10*(b.x_mm-a.x_mm) + a.r00*(b.y_mm-a.y_mm) - my_mm)/1000e0 AS dy, atan2(a.r00*b.r10 - a.r10*b.r00, a.r00*b.r00 + a.r10*b.r10) - 0.1e0 AS dt
      FROM graph_edges e JOIN graph_vertices a ON v0 = a.v_id JOIN graph_vertices b ON v1 = b.v_id)
    SELECT v0, v1, {q6("cos(0.1e0)*dx + sin(0.1e0)*dy")} AS e0, {q6("cos(0.1e0)*dy - sin(0.1e0)*dx")} AS e1, {q6("CASE WHEN dt < -pi() THEN dt + 2*pi() ELSE dt END")} AS e2 FROM e""",
)
def _(spark, sf):
    v = fixtures.view(spark, sf, "graph_vertices").select("v_id", (F.col("x_mm") / 1000.0).alias("x"), (F.col("y_mm") / 1000.0).alias("y"), F.atan2("r10", "r00").alias("theta"))
    e = fixtures.view(spark, sf, "graph_edges").select("v0", "v1", (F.col("mx_mm") / 1000.0).alias("m_x"), (F.col("my_mm") / 1000.0).alias("m_y"), F.lit(0.1).alias("m_theta"))
    return G.se2_error(e, v).select("v0", "v1", *(r6(f"e{i}").alias(f"e{i}") for i in range(3)))


@register(
    "j12_prior_errors",
    f"SELECT v_id AS v0, {q6('(kf_id*2)/-1000e0')} AS e0, {q6('kf_id/1000e0')} AS e1, {q6('0.2e0')} AS e5, {q6('z_mm/1000e0 - 0.25e0')} AS height FROM (SELECT *, v_id % 1000000 AS kf_id FROM graph_vertices)",
)
def _(spark, sf):
    v, _ = graph(spark, sf)
    kf = F.col("kf_id")
    turn = geom.quat_mul(geom.Pose.of().q, geom.so3_exp(geom.Vec(F.lit(0.0), F.lit(0.0), F.lit(0.2))))
    drift = geom.Vec(F.col("tx") + kf * 0.002, F.col("ty") - kf * 0.001, F.col("tz"))
    e = v.select(F.col("v_id").alias("v0"), *geom.Pose(turn, drift).columns("m"), F.lit(0.25).alias("m_z"))
    out = G.se3_prior_error(e, v).select("v0", "e0", "e1", "e5")
    h = G.height_error(e, v).select("v0", F.col("e0").alias("height"))
    j = out.join(h, "v0")
    return j.select("v0", *(r6(c).alias(c) for c in ("e0", "e1", "e5", "height")))


@register(
    "a15_normal_equations",
    f"""SELECT run_id, CAST(sum(mx_mm*mx_mm) AS DOUBLE) AS h_0_0, CAST(sum(mx_mm*my_mm) AS DOUBLE) AS h_0_1, CAST(sum(my_mm*my_mm) AS DOUBLE) AS h_1_1, CAST(-sum(mx_mm*mz_mm) AS DOUBLE) AS b_0, CAST(-sum(my_mm*mz_mm) AS DOUBLE) AS b_1, CAST(sum(mz_mm*mz_mm) AS DOUBLE) AS cost, count(*) AS n FROM graph_edges GROUP BY run_id""",
)
def _(spark, sf):
    return A.normal_equations(fixtures.view(spark, sf, "graph_edges"), ["run_id"], ["mx_mm", "my_mm"], "mz_mm")


@register(
    "a16_total_chi2",
    f"""WITH e AS (SELECT run_id, {CHI} AS e FROM graph_edges) SELECT run_id, {q6("sum(e) + 1e-8")} AS chi2, {q6("sum(9*ln(1 + e/9)) + 1e-8")} AS robust_chi2 FROM e GROUP BY run_id""",
)
def _(spark, sf):
    e = chi_edges(spark, sf)
    both = A.total_chi2(e, ["run_id"]).join(A.total_robust_chi2(e, "cauchy", DELTA, ["run_id"]), "run_id")
    return both.select("run_id", r6(F.col("chi2") + 1e-8).alias("chi2"), r6(F.col("robust_chi2") + 1e-8).alias("robust_chi2"))


def bundle(spark, sf):
    one, zero = F.lit(1.0), F.lit(0.0)
    cams = fixtures.view(spark, sf, "bal_cams").select(
        "cam_id", (F.col("tx_mm") / 1000.0).alias("tx"), zero.alias("ty"), zero.alias("tz"), one.alias("qw"), zero.alias("qx"), zero.alias("qy"), zero.alias("qz"),
        F.col("f").cast("double").alias("f"), (F.col("k1_e4") / 1e4).alias("k1"), (F.col("k2_e6") / 1e6).alias("k2"),
    )
    pts = fixtures.view(spark, sf, "bal_points").select("pt_id", *((F.col(f"{c}_mm") / 1000.0).alias(c) for c in "xyz"))
    return fixtures.view(spark, sf, "bal_obs"), cams, pts


@register(
    "j20_bundle_residuals",
    f"""WITH p AS (SELECT o.*, f, k1_e4/1e4 AS k1, k2_e6/1e6 AS k2, -(x_mm + tx_mm)/CAST(z_mm AS DOUBLE) AS px, -y_mm/CAST(z_mm AS DOUBLE) AS py, z_mm > 10 AS behind FROM bal_obs o JOIN bal_cams c ON o.cam_id = c.cam_id JOIN bal_points q ON o.pt_id = q.pt_id),
      n AS (SELECT *, px*px + py*py AS n FROM p)
    SELECT cam_id, pt_id, {q6("f*(1 + (k1 + k2*n)*n)*px - u")} AS e0, {q6("f*(1 + (k1 + k2*n)*n)*py - v")} AS e1, behind FROM n""",
)
def _(spark, sf):
    out = G.bundle_residuals(*bundle(spark, sf))
    return out.select("cam_id", "pt_id", r6("e0").alias("e0"), r6("e1").alias("e1"), "behind")
