"""Keys and aggregations."""

from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.catalog.registry import keyframe_poses, q6, r6, register, view
from scanfleet.functions import keys
from scanfleet.operators import aggregate as A

PID = ["run_id", "scan_id", "idx"]
V = ["vx", "vy", "vz"]
SYM = A.SYM3_NAMES


def rounded(leaf: str, c: str) -> str:
    return f"CAST(round({c} / {leaf}) AS BIGINT)"


def sql_inverse(c: list[str]) -> list[str]:
    """Adjugate inverse as SQL, in the operation order of the library."""
    xx, xy, xz, yy, yz, zz = c
    det = f"({xx}*({yy}*{zz} - {yz}*{yz}) - {xy}*({xy}*{zz} - {yz}*{xz}) + {xz}*({xy}*{yz} - {yy}*{xz}))"
    return [
        f"(({yy}*{zz} - {yz}*{yz})/{det})", f"(({xz}*{yz} - {xy}*{zz})/{det})", f"(({xy}*{yz} - {xz}*{yy})/{det})",
        f"(({xx}*{zz} - {xz}*{xz})/{det})", f"(({xy}*{xz} - {xx}*{yz})/{det})", f"(({xx}*{yy} - {xy}*{xy})/{det})",
    ]


def moments_sql(table: str, leaf: int, fn: str, by: str = "") -> str:
    """Voxel moments relative to the voxel origin, as a subquery."""
    key = ", ".join(f"CAST({fn}({c}_mm / {leaf}e0) AS BIGINT) AS v{c}" for c in "xyz")
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = ", ".join(f"CAST(sum(d{a}) AS DOUBLE) AS s{a}" for a in "xyz")
    prods = ", ".join(f"CAST(sum(d{a}*d{b}) AS DOUBLE) AS p{a}{b}" for a, b in pairs)
    means = ", ".join(f"(v{a}*{leaf} + s{a}/n) * 0.001e0 AS m{a}" for a in "xyz")
    cent = ", ".join(f"p{a}{b} - s{a}*s{b}/n AS c{a}{b}" for a, b in pairs)
    offs = ", ".join(f"{a}_mm - v{a}*{leaf} AS d{a}" for a in "xyz")
    return f"""(SELECT {by} vx, vy, vz, n, {means}, {cent} FROM
      (SELECT {by} vx, vy, vz, count(*) AS n, {sums}, {prods} FROM
       (SELECT *, {offs} FROM (SELECT *, {key} FROM {table})) GROUP BY {by} vx, vy, vz))"""


@register(
    "v1k_voxel_key",
    f"""SELECT run_id, scan_id, idx, {", ".join(f"CAST(floor({c}_mm/700e0) AS BIGINT) AS f{c}, {rounded('700e0', c + '_mm')} AS r{c}, CAST(trunc({c}_mm/700e0) AS BIGINT) AS t{c}" for c in "xyz")} FROM points""",
)
def _(spark, sf):
    df = view(spark, sf, "points")
    for mode in ("floor", "round", "trunc"):
        df = keys.voxel_key(df, 700, mode, names=[f"{mode[0]}{c}" for c in "xyz"])
    return df.select(*PID, *(f"{m}{c}" for m in "frt" for c in "xyz"))


@register(
    "v2k_tile_key",
    """SELECT run_id, kf_id, CAST(floor(x_mm / 100000e0 + 0.5e0) AS BIGINT) AS gx, CAST(floor(y_mm / 100000e0 + 0.5e0) AS BIGINT) AS gy FROM keyframes""",
)
def _(spark, sf):
    return keys.tile_key(view(spark, sf, "keyframes"), 100_000).select("run_id", "kf_id", "gx", "gy")


@register(
    "v3k_occ_key",
    """SELECT run_id, scan_id, idx, cx, cy, cx >> 4 AS bx, cy >> 4 AS by, cx - (cx >> 4) * 16 AS sx, cy - (cy >> 4) * 16 AS sy
    FROM (SELECT *, CAST(floor(x_mm / 100e0) AS BIGINT) AS cx, CAST(floor(y_mm / 100e0) AS BIGINT) AS cy FROM points)""",
)
def _(spark, sf):
    return keys.occ_key(view(spark, sf, "points"), 100, 4).select(*PID, "cx", "cy", "bx", "by", "sx", "sy")


@register(
    "v4k_spatial_hash",
    """WITH v AS (SELECT run_id, scan_id, idx, CAST(floor(x_mm/500e0) AS BIGINT) AS vx, CAST(floor(y_mm/500e0) AS BIGINT) AS vy, CAST(floor(z_mm/500e0) AS BIGINT) AS vz FROM points)
    SELECT run_id, scan_id, idx, ((xor(vx*73856093, vy*471943)) % 10000000 + 10000000) % 10000000 AS h2,
      ((xor(xor(vx*73856093, vy*471943), vz*83492791)) % 10000000 + 10000000) % 10000000 AS h3 FROM v""",
)
def _(spark, sf):
    df = keys.voxel_key(view(spark, sf, "points"), 500)
    v = [F.col(c) for c in V]
    return df.select(*PID, keys.spatial_hash(*v[:2]).alias("h2"), keys.spatial_hash(*v).alias("h3"))


def hilbert_sql(columns: str, order: int, leaf: int) -> str:
    """CTEs that end in ``h`` with ``columns`` and ``hilbert``: one step per bit and axis of the transposed index."""
    top, side = (1 << order) - 1, leaf / (1 << order)
    sub = [f"greatest(0, least({top}, CAST(trunc(({c}_mm - (round({c}_mm/{leaf}e0)*{leaf} - {leaf / 2}e0))/{side}e0) AS BIGINT))) AS a{i}" for i, c in enumerate("xyz")]
    steps, n = [f"h0 AS MATERIALIZED (SELECT {columns}, {', '.join(sub)} FROM points)"], 0

    def step(a0: str, a1: str, a2: str, more: str = "") -> None:
        nonlocal n
        steps.append(f"h{n + 1} AS (SELECT {columns}, {a0} AS a0, {a1} AS a1, {a2} AS a2{more} FROM h{n})")
        n += 1

    for b in range(order - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(3):
            swap = f"(xor(a0, a{i}) & {low})"
            first = f"CASE WHEN a{i} & {bit} <> 0 THEN xor(a0, {low}) ELSE xor(a0, {swap}) END"
            rest = [f"CASE WHEN a{i} & {bit} <> 0 THEN a{j} ELSE xor(a{j}, {swap}) END" if j == i else f"a{j}" for j in (1, 2)]
            step(first, *rest)
    step("a0", "xor(a1, a0)", "xor(a2, xor(a1, a0))")
    flip = "0"
    for b in range(order - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN a2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step(*(f"xor(a{i}, {flip})" for i in range(3)))
    bits = " + ".join(f"((a{i} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(order) for i in range(3))
    return f"WITH {', '.join(steps)}, h AS (SELECT {columns}, CAST({bits} AS BIGINT) AS hilbert FROM h{n})"


@register("v5k_hilbert_key", hilbert_sql("run_id, scan_id, idx", 6, 500) + " SELECT run_id, scan_id, idx, hilbert FROM h")
def _(spark, sf):
    return keys.hilbert_key(view(spark, sf, "points"), 500, 6).select(*PID, "hilbert")


@register(
    "a1_voxel_downsample",
    """SELECT run_id, CAST(floor(x_mm/2000e0) AS BIGINT) AS vx, CAST(floor(y_mm/2000e0) AS BIGINT) AS vy, CAST(floor(z_mm/2000e0) AS BIGINT) AS vz,
      avg(x_mm) AS x, avg(y_mm) AS y, avg(z_mm) AS z, avg(intensity) AS intensity, count(*) AS n FROM points GROUP BY ALL""",
)
def _(spark, sf):
    return A.voxel_downsample(view(spark, sf, "points"), 2000, ["run_id"], ["x", "y", "z", "intensity"])


def _info_sql() -> str:
    padded = [f"({c} + 1e-3)" if c in ("cxx", "cyy", "czz") else c for c in SYM]
    diag = {"ixx", "iyy", "izz"}
    return ", ".join(
        f"{q6(f'CASE WHEN n > 1 THEN {e} ELSE {100.0 if i in diag else 0.0}e0 END')} AS {i}"
        for i, e in zip(A.INFO_NAMES, sql_inverse(padded))
    )


@register(
    "a2_voxel_gaussian",
    f"""WITH m AS (SELECT vx, vy, vz, n, mx, my, mz, {", ".join(f"CASE WHEN n > 1 THEN {c} * 1e-6 / (n - 1) END AS {c}" for c in SYM)}
      FROM {moments_sql("points", 1000, "trunc")})
    SELECT vx, vy, vz, n, {", ".join(f"{q6(c)} AS {c}" for c in ["mx", "my", "mz", *SYM])}, {_info_sql()} FROM m""",
)
def _(spark, sf):
    out = A.voxel_gaussian(view(spark, sf, "points"), 1000, scale=1e-3)
    return out.select(*V, "n", *(r6(c).alias(c) for c in ["mx", "my", "mz", *SYM, *A.INFO_NAMES]))


@register(
    "a3_ndt_cells",
    f"""SELECT vx, vy, vz, n, {", ".join(f"{q6(c)} AS {c}" for c in ["mx", "my", "mz"])},
      {", ".join(q6(f"CASE WHEN n >= 6 THEN ({c} * 1e-6 + {1 if c in ('cxx', 'cyy', 'czz') else 0}e0) / n * (n - 1) / n END") + f" AS {c}" for c in SYM)}
    FROM {moments_sql("points", 1000, "round")}""",
)
def _(spark, sf):
    out = A.ndt_cells(view(spark, sf, "points"), 1000, scale=1e-3, clamp=False)
    return out.select(*V, "n", *(r6(c).alias(c) for c in ["mx", "my", "mz", *SYM]))


@register("a3_ndt_cells_clamped")
def _(spark, sf):
    return A.ndt_cells(view(spark, sf, "points"), 1000, scale=1e-3)


def _pop(table: str, cond: str) -> str:
    return f"""(SELECT vx, vy, vz, n, mx, my, mz, {", ".join(f"{c} * 1e-6 / n AS {c}" for c in SYM)} FROM {moments_sql(f"(SELECT * FROM {table} WHERE {cond})", 1000, "trunc")})"""


def _merged(c: str) -> str:
    a, b = c[1], c[2]
    nm = "(h.n*h.m{0} + b.n*b.m{0})/(h.n + b.n)"
    one = f"h.n*(h.{c} + (h.m{a} - {nm.format(a)})*(h.m{b} - {nm.format(b)}))"
    two = f"b.n*(b.{c} + (b.m{a} - {nm.format(a)})*(b.m{b} - {nm.format(b)}))"
    return f"CASE WHEN h.n IS NOT NULL AND b.n IS NOT NULL AND h.n <= 50 THEN ({one} + {two})/(h.n + b.n) ELSE coalesce(h.{c}, b.{c}) END"


@register(
    "a4_merge_gaussians",
    f"""SELECT coalesce(h.vx, b.vx) AS vx, coalesce(h.vy, b.vy) AS vy, coalesce(h.vz, b.vz) AS vz,
      CASE WHEN h.n IS NOT NULL AND b.n IS NOT NULL AND h.n <= 50 THEN h.n + b.n ELSE coalesce(h.n, b.n) END AS n,
      {", ".join(q6(f"CASE WHEN h.n IS NOT NULL AND b.n IS NOT NULL AND h.n <= 50 THEN (h.n*h.{m} + b.n*b.{m})/(h.n + b.n) ELSE coalesce(h.{m}, b.{m}) END") + f" AS {m}" for m in ("mx", "my", "mz"))},
      {", ".join(q6(_merged(c)) + f" AS {c}" for c in SYM)}
    FROM {_pop("points", "run_id < 2")} h FULL OUTER JOIN (SELECT * FROM {_pop("points", "run_id >= 2")} WHERE n > 3) b
      ON h.vx = b.vx AND h.vy = b.vy AND h.vz = b.vz""",
)
def _(spark, sf):
    pts = view(spark, sf, "points")

    def pop(df):
        m = A._moments(df, 1000, (), "trunc", 1e-3)
        return m.withColumns({c: F.col(c) * 1e-6 / F.col("n") for c in SYM})

    # History: the first two vehicles; batch: the others. Together the whole table.
    out = A.merge_gaussians(pop(pts.filter("run_id < 2")), pop(pts.filter("run_id >= 2")))
    return out.select(*V, "n", *(r6(c).alias(c) for c in ["mx", "my", "mz", *SYM]))


@register(
    "a5_merge_mean_var",
    f"""WITH s AS (SELECT run_id, ring, ring < 3 AS low, count(*) AS n, avg(intensity) AS m, count(*)*sum(intensity*intensity) - sum(intensity)*sum(intensity) AS d FROM points GROUP BY ALL),
      v AS (SELECT run_id, low, sum(n) AS n, CAST(sum(n*m) AS DOUBLE)/sum(n) AS m FROM s GROUP BY ALL),
      p AS (SELECT run_id, ring < 3 AS low, CAST(count(*) AS BIGINT) AS n, avg(intensity) AS m, CAST(count(*)*sum(intensity*intensity) - sum(intensity)*sum(intensity) AS DOUBLE)/(count(*)*count(*)) AS v FROM points GROUP BY ALL)
    SELECT a.run_id, {q6("(a.n*a.m + b.n*b.m)/(a.n+b.n)")} AS mean,
      {q6("(a.n*(a.v + ((a.n*a.m + b.n*b.m)/(a.n+b.n) - a.m)*((a.n*a.m + b.n*b.m)/(a.n+b.n) - a.m)) + b.n*(b.v + ((a.n*a.m + b.n*b.m)/(a.n+b.n) - b.m)*((a.n*a.m + b.n*b.m)/(a.n+b.n) - b.m)))/(a.n+b.n)")} AS var
    FROM p a JOIN p b ON a.run_id = b.run_id AND a.low AND NOT b.low""",
)
def _(spark, sf):
    i = F.col("intensity")
    n = F.count(F.lit(1))
    s = view(spark, sf, "points").groupBy("run_id", (F.col("ring") < 3).alias("low")).agg(
        n.alias("n"), F.avg(i).alias("m"), ((n * F.sum(i * i) - F.sum(i) * F.sum(i)).cast("double") / (n * n)).alias("v")
    )
    a = s.filter("low").select("run_id", F.struct("n", "m", "v").alias("a"))
    b = s.filter("NOT low").select("run_id", F.struct("n", "m", "v").alias("b"))
    mean, var = A.merge_mean_var(*(F.col(f"{t}.{c}") for t in "ab" for c in "nmv"))
    return a.join(b, "run_id").select("run_id", r6(mean).alias("mean"), r6(var).alias("var"))


@register(
    "a6_mean_cov_diag",
    f"""SELECT run_id, scan_id, count(*) AS n, {", ".join(f"{q6(f'avg({c}_mm/1000e0)')} AS {c}_mean, {q6(f'var_pop({c}_mm/1000e0)')} AS {c}_var" for c in "xyz")} FROM points GROUP BY ALL""",
)
def _(spark, sf):
    out = A.mean_cov_diag(view(spark, sf, "points", metres=True), ["x", "y", "z"], ["run_id", "scan_id"])
    return out.select("run_id", "scan_id", "n", *(r6(f"{c}_{s}").alias(f"{c}_{s}") for c in "xyz" for s in ("mean", "var")))


@register(
    "a7_voxel_stats",
    f"""WITH c AS (SELECT run_id, {rounded("500e0", "x_mm")} AS vx, {rounded("500e0", "y_mm")} AS vy, {rounded("500e0", "z_mm")} AS vz, count(*) AS c FROM points GROUP BY ALL)
    SELECT run_id, count(*) AS n_voxels, {q6("avg(c)")} AS mean_points, max(c) AS max_points, min(c) AS min_points, {q6("coalesce(stddev_samp(c), 0e0)")} AS std_points FROM c GROUP BY run_id""",
)
def _(spark, sf):
    out = A.voxel_stats(view(spark, sf, "points"), 500, ["run_id"])
    return out.select("run_id", "n_voxels", r6("mean_points").alias("mean_points"), "max_points", "min_points", r6("std_points").alias("std_points"))


@register(
    "a8_map_extent",
    """WITH w AS (SELECT k.run_id, k.x_mm + k.r00*p.x_mm - k.r10*p.y_mm AS x, k.y_mm + k.r10*p.x_mm + k.r00*p.y_mm AS y
        FROM kf_points p JOIN keyframes k ON p.run_id = k.run_id AND p.kf_id = k.kf_id
        WHERE p.idx % 10 = 0 AND p.x_mm*p.x_mm + p.y_mm*p.y_mm + p.z_mm*p.z_mm BETWEEN 101 AND 2500000000),
      b AS (SELECT run_id, min(x) - 1000 AS x0, max(x) + 1000 AS x1, min(y) - 1000 AS y0, max(y) + 1000 AS y1 FROM w GROUP BY run_id
        UNION ALL SELECT run_id, min(x_mm), max(x_mm), min(y_mm), max(y_mm) FROM keyframes GROUP BY run_id)
    SELECT run_id, floor(min(x0)/500e0)*500e0 AS min_x, ceil(max(x1)/500e0)*500e0 AS max_x, floor(min(y0)/500e0)*500e0 AS min_y, ceil(max(y1)/500e0)*500e0 AS max_y FROM b GROUP BY run_id""",
)
def _(spark, sf):
    # Millimetre frames: usable range 50 m, margin 1 m, cell 0.5 m.
    poses = keyframe_poses(spark, sf, metres=False)
    pts = view(spark, sf, "kf_points")
    thin = A.usable_range(pts, 50_000, 3, 10.0)
    out = A.map_extent(thin.withColumns({c: F.col(c).cast("double") for c in "xyz"}), poses, 500.0, max_r=50_000.0, margin=1000.0)
    # Quarter-turn rotations leave 1e-12 noise on integer millimetres; snap before the outward rounding.
    return out.select("run_id", *(F.round(c, 0).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")))


@register(
    "a9_imu_static_init",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, imu_id) AS k FROM imu),
      m AS (SELECT vehicle_id, {", ".join(f"avg({a}_mrad/1000e0) AS m_{a}" for a in ("gx", "gy", "gz"))}, {", ".join(f"avg({a}_mms2/1000e0) AS m_{a}" for a in ("ax", "ay", "az"))} FROM f WHERE k <= 20 GROUP BY vehicle_id),
      r AS (SELECT vehicle_id AS vid, count(*) > 20 AS ready FROM imu GROUP BY vehicle_id)
    SELECT vehicle_id, {", ".join(f"{q6('m_' + a)} AS m_{a}" for a in ("gx", "gy", "gz", "ax", "ay", "az"))},
      {", ".join(f"{q6(f'-9.809e0 * m_a{c} / sqrt(m_ax*m_ax + m_ay*m_ay + m_az*m_az)')} AS grav_{c}" for c in "xyz")}, ready FROM m JOIN r ON vehicle_id = vid""",
)
def _(spark, sf):
    imu = fixtures.view(spark, sf, "imu")
    imu = imu.select("vehicle_id", "t_us", "imu_id", *((F.col(f"{a}_mrad") / 1000.0).alias(a) for a in ("gx", "gy", "gz")), *((F.col(f"{a}_mms2") / 1000.0).alias(a) for a in ("ax", "ay", "az")))
    out = A.imu_static_init(imu, ["vehicle_id"], ["t_us", "imu_id"], 20)
    cols = [f"m_{a}" for a in ("gx", "gy", "gz", "ax", "ay", "az")] + ["grav_x", "grav_y", "grav_z"]
    return out.select("vehicle_id", *(r6(c).alias(c) for c in cols), "ready")


CHI = "(mx_mm*mx_mm + my_mm*my_mm + mz_mm*mz_mm) % 99991 / 1000e0"


@register(
    "a12_edge_stats",
    f"""WITH e AS (SELECT etype, {CHI} AS chi2 FROM graph_edges WHERE level = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY chi2) - 1 AS k, count(*) OVER (PARTITION BY etype) AS n FROM e)
    SELECT etype, max(n) AS n, {q6("avg(chi2)")} AS mean, max(chi2) AS max, max(chi2) FILTER (k = n // 2) AS median,
      max(chi2) FILTER (k = CAST(floor(n * 0.1e0) AS BIGINT)) AS p10, max(chi2) FILTER (k = CAST(floor(n * 0.9e0) AS BIGINT)) AS p90 FROM r GROUP BY etype""",
)
def _(spark, sf):
    e = fixtures.view(spark, sf, "graph_edges").withColumn("chi2", F.expr(CHI.replace("1000e0", "1000D")))
    out = A.edge_stats(e)
    return out.select("etype", "n", r6("mean").alias("mean"), "max", "median", "p10", "p90")


@register(
    "a13_timing_stats",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS b FROM timings),
      r AS (SELECT name, ms, row_number() OVER (PARTITION BY name ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY name) AS n FROM t WHERE b <= 2000)
    SELECT name, {q6("avg(ms)")} AS mean, max(ms) FILTER (k = CAST(floor(n*0.5e0) AS BIGINT)) AS median, max(ms) FILTER (k = CAST(floor(n*0.95e0) AS BIGINT)) AS p95, max(n) AS calls FROM r GROUP BY name""",
)
def _(spark, sf):
    out = A.timing_stats(fixtures.view(spark, sf, "timings"))
    return out.select("name", r6("mean").alias("mean"), "median", "p95", "calls")


@register(
    "a14_residual_stats",
    """WITH e AS (SELECT run_id, scan_id, (z_mm/1000e0 + 1.2e0)*(z_mm/1000e0 + 1.2e0) AS r2 FROM points),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id, scan_id ORDER BY r2) - 1 AS k, count(*) OVER (PARTITION BY run_id, scan_id) AS n FROM e)
    SELECT run_id, scan_id, max(r2) FILTER (k = n // 2) AS median, max(r2) AS max, max(n) AS effective FROM r GROUP BY ALL""",
)
def _(spark, sf):
    pts = view(spark, sf, "points", metres=True).withColumn("residual", F.col("z") + 1.2)
    return A.residual_stats(pts).select("run_id", "scan_id", "median", "max", "effective")


@register(
    "a17_best_candidate",
    """SELECT vehicle_id, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY score DESC, seq) AS k FROM loc_results) WHERE k = 1""",
)
def _(spark, sf):
    res = fixtures.view(spark, sf, "loc_results").select("vehicle_id", "seq", "score")
    return A.best_candidate(res, ["vehicle_id"], "score", "seq")


@register(
    "a18_subcube_centroids",
    hilbert_sql("x_mm, y_mm, z_mm", 4, 500)
    + f""" SELECT vx, vy, vz, hilbert, {q6("avg(x_mm)")} AS x, {q6("avg(y_mm)")} AS y, {q6("avg(z_mm)")} AS z, count(*) AS n
    FROM (SELECT *, {", ".join(f"CAST(round({c}_mm/500e0) AS BIGINT) AS v{c}" for c in "xyz")} FROM h) GROUP BY vx, vy, vz, hilbert""",
)
def _(spark, sf):
    out = A.subcube_centroids(view(spark, sf, "points"), 500, 4)
    return out.select("vx", "vy", "vz", "hilbert", *(r6(c).alias(c) for c in "xyz"), "n")


@register(
    "a19_fit_circle",
    f"""WITH s AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(x) AS x, sum(y) AS y,
        sum(x*(x*x+y*y)) AS xq, sum(y*(x*x+y*y)) AS yq, sum(x*x+y*y) AS q FROM circle_samples GROUP BY grp),
      d AS (SELECT *, xx*(yy*n - y*y) - xy*(xy*n - y*x) + x*(xy*y - yy*x) AS det FROM s),
      f AS (SELECT grp AS g, ((yy*n - y*y)*xq + (x*y - xy*n)*yq + (xy*y - x*yy)*q)/det AS a, ((x*y - xy*n)*xq + (xx*n - x*x)*yq + (xy*x - xx*y)*q)/det AS b,
        ((xy*y - x*yy)*xq + (xy*x - xx*y)*yq + (xx*yy - xy*xy)*q)/det AS c FROM d),
      e AS (SELECT grp, sum((x*x+y*y - a*x - b*y - c)*(x*x+y*y - a*x - b*y - c)) AS residual FROM circle_samples JOIN f ON g = grp GROUP BY grp)
    SELECT grp, {q6("a/2")} AS cx, {q6("b/2")} AS cy, {q6("sqrt(c + a*a/4 + b*b/4)")} AS radius, {q6("residual")} AS residual FROM e JOIN f ON g = grp""",
)
def _(spark, sf):
    out = A.fit_circle(fixtures.view(spark, sf, "circle_samples"), ["grp"])
    return out.select("grp", *(r6(c).alias(c) for c in ("cx", "cy", "radius", "residual")))


@register("a22_floor_plane")
def _(spark, sf):
    return A.floor_plane(view(spark, sf, "points", metres=True), below=-1.0)


@register(
    "a23_chunk_counts",
    """WITH w AS (SELECT run_id, x_mm, y_mm, CAST(floor(x_mm / 100000e0 + 0.5e0) AS BIGINT) AS gx, CAST(floor(y_mm / 100000e0 + 0.5e0) AS BIGINT) AS gy FROM keyframes)
    SELECT run_id, gx, gy, count(*) AS n_points, min(x_mm) AS min_x, max(x_mm) AS max_x, min(y_mm) AS min_y, max(y_mm) AS max_y FROM w GROUP BY ALL""",
)
def _(spark, sf):
    return A.chunk_counts(view(spark, sf, "keyframes"), 100_000, ["run_id"])


@register(
    "a24_degenerate_flags",
    "SELECT vehicle_id, seq, least(score, abs(x_mm)/1000e0, abs(y_mm)/1000e0) < 0.3e0 AS degenerate FROM loc_results",
)
def _(spark, sf):
    res = fixtures.view(spark, sf, "loc_results")
    res = res.withColumn("w", F.array("score", F.abs("x_mm") / 1000.0, F.abs("y_mm") / 1000.0))
    return A.degenerate_flags(res, "w", "degenerate").select("vehicle_id", "seq", "degenerate")
