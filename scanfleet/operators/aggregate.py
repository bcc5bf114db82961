"""Aggregations over points, cells, samples and edges.

Coordinates may be scaled integers (for example millimetres) with ``scale`` giving the unit: sums of
integers are exact in any order, so a result does not depend on how rows were partitioned or
which task was retried. Every grouped sum is a built-in aggregate and so is combined map-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfleet.functions import geom, kernels
from scanfleet.functions.keys import hilbert_key, tile_key, voxel_key
from scanfleet.operators.ordered import join_groups, latest, order_stats
from scanfleet.operators.points import transform_points, usable_range

XYZ = ("x", "y", "z")
VOXEL = ["vx", "vy", "vz"]
SYM3 = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
SYM3_NAMES = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
INFO_NAMES = ["ixx", "ixy", "ixz", "iyy", "iyz", "izz"]

# Fixed values of the Gaussian map.
SINGLE_POINT_INFO = 100.0
COV_REGULARISER = 1e-3
MIN_EIGEN_RATIO = 0.01
FREEZE_ABOVE = 50
MERGE_ABOVE = 3
MIN_SINGULAR_RATIO = 1e-3


def voxel_downsample(
    points: DataFrame,
    leaf: float,
    by: Sequence[str] = (),
    fields: Sequence[str] = XYZ,
    rounding: str = "floor",
) -> DataFrame:
    """One row per voxel: mean of every field and the count. ``by`` scopes voxels (scan, run, tile)."""
    keyed = voxel_key(points, leaf, rounding)
    return keyed.groupBy(*by, *VOXEL).agg(
        *(F.avg(c).alias(c) for c in fields), F.count(F.lit(1)).alias("n")
    )


def _moments(points: DataFrame, leaf: float, by: Sequence[str], rounding: str, scale: float) -> DataFrame:
    """Count, mean and centred second moments per voxel; offsets are taken from the voxel origin."""
    step = int(leaf) if float(leaf).is_integer() else float(leaf)
    off = [F.col(c) - F.col(v) * F.lit(step) for c, v in zip(XYZ, VOXEL)]
    keyed = voxel_key(points, leaf, rounding).select(
        *by, *VOXEL, *(o.alias(f"_{c}") for o, c in zip(off, XYZ))
    )
    d = [F.col(f"_{c}") for c in XYZ]
    sums = keyed.groupBy(*by, *VOXEL).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c).cast("double").alias(f"_s{i}") for i, c in enumerate(d)),
        *(F.sum(d[i] * d[j]).cast("double").alias(f"_p{i}{j}") for i, j in SYM3),
    )
    s = [F.col(f"_s{i}") for i in range(3)]
    centred = {
        n: F.col(f"_p{i}{j}") - s[i] * s[j] / F.col("n") for n, (i, j) in zip(SYM3_NAMES, SYM3)
    }
    means = {
        m: (F.col(v) * F.lit(step) + s[i] / F.col("n")) * scale
        for i, (m, v) in enumerate(zip(("mx", "my", "mz"), VOXEL))
    }
    return sums.select(*by, *VOXEL, "n", *(e.alias(k) for k, e in {**means, **centred}.items()))


def voxel_gaussian(
    points: DataFrame, leaf: float, by: Sequence[str] = (), scale: float = 1.0
) -> DataFrame:
    """Count, mean, sample covariance and information matrix per (truncated) voxel."""
    m = _moments(points, leaf, by, "trunc", scale)
    cov = {c: F.when(F.col("n") > 1, F.col(c) * (scale * scale) / (F.col("n") - 1)) for c in SYM3_NAMES}
    out = m.withColumns(cov)
    padded = [
        F.col(c) + COV_REGULARISER if i == j else F.col(c) for c, (i, j) in zip(SYM3_NAMES, SYM3)
    ]
    out = geom.add_sym3_inverse(out, padded, INFO_NAMES)
    info = {
        n: F.when(F.col("n") > 1, F.col(n)).otherwise(SINGLE_POINT_INFO if i == j else 0.0)
        for n, (i, j) in zip(INFO_NAMES, SYM3)
    }
    return out.withColumns(info)


_INFO_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in INFO_NAMES])
_CHECKED_INFO_TYPE = T.StructType([*_INFO_TYPE.fields, T.StructField("valid", T.BooleanType())])


@F.pandas_udf(_CHECKED_INFO_TYPE)
def _clamped_inverse(cov: pd.DataFrame) -> pd.DataFrame:
    """Inverse covariance after raising small eigenvalues, for one Arrow batch of cells."""
    m = np.empty((len(cov), 3, 3))
    for name, (i, j) in zip(SYM3_NAMES, SYM3):
        m[:, i, j] = m[:, j, i] = cov[name].to_numpy(dtype=float)
    blank = ~np.isfinite(m).all(axis=(1, 2))
    m[blank] = np.eye(3)
    vals, vecs = np.linalg.eigh(m)
    bad = blank | (vals[:, 0] < 0) | (vals[:, 2] <= 0)
    vals = np.maximum(vals, MIN_EIGEN_RATIO * vals[:, 2:])
    with np.errstate(divide="ignore", invalid="ignore"):
        inv = np.einsum("nik,nk,njk->nij", vecs, 1.0 / vals, vecs)
    bad |= ~np.isfinite(inv).all(axis=(1, 2))
    out = {n: np.where(bad, np.nan, inv[:, i, j]) for n, (i, j) in zip(INFO_NAMES, SYM3)}
    return pd.DataFrame({**out, "valid": ~bad})


def ndt_cells(
    points: DataFrame,
    res: float,
    by: Sequence[str] = (),
    min_pts: int = 6,
    prior: float = 1.0,
    scale: float = 1.0,
    clamp: bool = True,
) -> DataFrame:
    """Normal-distribution cells of a map: count, mean, covariance and its clamped inverse.

    ``prior`` is the diagonal the covariance accumulator starts from (1 as in the usual open
    implementation, 0 for the textbook form). Cells under ``min_pts`` have null covariance.
    """
    m = _moments(points, res, by, "round", scale)
    n = F.col("n")
    cov = {
        c: F.when(
            n >= min_pts,
            (F.col(c) * (scale * scale) + (prior if i == j else 0.0)) / n * (n - 1) / n,
        )
        for c, (i, j) in zip(SYM3_NAMES, SYM3)
    }
    cells = m.withColumns(cov)
    if not clamp:
        return cells
    full = cells.filter(n >= min_pts).withColumn("_inv", _clamped_inverse(F.struct(*SYM3_NAMES)))
    return full.select("*", "_inv.*").drop("_inv")


def merge_mean_var(
    n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column
) -> tuple[Column, Column]:
    """Pooled mean and population variance of two summaries."""
    n = n1 + n2
    mean = (n1 * m1 + n2 * m2) / n
    var = (n1 * (v1 + (mean - m1) * (mean - m1)) + n2 * (v2 + (mean - m2) * (mean - m2))) / n
    return mean, var


@F.pandas_udf(_INFO_TYPE)
def _bounded_inverse(cov: pd.DataFrame) -> pd.DataFrame:
    m = np.empty((len(cov), 3, 3))
    for name, (i, j) in zip(SYM3_NAMES, SYM3):
        m[:, i, j] = m[:, j, i] = cov[name].to_numpy(dtype=float)
    u, s, vt = np.linalg.svd(m)
    s = np.maximum(s, s[:, :1] * MIN_SINGULAR_RATIO)
    with np.errstate(divide="ignore", invalid="ignore"):
        inv = np.einsum("nki,nk,njk->nij", vt, 1.0 / s, u)
    return pd.DataFrame({n: inv[:, i, j] for n, (i, j) in zip(INFO_NAMES, SYM3)})


def merge_gaussians(
    history: DataFrame,
    batch: DataFrame,
    by: Sequence[str] = (),
    freeze_above: int = FREEZE_ABOVE,
    merge_above: int = MERGE_ABOVE,
    info: bool = False,
) -> DataFrame:
    """Cell summaries of a history updated with a batch (full outer join on the voxel).

    A frozen cell (more than ``freeze_above`` points) keeps its history; a batch with at most
    ``merge_above`` points in a cell changes nothing and opens no new cell.
    """
    key = [*by, *VOXEL]
    cols = ["n", "mx", "my", "mz", *SYM3_NAMES]
    h = history.select(*key, F.struct(*cols).alias("h"))
    b = batch.filter(F.col("n") > merge_above).select(*key, F.struct(*cols).alias("b"))
    j = h.join(b, key, "full_outer")
    n1, n2 = F.col("h.n"), F.col("b.n")
    both = F.col("h").isNotNull() & F.col("b").isNotNull() & (n1 <= freeze_above)
    pick = F.coalesce(F.col("h"), F.col("b"))
    m1 = [F.col(f"h.{c}") for c in ("mx", "my", "mz")]
    m2 = [F.col(f"b.{c}") for c in ("mx", "my", "mz")]
    mean = [(n1 * a + n2 * c) / (n1 + n2) for a, c in zip(m1, m2)]
    out = {"n": F.when(both, n1 + n2).otherwise(pick["n"])}
    for c, m in zip(("mx", "my", "mz"), mean):
        out[c] = F.when(both, m).otherwise(pick[c])
    for c, (i, k) in zip(SYM3_NAMES, SYM3):
        d1 = F.col(f"h.{c}") + (m1[i] - mean[i]) * (m1[k] - mean[k])
        d2 = F.col(f"b.{c}") + (m2[i] - mean[i]) * (m2[k] - mean[k])
        out[c] = F.when(both, (n1 * d1 + n2 * d2) / (n1 + n2)).otherwise(pick[c])
    merged = j.select(*key, *(e.alias(k) for k, e in out.items()))
    if not info:
        return merged
    ready = merged.filter(F.col("cxx").isNotNull())
    return ready.withColumn("_inv", _bounded_inverse(F.struct(*SYM3_NAMES))).select("*", "_inv.*").drop("_inv")


def mean_cov_diag(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance per column; a single row has variance 0."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.var_pop(c).alias(f"{c}_var")]
    return df.groupBy(*by).agg(*aggs)


def voxel_stats(points: DataFrame, leaf: float, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty voxels and mean, max, min, sample deviation of points per voxel."""
    per = voxel_key(points, leaf, "round").groupBy(*by, *VOXEL).agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c")
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.sum(c).alias("_s"),
        F.sum(c * c).alias("_ss"),
        F.max(c).alias("max_points"),
        F.min(c).alias("min_points"),
    )
    n, s, ss = F.col("n_voxels"), F.col("_s").cast("double"), F.col("_ss").cast("double")
    var = F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)
    return out.select(
        *by,
        "n_voxels",
        (s / n).alias("mean_points"),
        "max_points",
        "min_points",
        F.when(n > 1, F.sqrt(var)).otherwise(0.0).alias("std_points"),
    )


def map_extent(
    kf_points: DataFrame,
    poses: DataFrame,
    res: float,
    by: Sequence[str] = ("run_id",),
    every: int = 10,
    max_r: float = 50.0,
    margin: float = 1.0,
) -> DataFrame:
    """Planar bounds of keyframe positions and every ``every``-th usable point with a margin,
    snapped outward to ``res``."""
    thin = usable_range(kf_points.filter(F.col("idx") % every == 0), max_r, 3)
    world = transform_points(thin, poses, [*by, "kf_id"])
    lo = world.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    pts = lo.select(*by, *((F.col(f"min_{c}") - margin).alias(f"min_{c}") for c in "xy"), *((F.col(f"max_{c}") + margin).alias(f"max_{c}") for c in "xy"))
    pos = poses.groupBy(*by).agg(
        *(f(f"t{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy")
    )
    both = pts.unionByName(pos).groupBy(*by).agg(
        *(F.min(f"min_{c}").alias(f"min_{c}") for c in "xy"), *(F.max(f"max_{c}").alias(f"max_{c}") for c in "xy")
    )
    return both.select(
        *by,
        *((F.floor(F.col(f"min_{c}") / res) * res).alias(f"min_{c}") for c in "xy"),
        *((F.ceil(F.col(f"max_{c}") / res) * res).alias(f"max_{c}") for c in "xy"),
    )


def imu_static_init(
    imu: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 20
) -> DataFrame:
    """Running mean, recursive covariance and gravity from the first ``n`` samples of each key.

    The top-n limit is applied before the shuffle, so a key brings at most ``n`` rows per task.
    ``ready`` tells whether more than ``n`` samples exist.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = imu.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    axes = ["gx", "gy", "gz", "ax", "ay", "az"]
    samples = first.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_k", *(F.col(a).cast("double").alias(a) for a in axes)))).alias("_s")
    )
    start = F.struct(
        *(F.col("_s")[0][a].alias(f"m_{a}") for a in axes), *(F.lit(0.0).alias(f"c_{a}") for a in axes)
    )

    def step(acc: Column, s: Column) -> Column:
        k = s["_k"].cast("double")
        means, covs = [], []
        for a in axes:
            mean = acc[f"m_{a}"] + (s[a] - acc[f"m_{a}"]) / k
            dev = s[a] - mean
            means.append(mean.alias(f"m_{a}"))
            covs.append((acc[f"c_{a}"] * (k - 1) / k + dev * dev * (k - 1) / (k * k)).alias(f"c_{a}"))
        return F.struct(*means, *covs)

    counts = imu.groupBy(*by).agg((F.count(F.lit(1)) > n).alias("ready"))
    folded = samples.select(*by, F.aggregate("_s", start, step).alias("_f")).select(*by, "_f.*")
    g = geom.s2_gravity(geom.Vec.of("m_ax", "m_ay", "m_az"))
    return folded.withColumns(dict(zip(("grav_x", "grav_y", "grav_z"), g))).join(counts, list(by))


def edge_stats(edges: DataFrame, by: Sequence[str] = ("etype",)) -> DataFrame:
    """Count, mean, upper median, 10 % and 90 % index picks and maximum of χ² of active edges."""
    active = edges.filter(F.col("level") == 0)
    n = F.col("n")
    picks = order_stats(
        active, by, "chi2", {"median": F.floor(n / 2), "p10": F.floor(n * 0.1), "p90": F.floor(n * 0.9)}
    )
    base = active.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("chi2").alias("mean"), F.max("chi2").alias("max")
    )
    return join_groups(base, picks, by)


def timing_stats(timings: DataFrame, keep: int = 2000, span: float = 1 << 17) -> DataFrame:
    """Mean, median and 95 % index picks over the newest ``keep`` records of each timer."""
    recent = latest(timings, ["name"], ["seq"], span, keep)
    n = F.col("n")
    picks = order_stats(recent, ["name"], "ms", {"median": F.floor(n * 0.5), "p95": F.floor(n * 0.95)})
    base = recent.groupBy("name").agg(F.avg("ms").alias("mean"), F.count(F.lit(1)).alias("calls"))
    return join_groups(base, picks, ["name"])


def residual_stats(residuals: DataFrame, by: Sequence[str] = ("run_id", "scan_id")) -> DataFrame:
    """Upper median and maximum of the squared residual and the number of effective rows."""
    sq = residuals.withColumn("_r2", F.col("residual") * F.col("residual"))
    picks = order_stats(sq, by, "_r2", {"median": F.floor(F.col("n") / 2)})
    base = sq.groupBy(*by).agg(F.max("_r2").alias("max"), F.count("_r2").alias("effective"))
    return join_groups(base, picks, by)


def normal_equations(
    rows: DataFrame, by: Sequence[str], jac: Sequence[str], err: str, weight: Column | None = None
) -> DataFrame:
    """``H = Σ w J Jᵀ`` (upper triangle ``h_i_j``) and ``b = −Σ w J e`` per key, one scalar error per row."""
    w = F.lit(1.0) if weight is None else weight
    k = len(jac)
    hs = [
        F.sum(w * F.col(jac[i]) * F.col(jac[j])).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    bs = [F.sum(-w * F.col(jac[i]) * F.col(err)).alias(f"b_{i}") for i in range(k)]
    cost = F.sum(w * F.col(err) * F.col(err)).alias("cost")
    return rows.groupBy(*by).agg(*hs, *bs, cost, F.count(F.lit(1)).alias("n"))


def total_chi2(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*by).agg(F.sum("chi2").alias("chi2"))


def total_robust_chi2(
    edges: DataFrame, kernel: str, delta: float, by: Sequence[str] = ()
) -> DataFrame:
    rho, _, _ = kernels.robust_weight(F.col("chi2"), kernel, delta)
    return edges.groupBy(*by).agg(F.sum(rho).alias("robust_chi2"))


def best_candidate(scores: DataFrame, by: Sequence[str], score: str, index: str) -> DataFrame:
    """Row with the highest score per key; the smallest index wins ties."""
    row = F.struct(*(c for c in scores.columns if c not in by))
    best = scores.groupBy(*by).agg(F.max_by(row, F.struct(F.col(score), -F.col(index))).alias("_r"))
    return best.select(*by, "_r.*")


def subcube_centroids(
    points: DataFrame, leaf: float, order: int = 6, by: Sequence[str] = ()
) -> DataFrame:
    """Mean position and count per Hilbert sub-cube of a voxel."""
    keyed = hilbert_key(voxel_key(points, leaf, "round"), leaf, order)
    return keyed.groupBy(*by, *VOXEL, "hilbert").agg(
        *(F.avg(c).alias(c) for c in XYZ), F.count(F.lit(1)).alias("n")
    )


def fit_circle(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares circle per group from ``x²+y² = a x + b y + c``, with the residual sum."""
    x, y = F.col("x"), F.col("y")
    q = x * x + y * y
    s = points.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *(
            F.sum(e).alias(a)
            for a, e in {
                "_xx": x * x, "_xy": x * y, "_yy": y * y, "_x": x, "_y": y,
                "_xq": x * q, "_yq": y * q, "_q": q,
            }.items()
        ),
    )
    m = [F.col(c) for c in ("_xx", "_xy", "_x", "_yy", "_y", "_n")]
    rhs = [F.col("_xq"), F.col("_yq"), F.col("_q")]
    fit = geom.add_solve3(s, m, rhs, ["_a", "_b", "_c"]).select(*by, "_a", "_b", "_c")
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    e = q - a * x - b * y - c
    res = points.join(fit, list(by)).groupBy(*by).agg(F.sum(e * e).alias("residual"))
    return fit.join(res, list(by)).select(
        *by,
        (a / 2).alias("cx"),
        (b / 2).alias("cy"),
        F.sqrt(c + a * a / 4 + b * b / 4).alias("radius"),
        "residual",
    )


def plane_fit(neighbours: DataFrame, by: Sequence[str], max_dist: float = 0.1, scale: float = 1.0) -> DataFrame:
    """Plane ``n·p + d = 0`` through at least three neighbours per query: an array ``near`` of structs, or rows, with
    ``nx, ny, nz``.

    Least squares of ``A n = −1``; the fit is refused when a neighbour is farther than
    ``max_dist``. Sums are taken over the stored integers, ``scale`` converts them to metres.
    """
    by, names = list(by), ("nx", "ny", "nz")
    if "near" not in neighbours.columns:
        neighbours = neighbours.groupBy(*by).agg(F.collect_list(F.struct(*names)).alias("near"))
    found = ["pa", "pb", "pc", "pd", "max_dist"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            n = pc.list_value_length(near).to_numpy()
            if not len(n):
                continue
            points = near.flatten()
            v = [c.to_numpy(zero_copy_only=False) for c in points.flatten()]
            first = np.cumsum(n) - n
            m = [np.add.reduceat(v[i] * v[j], first).astype(float) * (scale * scale) for i, j in SYM3]
            rhs = [np.add.reduceat(-c, first).astype(float) * scale for c in v]
            xx, xy, xz, yy, yz, zz = m
            det = geom.sym3_det(m)
            with np.errstate(all="ignore"):
                inv = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
                inv = [c / det for c in inv]
                w = [inv[i] * rhs[0] + inv[j] * rhs[1] + inv[k] * rhs[2] for i, j, k in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]
                d = 1.0 / np.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
                plane = [c * d for c in w]
                a, b, c, e = (np.repeat(x, n) for x in (*plane, d))
                far = np.maximum.reduceat(np.abs(a * (v[0] * scale) + b * (v[1] * scale) + c * (v[2] * scale) + e), first)
                keep = pa.array((det != 0) & (far <= max_dist))
            own = [batch.column(c).filter(keep) for c in [*by, "n"]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x).filter(keep) for x in (*plane, d, far))], names=[*by, "n", *found])

    s = neighbours.withColumn("n", F.size("near").cast("bigint")).filter(F.col("n") >= 3)
    s = s.select(*by, "n", F.transform("near", lambda p: F.struct(*(p[c].alias(c) for c in names))).alias("near"))
    kept = ", ".join(f"`{c}` {s.schema[c].dataType.simpleString()}" for c in [*by, "n"])
    return s.mapInArrow(fit, kept + "".join(f", {c} double" for c in found))


def floor_plane(
    points: DataFrame,
    by: Sequence[str] = ("run_id", "scan_id"),
    below: float = -1.0,
    hypotheses: int = 12,
    inlier: float = 0.25,
    min_candidates: int = 200,
    min_inliers: int = 100,
    min_nz: float = 0.99,
) -> DataFrame:
    """Ground plane per scan by seeded consensus, refitted on its inliers.

    Three pseudo-random points per hypothesis are picked by hash order, so the result is repeatable;
    every candidate point is scored against all hypotheses in one aggregation (no pairing of points).
    """
    by = list(by)
    cand = points.filter(F.col("z") < below).select(*by, "idx", *(F.col(c).cast("double").alias(c) for c in XYZ))
    # The smallest hashes per hypothesis and corner, as map-side aggregates.
    corners = cand.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        *(
            F.min_by(F.struct(*XYZ), F.xxhash64(F.col("idx"), F.lit(3 * k + c))).alias(f"_c{k}_{c}")
            for k in range(hypotheses)
            for c in range(3)
        ),
    ).filter(F.col("n_candidates") >= min_candidates)
    planes = []
    for k in range(hypotheses):
        a, b, c = (geom.Vec(*(F.col(f"_c{k}_{i}.{n}") for n in XYZ)) for i in range(3))
        normal = b.minus(a).cross(c.minus(a))
        length = normal.norm()
        unit = normal.times(F.when(normal.z < 0, -1.0).otherwise(1.0) / F.when(length > 1e-9, length))
        planes.append(F.struct(unit.x.alias("a"), unit.y.alias("b"), unit.z.alias("c"), (-unit.dot(a)).alias("d")))
    seeds = corners.select(*by, "n_candidates", *(p.alias(f"_h{k}") for k, p in enumerate(planes)))

    def dist(h: str) -> Column:
        return F.abs(
            F.col(f"{h}.a") * F.col("x") + F.col(f"{h}.b") * F.col("y") + F.col(f"{h}.c") * F.col("z") + F.col(f"{h}.d")
        )

    scored = cand.join(seeds, by)
    votes = scored.groupBy(*by).agg(
        *(F.sum(F.when(dist(f"_h{k}") < inlier, 1).otherwise(0)).alias(f"_v{k}") for k in range(hypotheses))
    )
    ranked = seeds.join(votes, by).withColumn(
        "_best",
        F.array_max(
            F.array(
                *(
                    F.struct(F.col(f"_v{k}").alias("v"), F.lit(-k).alias("k"), F.col(f"_h{k}").alias("h"))
                    for k in range(hypotheses)
                )
            )
        ),
    )
    best = ranked.select(*by, "n_candidates", F.col("_best.h").alias("_p"))
    hits = cand.join(best, by).filter(dist("_p") < inlier)
    x, y, z = (F.col(c) for c in XYZ)
    one = F.lit(1.0)
    s = hits.groupBy(*by).agg(
        F.first("n_candidates").alias("n_candidates"),
        F.count(F.lit(1)).alias("n_inliers"),
        *(
            F.sum(e).alias(a)
            for a, e in {
                "_xx": x * x, "_xy": x * y, "_x": x, "_yy": y * y, "_y": y, "_n": one,
                "_xz": x * z, "_yz": y * z, "_z": z,
            }.items()
        ),
    )
    # The floor is near horizontal: refit z = p x + q y + r.
    normal = [F.col(c) for c in ("_xx", "_xy", "_x", "_yy", "_y", "_n")]
    s = geom.add_solve3(s, normal, [F.col(c) for c in ("_xz", "_yz", "_z")], ["_p", "_q", "_r"])
    p, q, r = F.col("_p"), F.col("_q"), F.col("_r")
    length = F.sqrt(p * p + q * q + 1.0)
    out = s.select(
        *by, "n_candidates", "n_inliers",
        (-p / length).alias("a"), (-q / length).alias("b"), (1.0 / length).alias("c"), (-r / length).alias("d"),
    )
    return out.filter((F.col("c") >= min_nz) & (F.col("n_inliers") >= min_inliers))


def chunk_counts(points: DataFrame, size: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """Points and extent per map tile."""
    return tile_key(points, size).groupBy(*by, "gx", "gy").agg(
        F.count(F.lit(1)).alias("n_points"),
        *(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))),
    )


def degenerate_flags(df: DataFrame, weights: str, name: str, threshold: float = 0.3) -> DataFrame:
    """True where any axis weight of the array column is under the threshold."""
    return df.withColumn(name, F.array_min(weights) < threshold)
