"""Rigid-body geometry as Column expressions (no UDF, stays inside whole-stage codegen).

Rotations are unit quaternions ``Quat(w, x, y, z)``, translations ``Vec(x, y, z)`` and rigid
transforms ``Pose(q, t)``; all members are Columns. ``Pose.of("a")`` reads the flat columns
``a_tx … a_qz`` and ``pose.columns("b")`` writes them back.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gravity magnitudes and small-angle limits that results must agree with.
GRAVITY = 9.81
S2_LENGTH = 9.809
EXP_EPS = 1e-7
EXP_EPS_VECTOR = 1e-5
LOG_SMALL_ANGLE = 1e-3
LOG_TRACE_GUARD = 3.0 - 1e-6
GIMBAL_EPS = 1e-6


def _d(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(*names: str) -> Vec:
        return Vec(*(F.col(n) for n in names))

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(
            self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x
        )

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def columns(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip("xyz", self)]


class Quat(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column

    @property
    def vec(self) -> Vec:
        return Vec(self.x, self.y, self.z)


class Pose(NamedTuple):
    q: Quat
    t: Vec

    @staticmethod
    def of(prefix: str = "") -> Pose:
        p = f"{prefix}_" if prefix else ""
        return Pose(
            Quat(*(F.col(f"{p}q{n}") for n in "wxyz")), Vec(*(F.col(f"{p}t{n}") for n in "xyz"))
        )

    @staticmethod
    def field(struct: str | Column) -> Pose:
        """The pose kept in a struct column with fields tx … qz."""
        c = F.col(struct) if isinstance(struct, str) else struct
        return Pose(
            Quat(*(c.getField(f"q{n}") for n in "wxyz")),
            Vec(*(c.getField(f"t{n}") for n in "xyz")),
        )

    def columns(self, prefix: str = "") -> list[Column]:
        p = f"{prefix}_" if prefix else ""
        return [c.alias(f"{p}t{n}") for n, c in zip("xyz", self.t)] + [
            c.alias(f"{p}q{n}") for n, c in zip("wxyz", self.q)
        ]

    def struct(self) -> Column:
        return F.struct(*self.columns())


def stage(df: DataFrame, prefix: str, value: Pose | Vec) -> tuple[DataFrame, Pose | Vec]:
    """Materialise a pose or vector as flat columns before composing further.

    Nested compositions repeat their operands; a flat column that is used several times stays a
    projection of its own, which keeps generated code small.
    """
    if isinstance(value, Pose):
        cols = dict(zip((f"{prefix}_{c}" for c in POSE_COLUMNS), (*value.t, *value.q)))
        return df.withColumns(cols), Pose.of(prefix)
    cols = dict(zip((f"{prefix}_{c}" for c in "xyz"), value))
    return df.withColumns(cols), Vec.of(*cols)


def unstage(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*(f"{p}_{c}" for p in prefixes for c in [*POSE_COLUMNS, *"xyz"]))


POSE_COLUMNS = ["tx", "ty", "tz", "qw", "qx", "qy", "qz"]

Matrix = list[list[Column]]


def identity_quat() -> Quat:
    return Quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


def quat_normalize(q: Quat) -> Quat:
    n = F.sqrt(q.w * q.w + q.vec.dot(q.vec))
    return Quat(*(c / n for c in q))


def quat_mul(a: Quat, b: Quat) -> Quat:
    v = b.vec.times(a.w).plus(a.vec.times(b.w)).plus(a.vec.cross(b.vec))
    return Quat(a.w * b.w - a.vec.dot(b.vec), *v)


def quat_inv(q: Quat) -> Quat:
    return Quat(q.w, -q.x, -q.y, -q.z)


def quat_to_matrix(q: Quat) -> Matrix:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def matrix_to_quat(m: Matrix) -> Quat:
    """Largest-component extraction, sign chosen so that the largest component is positive."""
    trace = m[0][0] + m[1][1] + m[2][2]

    def root(c: Column) -> Column:
        return F.sqrt(F.greatest(c, F.lit(0.0))) * 2

    sw = root(1 + trace)
    sx, sy, sz = (root(1 + m[i][i] * 2 - trace) for i in range(3))
    xy, xz, yz = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    ax, ay, az = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    cases = [
        (trace > 0, (sw / 4, ax / sw, ay / sw, az / sw)),
        ((m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), (ax / sx, sx / 4, xy / sx, xz / sx)),
        (m[1][1] >= m[2][2], (ay / sy, xy / sy, sy / 4, yz / sy)),
    ]
    last = (az / sz, xz / sz, yz / sz, sz / 4)
    parts = []
    for k in range(4):
        expr = F.when(cases[0][0], cases[0][1][k])
        for cond, vals in cases[1:]:
            expr = expr.when(cond, vals[k])
        parts.append(expr.otherwise(last[k]))
    return Quat(*parts)


def mat_vec(m: Matrix, v: Vec) -> Vec:
    return Vec(*(row[0] * v.x + row[1] * v.y + row[2] * v.z for row in m))


def mat_mul(a: Matrix, b: Matrix) -> Matrix:
    return [[sum_(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def transpose(m: Matrix) -> Matrix:
    return [list(row) for row in zip(*m)]


def sum_(terms) -> Column:
    terms = list(terms)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def rotate(q: Quat, v: Vec) -> Vec:
    """``q v q⁻¹`` through two cross products."""
    u = q.vec.cross(v).times(2.0)
    return v.plus(u.times(q.w)).plus(q.vec.cross(u))


def transform(p: Pose, v: Vec) -> Vec:
    return rotate(p.q, v).plus(p.t)


def pose_compose(a: Pose, b: Pose) -> Pose:
    return Pose(quat_mul(a.q, b.q), rotate(a.q, b.t).plus(a.t))


def pose_inverse(a: Pose) -> Pose:
    qi = quat_inv(a.q)
    return Pose(qi, rotate(qi, a.t).times(-1.0))


def pose_between(a: Pose, b: Pose) -> Pose:
    """``a⁻¹ b``."""
    qi = quat_inv(a.q)
    return Pose(quat_mul(qi, b.q), rotate(qi, b.t.minus(a.t)))


def so3_exp(w: Vec, dt: Column | float = 1.0, eps: float = EXP_EPS) -> Quat:
    """Rotation by ``w·dt``; the identity when ``‖w‖ ≤ eps``."""
    n = w.norm()
    half = n * dt / 2.0
    k = F.when(n > eps, F.sin(half) / n).otherwise(0.0)
    return Quat(F.when(n > eps, F.cos(half)).otherwise(1.0), w.x * k, w.y * k, w.z * k)


def so3_log(m: Matrix) -> Vec:
    trace = m[0][0] + m[1][1] + m[2][2]
    safe = F.greatest(F.least((trace - 1) * 0.5, F.lit(1.0)), F.lit(-1.0))
    theta = F.when(trace > LOG_TRACE_GUARD, 0.0).otherwise(F.acos(safe))
    k = F.when(F.abs(theta) < LOG_SMALL_ANGLE, 0.5).otherwise(0.5 * theta / F.sin(theta))
    return Vec(m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]).times(k)


def quat_log(q: Quat) -> Vec:
    """Rotation vector of a unit quaternion, stable near the identity and up to π."""
    s = F.sqrt(q.vec.dot(q.vec))
    sign = F.when(q.w < 0, -1.0).otherwise(1.0)
    k = F.when(s < 1e-12, 2.0 * sign).otherwise(2.0 * F.atan2(s * sign, q.w * sign) / s)
    return q.vec.times(k)


def rpy_from_matrix(m: Matrix) -> Vec:
    """Roll, pitch, yaw of a Z-Y-X rotation; yaw is 0 at the gimbal."""
    sy = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    ok = sy >= GIMBAL_EPS
    roll = F.when(ok, F.atan2(m[2][1], m[2][2])).otherwise(F.atan2(-m[1][2], m[1][1]))
    return Vec(roll, F.atan2(-m[2][0], sy), F.when(ok, F.atan2(m[1][0], m[0][0])).otherwise(0.0))


def rpy_from_pose(p: Pose) -> Vec:
    return rpy_from_matrix(quat_to_matrix(p.q))


def quat_from_rpy(roll: Column, pitch: Column, yaw: Column) -> Quat:
    r, p, y = _d(roll) / 2, _d(pitch) / 2, _d(yaw) / 2
    cr, sr, cp, sp, cy, sy = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(y), F.sin(y)
    return Quat(
        cr * cp * cy + sr * sp * sy,
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
    )


def pose_from_rpy(t: Vec, roll: Column, pitch: Column, yaw: Column) -> Pose:
    return Pose(quat_from_rpy(roll, pitch, yaw), t)


def force_2d(p: Pose) -> Pose:
    """Keep x, y and yaw; zero roll, pitch and z."""
    yaw = rpy_from_pose(p).z
    return Pose(quat_from_rpy(F.lit(0.0), F.lit(0.0), yaw), Vec(p.t.x, p.t.y, F.lit(0.0)))


def pose_distance(a: Pose, b: Pose) -> tuple[Column, Column]:
    """Translation distance and rotation angle (radians) between two poses."""
    d = b.t.minus(a.t).norm()
    rel = quat_mul(quat_inv(a.q), b.q)
    return d, 2.0 * F.atan2(rel.vec.norm(), F.abs(rel.w))


def slerp(a: Quat, b: Quat, s: Column) -> Quat:
    """Shortest-arc interpolation; linear weights when the quaternions nearly coincide."""
    cosine = a.w * b.w + a.vec.dot(b.vec)
    mag = F.least(F.abs(cosine), F.lit(1.0))
    theta = F.acos(mag)
    near = mag >= 1.0 - 2.220446049250313e-16
    wa = F.when(near, 1.0 - s).otherwise(F.sin((1.0 - s) * theta) / F.sin(theta))
    wb = F.when(near, s).otherwise(F.sin(s * theta) / F.sin(theta))
    wb = F.when(cosine < 0, -wb).otherwise(wb)
    return Quat(*(p * wa + q * wb for p, q in zip(a, b)))


def stage_slerp(df: DataFrame, prefix: str, a: Quat, b: Quat, s: Column) -> tuple[DataFrame, tuple[Column, Column]]:
    """Slerp weights of both quaternions as columns (see :func:`slerp` and :func:`stage`)."""
    df = df.withColumn(f"{prefix}_c", a.w * b.w + a.vec.dot(b.vec))
    cosine = F.col(f"{prefix}_c")
    df = df.withColumn(f"{prefix}_t", F.acos(F.least(F.abs(cosine), F.lit(1.0))))
    theta = F.col(f"{prefix}_t")
    near = F.abs(cosine) >= 1.0 - 2.220446049250313e-16
    wa = F.when(near, 1.0 - s).otherwise(F.sin((1.0 - s) * theta) / F.sin(theta))
    wb = F.when(near, s).otherwise(F.sin(s * theta) / F.sin(theta))
    df = df.withColumns({f"{prefix}_a": wa, f"{prefix}_b": F.when(cosine < 0, -wb).otherwise(wb)})
    return df, (F.col(f"{prefix}_a"), F.col(f"{prefix}_b"))


def pose_mix(a: Pose, b: Pose, s: Column) -> Pose:
    """Slerp of the rotation, linear mix of the translation."""
    return Pose(slerp(a.q, b.q, s), a.t.times(1.0 - s).plus(b.t.times(s)))


def so3_left_jacobian_apply(w: Vec, v: Vec, inverse: bool = False) -> Vec:
    """``J(w) v`` (or ``J(w)⁻¹ v``) where J maps a twist to the translation of its exponential."""
    th2 = w.dot(w)
    th = F.sqrt(th2)
    small = th < 1e-5
    if inverse:
        half = th / 2.0
        b = F.when(small, 1.0 / 12.0).otherwise((1.0 - half * F.cos(half) / F.sin(half)) / th2)
        a: Column | float = -0.5
    else:
        a = F.when(small, 0.5).otherwise((1.0 - F.cos(th)) / th2)
        b = F.when(small, 1.0 / 6.0).otherwise((th - F.sin(th)) / (th2 * th))
    wv = w.cross(v)
    return v.plus(wv.times(a)).plus(w.cross(wv).times(b))


def se3_exp(rho: Vec, w: Vec) -> Pose:
    return Pose(so3_exp(w, 1.0, 1e-12), so3_left_jacobian_apply(w, rho))


def se3_log(p: Pose) -> tuple[Vec, Vec]:
    w = quat_log(p.q)
    return so3_left_jacobian_apply(w, p.t, inverse=True), w


def wrap_pi(a: Column) -> Column:
    """Angle in [−π, π]; values already inside are returned untouched."""
    inside = (a >= -math.pi) & (a <= math.pi)
    return F.when(inside, a).otherwise(a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi)))


def wrap_2pi(a: Column) -> Column:
    """Angle in (0, 2π]."""
    inside = (a > 0) & (a <= 2 * math.pi)
    return F.when(inside, a).otherwise(a - 2 * math.pi * (F.ceil(a / (2 * math.pi)) - 1))


def deg2rad(a: Column) -> Column:
    return a * math.pi / 180.0


def rad2deg(a: Column) -> Column:
    return a * 180.0 / math.pi


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.least(F.greatest(x, _d(lo)), _d(hi))


def ns_to_sec(t_ns: Column) -> Column:
    return t_ns / 1e9


def sec_to_stamp(t: Column) -> tuple[Column, Column]:
    """Whole seconds and the truncated nanosecond remainder."""
    sec = t.cast("int")
    return sec, ((t - sec) * 1e9).cast("int")


def sym3_rotate(c: list[Column], m: Matrix) -> list[Column]:
    """``R C Rᵀ`` of a symmetric matrix held as (xx, xy, xz, yy, yz, zz)."""
    full = [[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]
    out = mat_mul(mat_mul(m, full), transpose(m))
    return [out[0][0], out[0][1], out[0][2], out[1][1], out[1][2], out[2][2]]


def sym3_det(c: list[Column]) -> Column:
    xx, xy, xz, yy, yz, zz = c
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def sym3_inverse(c: list[Column]) -> list[Column]:
    """Inverse by the adjugate; null where the determinant is zero."""
    xx, xy, xz, yy, yz, zz = c
    det = sym3_det(c)
    det = F.when(det != 0, det)
    return [
        (yy * zz - yz * yz) / det,
        (xz * yz - xy * zz) / det,
        (xy * yz - xz * yy) / det,
        (xx * zz - xz * xz) / det,
        (xy * xz - xx * yz) / det,
        (xx * yy - xy * xy) / det,
    ]


def sym3_eigenvalues(c: list[Column]) -> list[Column]:
    """Ascending eigenvalues by the trigonometric closed form."""
    xx, xy, xz, yy, yz, zz = c
    q = (xx + yy + zz) / 3.0
    a, b, d = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + d * d + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0)
    det = sym3_det([a, xy, xz, b, yz, d])
    r = clamp(F.when(p > 0, det / (2.0 * p * p * p)).otherwise(0.0), -1.0, 1.0)
    phi = F.acos(r) / 3.0
    hi = q + 2.0 * p * F.cos(phi)
    lo = q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    return [lo, 3.0 * q - hi - lo, hi]


def add_sym3_inverse(df: DataFrame, c: list[Column], names: list[str]) -> DataFrame:
    """Add the six columns of the inverse; the determinant is computed once, as its own column."""
    named = df.withColumns({f"_i{k}": e for k, e in enumerate(c)})
    xx, xy, xz, yy, yz, zz = m = [F.col(f"_i{k}") for k in range(6)]
    det = sym3_det(m)
    named = named.withColumn("_det", F.when(det != 0, det))
    d = F.col("_det")
    inv = [
        (yy * zz - yz * yz) / d,
        (xz * yz - xy * zz) / d,
        (xy * yz - xz * yy) / d,
        (xx * zz - xz * xz) / d,
        (xy * xz - xx * yz) / d,
        (xx * yy - xy * xy) / d,
    ]
    return named.withColumns(dict(zip(names, inv))).drop("_det", *(f"_i{k}" for k in range(6)))


def add_solve3(df: DataFrame, m: list[Column], b: list[Column], names: list[str]) -> DataFrame:
    """Add the solution of a symmetric 3×3 system; null when singular."""
    tmp = [f"_n{k}" for k in range(6)]
    out = add_sym3_inverse(df, m, tmp)
    rows = [(0, 1, 2), (1, 3, 4), (2, 4, 5)]
    sol = {n: sum_(F.col(tmp[i]) * b[k] for k, i in enumerate(r)) for n, r in zip(names, rows)}
    return out.withColumns(sol).drop(*tmp)


def s2_gravity(a: Vec) -> Vec:
    """Gravity from a mean accelerometer reading: opposite direction, fixed length."""
    g = a.times(-1.0 * GRAVITY / a.norm())
    return g.times(S2_LENGTH / g.norm())
