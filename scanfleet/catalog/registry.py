"""Registered queries: a Spark builder and, where SQL can say it, the same result as DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet import fixtures
from scanfleet.functions import geom

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` names fixture views and is expanded to full DuckDB text."""

    def wrap(build: Build) -> Build:
        ENTRIES[name] = Entry(name, build, fixtures.oracle(sql) if sql else None)
        return build

    return wrap


def r6(expr: Column | str) -> Column:
    """Six decimals by ``floor(x·10⁶ + ½)``: plain IEEE steps, the same in both engines."""
    c = F.col(expr) if isinstance(expr, str) else expr
    return F.floor(c * 1e6 + 0.5) / 1e6


def q6(expr: str) -> str:
    """DuckDB text of :func:`r6`."""
    return f"(floor(({expr}) * 1e6 + 0.5e0) / 1e6)"


def view(spark: SparkSession, sf: str, name: str, metres: bool = False) -> DataFrame:
    """A fixture view with ``*_mm`` columns as ``x, y, z`` (integer mm, or metres)."""
    df = fixtures.view(spark, sf, name)
    for c in df.columns:
        if c in ("x_mm", "y_mm", "z_mm"):
            df = df.withColumn(c, F.col(c) / 1000.0) if metres else df
            df = df.withColumnRenamed(c, c[0])
    return df


def keyframe_poses(spark: SparkSession, sf: str, opt: bool = False, metres: bool = True) -> DataFrame:
    """Keyframes with pose columns; ``opt`` takes the drifted (optimised) translation."""
    kf = fixtures.view(spark, sf, "keyframes")
    k = 1000.0 if metres else 1.0
    src = ("ox_mm", "oy_mm", "oz_mm") if opt else ("x_mm", "y_mm", "z_mm")
    # Half-angle of the quarter turn by square roots, which every engine rounds alike.
    qw = F.sqrt((1 + F.col("r00")) / 2.0)
    qz = F.sqrt((1 - F.col("r00")) / 2.0) * F.when(F.col("r10") < 0, -1.0).otherwise(1.0)
    pose = geom.Pose(
        geom.Quat(qw, F.lit(0.0), F.lit(0.0), qz), geom.Vec(*(F.col(c) / k for c in src))
    )
    return kf.select("run_id", "kf_id", "t_ms", *pose.columns())
