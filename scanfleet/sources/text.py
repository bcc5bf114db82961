"""Pose-graph and bundle-adjustment text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfleet.functions import geom

# Fixed values of the formats.
VERTEX3, EDGE3, VERTEX2, EDGE2 = "VERTEX_SE3:QUAT", "EDGE_SE3:QUAT", "VERTEX_SE2", "EDGE_SE2"
ROTATION_INFO_SCALE = 0.25
CAMERA_FIELDS = ["rx", "ry", "rz", "tx", "ty", "tz", "f", "k1", "k2"]


def numbered_text(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """Lines with ``file`` and 0-based ``line_no``, without funnelling a file through one task.

    Lines are counted per file block; block offsets (one row per block) turn the position inside a
    block into a line number. With ``together`` the part files of a folder are one text in name order.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        "value", (F.lit(path) if together else file).alias("file"), file.alias("_part"),
        F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"),
    )
    key = ["file", "_part", "_b"]
    blocks = lines.groupBy(*key).agg(F.min("_i").alias("_i0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_part", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = lines.join(blocks, key)
    return out.select("file", (F.col("_off") + F.col("_i") - F.col("_i0")).alias("line_no"), "value")


def _mirrored(values: Column, first: int, n: int) -> Column:
    """Full n×n matrix (row major) from its upper triangle that starts at ``values[first]``."""
    place = {}
    k = first
    for i in range(n):
        for j in range(i, n):
            place[i, j] = place[j, i] = k
            k += 1
    cells = []
    for i in range(n):
        for j in range(n):
            cell = values[place[i, j]].cast("double")
            cells.append(cell * ROTATION_INFO_SCALE if n == 6 and i >= 3 and j >= 3 else cell)
    return F.array(*cells)


def read_graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a pose-graph file; planar rows become poses with a yaw-only rotation."""
    part = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).select(part.alias("p"))
    d = lambda i: F.col("p")[i].cast("double")
    n = lambda i: F.col("p")[i].cast("bigint")

    def pose(first: int, planar: bool) -> list[Column]:
        if planar:
            q = geom.quat_from_rpy(F.lit(0.0), F.lit(0.0), d(first + 2))
            return geom.Pose(q, geom.Vec(d(first), d(first + 1), F.lit(0.0))).columns()
        q = geom.Quat(d(first + 6), d(first + 3), d(first + 4), d(first + 5))
        return geom.Pose(q, geom.Vec(*(d(first + k) for k in range(3)))).columns()

    def tagged(tag: str) -> DataFrame:
        return rows.filter(F.col("p")[0] == tag)

    vertices = tagged(VERTEX3).select(n(1).alias("v_id"), *pose(2, False)).unionByName(
        tagged(VERTEX2).select(n(1).alias("v_id"), *pose(2, True))
    )
    edges = tagged(EDGE3).select(
        F.lit("se3").alias("etype"), n(1).alias("v0"), n(2).alias("v1"), *pose(3, False), _mirrored(F.col("p"), 10, 6).alias("info")
    ).unionByName(
        tagged(EDGE2).select(
            F.lit("se2").alias("etype"), n(1).alias("v0"), n(2).alias("v1"), *pose(3, True), _mirrored(F.col("p"), 6, 3).alias("info")
        )
    )
    return vertices, edges


def write_graph_text(vertices: DataFrame, edges: DataFrame, path: str) -> str:
    """Write SE3 vertices and edges; quaternions x y z w, so a written file reads back unchanged."""
    order = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    v = vertices.select(F.concat_ws(" ", F.lit(VERTEX3), "v_id", *order).alias("value"))
    upper = [
        F.col("info")[i * 6 + j] / (ROTATION_INFO_SCALE if i >= 3 and j >= 3 else 1.0) for i in range(6) for j in range(i, 6)
    ]
    e = edges.select(F.concat_ws(" ", F.lit(EDGE3), "v0", "v1", *order, *upper).alias("value"))
    v.unionByName(e).write.mode("overwrite").text(path)
    return path


def write_bal(obs: DataFrame, cams: DataFrame, points: DataFrame, path: str) -> str:
    """Write a bundle-adjustment problem as text; part files in name order form the sequence.

    ``cams`` has ``cam_id`` and the nine camera fields, ``points`` has ``pt_id, x, y, z``; ids count
    from 0 without gaps. The sections are globally sorted by id before writing.
    """
    counts = [df.count() for df in (cams, points, obs)]
    spark = obs.sparkSession
    head = spark.range(1).select(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(" ".join(map(str, counts))).alias("value"))
    o = obs.select(F.lit(1).alias("s"), F.col("cam_id").alias("a"), F.col("pt_id").alias("b"), F.concat_ws(" ", "cam_id", "pt_id", "u", "v").alias("value"))
    c = cams.select(F.lit(2).alias("s"), F.col("cam_id").alias("a"), F.posexplode(F.array(*(F.col(f).cast("double") for f in CAMERA_FIELDS))).alias("b", "x"))
    p = points.select(F.lit(3).alias("s"), F.col("pt_id").alias("a"), F.posexplode(F.array(*(F.col(f).cast("double") for f in "xyz"))).alias("b", "x"))
    vals = [d.select("s", "a", F.col("b").cast("bigint").alias("b"), F.col("x").cast("string").alias("value")) for d in (c, p)]
    out = head.unionByName(o).unionByName(vals[0]).unionByName(vals[1])
    out.orderBy("s", "a", "b").select("value").write.mode("overwrite").text(path)
    return path


def read_bal(
    spark: SparkSession, path: str, together: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, cameras, points) of bundle-adjustment text files, keyed by ``file``.

    The header says how many lines each section has; sections are ranges of line numbers.
    """
    lines = numbered_text(spark, path, together).withColumn("p", F.split(F.trim("value"), "\\s+"))
    head = lines.filter("line_no = 0").select(
        "file", *(F.get("p", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("_cams", "_pts", "_obs")))
    )
    body = lines.filter("line_no > 0").join(head, "file").withColumn("i", F.col("line_no") - 1 - F.col("_obs"))
    p = [F.get("p", F.lit(i)) for i in range(4)]
    obs = body.filter("i < 0").select(
        "file", p[0].cast("bigint").alias("cam_id"), p[1].cast("bigint").alias("pt_id"), p[2].cast("double").alias("u"), p[3].cast("double").alias("v")
    )

    def section(rows: DataFrame, start: Column, width: int, key: str, names: list[str]) -> DataFrame:
        j = F.col("i") - start
        keyed = rows.select("file", F.floor(j / width).cast("bigint").alias(key), (j % width).alias("k"), p[0].cast("double").alias("x"))
        return keyed.groupBy("file", key).agg(*(F.max(F.when(F.col("k") == i, F.col("x"))).alias(n) for i, n in enumerate(names)))

    nine = F.col("_cams") * 9
    cams = section(body.filter((F.col("i") >= 0) & (F.col("i") < nine)), F.lit(0), 9, "cam_id", CAMERA_FIELDS)
    q = geom.so3_exp(geom.Vec.of("rx", "ry", "rz"), 1.0, 1e-12)
    cams = cams.withColumns(dict(zip(("qw", "qx", "qy", "qz"), q))).drop("rx", "ry", "rz")
    points = section(body.filter(F.col("i") >= nine), nine, 3, "pt_id", ["x", "y", "z"])
    return obs, cams, points
