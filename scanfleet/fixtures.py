"""Test and demo views derived from the base tables, as SQL text shared by Spark and DuckDB.

Coordinates are integer millimetres, so sums are exact in any order. ``{US}`` is the only
dialect difference (microseconds of a timestamp).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_US = {
    "spark": "unix_micros(CAST(ts AS TIMESTAMP))",
    "duckdb": "epoch_us(ts)",
}

VIEWS: dict[str, str] = {
    "points": """
        SELECT CAST(l_suppkey % 4 AS BIGINT) AS run_id, CAST(l_suppkey AS BIGINT) AS scan_id,
          CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS idx,
          CAST((l_orderkey*7919 + l_partkey*104729 + l_linenumber*31 + l_suppkey*17) % 20001 - 10000 AS BIGINT) AS x_mm,
          CAST((l_orderkey*15485863 + l_partkey*7907 + l_linenumber*17) % 20001 - 10000 AS BIGINT) AS y_mm,
          CAST(CASE WHEN l_linenumber <= 3 THEN -1200 + (l_orderkey*7919 + l_partkey*104729 + l_linenumber*31 + l_suppkey*17) % 61 - 30
               ELSE (l_orderkey*31 + l_partkey*13 + l_linenumber*101) % 3001 - 1200 END AS BIGINT) AS z_mm,
          CAST(l_linenumber - 1 AS BIGINT) AS ring, CAST(l_quantity AS BIGINT) AS intensity,
          CAST((l_partkey % 4) * 16 AS BIGINT) AS tag
        FROM lineitem
    """,
    "points_velodyne": """
        SELECT *, CASE WHEN scan_id % 2 = 0 THEN CAST(0 AS BIGINT) ELSE idx * 150 END AS time_us FROM points
    """,
    "points_ouster": """
        SELECT *, idx * 150000 AS t_ns FROM points
    """,
    "points_livox": """
        SELECT *, ring AS line, idx * 150000 AS offset_time FROM points
    """,
    "scans": """
        SELECT run_id, scan_id, count(*) AS n_points, scan_id * 100 AS t_begin_ms, scan_id * 100 + max(idx) * 150 / 1000e0 AS t_end_ms FROM points GROUP BY run_id, scan_id
    """,
    # A hall with a slanted wall and a corner of boxes, seen by every scan from a known pose (centimetre rotations are 3-4-5).
    "site_scans": """
        SELECT run_id, scan_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY scan_id) - 1 AS BIGINT) AS k,
          (scan_id % 5 - 2) * 1000 AS tx_mm, (scan_id % 3 - 1) * 1000 AS ty_mm,
          CASE scan_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 0 ELSE -6 END AS c10, CASE scan_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 10 ELSE 8 END AS s10
        FROM (SELECT DISTINCT CAST(floor(l_suppkey / 4e0) AS BIGINT) % 4 AS run_id, CAST(l_suppkey AS BIGINT) AS scan_id FROM lineitem) d
    """,
    "site_points": """
        SELECT s.run_id, s.scan_id, p.idx, s.k, p.wx AS wx_mm, p.wy AS wy_mm, p.wz AS wz_mm,
          (s.c10*(p.wx - s.tx_mm) + s.s10*(p.wy - s.ty_mm)) / 10e0 AS bx_mm, (s.c10*(p.wy - s.ty_mm) - s.s10*(p.wx - s.tx_mm)) / 10e0 AS by_mm, p.wz * 1e0 AS bz_mm
        FROM (SELECT scan_id, idx,
            CASE WHEN n <= 3 OR n = 5 THEN -12000 + 24*u WHEN n = 4 THEN 12000 WHEN n = 6 THEN -12000 + 4*u WHEN u < 500 THEN 3000 + 8*u ELSE 3000 END AS wx,
            CASE WHEN n <= 2 THEN -8000 + 16*v WHEN n = 3 THEN -8000 WHEN n = 5 THEN 8000 WHEN n = 4 OR n = 6 THEN -8000 + 16*u WHEN u < 500 THEN -3000 ELSE -7000 + 8*(u - 500) END AS wy,
            CASE WHEN n <= 2 THEN -1200 + u*v % 41 - 20 ELSE -1200 + 3*v END AS wz
          FROM (SELECT CAST(l_suppkey AS BIGINT) AS scan_id, l_linenumber AS n,
              CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS idx,
              CAST((l_orderkey*7919 + l_partkey*104729 + l_linenumber*31) % 1000 AS BIGINT) AS u, CAST((l_orderkey*15485863 + l_partkey*7907 + l_linenumber*17) % 1000 AS BIGINT) AS v FROM lineitem) a) p
        JOIN site_scans s ON s.scan_id = p.scan_id
    """,
    "imu": """
        SELECT event_id AS imu_id, user_id AS vehicle_id, {US} AS t_us,
          CAST(event_id*7919 % 201 - 100 AS BIGINT) AS gx_mrad, CAST(event_id*104729 % 201 - 100 AS BIGINT) AS gy_mrad, CAST(event_id*31 % 201 - 100 AS BIGINT) AS gz_mrad,
          CAST(event_id*17 % 401 - 200 AS BIGINT) AS ax_mms2, CAST(event_id*13 % 401 - 200 AS BIGINT) AS ay_mms2, CAST(9810 + event_id*101 % 401 - 200 AS BIGINT) AS az_mms2
        FROM events WHERE event_type <> 'view'
    """,
    "scan_stamps": """
        SELECT event_id AS scan_id, user_id AS vehicle_id, {US} AS t_us FROM events WHERE event_type = 'view'
    """,
    "loc_results": """
        SELECT user_id AS vehicle_id, event_id AS seq, {US} AS t_us, value / 100e0 AS score, event_type <> 'error' AS ok, event_type = 'signup' AS parking,
          CAST(event_id*7919 % 2001 - 1000 AS BIGINT) AS x_mm, CAST(event_id*104729 % 2001 - 1000 AS BIGINT) AS y_mm FROM events
    """,
    "messages": """
        SELECT event_id % 3 AS log_id, event_id AS seq, concat('/', event_type) AS topic, {US} * 1000 AS t_ns, props AS payload FROM events
    """,
    "timings": """
        SELECT event_type AS name, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS seq, value AS ms FROM events
    """,
    "keyframes": """
        SELECT run_id, kf_id, kf_id * 1000 AS t_ms, x_mm, y_mm, CAST(jz AS BIGINT) AS z_mm,
          CAST(CASE side WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS BIGINT) AS r00, CAST(CASE side WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS BIGINT) AS r10,
          x_mm + kf_id * 2 AS ox_mm, y_mm - kf_id AS oy_mm, CAST(jz AS BIGINT) AS oz_mm
        FROM (SELECT run_id, kf_id, side, jz,
           CAST(CASE side WHEN 0 THEN s*2000 WHEN 1 THEN 100000 WHEN 2 THEN 300000 - s*2000 ELSE 0 END + jx AS BIGINT) AS x_mm,
           CAST(CASE side WHEN 0 THEN 0 WHEN 1 THEN s*2000 - 100000 WHEN 2 THEN 100000 ELSE 400000 - s*2000 END + jy AS BIGINT) AS y_mm
          FROM (SELECT run_id, kf_id, kf_id % 200 AS s, CAST(floor((kf_id % 200) / 50e0) AS BIGINT) AS side,
             o_orderkey*7919 % 401 - 200 AS jx, o_orderkey*104729 % 401 - 200 AS jy, o_orderkey*31 % 101 - 50 AS jz
            FROM (SELECT CAST(o_orderkey % 16 AS BIGINT) AS run_id, o_orderkey,
               CAST(row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) - 1 AS BIGINT) AS kf_id FROM orders) a) b) c
    """,
    "kf_points": """
        SELECT scan_id % 16 AS run_id, CAST(floor(scan_id / 16e0) AS BIGINT) * 10 AS kf_id, idx, x_mm, y_mm, z_mm, intensity FROM points
    """,
    "pose_queries": """
        SELECT run_id, kf_id * 10 AS q_id, t_ms + 370 AS t_ms FROM keyframes WHERE kf_id % 7 = 0
        UNION ALL SELECT run_id, kf_id * 10 + 1, t_ms FROM keyframes WHERE kf_id % 11 = 0
        UNION ALL SELECT run_id, CAST(-1 AS BIGINT), CAST(-400 AS BIGINT) FROM keyframes WHERE kf_id = 0
        UNION ALL SELECT run_id, CAST(-2 AS BIGINT), CAST(-600 AS BIGINT) FROM keyframes WHERE kf_id = 0
        UNION ALL SELECT run_id, CAST(-3 AS BIGINT), max(t_ms) + 200 FROM keyframes GROUP BY run_id
        UNION ALL SELECT run_id, CAST(-4 AS BIGINT), max(t_ms) + 900 FROM keyframes GROUP BY run_id
    """,
    "graph_vertices": """
        SELECT run_id * 1000000 + kf_id AS v_id, run_id, x_mm, y_mm, z_mm, r00, r10 FROM keyframes
    """,
    "graph_edges": """
        SELECT a.run_id, a.run_id*1000000 + a.kf_id AS v0, b.run_id*1000000 + b.kf_id AS v1, CASE WHEN b.kf_id - a.kf_id = 200 THEN 'loop' ELSE 'odom' END AS etype,
          b.ox_mm - a.ox_mm AS mx_mm, b.oy_mm - a.oy_mm AS my_mm, b.oz_mm - a.oz_mm AS mz_mm, CAST(0 AS BIGINT) AS level
        FROM keyframes a JOIN (SELECT kf_id - 1 AS ka, * FROM keyframes UNION ALL SELECT kf_id - 2 AS ka, * FROM keyframes UNION ALL SELECT kf_id - 200 AS ka, * FROM keyframes) b
          ON a.run_id = b.run_id AND a.kf_id = b.ka
    """,
    "dyn_areas": """
        SELECT CAST(r_regionkey AS BIGINT) AS area_id, v.k AS k, CAST(r_regionkey*3000 - 7000 + v.dx AS BIGINT) AS x_mm, CAST(r_regionkey*2000 - 5000 + v.dy AS BIGINT) AS y_mm
        FROM region CROSS JOIN (SELECT 0 AS k, 0 AS dx, 0 AS dy UNION ALL SELECT 1, 4000, 500 UNION ALL SELECT 2, 4500, 4000 UNION ALL SELECT 3, 500, 3500) v
    """,
    "bal_obs": """
        SELECT DISTINCT CAST(l_suppkey % 10 AS BIGINT) AS cam_id, CAST(l_partkey AS BIGINT) AS pt_id, CAST((l_suppkey % 10)*31 + l_partkey*17 AS BIGINT) % 401 - 200 AS u, CAST((l_suppkey % 10)*13 + l_partkey*7 AS BIGINT) % 401 - 200 AS v FROM lineitem
    """,
    "bal_points": """
        SELECT CAST(p_partkey AS BIGINT) AS pt_id, CAST(p_partkey*7919 % 3001 - 1500 AS BIGINT) AS x_mm, CAST(p_partkey*104729 % 3001 - 1500 AS BIGINT) AS y_mm, CAST(-10000 - p_partkey*31 % 1001 AS BIGINT) AS z_mm FROM part
    """,
    "bal_cams": """
        SELECT DISTINCT CAST(s_suppkey % 10 AS BIGINT) AS cam_id, CAST(s_suppkey % 10 AS BIGINT) * 40 - 200 AS tx_mm, CAST(500 AS BIGINT) AS f, CAST(s_suppkey % 10 AS BIGINT) AS k1_e4, CAST(1 AS BIGINT) AS k2_e6 FROM supplier
    """,
    "circle_samples": """
        SELECT CAST(c_nationkey AS BIGINT) AS grp, CAST(c_custkey AS BIGINT) AS id,
          4e0 + (2e0 + n) * (1e0 - u*u) / (1e0 + u*u) AS x, 2e0 + (2e0 + n) * 2e0 * u / (1e0 + u*u) AS y
        FROM (SELECT c_nationkey, c_custkey, (c_custkey*7 % 41 - 20) / 10e0 AS u, (c_custkey*7919 % 11 - 5) / 100e0 AS n FROM customer) t
    """,
}


def _words(sql: str) -> set[str]:
    return set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql, flags=re.IGNORECASE))


def _closure(names: list[str]) -> list[str]:
    """``names`` and the views they are built from, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in sorted(_words(VIEWS[name])):
                visit(dep)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _ctes(names: list[str], dialect: str) -> list[str]:
    return [
        f"{name} AS ({VIEWS[name].strip().replace('{US}', _US[dialect])})"
        for name in _closure(names)
    ]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view (or base table) over the parquet files in ``sf_dir``."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set().union(*(_words(VIEWS[n]) for n in _closure([name])))
    base = [
        f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in BASE_TABLES if t in used
    ]
    return spark.sql(f"WITH {', '.join(base + _ctes([name], 'spark'))} SELECT * FROM {name}")


def oracle(body: str) -> str:
    """DuckDB text for ``body``, which may name views and start with its own WITH."""
    body = body.strip()
    ctes = _ctes(sorted(_words(body) & VIEWS.keys()), "duckdb")
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
