"""Split windows, kNN levels, folds and raster rules against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanfleet.functions import geom, keys
from scanfleet.operators import aggregate as A
from scanfleet.operators import joins, ordered, raster, retain, windows
from scanfleet.operators.ordered import Carry
from scanfleet.session import scratch_path
from scanfleet.streaming import flows, folds


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 5, n)), "t": np.arange(n), "v": rng.integers(0, 50, n)})
    pdf["m"] = [float(v) if v % 3 == 0 else None for v in pdf["v"]]
    return spark.createDataFrame(pdf)


def test_split_windows_equal_plain_windows(series):
    kinds = ["count", "total", "sum", "max_before", "min_before", "last", "last_before", "next", "next_after"]
    carries = [Carry(f"c_{k}", k, None if k in ("count", "total") else F.col("v") if k == "sum" else F.col("m")) for k in kinds]
    plain = ordered.running(series, ["k"], ["t"], 40, carries, split=False)
    cut = ordered.running(series, ["k"], ["t"], 40, carries, split=True)
    a = plain.toPandas().sort_values("t").reset_index(drop=True)
    b = cut.toPandas().sort_values("t").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_split_windows_keep_null_keys_and_times(spark):
    rng = np.random.default_rng(8)
    rows = [
        (None if i % 7 == 0 else int(rng.integers(0, 3)), None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i // 2), i, int(v) if v % 3 else None)
        for i, v in enumerate(rng.integers(0, 50, 300))
    ]
    df = spark.createDataFrame(rows, "k long, t double, i long, v long")
    kinds = ["count", "total", "sum", "max_before", "min_before", "last", "last_before", "next", "next_after"]
    carries = [Carry(f"c_{k}", k, None if k in ("count", "total") else F.col("v")) for k in kinds]
    plans = [ordered.running(df, ["k"], ["t", "i"], 40, carries, split=s).toPandas().sort_values("i").reset_index(drop=True) for s in (False, True)]
    assert len(plans[1]) == len(rows)
    pd.testing.assert_frame_equal(plans[0], plans[1][plans[0].columns], check_dtype=False)


def test_order_stats_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (None, 2), (1, 9), (1, None)], "k long, v long")
    for split in (True, False):
        got = {r.k: r.med for r in ordered.order_stats(df, ["k"], "v", {"med": F.floor(F.col("n") / 2)}, 16, split=split).collect()}
        assert got == {None: 2, 1: 9}


def test_building_a_running_plan_starts_no_job(spark):
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("plan", "plan only")
    windows.path_length(spark.range(9).selectExpr("id as run_id", "id as t", "0D as tx", "0D as ty", "0D as tz"), ["run_id"], ["t"], 10.0)
    assert not seen("plan")
    spark.sparkContext.setJobGroup("other", "other")


def test_order_stats_split_equals_sort(series):
    picks = {"med": F.floor(F.col("n") / 2), "hi": F.floor(F.col("n") * 0.9)}
    got = {r.k: (r.med, r.hi) for r in ordered.order_stats(series, ["k"], "v", picks, 16, split=True).collect()}
    for k, g in series.toPandas().groupby("k"):
        s = sorted(g["v"])
        assert got[k] == (s[len(s) // 2], s[int(len(s) * 0.9)])


def test_knn_levels_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    dense = rng.integers(0, 60, (300, 3))
    wide = rng.integers(-900, 900, (200, 3))
    pts = np.vstack([dense, wide, np.repeat([[10, 10, 10]], 40, axis=0)])
    m = spark.createDataFrame(pd.DataFrame(pts, columns=list("xyz")).assign(map_id=np.arange(len(pts))))
    q = pts[::9] + 3
    qs = spark.createDataFrame(pd.DataFrame(q, columns=list("xyz")).assign(q=np.arange(len(q))))
    near = lambda dense: {
        (r.q, r["rank"]): (r.map_id, r.d2) for r in joins.knn(qs, m, ["q"], "map_id", 4, 400.0, 200.0, 27, dense=dense).collect()
    }
    want = {}
    cell = lambda a: np.sign(a) * np.floor(np.abs(a) / 200.0 + 0.5)
    for i, p in enumerate(q):
        d2 = ((pts - p) ** 2).sum(axis=1)
        ok = (np.abs(cell(pts.astype(float)) - cell(p.astype(float))).max(axis=1) <= 1) & (d2 < 400.0**2)
        best = sorted((d2[j], j) for j in np.where(ok)[0])[:4]
        for r, (d, j) in enumerate(best, 1):
            want[i, r] = (j, d)
    assert near(10_000) == want
    assert near(30) == want


def test_knn_shares_a_crowded_cell_and_streams_over_batches(spark):
    rng = np.random.default_rng(7)
    pts, q = rng.integers(-300, 300, (150, 3)), rng.integers(-90, 90, (700, 3))
    m = spark.createDataFrame(pd.DataFrame(pts, columns=list("xyz")).assign(map_id=[f"m{i:03}" for i in range(len(pts))]))
    qs = spark.createDataFrame(pd.DataFrame(q, columns=list("xyz")).assign(q=np.arange(len(q))))
    want = {}
    for i, p in enumerate(q):
        d2 = ((pts - p) ** 2).sum(axis=1)
        for r, (d, j) in enumerate(sorted((d2[j], j) for j in np.flatnonzero(d2 < 150**2))[:3], 1):
            want[i, r] = (f"m{j:03}", d)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
        near = joins.knn_lists(qs, m, ["q"], "map_id", 3, 150.0, 200.0, 27, share=50)
        got = {(r.q, i): (n.map_id, n.d2) for r in near.collect() for i, n in enumerate(r.near, 1)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == want


def test_plane_fit_and_admission_take_arrays_and_rows(spark):
    rng = np.random.default_rng(3)
    xy = rng.integers(1000, 3000, (60, 2))
    pts = np.column_stack([xy, 500 + rng.integers(-5, 6, 60)])
    m = spark.createDataFrame(pd.DataFrame(pts, columns=list("xyz")).assign(map_id=np.arange(60)))
    qs = m.selectExpr("map_id AS q", "x + 3 AS x", "y", "z")
    args = (qs, m, ["q"], "map_id", 5, 2000.0, 500.0, 27)
    forms = joins.knn_lists(*args), joins.knn(*args)
    plane = lambda near: sorted(tuple(r) for r in A.plane_fit(near, ["q"], 0.1, 1e-3).collect())
    taken = lambda near: sorted(r.q for r in retain.admit_points(qs, near, ["q"], 500.0, 1.0).collect())
    assert plane(forms[0]) == plane(forms[1]) and taken(forms[0]) == taken(forms[1])
    near = {r.q: np.array([[n.nx, n.ny, n.nz] for n in r.near]) / 1000.0 for r in forms[0].collect()}
    fits = A.plane_fit(forms[0], ["q"], 0.1, 1e-3).collect()
    assert len(fits) > 40
    for r in fits:
        w = np.linalg.lstsq(near[r.q], -np.ones(len(near[r.q])), rcond=None)[0]
        want = np.append(w, 1.0) / np.linalg.norm(w)
        assert r.n == len(near[r.q]) and np.allclose([r.pa, r.pb, r.pc, r.pd], want, atol=1e-3)


def test_hilbert_neighbours_touch(spark):
    side = 8
    rows = [(x, y, z) for x in range(side) for y in range(side) for z in range(side)]
    df = spark.createDataFrame(rows, ["x", "y", "z"])
    got = df.select("*", keys.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(side**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(got, got[1:]))


def test_keyframes_batch_equals_loop(spark):
    rng = np.random.default_rng(8)
    xy = np.cumsum(rng.normal(0, 0.7, (200, 2)), axis=0)
    rows = [(int(i % 2), float(i), float(x), float(y), 0.0, 1.0, 0.0, 0.0, 0.0) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, ["run_id", "t", "tx", "ty", "tz", "qw", "qx", "qy", "qz"])
    got = {(r.run_id, r.t) for r in windows.select_keyframes(df, ["run_id"], "t", 2.0).collect()}
    want, last = set(), {}
    for r in rows:
        p = np.array(r[2:4])
        if r[0] not in last or np.linalg.norm(p - last[r[0]]) > 2.0:
            last[r[0]] = p
            want.add((r[0], r[1]))
    assert got == want


def test_occupancy_split_equals_fold(spark):
    rng = np.random.default_rng(9)
    rows = [(0, int(c), 0, int(t), int(p), int(i), float(h)) for i, (c, t, p, h) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), rng.integers(0, 2, 300), rng.integers(1, 30, 300)))]
    df = spark.createDataFrame(rows, ["run_id", "cx", "cy", "t", "phase", "i", "h"])
    out = raster.occupancy_exact(df, ["run_id"]).collect()
    rule = folds.occupancy()
    cells = rule.start()
    for r in sorted(rows, key=lambda r: r[3:6]):
        cells, _ = rule.step(cells, (r[1], r[2], r[4], r[6]))
    assert {(r.cx, r.cy): (r.hit, r.visit, r.height) for r in out} == cells


def test_rest_and_smoothing_rules():
    rule = folds.dead_reckoning()
    state = rule.start()
    for i in range(50):
        state, out = rule.step(state, (i * 0.01, 0, 0, 0, 0, 0, 9.81))
    assert out[0] == 0 and np.allclose(out[1:4], 0, atol=1e-9)
    fuse = folds.fusion()
    state = fuse.start()
    for i in range(12):
        pose = [0.5 * i, 0, 0, 1, 0, 0, 0]
        state, out = fuse.step(state, [*pose, *pose, 1.0])
    assert np.allclose(out[:3], pose[:3], atol=1e-9)
    assert math.isclose(np.linalg.norm(out[3:]), 1.0, rel_tol=1e-9)


def test_entry_and_registry(spark, sf):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_every_loop_has_its_submap_and_every_near_pair_is_counted(spark):
    from scanfleet import fixtures
    from scanfleet.catalog import ENTRIES

    run = lambda name: ENTRIES[name].build(spark, "/root/testdata/sf0.01")
    centres = {(r[0], r[1]) for r in run("j9_loop_candidates").select("run_id", "kf1").distinct().collect()}
    made = {(r[0], r[1]) for r in run("j10_loop_submaps").select("run_id", "kf1").distinct().collect()}
    clouds = fixtures.view(spark, "/root/testdata/sf0.01", "kf_points").select("run_id", "kf_id").distinct().collect()
    having = {(r[0], r[1]) for r in clouds}
    assert made == {(r, k) for r, k in centres if any((r, k + o) in having for o in range(-40, 37, 4))}
    assert any(k % 100 != 50 for _, k in made)
    wide = run("j9_loop_ranges").groupBy().sum("n").first()[0]
    assert wide > run("j9_loop_pairs").count()


def test_poses_meet_their_tiles_before_they_are_multiplied(spark):
    rng = np.random.default_rng(3)
    poses = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (200, 2)))]
    tiles = [(x, y) for x in range(-3, 4) for y in range(-3, 4) if (x + y) % 3] + [(1, 1)]  # one tile is listed twice
    df = spark.createDataFrame(poses, "kf_id bigint, x double, y double")
    out = joins.tiles_near(df, spark.createDataFrame(tiles, "gx bigint, gy bigint"), 2, 100.0)
    home = {i: (math.floor(x / 100 + 0.5), math.floor(y / 100 + 0.5)) for i, x, y in poses}
    want = [(i, gx, gy) for i, (hx, hy) in home.items() for gx, gy in tiles if abs(gx - hx) + abs(gy - hy) <= 2]
    assert sorted((r.kf_id, r.gx, r.gy) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_near") < plan.index("Join Inner")  # the join lies below


def test_small_groups_are_ordered_whole_and_large_ones_in_buckets(spark):
    rng = np.random.default_rng(9)
    rows = [(None if k == 3 else k, float(v)) for k, n in ((0, 700), (1, 40), (2, 1), (3, 25)) for v in rng.integers(0, 90, n)] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    picks = {"med": F.floor(F.col("n") / 2), "top": F.col("n") - 1}
    values = {}
    for k, v in rows:
        values.setdefault(k, []).extend([v] if v is not None else [])
    want = {k: (sorted(v)[len(v) // 2], max(v)) for k, v in values.items() if v}
    for whole in (0, 50, 20_000):
        got = ordered.order_stats(df, ["k"], "v", picks, 16, whole=whole).collect()
        assert {r.k: (r.med, r.top) for r in got} == want


def test_hilbert_steps_are_not_repeated_for_each_bit(spark):
    df = spark.range(1).select(*(F.col("id").alias(c) for c in "xyz"))
    plan = df.select(keys.hilbert_index([F.col(c) for c in "xyz"], 9))._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") < 1000  # 13,810 where each of the 27 bits worked out the flips


def test_loops_are_swept_without_pairs(spark):
    """Laps with exact border distances, coincident and parked keyframes, several blocks and parts of ids."""
    from functools import partial

    from scanfleet.operators.sweep import Counts, Picks, sweep

    rng = np.random.default_rng(11)
    rows = []
    for run, n in ((0, 900), (1, 60), (2, 1)):
        lap = np.arange(n) % 120
        x = np.where(lap < 60, lap, 119 - lap) * 2.0 + rng.integers(-1, 2, n)
        x[n // 4 : n // 3] = 4.0
        y = np.where(lap < 60, 0.0, 5.0)
        rows += [(run, int(3 * i - 40), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    kf = spark.createDataFrame([*rows, (None, 5, 0.0, 0.0)], "run_id bigint, kf_id bigint, tx double, ty double")
    near = {}
    for run, k2, x2, y2 in rows:
        near[run, k2] = [k1 for r, k1, x1, y1 in rows if r == run and k2 - k1 >= 60 and (x2 - x1) ** 2 + (y2 - y1) ** 2 < 900.0]
    near = {k: v for k, v in near.items() if v}
    limits = {"radius": 30.0, "min_age": 60}
    for shape in ({"part_ids": 1 << 20, "block": 1 << 18}, {"part_ids": 500, "block": 70}):
        got = sweep(kf, kf, ["run_id"], visit=partial(Counts, any_=False, **limits), columns=Counts.columns, **limits, **shape).collect()
        assert sorted(map(tuple, got)) == sorted((r, k, len(v), min(v), max(v)) for (r, k), v in near.items())
        some = sweep(kf, kf, ["run_id"], visit=partial(Counts, any_=True, **limits), columns=Counts.columns, **limits, **shape).collect()
        assert sorted((r.run_id, r.kf2) for r in some) == sorted(near)
        want = set()
        for (r, k), v in near.items():
            last = None
            for k1 in v:
                if last is None or k1 - last > 20:
                    last = k1
                    want.add((r, k, k1))
        got = sweep(kf, kf, ["run_id"], visit=partial(Picks, skip=20, **limits), columns=Picks.columns, **limits, **shape).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    # Far more pairs than rows may be made of: two million within the radius.
    stood = spark.range(2100).select(F.lit(0).alias("run_id"), F.col("id").alias("kf_id"), F.lit(1.0).alias("tx"), F.lit(2.0).alias("ty"))
    plan = joins.loop_ranges(stood, radius=30.0)
    assert "_x1" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.groupBy().sum("n").first()[0] == sum(range(2051))


def test_spread_selection_equals_the_fold(spark):
    """One long track, several short ones, a null key and a parked stretch; more ranges than keys."""
    rng = np.random.default_rng(5)
    rows = []
    for key, n in [(1, 3000), (2, 7), (3, 1), (None, 400)]:
        steps = rng.normal(0.3, 0.4, n)
        steps[n // 3 : n // 2] = 0.0
        x, yaw = np.cumsum(steps), np.cumsum(rng.normal(0, 0.05, n))
        rows += [(key, i, float(x[i]), 0.0, 0.0, float(np.cos(yaw[i] / 2)), 0.0, 0.0, float(np.sin(yaw[i] / 2))) for i in range(n)]
    poses = spark.createDataFrame(rows, ["run_id", "t", *geom.POSE_COLUMNS]).repartition(7)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = windows.select_keyframes(poses, ["run_id"], "t", 2.0, 15.0)
        assert got.rdd.getNumPartitions() == 16
        parts = got.withColumn("p", F.spark_partition_id()).filter("run_id = 1").select("p").distinct().count()
        assert parts > 8  # the long key is in no single task
        got = {(r["run_id"], r["t"]) for r in got.select("run_id", "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    want, rule = set(), windows.keyframe_step(2.0, np.radians(15.0), None)
    for key in {r[0] for r in rows}:
        state = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            state, (take,) = rule(state, np.array(r[1:], float))
            if take:
                want.add((key, r[1]))
    assert got == want
    assert windows.select_keyframes(poses.filter("false"), ["run_id"], "t").count() == 0


def test_fusion_follows_a_turning_track():
    """A tight circle with a heading error at the start: rotation and translation must be solved together."""
    rng = np.random.default_rng(2)
    fuse, errors = folds.fusion(), []
    state, drift = fuse.start(), np.array([5.0, -3.0, 0.0, *folds.qexp(np.array([0.0, 0.0, 1.1]))])
    for i in range(80):
        a = 0.15 * i
        pose = np.concatenate([[4 * np.cos(a), 4 * np.sin(a), 0.02 * i], folds.qexp(np.array([0.0, 0.0, a + np.pi / 2]))])
        loc = np.concatenate([pose[:3] + rng.normal(0, 0.3, 3), folds.qmul(pose[3:], folds.qexp(rng.normal(0, 0.02, 3)))])
        state, out = fuse.step(state, [*loc, *folds.compose(drift, pose), 0.9])
        errors.append(np.linalg.norm(np.array(out[:3]) - pose[:3]))
    assert len(state[0]) == 4 and state[1][0].shape == (24, 24)
    assert np.linalg.eigvalsh(state[1][0]).min() > -1e-6  # the prior is a proper quadratic
    # Good odometry averages the localization noise of 0.52 m down over window and prior.
    assert np.mean(errors[20:]) < 0.2


def test_fusion_ignores_an_odometry_jump():
    fuse, state = folds.fusion(), folds.fusion().start()
    for i in range(30):
        pose = np.array([0.5 * i, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0])
        odo = pose + np.array([100.0 if i >= 15 else 0.0, 0, 0, 0, 0, 0, 0])
        state, out = fuse.step(state, [*pose, *odo, 0.9])
    assert np.linalg.norm(np.array(out[:3]) - pose[:3]) < 0.1


def test_fusion_has_settled_at_the_jump_itself():
    """The row at which odometry jumps is fused near its localization, not on the way there."""
    fuse, state = folds.fusion(), folds.fusion().start()
    for i in range(16):
        pose = np.array([0.5 * i, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0])
        odo = pose + np.array([30.0 if i >= 12 else 0.0, 20.0 if i >= 12 else 0.0, 0, 0, 0, 0, 0])
        state, out = fuse.step(state, [*pose, *odo, 0.9])
        assert np.linalg.norm(np.array(out[:3]) - pose[:3]) < 0.2, i


def test_next_values_are_not_computed_anew_for_every_row(spark):
    """A frame that reaches to the end costs the square of a chunk; none is planned, and the values stay the same."""
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    for split in (False, True):
        out = ordered.running(df, ["k"], ["t"], 50, [Carry("n", "next", F.col("v")), Carry("a", "next_after", F.col("v"))], split)
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        for r in out.collect():
            later = [x for x in range(0, 200, 7) if x >= r["t"]]
            assert r["n"] == (later[0] if later else None)
            assert r["a"] == next((x for x in later if x > r["t"]), None)


def test_live_rules_keep_many_keys_in_few_states(spark):
    """Live rules equal replayed ones, null keys included, with at most one state for a bucket and the null key."""
    rng = np.random.default_rng(8)
    rows = [(None if k == 39 else int(k), i, float(i), float(rng.uniform(0, 1)), bool(rng.random() < 0.6), i % 7 == 0, float(i), float(k)) for i in range(30) for k in range(40)]
    df = spark.createDataFrame(rows, "vehicle_id bigint, seq bigint, t double, score double, ok boolean, parking boolean, x double, y double")
    rule = folds.loc_status(0.3, 0.1, 2, 1, 3)
    base = scratch_path(spark, "live")
    query = flows.stream_sink(folds.live(flows.as_stream(df, "t"), ["vehicle_id"], ["t", "seq"], rule, buckets=4), f"{base}/out", f"{base}/ck", available_now=True)
    query.awaitTermination()
    assert 1 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    # The replay starts a null key anew in every row, so the null key gets a number there.
    numbered = df.fillna(39, ["vehicle_id"])
    told = ["vehicle_id", "seq", "status", "fail_count", "unusual", "out_x", "out_y"]
    want = {tuple(r) for r in folds.replay(numbered, ["vehicle_id"], ["t", "seq"], rule).select(told).collect()}
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out").fillna(39, ["vehicle_id"]).select(told).collect()]
    assert len(got) == len(rows) and set(got) == want
