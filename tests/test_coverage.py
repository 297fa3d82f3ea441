import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutline.operators import coverage
from scoutline.plans import bindings
from scoutline.plans.recommend import recommend


def brute(rows, delta, batch, bonus=None):
    """The greedy rule on all pairs: rows are (row_id, features, labelled)."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < delta
    lab = np.array([r[2] for r in rows])
    done = near[lab].any(0) if lab.any() else np.zeros(len(rows), bool)
    taken, picks = set(), []
    for _ in range(batch):
        best = None
        for i in range(len(rows)):
            if lab[i] or i in taken:
                continue
            g = int((near[i] & ~done).sum())
            score = g + (bonus[i] if bonus else 0.0)
            if best is None or (-score, ids[i]) < (-best[1], ids[best[0]]):
                best = (i, score, g)
        if best is None or (bonus is None and best[2] == 0):
            break
        picks.append((ids[best[0]], best[2]))
        taken.add(best[0])
        done = done | near[best[0]]
    return picks


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, labelled boolean").repartition(4)


def clouds(seed, n, copies=True):
    """Dense clusters, scattered points, and a third of the rows as copies of one point."""
    rng = random.Random(seed)
    centers = [[rng.uniform(-10, 10) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(n):
        if copies and i % 3 == 0:
            f = [0.5, 0.5, 0.5, 0.5]
        elif i % 3 == 1:
            f = [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]
        else:
            f = [rng.uniform(-10, 10) for _ in range(4)]
        rows.append((i * 3 + 1, f, rng.random() < 0.05))
    return rows


@pytest.fixture(params=[(1024, 32768), (8, 20)], ids=["defaults", "tiny blocks and strips"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(coverage, "BLOCK_ROWS", request.param[0])
    monkeypatch.setattr(coverage, "TILE_ROWS", request.param[1])
    if request.param[1] < 1000:
        monkeypatch.setattr(coverage, "GAIN_ROWS", 20)
        monkeypatch.setattr(coverage, "BLOCKS_AT_ONCE", 1)


@pytest.mark.parametrize("delta", [0.9, 3.0])
def test_greedy_equals_brute_force(spark, sizes, delta):
    rows = clouds(3, 150)
    got = [(r["row_id"], r["gain"]) for r in coverage.greedy_cover(frame(spark, rows), delta, 12).orderBy("pick").collect()]
    want = brute(rows, delta, 12)
    assert got == want
    assert all(a[1] >= b[1] for a, b in zip(got, got[1:]))  # gains never grow


def test_mixed_equals_brute_force_with_copies(spark, sizes):
    rows = clouds(5, 90)
    bonus = [0.25 * ((r[0] * 7) % 11) for r in rows]
    bonus = [2.75 if r[1][0] == 0.5 else b for r, b in zip(rows, bonus)]  # copies share their bonus
    df = frame(spark, rows).join(spark.createDataFrame([(r[0], b) for r, b in zip(rows, bonus)], "row_id bigint, b double"), "row_id")
    got = coverage.mixed_cover(df, 1.5, 10, F.col("b")).orderBy("pick").collect()
    assert [(r["row_id"], r["gain"]) for r in got] == brute(rows, 1.5, 10, bonus)


def test_mixed_keeps_copies_with_unequal_bonus_apart(spark, sizes):
    rows = [(1, [0.0, 0.0], False), (2, [0.0, 0.0], False), (3, [0.0, 0.0], False), (4, [9.0, 9.0], False)]
    bonus = {1: 5.0, 2: 1.0, 3: 5.0, 4: 0.0}
    df = frame(spark, rows).join(spark.createDataFrame(list(bonus.items()), "row_id bigint, b double"), "row_id")
    got = coverage.mixed_cover(df, 1.5, 4, F.col("b")).orderBy("pick").collect()
    assert [(r["row_id"], r["gain"], r["score"]) for r in got] == [(1, 3, 8.0), (3, 0, 5.0), (2, 0, 1.0), (4, 1, 1.0)]
    assert [(r["row_id"], r["gain"]) for r in got] == brute(rows, 1.5, 4, [bonus[r[0]] for r in rows])


def test_copies_per_row_do_not_grow(spark, monkeypatch):
    """A point travels once per strip of the other side, however many entries the index has."""
    monkeypatch.setattr(coverage, "TILE_ROWS", 4000)
    rng = np.random.default_rng(4)
    for n in (500, 2000, 4000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)))], "row_id bigint, features array<double>")
        index = coverage.index_points(df, 3.0)
        plan = coverage._plan(index.points, index.points, index, True)
        assert coverage._dealt(index.points, plan.left.drop("weight"), plan.strips, "ls").count() <= n


def test_the_driver_holds_cells_and_not_strips(spark, monkeypatch):
    """Strips double with the points; what comes to the driver is one row per cell, the cube root of the points."""
    monkeypatch.setattr(coverage, "TILE_ROWS", 10)
    held = []
    monkeypatch.setattr(coverage, "_first_strips", lambda cells, fn=coverage._first_strips: (held.append(len(cells)), fn(cells))[1])
    rng = np.random.default_rng(8)
    strips = []
    for n in (500, 1000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 3)))], "row_id bigint, features array<double>")
        index = coverage.index_points(df, 0.3)
        plan = coverage._plan(index.points, index.points, index, True)
        strips.append(plan.strips.select("ls").distinct().count())
        assert max(held) <= len(index.pivots) == round(n ** (1 / 3))
    assert strips[1] > 1.5 * strips[0] > 20


def test_a_pick_reads_blocks_that_can_win_and_writes_its_ball(spark, monkeypatch):
    monkeypatch.setattr(coverage, "GAIN_ROWS", 50)
    monkeypatch.setattr(coverage, "BLOCKS_AT_ONCE", 1)
    logs = []
    monkeypatch.setattr(coverage, "GainLog", lambda *a, fn=coverage.GainLog: (logs.append(fn(*a)), logs[-1])[1])
    rng = random.Random(2)
    rows = [(i, [rng.uniform(0, 100), rng.uniform(0, 100)] if i % 2 else [100 * (i % 40) + rng.gauss(0, 0.3), 500.0], False) for i in range(600)]
    got = [(r["row_id"], r["gain"]) for r in coverage.greedy_cover(frame(spark, rows), 1.0, 8).orderBy("pick").collect()]
    assert got == brute(rows, 1.0, 8)
    log, = logs
    blocks = log.base.select("block").distinct().count()
    assert blocks > 6 and log.read < 0.6 * len(got) * blocks  # blocks of equal scores are all read
    assert all(0 < loss.count() < 100 for loss in log.losses)


def test_a_dense_ball_is_picked_exactly(spark, sizes):
    rng = np.random.default_rng(6)
    rows = [(i, (0.1 * rng.normal(size=3)).tolist(), False) for i in range(60)] + [(60 + i, (50 * rng.normal(size=3)).tolist(), False) for i in range(10)]
    got = coverage.greedy_cover(frame(spark, rows), 1.0, 4).orderBy("pick").collect()
    assert [(r["row_id"], r["gain"]) for r in got] == brute(rows, 1.0, 4)


def test_counts_pairs_and_cover_equal_brute_force(spark, sizes):
    rows, delta = clouds(9, 120), 1.2
    df = frame(spark, rows)
    x = np.array([r[1] for r in rows])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < delta
    counts = {r["row_id"]: r["n_neighbors"] for r in coverage.neighbor_counts(df, delta).collect()}
    assert counts == {r[0]: int(n) for r, n in zip(rows, near.sum(1))}
    first = {}
    for r in rows:
        first.setdefault(tuple(r[1]), r[0])
    pairs = {(r["i"], r["j"]): r["copies"] for r in coverage.neighbors(df, delta).collect()}
    want = {(first[tuple(a[1])], first[tuple(b[1])]) for i, a in enumerate(rows) for j, b in enumerate(rows) if near[i, j]}
    assert set(pairs) == want and len(pairs) == coverage.neighbors(df, delta).count()
    assert pairs[(1, 1)] == 40
    hit = near[np.array([r[2] for r in rows])].any(0)
    assert {r["row_id"] for r in coverage.covered(df, delta).collect()} == {r[0] for r, h in zip(rows, hit) if h}
    gains = {r["row_id"]: r["gain"] for r in coverage.gain(df, delta).collect()}
    assert gains == {r[0]: 0 if r[2] else int((near[i] & ~hit).sum()) for i, r in enumerate(rows)}


def test_stops_when_everything_is_covered(spark):
    rows = [(i, [float(i // 5) * 10, 0.0], False) for i in range(15)]
    got = coverage.greedy_cover(frame(spark, rows), 1.0, 10).orderBy("pick").collect()
    assert [(r["row_id"], r["gain"]) for r in got] == [(0, 5), (5, 5), (10, 5)]
    with pytest.warns(UserWarning):
        from scoutline.plans.recommend import trim
        assert trim(coverage.greedy_cover(frame(spark, rows), 1.0, 10), 10).count() == 3


def test_nothing_labelled_all_labelled_and_empty(spark):
    rows = [(i, [float(i)], True) for i in range(6)]
    df = frame(spark, rows)
    assert coverage.greedy_cover(df, 0.5, 3).count() == 0
    assert coverage.covered(df, 0.5).count() == 6
    free = df.withColumn("labelled", F.lit(False))
    assert coverage.covered(free, 0.5).count() == 0
    assert coverage.gain(free, 1.5).agg(F.sum("gain")).first()[0] == 16
    assert coverage.greedy_cover(df.where("row_id < 0"), 0.5, 3).count() == 0
    assert coverage.neighbors(df.where("row_id < 0"), 0.5).count() == 0


def test_distance_equal_to_delta_is_outside(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [3.0, 3.999999])], "row_id bigint, features array<double>")
    got = {r["row_id"]: r["n_neighbors"] for r in coverage.neighbor_counts(df, 5.0).collect()}
    assert got == {0: 2, 1: 2, 2: 3}


def test_known_picks_on_the_embeddings(spark):
    p = bindings.points(spark, "/root/testdata/sf0.01").withColumn("labelled", F.col("row_id") % 20 == 0)
    got = coverage.greedy_cover(p, 1.25, 3).orderBy("pick").collect()
    assert [(r["row_id"], r["gain"]) for r in got] == [(158, 16), (413, 14), (50, 13)]


def test_radius_is_the_unweighted_mean_over_clusters(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "cell int, dist double")
    assert coverage.mean_of_cluster_means(df).first()[0] == 6.0
    points = spark.createDataFrame([(i, [float(i // 3) * 100 + i % 3]) for i in range(6)], "row_id bigint, features array<double>")
    assert coverage.coverage_radius(points, 2, seed=1) == pytest.approx(2 / 3)


def test_entropy_and_dispatch(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5], [1.0, 0.0], False), (1, [0.9, 0.1], [0.5, 0.5], False), (2, [0.5, 0.5], [0.5, 0.5], True)],
                               "row_id bigint, q0 array<double>, q1 array<double>, labelled boolean")
    scored = df.withColumn("score", coverage.entropy_score("q0", "q1"))
    assert [r["score"] for r in scored.orderBy("row_id").collect()] == pytest.approx([np.log(2), np.log(2) + 0.3250829734, 2 * np.log(2)])
    assert [r["row_id"] for r in recommend(scored, "entropy", 5, 0.0, F.col("score")).orderBy("pick").collect()] == [1, 0]
    with pytest.raises(ValueError):
        recommend(scored, "unknown", 1, 0.0)


def test_pairs_leave_a_task_in_pieces(monkeypatch):
    """What is held of a dense block list is bounded, and nothing of it is lost."""
    monkeypatch.setattr(coverage, "BLOCK_ROWS", 8)
    made = []

    def blocks():
        for k in range(50):
            made.append(k)
            yield np.arange(8) + 8 * k, np.arange(8), np.ones((8, 8), bool)

    sizes, seen = [], 0
    for found in coverage._gathered(blocks()):
        seen += 1
        assert len(made) == seen  # the next block has not been measured yet
        sizes.append(sum(len(i) for i, _ in found))
    assert max(sizes) <= 64 + 16 and sum(sizes) == 50 * 64


def test_pairs_of_several_strips_and_ties(spark, monkeypatch):
    """A grid whose pairs lie at delta by the thousand, measured a few at a time."""
    monkeypatch.setattr(coverage, "TILE_ROWS", 64)
    monkeypatch.setattr(coverage, "BLOCK_ROWS", 16)
    monkeypatch.setattr(coverage, "CLOSE_PAIRS", 5)
    rows = [(i, [float(i % 20), float(i // 20)]) for i in range(400)]
    x = np.array([r[1] for r in rows])
    want = {(int(i), int(j), 1) for i, j in zip(*np.nonzero(((x[:, None] - x[None]) ** 2).sum(2) < 4.0))}
    got = [tuple(r) for r in coverage.neighbors(spark.createDataFrame(rows, "row_id bigint, features array<double>"), 2.0).collect()]
    assert set(got) == want and len(got) == len(want)
    direct = coverage.within(x, x, 2.0)
    assert {(int(i), int(j), 1) for i, j in zip(*np.nonzero(direct))} == want


def test_strips_are_counted_as_arrow_batches(spark, monkeypatch):
    """The counting step is one grouping of both sides, without a cogroup through pandas, and right when a strip comes in many batches."""
    monkeypatch.setattr(coverage, "TILE_ROWS", 64)
    monkeypatch.setattr(coverage, "BLOCK_ROWS", 16)
    rows = clouds(3, 300)
    df, x = frame(spark, rows), np.array([r[1] for r in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = coverage.index_points(df, 1.5)
        weights = coverage.neighbor_weights(index.points, index.points, index)
        got = {r["pid"]: r["n_within"] for r in weights.collect()}
        near = index.points.select(F.lit(3).alias("block"), "pid", "features")
        losses = coverage._losses(near, index.points.select("pid", "features", "weight"), 1.5, 3)
        lost = {r["pid"]: (r["block"], r["m"]) for r in losses.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    within = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 1.5).sum(1)
    want = {r[0]: n for r, n in zip(rows, within.tolist()) if r[0] in got}
    assert got == want and len(got) == len({tuple(r[1]) for r in rows}) and lost == {pid: (3, n) for pid, n in want.items()}
    for step in (weights, losses):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan


def test_a_block_is_measured_in_place():
    """Two matrices of a block's size and the answer at a time, not three."""
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(512, 8))
    tracemalloc.start()
    hit = coverage.within(x, x, 3.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * 512 * 512
    assert (hit == (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 3.0)).all()
