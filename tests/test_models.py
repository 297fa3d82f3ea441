import itertools

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scoutline.functions import sums
from scoutline.operators import cotrain, evaluate, features, reduce, targets


def small_problem(seed=0, n=30, k=3):
    rng = np.random.default_rng(seed)
    xs = [rng.normal(size=(n, 5)), rng.normal(size=(n, 4))]
    encoders = [cotrain.Encoder.create(5, 7, 3, 1), cotrain.Encoder.create(4, 7, 3, 2)]
    reps = [x[:k] for x in xs]
    target = np.zeros((n, k))
    target[:10] = rng.dirichlet(np.ones(k), 10)
    return xs, encoders, reps, target


def test_gradients_match_finite_differences():
    xs, encoders, reps, target = small_problem()
    lam = 0.7
    sums = cotrain.row_gradients(encoders, reps, xs, target, lam)
    analytic = cotrain.full_gradients(encoders, reps, sums)
    for v in (0, 1):
        other_q = cotrain.assignment(encoders[1 - v].forward(xs[1 - v])[1], encoders[1 - v].forward(reps[1 - v])[1])[1]

        def loss():
            q = cotrain.assignment(encoders[v].forward(xs[v])[1], encoders[v].forward(reps[v])[1])[1]
            return cotrain._divergence(target, q) + lam * cotrain._divergence(other_q, q)

        assert loss() == pytest.approx(analytic[v][0])
        for p, g in zip(encoders[v].parts(), analytic[v][1]):
            for idx in list(np.ndindex(p.shape))[::5]:
                keep = p[idx]
                p[idx] = keep + 1e-6
                up = loss()
                p[idx] = keep - 1e-6
                down = loss()
                p[idx] = keep
                assert (up - down) / 2e-6 == pytest.approx(g[idx], abs=1e-5)


def as_rows(spark, xs, target):
    rows = [(i, *[x[i].tolist() for x in xs], target[i].tolist()) for i in range(len(target))]
    return spark.createDataFrame(rows, "row_id bigint, x0 array<double>, x1 array<double>, target array<double>").repartition(4)


def test_distributed_sums_equal_local_ones(spark, monkeypatch):
    xs, encoders, reps, target = small_problem()
    monkeypatch.setattr(cotrain, "CHUNK", 17)
    got = cotrain._epoch_sums(as_rows(spark, xs, target), encoders, reps, 1.0)
    want = cotrain.row_gradients(encoders, reps, xs, target, 1.0)
    for (l0, g0, c0), (l1, g1, c1) in zip(got, want):
        assert l0 == pytest.approx(l1)
        for a, b in zip(g0 + [c0], g1 + [c1]):
            np.testing.assert_allclose(a, b, atol=1e-9)


def test_training_lowers_the_loss_and_keeps_its_input(spark):
    xs, encoders, reps, target = small_problem()
    before = encoders[0].w1.copy()
    trained, losses = cotrain.cotrain(as_rows(spark, xs, target), reps, encoders, 8, lr=1e-2)
    assert sum(losses[-1]) < sum(losses[0]) and len(losses) == 8
    assert (encoders[0].w1 == before).all() and (trained[0].w1 != before).any()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs[0])], "row_id bigint, features array<double>")
    z = cotrain.encode(df, trained[0]).orderBy("row_id").collect()
    np.testing.assert_allclose([r["z"] for r in z], trained[0].forward(xs[0])[1])
    q = cotrain.cluster_view(df, trained[0], reps[0]).collect()
    assert all(sum(r["q"]) == pytest.approx(1) for r in q)


def test_convergence_rule_in_blocks_equals_the_list_rule(spark, monkeypatch):
    rng = np.random.default_rng(4)
    runs = {"a": 5 + rng.normal(0, 0.3, 70), "b": np.linspace(9, 1, 45)}
    df = spark.createDataFrame([(run, i, float(v)) for run, vs in runs.items() for i, v in enumerate(vs)], "run string, step bigint, loss double")
    monkeypatch.setattr(targets, "LOSS_BLOCK", 23)
    got = {(r["run"], r["n"]): r["converged"] for r in targets.converged(df).collect()}
    assert got == {(run, n): targets.has_converged(list(vs[:n])) for run, vs in runs.items() for n in range(1, len(vs) + 1)}
    assert any(got.values()) and not all(got.values())


def test_label_clusters_respect_bounds(spark):
    two = spark.createDataFrame([(0, 10.0), (1, 10.0), (2, 12.0)], "row_id bigint, y double")
    found = targets.adaptive_label_kmeans(two, 5)
    assert found.centroids == [10.0, 12.0] and found.max_span == 0
    one = targets.adaptive_label_kmeans(two.where("y = 10"), 5)
    assert one.centroids == [10.0]
    wide = spark.createDataFrame([(i, float(i)) for i in range(60)], "row_id bigint, y double")
    assert targets.adaptive_label_kmeans(wide, 4).max_span <= 5


def test_soft_targets_and_assignments_sum_to_one(spark):
    df = spark.createDataFrame([(0, 40.0, [1.0, 2.0]), (1, 90.0, [0.0, 0.0])], "row_id bigint, y double, features array<double>")
    rows = targets.soft_targets(df, [40.0, 41.0, 99.0]).orderBy("row_id").collect()
    w = np.array([2, 2 - 0.01, 1e-4])
    np.testing.assert_allclose(rows[0]["target"], w / w.sum())
    assert all(sum(r["target"]) == pytest.approx(1) for r in rows)
    q = df.select(targets.assign_t("features", [[1.0, 2.0], [0.0, 0.0]]).alias("q")).first()["q"]
    np.testing.assert_allclose(q, np.array([1, 1 / 6]) / (1 + 1 / 6))
    s = df.select(targets.sharpen(F.array(F.lit(0.75), F.lit(0.25))).alias("s")).first()["s"]
    np.testing.assert_allclose(s, [0.9, 0.1])


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 4, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    projected, ratio = reduce.truncated_svd(df, 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    got = np.array([r["features"] for r in projected.orderBy("row_id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs(x @ vt[:3].T), atol=1e-8)
    np.testing.assert_allclose(reduce.fit_svd(df, 3).singular_values, s[:3])
    assert ratio == pytest.approx((x @ vt[:3].T).var(0).sum() / x.var(0).sum())
    assert len(reduce.fit_svd(df, 99).singular_values) == 6
    wider, _ = reduce.truncated_svd(df.where("row_id < 10"), 2, fit_on=df)
    np.testing.assert_allclose(np.abs([r["features"] for r in wider.orderBy("row_id").collect()]), np.abs(x[:10] @ vt[:2].T), atol=1e-8)


def test_sparse_svd_equals_dense(spark):
    rng = np.random.default_rng(3)
    bits = rng.random((30, 12)) < 0.3
    df = spark.createDataFrame([(i, [int(j) for j in np.nonzero(b)[0]]) for i, b in enumerate(bits)], "row_id bigint, slots array<int>")
    model = reduce.fit_svd_slots(df, 12, 3)
    np.testing.assert_allclose(model.singular_values, np.linalg.svd(bits.astype(float))[1][:3])
    got = [r["features"] for r in model.transform_slots(df).orderBy("row_id").collect()]
    np.testing.assert_allclose(got, bits.astype(float) @ model.components, atol=1e-9)


def _squares(values, borders):
    return sum(((values[i:j] - values[i:j].mean()) ** 2).sum() for i, j in zip(borders, borders[1:]))


def test_label_clusters_are_the_best_ranges(spark):
    rng = np.random.default_rng(3)
    for n, digits in ((1, 1), (3, 1), (9, 3), (12, 0)):
        y = np.sort(np.round(rng.uniform(0, 100, n), digits))
        rows = spark.createDataFrame([(float(v),) for v in y] + [(None,), (float("nan"),)], "y double")
        found = targets.LabelSegmentation(rows, "y")
        for k in range(1, len(set(y)) + 1):
            want = min(_squares(y, [0, *cut, n]) for cut in itertools.combinations(range(1, n), k - 1))
            got = found.clusters(k)
            assert len(got.centroids) == k and got.centroids == sorted(got.centroids)
            near = np.abs(y[:, None] - np.array(got.centroids)).min(1)
            assert (near ** 2).sum() == pytest.approx(want, abs=1e-9)
    assert targets.adaptive_label_kmeans(rows.where("y < 0"), 4).centroids == []


def test_label_clusters_from_cells_are_refined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(20, 6, 500), rng.normal(55, 9, 700), rng.uniform(60, 100, 300)])
    rows = spark.createDataFrame([(float(v),) for v in y], "y double")
    exact = targets.LabelSegmentation(rows, "y").clusters(5)
    monkeypatch.setattr(targets, "MAX_VALUES", 100)
    monkeypatch.setattr(targets, "GRID", 24)
    found = targets.LabelSegmentation(rows, "y")
    assert found.edges and len(found.cells.weight) <= 25
    got = found.clusters(5)
    np.testing.assert_allclose(got.centroids, exact.centroids, rtol=1e-3)
    borders = (np.array(got.centroids[1:]) + got.centroids[:-1]) / 2  # no label is nearer to another centroid
    means = [y[np.searchsorted(borders, y) == c].mean() for c in range(5)]
    np.testing.assert_allclose(got.centroids, means, rtol=1e-9)


def test_wide_svd_in_bounded_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0] @ np.diag(0.6 ** np.arange(64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id bigint, features array<double>").repartition(12)
    jobs = []
    for name in ("summed", "triangle"):
        monkeypatch.setattr(reduce, name, lambda *a, fn=getattr(reduce, name): (jobs.append(fn.__name__), fn(*a))[1])
    for passes in (2, 5):
        jobs.clear()
        model = reduce.fit_svd_wide(df, 64, 16, passes, oversample=16)
        assert jobs == ["summed"] * (passes - 1) + ["triangle"]
    gram = reduce.fit_svd(df, 16)
    np.testing.assert_allclose(model.singular_values, gram.singular_values, rtol=1e-6)
    np.testing.assert_allclose(np.abs((model.components * gram.components).sum(0)), 1, atol=1e-6)
    np.testing.assert_allclose(reduce.fit_svd_wide(df, 64, 64).singular_values, np.linalg.svd(x)[1], rtol=1e-6, atol=1e-12)
    assert len(reduce.fit_svd_wide(df.limit(3), 64, 10).singular_values) == 3
    with pytest.raises(ValueError):
        reduce.fit_svd_wide(df.limit(0), 64, 4)


def test_wide_sparse_svd_equals_numpy(spark):
    rng = np.random.default_rng(6)
    bits = rng.random((40, 500)) < 0.02
    df = spark.createDataFrame([(i, [int(j) for j in np.nonzero(b)[0]]) for i, b in enumerate(bits)], "row_id bigint, slots array<int>")
    model = reduce.fit_svd_wide(df, 500, 10, col="slots", sparse=True, oversample=40)
    np.testing.assert_allclose(model.singular_values, np.linalg.svd(bits.astype(float))[1][:10], rtol=1e-9)


def test_contributions_are_one_per_core(spark):
    rows = spark.range(0, 1000, 1, 300).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = np.append(np.stack(b.column("x").to_pylist()).sum(0), 0)
                total = part if total is None else total + part
        return None if total is None else np.append(total[:2], 1.0)

    ids, n, tasks = sums.summed(rows, partial)
    assert (ids, n) == (499500, 1000) and tasks <= sums.cores(spark)
    assert sums.summed(rows.limit(0), partial) is None
    r = sums.triangle(rows, lambda batches: (np.stack(b.column("x").to_pylist()) for b in batches if b.num_rows), 2)
    x = np.stack([np.arange(1000.0), np.ones(1000)], 1)
    np.testing.assert_allclose(r.T @ r, x.T @ x)


def test_one_hot_round_trip_with_empty_and_non_ascii(spark):
    df = spark.createDataFrame([(0, "abc", "é"), (1, "", "日本"), (2, "c", "é日")], "row_id bigint, a string, b string")
    vocab = features.char_vocab(df, ["a", "b"])
    encoded = features.one_hot(df, ["a", "b"], vocab)
    back = features.one_hot_decode(encoded.select("row_id", "slots"), ["a", "b"], vocab)
    assert sorted(tuple(r) for r in back.select("row_id", "a", "b").collect()) == sorted(tuple(r) for r in df.collect())
    gap = spark.createDataFrame([(0, [0, 7])], "row_id bigint, slots array<bigint>")  # position 1 of `a` is empty
    assert features.one_hot_decode(gap, ["a"], vocab).first()["a"] == "a"


def test_blocks_and_scaling(spark):
    df = spark.createDataFrame([(0, "abcd", ""), (1, "ab", "abcd"), (2, "abcd", None)], "row_id bigint, a string, b string")
    fp = features.hash_fingerprint(df, ["a", "b"], 64).orderBy("row_id").collect()
    assert len(fp[0]["slots"]) == 2 and fp[1]["slots"] == [s + 64 for s in fp[0]["slots"]] and fp[2]["slots"] == fp[0]["slots"]
    in_place = features.hash_fingerprint(df, ["a", "b"], 64, distinct=False).orderBy("row_id").collect()
    assert [r["slots"] for r in in_place] == [r["slots"] for r in fp]
    dense = features.hash_fingerprint(df, ["a", "b"], 64).select("slots", features.slots_to_dense("slots", 128).alias("d")).collect()
    assert all(list(np.nonzero(r["d"])[0]) == r["slots"] for r in dense)
    scaled = features.minmax(spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "row_id bigint, features array<double>"))
    assert [r["features"] for r in scaled.orderBy("row_id").collect()] == [[0.0, 0.0], [1.0, 0.0]]
    assert df.select(features.descriptors("b").alias("d")).where("d is not null").count() == 3


def test_align_views_refuses_missing_rows(spark):
    v = spark.createDataFrame([(0, [1.0], 1.0), (1, [2.0], 2.0)], "row_id bigint, features array<double>, y double")
    assert features.align_views(v, v).count() == 2
    with pytest.raises(Exception, match="missing"):
        features.align_views(v, v.where("row_id = 0")).collect()


def test_metrics_with_degenerate_input(spark):
    df = spark.createDataFrame([(i, 5.0, 5.0 + i) for i in range(4)], "row_id bigint, y double, pred double")
    flat = evaluate.regression_metrics(df).first()
    assert flat["r2"] is None and flat["mae"] == 1.5
    first = evaluate.top_ratio_mae(df, [0.05, 0.5]).orderBy("ratio").collect()
    assert first[0]["mae"] is None and first[1]["mae"] == 0.5  # ties: lowest ids first
    assert evaluate.rank_threshold_confusion(df, [0.5]).first()["f1"] is None


def test_forest_and_threshold_models(spark):
    df = spark.createDataFrame([(i, [float(i), float(i % 7)], float(i)) for i in range(80)], "row_id bigint, features array<double>, y double")
    pred = evaluate.fit_predict_rf(df, F.col("row_id") % 2 == 0, seed=1, trees=20)
    assert pred.count() == 80 and evaluate.regression_metrics(pred).first()["mae"] < 2
    models = evaluate.threshold_models(df, [20.0, 60.0])
    above = evaluate.apply_threshold_models(df, models).groupBy("boundary").agg(F.sum("above").alias("n")).orderBy("boundary").collect()
    assert [abs(r["n"] - w) <= 4 for r, w in zip(above, (59, 19))] == [True, True]


def test_loop_ends_with_the_final_round_when_nothing_is_left(spark, monkeypatch):
    from scoutline.plans import loop

    rounds = []

    def one_round(aligned, labelled, encoders, settings, clusters, epochs, acquire=True, evaluate_model=True):
        rounds.append((clusters, acquire))
        none = aligned.select("row_id").limit(0)
        return loop.RoundResult([{"view": "view_0", "kind": "original", "r2": 0.0, "mae": 0.0, "rmse": 0.0, "n_clusters": clusters, "epochs": epochs}],
                                none if acquire else None, encoders)

    monkeypatch.setattr(loop, "one_round", one_round)
    view = spark.createDataFrame([(i, [float(i)], 1.0) for i in range(20)], "row_id bigint, features array<double>, y double")
    log = loop.active_loop(view, view, loop.LoopSettings(start=5, step=5, total=15, clusters=3, final_clusters=7, hidden=2, out=2)).collect()
    assert rounds == [(3, True), (7, False)] and [(r["round"], r["n_labelled"]) for r in log] == [(0, 5), (1, 5)]


def test_a_lost_driver_goes_on_after_the_last_finished_round(spark, tmp_path, monkeypatch):
    from scoutline.plans import loop

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), float(10 + i % 4 * 20)) for i in range(60)]
    view = spark.createDataFrame(rows, "row_id bigint, features array<double>, y double")
    settings = loop.LoopSettings(start=10, step=5, total=20, clusters=3, final_clusters=3, hidden=4, out=2, epochs=2, final_epochs=2, trees=3,
                                 delta=0.01, kinds=("encoded",))
    whole = loop.active_loop(view, view, settings, str(tmp_path / "whole")).collect()
    assert sorted({(r["round"], r["n_labelled"]) for r in whole}) == [(0, 10), (1, 15), (2, 20)]
    commit, ran = loop.LoopLog.commit, []

    def lost(self, round_no, result, *rest):
        if round_no == 1 and not ran:
            ran.append(round_no)
            self.write("picks", round_no, result.picks.select("row_id").limit(1))  # half of a round, without its last line
            raise KeyboardInterrupt
        ran.append(round_no)
        commit(self, round_no, result, *rest)

    monkeypatch.setattr(loop.LoopLog, "commit", lambda self, n, *rest: lost(self, n, *rest) if n else commit(self, n, *rest))
    with pytest.raises(KeyboardInterrupt):
        loop.active_loop(view, view, settings, str(tmp_path / "broken"))
    again = loop.active_loop(view, view, settings, str(tmp_path / "broken")).collect()
    assert ran == [1, 1, 2]
    key = lambda r: (r["round"], r["view"], r["kind"])
    for a, b in zip(sorted(whole, key=key), sorted(again, key=key), strict=True):
        assert key(a) == key(b) and a["n_labelled"] == b["n_labelled"] and a["mae"] == pytest.approx(b["mae"], rel=1e-6)
    picks = [{(r["round"], r["row_id"]) for r in loop.LoopLog(spark, str(tmp_path / f)).read("picks", "row_id bigint").collect()} for f in ("whole", "broken")]
    assert picks[0] == picks[1] and len(picks[0]) == 10
    ran.clear()
    assert len(loop.active_loop(view, view, settings, str(tmp_path / "broken")).collect()) == len(whole) and not ran


def test_representation_report_of_one_group_equals_the_single_reports(spark):
    from scoutline.operators import evaluate

    rng = np.random.default_rng(8)
    rows = [(g, i, float(rng.integers(0, 12)), float(rng.integers(0, 12))) for g in "ab" for i in range(60 if g == "a" else 25)]
    df = spark.createDataFrame(rows, "g string, row_id bigint, y double, pred double")
    got = {(r["g"], r["ratio"]): r for r in evaluate.representation_report(df, ["g"]).collect()}
    for g in "ab":
        own = df.where(F.col("g") == g)
        for r in evaluate.top_ratio_mae(own).collect():
            assert got[g, r["ratio"]]["k"] == r["k"] and got[g, r["ratio"]]["top_mae"] == (None if r["mae"] is None else pytest.approx(r["mae"]))
        for r in evaluate.rank_threshold_confusion(own).collect():
            assert [got[g, r["ratio"]][c] for c in ("threshold", "tp", "tn", "fn", "fp")] == [r[c] for c in ("threshold", "tp", "tn", "fn", "fp")]


def test_projection_plot_equals_numpy(spark):
    from scoutline.plans import metric_queries
    from scoutline.plans.bindings import points

    sf = "/root/testdata/sf0.001"
    rows = points(spark, sf).collect()
    x, value = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    v = np.linalg.svd(x, full_matrices=False)[2][:2].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(2)])
    flat = x @ v
    unit = (flat - flat.min(0)) / (flat.max(0) - flat.min(0)) * [50, int(50 / 3 ** 0.5)]
    near, below = np.rint(unit), np.floor(unit)
    first = ((unit - near) ** 2 @ [1, 3]) < ((unit - below - 0.5) ** 2 @ [1, 3])
    want = {}
    for a, p, q, y in zip(first, near, below, value):
        want.setdefault((0, *p) if a else (1, *q), []).append(y)
    got = {(r.lattice, r.i, r.j): (r.n, r["mean"]) for r in metric_queries.Q["i1_projection"](spark, sf).collect()}
    assert got == {k: (len(v), pytest.approx(np.mean(v), abs=1e-5)) for k, v in want.items()}


def test_fingerprints_equal_the_formula_and_run_on_batches(spark):
    """Code points beyond the basic plane, short texts and nulls; no nested array expression per text is left in the plan."""
    texts = [None, "", "ab", "abc", "a\U0001f600bcd\u00e9\x00zz", "abcabc " * 30, "\u65e5\u672c\u8a9e\u30c6"]

    def bits(text):
        codes = [ord(ch) for ch in text or ""]
        keys = [((a * 31 + b) % 2 ** 30 * 31 + c) % 2 ** 30 for a, b, c in zip(codes, codes[1:], codes[2:])]
        return sorted({(k * 2654435761) % 2 ** 32 * 512 >> 32 for k in keys})

    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, t string")
    got = df.select("row_id", features.fingerprint("t", 512).alias("b"))
    assert {r["row_id"]: r["b"] for r in got.collect()} == {i: bits(t) for i, t in enumerate(texts)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_distinct" not in plan
    assert features._set_bits("abcabc", 512, 3, None).tolist() == bits("abcabc")


def sparse_rows(rng, rows, width):
    return [sorted(rng.choice(width, size=int(rng.integers(0, 6)), replace=False).tolist()) for _ in range(rows)]


def test_sparse_products_equal_dense_ones():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    slots = sparse_rows(rng, 60, 20)
    dense = np.array([[float(k in r) for k in range(20)] for r in slots])
    column = pa.array([[9]] + slots, pa.list_(pa.int32())).slice(1)  # a slice knows where it begins
    w, total = rng.normal(size=(20, 3)), np.zeros((20, 3))
    rows = reduce._Sparse.of(column)
    assert np.allclose(rows.times(w), dense @ w)
    rows.back(dense @ w, total)
    assert np.allclose(total, dense.T @ dense @ w)


def test_sparse_fits_make_no_iterations_and_no_dense_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    slots = sparse_rows(rng, 80, 12)
    dense = np.array([[float(k in r) for k in range(12)] for r in slots])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(slots)], "row_id bigint, slots array<int>")
    values = np.linalg.svd(dense, compute_uv=False)
    monkeypatch.setattr(reduce, "_fit", None)  # MLlib's pass per iteration
    model = reduce.fit_svd_slots(df, 12, 4)
    assert model.singular_values == pytest.approx(values[:4]) and model.components.shape == (12, 4)
    out = np.array([r["features"] for r in model.transform_slots(df).orderBy("row_id").collect()])
    assert np.allclose(out, dense @ model.components)
    monkeypatch.setattr(reduce, "_blocks", None)
    wide = reduce.fit_svd_wide(df, 12, 12, col="slots", sparse=True)
    assert wide.singular_values == pytest.approx(values)
    assert model.transform_slots(df).columns == ["row_id", "slots", "features"]


def test_views_are_encoded_in_one_python_pass(spark):
    """The same columns as one call per column, of one operator in the plan."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for i in range(50)], "row_id bigint, x0 array<double>, x1 array<double>")
    encoders, reps = [cotrain.Encoder.create(3, 5, 4, 1), cotrain.Encoder.create(2, 5, 4, 2)], [rng.normal(size=(3, 3)), rng.normal(size=(3, 2))]
    got = cotrain.encode_views(df, encoders, reps)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and got.columns == ["row_id", "x0", "x1", "z0", "z1", "q0", "q1"]
    want = df
    for v in (0, 1):
        want = cotrain.cluster_view(cotrain.encode(want, encoders[v], f"x{v}", f"z{v}"), encoders[v], reps[v], f"x{v}", f"q{v}")
    assert got.orderBy("row_id").collect() == want.select(got.columns).orderBy("row_id").collect()
    assert cotrain.encode_views(df.where("row_id < 0"), encoders, reps).count() == 0


def test_large_forests_are_grown_by_fits_side_by_side(spark, monkeypatch):
    """All trees, each fit over the same written rows, `pred` the mean over all trees; few rows stay one fit."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    df = spark.createDataFrame([(i, v.tolist(), float(v[0] * 3 + v[1])) for i, v in enumerate(x)], "row_id bigint, features array<double>, y double").repartition(5)
    fits, fit = [], evaluate.RandomForestRegressor.fit

    def recorded(self, train):
        model = fit(self, train)
        fits.append((self.getNumTrees(), self.getSeed(), train.rdd.getNumPartitions(), train.count(), model, self))
        return model

    monkeypatch.setattr(evaluate.RandomForestRegressor, "fit", recorded)
    known = F.col("row_id") % 2 == 0
    assert evaluate.fit_predict_rf(df, known, seed=1, trees=25).columns == ["row_id", "features", "y", "pred"]
    assert [f[0] for f in fits] == [25]

    fits.clear()
    monkeypatch.setattr(evaluate, "FOREST_ROWS", 100)
    monkeypatch.setattr(evaluate, "ROWS_A_TASK", 70)
    got = evaluate.fit_predict_rf(df, known, seed=1, trees=25)
    assert got.columns == ["row_id", "features", "y", "pred"] and got.count() == 240
    assert sorted(f[0] for f in fits) == [8, 8, 9] and len({f[1] for f in fits}) == 3
    assert all(f[2] == 2 and f[3] == 120 and f[5].getMaxDepth() == 30 and f[5].getFeatureSubsetStrategy() == "all" for f in fits)
    pred = {r["row_id"]: r["pred"] for r in got.collect()}
    trees = [t for f in fits for t in f[4].trees]
    vector = lambda i: Vectors.dense(x[i].tolist())
    assert len(trees) == 25 and all(pred[i] == pytest.approx(np.mean([t.predict(vector(i)) for t in trees])) for i in range(0, 240, 40))
    assert evaluate.regression_metrics(got.where(~known)).first()["r2"] > 0.8
    again = {r["row_id"]: r["pred"] for r in evaluate.fit_predict_rf(df.repartition(3, "y"), known, seed=1, trees=25).collect()}
    assert again == pytest.approx(pred)

    fits.clear()
    evaluate.fit_predict_rf(df, known, seed=1, trees=evaluate.TREES_AT_ONCE)
    assert [f[0] for f in fits] == [10]
