import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutline.functions import selection
from scoutline.operators import space, splits


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key."""
    rng = random.Random(1)
    rows = [(i, 7.0 if i % 3 == 0 else round(rng.gauss(0, 50), 2)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "row_id bigint, v double").repartition(5)


@pytest.mark.parametrize("bins,finish", [(2048, 4096), (4, 10), (3, 0)])
def test_thresholds_equal_sorting(skewed, monkeypatch, bins, finish):
    rows, df = skewed
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FINISH_ROWS", finish)
    order = sorted((v, i) for i, v in rows)
    ranks = [1, 2, 250, 500, 501, 502, 899, 900]
    assert selection.thresholds(df, "v", "row_id", ranks) == [order[r - 1] for r in ranks]


@pytest.mark.parametrize("finish", [4096, 0])
def test_thresholds_with_infinite_and_nan_keys(spark, monkeypatch, finish):
    monkeypatch.setattr(selection, "FINISH_ROWS", finish)
    inf, nan = float("inf"), float("nan")
    keys = [inf, -inf, nan, 1.0, -1e308, 1e308, 0.0] * 8 + [2.5, nan]
    order = sorted(enumerate(keys), key=lambda e: (e[1] != e[1], e[1] if e[1] == e[1] else 0, e[0]))
    df = spark.createDataFrame(list(enumerate(keys)), "row_id bigint, v double").repartition(3)
    got = selection.thresholds(df, "v", "row_id", list(range(1, len(keys) + 1)))
    assert [t for _, t in got] == [i for i, _ in order]
    assert all(k == keys[t] or (k != k and keys[t] != keys[t]) for k, t in got)
    assert df.where(selection.first_n_by(df, 57, F.col("v"))).count() == 57


def test_thresholds_of_wide_integers(spark, monkeypatch):
    monkeypatch.setattr(selection, "FINISH_ROWS", 0)
    keys = [2**60 + i for i in range(40)] + list(range(40))
    df = spark.createDataFrame(list(enumerate(keys)), "row_id bigint, v bigint")
    assert [k for k, _ in selection.thresholds(df, "v", "row_id", [1, 40, 41, 80])] == [0, 39, 2**60, 2**60 + 39]


def test_consecutive_numbers(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(500)], "v string").repartition(6)
    assert [r["n"] for r in selection.consecutive(df, "v", "n").orderBy("v").collect()] == list(range(500))
    assert selection.consecutive(df.limit(0), "v", "n").count() == 0


def test_union_of_splits_has_unique_ids(spark):
    a = spark.createDataFrame([(3,), (90,)], "row_id bigint")
    b = spark.createDataFrame([(5,), (7,), (91,)], "row_id bigint")
    assert sorted(r["row_id"] for r in splits.union_splits(a, b).collect()) == [3, 90, 91, 93, 177]
    assert splits.union_splits(a, b.limit(0)).count() == 2 and splits.union_splits(a.limit(0), b).count() == 3


def test_thresholds_reject_bad_rank(skewed):
    with pytest.raises(ValueError):
        selection.thresholds(skewed[1], "v", "row_id", [901])


@pytest.mark.parametrize("pieces", [2, 16])
def test_exact_rank_under_skew(skewed, pieces):
    rows, df = skewed
    order = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in rows))}
    got = selection.exact_rank(df, F.col("v"), pieces=pieces).collect()
    assert {r["row_id"]: r["rank"] for r in got} == order
    assert got[0].asDict().keys() == {"row_id", "v", "rank"}


def test_exact_rank_in_groups(skewed):
    rows, df = skewed
    got = selection.exact_rank(df.withColumn("g", F.col("row_id") % 2), F.col("v"), by=["g"]).collect()
    for g in (0, 1):
        order = [i for _, i in sorted((v, i) for i, v in rows if i % 2 == g)]
        assert [r["row_id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == order


def test_splits_are_exact_disjoint_and_stable(skewed):
    _, df = skewed
    one = {r["row_id"]: r["split"] for r in splits.split_exact(df, 0.3, 5).collect()}
    two = {r["row_id"]: r["split"] for r in splits.split_exact(df.repartition(3), 0.3, 5).collect()}
    assert one == two and len(one) == 900 and sum(s == "test" for s in one.values()) == 270
    assert splits.split_ratio(df.limit(5), 0.5, 1).where("split = 'train'").count() == 2  # round half to even
    assert [r["row_id"] for r in splits.initial_set(df, n=7, seed=2).collect()] == sorted(
        r["row_id"] for r in splits.initial_set(df, n=7, seed=2).collect())
    assert splits.initial_set(df, test_ratio=0.95).count() == 900 - 855
    tail = splits.split_ordered(df, 0.95).where("split = 'train'").collect()
    assert sorted(r["row_id"] for r in tail) == list(range(45))


def test_split_edges(spark, skewed):
    _, df = skewed
    assert splits.split_exact(df, 0.0, 1).where("split = 'test'").count() == 0
    assert splits.split_exact(df, 1.0, 1).where("split = 'train'").count() == 0
    empty = df.where("row_id < 0")
    assert splits.split_exact(empty, 0.5, 1).count() == 0
    with pytest.raises(ValueError):
        splits.split_by_group(spark.createDataFrame([(1, None), (2, "a")], "row_id bigint, g string"), "g", ["a"])


def test_active_set_counts(skewed):
    _, df = skewed
    n = lambda s: tuple(splits.active_counts(s).first())
    assert n(splits.active_init(df, -1, 1)) == (900, 0)
    assert n(splits.active_init(df, 0.1, 1)) == (90, 810)
    started = splits.active_init(df, 12, 1)
    assert n(started) == (12, 888)
    assert n(splits.active_uniform(started, 5000, 2)) == (900, 0)
    assert n(splits.active_uniform(started, 8, 2)) == (20, 880)
    assert n(splits.active_init(df, 5, 1, df.where("row_id < 10"))) == (15, 885)


def test_seed_and_masks(skewed, spark):
    _, df = skewed
    seeded = space.seed_labels(df, 15).where("yield <> -1").collect()
    assert len(seeded) == 15 and all(1 <= r["yield"] <= 100 and r["yield"] == int(r["yield"]) for r in seeded)
    odd = spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.0), (3, -5.0), (4, 3.5)], "row_id bigint, yield double")
    assert [r["yield"] for r in space.mask_labels(odd).orderBy("row_id").collect()] == [-1, -1, -1, -1, 3.5]
    assert space.mask_labels(odd.drop("yield")).where("yield = -1").count() == 5
    with pytest.raises(ValueError):
        space.mask_keep_sample(odd, 3)
    assert [r["row_id"] for r in splits.labelled_set(odd).collect()] == [4]
    assert [r["row_id"] for r in splits.labelled_set(odd, zero_is_known=True).orderBy("row_id").collect()] == [2, 4]


def test_build_space_order_and_selection(spark):
    part = lambda name, values: spark.createDataFrame(list(enumerate(values)), f"ord bigint, {name} string")
    built = space.build_space(spark, part("a", "xy"), part("b", "pqr"), part("c", "mn"))
    rows = [tuple(r) for r in built.orderBy("row_id").collect()]
    assert rows == [(i * 6 + j * 2 + k, a, b, c) for i, a in enumerate("xy") for j, b in enumerate("pqr") for k, c in enumerate("mn")]
    assert [(r["pos"], r["row_id"]) for r in space.select_rows(built, [5, 99, 0]).collect()] == [(0, 5), (2, 0)]
    with pytest.raises(IndexError):
        space.select_rows(built, [5, 99], strict=True)


def test_compose_reaction_drops_empty_parts_but_not_unknown_names(spark):
    df = spark.createDataFrame([(0, "a", "k"), (1, "b", "k"), (2, "zz", "k")], "row_id bigint, x string, y string")
    names = spark.createDataFrame([("a", ""), ("b", "CC")], "name string, structure string")
    got = space.compose_reaction(df, ["x", "y"], {"x": names}, F.lit("P")).orderBy("row_id").collect()
    assert [r["reaction"] for r in got] == ["k>>P", "CC.k>>P", None]


def test_catalog_space(spark):
    from scoutline.sources.catalog import COMPONENTS, HALIDE_GROUPS, catalog_components
    built = space.build_space(spark, *catalog_components(spark))
    assert built.count() == 360 and built.columns[1:] == list(COMPONENTS)
    assert built.distinct().count() == 360
    assert COMPONENTS["Catalyst_SMILES"]["Pd[P(Ph)3]2Cl2"].count("C1=CC=CC=C1") == 1
    last = built.orderBy(F.desc("row_id")).first()
    assert [last[c] for c in COMPONENTS] == [list(v.values())[-1] for v in COMPONENTS.values()]
    halides = spark.createDataFrame([(i, h) for i, h in enumerate(h for g in HALIDE_GROUPS.values() for h in g)], "row_id bigint, h string")
    for mode, group in HALIDE_GROUPS.items():
        held = splits.split_by_group(halides, "h", group).where("split = 'test'").collect()
        assert {r["h"] for r in held} == set(group), mode


@pytest.mark.parametrize("finish", [4096, 3, 0])
def test_grouped_thresholds_equal_sorting_each_group(spark, monkeypatch, finish):
    monkeypatch.setattr(selection, "FINISH_ROWS", finish)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = np.random.default_rng(3)
    keys = {"hot": [float(v) for v in rng.integers(0, 3, 300)], "wide": [float(v) for v in 10.0 ** rng.uniform(-5, 5, 40)],
            "odd": [float("inf"), float("-inf"), float("nan"), 1.0, 1.0, -0.0, 0.0, 5e-324, float("nan"), float("inf"), 1e308, -1e308], "one": [2.5]}
    rows = [(g, 7 * i - 50, v) for g, values in keys.items() for i, v in enumerate(values)] + [("null", 1, None), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "g string, row_id bigint, v double")
    ranks = {f"r{k}": F.lit(k) for k in (0, 1, 2, 3, 5, 9, 11, 12, 150, 301)} | {"half": F.floor(F.col("n") / 2) + 1, "last": F.col("n")}
    got = {(r.g, r.target): (str(r.key + 0.0), r.tie) for r in selection.group_thresholds(df, ["g"], F.col("v"), F.col("row_id"), ranks).collect()}
    want = {}
    for g, values in keys.items():
        ordered = sorted([(v != v, v if v == v else 0.0, 7 * i - 50) for i, v in enumerate(values)])
        for name, k in [(f"r{k}", k) for k in (0, 1, 2, 3, 5, 9, 11, 12, 150, 301)] + [("half", len(values) // 2 + 1), ("last", len(values))]:
            if 1 <= k <= len(values):
                nan, v, tie = ordered[k - 1]
                want[g, name] = ("nan" if nan else str(v + 0.0), tie)
    assert got == want
