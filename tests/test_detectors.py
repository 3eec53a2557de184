"""Contract and properties of the detectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.detectors import iforest, recon
from barloom.detectors.base import standardise
from barloom.detectors.factory import create_detector, load_detector
from barloom.operators import neighbours
from barloom.operators.evaluate import number_in_order
from barloom.session import fresh_folder
from barloom.streaming.live import read_parquet_stream, run_available, score_available, stream_scores

FEATURES = ["f1", "f2"]
KINDS = {
    "isolation_forest": {"contamination": 0.05},
    "lof": {"contamination": 0.05},
    "autoencoder": {"contamination": 0.05, "epochs": 3, "encoding_dim": 1},
}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 2))
    x[0] = [9, 9]
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf.insert(0, "Date", pd.date_range("2024-01-01", periods=300))
    pdf.insert(0, "Symbol", "A")
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("kind", KINDS)
def test_contract(spark, points, kind):
    detector = create_detector(kind, **KINDS[kind])
    with pytest.raises(ValueError, match="not been fitted"):
        detector.predict(points)
    with pytest.raises(ValueError, match="not found"):
        detector.fit(points, ["nope"])
    with pytest.raises(ValueError):
        detector.fit(points.limit(0), FEATURES)
    scored = detector.fit(points, FEATURES).predict(points)
    assert scored.columns == [*points.columns, "anomaly_score", "is_anomaly"]
    pdf = scored.toPandas()
    assert len(pdf) == 300 and pdf.anomaly_score.between(0, 1).all()
    assert abs(pdf.is_anomaly.mean() - 0.05) <= 0.02
    assert pdf.sort_values("anomaly_score").iloc[-1].f1 == 9
    path = detector.save(fresh_folder(spark, kind), spark)
    again = load_detector(spark, path).predict(points.repartition(3)).toPandas()
    key = ["Symbol", "Date"]
    both = pdf.merge(again, on=key, suffixes=("", "_2"))
    assert np.allclose(both.anomaly_score, both.anomaly_score_2) and (both.is_anomaly == both.is_anomaly_2).all()


def test_unknown_kind_and_parameter():
    with pytest.raises(ValueError):
        create_detector("tarot")
    with pytest.raises(ValueError):
        create_detector("lof", random_state=1)


@pytest.mark.parametrize("kind", ["isolation_forest", "lof"])
def test_independent_of_partitions(points, kind):
    a = create_detector(kind).fit(points, FEATURES).predict(points)
    moved = points.orderBy(F.col("f2").desc()).repartition(11)
    b = create_detector(kind).fit(moved, FEATURES).predict(moved)
    both = a.toPandas().merge(b.toPandas(), on="Date", suffixes=("", "_2"))
    assert np.allclose(both.anomaly_score, both.anomaly_score_2)


def test_nulls_are_imputed_and_kept(points):
    holed = points.withColumn("f1", F.when(F.dayofmonth("Date") != 3, F.col("f1")))
    scored = create_detector("isolation_forest").fit(holed, FEATURES).predict(holed)
    assert scored.count() == 300
    assert scored.filter(F.col("f1").isNull()).count() == holed.filter(F.col("f1").isNull()).count()
    empty = points.withColumn("f1", F.lit(None).cast("double"))
    fitted = create_detector("isolation_forest").fit(points, FEATURES)
    assert fitted.predict(empty).count() == 300


def test_constant_data_scores_zero(spark):
    df = spark.createDataFrame([("A", float(i), 3.0) for i in range(40)], "Symbol string, k double, v double")
    scored = create_detector("isolation_forest").fit(df, ["v"]).predict(df)
    assert scored.agg(F.max("anomaly_score"), F.sum("is_anomaly")).first() == (0.0, 0)


def brute_force(x, k):
    """Local outlier factors from the full distance matrix, copies of a row included."""
    order = np.lexsort(x.T[::-1])
    x = x[order]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    kdist = dist[:, -1]
    lrd = 1 / (np.maximum(kdist[near], dist).mean(axis=1) + 1e-10)
    out = np.empty(len(x))
    out[order] = lrd[near].mean(axis=1) / lrd
    return out


@pytest.mark.parametrize("leaf_rows,portion", [(1024, 4096), (16, 8)])
def test_lof_matches_brute_force(spark, monkeypatch, tiny_tasks, leaf_rows, portion):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 3)), 5 + 0.01 * rng.normal(size=(100, 3)), np.ones((60, 3)), rng.normal(size=(3, 3)).repeat(4, axis=0)])
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(neighbours, "PORTION_ROWS", portion)
    tiny_tasks(50)  # the 60 copies count as hot
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    lof = create_detector("lof", n_neighbors=10).fit(df, ["a", "b", "c"])
    raw = lof.raw_scores(lof.complete(df, [0, 0, 0])).toPandas().sort_values("i")["_raw_score"]
    assert np.allclose(raw, brute_force(x, 10), rtol=1e-9)


def test_lof_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double")
    assert create_detector("lof").fit(df, ["v"]).predict(df).count() == 3
    one = df.limit(1)
    assert create_detector("lof").fit(one, ["v"]).predict(one).first()["is_anomaly"] == 0


@pytest.mark.parametrize("leaf_rows,portion", [(1024, 4096), (16, 8)])
def test_lof_of_groups_equals_fits_apart(spark, monkeypatch, tiny_tasks, leaf_rows, portion):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(neighbours, "PORTION_ROWS", portion)
    tiny_tasks(30)
    parts = {"a": rng.normal(size=(150, 2)), "b": np.ones((40, 2)), None: 1000 * rng.normal(size=(25, 2)), "": rng.normal(size=(6, 2)), "one": rng.normal(size=(1, 2))}
    parts["b"] = np.concatenate([parts["b"], parts["a"][:60]])  # the same vectors in two groups
    rows = [(g, *map(float, v)) for g, x in parts.items() for v in x]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, a double, b double")
    lof = create_detector("lof", n_neighbors=10, partition_by="g").fit(df, ["a", "b"])
    raw = lof.raw_scores(lof.complete(df, [0, 0])).toPandas().sort_values("i")["_raw_score"].to_numpy()
    apart = [brute_force(x, min(10, len(x) - 1)) if len(x) > 1 else np.ones(1) for x in parts.values()]
    assert np.allclose(raw, np.concatenate(apart), rtol=1e-9)
    back = load_detector(spark, lof.save(fresh_folder(spark, "lof-groups"), spark))
    new = [(g, *map(float, v)) for g in parts for v in 3 * rng.normal(size=(4, 2))] + [("unseen", 0.0, 0.0)]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(new)], "i int, g string, a double, b double")
    got = back.raw_scores(back.complete(asked, [0, 0])).toPandas().set_index("i")["_raw_score"]
    for g in ("a", "b", ""):
        single = create_detector("lof", n_neighbors=10, novelty=True).fit(df.where(F.col("g") == g), ["a", "b"])
        mine = asked.where(F.col("g") == g)
        want = single.raw_scores(single.complete(mine, [0, 0])).toPandas().set_index("i")["_raw_score"]
        assert np.allclose(got[want.index], want, rtol=1e-9)
    last = back.predict(asked).where("g = 'unseen'").first()
    assert last["anomaly_score"] is None and last["is_anomaly"] is None


def test_nearest_equals_sort(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 20)
    rng = np.random.default_rng(2)
    ref, asked = rng.integers(0, 12, (400, 2)).astype(float), rng.integers(0, 12, (150, 2)).astype(float)
    schema = "id bigint, x array<double>, w bigint"
    left = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(asked)], schema)
    right = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(ref)], schema)
    for r in neighbours.k_nearest(left, right, 7).collect():
        d2 = ((ref - asked[r["id"]]) ** 2).sum(axis=1)
        expected = np.lexsort((np.arange(len(ref)), d2))[:7]
        assert [n["id"] for n in r["near"]] == expected.tolist()


def test_exact_distances_of_few_pairs(monkeypatch):
    """Rough distances decide which pairs are compared exactly, also where numbers leave single precision."""
    rng = np.random.default_rng(3)
    taken, exact = [], neighbours.squared_distances
    monkeypatch.setattr(neighbours, "squared_distances", lambda *x: taken.append(exact(*x)) or taken[-1])
    for scale, few in ((1.0, True), (1e25, False), (1e-30, False)):
        x = rng.normal(size=(300, 64)) * scale
        rows = pd.DataFrame({"id": np.arange(300), "x": list(x), "w": 1})
        taken.clear()
        got = neighbours.nearest(rows, rows, 5, True)
        if few:
            assert sum(t.size for t in taken) < 300 * 300 // 10
        d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d2, np.inf)
        assert [[n["id"] for n in one] for one in got] == np.argsort(d2, axis=1)[:, :5].tolist()


def test_visits_of_one_bough_travel_once():
    """A query whose radius reaches all 16 leaves is one row for each of two boughs, not one for each leaf."""
    leaves, x = 16, np.zeros((4, 2))
    boxes = pd.DataFrame({"leaf": range(leaves), "low": [[-1.0, -1.0]] * leaves, "high": [[1.0, 1.0]] * leaves})
    find = neighbours.box_finder(*neighbours.nested(boxes, leaves, 2), leaves, 1, np.inf)
    batch = pd.DataFrame({"id": range(4), "x": list(x), "home": [0, 3, 8, 15], "near": [[{"d2": 1.0}]] * 4})
    assert sum(len(out) for out in find([batch])) == 4 * 2


def test_novel_points(spark, points):
    lof = create_detector("lof", n_neighbors=10).fit(points, FEATURES)
    new = spark.createDataFrame([(0.5, 0.5), (30.0, -30.0)], "f1 double, f2 double")
    scored = {r["f1"]: r for r in lof.predict(new).collect()}
    assert scored[30.0]["is_anomaly"] == 1 and scored[0.5]["is_anomaly"] == 0 and scored[30.0]["anomaly_score"] == 1


@pytest.mark.parametrize("kind", ["lof", "isolation_forest"])
def test_batches_of_a_stream_score_as_a_table(spark, monkeypatch, points, kind):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    params = {"n_neighbors": 10, "novelty": True} if kind == "lof" else {"contamination": 0.05}
    detector = create_detector(kind, **params).fit(points, FEATURES)
    folder = fresh_folder(spark, "landed")
    new = points.select(*[(F.col(c) * 1.5).alias(c) for c in FEATURES]).unionByName(spark.createDataFrame([(None, 1.0), (30.0, -30.0)], "f1 double, f2 double"))
    new.repartition(3).write.parquet(folder)
    stream = read_parquet_stream(spark, folder, new.schema, files_per_batch=1)
    got = score_available(stream, detector, "scored").toPandas().sort_values(FEATURES).reset_index(drop=True)
    want = detector.score_batch(new).toPandas().sort_values(FEATURES).reset_index(drop=True)
    assert len(got) == new.count() and list(got.columns) == [*FEATURES, "anomaly_score", "is_anomaly"]
    assert np.allclose(got["anomaly_score"], want["anomaly_score"], rtol=1e-9) and (got["is_anomaly"] == want["is_anomaly"]).all()
    nothing = fresh_folder(spark, "landed")
    new.limit(0).write.parquet(nothing)
    assert score_available(read_parquet_stream(spark, nothing, new.schema), detector, "scored").count() == 0


def test_standardise_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(tuple(r) for r in standardise(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_gradient_matches_differences():
    sizes = recon.layer_sizes(3, [4], 2)
    w = recon.initial_weights(sizes, 1)
    w = w + np.random.default_rng(1).normal(0, 0.1, len(w))  # off the kink at zero
    x = np.random.default_rng(0).normal(size=(5, 3))
    loss = lambda v: ((recon.forward(x, recon.unpack(v, sizes))[-1] - x) ** 2).mean()
    g = recon.gradient(x, recon.unpack(w, sizes), {})
    for i in range(0, len(w), 5):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_training_finds_the_outlier(points):
    fitted = create_detector("autoencoder", epochs=8, encoding_dim=1, dropout_rate=0.0).fit(points, FEATURES)
    assert fitted.predict(points).orderBy(F.desc("anomaly_score")).first()["f1"] == 9


@pytest.mark.parametrize("drop", [0.0, 0.2])
def test_dense_weights_whatever_the_partitions(points, monkeypatch, drop):
    monkeypatch.setattr(recon, "DRIVER_SUMS", 8)  # 40 tasks are summed in groups, one is not
    fit = lambda n: create_detector("autoencoder", epochs=6, encoding_dim=1, dropout_rate=drop, validation_split=0.0).fit(points.repartition(n), FEATURES)
    one, many = (np.array(fit(n).state["layers"]["weights"]) for n in (1, 40))
    assert np.abs(one - recon.initial_weights(recon.layer_sizes(2, [20, 10], 1), 42)).max() > 1e-3
    assert np.allclose(one, many, atol=1e-6)


def test_sums_over_tasks_are_the_gradient_of_all_rows(spark):
    sizes = recon.layer_sizes(3, [4], 2)
    w = recon.initial_weights(sizes, 1)
    x = np.random.default_rng(0).normal(size=(50, 3))
    rows = spark.createDataFrame([(r.tolist(), i, i >= 40) for i, r in enumerate(x)], "z array<double>, key long, held_out boolean").repartition(7)
    sums = recon.summed(rows, recon.partial_sums(w, sizes, [], 0.0), len(w) + 4)
    layers = recon.unpack(w, sizes)
    held = ((recon.forward(x[40:], layers)[-1] - x[40:]) ** 2).mean(axis=1).sum()
    assert sums[1] == 40 and sums[3] == 10 and sums[2] == pytest.approx(held)
    assert np.allclose(sums[4:] / 40, recon.gradient(x[:40], layers, {}))


def test_fixed_masks_keep_a_share_of_units():
    masks = recon.unit_masks(np.arange(-5000, 5000), [3, 20, 10, 20, 3], [0, 2], 0.2)
    for m in masks.values():
        assert set(np.unique(m)) == {0.0, 1.25} and abs((m > 0).mean() - 0.8) < 0.01
        assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.05


def test_minimise_solves_a_quadratic():
    scale, at = np.array([1.0, 10.0, 100.0]), np.array([3.0, -2.0, 1.0])
    evaluate = lambda w: (float(scale @ (w - at) ** 2), 2 * scale * (w - at), float("nan"))
    assert np.allclose(recon.minimise(evaluate, np.zeros(3), 60, 0.001, 5), at, atol=1e-4)
    worse = lambda w: (float(scale @ (w - at) ** 2), 2 * scale * (w - at), float(w @ w))
    assert np.allclose(recon.minimise(worse, np.zeros(3), 60, 0.001, 3), 0)  # validation never improves


def test_stream_scores_equal_batch(spark, points, tmp_path):
    forest = create_detector("isolation_forest", contamination=0.05).fit(points, FEATURES)
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    live = read_parquet_stream(spark, str(tmp_path / "in"), points.schema, files_per_batch=1)
    got = run_available(stream_scores(live, forest), "scores").toPandas()
    both = got.merge(forest.predict(points).toPandas(), on="Date", suffixes=("", "_2"))
    assert len(both) == 300 and np.allclose(both.anomaly_score, both.anomaly_score_2)


def test_numbering_is_total(points):
    rows = number_in_order(points, [F.col("f1")]).toPandas()
    assert sorted(rows["_nth"]) == list(range(1, 301))


def forest_nodes(df, **params):
    forest = create_detector("isolation_forest", n_estimators=20, max_samples=64, **params).fit(df, ["a", "b"])
    return forest.nodes.orderBy("tree", "node").toPandas()


def test_forest_is_the_same_under_any_partitioning(spark):
    rows = spark.range(3000).select((F.col("id") % 700).cast("double").alias("a"), F.sin(F.col("id") % 90).alias("b"))
    one, seven = forest_nodes(rows.coalesce(1)), forest_nodes(rows.repartition(7))
    assert one.equals(seven)


def test_every_tree_draws_from_all_rows(spark):
    """One row in 5,000 is in a cluster of its own; the samples of 100 trees hold about as large a share of it."""
    rows = spark.range(500_000).select(F.when(F.col("id") % 5000 == 0, 100.0).otherwise(F.rand(1)).alias("a"), F.rand(2).alias("b"), F.col("id").alias("_row"))
    forest = create_detector("isolation_forest", max_samples=256)
    forest.feature_columns = ["a", "b"]
    drawn = forest.drawn(rows, 500_000, 256, 100, 42)
    total, cluster, distinct = drawn.agg(F.count("*"), F.count_if(F.get("_x", F.lit(0)) == 100.0), F.countDistinct("_h")).first()
    assert 45_000 < total < 58_000 and 2 <= cluster <= 25 and distinct > 40_000
    per_tree = drawn.groupBy("tree").count().agg(F.min("count"), F.count("*")).first()
    assert per_tree[0] >= 256 and per_tree[1] == 100


def test_forest_walks_no_further_than_its_trees_and_ends_where_they_end():
    rng = np.random.default_rng(4)
    trees = [iforest.grow(rng.normal(size=(n, 3)), rng, 6) for n in (1, 2, 40, 64)]
    columns = ["feature", "threshold", "left", "right", "path"]
    nodes = pd.concat([pd.DataFrame(t, columns=columns).assign(tree=i, node=range(len(t))) for i, t in enumerate(trees)])
    x = np.vstack([rng.normal(size=(200, 3)), [[np.inf] * 3, [-np.inf] * 3]])

    def path(tree, row):
        at = tree[0]
        while at[0] >= 0:
            at = tree[at[3] if row[at[0]] > at[1] else at[2]]
        return at[4]

    forest = iforest.Forest(nodes)
    assert forest.steps[:2] == [0, 1] and max(forest.steps) <= 6
    assert np.allclose(forest.mean_path(x), [np.mean([path(t, row) for t in trees]) for row in x], rtol=1e-15)
