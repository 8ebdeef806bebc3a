"""Forms without a bounded side, with pieces made small: neighbours in cells, lazy farthest points, cuts in tiles, bases as tables, large groups, tiled areas, histories, sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import affinity, align, connect, knn, linalg, mask, neighbours, paired, sampling, tall, tiles
from vectorloom.plans.grouped import grouped_cut, grouped_kernel_cut, grouped_landmark_cut, grouped_sample
from vectorloom.plans.kernel import KernelNCut
from vectorloom.plans.nystrom import NystromNCut, exact_cut
from vectorloom.sources import tables
from vectorloom.streaming.online import Quantiles, once


def table(spark, x, ids=None, parts=3):
    rows = [(int(i), [float(e) for e in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)


def collected(near):
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.anchor_id)
    return got


def ranked(x, y, k, kind):
    """Plain neighbours: anchors of the largest affinity, equal ones by id."""
    good = [i for i in range(len(x)) if np.isfinite(x[i]).all()]
    out = {}
    for q in range(len(y)):
        if np.isfinite(y[q]).all():
            d = [round(float(((y[q] - x[i]) ** 2).sum()) if kind == "rbf" else float(2 - 2 * affinity.unit(y[q : q + 1])[0] @ affinity.unit(x[i : i + 1])[0]), 9) for i in good]
            out[q] = [good[j] for j in np.lexsort((good, d))[:k]]
    return out


@pytest.mark.parametrize("kind", ["cosine", "rbf"])
@pytest.mark.parametrize("k", [1, 7])
def test_cells_find_all_neighbours(spark, kind, k):
    rng = np.random.default_rng(k)
    x = np.round(rng.standard_normal((300, 3)) + 5 * rng.integers(0, 3, (300, 1)), 1)  # coarse: equal distances
    x[100:200] = x[5]  # a third of all anchors is one vector
    x[7], x[8], x[9, 0] = 0.0, 0.0, np.nan
    y = np.concatenate([x[::4], np.zeros((1, 3)), np.full((1, 3), np.nan)])
    got = collected(neighbours.nearest_of_many(table(spark, x), table(spark, y), k, kind, block=16, most=20))
    assert got == ranked(x, y, k, kind)


def test_fewer_anchors_than_neighbours(spark):
    x = np.eye(3)
    got = neighbours.nearest_of_many(table(spark, x), table(spark, x[:2]), 10)
    assert collected(got) == {0: [0, 1, 2], 1: [1, 0, 2]}
    assert neighbours.nearest_of_many(table(spark, x).where("false"), table(spark, x), 10).count() == 0
    assert neighbours.nearest_of_many(table(spark, x), table(spark, x).where("false"), 10).count() == 0


@pytest.mark.parametrize("kind", ["cosine", "rbf"])
@pytest.mark.parametrize("k", [5, None])
def test_extrapolation_does_not_depend_on_how_anchors_are_met(spark, kind, k):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((120, 4)), rng.standard_normal((40, 4))
    y[3] = np.nan
    anchors = table(spark, x).withColumn("out", F.slice("v", 1, 2))
    a, b = (knn.extrapolate(anchors, table(spark, y), k, kind, 0.7, most=m).orderBy("id").collect() for m in (1000, 50))
    assert [r.id for r in a] == [r.id for r in b]
    np.testing.assert_allclose([r.out for r in a], [r.out for r in b], atol=1e-9)  # squared distances have ten digits
    if k:
        a, b = (collected(knn.nearest(anchors, table(spark, y), k, kind, 0.7, most=m)) for m in (1000, 50))
        assert a == b


def test_streams_carry_groups_over_batches(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("y"), F.col("id").alias("q"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        sums = {r.id: r.y for r in paired.added(df).collect()}
        first = paired.first_of(df.select("id", "q"), "id", ["q"], 205).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sums == {i: [float(len(range(i, 5000, 3))), float(sum(range(i, 5000, 3)))] for i in range(3)}
    assert sorted((r.id, r["rank"], r.q) for r in first) == sorted((i, n + 1, i + 3 * n) for i in range(3) for n in range(205))


@pytest.mark.parametrize("parts, pool, keep", [(1, 1024, 256), (4, 16, 6), (16, 16, 2)])
def test_farthest_points_do_not_depend_on_partitions(spark, parts, pool, keep):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((700, 2)), 1)  # equal rows and equal distances
    x[13] = np.nan
    good = np.nonzero(np.isfinite(x).all(1))[0]
    want = sorted(good[sampling.farthest(x[good], 40)].tolist())
    got = sampling.fps(table(spark, x, parts=parts), "euclidean", 40, pool=pool, keep=keep)
    assert [r.id for r in got.orderBy("id").collect()] == want


def test_farthest_points_of_few_rows(spark):
    x = np.ones((5, 2))
    assert [r.id for r in sampling.fps(table(spark, x), "euclidean", 3, pool=16, keep=1).orderBy("id").collect()] == [0, 1, 2]
    assert sampling.fps(table(spark, x), "euclidean", 9).count() == 5
    assert sampling.fps(table(spark, x).where("false"), "euclidean", 3).count() == 0


def test_products_in_tiles(spark):
    rng = np.random.default_rng(2)
    x, y, a = rng.standard_normal((90, 5)), rng.standard_normal((70, 5)), rng.standard_normal((70, 3))
    columns = spark.createDataFrame([(i, y[i].tolist(), a[i].tolist()) for i in range(70)], "id long, v array<double>, a array<double>")
    got = tiles.product(table(spark, x), columns, "cosine", 0.5, held=16, stream=20).orderBy("id").collect()
    np.testing.assert_allclose([r.y for r in got], affinity.block(y, x, "cosine", 0.5) @ a, atol=1e-12)


def test_dependent_directions_are_dropped(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 3)) * [1, 1e6, 1e-6]
    x = np.concatenate([x, x[:, :1] + x[:, 1:2], np.zeros((200, 1))], 1)
    df = table(spark, x).withColumnRenamed("v", "x")
    _, q = tables.to_numpy(tall.orthonormal(df), 1000, "x")
    assert q.shape == (200, 3) and np.abs(q.T @ q - np.eye(3)).max() < 1e-12
    small = x[:, :3]
    assert np.abs(small - q @ (q.T @ small)).max() < 1e-6 * np.abs(small).max()


@pytest.mark.parametrize("find", [tall.krylov, tall.lobpcg])
def test_solvers_over_tables(spark, find):
    rng = np.random.default_rng(5)
    u = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    values = np.concatenate([[5.0, -4.0, 3.0, 3.0], np.linspace(0.5, -0.5, 146)])
    m = (u * values) @ u.T
    shared = spark.sparkContext.broadcast(m)

    def apply(basis):
        ids, x = tables.to_numpy(basis, 1000, "x")
        return spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, shared.value @ x, strict=True)], "id long, y array<double>")

    w, x, off = find(apply, spark.range(150), 4)
    _, v = tables.to_numpy(x, 1000, "x")
    np.testing.assert_allclose(w, [5, -4, 3, 3], atol=1e-9)
    assert off <= linalg.RESIDUAL and np.abs(m @ v - v * w).max() < 1e-7 and np.abs(v.T @ v - np.eye(4)).max() < 1e-9


@pytest.mark.parametrize("kind", ["cosine", "rbf"])
def test_a_cut_in_tiles_is_that_in_memory(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 4)) * 0.3 + 2 * np.eye(4)[np.arange(90) % 3]
    df = table(spark, x)
    ids, want = tables.to_numpy(NystromNCut(3, kind, 0.5).fit_transform(df), 1000, "ev")
    model = NystromNCut(3, kind, 0.5, eig_solver="lobpcg")
    _, got = tables.to_numpy(model.fit_transform(df, most=50), 1000, "ev")
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-7)
    _, again = tables.to_numpy(model.transform(df), 1000, "ev")
    np.testing.assert_allclose(again, got, atol=1e-7)
    with pytest.raises(ValueError, match="tiles"):
        model.update(df)


def test_missing_rows_of_a_cut_in_tiles(spark):
    x = np.eye(3)[np.arange(30) % 3] + 0.01 * np.arange(30)[:, None]
    gone = x.copy()
    gone[4] = np.nan
    ev, w = exact_cut(table(spark, gone), 2, solver="lobpcg", held=8)
    _, got = tables.to_numpy(ev, 100, "ev")
    other, v = exact_cut(table(spark, np.delete(x, 4, 0), ids=np.delete(np.arange(30), 4)), 2, solver="lobpcg", held=30)
    _, want = tables.to_numpy(other, 100, "ev")
    assert np.isnan(got[4]).all()
    np.testing.assert_allclose(w, v, atol=1e-12)
    np.testing.assert_allclose(np.delete(got, 4, 0)[:, 0], want[:, 0], atol=1e-9)


def grouped(spark):
    """Two groups of planted clusters and one of null; a missing row in each."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 4)) * 0.2 + 2 * np.eye(4)[np.arange(120) % 3]
    x[[5, 50, 100]] = np.nan
    return table(spark, x).withColumn("g", F.when(F.col("id") < 45, "a").when(F.col("id") < 95, "b"))


def by_id(df, column="ev"):
    return {r.id: r[column] for r in df.collect()}


@pytest.mark.parametrize("method", ["random", "fps"])
def test_large_groups_are_cut_as_small_ones_are(spark, method):
    df, config = grouped(spark), sampling.SampleConfig(method, 12)
    # fewer directions than the landmarks' rank, so that vectors are determined
    for cut in (lambda n: grouped_landmark_cut(df, "g", 3, config, gamma=0.5, large=n), lambda n: grouped_kernel_cut(df, "g", 3, 64, gamma=0.5, large=n)):
        small, large = by_id(cut(1000)), by_id(cut(0))
        assert set(small) == set(large)
        for i in small:
            np.testing.assert_allclose(np.abs(large[i]), np.abs(small[i]), atol=1e-6)
        mixed = by_id(cut(46))  # only b is large
        assert len(mixed) == 120 and np.allclose(np.abs(mixed[60]), np.abs(small[60]), atol=1e-6)
    assert {tuple(r) for r in grouped_sample(df, "g", config, large=0).collect()} == {tuple(r) for r in grouped_sample(df, "g", config, large=1000).collect()}


def test_large_groups_are_cut_exactly_and_aligned(spark):
    df = grouped(spark).where("id < 95 and id % 2 = 0")
    small, large = grouped_cut(df, "g", 3, gamma=0.5), grouped_cut(df, "g", 3, gamma=0.5, large=0, held=10)
    a, b = by_id(small), by_id(large)
    for i in a:
        np.testing.assert_allclose(np.abs(b[i]), np.abs(a[i]), atol=1e-6)
    # Rows of different lengths, so that no two axes weigh the same.
    held = spark.createDataFrame([(r.g, r.id, [e * (1 + r.id % 7) for e in r.ev]) for r in small.collect() if r.id != 4], "g string, id long, ev array<double>")
    for order in align.SORTS:
        assert by_id(align.grouped_align(held, "g", order, large=0), "cluster") == by_id(align.grouped_align(held, "g", order), "cluster")


def test_groups_without_finite_rows(spark):
    df = table(spark, np.full((6, 3), np.nan)).withColumn("g", F.lit(1))
    config = sampling.SampleConfig("random", 4)
    for got in (grouped_landmark_cut(df, "g", 2, config, large=0), grouped_kernel_cut(df, "g", 2, 16, large=0)):
        assert got.count() == 6 and all(np.isnan(r.ev).all() for r in got.collect())
    assert align.grouped_align(df, "g", vector="v", large=0).where("cluster is null").count() == 6
    assert grouped_sample(df, "g", config, large=0).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_areas_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(9)
    lit = rng.random((2, 13, 17)) < 0.35
    lit[1, 6] = True  # a line through all tiles
    rows = [(i, y, x, int(lit[i, y, x])) for i in range(2) for y in range(13) for x in range(17)]
    got = {(r.img, r.y, r.x): r.comp for r in mask.areas(spark.createDataFrame(rows, "img int, y int, x int, mask int"), tile=tile).collect()}
    for i in range(2):
        name = {(y, x): y * 1_000_000 + x for y in range(13) for x in range(17) if lit[i, y, x]}
        changed = True
        while changed:
            changed = False
            for y, x in name:
                least = min(name[p] for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if p in name)
                changed |= least < name[y, x]
                name[y, x] = least
        assert {(y, x): got[i, y, x] for y in range(13) for x in range(17)} == {(y, x): name.get((y, x)) for y in range(13) for x in range(17)}


def test_components_of_structs_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9] + [(5, 5), (30, 31), (31, 30)], "a long, b long").select(F.struct("a").alias("u"), F.struct(F.col("b").alias("a")).alias("v"))
    got = {r.u.a: r.label.a for r in connect.components(edges).collect()}
    assert got == {**{i: 0 for i in range(10)}, **{i: 10 for i in range(10, 21)}, 30: 30, 31: 30}
    assert connect.components(edges.where("false")).count() == 0


def test_wide_rows_have_the_directions_of_narrow_ones(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((300, 40)) * np.concatenate([[9, 7, 5], np.ones(37)]) + 3
    x[3] = np.nan
    df = table(spark, x)
    (m, u, w), (n, v, y) = linalg.leading(df, 3), linalg.leading(df, 3, wide=10)
    np.testing.assert_allclose(m, n, atol=1e-12)
    np.testing.assert_allclose(w, y, rtol=1e-8)
    np.testing.assert_allclose(np.abs((u * v).sum(0)), 1, atol=1e-8)


def test_a_history_makes_many_updates_one(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((200, 5)) * 0.3 + 2 * np.eye(5)[np.arange(200) % 4]
    df = table(spark, x)
    marks, rest = df.where("id < 30").select("id"), df.where("id >= 30")
    whole = NystromNCut(4, affinity_focal_gamma=0.5).fit(df, marks)
    whole.update(rest)
    model = NystromNCut(4, affinity_focal_gamma=0.5, history=f"{tmp_path}/history").fit(df, marks)
    for k in range(4):
        model.update(rest.where(F.col("id") % 4 == k))
    model.update(df.where("id % 3 = 0"))  # rows that came before, and landmarks
    again = NystromNCut(4, affinity_focal_gamma=0.5, history=f"{tmp_path}/history").fit(df, marks)
    again.refresh(spark)  # another process
    for m in (model, again):
        np.testing.assert_allclose(m.eigenvalues_, whole.eigenvalues_, atol=1e-9)
        _, got = tables.to_numpy(m.transform(df), 1000, "ev")
        _, want = tables.to_numpy(whole.transform(df), 1000, "ev")
        np.testing.assert_allclose(got, want, atol=1e-6)


def test_a_loaded_kernel_cut_goes_on(spark, tmp_path):
    rng = np.random.default_rng(12)
    df = table(spark, rng.standard_normal((80, 4)))
    first = KernelNCut(2, 32).fit(df.where("id < 20"), df.where("id < 10").select("id"))
    first.save(spark, f"{tmp_path}/model")
    first.update(df.where("id >= 20"))
    second = KernelNCut(2, 32).load(spark, f"{tmp_path}/model")
    second.update(df.where("id >= 20"))
    np.testing.assert_allclose(second.eigenvalues_, first.eigenvalues_, rtol=1e-12)
    assert second.transform_anchors().count() == 10


def test_quantiles_of_batches(spark, tmp_path):
    rng = np.random.default_rng(13)
    x = rng.exponential(size=20_000)
    sketch = Quantiles(f"{tmp_path}/q", ["a", "b"])
    assert sketch.values(spark, [0.5]) == {"a": [None], "b": [None]}
    for k in range(3):
        rows = [(float(e), None) for e in x[k::3]] + [(float("nan"), None), (None, 1.0 if k == 2 else None)]
        sketch(spark.createDataFrame(rows, "a double, b double"), k)
    again = Quantiles(f"{tmp_path}/q", ["a", "b"])
    again(spark.createDataFrame([(5.0, 5.0)], "a double, b double"), 2)  # a replay of the last batch
    ps = [0.01, 0.05, 0.5, 0.95, 0.99]
    got = again.values(spark, ps)
    assert got["b"] == [1.0] * 5
    assert np.abs((x[:, None] <= np.array(got["a"])).mean(0) - ps).max() < 0.01
    scaled = [r.a for r in again.normalize(spark.createDataFrame([(-1.0, 1.0), (100.0, 1.0)], "a double, b double")).collect()]
    assert scaled == [0.0, 1.0]


def test_keys_that_came_before_are_left_out(spark, tmp_path):
    def put(name, ids):
        spark.createDataFrame([(i, f"2024-01-01 00:00:{i % 60:02d}") for i in ids], "id long, t string").selectExpr("id", "cast(t as timestamp) as t").coalesce(1).write.parquet(f"{tmp_path}/in/part={name}")

    seen = []
    put(0, [1, 2, 2, 3])
    for name, ids in ((1, [3, 4]), (2, [1, 5])):
        put(name, ids)
        stream = spark.readStream.schema("id long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
        rows = once(stream, "id", "t", "1 hour")
        rows.writeStream.foreachBatch(lambda b, n: seen.extend(r.id for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [1, 2, 3, 4, 5]
