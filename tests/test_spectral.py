"""Properties and edge cases of the spectral library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import color, vec
from vectorloom.operators import affinity, align, knn, layout, linalg, mask, sampling, stats
from vectorloom.plans.grouped import grouped_cut, grouped_kernel_cut, grouped_landmark_cut, grouped_sample
from vectorloom.plans.kernel import KernelNCut
from vectorloom.plans.nystrom import NystromNCut, exact_cut
from vectorloom.sources import tables
from vectorloom.streaming.online import VectorSum, updater


def planted(n=120, d=6, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * 0.2
    x[np.arange(n), np.arange(n) % 3] += 2
    return x


def embedding(df):
    rows = sorted(df.collect(), key=lambda r: r.id)
    return np.array([r.ev for r in rows])


def test_vectors_normalise_missing_rows(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, [1.0]), (4, [3.0, 4.0])], "vec_id long, embedding array<float>")
    got = {r.id: r.v for r in tables.vectors(df, dim=2).collect()}
    assert got[4] == [3.0, 4.0] and all(np.isnan(v).any() for k, v in got.items() if k != 4)


def test_zero_and_nan_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 1.0])], "id long, v array<double>")
    got = {r.id: r.u for r in df.select("id", vec.normalized("v").alias("u")).collect()}
    assert got[1] == [0.0, 0.0] and np.isnan(got[2]).all()


def test_full_sampled_and_matrix_free_cuts_agree(spark):
    x = planted()
    df = tables.from_numpy(spark, x).repartition(5)
    a = affinity.block(x, x, "cosine", 0.5)
    s = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    want = np.sort(np.linalg.eigvalsh(s))[::-1][:3]
    full = NystromNCut(3, affinity_focal_gamma=0.5)
    ev = embedding(full.fit_transform(df))
    assert np.allclose(full.eigenvalues_, want) and np.allclose(ev.T @ ev, np.eye(3), atol=1e-8)
    free, w = exact_cut(df, 3, gamma=0.5)
    other = embedding(free)
    assert np.allclose(w, want, atol=1e-6) and np.allclose(other @ other.T, ev @ ev.T, atol=1e-5)
    every = embedding(NystromNCut(3, affinity_focal_gamma=0.5, sample_config=sampling.SampleConfig("fps", 500)).fit_transform(df))
    assert np.allclose(every, ev, atol=1e-8)


@pytest.mark.parametrize("make", [lambda: NystromNCut(3, affinity_focal_gamma=0.5, sample_config=sampling.SampleConfig("random", 40)), lambda: NystromNCut(3, "rbf", 0.5, sample_config=sampling.SampleConfig("fps", 40)), lambda: KernelNCut(3, 256, affinity_focal_gamma=0.5), lambda: KernelNCut(3, 256, "rbf", 0.5, sampling.SampleConfig("random", 60))])
def test_planted_groups_are_found(spark, make):
    df = tables.from_numpy(spark, planted())
    got = align.canonical(align.AxisAlign().fit_transform(make().fit_transform(df), hard=True)).collect()
    assert {(r.id, r.rep) for r in got} == {(i, i % 3) for i in range(120)}


@pytest.mark.parametrize("sort", align.SORTS)
def test_axes_are_orthogonal(spark, sort):
    df = tables.from_numpy(spark, planted()).select("id", F.slice("v", 1, 3).alias("ev"))
    r = align.AxisAlign(sort).fit(df).r
    assert np.allclose(r @ r.T, np.eye(3))
    with pytest.raises(ValueError):
        align.AxisAlign("other")


def test_partitions_do_not_matter(spark):
    df = tables.from_numpy(spark, planted())
    config = sampling.SampleConfig("random", 30)
    a, b = (embedding(NystromNCut(3, affinity_focal_gamma=0.5, sample_config=config).fit_transform(d)) for d in (df.repartition(1), df.repartition(7)))
    assert np.allclose(a, b, atol=1e-8)


def test_missing_rows_give_nan_and_leave_the_rest(spark):
    x = planted()
    y = np.vstack([x, np.full((2, 6), np.nan)])
    y[121, 0] = 1.0
    for model in (NystromNCut(3, affinity_focal_gamma=0.5), KernelNCut(3, 128, affinity_focal_gamma=0.5)):
        got = embedding(model.fit_transform(tables.from_numpy(spark, y)))
        assert np.isnan(got[120:]).all() and np.isfinite(got[:120]).all()


def test_solvers_agree_and_signs_are_fixed():
    x = planted(40)
    a = affinity.block(x, x, "cosine", 1.0)
    first = linalg.solve_eig(a, 3, "eigh")
    for s in linalg.SOLVERS:
        u, w = linalg.solve_eig(a, 3, s, buffer=0.1)
        assert np.allclose(w, first[1]) and np.allclose(np.abs(u.T @ first[0]), np.eye(3), atol=1e-6) and (u.sum(0) >= -1e-9).all()
    with pytest.raises(ValueError):
        linalg.solve_eig(a, 3, "other")
    w, _ = linalg.subspace(lambda q: a @ q, 40, 3)
    assert np.allclose(w, first[1], atol=1e-6)


def test_scale_invariance(spark):
    x = planted(30)
    assert np.allclose(affinity.block(x, x, "cosine", 1.0), affinity.block(5 * x, 5 * x, "cosine", 1.0))
    assert np.allclose(affinity.block(x, x, "rbf", 1.0, affinity.sigma(x)), affinity.block(5 * x, 5 * x, "rbf", 1.0, affinity.sigma(5 * x)))
    with pytest.raises(ValueError):
        affinity.block(x, x, "other", 1.0)


def test_farthest_points_match_brute_force(spark):
    x = planted(50, 4)
    df = tables.from_numpy(spark, x)
    chosen = [0]
    while len(chosen) < 8:
        d = np.min([((x - x[i]) ** 2).sum(1) for i in chosen], 0)
        d[chosen] = -1
        chosen.append(int(d.argmax()))
    got = sampling.subsample(df, "euclidean", sampling.SampleConfig("fps", 8))
    assert sorted(chosen) == [r.id for r in got.orderBy("id").collect()]


def test_sampling_edges(spark):
    df = tables.from_numpy(spark, np.vstack([planted(5), np.full((1, 6), np.nan)]))
    assert sampling.subsample(df, "cosine", sampling.SampleConfig("fps", 100)).count() == 6  # as large as the table: all
    assert sampling.fps(df, "cosine", 100).count() == 5
    assert 5 not in [r.id for r in sampling.random_sample(df, 5).collect()]
    assert sampling.fps(df.limit(0), "cosine", 3).count() == 0
    for bad in (lambda: sampling.SampleConfig("other"), lambda: sampling.SampleConfig("fps_recursive")):
        with pytest.raises(ValueError):
            bad()


def test_neighbours_clip_k_and_pass_empty_queries(spark):
    df = tables.from_numpy(spark, planted(6)).withColumn("out", F.slice("v", 1, 2))
    got = knn.extrapolate(df, df, 50).collect()
    assert len(got) == 6 and knn.extrapolate(df, df.limit(0), 3).count() == 0
    native = {(r.id, r.pos): r.value for r in knn.extrapolate_native(df, df, 3).collect()}
    for r in knn.extrapolate(df, df, 3).collect():
        assert np.allclose(r.out, [native[r.id, 0], native[r.id, 1]])


def test_constant_column_and_nan_quantiles(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, float("nan")), (3, 2.0, 3.0)], "id long, a double, b double")
    assert [r.a for r in stats.quantile_normalize(df, ["a"]).collect()] == [0.0] * 3
    assert stats.quantiles(df, ["b"], [0.5])["b"] == [2.0]


def test_rotations(spark):
    one = spark.range(1).select(*(c.alias(n) for p in range(7) for c, n in zip(color.rotate_rgb_cube(F.lit(0.1), F.lit(0.2), F.lit(0.3), p), (f"r{p}", f"g{p}", f"b{p}"), strict=True))).first()
    assert (one.r1, one.g1, one.b1) == (0.3, 0.1, 0.2) and one.r6 == 0.9 and (one.r3, one.g3) == (0.1, 0.2)
    with pytest.raises(AssertionError):
        color.rotate_rgb_cube(F.lit(0.1), F.lit(0.2), F.lit(0.3), 7)


def test_lab_white_and_black(spark):
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(color.lab_to_rgb(F.lit(100.0), F.lit(0.0), F.lit(0.0)), "rgb", strict=True)), *(c.alias(f"k{n}") for c, n in zip(color.lab_to_rgb(F.lit(0.0), F.lit(0.0), F.lit(0.0)), "rgb", strict=True))).first()
    assert np.allclose([r.r, r.g, r.b], 1, atol=2e-3) and np.allclose([r.kr, r.kg, r.kb], 0, atol=2e-3)


def test_areas_are_eight_connected(spark):
    df = spark.createDataFrame([(0, y, x, int((y, x) in {(0, 0), (1, 1), (2, 2), (0, 4)})) for y in range(3) for x in range(5)], "img int, y int, x int, mask int")
    assert sorted(r.area for r in mask.area_table(df).collect()) == [1, 3]
    assert mask.clean_mask(df, 2).where("mask = 255").count() == 3


def test_groups_are_cut_alone(spark):
    x = planted(60)
    df = tables.from_numpy(spark, np.vstack([x, np.full((1, 6), np.nan)])).withColumn("g", F.when(F.col("id") < 20, "a").otherwise("b"))
    got = {r.id: r.ev for r in grouped_cut(df, "g", 2, gamma=0.5).collect()}
    alone = embedding(NystromNCut(2, affinity_focal_gamma=0.5).fit_transform(df.where("g = 'a'").select("id", "v")))
    assert np.allclose([got[i] for i in range(20)], alone, atol=1e-8) and np.isnan(got[60]).all()
    with pytest.raises(Exception, match="more than 5 rows"):
        grouped_cut(df, "g", 2, most=5).collect()


def test_lab_cube_is_in_range(spark):
    df = tables.from_numpy(spark, np.random.default_rng(0).standard_normal((50, 3)) * [3, 2, 1])
    for full in (True, False):
        got = np.array([[r.r, r.g, r.b] for r in layout.lab_cube(df, full_range=full).collect()])
        assert got.shape == (50, 3) and np.isfinite(got).all() and got.min() >= 0 and got.max() <= 1 and got.std(0).min() > 0.05


@pytest.mark.parametrize("n", [1, 2, 9, 4000])
def test_exact_quantiles_match_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(stats, "FETCH", 40)
    r = np.random.default_rng(n)
    x = np.round(r.standard_normal((n, 4)) * [1e-3, 1, 1e6, 1], 3)
    x[:, 3] = 0
    x[r.random((n, 4)) < 0.1] = np.nan
    ps = [0, 0.01, 0.05, 0.5, 0.95, 1]
    got = stats.vector_quantiles(tables.from_numpy(spark, x).repartition(3), "v", ps)
    for j in range(4):
        col = x[np.isfinite(x[:, j]), j]
        assert np.isnan(got[:, j]).all() if not len(col) else np.allclose(got[:, j], np.quantile(col, ps), rtol=1e-12, atol=1e-12)
    assert stats.vector_quantiles(tables.from_numpy(spark, x).limit(0), "v", ps).shape == (6, 0)


def test_iterative_solvers_reach_the_residual_on_close_values():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((700, 700)))[0]
    values = np.concatenate([[1.0], 0.03 * 0.999 ** np.arange(699)])
    a = (q * values) @ q.T
    for f in (linalg.krylov, linalg.lobpcg):
        w, v, off = f(lambda x: a @ x, 700, 10)
        assert off <= linalg.RESIDUAL and np.allclose(w, values[:10], atol=1e-9) and np.allclose(v.T @ v, np.eye(10), atol=1e-8)
        assert np.linalg.norm(q[:, :10].T @ v) ** 2 > 10 - 1e-6
    negative = (q * (values * np.where(np.arange(700) == 3, -1, 1))) @ q.T
    for s in linalg.SOLVERS:
        assert np.allclose(np.sort(linalg.solve_eig(negative, 5, s)[1]), np.sort(values[:5] * [1, 1, 1, -1, 1]), atol=1e-8)


def test_largest_keeps_the_order_of_equal_weights():
    w = np.array([[1.0, 3.0, 2.0, 3.0, 2.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    assert knn.largest(w, 3).tolist() == [[1, 3, 2], [0, 1, 2]]
    r = np.random.default_rng(0).integers(0, 5, (50, 30)).astype(float)
    assert (knn.largest(r, 7) == np.argsort(-r, axis=1, kind="stable")[:, :7]).all()


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(affinity, "CELLS", 50)
    x = planted(20)
    df = tables.from_numpy(spark, x)
    want = {"cosine": 1 - affinity.unit(x) @ affinity.unit(x).T, "euclidean": np.linalg.norm(x[:, None] - x, axis=2)}
    for kind, d in want.items():
        assert all(abs(r.d - d[r.i, r.j]) < 1e-7 for r in affinity.distances(df, df, kind).collect())
    monkeypatch.setattr(affinity, "MOST", 10)
    with pytest.raises(ValueError):
        affinity.affinities(df)


def test_order_of_axes_uses_the_rows_as_they_are(spark):
    x = np.array([[1.0, 0.02]] * 10 + [[0.3, 10.0]] * 3)
    df = tables.from_numpy(spark, x).withColumnRenamed("v", "ev")
    for method, first in (("count", 0), ("norm", 1), ("marginal_norm", 1)):
        r = align.AxisAlign(method).fit(df).r
        assert np.abs(r[0]).argmax() == first


def test_groups_match_the_same_rows_alone(spark):
    x = planted(90)
    df = tables.from_numpy(spark, x).withColumn("g", F.when(F.col("id") < 40, 1).otherwise(2))
    alone = df.where("g = 2").select("id", "v")
    config = sampling.SampleConfig("random", 20)
    pairs = [
        (grouped_landmark_cut(df, "g", 3, config, gamma=0.5), NystromNCut(3, affinity_focal_gamma=0.5, sample_config=config).fit_transform(alone)),
        (grouped_kernel_cut(df, "g", 3, 256, gamma=0.5), KernelNCut(3, 256, affinity_focal_gamma=0.5).fit_transform(alone)),
    ]
    for grouped, single in pairs:
        got, want = embedding(grouped.where("g = 2")), embedding(single)
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    for method in ("random", "fps"):
        c = sampling.SampleConfig(method, 7)
        assert {r.id for r in grouped_sample(df, "g", c).where("g = 2").collect()} == {r.id for r in sampling.subsample(alone, "cosine", c).collect()}
    ev = grouped_cut(df, "g", 3, gamma=0.5)
    found = {(r.id, r.cluster) for r in align.grouped_align(ev, "g", "marginal_norm").where("g = 2").collect()}
    single = {(r.id, r.cluster) for r in align.AxisAlign("marginal_norm").fit_transform(ev.where("g = 2").select("id", "ev"), hard=True).collect()}
    assert found == single


def test_pools_of_tasks_lead_to_the_exact_farthest_points(spark):
    x = np.random.default_rng(6).standard_normal((3000, 5))
    df = tables.from_numpy(spark, x).repartition(6)
    want = sorted(sampling.farthest(x, 40).tolist())
    for pool in (1024, 20):
        assert [r.id for r in sampling.fps(df, "euclidean", 40, pool=pool).orderBy("id").collect()] == want


def test_stream_state_survives_a_restart(spark, tmp_path):
    df = tables.from_numpy(spark, planted(60))
    part = lambda k: df.where(F.col("id") % 3 == k)
    first = VectorSum(f"{tmp_path}/sum")
    first(part(0), 0)
    first(part(1), 1)
    second = VectorSum(f"{tmp_path}/sum")
    second(part(1), 1)  # replayed
    second(part(2), 2)
    assert np.allclose(second.total, planted(60).sum(0))
    make = lambda: KernelNCut(3, 64, affinity_focal_gamma=0.5).fit(part(0))
    whole = make()
    for k in (1, 2):
        whole.update(part(k))
    updater(make(), f"{tmp_path}/model")(part(1), 0)
    model = make()
    updater(model, f"{tmp_path}/model")(part(2), 1)
    assert model.total == whole.total and np.allclose(embedding(model.transform(df)), embedding(whole.transform(df)))


def test_ceildiv_is_exact_beyond_53_bits(spark):
    rows = [(2**53 + 1, 2), (-7, 2), (7, 7), (0, 3)]
    got = [spark.createDataFrame([(a,)], "a long").select(vec.ceildiv("a", b).alias("q")).first().q for a, b in rows]
    assert got == [-(-a // b) for a, b in rows]


def test_curve_of_the_layout():
    a, b = layout._curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01


def test_any_reduction_and_colouring(spark):
    df = tables.from_numpy(spark, planted(40))
    got = layout.color_rows(df, lambda x, metric, seed: x[:, :3], lambda y, q: y.select("id", *(F.col("out")[i].alias(c) for i, c in enumerate("rgb"))), num_sample=40, knn=1)
    assert all(np.allclose([r.r, r.g, r.b], planted(40)[r.id][:3], atol=1e-6) for r in got.collect())


def test_models_are_stored_and_loaded(spark, tmp_path):
    df = tables.from_numpy(spark, planted(60))
    for k, make in enumerate((lambda: NystromNCut(3, affinity_focal_gamma=0.5, sample_config=sampling.SampleConfig("random", 20)), lambda: KernelNCut(3, 64, affinity_focal_gamma=0.5))):
        model = make()
        model.fit_transform(df)
        want = embedding(model.transform(df))
        model.save(spark, f"{tmp_path}/{k}")
        loaded = embedding(make().load(spark, f"{tmp_path}/{k}").transform(df))
        assert np.allclose(loaded, want, atol=1e-8)
