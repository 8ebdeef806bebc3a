"""What moves between tasks grows no faster than the table; forms beyond a bounded side give what the bounded ones do."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_any_size import collected, ranked, table
from vectorloom.functions import vec
from vectorloom.operators import affinity, layout, neighbours, tall, tiles
from vectorloom.plans import catalog, grouped, nystrom
from vectorloom.sources import tables


def vectors(n: int, dim: int = 5, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


def test_copies_of_a_row_do_not_grow_with_the_number_of_pieces(spark, monkeypatch):
    x, moved, real = vectors(120), [], tiles.paired

    def counting(held, streamed, *rest):
        moved.append(held.count() + streamed.count())
        return real(held, streamed, *rest)

    monkeypatch.setattr(tiles, "paired", counting)
    columns = table(spark, x).withColumn("a", F.array(F.lit(1.0)))
    got = tiles.product(table(spark, x), columns, held=2).orderBy("id").collect()
    assert np.allclose([r.y[0] for r in got], affinity.block(x, x, "cosine", 1.0).sum(1))
    assert moved[0] <= 120 * 2 * tiles._few(columns)  # 60 pieces would be over 7,000 rows


def test_symmetric_products(spark):
    x = vectors(90)
    rows = table(spark, x).select("id", "v", F.array(F.col("v")[0], F.lit(1.0)).alias("a"), (F.col("id") + 1.0).alias("s"))
    for kind, scale in (("cosine", None), ("rbf", 1.7)):
        got = tiles.symmetric(rows, 90, kind, 0.5, scale, held=7).orderBy("id").collect()
        want = np.arange(1, 91)[:, None] * (affinity.block(x, x, kind, 0.5, scale) @ np.stack([x[:, 0], np.ones(90)], 1))
        assert np.allclose([r.y for r in got], want)


def test_pairs_of_two_sides_of_any_size(spark, monkeypatch):
    x, y = vectors(70), vectors(50, seed=1)
    y[3] = np.nan
    found = lambda pairs, n: {(r.i, r.j): r[n] for r in pairs.collect()}
    cases = [
        lambda: found(affinity.distances(table(spark, x), table(spark, y)), "d"),
        lambda: found(affinity.distances(table(spark, x), table(spark, y), "euclidean"), "d"),
        lambda: found(affinity.affinities(table(spark, x)), "w"),
        lambda: found(affinity.affinities(table(spark, x), kind="rbf"), "w"),
        lambda: found(affinity.normalized_affinities(table(spark, x)), "w"),
        lambda: {r.id: r.degree for r in affinity.all_degrees(table(spark, x)).collect()},
    ]
    want = [f() for f in cases]
    monkeypatch.setattr(affinity, "MOST", 40)
    for f, w in zip(cases, want, strict=True):
        got = f()
        assert got.keys() == w.keys() and np.allclose([got[k] for k in w], list(w.values()), equal_nan=True)


def test_every_core_gets_a_piece(spark):
    df = spark.range(1)
    assert tiles.pieces(df, 50_000, tiles.HELD, tiles.HELD, True) == tiles._few(df, True) > 1
    assert tiles.pieces(df, 10**7, 100, tiles.HELD) == -(-(10**7) // tiles.HELD)


def test_farthest_points_of_a_table_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(affinity, "MOST", 100)
    got = catalog.QUERIES["fps_properties"](spark, "/root/testdata/sf0.001").collect()
    assert [tuple(r) for r in got] == [("fps", True, True), ("fps_recursive", True, True)]


def test_colours_apart_by_sums_in_tiles(spark):
    x = np.random.default_rng(2).random((60, 3))
    label = np.arange(60) % 3
    for shift in (0.0, 1.0):
        v = x + shift * label[:, None]
        d, same = np.sqrt(((v[:, None] - v) ** 2).sum(2)), label[:, None] == label
        rows = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(60)], "id long, v array<double>, label int")
        assert catalog._apart(rows, 60) == (d[same].mean() < 0.8 * d[~same].mean()) == bool(shift)


@pytest.mark.parametrize("kind, far", [("cosine", 0.0), ("rbf", 0.0), ("rbf", 30.0), ("rbf", 1e6)])  # far: single precision tells nothing, at last double precision little
def test_a_query_is_sent_once_to_a_region_however_many_its_blocks(spark, monkeypatch, kind, far):
    x, moved, real = np.round(vectors(400, 8), 2) + far, [], neighbours.paired
    x[50:140] = x[7]  # more equal vectors than neighbours

    def counting(held, streamed, *rest):
        moved.append((held.count(), streamed.count()))
        return real(held, streamed, *rest)

    monkeypatch.setattr(neighbours, "paired", counting)
    monkeypatch.setattr(neighbours, "WIDE", 64)
    monkeypatch.setattr(neighbours, "HIGH", 32)
    got = collected(neighbours.nearest_of_many(table(spark, x), table(spark, x), 5, kind, block=4, region=80))
    assert got == ranked(x, x, 5, kind) if far < 1e3 else {len(found) for found in got.values()} == {5} and len(got) == 400
    assert sum(held + sent for held, sent in moved) <= 400 * (1 + 5 + 2 * 6)  # over 100 blocks were each sent nearly all queries


@pytest.mark.parametrize("known_edges", [True, False])
def test_pairs_are_looked_at_again_only_near_the_edge(monkeypatch, known_edges):
    x, k = vectors(6000, 16), 5
    x[100:140] = x[7]
    y, ids, seen, real = np.concatenate([x[:300], x[7:8]]), np.arange(6000)[::-1].copy(), [], np.nonzero
    rings = neighbours.Rings(np.zeros((1, 16)), np.arange(2), np.zeros(2, int), np.full(2, 3000), np.zeros(2), np.full(2, 100.0), k)
    want = neighbours._ranked(ids[::-1], x[::-1], y, k)
    edge = np.full(len(y), np.inf)
    if known_edges:
        edge = neighbours._ranked(ids[:3000][::-1], x[:3000][::-1], y, k)[2][:, -1]
    monkeypatch.setattr(neighbours.np, "nonzero", lambda a: seen.append(np.size(a)) or real(a))
    monkeypatch.setattr(neighbours, "_ranked", lambda *a, f=neighbours._ranked: seen.append(len(a[1]) * len(a[2])) or f(*a))
    row, name, far = neighbours._in_region((ids, x, np.repeat([0.0, 1.0], 3000)[:, None]), (np.arange(len(y)), y, edge[:, None]), rings)
    assert (row.reshape(-1, k) == np.arange(len(y))[:, None]).all() and (name.reshape(-1, k) == want[0]).all() and (far.reshape(-1, k) == want[2]).all()
    assert sum(seen) < 0.3 * len(x) * len(y)  # all pairs before, each several times as dear as its product


def test_neighbours_form_their_anchors_once(spark, monkeypatch):
    kept, real, x = [], neighbours.written, vectors(60)
    monkeypatch.setattr(neighbours, "written", lambda df, name: kept.append(name) or real(df, name))
    assert collected(neighbours.nearest_of_many(table(spark, x), table(spark, x), 3, block=16)) == ranked(x, x, 3, "cosine")
    assert kept == ["anchors", "rings", "queries", "edges", "nearest"]


def test_solvers_of_more_rows_than_the_driver_takes(spark, monkeypatch):
    x = vectors(60, 4) * 0.1 + 2 * np.eye(4)[np.arange(60) % 3]
    monkeypatch.setattr(catalog, "planted", lambda *_: table(spark, x))
    monkeypatch.setattr(catalog.tables, "to_numpy", None)
    for name, value in (("FULL", 30), ("CLUSTERS", 3)):
        monkeypatch.setattr(catalog, name, value)
    got = sorted(tuple(r) for r in catalog.eigen_solvers(spark, "").collect())
    assert got == [(s, 0.0, 0.0, 0.0) for s in ("eigh", "lobpcg", "svd", "svd_lowrank")]
    a = affinity.block(x, x, "cosine", 0.3)
    a /= np.sqrt(np.outer(a.sum(0), a.sum(0)))
    assert np.isclose(nystrom.tiled_operator(table(spark, x), "cosine", 0.3)[2](), (a**2).sum())


def test_a_vector_is_normalised_by_a_length_formed_once(spark):
    row = lambda n: spark.range(1).select(F.array_repeat(F.lit(2.0), n).alias("v"))
    asked = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "id long, v array<double>").withColumn("v", vec.normalized("v"))
    assert [r.v for r in asked.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    spent = {}
    for n in (100, 20_000, 20_000):
        began = time.time()
        assert row(n).select(F.element_at(vec.normalized("v"), -1).alias("x")).first().x > 0
        spent[n] = time.time() - began
    assert spent[20_000] < 3  # 400 million terms before


def test_a_colouring_forms_its_rows_once(spark, monkeypatch):
    kept, real = [], layout.written
    monkeypatch.setattr(layout, "written", lambda df, name: kept.append(name) or real(df, name))
    got = layout.color_rows(table(spark, vectors(80, 6)), lambda rows, metric, seed: rows[:, :3], layout.rgb_of_cube, num_sample=20)
    assert kept == ["smooth", "layout"] and got.count() == 80


def test_degrees_of_all_pairs_are_summed_where_they_are_formed(spark, monkeypatch):
    x = vectors(60)
    x[7], x[9, 0] = np.nan, np.inf
    for kind in ("cosine", "rbf"):
        want = {r.id: r.degree for r in affinity.degrees(affinity.affinities(table(spark, np.delete(x, [7, 9], 0), np.delete(np.arange(60), [7, 9])), kind=kind)).collect()}
        if kind == "rbf":  # the scale comes from all rows
            want = {i: None for i in want}
        got = {r.id: r.degree for r in affinity.pair_degrees(table(spark, x), kind).collect()}
        assert len(got) == 60 and got[7] == got[9] == 0 and all(w is None or np.isclose(got[i], w) for i, w in want.items())
    monkeypatch.setattr(catalog, "planted", lambda *_: table(spark, x))
    monkeypatch.setattr(affinity, "_pairs", None)  # a row for every pair before
    assert catalog.degree(spark, "").count() == 60


def test_degrees_of_normalised_pairs_are_summed_once(spark, monkeypatch):
    x, formed, real = vectors(60), spark.sparkContext.accumulator(0), affinity.all_degrees

    def counting(batches):
        for b in batches:
            formed.add(b.num_rows)
            yield b

    want = {(r.i, r.j): r.w for r in affinity.normalized_affinities(table(spark, x)).collect()}
    monkeypatch.setattr(affinity, "MOST", 40)
    monkeypatch.setattr(affinity, "all_degrees", lambda *a: real(*a).mapInArrow(counting, "id bigint, degree double"))
    got = {(r.i, r.j): r.w for r in affinity.normalized_affinities(table(spark, x)).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert formed.value == 60  # each count and each side summed all pairs again before


@pytest.mark.parametrize("find", [tall.krylov, tall.lobpcg])
def test_a_column_of_a_basis_is_multiplied_once(spark, find):
    u = np.linalg.qr(vectors(400, 400))[0]
    m, asked = (u * np.concatenate([[5.0, 4.0, 3.0], np.linspace(0.2, -0.2, 397)])) @ u.T, []

    def apply(basis):
        ids, x = tables.to_numpy(basis, 1000, "x")
        asked.append(x.shape[1])
        return spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, m @ x, strict=True)], "id long, y array<double>")

    w, _, off = find(apply, spark.range(400), 3)
    assert np.allclose(w, [5, 4, 3], atol=1e-9) and off <= 1e-9
    assert asked[0] == 16 and max(asked[1:]) <= 8 and sum(asked) <= 100  # three blocks a step, most of them again, before


def test_large_groups_are_cut_side_by_side(spark, monkeypatch):
    now, most, lock, real = [], [], threading.Lock(), grouped.exact_cut

    def watched(*a, **k):
        with lock:
            now.append(1)
            most.append(len(now))
        try:
            return real(*a, **k)
        finally:
            with lock:
                now.pop()

    monkeypatch.setattr(grouped, "exact_cut", watched)
    df = table(spark, vectors(60)).withColumn("g", F.col("id") % 3)
    got = {r.id: r.ev for r in grouped.grouped_cut(df, "g", 1, large=0).collect()}
    assert len(got) == 60 and 1 < max(most) <= grouped.TOGETHER
