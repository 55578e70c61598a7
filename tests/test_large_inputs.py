"""Work that must not grow with the density, the copies or the size of a batch."""

import threading
import tracemalloc
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracefold.functions import signal
from tracefold.operators import joins, lineage, spacing
from tracefold.plans import registry

XYZ = ["x", "y", "z"]


@contextmanager
def limit(spark, seconds):
    """All jobs are cancelled after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def placed(spark, places):
    table = pd.DataFrame(np.asarray(places, float), columns=XYZ)
    table.insert(0, "id", np.arange(len(table)))
    return spark.createDataFrame(table).repartition(4)


def test_nearest_join_of_crowded_places(spark):
    """What lies within a radius is no measure of the work: 40000 places in a small cube, 8000 of them at one place."""
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.random((32000, 3)) * 0.01, np.full((8000, 3), 0.005), [[9.0, 9, 9]]]).round(4)  # rounded: many ties
    df = placed(spark, places)
    with limit(spark, 120):
        rows = joins.nearest_join(df, df, "id", "id", XYZ, 3, 0.1).filter("a_id % 400 = 0").collect()
    got = {(r.a_id, r.rank): (r.b_id, r.distance) for r in rows}
    assert len(got) == len(rows) == 3 * 101
    for i in range(0, len(places), 400):
        d = np.sqrt((places[i, 0] - places[:, 0]) ** 2 + (places[i, 1] - places[:, 1]) ** 2 + (places[i, 2] - places[:, 2]) ** 2)
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[:3], 1):
            assert got[i, rank] == (j, d[j])


def test_nearest_join_of_distant_tables(spark):
    """Leaves without a place of the other table, names as ids, and places that are none."""
    rng = np.random.default_rng(5)
    b = np.concatenate([rng.normal(size=(6000, 3)), rng.normal(size=(3000, 3)) + 50])
    a = np.concatenate([rng.normal(size=(40, 3)) + 25, rng.normal(size=(40, 3)) * 300])
    right = placed(spark, b).withColumn("name", F.format_string("n%05d", "id")).select("name", *XYZ)
    right = right.union(spark.createDataFrame([("null", None, 0.0, 0.0), ("nan", float("nan"), 0.0, 0.0)], right.schema))
    left = placed(spark, a).union(spark.createDataFrame([(500, None, 0.0, 0.0), (501, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double"))
    got = {(r.a_id, r.rank): r.b_id for r in joins.nearest_join(left, right, "id", "name", XYZ, 5).collect()}
    assert len(got) == 5 * len(a)
    for i, p in enumerate(a):
        order = np.argsort(np.linalg.norm(b - p, axis=1), kind="stable")[:5]
        assert [got[i, r] for r in range(1, 6)] == [f"n{j:05d}" for j in order]
    assert joins.nearest_join(left, right.limit(0), "id", "name", XYZ, 5).count() == 0


def test_nearest_merge_of_crowded_places(spark, tmp_path):
    rng = np.random.default_rng(6)
    places = (rng.random((30000, 3)) * 0.02).round(3)
    spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(places)), "label": 0, "embedding": places.tolist()})).write.parquet(f"{tmp_path}/embeddings.parquet")
    with limit(spark, 100):
        got = {r.point: (r.element, r.status) for r in registry.QUERIES["nearest_merge"](spark, str(tmp_path)).collect()}
    assert len(got) == len(places)
    for i in range(0, len(places), 1000):
        d = np.sqrt((places[i, 0] - places[:, 0]) ** 2 + (places[i, 1] - places[:, 1]) ** 2 + (places[i, 2] - places[:, 2]) ** 2)
        d[i] = np.inf
        assert got[i] == (int(np.argmin(d)), 1 if d.min() < 0.02 else 0)


def test_farthest_first_of_crowded_places(spark):
    """Many candidates and many existing points within reach of one another."""
    rng = np.random.default_rng(7)
    old = rng.normal(size=(20000, 3)) * 0.01
    new = np.concatenate([rng.normal(size=(40000, 3)) * 0.01, np.full((3000, 3), 0.5), [[0.0, 2.0, 0.0]]])
    with limit(spark, 150):
        got = {r.id: r.distance for r in spacing.farthest_first(placed(spark, new), placed(spark, old), "id", XYZ, 0.5).collect()}
    assert got == pytest.approx({43000: np.linalg.norm(old - new[43000], axis=1).min(), 40000: np.linalg.norm(old - new[40000], axis=1).min()})


def test_first_line_of_a_part(spark, tmp_path):
    """Lines without a number come last, as in the SQL; of lines of one number the lesser supplier's counts, however rows are dealt."""
    spark.createDataFrame([(1,), (2,), (3,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, None, 1, 9), (1, 5, 1, 7), (2, 4, 2, 8), (2, 4, 2, 6), (2, 4, 3, 1)]
    for n, rows in enumerate((lines, lines[::-1])):
        (folder := tmp_path / str(n)).mkdir()
        (folder / "part.parquet").symlink_to(tmp_path / "part.parquet")
        spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        got = {r.p_partkey: r.azimuth for r in registry.QUERIES["component_lookup_first"](spark, str(folder)).collect()}
        assert got == {1: 7, 2: 6, 3: -1}


def test_lags_of_a_large_batch():
    """The memory of a batch does not grow with its rows beyond the traces and results themselves."""
    rng = np.random.default_rng(8)
    traces = pd.Series(list(rng.normal(size=(10001, 64))))
    tracemalloc.start()
    found = signal.cc_lag_search(2.0, 4.0, 8).func(traces[:-1].reset_index(drop=True), traces[1:].reset_index(drop=True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    few = signal.cc_lag_search(2.0, 4.0, 8).func(traces[9990:10000].reset_index(drop=True), traces[9991:].reset_index(drop=True))
    assert np.allclose(found[9990:], few)


def one_by_one(places, radius):
    """The points that go, from the whole matrix of distances."""
    gaps = places[:, None] - places[None]
    near = np.sqrt(gaps[..., 0] ** 2 + gaps[..., 1] ** 2 + gaps[..., 2] ** 2) <= radius
    np.fill_diagonal(near, False)
    degree, out = near.sum(axis=1), set()
    while degree.max() > 0:
        i = max(np.flatnonzero(degree == degree.max()))
        out.add(int(i))
        degree[near[i]] -= 1
        near[i] = near[:, i] = False
        degree[i] = 0
    return out


def test_thinning_of_crowded_places(spark):
    """Blocks drop what one by one would; the middle holds copies and far more conflicts than a round for each could drop in time."""
    rng = np.random.default_rng(9)
    places = np.concatenate([rng.normal(size=(1500, 3)) * 0.08, rng.normal(size=(500, 3)) * 0.3, np.repeat(rng.normal(size=(20, 3)) * 0.1, 10, axis=0)])
    df = placed(spark, places).union(spark.createDataFrame([(9999, None, 0.0, 0.0)], "id long, x double, y double, z double"))
    with limit(spark, 200):
        rows = spacing.thin_by_distance(df, "id", XYZ, 0.05).collect()
    assert len(rows) == len({r.id for r in rows})
    assert {r.id for r in rows} == one_by_one(places, 0.05)
    assert spacing.thin_by_distance(df.limit(0), "id", XYZ, 0.05).count() == 0


@pytest.mark.parametrize("n, smaller, tables", [(4000, {}, 8), (700, {"MOST": 100, "SIDE": 8}, 200)])
def test_thinning_in_few_rounds(spark, monkeypatch, n, smaller, tables):
    """The rounds do not grow with the conflicts of a point as long as blocks can; smaller blocks drop the same."""
    rng = np.random.default_rng(11)
    places = np.round(rng.random((n, 3)) * [2.5, 0.05, 0.05], 4)
    odd = spark.createDataFrame([(9001, float("nan"), 0.0, 0.0), (9002, float("inf"), 0.0, 0.0), (9003, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    for name, value in smaller.items():
        monkeypatch.setattr(spacing, name, value)
    written, cut = [], lineage.Tables.cut
    monkeypatch.setattr(lineage.Tables, "cut", lambda self, df: (written.append(1), cut(self, df))[1])
    with limit(spark, 200):
        got = {r.id for r in spacing.thin_by_distance(placed(spark, places).union(odd), "id", XYZ, 0.05).collect()}
    assert got == one_by_one(places, 0.05)
    assert len(written) <= tables
