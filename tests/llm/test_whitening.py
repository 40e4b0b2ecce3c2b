"""Whitening against the covariance's eigenvectors computed whole."""

import math

import numpy as np
import pytest

from nimboscale.llm.whitening import leading_components, op11_embedding_whitening, whiten
from nimboscale.session import table


def brute(vectors, k):
    x = np.floor(1024 * np.asarray(vectors, dtype=float)) + 100000
    n, mean = len(x), x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    sums = [sum(int(c) for c in col) for col in x.T]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return n, deviation, (x - mean) @ axes / np.sqrt(values), values / np.trace(v)


def test_query_against_whole_covariance(spark, sf):
    rows = op11_embedding_whitening(spark, sf).toPandas()
    source = table(spark, sf, "embeddings").orderBy("vec_id").toPandas()
    n, deviation, white, share = brute(source["embedding"].tolist(), 8)
    rows = rows.sort_values(["vec_id", "component"])
    assert len(rows) == 8 * len(source) and set(rows["n"]) == {n}
    assert rows["deviation"].tolist() == [d for d in deviation for _ in range(8)]
    got = rows["whitened"].to_numpy().reshape(-1, 8)
    for j in range(8):
        assert min(np.abs(got[:, j] - white[:, j]).max(), np.abs(got[:, j] + white[:, j]).max()) < 1e-8
    assert np.allclose(rows["explained"].to_numpy().reshape(-1, 8)[0], share, rtol=1e-10)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("dims", [40, 200, 400])
def test_filtered_iteration_on_flat_and_steep_spectra(dims):
    rng = np.random.default_rng(dims)
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    for values in (np.linspace(2, 1, dims), 0.5 ** np.arange(dims), np.ones(dims), np.r_[np.full(12, 3.0), np.ones(dims - 12)]):
        v = (turn * values) @ turn.T
        passes = []
        found, axes, trace = leading_components(lambda q: (passes.append(1), (v @ q, np.diag(v)))[1], dims, 8)
        assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-10)
        assert math.isclose(trace, values.sum(), rel_tol=1e-12)
        assert np.abs(v @ axes - axes * found).max() < 1e-9
        assert len(passes) < 400


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((30, 5)).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, "x") for i, v in enumerate(good)]
    rows += [(100, None, None), (101, [1.0, None, 2.0, 3.0, 4.0], "x"), (102, [nan] * 5, "x"), (103, [1.0, 2.0, 3.0, 4.0, -inf], "x"), (104, [], "x"), (105, [1.0, 2.0], "x"), (106, [1e30] * 5, "x")]
    rows += [(None, good[0], "x"), (0, good[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    out = whiten(df).toPandas()
    n, deviation, white, _ = brute([*good, good[0], good[0]], 5)
    assert len(out) == 5 * 32 and set(out["n"]) == {32} and set(out["vec_id"].dropna()) == set(range(30))
    first = out[(out["vec_id"] == 0) & (out["component"] == 1)]
    assert len(first) == 2 and set(first["deviation"]) == {deviation[0]}
    assert np.allclose(np.abs(first["whitened"]), abs(white[0, 0]), atol=1e-9)
    flat = spark.createDataFrame([(i, [1.0, float(i % 2), 0.0]) for i in range(9)], df.select("vec_id", "embedding").schema)
    assert {r["component"] for r in whiten(flat).collect()} == {1}
    for none in (df.limit(0), spark.createDataFrame([(1, [2.0, 3.0])] * 4, flat.schema)):
        empty = whiten(none)
        assert empty.count() == 0 and empty.columns == out.columns.tolist()


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 2.0**36, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whiten(df).collect()} == {None}
