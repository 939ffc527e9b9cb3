"""Eigenvectors, diffusion layout, neighbour memberships and bandwidth order against dense and plain versions."""

import math
import random

import numpy as np
import pytest

from parcelyard.operators import embedding, nulls, spectral


def ring(n, seed):
    r = random.Random(seed)
    return sorted({(k, (k + 1) % n) for k in range(n)} | {tuple(r.sample(range(n), 2)) for _ in range(n)})


def dense(n, links):
    a = np.zeros((n, n))
    for i, j in links:
        a[i, j] = a[j, i] = 1
    d = 1 / np.sqrt(a.sum(1))
    return a * d[:, None] * d


def test_diffusion_equals_the_dense_solver(spark):
    links = ring(26, 3)
    e = spark.createDataFrame([(a, b, 0.5) for a, b in links] + [(0, 0, 9.0), (1, 3, -2.0)], "src bigint, dst bigint, w double")
    got = {r["node"]: (r["p1"], r["p2"]) for r in spectral.diffusion_positions(e, spark.range(26).withColumnRenamed("id", "node")).collect()}
    values, vectors = np.linalg.eigh(dense(26, links))
    for at in (1, 2):
        v = vectors[:, ::-1][:, at] * values[::-1][at]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        want = (v - v.mean()) / (v.max() - v.min())
        assert [got[k][at - 1] for k in range(26)] == pytest.approx(want, abs=1e-6)


def test_eigenvectors_of_a_small_graph_are_all_of_them(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src bigint, dst bigint, w double")
    values, rows = spectral.eigenvectors(spectral.normalised(e), 5)
    assert values == pytest.approx([1, 0, -1], abs=1e-9)
    y = np.array([r["y"] for r in rows.orderBy("node").collect()])
    assert y.T @ y == pytest.approx(np.eye(3), abs=1e-8)


def test_diffusion_of_nothing(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint, w double")
    assert spectral.diffusion_positions(e).count() == 0
    alone = spectral.diffusion_positions(e, spark.range(2).withColumnRenamed("id", "node")).collect()
    assert [tuple(r)[1:] for r in alone] == [(0, 0), (0, 0)]


def test_memberships_reach_their_sum(spark):
    r = np.random.default_rng(5)
    p = r.normal(size=(30, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    k = 7
    near = {i: [j for j in np.argsort(d[i]) if j != i][:k] for i in range(30)}
    rows = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in near for j in near[i]], "i bigint, j bigint, d double")
    found = {x["i"]: (x["rho"], x["sigma"]) for x in embedding.bandwidths(rows).collect()}
    own = {}
    for i in near:
        rho, sigma = found[i]
        assert rho == min(d[i, j] for j in near[i])
        for j in near[i]:
            own[i, j] = math.exp(-max(d[i, j] - rho, 0) / sigma)
        assert sum(own[i, j] for j in near[i]) == pytest.approx(math.log2(k), abs=1e-6)
    got = {(x["i"], x["j"]): x["w"] for x in embedding.memberships(rows).collect()}
    for (i, j), w in got.items():
        a, b = own.get((i, j), 0), own.get((j, i), 0)
        assert w == pytest.approx(a + b - a * b) and got[j, i] == pytest.approx(w)
    assert set(got) == set(own) | {(j, i) for i, j in own}


def plain_order(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order, seen = [], set()
    for start in sorted(near, key=lambda n: (len(near[n]), n)):
        queue = [start] if start not in seen else []
        seen.update(queue)
        while queue:
            node = queue.pop(0)
            order.append(node)
            fresh = sorted(near[node] - seen, key=lambda n: (len(near[n]), n))
            seen.update(fresh)
            queue += fresh
    return {n: k for k, n in enumerate(reversed(order))}


def test_bandwidth_order_of_several_components(spark):
    r = random.Random(6)
    links = [(a, b) for a, b in ring(14, 1)] + [(20 + a, 20 + b) for a, b in [(0, 1), (1, 2), (2, 3), (1, 4)]] + [(30, 31), (41, 40)]
    names = list(range(60))
    r.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    got = {x["node"]: x["position"] for x in nulls.bandwidth_order(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == plain_order(links)
    assert max(abs(got[a] - got[b]) for a, b in links) <= max(abs(a - b) for a, b in links)


def test_bandwidth_order_of_nothing(spark):
    assert nulls.bandwidth_order(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
