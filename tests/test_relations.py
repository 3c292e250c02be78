"""Learned relation layers against plain NumPy on the same rows."""

import math

import numpy as np
import pytest

from talentweave.operators import propagation, relations

DIM = 6


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(8)
    names = [f"c:{i}" for i in range(30)] + [f"j:{i}" for i in range(20)]
    vectors = {n: rng.normal(size=DIM) for n in names}
    pairs = sorted({(f"c:{rng.integers(29)}", f"j:{rng.integers(19)}") for _ in range(120)})
    edges = [("cj", a, b) for a, b in pairs] + [("jc", b, a) for a, b in pairs]
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in vectors.items()] + [("c:none", None)], "node string, vector array<double>")
    return nodes, spark.createDataFrame(edges + [("jc", "j:0", "c:none")], "relation string, src string, dst string"), vectors, edges


def _layer(vectors, edges, decay):
    """One layer and its matrices, node by node."""
    weights, incoming, errors = {}, {n: np.zeros(DIM) for n in vectors}, {}
    for relation in sorted({k for k, _, _ in edges}):
        met: dict[str, list] = {}
        for k, s, d in edges:
            if k == relation:
                met.setdefault(d, []).append(vectors[s])
        names = sorted(met)
        x = np.array([np.append(np.mean(met[n], axis=0), 1.0) for n in names])
        y = np.array([vectors[n] for n in names])
        # ridge as ordinary least squares with rows of zeros as extra targets
        more = np.hstack([np.sqrt(decay) * np.eye(DIM), np.zeros((DIM, 1))])
        w = np.linalg.lstsq(np.vstack([x, more]), np.vstack([y, np.zeros((DIM, DIM))]), rcond=None)[0]
        weights[relation], errors[relation] = w, float(((x @ w - y) ** 2).mean())
        for n, row in zip(names, x @ w, strict=True):
            incoming[n] = incoming[n] + row
    out = {}
    for n, v in vectors.items():
        h = v + np.array([0.5 * m * (1 + math.erf(m / math.sqrt(2))) for m in incoming[n]])
        out[n] = (h - h.mean()) / math.sqrt(h.var() + 1e-5)
    return out, weights, errors


@pytest.mark.parametrize("parts", [1, 5])
def test_layers_equal_plain_numpy(graph, parts):
    nodes, edges, vectors, rows = graph
    got = relations.learned_relational_encode(nodes.repartition(parts), edges.repartition(parts), DIM, layers=2, decay=0.5, hub=10)
    state = vectors
    for layer in range(2):
        state, weights, errors = _layer(state, rows, 0.5)
        assert set(got.matrices[layer]) == {"cj", "jc"}
        for name, w in weights.items():
            assert np.allclose(got.matrices[layer][name], w, atol=1e-8)
            assert got.errors[layer][name] == pytest.approx(errors[name], abs=1e-8)
    found = {r.node: r.vector for r in got.nodes.collect()}
    assert set(found) == set(state)
    assert all(np.allclose(found[n], state[n], atol=1e-7) for n in state)


def test_learned_maps_leave_less_than_plain_means(spark):
    """Jobs are a rotation of their users' mean: the identity cannot show that, the learned map can."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0]
    users = rng.normal(size=(60, DIM))
    edges, jobs = [], []
    for j in range(40):
        own = rng.choice(60, 3, replace=False)
        edges += [("cj", f"c:{u}", f"j:{j}") for u in own]
        jobs.append(users[own].mean(axis=0) @ turn)
    rows = [(f"c:{i}", v.tolist()) for i, v in enumerate(users)] + [(f"j:{i}", v.tolist()) for i, v in enumerate(jobs)]
    nodes = spark.createDataFrame(rows, "node string, vector array<double>")
    got = relations.learned_relational_encode(nodes, spark.createDataFrame(edges, "relation string, src string, dst string"), DIM, layers=1, decay=1e-6)
    assert got.errors[0]["cj"] < 1e-8
    assert np.allclose(got.matrices[0]["cj"][:DIM], turn, atol=1e-4)


def test_no_edges(spark, graph):
    nodes, edges, vectors, _ = graph
    got = relations.learned_relational_encode(nodes, edges.limit(0), DIM, layers=1)
    assert got.matrices == [{}] and got.nodes.count() == len(vectors)
    assert relations.gram_sums(propagation.relation_means(nodes, edges.limit(0)), nodes, DIM).count() == 0
