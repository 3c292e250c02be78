"""Vector sums: wide vectors, hubs in slices, missing vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import propagation
from talentweave.operators.vectorsums import hub_slices, vector_sums

DIM = 768


@pytest.fixture(scope="module")
def hub_graph(spark):
    """One node that 40 others point at under two relations, and a few of low degree."""
    rng = np.random.default_rng(3)
    names = [f"c:{i}" for i in range(40)] + ["j:0", "j:1"]
    vectors = {n: rng.normal(size=DIM) for n in names}
    edges = [("cj", f"c:{i}", "j:0") for i in range(40)] + [("x", f"c:{i}", "j:0") for i in range(5)] + [("cj", "c:3", "j:1"), ("jc", "j:1", "c:3")]
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in vectors.items()], "node string, vector array<double>")
    return nodes.repartition(3), spark.createDataFrame(edges, "relation string, src string, dst string").repartition(5), vectors, edges


@pytest.mark.parametrize("hub", [7, 1000])
def test_relation_means_of_wide_vectors(hub_graph, hub):
    nodes, edges, vectors, rows = hub_graph
    got = {(r.relation, r.dst): r.vector for r in propagation.relation_means(nodes, edges, hub).collect()}
    assert set(got) == {(k, d) for k, _, d in rows}
    for (relation, dst), found in got.items():
        want = np.mean([vectors[s] for k, s, d in rows if (k, d) == (relation, dst)], axis=0)
        assert np.allclose(found, want, atol=1e-12)


def test_hubs_are_cut_into_slices(hub_graph):
    _, edges, _, _ = hub_graph
    sliced, hubs = hub_slices(edges, ["dst"], "src", 10)
    used = {r.dst: r.n for r in sliced.groupBy("dst").agg(F.countDistinct("slice").alias("n")).collect()}
    assert hubs and used["j:0"] > 2 and used["j:1"] == 1 and used["c:3"] == 1
    assert sliced.count() == edges.count()
    assert not hub_slices(edges, ["dst"], "src", 100)[1]


def test_propagation_with_and_without_slices(spark, hub_graph):
    nodes, _, vectors, _ = hub_graph
    pairs = spark.createDataFrame([(i, 0) for i in range(40)] + [(3, 1)], "user_id long, job_id long")
    whole, cut = ({r.node: r.vector for r in propagation.propagate(nodes, pairs, 2, DIM, hub=h).collect()} for h in (1000, 6))
    assert set(whole) == set(cut) == set(vectors)
    assert all(np.allclose(whole[n], cut[n], atol=1e-12) for n in whole)


def test_missing_vectors_and_weights(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 2.0), ("a", None, 9.0), ("a", [3.0, -1.0], 0.5), ("b", None, 1.0)], "k string, vector array<double>, w double")
    assert [(r.k, r.vector) for r in vector_sums(rows, ["k"], "w").collect()] == [("a", [3.5, 3.5])]
    assert [(r.k, r.vector) for r in vector_sums(rows, ["k"], mean=True).collect()] == [("a", [2.0, 0.5])]
    assert vector_sums(rows.limit(0), ["k"]).count() == 0
