"""Embeddings, priorities and sampling."""

import pytest

from graphloom.operators import learning
from graphloom.sources.graphs import Graph


def test_embeddings_tell_links(spark):
    rows = [(f"<n{i}>", "<next>", f"<n{i + 1}>") for i in range(12)]
    model = learning.train_transe(Graph.of(spark, rows), size=8, epochs=300)
    top = [r.name for r in learning.predict_link(model, "<n3>", "<next>", 3).collect()]
    assert "<n4>" in top
    assert learning.train_transe(Graph.of(spark, []), epochs=1).count() == 0


def test_sampling(spark):
    net = learning.BayesNetwork({"rain": ((), {(): 0.2}), "sprinkler": (("rain",), {(True,): 0.01, (False,): 0.4}),
                                 "wet": (("rain", "sprinkler"), {(True, True): 0.99, (True, False): 0.8, (False, True): 0.9, (False, False): 0.0})})
    assert net.sample(spark, "rain", {"wet": True}, 40_000) == pytest.approx(0.3577, abs=0.02)


def test_priorities():
    p = learning.RulePriorities()
    for _ in range(5):
        p.record("good", 3)
        p.record("bad", 0)
    assert p.order(["bad", "good"]) == ["good", "bad"]
