"""Translational embeddings, rule priorities and Bayes-network sampling."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.reasoning import transe_score
from graphloom.sources.graphs import Graph


def train_transe(graph: Graph, size: int = 16, epochs: int = 50, rate: float = 0.05, margin: float = 1.0, most: int = 200_000, seed: int = 1) -> DataFrame:
    """(name, kind, embedding) for entities and relations: margin loss against corrupted heads or tails.

    Trained on the driver on ``most`` triples at most, those of the smallest hash, the same in every run; entities
    outside that sample get no embedding.
    """
    rows = graph.triples.orderBy(F.xxhash64("s", "p", "o"), "s", "p", "o").limit(most).collect()
    rng = np.random.default_rng(seed)
    entities = {e: i for i, e in enumerate(sorted({x for r in rows for x in (r.s, r.o)}))}
    relations = {p: i for i, p in enumerate(sorted({r.p for r in rows}))}
    e, w = rng.normal(0, 1 / math.sqrt(size), (len(entities), size)), rng.normal(0, 1 / math.sqrt(size), (len(relations), size))
    if rows:
        h, p, t = (np.array([d[r[c]] for r in rows]) for c, d in (("s", entities), ("p", relations), ("o", entities)))
        for _ in range(epochs):
            e /= np.maximum(1.0, np.linalg.norm(e, axis=1, keepdims=True))
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
                heads, tails = h[at].copy(), t[at].copy()
                swap = rng.random(len(at)) < 0.5
                other = rng.integers(0, len(entities), len(at))
                heads[swap], tails[~swap] = other[swap], other[~swap]
                good, bad = e[h[at]] + w[p[at]] - e[t[at]], e[heads] + w[p[at]] - e[tails]
                dg, db = np.linalg.norm(good, axis=1) + 1e-9, np.linalg.norm(bad, axis=1) + 1e-9
                wrong = (dg + margin > db)[:, None]
                up, down = rate * wrong * good / dg[:, None], rate * wrong * bad / db[:, None]
                np.add.at(e, h[at], -up)
                np.add.at(e, t[at], up)
                np.add.at(e, heads, down)
                np.add.at(e, tails, -down)
                np.add.at(w, p[at], down - up)
    out = [(n, "entity", e[i].tolist()) for n, i in entities.items()] + [(n, "relation", w[i].tolist()) for n, i in relations.items()]
    return graph.spark.createDataFrame(out, "name string, kind string, embedding array<double>")


def predict_link(model: DataFrame, head: str, relation: str, k: int = 10) -> DataFrame:
    """The k tails that fit (head, relation, ?) best."""
    fixed = model.where(F.col("name").isin(head, relation)).select("name", "embedding").collect()
    vectors = {r.name: F.array(*map(F.lit, r.embedding)) for r in fixed}
    tails = model.where((F.col("kind") == "entity") & (F.col("name") != head))
    return tails.select("name", transe_score(vectors[head], vectors[relation], F.col("embedding")).alias("score")).orderBy(F.desc("score"), "name").limit(k)


class RulePriorities:
    """A moving average of each rule's success, weighed by how often it was tried."""

    def __init__(self, keep: float = 0.9):
        self.keep = keep
        self.success: dict[str, float] = {}
        self.tries: dict[str, int] = {}

    def record(self, rule: str, derived: int) -> None:
        old = self.success.get(rule, 0.0)
        self.success[rule] = self.keep * old + (1 - self.keep) * (derived > 0)
        self.tries[rule] = self.tries.get(rule, 0) + 1

    def order(self, rules: list[str]) -> list[str]:
        return sorted(rules, key=lambda r: (-self.success.get(r, 0.5) * math.log(self.tries.get(r, 0) + 1), r))


@dataclasses.dataclass
class BayesNetwork:
    """Boolean variables with parents and a table from the parents' values to the chance of true, parents first."""

    nodes: dict[str, tuple[tuple[str, ...], dict[tuple[bool, ...], float]]]

    def sample(self, spark: SparkSession, query: str, evidence: dict[str, bool] | None = None, samples: int = 10_000, seed: int = 1) -> float:
        """P(query | evidence) by likelihood weighting: one row a sample, all in column expressions."""
        evidence = evidence or {}
        df, weight = spark.range(samples), F.lit(1.0)
        for i, (name, (parents, table)) in enumerate(self.nodes.items()):
            chance = F.lit(0.0)
            for values, p in table.items():
                test = F.lit(True)
                for parent, value in zip(parents, values, strict=True):
                    test = test & (F.col(parent) == value)
                chance = F.when(test, p).otherwise(chance)
            if name in evidence:
                df = df.withColumn(f"__w{i}", chance if evidence[name] else 1 - chance).withColumn(name, F.lit(evidence[name]))
                weight = weight * F.col(f"__w{i}")
            else:
                df = df.withColumn(name, F.rand(seed + i) < chance)
        out = df.agg(F.sum(F.when(F.col(query), weight).otherwise(0.0)).alias("hit"), F.sum(weight).alias("all")).first()
        return out.hit / out["all"] if out["all"] else float("nan")
