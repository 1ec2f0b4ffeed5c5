"""Reasoning about alternatives: hypothetical worlds, abduction, argumentation, finite-domain constraints."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import reason, why_not
from graphloom.operators.transforms import SPO
from graphloom.sources.graphs import TRIPLE, Graph, union
from graphloom.sources.n3 import Rule


def what_if(graph: Graph, rules: list[Rule], hypotheses: list[tuple[str, str, str]]) -> DataFrame:
    """What follows with the hypotheses that doesn't without them."""
    assumed = graph.insert(graph.spark.createDataFrame(hypotheses, TRIPLE))
    return reason(assumed, rules).graph.triples.join(reason(graph, rules).graph.triples, SPO, "left_anti")


def counterfactual(graph: Graph, rules: list[Rule], removed: list[tuple[str, str, str]]) -> DataFrame:
    """What no longer follows without the given facts."""
    without = graph.delete(graph.spark.createDataFrame(removed, TRIPLE))
    return reason(graph, rules).graph.triples.join(reason(without, rules).graph.triples, SPO, "left_anti")


def compare(a: Graph, b: Graph) -> DataFrame:
    """Each triple with where it holds: both, a or b."""
    tag = lambda g, n: g.triples.distinct().withColumn("w", F.lit(n))
    return tag(a, 1).unionByName(tag(b, 2)).groupBy(*SPO).agg(F.sum("w").alias("w")).select(*SPO, F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("both")), F.col("w").cast("int")).alias("world"))


def necessarily(worlds: list[Graph]) -> DataFrame:
    """Triples of all worlds."""
    return union([g.triples.distinct() for g in worlds]).groupBy(*SPO).agg(F.count("*").alias("n")).where(F.col("n") == len(worlds)).drop("n")


def possibly(worlds: list[Graph]) -> DataFrame:
    return union([g.triples for g in worlds]).distinct()


def abduce(graph: Graph, rules: list[Rule], observation: tuple[str, str, str], abducibles: list[tuple[str, str, str]]) -> list[tuple]:
    """The smallest sets of one or two abducibles that let the observation follow."""
    for size in (1, 2):
        found = []
        for chosen in itertools.combinations(abducibles, size):
            assumed = graph.insert(graph.spark.createDataFrame(list(chosen), TRIPLE))
            if reason(assumed, rules).graph.contains(*observation):
                found.append(chosen)
        if found:
            return found
    return []


class Framework:
    """Abstract argumentation: arguments and attacks between them, of the size of a discussion."""

    def __init__(self, arguments: Iterable, attacks: Iterable[tuple]):
        self.arguments, self.attacks = set(arguments), set(attacks)
        self.attackers = {a: {x for x, y in self.attacks if y == a} for a in self.arguments}

    def grounded(self) -> set:
        accepted: set = set()
        while True:
            defeated = {y for x, y in self.attacks if x in accepted}
            more = {a for a in self.arguments if self.attackers[a] <= defeated}
            if more == accepted:
                return accepted
            accepted = more

    def _conflict_free(self, chosen: set) -> bool:
        return not any(x in chosen and y in chosen for x, y in self.attacks)

    def admissible(self) -> list[set]:
        """All admissible sets, by backtracking over arguments without conflict."""
        order, out = sorted(self.arguments, key=str), []

        def extend(i: int, chosen: set) -> None:
            if i == len(order):
                beaten = {y for x, y in self.attacks if x in chosen}
                if all(self.attackers[a] <= beaten for a in chosen):
                    out.append(chosen)
                return
            with_it = chosen | {order[i]}
            if self._conflict_free(with_it):
                extend(i + 1, with_it)
            extend(i + 1, chosen)

        extend(0, set())
        return out

    def preferred(self) -> list[set]:
        sets = self.admissible()
        return [s for s in sets if not any(s < t for t in sets)]

    def stable(self) -> list[set]:
        return [s for s in self.preferred() if {y for x, y in self.attacks if x in s} | s == self.arguments]

    def _extensions(self, semantics: str) -> list[set]:
        return [self.grounded()] if semantics == "grounded" else getattr(self, semantics)()

    def skeptical(self, semantics: str = "preferred") -> set:
        found = self._extensions(semantics)
        return set.intersection(*found) if found else set()

    def credulous(self, semantics: str = "preferred") -> set:
        return set().union(*self._extensions(semantics))


def solve(domains: dict[str, list[int]], constraints: list[tuple[tuple[str, ...], Callable[..., bool]]], all_solutions: bool = True) -> list[dict[str, int]]:
    """Assignments that meet all constraints (variables, test): bounds by arc consistency, then the smallest domain first."""
    domains = {v: list(d) for v, d in domains.items()}

    def propagate(ds: dict) -> dict | None:
        changed = True
        while changed:
            changed = False
            for names, test in constraints:
                for i, v in enumerate(names):
                    others = [ds[n] for j, n in enumerate(names) if j != i]
                    if len(names) > 3 and any(len(o) > 1 for o in others):
                        continue
                    kept = [x for x in ds[v] if any(test(*rest[:i], x, *rest[i:]) for rest in itertools.product(*others))]
                    if not kept:
                        return None
                    if len(kept) < len(ds[v]):
                        ds, changed = ds | {v: kept}, True
        return ds

    out: list[dict[str, int]] = []

    def search(ds: dict | None) -> bool:
        if ds is None:
            return False
        free = [v for v in ds if len(ds[v]) > 1]
        if not free:
            found = {v: d[0] for v, d in ds.items()}
            if all(test(*(found[n] for n in names)) for names, test in constraints):
                out.append(found)
            return bool(out) and not all_solutions
        v = min(free, key=lambda x: len(ds[x]))
        return any(search(propagate(ds | {v: [x]})) for x in ds[v])

    search(propagate(domains))
    return out


def optimise(domains: dict, constraints: list, objective: Callable[[dict], int], largest: bool = True) -> tuple[dict, int] | None:
    found = [(objective(s), s) for s in solve(domains, constraints)]
    if not found:
        return None
    value, best = (max if largest else min)(found, key=lambda x: x[0])
    return best, value


__all__ = ["Framework", "abduce", "compare", "counterfactual", "necessarily", "optimise", "possibly", "solve", "what_if", "why_not"]
