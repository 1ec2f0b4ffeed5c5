"""Forward chaining to a fixpoint, semi-naive and stratum by stratum; proofs, incremental change, goals."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.formulas import simplified
from graphloom.operators.lineage import cut
from graphloom.operators.paths import closure, lines
from graphloom.plans.compile import Solutions, basic
from graphloom.plans.rules import derive, is_data, solve, strata, variables
from graphloom.sources.graphs import TRIPLE, Graph, union
from graphloom.sources.n3 import Rule

#: Steps that no line or graph outlasts; nodes of a line whose proofs are made in one row.
ALL_STEPS, MOST_PROVED = 64, 1024
DERIVATION = "s string, p string, o string, rule string, step int, premises array<struct<s:string,p:string,o:string>>"


@dataclasses.dataclass
class Result:
    """All facts, the inferred ones, the number of steps, and whether nothing more follows."""

    graph: Graph
    inferred: DataFrame
    steps: int
    complete: bool


#: Finds of steps that are kept apart before they are written as one; schema triples and rules made from them that are
#: gathered on the driver, at most: beyond it schemas are joined like any other facts.
MOST_PARTS, MOST_SCHEMA, MOST_GROUNDED = 8, 2000, 200
_SCHEMA = {f"<{terms.RDFS}{n}>" for n in ("subClassOf", "subPropertyOf", "domain", "range")} | {
    f"<{terms.OWL}{n}>" for n in ("inverseOf", "equivalentClass", "equivalentProperty", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue")}
_SCHEMA_CLASS = (f"<{terms.OWL}", f"<{terms.RDFS}", f"<{terms.RDF}")


def _is_schema(t: tuple) -> bool:
    """Whether a triple or pattern speaks of classes and properties."""
    return t[1] in _SCHEMA or (t[1] == terms.TYPE and isinstance(t[2], str) and t[2].startswith(_SCHEMA_CLASS))


def _grounded(rule: Rule, schema: set[tuple]) -> list[Rule]:
    """The rule once for each way its schema atoms are met, without them."""
    found: list[dict] = [{}]
    for a in (a for a in rule.body if is_data(a) and _is_schema(a)):
        found = [b2 for b in found for t in schema if (b2 := _bound_by(a, t, b)) is not None]
    put = lambda t, b: tuple(b.get(x, x) if isinstance(x, str) else x for x in t)
    rest = [a for a in rule.body if not (is_data(a) and _is_schema(a))]
    return list(dict.fromkeys(Rule(tuple(put(a, b) for a in rest), tuple(put(t, b) for t in rule.head), rule.name) for b in found))


def _bound_by(pattern: tuple, t: tuple, binding: dict) -> dict | None:
    out = dict(binding)
    for p, x in zip(pattern, t, strict=True):
        if p.startswith("?"):
            if out.setdefault(p, x) != x:
                return None
        elif p != x:
            return None
    return out


def specialise(graph: Graph, rules: list[Rule]) -> tuple[list[Rule], list[tuple]]:
    """The rules with what the schema says put in, and the schema triples that follow: a rule over any property becomes
    rules over those the schema names, so facts are filtered by predicate and not joined with the schema. A schema too
    large for the driver, rules that could add to it from facts, and rules on lists or formulas stay as they are."""
    about = [r for r in rules if any(is_data(a) and _is_schema(a) for a in r.body)]
    plain = lambda r: all(isinstance(x, str) for t in (*r.body, *r.head) for x in t)
    if not about or not all(map(plain, about)):
        return rules, []
    wanted = F.col("p").isin(*_SCHEMA) | ((F.col("p") == terms.TYPE) & reduce(lambda a, b: a | b, [F.col("o").startswith(c) for c in _SCHEMA_CLASS]))
    rows = graph.triples.where(wanted).limit(MOST_SCHEMA + 1).collect()
    if len(rows) > MOST_SCHEMA:
        return rules, []
    told = {(r.s, r.p, r.o) for r in rows}
    schema = set(told)
    while True:
        made = list(dict.fromkeys(g for r in about for g in _grounded(r, schema)))
        new = {t for r in made if not r.body for t in r.head if not any(x.startswith("?") for x in t)} - schema
        if len(schema) + len(new) > MOST_SCHEMA or len(made) > MOST_SCHEMA:
            return rules, []
        if not new:
            break
        schema |= new
    out = [r for r in made if r.body and any(t not in r.body for t in r.head)] + [r for r in rules if r not in about]
    if len(out) > MOST_GROUNDED or any(_is_schema(t) or t[1].startswith("?") or (t[1] == terms.TYPE and isinstance(t[2], str) and t[2].startswith("?")) for r in out for t in r.head):
        return rules, []
    return out, sorted(schema - told)


def _transitive(rules: list[Rule]) -> dict[str, Rule] | None:
    """The rules by predicate, if each only says that one predicate of its own is transitive."""
    out = {}
    for r in rules:
        if len(r.body) != 2 or len(r.head) != 1 or not all(isinstance(x, str) for t in (*r.body, *r.head) for x in t):
            return None
        (x, p, z), body = r.head[0], set(r.body)
        ways = {(a, b) for a in r.body for b in r.body if a[0] == x and b[2] == z and a[2] == b[0]}
        middle = next(iter(ways))[0][2] if len(ways) == 1 else ""
        if p.startswith("?") or p in out or len(body) != 2 or len({x, middle, z}) != 3 or not all(v.startswith("?") for v in (x, middle, z)) or any(a[1] != p for a in body):
            return None
        out[p] = r
    return out or None


def reason(graph: Graph, rules: list[Rule], max_steps: int = 10_000, on_step: Callable[[int, DataFrame], None] | None = None, delta: Graph | None = None) -> Result:
    """The least fixpoint of the rules over the graph, which is a set of triples. A step applies every rule once: to all
    facts first (or to the given delta), then to what the last step added. Each step writes only what it has found; the
    graph itself is read where it lies."""
    given = tuple(rules)
    rules = [x for r in rules if (x := simplified(r)) is not None]
    rules, more = specialise(graph, rules) if delta is None else (rules, [])
    base, steps, complete = graph.triples, 0, True
    found = [graph.spark.createDataFrame(more, TRIPLE)] if more else []
    for layer in strata(rules):
        kinds = _transitive(layer) if delta is None and on_step is None and max_steps - steps >= ALL_STEPS else None
        if kinds is not None:  # closures; the pairs are made when they are read
            facts = Graph(union([base, *found]))
            found += [closure(facts.scan(p=p), beyond=True).select("s", F.lit(p).alias("p"), "o") for p in kinds]
            steps += 1
            continue
        fresh = cut(delta.triples) if delta is not None else None
        heads = {t[1] for r in layer for t in r.head}
        while steps < max_steps:
            facts = Graph(union([base, *found]))
            made = [d for r in layer if (d := derive(r, facts, Graph(fresh) if fresh is not None else None)) is not None]
            if not made:
                break
            known = facts.triples if any(p.startswith("?") for p in heads) else facts.triples.where(F.col("p").isin(*heads))
            new = cut(union(made).distinct().join(known, ["s", "p", "o"], "left_anti"))
            steps += 1
            if new.isEmpty():
                break
            if on_step:
                on_step(steps, new)
            found.append(new)
            if len(found) > MOST_PARTS:
                found = [cut(union(found))]
            fresh = new
        else:
            complete = False
    inferred = union(found) if found else base.limit(0)
    whole = Graph(union([base, *found]))
    if complete and delta is None and _transitive(rules) is not None:
        whole.basis = graph, given
    return Result(whole, inferred, steps, complete)


def derivations(graph: Graph, rules: list[Rule], max_steps: int = 10_000) -> DataFrame:
    """One derivation of each inferred triple, of the earliest step: rule, step and premises; ties by rule and premises."""
    out, steps = [], 0
    rules = [x for r in rules if (x := simplified(r)) is not None]
    kinds = _transitive(rules) if max_steps >= ALL_STEPS else None
    if kinds is not None:
        made = [_line_proofs(graph.scan(p=p), r) for p, r in kinds.items()]
        if all(x is not None for x in made):
            return union(made)
    while steps < max_steps:
        steps += 1
        facts = union([graph.triples, *[x.select("s", "p", "o") for x in out]])
        found = []
        for r in rules:
            s = solve(r.body, Graph(facts))
            place = lambda t, s=s: (F.col(f"`{t[1:]}`") if t[1:] in s.variables else F.lit(None).cast("string")) if t.startswith("?") else F.lit(t)
            premises = F.array(*[F.struct(*[place(t).alias(n) for n, t in zip("spo", a, strict=True)]) for a in r.body if is_data(a)])
            kept = Solutions(s.frame.withColumn("__premises", premises), s.variables, s.maybe, s.numbers)
            for t in r.head:
                found.append(kept.frame.select(*[place(x).alias(n) for n, x in zip("spo", t, strict=True)], F.lit(r.name).alias("rule"), "__premises"))
        new = union(found).where("s is not null and p is not null and o is not null").join(facts, ["s", "p", "o"], "left_anti")
        first = cut(new.groupBy("s", "p", "o").agg(F.min(F.struct("rule", "__premises")).alias("d")).select("s", "p", "o", "d.rule", F.lit(steps).alias("step"), F.col("d.__premises").alias("premises")))
        if first.isEmpty():
            break
        out.append(first)
    return union(out) if out else graph.spark.createDataFrame([], DERIVATION)


def _line_proofs(facts: DataFrame, rule: Rule) -> DataFrame | None:
    """The derivations a transitive rule has along lines: nodes d edges apart are linked in step log2 d, rounded up, over
    the least node between them that is linked with both by then. None where facts branch, merge or go in rings, or
    lines are too long for one row."""
    found = lines(cut(facts.select("s", "o").distinct()))
    if found is None or found[1] or not found[0].where(F.col("at") >= MOST_PROVED).isEmpty():
        return None
    places, p = found[0], rule.head[0][1]
    n = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.sparkSession.sparkContext.defaultParallelism)
    each = places.repartition(n, "line").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("x")).select(F.col("x.n").alias("x")).where(F.size("x") > 2)
    firsts = each.select("x", F.explode(F.sequence(F.lit(1), F.size("x") - 2)).alias("i"))
    pairs = firsts.select("x", "i", F.explode(F.sequence(F.col("i") + 2, F.size("x"))).alias("j"))
    step = F.length(F.bin(F.col("j") - F.col("i") - 1))
    half = F.expr("shiftleft(1, step - 1)")
    low, high = F.greatest(F.col("i") + 1, F.col("j") - half), F.least(F.col("j") - 1, F.col("i") + half)
    rows = pairs.withColumn("step", step.cast("int")).select(
        F.element_at("x", F.col("i")).alias("s"), F.element_at("x", F.col("j")).alias("o"), "step", F.array_min(F.slice("x", low, high - low + 1)).alias("m"))
    x, z = rule.head[0][0], rule.head[0][2]
    put = lambda t: F.lit(t) if t == p else F.col("s" if t == x else "o" if t == z else "m")
    premises = F.array(*[F.struct(*[put(t).alias(c) for c, t in zip("spo", a, strict=True)]) for a in rule.body])
    return rows.select("s", F.lit(p).alias("p"), "o", F.lit(rule.name).alias("rule"), "step", premises.alias("premises"))


def validate(proof: DataFrame, asserted: Graph) -> DataFrame:
    """Premises that are neither asserted nor derived in an earlier step: none in a valid proof."""
    needed = proof.select("step", F.explode("premises").alias("x")).select("step", "x.s", "x.p", "x.o")
    # asserted triples are there from the start
    there = asserted.triples.withColumn("at", F.lit(0)).unionByName(proof.select("s", "p", "o", F.col("step").alias("at")))
    there = there.select(*[F.col(c).alias(f"e{c}") for c in "spo"], "at")
    return needed.join(there, (F.col("s") == F.col("es")) & (F.col("p") == F.col("ep")) & (F.col("o") == F.col("eo")) & (F.col("at") < F.col("step")), "left_anti")


def why(proof: DataFrame, triple: tuple[str, str, str], depth: int = 100) -> list[tuple]:
    """The derivations below one triple: rows (depth, s, p, o, rule, premises). What one proof needs goes to the driver."""
    wanted, out, seen = [triple], [], set()
    for level in range(depth):
        wanted = [t for t in wanted if t not in seen]
        if not wanted:
            break
        seen |= set(wanted)
        asked = proof.sparkSession.createDataFrame(wanted, "s string, p string, o string")
        rows = proof.join(F.broadcast(asked), ["s", "p", "o"], "left_semi").collect()
        out += [(level, r.s, r.p, r.o, r.rule, [tuple(x) for x in r.premises]) for r in rows]
        wanted = [tuple(x) for r in rows for x in r.premises]
    return out


def why_not(graph: Graph, rules: list[Rule], triple: tuple[str, str, str]) -> list[tuple[str, tuple]]:
    """For each rule whose head fits the triple the body atoms that nothing fulfils with the head's bindings."""
    out = []
    for r in rules:
        for head in r.head:
            binding = {}
            if all(h == t or (h.startswith("?") and binding.setdefault(h, t) == t) for h, t in zip(head, triple, strict=True)):
                for a in r.body:
                    if is_data(a):
                        atom = tuple(binding.get(x, x) for x in a)
                        if graph.match(*atom).isEmpty():
                            out.append((r.name, atom))
    return out


def insert(result: Graph, rules: list[Rule], added: DataFrame) -> Result:
    """A materialised graph after insertions: semi-naive from the new triples. Where all rules are transitivity, what
    the graph was made from and the new triples are closed again, which makes each pair once."""
    if result.basis is not None and result.basis[1] == tuple(rules):
        base = result.basis[0].triples
        again = reason(Graph(base.unionByName(added.select("s", "p", "o").distinct().join(base, ["s", "p", "o"], "left_anti"))), rules)
        return dataclasses.replace(again, inferred=again.inferred.join(result.triples, ["s", "p", "o"], "left_anti"))
    new = cut(added.select("s", "p", "o").distinct().join(result.triples, ["s", "p", "o"], "left_anti"))
    return reason(Graph(result.triples.unionByName(new)), rules, delta=Graph(new))


def remove(asserted: Graph, materialised: Graph, rules: list[Rule], removed: DataFrame) -> Graph:
    """A materialised graph after deletions: what depends on them is over-deleted, then what still follows is derived.
    Where all rules are transitivity and the graph was made from these facts, the rest is closed again."""
    kept_facts = asserted.delete(removed)
    if materialised.basis is not None and materialised.basis[0] is asserted and materialised.basis[1] == tuple(rules):
        return reason(kept_facts, rules).graph
    gone = cut(removed.select("s", "p", "o").distinct().join(materialised.triples, ["s", "p", "o"], "left_semi"))
    delta, facts = gone, materialised
    while not delta.isEmpty():
        made = [d for r in rules if (d := derive(r, facts, Graph(delta))) is not None]
        if not made:
            break
        found = union(made).distinct().join(materialised.triples, ["s", "p", "o"], "left_semi")
        delta = cut(found.join(gone, ["s", "p", "o"], "left_anti").join(kept_facts.triples, ["s", "p", "o"], "left_anti"))
        gone = cut(gone.unionByName(delta))
    rest = Graph(materialised.delete(gone).triples.unionByName(kept_facts.triples).distinct())
    return reason(rest, rules).graph


def relevant(rules: list[Rule], goals: list[tuple]) -> list[Rule]:
    """The rules whose conclusions the goals can need, directly or through other rules."""
    wanted, out = {g[1] for g in goals}, []
    while True:
        more = [r for r in rules if r not in out and any(t[1] in wanted or t[1].startswith("?") or any(w.startswith("?") for w in wanted) for t in r.head)]
        if not more:
            return [r for r in rules if r in out]
        out += more
        wanted |= {a[1] for r in more for a in r.body if is_data(a)}


def _pushed(rules: list[Rule], goals: list[tuple]) -> list[Rule]:
    """The rules with a goal's constant put in, where every rule for its predicate hands that place on unchanged: what
    is derived then is only what the constant can reach."""
    out = list(rules)
    for g in goals:
        own = [r for r in out if any(t[1] == g[1] for t in r.head)]
        if g[1].startswith("?") or not own or any(len(r.head) != 1 for r in own) or sum(x[1] == g[1] for x in goals) > 1:
            continue
        uses = [(r, a) for r in out for a in r.body if is_data(a) and (a[1] == g[1] or a[1].startswith("?"))]
        for place in (0, 2):
            if g[place].startswith("?"):
                continue
            # linear in itself, with the same variable in that place of head and body
            through = all(r.head[0][place].startswith("?") and all(a[1] == g[1] and a[place] == r.head[0][place] for a in r.body if is_data(a) and (a[1] == g[1] or a[1].startswith("?"))) for r in own)
            if through and all(r in own for r, _ in uses):
                put = lambda t, v: tuple(g[place] if x == v else x for x in t)  # noqa: B023, E731
                plain = all(isinstance(x, str) for r in own for a in r.body for x in a)
                if plain:
                    out = [Rule(tuple(put(a, r.head[0][place]) for a in r.body), (put(r.head[0], r.head[0][place]),), r.name) if r in own else r for r in out]
                break
    return out


def answer(graph: Graph, rules: list[Rule], goals: list[tuple]) -> DataFrame:
    """Goal-directed: the goals' bindings over the fixpoint of the rules that matter to them, with the goals' constants
    put into the rules where they pass through."""
    return basic(reason(graph, _pushed(relevant(rules, goals), goals)).graph, goals).frame


def materialise(graph: Graph, rules: list[Rule], strategy: str = "eager", predicates: set[str] | None = None, selectivity: float = 0.5, max_steps: int = 10_000) -> Result:
    """eager: the fixpoint; lazy: nothing; partial: one step of the selective rules; hybrid: the fixpoint of the rules
    that conclude the given predicates."""
    if strategy == "lazy":
        return Result(graph, graph.triples.limit(0), 0, False)
    if strategy == "partial":
        def share(r: Rule) -> float:
            places = [t for a in r.body if is_data(a) for t in a]
            return 1 - sum(not variables(t) for t in places) / max(1, len(places))

        return reason(graph, [r for r in rules if share(r) <= selectivity], max_steps=1)
    if strategy == "hybrid":
        return reason(graph, [r for r in rules if any(t[1] in (predicates or set()) for t in r.head)], max_steps)
    return reason(graph, rules, max_steps)
