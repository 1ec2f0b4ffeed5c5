"""Rules as join plans: body atoms become pattern joins, built-ins become filters and columns once their inputs are
bound, negated formulas become anti-joins; and the order of strata."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import builtins, terms
from graphloom.plans.compile import Solutions, _solutions, instantiate, join
from graphloom.plans.expressions import Val, constant
from graphloom.sources.graphs import Graph, bind
from graphloom.sources.n3 import Formula, ListTerm, Rule

NOT_INCLUDES = f"<{terms.LOG}notIncludes>"
INCLUDES = f"<{terms.LOG}includes>"


class RuleError(ValueError):
    """A rule that no order of its atoms can evaluate."""


def variables(t) -> set[str]:
    if isinstance(t, ListTerm):
        return set().union(*map(variables, t.items))
    if isinstance(t, Formula):
        return {v for a in t.triples for x in a for v in variables(x)}
    return {t[1:]} if t.startswith("?") else set()


def is_data(atom: tuple) -> bool:
    return not builtins.is_builtin(atom[1]) and atom[1] not in (NOT_INCLUDES, INCLUDES) and not any(isinstance(x, (ListTerm, Formula)) for x in atom)


def _value(t, s: Solutions):
    """A term as a value, a list as a list of values; None if it has an unbound variable."""
    if isinstance(t, ListTerm):
        items = [_value(x, s) for x in t.items]
        return None if any(x is None for x in items) else items
    if isinstance(t, Formula):
        return constant("{}")
    if not t.startswith("?"):
        return constant(t)
    v = t[1:]
    if v not in s.variables:
        return None
    if dict(s.frame.dtypes)[v].startswith("array"):
        return F.col(v)
    return Val(F.col(f"`{v}`"), F.col(s.numbers[v]) if v in s.numbers else None)


def _inverse(atom: tuple, s: Solutions) -> Solutions | None:
    """math:sum and its kin solved for one unknown of the list."""
    name = atom[1].rsplit("#", 1)[-1][:-1]
    if not isinstance(atom[0], ListTerm) or len(atom[0].items) != 2 or name not in ("sum", "difference", "product", "quotient") or "/math#" not in atom[1]:
        return None
    a, b, c = _value(atom[0].items[0], s), _value(atom[0].items[1], s), _value(atom[2], s)
    if c is None or (a is None) == (b is None):
        return None
    known = (b if a is None else a).num
    made = {
        ("sum", True): lambda: c.num - known, ("sum", False): lambda: c.num - known, ("difference", True): lambda: c.num + known, ("difference", False): lambda: known - c.num,
        ("product", True): lambda: F.try_divide(c.num, known), ("product", False): lambda: F.try_divide(c.num, known), ("quotient", True): lambda: c.num * known,
        ("quotient", False): lambda: F.try_divide(known, c.num),
    }[name, a is None]()
    target = atom[0].items[0 if a is None else 1]
    return _bound(s, target[1:], Val(_num=made))


def _bound(s: Solutions, name: str, made) -> Solutions:
    if not isinstance(made, Val):
        return Solutions(s.frame.withColumn(name, made).where(F.col(name).isNotNull()), [*s.variables, name], s.maybe, s.numbers, s.keys)
    frame, numbers = s.frame.withColumn(name, made.term).where(F.col(f"`{name}`").isNotNull()), dict(s.numbers)
    if made._num is not None:
        frame, numbers[name] = frame.withColumn(f"__n_{name}", made._num.cast("double")), f"__n_{name}"
    return Solutions(frame, [*s.variables, name], s.maybe, numbers, s.keys)


_LIST_IN, _LIST_MEMBER = f"<{builtins.NAMESPACES['list']}in>", f"<{builtins.NAMESPACES['list']}member>"


def _members(s: Solutions, name: str, items) -> Solutions:
    """s once for each member of the list, bound to the variable."""
    frame = s.frame.withColumn(name, F.explode(builtins._array(items)))
    return dataclasses.replace(s, frame=frame, variables=[*s.variables, name])


def apply_builtin(atom: tuple, s: Solutions) -> Solutions | None:
    """s with the built-in applied, or None while it lacks inputs."""
    subject = _value(atom[0], s)
    obj = _value(atom[2], s)
    if subject is None:
        if atom[1] == _LIST_IN and obj is not None and isinstance(atom[0], str):  # each member of the list
            return _members(s, atom[0][1:], obj)
        return _inverse(atom, s)
    b = builtins.REGISTRY[atom[1]]
    if b.kind == "test":
        if obj is None:
            return _members(s, atom[2][1:], subject) if atom[1] == _LIST_MEMBER and isinstance(atom[2], str) else None
        return dataclasses.replace(s, frame=s.frame.where(builtins.evaluate(atom[1], subject, obj)))
    made = builtins.evaluate(atom[1], subject, None)
    if b.kind == "holds":
        return dataclasses.replace(s, frame=s.frame.where(made))
    if obj is None:
        if isinstance(atom[2], ListTerm):  # a pattern of variables takes the result apart
            out = Solutions(s.frame.withColumn("__list", made).where(F.size("__list") == len(atom[2].items)), s.variables, s.maybe, s.numbers)
            for i, t in enumerate(atom[2].items):
                out = _bound(out, t[1:], Val(F.get("__list", F.lit(i)))) if t.startswith("?") and t[1:] not in out.variables else dataclasses.replace(out, frame=out.frame.where(F.get("__list", F.lit(i)) == _value(t, out).term))
            return dataclasses.replace(out, frame=out.frame.drop("__list"))
        return _bound(s, atom[2][1:], made)
    if isinstance(made, Val):
        test = made.num == obj.num if b.kind == "num" else made.text == obj.text if b.kind == "text" else made.term == obj.term
    else:
        test = made == (F.array(*[v.term for v in obj]) if isinstance(obj, list) else obj)
    return dataclasses.replace(s, frame=s.frame.where(test))


def solve(body: tuple, facts: Graph, delta: Graph | None = None, position: int = -1, start: Solutions | None = None) -> Solutions:
    """The body's solutions over facts; the data atom at ``position`` reads ``delta`` instead."""
    data = [(i, a) for i, a in enumerate(body) if is_data(a)]
    waiting = [a for a in body if not is_data(a)]
    out = start
    if out is None and not data:
        out = Solutions(facts.spark.range(1).select(F.lit(1).alias("__match")), [])
    seen: set[str] = set(out.variables) if out else set()

    def settle(s: Solutions | None) -> Solutions | None:
        progress = True
        while s is not None and progress:
            progress = False
            for a in list(waiting):
                if a[1] in (NOT_INCLUDES, INCLUDES):
                    if data and any(variables(x) & variables(a[2]) - set(s.variables) for _, atom in data for x in atom):
                        continue  # its shared variables are still to be bound
                    made = _scoped(a, s, facts)
                else:
                    made = apply_builtin(a, s)
                if made is not None:
                    waiting.remove(a)
                    s, progress = made, True
        return s

    out = settle(out)
    while data:
        # the delta first, as it is small; then what is most bound and connected
        data.sort(key=lambda x: (x[0] != position, -len(set().union(*map(variables, x[1])) & seen), -sum(not t.startswith("?") for t in x[1])))
        i, atom = data.pop(0)
        part = _solutions(bind(delta if i == position else facts, *atom))
        out = settle(join(out, part))
        seen = set(out.variables)
    if waiting:
        raise RuleError(f"no order binds the inputs of {waiting}")
    return out


def _scoped(atom: tuple, s: Solutions, facts: Graph) -> Solutions:
    """{pattern} in a written formula, or with a variable as scope in all facts: kept where it is (not) included."""
    inside = atom[2].triples
    if isinstance(atom[0], Formula):
        rows = [tuple(t) for t in atom[0].triples]
        facts = Graph.of(facts.spark, rows)
    found = solve(inside, facts)
    shared = [v for v in s.variables if v in found.variables]
    how = "left_anti" if atom[1] == NOT_INCLUDES else "left_semi"
    if shared:
        names = {v: f"__m_{i}" for i, v in enumerate(shared)}
        other = found.frame.select(*[F.col(f"`{v}`").alias(n) for v, n in names.items()]).distinct()
        test = F.lit(True)
        for v, n in names.items():
            test = test & (F.col(f"`{v}`") == F.col(n))
    else:
        other, test = found.frame.select(F.lit(1).alias("__m")).limit(1), F.lit(True)
    return dataclasses.replace(s, frame=s.frame.join(other, test, how))


def heads(rule: Rule, s: Solutions) -> DataFrame:
    """The rule's conclusions; those with an unbound variable are left out."""
    return instantiate(s, [(None, *t) for t in rule.head]).select("s", "p", "o")


def derive(rule: Rule, facts: Graph, delta: Graph | None) -> DataFrame | None:
    """What the rule concludes from facts, using the delta in one data atom at least (all facts if there is none)."""
    from graphloom.sources.graphs import union

    if delta is None:
        return heads(rule, solve(rule.body, facts))
    places = [i for i, a in enumerate(rule.body) if is_data(a)]
    if not places:
        return None
    return union([heads(rule, solve(rule.body, facts, delta, i)) for i in places])


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in layers: what a layer negates is complete before it. Raises where rules negate themselves."""
    def key(t: tuple) -> tuple[str, str]:
        """The predicate, and of types the class; ``*`` for any."""
        p = "*" if t[1].startswith("?") else t[1]
        return p, t[2] if p == terms.TYPE and isinstance(t[2], str) and not t[2].startswith("?") else "*"

    def needs(r: Rule) -> tuple[set, set]:
        open_scope = [a for a in r.body if a[1] in (INCLUDES, NOT_INCLUDES) and not isinstance(a[0], Formula)]
        positive = {key(a) for a in r.body if is_data(a)} | {key(t) for a in open_scope if a[1] == INCLUDES for t in a[2].triples}
        return positive, {key(t) for a in open_scope if a[1] == NOT_INCLUDES for t in a[2].triples}

    def meets(made: set, wanted: set) -> bool:
        return any((a == c or "*" in (a, c)) and (b == d or "*" in (b, d)) for a, b in made for c, d in wanted)

    level = [0] * len(rules)
    for _ in range(len(rules) * len(rules) + 1):
        changed = False
        for i, r in enumerate(rules):
            positive, negative = needs(r)
            for j, other in enumerate(rules):
                made = {key(t) for t in other.head}
                least = max(level[j] if meets(made, positive) else 0, level[j] + 1 if meets(made, negative) else 0)
                if least > level[i]:
                    level[i], changed = least, True
        if not changed:
            break
        if max(level) > len(rules):
            raise RuleError("rules negate what they depend on")
    return [[r for r, n in zip(rules, level, strict=True) if n == at] for at in sorted(set(level))]
