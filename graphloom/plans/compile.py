"""From the algebra to DataFrames: one plan for each query, which Catalyst optimises as a whole."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators import paths
from graphloom.plans.algebra import Aggregate, Expr, Group, Path, Query
from graphloom.plans.expressions import Val, compile_expr, constant
from graphloom.sources.graphs import Dataset, Graph, TableGraph, bind, union


#: Parts that each side is dealt to where no variable joins them.
SALT = 16
#: Variables that can be unbound on both sides of a join, at most, for their cases to be told apart.
MOST_LOOSE = 4


@dataclasses.dataclass
class Solutions:
    """Bindings: a column for each variable, null where unbound; ``maybe`` names the variables that can be unbound,
    ``numbers`` hidden columns that hold a variable's number, and ``keys`` hidden columns that hold the native key of
    the table row a variable names, with the table."""

    frame: DataFrame
    variables: list[str]
    maybe: frozenset[str] = frozenset()
    numbers: dict[str, str] = dataclasses.field(default_factory=dict)
    keys: dict[str, tuple[str, str]] = dataclasses.field(default_factory=dict)
    inline: bool = False  # as large as the query's text

    def col(self, v: str) -> Column:
        return F.col(f"`{v}`")

    @property
    def hidden(self) -> list[str]:
        return list(dict.fromkeys([*self.numbers.values(), *(h for _, h in self.keys.values())]))


def _solutions(frame: DataFrame, numbers: dict[str, str] | None = None, keys: dict[str, tuple[str, str]] | None = None) -> Solutions:
    return Solutions(frame, [c for c in frame.columns if not c.startswith(("__n_", "__k_")) and c != "__match"], numbers=numbers or {}, keys=keys or {})


def _cases(s: Solutions, loose: list[str]) -> list[Solutions]:
    """The solutions told apart by which of the loose variables are unbound; a case lacks those."""
    open_ = [v for v in loose if v in s.maybe]
    out = []
    for bits in range(1 << len(open_)):
        gone = {v for i, v in enumerate(open_) if bits >> i & 1}
        frame = s.frame
        for v in open_:
            frame = frame.where(F.col(f"`{v}`").isNull() if v in gone else F.col(f"`{v}`").isNotNull())
        numbers = {v: h for v, h in s.numbers.items() if v not in loose}
        keys = {v: k for v, k in s.keys.items() if v not in loose}
        variables = [v for v in s.variables if v not in gone]
        kept = Solutions(frame, variables, s.maybe - set(open_), numbers, keys)
        out.append(dataclasses.replace(kept, frame=frame.select(*[F.col(f"`{v}`") for v in variables], *[F.col(h) for h in kept.hidden], *([] if variables else [F.lit(1).alias("__match")]))))
    return out


def _product(left: Solutions, right: Solutions) -> Solutions:
    """Every pair: an inline table goes to all rows, else by an equi-join of parts: each side's rows are dealt by their
    hash, and sent once for each part of the other side. Parts are dealt to all partitions by number, as the pairs are
    many where the sides are small."""
    hidden = [h for h in right.hidden if h not in left.hidden]
    r = right.frame.select(*[F.col(f"`{v}`") for v in right.variables], *[F.col(h) for h in hidden])
    numbers, keys = {**{v: h for v, h in right.numbers.items() if h in hidden}, **left.numbers}, {**{v: k for v, k in right.keys.items() if k[1] in hidden}, **left.keys}
    if left.inline or right.inline:
        frame = F.broadcast(left.frame).crossJoin(r) if left.inline else left.frame.crossJoin(F.broadcast(r))
    else:
        own = lambda s: F.pmod(F.xxhash64(*[F.col(f"`{v}`") for v in s.variables]), F.lit(SALT)).cast("int") if s.variables else F.lit(0)
        every = lambda s: F.explode(F.sequence(F.lit(0), F.lit(SALT - 1 if s.variables else 0)))
        n = max(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), r.sparkSession.sparkContext.defaultParallelism)
        dealt = lambda f, i, j: f.withColumn("__i", i).withColumn("__j", j).repartition(n, "__i", "__j")
        frame = dealt(left.frame, own(left), every(right)).join(dealt(r, every(left), own(right)), ["__i", "__j"]).drop("__i", "__j")
    return Solutions(frame, left.variables + right.variables, left.maybe | right.maybe, numbers, keys, left.inline and right.inline)


def _together(parts: list[Solutions], variables: list[str], maybe: frozenset[str]) -> Solutions:
    """The union of cases; a variable a case lacks is unbound in it."""
    numbers = {v: h for v, h in parts[0].numbers.items() if all(x.numbers.get(v) == h for x in parts)}
    keys = {v: k for v, k in parts[0].keys.items() if all(x.keys.get(v) == k for x in parts)}
    hidden = list(dict.fromkeys([*numbers.values(), *(h for _, h in keys.values())]))
    frames = [x.frame.select(*[F.col(f"`{v}`") if v in x.variables else F.lit(None).cast("string").alias(v) for v in variables], *[F.col(h) for h in hidden]) for x in parts]
    return Solutions(union(frames), variables, maybe, numbers, keys)


def _same(left: Solutions, right: Solutions, v: str, names: Callable[[str, str], Column]) -> Column:
    """Whether a variable has the same value on both sides: by native keys of one table where both have them."""
    a, b = left.keys.get(v), right.keys.get(v)
    if a and b and a[0] == b[0]:
        return names("l", a[1]) == names("r", b[1])
    return names("l", v) == names("r", v)


def join(left: Solutions | None, right: Solutions, how: str = "inner", condition: Callable[[Solutions], Column] | None = None) -> Solutions:
    """The compatible merge of two solutions. Variables bound on both sides make an equi-join; where one can be unbound
    it matches anything, and rows are told apart by that, so that the bound ones still make an equi-join."""
    if left is None:
        return right
    shared = [v for v in left.variables if v in right.variables]
    loose = [v for v in shared if v in left.maybe or v in right.maybe]
    variables = left.variables + [v for v in right.variables if v not in shared]
    maybe = (left.maybe & right.maybe) | {v for v in left.maybe | right.maybe if v not in shared}
    if how == "left":
        maybe |= {v for v in right.variables if v not in shared} | (left.maybe & set(shared))
    if loose and len(loose) <= MOST_LOOSE:
        if how == "inner" and condition is None:
            return _together([join(a, b) for a in _cases(left, loose) for b in _cases(right, loose)], variables, frozenset(maybe))
        if how == "left" and not right.maybe & set(loose):
            return _together([join(a, right, how, condition) for a in _cases(left, loose)], variables, frozenset(maybe))
    # the right side's shared and hidden columns under names of their own
    renamed = {v: f"__r_{i}" for i, v in enumerate(shared)} | {h: f"__r{h}" for h in right.hidden}
    r = right.frame.withColumnsRenamed(renamed)
    names = lambda side, c: F.col(f"`{renamed[c] if side == 'r' else c}`")
    tests = [_same(left, right, v, names) if v not in loose else names("l", v).isNull() | names("r", v).isNull() | (names("l", v) == names("r", v)) for v in shared]
    fresh_numbers = {v: h for v, h in right.numbers.items() if v not in left.numbers and v not in loose}
    fresh_keys = {v: k for v, k in right.keys.items() if v not in left.keys and v not in loose}
    if condition is not None:
        merged = Solutions(left.frame, variables, left.maybe | right.maybe, left.numbers | {v: f"__r{h}" for v, h in fresh_numbers.items()})
        tests.append(condition(merged))
    if tests:
        out = left.frame.join(r, reduce(lambda a, b: a & b, tests), how)
    elif how == "inner":
        return _product(left, right)
    else:
        out = left.frame.join(r, F.lit(True), how)
    columns = [F.coalesce(F.col(f"`{v}`"), names("r", v)).alias(v) if v in loose else F.col(f"`{v}`") for v in left.variables]
    columns += [F.col(f"`{v}`") for v in right.variables if v not in shared]
    numbers = {v: h for v, h in left.numbers.items() if v not in loose} | fresh_numbers
    keys = {v: k for v, k in left.keys.items() if v not in loose} | fresh_keys
    own = list(dict.fromkeys([*(h for v, h in numbers.items() if v not in fresh_numbers), *(k[1] for v, k in keys.items() if v not in fresh_keys)]))
    new = list(dict.fromkeys([*fresh_numbers.values(), *(k[1] for k in fresh_keys.values())]))
    frame = out.select(*columns, *[F.col(h) for h in own], *[F.col(f"`__r{h}`").alias(h) for h in new if h not in own], *([] if columns else [F.lit(1).alias("__match")]))
    return Solutions(frame, variables, frozenset(maybe), numbers, keys)


def _vars(t: tuple) -> set[str]:
    return {x[1:] for x in t if isinstance(x, str) and x.startswith("?")}


def basic(graph: Graph, patterns: list[tuple]) -> Solutions:
    """A basic graph pattern. Patterns about one subject go to the graph as a star; parts are joined along shared
    variables, the most bound first, so that a product arises only where the query asks for one."""
    parts: list[tuple[set[str], int, Callable[[Solutions | None], Solutions]]] = []
    rest = list(patterns)
    nodes = {x[1:] for t in patterns if isinstance(t[1], str) for x in (t[0], t[2]) if isinstance(x, str) and x.startswith("?")}

    def path(t: tuple, found: Solutions | None) -> Solutions:
        """A path's bindings; from the nodes that its subject is known to be, where others have bound it to nodes."""
        v = t[0][1:]
        among = found.frame.select(found.col(v).alias("s")).distinct() if found is not None and t[0].startswith("?") and v in found.variables and v in nodes else None
        return _solutions(paths.bind_path(graph, *t, among=among))

    if isinstance(graph, TableGraph):
        by_subject: dict[str, list[tuple]] = {}
        for t in patterns:
            if t[0].startswith("?") and isinstance(t[1], str) and not t[1].startswith("?"):
                by_subject.setdefault(t[0], []).append(t)
        for subject, ts in by_subject.items():
            made = graph.star(subject, [(p, o) for _, p, o in ts])
            if made is not None:
                parts.append((set().union(*map(_vars, ts)), sum(not t[2].startswith("?") for t in ts), lambda _, m=made: _solutions(*m)))
                rest = [t for t in rest if t not in ts]
    for t in rest:
        bound = sum(isinstance(x, str) and not x.startswith("?") for x in t)
        if isinstance(t[1], Path):
            parts.append((_vars(t), bound, lambda found, t=t: path(t, found)))
        else:
            parts.append((_vars(t), bound, lambda _, t=t: _solutions(bind(graph, *t))))
    out, seen = None, set()
    while parts:
        parts.sort(key=lambda x: (-len(x[0] & seen) if seen else 0, -x[1], len(x[0])))
        names, _, make = parts.pop(0)
        out, seen = join(out, make(out)), seen | names
    return out if out is not None else unit(graph)


def unit(graph: Graph | Dataset) -> Solutions:
    """One solution that binds nothing."""
    return Solutions(graph.spark.range(1).select(F.lit(1).alias("__match")), [], inline=True)


class Compiler:
    """Compiles queries over a graph, or over a dataset (its default graph, GRAPH for the others)."""

    def __init__(self, data: Graph | Dataset, service: Callable[[str, Group], DataFrame] | None = None):
        self.dataset = data if isinstance(data, Dataset) else None
        self.graph = data.default() if isinstance(data, Dataset) else data
        self.service = service

    # patterns
    def group(self, g: Group, graph: Graph, outer: Solutions | None = None) -> Solutions:
        out, filters = outer, []
        for element in g.elements:
            op = element[0]
            if op == "bgp":
                out = join(out, basic(graph, element[1]))
            elif op == "tagged":
                out = join(out, _bind_quads(graph.quads, element[1], element[2]))
            elif op == "named":
                out = join(out, _solutions(self.dataset.graph_names().select(F.col("g").alias(element[1][1:]))))
            elif op == "filter":
                filters.append(element[1])
            elif op == "optional":
                inner = element[1]
                conditions = [e[1] for e in inner.elements if e[0] == "filter"]
                body = self.group(Group([e for e in inner.elements if e[0] != "filter"]), graph)
                test = (lambda s, c=conditions: reduce(lambda a, b: a & b, [F.coalesce(self.expr(e, s).truth, F.lit(False)) for e in c])) if conditions else None
                out = join(out if out is not None else unit(self.graph), body, "left", test)
            elif op == "union":
                out = join(out, self.union([self.group(x, graph) for x in element[1]]))
            elif op == "group":
                out = join(out, self.group(element[1], graph))
            elif op == "minus":
                out = self.minus(out if out is not None else unit(self.graph), self.group(element[1], graph))
            elif op == "bind":
                out = self.extend(out if out is not None else unit(self.graph), element[2], element[1])
            elif op == "values":
                out = join(out, self.values(element[1], element[2]))
            elif op == "graph":
                out = join(out, self.named(element[1], element[2]))
            elif op == "select":
                out = join(out, self.select(element[1], graph))
            elif op == "service":
                out = self.remote(out, *element[1:])
        out = out if out is not None else unit(self.graph)
        for e in filters:
            out = self.filter(out, e, graph)
        return out

    def expr(self, e: Expr, s: Solutions, aggregates: Callable | None = None) -> Val:
        return compile_expr(e, set(s.variables), s.numbers, aggregates)

    def filter(self, s: Solutions, e: Expr, graph: Graph) -> Solutions:
        """The solutions for which e is true."""
        if not _has_exists(e):
            return dataclasses.replace(s, frame=s.frame.where(self.expr(e, s).truth))
        return self._where(s, _pushed_in(e), graph)

    def _where(self, s: Solutions, e: Expr, graph: Graph, holds: bool = True) -> Solutions:
        """The solutions for which e, with negations at its leaves, is true, or those for which it isn't."""
        if e.op == "exists" or (e.op == "not" and e.args[0].op == "exists"):
            wanted = (e.op == "exists") == holds
            return self._exists(s, (e if e.op == "exists" else e.args[0]).args[0], graph, "left_semi" if wanted else "left_anti")
        if e.op in ("and", "or") and _has_exists(e):
            a, b = sorted(e.args, key=_has_exists)  # what needs no join first
            if (e.op == "and") == holds:  # both (not true: neither)
                return self._where(self._where(s, a, graph, holds), b, graph, holds)
            rest = self._where(self._where(s, a, graph, not holds), b, graph, holds)
            first = self._where(s, a, graph, holds)
            return dataclasses.replace(s, frame=first.frame.unionByName(rest.frame))
        truth = self.expr(e, s).truth
        return dataclasses.replace(s, frame=s.frame.where(truth if holds else ~F.coalesce(truth, F.lit(False))))

    def _exists(self, s: Solutions, g: Group, graph: Graph, how: str) -> Solutions:
        """Solutions with (without) a solution of the group; filters of the group see the variables of both."""
        outer = [e[1] for e in g.elements if e[0] == "filter" and _expr_vars(e[1]) & set(s.variables)]
        inner = self.group(Group([e for e in g.elements if not (e[0] == "filter" and any(e[1] is x for x in outer))]), graph)
        outer_only = [e for e in outer if _expr_vars(e) & set(s.variables) - set(inner.variables)]
        for e in outer:
            if e not in outer_only:
                inner = self.filter(inner, e, graph)
        if any(map(_has_exists, outer_only)):
            raise ValueError("an EXISTS inside an EXISTS cannot read variables from outside both")
        own = set().union(*map(_expr_vars, outer_only), set()) - set(s.variables)
        condition = (lambda m: reduce(lambda a, b: a & b, [F.coalesce(self.expr(e, m).truth, F.lit(False)) for e in outer_only])) if outer_only else None
        return self._semi(s, inner, how, own, condition)

    def _semi(self, left: Solutions, right: Solutions, how: str, own: set[str] = frozenset(), condition: Callable[[Solutions], Column] | None = None) -> Solutions:
        """Left solutions that agree with some (left_semi) or no (left_anti) right one; unbound agrees with anything.
        ``condition`` reads the left's variables and the right's ``own``."""
        shared = [v for v in left.variables if v in right.variables]
        loose = [v for v in shared if v in left.maybe | right.maybe]
        if loose and len(loose) <= MOST_LOOSE:
            out = []
            for a in _cases(left, loose):
                rest, met = a, []
                for b in _cases(right, loose):
                    met.append(self._semi(rest, b, "left_semi", own, condition))
                    rest = self._semi(rest, b, "left_anti", own, condition)
                out += met if how == "left_semi" else [rest]
            return _together(out, left.variables, left.maybe)
        names = {v: f"__m_{i}" for i, v in enumerate(shared)} | {h: f"__m{h}" for h in right.hidden}
        more = [v for v in right.variables if v in own]
        hidden = [h for v, h in right.numbers.items() if v in own] + [right.keys[v][1] for v in shared if v in right.keys]
        columns = [F.col(f"`{v}`").alias(names.get(v, v)) for v in [*shared, *more, *dict.fromkeys(hidden)]]
        other = right.frame.select(*columns).distinct() if columns else right.frame.select(F.lit(1).alias("__m")).limit(1)
        pick = lambda side, c: F.col(f"`{names[c] if side == 'r' else c}`")
        tests = [_same(left, right, v, pick) for v in shared]
        if condition is not None:
            tests.append(condition(Solutions(left.frame, left.variables + more, left.maybe | set(more), left.numbers | {v: f"__m{h}" for v, h in right.numbers.items() if v in own})))
        return dataclasses.replace(left, frame=left.frame.join(other, reduce(lambda a, b: a & b, tests, F.lit(True)), how))

    def minus(self, left: Solutions, right: Solutions) -> Solutions:
        """Without the solutions that agree with one on the right in some bound variable; disjoint ones stay."""
        shared = [v for v in left.variables if v in right.variables]
        if not shared:
            return left
        loose = [v for v in shared if v in left.maybe | right.maybe]
        if not loose:
            return self._semi(left, right, "left_anti")
        out = []
        for a in _cases(left, loose):
            for b in _cases(right, loose):
                if set(a.variables) & set(b.variables):
                    a = self._semi(a, b, "left_anti")
            out.append(a)
        return _together(out, left.variables, left.maybe)

    def extend(self, s: Solutions, name: str, e: Expr) -> Solutions:
        made = self.expr(e, s)
        frame = s.frame.withColumn(name, made.term)
        numbers = dict(s.numbers)
        if made._num is not None:
            frame = frame.withColumn(f"__n_{name}", made._num.cast("double"))
            numbers[name] = f"__n_{name}"
        return Solutions(frame, [*s.variables, name], s.maybe | {name} if _nullable(e, s) else s.maybe, numbers, s.keys, s.inline)

    def union(self, parts: list[Solutions]) -> Solutions:
        every = list(dict.fromkeys(v for s in parts for v in s.variables))
        frames = [s.frame.select(*[F.col(f"`{v}`") if v in s.variables else F.lit(None).cast("string").alias(v) for v in every] or [F.lit(1).alias("__match")]) for s in parts]
        maybe = {v for v in every for s in parts if v not in s.variables or v in s.maybe}
        return Solutions(union(frames), every, frozenset(maybe))

    def values(self, names: list[str], rows: list[tuple]) -> Solutions:
        """An inline table, as large as the query's text."""
        frame = self.graph.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        return Solutions(F.broadcast(frame), names, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows)), inline=True)

    def named(self, term: str, g: Group) -> Solutions:
        if self.dataset is None:
            raise ValueError("GRAPH needs a dataset")
        if not term.startswith("?"):
            return self.group(g, self.dataset.graph(term))
        return self.group(_tagged(g, term), _Quads(self.dataset))

    def remote(self, s: Solutions | None, endpoint: str, g: Group, silent: bool) -> Solutions:
        try:
            if self.service is None:
                raise ValueError(f"no handler for SERVICE {endpoint}")
            return join(s, _solutions(self.service(endpoint, g)))
        except Exception:
            if silent:
                return s if s is not None else unit(self.graph)
            raise

    # queries
    def select(self, q: Query, graph: Graph | None = None) -> Solutions:
        s = self.group(q.where, graph or self.graph)
        chosen = q.variables
        aggregated = bool(q.group_by) or any(isinstance(e, Expr) and _has_aggregate(e) for _, e in chosen or []) or any(map(_has_aggregate, q.having))
        if aggregated:
            s = self.grouped(q, s)
            chosen = [(n, None) for n, _ in chosen or []]
        elif chosen is not None:
            for name, e in chosen:
                if e is not None:
                    s = self.extend(s, name, e)
        names = sorted(v for v in s.variables if not v.startswith("__b")) if chosen is None else [n for n, _ in chosen]
        keys: list[Column] = []
        helpers: list[Column] = []
        for i, (e, down) in enumerate(q.order):
            v = self.expr(e, s)
            for j, k in enumerate((v.num, v.text)):
                helpers.append(k.alias(f"__o_{i}_{j}"))
                c = F.col(f"__o_{i}_{j}")
                # unbound first, then numbers, then the rest by text
                keys.append((c.desc_nulls_last() if down else c.asc_nulls_first()) if j else (c.desc_nulls_first() if down else c.asc_nulls_last()))
            unbound = v.text.isNull().cast("int").alias(f"__o_{i}_u")
            helpers.append(unbound)
            c = F.col(f"__o_{i}_u")
            keys.insert(len(keys) - 2, c.asc() if down else c.desc())
        numbers, keys_of = {v: h for v, h in s.numbers.items() if v in names}, {v: k for v, k in s.keys.items() if v in names}
        hidden = list(dict.fromkeys([*numbers.values(), *(h for _, h in keys_of.values())]))
        columns = [F.col(f"`{n}`") if n in s.variables else F.lit(None).cast("string").alias(n) for n in names]
        if q.distinct:
            frame = s.frame.select(*columns, *[h for h in helpers]).distinct() if helpers else s.frame.select(*columns).distinct()
            numbers, keys_of = {}, {}
            if helpers:  # the sort keys of variables that aren't projected don't tell solutions apart
                frame = frame.dropDuplicates(names)
        else:
            frame = s.frame.select(*columns, *[F.col(h) for h in hidden], *helpers)
        if keys:
            frame = frame.orderBy(*keys)
        if q.offset:
            frame = frame.offset(q.offset)
        if q.limit is not None:
            frame = frame.limit(q.limit)
        frame = frame.drop(*[c for c in frame.columns if c.startswith("__o_")])
        return Solutions(frame, names, s.maybe & set(names) | {n for n in names if n not in s.variables}, numbers, keys_of)

    def grouped(self, q: Query, s: Solutions) -> Solutions:
        keys = []
        for i, (name, e) in enumerate(q.group_by):
            name = name or f"__g{i}"
            if e.op != "var" or e.args[0] != name:
                s = self.extend(s, name, e)
            keys.append(name)
        made: dict[str, Column] = {}

        def aggregate(a: Aggregate) -> Val:
            name = f"__a{len(made)}"
            made[name], kind = _aggregate(a, self, s)
            c = F.col(name)
            return {"num": lambda: Val(_num=c), "int": lambda: Val(_term=terms.integer(c), _num=c.cast("double")), "term": lambda: Val(_term=c), "text": lambda: Val(_text=c)}[kind]()

        inner = Solutions(s.frame, keys, s.maybe, {})
        outputs = {n: compile_expr(e, set(keys), {}, aggregate) for n, e in q.variables or [] if e is not None}
        having = [compile_expr(h, set(keys) | set(outputs), {}, aggregate) for h in q.having]
        frame = inner.frame.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[c.alias(n) for n, c in made.items()] or [F.count("*").alias("__a")])
        numbers = {}
        for n, v in outputs.items():
            frame = frame.withColumn(n, v.term)
            if v._num is not None:
                frame = frame.withColumn(f"__n_{n}", v._num.cast("double"))
                numbers[n] = f"__n_{n}"
        for h in having:
            frame = frame.where(h.truth)
        variables = keys + [n for n in outputs if n not in keys]
        # counts, sums and means are there for every group
        sure = {n for n, e in q.variables or [] if isinstance(e, Expr) and e.op == "aggregate" and e.args[0].function in ("COUNT", "SUM", "AVG", "GROUP_CONCAT")}
        sure |= {n for n in outputs if n in keys and n not in s.maybe}
        return Solutions(frame, variables, s.maybe & set(keys) | set(outputs) - sure, numbers)

    def ask(self, q: Query) -> DataFrame:
        return self.group(q.where, self.graph).frame.limit(1).agg((F.count("*") > 0).alias("ask"))

    def construct(self, q: Query) -> DataFrame:
        s = self.group(q.where, self.graph)
        return instantiate(s, [(None, *t) for t in q.template]).select("s", "p", "o").distinct()

    def describe(self, q: Query) -> DataFrame:
        """Triples with a resource as subject; in a dataset as subject or object, over all graphs."""
        data = self.dataset.quads if self.dataset else None
        names = [r for r in q.resources if not r.startswith("?")]
        places = ("s", "o") if self.dataset else ("s",)
        found = []
        if names:
            found += [data.where(reduce(lambda a, b: a | b, [F.col(c).isin(names) for c in places]))] if self.dataset else [self.graph.scan(s=n) for n in names]
        asked = [r[1:] for r in q.resources if r.startswith("?")]
        if asked:
            s = self.group(q.where, self.graph)
            nodes = union([s.frame.select(F.col(f"`{v}`").alias("__node")) for v in asked if v in s.variables]).distinct()
            data = data if data is not None else self.graph.triples
            found += [data.join(nodes, F.col(c) == F.col("__node"), "left_semi") for c in places]
        return union([f.select("s", "p", "o") for f in found]).distinct()

    def run(self, q: Query) -> DataFrame:
        if q.form == "select":
            s = self.select(q)
            return s.frame.select(*[F.col(f"`{v}`") for v in s.variables])
        return {"ask": self.ask, "construct": self.construct, "describe": self.describe}[q.form](q)


def instantiate(s: Solutions, template: list[tuple]) -> DataFrame:
    """The template's quads for each solution; those with an unbound variable, or a literal as subject, are left out."""
    def place(t):
        if t is None:
            return F.lit(None).cast("string")
        return (F.col(f"`{t[1:]}`") if t[1:] in s.variables else F.lit(None).cast("string")) if t.startswith("?") else F.lit(t)

    frames = [s.frame.select(*[place(t).alias(n) for n, t in zip("gspo", quad, strict=True)]) for quad in template]
    return union(frames).where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~terms.is_literal(F.col("s")))


class _Quads(Graph):
    """All named graphs at once: patterns bind the graph too."""

    def __init__(self, dataset: Dataset):
        super().__init__(dataset.quads.where("g is not null").select("s", "p", "o"))
        self.quads = dataset.quads.where("g is not null")


def _tagged(g: Group, term: str) -> Group:
    """The group with every pattern in it, however deep, also binding the variable ``term`` to its graph."""
    def expr(e):
        if not isinstance(e, Expr):
            return e
        return Expr(e.op, [_tagged(e.args[0], term)] if e.op == "exists" else [expr(x) for x in e.args])

    def select(q: Query) -> Query:
        names = q.variables if q.variables is None or any(n == term[1:] for n, _ in q.variables) else [*q.variables, (term[1:], None)]
        counted = q.group_by or any(isinstance(e, Expr) and _has_aggregate(e) for _, e in q.variables or [])
        return dataclasses.replace(q, where=_tagged(q.where, term), variables=names, group_by=[*q.group_by, (term[1:], Expr("var", [term[1:]]))] if counted else q.group_by)

    out = []
    for e in g.elements:
        if e[0] == "bgp":
            e = ("tagged", e[1], term)
        elif e[0] in ("optional", "minus", "group"):
            e = (e[0], _tagged(e[1], term))
        elif e[0] == "union":
            e = ("union", [_tagged(x, term) for x in e[1]])
        elif e[0] == "filter":
            e = ("filter", expr(e[1]))
        elif e[0] == "select":
            e = ("select", select(e[1]))
        out.append(e)
    if not out or out[0][0] not in ("tagged", "union", "group", "select"):
        out.insert(0, ("named", term))  # nothing else binds the graph before the rest is joined
    return Group(out)


#: Between a graph's name and a node, where nodes of different graphs must not meet.
_IN = "\x01"


def _path_quads(quads: DataFrame, path: Path) -> DataFrame:
    """A path's relation within each graph: (g, s, o)."""
    within = lambda c: F.concat(F.col("g"), F.lit(_IN), F.col(c)).alias(c)
    found = paths.evaluate(Graph(quads.select(within("s"), "p", within("o"))), path)
    part = lambda c, i: F.split_part(F.col(c), F.lit(_IN), F.lit(i))
    return found.select(part("s", 1).alias("g"), part("s", 2).alias("s"), part("o", 2).alias("o"))


def _bind_quads(quads: DataFrame, patterns: list[tuple], graph_var: str) -> Solutions:
    out = None
    for s, p, o in patterns:
        columns, frame = {graph_var[1:]: F.col("g")}, quads
        if isinstance(p, Path):
            frame, places = _path_quads(quads, p), (("s", s), ("o", o))
        else:
            places = (("s", s), ("p", p), ("o", o))
        for place, t in places:
            if t.startswith("?"):
                if t[1:] in columns:
                    frame = frame.where(columns[t[1:]] == F.col(place))
                columns.setdefault(t[1:], F.col(place))
            else:
                frame = frame.where(F.col(place) == t)
        out = join(out, _solutions(frame.select(*[c.alias(v) for v, c in columns.items()])))
    return out


def _has_exists(e) -> bool:
    return isinstance(e, Expr) and (e.op == "exists" or any(map(_has_exists, e.args)))


def _pushed_in(e: Expr) -> Expr:
    """e with negations at its leaves, as far as EXISTS stands below them."""
    if e.op == "not" and _has_exists(e):
        a = e.args[0]
        if a.op == "not":
            return _pushed_in(a.args[0])
        if a.op in ("and", "or"):
            return Expr("or" if a.op == "and" else "and", [_pushed_in(Expr("not", [x])) for x in a.args])
        if a.op != "exists":
            raise ValueError("EXISTS below a function or comparison")
        return e
    if e.op in ("and", "or"):
        return Expr(e.op, [_pushed_in(x) for x in e.args])
    if e.op not in ("exists", "not") and _has_exists(e):
        raise ValueError("EXISTS below a function or comparison")
    return e


def _expr_vars(e) -> set[str]:
    if not isinstance(e, Expr):
        return _expr_vars(e.arg) if isinstance(e, Aggregate) and e.arg is not None else set()
    if e.op == "var":
        return {e.args[0]}
    return set().union(*map(_expr_vars, e.args)) if e.op != "exists" else set()


#: Functions of strings that have a value whenever their arguments have one.
_TOTAL = {"CONCAT", "STR", "UCASE", "LCASE", "MD5", "SHA1", "SHA256", "SHA512", "ENCODE_FOR_URI", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "BOUND", "IRI", "URI"}


def _nullable(e: Expr, s: Solutions) -> bool:
    """Whether e can lack a value: an unbound variable, or an error."""
    if e.op == "const":
        return False
    if e.op == "var":
        return e.args[0] not in s.variables or e.args[0] in s.maybe
    if e.op in ("+", "-", "*", "neg"):
        sure = lambda x: x.op == "var" and x.args[0] in s.numbers and x.args[0] not in s.maybe or x.op == "const" and constant(x.args[0]).numeric_const or x.op in ("+", "-", "*", "neg") and not _nullable(x, s)
        return not all(map(sure, e.args))
    if e.op == "call" and e.args[0] == "COALESCE":
        return all(_nullable(x, s) for x in e.args[1:])
    if e.op == "call" and e.args[0] in _TOTAL:
        return e.args[0] != "BOUND" and any(_nullable(x, s) for x in e.args[1:])
    return True


def _has_aggregate(e: Expr) -> bool:
    return e.op == "aggregate" or any(isinstance(x, Expr) and _has_aggregate(x) for x in e.args)


def _aggregate(a: Aggregate, compiler: Compiler, s: Solutions) -> tuple[Column, str]:
    if a.arg is None:
        if a.distinct:
            return F.count_distinct(F.struct(*[F.col(f"`{v}`") for v in s.variables])), "int"
        return F.count("*"), "int"
    v = compiler.expr(a.arg, s)
    if a.function == "COUNT":
        return (F.count_distinct(v.term) if a.distinct else F.count(v.term)), "int"
    if a.function == "SUM":
        return F.coalesce(F.sum_distinct(v.num) if a.distinct else F.sum(v.num), F.lit(0.0)), "num"
    if a.function == "AVG":
        mean = F.try_divide(F.sum_distinct(v.num), F.count_distinct(v.num)) if a.distinct else F.avg(v.num)
        return F.coalesce(mean, F.lit(0.0)), "num"
    if a.function in ("MIN", "MAX"):
        pick = F.min if a.function == "MIN" else F.max
        if v._num is not None:
            return pick(v.num), "num"
        # numbers if all are, else by text
        return F.when(F.count(v.num) == F.count(v.term), terms.decimal(pick(v.num))).otherwise(terms.plain(pick(v.text))), "term"
    if a.function == "SAMPLE":
        return F.min(v.term), "term"
    found = F.collect_set(v.text) if a.distinct else F.collect_list(v.text)
    return F.array_join(F.array_sort(found), a.separator), "text"
