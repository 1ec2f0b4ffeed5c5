"""Built-ins over quoted formulas: sets of triples written in a rule or parsed from a text."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.functions import terms
from graphloom.functions.builtins import NAMESPACES
from graphloom.sources import n3
from graphloom.sources.n3 import Formula, ListTerm, text_of


def _ground(t: tuple) -> bool:
    return not any(isinstance(x, str) and x.startswith("?") for x in t)


def _fits(pattern: tuple, t: tuple, binding: dict) -> dict | None:
    out = dict(binding)
    for p, x in zip(pattern, t, strict=True):
        if isinstance(p, str) and p.startswith("?"):
            if out.setdefault(p, x) != x:
                return None
        elif p != x:
            return None
    return out


def matches(f: Formula, pattern: Formula) -> list[dict]:
    """All joint bindings under which f has every triple of the pattern."""
    found: list[dict] = [{}]
    for p in pattern.triples:
        found = [b2 for b in found for t in f.triples if (b2 := _fits(p, t, b)) is not None]
    return found


def includes(f: Formula, pattern: Formula) -> bool:
    return bool(matches(f, pattern))


def not_includes(f: Formula, pattern: Formula) -> bool:
    return not includes(f, pattern)


def conjunction(formulas: list[Formula]) -> Formula:
    """All triples of the formulas, once each; also merge."""
    return Formula(tuple(dict.fromkeys(t for f in formulas for t in f.triples)))


def difference(a: Formula, b: Formula) -> Formula:
    return Formula(tuple(t for t in a.triples if t not in b.triples))


def intersection(a: Formula, b: Formula) -> Formula:
    return Formula(tuple(t for t in a.triples if t in b.triples))


def keep(f: Formula, pattern: Formula, fitting: bool = True) -> Formula:
    """The triples that fit a triple of the pattern (filter), or those that don't (reject)."""
    return Formula(tuple(t for t in f.triples if any(_fits(p, t, {}) is not None for p in pattern.triples) == fitting))


def for_all(f: Formula, pattern: Formula) -> bool:
    return all(any(_fits(p, t, {}) is not None for p in pattern.triples) for t in f.triples)


def triple_count(f: Formula) -> int:
    return len(f.triples)


def statements(f: Formula) -> ListTerm:
    return ListTerm(tuple(ListTerm(t) for t in f.triples))


def collect(template, pattern: Formula, scope: Formula) -> ListTerm:
    """The template under each binding of the pattern in the scope (findall)."""
    def put(t, b):
        if isinstance(t, ListTerm):
            return ListTerm(tuple(put(x, b) for x in t.items))
        return b.get(t, t) if isinstance(t, str) else t

    return ListTerm(tuple(put(template, b) for b in matches(scope, pattern)))


def copy(f: Formula, mark: str = "c") -> Formula:
    """The formula with fresh blank nodes."""
    fresh = lambda x: f"{x}{mark}" if isinstance(x, str) and x.startswith("_:") else x
    return Formula(tuple(tuple(map(fresh, t)) for t in f.triples))


def parsed(text: str) -> Formula:
    return Formula(tuple(n3.parse(text).triples))


def written(f: Formula) -> str:
    return "\n".join(f"{text_of(s)} {text_of(p)} {text_of(o)} ." for s, p, o in f.triples)


def conclusion(f: Formula) -> Formula:
    """The formula's ground triples with all its own rules conclude."""
    rules = [(s.triples, o.triples) for s, p, o in f.triples if p == n3.IMPLIES and isinstance(s, Formula) and isinstance(o, Formula)]
    known = dict.fromkeys(t for t in f.triples if _ground(t) and p_is_plain(t))
    while True:
        facts = Formula(tuple(known))
        new = [tuple(b.get(x, x) for x in t) for body, head in rules for b in matches(facts, Formula(body)) for t in head]
        new = [t for t in new if _ground(t) and t not in known]
        if not new:
            return facts
        known |= dict.fromkeys(new)


def p_is_plain(t: tuple) -> bool:
    return t[1] != n3.IMPLIES


def fetched(uri: str) -> Formula:
    """The document a URI names, read by Spark from wherever it reads, parsed by its ending."""
    from pyspark.sql import SparkSession

    from graphloom.sources.files import read_file

    rows = read_file(SparkSession.getActiveSession(), uri.removeprefix("<").removesuffix(">")).triples.collect()
    return Formula(tuple(sorted((r.s, r.p, r.o) for r in rows)))


def _fetched_or_error(uri: str):
    try:
        return fetched(uri)
    except Exception as e:
        return terms.literal(str(e).splitlines()[0])


def _of(n: int | None, *kinds) -> Callable:
    """Items of a list subject, if it has as many and of these kinds; None else."""
    def take(subject):
        if not isinstance(subject, ListTerm) or (n is not None and len(subject.items) != n):
            return None
        return subject.items if all(isinstance(x, k) for x, k in zip(subject.items, kinds, strict=False)) else None

    return take


_two, _three, _every = _of(2, Formula, Formula), _of(3), _of(None)


def _find(s, wrap: Callable = lambda template, x: x):
    """(template pattern scope), or (template scope): the template for each way the pattern is met."""
    if isinstance(s, Formula):
        return statements(s)
    items = _every(s)
    if items is None or len(items) not in (2, 3) or not all(isinstance(x, Formula) for x in items[1:]):
        return None
    found = collect(items[0], items[1], items[-1]) if len(items) == 3 else collect(items[0], Formula(tuple(t for t in items[1].triples if not _ground(t))), Formula(tuple(t for t in items[1].triples if _ground(t))))
    return ListTerm(tuple(wrap(items[0], x) for x in found.items))


def _truthy(t) -> bool:
    if isinstance(t, (Formula, ListTerm)):
        return bool(t.triples if isinstance(t, Formula) else t.items)
    return not t.startswith('"') or t[1 : t.rindex('"')] not in ("", "false", "0")


def _pair(make: Callable) -> Callable:
    return lambda s: None if (x := _two(s)) is None else make(*x)


def _whole(make: Callable) -> Callable:
    return lambda s: make(s) if isinstance(s, Formula) else None


def _all_formulas(s):
    items = _every(s)
    return conjunction(items) if items is not None and all(isinstance(x, Formula) for x in items) else None


_count = _whole(lambda f: terms.literal(len(f.triples)))
_SAME = n3.SAME_AS
#: Functions of what a rule's text spells out, by name: a value, or None while inputs are missing.
_VALUES = {
    "log": {
        "conjunction": _all_formulas, "merge": _all_formulas, "bulkIn": _all_formulas, "difference": _pair(difference), "intersection": _pair(intersection), "filter": _pair(keep),
        "reject": _pair(lambda a, b: keep(a, b, False)), "tripleCount": _count, "n3String": _whole(lambda f: terms.literal(written(f))), "copy": _whole(copy), "conclusion": _whole(conclusion), "getList": _whole(statements),
        "parsedAsN3": lambda s: parsed(terms.unescape(s[1 : s.rindex('"')])) if isinstance(s, str) and s.startswith('"') else None,
        "findall": _find, "collectAllIn": lambda s: _find(s, lambda template, x: Formula(((template, _SAME, x),))),
        "term": lambda s: s if _three(s) else None, "becomes": lambda s: s if isinstance(s, ListTerm) and len(s.items) == 2 else None,
        "ifThenElseIn": lambda s: None if (x := _three(s)) is None or (isinstance(x[0], str) and x[0].startswith("?")) else x[1] if _truthy(x[0]) else x[2],
        "semantics": lambda s: fetched(s) if isinstance(s, str) and s.startswith("<") else None, "semanticsOrError": lambda s: _fetched_or_error(s) if isinstance(s, str) and s.startswith("<") else None,
    },
    "graph": {
        "difference": _pair(difference), "intersection": _pair(intersection), "union": _pair(lambda a, b: conjunction([a, b])), "length": _count,
        "member": _whole(lambda f: ListTerm(f.triples[0]) if f.triples else None),
    },
}


def _text(t) -> str | None:
    return terms.unescape(t[1 : t.rindex('"')]) if isinstance(t, str) and t.startswith('"') else None


def _table(rows: list[tuple]) -> ListTerm:
    return ListTerm(tuple(ListTerm(tuple(terms.literal("" if x is None else x) for x in r)) for r in rows))


def _db(ask: Callable, n: int) -> Callable:
    """A question to a database file: (handle text ..), or the handle alone. Files are opened for reading only; what
    would change one is refused in rules."""
    def run(subject):
        from graphloom.sources import sqlite

        items = [subject] if n == 1 else list(subject.items) if isinstance(subject, ListTerm) and len(subject.items) == n else [None]
        texts = [_text(x) for x in items]
        return None if any(x is None for x in texts) else ask(sqlite, *texts)

    return run


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_VALUES["db"] = {
    "connect": _db(lambda db, path: terms.literal(path) if db.rows(path, "select 1") else None, 1),
    "query": _db(lambda db, path, text: _table(db.rows(path, text)), 2),
    "tables": _db(lambda db, path: ListTerm(tuple(terms.literal(r[0]) for r in db.rows(path, "select name from sqlite_master where type = 'table' order by name"))), 1),
    "columns": _db(lambda db, path, table: ListTerm(tuple(terms.literal(r[0]) for r in db.rows(path, "select name from pragma_table_info(?) order by cid", (table,)))), 2),
    "selectWhere": _db(lambda db, path, table, test: _table(db.rows(path, f"select * from {_quoted(table)} where {test}")), 3),
}
#: Tests of the same.
_TESTS = {
    "log": {
        "forAllIn": _pair(for_all), "forAllInClosure": _pair(lambda f, p: for_all(conclusion(f), p)), "implies": lambda s: _two(s) is not None, "supports": lambda s: isinstance(s, ListTerm) and len(s.items) == 2,
        "N3Document": lambda s: isinstance(s, Formula), "builtinIn": lambda s: isinstance(s, str) and any(s.startswith(f"<{NAMESPACES[n]}") for n in NAMESPACES if n != "db"),
    },
    "db": {"close": lambda s: _text(s) is not None},
}
EVALUATED = {f"<{NAMESPACES[n]}{name}>": (True, f) for n, fs in _VALUES.items() for name, f in fs.items()} | {f"<{NAMESPACES[n]}{name}>": (False, f) for n, fs in _TESTS.items() for name, f in fs.items()}


def _put(t, env: dict):
    """A term with what is known put in; variables inside formulas are their own."""
    if isinstance(t, ListTerm):
        return ListTerm(tuple(_put(x, env) for x in t.items))
    return env.get(t, t) if isinstance(t, str) else t


def simplified(rule: n3.Rule) -> n3.Rule | None:
    """The rule with its built-ins over formulas carried out, as far as its text has their inputs: none of them needs
    facts. None if one of them says that the rule never holds."""
    if not any(a[1] in EVALUATED for a in rule.body):
        return rule
    env: dict = {}
    waiting, progress = list(rule.body), True
    while progress:
        progress = False
        for a in list(waiting):
            if a[1] not in EVALUATED:
                continue
            is_value, f = EVALUATED[a[1]]
            subject, obj = _put(a[0], env), _put(a[2], env)
            if isinstance(subject, str) and subject.startswith("?"):
                continue
            found = f(subject)
            if found is None and is_value:
                continue
            if not is_value:
                if not found:
                    return None
            elif isinstance(obj, str) and obj.startswith("?"):
                env[obj] = found
            elif text_of(obj) != text_of(found):
                return None
            waiting.remove(a)
            progress = True
    if any(a[1] in EVALUATED for a in waiting):
        raise ValueError(f"inputs of {[a[1] for a in waiting if a[1] in EVALUATED]} are not written in the rule")
    from graphloom.functions.builtins import is_builtin

    def plain(t, spread: bool):
        t = _put(t, env)
        return t if spread or isinstance(t, str) else text_of(t)

    body = tuple(tuple(plain(x, is_builtin(a[1]) or any(isinstance(y, (ListTerm, Formula)) for y in a)) for x in a) for a in waiting)
    return n3.Rule(body, tuple(tuple(plain(x, False) for x in t) for t in rule.head), rule.name)
