"""The SPARQL algebra as dataclasses. Terms are canonical text, variables ``?name``."""

from __future__ import annotations

import dataclasses
from typing import Any


@dataclasses.dataclass(frozen=True)
class Path:
    """A property path: op is one of pred, inv, seq, alt, star, plus, opt, neg; args are paths or predicates."""

    op: str
    args: tuple[Any, ...]


@dataclasses.dataclass
class Expr:
    """An expression: op with arguments; ``var`` and ``const`` are leaves."""

    op: str
    args: list[Any]


@dataclasses.dataclass
class Aggregate:
    function: str
    arg: Expr | None
    distinct: bool = False
    separator: str = " "


@dataclasses.dataclass
class Group:
    """Elements in textual order: ("bgp", triples), ("filter", e), ("optional", g), ("union", [g..]), ("minus", g),
    ("bind", e, var), ("values", vars, rows), ("graph", term, g), ("service", term, g, silent), ("select", q), ("group", g)."""

    elements: list[tuple]


@dataclasses.dataclass
class Query:
    form: str
    where: Group
    variables: list[tuple[str, Any]] | None = None  # (name, None | Expr | Aggregate); None for *
    distinct: bool = False
    group_by: list[tuple[str | None, Expr]] = dataclasses.field(default_factory=list)
    having: list[Expr] = dataclasses.field(default_factory=list)
    order: list[tuple[Expr, bool]] = dataclasses.field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    template: list[tuple] = dataclasses.field(default_factory=list)
    resources: list[str] = dataclasses.field(default_factory=list)


@dataclasses.dataclass
class Update:
    """op: insert_data, delete_data, modify, clear, drop, create, load. Quads are (g | None, s, p, o)."""

    op: str
    delete: list[tuple] = dataclasses.field(default_factory=list)
    insert: list[tuple] = dataclasses.field(default_factory=list)
    where: Group | None = None
    graph: str | None = None
    target: str | None = None
    silent: bool = False
