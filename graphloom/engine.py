"""The facade: a graph or dataset with SPARQL, updates, rules and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.plans import sparql
from graphloom.plans.compile import Compiler, instantiate
from graphloom.sources.graphs import Dataset, Graph, union


class Engine:
    """Queries over one graph or dataset; ``prefixes`` hold for all texts."""

    def __init__(self, data: Graph | Dataset, prefixes: dict[str, str] | None = None, service: Callable | None = None):
        self.data, self.prefixes, self.service = data, prefixes or {}, service

    def sparql(self, text: str) -> DataFrame:
        """SELECT: a column of canonical terms for each variable; ASK: one boolean; CONSTRUCT, DESCRIBE: s, p, o."""
        return Compiler(self.data, self.service).run(sparql.parse(text, self.prefixes))

    def native(self, text: str, types: dict[str, str]) -> DataFrame:
        """A SELECT with lexical values cast to Spark types; numbers come straight from their columns where known."""
        s = Compiler(self.data, self.service).select(sparql.parse(text, self.prefixes))
        def column(v: str, kind: str):
            if kind != "string" and v in s.numbers:
                return F.col(s.numbers[v]).cast(kind)
            text_value = terms.value(F.col(f"`{v}`"))
            return (text_value if kind == "string" else text_value.try_cast(kind))
        return s.frame.select(*[column(v, types.get(v, "string")).alias(v) for v in s.variables])

    def update(self, text: str) -> Engine:
        """The engine after the updates, in order; data is immutable, so the old engine still answers as before."""
        data = self.data if isinstance(self.data, Dataset) else Dataset(self.data.triples.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))
        rows = lambda quads: data.spark.createDataFrame(quads, "g string, s string, p string, o string")
        for u in sparql.parse_update(text, self.prefixes):
            if u.op == "insert_data":
                data = data.insert(rows(u.insert))
            elif u.op == "delete_data":
                data = data.delete(rows(u.delete))
            elif u.op == "modify":
                compiler = Compiler(data, self.service)
                s = compiler.group(u.where, data.graph(u.graph) if u.graph else data.default())
                scoped = lambda quads, u=u: [(q[0] or u.graph, *q[1:]) for q in quads]
                removed = instantiate(s, scoped(u.delete)) if u.delete else None
                added = instantiate(s, scoped(u.insert)) if u.insert else None
                data = data.delete(removed) if removed is not None else data
                data = data.insert(added) if added is not None else data
            elif u.op in ("clear", "drop"):
                known = u.target in ("DEFAULT", "NAMED", "ALL") or u.silent or not data.graph_names().where(F.col("g") == u.target).isEmpty()
                if not known and u.op == "drop":
                    raise ValueError(f"no graph {u.target}")
                data = data.clear(u.target) if u.op == "clear" else data.drop(u.target)
            elif u.op == "create":
                data = data.create(u.target)
            elif u.op == "load":
                from graphloom.sources.files import read_file

                try:
                    found = read_file(data.spark, u.target[1:-1]).triples
                    data = data.insert(found.select(F.lit(u.graph).cast("string").alias("g"), "s", "p", "o"))
                except Exception:
                    if not u.silent:
                        raise
        named = any(u.graph or any(q[0] for q in u.insert) for u in sparql.parse_update(text, self.prefixes))
        return Engine(data if isinstance(self.data, Dataset) or named else data.default(), self.prefixes, self.service)

    def closure(self, path_text: str) -> DataFrame:
        return self.sparql(f"SELECT ?s ?o WHERE {{ ?s ({path_text})+ ?o }}")


__all__ = ["Dataset", "Engine", "Graph", "union"]
