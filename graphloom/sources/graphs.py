"""Graphs: what answers triple patterns. Stored triples, quads, and relational tables seen as triples."""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms

TRIPLE = "s string, p string, o string"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Graph:
    """Stored triples: a DataFrame of s, p and o in canonical text, as a set. ``basis``: of a graph that rules of
    transitivity made, what it was made from and the rules."""

    basis: tuple[Graph, tuple] | None = None

    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o")
        self.spark: SparkSession = triples.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple[str, str, str]]) -> Graph:
        return cls(spark.createDataFrame(rows, TRIPLE).distinct())

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """The triples that have the given terms; the filters reach a Parquet scan."""
        out = self.triples
        for name, term in (("s", s), ("p", p), ("o", o)):
            if term is not None:
                out = out.where(F.col(name) == term)
        return out

    # set primitives
    def insert(self, more: DataFrame) -> Graph:
        return Graph(self.triples.unionByName(more.select("s", "p", "o")).distinct())

    def delete(self, less: DataFrame) -> Graph:
        return Graph(self.triples.join(less.select("s", "p", "o"), ["s", "p", "o"], "left_anti"))

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.scan(s, p, o).isEmpty()

    def match(self, s: str, p: str, o: str) -> DataFrame:
        """Bindings of one pattern whose variables start with ``?``; a repeated variable must agree."""
        return bind(self, s, p, o)

    def query(self, patterns: list[tuple[str, str, str]]) -> DataFrame:
        """A conjunctive query: patterns joined on their shared variables."""
        from graphloom.plans.compile import basic

        return basic(self, patterns).frame

    def partitioned(self, strategy: str = "subject", partitions: int | None = None) -> Graph:
        """The same triples dealt by subject, by predicate or in ranges of subjects."""
        n = [partitions] if partitions else []
        t = self.triples
        return Graph({"subject": lambda: t.repartition(*n, "s"), "predicate": lambda: t.repartition(*n, "p"), "range": lambda: t.repartitionByRange(*n, "s")}[strategy]())

    def save(self, path: str, mode: str = "overwrite") -> None:
        """As Parquet, sorted by predicate and subject within files so that statistics prune scans."""
        self.triples.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.parquet(path))


@dataclasses.dataclass(frozen=True)
class TableMap:
    """A table seen as triples: key columns, class, and each column's kind.

    Kinds: string, integer, double, dateTime, or ``table`` names with a leading ``>`` for foreign keys.
    """

    name: str
    key: tuple[str, ...]
    columns: dict[str, str]

    def subject(self) -> Column:
        return F.concat(F.lit(f"<t:{self.name}/"), F.concat_ws("/", *[F.col(k).cast("string") for k in self.key]), F.lit(">"))

    @property
    def type_iri(self) -> str:
        return f"<t:{self.name}>"

    def object(self, column: str) -> Column:
        how, c = self.columns[column], F.col(column)
        if how.startswith(">"):
            return F.concat(F.lit(f"<t:{how[1:]}/"), c.cast("string"), F.lit(">"))
        if how == "string":
            return terms.plain(c)
        if how == "dateTime":
            return terms.typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), f"{terms.XSD}dateTime")
        return terms.typed(c, f"{terms.XSD}{how}")

    def key_column(self) -> Column | None:
        """The key as a number, where one column is."""
        return F.col(self.key[0]).cast("bigint") if len(self.key) == 1 else None

    def has_subject(self, term: str) -> Column:
        """Whether a row is the one the term names: a test on the key columns, which reaches the scan."""
        return _keys(term, self.name, [F.col(k) for k in self.key])

    def has_object(self, column: str, term: str) -> Column:
        """Whether a column's value is the term, tested on the column itself where the term tells its value."""
        how, c = self.columns[column], F.col(column)
        if how.startswith(">"):
            return _keys(term, how[1:], [c])
        if how == "string":
            return c == terms.unescape(term[1:-1]) if term.startswith('"') and term.endswith('"') else F.lit(False)
        if how == "integer" and term.endswith(f'"^^<{terms.XSD_INTEGER}>') and re.fullmatch(r"-?\d{1,18}", term[1 : term.rindex('"')]):
            return (c == int(term[1 : term.rindex('"')])) & (self.object(column) == term)
        return self.object(column) == term

    def native(self, column: str) -> Column | None:
        return F.col(column).cast("double") if self.columns[column] in ("integer", "double") else None


def _keys(term: str, table: str, columns: list[Column]) -> Column:
    """A term ``<t:table/1/2>`` as a test on its key columns; false for any other term."""
    parts = term[len(table) + 4 : -1].split("/") if term.startswith(f"<t:{table}/") else []
    if len(parts) != len(columns) or not all(re.fullmatch(r"0|-?[1-9]\d{0,17}", p) for p in parts):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [c == int(p) for c, p in zip(columns, parts, strict=True)])


#: The supplied relational tables as triples.
TABLES = [
    TableMap("region", ("r_regionkey",), {"r_name": "string"}),
    TableMap("nation", ("n_nationkey",), {"n_name": "string", "n_regionkey": ">region"}),
    TableMap("customer", ("c_custkey",), {"c_name": "string", "c_nationkey": ">nation", "c_acctbal": "double", "c_mktsegment": "string"}),
    TableMap("supplier", ("s_suppkey",), {"s_name": "string", "s_nationkey": ">nation", "s_acctbal": "double"}),
    TableMap("part", ("p_partkey",), {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"}),
    TableMap("orders", ("o_orderkey",), {"o_custkey": ">customer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "dateTime", "o_orderpriority": "string"}),
    TableMap("lineitem", ("l_orderkey", "l_linenumber"), {"l_orderkey": ">orders", "l_partkey": ">part", "l_suppkey": ">supplier", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "dateTime"}),
    TableMap("events", ("event_id",), {"ts": "dateTime", "user_id": ">user", "event_type": "string", "value": "double"}),
    TableMap("pages", ("page_id",), {"url": "string"}),
]


class TableGraph(Graph):
    """Relational tables as a virtual graph. A pattern with a known predicate reads one column of one table; patterns
    about one subject read their columns in one scan."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[TableMap] | None = None):
        self.spark, self.folder = spark, folder
        self.maps = {m.name: m for m in (TABLES if tables is None else tables)}
        self.owner = {f"<t:{c}>": (m, c) for m in self.maps.values() for c in m.columns}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def triples(self) -> DataFrame:
        return union([self._exploded(m) for m in self.maps.values()])

    def _exploded(self, m: TableMap, s: str | None = None) -> DataFrame:
        pairs = [F.struct(F.lit(terms.TYPE).alias("p"), F.lit(m.type_iri).alias("o"))] + [F.struct(F.lit(f"<t:{c}>").alias("p"), m.object(c).alias("o")) for c in m.columns]
        rows = self.table(m.name)
        rows = rows.where(m.has_subject(s)) if s is not None else rows
        return rows.select(m.subject().alias("s"), F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o").where("o is not null")

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """A known subject names its table and key, a known object the value of a column: both reach the scan."""
        maps = [m for m in self.maps.values() if s is None or s.startswith(f"<t:{m.name}/")]
        frames = []
        if p == terms.TYPE:
            for m in maps:
                if o in (None, m.type_iri):
                    rows = self.table(m.name)
                    frames.append((rows.where(m.has_subject(s)) if s is not None else rows).select(m.subject().alias("s"), F.lit(p).alias("p"), F.lit(m.type_iri).alias("o")))
        elif p is not None:
            if p in self.owner and self.owner[p][0] in maps:
                m, c = self.owner[p]
                rows = self.table(m.name).where(F.col(c).isNotNull())
                rows = rows.where(m.has_subject(s)) if s is not None else rows
                rows = rows.where(m.has_object(c, o)) if o is not None else rows
                frames = [rows.select(m.subject().alias("s"), F.lit(p).alias("p"), m.object(c).alias("o"))]
        else:
            frames = [self._exploded(m, s) if o is None else self._exploded(m, s).where(F.col("o") == o) for m in maps]
        return union(frames) if frames else self.spark.createDataFrame([], TRIPLE)

    def star(self, subject: str, pairs: list[tuple[str, str]]) -> tuple[DataFrame, dict[str, str], dict[str, tuple[str, str]]] | None:
        """One scan for patterns (subject, predicate, object) about one variable in one table: its bindings, which
        hidden column holds the number of a variable, and which the native key, of which table. None if the table can't
        answer them at once."""
        found = {self.owner[p][0].name for p, _ in pairs if p in self.owner} | {o[3:-1] for p, o in pairs if p == terms.TYPE and o[3:-1] in self.maps}
        if len(found) != 1 or any(p != terms.TYPE and p not in self.owner or p == terms.TYPE and o.startswith("?") for p, o in pairs):
            return None
        m = self.maps[found.pop()]
        frame, columns, numbers = self.table(m.name), {subject[1:]: m.subject()}, {}
        keys = {subject[1:]: (m.name, m.key_column())} if m.key_column() is not None else {}
        for p, o in pairs:
            if p == terms.TYPE:
                continue
            c = self.owner[p][1]
            frame = frame.where(F.col(c).isNotNull())
            if not o.startswith("?"):
                frame = frame.where(m.has_object(c, o))
            elif o[1:] in columns:
                frame = frame.where(columns[o[1:]] == m.object(c))
            else:
                columns[o[1:]] = m.object(c)
                if m.native(c) is not None:
                    numbers[o[1:]] = c
                if m.columns[c].startswith(">"):
                    keys[o[1:]] = m.columns[c][1:], F.col(c).cast("bigint")
        hidden = [m.native(c).alias(f"__n_{v}") for v, c in numbers.items()] + [k.alias(f"__k_{v}") for v, (_, k) in keys.items()]
        return frame.select(*[c.alias(v) for v, c in columns.items()], *hidden), {v: f"__n_{v}" for v in numbers}, {v: (t, f"__k_{v}") for v, (t, _) in keys.items()}


def bind(graph: Graph, s: str, p: str, o: str) -> DataFrame:
    """A pattern's bindings as columns named by its variables."""
    fixed = [None if t.startswith("?") else t for t in (s, p, o)]
    out, columns = graph.scan(*fixed), {}
    for place, t in zip("spo", (s, p, o), strict=True):
        if t.startswith("?"):
            if t[1:] in columns:
                out = out.where(columns[t[1:]] == F.col(place))
            columns.setdefault(t[1:], F.col(place))
    return out.select(*[c.alias(v) for v, c in columns.items()]) if columns else out.select(F.lit(1).alias("__match")).limit(1)


class Dataset:
    """Quads (g, s, p, o); g is null in the default graph. Empty named graphs are kept by name."""

    def __init__(self, quads: DataFrame, names: frozenset[str] = frozenset()):
        self.quads, self.names = quads.select("g", "s", "p", "o"), names
        self.spark = quads.sparkSession

    def default(self) -> Graph:
        return Graph(self.quads.where("g is null"))

    def graph(self, name: str) -> Graph:
        return Graph(self.quads.where(F.col("g") == name))

    def graph_names(self) -> DataFrame:
        found = self.quads.where("g is not null").select("g")
        return found.union(self.spark.createDataFrame([(n,) for n in self.names], "g string")).distinct()

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None, any_graph: bool = False) -> DataFrame:
        out = self.quads if any_graph else self.quads.where(F.col("g").eqNullSafe(F.lit(g)))
        for name, term in (("s", s), ("p", p), ("o", o)):
            if term is not None:
                out = out.where(F.col(name) == term)
        return out

    def insert(self, quads: DataFrame) -> Dataset:
        return Dataset(self.quads.unionByName(quads.select("g", "s", "p", "o")).distinct(), self.names)

    def delete(self, quads: DataFrame) -> Dataset:
        less = quads.select(*[F.col(c).alias(f"d{c}") for c in "gspo"])
        return Dataset(self.quads.join(less, (F.col("g").eqNullSafe(F.col("dg"))) & (F.col("s") == F.col("ds")) & (F.col("p") == F.col("dp")) & (F.col("o") == F.col("do")), "left_anti"), self.names)

    def merge(self, other: Dataset) -> Dataset:
        return Dataset(self.quads.unionByName(other.quads).distinct(), self.names | other.names)

    def clear(self, target: str) -> Dataset:
        """target: DEFAULT, NAMED, ALL or a graph's name. The names stay known."""
        keep = {"DEFAULT": F.col("g").isNotNull(), "NAMED": F.col("g").isNull(), "ALL": F.lit(False)}.get(target, ~F.col("g").eqNullSafe(F.lit(target)))
        return Dataset(self.quads.where(keep), self.names)

    def drop(self, target: str) -> Dataset:
        names = frozenset() if target in ("NAMED", "ALL") else self.names - {target}
        return Dataset(self.clear(target).quads, names)

    def create(self, name: str) -> Dataset:
        return Dataset(self.quads, self.names | {name})
