"""Whole-graph transforms: difference, patch, reification, formulas, blank nodes, equality, IRIs, filters, versions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.builtins import NAMESPACES
from graphloom.operators.lineage import cut
from graphloom.operators.paths import closure
from graphloom.sources.graphs import Graph, union

STATEMENT, SUBJECT, PREDICATE, OBJECT = (f"<{terms.RDF}{n}>" for n in ("Statement", "subject", "predicate", "object"))
INCLUDES = f"<{terms.LOG}includes>"
SPO = ["s", "p", "o"]


def diff(before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:
    """(added, removed)."""
    return after.triples.join(before.triples, SPO, "left_anti"), before.triples.join(after.triples, SPO, "left_anti")


def patch(graph: Graph, deletions: DataFrame, insertions: DataFrame) -> Graph:
    return graph.delete(deletions).insert(insertions)


def purge_rules(t: DataFrame) -> DataFrame:
    return t.where(~F.col("p").isin(f"<{terms.LOG}implies>", f"<{terms.LOG}impliedBy>"))


def purge_builtins(t: DataFrame) -> DataFrame:
    """Without triples whose predicate is a built-in."""
    out = t
    for name, base in NAMESPACES.items():
        if name != "db":
            out = out.where(~F.col("p").startswith(f"<{base}"))
    return out


def purge_chaff(t: DataFrame) -> DataFrame:
    """Without the triples about members of log:Chaff."""
    chaff = t.where((F.col("p") == terms.TYPE) & (F.col("o") == f"<{terms.LOG}Chaff>")).select("s")
    return t.join(chaff, "s", "left_anti")


def truth_filter(t: DataFrame) -> DataFrame:
    """Without the triples about members of log:Falsehood and about what notIncludes names."""
    false = t.where((F.col("p") == terms.TYPE) & (F.col("o") == f"<{terms.LOG}Falsehood>")).select("s")
    named = t.where(F.col("p") == f"<{terms.LOG}notIncludes>").select(F.col("o").alias("s"))
    return t.join(false.union(named), "s", "left_anti")


def reify(t: DataFrame) -> DataFrame:
    """Four triples for each statement; its node follows from its text, so a rerun names it alike."""
    node = F.concat(F.lit("_:st"), F.md5(F.concat_ws(" ", "s", "p", "o").cast("binary")))
    rows = [(terms.TYPE, F.lit(STATEMENT)), (SUBJECT, F.col("s")), (PREDICATE, F.col("p")), (OBJECT, F.col("o"))]
    return t.select(node.alias("n"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in rows])).alias("x")).select(F.col("n").alias("s"), "x.p", "x.o")


def dereify(t: DataFrame) -> DataFrame:
    """Complete statements as triples again; all else stays."""
    part = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    found = t.where(F.col("p").isin(SUBJECT, PREDICATE, OBJECT)).groupBy("s").agg(part(SUBJECT).alias("rs"), part(PREDICATE).alias("rp"), part(OBJECT).alias("ro")).where("rs is not null and rp is not null and ro is not null")
    own = F.col("p").isin(SUBJECT, PREDICATE, OBJECT) | ((F.col("p") == terms.TYPE) & (F.col("o") == STATEMENT))
    rest = t.where(~own).unionByName(t.where(own).join(found.select("s"), "s", "left_anti"))
    return rest.unionByName(found.select(F.col("rs").alias("s"), F.col("rp").alias("p"), F.col("ro").alias("o"))).distinct()


def flatten(t: DataFrame, formulas: DataFrame) -> DataFrame:
    """The main graph and the contents of its formulas (formula, s, p, o)."""
    return t.unionByName(formulas.select(*SPO)).distinct()


def unflatten(t: DataFrame) -> DataFrame:
    """Statements that log:includes collects, by formula: (formula, triples)."""
    members = t.where(F.col("p") == INCLUDES).select(F.col("s").alias("formula"), F.col("o").alias("node"))
    part = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    statements = t.where(F.col("p").isin(SUBJECT, PREDICATE, OBJECT)).groupBy(F.col("s").alias("node")).agg(part(SUBJECT).alias("s"), part(PREDICATE).alias("p"), part(OBJECT).alias("o"))
    return members.join(statements, "node").groupBy("formula").agg(F.sort_array(F.collect_list(F.struct("s", "p", "o"))).alias("triples"))


def skolemise(t: DataFrame, base: str = "urn:skolem:") -> DataFrame:
    """Blank nodes as IRIs."""
    named = lambda c: F.when(terms.is_blank(F.col(c)), F.concat(F.lit(f"<{base}"), F.substring(c, F.lit(3), F.length(c)), F.lit(">"))).otherwise(F.col(c)).alias(c)
    return t.select(named("s"), "p", named("o"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node each can reach over the pairs (s, o), by alternating large and small stars."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u").where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (moved if large else moved.union(least.select("u", F.col("m").alias("v")))).where("u <> v").distinct()

    edges, before = cut(pairs.select(F.col("s").alias("u"), F.col("o").alias("v")).where("u <> v").distinct()), None
    while True:
        edges = cut(star(star(edges, True), False))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    found = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return found.union(found.select(F.col("label").alias("node"), "label").distinct())


def smush(t: DataFrame) -> DataFrame:
    """Nodes that owl:sameAs links replaced by the least of them."""
    same = components(t.where(F.col("p") == f"<{terms.OWL}sameAs>"))
    out = t
    for c in ("s", "o"):
        out = out.join(same.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left").select(*[F.coalesce(f"{c}_label", c).alias(c) if x == c else F.col(x) for x in SPO])
    return out.where((F.col("p") != f"<{terms.OWL}sameAs>") | (F.col("s") != F.col("o"))).distinct()


def component_counts(t: DataFrame, position: str) -> DataFrame:
    return t.groupBy(position).agg(F.count("*").alias("n"))


def transitive_properties(t: DataFrame) -> DataFrame:
    """What the closure of each owl:TransitiveProperty adds."""
    kinds = [r[0] for r in t.where((F.col("p") == terms.TYPE) & (F.col("o") == f"<{terms.OWL}TransitiveProperty>")).select("s").distinct().collect()]  # schema
    made = [closure(t.where(F.col("p") == k)).select("s", F.lit(k).alias("p"), "o") for k in kinds]
    return union(made).join(t, SPO, "left_anti") if made else t.limit(0)


def normalise_iris(t: DataFrame) -> DataFrame:
    """Scheme and host in lower case, without default ports and empty queries or fragments."""
    def clean(c: str):
        x = F.col(c)
        parts = [F.regexp_extract(x, r"^<([A-Za-z][A-Za-z0-9+.-]*)://([^/?#>]*)([^>]*)>$", i) for i in (1, 2, 3)]
        scheme, host = F.lower(parts[0]), F.lower(parts[1])
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        return F.when(parts[0] != "", F.concat(F.lit("<"), scheme, F.lit("://"), host, F.regexp_replace(parts[2], r"[?#]+$", ""), F.lit(">"))).otherwise(x).alias(c)

    return t.select(*map(clean, SPO)).distinct()


def schema_rules(graph: Graph):
    """subClassOf, subPropertyOf, domain and range triples as rules; the schema is collected."""
    from graphloom.sources.n3 import Rule

    shapes = {"subClassOf": lambda a, b: ((("?x", terms.TYPE, a),), (("?x", terms.TYPE, b),)), "subPropertyOf": lambda a, b: ((("?x", a, "?y"),), (("?x", b, "?y"),)),
              "domain": lambda a, b: ((("?x", a, "?y"),), (("?x", terms.TYPE, b),)), "range": lambda a, b: ((("?x", a, "?y"),), (("?y", terms.TYPE, b),))}
    out = []
    for name, shape in shapes.items():
        for r in graph.scan(p=f"<{terms.RDFS}{name}>").orderBy("s", "o").collect():
            out.append(Rule(*shape(r.s, r.o), f"{name}{len(out)}"))
    return out


def migrate(t: DataFrame, renamed: dict[str, str], removed: tuple[str, ...] = ()) -> DataFrame:
    """The triples after a migration: classes and properties under new names, others gone with what they are used in."""
    gone = F.col("p").isin(*removed) | F.col("o").isin(*removed) | F.col("s").isin(*removed) if removed else F.lit(False)
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]) if renamed else None
    new = lambda c: F.coalesce(names[F.col(c)], F.col(c)).alias(c) if renamed else F.col(c)
    return t.where(~gone).select(*map(new, SPO)).distinct()


def near_partitions(t: DataFrame, partitions: int, rounds: int = 3) -> DataFrame:
    """(node, part): nodes dealt so that neighbours tend to lie together: each takes the part most of its neighbours
    have, in a few rounds from a hash, ties to the smallest part. Counts by part, not lists, so hubs don't gather."""
    edges = t.where(F.col("o").startswith("<")).select("s", "o")
    both = cut(edges.union(edges.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct())
    parts = cut(both.select(F.col("s").alias("node")).distinct().withColumn("part", F.pmod(F.xxhash64("node"), F.lit(partitions)).cast("int")))
    for _ in range(rounds):
        votes = both.join(parts.withColumnRenamed("node", "o"), "o").groupBy(F.col("s").alias("node"), "part").agg(F.count("*").alias("n"))
        parts = cut(votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("part")).alias("m"))).alias("b")).select("node", (-F.col("b.m")).alias("part")))
    return parts


@dataclasses.dataclass(frozen=True, order=True)
class Version:
    major: int
    minor: int
    patch: int

    @classmethod
    def of(cls, text: str) -> Version:
        return cls(*map(int, text.split(".")))

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"

    def bump(self, added: int, removed: int, breaking: int) -> Version:
        """Breaking changes: major; additions: minor; other removals: patch; none: the same."""
        if breaking:
            return Version(self.major + 1, 0, 0)
        if added:
            return Version(self.major, self.minor + 1, 0)
        return Version(self.major, self.minor, self.patch + 1) if removed else self


class Versions:
    """Snapshots of a graph, one Parquet folder for each version."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, graph: Graph, version: str) -> Version:
        graph.triples.write.mode("errorifexists").parquet(f"{self.folder}/{version}")
        return Version.of(version)

    def checkout(self, version: str) -> Graph:
        return Graph.load(self.spark, f"{self.folder}/{version}")

    def diff(self, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        return diff(self.checkout(a), self.checkout(b))

    def suggest(self, a: str, b: str) -> Version:
        """The next version for b's changes since a; a class or property that is gone breaks."""
        added, removed = self.diff(a, b)
        schema = F.col("o").isin(f"<{terms.RDFS}Class>", f"<{terms.OWL}Class>", f"<{terms.RDF}Property>") & (F.col("p") == terms.TYPE)
        return Version.of(a).bump(added.count(), removed.count(), removed.where(schema).count())
