"""Registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import builtins, terms
from graphloom.operators import fixpoint, paths, reasoning, rulesets, transforms
from graphloom.plans.expressions import Val, constant
from graphloom.sources.graphs import TABLES, Dataset, Graph, TableGraph, union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PREFIXES = {"t": "t:"}
TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def graph(spark: SparkSession, sf_dir: str) -> TableGraph:
    return TableGraph(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def sparql(name: str, text: str, types: dict[str, str], sql: str, rounded: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(graph(spark, sf_dir), PREFIXES).native(text, types)
        return out.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else out

    query(name, sql)(run)


sparql("bgp_star", "SELECT ?name ?bal WHERE { ?c a t:customer ; t:c_name ?name ; t:c_acctbal ?bal . FILTER(?bal > 27) }", {"bal": "double"},
       "select c_name as name, c_acctbal as bal from customer where c_acctbal > 27")
sparql("bgp_chain_3way", "SELECT ?o ?seg ?nation WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?p . ?c t:c_mktsegment ?seg ; t:c_nationkey ?n . ?n t:n_name ?nation FILTER(?p > 100000) }", {},
       "select 't:orders/' || o_orderkey as o, c_mktsegment as seg, n_name as nation from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 100000")
sparql("filter_num", "SELECT ?p ?price WHERE { ?p t:p_retailprice ?price ; t:p_size ?s . FILTER(?price >= 950 && (?s < 10 || ?s = 25) && !(?s = 3)) }", {"price": "double"},
       "select 't:part/' || p_partkey as p, p_retailprice as price from part where p_retailprice >= 950 and (p_size < 10 or p_size = 25) and not p_size = 3")
sparql("filter_regex", "SELECT ?n WHERE { ?p t:p_type ?n FILTER(REGEX(?n, 'brass$', 'i') || STRSTARTS(?n, 'PROMO') || CONTAINS(?n, 'TIN')) }", {},
       "select p_type as n from part where regexp_matches(lower(p_type), 'brass$') or starts_with(p_type, 'PROMO') or contains(p_type, 'TIN')")
sparql("optional_left", "SELECT ?name ?o WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 150000) } }", {},
       "select c_name as name, 't:orders/' || o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_totalprice > 150000")
sparql("union_bag", "SELECT ?n WHERE { { ?x t:c_nationkey ?n } UNION { ?x t:s_nationkey ?n } }", {},
       "select 't:nation/' || c_nationkey as n from customer union all select 't:nation/' || s_nationkey from supplier")
sparql("minus_anti", "SELECT ?c WHERE { ?c a t:customer MINUS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 400000) } }", {},
       "select 't:customer/' || c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
sparql("not_exists", "SELECT ?c WHERE { ?c a t:customer FILTER NOT EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 400000) } }", {},
       "select 't:customer/' || c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
sparql("values_inline", "SELECT ?r ?n WHERE { VALUES ?r { 'ASIA' 'EUROPE' } ?x t:r_name ?r . ?y t:n_regionkey ?x ; t:n_name ?n }", {},
       "select r_name as r, n_name as n from region join nation on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')")
sparql("bind_expr", "SELECT ?p ?taxed ?label WHERE { ?p t:p_retailprice ?x ; t:p_brand ?b BIND(?x * 1.5 + 1 AS ?taxed) BIND(CONCAT(LCASE(?b), '-', STR(?b)) AS ?label) }", {"taxed": "double"},
       "select 't:part/' || p_partkey as p, round(p_retailprice * 1.5 + 1, 2) as taxed, lower(p_brand) || '-' || p_brand as label from part", ("taxed",))
sparql("subselect_agg", "SELECT ?name ?n WHERE { ?c t:c_name ?name { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o t:o_custkey ?c } GROUP BY ?c } FILTER(?n > 12) }", {"n": "bigint"},
       "select c_name as name, count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey, c_name having count(*) > 12")
sparql("agg_count_sum_avg", "SELECT ?seg (COUNT(?c) AS ?n) (SUM(?b) AS ?total) (AVG(?b) AS ?mean) (MIN(?b) AS ?low) (MAX(?b) AS ?high) WHERE { ?c t:c_mktsegment ?seg ; t:c_acctbal ?b } GROUP BY ?seg",
       {"n": "bigint", "total": "double", "mean": "double", "low": "double", "high": "double"},
       "select c_mktsegment as seg, count(*) as n, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 2) as mean, min(c_acctbal) as low, max(c_acctbal) as high from customer group by 1", ("total", "mean"))
sparql("agg_distinct", "SELECT ?n (COUNT(DISTINCT ?seg) AS ?k) WHERE { ?c t:c_mktsegment ?seg ; t:c_nationkey ?n } GROUP BY ?n", {"k": "bigint"},
       "select 't:nation/' || c_nationkey as n, count(distinct c_mktsegment) as k from customer group by c_nationkey")
sparql("agg_having", "SELECT ?c (SUM(?p) AS ?spent) WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?p } GROUP BY ?c HAVING (SUM(?p) > 500000)", {"spent": "double"},
       "select 't:customer/' || o_custkey as c, round(sum(o_totalprice), 2) as spent from orders group by o_custkey having sum(o_totalprice) > 500000", ("spent",))
sparql("agg_empty", "SELECT (COUNT(*) AS ?n) WHERE { ?c t:c_acctbal ?b FILTER(?b > 1000000000) }", {"n": "bigint"}, "select count(*) as n from customer where c_acctbal > 1000000000")
sparql("group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x t:n_regionkey ?r ; t:n_name ?n } GROUP BY ?r", {},
       "select 't:region/' || n_regionkey as r, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey")
sparql("order_limit_offset", "SELECT ?name ?b WHERE { ?c t:c_name ?name ; t:c_acctbal ?b } ORDER BY DESC(?b) ?name LIMIT 10 OFFSET 5", {"b": "double"},
       "select c_name as name, c_acctbal as b from customer order by c_acctbal desc, c_name limit 10 offset 5")
sparql("distinct_proj", "SELECT DISTINCT ?seg ?n WHERE { ?c t:c_mktsegment ?seg ; t:c_nationkey ?n }", {}, "select distinct c_mktsegment as seg, 't:nation/' || c_nationkey as n from customer")
sparql("path_seq", "SELECT ?c ?r WHERE { ?c t:c_nationkey/t:n_regionkey ?r }", {},
       "select 't:customer/' || c_custkey as c, 't:region/' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey")
sparql("path_alt", "SELECT ?x ?n WHERE { ?x t:c_nationkey|t:s_nationkey ?n }", {},
       "select 't:customer/' || c_custkey as x, 't:nation/' || c_nationkey as n from customer union select 't:supplier/' || s_suppkey, 't:nation/' || s_nationkey from supplier")
sparql("path_inverse", "SELECT ?n ?c WHERE { ?n ^t:c_nationkey ?c }", {}, "select 't:nation/' || c_nationkey as n, 't:customer/' || c_custkey as c from customer")


def _tpch(spark: SparkSession, sf_dir: str) -> TableGraph:
    """The relational tables as one graph, without events and pages."""
    return TableGraph(spark, sf_dir, [m for m in TABLES if m.name in TPCH])


def _object_sql(m, c: str) -> str:
    how = m.columns[c]
    return f"'t:{how[1:]}/' || {c}" if how.startswith(">") else f"'{how}' || {c}"


#: All triples of the relational tables in SQL; a literal goes by its type and value.
_TRIPLES = "(" + " union all ".join(
    f"select 't:{m.name}/' || {" || '/' || ".join(m.key)} as s, {p} as p, {o} as o from {m.name}" for m in TABLES if m.name in TPCH
    for p, o in [("'type'", f"'t:{m.name}'"), *((f"'{c}'", _object_sql(m, c)) for c in m.columns)]) + ")"


def _values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[terms.value(F.col(c)).alias(c) for c in columns])


_LITERALS = "|".join(["a", *(f"t:{c}" for m in TABLES if m.name in TPCH for c, how in m.columns.items() if not how.startswith(">"))])


@query("path_negated", "select s, o from " + _TRIPLES + f" where p in ({', '.join(repr(c) for m in TABLES if m.name in TPCH for c, how in m.columns.items() if how.startswith('>'))})")
def path_negated(spark, sf_dir):
    return _values(Engine(_tpch(spark, sf_dir), PREFIXES).sparql(f"SELECT ?s ?o WHERE {{ ?s !({_LITERALS}) ?o }}"), "s", "o")


@query("path_opt", "select 't:customer/' || c_custkey as s, 't:nation/' || c_nationkey as o from customer union select x, x from (select 't:customer/' || c_custkey as x from customer)")
def path_opt(spark, sf_dir):
    return _values(Engine(_tpch(spark, sf_dir), PREFIXES).sparql("SELECT ?s ?o WHERE { ?s a t:customer . ?s t:c_nationkey? ?o }"), "s", "o")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, each linked to the customer's next one by date and key."""
    node = lambda c: F.concat(F.lit("<o:"), c.cast("string"), F.lit(">"))
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", after.alias("n")).where("n is not null").select(node(F.col("o_orderkey")).alias("s"), F.lit("<next>").alias("p"), node(F.col("n")).alias("o"))


_EDGES = "select 'o:' || o_orderkey as s, 'o:' || n as o from (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n is not null"
_CLOSURE = f"with recursive e as ({_EDGES}), c as (select s, o from e union select c.s, e.o from c join e on c.o = e.s) "


@query("path_plus", _CLOSURE + "select s, o from c")
def path_plus(spark, sf_dir):
    return _values(Engine(Graph(_chain(spark, sf_dir))).sparql("SELECT ?s ?o WHERE { ?s <next>+ ?o }"), "s", "o")


@query("path_star", _CLOSURE + "select s, o from c union select s, s from e union select o, o from e")
def path_star(spark, sf_dir):
    return _values(Engine(Graph(_chain(spark, sf_dir))).sparql("SELECT ?s ?o WHERE { ?s <next>* ?o }"), "s", "o")


@query("path_cycle", "with c as (select 'c:' || c_custkey as n, c_nationkey as a, c_mktsegment as b, count(*) over (partition by c_nationkey, c_mktsegment) as k from customer) select x.n as s, y.n as o from c x join c y on x.a = y.a and x.b = y.b where x.k > 1")
def path_cycle(spark, sf_dir):
    """Customers of a nation and segment in a ring: all reach all."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    node = lambda c: F.concat(F.lit("<c:"), c.cast("string"), F.lit(">"))
    after = F.coalesce(F.lead("c_custkey").over(w.orderBy("c_custkey")), F.min("c_custkey").over(w))
    ring = table(spark, sf_dir, "customer").select("c_custkey", after.alias("n")).where("c_custkey <> n")
    return _values(paths.closure(ring.select(node(F.col("c_custkey")).alias("s"), node(F.col("n")).alias("o"))), "s", "o")


@query("closure_seeded", _CLOSURE + "select s, o from c where s in (select 'o:' || min_by(o_orderkey, (o_orderdate, o_orderkey)) from orders group by o_custkey)")
def closure_seeded(spark, sf_dir):
    """From each customer's first order on."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k"))
    return _values(paths.closure(_chain(spark, sf_dir), first.select(F.concat(F.lit("<o:"), F.col("k").cast("string"), F.lit(">")).alias("s"))), "s", "o")


@query("ask", "select count(*) > 0 as ask from region where r_name = 'ASIA'")
def ask(spark, sf_dir):
    return Engine(graph(spark, sf_dir), PREFIXES).sparql("ASK { ?r t:r_name 'ASIA' }")


@query("construct", "select distinct 't:customer/' || c_custkey as s, 'in' as p, 't:region/' || n_regionkey as o from customer join nation on c_nationkey = n_nationkey")
def construct(spark, sf_dir):
    return _values(Engine(graph(spark, sf_dir), PREFIXES).sparql("CONSTRUCT { ?c <in> ?r } WHERE { ?c t:c_nationkey ?n . ?n t:n_regionkey ?r }"), "s", "p", "o")


@query("describe", "select 't:nation/3' as s, 't:n_name' as p, n_name as o from nation where n_nationkey = 3 union all select 't:nation/3', 't:n_regionkey', 't:region/' || n_regionkey from nation where n_nationkey = 3 union all select 't:nation/3', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 't:nation'")
def describe(spark, sf_dir):
    return _values(Engine(_tpch(spark, sf_dir), PREFIXES).sparql("DESCRIBE <t:nation/3>"), "s", "p", "o")


def _regions(spark: SparkSession, sf_dir: str) -> Dataset:
    """Nations as quads, each in the graph of its region."""
    n = table(spark, sf_dir, "nation")
    region = F.concat(F.lit("<t:region/"), F.col("n_regionkey").cast("string"), F.lit(">"))
    return Dataset(n.select(region.alias("g"), F.concat(F.lit("<t:nation/"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<t:n_name>").alias("p"), terms.plain(F.col("n_name")).alias("o")))


@query("graph_named", "select 't:region/' || n_regionkey as g, count(*) as n from nation group by n_regionkey")
def graph_named(spark, sf_dir):
    return Engine(_regions(spark, sf_dir), PREFIXES).native("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x t:n_name ?name } } GROUP BY ?g", {"n": "bigint"})


@query("update_insert_delete", "select 't:nation/' || n_nationkey as s, case when n_name like 'A%' then 'starts-with-a' else n_name end as o from nation where n_regionkey = 1 union all select 'x', 'y'")
def update_insert_delete(spark, sf_dir):
    data = Graph(_regions(spark, sf_dir).graph("<t:region/1>").triples)
    after = Engine(data, PREFIXES).update(
        "INSERT DATA { <x> t:n_name 'y' . <gone> t:n_name 'z' } ; DELETE DATA { <gone> t:n_name 'z' } ; "
        "DELETE { ?n t:n_name ?o } INSERT { ?n t:n_name 'starts-with-a' } WHERE { ?n t:n_name ?o FILTER(STRSTARTS(?o, 'A')) }")
    return _values(after.data.triples, "s", "o")


@query("graph_diff", "select '+' as mark, 't:supplier/' || s_suppkey as s from supplier where s_suppkey % 3 = 2 union all select '-', 't:supplier/' || s_suppkey from supplier where s_suppkey % 3 = 0")
def graph_diff(spark, sf_dir):
    t = graph(spark, sf_dir).scan(p="<t:s_name>")
    key = F.regexp_extract("s", r"/(\d+)>", 1).cast("int") % 3
    added, removed = transforms.diff(Graph(t.where(key < 2)), Graph(t.where(key > 0)))
    return _values(added.withColumn("mark", F.lit("+")).unionByName(removed.withColumn("mark", F.lit("-"))), "mark", "s")


@query("reify", "select 'subject' as part, 't:region/' || r_regionkey as value from region union all select 'predicate', 't:r_name' from region union all select 'object', r_name from region union all select 'type', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement' from region")
def reify(spark, sf_dir):
    made = transforms.reify(graph(spark, sf_dir).scan(p="<t:r_name>"))
    return made.select(F.regexp_extract("p", "#([a-z]+)>", 1).alias("part"), terms.value(F.col("o")).alias("value"))


@query("dereify", "select 't:region/' || r_regionkey as s, r_name as o from region")
def dereify(spark, sf_dir):
    return _values(transforms.dereify(transforms.reify(graph(spark, sf_dir).scan(p="<t:r_name>"))), "s", "o")


def _schema(spark: SparkSession, text: str) -> DataFrame:
    from graphloom.sources.files import read_n3

    return read_n3(spark, rulesets._PREFIXES + "@prefix t: <t:> . " + text)[0].triples


@query("rdfs_type_propagation", "select 't:customer/' || c_custkey as s, k as class from customer, (values ('t:customer'), ('t:party'), ('t:agent')) v(k) union all select 't:supplier/' || s_suppkey, k from supplier, (values ('t:supplier'), ('t:party'), ('t:agent')) v(k)")
def rdfs_type_propagation(spark, sf_dir):
    g = graph(spark, sf_dir)
    facts = g.scan(p=terms.TYPE, o="<t:customer>").union(g.scan(p=terms.TYPE, o="<t:supplier>")).union(_schema(spark, "t:customer rdfs:subClassOf t:party . t:supplier rdfs:subClassOf t:party . t:party rdfs:subClassOf t:agent ."))
    out = fixpoint.reason(Graph(facts), rulesets.rdfs()).graph.scan(p=terms.TYPE)
    return _values(out.select("s", F.col("o").alias("class")), "s", "class")


@query("rdfs_domain_range", "select distinct 't:orders/' || o_orderkey as s, 't:purchase' as class from orders union select distinct 't:customer/' || o_custkey, 't:buyer' from orders")
def rdfs_domain_range(spark, sf_dir):
    facts = graph(spark, sf_dir).scan(p="<t:o_custkey>").union(_schema(spark, "t:o_custkey rdfs:domain t:purchase ; rdfs:range t:buyer ."))
    return _values(fixpoint.reason(Graph(facts), rulesets.rdfs()).graph.scan(p=terms.TYPE).select("s", F.col("o").alias("class")), "s", "class")


@query("owl_symmetric_inverse", "select 't:nation/' || n_nationkey as s, 't:in' as p, 't:region/' || n_regionkey as o from nation union all select 't:region/' || n_regionkey, 't:has', 't:nation/' || n_nationkey from nation")
def owl_symmetric_inverse(spark, sf_dir):
    facts = graph(spark, sf_dir).scan(p="<t:n_regionkey>").select("s", F.lit("<t:in>").alias("p"), "o").union(_schema(spark, "t:in owl:inverseOf t:has ."))
    out = fixpoint.reason(Graph(facts), rulesets.owl_rl(["prp-symp", "prp-inv1", "prp-inv2"])).graph.triples
    return _values(out.where(F.col("p").isin("<t:in>", "<t:has>")), "s", "p", "o")


@query("owl_transitive", _CLOSURE + "select s, o from c")
def owl_transitive(spark, sf_dir):
    facts = _chain(spark, sf_dir).union(_schema(spark, "<next> a owl:TransitiveProperty ."))
    return _values(fixpoint.reason(Graph(facts), rulesets.owl_rl(["prp-trp"])).graph.scan(p="<next>"), "s", "o")


@query("owl_sameas_components", "select 't:customer/' || c_custkey as node, replace(min('t:customer/' || c_custkey || '>') over (partition by c_nationkey, c_mktsegment), '>', '') as label from customer qualify count(*) over (partition by c_nationkey, c_mktsegment) > 1")
def owl_sameas_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("<t:customer/"), F.col("c_custkey").cast("string"), F.lit(">")).alias("n"), F.col("c_custkey"), "c_nationkey", "c_mktsegment")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min_by("n", "c_custkey").alias("o"))
    return _values(transforms.components(c.join(first, ["c_nationkey", "c_mktsegment"]).select(F.col("n").alias("s"), "o")), "node", "label")


@query("naf_not_includes", "select 't:customer/' || c_custkey as s from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def naf_not_includes(spark, sf_dir):
    large = Engine(graph(spark, sf_dir), PREFIXES).sparql("CONSTRUCT { ?o t:large ?c } WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 400000) }")
    facts = Graph(graph(spark, sf_dir).scan(p=terms.TYPE, o="<t:customer>").union(large))
    rules = rulesets.rules("{ ?c a <t:customer> . ?scope log:notIncludes { ?o <t:large> ?c } } => { ?c a <t:modest> } .", {"log": terms.LOG})
    return _values(fixpoint.reason(facts, rules).graph.scan(p=terms.TYPE, o="<t:modest>").select("s"), "s")


@query("rules_builtins", "select 't:part/' || p_partkey as s, round(p_retailprice + p_size, 2) as total from part where p_size > 20 and starts_with(lower(p_brand), 'brand#1')")
def rules_builtins(spark, sf_dir):
    g = graph(spark, sf_dir)
    facts = Graph(union([g.scan(p=f"<t:{p}>") for p in ("p_size", "p_retailprice", "p_brand")]))
    rules = rulesets.rules(
        "{ ?x t:p_size ?n ; t:p_retailprice ?p ; t:p_brand ?b . ?n math:greaterThan 20 . (?p ?n) math:sum ?total . ?b string:lowerCase ?l . ?l string:startsWith 'brand#1' } => { ?x t:total ?total } .",
        {"t": "t:", "math": builtins.NAMESPACES["math"], "string": builtins.NAMESPACES["string"]})
    return fixpoint.reason(facts, rules).inferred.select(terms.value(F.col("s")).alias("s"), F.round(terms.number(F.col("o")), 2).alias("total"))


@query("proof_steps", _CLOSURE + "select count(*) as n from c where (s, o) not in (select s, o from e)")
def proof_steps(spark, sf_dir):
    rules = rulesets.rules("{ ?x <next> ?y . ?y <next> ?z } => { ?x <next> ?z } .")
    return fixpoint.derivations(Graph(_chain(spark, sf_dir)), rules).agg(F.count("*").alias("n"))


@query("incremental_delete", f"with recursive e as (select * from ({_EDGES}) where s not in (select 'o:' || o_orderkey from orders where o_orderstatus = 'P')), c as (select s, o from e union select c.s, e.o from c join e on c.o = e.s) select s, o from c")
def incremental_delete(spark, sf_dir):
    """The closure after the links from pending orders are withdrawn."""
    rules = rulesets.rules("{ ?x <next> ?y . ?y <next> ?z } => { ?x <next> ?z } .")
    facts = Graph(_chain(spark, sf_dir))
    whole = fixpoint.reason(facts, rules).graph
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("<o:"), F.col("o_orderkey").cast("string"), F.lit(">")).alias("s"))
    return _values(fixpoint.remove(facts, whole, rules, facts.triples.join(pending, "s", "left_semi")).triples, "s", "o")


@query("backward_goal", _CLOSURE + "select o as y from c where s = (select 'o:' || min_by(o_orderkey, (o_orderdate, o_orderkey)) from orders where o_custkey = (select min(o_custkey) from orders))")
def backward_goal(spark, sf_dir):
    """What follows the first order of the first customer."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k")).orderBy("o_custkey").first().k
    rules = rulesets.rules("{ ?x <next> ?y } => { ?x <reach> ?y } . { ?x <reach> ?y . ?y <next> ?z } => { ?x <reach> ?z } . { ?x <other> ?y } => { ?x <unused> ?y } .")
    return _values(fixpoint.answer(Graph(_chain(spark, sf_dir)), rules, [(f"<o:{first}>", "<reach>", "?y")]), "y")


@query("functional_violation", "select 't:customer/' || o_custkey as subject from orders group by o_custkey having count(distinct o_orderkey) > 1")
def functional_violation(spark, sf_dir):
    facts = graph(spark, sf_dir).scan(p="<t:o_custkey>").union(_schema(spark, "t:o_custkey a owl:InverseFunctionalProperty ."))
    return _values(reasoning.functional(Graph(facts), inverse=True), "subject")


@query("allen_relations", """with i as (select user_id, event_type, min(ts) as a, max(ts) as b from events group by all),
p as (select x.user_id, x.event_type as l, y.event_type as r, x.a as a1, x.b as a2, y.a as b1, y.b as b2 from i x join i y on x.user_id = y.user_id and x.event_type < y.event_type)
select relation, count(*) as n from (select case when a1 = b1 and a2 = b2 then 'equals' when a2 < b1 then 'before' when a1 > b2 then 'after' when a2 = b1 then 'meets' when a1 = b2 then 'metBy'
 when a1 = b1 and a2 < b2 then 'starts' when a1 = b1 and a2 > b2 then 'startedBy' when a2 = b2 and a1 > b1 then 'finishes' when a2 = b2 and a1 < b1 then 'finishedBy'
 when a1 > b1 and a2 < b2 then 'during' when a1 < b1 and a2 > b2 then 'contains' when a1 < b1 and a2 > b1 and a2 < b2 then 'overlaps' else 'overlappedBy' end as relation from p) group by relation""")
def allen_relations(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("id")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return reasoning.relations(spans, "user_id").groupBy("relation").agg(F.count("*").alias("n"))


@query("valid_at", "select o_orderkey from orders where o_orderdate <= timestamp '1995-06-17' and o_orderdate + interval 30 day >= timestamp '1995-06-17'")
def valid_at(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.expr("o_orderdate + interval 30 days").alias("valid_to"))
    return reasoning.valid_at(t, F.expr("cast('1995-06-17 00:00:00' as timestamp_ntz)") if t.schema["valid_from"].dataType.typeName() == "timestamp_ntz" else F.expr("timestamp '1995-06-17'")).select("o_orderkey")


@query("noisy_or", "select l_partkey, round(1 - product(1 - l_discount), 9) as prob from lineitem group by l_partkey")
def noisy_or(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.col("l_discount").alias("prob"))
    return reasoning.aggregate_probability(t).select(F.col("s").cast("bigint").alias("l_partkey"), F.round("prob", 9).alias("prob"))


@query("fuzzy_membership", "select p_partkey, round(greatest(0, least((p_size - 5) / 20.0, (45 - p_size) / 20.0)), 9) as degree, round(power(greatest(0, least((p_size - 5) / 20.0, (45 - p_size) / 20.0)), 2), 9) as very from part")
def fuzzy_membership(spark, sf_dir):
    m = reasoning.MEMBERSHIP["triangular"](F.col("p_size").cast("double"), 5.0, 25.0, 45.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(m, 9).alias("degree"), F.round(reasoning.HEDGES["very"](m), 9).alias("very"))


@query("cosine_topk", """with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
p as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 9) as x from embeddings, q)
select query_id, vec_id, round(x, 6) as similarity from p qualify row_number() over (partition by query_id order by x desc, vec_id) <= 10""")
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of every hundredth one, of all."""
    v = table(spark, sf_dir, "embeddings")
    return reasoning.nearest(v, v.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("predicate_cooccurrence", f"with t as (select distinct s, p from {_TRIPLES}) select a.p as p1, b.p as p2, count(*) as support from t a join t b on a.s = b.s and a.p <> b.p group by all")
def predicate_cooccurrence(spark, sf_dir):
    short = F.when(F.col("p") == terms.TYPE, "type").otherwise(F.regexp_extract("p", "<t:(.*)>", 1)).alias("p")
    return reasoning.predicate_pairs(Graph(_tpch(spark, sf_dir).triples.select("s", short, "o"))).select("p1", "p2", "support")


@query("graph_statistics", f"select count(*) as triples, count(distinct s) as subjects, count(distinct p) as predicates, count(distinct o) as objects from {_TRIPLES}")
def graph_statistics(spark, sf_dir):
    return reasoning.statistics(_tpch(spark, sf_dir))


@query("skolemise", "select 'urn:skolem:r' || r_regionkey as s, r_name as o from region")
def skolemise(spark, sf_dir):
    t = table(spark, sf_dir, "region").select(F.concat(F.lit("_:r"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("<n>").alias("p"), terms.plain(F.col("r_name")).alias("o"))
    return _values(transforms.skolemise(t), "s", "o")


# built-ins: over customer (a = c_acctbal, b = c_nationkey + 1) and part (p_name, p_type, p_brand)
_MATH = {
    "sum": "a + b", "difference": "a - b", "product": "a * b", "quotient": "a / b", "remainder": "a - b * trunc(a / b)", "integerQuotient": "floor(a / b)", "mod": "fmod(fmod(a, b) + b, b)",
    "hypot": "sqrt(a * a + b * b)", "atan2": "atan2(a, b)", "gcd": "gcd(abs(trunc(a))::bigint, b::bigint)", "bitAnd": "(trunc(a)::bigint & b::bigint)", "bitOr": "(trunc(a)::bigint | b::bigint)",
    "bitXor": "xor(trunc(a)::bigint, b::bigint)", "rightShift": "floor(a / power(2, b))",
}
_MATH_ONE = {
    "negation": "-a", "absoluteValue": "abs(a)", "rounded": "round(a)", "floor": "floor(a)", "ceiling": "ceil(a)", "sin": "sin(a)", "cos": "cos(a)", "atan": "atan(a)", "degrees": "degrees(a)",
    "radians": "radians(a)", "sign": "sign(a)", "cbrt": "cbrt(a)",
}
_MATH_POSITIVE = {"logarithm": "ln(b)", "sqrt": "sqrt(b)", "log10": "log10(b)", "log2": "log2(b)", "exp": "exp(b)", "sinh": "(exp(b) - exp(-b)) / 2", "cosh": "(exp(b) + exp(-b)) / 2", "tanh": "1 - 2 / (exp(2 * b) + 1)", "tan": "tan(b)"}
_MATH_TEST = {"lessThan": "b < 13", "greaterThan": "b > 13", "equalTo": "b = 13", "notEqualTo": "b <> 13", "notLessThan": "b >= 13", "notGreaterThan": "b <= 13"}
_CUSTOMER = "(select c_custkey as k, c_acctbal as a, c_nationkey + 1.0::double as b from customer)"
_STRING_ONE = {
    "lowerCase": "lower(t)", "upperCase": "upper(t)", "trim": "trim(t)", "trimLeft": "ltrim(t)", "trimRight": "rtrim(t)", "normalize": "regexp_replace(trim(t), '\\s+', ' ', 'g')", "reverse": "reverse(t)",
    "capitalize": "upper(t[1]) || t[2:]", "xmlEscape": "replace(replace(t, '&', '&amp;'), '<', '&lt;')",
}
_STRING_TEST = {
    "contains": ("ROM", "contains(t, 'ROM')"), "notContains": ("ROM", "not contains(t, 'ROM')"), "startsWith": ("PRO", "starts_with(t, 'PRO')"), "endsWith": ("MO", "ends_with(t, 'MO')"),
    "lessThan": ("MEDIUM", "t < 'MEDIUM'"), "greaterThan": ("MEDIUM", "t > 'MEDIUM'"), "notLessThan": ("MEDIUM", "t >= 'MEDIUM'"), "notGreaterThan": ("MEDIUM", "t <= 'MEDIUM'"),
    "matches": ("^[ES].*M", "regexp_matches(t, '^[ES].*M')"), "notMatches": ("^[ES].*M", "not regexp_matches(t, '^[ES].*M')"), "containsIgnoringCase": ("rom", "contains(lower(t), 'rom')"),
    "equalIgnoringCase": ("promo", "lower(t) = 'promo'"), "notEqualIgnoringCase": ("promo", "lower(t) <> 'promo'"),
}
_CRYPTO = {"md5": "md5(t)", "sha": "sha256(t)", "sha1": "sha1(t)", "base64Encode": "base64(encode(t))", "hexEncode": "lower(hex(encode(t)))"}
_TIME = {"year": "year(d)", "month": "month(d)", "day": "day(d)", "hour": "hour(d)", "dayOfWeek": "dayofweek(d)", "dayOfYear": "dayofyear(d)", "weekOfYear": "weekofyear(d)", "inSeconds": "epoch(d)"}
_LIST = {"length": "len(l)", "first": "l[1]", "last": "l[-1]", "unique": "len(list_distinct(l))", "reverse": "array_to_string(list_reverse(l), ' ')", "rest": "array_to_string(l[2:], ' ')", "butLast": "array_to_string(l[:-2], ' ')",
         "rotateLeft": "array_to_string(l[2:] || l[1:1], ' ')", "sort": "array_to_string(list_sort(l), ' ')"}


def _builtin(namespace: str, name: str, sql: str, build: Callable[[SparkSession, str, str], DataFrame]) -> None:
    uri = f"<{builtins.NAMESPACES[namespace]}{name}>"
    query(f"bi_{namespace}_{name}", sql)(lambda spark, sf_dir: build(spark, sf_dir, uri))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"), (F.col("c_nationkey") + 1).cast("double").alias("b"))


def _num(name: str) -> Val:
    return Val(_num=F.col(name))


def _t() -> Val:
    return Val(_text=F.col("t"))


for _n, _sql in _MATH.items():
    _builtin("math", _n, f"select k, round(({_sql})::double, 6) as value from {_CUSTOMER}", lambda spark, sf, u: _customers(spark, sf).select("k", F.round(builtins.evaluate(u, [_num("a"), _num("b")], None).num.cast("double"), 6).alias("value")))
for _n, _sql in _MATH_ONE.items():
    _builtin("math", _n, f"select k, round(({_sql})::double, 6) as value from {_CUSTOMER}", lambda spark, sf, u: _customers(spark, sf).select("k", F.round(builtins.evaluate(u, _num("a"), None).num.cast("double"), 6).alias("value")))
for _n, _sql in _MATH_POSITIVE.items():
    _builtin("math", _n, f"select k, round(({_sql})::double, 3) as value from {_CUSTOMER}", lambda spark, sf, u: _customers(spark, sf).select("k", F.round(builtins.evaluate(u, _num("b"), None).num.cast("double"), 3).alias("value")))
for _n, _sql in _MATH_TEST.items():
    _builtin("math", _n, f"select k from {_CUSTOMER} where {_sql}", lambda spark, sf, u: _customers(spark, sf).where(builtins.evaluate(u, _num("b"), constant(terms.literal(13)))).select("k"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("t"), F.col("p_name").alias("n"))


_PART = "(select p_partkey as k, p_type as t, p_name as n, string_split(p_type, ' ') as l from part)"
for _n, _sql in _STRING_ONE.items():
    _builtin("string", _n, f"select k, {_sql} as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, _t(), None).text.alias("value")))
for _n, (_given, _sql) in _STRING_TEST.items():
    _builtin("string", _n, f"select k from {_PART} where {_sql}", lambda spark, sf, u, g=_given: _parts(spark, sf).where(builtins.evaluate(u, _t(), constant(terms.literal(g)))).select("k"))
for _n, _sql in _CRYPTO.items():
    _builtin("crypto", _n, f"select k, {_sql} as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, _t(), None).text.alias("value")))
_builtin("string", "length", f"select k, strlen(t)::double as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, _t(), None).num.alias("value")))
_builtin("string", "concatenation", f"select k, t || n as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, [_t(), Val(_text=F.col("n"))], None).text.alias("value")))
_builtin("string", "replace", f"select k, replace(t, 'E', 'e') as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, [_t(), constant('"E"'), constant('"e"')], None).text.alias("value")))
_builtin("string", "indexOf", f"select k, (position(' ' in t) - 1)::double as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, [_t(), constant('" "')], None).num.alias("value")))
_builtin("string", "substring", f"select k, substr(t, 3, 4) as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", builtins.evaluate(u, [_t(), constant(terms.literal(2)), constant(terms.literal(4))], None).text.alias("value")))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"))


for _n, _sql in _TIME.items():
    _builtin("time", _n, f"select k, ({_sql})::double as value from (select o_orderkey as k, o_orderdate as d from orders)", lambda spark, sf, u: _orders(spark, sf).select("k", builtins.evaluate(u, _t(), None).num.alias("value")))


def _list_value(u: str):
    made = builtins.evaluate(u, F.transform(F.split("t", " "), terms.plain), None)
    if not isinstance(made, Val):
        return F.size(made).cast("double") if u.endswith("unique>") else F.array_join(F.transform(made, terms.value), " ")
    return made.num if builtins.REGISTRY[u].kind == "num" else made.text


for _n, _sql in _LIST.items():
    _cast = f"({_sql})::double" if _n in ("length", "unique") else _sql
    _builtin("list", _n, f"select k, {_cast} as value from {_PART}", lambda spark, sf, u: _parts(spark, sf).select("k", _list_value(u).alias("value")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region: a chain over five tables, filtered, grouped and ordered."""
    return Engine(graph(spark, sf_dir), PREFIXES).native(
        "SELECT ?region (SUM(?v) AS ?revenue) (COUNT(*) AS ?n) WHERE { ?l t:l_orderkey ?o ; t:l_extendedprice ?x ; t:l_discount ?d . ?o t:o_custkey ?c . ?c t:c_nationkey ?na . ?na t:n_regionkey ?r . "
        "?r t:r_name ?region BIND(?x * (1 - ?d) AS ?v) } GROUP BY ?region ORDER BY ?region", {"revenue": "double", "n": "bigint"}).withColumn("revenue", F.round("revenue", 2))


query("flagship", "select r_name as region, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
      "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")(flagship)

from graphloom import queries_more  # noqa: E402, F401
