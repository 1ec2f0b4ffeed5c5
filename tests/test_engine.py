"""SPARQL, updates, paths, files, rules and transforms on small graphs with answers worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import builtins, formulas, terms
from graphloom.operators import fixpoint, paths, reasoning, rulesets, transforms
from graphloom.plans import sparql
from graphloom.plans.expressions import Val, constant
from graphloom.sources import files, n3
from graphloom.sources.graphs import Dataset, Graph

PEOPLE = """@prefix : <http://e/> . @prefix foaf: <http://f/> .
:alice a foaf:Person ; foaf:name "Alice" ; foaf:age 30 ; foaf:knows :bob , :carol ; foaf:mbox <mailto:a@e> .
:bob a foaf:Person ; foaf:name "Bob" ; foaf:age 25 ; foaf:knows :carol .
:carol a foaf:Person ; foaf:name "Carol"@en ; foaf:age 35 ; foaf:knows :dave .
:dave a foaf:Person ; foaf:name "Dave" ; foaf:age 28 ."""
PREFIXES = {"": "http://e/", "foaf": "http://f/"}


@pytest.fixture(scope="module")
def people(spark):
    return Engine(files.read_n3(spark, PEOPLE)[0], PREFIXES)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_select(people):
    assert people.data.triples.count() == 17
    found = people.native("SELECT ?n ?a WHERE { ?p foaf:name ?n ; foaf:age ?a FILTER(?a > 27) } ORDER BY DESC(?a)", {"a": "int"}).collect()
    assert [tuple(r) for r in found] == [("Carol", 35), ("Alice", 30), ("Dave", 28)]
    assert people.sparql("SELECT DISTINCT ?t WHERE { ?p a ?t }").count() == 1
    assert rows(people.native("SELECT ?n ?m WHERE { ?p foaf:name ?n OPTIONAL { ?p foaf:mbox ?m } }", {}))[0] == ("Alice", "mailto:a@e")
    assert [r.n for r in people.native("SELECT ?n WHERE { ?p foaf:name ?n } ORDER BY ?n LIMIT 2 OFFSET 1", {}).collect()] == ["Bob", "Carol"]


@pytest.mark.parametrize(("where", "n"), [
    ("{ ?p foaf:age ?a FILTER(?a >= 28 && ?a != 30) }", 2), ("{ ?p foaf:age ?a FILTER(?a < 26 || ?a = 35) }", 2), ("{ ?p foaf:name ?n FILTER(LANG(?n) = 'en') }", 1),
    ("{ ?p foaf:name ?n FILTER(REGEX(?n, '^[ab]', 'i')) }", 2), ("{ ?p foaf:mbox ?m FILTER(isIRI(?m)) }", 1), ("{ ?p foaf:knows ?q MINUS { ?p foaf:mbox ?m } }", 2),
    ("{ ?p a foaf:Person FILTER NOT EXISTS { ?p foaf:knows ?q } }", 1), ("{ ?p a foaf:Person FILTER EXISTS { ?p foaf:knows :carol } }", 2),
    ("{ { ?p foaf:age 25 } UNION { ?p foaf:age 30 } }", 2), ("{ VALUES (?p ?x) { (:bob 1) (:alice UNDEF) } ?p foaf:age ?a }", 2), ("{ ?p foaf:age ?a BIND(?a + 1 AS ?b) FILTER(?b IN (26, 31)) }", 2),
    ("{ ?p foaf:age ?a OPTIONAL { ?p foaf:mbox ?m } FILTER(!BOUND(?m)) }", 3), ("{ ?p foaf:name ?n FILTER(STRLEN(?n) = 3) }", 1), ("{ ?p ?q ?p }", 0),
    ("{ ?p foaf:age ?a FILTER(DATATYPE(?a) = xsd:integer) }", 4), ("{ ?p foaf:name ?n . FILTER(STRSTARTS(UCASE(?n), 'C') || CONTAINS(?n, 'o')) }", 2),
    ("{ :alice foaf:knows+ ?q }", 3), ("{ :alice foaf:knows* ?q }", 4), ("{ ?p foaf:knows? :carol }", 3), ("{ ?p foaf:knows/foaf:knows ?q }", 3), ("{ :carol ^foaf:knows ?q }", 2),
    ("{ :alice foaf:knows|foaf:mbox ?q }", 3), ("{ :alice !(a|foaf:knows) ?q }", 3), ("{ ?p foaf:knows+ :dave }", 3),
])
def test_patterns(people, where, n):
    assert people.sparql(f"SELECT * WHERE {where}").count() == n


def test_aggregates(people):
    found = people.native(
        "SELECT (COUNT(?p) AS ?n) (SUM(?a) AS ?s) (AVG(?a) AS ?m) (MIN(?a) AS ?l) (MAX(?a) AS ?h) (GROUP_CONCAT(?x; SEPARATOR=',') AS ?c) WHERE { ?p foaf:age ?a ; foaf:name ?x }",
        {"n": "int", "s": "double", "m": "double", "l": "double", "h": "double"}).first()
    assert tuple(found) == (4, 118.0, 29.5, 25.0, 35.0, "Alice,Bob,Carol,Dave")
    assert rows(people.native("SELECT ?p (COUNT(?q) AS ?n) WHERE { ?p foaf:knows ?q } GROUP BY ?p HAVING (COUNT(?q) > 1)", {"n": "int"})) == [("http://e/alice", 2)]
    assert people.native("SELECT (COUNT(*) AS ?n) WHERE { ?p foaf:age 99 }", {"n": "int"}).first().n == 0


def test_forms(people):
    assert people.sparql("ASK { :alice foaf:knows :bob }").first().ask
    assert not people.sparql("ASK { :bob foaf:knows :alice }").first().ask
    assert people.sparql("CONSTRUCT { ?q :knownBy ?p . ?p :x ?m } WHERE { ?p foaf:knows ?q OPTIONAL { ?p foaf:mbox ?m } }").count() == 5
    assert people.sparql("DESCRIBE :bob").count() == 4


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x WHERE { ?x ?y }", "SELECT ?x WHERE { ?x nope:y ?z }", "FOO", "SELECT ?x WHERE { ?x ?y ?z } x"])
def test_what_is_no_query_raises(text):
    with pytest.raises(ValueError):
        sparql.parse(text)


def test_updates(spark):
    e = Engine(Graph.of(spark, [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>")]))
    e = e.update("INSERT DATA { <c> <p> <d> . <c> <p> <d> } ; DELETE DATA { <a> <p> <b> } ; DELETE { ?s <p> ?o } INSERT { ?o <q> ?s } WHERE { ?s <p> ?o FILTER(?s = <b>) }")
    assert rows(e.data.triples) == [("<c>", "<p>", "<d>"), ("<c>", "<q>", "<b>")]
    d = Engine(Dataset(spark.createDataFrame([("<g>", "<a>", "<p>", "<b>"), (None, "<a>", "<p>", "<c>")], "g string, s string, p string, o string")))
    d = d.update("INSERT DATA { GRAPH <h> { <x> <p> <y> } } ; DELETE DATA { GRAPH <g> { <a> <p> <b> } } ; CREATE GRAPH <empty>")
    assert rows(d.sparql("SELECT ?g ?s WHERE { GRAPH ?g { ?s <p> ?o } }")) == [("<h>", "<x>")]
    assert rows(d.data.graph_names()) == [("<empty>",), ("<h>",)]
    assert d.update("CLEAR DEFAULT").data.quads.count() == 1 and d.update("DROP ALL").data.quads.count() == 0
    with pytest.raises(ValueError):
        d.update("DROP GRAPH <nowhere>")
    assert d.update("DROP SILENT GRAPH <nowhere>").data.quads.count() == 2


def test_closure_of_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "s string, o string")
    assert paths.closure(edges).count() == 12
    assert rows(paths.closure(edges, spark.createDataFrame([("x",)], "s string"))) == [("x", "a"), ("x", "b"), ("x", "c")]
    assert paths.closure(edges.limit(0)).count() == 0


def _reached(pairs):
    after, out = {}, set()
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for a in after:
        found, todo = set(), [a]
        while todo:
            todo = [y for x in todo for y in after.get(x, ()) if y not in found and not found.add(y)]
        out |= {(a, b) for b in found}
    return sorted(out)


def test_closure_of_lines_and_rings(spark, monkeypatch):
    """Each pair is made once and nothing is joined round by round; a long line and ring are dealt to blocks."""
    monkeypatch.setattr(paths, "LINE_BLOCK", 5)
    monkeypatch.setattr(paths, "FEW_SEEDS", 2)
    monkeypatch.setattr(paths, "_doubled", None)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("b1", "b0"), ("b0", "b2"), ("self", "self")]
    for name, size in (("r", 7), ("q", 3), ("p", 2)):
        pairs += [(f"{name}{i}", f"{name}{(i + 2) % size if size == 7 else (i + 1) % size}") for i in range(size)]
    edges = spark.createDataFrame([*pairs, pairs[0]], "s string, o string")
    expected = _reached(pairs)
    assert rows(paths.closure(edges)) == expected
    assert rows(paths.closure(edges, beyond=True)) == sorted(set(expected) - set(pairs))
    seeds = ["a3", "b0", "r2", "none"]
    assert rows(paths.closure(edges, spark.createDataFrame([(x,) for x in seeds], "s string"))) == [x for x in expected if x[0] in seeds]
    only = [x for x in pairs if x[0].startswith("r")]
    assert rows(paths.closure(spark.createDataFrame(only, "s string, o string"), beyond=True)) == sorted(set(_reached(only)) - set(only))


def test_transitive_rules_are_closed_at_once(spark, monkeypatch):
    """Lines: no step joins all facts; the same proofs, insertions and deletions as step by step."""
    rules = rulesets.rules("{ ?y <n> ?z . ?x <n> ?y } => { ?x <n> ?z } .")
    links = [(f"<{a}{(i * 7) % 23}>", "<n>", f"<{a}{(i * 7 + 7) % 23}>") for a, size in (("a", 6), ("b", 3), ("c", 1)) for i in range(size)]
    facts = Graph.of(spark, [*links, ("<a1>", "<other>", "<b1>")])
    late = spark.createDataFrame([links[3], links[7]], "s string, p string, o string")
    early = Graph(facts.delete(late).triples)
    closed = sorted([(a, "<n>", b) for a, b in _reached([(a, b) for a, _, b in links])] + [("<a1>", "<other>", "<b1>")])

    def run():
        proof = fixpoint.derivations(facts, rules)
        whole, part = fixpoint.reason(facts, rules).graph, fixpoint.reason(early, rules).graph
        grown = fixpoint.insert(part, rules, late)
        return rows(proof), fixpoint.validate(proof, facts).count(), rows(whole.triples), rows(fixpoint.remove(facts, whole, rules, late).triples), rows(grown.graph.triples), rows(grown.inferred)

    with monkeypatch.context() as m:
        m.setattr(fixpoint, "derive", None)
        m.setattr(fixpoint, "solve", None)
        fast = run()
    monkeypatch.setattr(fixpoint, "_transitive", lambda rules: None)
    assert fast == run()
    assert fast[1] == 0 and fast[2] == closed == fast[4] and len(fast[3]) < len(closed)
    proof = fixpoint.derivations(facts, rules)
    assert fixpoint.validate(proof.where("step > 1"), facts).count() > 0


def test_closure_of_branching_ways(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "d"), ("g", "h"), ("h", "h"), ("a", "c")]
    edges = spark.createDataFrame(pairs, "s string, o string")
    assert rows(paths.closure(edges)) == _reached(pairs)
    assert rows(paths.closure(edges, beyond=True)) == sorted(set(_reached(pairs)) - set(pairs))


def test_terms(spark):
    values = ["plain", 'quote " and \\ back', "line\nbreak\ttab", "", "\\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("t", terms.plain(F.col("v")))
    for r in df.withColumn("back", terms.value(F.col("t"))).collect():
        assert r.t == terms.literal(r.v) and r.back == r.v and files.python_literal(r.t)[0] == r.v
    numbers = {5.0: "5", 0.0000001: "0.0000001", 1.5: "1.5", 12345678.5: "12345678.5", 1e20: "100000000000000000000", -2.25: "-2.25"}
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", terms.num_to_lex(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == numbers


def test_formats(spark, tmp_path):
    g = files.read_n3(spark, PEOPLE)[0]
    files.write_ntriples(g.triples, str(tmp_path / "out.nt"))
    assert rows(files.read_file(spark, str(tmp_path / "out.nt")).triples) == rows(g.triples)
    assert rows(Graph.of(spark, files.parse_rdfxml(files.to_rdfxml(g.triples))).triples) == rows(g.triples)
    assert rows(files.read_n3(spark, files.to_n3(g.triples, {"f": "http://f/"}))[0].triples) == rows(g.triples)
    files.write_dictionary(g, str(tmp_path / "dict"))
    assert rows(files.read_dictionary(spark, str(tmp_path / "dict")).triples) == rows(g.triples)
    assert len(json.loads(files.to_jsonld(g.triples))["@graph"]) == 4
    asked = Engine(g, PREFIXES).sparql("SELECT ?n WHERE { :carol foaf:name ?n }")
    assert json.loads(files.results_json(asked))["results"]["bindings"] == [{"n": {"type": "literal", "value": "Carol", "xml:lang": "en"}}]
    assert '<literal xml:lang="en">Carol</literal>' in files.results_xml(asked)
    triples, rules = files.parse_kif("(human Socrates) (=> (human ?x) (mortal ?x)) (gives A B C)")
    assert len(triples) == 5 and len(rules) == 1


def test_n3_syntax():
    doc = n3.parse("@prefix : <http://e/> . :a :p (1 \"x\"@en), [ :q true ] ; a :T . @forAll :x . { :x :p ?y } => { ?y :r :x } . :a!:p :s 3.5 . :b is :of of :c . PREFIX z: <http://z/> z:a = z:b .")
    assert doc.rules[0].head == (("?y", "<http://e/r>", "?x"),)
    assert ("<http://e/c>", "<http://e/of>", "<http://e/b>") in doc.triples and ("<http://z/a>", n3.SAME_AS, "<http://z/b>") in doc.triples
    with pytest.raises(n3.N3Error):
        n3.parse(":a :b")


def test_rules(spark):
    text = """@prefix : <http://e/> . @prefix math: <http://www.w3.org/2000/10/swap/math#> . @prefix log: <http://www.w3.org/2000/10/swap/log#> . @prefix string: <http://www.w3.org/2000/10/swap/string#> .
    :a :sub :b . :b :sub :c . :c :sub :a . :a :n 4 . :b :n 9 . :t a :Bird . :u a :Bird , :Penguin .
    { ?x :sub ?y . ?y :sub ?z } => { ?x :sub ?z } . { ?x :n ?n . ?n math:greaterThan 5 . (?n 1) math:sum ?m } => { ?x :next ?m } . { ?x :n ?n . (?k 1) math:sum ?n } => { ?x :before ?k } .
    { ?x a :Bird . ?w log:notIncludes { ?x a :Penguin } } => { ?x a :Flyer } . { ?x a :Flyer . (\"i \" \"fly\") string:concatenation ?s } => { ?x :says ?s } ."""
    g, doc = files.read_n3(spark, text)
    facts = Graph(transforms.purge_rules(g.triples))
    out = fixpoint.reason(facts, doc.rules).graph
    assert out.scan(p="<http://e/sub>").count() == 9
    value = lambda p: rows(out.scan(p=f"<http://e/{p}>").select("s", terms.value(F.col("o"))))
    assert value("next") == [("<http://e/b>", "10")] and value("before") == [("<http://e/a>", "3"), ("<http://e/b>", "8")] and value("says") == [("<http://e/t>", "i fly")]
    proof = fixpoint.derivations(facts, doc.rules[:1])
    assert proof.count() == 6 and fixpoint.validate(proof, facts).count() == 0
    assert fixpoint.why_not(facts, doc.rules[:1], ("<http://e/a>", "<http://e/sub>", "<http://e/z>"))
    whole = fixpoint.reason(facts, doc.rules[:1]).graph
    cut_edge = facts.scan(s="<http://e/c>", p="<http://e/sub>")
    after = fixpoint.remove(facts, whole, doc.rules[:1], cut_edge)
    again = fixpoint.reason(facts.delete(cut_edge), doc.rules[:1]).graph
    assert rows(after.triples) == rows(again.triples)
    grown = fixpoint.insert(again, doc.rules[:1], cut_edge).graph
    assert rows(grown.triples) == rows(whole.triples)
    assert not fixpoint.reason(facts, doc.rules[:1], max_steps=1).complete


@pytest.mark.parametrize(("name", "facts", "expected"), [
    ("prp-symp", [("<p>", terms.TYPE, f"<{terms.OWL}SymmetricProperty>"), ("<a>", "<p>", "<b>")], ("<b>", "<p>", "<a>")),
    ("cls-hv1", [("<r>", f"<{terms.OWL}hasValue>", "<v>"), ("<r>", f"<{terms.OWL}onProperty>", "<p>"), ("<x>", terms.TYPE, "<r>")], ("<x>", "<p>", "<v>")),
    ("cls-svf1", [("<r>", f"<{terms.OWL}someValuesFrom>", "<c>"), ("<r>", f"<{terms.OWL}onProperty>", "<p>"), ("<x>", "<p>", "<y>"), ("<y>", terms.TYPE, "<c>")], ("<x>", terms.TYPE, "<r>")),
    ("eq-rep-o", [("<a>", f"<{terms.OWL}sameAs>", "<b>"), ("<x>", "<p>", "<a>")], ("<x>", "<p>", "<b>")),
])
def test_owl_rules(spark, name, facts, expected):
    assert fixpoint.reason(Graph.of(spark, facts), rulesets.owl_rl([name])).graph.contains(*expected)


def test_consistency(spark):
    owl = lambda n: f"<{terms.OWL}{n}>"
    g = Graph.of(spark, [("<A>", owl("disjointWith"), "<B>"), ("<x>", terms.TYPE, "<A>"), ("<x>", terms.TYPE, "<B>"), ("<f>", terms.TYPE, owl("FunctionalProperty")), ("<x>", "<f>", "<y>"), ("<x>", "<f>", "<z>"),
                         ("<x>", owl("sameAs"), "<y>"), ("<y>", owl("differentFrom"), "<x>"), ("<n>", terms.TYPE, owl("Nothing")), ("<i>", terms.TYPE, owl("IrreflexiveProperty")), ("<q>", "<i>", "<q>"),
                         ("<f>", f"<{terms.RDFS}domain>", "<D>")])
    assert {r.check for r in reasoning.violations(g).collect()} == {"disjoint", "FunctionalProperty", "identity", "nothing", "irreflexive", "domain"}


def test_transforms(spark):
    g = Graph.of(spark, [("_:a", "<p>", "<HTTP://E.org:80/x?>"), ("<b>", f"<{terms.OWL}sameAs>", "<a>"), ("<c>", "<p>", "<b>"), ("<ch>", terms.TYPE, f"<{terms.LOG}Chaff>")])
    assert ("<urn:skolem:a>", "<p>", "<HTTP://E.org:80/x?>") in rows(transforms.skolemise(g.triples))
    assert ("_:a", "<p>", "<HTTP://E.org:80/x?>") not in rows(transforms.normalise_iris(g.triples)) and ("_:a", "<p>", "<http://e.org/x>") in rows(transforms.normalise_iris(g.triples))
    assert ("<c>", "<p>", "<a>") in rows(transforms.smush(g.triples))
    assert transforms.purge_chaff(g.triples).count() == 3
    assert rows(transforms.dereify(transforms.reify(g.triples))) == rows(g.triples)
    added, removed = transforms.diff(g, transforms.patch(g, g.scan(s="<c>"), spark.createDataFrame([("<n>", "<p>", "<m>")], "s string, p string, o string")))
    assert rows(added) == [("<n>", "<p>", "<m>")] and rows(removed) == [("<c>", "<p>", "<b>")]
    assert str(transforms.Version.of("1.2.3").bump(1, 0, 0)) == "1.3.0"


def _many(values):
    return [constant(terms.literal(v)) for v in values]


@pytest.mark.parametrize(("name", "subject", "expected"), [
    ("math#gcd", [12, 18], "6"), ("math#mod", [7, -3], "-2"), ("math#remainder", [7, -3], "1"), ("math#integerQuotient", [-7, 2], "-4"), ("math#leftShift", [3, 4], "48"), ("math#lcm", [4, 6], "12"),
    ("string#substring", ["hello", 1, 3], "ell"), ("string#padStart", ["5", 3, "0"], "005"), ("string#scrape", ["ab12", r"(\d+)"], "12"), ("string#lastIndexOf", ["abcabc", "bc"], "4"),
    ("time#addSeconds", ["2024-02-29T10:11:12Z", 60], "2024-02-29T10:12:12Z"), ("time#diffSeconds", ["2024-01-01T00:01:00Z", "2024-01-01T00:00:00Z"], "60"), ("time#format", ["2024-02-29T10:11:12Z", "%Y/%m"], "2024/02"),
    ("crypto#sign", ["data", "key"], "UDH+PZicbRU3oBP6bnOdojRj/a7DtwE32Cjjas4iG9A="), ("log#dtlit", ["5", "http://d"], "5"),
])
def test_builtins_of_lists(spark, name, subject, expected):
    made = builtins.evaluate(f"<{builtins.SWAP}{name}>", _many(subject), None)
    assert spark.range(1).select(terms.value(made.term)).first()[0] == expected


@pytest.mark.parametrize(("name", "subject", "expected"), [
    ("math#rounded", 2.5, "3"), ("math#cbrt", 27.0, "3"), ("string#length", "hé", "3"), ("string#uriPort", "http://h:80/p", "80"), ("string#encodeForURI", "a b/ü", "a%20b%2F%C3%BC"), ("string#reverse", "abc", "cba"),
    ("time#dayOfWeek", "2024-02-29T10:11:12Z", "4"), ("time#timeZone", "2024-02-29T10:11:12-05:30", "-330"), ("crypto#base64Decode", "YWJj", "abc"), ("os#basename", "/a/b.txt", "b.txt"), ("os#extension", "/a/b.txt", "txt"),
])
def test_builtins_of_values(spark, name, subject, expected):
    made = builtins.evaluate(f"<{builtins.SWAP}{name}>", constant(terms.literal(subject)), None)
    assert spark.range(1).select(terms.value(made.term)).first()[0] == expected


@pytest.mark.parametrize(("name", "subject", "expected"), [
    ("list#sort", [[3, 1, 2]], "1 2 3"), ("list#rest", [[1, 2]], "2"), ("list#take", [[1, 2, 3], 2], "1 2"), ("list#insert", [[1, 3], 1, 2], "1 2 3"), ("list#setDifference", [[1, 2], [2]], "1"), ("list#append", [[1], [2]], "1 2"),
    ("list#rotateRight", [[1, 2, 3]], "3 1 2"), ("list#intersperse", [[1, 2], 0], "1 0 2"), ("list#replaceAt", [[1, 2], 0, 9], "9 2"), ("list#removeAt", [[1, 2], 0], "2"),
])
def test_list_builtins(spark, name, subject, expected):
    uri = f"<{builtins.SWAP}{name}>"
    shape = builtins.REGISTRY[uri].shape
    args = [_many(x) if isinstance(x, list) else constant(terms.literal(x)) for x in subject]
    made = builtins.evaluate(uri, args[0] if shape == "array" else args, None)
    assert spark.range(1).select(F.array_join(F.transform(made, terms.value), " ")).first()[0] == expected


def test_own_builtin(spark):
    builtins.register("<http://own#twice>", builtins.Builtin("one", "num", lambda a: a.num * 2))
    rules = rulesets.rules("{ ?x <n> ?n . ?n <http://own#twice> ?m } => { ?x <m> ?m } .")
    out = fixpoint.reason(Graph.of(spark, [("<a>", "<n>", terms.literal(4))]), rules).inferred
    assert out.select(terms.value(F.col("o"))).first()[0] == "8"
    assert isinstance(builtins.evaluate("<http://own#twice>", constant(terms.literal(1)), None), Val)


def test_formulas():
    f = formulas.parsed("<a> <p> <b> . <b> <p> <c> .")
    pattern = n3.Formula((("?x", "<p>", "?y"), ("?y", "<p>", "?z")))
    assert formulas.matches(f, pattern) == [{"?x": "<a>", "?y": "<b>", "?z": "<c>"}]
    assert formulas.not_includes(f, n3.Formula((("<c>", "<p>", "?x"),)))
    assert formulas.collect("?x", n3.Formula((("?x", "<p>", "?y"),)), f).items == ("<a>", "<b>")
    rule = rulesets.rules("{ ({ <a> <p> <b> } { <b> <p> <c> }) log:conjunction ?f . ?f log:tripleCount ?n . (?x { ?x <p> ?y } ?f) log:findall ?l . ?z list:in ?l } => { ?z <among> ?n } .", {"log": terms.LOG, "list": builtins.NAMESPACES["list"]})[0]
    assert formulas.simplified(rule).body == (("?z", f"<{builtins.NAMESPACES['list']}in>", n3.ListTerm(("<a>", "<b>"))),)
    assert formulas.simplified(rulesets.rules("{ ({ <a> <p> <b> } { <a> <q> ?x }) log:forAllIn true } => { <a> <b> <c> } .", {"log": terms.LOG})[0]) is None
    assert formulas.triple_count(formulas.difference(f, formulas.keep(f, n3.Formula((("<a>", "?p", "?o"),))))) == 1


def test_exists_sees_outer_variables(people):
    younger = "SELECT ?p WHERE { ?p foaf:age ?n FILTER NOT EXISTS { ?y foaf:age ?m FILTER(?m > ?n) } }"
    assert rows(people.native(younger, {})) == [("http://e/carol",)]
    knows = "SELECT ?p WHERE { ?p foaf:age ?n FILTER EXISTS { ?p foaf:knows ?y . ?y foaf:age ?m FILTER(?m > ?n) } }"
    assert rows(people.native(knows, {})) == [("http://e/alice",), ("http://e/bob",)]
    mixed = "SELECT ?p WHERE { ?p foaf:age ?n FILTER(?n > 29 && EXISTS { ?p foaf:knows ?y } || !(EXISTS { ?p foaf:knows ?z } || ?n > 90)) }"
    assert rows(people.native(mixed, {})) == [("http://e/alice",), ("http://e/carol",), ("http://e/dave",)]


def test_graph_reaches_nested_patterns(spark):
    quads = [("<g1>", "<x>", "<p>", "<a>"), ("<g2>", "<x>", "<q>", "<b>"), ("<g2>", "<y>", "<p>", "<c>"), ("<g2>", "<y>", "<q>", "<d>"), ("<g2>", "<d>", "<q>", "<e>")]
    e = Engine(Dataset(spark.createDataFrame(quads, "g string, s string, p string, o string")))
    assert rows(e.native("SELECT ?g ?s ?v WHERE { GRAPH ?g { ?s <p> ?o OPTIONAL { ?s <q> ?v } } }", {})) == [("g1", "x", None), ("g2", "y", "d")]
    assert rows(e.native("SELECT ?g ?s WHERE { GRAPH ?g { { ?s <p> ?o } UNION { ?s <q> ?o } FILTER EXISTS { ?s <p> ?w } } }", {})) == [("g1", "x"), ("g2", "y"), ("g2", "y")]
    assert rows(e.native("SELECT ?g ?v WHERE { GRAPH ?g { <y> <q>+ ?v } }", {})) == [("g2", "d"), ("g2", "e")]
    assert rows(e.native("SELECT ?g ?s WHERE { GRAPH ?g { ?s <p> ?o MINUS { ?s <q> ?v } } }", {})) == [("g1", "x")]


def test_unbound_joins_without_a_product(people):
    text = "SELECT ?x ?y WHERE { ?x foaf:age ?n BIND(?n + 5 AS ?k) ?y foaf:age ?k }"
    found = people.native(text, {})
    assert rows(found) == [("http://e/alice", "http://e/carol"), ("http://e/bob", "http://e/alice")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    two = "SELECT ?p ?m WHERE { ?p foaf:name ?n OPTIONAL { ?p foaf:mbox ?m } OPTIONAL { ?q foaf:mbox ?m ; foaf:age ?a } }"
    assert people.sparql(two).count() == 4
    gone = "SELECT ?p WHERE { ?p foaf:name ?n OPTIONAL { ?p foaf:mbox ?m } MINUS { ?q foaf:mbox ?m } }"
    assert len(rows(people.sparql(gone))) == 3


def test_schema_is_put_into_rules(spark):
    schema = files.read_n3(spark, f"@prefix rdfs: <{terms.RDFS}> . <A> rdfs:subClassOf <B> . <B> rdfs:subClassOf <C> . <p> rdfs:domain <A> ; rdfs:subPropertyOf <q> .")[0].triples
    facts = Graph(schema.union(spark.createDataFrame([("<x>", "<p>", "<y>"), ("<z>", "<r>", "<y>")], "s string, p string, o string")))
    ground, more = fixpoint.specialise(facts, rulesets.rdfs())
    assert all(a[1] in ("<p>", terms.TYPE) for r in ground for a in r.body) and ("<A>", f"<{terms.RDFS}subClassOf>", "<C>") in more
    out = fixpoint.reason(facts, rulesets.rdfs())
    expected = [("<A>", f"<{terms.RDFS}subClassOf>", "<C>"), ("<x>", "<q>", "<y>"), *[("<x>", terms.TYPE, c) for c in ("<A>", "<B>", "<C>")]]
    assert rows(out.inferred) == sorted(expected)


def test_goal_constants_reach_the_rules():
    rules = rulesets.rules("{ ?x <next> ?y } => { ?x <reach> ?y } . { ?x <reach> ?y . ?y <next> ?z } => { ?x <reach> ?z } .")
    pushed = fixpoint._pushed(rules, [("<a>", "<reach>", "?y")])
    assert [r.head[0][0] for r in pushed] == ["<a>", "<a>"] and pushed[1].body[0][0] == "<a>"
    other_way = fixpoint._pushed(rules, [("?x", "<reach>", "<b>")])
    assert other_way == rules
