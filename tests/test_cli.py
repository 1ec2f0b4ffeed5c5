"""The command line over small documents."""

import json

import pytest

from graphloom import cli

RULES = "@prefix : <http://e/> . :a :p :b . :b :p :c . :a :n \"x\" . { ?x :p ?y . ?y :p ?z } => { ?x :p ?z } ."


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = tmp_path_factory.mktemp("docs")
    (out / "d.n3").write_text(RULES)
    (out / "q.n3").write_text("@prefix : <http://e/> . { ?x :p ?y } => { ?y :back ?x } .")
    (out / "e.nt").write_text("<http://e/a> <http://e/p> <http://e/z> .\n")
    return out


def run(spark, *argv):
    return cli.run(spark, cli.parser().parse_args(list(map(str, argv))))


def test_reasoning(spark, path):
    d = path / "d.n3"
    assert run(spark, d, "--think", "--filter", "--format", "ntriples") == "<http://e/a> <http://e/p> <http://e/c> .\n"
    assert ":a :n \"x\" ;\n    :p :b , :c ." in run(spark, d, "--think", "--purge-rules")
    assert "r0" in run(spark, d, "--think", "--why")
    assert run(spark, d, "--query", path / "q.n3", "--format", "ntriples").count("back") == 2
    assert run(spark, d, "--strings") == "x\n"
    assert run(spark, d, "--no") == ""


def test_queries_and_diff(spark, path):
    d = path / "d.n3"
    found = json.loads(run(spark, d, "--sparql-query", "SELECT ?x WHERE { <http://e/a> <http://e/p> ?x }"))
    assert found["results"]["bindings"] == [{"x": {"type": "uri", "value": "http://e/b"}}]
    assert "<boolean>true</boolean>" in run(spark, d, "--sparql-query", "ASK { ?x <http://e/n> 'x' }", "--sparql-results", "xml")
    assert "+ <http://e/a> <http://e/p> <http://e/z> ." in run(spark, d, "--purge-rules", "--diff", path / "e.nt")
    assert run(spark, d, path / "e.nt", "--purge-rules", "--format", "ntriples").count("\n") == 4
