"""Command line: load documents, reason, transform, query and write.

    python -m graphloom.cli data.n3 --think --format n3
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import terms
from graphloom.operators import fixpoint, rulesets, transforms
from graphloom.sources import files, n3
from graphloom.sources.graphs import Graph, union


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("inputs", nargs="*")
    p.add_argument("--stdin", action="store_true", help="also read N3 from standard input")
    p.add_argument("--think", action="store_true", help="apply the rules to a fixpoint")
    p.add_argument("--filter", action="store_true", help="write inferred triples only")
    p.add_argument("--filter-rules", nargs="*", default=[], help="apply these rules and keep their conclusions only")
    p.add_argument("--max-steps", type=int, default=10_000)
    p.add_argument("--apply", "--rules", dest="rules", nargs="*", default=[], help="rule files")
    p.add_argument("--data", nargs="*", default=[], help="files whose rules are not taken")
    p.add_argument("--profile", choices=sorted(rulesets.PROFILES), default="default")
    p.add_argument("--schema", action="store_true", help="read schema triples as rules")
    p.add_argument("--patch", nargs=2, metavar=("DELETE", "INSERT"))
    p.add_argument("--diff", metavar="FILE", help="write what FILE adds and removes")
    p.add_argument("--closure", action="store_true", help="follow owl:imports")
    p.add_argument("--smush", action="store_true", help="replace nodes that are the same by one of them")
    for flag in ("reify", "dereify", "purge", "purge-rules", "purge-builtins", "truth", "skolemise", "normalise-iris", "strings", "no"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--sparql", metavar="FILE")
    p.add_argument("--sparql-query", metavar="TEXT")
    p.add_argument("--sparql-results", choices=("xml", "json"), default="json")
    p.add_argument("--query", metavar="FILE", help="a file of N3 rules whose conclusions are the answer")
    p.add_argument("--why", action="store_true", help="write the derivations")
    p.add_argument("--format", choices=("n3", "ntriples", "rdfxml", "jsonld"), default="n3")
    p.add_argument("--output", metavar="FILE")
    p.add_argument("--sparqlServer", type=int, metavar="PORT")
    p.add_argument("--base", default="")
    return p


def load(spark: SparkSession, paths: list[str], base: str, imports: bool) -> tuple[Graph, list[n3.Rule], dict[str, str]]:
    """The documents' triples, rules and prefixes; with ``imports`` those that owl:imports names too, each once."""
    frames, rules, prefixes, seen, todo = [], [], {}, set(), list(paths)
    while todo:
        path = todo.pop(0)
        if path in seen:
            continue
        seen.add(path)
        if path.rsplit(".", 1)[-1] in ("n3", "ttl"):
            graph, doc = files.read_n3(spark, spark.read.text(path, wholetext=True).first()[0], base or path)
            rules += doc.rules
            prefixes |= doc.prefixes
        else:
            graph = files.read_file(spark, path)
        frames.append(graph.triples)
        if imports:
            todo += [r.o[1:-1] for r in graph.scan(p=f"<{terms.OWL}imports>").collect()]
    return Graph(union(frames).distinct()) if frames else Graph.of(spark, []), rules, prefixes


def render(df: DataFrame, how: str, prefixes: dict[str, str]) -> str:
    if how == "ntriples":
        return "".join(f"{r.value}\n" for r in files.ntriples_lines(df).orderBy("value").toLocalIterator())
    return {"n3": lambda: files.to_n3(df, prefixes), "rdfxml": lambda: files.to_rdfxml(df), "jsonld": lambda: files.to_jsonld(df)}[how]()


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    graph, rules, prefixes = load(spark, args.inputs, args.base, args.closure)
    if args.stdin:
        more, doc = files.read_n3(spark, sys.stdin.read(), args.base)
        graph, rules, prefixes = graph.insert(more.triples), rules + doc.rules, prefixes | doc.prefixes
    if args.data:
        graph = graph.insert(load(spark, args.data, args.base, False)[0].triples)
    if args.rules:
        rules += load(spark, args.rules, args.base, False)[1]
    if args.patch:
        deletions, insertions = (load(spark, [p], args.base, False)[0].triples for p in args.patch)
        graph = transforms.patch(graph, deletions, insertions)
    rules += rulesets.PROFILES[args.profile]() + (transforms.schema_rules(graph) if args.schema else [])
    before = graph
    if args.think or args.profile != "default":
        graph = fixpoint.reason(Graph(transforms.purge_rules(graph.triples)), rules, args.max_steps).graph
        if args.why:
            proof = fixpoint.derivations(Graph(transforms.purge_rules(before.triples)), rules, args.max_steps)
            return "\n".join(f"{r.s} {r.p} {r.o} <- {r.rule} {[tuple(x) for x in r.premises]}" for r in proof.orderBy("step", "s", "p", "o").toLocalIterator()) + "\n"
    for path in (args.filter_rules and [args.filter_rules]) or ([[args.query]] if args.query else []):
        asked = load(spark, path, args.base, False)[1]
        graph = Graph(fixpoint.reason(Graph(transforms.purge_rules(graph.triples)), asked, 1 if args.query else args.max_steps).inferred)
    t = graph.triples
    if args.filter:
        t = t.join(before.triples, ["s", "p", "o"], "left_anti")
    steps = (("purge", transforms.purge_chaff), ("purge_rules", transforms.purge_rules), ("purge_builtins", transforms.purge_builtins), ("truth", transforms.truth_filter), ("smush", transforms.smush),
             ("normalise_iris", transforms.normalise_iris), ("skolemise", transforms.skolemise), ("reify", transforms.reify), ("dereify", transforms.dereify))
    for name, step in steps:
        if getattr(args, name):
            t = step(t)
    if args.no:
        return ""
    if args.diff:
        added, removed = transforms.diff(Graph(t), load(spark, [args.diff], args.base, False)[0])
        return "".join(f"{r.value}\n" for r in files.format_diff(added, removed).toLocalIterator())
    text = args.sparql_query or (spark.read.text(args.sparql, wholetext=True).first()[0] if args.sparql else None)
    engine = Engine(Graph(t), prefixes)
    if args.sparqlServer:
        from graphloom.server import make_server

        make_server(engine, args.sparqlServer).serve_forever()
    if text:
        found = engine.sparql(text)
        if found.columns == ["s", "p", "o"]:
            return render(found, args.format, prefixes)
        return files.results_xml(found) if args.sparql_results == "xml" else files.results_json(found)
    if args.strings:
        return "".join(f"{r.value}\n" for r in files.strings(t).orderBy(F.col("value")).toLocalIterator())
    return render(t, args.format, prefixes)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out = run(spark, args)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out)


if __name__ == "__main__":
    main()
