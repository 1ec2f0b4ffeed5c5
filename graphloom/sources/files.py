"""Readers and writers of graphs: N3, Turtle, N-Triples, RDF/XML, KIF, JSON-LD, SPARQL results, dictionary tables."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from xml.sax.saxutils import escape as xml_escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.sources import n3
from graphloom.sources.graphs import TRIPLE, Graph

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> Graph:
    """Line by line in the JVM, split over files: the bulk format. Lines that aren't triples are left out."""
    line = spark.read.text(path).where(F.col("value").rlike(_LINE))
    return Graph(line.select(*[F.regexp_extract("value", _LINE, i + 1).alias(c) for i, c in enumerate("spo")]).distinct())


def read_n3(spark: SparkSession, text: str, base: str = "") -> tuple[Graph, n3.Document]:
    """A document's ground triples as a graph, and the document with its rules. Parsed on the driver: documents of rules
    and schema; bulk data comes as N-Triples."""
    doc = n3.parse(text, base)
    rows = [tuple(map(n3.text_of, t)) for t in doc.triples if not any(isinstance(x, str) and x.startswith("?") for x in t)]
    return Graph(spark.createDataFrame(rows, TRIPLE).distinct()), doc


_RDF_NS = "{" + terms.RDF + "}"
_XML_NS = "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(text: str) -> list[tuple[str, str, str]]:
    """Node and property elements, typed nodes, parseType Resource, Literal and Collection, property attributes."""
    out: list[tuple[str, str, str]] = []
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def name(tag: str) -> str:
        return f"<{tag[1:].replace('}', '', 1)}>"

    def subject(e: ET.Element) -> str:
        if about := e.get(_RDF_NS + "about"):
            return f"<{about}>"
        if rdf_id := e.get(_RDF_NS + "ID"):
            return f"<#{rdf_id}>"
        if node := e.get(_RDF_NS + "nodeID"):
            return f"_:{node}"
        return fresh()

    def node(e: ET.Element) -> str:
        s = subject(e)
        if e.tag != _RDF_NS + "Description":
            out.append((s, terms.TYPE, name(e.tag)))
        for key, v in e.attrib.items():
            if not key.startswith((_RDF_NS, _XML_NS)):
                out.append((s, name(key), terms.literal(v)))
            elif key == _RDF_NS + "type":
                out.append((s, terms.TYPE, f"<{v}>"))
        lang = e.get(_XML_NS + "lang")
        for i, child in enumerate(e):
            prop(s, child, i, lang)
        return s

    def prop(s: str, e: ET.Element, i: int, lang: str | None) -> None:
        p = f"<{terms.RDF}_{i + 1}>" if e.tag == _RDF_NS + "li" else name(e.tag)
        lang = e.get(_XML_NS + "lang", lang)
        how = e.get(_RDF_NS + "parseType")
        if (resource := e.get(_RDF_NS + "resource")) is not None:
            out.append((s, p, f"<{resource}>"))
        elif (ref := e.get(_RDF_NS + "nodeID")) is not None:
            out.append((s, p, f"_:{ref}"))
        elif how == "Resource":
            inner = fresh()
            out.append((s, p, inner))
            for j, child in enumerate(e):
                prop(inner, child, j, lang)
        elif how == "Collection":
            items = [node(child) for child in e]
            head = f"<{terms.RDF}nil>"
            for item in reversed(items):
                cell = fresh()
                out.append((cell, f"<{terms.RDF}first>", item))
                out.append((cell, f"<{terms.RDF}rest>", head))
                head = cell
            out.append((s, p, head))
        elif how == "Literal":
            inner_text = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            out.append((s, p, terms.literal(inner_text, datatype=f"{terms.RDF}XMLLiteral")))
        elif len(e):
            out.append((s, p, node(e[0])))
        else:
            kind = e.get(_RDF_NS + "datatype")
            out.append((s, p, terms.literal(e.text or "", lang=None if kind else lang, datatype=kind)))

    root = ET.fromstring(text)
    for e in root if root.tag == _RDF_NS + "RDF" else [root]:
        node(e)
    return out


def parse_kif(text: str) -> tuple[list[tuple], list[n3.Rule]]:
    """S-expressions: ``=>`` rules; unary atoms as types, binary ones as triples, longer ones as a node with arguments;
    ``or`` is flattened, ``not`` skipped."""
    tokens = re.findall(r'\(|\)|"[^"]*"|[^\s()]+', re.sub(r";[^\n]*", "", text))
    at = 0

    def read():
        nonlocal at
        token = tokens[at]
        at += 1
        if token != "(":
            return token
        items = []
        while tokens[at] != ")":
            items.append(read())
        at += 1
        return items

    count = 0

    def term(t: str) -> str:
        if t.startswith("?"):
            return t
        if t.startswith('"'):
            return terms.literal(t[1:-1])
        if re.fullmatch(r"-?\d+(\.\d+)?", t):
            return terms.literal(t, datatype=terms.XSD_DECIMAL if "." in t else terms.XSD_INTEGER)
        return f"<kif:{t}>"

    def atoms(e) -> list[tuple]:
        nonlocal count
        if not isinstance(e, list) or not e or e[0] == "not":
            return []
        if e[0] in ("and", "or"):
            return [a for x in e[1:] for a in atoms(x)]
        if len(e) == 2:
            return [(term(e[1]), terms.TYPE, term(e[0]))]
        if len(e) == 3:
            return [(term(e[1]), term(e[0]), term(e[2]))]
        count += 1
        node = f"_:k{count}"
        return [(node, terms.TYPE, term(e[0]))] + [(node, f"<kif:arg{i}>", term(x)) for i, x in enumerate(e[1:], 1)]

    triples, rules = [], []
    while at < len(tokens):
        e = read()
        if isinstance(e, list) and e and e[0] == "=>":
            rules.append(n3.Rule(tuple(atoms(e[1])), tuple(atoms(e[2])), f"k{len(rules)}"))
        elif isinstance(e, list) and e and e[0] == "<=>":
            rules.append(n3.Rule(tuple(atoms(e[1])), tuple(atoms(e[2])), f"k{len(rules)}"))
            rules.append(n3.Rule(tuple(atoms(e[2])), tuple(atoms(e[1])), f"k{len(rules)}"))
        else:
            triples.extend(atoms(e))
    return triples, rules


def read_file(spark: SparkSession, path: str) -> Graph:
    """By extension: .nt in bulk, .n3 and .ttl, .rdf and .xml, .kif, .parquet. Read by Spark, from wherever it reads."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "nt":
        return read_ntriples(spark, path)
    if ending == "parquet":
        return Graph.load(spark, path)
    text = spark.read.text(path, wholetext=True).first()[0]
    if ending in ("n3", "ttl"):
        return read_n3(spark, text, path)[0]
    if ending in ("rdf", "xml", "owl"):
        return Graph.of(spark, parse_rdfxml(text))
    if ending == "kif":
        return Graph.of(spark, parse_kif(text)[0])
    raise ValueError(f"unknown format .{ending}")


# sinks
def ntriples_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One line for each triple, written by all tasks."""
    ntriples_lines(triples).write.mode("overwrite").text(path)


def strings(triples: DataFrame) -> DataFrame:
    """The values of literal objects."""
    return triples.where(terms.is_literal(F.col("o"))).select(terms.value(F.col("o")).alias("value"))


def _short(t: str, prefixes: dict[str, str]) -> str:
    if t == terms.TYPE:
        return "a"
    if t.startswith("<"):
        for name, base in prefixes.items():
            local = t[1:-1].removeprefix(base)
            if local != t[1:-1] and re.fullmatch(r"[A-Za-z_]\w*", local):
                return f"{name}:{local}"
    return t


def format_n3(rows: Iterable[tuple[str, str, str]], prefixes: dict[str, str] | None = None) -> str:
    """Prefixes, then each subject with its properties; rows must come sorted by subject and predicate."""
    prefixes = prefixes or {}
    out = [f"@prefix {name}: <{base}> ." for name, base in sorted(prefixes.items())]
    last = None
    for s, p, o in rows:
        p_text, o_text = _short(p, prefixes), _short(o, prefixes)
        if last and last[0] == s and last[1] == p:
            out[-1] += f" , {o_text}"
        elif last and last[0] == s:
            out[-1] += f" ;\n    {p_text} {o_text}"
        else:
            if last:
                out[-1] += " ."
            out.append(f"{_short(s, prefixes)} {p_text} {o_text}")
        last = s, p
    if last:
        out[-1] += " ."
    return "\n".join(out) + "\n"


def _sorted_rows(triples: DataFrame) -> Iterable[tuple[str, str, str]]:
    return (tuple(r) for r in triples.select("s", "p", "o").orderBy("s", "p", "o").toLocalIterator())


def to_n3(triples: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    return format_n3(_sorted_rows(triples), prefixes)


def to_rdfxml(triples: DataFrame) -> str:
    """Grouped by subject."""
    out = ['<?xml version="1.0" encoding="utf-8"?>', f'<rdf:RDF xmlns:rdf="{terms.RDF}">']
    last = None
    for s, p, o in _sorted_rows(triples):
        if s != last:
            if last is not None:
                out.append("  </rdf:Description>")
            about = f'rdf:about="{xml_escape(s[1:-1])}"' if s.startswith("<") else f'rdf:nodeID="{s[2:]}"'
            out.append(f"  <rdf:Description {about}>")
            last = s
        base, local = re.fullmatch(r"<(.*?)([A-Za-z_][\w.-]*)>", p).groups()
        tag = f'ns:{local} xmlns:ns="{xml_escape(base)}"'
        if o.startswith("<"):
            out.append(f'    <{tag} rdf:resource="{xml_escape(o[1:-1])}"/>')
        elif o.startswith("_:"):
            out.append(f'    <{tag} rdf:nodeID="{o[2:]}"/>')
        else:
            text, extra = python_literal(o)
            mark = f' rdf:datatype="{extra[2:]}"' if extra.startswith("^^") else f' xml:lang="{extra[1:]}"' if extra else ""
            out.append(f"    <{tag}{mark}>{xml_escape(text)}</ns:{local}>")
    if last is not None:
        out.append("  </rdf:Description>")
    return "\n".join([*out, "</rdf:RDF>", ""])


def python_literal(o: str) -> tuple[str, str]:
    """A literal's value and what follows the quotes: nothing, @lang, or ^^datatype."""
    end = o.rindex('"')
    mark = o[end + 1 :]
    return terms.unescape(o[1:end]), "^^" + mark[3:-1] if mark.startswith("^^") else mark


def to_jsonld(triples: DataFrame, context: dict[str, str] | None = None) -> str:
    """@context and @graph, an object for each subject."""
    graph: dict[str, dict] = {}
    for s, p, o in _sorted_rows(triples):
        node = graph.setdefault(s, {"@id": s[1:-1] if s.startswith("<") else s})
        if p == terms.TYPE:
            node.setdefault("@type", []).append(o[1:-1])
            continue
        if o.startswith('"'):
            text, mark = python_literal(o)
            value = {"@value": text, "@type": mark[2:]} if mark.startswith("^^") else {"@value": text, "@language": mark[1:]} if mark else text
        else:
            value = {"@id": o[1:-1] if o.startswith("<") else o}
        node.setdefault(p[1:-1], []).append(value)
    return json.dumps({"@context": context or {}, "@graph": list(graph.values())}, indent=2, ensure_ascii=False)


def _cell(t: str) -> dict:
    if t.startswith("<"):
        return {"type": "uri", "value": t[1:-1]}
    if t.startswith("_:"):
        return {"type": "bnode", "value": t[2:]}
    text, mark = python_literal(t)
    return {"type": "literal", "value": text} | ({"datatype": mark[2:]} if mark.startswith("^^") else {"xml:lang": mark[1:]} if mark else {})


def results_json(df: DataFrame) -> str:
    """SPARQL results in JSON; unbound variables are absent."""
    if df.columns == ["ask"]:
        return json.dumps({"head": {}, "boolean": df.first()[0]})
    rows = [{v: _cell(r[v]) for v in df.columns if r[v] is not None} for r in df.toLocalIterator()]
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}}, ensure_ascii=False)


def results_xml(df: DataFrame) -> str:
    head = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n'
    if df.columns == ["ask"]:
        return f"{head}<head/>\n<boolean>{str(df.first()[0]).lower()}</boolean>\n</sparql>\n"
    out = [head + "<head>" + "".join(f'<variable name="{v}"/>' for v in df.columns) + "</head>", "<results>"]
    for r in df.toLocalIterator():
        cells = []
        for v in df.columns:
            if r[v] is not None:
                c = _cell(r[v])
                mark = f' datatype="{c["datatype"]}"' if "datatype" in c else f' xml:lang="{c["xml:lang"]}"' if "xml:lang" in c else ""
                cells.append(f'<binding name="{v}"><{c["type"]}{mark}>{xml_escape(c["value"])}</{c["type"]}></binding>')
        out.append("<result>" + "".join(cells) + "</result>")
    return "\n".join([*out, "</results>", "</sparql>", ""])


def format_diff(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Lines with + or - before each triple."""
    line = lambda df, mark: df.select(F.concat_ws(" ", F.lit(mark), "s", "p", "o", F.lit(".")).alias("value"))
    return line(added, "+").union(line(removed, "-"))


# dictionary tables
def write_dictionary(graph: Graph, path: str) -> None:
    """Terms with numbers, and triples of numbers: ``terms`` (id, kind, value) and ``triples`` (s_id, p_id, o_id). A
    term's number is the hash of its text, so no task needs to see all terms; a clash of hashes raises."""
    t = graph.triples
    every = t.select(F.col("s").alias("value")).union(t.select("p")).union(t.select("o")).distinct()
    numbered = every.select(F.xxhash64("value").alias("id"), terms.kind(F.col("value")).alias("kind"), "value")
    if not numbered.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("two terms share a hash")
    numbered.write.mode("overwrite").parquet(f"{path}/terms")
    t.select(*[F.xxhash64(c).alias(f"{c}_id") for c in "spo"]).write.mode("overwrite").parquet(f"{path}/triples")


def read_dictionary(spark: SparkSession, path: str) -> Graph:
    names, t = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/triples")
    for c in "spo":
        t = t.join(names.select(F.col("id").alias(f"{c}_id"), F.col("value").alias(c)), f"{c}_id")
    return Graph(t)
