"""RDF terms as canonical N-Triples text, and Column functions over them.

``<iri>``, ``_:label``, ``"value"``, ``"value"@lang``, ``"value"^^<datatype>``: equality of the text is equality of the
term, so every join on a term is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
LOG = "http://www.w3.org/2000/10/swap/log#"
TYPE = f"<{RDF}type>"
XSD_INTEGER, XSD_DECIMAL, XSD_DOUBLE, XSD_BOOLEAN = (f"{XSD}{n}" for n in ("integer", "decimal", "double", "boolean"))

_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape(text: str) -> str:
    for raw, coded in _ESCAPES:
        text = text.replace(raw, coded)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    while i < len(text):
        if text[i] != "\\" or i + 1 == len(text):
            out.append(text[i])
            i += 1
        elif text[i + 1] in "uU":
            size = 4 if text[i + 1] == "u" else 8
            out.append(chr(int(text[i + 2 : i + 2 + size], 16)))
            i += 2 + size
        else:
            out.append(plain.get(text[i + 1], text[i + 1]))
            i += 2
    return "".join(out)


def iri(value: str) -> str:
    return f"<{value}>"


def literal(value: object, lang: str | None = None, datatype: str | None = None) -> str:
    """The canonical text of a Python value; a datatype is inferred for numbers and booleans."""
    if isinstance(value, bool):
        value, datatype = str(value).lower(), datatype or XSD_BOOLEAN
    elif isinstance(value, int):
        datatype = datatype or XSD_INTEGER
    elif isinstance(value, float):
        datatype = datatype or XSD_DOUBLE
    text = f'"{escape(str(value))}"'
    return f"{text}@{lang}" if lang else f"{text}^^<{datatype}>" if datatype and datatype != f"{XSD}string" else text


def is_iri(c: Column) -> Column:
    return c.startswith("<")


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def kind(c: Column) -> Column:
    """uri, bnode, literal, list or formula."""
    return F.when(is_iri(c), "uri").when(is_blank(c), "bnode").when(is_literal(c), "literal").when(c.startswith("("), "list").when(c.startswith("{"), "formula")


def _unescaped(c: Column) -> Column:
    # a backslash itself is hidden from the other escapes while they are undone
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for raw, coded in _ESCAPES[1:]:
        out = F.replace(out, F.lit(coded), F.lit(raw))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def value(c: Column) -> Column:
    """The lexical form of a literal, the string of an IRI, the label of a blank node."""
    inner = F.regexp_replace(c, r'(?s)^(?:"(.*)"[^"]*|<(.*)>|_:(.*))$', "$1$2$3")
    # most terms need no regular expression
    enclosed = (c.startswith("<") & c.endswith(">")) | (c.startswith('"') & c.endswith('"') & (F.length(c) > 1))
    inner = F.when(enclosed, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(inner)
    return F.when(F.contains(c, F.lit("\\")), _unescaped(inner)).otherwise(inner)


def language(c: Column) -> Column:
    """The language tag of a literal, or the empty string."""
    return F.when(is_literal(c), F.regexp_extract(c, '"@([A-Za-z0-9-]+)$', 1))


def datatype(c: Column) -> Column:
    """The datatype IRI of a literal."""
    found = F.nullif(F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    return F.when(is_literal(c), F.coalesce(found, F.when(c.rlike('"@[A-Za-z0-9-]+$'), f"{RDF}langString").otherwise(f"{XSD}string")))


def number(c: Column) -> Column:
    """The number a literal's lexical form stands for, whatever its datatype; null if none."""
    return F.regexp_extract(c, r'^"([^"\\]*)"', 1).try_cast("double")


def plain(c: Column) -> Column:
    """A plain literal of a string column."""
    text = c
    for raw, coded in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    text = F.when(c.rlike(r'[\\"\n\r\t]'), text).otherwise(c)
    return F.concat(F.lit('"'), text, F.lit('"'))


def typed(c: Column, datatype_iri: str) -> Column:
    """A typed literal of a column whose text has nothing to escape."""
    return F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{datatype_iri}>'))


def num_to_lex(x: Column) -> Column:
    """A double as shortest decimal text without an exponent: 5, 0.0000001."""
    def of(v: Column) -> Column:
        text = v.cast("string")
        trim = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
        return (
            F.when(F.rint(v) == v, text.try_cast("decimal(38,0)").cast("string"))
            .when(~F.contains(text, F.lit("E")), text)
            .when(F.abs(v) < 1, trim(text.try_cast("decimal(38,30)")))
            .otherwise(trim(text.try_cast("decimal(38,17)")))
        )

    return F.get(F.transform(F.array(x), of), F.lit(0))  # x is evaluated once


def decimal(x: Column) -> Column:
    return typed(num_to_lex(x), XSD_DECIMAL)


def integer(x: Column) -> Column:
    return typed(x.cast("bigint"), XSD_INTEGER)
