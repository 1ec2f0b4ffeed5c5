"""A hand-written parser of SPARQL queries and updates."""

from __future__ import annotations

import re

from graphloom.functions import terms
from graphloom.plans.algebra import Aggregate, Expr, Group, Path, Query, Update

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$][A-Za-z_]\w*)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<blank>_:[A-Za-z0-9_][\w.-]*)
    |(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*:(?:[\w%](?:[\w.%-]*[\w%-])?)?|:(?:[\w%](?:[\w.%-]*[\w%-])?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*/|^+?-])""",
    re.X,
)
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class SparqlError(ValueError):
    """The text is not SPARQL this parser knows."""


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0
        self.base = ""
        self.prefixes = {"rdf": terms.RDF, "rdfs": terms.RDFS, "owl": terms.OWL, "xsd": terms.XSD, "log": terms.LOG} | (prefixes or {})
        self.fresh = 0

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in words

    def word(self, *words: str) -> str | None:
        return self.take()[1].upper() if self.is_word(*words) else None

    def is_op(self, *ops: str) -> bool:
        return self.peek()[0] == "op" and self.peek()[1] in ops

    def op(self, *ops: str) -> str | None:
        return self.take()[1] if self.is_op(*ops) else None

    def expect(self, what: str) -> str:
        token = self.take()
        if token[1].upper() != what:
            raise SparqlError(f"expected {what}, found {token[1]!r}")
        return token[1]

    # terms
    def resolve(self, kind: str, text: str) -> str:
        if kind == "iri":
            inner = text[1:-1]
            return f"<{inner if re.match('[A-Za-z][A-Za-z0-9+.-]*:', inner) else self.base + inner}>"
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix {prefix}:")
        return f"<{self.prefixes[prefix]}{local}>"

    def term(self) -> str:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return self.resolve(kind, text)
        if kind == "var":
            return "?" + text[1:]
        if kind == "blank":
            return "?__b_" + text[2:]
        if kind == "string":
            long = text[:3] in ('"""', "'''")
            value = terms.unescape(text[3:-3] if long else text[1:-1])
            if self.peek()[0] == "lang":
                return terms.literal(value, lang=self.take()[1][1:])
            if self.op("^^"):
                return terms.literal(value, datatype=self.resolve(*self.take())[1:-1])
            return terms.literal(value)
        sign = ""
        if kind == "op" and text in "+-":
            sign, (kind, text) = ("-" if text == "-" else ""), self.take()
        if kind == "number":
            kind_iri = terms.XSD_DOUBLE if "e" in text.lower() else terms.XSD_DECIMAL if "." in text else terms.XSD_INTEGER
            return terms.literal(sign + text, datatype=kind_iri)
        if kind == "word" and text in ("true", "false"):
            return terms.literal(text == "true")
        if kind == "op" and text == "[" and self.op("]"):
            self.fresh += 1
            return f"?__b{self.fresh}"
        raise SparqlError(f"expected a term, found {text!r}")

    # paths
    def verb(self):
        if self.peek()[0] == "var":
            return self.term()
        path = self.path()
        return path.args[0] if path.op == "pred" else path

    def path(self) -> Path:
        parts = [self.sequence()]
        while self.op("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def sequence(self) -> Path:
        parts = [self.step()]
        while self.op("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def step(self) -> Path:
        if self.op("^"):
            return Path("inv", (self.step(),))
        if self.op("!"):
            if not self.op("("):
                return Path("neg", (self.predicate(),))
            names = [self.predicate()]
            while self.op("|"):
                names.append(self.predicate())
            self.expect(")")
            return Path("neg", tuple(names))
        if self.op("("):
            out = self.path()
            self.expect(")")
        else:
            out = Path("pred", (self.predicate(),))
        mark = self.op("*", "+", "?")
        return Path({"*": "star", "+": "plus", "?": "opt"}[mark], (out,)) if mark else out

    def predicate(self) -> str:
        if self.peek() == ("word", "a"):
            self.take()
            return terms.TYPE
        return self.term()

    # patterns
    def triples(self, end: tuple[str, ...] = ("}",)) -> list[tuple]:
        out = []
        while not self.is_op(*end) and not self.is_word("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE", "UNION") and not self.is_op("{"):
            subject = self.term()
            while True:
                verb = self.verb()
                out.append((subject, verb, self.term()))
                while self.op(","):
                    out.append((subject, verb, self.term()))
                if not self.op(";"):
                    break
                while self.op(";"):
                    pass
                if self.is_op(".", "}"):
                    break
            if not self.op("."):
                break
        return out

    def group(self) -> Group:
        self.expect("{")
        if self.is_word("SELECT"):
            query = self.select()
            self.expect("}")
            return Group([("select", query)])
        out: list[tuple] = []
        while not self.op("}"):
            if self.word("FILTER"):
                out.append(("filter", self.primary()))
            elif self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                out.append(("bind", e, self.term()[1:]))
                self.expect(")")
            elif self.word("VALUES"):
                out.append(self.values())
            elif self.word("GRAPH"):
                out.append(("graph", self.term(), self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                out.append(("service", self.term(), self.group(), silent))
            elif self.is_op("{"):
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            elif self.op("."):
                pass
            else:
                before = self.at
                found = self.triples()
                if self.at == before:
                    raise SparqlError(f"unexpected {self.peek()[1]!r}")
                if out and out[-1][0] == "bgp":
                    out[-1][1].extend(found)
                else:
                    out.append(("bgp", found))
        return Group(out)

    def values(self) -> tuple:
        if self.op("("):
            names = []
            while not self.op(")"):
                names.append(self.term()[1:])
            many = True
        else:
            names, many = [self.term()[1:]], False
        self.expect("{")
        rows = []
        while not self.op("}"):
            row = []
            if many:
                self.expect("(")
            while True:
                if many and self.op(")"):
                    break
                row.append(None if self.word("UNDEF") else self.term())
                if not many:
                    break
            if len(row) != len(names):
                raise SparqlError("VALUES: a row of another length")
            rows.append(tuple(row))
        return ("values", names, rows)

    # expressions
    def expression(self) -> Expr:
        left = self.conjunction()
        while self.op("||"):
            left = Expr("or", [left, self.conjunction()])
        return left

    def conjunction(self) -> Expr:
        left = self.relation()
        while self.op("&&"):
            left = Expr("and", [left, self.relation()])
        return left

    def relation(self) -> Expr:
        left = self.sum()
        if op := self.op("=", "!=", "<", ">", "<=", ">="):
            return Expr(op, [left, self.sum()])
        negated = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.take()
        if self.word("IN"):
            self.expect("(")
            items = []
            while not self.op(")"):
                items.append(self.expression())
                self.op(",")
            found = Expr("in", [left, *items])
            return Expr("not", [found]) if negated else found
        return left

    def sum(self) -> Expr:
        left = self.product()
        while op := self.op("+", "-"):
            left = Expr(op, [left, self.product()])
        return left

    def product(self) -> Expr:
        left = self.unary()
        while op := self.op("*", "/"):
            left = Expr(op, [left, self.unary()])
        return left

    def unary(self) -> Expr:
        if self.op("!"):
            return Expr("not", [self.unary()])
        if self.op("-"):
            return Expr("neg", [self.unary()])
        self.op("+")
        return self.primary()

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.expect(")")
            return e
        kind, text = self.peek()
        if kind == "word" and text not in ("true", "false"):
            name = self.take()[1].upper()
            if name in _AGGREGATES:
                return Expr("aggregate", [self.aggregate(name)])
            if name == "NOT":
                self.expect("EXISTS")
                return Expr("not", [Expr("exists", [self.group()])])
            if name == "EXISTS":
                return Expr("exists", [self.group()])
            return Expr("call", [name, *self.arguments()])
        if kind in ("iri", "name"):
            name = self.term()
            return Expr("call", [name, *self.arguments()]) if self.is_op("(") else Expr("const", [name])
        t = self.term()
        return Expr("var", [t[1:]]) if t.startswith("?") else Expr("const", [t])

    def arguments(self) -> list[Expr]:
        self.expect("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            self.op(",")
        return out

    def aggregate(self, name: str) -> Aggregate:
        self.expect("(")
        distinct = bool(self.word("DISTINCT"))
        arg = None if self.op("*") else self.expression()
        separator = " "
        if self.op(";"):
            self.expect("SEPARATOR")
            self.expect("=")
            separator = terms.unescape(self.take()[1][1:-1])
        self.expect(")")
        return Aggregate(name, arg, distinct, separator)

    # queries
    def prologue(self) -> None:
        while self.is_word("PREFIX", "BASE"):
            if self.word("BASE"):
                self.base = self.take()[1][1:-1]
            else:
                self.take()
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.resolve(*self.take())[1:-1]

    def query(self) -> Query:
        self.prologue()
        if self.is_word("SELECT"):
            out = self.select()
        elif self.word("ASK"):
            self.word("WHERE")
            out = Query("ask", self.group())
        elif self.word("CONSTRUCT"):
            self.expect("{")
            template = self.triples()
            self.expect("}")
            self.word("WHERE")
            out = Query("construct", self.group(), template=template)
            self.modifiers(out)
        elif self.word("DESCRIBE"):
            resources = []
            while self.peek()[0] in ("iri", "name", "var"):
                resources.append(self.term())
            self.word("WHERE")
            out = Query("describe", self.group() if self.is_op("{") else Group([]), resources=resources)
        else:
            raise SparqlError(f"unknown query form {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def select(self) -> Query:
        self.expect("SELECT")
        distinct = self.word("DISTINCT", "REDUCED") == "DISTINCT"
        variables: list | None = []
        if self.op("*"):
            variables = None
        else:
            while self.peek()[0] == "var" or self.is_op("(") or (self.is_word(*_AGGREGATES)):
                if self.op("("):
                    e = self.expression()
                    self.expect("AS")
                    variables.append((self.term()[1:], e))
                    self.expect(")")
                elif self.peek()[0] == "var":
                    variables.append((self.term()[1:], None))
                else:
                    name = self.take()[1].upper()
                    variables.append((name.lower(), Expr("aggregate", [self.aggregate(name)])))
        self.word("WHERE")
        out = Query("select", self.group(), variables, distinct)
        self.modifiers(out)
        return out

    def modifiers(self, out: Query) -> None:
        while True:
            if self.word("GROUP"):
                self.expect("BY")
                while self.peek()[0] == "var" or self.is_op("("):
                    if self.op("("):
                        e = self.expression()
                        name = self.term()[1:] if self.word("AS") else None
                        self.expect(")")
                        out.group_by.append((name, e))
                    else:
                        v = self.term()[1:]
                        out.group_by.append((v, Expr("var", [v])))
            elif self.word("HAVING"):
                while self.is_op("(") or (self.peek()[0] == "word" and self.peek(1)[1] == "(" and not self.is_word("ORDER", "LIMIT", "OFFSET")):
                    out.having.append(self.primary())
            elif self.word("ORDER"):
                self.expect("BY")
                while self.peek()[0] == "var" or self.is_op("(") or self.is_word("ASC", "DESC"):
                    down = self.word("ASC", "DESC") == "DESC"
                    out.order.append((self.primary(), down))
            elif self.word("LIMIT"):
                out.limit = int(self.take()[1])
            elif self.word("OFFSET"):
                out.offset = int(self.take()[1])
            elif self.is_word("VALUES"):
                self.take()
                out.where = Group([("group", out.where), self.values()])
            else:
                return

    # updates
    def quads(self, graph: str | None = None) -> list[tuple]:
        self.expect("{")
        out: list[tuple] = []
        while not self.op("}"):
            if self.word("GRAPH"):
                name = self.term()
                out.extend(self.quads(name))
            elif not self.op("."):
                out.extend((graph, *t) for t in self.triples())
        return out

    def updates(self) -> list[Update]:
        out = []
        while self.peek()[0] != "end":
            self.prologue()
            graph = self.term() if self.word("WITH") else None
            word = self.word("INSERT", "DELETE", "CLEAR", "DROP", "CREATE", "LOAD")
            if word in ("INSERT", "DELETE") and self.word("DATA"):
                quads = [tuple(_ground(t) for t in q) for q in self.quads()]
                out.append(Update(f"{word.lower()}_data", **{word.lower(): quads}))
            elif word in ("INSERT", "DELETE"):
                change = Update("modify", graph=graph)
                if word == "DELETE":
                    if self.word("WHERE"):
                        change.delete = self.quads()
                        change.where = Group([("bgp", [q[1:] for q in change.delete])])
                        out.append(change)
                        self.op(";")
                        continue
                    change.delete = self.quads()
                    if self.word("INSERT"):
                        change.insert = self.quads()
                else:
                    change.insert = self.quads()
                self.expect("WHERE")
                change.where = self.group()
                out.append(change)
            elif word in ("CLEAR", "DROP", "CREATE"):
                silent = bool(self.word("SILENT"))
                named = self.word("DEFAULT", "NAMED", "ALL")
                if not named:
                    self.word("GRAPH")
                    named = self.term()
                out.append(Update(word.lower(), target=named, silent=silent))
            elif word == "LOAD":
                silent = bool(self.word("SILENT"))
                source = self.term()
                into = None
                if self.word("INTO"):
                    self.expect("GRAPH")
                    into = self.term()
                out.append(Update("load", target=source, graph=into, silent=silent))
            else:
                raise SparqlError(f"unknown update {self.peek()[1]!r}")
            self.op(";")
        return out


def _ground(t: str | None) -> str | None:
    if t is None or not t.startswith("?"):
        return t
    if t.startswith("?__b"):
        return "_:" + t[4:].lstrip("_")
    raise SparqlError("a variable in ground data")


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[Update]:
    return Parser(text, prefixes).updates()
