"""A parser of N3, Turtle and N-Triples documents: triples, quoted formulas, lists, rules and prefixes."""

from __future__ import annotations

import dataclasses
import re
from urllib.parse import urljoin

from graphloom.functions import terms

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@(?:prefix|base|forAll|forSome|keywords)\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>\?[A-Za-z_]\w*)
    |(?P<blank>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<op><=>|=>|<=|\^\^|[{}()\[\].;,=!^])
    |(?P<name>(?:[A-Za-z_][\w-]*(?:\.[\w-]+)*)?:(?:[\w%](?:[\w.%-]*[\w%-])?)?)
    |(?P<word>[A-Za-z_][\w-]*)""",
    re.X | re.S,
)
IMPLIES = f"<{terms.LOG}implies>"
IMPLIED_BY = f"<{terms.LOG}impliedBy>"
SAME_AS = f"<{terms.OWL}sameAs>"


class N3Error(ValueError):
    """The text is not N3."""


@dataclasses.dataclass(frozen=True)
class Formula:
    triples: tuple[tuple, ...]


@dataclasses.dataclass(frozen=True)
class ListTerm:
    items: tuple


@dataclasses.dataclass(frozen=True)
class Rule:
    """{body} => {head}; variables are ``?name``, lists and formulas their dataclasses."""

    body: tuple[tuple, ...]
    head: tuple[tuple, ...]
    name: str = ""


@dataclasses.dataclass
class Document:
    triples: list[tuple]
    rules: list[Rule]
    prefixes: dict[str, str]


def text_of(t) -> str:
    """A term as canonical text; lists as ``(..)`` and formulas as ``{..}``."""
    if isinstance(t, ListTerm):
        return "(" + " ".join(map(text_of, t.items)) + ")"
    if isinstance(t, Formula):
        return "{" + " ".join(f"{text_of(s)} {text_of(p)} {text_of(o)} ." for s, p, o in t.triples) + "}"
    return t


class Parser:
    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise N3Error(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.base, self.scope, self.fresh = 0, base, scope, 0
        self.prefixes: dict[str, str] = {}
        self.universal: set[str] = set()
        self.existential: dict[str, str] = {}
        self.keywords: set[str] | None = None
        self.stack: list[list[tuple]] = [[]]

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def op(self, *ops: str) -> str | None:
        return self.take()[1] if self.peek()[0] == "op" and self.peek()[1] in ops else None

    def expect(self, op: str) -> None:
        if not self.op(op):
            raise N3Error(f"expected {op}, found {self.peek()[1]!r}")

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}b{self.fresh}"

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            inner = terms.unescape(text[1:-1])
            return f"<{inner if not self.base or re.match('[A-Za-z][A-Za-z0-9+.-]*:', inner) else urljoin(self.base, inner)}>"
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            if prefix:
                raise N3Error(f"unknown prefix {prefix}:")
            return f"<{self.base}#{local}>"
        return f"<{self.prefixes[prefix]}{local}>"

    def document(self) -> Document:
        while self.peek()[0] != "end":
            self.statement()
        rules = [
            Rule(s.triples, o.triples, f"r{i}")
            for i, (s, o) in enumerate((s, o) for s, p, o in self.stack[0] if p == IMPLIES and isinstance(s, Formula) and isinstance(o, Formula))
        ]
        return Document(self.stack[0], rules, self.prefixes)

    def statement(self) -> None:
        kind, text = self.peek()
        word = text.lstrip("@").upper() if kind in ("directive", "word") else ""
        if word in ("PREFIX", "BASE") and (kind == "directive" or text.upper() == text):
            self.take()
            if word == "PREFIX":
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.iri(*self.take())[1:-1]
            else:
                self.base = self.iri(*self.take())[1:-1]
            if kind == "directive":
                self.expect(".")
            return
        if kind == "directive":
            self.take()
            names = []
            while not self.op("."):
                t = self.take()
                if t[1] != ",":
                    names.append(t)
            if text == "@keywords":
                self.keywords = {n for _, n in names}
            elif text == "@forAll":
                self.universal |= {self.iri(*n) for n in names}
            else:
                self.existential |= {self.iri(*n): self.blank() for n in names}
            return
        self.triples()
        if not self.op(".") and self.peek()[0] != "end" and self.peek()[1] != "}":
            raise N3Error(f"expected ., found {self.peek()[1]!r}")

    def triples(self) -> None:
        subject = self.expression()
        self.properties(subject)

    def properties(self, subject) -> None:
        while self.peek()[1] not in (".", "}", "]", "") or self.peek()[0] == "string":
            verb, backwards = self.verb()
            while True:
                o = self.expression()
                self.stack[-1].append((o, verb, subject) if backwards else (subject, verb, o))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass

    def verb(self) -> tuple:
        if self.op("=>"):
            return IMPLIES, False
        if self.op("<="):
            return IMPLIED_BY, False
        if self.op("="):
            return SAME_AS, False
        kind, text = self.peek()
        if kind == "word" and text == "a" and (self.keywords is None or "a" in self.keywords):
            self.take()
            return terms.TYPE, False
        if kind == "word" and text == "has":
            self.take()
            return self.expression(), False
        if kind == "word" and text == "is":
            self.take()
            verb = self.expression()
            self.take()  # of
            return verb, True
        return self.expression(), False

    def expression(self):
        out = self.term()
        while mark := self.op("!", "^"):
            node, verb = self.blank(), self.term()
            if len(self.stack) > 1:
                node = "?" + node[2:]  # inside a formula what stands between is a variable
            self.stack[-1].append((out, verb, node) if mark == "!" else (node, verb, out))
            out = node
        return out

    def term(self):
        kind, text = self.take()
        if kind in ("iri", "name"):
            found = self.iri(kind, text)
            if found in self.universal:
                return "?" + re.sub(r"\W", "_", found[1:-1].rsplit("#", 1)[-1].rsplit("/", 1)[-1])
            return self.existential.get(found, found)
        if kind == "var":
            return text
        if kind == "blank":
            # a blank node in a formula is a variable of it
            return ("?__" + text[2:].replace(".", "_").replace("-", "_")) if len(self.stack) > 1 else f"_:{self.scope}{text[2:]}"
        if kind == "string":
            value = terms.unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return terms.literal(value, lang=self.take()[1][1:])
            if self.op("^^"):
                return terms.literal(value, datatype=self.iri(*self.take())[1:-1])
            return terms.literal(value)
        if kind == "number":
            how = terms.XSD_DOUBLE if "e" in text.lower() else terms.XSD_DECIMAL if "." in text else terms.XSD_INTEGER
            return terms.literal(text, datatype=how)
        if kind == "word" and text in ("true", "false"):
            return terms.literal(text == "true")
        if kind == "word" and self.keywords is not None:
            return self.iri("name", ":" + text)
        if (kind, text) == ("op", "{"):
            self.stack.append([])
            while not self.op("}"):
                self.statement() if self.peek()[0] == "directive" else self.triples()
                self.op(".")
            return Formula(tuple(self.stack.pop()))
        if (kind, text) == ("op", "("):
            items = []
            while not self.op(")"):
                items.append(self.expression())
            return ListTerm(tuple(items))
        if (kind, text) == ("op", "["):
            node = self.blank()
            if len(self.stack) > 1:
                node = "?" + node[2:]
            self.properties(node)
            self.expect("]")
            return node
        raise N3Error(f"expected a term, found {text!r}")


def parse(text: str, base: str = "", scope: str = "") -> Document:
    return Parser(text, base, scope).document()
