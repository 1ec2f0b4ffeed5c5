"""Plain-language faces: questions by template to patterns, rules and proofs to sentences."""

from __future__ import annotations

import re

from graphloom.sources.n3 import Rule, text_of


def _name(t) -> str:
    text = text_of(t)
    if text.startswith("?"):
        return text[1:]
    if text.startswith('"'):
        return text[1 : text.rindex('"')]
    return re.sub(r"([a-z])([A-Z])", r"\1 \2", re.split(r"[#/:]", text.strip("<>"))[-1]).replace("_", " ")


def verbalise(rule: Rule) -> str:
    say = lambda ts: " and ".join(f"{_name(s)} {'is a' if 'type>' in text_of(p) else _name(p)} {_name(o)}" for s, p, o in ts)
    return f"If {say(rule.body)}, then {say(rule.head)}."


def verbalise_proof(steps: list[tuple]) -> str:
    """Rows of ``fixpoint.why`` as lines."""
    out = []
    for depth, s, p, o, rule, premises in steps:
        because = "; ".join(f"{_name(a)} {_name(b)} {_name(c)}" for a, b, c in premises)
        out.append(f"{'  ' * depth}{_name(s)} {_name(p)} {_name(o)}, by {rule} because {because}.")
    return "\n".join(out)


_QUESTIONS = [
    (r"^(?:who|what) (?:is|are) an? (\w+)\??$", lambda m, b: [("?x", f"<{b}type>", f"<{b}{m[1]}>")]),
    (r"^(?:who|what) (\w+) (\w+)\??$", lambda m, b: [("?x", f"<{b}{m[1]}>", f"<{b}{m[2]}>")]),
    (r"^(?:who|what) does (\w+) (\w+)\??$", lambda m, b: [(f"<{b}{m[1]}>", f"<{b}{m[2]}>", "?x")]),
    (r"^is (\w+) an? (\w+)\??$", lambda m, b: [(f"<{b}{m[1]}>", f"<{b}type>", f"<{b}{m[2]}>")]),
    (r"^(?:list|show)(?: all)? (\w+)\??$", lambda m, b: [("?x", f"<{b}type>", f"<{b}{m[1]}>")]),
]


def question(text: str, base: str, type_iri: str | None = None) -> list[tuple[str, str, str]] | None:
    """The patterns a templated question asks for, or None."""
    for pattern, make in _QUESTIONS:
        if m := re.match(pattern, text.strip(), re.I):
            return [(s, f"<{type_iri}>" if type_iri and p == f"<{base}type>" else p, o) for s, p, o in make(m, base)]
    return None
