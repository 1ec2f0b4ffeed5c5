"""RDFS and OWL RL entailment as N3 rules, each named as the standards name it."""

from __future__ import annotations

from graphloom.functions import terms
from graphloom.sources import n3

_PREFIXES = f"@prefix rdf: <{terms.RDF}> . @prefix rdfs: <{terms.RDFS}> . @prefix owl: <{terms.OWL}> . "

_RDFS = {
    "rdfs2": "{ ?p rdfs:domain ?c . ?x ?p ?y } => { ?x a ?c }",
    "rdfs3": "{ ?p rdfs:range ?c . ?x ?p ?y } => { ?y a ?c }",
    "rdfs4a": "{ ?x ?p ?y } => { ?x a rdfs:Resource }",
    "rdfs4b": "{ ?x ?p ?y } => { ?y a rdfs:Resource }",
    "rdfs5": "{ ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r } => { ?p rdfs:subPropertyOf ?r }",
    "rdfs6": "{ ?p a rdf:Property } => { ?p rdfs:subPropertyOf ?p }",
    "rdfs7": "{ ?p rdfs:subPropertyOf ?q . ?x ?p ?y } => { ?x ?q ?y }",
    "rdfs8": "{ ?c a rdfs:Class } => { ?c rdfs:subClassOf rdfs:Resource }",
    "rdfs9": "{ ?c rdfs:subClassOf ?d . ?x a ?c } => { ?x a ?d }",
    "rdfs10": "{ ?c a rdfs:Class } => { ?c rdfs:subClassOf ?c }",
    "rdfs11": "{ ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e } => { ?c rdfs:subClassOf ?e }",
}
_OWL = {
    "prp-symp": "{ ?p a owl:SymmetricProperty . ?x ?p ?y } => { ?y ?p ?x }",
    "prp-trp": "{ ?p a owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z } => { ?x ?p ?z }",
    "prp-inv1": "{ ?p owl:inverseOf ?q . ?x ?p ?y } => { ?y ?q ?x }",
    "prp-inv2": "{ ?p owl:inverseOf ?q . ?x ?q ?y } => { ?y ?p ?x }",
    "prp-eqp1": "{ ?p owl:equivalentProperty ?q . ?x ?p ?y } => { ?x ?q ?y }",
    "prp-eqp2": "{ ?p owl:equivalentProperty ?q . ?x ?q ?y } => { ?x ?p ?y }",
    "prp-spo1": "{ ?p rdfs:subPropertyOf ?q . ?x ?p ?y } => { ?x ?q ?y }",
    "cax-sco": "{ ?c rdfs:subClassOf ?d . ?x a ?c } => { ?x a ?d }",
    "cax-eqc1": "{ ?c owl:equivalentClass ?d . ?x a ?c } => { ?x a ?d }",
    "cax-eqc2": "{ ?c owl:equivalentClass ?d . ?x a ?d } => { ?x a ?c }",
    "scm-sco": "{ ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e } => { ?c rdfs:subClassOf ?e }",
    "scm-eqc1": "{ ?c owl:equivalentClass ?d } => { ?c rdfs:subClassOf ?d }",
    "scm-eqc2": "{ ?c owl:equivalentClass ?d } => { ?d rdfs:subClassOf ?c }",
    "eq-ref": "{ ?x ?p ?y } => { ?x owl:sameAs ?x }",
    "eq-sym": "{ ?x owl:sameAs ?y } => { ?y owl:sameAs ?x }",
    "eq-trans": "{ ?x owl:sameAs ?y . ?y owl:sameAs ?z } => { ?x owl:sameAs ?z }",
    "eq-rep-s": "{ ?x owl:sameAs ?y . ?x ?p ?o } => { ?y ?p ?o }",
    "eq-rep-p": "{ ?p owl:sameAs ?q . ?x ?p ?o } => { ?x ?q ?o }",
    "eq-rep-o": "{ ?x owl:sameAs ?y . ?s ?p ?x } => { ?s ?p ?y }",
    "cls-svf1": "{ ?r owl:someValuesFrom ?c . ?r owl:onProperty ?p . ?x ?p ?y . ?y a ?c } => { ?x a ?r }",
    "cls-svf2": "{ ?r owl:someValuesFrom owl:Thing . ?r owl:onProperty ?p . ?x ?p ?y } => { ?x a ?r }",
    "cls-avf": "{ ?r owl:allValuesFrom ?c . ?r owl:onProperty ?p . ?x a ?r . ?x ?p ?y } => { ?y a ?c }",
    "cls-hv1": "{ ?r owl:hasValue ?v . ?r owl:onProperty ?p . ?x a ?r } => { ?x ?p ?v }",
    "cls-hv2": "{ ?r owl:hasValue ?v . ?r owl:onProperty ?p . ?x ?p ?v } => { ?x a ?r }",
}


def _named(texts: dict[str, str], names: list[str]) -> list[n3.Rule]:
    return [n3.Rule(r.body, r.head, name) for name in names for r in n3.parse(_PREFIXES + texts[name] + " .").rules]


def rules(text: str, prefixes: dict[str, str] | None = None) -> list[n3.Rule]:
    """The rules of an N3 text."""
    head = "".join(f"@prefix {k}: <{v}> . " for k, v in (prefixes or {}).items())
    return n3.parse(_PREFIXES + head + text).rules


def rdfs(names: list[str] | None = None) -> list[n3.Rule]:
    """The core rules: domain, range, sub-properties and sub-classes."""
    return _named(_RDFS, names or ["rdfs2", "rdfs3", "rdfs5", "rdfs7", "rdfs9", "rdfs11"])


def rdfs_extended() -> list[n3.Rule]:
    return rdfs(["rdfs2", "rdfs3", "rdfs5", "rdfs7", "rdfs9", "rdfs11", "rdfs6", "rdfs8", "rdfs10"])


def owl_rl(names: list[str] | None = None) -> list[n3.Rule]:
    return _named(_OWL, names or list(_OWL))


#: What a profile reasons with.
PROFILES = {"default": lambda: [], "rdfs": rdfs, "owl": lambda: rdfs() + owl_rl(), "performance": rdfs, "complete": lambda: rdfs_extended() + owl_rl()}
