"""SPARQL expressions as Columns. An error is null, so a filter on it is not met."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.plans.algebra import Expr


@dataclasses.dataclass
class Val:
    """A value in the forms it has at hand: term, number, string or boolean; others are derived when asked for."""

    _term: Column | None = None
    _num: Column | None = None
    _text: Column | None = None
    _bool: Column | None = None
    const: str | None = None
    _whole: Column | None = None  # of a number made from numbers: whether all of them are integers

    @functools.cached_property
    def term(self) -> Column:
        if self._term is not None:
            return self._term
        if self._bool is not None:
            return terms.typed(self._bool, terms.XSD_BOOLEAN)
        if self._text is not None:
            return terms.plain(self._text)
        if self._whole is not None:
            return F.when(self._whole, terms.integer(self._num)).otherwise(terms.decimal(self._num))
        return terms.decimal(self._num)

    @property
    def whole(self) -> Column:
        """Whether the number is an integer by its type."""
        if self._whole is not None:
            return self._whole
        if self.const is not None:
            return F.lit(self.const.endswith(f'"^^<{terms.XSD_INTEGER}>'))
        return F.coalesce(terms.datatype(self._term) == terms.XSD_INTEGER, F.lit(False)) if self._term is not None else F.lit(False)

    @functools.cached_property
    def num(self) -> Column:
        if self._num is not None:
            return self._num
        return self._text.try_cast("double") if self._text is not None else terms.number(self.term)

    @functools.cached_property
    def text(self) -> Column:
        if self._text is not None:
            return self._text
        return self._bool.cast("string") if self._bool is not None else terms.value(self.term)

    @functools.cached_property
    def truth(self) -> Column:
        """The effective boolean value."""
        if self._bool is not None:
            return self._bool
        if self._num is not None and self._term is None:
            return (self._num != 0) & ~F.isnan(self._num)
        lexical = self.text
        return F.when(terms.datatype(self.term) == terms.XSD_BOOLEAN, lexical.isin("true", "1")).when(self.num.isNotNull(), self.num != 0).otherwise(F.length(lexical) > 0)

    @property
    def numeric_const(self) -> bool:
        return self.const is not None and '"^^<' in self.const and self.const.rsplit("#", 1)[-1][:-1] in {"integer", "decimal", "double", "float", "int", "long"}


def constant(term: str) -> Val:
    out = Val(F.lit(term), const=term)
    if out.numeric_const:
        out = Val(F.lit(term), F.lit(float(term[1 : term.rindex('"')])), const=term)
    return out


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b),
}


def compare(op: str, a: Val, b: Val) -> Column:
    test = _COMPARE[op]
    if a.numeric_const or b.numeric_const or (a._num is not None and b._num is not None):
        return test(a.num, b.num)
    if op in ("=", "!=") and (a.const or b.const):
        return test(a.term, b.term)
    both = a.num.isNotNull() & b.num.isNotNull()
    return F.when(both, test(a.num, b.num)).otherwise(test(a.term, b.term) if op in ("=", "!=") else test(a.text, b.text))


def _regex(args: list[Val]) -> Val:
    flags = args[2].const[1:-1] if len(args) > 2 and args[2].const else ""
    pattern = F.concat(F.lit(f"(?{flags})"), args[1].text) if flags else args[1].text
    return Val(_bool=F.when(terms.is_literal(args[0].term), F.regexp_like(args[0].text, pattern)))


def _when_literal(args: list[Val], made: Column) -> Column:
    return F.when(terms.is_literal(args[0].term), made)


def _replace(a: list[Val]) -> Val:
    return Val(_text=F.regexp_replace(a[0].text, a[1].text, a[2].text))


_FUNCTIONS: dict[str, Callable[[list[Val]], Val]] = {
    "REGEX": _regex,
    "CONTAINS": lambda a: Val(_bool=_when_literal(a, F.contains(a[0].text, a[1].text))),
    "STRSTARTS": lambda a: Val(_bool=_when_literal(a, F.startswith(a[0].text, a[1].text))),
    "STRENDS": lambda a: Val(_bool=_when_literal(a, F.endswith(a[0].text, a[1].text))),
    "STRLEN": lambda a: Val(_num=_when_literal(a, F.length(a[0].text)).cast("double")),
    "UCASE": lambda a: Val(_text=F.upper(a[0].text)),
    "LCASE": lambda a: Val(_text=F.lower(a[0].text)),
    "SUBSTR": lambda a: Val(_text=F.substring(a[0].text, a[1].num.cast("int"), a[2].num.cast("int") if len(a) > 2 else F.length(a[0].text))),
    "STRBEFORE": lambda a: Val(_text=F.when(F.contains(a[0].text, a[1].text), F.substring_index(a[0].text, a[1].const[1:-1], 1)).otherwise("")),
    "STRAFTER": lambda a: Val(_text=F.when(F.contains(a[0].text, a[1].text), F.substring(a[0].text, F.locate(a[1].const[1:-1], a[0].text) + F.length(a[1].text), F.length(a[0].text))).otherwise("")),
    "CONCAT": lambda a: Val(_text=F.concat(*[x.text for x in a])),
    "REPLACE": _replace,
    "STR": lambda a: Val(_text=a[0].text),
    "LANG": lambda a: Val(_text=terms.language(a[0].term)),
    "LANGMATCHES": lambda a: Val(_bool=(a[1].text == "*") & (a[0].text != "") | F.startswith(F.lower(a[0].text), F.lower(a[1].text))),
    "DATATYPE": lambda a: Val(_term=F.concat(F.lit("<"), terms.datatype(a[0].term), F.lit(">"))),
    "IRI": lambda a: Val(_term=F.concat(F.lit("<"), a[0].text, F.lit(">"))),
    "URI": lambda a: Val(_term=F.concat(F.lit("<"), a[0].text, F.lit(">"))),
    "ISIRI": lambda a: Val(_bool=terms.is_iri(a[0].term)),
    "ISURI": lambda a: Val(_bool=terms.is_iri(a[0].term)),
    "ISLITERAL": lambda a: Val(_bool=terms.is_literal(a[0].term)),
    "ISBLANK": lambda a: Val(_bool=terms.is_blank(a[0].term)),
    "ISNUMERIC": lambda a: Val(_bool=a[0].num.isNotNull()),
    "ABS": lambda a: Val(_num=F.abs(a[0].num)),
    "CEIL": lambda a: Val(_num=F.ceil(a[0].num).cast("double")),
    "FLOOR": lambda a: Val(_num=F.floor(a[0].num).cast("double")),
    "ROUND": lambda a: Val(_num=F.floor(a[0].num + 0.5).cast("double")),
    "YEAR": lambda a: Val(_num=F.substring(a[0].text, 1, 4).try_cast("double")),
    "MONTH": lambda a: Val(_num=F.substring(a[0].text, 6, 2).try_cast("double")),
    "DAY": lambda a: Val(_num=F.substring(a[0].text, 9, 2).try_cast("double")),
    "HOURS": lambda a: Val(_num=F.substring(a[0].text, 12, 2).try_cast("double")),
    "MINUTES": lambda a: Val(_num=F.substring(a[0].text, 15, 2).try_cast("double")),
    "SECONDS": lambda a: Val(_num=F.regexp_extract(a[0].text, r"T\d\d:\d\d:([\d.]+)", 1).try_cast("double")),
    "MD5": lambda a: Val(_text=F.md5(a[0].text.cast("binary"))),
    "SHA1": lambda a: Val(_text=F.sha1(a[0].text.cast("binary"))),
    "SHA256": lambda a: Val(_text=F.sha2(a[0].text.cast("binary"), 256)),
    "SHA512": lambda a: Val(_text=F.sha2(a[0].text.cast("binary"), 512)),
    "ENCODE_FOR_URI": lambda a: Val(_text=F.replace(F.url_encode(a[0].text), F.lit("+"), F.lit("%20"))),
    "COALESCE": lambda a: Val(_term=F.coalesce(*[x.term for x in a])),
    "IF": lambda a: Val(_term=F.when(a[0].truth, a[1].term).when(~a[0].truth, a[2].term)),
    "SAMETERM": lambda a: Val(_bool=a[0].term == a[1].term),
}


class UnknownFunction(ValueError):
    """A function this compiler doesn't have."""


def compile_expr(e: Expr, columns: set[str], numbers: dict[str, str], aggregates: Callable | None = None) -> Val:
    """e over the columns of a solution; ``numbers`` names hidden columns with a variable's number."""
    sub = lambda x: compile_expr(x, columns, numbers, aggregates)
    if e.op == "var":
        name = e.args[0]
        if name not in columns:
            return Val(F.lit(None).cast("string"))
        return Val(F.col(f"`{name}`"), F.col(numbers[name]) if name in numbers else None)
    if e.op == "const":
        return constant(e.args[0])
    if e.op == "aggregate":
        if aggregates is None:
            raise UnknownFunction("an aggregate outside of SELECT, HAVING and ORDER BY")
        return aggregates(e.args[0])
    if e.op in _COMPARE:
        return Val(_bool=compare(e.op, sub(e.args[0]), sub(e.args[1])))
    if e.op in _ARITHMETIC:
        a, b = sub(e.args[0]), sub(e.args[1])
        return Val(_num=_ARITHMETIC[e.op](a.num, b.num), _whole=a.whole & b.whole if e.op != "/" else None)
    if e.op in ("and", "or"):
        a, b = (sub(x).truth for x in e.args)
        return Val(_bool=a & b if e.op == "and" else a | b)
    if e.op == "not":
        return Val(_bool=~sub(e.args[0]).truth)
    if e.op == "neg":
        a = sub(e.args[0])
        return Val(_num=-a.num, _whole=a.whole)
    if e.op == "in":
        left = sub(e.args[0])
        return Val(_bool=functools.reduce(lambda a, b: a | b, [compare("=", left, sub(x)) for x in e.args[1:]], F.lit(False)))
    if e.op == "call":
        name = e.args[0]
        if name == "BOUND":
            v = e.args[1].args[0]
            return Val(_bool=F.col(f"`{v}`").isNotNull() if v in columns else F.lit(False))
        if name.startswith(f"<{terms.XSD}"):
            kind, arg = name[len(terms.XSD) + 1 : -1], sub(e.args[1])
            if kind == "string":
                return Val(_text=arg.text)
            if kind in ("integer", "int", "long"):
                return Val(_term=terms.integer(arg.num), _num=arg.num.try_cast("bigint").cast("double"))
            if kind == "boolean":
                return Val(_bool=arg.text.isin("true", "1"))
            return Val(_term=terms.typed(arg.num, f"{terms.XSD}{kind}"), _num=arg.num)
        if name not in _FUNCTIONS:
            raise UnknownFunction(name)
        return _FUNCTIONS[name]([sub(x) for x in e.args[1:]])
    raise UnknownFunction(e.op)
