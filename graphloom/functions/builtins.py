"""Built-in predicates as Column builders, by name within the math, string, list, time, crypto, log and os namespaces.

An entry takes the subject, as one value or as the values of a list, and returns a value (bound to the object, or
compared with it) or, for tests, a boolean column. Arrays hold canonical terms.
"""

from __future__ import annotations

import dataclasses
import hashlib as _hashlib
import os as _os
import platform as _platform
import re as _re
import socket as _socket
import sys as _sys
import tempfile as _tempfile
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.plans.expressions import Val

SWAP = "http://www.w3.org/2000/10/swap/"
NAMESPACES = {n: f"{SWAP}{n}#" for n in ("math", "string", "list", "time", "crypto", "log", "os", "graph", "db")}


@dataclasses.dataclass(frozen=True)
class Builtin:
    """shape: what the subject is ("one" value, values "many" of a list, an "array"); kind: what comes out ("num", "text",
    "term", "array"), or "test" with the object as a further argument."""

    shape: str
    kind: str
    build: Callable


REGISTRY: dict[str, Builtin] = {}


def register(uri: str, builtin: Builtin) -> None:
    """Adds a predicate under its URI, or replaces one: the extension point for own functions."""
    REGISTRY[uri] = builtin


def _add(namespace: str, shape: str, kind: str, entries: dict[str, Callable]) -> None:
    for name, build in entries.items():
        register(f"<{NAMESPACES[namespace]}{name}>", Builtin(shape, kind, build))


def _given(a: Val) -> str:
    """The value of an argument that the rule's text gives."""
    return terms.unescape(a.const[1 : a.const.rindex('"')])


def _array(x) -> Column:
    """A list given as values, or an array, as an array of terms."""
    if isinstance(x, list):
        return F.array(*[v.term if isinstance(v, Val) else list_text(_array(v)) if isinstance(v, list) else v for v in x]) if x else F.array().cast("array<string>")
    return list_items(x.term) if isinstance(x, Val) else x


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _positive_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, ((a % b) + b) % b)


def _gcd(a: Column, b: Column) -> Column:
    # Euclid's steps for 64-bit numbers are at most 92
    start = F.struct(F.abs(_int(a)).alias("a"), F.abs(_int(b)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.nullif(s.b, F.lit(0).cast("bigint"))).alias("b"))), lambda s: s.a)


def _numbers(a: Column) -> Column:
    return F.filter(F.transform(a, terms.number), lambda x: x.isNotNull())


def _total(a: Column) -> Column:
    return F.aggregate(_numbers(a), F.lit(0.0), lambda s, x: s + x)


def _factors(n: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def split(values):
        def of(n):
            out, d = [], 2
            n = int(n)
            while d * d <= n:
                while n % d == 0:
                    out.append(d)
                    n //= d
                d += 1
            return out + [n] * (n > 1)

        return values.map(of, na_action="ignore")

    return F.transform(split(_int(n)), terms.integer)


_add("math", "many", "num", {
    "sum": lambda a: a[0].num + a[1].num, "difference": lambda a: a[0].num - a[1].num, "product": lambda a: a[0].num * a[1].num,
    "quotient": lambda a: F.try_divide(a[0].num, a[1].num), "remainder": lambda a: F.when(a[1].num != 0, a[0].num % a[1].num),
    "integerQuotient": lambda a: F.floor(F.try_divide(a[0].num, a[1].num)).cast("double"), "exponentiation": lambda a: F.pow(a[0].num, a[1].num),
    "atan2": lambda a: F.atan2(a[0].num, a[1].num), "mod": lambda a: _positive_mod(a[0].num, a[1].num), "hypot": lambda a: F.hypot(a[0].num, a[1].num),
    "gcd": lambda a: _gcd(a[0].num, a[1].num).cast("double"),
    "lcm": lambda a: F.abs(_int(a[0].num) * _int(a[1].num)) / F.nullif(_gcd(a[0].num, a[1].num), F.lit(0).cast("bigint")),
    "bitAnd": lambda a: _int(a[0].num).bitwiseAND(_int(a[1].num)).cast("double"), "bitOr": lambda a: _int(a[0].num).bitwiseOR(_int(a[1].num)).cast("double"),
    "bitXor": lambda a: _int(a[0].num).bitwiseXOR(_int(a[1].num)).cast("double"),
    "leftShift": lambda a: a[0].num * F.pow(F.lit(2.0), a[1].num), "rightShift": lambda a: F.floor(a[0].num / F.pow(F.lit(2.0), a[1].num)).cast("double"),
    "randomInteger": lambda a: F.floor(a[0].num + F.rand() * (a[1].num - a[0].num + 1)).cast("double"),
})
_add("math", "one", "num", {
    "negation": lambda a: -a.num, "absoluteValue": lambda a: F.abs(a.num), "rounded": lambda a: F.round(a.num), "floor": lambda a: F.floor(a.num).cast("double"),
    "ceiling": lambda a: F.ceil(a.num).cast("double"), "sin": lambda a: F.sin(a.num), "cos": lambda a: F.cos(a.num), "tan": lambda a: F.tan(a.num),
    "sinh": lambda a: F.sinh(a.num), "cosh": lambda a: F.cosh(a.num), "tanh": lambda a: F.tanh(a.num), "asin": lambda a: F.asin(a.num),
    "acos": lambda a: F.acos(a.num), "atan": lambda a: F.atan(a.num), "degrees": lambda a: F.degrees(a.num), "radians": lambda a: F.radians(a.num),
    "logarithm": lambda a: F.ln(a.num), "sqrt": lambda a: F.sqrt(a.num), "sign": lambda a: F.signum(a.num), "log10": lambda a: F.log10(a.num),
    "log2": lambda a: F.log2(a.num), "exp": lambda a: F.exp(a.num), "cbrt": lambda a: F.cbrt(a.num), "bitNot": lambda a: F.bitwise_not(_int(a.num)).cast("double"),
    "random": lambda a: F.rand(),
})
_add("math", "one", "array", {"factors": lambda a: _factors(a.num)})
_add("math", "one", "test", {
    "lessThan": lambda a, b: a.num < b.num, "greaterThan": lambda a, b: a.num > b.num, "equalTo": lambda a, b: a.num == b.num,
    "notEqualTo": lambda a, b: a.num != b.num, "notLessThan": lambda a, b: a.num >= b.num, "notGreaterThan": lambda a, b: a.num <= b.num,
})
_mean = lambda a: F.try_divide(_total(a), F.size(_numbers(a)))
_add("math", "array", "num", {
    "memberCount": lambda a: F.size(a).cast("double"), "sumOf": _total, "productOf": lambda a: F.aggregate(_numbers(a), F.lit(1.0), lambda s, x: s * x),
    "min": lambda a: F.array_min(_numbers(a)), "max": lambda a: F.array_max(_numbers(a)), "average": _mean,
})

_squeeze = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
_low = F.lower
_find = lambda s, part: F.when(F.contains(s, part), F.octet_length(F.split_part(s, part, F.lit(1)))).otherwise(-1).cast("double")


def _last(s: Column, part: Column) -> Column:
    pieces = F.split(s, F.concat(F.lit(r"\Q"), part, F.lit(r"\E")), -1)
    return F.when(F.contains(s, part), F.octet_length(s) - F.octet_length(F.element_at(pieces, -1)) - F.octet_length(part)).otherwise(-1).cast("double")


def _uri(part: str) -> Callable[[Val], Column]:
    # scheme ":" "//" authority path "?" query "#" fragment, by the generic syntax
    pattern = r"^(?:([^:/?#]+):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    group = {"scheme": 1, "host": 2, "port": 3, "path": 4, "query": 5, "fragment": 6}[part]
    return lambda a: F.nullif(F.regexp_extract(a.text, pattern, group), F.lit(""))


def _format(a: list[Val]) -> Column:
    return F.format_string(_given(a[0]), *[x.text for x in a[1:]]) if a[0].const else F.array_join(F.array(*[x.text for x in a]), "")


def _escape_signs(pairs: list[tuple[str, str]]) -> Callable[[Val], Column]:
    def build(a: Val) -> Column:
        out = a.text
        for raw, coded in pairs:
            out = F.replace(out, F.lit(raw), F.lit(coded))
        return out

    return build


_MARKUP = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
_texts = lambda c: F.transform(c, terms.plain)
_add("string", "many", "text", {
    "concatenation": lambda a: F.concat(*[x.text for x in a]), "concat": lambda a: F.concat(a[0].text, a[1].text),
    "replace": lambda a: F.regexp_replace(a[0].text, a[1].text, a[2].text),
    "scrape": lambda a: F.nullif(F.regexp_extract(a[0].text, _given(a[1]) if a[1].const else ".*", 1), F.lit("")), "format": _format,
    "substring": lambda a: F.substring(a[0].text, a[1].num.cast("int") + 1, a[2].num.cast("int")),
    "repeat": lambda a: F.repeat(a[0].text, a[1].num.cast("int")),
    "padStart": lambda a: F.lpad(a[0].text, F.greatest(F.length(a[0].text), a[1].num.cast("int")), a[2].text),
    "padEnd": lambda a: F.rpad(a[0].text, F.greatest(F.length(a[0].text), a[1].num.cast("int")), a[2].text),
})
_add("string", "many", "num", {"indexOf": lambda a: _find(a[0].text, a[1].text), "lastIndexOf": lambda a: _last(a[0].text, a[1].text)})
_add("string", "many", "array", {
    "split": lambda a: _texts(F.split(a[0].text, F.concat(F.lit(r"\Q"), a[1].text, F.lit(r"\E")), -1)), "tokenize": lambda a: _texts(F.split(a[0].text, a[1].text, -1)),
    "findAll": lambda a: _texts(F.regexp_extract_all(a[0].text, a[1].text, F.lit(0))),
    "captureGroups": lambda a: _texts(F.array(*[F.regexp_extract(a[0].text, _given(a[1]), i) for i in range(1, _re.compile(_given(a[1])).groups + 1)])),
})
_add("string", "one", "text", {
    "lowerCase": lambda a: _low(a.text), "upperCase": lambda a: F.upper(a.text), "trim": lambda a: F.regexp_replace(a.text, r"^\s+|\s+$", ""),
    "trimLeft": lambda a: F.regexp_replace(a.text, r"^\s+", ""), "trimRight": lambda a: F.regexp_replace(a.text, r"\s+$", ""), "normalize": lambda a: _squeeze(a.text),
    "reverse": lambda a: F.reverse(a.text), "xmlEscape": _escape_signs([*_MARKUP, ("'", "&apos;")]), "htmlEscape": _escape_signs([*_MARKUP, ("'", "&#39;")]),
    "encodeForURI": lambda a: F.replace(F.url_encode(a.text), F.lit("+"), F.lit("%20")), "decodeFromURI": lambda a: F.try_url_decode(F.replace(a.text, F.lit("+"), F.lit("%2B"))),
    "uriScheme": _uri("scheme"), "uriHost": _uri("host"), "uriPath": _uri("path"), "uriQuery": _uri("query"), "uriFragment": _uri("fragment"),
    "capitalize": lambda a: F.concat(F.upper(F.substring(a.text, 1, 1)), F.substring(a.text, F.lit(2), F.length(a.text))),
})
_add("string", "one", "num", {"length": lambda a: F.octet_length(a.text).cast("double"), "uriPort": lambda a: _uri("port")(a).try_cast("double"), "charCode": lambda a: F.when(F.length(a.text) > 0, F.ascii(a.text)).cast("double")})
_add("string", "one", "array", {
    "lines": lambda a: _texts(F.split(a.text, "\r?\n")), "words": lambda a: _texts(F.filter(F.split(a.text, r"\s+"), lambda x: x != "")),
})
_add("string", "one", "test", {
    "contains": lambda a, b: F.contains(a.text, b.text), "notContains": lambda a, b: ~F.contains(a.text, b.text), "startsWith": lambda a, b: F.startswith(a.text, b.text),
    "endsWith": lambda a, b: F.endswith(a.text, b.text), "equalIgnoringCase": lambda a, b: _low(a.text) == _low(b.text), "notEqualIgnoringCase": lambda a, b: _low(a.text) != _low(b.text),
    "lessThan": lambda a, b: a.text < b.text, "greaterThan": lambda a, b: a.text > b.text, "notLessThan": lambda a, b: a.text >= b.text, "notGreaterThan": lambda a, b: a.text <= b.text,
    "matches": lambda a, b: F.regexp_like(a.text, b.text), "notMatches": lambda a, b: ~F.regexp_like(a.text, b.text),
    "containsIgnoringCase": lambda a, b: F.contains(_low(a.text), _low(b.text)), "containsRoughly": lambda a, b: F.contains(_low(_squeeze(a.text)), _low(_squeeze(b.text))),
    "notContainsRoughly": lambda a, b: ~F.contains(_low(_squeeze(a.text)), _low(_squeeze(b.text))),
    "isAlpha": lambda a, b: a.text.rlike(r"^\p{L}+$"), "isNumeric": lambda a, b: a.text.rlike(r"^\p{N}+$"), "isAlphanumeric": lambda a, b: a.text.rlike(r"^[\p{L}\p{N}]+$"),
    "isWhitespace": lambda a, b: a.text.rlike(r"^\s+$"),
})
_add("string", "pair", "text", {"join": lambda a, b: F.array_join(F.transform(a, terms.value), _given(b) if b.const else "")})

# arrays of terms; "pair" takes an array and one more value, "two" two arrays
_at = lambda b: b.num.cast("int")
_add("list", "array", "term", {"first": lambda a: F.get(a, F.lit(0)), "last": lambda a: F.get(a, F.size(a) - 1)})
_add("list", "array", "num", {
    "length": lambda a: F.size(a).cast("double"), "min": lambda a: F.array_min(_numbers(a)), "max": lambda a: F.array_max(_numbers(a)), "average": _mean,
})
_tail = lambda a, n: F.slice(a, n + 1, F.greatest(F.size(a), F.lit(1)))
_no_term = lambda: F.array().cast("array<string>")
_add("list", "array", "array", {
    "rest": lambda a: F.when(F.size(a) > 0, _tail(a, F.lit(1))), "unique": F.array_distinct, "reverse": F.reverse, "butLast": lambda a: F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)),
    "sort": lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(terms.number(x).alias("n"), terms.value(x).alias("v"), x.alias("t")))), lambda s: s.t),
    "iterate": lambda a: F.transform(a, lambda x, i: F.concat(F.lit("("), terms.integer(i), F.lit(" "), x, F.lit(")"))),
    "rotateLeft": lambda a: F.concat(_tail(a, F.lit(1)), F.slice(a, 1, 1)), "rotateRight": lambda a: F.when(F.size(a) > 0, F.concat(F.array(F.element_at(a, -1)), F.slice(a, F.lit(1), F.size(a) - 1))).otherwise(a),
    "filterNumbers": lambda a: F.filter(a, lambda x: terms.number(x).isNotNull()), "filterStrings": lambda a: F.filter(a, lambda x: terms.is_literal(x) & terms.number(x).isNull()),
    "filterURIs": lambda a: F.filter(a, terms.is_iri),
})
_add("list", "array", "text", {"listToString": lambda a: F.array_join(F.transform(a, terms.value), "")})
_add("list", "one", "array", {"stringToList": lambda a: _texts(F.filter(F.split(a.text, ""), lambda x: x != ""))})
_add("list", "array", "test", {
    "member": lambda a, b: F.array_contains(a, b.term), "isEmpty": lambda a, b: F.size(a) == 0, "notEmpty": lambda a, b: F.size(a) > 0,
})
_add("list", "pair", "array", {
    "remove": lambda a, b: F.array_remove(a, b.term), "take": lambda a, b: F.slice(a, F.lit(1), F.greatest(_at(b), F.lit(0))), "drop": lambda a, b: _tail(a, F.greatest(_at(b), F.lit(0))),
    "removeAt": lambda a, b: F.filter(a, lambda x, i: i != _at(b)), "intersperse": lambda a, b: F.slice(F.flatten(F.transform(a, lambda x: F.array(x, b.term))), F.lit(1), F.greatest(F.size(a) * 2 - 1, F.lit(0))),
})
_add("list", "pair", "term", {"nth": lambda a, b: F.get(a, _at(b))})
_add("list", "pair", "num", {
    "count": lambda a, b: F.size(F.filter(a, lambda x: x == b.term)).cast("double"), "indexOf": lambda a, b: (F.array_position(a, b.term) - 1).cast("double"),
})
_add("list", "pair", "holds", {"contains": lambda a, b: F.array_contains(a, b.term)})
#: A list's text, taken apart: literals, IRIs, blank nodes, and lists of lists as far as they are nested three deep.
_LEAF = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<[^>]*>|_:[^\s()]+'
_ITEM = rf"{_LEAF}|\((?:{_LEAF}|\s|\((?:{_LEAF}|\s|\((?:{_LEAF}|\s)*\))*\))*\)"


def list_items(c: Column) -> Column:
    """The items of a list's text, as an array."""
    return F.regexp_extract_all(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(_ITEM), F.lit(0))


def list_text(a: Column) -> Column:
    """The text of a list of terms."""
    return F.concat(F.lit("("), F.array_join(a, " "), F.lit(")"))


_flat = lambda a: F.flatten(F.transform(a, lambda x: F.when(x.startswith("("), list_items(x)).otherwise(F.array(x))))
_add("list", "array", "array", {"flat": _flat, "flatten": _flat, "uncons": lambda a: F.when(F.size(a) > 0, F.array(F.get(a, F.lit(0)), list_text(_tail(a, F.lit(1)))))})
_add("list", "pair", "array", {"splitAt": lambda a, b: F.array(list_text(F.slice(a, F.lit(1), F.greatest(_at(b), F.lit(0)))), list_text(_tail(a, F.greatest(_at(b), F.lit(0)))))})
_add("list", "one", "test", {"in": lambda a, b: F.array_contains(_array(b), a.term)})
_add("list", "two", "array", {
    "append": lambda a, b: F.concat(a, b), "setDifference": F.array_except, "setIntersection": F.array_intersect, "setUnion": F.array_union,
    "zip": lambda a, b: F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: F.concat(F.lit("("), x, F.lit(" "), y, F.lit(")"))),
})
_add("list", "many", "array", {"range": lambda a: F.when(a[1].num > a[0].num, F.transform(F.sequence(_int(a[0].num), _int(a[1].num) - 1), terms.integer)).otherwise(_no_term())})
_add("list", "triple", "array", {
    "slice": lambda a, b, c: F.slice(a, _at(b) + 1, F.greatest(_at(c) - _at(b), F.lit(0))), "insert": lambda a, b, c: F.concat(F.slice(a, F.lit(1), _at(b)), F.array(c.term), _tail(a, _at(b))),
    "replaceAt": lambda a, b, c: F.transform(a, lambda x, i: F.when(i == _at(b), c.term).otherwise(x)),
})
_add("list", "head", "array", {"cons": lambda a, b: F.concat(F.array(a.term), b)})

# RFC 3339 texts; parts are read in the text's own offset
_stamp = lambda c: F.try_to_timestamp(c)
_seconds = lambda c: _stamp(c).cast("double")
_date = lambda c: F.try_to_date(F.substring(c, 1, 10)) if hasattr(F, "try_to_date") else F.substring(c, 1, 10).try_cast("date")
_utc = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
_part = lambda pattern: lambda a: F.regexp_extract(a.text, pattern, 1).try_cast("double")


def _offset(a: Val) -> Column:
    sign, hours, minutes = (F.regexp_extract(a.text, r"([+-])(\d\d):(\d\d)$", i) for i in (1, 2, 3))
    total = hours.try_cast("double") * 60 + minutes.try_cast("double")
    return F.when(a.text.endswith("Z"), 0.0).when(sign == "-", -total).otherwise(total)


def _year(c: Column) -> Column:
    return F.regexp_extract(c, r"^(-?\d{4})", 1).try_cast("int")


_add("time", "one", "num", {
    "inSeconds": lambda a: _seconds(a.text), "year": _part(r"^(-?\d{4})"), "month": _part(r"^-?\d{4}-(\d\d)"), "day": _part(r"^-?\d{4}-\d\d-(\d\d)"),
    "hour": _part(r"T(\d\d)"), "minute": _part(r"T\d\d:(\d\d)"), "second": _part(r"T\d\d:\d\d:(\d\d)"), "dayOfWeek": lambda a: (F.dayofweek(_date(a.text)) - 1).cast("double"),
    "timeZone": _offset, "dayOfYear": lambda a: F.dayofyear(_date(a.text)).cast("double"), "weekOfYear": lambda a: F.weekofyear(_date(a.text)).cast("double"),
    "nowSeconds": lambda a: F.unix_timestamp().cast("double"),
})
_add("time", "one", "text", {"gmTime": lambda a: _utc(a.num), "localTime": lambda a: F.date_format(F.timestamp_seconds(a.num), "yyyy-MM-dd'T'HH:mm:ssXXX"), "now": lambda a: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})
_add("time", "one", "test", {"isLeapYear": lambda a, b: (_year(a.text) % 4 == 0) & ((_year(a.text) % 100 != 0) | (_year(a.text) % 400 == 0))})
_JAVA_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh"}


def _java(pattern: str) -> str:
    for c, java in _JAVA_FORMAT.items():
        pattern = pattern.replace(c, f"\x01{java}\x01")
    return "".join(x if i % 2 else (f"'{x}'" if any(ch.isalpha() for ch in x) else x) for i, x in enumerate(pattern.split("\x01")))


_add("time", "many", "text", {
    "format": lambda a: F.date_format(_stamp(a[0].text), _java(_given(a[1]))), "addSeconds": lambda a: _utc(_seconds(a[0].text) + a[1].num),
    "parse": lambda a: F.date_format(F.try_to_timestamp(a[0].text, F.lit(_java(_given(a[1])))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
})
_add("time", "many", "num", {"diffSeconds": lambda a: _seconds(a[0].text) - _seconds(a[1].text), "parseToSeconds": lambda a: F.try_to_timestamp(a[0].text, F.lit(_java(_given(a[1])))).cast("double")})
_add("time", "many", "holds", {"isBefore": lambda a: _seconds(a[0].text) < _seconds(a[1].text), "isAfter": lambda a: _seconds(a[0].text) > _seconds(a[1].text)})

_bytes = lambda a: a.text.cast("binary")


def _hmac(data: Column, given: Val) -> Column:
    """HMAC-SHA256 in built-in functions: the key padded to 64 bytes, xored byte by byte with the two pads; once for all
    rows where the key is written in the rule."""
    if given.const is not None and given.const.startswith('"'):
        raw = _given(given).encode()
        raw = (_hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
        return _keyed_hash(data, *(F.lit(bytes(x ^ n for x in raw).hex()) for n in (0x36, 0x5C)))
    key = given.text
    short = F.when(F.octet_length(key) > 64, F.sha2(key.cast("binary"), 256)).otherwise(F.hex(key.cast("binary")))
    padded = F.rpad(F.lower(short), 128, "0")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    pad = lambda n: F.array_join(F.transform(pairs, lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(n))), 2, "0")), "")
    return _keyed_hash(data, pad(0x36), pad(0x5C))


def _keyed_hash(data: Column, inside: Column, outside: Column) -> Column:
    inner = F.sha2(F.unhex(F.concat(inside, F.hex(data.cast("binary")))), 256)
    return F.base64(F.unhex(F.sha2(F.unhex(F.concat(outside, inner)), 256)))


_is_hex = lambda a: a.text.rlike("^[0-9A-Fa-f]+$")
_add("crypto", "one", "text", {
    "md5": lambda a: F.md5(_bytes(a)), "sha": lambda a: F.sha2(_bytes(a), 256), "sha1": lambda a: F.sha1(_bytes(a)), "sha512": lambda a: F.sha2(_bytes(a), 512),
    "base64Encode": lambda a: F.base64(_bytes(a)), "base64Decode": lambda a: F.try_to_binary(a.text, F.lit("base64")).cast("string"), "hexEncode": lambda a: F.lower(F.hex(_bytes(a))),
    "hexDecode": lambda a: F.unhex(a.text).cast("string"), "randomBytes": lambda a: F.substring(F.sha2(F.uuid(), 512), F.lit(1), a.num.cast("int") * 2),
})
_add("crypto", "one", "num", {"keyLength": lambda a: F.octet_length(F.unhex(a.text)).cast("double") * 8})
_signed = lambda a: _hmac(a[0][0].text, a[0][1]) == a[1].text
_add("crypto", "many", "text", {
    "sign": lambda a: _hmac(a[0].text, a[1]), "verify": lambda a: F.when(_signed(a), "1").otherwise("0"),
})
_add("crypto", "many", "holds", {"verifyBoolean": _signed})
#: Fixed value: what a public key's hash begins with.
_KEY_MARK = "public_key_derivation:"
_add("crypto", "any", "text", {"publicKey": lambda a: a[1].text if isinstance(a, list) else F.sha2(F.concat(F.lit(_KEY_MARK), a.text).cast("binary"), 256)})
_add("crypto", "one", "test", {
    "hashFunction": lambda a, b: F.lower(a.text).isin("sha256", "sha-256", "sha384", "sha-384", "sha512", "sha-512"), "publicKeyObject": lambda a, b: _is_hex(a),
    "canSign": lambda a, b: _is_hex(a), "canEncrypt": lambda a, b: F.length(a.text) > 0, "hasPrivate": lambda a, b: F.contains(F.lower(a.text), F.lit("private")),
})

_truthy = lambda a: F.coalesce(a.truth, F.lit(False))
_add("log", "one", "text", {"uri": lambda a: F.when(terms.is_iri(a.term), a.text), "rawUri": lambda a: a.text, "uuid": lambda a: F.uuid(), "outputString": lambda a: a.text, "content": lambda a: a.text})
_add("log", "one", "term", {
    "rawType": lambda a: F.concat(F.lit(f"<{terms.LOG}"), F.element_at(F.create_map(*[F.lit(x) for x in ("uri", "Uri", "bnode", "BlankNode", "literal", "Literal", "list", "List", "formula", "Formula")]), terms.kind(a.term)), F.lit(">")),
    "racine": lambda a: F.regexp_replace(a.term, "#[^>]*>$", ">"), "skolem": lambda a: F.concat(F.lit("<urn:skolem:"), F.md5(a.term.cast("binary")), F.lit(">")),
    "definitiveDocument": lambda a: F.regexp_replace(a.term, "#[^>]*>$", ">"), "definitiveService": lambda a: F.regexp_replace(a.term, "#[^>]*>$", ">"),
})
_add("log", "many", "term", {
    "dtlit": lambda a: F.concat(terms.plain(a[0].text), F.lit("^^<"), a[1].text, F.lit(">")), "langlit": lambda a: F.concat(terms.plain(a[0].text), F.lit("@"), a[1].text),
    "ifThenElse": lambda a: F.when(_truthy(a[0]), a[1].term).otherwise(a[2].term), "either": lambda a: F.when(_truthy(a[0]), a[0].term).otherwise(a[1].term),
})
_add("log", "many", "holds", {"and": lambda a: _truthy(a[0]) & _truthy(a[1]), "or": lambda a: _truthy(a[0]) | _truthy(a[1])})
_add("log", "one", "test", {
    "equalTo": lambda a, b: a.term == b.term, "notEqualTo": lambda a, b: a.term != b.term, "notSame": lambda a, b: a.term != b.term, "isTrue": lambda a, b: _truthy(a),
    "Truth": lambda a, b: F.lower(a.text).isin("true", "1"), "Falsehood": lambda a, b: F.lower(a.text).isin("false", "0", ""),
    "isFalse": lambda a, b: ~_truthy(a), "not": lambda a, b: ~_truthy(a), "bound": lambda a, b: a.term.isNotNull(), "notBound": lambda a, b: a.term.isNull(), "ground": lambda a, b: ~a.term.startswith("?"),
})
_add("log", "array", "test", {"allDistinct": lambda a, b: F.size(F.array_distinct(a)) == F.size(a)})

_add("os", "one", "text", {
    "environ": lambda a: F.lit(_os.environ.get(_given(a), None) if a.const else None), "cwd": lambda a: F.lit(_os.getcwd()), "hostname": lambda a: F.lit(_socket.gethostname()),
    "platform": lambda a: F.lit(_platform.system().lower()), "arch": lambda a: F.lit(_platform.machine()), "tempDir": lambda a: F.lit(_tempfile.gettempdir()),
    "homeDir": lambda a: F.lit(_os.path.expanduser("~")), "dirname": lambda a: F.regexp_extract(a.text, r"^(.*)/[^/]*$", 1), "basename": lambda a: F.regexp_extract(a.text, r"([^/]*)$", 1),
    "extension": lambda a: F.regexp_extract(a.text, r"[^/.]\.([^./]+)$", 1), "baseAbsolute": lambda a: F.when(a.text.startswith("/"), a.text).otherwise(F.concat(F.lit(_os.getcwd() + "/"), a.text)),
    "baseRelative": lambda a: F.regexp_replace(a.text, "^" + _re.escape(_os.getcwd() + "/"), ""),
})
_add("os", "many", "text", {"joinPath": lambda a: F.when(a[1].text.startswith("/"), a[1].text).otherwise(F.concat(F.rtrim(a[0].text, F.lit("/")), F.lit("/"), a[1].text))})


def _inside(path: str) -> bool:
    """Whether a path stays below the working folder: others are not read."""
    return ".." not in path and not path.startswith("/")


def _file(read: Callable[[str], object], kind: str, anywhere: bool = True) -> Callable:
    """A look at the driver's files for each path: paths are few, as rules name them."""
    def build(a: Val) -> Column:
        @F.pandas_udf(kind)
        def look(paths):
            def of(path):
                try:
                    return read(path) if anywhere or _inside(path) else None
                except OSError:
                    return None

            return paths.map(of, na_action="ignore")

        return look(a.text)

    return build


def _text_of_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_add("os", "one", "test", {
    "exists": lambda a, b: _file(_os.path.exists, "boolean")(a), "isFile": lambda a, b: _file(_os.path.isfile, "boolean")(a), "isDir": lambda a, b: _file(_os.path.isdir, "boolean")(a),
})
_add("os", "one", "num", {"fileSize": _file(lambda p: float(_os.stat(p).st_size), "double"), "fileModTime": _file(lambda p: float(_os.stat(p).st_mtime), "double")})
_add("os", "one", "text", {"readFile": _file(_text_of_file, "string", False), "argv": lambda a: F.get(F.array(*map(F.lit, _sys.argv)), _int(a.num).cast("int"))})
_add("os", "one", "array", {
    "dirContents": lambda a: _texts(_file(lambda p: sorted(_os.listdir(p)), "array<string>")(a)),
    "listDir": lambda a: _texts(_file(lambda p: sorted(_os.path.join(p, x) for x in _os.listdir(p)), "array<string>", False)(a)),
})


def is_builtin(predicate: str) -> bool:
    return predicate in REGISTRY


def evaluate(predicate: str, subject, obj: Val | None) -> Val | Column:
    """The boolean column of a test, or the value a function gives. ``subject`` is a Val, or a list of Vals and arrays."""
    b = REGISTRY[predicate]
    as_array = _array
    if b.shape in ("one", "many", "any"):
        args = [subject]
    elif b.shape == "array":
        args = [as_array(subject)]
    elif b.shape in ("pair", "triple"):
        args = [as_array(subject[0]), *subject[1:]]
    elif b.shape == "two":
        args = [as_array(subject[0]), as_array(subject[1])]
    else:
        args = [subject[0], as_array(subject[1])]
    if b.kind == "test":
        return b.build(*args, obj)
    made = b.build(*args)
    return {"num": lambda: Val(_num=made), "text": lambda: Val(_text=made), "term": lambda: Val(_term=made), "array": lambda: made, "holds": lambda: made}[b.kind]()

