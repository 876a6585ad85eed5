"""Constraint expressions compiled to Catalyst columns.

The language has three-valued logic (UNDEFINED and ERROR are NULL here), string
`==` without regard to case, `=?=` and `=!=` that are strict and never NULL,
integer division, and references with scope: MY.x, TARGET.x, or x, which is one's
own attribute if defined, else the other side's. Types are static, taken from the
columns; an attribute that no side has is UNDEFINED.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+[eE][+-]?\d+|\d+)|"((?:[^"\\]|\\.)*)"|([A-Za-z_]\w*)|(=\?=|=!=|&&|\|\||==|!=|<=|>=|\?:|[-+*/%<>!?:().,\[\]{}]))""")
_BINARY = {"||": 1, "&&": 2, "is": 3, "isnt": 3, "=?=": 3, "=!=": 3, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


class ExpressionError(ValueError):
    """The text isn't an expression."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()
    value: object = None


def parse(text: str) -> Node:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected text at {text[at:at + 20]!r}")
        number, string, name, op = m.groups()
        tokens.append(("number", number) if number else ("string", re.sub(r"\\(.)", r"\1", string)) if string is not None else ("name", name) if name else ("op", op))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek():
        return tokens[place]

    def take(op=None):
        nonlocal place
        kind, value = tokens[place]
        if op is not None and (kind, value) != ("op", op):
            raise ExpressionError(f"expected {op!r}, found {value!r}")
        place += 1
        return kind, value

    def many(close):
        out = []
        while peek() != ("op", close):
            out.append(ternary())
            if peek() == ("op", ","):
                take()
        take(close)
        return tuple(out)

    def primary():
        kind, value = take()
        if kind == "number":
            node = Node("lit", value=float(value) if re.search(r"[.eE]", value) else int(value))
        elif kind == "string":
            node = Node("lit", value=value)
        elif kind == "name":
            low = value.lower()
            if peek() == ("op", "("):
                take()
                node = Node("call", many(")"), low)
            elif low in ("true", "false"):
                node = Node("lit", value=low == "true")
            elif low in ("undefined", "error"):
                node = Node("lit")
            elif low in ("my", "target", "parent") and peek() == ("op", "."):
                take()
                node = Node("ref", (low,), take()[1].lower())
            else:
                node = Node("ref", ("",), low)
        elif value == "(":
            node = ternary()
            take(")")
        elif value == "{":
            node = Node("list", many("}"))
        elif value in ("!", "-", "+"):
            return Node("unary", (primary(),), value)
        else:
            raise ExpressionError(f"unexpected {value!r}")
        while peek() in (("op", "."), ("op", "[")):
            if take()[1] == ".":
                node = Node("select", (node,), take()[1])
            else:
                node = Node("subscript", (node, ternary()))
                take("]")
        return node

    def binary(least):
        left = primary()
        while (op := peek()[1].lower() if peek()[0] in ("op", "name") else "") in _BINARY and _BINARY[op] >= least:
            take()
            left = Node("binary", (left, binary(_BINARY[op] + 1)), {"is": "=?=", "isnt": "=!="}.get(op, op))
        return left

    def ternary():
        left = binary(1)
        if peek() == ("op", "?:"):
            take()
            return Node("elvis", (left, ternary()))
        if peek() == ("op", "?"):
            take()
            a = ternary()
            take(":")
            return Node("if", (left, a, ternary()))
        return left

    node = ternary()
    if peek()[0] != "end":
        raise ExpressionError(f"unexpected {peek()[1]!r}")
    return node


def references(node: Node) -> set[tuple[str, str]]:
    """(scope, name) of every attribute it names; scope is my, target, parent or empty."""
    if node.op == "ref":
        return {(node.args[0], node.value)}
    return set().union(*(references(a) for a in node.args if isinstance(a, Node)), set())


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "real"
    return "list" if isinstance(t, T.ArrayType) else "record" if isinstance(t, T.StructType) else "null" if isinstance(t, T.NullType) else "str"


Typed = tuple[Column, str]


def _null() -> Typed:
    return F.lit(None), "null"


def attributes(df: DataFrame, prefix: str = "") -> dict[str, Typed]:
    """The columns of `df` whose name starts with `prefix`, by lower-case name without it."""
    return {f.name[len(prefix) :].lower(): (F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in df.schema if f.name.lower().startswith(prefix.lower())}


@dataclass
class Compiler:
    my: Mapping[str, Typed]
    target: Mapping[str, Typed] = field(default_factory=dict)
    now: int | None = None

    def __call__(self, text: str) -> Typed:
        return self.column(parse(text))

    def condition(self, text: str | None) -> Column:
        """For filters and joins, which drop NULL by themselves: bare, so that its parts reach the scan
        and become join keys. "" and "true" match all."""
        return F.lit(True) if text is None or text.strip().lower() in ("", "true") else self._bool(self(text))

    def predicate(self, text: str | None) -> Column:
        """True where the expression is true, else false: never NULL, so it may be negated."""
        return F.coalesce(self.condition(text), F.lit(False))

    def column(self, n: Node) -> Typed:
        if n.op == "lit":
            v = n.value
            return F.lit(v) if not isinstance(v, int) or isinstance(v, bool) else F.lit(v).cast("long"), "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "real" if isinstance(v, float) else "str"
        if n.op == "ref":
            return self._reference(*n.args, n.value)
        if n.op == "list":
            return self._list([self.column(a) for a in n.args])
        if n.op == "select":
            c, kind = self.column(n.args[0])
            return (c[n.value], "str") if kind == "record" else _null()
        if n.op == "subscript":
            (c, kind), (i, of) = map(self.column, n.args)
            return (F.get(c, i.cast("int")), "str") if kind == "list" and of == "int" else _null()
        if n.op == "if":
            return self._choose(*map(self.column, n.args))
        if n.op == "elvis":
            a, b = map(self.column, n.args)
            return (F.coalesce(a[0], b[0]), _common(a[1], b[1])) if _common(a[1], b[1]) else a
        if n.op == "unary":
            return self._unary(n.value, self.column(n.args[0]))
        if n.op == "binary":
            return self._binary(n.value, *map(self.column, n.args))
        return self._call(n.value, [self.column(a) for a in n.args])

    def _reference(self, scope: str, name: str) -> Typed:
        sides = {"my": [self.my], "target": [self.target], "": [self.my, self.target]}.get(scope, [])
        found = [s[name] for s in sides if name in s]
        if not found:
            return _null()
        if len(found) == 2 and (kind := _common(found[0][1], found[1][1])):
            return F.coalesce(found[0][0], found[1][0]), kind
        return found[0]

    @staticmethod
    def _list(items: list[Typed]) -> Typed:
        return F.array(*(c for c, _ in items)) if items else F.array().cast("array<string>"), "list"

    @staticmethod
    def _bool(x: Typed) -> Column:
        c, kind = x
        return c if kind == "bool" else c != 0 if kind in ("int", "real") else F.lit(None).cast("boolean")

    def _choose(self, c: Typed, a: Typed, b: Typed) -> Typed:
        kind = _common(a[1], b[1])
        test = self._bool(c)
        return (F.when(test, a[0]).when(~test, b[0]), kind) if kind else _null()

    def _unary(self, op: str, x: Typed) -> Typed:
        if op == "!":
            return ~self._bool(x), "bool"
        return (-x[0] if op == "-" else x[0], x[1]) if x[1] in ("int", "real") else _null()

    def _binary(self, op: str, x: Typed, y: Typed) -> Typed:
        (a, ka), (b, kb) = x, y
        if op in ("&&", "||"):
            p, q = self._bool(x), self._bool(y)
            return (p & q if op == "&&" else p | q), "bool"
        if op in ("=?=", "=!="):
            same = a.isNull() & b.isNull() if "null" in (ka, kb) or ka != kb else a.eqNullSafe(b)
            return (same if op == "=?=" else ~same), "bool"
        number = ka in ("int", "real") and kb in ("int", "real")
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if ka == kb == "str":
                a, b = F.lower(a), F.lower(b)
            elif not number and not (ka == kb == "bool" and op in ("==", "!=")):
                return F.lit(None).cast("boolean"), "bool"
            return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "bool"
        if not number:
            return _null()
        kind = "int" if ka == kb == "int" else "real"
        if op in "+-*":
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), kind
        zero = b == 0
        if kind == "int":
            by = F.nullif(b.cast("long"), F.lit(0))
            return (F.try_mod(a, by) if op == "%" else F.call_function("div", a.cast("long"), by)), "int"
        return (F.when(~zero, F.try_mod(a.cast("double"), b.cast("double"))) if op == "%" else F.try_divide(a.cast("double"), b.cast("double"))), "real"

    def _call(self, name: str, args: list[Typed]) -> Typed:
        columns, kinds = [c for c, _ in args], [k for _, k in args]
        if name == "ifthenelse" and len(args) == 3:
            return self._choose(*args)
        if name == "strcat":
            return F.concat(*(c.cast("string") for c in columns)), "str"
        if name == "isundefined" and len(args) == 1:
            return columns[0].isNull(), "bool"
        if name in ("tolower", "toupper"):
            return (F.lower if name == "tolower" else F.upper)(columns[0].cast("string")), "str"
        if name == "size":
            return (F.length(columns[0]).cast("long"), "int") if kinds[0] == "str" else (F.size(columns[0]).cast("long"), "int")
        if name == "substr":
            start = F.when(columns[1] < 0, F.greatest(F.length(columns[0]) + columns[1], F.lit(0))).otherwise(columns[1]) + 1
            rest = columns[2] if len(args) > 2 else F.length(columns[0])
            return F.substr(columns[0], start.cast("int"), rest.cast("int")), "str"
        if name in ("int", "real", "string"):
            to = {"int": "long", "real": "double", "string": "string"}[name]
            c = columns[0].cast("double") if name == "int" and kinds[0] == "real" else columns[0]
            return (c.try_cast(to) if kinds[0] == "str" else c.cast(to)), {"int": "int", "real": "real", "string": "str"}[name]
        if name in ("floor", "ceiling", "round"):
            c = columns[0].cast("double")
            return {"floor": F.floor(c), "ceiling": F.ceil(c), "round": F.round(c)}[name].cast("long"), "int"
        if name in ("min", "max") and len(args) > 1:
            return (F.least if name == "min" else F.greatest)(*columns), "real" if "real" in kinds else "int"
        if name == "pow":
            return F.pow(columns[0], columns[1]), "real"
        if name == "time" and not args:
            return F.lit(self.now).cast("long") if self.now is not None else F.unix_timestamp(), "int"
        if name == "regexp" and len(args) >= 2:
            flags = F.concat(F.lit("(?"), columns[2], F.lit(")")) if len(args) > 2 else F.lit("")
            return F.regexp_like(columns[1], F.concat(flags, columns[0])), "bool"
        if name == "member" and kinds[1] == "list":
            return F.array_contains(columns[1], columns[0]), "bool"
        if name in ("stringlistmember", "stringlistimember", "stringlistsize"):
            items = F.filter(F.split(columns[-1], r"[,\s]+"), lambda x: x != "")
            if name == "stringlistsize":
                return F.size(items).cast("long"), "int"
            fold = F.lower if name == "stringlistimember" else lambda c: c
            return F.array_contains(F.transform(items, fold), fold(columns[0])), "bool"
        raise ExpressionError(f"function {name} isn't known with {len(args)} arguments")


def _common(a: str, b: str) -> str | None:
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    return "real" if {a, b} == {"int", "real"} else None
