"""The textual expression language, compiled to a Spark SQL expression over a frame's columns.

Two modes: ``strict`` raises on overflow, division by zero, a null operand of ``and``/``or``/``not`` and on type
mismatches; ``lenient`` gives null instead, which a filter drops.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEX = re.compile(r"\s+|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|\"(?P<text>(?:[^\"\\]|\\.)*)\"|'(?P<alt>(?:[^'\\]|\\.)*)'|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|>=|<=|[-+*/%<>()\[\].,])")
COMPARE = {"==", "!=", ">", ">=", "<", "<="}
WORDS = {"and", "or", "not", "contains", "in"}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # literal, path, call, unary, binary
    value: object
    args: tuple = ()


def parse(text: str) -> Node:
    tokens, at = [], 0
    while at < len(text):
        m = LEX.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            value = m.group(m.lastgroup)
            kind = "text" if m.lastgroup == "alt" else m.lastgroup
            tokens.append((kind, re.sub(r"\\(.)", r"\1", value) if kind == "text" else value))
        at = m.end()
    tokens.append(("end", ""))
    k = 0

    def is_(*values):
        return tokens[k][0] in ("mark", "name") and tokens[k][1] in values

    def next_():
        nonlocal k
        k += 1
        return tokens[k - 1]

    def left(below, *ops):
        node = below()
        while is_(*ops):
            op = next_()[1]
            node = Node("binary", op, (node, below()))
        return node

    def comparison():
        node = left(product_sum, "\0")
        if is_(*COMPARE, "contains", "in"):
            op = next_()[1]
            node = Node("binary", op, (node, product_sum()))
            if is_(*COMPARE, "contains", "in"):
                raise ExpressionError("comparisons cannot be chained")
        return node

    def product_sum():
        return left(lambda: left(unary, "*", "/", "%"), "+", "-")

    def unary():
        if is_("-", "not"):
            return Node("unary", next_()[1], (unary(),))
        return primary()

    def primary():
        kind, value = next_()
        if kind == "int":
            return Node("literal", int(value))
        if kind == "float":
            return Node("literal", float(value))
        if kind == "text":
            return Node("literal", value)
        if (kind, value) == ("mark", "("):
            node = disjunction()
            if not is_(")"):
                raise ExpressionError("missing )")
            next_()
            return node
        if kind == "name" and value not in WORDS:
            if is_("("):
                next_()
                args = []
                while not is_(")"):
                    args.append(disjunction())
                    if not is_(")"):
                        if not is_(","):
                            raise ExpressionError("expected , or )")
                        next_()
                next_()
                return Node("call", value, tuple(args))
            steps = [value]
            while is_(".", "["):
                if next_()[1] == ".":
                    kind, value = next_()
                    if kind != "name":
                        raise ExpressionError("expected a field after .")
                    steps.append(value)
                else:
                    kind, value = next_()
                    if kind != "int" or not is_("]"):
                        raise ExpressionError("expected an index")
                    next_()
                    steps.append(int(value))
            return Node("path", tuple(steps))
        raise ExpressionError(f"unexpected {value or 'end'!r}")

    def disjunction():
        return left(lambda: left(comparison, "and"), "or")

    node = disjunction()
    if tokens[k][0] != "end":
        raise ExpressionError(f"unexpected {tokens[k][1]!r}")
    return node


def roots(node: Node) -> set[str]:
    """Fields that the expression starts from."""
    return {node.value[0]} if node.kind == "path" else set().union(*(roots(a) for a in node.args))


#: name -> (fewest arguments, most or None, argument kinds or None, SQL of the arguments' SQL and kinds, result kind)
_KEEP = lambda kinds: kinds[0]
FUNCTIONS: dict[str, tuple] = {
    "lower": (1, 1, "s", lambda a, k: f"lower({a[0]})", "s"),
    "upper": (1, 1, "s", lambda a, k: f"upper({a[0]})", "s"),
    "trim": (1, 1, "s", lambda a, k: f"regexp_replace({a[0]}, r'(?U)^\\s+|\\s+$', '')", "s"),
    "len": (1, 1, "slo", lambda a, k: f"cast({'char_length' if k[0] == 's' else 'size'}({a[0]}) as bigint)" if k[0] != "o" else f"cast(size(map_keys(from_json(to_json({a[0]}), 'map<string,string>'))) as bigint)", "i"),
    "concat": (1, None, "s", lambda a, k: f"concat({', '.join(a)})", "s"),
    "abs": (1, 1, "if", lambda a, k: f"abs({a[0]})", _KEEP),
    "ceil": (1, 1, "if", lambda a, k: a[0] if k[0] == "i" else f"cast(ceil({a[0]}) as double)", _KEEP),
    "floor": (1, 1, "if", lambda a, k: a[0] if k[0] == "i" else f"cast(floor({a[0]}) as double)", _KEEP),
    "round": (1, 1, "if", lambda a, k: a[0] if k[0] == "i" else f"round({a[0]}, 0)", _KEEP),
}


def register(name: str, sql: Callable[[list[str], list[str]], str], result: str, fewest: int = 1, most: int | None = None, kinds: str | None = None) -> None:
    """Add a scalar function: ``sql`` gets the arguments as SQL and their kinds (i f s b l o) and gives SQL."""
    FUNCTIONS[name] = (fewest, most, kinds, sql, result)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "i"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "f"
    if isinstance(t, T.StringType):
        return "s"
    if isinstance(t, T.BooleanType):
        return "b"
    if isinstance(t, T.ArrayType):
        return "l"
    return "o" if isinstance(t, (T.StructType, T.MapType)) else "t" if isinstance(t, (T.TimestampType, T.DateType)) else "?"


class Compiler:
    def __init__(self, schema: T.StructType, strict: bool = True, bound: dict[str, tuple[str, str]] | None = None):
        self.schema, self.strict, self.bound = schema, strict, bound or {}

    def column(self, node: Node | str) -> Column:
        return F.expr(self.sql(parse(node) if isinstance(node, str) else node)[0])

    def _fail(self, why: str, kind: str = "?") -> tuple[str, str]:
        if self.strict:
            raise ExpressionError(why)
        return "null", kind

    def sql(self, n: Node) -> tuple[str, str]:
        """SQL and kind."""
        if n.kind == "literal":
            if isinstance(n.value, str):
                return "'" + n.value.replace("\\", "\\\\").replace("'", "\\'") + "'", "s"
            return (f"{n.value}L", "i") if isinstance(n.value, int) else (f"{n.value!r}D", "f")
        return getattr(self, "_" + n.kind)(n)

    def _path(self, n: Node) -> tuple[str, str]:
        first, *rest = n.value
        if first in self.bound:
            sql, kind = self.bound[first]
            return (sql, kind) if not rest else self._fail("a loop variable has no fields")
        if first not in self.schema.names:
            return "null", "n"
        sql, t = f"`{first}`", self.schema[first].dataType
        for step in rest:
            if isinstance(step, int):
                if not isinstance(t, T.ArrayType):
                    return "null", "n"
                sql, t = f"get({sql}, {step})", t.elementType
            elif isinstance(t, T.StructType):
                if step not in t.names:
                    return "null", "n"
                sql, t = f"{sql}.`{step}`", t[step].dataType
            elif isinstance(t, T.MapType):
                sql, t = f"{sql}['{step}']", t.valueType
            else:
                return "null", "n"
        return (f"cast({sql} as bigint)", "i") if kind_of(t) == "i" and not isinstance(t, T.LongType) else (f"cast({sql} as double)", "f") if kind_of(t) == "f" and not isinstance(t, T.DoubleType) else (sql, kind_of(t))

    def _call(self, n: Node) -> tuple[str, str]:
        if n.value not in FUNCTIONS:
            raise ExpressionError(f"unknown function {n.value}")
        fewest, most, kinds, make, result = FUNCTIONS[n.value]
        if len(n.args) < fewest or most is not None and len(n.args) > most:
            raise ExpressionError(f"{n.value} takes {fewest}{'' if most == fewest else ' or more'} arguments")
        args = [self.sql(a) for a in n.args]
        if any(k == "n" for _, k in args):
            return "null", "n"  # a null argument comes before any check of kinds
        if kinds and any(k not in kinds for _, k in args):
            return self._fail(f"{n.value} cannot take that")
        sql, got = [a for a, _ in args], [k for _, k in args]
        out = make(sql, got)
        return out, result(got) if callable(result) else result

    def _unary(self, n: Node) -> tuple[str, str]:
        sql, kind = self.sql(n.args[0])
        if n.value == "-":
            if kind == "n":
                return "null", "n"
            if kind not in "if":
                return self._fail("- needs a number")
            return (f"(-{sql})" if self.strict else f"try_subtract(cast(0 as {'bigint' if kind == 'i' else 'double'}), {sql})"), kind
        if kind != "b":
            return self._fail("not needs a truth value", "b")
        return self._known(f"(not {sql})", sql), "b"

    def _known(self, sql: str, *operands: str) -> str:
        some_null = " or ".join(f"{o} is null" for o in operands)
        other = "raise_error('a truth value is missing')" if self.strict else "null"
        return f"(case when {some_null} then {other} else {sql} end)"

    def _binary(self, n: Node) -> tuple[str, str]:
        op = n.value
        (a, ka), (b, kb) = self.sql(n.args[0]), self.sql(n.args[1])
        if op in ("and", "or"):
            if ka != "b" or kb != "b":
                return self._fail(f"{op} needs truth values", "b")
            return self._known(f"({a} {op} {b})", a, b), "b"
        if op in ("==", "!="):
            same = ka == kb or {ka, kb} <= {"i", "f"} or "n" in (ka, kb) or {ka, kb} <= {"s", "t"}
            sql = f"({a} <=> {b})" if same else "false"
            return (sql if op == "==" else f"(not {sql})"), "b"
        if op == "in":
            if kb != "l":
                return ("null", "b") if "n" in (ka, kb) else self._fail("in needs a list", "b")
            return f"(case when {a} is null then null else coalesce(array_contains({b}, {a}), false) end)", "b"
        if op == "contains":
            if "n" in (ka, kb):
                return "null", "b"
            if ka == "l":
                return f"array_contains({a}, {b})", "b"
            return (f"contains({a}, {b})", "b") if ka == kb == "s" else self._fail("contains needs text or a list", "b")
        if "n" in (ka, kb):
            return "null", "b" if op in COMPARE else "n"
        if op in COMPARE:
            if ka == kb and ka in "sbt" and ka != "b" or {ka, kb} <= {"i", "f"} or {ka, kb} <= {"s", "t"}:
                return f"({a} {op} {b})", "b"
            return self._fail(f"cannot compare with {op}", "b")
        if not {ka, kb} <= {"i", "f"}:
            return self._fail(f"{op} needs numbers")
        kind = "i" if ka == kb == "i" else "f"
        if kind == "f":
            a, b = f"cast({a} as double)", f"cast({b} as double)"
        if op in "+-*":
            name = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}[op]
            return (f"({a} {op} {b})" if self.strict else f"{name}({a}, {b})"), kind
        sql = f"({a} div {b})" if (op, kind) == ("/", "i") else f"({a} {op} {b})"
        return (sql if self.strict else f"(case when {b} = 0 then null else {sql} end)"), kind
