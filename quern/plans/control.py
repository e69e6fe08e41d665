"""Control flow over lazy frames: conditionals as expressions, loops and sequences as small Python drivers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.expressions import Compiler, ExpressionError, kind_of, parse


def if_else(schema: T.StructType, branches: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first branch whose condition is true; null without one."""
    compile_ = Compiler(schema, strict=True).column
    out = None
    for condition, value in branches:
        c, v = F.coalesce(compile_(condition), F.lit(False)), compile_(value)
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(compile_(otherwise)) if otherwise is not None else out


def value_of(spark, expression: str) -> DataFrame:
    """One row with an expression that needs no row."""
    return spark.range(1).select(Compiler(T.StructType(), strict=True).column(expression).alias("value"))


def each(schema: T.StructType, items: str, variable: str, expression: str) -> Column:
    """``expression`` for every item of a list expression; ``variable`` names the item in it."""
    whole = Compiler(schema, strict=True)
    source, kind = whole.sql(parse(items))
    if kind != "l":
        raise ExpressionError("a loop needs a list")
    element = _element(schema, items)
    body, _ = Compiler(schema, strict=True, bound={variable: (f"`{variable}`", element)}).sql(parse(expression))
    return F.expr(f"transform({source}, `{variable}` -> {body})")


def _element(schema: T.StructType, items: str) -> str:
    node = parse(items)
    kind = schema[node.value[0]].dataType
    for step in node.value[1:]:
        kind = kind[step].dataType if isinstance(step, str) else kind.elementType
    return kind_of(kind.elementType)


class Break(Exception):
    """Raised by a step to end a loop or a sequence; carries a frame to return, if any."""

    def __init__(self, result: DataFrame | None = None):
        self.result = result


def for_each(items: Iterable, step: Callable, until: Callable | None = None) -> int:
    """Run ``step(item)``; false moves on without counting as an end, ``until(item)`` breaks before the item is counted. The number of completed rounds."""
    done = 0
    for item in items:
        if until is not None and until(item):
            break
        try:
            step(item)
        except Break:
            break
        done += 1
    return done


def sequence(steps: list[Callable[[], DataFrame]]) -> DataFrame | None:
    """The steps' frames one after another; a Break drops what came before and gives its own frame."""
    frames = []
    for step in steps:
        try:
            frames.append(step())
        except Break as b:
            return b.result
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def give(df: DataFrame) -> DataFrame:
    raise Break(df)
