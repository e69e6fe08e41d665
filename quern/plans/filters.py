"""Filter objects to frames: scalar conditions become one predicate, relation conditions semi- and anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import geo, text
from quern.sources.schema import SchemaError
from quern.sources.store import Store

TEXT = {"allofterms": (True, False), "anyofterms": (False, False), "alloftext": (True, True), "anyoftext": (False, True)}


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def condition(c: Column, op: str, value, vacuous: bool = False, numeric_strings: bool = False) -> Column:
    """One operator of a field's condition; a comparison with null is false (``vacuous``: true)."""
    if op == "eq":
        return c.isNull() if value is None else two_valued(c.eqNullSafe(F.lit(value)))
    if op == "ne":
        return ~condition(c, "eq", value)
    if op in ("gt", "ge", "lt", "le"):
        b = F.lit(value)
        if numeric_strings and isinstance(value, str) and value.lstrip("+-").isdigit():
            c, b = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")), F.lit(int(value))
        out = {"gt": c > b, "ge": c >= b, "lt": c < b, "le": c <= b}[op]
        return F.coalesce(out, F.lit(vacuous))
    if op == "between":
        return F.coalesce(c.between(value[0], value[1]), F.lit(vacuous)) if len(value) == 2 else F.lit(True)
    if op == "in":
        some = [v for v in value if v is not None]
        out = two_valued(c.isin(some)) if some else F.lit(False)
        return out | c.isNull() if len(some) < len(value) else out
    if op == "contains":
        return two_valued(F.contains(c, F.lit(value)))
    if op == "near":
        p = value["coordinate"]
        return two_valued(geo.distance(c, p["latitude"], p["longitude"]) <= value["distance"])
    if op == "within":
        return geo.within(c, value)
    if op == "intersects":
        return geo.intersects(c, value)
    if op in TEXT:
        every, stem = TEXT[op]
        toks, terms = text.tokens(c), text.parse_query(value, stem=stem)
        return text.let(text.stem_all(toks, terms), lambda x: text.matches(x, terms, every)) if stem else text.matches(toks, terms, every)
    if op == "trigram":
        return two_valued(F.contains(F.lower(c), F.lit(value.lower()))) if len(value) >= 3 else F.lit(False)
    raise SchemaError(f"unknown operator {op}")


class Filters:
    """Compiles filters of one store; ``depth`` guards against relations nested without end."""

    MOST = 64

    def __init__(self, store: Store, vacuous: bool = False, numeric_strings: bool = False):
        self.store, self.vacuous, self.numeric = store, vacuous, numeric_strings

    def apply(self, df: DataFrame, type_name: str, flt: dict | None, depth: int = 0) -> DataFrame:
        """Rows of ``df`` (frame of ``type_name``) that pass."""
        if depth > self.MOST:
            raise SchemaError("filters are nested too deep")
        names = df.columns
        plain: list[Column] = []
        for key, value in (flt or {}).items():
            if key == "and":
                for part in value:
                    df = self.apply(df, type_name, part, depth + 1)
            elif key == "not" and self._only_relation(type_name, value):
                (field, sub), = value.items()
                df = self._semi(df, type_name, field, sub, depth, "left_anti")
            elif key not in ("or", "not") and self._is_relation(type_name, key):
                df = self._semi(df, type_name, key, value, depth, "left_semi")
            else:
                df, c = self._column(df, type_name, {key: value}, depth)
                if c is not None:
                    plain.append(c)
        if plain:
            df = df.filter(reduce(lambda a, b: a & b, plain))
        return df.select(*names)

    def _is_relation(self, type_name: str, key: str) -> bool:
        f = self.store.catalog[type_name].fields.get(key)
        return bool(f) and self.store.catalog.is_relation(f)

    def _only_relation(self, type_name: str, flt: dict) -> bool:
        return len(flt) == 1 and self._is_relation(type_name, next(iter(flt)))

    def _sources(self, type_name: str, field: str, flt: dict, depth: int) -> DataFrame:
        """The uids of the rows that some child of ``field`` lets pass; an empty filter asks for any child."""
        target = self.store.catalog[type_name].fields[field].base
        pairs = self.store.pairs(type_name, field)
        child = self.apply(self.store.frame(target), target, flt, depth + 1).select(F.col("uid").alias("dst"))
        return pairs.join(child, "dst", "left_semi").select(F.col("src").alias("uid"))

    def _semi(self, df: DataFrame, type_name: str, field: str, flt: dict, depth: int, how: str) -> DataFrame:
        return df.join(self._sources(type_name, field, flt, depth), "uid", how)

    def _column(self, df: DataFrame, type_name: str, flt: dict, depth: int) -> tuple[DataFrame, Column | None]:
        """A predicate for boolean trees; relation conditions inside become joined flags."""
        parts: list[Column] = []
        for key, value in flt.items():
            if key in ("and", "or"):
                inner = []
                for part in value:
                    df, c = self._column(df, type_name, part, depth + 1)
                    inner.append(c if c is not None else F.lit(True))
                if inner:
                    parts.append(reduce((lambda a, b: a & b) if key == "and" else (lambda a, b: a | b), inner))
            elif key == "not":
                df, c = self._column(df, type_name, value, depth + 1)
                parts.append(~two_valued(c) if c is not None else F.lit(False))
            elif self._is_relation(type_name, key):
                flag = f"_has{len(df.columns)}"
                found = self._sources(type_name, key, value, depth).distinct().withColumn(flag, F.lit(True))
                df = df.join(found, "uid", "left")
                parts.append(two_valued(F.col(flag)))
            else:
                if key not in df.columns:
                    raise SchemaError(f"{type_name} has no field {key}")
                ops = value if isinstance(value, dict) else {"eq": value}
                parts += [condition(F.col(key), op, v, self.vacuous, self.numeric) for op, v in ops.items() if op not in ("boost", "strategy")]
        return df, reduce(lambda a, b: a & b, parts) if parts else None
