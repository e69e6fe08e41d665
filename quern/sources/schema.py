"""The type definition language: text to a catalog of types, fields and directives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKENS = re.compile(r'\s+|#[^\n]*|"""(?P<doc>.*?)"""|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark>\.\.\.|[{}()\[\]:!@=|&,$])', re.S)
BUILT_IN = {"ID", "String", "Int", "Int64", "Float", "Boolean", "DateTime", "Date", "Time", "JSON", "GeoPoint", "Point", "Polygon", "MultiPolygon"}


class SchemaError(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise SchemaError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup and m.lastgroup != "doc":
            value = m.group(m.lastgroup)
            out.append((m.lastgroup, re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), value) if m.lastgroup == "text" else value))
        at = m.end()
    return [t for t in out if t != ("mark", ",")]


class Cursor:
    """Tokens with one of look-ahead, shared by the definition and the query parser."""

    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def take(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.at += 1
            return True
        return False

    def expect(self, mark: str) -> None:
        if not self.take(mark):
            raise SchemaError(f"expected {mark!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "name":
            raise SchemaError(f"expected a name, found {value!r}")
        return value

    def value(self, variables: dict | None = None):
        kind, v = self.next()
        if kind == "text":
            return v
        if kind == "number":
            return float(v) if "." in v else int(v)
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(v, v)
        if (kind, v) == ("mark", "$"):
            n = self.name()
            if variables is None or n not in variables:
                raise SchemaError(f"variable {n} has no value")
            return variables[n]
        if (kind, v) == ("mark", "["):
            out = []
            while not self.take("]"):
                out.append(self.value(variables))
            return out
        if (kind, v) == ("mark", "{"):
            out = {}
            while not self.take("}"):
                k = self.name()
                self.expect(":")
                out[k] = self.value(variables)
            return out
        raise SchemaError(f"unexpected {v!r}")

    def arguments(self, variables: dict | None = None) -> dict:
        out = {}
        if self.take("("):
            while not self.take(")"):
                k = self.name()
                self.expect(":")
                out[k] = self.value(variables)
        return out


@dataclass
class Field:
    name: str
    base: str
    many: bool = False
    required: bool = False
    directives: dict[str, dict] = field(default_factory=dict)

    @property
    def compute(self) -> str | None:
        return self.directives.get("compute", {}).get("expr")


@dataclass
class Type:
    name: str
    kind: str  # type, interface, union, enum, scalar
    fields: dict[str, Field] = field(default_factory=dict)
    interfaces: list[str] = field(default_factory=list)
    members: list[str] = field(default_factory=list)

    def with_directive(self, name: str) -> list[str]:
        return [f.name for f in self.fields.values() if name in f.directives]


@dataclass
class Inverse:
    type: str
    field: str
    many: bool


class Catalog:
    """All types by name; relations and their inverses are derived from the definitions."""

    def __init__(self, types: dict[str, Type]):
        self.types = types

    @classmethod
    def parse(cls, text: str) -> Catalog:
        c, types = Cursor(text), {}
        while c.peek()[0] != "end":
            word = c.name()
            if word not in ("type", "interface", "union", "enum", "scalar", "input"):
                raise SchemaError(f"unexpected {word!r}")
            t = Type(c.name(), word)
            if c.peek() == ("name", "implements"):
                c.next()
                c.take("&")
                t.interfaces.append(c.name())
                while c.take("&") or c.peek()[0] == "name":
                    t.interfaces.append(c.name())
            _directives(c)
            if word == "union":
                c.expect("=")
                c.take("|")
                t.members.append(c.name())
                while c.take("|"):
                    t.members.append(c.name())
            elif word != "scalar":
                c.expect("{")
                while not c.take("}"):
                    n = c.name()
                    if word == "enum":
                        t.members.append(n)
                        _directives(c)
                    else:
                        c.expect(":")
                        base, many, required = _type(c)
                        t.fields[n] = Field(n, base, many, required, _directives(c))
            if t.name in types:
                raise SchemaError(f"type {t.name} is defined twice")
            types[t.name] = t
        out = cls(types)
        out._validate()
        return out

    def _validate(self) -> None:
        for t in self.types.values():
            for name in t.interfaces:
                for f in self[name].fields.values():
                    t.fields.setdefault(f.name, f)
            for f in t.fields.values():
                inverse = f.directives.get("hasInverse")
                if inverse and inverse.get("field") not in self[f.base].fields:
                    raise SchemaError(f"{t.name}.{f.name}: no field {inverse.get('field')} in {f.base}")

    def __getitem__(self, name: str) -> Type:
        if name not in self.types:
            raise SchemaError(f"unknown type {name}")
        return self.types[name]

    def is_relation(self, f: Field) -> bool:
        return f.base in self.types and self.types[f.base].kind in ("type", "interface", "union")

    def inverse(self, type_name: str, field_name: str) -> Inverse | None:
        """The declared inverse, or the only field of the target that has our type."""
        f = self[type_name].fields[field_name]
        target = self[f.base]
        named = f.directives.get("hasInverse", {}).get("field")
        if not named:
            back = [g.name for g in target.fields.values() if g.directives.get("hasInverse", {}).get("field") == field_name and g.base == type_name]
            same = back or [g.name for g in target.fields.values() if g.base == type_name]
            named = same[0] if len(same) == 1 else None
        return Inverse(target.name, named, target.fields[named].many) if named else None

    def concrete(self, name: str) -> list[str]:
        """The types behind an interface or union; a type stands for itself."""
        t = self[name]
        if t.kind == "union":
            return t.members
        if t.kind == "interface":
            return [x.name for x in self.types.values() if name in x.interfaces and x.kind == "type"]
        return [name]


def _type(c: Cursor) -> tuple[str, bool, bool]:
    if c.take("["):
        base, _, _ = _type(c)
        c.expect("]")
        return base, True, c.take("!")
    return c.name(), False, c.take("!")


def _directives(c: Cursor) -> dict[str, dict]:
    out = {}
    while c.take("@"):
        name = c.name()
        out[name] = c.arguments()
    return out
