"""Relationship-based permissions: a schema of relations and set expressions, evaluated for all entities at once.

Every relation and permission becomes a frame (entity, subject); ``or``, ``and`` and ``not`` are union, intersection and
difference of such frames, and a recursive permission is the least fixed point, found round by round.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expressions import Compiler
from quern.sources.staging import handed_over

TUPLE = "entity_type string, entity_id bigint, relation string, subject_type string, subject_id bigint, subject_relation string"
LEX = re.compile(r"\s+|//[^\n]*|(?P<name>[A-Za-z_]\w*)|(?P<mark>[{}()=@#.,])|(?P<other>[^\s\w{}()=@#.,]+|\d[\d.]*)")
MOST_ROUNDS = 100


class PermissionError_(ValueError):
    pass


@dataclass
class Relation:
    name: str
    targets: list[tuple[str, str | None]]  # (type, relation after # or None)


@dataclass
class Entity:
    name: str
    relations: dict[str, Relation] = field(default_factory=dict)
    permissions: dict[str, tuple] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Rules:
    entities: dict[str, Entity]
    rules: dict[str, tuple[list[str], str]]

    @classmethod
    def parse(cls, text: str) -> Rules:
        """``entity``s with ``relation r @t @t#r``, ``attribute a boolean``, ``permission p = expr`` (or ``action``), and ``rule f(a, b) { expr }``, in the expression language with && and || for and and or."""
        rules = {}
        for m in re.finditer(r"\brule\s+(\w+)\s*\(([^)]*)\)\s*\{([^}]*)\}", text):
            rules[m[1]] = [p.split()[0] for p in m[2].split(",") if p.strip()], m[3].strip().removeprefix("return").strip().rstrip(";").replace("&&", " and ").replace("||", " or ")
        text = re.sub(r"\brule\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", "", text)
        tokens = [(m.lastgroup, m[m.lastgroup]) for m in LEX.finditer(text) if m.lastgroup]
        tokens.append(("end", ""))
        k, entities = 0, {}

        def take(value=None):
            nonlocal k
            if value is not None and tokens[k][1] != value:
                raise PermissionError_(f"expected {value!r}, found {tokens[k][1]!r}")
            k += 1
            return tokens[k - 1][1]

        def union():
            node = both()
            while tokens[k][1] == "or":
                take()
                node = ("or", node, both())
            return node

        def both():
            node = negated()
            while tokens[k][1] in ("and", "not"):
                node = ("and", node, negated()) if take() == "and" else ("minus", node, negated())
            return node

        def negated():
            if tokens[k][1] == "not":
                take()
                return ("not", negated())
            if tokens[k][1] == "(":
                take()
                node = union()
                take(")")
                return node
            name = take()
            if tokens[k][1] == ".":
                take()
                return ("through", name, take())
            if tokens[k][1] == "(":
                take()
                args = []
                while tokens[k][1] != ")":
                    args.append(take())
                    if tokens[k][1] == ",":
                        take()
                take()
                return ("call", name, tuple(args))
            return ("name", name)

        while tokens[k][0] != "end":
            take("entity")
            e = entities.setdefault(tokens[k][1], Entity(tokens[k][1]))
            take()
            take("{")
            while tokens[k][1] != "}":
                word, name = take(), take()
                if word == "relation":
                    targets = []
                    while tokens[k][1] == "@":
                        take()
                        t, r = take(), None
                        if tokens[k][1] == "#":
                            take()
                            r = take()
                        targets.append((t, r))
                    e.relations[name] = Relation(name, targets)
                elif word == "attribute":
                    e.attributes[name] = take()
                elif word in ("permission", "action"):
                    take("=")
                    e.permissions[name] = union()
                else:
                    raise PermissionError_(f"unexpected {word!r}")
            take("}")
        return cls(entities, rules)


class Access:
    """``tuples`` has the columns of TUPLE; ``attributes``: entity_type, entity_id, attribute, value (double; true is 1)."""

    def __init__(self, spark: SparkSession, rules: Rules | str, tuples: DataFrame, attributes: DataFrame | None = None, subject_type: str = "user"):
        self.spark = spark
        self.rules = Rules.parse(rules) if isinstance(rules, str) else rules
        self.tuples, self.attributes, self.subject_type = tuples, attributes, subject_type
        self.state: dict[tuple[str, str], DataFrame] = {}
        self._asked: list[int] | None = None

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "entity bigint, subject bigint")

    def _known(self, entity: str, name: str) -> DataFrame:
        return self.state.get((entity, name)) if (entity, name) in self.state else self._empty()

    def _relation(self, entity: str, r: Relation) -> DataFrame:
        own = self.tuples.filter((F.col("entity_type") == entity) & (F.col("relation") == r.name))
        plain = own.filter((F.col("subject_type") == self.subject_type) & F.col("subject_relation").isNull())
        if self._asked is not None:  # every pair starts from a plain tuple of its subject
            plain = plain.filter(F.col("subject_id").isin(self._asked))
        parts = [plain.select(F.col("entity_id").alias("entity"), F.col("subject_id").alias("subject"))]
        for t, sub in r.targets:
            if sub and t in self.rules.entities:  # members of a set of subjects
                sets = own.filter((F.col("subject_type") == t) & (F.col("subject_relation") == sub)).select(F.col("entity_id").alias("e"), F.col("subject_id").alias("s"))
                parts.append(sets.join(self._known(t, sub).select(F.col("entity").alias("s"), "subject"), "s").select(F.col("e").alias("entity"), "subject"))
        return reduce(lambda a, b: a.union(b), parts)

    def links(self, entity: str, relation: str) -> DataFrame:
        """(e, target type, t): plain subjects of a relation, to go on through."""
        own = self.tuples.filter((F.col("entity_type") == entity) & (F.col("relation") == relation) & F.col("subject_relation").isNull())
        return own.select(F.col("entity_id").alias("e"), F.col("subject_type").alias("tt"), F.col("subject_id").alias("t"))

    def _everyone(self, entity: str) -> DataFrame:
        """What a bare ``not``, an attribute or a rule can answer with: the entities that occur, for each asked subject."""
        if self._asked is None:
            raise PermissionError_("name the subjects: a negation, attribute or rule holds for every subject there is")
        of = [self.tuples.select("entity_type", "entity_id")] + ([self.attributes.select("entity_type", "entity_id")] if self.attributes is not None else [])
        e = reduce(lambda a, b: a.union(b), of).filter(F.col("entity_type") == entity).select(F.col("entity_id").alias("entity")).distinct()
        return e.select("entity", F.explode(F.array(*(F.lit(x).cast("bigint") for x in self._asked))).alias("subject"))

    def _rule(self, entity: str, call: tuple) -> DataFrame:
        _, name, args = call
        if name not in self.rules.rules or self.attributes is None:
            return self._empty()
        params, body = self.rules.rules[name]
        own = self.attributes.filter(F.col("entity_type") == entity)
        wide = own.groupBy(F.col("entity_id").alias("entity")).agg(*(F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(p) for p, a in zip(params, args)))
        ok = wide.filter(F.coalesce(Compiler(wide.schema, strict=False).column(body), F.lit(False))).select("entity")
        return self._everyone(entity).join(ok, "entity", "left_semi")

    def _eval(self, entity: str, node: tuple) -> DataFrame:
        kind = node[0]
        e = self.rules.entities[entity]
        if kind == "or":
            return self._eval(entity, node[1]).union(self._eval(entity, node[2]))
        if kind == "and":
            return self._eval(entity, node[1]).join(self._eval(entity, node[2]).distinct(), ["entity", "subject"], "left_semi")
        if kind == "minus":
            return self._eval(entity, node[1]).join(self._eval(entity, node[2]), ["entity", "subject"], "left_anti")
        if kind == "not":
            return self._everyone(entity).join(self._eval(entity, node[1]), ["entity", "subject"], "left_anti")
        if kind == "through":
            parts = []
            for t in {t for t, _ in e.relations[node[1]].targets} if node[1] in e.relations else ():
                if t in self.rules.entities:
                    hop = self.links(entity, node[1]).filter(F.col("tt") == t)
                    parts.append(hop.join(self._known(t, node[2]).select(F.col("entity").alias("t"), "subject"), "t").select(F.col("e").alias("entity"), "subject"))
            return reduce(lambda a, b: a.union(b), parts) if parts else self._empty()
        if kind == "call":
            return self._rule(entity, node)
        if node[1] in e.relations or node[1] in e.permissions:
            return self._known(entity, node[1])
        if node[1] in e.attributes and self.attributes is not None:
            true = self.attributes.filter((F.col("entity_type") == entity) & (F.col("attribute") == node[1]) & (F.col("value") == 1)).select(F.col("entity_id").alias("entity"))
            return self._everyone(entity).join(true, "entity", "left_semi")
        return self._empty()  # unknown names deny

    def _names(self, entity: str, name: str, seen: set) -> set:
        """All (entity, name) that a permission depends on."""
        if (entity, name) in seen or entity not in self.rules.entities:
            return seen
        e = self.rules.entities[entity]
        if name in e.relations:
            seen.add((entity, name))
            for t, sub in e.relations[name].targets:
                if sub:
                    self._names(t, sub, seen)
        elif name in e.permissions:
            seen.add((entity, name))
            stack = [e.permissions[name]]
            while stack:
                n = stack.pop()
                if n[0] == "name":
                    self._names(entity, n[1], seen)
                elif n[0] == "through" and n[1] in e.relations:
                    for t, _ in e.relations[n[1]].targets:
                        self._names(t, n[2], seen)
                elif n[0] in ("or", "and", "minus", "not"):
                    stack += n[1:]
        return seen

    def allowed(self, entity: str, permission: str, subjects: list[int] | None = None) -> DataFrame:
        """(entity, subject) for every pair that has the permission, or for the pairs of the ``subjects`` named, whose tuples
        alone are then followed; a bare ``not``, attributes and rules need them. A recursion that does not settle in
        MOST_ROUNDS rounds is an error."""
        self._asked = subjects
        self.state = {}
        names = sorted(self._names(entity, permission, set()))
        # in the order of dependence where there is one; a cycle is settled by repeating until nothing is added
        order, done = [], set()
        while len(order) < len(names):
            ready = [n for n in names if n not in done and self._needs(n) - {n} <= done] or [n for n in names if n not in done]
            order += ready
            done |= set(ready)
        recursive = any(n in self._reach(n) for n in names)
        seen: dict[tuple[str, str], tuple] = {}
        for _ in range(MOST_ROUNDS):
            changed = False
            for e, name in order:
                spec = self.rules.entities[e]
                new = (self._relation(e, spec.relations[name]) if name in spec.relations else self._eval(e, spec.permissions[name])).distinct()
                if recursive:
                    new = handed_over(new, "pairs")
                    now = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("entity", "subject"))).first())
                    changed |= now != seen.get((e, name), (0, None))
                    seen[e, name] = now
                self.state[e, name] = new
            if not changed:
                return self._known(entity, permission)
        raise PermissionError_(f"{entity}.{permission} does not settle in {MOST_ROUNDS} rounds")

    def _needs(self, n: tuple[str, str]) -> set:
        e = self.rules.entities[n[0]]
        out: set = set()
        if n[1] in e.relations:
            return {(t, s) for t, s in e.relations[n[1]].targets if s}
        stack = [e.permissions[n[1]]]
        while stack:
            x = stack.pop()
            if x[0] == "name":
                out.add((n[0], x[1]))
            elif x[0] == "through" and x[1] in e.relations:
                out |= {(t, x[2]) for t, _ in e.relations[x[1]].targets}
            elif x[0] in ("or", "and", "minus", "not"):
                stack += x[1:]
        return {(t, s) for t, s in out if t in self.rules.entities and (s in self.rules.entities[t].relations or s in self.rules.entities[t].permissions)}

    def _reach(self, n: tuple[str, str]) -> set:
        seen: set = set()
        stack = [n]
        while stack:
            for m in self._needs(stack.pop()):
                if m not in seen:
                    seen.add(m)
                    stack.append(m)
        return seen

    def check(self, checks: list[tuple[str, int, str]], subject: int) -> DataFrame:
        """(entity_type, entity_id, permission, allowed) for every asked triple and one subject; unknown names deny."""
        parts = []
        for e, p in sorted({(e, p) for e, _, p in checks}):
            ok = self.allowed(e, p, [subject]) if e in self.rules.entities else self._empty()
            parts.append(ok.filter(F.col("subject") == subject).select(F.lit(e).alias("entity_type"), F.col("entity").alias("entity_id"), F.lit(p).alias("permission")).distinct())
        asked = self.spark.createDataFrame(checks, "entity_type string, entity_id bigint, permission string")
        yes = reduce(lambda a, b: a.union(b), parts).withColumn("allowed", F.lit(True))
        return asked.join(yes, ["entity_type", "entity_id", "permission"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
