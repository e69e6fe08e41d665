import pytest

from quern.functions.expressions import ExpressionError, parse, roots
from quern.functions.text import Term, parse_query, porter, python_tokens
from quern.operators.changes import Clock
from quern.operators.permissions import Rules
from quern.plans import control
from quern.plans.documents import parse as parse_document
from quern.sources.readers import frames_of
from quern.sources.schema import Catalog, SchemaError


def test_schema_inverses_interfaces_and_errors():
    c = Catalog.parse('interface N { name: String! } type A implements N { bs: [B!] @hasInverse(field: "a") } type B { a: A  other: A } union U = A | B enum E { X Y }')
    assert c["A"].fields["name"].required and c["A"].fields["bs"].many
    assert c.inverse("A", "bs").field == "a" and c.inverse("B", "a").field == "bs"
    assert c.concrete("N") == ["A"] and c.concrete("U") == ["A", "B"] and c["E"].members == ["X", "Y"]
    with pytest.raises(SchemaError):
        Catalog.parse('type A { b: B @hasInverse(field: "nope") } type B { x: Int }')


def test_expression_precedence_and_errors():
    n = parse("1 + 2 * 3 == 7 and not a.b[2] contains 'x'")
    assert n.value == "and" and n.args[0].value == "==" and roots(n) == {"a"}
    for bad in ("1 < 2 < 3", "a.", "f(1", "1 +", "#"):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_query_grammar_and_stems():
    assert parse_query('one "two three" fo*') == [Term(("one",)), Term(("two", "three")), Term(("fo",), True)]
    assert parse_query("don't") == [Term(("don",)), Term(("t",))] and parse_query("...") == []
    assert python_tokens("Éa, B_c") == ["ea", "b", "c"]
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat digitizer:digit hopefulness:hope triplicate:triplic revival:reviv adoption:adopt probate:probat controll:control running:run"
    assert [(a, porter(a)) for a in (p.split(":")[0] for p in pairs.split())] == [tuple(p.split(":")) for p in pairs.split()]


def test_documents_fragments_variables_aliases():
    op, = parse_document("query Q($n: Int = 3) { a: queryA(first: $n) { ...F ... on A { y } } } fragment F on A { x b { z } }")
    s = op.fields["a"]
    assert (s.field, s.args, list(s.fields), list(s.fields["b"].fields)) == ("queryA", {"first": 3}, ["x", "b", "y"], ["z"])
    with pytest.raises(SchemaError):
        parse_document("{ a { ...Missing } }")


def test_clock_orders_sends_and_receives():
    c = Clock(1)
    a, b = c.send(10), c.send(10)
    assert a < b < c.receive((50, 7, 2), 20) == (50, 8, 1)
    assert c.send(5) == (50, 9, 1)


def test_control_flow():
    seen = []
    assert control.for_each([1, 2, 3, 4], lambda x: seen.append(x), until=lambda x: x == 3) == 2 and seen == [1, 2]
    assert control.for_each([1, 2], lambda x: x > 1) == 2
    assert control.sequence([]) is None


def test_permission_precedence():
    r = Rules.parse("entity user {} entity d { relation a @user relation b @user @g#m permission p = a or b and not (a or b) permission q = a not b }")
    assert r.entities["d"].permissions["p"] == ("or", ("name", "a"), ("and", ("name", "b"), ("not", ("or", ("name", "a"), ("name", "b")))))
    assert r.entities["d"].permissions["q"] == ("minus", ("name", "a"), ("name", "b")) and r.entities["d"].relations["b"].targets == [("user", None), ("g", "m")]


def test_bulk_frames():
    body = b'[{"type_name": "A", "fields": {}}]'
    data = len(body).to_bytes(4, "little") + body
    assert len(list(frames_of(data * 2))) == 2
    with pytest.raises(ValueError):
        list(frames_of(data[:-1]))
