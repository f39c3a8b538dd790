from __future__ import annotations

import pytest

from motifold.functions.predicates import Kind, LiteralCondition, Op, Property, VariableCondition, hoistable, parse_predicate
from motifold.plans.cypher import convert, parse
from motifold.plans.pattern import Edge, Node, Pattern

FLAGSHIP = "MATCH (q1:Officer)-[e1:`director of`]->(q2:Entity)<-[e2:`shareholder of`]-(q3:Officer), (q2)-[e3:`registered address`]->(q4:Address) WHERE q1.name <> q3.name AND (q2.countries CONTAINS 'France' OR q4.countries CONTAINS 'France') RETURN q1, q2, q3, q4"


def test_flagship():
    p = parse(FLAGSHIP)
    assert list(p.nodes) == ["q1", "q2", "q3", "q4"]
    assert (p.edges["e2"].src, p.edges["e2"].dst, p.edges["e2"].types) == ("q3", "q2", ("shareholder of",))
    assert isinstance(p.where.conditions["c0"], VariableCondition)
    assert [i.name for i in p.returned.items] == ["q1", "q2", "q3", "q4"]


@pytest.mark.parametrize(
    "text, says",
    [
        ("RETURN x", "No MATCH"),
        ("MATCH (a)", "No RETURN"),
        ("MATCH (a)-[*1..2]->(b) RETURN a", "variable length"),
        ("MATCH (a {x: 1}) RETURN a", "inline"),
        ("OPTIONAL MATCH (a) RETURN a", "OPTIONAL"),
        ("MATCH (a) MATCH (b) RETURN a", "second clause"),
        ("MATCH (a) WHERE a.x =~ 'y' RETURN a", "Unsupported"),
        ("MATCH (a) WHERE a.x + 1 = 2 RETURN a", "Unsupported"),
        ("MATCH (a) WHERE size(a) = 2 RETURN a", "Unsupported"),
        ("MATCH (a) WHERE a.x = $p RETURN a", "Unsupported"),
        ("MATCH (a) WHERE 1 < a.x RETURN a", "Unsupported"),
        ("MATCH (a) WHERE a.x < 3 < 4 RETURN a", "chained"),
        ("MATCH (a) WHERE a:L RETURN a", "Unsupported"),
        ("MATCH (a) WHERE a.x = true RETURN a", "Unsupported"),
        ("MATCH (a)-[e]->(b) WHERE e.x = 1 RETURN a", "edge e are not supported"),
        ("MATCH (a) RETURN z", "not in the pattern"),
        ("MATCH (a)-[e]->(b)-[e]->(c) RETURN a", "two edges"),
        ("MATCH (a RETURN a", "expected"),
    ],
)
def test_rejections(text, says):
    pattern, error = convert(text)
    assert pattern is None and says in error


def test_all_atoms_parse():
    atoms = [f"a.x {op} {v}" for op in ("=", "<>", "<", "<=", ">", ">=") for v in ("1", "-2", "2.5", "'s'", "b.y")]
    atoms += ["a.x IN [1, 2]", "a.x IN [1.5]", "a.x IN ['p', 3]", "a.x IN []", "a.x IS NULL", "a.x IS NOT NULL", "a.x STARTS WITH 's'", "a.x ENDS WITH 's'", "a.x CONTAINS 's'"]
    text = " AND ".join(f"({x} OR NOT {x} XOR {x})" for x in atoms)
    p = parse(f"MATCH (a)-->(b) WHERE {text} RETURN a")
    assert len(p.where.conditions) == 3 * len(atoms)
    mixed = parse("MATCH (a) WHERE a.x IN ['p', 3] RETURN a").where.conditions["c0"]
    assert mixed.property.value == ("p",)


def test_anonymous_parts_are_distinct():
    p = parse("MATCH (a)-[]->()-[]->(b), ()--(a) RETURN a, b")
    assert len(p.nodes) == 4 and len(p.edges) == 3 and p.named_nodes == ["a", "b"]


def test_hoisting():
    p = parse("MATCH (a)-->(b) WHERE a.x = 1 AND (a.y = 2 OR b.z = 3) AND NOT b.w = 4 AND b.v IS NULL RETURN a")
    assert {v: [t.name for t in ts] for v, ts in hoistable(p.where.expression, p.where.conditions).items()} == {"a": ["x"]}


def test_query_graph():
    p = Pattern()
    p.add_node(Node("a", frozenset(["L"])))
    p.add_node(Node("b"))
    p.add_edge(Edge("e", "a", "b", ("T",)))
    assert p.outgoing("a") == p.incoming("b") == p.either("a") == [p.edges["e"]]
    assert p.nodes["a"].signature != p.nodes["b"].signature
    with pytest.raises(KeyError):
        p.add_edge(Edge("f", "a", "zz"))
    p.remove_node("b")
    assert not p.edges


@pytest.mark.parametrize(
    "test, stored, holds",
    [
        (Property("x", Op.EQ, 25), 25.7, False),
        (Property("x", Op.GT, 25), 25.7, True),
        (Property("x", Op.GT, 25), None, False),
        (Property("x", Op.IS_NULL), None, True),
        (Property("x", Op.CONTAINS, "ran"), ["France", "x"], True),
        (Property("x", Op.IN, ("a",)), ["a"], True),
        (Property("x", Op.IN, ("a",)), ["a", "b"], False),
        (Property("x", Op.IN, ("a",)), [], False),
        (Property("x", Op.IN, ("a",)), "a", True),
        (Property("x", Op.NOT_IN, ("a",)), ["a", "b"], True),
        (Property("x", Op.SOME_IN, (1, 2)), [2, 5], True),
        (Property("x", Op.IS_EMPTY), [], True),
        (Property("x", Op.NOT_CONTAINS, ("a", "b")), ["a"], True),
        (Property("x", Op.STARTS_WITH, "a"), 5, False),
    ],
)
def test_evaluation(test, stored, holds):
    assert test.evaluate(stored) is holds


def test_parsed_predicates():
    assert parse_predicate("n.x >= 2.5") == LiteralCondition("n", Property("x", Op.GE, 2.5))
    assert parse_predicate("n.x not  in ['a', 'b']").property.value == ("a", "b")
    assert parse_predicate("n.x = 5", {"x": Kind.STRING}).property.value == "5"
    assert parse_predicate("n.x IS NOT NULL").property.op is Op.IS_NOT_NULL
    with pytest.raises(ValueError):
        parse_predicate("n.x = abc", {"x": Kind.INTEGER})
