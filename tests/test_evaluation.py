import pytest

from hornpress.functions.scores import Eval
from hornpress.plans import compile as cp
from hornpress.plans.rules import parse_rule
from tests.fixtures import KIN, kb, rows_of

#: rule, rules accepted before it, (pos, all, length)
GOLDEN = [
    ("parent(?,?):-", [], (9, 256, 0)),
    ("parent(X,?):-father(X,?)", [], (4, 64, 1)),
    ("parent(X,Y):-father(X,Y)", ["parent(X,?):-father(X,?)"], (0, 2, 2)),
    ("parent(?,X):-father(?,X)", [], (4, 80, 1)),
    ("grandParent(?,?):-", [], (3, 256, 0)),
    ("grandParent(X,?):-parent(X,?)", [], (2, 96, 1)),
    ("grandParent(X,Y):-parent(X,?),parent(?,Y)", [], (2, 48, 2)),
    ("grandParent(X,?):-parent(X,Y),parent(Y,?)", [], (2, 32, 2)),
    ("grandParent(X,Z):-parent(X,Y),parent(Y,Z)", [], (2, 4, 3)),
    ("grandParent(X,?):-parent(X,Y),father(Y,?)", [], (2, 48, 2)),
    ("grandParent(X,Z):-parent(X,Y),father(Y,Z)", [], (2, 4, 3)),
    ("grandParent(?,X):-father(?,X)", [], (2, 80, 1)),
    ("grandParent(1,X):-father(?,X)", [], (1, 5, 2)),
    ("grandParent(1,X):-father(6,X)", [], (0, 2, 3)),
    ("grandParent(1,X):-father(6,X)", ["grandParent(1,X):-father(?,X)"], (0, 2, 3)),
    ("parent(X,X):-", [], (0, 16, 1)),
    ("father(X,?):-parent(?,X)", [], (4, 128, 1)),
    ("father(X,?):-parent(?,X),parent(X,?)", [], (3, 48, 2)),
    ("father(6,?):-", [], (2, 16, 1)),
    ("father(?,?):-", ["father(6,?):-"], (3, 254, 0)),
    ("grandParent(Y,X):-father(?,X),parent(Y,?)", [], (2, 30, 2)),
    ("parent(6,?):-", [], (2, 16, 1)),
    ("parent(6,15):-", [], (1, 1, 2)),
    ("parent(6,X):-father(?,X)", [], (2, 5, 2)),
]

MORE = [
    ({"p": [(1, 2, 3), (4, 5, 3), (6, 7, 8)], "h": [(1, 1, 2, 2), (4, 4, 5, 5)]}, "h(X,X,Y,Y):-p(X,Y,3)", (2, 2, 5), set()),
    ({"p": [(2, 1), (1, 1), (2, 2), (3, 1)], "q": [(3,), (1,)], "h": [(1,)]}, "h(X):-p(X,X),q(X)", (1, 1, 3), set()),
    ({"h": [(1, 1), (2, 2), (1, 3)]}, "h(X,X):-", (2, 3, 1), {(3, 3)}),
    ({"h": [(1, 1, 2), (2, 2, 1), (1, 2, 2)]}, "h(X,X,?):-", (2, 4, 1), {(1, 1, 1), (2, 2, 2)}),
]


@pytest.fixture(scope="module")
def kin(spark):
    return kb(spark, KIN, 16).persisted()


@pytest.mark.parametrize(("rule", "before", "want"), GOLDEN)
def test_golden(kin, rule, before, want):
    base = kin
    for b in before:
        r = parse_rule(b)
        base = base.with_relation(base[r.head.pred].entail(cp.newly_entailed(r, base)))
    assert cp.evaluate(parse_rule(rule), base) == Eval(*want)


@pytest.mark.parametrize(("relations", "rule", "want", "counter"), MORE)
def test_repeated_variables(spark, relations, rule, want, counter):
    base = kb(spark, relations)
    r = parse_rule(rule)
    assert cp.evaluate(r, base) == Eval(*want)
    assert rows_of(cp.counterexamples(r, base)) == counter


def test_counterexamples_and_coverage(kin):
    r = parse_rule("parent(X,Y):-father(X,Y)")
    assert rows_of(cp.counterexamples(r, kin)) == {(7, 12), (8, 16)}
    assert cp.coverage(parse_rule("parent(X,?):-father(X,?)"), kin) == pytest.approx(4 / 9)
    assert cp.counterexamples(parse_rule("parent(X,?):-father(X,?)"), kin).count() == 60


def test_evidence(kin):
    got = {tuple(r["head"]): [tuple(b) for b in r["body"]] for r in cp.evidence(parse_rule("grandParent(X,Z):-parent(X,Y),father(Y,Z)"), kin).collect()}
    assert got == {(1, 10): [(1, 5), (5, 10)], (2, 15): [(2, 6), (6, 15)]}
    axiom = cp.evidence(parse_rule("father(6,?):-"), kin).collect()
    assert {(tuple(r["head"]), r["body"]) for r in axiom} == {((6, 11), None), ((6, 15), None)}


@pytest.mark.parametrize("with_values", [False, True])
@pytest.mark.parametrize(
    ("text", "used"),
    [
        ("h(X,Y):-p(X,Z,Z),q(Y,W)", ["b1_a0", "b2_a1"]),
        ("h(X,?):-p(X,Z,Z)", []),
        ("h(X,Y):-p(X,Z,?),q(Z,Y)", ["b1_a2"]),
        ("h(X,?):-p(X,2,?),q(?,X)", ["b2_a0"]),
        ("h(X,X):-q(X,?)", ["b1_a1"]),
        ("h(1,Y):-p(?,?,Y)", ["b1_a0"]),
    ],
)
def test_reduced_groundings_hold_the_values_of_whole_ones(spark, text, used, with_values):
    p = [(1, 2, 2), (1, 3, 2), (2, 2, 4), (3, 3, 3), (4, 1, 1), (2, 2, 1)]
    base = kb(spark, {"h": [(1, 2), (1, 1), (2, 4), (3, 3), (4, 2)], "p": p, "q": [(2, 2), (3, 2), (1, 4), (2, 4), (2, 1), (3, 3)]})
    if with_values:
        assert base.colvals.count()
    rule = parse_rule(text)
    cols = ["h_a0", "h_a1", *used]
    want = {tuple(r) for r in cp.groundings(rule, base).select(*cols).collect()}
    assert {tuple(r) for r in cp.reduced_groundings(rule, base, used).select(*cols).collect()} == want and want
