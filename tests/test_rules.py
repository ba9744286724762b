import pytest

from hornpress.functions.scores import Eval, metric
from hornpress.plans.rules import Pruner, generalizations, is_specialization, parse_rule, same_rule, specializations, steps_to

SCHEMA = [("family", 3), ("father", 2), ("mother", 2), ("isMale", 1)]
CONSTANTS = {("family", 0): [1], ("family", 1): [2]}


def test_text_and_length():
    r = parse_rule("h(X, Y, ?, 7) :- p(X,Z), q(Z,Y,W), h(?,a,?,?)", {"a": 3}.get)
    assert str(r) == "h(X0,X1,?,7):-p(X0,X2),q(X2,X1,?),h(?,3,?,?)"
    assert r.length == 5
    assert parse_rule(str(r)) == r
    assert parse_rule("h(?):-").length == 0


@pytest.mark.parametrize("bad", ["", "h(X", "h(X),p(X)", "h(X):-p(X):-q(X)", "h(,):-"])
def test_bad_text(bad):
    with pytest.raises(ValueError):
        parse_rule(bad)


@pytest.mark.parametrize(("rule", "count"), [("family(?,?,?):-", 26), ("family(?,X,?):-father(X,?)", 36)])
def test_specializations(rule, count):
    r, p = parse_rule(rule), Pruner()
    p.fresh(r)
    new = [s for s in specializations(r, SCHEMA, CONSTANTS) if p.fresh(s)]
    assert len(new) == count
    assert all(s.length == r.length + 1 and is_specialization(s, r) for s in new)
    for i, a in enumerate(new):
        assert not any(same_rule(a, b) for b in new[:i])


def test_generalizations():
    r, p = parse_rule("family(Y,X,Z):-father(X,Z),mother(Y,?),isMale(Z)"), Pruner()
    p.fresh(parse_rule("family(Y,X,Z):-father(X,Z),mother(Y,?)"))
    got = [g for g in generalizations(r) if p.fresh(g)]
    want = ["family(?,X,Y):-father(X,Y),isMale(Y)", "family(Y,?,X):-father(?,X),mother(Y,?),isMale(X)", "family(Y,X,?):-father(X,Z),mother(Y,?),isMale(Z)", "family(Y,X,Z):-father(X,?),mother(Y,?),isMale(Z)"]
    assert len(got) == 4 and all(any(same_rule(g, parse_rule(w)) for g in got) for w in want)


@pytest.mark.parametrize(("rule", "invalid"), [
    ("father(X,?):-father(X,?)", True), ("father(X,Y):-father(Y,X)", False), ("father(X,?):-father(Y,X),father(Y,X)", True),
    ("h(?,?):-p(X,X)", True), ("h(X,?):-p(X,?),q(Y,Y)", True), ("h(X):-p(X,?),q(3)", True), ("h(3,?):-", False),
])
def test_validity(rule, invalid):
    assert parse_rule(rule).invalid is invalid


def test_fingerprints():
    a, b = parse_rule("h(X,Y):-p(X,Z),q(Z,Y)"), parse_rule("h(U,V):-q(W,V),p(U,W)")
    assert a.fingerprint == b.fingerprint and same_rule(a, b)
    assert a.fingerprint != parse_rule("h(X,Y):-p(X,Z),q(Y,Z)").fingerprint
    assert parse_rule("h(X,?):-p(X,?)").generalization_of(a)
    assert not parse_rule("h(X,X):-").generalization_of(a)


def test_tabu():
    p = Pruner()
    p.add_tabu(parse_rule("h(X,?):-p(X,?)"))
    assert p.is_tabu(parse_rule("h(X,Y):-p(X,Y)")) and not p.is_tabu(parse_rule("h(X,Y):-q(X,Y)"))


def test_steps_to():
    r = parse_rule("h(X,Y,4):-p(X,Z),q(Z,Y)")
    way = steps_to(r)
    assert [w.length for w in way] == list(range(r.length + 1)) and way[-1] == r
    with pytest.raises(ValueError):
        steps_to(parse_rule("h(X,?):-p(X,?),q(Y,Y)"))


def test_scores():
    e = Eval(6, 7, 3)
    assert (e.neg, e.tau, e.delta, e.useful) == (1, 0.6, 2, True)
    z = Eval(0, 0, 0)
    assert (z.tau, z.delta, z.h, z.useful) == (0, 0, 0, False)
    assert (metric("δ"), metric("h"), metric("nonsense")) == ("delta", "h", "tau")
    assert e.h_simple > 0 and z.h_simple == float("-inf") and e.h_of(Eval(6, 12, 1)) > 0
