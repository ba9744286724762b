import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from hornpress.functions.scores import Eval
from hornpress.plans import compile as cp
from hornpress.plans import estimate as es
from hornpress.plans.rules import Pruner, Rule, Var, parse_rule
from hornpress.plans.search import Config, Scored, Scorer
from tests.fixtures import FAMILY, KIN, kb, shuffled


@pytest.fixture(scope="module")
def scorer(spark):
    return Scorer(kb(spark, FAMILY, 17).persisted(), Config(beam=3, metric="delta", coverage=0.0, constants=0.25))


@pytest.mark.parametrize(("tables", "n", "start"), [(FAMILY, 17, "father(X,?):-family(?,X,?)"), (KIN, 16, "grandParent(X,?):-parent(X,?)"), (KIN, 16, "parent(?,?):-")])
def test_batched_scores_are_those_of_single_rules(spark, tables, n, start):
    base = kb(spark, tables, n).persisted()
    s = Scorer(base, Config(coverage=-1.0))
    rule = parse_rule(start)
    children = s.children([Scored(rule, cp.evaluate(rule, base))], Pruner())[0]
    assert children
    for c in random.Random(1).sample(children, min(8, len(children))):
        plain = cp.evaluate(c.rule, base)
        assert (c.eval.pos, c.eval.all, c.eval.length) == (plain.pos, plain.all, plain.length), str(c.rule)


def test_batched_scores_after_entailment(spark):
    base = kb(spark, KIN, 16).persisted()
    first = parse_rule("parent(X,?):-father(X,?)")
    base = base.with_relation(base["parent"].entail(cp.newly_entailed(first, base)))
    s = Scorer(base, Config(coverage=-1.0))
    start = Rule.start("parent", 2)
    for c in s.children([Scored(start, cp.evaluate(start, base))], Pruner())[0][:6]:
        plain = cp.evaluate(c.rule, base)
        assert (c.eval.pos, c.eval.all) == (plain.pos, plain.all), str(c.rule)


@pytest.mark.parametrize("pick", [es.by_estimate, es.at_random(3)])
def test_estimated_and_random_searches_give_true_scores(scorer, pick):
    found = es.find_rule_by(scorer, "mother", Pruner(), pick)
    if found is not None:
        plain = cp.evaluate(found.rule, scorer.kb)
        assert Eval(plain.pos, plain.all, plain.length) == Eval(found.eval.pos, found.eval.all, found.eval.length) and found.eval.useful


def test_estimates_are_bounded(scorer):
    start = Rule.start("father", 2)
    ranked = es.ranked_children(scorer, [Scored(start, cp.evaluate(start, scorer.kb))], Pruner())
    assert ranked and all(0 <= e.pos <= 4 and e.pos <= e.all for e, *_ in ranked)
    values = [e.delta for e, *_ in ranked]
    assert values == sorted(values, reverse=True)


def test_links():
    r = parse_rule("h(X,Y):-p(X,Z),q(Z,Y),p(X,Z)")
    x, y, z = (Var(k) for k in range(3))
    assert es.shared_links(r)[x, z] == 2 and es.shortest_link(r, x, y) == [x, z, y]
    assert es.shortest_link(parse_rule("h(X,Y):-p(X,X),q(Y,Y)"), x, y) is None


def test_inversions(spark):
    row = es.inversions(spark.createDataFrame([(3.0, 1.0), (2.0, 2.0), (1.0, 3.0), (0.0, 0.0)], "estimate double, exact double")).first()
    assert (row.inversions, row.pairs) == (3, 6)


@pytest.mark.parametrize("kind", ["spread", "tied", "one", "none", "odd"])
def test_inversions_of_large_rankings(spark, kind, monkeypatch):
    rng = random.Random(7)
    rows = {
        "spread": [(rng.random(), rng.random()) for _ in range(1500)],
        "tied": [(float(rng.choice([0, 0, 0, rng.randint(1, 300)])), float(rng.choice([5, 5, rng.randint(1, 9)]))) for _ in range(1500)],
        "one": [(1.0, rng.random()) for _ in range(300)],
        "none": [],
        "odd": [(rng.choice([None, float("nan"), rng.random(), 0.0, -0.0]), rng.choice([None, float("nan"), rng.random()])) for _ in range(400)],
    }[kind]
    monkeypatch.setattr(es, "INTERVAL", 50)
    df = spark.createDataFrame(rows, "estimate double, exact double")
    pairs = df.alias("x").join(df.alias("y"), F.col("x.estimate") > F.col("y.estimate"))
    want = pairs.agg(F.count_if(F.col("x.exact") < F.col("y.exact")), F.count("*")).first()
    got = es.inversions(df).first()
    assert (got.inversions, got.pairs) == tuple(want)


def test_whole_rankings_list_no_pairs(spark, monkeypatch):
    from hornpress import queries as q
    from hornpress import queries_rules  # noqa: F401 - registers the query

    row = q.QUERIES["inversions"](spark, "/root/testdata/sf0.01").first()
    assert row.pairs > 1_000_000  # 1,500 customers, not 60
    monkeypatch.setattr(type(spark.range(1)), "join", None)
    n = 200_000
    row = es.inversions(spark.range(n).select(F.col("id").cast("double").alias("estimate"), (-F.col("id")).cast("double").alias("exact"))).first()
    assert (row.inversions, row.pairs, row.share) == (n * (n - 1) // 2, n * (n - 1) // 2, 1.0)


def estimates(spark, tables, n, text, constants=0.25):
    """{rule: (estimate, exact)} of a rule's candidates."""
    base = kb(spark, tables, n).persisted()
    s = Scorer(base, Config(metric="delta", coverage=0.0, constants=constants))
    rule = parse_rule(text)
    return base, {str(r): (e, r) for e, _, r, _ in es.ranked_children(s, [Scored(rule, cp.evaluate(rule, base))], Pruner())}


def exact(base, found, text):
    e, rule = found[text] if text in found else found[str(parse_rule(text))]
    plain = cp.evaluate(rule, base)
    assert (e.pos, e.all) == pytest.approx((plain.pos, plain.all)), text


def test_constants_are_estimated_by_their_counts(spark):
    rows = [(i, 21 if i <= 18 else 22) for i in range(1, 21)]
    base, found = estimates(spark, {"h": rows, "p": rows}, 22, "h(?,?):-", 0.1)
    exact(base, found, "h(?,21):-")
    exact(base, found, "h(?,22):-")
    base, found = estimates(spark, {"h": [(i,) for i in range(1, 4)], "p": rows}, 22, "h(X):-p(X,?)", 0.1)
    exact(base, found, "h(X):-p(X,21)")
    exact(base, found, "h(X):-p(X,22)")


def test_joins_may_remove_wrong_tuples(spark):
    p = [(i, i + 20) for i in range(1, 21)]
    base, found = estimates(spark, {"h": p[:4], "p": p, "q": [(i,) for i in range(1, 5)]}, 40, "h(X,Y):-p(X,Y)")
    exact(base, found, "h(X,Y):-p(X,Y),q(X)")


def test_links_of_head_variables(spark):
    p, q = [(i, i + 10) for i in range(1, 11)], [(i + 10, i + 20) for i in range(1, 11)]
    tables = {"h": [(i, i + 20) for i in range(1, 11)], "p": p, "q": q}
    base, found = estimates(spark, tables, 30, "h(X,Y):-p(X,?),q(?,Y)")
    exact(base, found, "h(X,Y):-p(X,Z),q(Z,Y)")
    base, found = estimates(spark, tables, 30, "h(X,?):-p(X,Z),q(Z,?)")
    exact(base, found, "h(X0,X2):-p(X0,X1),q(X1,X2)")


def test_entailed_rows_are_estimated_apart(spark):
    p = [(i, i + 20) for i in range(1, 21)]
    base = kb(spark, {"h": p[:10], "p": p, "q": [(i,) for i in range(4, 9)]}, 40).persisted()
    base = base.with_relation(base["h"].entail(base["h"].df.filter("a0 <= 5")))
    s = Scorer(base, Config(metric="delta", coverage=0.0))
    rule = parse_rule("h(X,Y):-p(X,Y)")
    found = {str(r): (e, r) for e, _, r, _ in es.ranked_children(s, [Scored(rule, cp.evaluate(rule, base))], Pruner())}
    exact(base, found, "h(X,Y):-p(X,Y),q(X)")


def test_scores_of_joins_taken_apart(spark, monkeypatch):
    """Counted without listing groundings, scores are those of single rules."""
    import random as rnd

    from hornpress.plans import search

    draw = rnd.Random(5)
    pairs = lambda n: sorted({(draw.randint(1, 9), draw.randint(1, 9)) for _ in range(n)})
    base = kb(spark, {"p": pairs(22), "q": pairs(18), "u": [(k,) for k in (1, 3, 4, 8)], "f": [(k, k % 3 + 1) for k in range(1, 10)]}, 9).persisted()
    first = parse_rule("p(X,?):-u(X)")
    base = base.with_relation(base["p"].entail(cp.newly_entailed(first, base)))
    monkeypatch.setattr(search, "MANY_ROWS", 0)
    monkeypatch.setattr(search, "FEW_TUPLES", 0)
    s = Scorer(base, Config(coverage=-1.0))
    for text in ("p(?,?):-", "p(X,?):-q(?,X)", "p(X,Y):-q(X,Z),f(Y,Z)", "p(X,Y):-f(X,?),q(?,Y)", "p(X,Y):-q(X,Z),q(Z,Y)"):
        rule = parse_rule(text)
        children = s.children([Scored(rule, cp.evaluate(rule, base))], Pruner())[0]
        chosen = draw.sample(children, min(12, len(children)))
        rows = [cp.evaluation(c.rule, base).selectExpr(f"{k} as k", "pos", "`all`") for k, c in enumerate(chosen)]
        plain = {r["k"]: (r["pos"], r["all"]) for r in reduce(lambda x, y: x.unionByName(y), rows).collect()}
        assert {k: (c.eval.pos, c.eval.all) for k, c in enumerate(chosen)} == plain


def test_groundings_of_a_hub_are_not_listed(spark, monkeypatch):
    from hornpress.plans import search

    monkeypatch.setattr(search, "MANY_ROWS", 100_000, raising=False)
    monkeypatch.setattr(search, "FEW_TUPLES", 100, raising=False)
    made = {"oc": [(k, 3001 + k % 500) for k in range(1, 2001)], "on": [(k, 4001 + k % 500 % 5) for k in range(1, 2001)], "cn": [(3001 + c, 4001 + c % 5) for c in range(500)]}
    base = kb(spark, made, 4005).persisted()
    rule, s = parse_rule("on(?,X):-cn(?,X)"), Scorer(base, Config())
    start, found = Scored(rule, cp.evaluate(rule, base)), []
    assert shuffled(spark, lambda: found.extend(s.children([start], Pruner())[0])) < 100_000  # groundings: 200,000
    scores = {(c.eval.pos, c.eval.all) for c in found if {"oc", "cn"} <= {b.pred for b in c.rule.body}}
    assert (2000, 10_000) in scores
