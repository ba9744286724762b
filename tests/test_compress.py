import random

import pytest
from pyspark.sql import functions as F

from hornpress.functions.scores import Eval
from hornpress.operators import graph
from hornpress.operators.recovery import recover, select
from hornpress.plans.compress import compress, compress_with
from hornpress.plans.rules import parse_rule
from hornpress.plans.search import Config
from tests.fixtures import FAMILY, frame, kb, rows_of

SCRIPT = ["mother(X,Y):-family(X,?,Y)", "mother(8,X):-father(?,X)", "father(X,Y):-family(?,X,Y)", "family(Y,X,Z):-father(X,Z),mother(Y,Z)"]


def test_given_rules_are_lossless(spark):
    base = kb(spark, FAMILY, 17)
    c = compress_with(base, [parse_rule(r) for r in SCRIPT])
    assert c.is_lossless()
    row = c.report().first()
    assert (row.records, row.rules, row.rule_length) == (12, 4, sum(parse_rule(r).length for r in SCRIPT))
    assert row.feedback > 0 and row.necessary < row.records


def test_dual_relations_end_to_end(spark):
    p = [(2 * i + 1, 2 * i + 2) for i in range(55)]
    q = [(2 * i + 2, 2 * i + 1) for i in range(50)]
    c = compress(kb(spark, {"p": p, "q": q}), Config(metric="delta"))
    found = {s.rule.head.pred: s.eval for s in c.rules}
    assert len(c.rules) == 2
    assert (found["p"].pos, found["p"].all, found["p"].length) == (50, 50, 2)
    assert (found["q"].pos, found["q"].all, found["q"].length) == (50, 55, 2)
    assert rows_of(c.counter["q"]) == {(2 * i + 2, 2 * i + 1) for i in range(50, 55)} and c.counter["p"].count() == 0
    assert c.supplementary.count() == 0
    assert c.feedback.filter("feedback").count() == 50 and c.is_lossless()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_bases_come_back(spark, seed):
    rng = random.Random(seed)
    rels = {f"r{k}": sorted({tuple(rng.randint(1, 6) for _ in range(a)) for _ in range(14)}) for k, a in enumerate([1, 2, 2])}
    c = compress(kb(spark, rels, 6), Config(beam=2, metric="delta"))
    assert c.is_lossless()


def test_recovery_ranges_over_all_constants(spark):
    base = kb(spark, {"h": [(1, 2)]}, 4)
    counter = {"h": frame(spark, [(1, 1), (2, 2), (3, 3)])}
    back = recover(base, counter, [parse_rule("h(?,?):-")], frame(spark, [(4,)]).toDF("value"))
    assert rows_of(back["h"].df) == {(a, b) for a in range(1, 5) for b in range(1, 5)} - {(1, 1), (2, 2), (3, 3)}


def test_recursive_rules_and_selection(spark):
    base = kb(spark, {"edge": [(i, i + 1) for i in range(1, 8)], "path": [(9, 9)], "far": [(8, 1)]}, 9)
    rules = [parse_rule(r) for r in ("path(X,Y):-edge(X,Y)", "path(X,Y):-path(X,Z),edge(Z,Y)", "far(X,Y):-path(X,Y),edge(?,Y)")]
    whole = recover(base, {}, rules)
    assert rows_of(whole["path"].df) == {(a, b) for a in range(1, 9) for b in range(a + 1, 9)} | {(9, 9)}
    for pred, place, value in (("path", 0, 3), ("far", 1, 5), ("edge", 0, 2), ("far", 0, 77)):
        assert rows_of(select(base, {}, rules, pred, place, value)) == {r for r in rows_of(whole[pred].df) if r[place] == value}


@pytest.mark.parametrize(("edges", "size"), [
    ([("a", "b"), ("b", "a")], 1),
    ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "x"), ("y", "b")], 1),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("b", "b")], 2),
    ([("a", "b"), ("b", "c")], 0),
])
def test_feedback_vertices(spark, edges, size):
    df = spark.createDataFrame(edges, "src string, dst string")
    got = graph.cycle_breakers(df)
    gone = {r.node for r in got.filter("feedback").collect()}
    assert len(gone) == size
    assert graph.strong_components([(a, b) for a, b in edges if not {a, b} & gone]) == []


def test_two_components_are_solved_apart(spark):
    edges = [(f"{c}{i}", f"{c}{(i + 1) % 5}") for c in "xyz" for i in range(5)]
    got = graph.cycle_breakers(spark.createDataFrame(edges, "src string, dst string"))
    assert got.filter("feedback").count() == 3 and got.select("scc").distinct().count() == 3
    assert got.agg(F.count("*")).first()[0] == 15


def test_scores_of_found_rules_hold(spark):
    from hornpress.plans import compile as cp

    c = compress(kb(spark, FAMILY, 17), Config(metric="delta"), ["mother"])
    for s in c.rules[:1]:
        plain = cp.evaluate(s.rule, kb(spark, FAMILY, 17))
        assert Eval(plain.pos, plain.all, plain.length) == Eval(s.eval.pos, s.eval.all, s.eval.length)


def test_registered_supplementary_constants_are_the_operators(spark, monkeypatch):
    import duckdb

    from hornpress import queries as q
    from hornpress.plans import compress as cm

    sf, seen, real = "/root/testdata/sf0.001", [], cm.supplementary_constants
    monkeypatch.setattr(cm, "supplementary_constants", lambda *a: seen.append(a) or real(*a))
    got = rows_of(q.QUERIES["supplementary"](spark, sf))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    assert got and got == set(duck.execute(q.ORACLES["supplementary"]).fetchall())
    (kb, necessary, counter, rules), = seen
    # each of the three kinds of kept constants holds some back
    assert 0 < len(got) < kb.n and len(rules) == 3
    assert rows_of(necessary["seventh"]) and not rows_of(necessary["cust"]) and not rows_of(necessary["far_cust"])
    assert rows_of(counter["far_cust"]) and (1,) not in got


def test_lost_constants_come_back(spark):
    base = kb(spark, {"all": [(c,) for c in range(1, 7)], "some": [(2,), (3,), (4,)]}, 6)
    c = compress_with(base, [parse_rule("all(?):-"), parse_rule("some(?):-")])
    assert rows_of(c.supplementary) == {(2,), (3,), (4,)} and c.is_lossless()


def marked(base, entailed):
    from hornpress.operators.kb import Kb

    made = {k: r.entail(frame(base.spark, sorted(entailed[k]))) if entailed.get(k) else r for k, r in base.relations.items()}
    return Kb(base.name, made, base.n)


def golden(spark, entailed, rules, wrong, cycle=()):
    """What is kept where rules, marks, counterexamples and a cycle of proofs are given."""
    from hornpress.plans.compress import EDGES, finish
    from hornpress.plans.search import Scored

    base = marked(kb(spark, FAMILY, 17), entailed)
    edges = spark.createDataFrame([(a, list(x), b, list(y)) for (a, x), (b, y) in cycle], EDGES)
    return finish(base, [Scored(parse_rule(r), Eval(0, 0, parse_rule(r).length)) for r in rules], {k: frame(spark, v) for k, v in wrong.items()}, [edges])


def test_golden_figures_of_a_given_hypothesis(spark):
    """FIXTURES.md F1, G1 (fixed values)."""
    rules = ["mother(X0,X1):-family(X0,?,X1)", "mother(8,X0):-father(?,X0)", "father(X0,X1):-family(?,X0,X1)", "family(X1,X0,X2):-father(X0,X2),mother(X1,X2)"]
    c = golden(spark, {"mother": [(4, 6), (7, 9)], "father": [(5, 6), (16, 17)], "family": [(4, 5, 6)]}, rules, {"family": [(1, 2, 3)]})
    r = c.report().first()
    assert (r.necessary, r.feedback, r.counterexamples, r.rule_length) == (7, 0, 1, 10)
    assert rows_of(c.supplementary) == {(4,), (5,), (6,), (16,), (17,)}


def test_golden_figures_with_a_cycle(spark):
    """FIXTURES.md F1, G2 (fixed values)."""
    rows = {k: v[:3] for k, v in FAMILY.items()}
    turn = [(("family", (10, 11, 12)), ("father", (11, 12))), (("father", (11, 12)), ("family", (10, 11, 12)))]
    c = golden(spark, rows, ["father(X0,X1):-family(?,X0,X1)", "mother(X0,6):-family(X0,?,6)"], {"mother": [(5, 5)], "father": [(16, 17), (14, 15)]}, turn)
    r = c.report().first()
    assert (r.necessary, r.feedback, r.counterexamples, r.rule_length) == (4, 1, 3, 5)
    assert rows_of(c.supplementary) == {(x,) for x in (1, 2, 3, 4, 7, 8, 9)}
    assert rows_of(c.necessary["family"]) == {(10, 11, 12), (13, 14, 15)} and rows_of(c.necessary["father"]) == {(16, 17)} and rows_of(c.necessary["mother"]) == {(13, 15)}


def jobs_of(spark, act):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        out = act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_a_long_chain_of_proofs_takes_few_jobs(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5000)] + [("n9", "n8")], "src string, dst string")
    got, jobs = jobs_of(spark, lambda: graph.cycle_breakers(edges).collect())
    assert [(r.node, r.scc, r.feedback) for r in sorted(got)] == [("n8", "n8", True), ("n9", "n8", False)] and jobs < 30


def test_parts_beyond_one_task_are_solved_apart(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    edges = [(f"{c}{i}", f"{c}{(i + 1) % 4}") for c in "xyz" for i in range(4)] + [("x0", "t0"), ("t0", "t1"), ("y1", "y0")]
    got = {r.node: (r.scc, r.feedback) for r in graph.cycle_breakers(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"{c}{i}": (f"{c}0", i == 0) for c in "xyz" for i in range(4)}


def test_new_tuples_alone_are_joined(spark):
    """A long recursion, and two recursive atoms in one rule."""
    base = kb(spark, {"step": [(i, i + 1) for i in range(1, 12)], "reach": [(1, 2)]}, 12)
    whole = {(a, b) for a in range(1, 13) for b in range(a + 1, 13)}
    for rules in (["reach(X,Y):-step(X,Y)", "reach(X,Y):-reach(X,Z),reach(Z,Y)"], ["reach(X,Y):-step(X,Y)", "reach(X,Y):-step(X,Z),reach(Z,Y)"]):
        assert rows_of(recover(base, {}, [parse_rule(r) for r in rules])["reach"].df) == whole
