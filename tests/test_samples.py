import pytest
from pyspark.sql import functions as F

from hornpress.operators import negatives as ng
from hornpress.operators import sampling as sp
from hornpress.operators import templates as tp
from hornpress.operators.kb import Kb
from hornpress.plans import compile as cp
from hornpress.plans.rules import parse_rule
from hornpress.sources import generators as gen
from tests.fixtures import frame, kb, rows_of, shuffled

POS = [(1, 2, 9), (1, 5, 2), (1, 5, 3), (2, 4, 3), (2, 4, 5), (5, 3, 4), (5, 10, 10)]


def test_intervals(spark):
    pos = frame(spark, POS)
    begins = {(1, 1, 1), (1, 2, 10), (1, 5, 4), (2, 4, 4), (2, 4, 6), (5, 3, 5), (6, 1, 1)}
    assert rows_of(ng.interval_begins(pos, 10)) == begins
    ends = {(1, 2, 8), (1, 5, 1), (2, 4, 2), (2, 4, 4), (5, 3, 3), (5, 10, 9), (10, 10, 10)}
    assert rows_of(ng.interval_ends(pos, 10)) == ends and rows_of(ng.intervals(pos, 10)) == begins | ends
    assert rows_of(ng.stepped(frame(spark, [(1, 10), (10, 10), (1, 1)]), 10, 1)) == {(2, 1), (10, 10), (1, 2)}
    assert rows_of(ng.stepped(frame(spark, [(2, 1), (1, 1)]), 10, -1)) == {(1, 10), (1, 1)}


def test_uniform_takes_all_that_is_left(spark):
    assert rows_of(ng.uniform(frame(spark, [(1,), (2,), (4,), (8,)]), 10, 6)) == {(3,), (5,), (6,), (7,), (9,), (10,)}


@pytest.mark.parametrize("draw", [ng.uniform, ng.near_positive])
def test_draws(spark, draw):
    pos = frame(spark, POS)
    got = rows_of(draw(pos, 10, 30))
    assert len(got) == 30 and not got & set(POS) and all(1 <= x <= 10 for r in got for x in r)
    assert got == rows_of(draw(pos, 10, 30))


def test_neighbours_and_steps(spark):
    pos = frame(spark, POS)
    want = {tuple(x + (d if i == k else 0) for k, x in enumerate(r)) for r in POS for i in range(3) for d in (1, -1)}
    assert rows_of(ng.neighbours(pos, 10)) == {r for r in want if all(1 <= x <= 10 for x in r)} - set(POS)
    assert rows_of(ng.even_steps(frame(spark, [(1, 1)]), 4, 4)) == {(2, 1), (3, 1), (4, 1)}


def test_weights_fill_their_gaps(spark):
    pos, neg = frame(spark, [(1, 3), (3, 3)]), frame(spark, [(1, 1), (2, 2), (3, 1), (4, 4)])
    assert {tuple(r) for r in ng.weights(pos, neg, 4).collect()} == {(1, 1, 2.0), (2, 2, 3.5), (3, 1, 3.5), (4, 4, 5.0)}


def test_adversarial(spark):
    base = kb(spark, {"p": [(1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (5, 6)], "q": [(2, 9), (3, 10), (4, 9), (5, 7), (8, 1), (9, 9)], "h": [(1, 9), (1, 3)]}, 10)
    derived = cp.derived(parse_rule("h(X,Y):-p(X,Z),q(Z,Y)"), base)
    assert rows_of(ng.adversarial(base["h"].df, derived, 10, 9)) == {(1, 10), (2, 9), (2, 10)}
    covered = frame(spark, [(1, 10), (1, 10), (2, 9)]).withColumn("weight", F.lit(2.5))
    assert ng.weighted_negatives(covered, ["a0", "a1"]).first()[0] == 5.0


def test_samples_are_dense_bases(spark):
    base = kb(spark, {"e": [(i, i % 7 + 100) for i in range(1, 40)], "f": [(100 + i, 200) for i in range(7)]})
    for sample in (sp.by_edge(base, 12), sp.by_end(base, 12), sp.by_end(base, 12, last=True), sp.by_major_nodes(base, 12), sp.by_snowball(base, 12), sp.by_walk(base, 8)):
        small, mapping = sp.as_kb(base, sample, "s")
        old = {r.new: r.old for r in mapping.collect()}
        assert sorted(old) == list(range(1, small.n + 1)) and sample.count() > 0
        for r in small.relations.values():
            assert {tuple(old[x] for x in t) for t in rows_of(r.df)} <= rows_of(base[r.name].df)


def test_templates_on_families(spark):
    base = Kb.from_names("f", {k: v for k, v in gen.families(spark, 10).items() if k != "gender"}).persisted()
    dual = {r.rule for r in tp.match(base, "Dual", similar=0.5).collect()}
    assert {"child(X0,X1):-mother(X1,X0)", "child(X0,X1):-father(X1,X0)"} <= dual
    assert {r.rule for r in tp.match_hints(base, ["h(X,Y):-f(X,?,Y);(h,f)"]).collect()} == {"father(X0,X1):-family(X0,?,X1)"}
    with pytest.raises(ValueError):
        tp.parse_hint("h(X):-p(X,?);(h,z)")


def test_generators(spark):
    assert gen.functional(spark, 5, 3).groupBy("a0").count().filter("count <> 3").isEmpty()
    assert gen.varying(spark, 6, 3).count() == sum(k % 3 + 1 for k in range(1, 7))
    assert {k: len(v.columns) for k, v in gen.random_tables(spark, 4).items()} == {"r1": 1, "r2": 2, "r3": 3, "r4": 4}
    noisy, clean = gen.families(spark, 30, 0.3), gen.families(spark, 30)
    assert 0 < noisy["father"].exceptAll(clean["father"]).count() < 40
    assert gen.wizards(spark)["grandparent"].count() == 4 and gen.families(spark, 2, grandparents=True)["grandparent"].count() == 8


def test_near_positive_is_near_when_few_are_left(spark):
    got = rows_of(ng.near_positive(frame(spark, [(1, 1)]), 10, 60))
    assert got == {(1, x) for x in range(2, 11)} | {(x, 1) for x in range(2, 11)}
    assert len(rows_of(ng.near_positive(frame(spark, [(1, 1)]), 1000, 5000))) == 2 * 999
    assert rows_of(ng.near_positive(frame(spark, [(1,), (3,)]), 4, 9)) == {(2,), (4,)}


@pytest.mark.parametrize("template", ["Dual", "Transition", "DualTransition", "SharedSource", "SharedSink", "Subsumption", "TypeInference"])
def test_templates_count_all_instances(spark, template):
    """One join over all relations gives what each instance's own plan gives."""
    import random
    from itertools import product

    from hornpress.plans.rules import Atom, Rule

    draw = random.Random(6)
    pairs = lambda n: sorted({(draw.randint(1, 7), draw.randint(1, 7)) for _ in range(n)})
    base = kb(spark, {"p": pairs(12), "q": pairs(9), "u": [(k,) for k in range(1, 5)]}, 7)
    got, want = {}, []
    for s in tp.shapes(base, template):
        got |= {r.rule: (r.pos, r.neg, r.length) for r in tp.counted(base, s).collect()}
        arity = {a.pred: len(a.args) for a in s.rule.atoms}
        for names in product(*[[r.name for r in base.relations.values() if r.arity == arity[h]] for h in s.holders]):
            put = dict(zip(s.holders, names, strict=True))
            rule = Rule(tuple(Atom(put[a.pred], a.args) for a in s.rule.atoms))
            if not rule.invalid and all(len({put[x] for x in g}) > 1 for g in s.groups):
                want.append((rule, s.length))
    plain = {r.rule: (r.pos, r.neg, r.length) for r in tp.measured(base, want).collect() if r.pos}
    assert got == plain


def test_runs_of_templates(spark):
    base = kb(spark, {"p": [(i, i + 20) for i in range(1, 15)], "q": [(i + 20, i) for i in range(1, 14)]}, 34)
    found, stats = tp.hinted(base, ["Dual", "Subsumption"])
    assert {r.rule for r in found["Dual"].collect()} == {"p(X0,X1):-q(X1,X0)", "q(X0,X1):-p(X1,X0)"}
    assert {r.template: (r.rules, r.covered, r.records) for r in stats.collect()} == {"Dual": (2, 26, 27), "Subsumption": (0, 0, 27)}
    with pytest.raises(ValueError):
        tp.hinted(base, ["Nothing"])


def test_draws_over_free_places(spark):
    pos, bound = frame(spark, [(1, 2), (2, 3)]), frame(spark, [(1, 1), (2, 2), (4, 4)]).select("a0")
    got = rows_of(ng.adversarial_draws(pos, bound, [1], 9, 12))
    assert len(got) == 12 and got <= {(a, b) for a in (1, 2, 4) for b in range(1, 10)} - {(1, 2), (2, 3)}
    assert rows_of(ng.remapped(pos.withColumn("weight", F.lit(0.5)), spark.createDataFrame([(1, 8), (2, 9)], "old int, new int"))) == {(8, 9, 0.5)}


def _walked(relations, hops):
    """(relevance over walks, lists of near constants in order) by loops over all pairs."""
    from collections import Counter, defaultdict

    meets = Counter(p for rows in relations for a, b in rows for p in ((a, b), (b, a)))
    total = Counter()
    for (a, _), n in meets.items():
        total[a] += n
    rel = defaultdict(dict)
    for (a, b), n in meets.items():
        rel[a][b] = n / total[a]
    relevance, near = {}, {}
    for c in rel:
        walk, out = {b: w / 2 for b, w in rel[c].items()}, defaultdict(float)
        for h in range(1, hops + 1):
            for b, w in walk.items():
                out[b] += w * (2 if h == hops else 1)
            after = defaultdict(float)
            for m, w in walk.items():
                for b, r in rel[m].items():
                    after[b] += w * r / 2
            walk = after
        relevance |= {(c, b): round(w, 9) for b, w in out.items()}
        seen, near[c], walk = {c}, [], {b: w for b, w in rel[c].items() if b != c}
        for _ in range(hops):
            near[c] += [b for b, _ in sorted(walk.items(), key=lambda x: (-round(x[1], 12), x[0]))]
            seen |= set(walk)
            after = defaultdict(float)
            for m, w in walk.items():
                for b, r in rel[m].items():
                    if b not in seen and m != b:
                        after[b] += w * r
            walk = after
    return relevance, near


@pytest.mark.parametrize("hops", [2, 3])
@pytest.mark.parametrize(("grouped", "sent"), [(64, 100_000), (2, 0)])
def test_walks_of_groups_are_each_members_own(spark, monkeypatch, hops, grouped, sent):
    import random

    draw = random.Random(hops)
    one = sorted({(k, 40 + k % 4) for k in range(1, 25)} | {(draw.randint(1, 30), draw.randint(25, 45)) for _ in range(12)} | {(3, 3)})
    other = sorted({(k, 50 + k % 2) for k in range(1, 20)})
    relevance, near = _walked([one, other], hops)
    monkeypatch.setattr(ng, "GROUPED", grouped)
    monkeypatch.setattr(ng, "BROADCAST_MEMBERS", sent)
    monkeypatch.setattr(ng, "ROWS_A_TASK", 50)
    tables = [frame(spark, one), frame(spark, other)]
    got = {(r.c1, r.c2): round(r.relevance, 9) for r in ng.hop_relevance(ng.cooccurrence(tables), hops).collect()}
    assert got == pytest.approx(relevance, abs=2e-9)
    for budget in (7, 5000):
        at = {}
        for row in one:
            for place, c in enumerate(row):
                for turn, b in enumerate(near[c][:budget], 1):
                    t = tuple(b if i == place else x for i, x in enumerate(row))
                    at[t] = min(at.get(t, (turn, place)), (turn, place))
        want = sorted((v, t) for t, v in at.items() if t not in set(one))[:budget]
        assert [tuple(r) for r in ng.relevant_by_hops(tables[0], tables, budget, hops).collect()] == [t for _, t in want]


def test_near_constants_of_a_hub_are_not_joined_in_pairs(spark, monkeypatch):
    hub, kept, plain = spark.range(1, 1501).selectExpr("cast(id as int) as a0", "2000 as a1"), [], ng.checkpointed
    monkeypatch.setattr(ng, "checkpointed", lambda df: kept.append(plain(df)) or kept[-1])
    assert ng.relevant_by_hops(hub, [hub], 20, 2).count() == 20
    assert max(t.count() for t in kept) < 10_000  # a row for each two: 2,250,000


def test_walks_through_a_hub_are_added_up_once(spark):
    hub = spark.range(1, 1501).selectExpr("cast(id as int) as a0", "2000 as a1")
    rows = []
    moved = shuffled(spark, lambda: rows.append(ng.hop_relevance(ng.cooccurrence([hub]), 2).count()))
    assert rows == [1500 * 1501 + 1 + 1500] and moved < 100_000


def test_templates_join_only_what_a_head_can_take(spark):
    made = {"sn": [(k, 2001 + k % 5) for k in range(1, 1501)], "rn": [(3001 + k % 2, 2001 + k) for k in range(5)], "sr": [(k, 3001 + k % 5 % 2) for k in range(1, 1501)]}
    base = kb(spark, made, 3010).persisted()
    rules = []
    moved = shuffled(spark, lambda: rows_of(tp.match(base, "SharedSink").select("rule")) and rules.extend(r.rule for r in tp.match(base, "SharedSink").collect()))
    assert rules == ["sr(X0,X1):-sn(X0,X2),rn(X1,X2)"] and moved < 200_000  # pairs of sn that share a place: 450,000
    pairs = tp.alike(base, 0.8)
    got = {r.rule for r in tp.counted(base, tp.shapes(base, "SharedSource")[0], pairs).collect()}
    every = {r.rule for r in tp.counted(base, tp.shapes(base, "SharedSource")[0]).collect()}
    assert got and got <= every
