import pytest

from hornpress.functions import multisets as ms
from hornpress.operators import numeration as nm
from hornpress.operators import tables as tb
from hornpress.operators.kb import Kb, Relation
from tests.fixtures import frame, kb, rows_of

T1 = [(1, 5, 3), (2, 4, 3), (1, 2, 9), (5, 3, 3), (1, 5, 2)]
T2 = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
T3 = [(1, 5, 3), (5, 3, 3), (1, 5, 2), (1, 1, 1), (2, 2, 2), (3, 3, 3)]


@pytest.fixture(scope="module")
def t1(spark):
    return frame(spark, T1)


def test_lookup(spark, t1):
    assert [tuple(r)[:3] for r in tb.ordinals(t1).orderBy("ordinal").collect()] == sorted(T1)
    assert rows_of(tb.slice_(t1, 0, 1)) == {r for r in T1 if r[0] == 1} and tb.slice_(t1, 0, 7).isEmpty()
    assert rows_of(tb.ith(t1, 3)) == {(2, 4, 3)}
    assert {r.value for r in tb.distinct_values(t1, 1).collect()} == {2, 3, 4, 5}
    stats = {r.col: (r.ndv, r.low, r.high, r.rows) for r in tb.column_stats(t1).collect()}
    assert stats == {0: (3, 1, 5, 5), 1: (4, 2, 5, 5), 2: (3, 2, 9, 5)}
    assert rows_of(tb.as_table(spark.createDataFrame([(1, None), (1, 2), (1, 2)], "x int, y int"))) == {(1, 2)}


def test_joins(spark, t1):
    t2, t3 = frame(spark, T2), frame(spark, T3)
    assert {tuple(r) for r in tb.match_groups(t1, 0, t2, 0).collect()} == {(1, 3, 3), (2, 1, 2)}
    assert tb.equi_join(t1, 0, t2, 0).count() == 11
    three = [(t1, 1), (frame(spark, [(1, 2), (2, 4), (2, 5), (3, 6), (4, 8)]), 0), (frame(spark, [(1,), (2,), (4,), (5,)]), 0)]
    assert {r.value for r in tb.common_values(*three).collect()} == {2, 4}
    assert rows_of(tb.equal_in_row(frame(spark, [(1, 5, 1), (2, 4, 3), (1, 2, 1), (3, 3, 3), (1, 5, 2)]), 0, 2)) == {(1, 5, 1), (1, 2, 1), (3, 3, 3)}
    assert rows_of(tb.project_join(t1, 1, [0, 2], t3, 1, [0, 2])) == {(a, c, x, z) for a, b, c in T1 for x, y, z in T3 if b == y}
    assert rows_of(tb.project_join(t1, 1, [0], t3, 1, [0])) == {(1, 2), (5, 5), (5, 3), (1, 1)} | {(a, x) for a, b, _ in T1 for x, y, _ in T3 if b == y}


def test_insert_places(spark):
    a = [(1, 1, 1), (1, 1, 2), (2, 2, 2), (3, 3, 3), (5, 3, 5), (5, 5, 5)]
    b = [(1, 2, 9), (1, 5, 2), (1, 5, 3), (2, 4, 3), (5, 3, 3)]
    place = lambda x, y: [r.place for r in tb.insert_places(frame(spark, x), frame(spark, y)).orderBy("a0", "a1", "a2").collect()]
    assert place(b, a) == [0, 0, 3, 4, 5, 5] and place(a, b) == [2, 2, 2, 3, 4]


@pytest.mark.parametrize(("share", "want"), [(0.5, {(0, 1), (2, 3)}), (0.3, {(0, 1), (1, 3), (1, 5), (2, 3)})])
def test_promising(spark, share, want):
    rows = [(1, 5, 3), (2, 4, 3), (1, 3, 9), (5, 3, 3), (1, 5, 2)]
    got = kb(spark, {"r": rows}).promising_constants(share)
    assert {(c, v) for (_, c), vs in got.items() for v in vs} == want
    assert {(r.col, r.val) for r in tb.frequent_values(frame(spark, rows), share).collect()} == want


def test_similarity(spark):
    sim = {(r.rel_i, r.col_i, r.rel_j, r.col_j): r.sim for r in ms.column_similarity(kb(spark, {"x": T1, "y": T3}).colvals).collect()}
    assert (sim["x", 0, "y", 0], sim["y", 0, "x", 0]) == (1.0, 5 / 6)
    assert (sim["x", 1, "y", 0], sim["y", 0, "x", 1]) == (0.8, 0.5)
    assert (sim["x", 2, "y", 2], sim["y", 2, "x", 2]) == (0.8, 5 / 6)


def test_multisets(spark):
    a, b = (spark.createDataFrame(x, "value string, cnt long") for x in ([("p", 3), ("q", 1)], [("p", 1), ("r", 2)]))
    assert rows_of(ms.union(a, b)) == {("p", 3), ("q", 1), ("r", 2)} and rows_of(ms.intersection(a, b)) == {("p", 1)}
    assert rows_of(ms.difference(a, b)) == {("p", 2), ("q", 1)} and rows_of(ms.add(a, b)) == {("p", 4), ("q", 1), ("r", 2)}
    assert ms.jaccard(a, b) == pytest.approx(1 / 6) and ms.item_count(a, "p") == 3 and ms.item_count(a, "z") == 0
    assert ms.is_subset(ms.intersection(a, b), a) and not ms.is_subset(a, b)


def test_entailment(spark):
    r = Relation.of("r", frame(spark, T2))
    r = r.entail(frame(spark, [(1, 1), (9, 9), (2, 2)]))
    assert rows_of(r.split()[0]) == {(1, 1), (2, 2)} and rows_of(r.newly(frame(spark, [(1, 1), (1, 2), (7, 7)]))) == {(1, 2)}
    assert rows_of(r.unentail(frame(spark, [(1, 1)])).split()[0]) == {(2, 2)}
    assert {tuple(x) for x in r.flagged.filter("entailed").select("a0", "a1").collect()} == {(1, 1), (2, 2)}


def test_edits(spark):
    base = Kb.from_names("k", {"likes": spark.createDataFrame([("ann", "bob"), ("bob", "cid")], "x string, y string")})
    more = base.add("likes", spark.createDataFrame([("ann", "dora"), ("ann", "bob")], "x string, y string"))
    assert more["likes"].df.count() == 3 and {r.name: r.num for r in more.numeration.collect()}["dora"] == 4
    less = more.remove("likes", nm.encode(spark.createDataFrame([("bob", "cid")], "x string, y string"), more.numeration))
    assert {r.name for r in less.numeration.collect()} == {"ann", "bob", "dora"}
    tidy = less.tidied()
    assert tidy.n == 3 and {tuple(r) for r in nm.decode(tidy["likes"].df, tidy.numeration).collect()} == {("ann", "bob"), ("ann", "dora")}
    assert base.same_as(base) and not base.same_as(more) and base.has("likes", 1, 2) and not base.has("likes", 2, 1) and not base.has("no", 1)
    with pytest.raises(ValueError):
        base.create("likes", 3)
    with pytest.raises(ValueError):
        base.load("likes", frame(spark, T2))
    assert base.load("t", frame(spark, T2)).schema == [("likes", 2), ("t", 2)] and base.load("t", frame(spark, T2)).delete("likes").schema == [("t", 2)]
    assert nm.encode(spark.createDataFrame([("zed",)], "x string"), base.numeration).first()[0] == 0
    assert rows_of(base.totals()) == {(1, 2, 3)}


def test_names_of_a_large_base_stay_off_the_driver(spark):
    names = spark.range(1, 2001).selectExpr("concat('n', id) as name", "cast(id as int) as num")
    rows = spark.range(1, 4001).selectExpr("concat('n', id) as a0", "concat('n', 4001 - id) as a1")
    coded = nm.encode(rows, names, 900_000)  # so many names as a hash table fill a driver of 750 MB
    assert "strategy=broadcast" not in coded._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in nm.encode(rows, names, 2000)._jdf.queryExecution().analyzed().toString()
    assert rows_of(coded) == {(k if k <= 2000 else 0, 4001 - k if k > 2000 else 0) for k in range(1, 4001)}
