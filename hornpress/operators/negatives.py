"""Negative samples: tuples that a relation lacks.

The tuples of k constants out of 1 to n are ordered; a tuple's ordinal is that of its digits x - 1
in base n. Ordinals are exact decimals of up to 38 digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornpress.functions.draws import draw
from hornpress.operators import tables as tb
from hornpress.operators.graph import checkpointed
from hornpress.operators.numeration import nearest, ranked

WIDE = "decimal(38,0)"
SEED = "negatives"
#: Constants that meet more others than this are compared with no other constant.
GROUPED = 64
#: Groups of so many constants in all are sent to every task; of more, walks and members meet by a shuffle.
BROADCAST_MEMBERS = 100_000
ROWS_A_TASK = 2_000_000


def ordinal(cols: list[str], n: int) -> Column:
    if n ** len(cols) >= 10**38:
        raise ValueError(f"{n}^{len(cols)} tuples have no exact ordinals")
    return reduce(lambda at, c: (at * F.lit(n).cast("decimal(20,0)") + (F.col(c) - 1)).cast(WIDE), cols, F.lit(0).cast(WIDE))


def decoded(ordinals: DataFrame, k: int, n: int) -> DataFrame:
    """(ordinal) to tuples, by exact whole-number division."""
    rows, rest = ordinals, "ordinal"
    for i in range(k):
        base = n ** (k - 1 - i)
        whole = F.expr(f"cast({rest} div {base}BD as {WIDE})") if base < 10**37 else F.floor(F.col(rest) / base).cast(WIDE)
        rows = rows.withColumn(f"a{i}", whole).withColumn(f"rest{i}", (F.col(rest) - F.col(f"a{i}") * F.lit(base).cast(WIDE)).cast(WIDE))
        rest = f"rest{i}"
    return rows.select(*[(F.col(f"a{i}") + 1).cast("int").alias(f"a{i}") for i in range(k)])


def with_ordinals(t: DataFrame, n: int) -> DataFrame:
    return t.select(*t.columns, ordinal(t.columns, n).alias("ordinal"))


def stepped(t: DataFrame, n: int, step: int) -> DataFrame:
    """Tuples so many places further, not beyond the first and last."""
    last = F.lit(n ** len(t.columns) - 1).cast(WIDE)
    at = F.least(F.greatest(F.col("ordinal") + F.lit(step), F.lit(0).cast(WIDE)), last)
    return decoded(with_ordinals(t, n).select(at.cast(WIDE).alias("ordinal")), len(t.columns), n)


def draws(spark, count: int, k: int, n: int, salt: str) -> DataFrame:  # noqa: ANN001
    """count tuples, each constant by a hash of its number."""
    cells = [(F.pmod(draw(SEED, salt, i, F.col("id")), F.lit(n)) + 1).cast("int").alias(f"a{i}") for i in range(k)]
    return spark.range(count).select(*cells)


def _until(pos: DataFrame, n: int, budget: int, drawn, rank: str) -> DataFrame:  # noqa: ANN001
    """Distinct drawn tuples outside pos, as many as asked for if there are so many, the first by a hash."""
    cols = pos.columns
    possible = n ** len(cols) - pos.count()
    budget, size, salt = min(budget, possible), max(64, 2 * budget), 0
    found = pos.limit(0)
    while True:
        found = tb.union_of(found, tb.absent(drawn(size, f"{rank}{salt}"), pos)).persist()
        if found.count() >= budget:
            return found.orderBy(draw(rank, *map(F.col, cols)), *cols).limit(budget)
        if salt >= 4 and budget * 4 > possible:  # few are left: list them all
            everything = decoded(pos.sparkSession.range(n ** len(cols)).select(F.col("id").cast(WIDE).alias("ordinal")), len(cols), n)
            return tb.absent(everything, pos).orderBy(draw(rank, *map(F.col, cols)), *cols).limit(budget)
        size, salt = size * 2, salt + 1


def uniform(pos: DataFrame, n: int, budget: int) -> DataFrame:
    """Distinct tuples, uniform over all that pos lacks."""
    spark, k = pos.sparkSession, len(pos.columns)
    return _until(pos, n, budget, lambda size, salt: draws(spark, size, k, n, salt), "uniform")


def near_positive(pos: DataFrame, n: int, budget: int) -> DataFrame:
    """Rows of pos with one constant replaced, as many as asked for if there are so many."""
    k, cols = len(pos.columns), pos.columns
    rest = [pos.select(*[c for c in cols if c != m]).distinct() for m in cols]
    least = max(r.count() for r in rest) * n - pos.count()
    if 4 * budget > least:  # few are left: list them all
        values = [pos.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias(m)) for m in cols]
        # a table of one column has no rest: any row of it gives all values
        near = [r.crossJoin(v).select(*cols) if k > 1 else v.join(pos.limit(1).select(F.lit(1).alias("one")), how="left_semi") for r, v in zip(rest, values, strict=True)]
        return tb.absent(reduce(DataFrame.unionByName, near).distinct(), pos).orderBy(draw("near", *map(F.col, cols)), *cols).limit(budget)

    def moved(size: int, salt: str) -> DataFrame:
        per_row = max(1, -(-size // max(1, pos.count())))
        rows = pos.select("*", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("copy"))
        h = [draw(SEED, salt, x, *map(F.col, pos.columns), F.col("copy")) for x in "cv"]
        return rows.select(*[F.when(F.pmod(h[0], F.lit(k)) == i, (F.pmod(h[1], F.lit(n)) + 1).cast("int")).otherwise(F.col(c)).alias(c) for i, c in enumerate(pos.columns)])

    return _until(pos, n, budget, moved, "near")


def _ends(pos: DataFrame, n: int, which: str) -> DataFrame:
    """Ordinals that begin or end a gap between positive tuples: found by looking ordinals up, without an order."""
    at = with_ordinals(pos, n).select("ordinal")
    last = n ** len(pos.columns) - 1
    step = 1 if which == "begin" else -1
    edge = pos.sparkSession.range(1).select(F.lit(0 if which == "begin" else last).cast(WIDE).alias("ordinal"))
    moved = at.select((F.col("ordinal") + step).cast(WIDE).alias("ordinal")).filter((F.col("ordinal") >= 0) & (F.col("ordinal") <= F.lit(last).cast(WIDE)))
    return moved.unionByName(edge).distinct().join(at, "ordinal", "left_anti")


def even_steps(pos: DataFrame, n: int, enhance: int) -> DataFrame:
    """Up to `enhance` tuples outside pos, at equal steps from the first."""
    rows = n ** len(pos.columns)
    step = -(-rows // enhance) if enhance else rows
    at = pos.sparkSession.range(enhance).select((F.col("id").cast(WIDE) * F.lit(step).cast("decimal(20,0)")).cast(WIDE).alias("ordinal")).filter(F.col("ordinal") < F.lit(rows).cast(WIDE))
    return tb.absent(decoded(at, len(pos.columns), n), pos).distinct()


def _enhanced(found: DataFrame, pos: DataFrame, n: int, enhance: int) -> DataFrame:
    return tb.union_of(found, even_steps(pos, n, enhance)) if enhance else found


def interval_begins(pos: DataFrame, n: int, enhance: int = 0) -> DataFrame:
    """The first tuple of each gap."""
    return _enhanced(decoded(_ends(pos, n, "begin"), len(pos.columns), n), pos, n, enhance)


def interval_ends(pos: DataFrame, n: int, enhance: int = 0) -> DataFrame:
    """The last tuple of each gap."""
    return _enhanced(decoded(_ends(pos, n, "end"), len(pos.columns), n), pos, n, enhance)


def intervals(pos: DataFrame, n: int) -> DataFrame:
    """First and last tuples of all gaps."""
    return decoded(_ends(pos, n, "begin").unionByName(_ends(pos, n, "end")).distinct(), len(pos.columns), n)


def neighbours(pos: DataFrame, n: int, up: bool = True, down: bool = True, enhance: int = 0) -> DataFrame:
    """Tuples that differ from a positive one by one, in one column."""
    moved = [F.array(*[F.col(c) + (d if c == m else 0) for c in pos.columns]) for m in pos.columns for d in ([1] if up else []) + ([-1] if down else [])]
    near = pos.select(F.explode(F.array(*moved)).alias("x")).filter(F.forall("x", lambda v: (v >= 1) & (v <= n)))
    cells = near.select(*[F.col("x")[i].cast("int").alias(c) for i, c in enumerate(pos.columns)]).distinct()
    return _enhanced(tb.absent(cells, pos), pos, n, enhance)


def gaps(pos: DataFrame, neg: DataFrame, n: int) -> DataFrame:
    """(ordinal, low, high) of samples, with the positive ordinals around them (-1 and the number of tuples at the ends)."""
    marks = with_ordinals(pos, n).select("ordinal", F.lit(True).alias("own")).unionByName(with_ordinals(neg, n).select("ordinal", F.lit(False).alias("own")))
    around = nearest(marks, "ordinal", "own", "low", "high").filter(~F.col("own"))
    last = n ** len(pos.columns)
    return around.select("ordinal", F.coalesce("low", F.lit(-1).cast(WIDE)).alias("low"), F.coalesce("high", F.lit(last).cast(WIDE)).alias("high"))


def weights(pos: DataFrame, neg: DataFrame, n: int) -> DataFrame:
    """neg with a weight: the size of the gap that holds a sample over the number of samples in it."""
    around = checkpointed(gaps(pos, neg, n))
    held = around.groupBy("low").agg(F.count("*").alias("held"))
    size = (F.col("high") - F.col("low") - 1).cast("double")
    weighed = around.join(held, "low").select("ordinal", (size / F.col("held")).cast("float").alias("weight"))
    return with_ordinals(neg, n).join(weighed, "ordinal").select(*pos.columns, "weight")


def adversarial(pos: DataFrame, bindings: DataFrame, n: int, budget: int) -> DataFrame:
    """Up to budget tuples that a rule derives wrongly, the first by a hash, from the tuples it derives."""
    cols = pos.columns
    wrong = tb.absent(bindings.select(*cols).distinct(), pos).filter(F.forall(F.array(*cols), lambda v: (v >= 1) & (v <= n)))
    return wrong.orderBy(draw("adversarial", *map(F.col, cols)), *cols).limit(budget)


def weighted_negatives(covered: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the weight of distinct covered samples."""
    return covered.dropDuplicates(cols).agg(F.coalesce(F.sum(F.col("weight").cast("double")), F.lit(0.0)).alias("negatives"))


def cooccurrence(relations: list[DataFrame]) -> DataFrame:
    """(c1, c2, relevance): how often c2 meets c1 in a binary tuple, over how often c1 meets anything."""
    pairs = [t.select(F.col("a0").alias("c1"), F.col("a1").alias("c2")).unionByName(t.select(F.col("a1").alias("c1"), F.col("a0").alias("c2"))) for t in relations]
    counts = reduce(DataFrame.unionByName, pairs).groupBy("c1", "c2").agg(F.count("*").alias("n"))
    return counts.withColumn("relevance", F.col("n") / F.sum("n").over(Window.partitionBy("c1"))).select("c1", "c2", "relevance")


def grouped(near: DataFrame) -> DataFrame:
    """(c1, group): constants that meet the same others, equally often, are a group, named by its smallest member.

    Walks from the members of a group differ in nothing but the member itself. A constant that meets more than
    GROUPED others is a group of its own, so that no row holds a long list.
    """
    meets = near.groupBy("c1").agg(F.count("*").alias("n"))
    few = near.join(meets.filter(F.col("n") <= GROUPED), "c1").groupBy("c1").agg(F.sort_array(F.collect_list(F.struct("c2", "relevance"))).alias("met"))
    alike = few.groupBy("met").agg(F.min("c1").alias("group"))
    many = meets.filter(F.col("n") > GROUPED).select("c1", F.col("c1").alias("group"))
    return few.join(alike, "met").select("c1", "group").unionByName(many)


def expanded(walks: DataFrame, group: DataFrame) -> DataFrame:
    """walks (c1, c2, ...) of the groups' first members, for every member. Rows are listed by tasks of some millions."""
    size = group.groupBy("group").agg(F.count("*").alias("members"))
    ways = walks.groupBy("c1").agg(F.count("*").alias("ways")).join(size, F.col("c1") == F.col("group"))
    rows, members = ways.agg(F.coalesce(F.sum(F.col("ways") * F.col("members")), F.lit(0)), F.coalesce(F.sum("members"), F.lit(0))).first()
    parts = -(-rows // ROWS_A_TASK)
    first, rest = walks.withColumnRenamed("c1", "group"), [c for c in walks.columns if c != "c1"]
    if members <= BROADCAST_MEMBERS:
        # a task's share of the walks, dealt by both ends, meets all members
        return (first.repartition(parts, "group", "c2") if parts > 1 else first).join(F.broadcast(group), "group").select("c1", *rest)
    salts = min(parts, 32)
    dealt = first.withColumn("salt", F.pmod(F.hash("c2"), F.lit(salts)))
    copies = group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.repartition(parts, "group", "salt").join(copies.repartition(parts, "group", "salt"), ["group", "salt"]).select("c1", *rest)


def hop_relevance(relevance: DataFrame, hops: int) -> DataFrame:
    """Relevance over walks of up to `hops` steps: each step halves it, the last one counts twice.

    Walks are added up once for each group of constants alike, and listed for its members at the end.
    """
    relevance = checkpointed(relevance)
    group = checkpointed(grouped(relevance))
    step = relevance.select(F.col("c1").alias("m"), F.col("c2").alias("to"), (F.col("relevance") / 2).alias("r"))
    walk = relevance.join(group.filter("c1 = group"), "c1", "left_semi").select("c1", "c2", (F.col("relevance") / 2).alias("w"))
    total = walk.withColumn("w", F.col("w") * (2 if hops == 1 else 1))
    for h in range(2, hops + 1):
        walk = walk.join(step, walk["c2"] == step["m"]).groupBy("c1", F.col("to").alias("c2")).agg(F.sum(F.col("w") * F.col("r")).alias("w"))
        total = total.unionByName(walk.withColumn("w", F.col("w") * (2 if h == hops else 1)))
    return expanded(checkpointed(total.groupBy("c1", "c2").agg(F.sum("w").alias("relevance"))), group)


def relevant(pos: DataFrame, relevance: DataFrame, top: int) -> DataFrame:
    """Binary tuples with one argument replaced by one of the `top` constants most relevant to it (ties by number)."""
    best = relevance.filter("c1 <> c2").withColumn("rank", F.row_number().over(Window.partitionBy("c1").orderBy(F.desc("relevance"), "c2"))).filter(F.col("rank") <= top).select("c1", "c2")
    left = pos.join(best, pos["a0"] == best["c1"]).select(F.col("c2").alias("a0"), "a1")
    right = pos.join(best, pos["a1"] == best["c1"]).select("a0", F.col("c2").alias("a1"))
    return tb.absent(left.unionByName(right).distinct(), pos)


def relevant_by_hops(pos: DataFrame, relations: list[DataFrame], budget: int, hops: int = 3) -> DataFrame:
    """Up to `budget` tuples in all, from each positive one with an argument replaced by what is near that argument.

    The constants that tuples link to an argument come first, in order of how often they meet it,
    then those two steps away and so on. Tuples are dealt in rounds: each positive tuple and place
    gives its first candidate, then each its second, until the budget is reached (ties by tuple).
    """
    pos = checkpointed(pos)
    near = checkpointed(cooccurrence(relations).filter("c1 <> c2"))
    group = checkpointed(grouped(near))
    ways = near.select(F.col("c1").alias("m"), F.col("c2").alias("to"), F.col("relevance").alias("r"))
    # Walks of a group's first member, back to itself too. As links go both ways every member is two steps from each
    # other and itself, so what a member's own walks lack of these is the member alone.
    walk = reach = near.join(group.filter("c1 = group"), "c1", "left_semi").select("c1", "c2", F.lit(1).alias("hop"), "relevance")
    for h in range(2, hops + 1):
        further = walk.join(ways, walk["c2"] == ways["m"]).groupBy("c1", F.col("to").alias("c2")).agg(F.sum(F.col("relevance") * F.col("r")).alias("relevance"))
        walk = checkpointed(further.join(reach, ["c1", "c2"], "left_anti").select("c1", "c2", F.lit(h).alias("hop"), "relevance"))
        reach = reach.unionByName(walk)
    order = Window.partitionBy("c1").orderBy("hop", F.desc(F.round("relevance", 12)), "c2")
    listed = reach.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= budget + 1)
    listed = checkpointed(listed.select(F.col("c1").alias("group"), "c2", "at"))
    # a member's own place in its group's list is passed over
    own = listed.select("group", F.col("c2").alias("c1"), F.col("at").alias("own"))
    members = checkpointed(group.join(own, ["group", "c1"], "left"))
    turns = min(2, budget)
    while True:
        first = members.join(listed.filter(F.col("at") <= turns + 1), "group").filter("c1 <> c2")
        dealt = first.select("c1", "c2", (F.col("at") - F.coalesce((F.col("own") < F.col("at")).cast("int"), F.lit(0))).alias("turn")).filter(F.col("turn") <= turns)
        places = [pos.withColumn("c1", F.col(c)).join(dealt, "c1").select(*[F.col("c2").alias(x) if x == c else F.col(x) for x in pos.columns], "turn", F.lit(i).alias("place")) for i, c in enumerate(pos.columns)]
        found = tb.absent(reduce(DataFrame.unionByName, places), pos).groupBy(*pos.columns).agg(F.min(F.struct("turn", "place")).alias("at"))
        if turns < budget:  # tuples of these turns precede all others: if they are enough, no later turn is dealt
            found = checkpointed(found)
        if turns >= budget or found.count() >= budget:
            return found.orderBy("at", *pos.columns).limit(budget).select(*pos.columns)
        turns = min(8 * turns, budget)


def adversarial_draws(pos: DataFrame, derived: DataFrame, free: list[int], n: int, budget: int) -> DataFrame:
    """Up to budget tuples that a rule derives wrongly, drawn over its groundings and, at head places that the body
    leaves free, over all constants; free places are drawn, never listed.

    derived: distinct bindings of the bound head columns. Each draw takes a binding by its rank and a constant for
    each free place.
    """
    cols = pos.columns
    bound = [c for i, c in enumerate(cols) if i not in free]
    if not free:
        return adversarial(pos, derived, n, budget)
    rows = ranked(derived.select(F.struct(*bound).alias("key")), "key", "place") if bound else None
    total = rows.count() if bound else 1
    if not total:
        return pos.limit(0)
    picks = pos.sparkSession.range(4 * budget).select((F.pmod(draw(SEED, "binding", F.col("id")), F.lit(total)) + 1).cast("int").alias("place"), *[(F.pmod(draw(SEED, "free", i, F.col("id")), F.lit(n)) + 1).cast("int").alias(f"a{i}") for i in free])
    drawn = (picks.join(rows, "place").select("key.*", *[f"a{i}" for i in free]) if bound else picks).select(*cols).distinct()
    return tb.absent(drawn, pos).orderBy(draw("adversarial", *map(F.col, cols)), *cols).limit(budget)


def remapped(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Samples in another numeration, from (old, new); weights stay, and samples with a constant that has no new number go."""
    cols = [c for c in samples.columns if c != "weight"]
    for c in cols:
        samples = samples.join(mapping.select(F.col("old").alias(c), F.col("new").alias("moved")), c).withColumn(c, F.col("moved")).drop("moved")
    return samples.select(*cols, *[c for c in samples.columns if c == "weight"])


def between(one: DataFrame, other: DataFrame) -> DataFrame:
    """(old, new) of the names that two numerations share."""
    return one.select("name", F.col("num").alias("old")).join(other.select("name", F.col("num").alias("new")), "name").select("old", "new")


def by_frequency(relations: list[DataFrame]) -> DataFrame:
    """(old, new): constants renumbered by falling frequency, then number."""
    cells = reduce(DataFrame.unionByName, (t.select(F.explode(F.array(*t.columns)).alias("old")) for t in relations))
    counts = cells.groupBy("old").agg(F.count("*").alias("n")).withColumn("order", F.struct(-F.col("n"), "old"))
    return ranked(counts, "order", "new").select("old", "new")


def in_gap(pos: DataFrame, neg: DataFrame, n: int) -> DataFrame:
    """neg with each sample's place in its gap and among all tuples, as shares."""
    inside = (F.col("ordinal") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double")
    overall = F.col("ordinal").cast("double") / F.lit(float(n ** len(pos.columns)))
    placed = gaps(pos, neg, n).select("ordinal", inside.alias("in_gap"), overall.alias("overall"))
    return with_ordinals(neg, n).join(placed, "ordinal").select(*pos.columns, "in_gap", "overall")
