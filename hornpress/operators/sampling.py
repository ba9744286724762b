"""Smaller bases. Draws are hashes of tuples, so that samples repeat; every sample is renumbered densely."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornpress.functions.draws import draw, listed, share
from hornpress.operators import numeration as nm
from hornpress.operators import tables as tb
from hornpress.operators.graph import checkpointed
from hornpress.operators.kb import Kb, Relation


def edges(kb: Kb) -> DataFrame:
    """(rel, args) of every tuple."""
    return reduce(DataFrame.unionByName, (r.df.select(F.lit(r.name).alias("rel"), F.array(*r.cols).alias("args")) for r in kb.relations.values()))


def as_kb(kb: Kb, sample: DataFrame, name: str) -> tuple[Kb, DataFrame]:
    """The sampled tuples as a base, without empty relations, and (new, old) of its constants in order."""
    sample = checkpointed(sample.select("rel", "args").distinct())
    used = sample.select(F.explode("args").alias("old")).distinct()
    mapping = nm.ranked(used, "old", "new").select("new", "old").persist()
    held = {r["rel"] for r in sample.select("rel").distinct().collect()}
    made = {}
    for k, r in kb.relations.items():
        if k in held:
            rows = sample.filter(F.col("rel") == k).select(*[F.col("args")[i].alias(c) for i, c in enumerate(r.cols)])
            made[k] = Relation(k, r.arity, nm.remap(rows, mapping.select("old", "new")))
    return Kb(name, made, mapping.count()), mapping


def by_edge(kb: Kb, budget: int, seed: int = 0) -> DataFrame:
    """`budget` draws with replacement over all tuples, without repeats."""
    every = edges(kb)
    total = every.count()
    place = nm.ranked(every.withColumn("key", F.struct("rel", "args")), "key", "place").select("rel", "args", "place")
    drawn = kb.spark.range(budget).select((F.pmod(draw(seed, F.col("id")), F.lit(max(total, 1))) + 1).cast("int").alias("place")).distinct()
    return place.join(drawn, "place").select("rel", "args")


def by_end(kb: Kb, budget: int, last: bool = False) -> DataFrame:
    """Of each relation its first (or last) whole part of rows * budget / total rows in order."""
    place = nm.ranked(edges(kb).withColumn("key", F.struct("rel", "args")), "key", "place").drop("key")
    place = checkpointed(place)
    ends = place.groupBy("rel").agg(F.count("*").alias("rows"), F.min("place").alias("low"), F.max("place").alias("high"))
    total = place.count()
    rank = F.col("high") - F.col("place") if last else F.col("place") - F.col("low")
    return place.join(F.broadcast(ends), "rel").filter(rank + 1 <= F.floor(F.lit(budget / max(total, 1)) * F.col("rows"))).select("rel", "args")


def degrees(kb: Kb) -> DataFrame:
    """(node, deg): tuples that hold a constant; a loop counts twice."""
    return edges(kb).select(F.explode("args").alias("node")).groupBy("node").agg(F.count("*").alias("deg"))


def by_major_nodes(kb: Kb, budget: int, skip: list[int] | None = None) -> DataFrame:
    """Whole neighbourhoods of the nodes of highest degree (ties by number) until the budget is reached."""
    nodes = degrees(kb).filter(~F.col("node").isin(skip)) if skip else degrees(kb)
    before = F.coalesce(F.sum("deg").over(Window.orderBy(F.desc("deg"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = nodes.orderBy(F.desc("deg"), "node").limit(max(1, budget)).withColumn("before", before).filter(F.col("before") < budget).select("node")
    every = edges(kb)
    return every.join(F.broadcast(chosen), F.array_contains(every["args"], chosen["node"]), "left_semi") if budget <= 100_000 else _touching(every, chosen)


def _touching(every: DataFrame, nodes: DataFrame) -> DataFrame:
    return every.select("rel", "args", F.explode("args").alias("node")).join(nodes, "node", "left_semi").select("rel", "args").distinct()


def by_snowball(kb: Kb, budget: int, rounds: int = 3, seed: int = 0) -> DataFrame:
    """From some seeds, likelier of high degree, each round adds up to the mean degree of tuples of each new node."""
    deg = checkpointed(degrees(kb))
    mean = max(1, round(deg.agg(F.avg("deg")).first()[0] or 1))
    count = max(1, -int(-(budget ** (1 / rounds)) // mean))
    # the smallest of -ln(u) / degree are draws in proportion to the degree
    u = share(seed, F.col("node"))
    seen = checkpointed(deg.orderBy(-F.log(u) / F.col("deg"), "node").limit(count).select("node"))
    every = edges(kb).select("rel", "args", F.explode("args").alias("node")).persist()
    frontier, taken = seen, None
    for k in range(rounds):
        near = every.join(frontier, "node")
        nth = F.row_number().over(Window.partitionBy("node").orderBy(draw(seed + k + 1, F.col("rel"), listed("args")), "rel", "args"))
        new = near.withColumn("nth", nth).filter(F.col("nth") <= mean).select("rel", "args")
        taken = checkpointed((new if taken is None else taken.unionByName(new)).distinct())
        reached = taken.select(F.explode("args").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen, "node", "left_anti"))
        seen = checkpointed(seen.unionByName(frontier))
    return taken.orderBy(draw(seed, F.col("rel"), listed("args")), "rel", "args").limit(budget)


def by_walk(kb: Kb, budget: int, walkers: int = 4, seed: int = 0) -> DataFrame:
    """Walks of `walkers` nodes, `budget` steps in all: in each round every walker takes one of its node's tuples by hash."""
    every = edges(kb).select("rel", "args", F.posexplode("args").alias("at", "node"))
    placed = checkpointed(nm.ranked(every.withColumn("key", F.struct("node", "rel", "args", "at")), "key", "place").drop("key", "at"))
    cells = placed.groupBy("node").agg(F.count("*").alias("deg"), F.min("place").alias("first"))
    ways = checkpointed(placed.join(cells, "node").withColumn("place", F.col("place") - F.col("first")))
    u = share(seed, F.col("node"))
    at = checkpointed(cells.orderBy(-F.log(u) / F.col("deg"), "node").limit(walkers).select("node", F.col("node").alias("walker")))
    taken = None
    for k in range(-(-budget // walkers)):
        step = ways.join(F.broadcast(at), "node").filter(F.col("place") == F.pmod(draw(seed, k, F.col("walker")), F.col("deg")))
        others = F.filter("args", lambda x: x != F.col("node"))
        step = checkpointed(step.select("rel", "args", "walker", F.coalesce(F.try_element_at(others, F.lit(1)), "node").alias("next")))
        taken = step.select("rel", "args") if taken is None else taken.unionByName(step.select("rel", "args"))
        at = step.select(F.col("next").alias("node"), "walker")
    return taken.distinct()


def by_weighted_walk(kb: Kb, budget: int, walkers: int = 4, seed: int = 0) -> DataFrame:
    """A walk of several walkers: at each step the walker that moves is drawn in proportion to its node's degree,
    and takes one of its node's tuples; until `budget` steps are done. Walkers are few and held here; a step looks
    its tuple up by rank."""
    every = edges(kb).select("rel", "args", F.posexplode("args").alias("at", "node"))
    placed = checkpointed(nm.ranked(every.withColumn("key", F.struct("node", "rel", "args", "at")), "key", "place").drop("key", "at"))
    cells = checkpointed(placed.groupBy("node").agg(F.count("*").alias("deg"), F.min("place").alias("first")))
    start = cells.orderBy(-F.log(share(seed, F.col("node"))) / F.col("deg"), "node").limit(walkers).collect()
    spans = {r["node"]: (r["deg"], r["first"]) for r in start}
    at, taken = [r["node"] for r in start], []
    for k in range(budget if start else 0):
        degrees_now = [spans[n][0] for n in at]
        spot = _draw(seed, k, "walker") % sum(degrees_now)
        who = next(i for i in range(len(at)) if spot < sum(degrees_now[: i + 1]))
        deg, first = spans[at[who]]
        row = placed.filter(F.col("place") == first + _draw(seed, k, "step") % deg).first()
        taken.append((row["rel"], list(row["args"])))
        at[who] = next((x for x in row["args"] if x != row["node"]), row["node"])
        if at[who] not in spans:
            r = cells.filter(F.col("node") == at[who]).first()
            spans[at[who]] = (r["deg"], r["first"])
    return kb.spark.createDataFrame(taken, "rel string, args array<int>").distinct()


def _draw(*parts: object) -> int:
    """The same as functions.draws.draw."""
    import hashlib

    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def relation_pairs(colvals: DataFrame) -> DataFrame:
    """(rel_i, rel_j, jaccard): the most similar columns of every two relations that share a value."""
    from hornpress.functions.multisets import jaccard_pairs

    pairs = jaccard_pairs(colvals).filter("rel_i <> rel_j")
    return pairs.groupBy(F.least("rel_i", "rel_j").alias("rel_i"), F.greatest("rel_i", "rel_j").alias("rel_j")).agg(F.max("jaccard").alias("jaccard"))


def split_parts(kb: Kb, steps: int = 100) -> tuple[float, list[list[str]]]:
    """Relations in parts: similar ones are linked above a threshold, which is raised in steps until the number
    of parts grows more slowly than before. Relations are few; their pairs are held here."""
    from hornpress.plans.rules import linked

    pairs = [(r["rel_i"], r["rel_j"], r["jaccard"]) for r in relation_pairs(kb.colvals).collect()]
    names = list(kb.relations)

    def parts(t: float) -> list[set]:
        return linked([{a, b} for a, b, j in pairs if j >= t] + [{n} for n in names])

    counts = [len(parts(k / steps)) for k in range(steps + 1)]
    growth = [b - a for a, b in zip(counts, counts[1:], strict=False)]
    pivot = next((k for k in range(1, len(growth)) if growth[k] < growth[k - 1]), 0) / steps
    return pivot, sorted(sorted(p) for p in parts(pivot))
