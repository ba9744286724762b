"""Search by estimates: candidates are ranked by closed-form estimates from column multisets, and only the best are evaluated.

An estimate needs, for each argument of a rule, the multiset of its values over the rule's
groundings, and over those of its body alone. Those come from one job for each beam rule; estimates themselves are arithmetic.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornpress.functions.scores import Eval
from hornpress.plans import compile as cp
from hornpress.plans.rules import Move, Place, Pruner, Rule, Var, moves
from hornpress.plans.search import Scored, Scorer


@dataclass(frozen=True)
class Column:
    """Of an argument: rows, different values, rows whose value is in a column of the base or in another argument,
    and rows of each constant that may be bound."""

    rows: int = 0
    different: int = 0
    kept: dict[tuple[str, int], int] = field(default_factory=dict)
    shared: dict[Place, int] = field(default_factory=dict)
    constants: dict[int, int] = field(default_factory=dict)

    def share(self, n: int) -> float:
        return n / self.rows if self.rows else 0.0

    @property
    def rows_each(self) -> float:
        return self.rows / self.different if self.different else 0.0


@dataclass(frozen=True)
class Columns:
    """Statistics of a rule's arguments over some of its groundings; same: for pairs in one atom the share of rows with equal values."""

    at: dict[Place, Column]
    same: dict[tuple[Place, Place], float]

    def __getitem__(self, place: Place) -> Column:
        return self.at.get(place, Column())

    def equal(self, place: Place, others: list[Place]) -> float:
        """Share of groundings in which an argument may equal a variable: exact in one atom, else the smallest share of rows with values of the other side."""
        near = [o for o in others if o[0] == place[0]]
        if near:
            return self.same.get(tuple(sorted((place, near[0]))), 0.0)
        mine = self[place]
        return min([self[o].share(self[o].shared.get(place, 0)) for o in others] + [mine.share(mine.shared.get(others[0], 0))])

    def share_of(self, place: Place, constant: int) -> float:
        return self[place].share(self[place].constants.get(constant, 0))

    def within(self, places: list[Place], column: tuple[str, int]) -> float:
        return min(self[p].share(self[p].kept.get(column, 0)) for p in places)


@dataclass(frozen=True)
class Statistics:
    """Arguments over the groundings of head rows not entailed and entailed, those of body atoms over the body alone, and the entailed head rows."""

    pos: Columns
    old: Columns
    every: Columns
    entailed: int


POS, OLD, EVERY = range(3)


def columns_of(scorer: Scorer, rule: Rule) -> Statistics:
    """The multisets' figures that estimates need."""
    kb = scorer.kb
    ground = cp.groundings(rule, kb).persist()
    places = [(a, i) for a, atom in enumerate(rule.atoms) for i in range(len(atom.args))]
    bodies = [(body.persist(), [p for p in places if p[0] in atoms]) for atoms, body in cp.body_groundings(rule, kb)]
    part = F.when(F.col("h_entailed"), OLD).otherwise(POS)
    sources = [(ground, part, places), *[(body, F.lit(EVERY), mine) for body, mine in bodies]]

    def cells(mine: list[Place]) -> Expr:
        return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i"), F.col(Scorer._column((a, i))).alias("val")) for a, i in mine])

    listed = reduce(DataFrame.unionByName, (rows.select(which.alias("part"), F.explode(cells(mine)).alias("x")) for rows, which, mine in sources))
    values = listed.groupBy("part", "x.a", "x.i", "x.val").agg(F.count("*").alias("n")).persist()
    found: dict[tuple[int, Place], Column] = {}
    for r in values.groupBy("part", "a", "i").agg(F.sum("n").alias("rows"), F.count("*").alias("different")).collect():
        found[r["part"], (r["a"], r["i"])] = Column(r["rows"], r["different"])
    other = values.select("part", F.col("a").alias("b"), F.col("i").alias("j"), "val")
    for r in values.join(other, ["part", "val"]).groupBy("part", "a", "i", "b", "j").agg(F.sum("n").alias("n")).collect():
        found[r["part"], (r["a"], r["i"])].shared[r["b"], r["j"]] = r["n"]
    for r in values.join(kb.colvals.select("rel", "col", "val"), "val").groupBy("part", "a", "i", "rel", "col").agg(F.sum("n").alias("n")).collect():
        found[r["part"], (r["a"], r["i"])].kept[r["rel"], r["col"]] = r["n"]
    wanted = [(a, i, c) for a, i in places for c in scorer.constants.get((rule.atoms[a].pred, i), [])]
    if wanted:
        asked = kb.spark.createDataFrame(wanted, "a int, i int, val int")
        for r in values.join(F.broadcast(asked), ["a", "i", "val"]).collect():
            found[r["part"], (r["a"], r["i"])].constants[r["val"]] = r["n"]
    same: dict[int, dict[tuple[Place, Place], float]] = {POS: {}, OLD: {}, EVERY: {}}
    for rows, which, mine in sources:
        pairs = [(p, q) for p in mine for q in mine if p < q and p[0] == q[0]]
        if pairs:
            equal = [F.count_if(F.col(Scorer._column(p)) == F.col(Scorer._column(q))).alias(f"s{k}") for k, (p, q) in enumerate(pairs)]
            for r in rows.groupBy(which.alias("part")).agg(F.count("*").alias("rows"), *equal).collect():
                same[r["part"]] |= {pq: r[f"s{k}"] / r["rows"] for k, pq in enumerate(pairs)}
    entailed = ground.filter("h_entailed").select(*[F.col(f"h_{c}") for c in kb[rule.head.pred].cols]).distinct().count()
    for rows in [ground, values, *[body for body, _ in bodies]]:
        rows.unpersist()
    pos, old, every = (Columns({p: c for (k, p), c in found.items() if k == part}, same[part]) for part in (POS, OLD, EVERY))
    return Statistics(pos, old, every, entailed)


def way_ratio(rule: Rule, way: list, every: Columns) -> float:
    """How many values of its last variable a value of the first has, on a way through body atoms."""
    ratio = 1.0
    for v, w in zip(way, way[1:], strict=False):
        ratio *= min(every[a, atom.args.index(v)].rows_each for a, atom in enumerate(rule.atoms) if a and v in atom.vars and w in atom.vars)
    return ratio


def every_share(scorer: Scorer, parent: Rule, rule: Rule, move: Move, others: list[Place], every: Columns) -> float:
    """The share of derived tuples that a step leaves. A head argument no longer ranges over all constants once it is bound;
    head variables that the body did not link before are no longer independent."""
    kind, place, what = move
    n = max(1, scorer.kb.n)
    inner = [p for p in others if p[0]]
    if kind == "is":
        return every.share_of(place, what) if place[0] else 1 / n
    if kind == "in":
        return every.within(inner, what) if inner else scorer.ndv.get(what, 0) / n
    if place[0] == 0 and any(o[0] == 0 for o in others):
        return 1 / n
    var = rule.atoms[place[0]].args[place[1]]
    if place[0] and any(o[0] == place[0] for o in others):
        return every.equal(place, others)
    heads = sorted(set(rule.head.vars))
    if place[0] == 0:
        ways = [w for h in heads if h != var and (w := shortest_link(rule, h, var))]
        if ways:
            way = min(ways, key=len)
            return way_ratio(rule, way, every) / n
        return every[inner[0]].different / n
    share = every.equal(place, inner) if inner else 1.0
    new = [(v, w, way) for k, v in enumerate(heads) for w in heads[k + 1 :] if (way := shortest_link(rule, v, w)) and not shortest_link(parent, v, w)]
    if new:
        v, w, way = min(new, key=lambda x: (len(x[2]), x[:2]))
        if not _inner(parent, v):
            v, w, way = w, v, way[::-1]
        bound = _inner(parent, w)
        share *= way_ratio(rule, way, every) / (max(1, every[bound[0]].different) if bound else n)
    elif not inner:
        share = every[place].different / n
    return share


def _inner(rule: Rule, var: Var) -> list[Place]:
    return [p for p in rule.places.get(var, []) if p[0]]


def estimated(scorer: Scorer, parent: Scored, rule: Rule, move: Move, columns: Statistics) -> Eval:
    """What the parent derives, scaled by the share of groundings that a step may keep: of head rows not entailed, of
    entailed ones, and of all that is derived, each by its own multisets."""
    kind, place, what = move
    old = parent.rule.atoms
    spot = what if kind == "eq" else place
    var = old[spot[0]].args[spot[1]]
    others = parent.rule.places[var] if var is not None else [spot]

    def share(c: Columns) -> float:
        if kind == "eq":
            return c.equal(place, others)
        return c.share_of(place, what) if kind == "is" else c.within(others, what)

    pos, gone = parent.eval.pos * share(columns.pos), columns.entailed * share(columns.old)
    derived = (parent.eval.all + columns.entailed) * every_share(scorer, parent.rule, rule, move, others, columns.every)
    return Eval(pos, max(derived - gone, pos), rule.length, parent.eval.tau, parent.eval.h)


def ranked_children(scorer: Scorer, beams: list[Scored], pruner: Pruner) -> list[tuple[Eval, Scored, Rule, Move]]:
    """All fresh candidates of a level with their estimates, the best first (ties in order of enumeration)."""
    out = []
    for parent in beams:
        columns = columns_of(scorer, parent.rule)
        for rule, move in moves(parent.rule, scorer.kb.schema, scorer.constants):
            if pruner.fresh(rule):
                out.append((estimated(scorer, parent, rule, move, columns), parent, rule, move))
    metric = scorer.config.metric
    order = sorted(range(len(out)), key=lambda k: (-out[k][0].value(metric), k))
    return [out[k] for k in order]


def evaluated(scorer: Scorer, chosen: list[tuple[Eval, Scored, Rule, Move]]) -> list[Scored]:
    """Exact scores of chosen candidates, in one batch, without those of too little coverage."""
    if not chosen:
        return []
    beams = list(dict.fromkeys(p for _, p, _, _ in chosen))
    kept = scorer.kept_counts([b.rule for b in beams], [(beams.index(p), m) for _, p, _, m in chosen], [r for _, _, r, _ in chosen])
    total = scorer.kb.sizes[beams[0].rule.head.pred]
    good = [(p, r, pos, old) for (_, p, r, _), (pos, old) in zip(chosen, kept, strict=True) if total and pos / total > scorer.config.coverage]
    derived = scorer.derived_counts([r for _, r, _, _ in good])
    scorer.stats.evaluated += len(good)
    return [Scored(r, Eval(pos, derived[r] - old, r.length, p.eval.tau, p.eval.h)) for p, r, pos, old in good]


def find_rule_by(scorer: Scorer, pred: str, pruner: Pruner, pick) -> Scored | None:  # noqa: ANN001
    """As a search of all candidates, but of each level only what `pick` takes from (scorer, beams, pruner) is evaluated."""
    metric, config = scorer.config.metric, scorer.config
    pruner.seen = set()
    start = Rule.start(pred, scorer.kb[pred].arity)
    pruner.fresh(start)
    beams = [Scored(start, cp.evaluate(start, scorer.kb))]
    while True:
        scorer.stats.levels += 1
        found = sorted(evaluated(scorer, pick(scorer, beams, pruner)), key=lambda s: -s.eval.value(metric))[: config.beam]
        best = max(beams, key=lambda s: s.eval.value(metric))
        if not found or best.eval.value(metric) >= found[0].eval.value(metric) or not config.go_on():
            return best if best.eval.useful else None
        if found[0].eval.tau >= config.stop or found[0].eval.neg == 0:
            return found[0] if found[0].eval.useful else None
        beams = found


def by_estimate(scorer: Scorer, beams: list[Scored], pruner: Pruner) -> list[tuple[Eval, Scored, Rule, Move]]:
    """The round(beam * observe) candidates of the best estimates."""
    return ranked_children(scorer, beams, pruner)[: max(1, round(scorer.config.beam * max(1.0, scorer.config.observe)))]


def at_random(seed: int = 0):  # noqa: ANN201
    """As many candidates, drawn at random: a baseline."""
    rng = random.Random(seed)

    def pick(scorer: Scorer, beams: list[Scored], pruner: Pruner) -> list[tuple[Eval, Scored, Rule, Move]]:
        fresh = [(p.eval, p, r, m) for p in beams for r, m in moves(p.rule, scorer.kb.schema, scorer.constants) if pruner.fresh(r)]
        return rng.sample(fresh, min(len(fresh), max(1, round(scorer.config.beam * max(1.0, scorer.config.observe)))))

    return pick


#: Rows of an interval between two cuts of a ranking, and the most cuts of each of its two columns.
INTERVAL, CUTS = 2_000, 256


def crossed(a: np.ndarray, b: np.ndarray) -> int:
    """Pairs of rows with a_i > a_j and b_i < b_j, by merging runs; NaN is above all, as in Spark."""
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    line, width, total = b[np.lexsort((b, a))].astype(np.int64), 1, 0
    at, span = np.arange(len(line)), int(b.max(initial=0)) + 1
    while width < len(line):
        key, left = at // (2 * width) * span + line, at // width % 2 == 0
        # of each value of a right run, the values of its left run that are above it
        ends = np.minimum((at[~left] // (2 * width) + 1) * width, left.sum())
        total += int((ends - np.searchsorted(key[left], key[~left], "right")).sum())
        line, width = np.sort(key) - at // (2 * width) * span, 2 * width
    return total


def _cell(col: str, cuts: list[float]) -> Expr:
    """2k for a value between cuts k - 1 and k, 2k + 1 for cut k itself, by halving."""

    def among(low: int, high: int) -> Expr:
        if low == high:
            return F.lit(2 * low)
        mid = (low + high) // 2
        cut = F.lit(cuts[mid])
        return F.when(F.col(col) == cut, F.lit(2 * mid + 1)).when(F.col(col) < cut, among(low, mid)).otherwise(among(mid + 1, high))

    return among(0, len(cuts))


def inversions(ranking: DataFrame) -> DataFrame:
    """One row from (estimate, exact): pairs in the wrong order, all pairs, and their quotient, of a ranking of any size.

    No pair is listed. Quantiles cut both columns into intervals; a cut is a cell of its own, so a frequent value
    is never part of an interval, and within a cell of one value there is no pair. Pairs in different cells of both
    columns are counted from the grid of cell sizes, the others within an interval of one column."""
    rows = ranking.select(F.col("estimate").cast("double").alias("estimate"), F.col("exact").cast("double").alias("exact")).filter("estimate is not null").persist()
    size = rows.count()
    n = min(CUTS, max(8, size // INTERVAL))
    found = rows.approxQuantile(["estimate", "exact"], [k / n for k in range(1, n)], 1 / (4 * n)) if size else [[], []]
    cuts = [sorted(set(c)) for c in found]
    alike = F.col("n").cast("decimal(19,0)")
    ties = rows.groupBy("estimate").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(alike * alike), F.lit(0))).first()[0]
    cells = rows.filter("exact is not null").select("estimate", "exact", _cell("estimate", cuts[0]).alias("p"), _cell("exact", cuts[1]).alias("q"))
    grid = np.zeros((2 * len(cuts[0]) + 1, 2 * len(cuts[1]) + 1), dtype=object)
    for r in cells.groupBy("p", "q").agg(F.count("*").alias("n")).collect():
        grid[r["p"], r["q"]] = r["n"]
    # of each cell, the rows of a lower estimate and a higher exact value
    above = grid.cumsum(axis=0)[:, ::-1].cumsum(axis=1)[:, ::-1]
    wrong = int((grid[1:, :-1] * above[:-1, 1:]).sum())

    def within(cell: str, a: str, b: str) -> DataFrame:
        def count(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [crossed(part["a"].to_numpy(), part["b"].to_numpy())]})

        inner = cells.filter(F.col(cell) % 2 == 0).select(cell, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        return inner.groupBy(cell).applyInPandas(count, "n long")

    # in one interval of estimates; in one interval of exact values, but not of estimates
    wrong += within("p", "estimate", "exact").unionByName(within("q", "p", "exact")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows.unpersist()
    pairs = (size * size - int(ties)) // 2
    return ranking.sparkSession.createDataFrame([(wrong, pairs, wrong / pairs if pairs else 0.0)], "inversions long, pairs long, share double")


def shared_links(rule: Rule) -> Counter:
    """How often body atoms link each two variables."""
    links: Counter = Counter()
    for atom in rule.body:
        vs = sorted(set(atom.vars))
        links.update((v, w) for k, v in enumerate(vs) for w in vs[k + 1 :])
    return links


def shortest_link(rule: Rule, one, other) -> list | None:  # noqa: ANN001
    """Variables on a shortest way between two through body atoms, or None."""
    near: dict = {}
    for v, w in shared_links(rule):
        near.setdefault(v, []).append(w)
        near.setdefault(w, []).append(v)
    ways, seen = [[one]], {one}
    while ways:
        way = ways.pop(0)
        if way[-1] == other:
            return way
        for v in sorted(near.get(way[-1], [])):
            if v not in seen:
                seen.add(v)
                ways.append([*way, v])
    return None
