"""Beam search for rules.

The search itself walks over rule trees on the driver. All candidates of a level are scored
together: one job counts, over the groundings of the level's rules, the head rows that each
candidate would keep (a new atom with one bound argument is a lookup in the table of column
values), and one more counts the bindings of body components not met before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornpress.functions.scores import RATIO, Eval
from hornpress.operators.kb import Kb
from hornpress.plans import compile as cp
from hornpress.plans.rules import Atom, Const, Move, Place, Pruner, Rule, Var, moves


#: Joins that are estimated to make more rows than this are taken apart; bases of fewer tuples are not looked at.
MANY_ROWS, FEW_TUPLES = 20_000_000, 10_000


@dataclass(frozen=True)
class Config:
    beam: int = 5
    metric: str = RATIO
    #: A rule is left alone if its coverage is not above this.
    coverage: float = 0.05
    #: Constants in at least this share of a column are tried.
    constants: float = 0.25
    #: A rule of this compression ratio ends a search.
    stop: float = 1.0
    #: Seconds after which the best rule so far is taken.
    seconds: float | None = None
    #: Decides after each level whether to go on.
    go_on: Callable[[], bool] = lambda: True
    #: Share of exact evaluations in a search by estimates, relative to the beam; below 1 none are estimated.
    observe: float = 0.0


@dataclass(frozen=True)
class Scored:
    rule: Rule
    eval: Eval


@dataclass
class Stats:
    levels: int = 0
    jobs: int = 0
    evaluated: int = 0
    pruned: int = 0
    #: Milliseconds by phase of a run.
    ms: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def timed(self, phase: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.ms[phase] = self.ms.get(phase, 0.0) + 1000 * (time.monotonic() - began)


@dataclass
class Scorer:
    """Scores candidates over a base whose entailment marks may change between levels."""

    kb: Kb
    config: Config
    constants: dict[tuple[str, int], list[int]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    stats: Stats = field(default_factory=Stats)
    #: Steps that are tried at all, of (rule, longer rule, move).
    gate: Callable[[Rule, Rule, Move], bool] | None = None

    def __post_init__(self) -> None:
        self.constants = self.constants or self.kb.promising_constants(self.config.constants)
        ndv = self.kb.colvals.groupBy("rel", "col").agg(F.count("*").alias("n")).collect()
        self.ndv = {(r["rel"], r["col"]): r["n"] for r in ndv}

    # --- sizes of joins ----------------------------------------------------------------------

    @cached_property
    def meets(self) -> dict[tuple[tuple[str, int], tuple[str, int]], int]:
        """Rows of the join of each two columns."""
        self.stats.jobs += 1
        one = self.kb.colvals.select("val", F.struct("rel", "col").alias("x"), F.col("cnt").alias("m"))
        other = self.kb.colvals.select("val", F.struct("rel", "col").alias("y"), F.col("cnt").alias("n"))
        return {(tuple(r["x"]), tuple(r["y"])): int(r["rows"]) for r in one.join(other, "val").groupBy("x", "y").agg(F.sum(F.col("m").cast("double") * F.col("n")).alias("rows")).collect()}

    def rows_made(self, atoms: list[Atom]) -> float:
        """An estimate of the most rows that a join of atoms, one after the other, makes on its way. It decides how
        things are counted, not what is found."""
        sizes, order, left = self.kb.sizes, [atoms[0]], list(atoms[1:])
        most = rows = float(sizes[atoms[0].pred])
        while left:
            have = {v for a in order for v in a.vars}
            a = next((a for a in left if set(a.vars) & have), left[0])
            left.remove(a)
            ways = [self.meets.get(((o.pred, o.args.index(v)), (a.pred, a.args.index(v))), 0) / max(1, sizes[o.pred]) for o in order for v in set(a.vars) & set(o.vars)]
            rows *= min(ways, default=sizes[a.pred])
            most = max(most, rows)
            order.append(a)
        return most

    def single(self, pred: str, place: int) -> bool:
        return self.ndv.get((pred, place)) == self.kb.sizes[pred]

    def many(self, atoms: list[Atom]) -> bool:
        return len(atoms) > 1 and sum(self.kb.sizes.values()) > FEW_TUPLES and self.rows_made(atoms) > MANY_ROWS

    # --- derived tuples ----------------------------------------------------------------------

    def _component(self, atoms: list[Atom], gvs: list[Var]) -> tuple[str, int | None]:
        """A name for a component's bindings that does not depend on variable numbers, and the count if it is known."""
        if len(atoms) == 1 and len(gvs) == 1 and sum(a is not None for a in atoms[0].args) == 1:
            key = (atoms[0].pred, atoms[0].args.index(gvs[0]))
            return f"{key}", self.ndv.get(key, 0)
        names: dict[Var, Var] = {}
        shown = [Rule((Atom(a.pred, tuple(names.setdefault(x, Var(len(names))) if isinstance(x, Var) else x for x in a.args)),)) for a in sorted(atoms, key=lambda a: (a.pred, [isinstance(x, Const) for x in a.args]))]
        label = f"{';'.join(map(str, shown))}|{sorted(names[v].n for v in gvs)}"
        return label, self.counts.get(label)

    def derived_counts(self, rules: list[Rule]) -> dict[Rule, float]:
        """How many tuples each rule derives."""
        wanted: dict[str, DataFrame] = {}
        summed: dict[str, DataFrame] = {}
        parts: dict[Rule, list[str]] = {}
        known: dict[str, int] = {}
        for rule in rules:
            head = set(rule.head.vars)
            parts[rule] = []
            for atoms in cp.components(rule):
                gvs = sorted(head & {v for a in atoms for v in a.vars})
                label, n = self._component(atoms, gvs)
                parts[rule].append(label)
                if n is not None:
                    known[label] = n
                elif gvs and self.many(atoms):
                    summed.setdefault(label, cp.bindings_counted(atoms, self.kb, set(gvs), self.single).select(F.lit(label).alias("label"), "n"))
                elif label not in wanted:
                    bound = cp.joined(atoms, self.kb, set(gvs))
                    wanted[label] = (bound if gvs else bound.limit(1)).select(F.lit(label).alias("label"))
        if wanted or summed:
            self.stats.jobs += 1
            listed = [reduce(DataFrame.unionByName, wanted.values()).groupBy("label").agg(F.count("*").alias("n"))] if wanted else []
            found = reduce(DataFrame.unionByName, [*listed, *summed.values()]).collect()
            self.counts |= dict.fromkeys(wanted, 0) | {r["label"]: r["n"] for r in found}
        out = {}
        for rule in rules:
            empty, only = cp.free_places(rule)
            out[rule] = float(self.kb.n) ** (len(empty) + len(only))
            for label in parts[rule]:
                out[rule] *= known.get(label, self.counts.get(label, 0))
        return out

    # --- head rows kept ----------------------------------------------------------------------

    @staticmethod
    def _column(place: Place) -> str:
        return f"h_a{place[1]}" if place[0] == 0 else f"b{place[0]}_a{place[1]}"

    def _apart(self, rule: Rule, b: int, mine: list[tuple[int, Move, Rule]]) -> list[DataFrame]:
        """(entailed, k) of the head rows that each of a rule's moves keeps, for a rule whose groundings are too many to list: each longer rule is
        asked which head rows it keeps, and each body place in which columns the values are that a head row meets."""
        first = lambda r: lambda atoms: self.rows_made([r.head, *atoms]) < self.rows_made(atoms)
        out = [cp.kept_by(longer, self.kb, first(longer)).select(F.col("h_entailed").alias("entailed"), F.lit(k).alias("k")) for k, m, longer in mine if m[0] != "in"]
        for place in sorted({m[1] for _, m, _ in mine if m[0] == "in"}):
            wanted = {m[2]: k for k, m, _ in mine if m[0] == "in" and m[1] == place}
            plan = self.kb.spark.createDataFrame([(*c, k) for c, k in wanted.items()], "rel string, col int, m_k int")
            marks = self.kb.colvals.join(F.broadcast(plan), ["rel", "col"]).select("val", "m_k")
            if place[0]:
                met = cp.kept_by(rule, self.kb, first(rule), place, marks)
            else:
                met = cp.kept_by(rule, self.kb, first(rule)).join(marks, F.col(self._column(place)) == F.col("val"))
            out.append(met.select(F.col("h_entailed").alias("entailed"), F.col("m_k").alias("k")))
        return out

    def kept_counts(self, beams: list[Rule], asked: list[tuple[int, Move]], longer: list[Rule]) -> list[tuple[int, int]]:
        """Of each (beam number, move), and the longer rule it makes, how many head rows it keeps: (not entailed, entailed)."""
        tests, lookups, apart = [], [], []
        for b, rule in enumerate(beams):
            mine = [(k, m) for k, (at, m) in enumerate(asked) if at == b]
            if not mine:
                continue
            if any(self.many([rule.head, *atoms]) for atoms in [list(rule.body), *cp.components(rule)]):
                apart += self._apart(rule, b, [(k, m, longer[k]) for k, m in mine])
                continue
            used = sorted({self._column(p) for _, m in mine for p in ([m[1], m[2]] if m[0] == "eq" else [m[1]])})
            width = len(rule.head.args)
            row = F.array(*[F.col(f"h_a{i}") for i in range(width)]).alias("head")
            ground = cp.reduced_groundings(rule, self.kb, [c for c in used if not c.startswith("h_")]).select(row, F.col("h_entailed").alias("entailed"), *used)
            exact = [F.when(F.col(self._column(m[1])) == (F.col(self._column(m[2])) if m[0] == "eq" else F.lit(m[2])), F.lit(k)) for k, m in mine if m[0] != "in"]
            if exact:
                tests.append(ground.select("head", "entailed", F.explode(F.array_compact(F.array(*exact))).alias("k")))
            places = sorted({m[1] for _, m in mine if m[0] == "in"})
            if places:
                cells = F.array(*[F.struct(F.lit(self._column(p)).alias("place"), F.col(self._column(p)).alias("val")) for p in places])
                lookups.append(ground.select(F.lit(b).alias("beam"), "head", "entailed", F.explode(cells).alias("x")).select("beam", "head", "entailed", "x.place", "x.val").distinct())
        if lookups:
            spark = self.kb.spark
            targets = [(k, b, self._column(m[1]), m[2][0], m[2][1]) for k, (b, m) in enumerate(asked) if m[0] == "in"]
            plan = spark.createDataFrame(targets, "k int, beam int, place string, rel string, col int")
            met = reduce(DataFrame.unionByName, lookups).join(self.kb.colvals.select("rel", "col", "val"), "val")
            tests.append(met.join(F.broadcast(plan), ["beam", "place", "rel", "col"]).select("head", "entailed", "k"))
        out = [(0, 0)] * len(asked)
        if tests or apart:
            self.stats.jobs += 1
            listed = [reduce(DataFrame.unionByName, tests).distinct()] if tests else []
            # of those that are asked apart no head row repeats; each is summed by itself
            kept = [t.groupBy("k").agg(F.sum((~F.col("entailed")).cast("long")).alias("pos"), F.sum(F.col("entailed").cast("long")).alias("old")) for t in listed + apart]
            for r in reduce(DataFrame.unionByName, kept).collect():
                out[r["k"]] = (r["pos"], r["old"])
        return out

    def children(self, beams: list[Scored], pruner: Pruner) -> list[list[Scored]]:
        """Of each beam its scored children, in order of enumeration; rules of too little coverage become tabu."""
        asked, rules = [], []
        for b, s in enumerate(beams):
            for rule, move in moves(s.rule, self.kb.schema, self.constants):
                if (self.gate is None or self.gate(s.rule, rule, move)) and pruner.fresh(rule):
                    asked.append((b, move))
                    rules.append(rule)
                else:
                    self.stats.pruned += 1
        total = self.kb.sizes[beams[0].rule.head.pred]
        good = []
        for (b, _), rule, (pos, old) in zip(asked, rules, self.kept_counts([s.rule for s in beams], asked, rules), strict=True):
            if self.config.coverage >= pos / total:
                pruner.add_tabu(rule)
                self.stats.pruned += 1
            else:
                good.append((b, rule, pos, old))
        self.stats.evaluated += len(good)
        derived = self.derived_counts([r for _, r, _, _ in good])
        out: list[list[Scored]] = [[] for _ in beams]
        for b, rule, pos, old in good:
            parent = beams[b].eval
            out[b].append(Scored(rule, Eval(pos, derived[rule] - old, rule.length, parent.tau, parent.h)))
        return out


@dataclass
class SampledScorer(Scorer):
    """Scores with negative samples (relation to tuples with a weight) in place of all wrong tuples."""

    samples: dict[str, DataFrame] = field(default_factory=dict)

    def derived_counts(self, rules: list[Rule]) -> dict[Rule, float]:
        """Head rows that a rule derives, and the weight of the samples that it covers."""
        if not rules:
            return {}
        rows = []
        for k, rule in enumerate(rules):
            r = self.kb[rule.head.pred]
            wrong = self.samples[rule.head.pred].dropDuplicates(r.cols)
            right = cp.matched_head(rule, self.kb, r.df).agg(F.count("*").cast("double").alias("n"))
            covered = cp.matched_head(rule, self.kb, wrong).agg(F.coalesce(F.sum(F.col("weight").cast("double")), F.lit(0.0)).alias("n"))
            rows += [x.select(F.lit(k).alias("k"), "n") for x in (right, covered)]
        self.stats.jobs += 1
        found = reduce(DataFrame.unionByName, rows).groupBy("k").agg(F.sum("n").alias("n")).collect()
        return {rules[r["k"]]: r["n"] for r in found}


def alike_columns(similar: set[tuple[tuple[str, int], tuple[str, int]]]) -> Callable[[Rule, Rule, Move], bool]:
    """A gate: places are only joined if their columns are the same or a similar pair, in either order."""

    def near(a: tuple[str, int], b: tuple[str, int]) -> bool:
        return a == b or (a, b) in similar or (b, a) in similar

    def gate(rule: Rule, longer: Rule, move: Move) -> bool:
        kind, place, what = move
        own = (rule.atoms[place[0]].pred, place[1])
        if kind == "is":
            return True
        return near(own, what if kind == "in" else (rule.atoms[what[0]].pred, what[1]))

    return gate


def symmetric_only(rule: Rule, longer: Rule, move: Move) -> bool:
    """A gate: only rules on the way to h(X,Y):-p(Y,X), with whole binary atoms."""
    if len(longer.head.args) != 2 or len(longer.body) > 1 or any(isinstance(x, Const) for a in longer.atoms for x in a.args):
        return False
    return all(len(b.args) == 2 and all(x is None or x == longer.head.args[1 - i] for i, x in enumerate(b.args)) for b in longer.body) and longer.head.args[0] != longer.head.args[1] or not longer.body and longer.length == 0


def top(scored: list[Scored], metric: str) -> Scored | None:
    """The first of the best."""
    return max(scored, key=lambda s: s.eval.value(metric), default=None)


def find_rule(scorer: Scorer, pred: str, pruner: Pruner) -> Scored | None:
    """A rule for a relation that no step improves, or that is good enough; None if it is of no use."""
    kb, config, metric = scorer.kb, scorer.config, scorer.config.metric
    pruner.seen = set()
    start = Rule.start(pred, kb[pred].arity)
    pruner.fresh(start)
    beams, began = [Scored(start, cp.evaluate(start, kb))], time.monotonic()
    while True:
        scorer.stats.levels += 1
        candidates: list[Scored] = []
        optimum: Scored | None = None
        for parent, found in zip(beams, scorer.children(beams, pruner), strict=True):
            better = [c for c in found if c.eval.value(metric) > parent.eval.value(metric)]
            if not better and (optimum is None or optimum.eval.value(metric) < parent.eval.value(metric)):
                optimum = parent
            for c in better:
                if len(candidates) < config.beam:
                    candidates.append(c)
                    continue
                low = min(range(len(candidates)), key=lambda i: candidates[i].eval.value(metric))
                if c.eval.value(metric) > candidates[low].eval.value(metric):
                    candidates[low] = c
        if not config.go_on() or (config.seconds is not None and time.monotonic() - began > config.seconds):
            best = top([*beams, *candidates], metric)
            return best if best.eval.useful else None
        best = top(candidates, metric)
        if optimum is not None and (best is None or optimum.eval.value(metric) > best.eval.value(metric)):
            return optimum if optimum.eval.useful else None
        if best.eval.tau >= config.stop or best.eval.neg == 0:
            return best if best.eval.useful else None
        beams = candidates


def chosen_targets(kb: Kb, most: int | None = None, blocked: tuple[str, ...] = ()) -> list[str]:
    """The first relations, without blocked ones."""
    return [r for r in list(kb.relations)[:most] if r not in blocked]
