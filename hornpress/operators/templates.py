"""Rules of fixed shapes, found without a search.

A template is a rule over placeholders for relations. All its instances are counted by one plan:
tuples of all relations of an arity are one table with the relation's name, body atoms are joined
on their shared variables, and figures are grouped by the names that the placeholders took. The
plan's size follows from the template, not from the number of relations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornpress.functions import multisets as ms
from hornpress.operators import tables as tb
from hornpress.operators.graph import checkpointed
from hornpress.operators.kb import Kb
from hornpress.plans import compile as cp
from hornpress.plans.rules import Atom, Const, Rule, Var, parse_rule

COVERAGE, TAU, SIMILAR = 0.2, 0.8, 0.8
RESULT_COLUMNS = ["rule", "length", "pos", "neg", "coverage", "tau", "delta"]
RESULT = "rule string, length int, pos long, neg long, coverage double, tau double, delta double"


def similar_pairs(kb: Kb, threshold: float = SIMILAR) -> set[tuple[tuple[str, int], tuple[str, int]]]:
    """Ordered pairs of columns of which the first's rows are mostly in the second (bounded by the number of columns)."""
    rows = ms.similar_columns(kb.colvals, threshold).collect()
    return {((r["rel_i"], r["col_i"]), (r["rel_j"], r["col_j"])) for r in rows}


def measured(kb: Kb, candidates: list[tuple[Rule, int]]) -> DataFrame:
    """(rule, length, pos, neg, coverage, tau, delta) of given rules, in one plan."""
    rows = [cp.evaluation(rule, kb).select(F.lit(str(rule)).alias("rule"), F.lit(length).alias("length"), F.col("pos").cast("long").alias("pos"), F.col("all"), F.lit(kb.sizes[rule.head.pred]).alias("rows")) for rule, length in candidates]
    if not rows:
        return kb.spark.createDataFrame([], RESULT)
    return _figures(reduce(DataFrame.unionByName, rows), [])


def accepted(results: DataFrame, coverage: float = COVERAGE, tau: float = TAU) -> DataFrame:
    return results.filter((F.col("coverage") >= coverage) & (F.col("tau") >= tau))


@dataclass(frozen=True)
class Shape:
    """A rule over placeholders, its length, and groups of placeholders that may not all be the same relation."""

    rule: Rule
    length: int
    groups: tuple[tuple[str, ...], ...] = ()

    @staticmethod
    def of(text: str, length: int, *groups: tuple[str, ...]) -> Shape:
        return Shape(parse_rule(text), length, groups)

    @property
    def holders(self) -> list[str]:
        return list(dict.fromkeys(a.pred for a in self.rule.atoms))

    def barred(self) -> Column:
        """Whether the relations that the placeholders took break a group or make a rule that isn't worth a look."""
        bad = [tb.all_of([F.col(f"r_{g[0]}") == F.col(f"r_{x}") for x in g[1:]]) for g in self.groups]
        arity = {a.pred: len(a.args) for a in self.rule.atoms}
        for same in _partitions(self.holders):
            if any(len({arity[h] for h in part}) > 1 for part in same):
                continue  # no relation has two arities
            name = {h: f"p{k}" for k, part in enumerate(same) for h in part}
            if Rule(tuple(Atom(name[a.pred], a.args) for a in self.rule.atoms)).invalid:
                equal = [F.col(f"r_{part[0]}") == F.col(f"r_{h}") for part in same for h in part[1:]]
                apart = [F.col(f"r_{one[0]}") != F.col(f"r_{other[0]}") for one, other in combinations(same, 2)]
                bad.append(tb.all_of([*equal, *apart]))
        return reduce(lambda x, y: x | y, bad, F.lit(False))

    def text(self) -> Column:
        """The instance's rule as text."""
        shown = [(a.pred, str(Rule((Atom("", a.args),)))[:-2]) for a in self.rule.atoms]
        (head, args), *body = shown
        parts = [F.col(f"r_{head}"), F.lit(f"{args}:-")]
        for k, (pred, inside) in enumerate(body):
            parts += [F.col(f"r_{pred}"), F.lit(inside + "," * (k < len(body) - 1))]
        return F.concat(*parts)


def _partitions(items: list[str]) -> list[list[list[str]]]:
    """All ways to part a few items into groups."""
    if not items:
        return [[]]
    first, rest = items[0], _partitions(items[1:])
    return [[[first], *p] for p in rest] + [[*p[:k], [first, *p[k]], *p[k + 1 :]] for p in rest for k in range(len(p))]


def _rows(kb: Kb, atom: Atom, head: bool = False) -> DataFrame:
    """Tuples of all relations that an atom's placeholder can stand for: the relation's name and distinct bindings
    of the atom's variables; of the head every tuple and whether it is entailed."""
    held = [r for r in kb.relations.values() if r.arity == len(atom.args)]
    none = kb.spark.createDataFrame([], ", ".join([*(f"{c} int" for c in tb.names(len(atom.args))), "entailed boolean", "rel string"]))
    flagged = lambda r: r.flagged if head else r.df.withColumn("entailed", F.lit(False))
    rows = reduce(DataFrame.unionByName, (flagged(r).withColumn("rel", F.lit(r.name)) for r in held), none)
    first: dict[Var, int] = {}
    for i, x in enumerate(atom.args):
        if isinstance(x, Const):
            rows = rows.filter(F.col(f"a{i}") == x.value)
        elif isinstance(x, Var) and first.setdefault(x, i) != i:
            rows = rows.filter(F.col(f"a{i}") == F.col(f"a{first[x]}"))
    chosen = [F.col("rel").alias(f"r_{atom.pred}"), *[F.col(f"a{i}").alias(cp.col_of(v)) for v, i in first.items()]]
    return rows.select(*chosen, "entailed", *tb.names(len(atom.args))) if head else rows.select(*chosen).distinct()


def _near(left: DataFrame, pairs: DataFrame | None, before: list[Atom], atom: Atom) -> DataFrame:
    """left with the relations that the atom's placeholder may take beside those taken: columns that are to share
    a variable must be alike."""
    if pairs is None:
        return left
    meets = [(o.pred, o.args.index(v), atom.args.index(v)) for o in before for v in dict.fromkeys(atom.vars) if v in o.args]
    for pred, i, j in meets:
        chosen = pairs.filter((F.col("col_i") == i) & (F.col("col_j") == j)).select(F.col("rel_i").alias(f"r_{pred}"), F.col("rel_j").alias(f"r_{atom.pred}"))
        left = left.join(F.broadcast(chosen), [c for c in chosen.columns if c in left.columns])
    return left


def alike(kb: Kb, threshold: float) -> DataFrame:
    """(rel_i, col_i, rel_j, col_j): similar columns, both ways round, and each column with itself."""
    pairs = ms.similar_columns(kb.colvals, threshold).select("rel_i", "col_i", "rel_j", "col_j")
    turned = pairs.select(F.col("rel_j").alias("rel_i"), F.col("col_j").alias("col_i"), F.col("rel_i").alias("rel_j"), F.col("col_i").alias("col_j"))
    own = kb.spark.createDataFrame([(r, i, r, i) for r, k in kb.schema for i in range(k)], "rel_i string, col_i int, rel_j string, col_j int")
    return checkpointed(pairs.unionByName(turned).unionByName(own).distinct())


def _takers(kb: Kb, shape: Shape, pairs: DataFrame | None, atoms: list[Atom]) -> Callable[[DataFrame], DataFrame]:
    """Keeps of a component's rows those whose relations the placeholders can take together, of arities that fit: with
    a head relation whose columns are like theirs, and not barred. Others derive nothing that is asked for."""
    head = shape.rule.head
    if pairs is None or not any(set(a.vars) & set(head.vars) for a in atoms):
        return lambda rows: rows
    near = {tuple(r) for r in pairs.collect()}
    after: dict[str, dict[int, list[tuple[str, int]]]] = {}
    for rel, i, other, j in near:
        after.setdefault(rel, {}).setdefault(i, []).append((other, j))
    arity = dict(kb.schema)
    taken, done, left = [{head.pred: r} for r, k in kb.schema if k == len(head.args)], [head], list(atoms)
    while left:
        a = next(a for a in left if any(set(a.vars) & set(o.vars) for o in done))
        left.remove(a)
        meets = [(o.pred, o.args.index(v), a.args.index(v)) for o in done for v in dict.fromkeys(a.vars) if v in o.args]
        pred, i, j = meets[0]
        wider = [{**t, a.pred: r} for t in taken for r, col in after.get(t[pred], {}).get(i, []) if col == j and arity[r] == len(a.args) and t.get(a.pred, r) == r]
        taken = [t for t in wider if all((t[p], x, t[a.pred], y) in near for p, x, y in meets)]
        done.append(a)
    names = [f"r_{h}" for h in dict.fromkeys(a.pred for a in done)]
    chosen = kb.spark.createDataFrame([tuple(t[n[2:]] for n in names) for t in taken], ", ".join(f"{n} string" for n in names))
    if len(names) == len(shape.holders):
        chosen = chosen.filter(~shape.barred())

    def keep(rows: DataFrame) -> DataFrame:
        on = [n for n in names if n in rows.columns]
        return rows.join(F.broadcast(chosen.select(*on).distinct()), on, "left_semi")

    return keep


def _bindings(kb: Kb, shape: Shape, pairs: DataFrame | None) -> list[DataFrame]:
    """Of each component of the body: names taken and distinct bindings of the head's variables."""
    head, out = set(shape.rule.head.vars), []
    for atoms in cp.components(shape.rule):
        order, left = [atoms[0]], atoms[1:]
        keep = _takers(kb, shape, pairs, atoms)
        rows = keep(_rows(kb, atoms[0]))
        while left:
            have = {v for a in order for v in a.vars}
            nxt = next(a for a in left if set(a.vars) & have)
            left.remove(nxt)
            rows, part = keep(_near(rows, pairs, order, nxt)), _rows(kb, nxt)
            order.append(nxt)
            later = head | {v for a in left for v in a.vars}
            joined = rows.join(part, [c for c in part.columns if c in rows.columns])
            rows = joined.select(*[c for c in joined.columns if c.startswith("r_") or c in {cp.col_of(v) for v in later}]).distinct()
        out.append(rows.select(*[c for c in rows.columns if c.startswith("r_") or c in {cp.col_of(v) for v in head}]).distinct())
    return out


def _matched(kb: Kb, shape: Shape, parts: list[DataFrame], pairs: DataFrame | None) -> DataFrame:
    """Head rows that instances derive, with the names taken."""
    rows, done = _rows(kb, shape.rule.head, head=True), [shape.rule.head]
    for atoms, part in zip(cp.components(shape.rule), parts, strict=True):
        if pairs is not None:
            for a in atoms:
                if set(a.vars) & set(shape.rule.head.vars):
                    rows = _near(rows, pairs, done[:1], a)
        rows = rows.join(part, [c for c in part.columns if c in rows.columns])
    return rows.filter(~shape.barred())


def counted(kb: Kb, shape: Shape, pairs: DataFrame | None = None) -> DataFrame:
    """(rule, length, pos, neg, coverage, tau, delta, r_*) of the instances that derive a tuple of their head; of a
    template without a body of all instances. pairs: columns that may share a variable."""
    names = [f"r_{h}" for h in shape.holders]
    parts = [checkpointed(p) for p in _bindings(kb, shape, pairs)]
    found = _matched(kb, shape, parts, pairs).groupBy(*names).agg(F.sum((~F.col("entailed")).cast("long")).alias("pos"), F.sum(F.col("entailed").cast("long")).alias("old"))
    head = f"r_{shape.rule.head.pred}"
    sizes = kb.spark.createDataFrame([(r, n) for r, n in kb.sizes.items() if kb[r].arity == len(shape.rule.head.args)], f"{head} string, rows long")
    found = F.broadcast(sizes).join(found, head, "inner" if shape.rule.body else "left").fillna(0, ["pos", "old"])
    empty, only = cp.free_places(shape.rule)
    every = F.lit(float(kb.n) ** (len(empty) + len(only)))
    for k, part in enumerate(parts):
        taken = [c for c in part.columns if c.startswith("r_")]
        found = found.join(part.groupBy(*taken).agg(F.count("*").alias(f"n{k}")), taken)
        every = every * F.col(f"n{k}")
    return _figures(found.withColumn("all", every - F.col("old")).withColumn("rule", shape.text()).withColumn("length", F.lit(shape.length)), names)


def _figures(rows: DataFrame, more: list[str]) -> DataFrame:
    pos, every, length = F.col("pos"), F.col("all"), F.col("length")
    ratio = F.when(every + length > 0, pos / (every + length)).otherwise(0.0)
    return rows.select("rule", "length", "pos", (every - pos).cast("long").alias("neg"), (pos / F.col("rows")).alias("coverage"), ratio.alias("tau"), (pos - (every - pos) - length).cast("double").alias("delta"), *more)


def _arities(kb: Kb) -> list[int]:
    return sorted({r.arity for r in kb.relations.values()})


def _args(n: int) -> str:
    return ",".join(f"X{i}" for i in range(n))


def shapes(kb: Kb, template: str) -> list[Shape]:
    """A template's shapes for the arities of the base."""
    if template == "TypeInference":  # h(X):-p(..,X,..)
        return [Shape(Rule((Atom("h", (Var(0),)), Atom("p", (None,) * k).put(i, Var(0)))), 1) for k in _arities(kb) if k > 1 for i in range(k)]
    if template == "Subsumption":  # h(X..):-p(X..)
        return [Shape(Rule((Atom("h", xs := tuple(map(Var, range(k)))), Atom("p", xs))), 2 * k, (("h", "p"),)) for k in _arities(kb)]
    return [Shape.of(*TEMPLATES[template])]


TEMPLATES: dict[str, tuple[str, int]] = {
    "TypeInference": ("h(X):-p(X,?)", 1),
    "Reflexive": ("h(X,X):-", 1),
    "Subsumption": ("h(X,Y):-p(X,Y)", 4),
    "Dual": ("h(X,Y):-p(Y,X)", 2),
    "Transition": ("h(X,Y):-p(X,Z),q(Z,Y)", 3),
    "DualTransition": ("h(X,Y):-p(Y,Z),q(Z,X)", 3),
    "SharedSource": ("h(X,Y):-p(Z,X),q(Z,Y)", 3),
    "SharedSink": ("h(X,Y):-p(X,Z),q(Y,Z)", 3),
}


def match(kb: Kb, template: str, coverage: float = COVERAGE, tau: float = TAU, similar: float = SIMILAR) -> DataFrame:
    """A template's accepted rules and their figures. Columns that share a variable must be that similar."""
    return _accepted(kb, shapes(kb, template), alike(kb, similar), coverage, tau)


def _accepted(kb: Kb, found: list[Shape], pairs: DataFrame | None, coverage: float, tau: float) -> DataFrame:
    rows = [accepted(counted(kb, s, pairs), coverage, tau).select(*RESULT_COLUMNS) for s in found]
    return reduce(DataFrame.unionByName, rows, kb.spark.createDataFrame([], RESULT))


def covered(kb: Kb, found: list[Shape], pairs: DataFrame | None = None, coverage: float = COVERAGE, tau: float = TAU) -> DataFrame:
    """(rel, covered): how many tuples of a relation the accepted rules of some shapes derive."""
    rows = []
    for s in found:
        parts = [checkpointed(p) for p in _bindings(kb, s, pairs)]
        kept = accepted(counted(kb, s, pairs), coverage, tau).select(*[f"r_{h}" for h in s.holders])
        met = _matched(kb, s, parts, pairs).join(F.broadcast(kept), kept.columns, "left_semi")
        rows.append(met.select(F.col(f"r_{s.rule.head.pred}").alias("rel"), F.array(*tb.names(len(s.rule.head.args))).alias("args")))
    every = reduce(DataFrame.unionByName, rows, kb.spark.createDataFrame([], "rel string, args array<int>"))
    return every.distinct().groupBy("rel").agg(F.count("*").alias("covered"))


def hinted(kb: Kb, templates: list[str] | None = None, coverage: float = COVERAGE, tau: float = TAU, similar: float = SIMILAR) -> tuple[dict[str, DataFrame], DataFrame]:
    """A run of templates by name: each one's accepted rules, and (template, rules, covered, records, share) of each."""
    chosen = list(TEMPLATES) if templates is None else templates
    if unknown := set(chosen) - set(TEMPLATES):
        raise ValueError(f"unknown templates: {sorted(unknown)}")
    pairs, found, stats = alike(kb, similar), {}, []
    for t in chosen:
        found[t] = checkpointed(_accepted(kb, shapes(kb, t), pairs, coverage, tau))
        reach = covered(kb, shapes(kb, t), pairs, coverage, tau).agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
        stats.append(found[t].agg(F.count("*").alias("rules")).crossJoin(reach).select(F.lit(t).alias("template"), "rules", "covered"))
    total = F.lit(sum(kb.sizes.values()))
    return found, reduce(DataFrame.unionByName, stats).select("template", "rules", "covered", total.alias("records"), F.when(total > 0, F.col("covered") / total).otherwise(0.0).alias("share"))


def type_rules(kb: Kb, type_relation: str = "type") -> DataFrame:
    """(rule, pos, all): t2(X):-t1(X) where over half of t1 are t2, and t(X):-p(..X..) where over half of the column's values are t.

    Types are the second argument of the type relation, entities the first.
    """
    typed = kb[type_relation].df.select(F.col("a0").alias("entity"), F.col("a1").alias("type"))
    sizes = typed.groupBy("type").agg(F.count("*").alias("n"))
    other = typed.select("entity", F.col("type").alias("type2"))
    both = typed.join(other, "entity").filter("type <> type2").groupBy("type", "type2").agg(F.count("*").alias("pos"))
    sub = both.join(sizes, "type").filter(2 * F.col("pos") > F.col("n")).select(F.concat(F.lit("type"), F.col("type2"), F.lit("(X0):-type"), F.col("type"), F.lit("(X0)")).alias("rule"), "pos", F.col("n").alias("all"))
    values = kb.colvals.filter(F.col("rel") != type_relation).select("rel", "col", F.col("val").alias("entity"))
    held = values.join(typed, "entity").groupBy("rel", "col", "type").agg(F.count("*").alias("pos"))
    ndv = values.groupBy("rel", "col").agg(F.count("*").alias("n"))
    infer = held.join(ndv, ["rel", "col"]).filter(2 * F.col("pos") > F.col("n")).select(F.concat(F.lit("type"), F.col("type"), F.lit("(X0):-"), F.col("rel"), F.lit("["), F.col("col"), F.lit("](X0)")).alias("rule"), "pos", F.col("n").alias("all"))
    return sub.unionByName(infer)


# --- templates given as text ------------------------------------------------------------------


def parse_hint(line: str) -> tuple[Rule, list[list[str]]]:
    """A rule over placeholder relations, and after a `;` groups of placeholders that may not all be the same relation: `p(X,Y):-q(Y,X);(p,q)`."""
    rule, _, rest = line.partition(";")
    groups = [[x.strip() for x in g.split(",")] for g in rest.replace(" ", "").strip("()").split("),(") if g]
    parsed = parse_rule(rule)
    unknown = {x for g in groups for x in g} - {a.pred for a in parsed.atoms}
    if unknown:
        raise ValueError(f"unknown relations in {line!r}: {sorted(unknown)}")
    return parsed, groups


def match_hints(kb: Kb, lines: list[str], coverage: float = COVERAGE, tau: float = TAU) -> DataFrame:
    """Accepted instances of hints given as text, whatever the similarity of columns."""
    found = [Shape(rule, rule.length, tuple(map(tuple, groups))) for rule, groups in map(parse_hint, lines)]
    return _accepted(kb, found, None, coverage, tau)


def entailed_by(kb: Kb, rules: list[Rule]) -> DataFrame:
    """Head tuples that any of the rules of one relation derives."""
    return tb.union_of(*(cp.matched_head(r, kb).select(*kb[r.head.pred].cols) for r in rules))


def has_constants(rule: Rule) -> bool:
    return any(isinstance(a, Const) for atom in rule.atoms for a in atom.args)
