"""Rules as DataFrame plans.

A rule's body falls into components that share no variable; each is joined by itself and reduced
to the variables that it shares with the head, so that components are never multiplied unless the
derived tuples themselves are asked for. Head places that the body does not bind range over all
constants: they are counted by a factor, and joined with the constants only when listed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornpress.functions.scores import Eval
from hornpress.operators import tables as tb
from hornpress.operators.kb import Kb
from hornpress.plans.rules import Atom, Const, Rule, Var, linked


#: Values with more rows than this are compared with no other value.
TWINS = 64


def col_of(v: Var) -> str:
    return f"x{v.n}"


def column(kb: Kb, pred: str, place: int, name: str) -> DataFrame:
    """A column's distinct values; where the table of column values is at hand, without a shuffle."""
    if "colvals" in kb.__dict__:
        return kb.colvals.filter((F.col("rel") == pred) & (F.col("col") == place)).select(F.col("val").alias(name))
    return kb[pred].df.select(F.col(f"a{place}").alias(name)).distinct()


def atom_rows(atom: Atom, kb: Kb, keep: set[Var]) -> DataFrame:
    """Distinct bindings of the kept variables in one atom."""
    df = kb[atom.pred].df
    checks, first = [], {}
    for i, arg in enumerate(atom.args):
        if isinstance(arg, Const):
            checks.append(F.col(f"a{i}") == arg.value)
        elif isinstance(arg, Var):
            if arg in first:
                checks.append(F.col(f"a{i}") == F.col(f"a{first[arg]}"))
            first.setdefault(arg, i)
    rows = df.filter(tb.all_of(checks)) if checks else df
    kept = [(v, i) for v, i in first.items() if v in keep]
    if not checks and len(kept) == 1 and len(atom.args) > 1:
        return column(kb, atom.pred, kept[0][1], col_of(kept[0][0]))
    bound = rows.select(*[F.col(f"a{i}").alias(col_of(v)) for v, i in kept])
    # constants and kept variables in all places keep rows distinct; otherwise they are reduced before any join
    return bound if all(isinstance(a, Const) or a in keep for a in atom.args) else bound.distinct()


def components(rule: Rule) -> list[list[Atom]]:
    """Body atoms by shared variables."""
    groups = linked([set(b.vars) for b in rule.body if b.vars])
    return [[b for b in rule.body if set(b.vars) & g] for g in groups] + [[b] for b in rule.body if not b.vars]


def marked_rows(atom: Atom, place: int, marks: DataFrame, kb: Kb, keep: set[Var]) -> DataFrame:
    """Distinct bindings of the kept variables in one atom, with the marks (of val: m_*) of its value at a place."""
    rows = tb.prefixed(kb[atom.pred].df, "b0_").join(marks.withColumnRenamed("val", f"b0_a{place}"), f"b0_a{place}")
    first: dict[Var, int] = {}
    for i, arg in enumerate(atom.args):
        if isinstance(arg, Const):
            rows = rows.filter(F.col(f"b0_a{i}") == arg.value)
        elif isinstance(arg, Var) and first.setdefault(arg, i) != i:
            rows = rows.filter(F.col(f"b0_a{i}") == F.col(f"b0_a{first[arg]}"))
    return rows.select(*[F.col(f"b0_a{i}").alias(col_of(v)) for v, i in first.items() if v in keep], *[c for c in marks.columns if c != "val"]).distinct()


def joined(atoms: list[Atom], kb: Kb, keep: set[Var], rows_of: Callable[[Atom, Kb, set[Var]], DataFrame] = atom_rows) -> DataFrame:
    """Distinct bindings of `keep` for which all atoms hold. Variables are dropped once no later atom
    has them, and an atom that brings nothing new only filters. Marks (m_*) that an atom's rows bring are kept."""
    order, left = [atoms[0]], atoms[1:]
    while left:
        have = {v for a in order for v in a.vars}
        order.append(next((a for a in left if set(a.vars) & have), left[0]))
        left.remove(order[-1])
    rows = None
    for k, atom in enumerate(order):
        later = keep | {v for a in order[k + 1 :] for v in a.vars}
        shared_before = {v for a in order[:k] for v in a.vars}
        part = rows_of(atom, kb, later | shared_before)
        if rows is None:
            rows = part
        else:
            on = [c for c in part.columns if c in rows.columns]
            new = [c for c in part.columns if c not in rows.columns]
            rows = rows.join(part, on, "inner" if new else "left_semi") if on else rows.crossJoin(part)
        wanted = [c for c in rows.columns if c in {col_of(v) for v in later} or c.startswith("m_")]
        if len(wanted) < len(rows.columns):
            rows = rows.select(*wanted).distinct()
    return rows


def twins(rows: DataFrame, c: str, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows of one value of column c out of all that have the same rows otherwise, and (c, w): how many those are.
    A value of more than TWINS rows stands for itself, so that no row holds a long list. single: no value has two rows."""
    others = [x for x in rows.columns if x != c]
    if single:
        alike = rows.groupBy(*others).agg(F.min(c).alias(c), F.count("*").alias("w"))
        return alike.drop("w"), alike.select(c, "w")
    rest = F.struct(*others)
    size = rows.groupBy(c).agg(F.count("*").alias("n"))
    lists = rows.join(size.filter(F.col("n") <= TWINS), c).groupBy(c).agg(F.sort_array(F.collect_list(rest)).alias("met"))
    alike = lists.groupBy("met").agg(F.min(c).alias(c), F.count("*").alias("w")).select(c, "w")
    weights = alike.unionByName(size.filter(F.col("n") > TWINS).select(c, F.lit(1).cast("long").alias("w")))
    return rows.join(weights, c, "left_semi"), weights


def bindings_counted(atoms: list[Atom], kb: Kb, keep: set[Var], single: Callable[[str, int], bool] = lambda pred, place: False) -> DataFrame:
    """One row (n): the number of distinct bindings of `keep` for which all atoms hold. Of variables that only one
    atom has, values that meet the same others are joined once and counted as often as there are. single: whether
    no value is in two rows of a relation's column."""
    places = [v for a in atoms for v in a.vars]
    chosen: dict[Atom, Var] = {}
    for a in atoms:
        alone = [v for v in dict.fromkeys(a.vars) if v in keep and places.count(v) == 1]
        if alone and len({x for x in a.vars if x in keep or places.count(x) > 1}) > 1 and atoms.count(a) == 1:
            chosen[a] = alone[0]
    reps, weights = {}, []
    for a, v in chosen.items():
        first, weight = twins(atom_rows(a, kb, {*a.vars} & (keep | {x for x in a.vars if places.count(x) > 1})), col_of(v), single(a.pred, a.args.index(v)))
        reps[a] = first
        weights.append((col_of(v), weight))
    rows = joined(atoms, kb, keep, lambda a, kb, wanted: reps[a] if a in reps else atom_rows(a, kb, wanted))
    every = F.lit(1).cast("long")
    for k, (c, weight) in enumerate(weights):
        rows = rows.join(weight.withColumnRenamed("w", f"w{k}"), c)
        every = every * F.col(f"w{k}")
    return rows.agg(F.coalesce(F.sum(every), F.lit(0)).alias("n"))


def bindings(rule: Rule, kb: Kb) -> list[tuple[list[Var], DataFrame]]:
    """Of each component the head variables that it binds, and their distinct bindings."""
    head = set(rule.head.vars)
    out = []
    for atoms in components(rule):
        gvs = sorted(head & {v for a in atoms for v in a.vars})
        out.append((gvs, joined(atoms, kb, set(gvs))))
    return out


def free_places(rule: Rule) -> tuple[list[int], list[Var]]:
    """Empty head arguments, and head variables that no body atom has."""
    bound = {v for b in rule.body for v in b.vars}
    return [i for i, a in enumerate(rule.head.args) if a is None], sorted({v for v in rule.head.vars if v not in bound})


def fitting_head(rule: Rule, kb: Kb, head: DataFrame | None = None) -> DataFrame:
    """Head rows (with `entailed`) that have the constants and equal places of the rule's head."""
    rows = kb[rule.head.pred].flagged if head is None else head
    for i, arg in enumerate(rule.head.args):
        if isinstance(arg, Const):
            rows = rows.filter(F.col(f"a{i}") == arg.value)
        elif isinstance(arg, Var) and (first := rule.head.args.index(arg)) != i:
            rows = rows.filter(F.col(f"a{i}") == F.col(f"a{first}"))
    return rows


def matched_head(rule: Rule, kb: Kb, head: DataFrame | None = None) -> DataFrame:
    """Head rows (with `entailed`) that the rule derives."""
    rows = fitting_head(rule, kb, head)
    for gvs, bound in bindings(rule, kb):
        if gvs:
            on = [rows[f"a{rule.head.args.index(v)}"] == bound[col_of(v)] for v in gvs]
            rows = rows.join(bound, on, "left_semi")
        else:
            rows = rows.join(bound.limit(1), how="left_semi")
    return rows


def evaluation(rule: Rule, kb: Kb) -> DataFrame:
    """One row: pos, all, old, rows, from one plan."""
    empty, only = free_places(rule)
    counted = matched_head(rule, kb).agg(F.coalesce(F.sum((~F.col("entailed")).cast("long")), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.col("entailed").cast("long")), F.lit(0)).alias("old"))
    derived = F.lit(float(kb.n) ** (len(empty) + len(only)))
    for k, (gvs, bound) in enumerate(bindings(rule, kb)):
        size = bound.agg(F.count("*").alias(f"c{k}")) if gvs else bound.limit(1).agg(F.count("*").alias(f"c{k}"))
        counted = counted.crossJoin(size)
        derived = derived * F.col(f"c{k}")
    return counted.select(F.col("pos"), (derived - F.col("old")).alias("all"), "old")


def evaluate(rule: Rule, kb: Kb, parent: Eval | None = None) -> Eval:
    row = evaluation(rule, kb).first()
    return Eval(row["pos"], row["all"], rule.length, parent.tau if parent else 0.0, parent.h if parent else 0.0)


def coverage(rule: Rule, kb: Kb) -> float:
    """Share of all head rows that the rule derives and no rule before did."""
    total = kb.sizes[rule.head.pred]
    return matched_head(rule, kb).filter(~F.col("entailed")).count() / total if total else 0.0


def derived(rule: Rule, kb: Kb, constants: DataFrame | None = None) -> DataFrame:
    """All head tuples that the rule derives. Unbound head places take every constant (value), 1 to n by default."""
    empty, only = free_places(rule)
    every = kb.spark.range(1, kb.n + 1).select(F.col("id").cast("int").alias("value")) if constants is None else constants
    parts = [b for g, b in bindings(rule, kb) if g]
    for gvs, bound in bindings(rule, kb):
        if not gvs:  # the component only has to hold
            parts.append(bound.limit(1).select(F.lit(1).alias("holds")))
    parts += [every.select(F.col("value").alias(col_of(v))) for v in only] + [every.select(F.col("value").alias(f"free{i}")) for i in empty]
    one = kb.spark.range(1).select(F.lit(1).alias("one"))
    rows = reduce(DataFrame.crossJoin, parts) if parts else one
    picked = [(F.col(f"free{i}") if a is None else F.lit(a.value) if isinstance(a, Const) else F.col(col_of(a))).cast("int").alias(f"a{i}") for i, a in enumerate(rule.head.args)]
    return rows.select(*picked).distinct()


def counterexamples(rule: Rule, kb: Kb) -> DataFrame:
    """Derived tuples that the relation lacks."""
    return tb.absent(derived(rule, kb), kb[rule.head.pred].df)


def newly_entailed(rule: Rule, kb: Kb) -> DataFrame:
    return matched_head(rule, kb).filter(~F.col("entailed")).select(*kb[rule.head.pred].cols)


def groundings(rule: Rule, kb: Kb, head: DataFrame | None = None) -> DataFrame:
    """Head rows joined with whole body rows: columns h_a*, b1_a*, b2_a*, ..."""
    rows = tb.prefixed(matched_head(rule, kb) if head is None else head, "h_")
    at = {v: f"h_a{rule.head.args.index(v)}" for v in rule.head.vars}
    return _grounded(rows, at, list(enumerate(rule.body, 1)), kb)


def reduced_groundings(rule: Rule, kb: Kb, used: list[str]) -> DataFrame:
    """Head rows (h_a*, h_entailed) with the body columns `used` of their groundings, in which rows can repeat: every
    atom is cut to those and to what it is joined by, and made distinct, before it is joined. The joins themselves
    drop head rows without a grounding."""
    rows = tb.prefixed(fitting_head(rule, kb), "h_")
    at = {v: f"h_a{rule.head.args.index(v)}" for v in rule.head.vars}
    return _grounded(rows, at, list(enumerate(rule.body, 1)), kb, set(used)).select(*rows.columns, *used)


def kept_by(rule: Rule, kb: Kb, head_first: Callable[[list[Atom]], bool], at: tuple[int, int] | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Distinct head rows (h_a*, h_entailed) that the rule derives, with the marks (of val: m_*) of what they meet at
    a place of the body, if one is given. Of each component of the body either its bindings are listed and looked up,
    or head rows are joined with its atoms: head_first says which makes fewer rows."""
    rows = tb.prefixed(fitting_head(rule, kb), "h_")
    own = rows.columns
    for atoms in components(rule):
        here = at is not None and rule.atoms[at[0]] in atoms
        gvs = sorted(set(rule.head.vars) & {v for a in atoms for v in a.vars})
        extra = [c for c in marks.columns if c != "val"] if here else []
        if gvs and head_first(atoms):
            start = {v: f"h_a{rule.head.args.index(v)}" for v in rule.head.vars}
            numbered = [(k, a) for k, a in enumerate(rule.atoms) if k and a in atoms]
            rows = _grounded(rows, start, numbered, kb, set(extra), (f"b{at[0]}_a{at[1]}", marks) if here else None).select(*own, *extra).distinct()
        else:
            part = lambda a, kb, keep: marked_rows(a, at[1], marks, kb, keep) if here and a == rule.atoms[at[0]] else atom_rows(a, kb, keep)  # noqa: B023, E731
            bound = joined(atoms, kb, set(gvs), part)
            on = [rows[f"h_a{rule.head.args.index(v)}"] == bound[col_of(v)] for v in gvs]
            if here:
                rows = (rows.join(bound, on) if on else rows.crossJoin(bound)).select(*own, *extra)
            else:
                rows = rows.join(bound, on, "left_semi") if on else rows.join(bound.limit(1), how="left_semi")
        own = own + extra
    return rows


def body_groundings(rule: Rule, kb: Kb) -> list[tuple[list[int], DataFrame]]:
    """Of each body component its atom numbers, and its whole rows joined without the head: columns b1_a*, b2_a*, ..."""
    groups = linked([set(b.vars) for b in rule.body if b.vars])
    parts = [[k for k, b in enumerate(rule.body, 1) if set(b.vars) & g] for g in groups] + [[k] for k, b in enumerate(rule.body, 1) if not b.vars]
    return [(ks, _grounded(None, {}, [(k, rule.atoms[k]) for k in ks], kb)) for ks in parts]


def _grounded(rows: DataFrame | None, at: dict[Var, str], left: list[tuple[int, Atom]], kb: Kb, used: set[str] | None = None, marked: tuple[str, DataFrame] | None = None) -> DataFrame:
    """rows, whose columns `at` hold variables, joined with the rows of atoms; of these only `used` columns, if given.
    marked: a column of an atom and marks (of val: m_*), which take the place of its values."""
    while left:
        k, atom = next(((k, a) for k, a in left if set(a.vars) & set(at)), left[0])
        left.remove((k, atom))
        part, on = tb.prefixed(kb[atom.pred].df, f"b{k}_"), []
        for i, arg in enumerate(atom.args):
            name = f"b{k}_a{i}"
            if isinstance(arg, Const):
                part = part.filter(F.col(name) == arg.value)
            elif isinstance(arg, Var):
                if arg in at and at[arg].startswith(f"b{k}_"):
                    part = part.filter(F.col(name) == F.col(at[arg]))
                elif arg in at:
                    on.append(rows[at[arg]] == part[name])
                else:
                    at[arg] = name
        if marked is not None and marked[0] in part.columns:
            part = part.join(marked[1].withColumnRenamed("val", marked[0]), marked[0])
        if used is not None:
            later = {at[v] for _, a in left for v in a.vars if v in at}
            joins = {f"b{k}_a{i}" for i, arg in enumerate(atom.args) if isinstance(arg, Var) and at[arg] != f"b{k}_a{i}"}
            own = [c for c in part.columns if c in used | later | joins]
            bound = [a for a in atom.args if a is not None]
            plain = all(isinstance(a, Var) for a in bound) and len(set(bound)) == len(bound)
            fixed = {f"b{k}_a{i}" for i, arg in enumerate(atom.args) if isinstance(arg, Const) or isinstance(arg, Var) and at[arg] in own and at[arg] != f"b{k}_a{i}"}
            if plain and len(own) == 1 and len(atom.args) > 1:
                cut = column(kb, atom.pred, int(own[0].rpartition("_a")[2]), own[0])
            else:
                cut = part.select(*own)
                cut = cut if set(part.columns) <= {*own, *fixed} else cut.distinct()
            on = [(at[arg], f"b{k}_a{i}") for i, arg in enumerate(atom.args) if isinstance(arg, Var) and not at[arg].startswith(f"b{k}_")]
            part, on = cut, [rows[x] == cut[y] for x, y in on]
            if not part.columns:  # the atom only has to hold
                rows = rows.join(part.limit(1), how="left_semi")
                continue
            if on and not set(part.columns) & (used | later):
                rows = rows.join(part, on, "left_semi")
                continue
        rows = part if rows is None else rows.join(part, on) if on else rows.crossJoin(part)
    return rows


def evidence(rule: Rule, kb: Kb) -> DataFrame:
    """One grounding of each newly entailed head row, the smallest: struct head, struct body (of structs b1, b2, ...)."""
    cols = kb[rule.head.pred].cols
    fresh = matched_head(rule, kb).filter(~F.col("entailed")).drop("entailed")
    rows = groundings(rule, kb, fresh)
    body = [F.struct(*[F.col(f"b{k}_a{i}").alias(f"a{i}") for i in range(len(b.args))]).alias(f"b{k}") for k, b in enumerate(rule.body, 1)]
    chosen = F.min(F.struct(*body)) if body else F.lit(None).cast("string")
    return rows.groupBy(*[F.col(f"h_{c}").alias(c) for c in cols]).agg(chosen.alias("body")).select(F.struct(*cols).alias("head"), "body")
