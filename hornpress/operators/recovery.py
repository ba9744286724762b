"""Rebuilding a base: rules are applied to the necessary tuples until nothing new appears."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornpress.operators import tables as tb
from hornpress.operators.graph import checkpointed, new_folder, written
from hornpress.operators.kb import Kb, Relation
from hornpress.plans import compile as cp
from hornpress.plans.rules import Atom, Const, Rule, Var


def all_constants(facts: Kb, counter: dict[str, DataFrame], rules: list[Rule], extra: DataFrame | None) -> DataFrame:
    """(value): constants of tuples, counterexamples and rules, and the supplementary ones."""
    spark = facts.spark
    named = {a.value for r in rules for atom in r.atoms for a in atom.args if isinstance(a, Const)}
    parts = [tb.constants_of(t) for t in [*(r.df for r in facts.relations.values()), *counter.values()]]
    parts.append(spark.createDataFrame([(c,) for c in sorted(named)], "value int"))
    if extra is not None:
        parts.append(extra.select("value"))
    return reduce(DataFrame.unionByName, parts).distinct()


def apply_rule(rule: Rule, facts: Kb, counter: dict[str, DataFrame], constants: DataFrame) -> DataFrame:
    """Tuples that a rule derives and that are neither known nor counterexamples."""
    pred = rule.head.pred
    new = tb.absent(cp.derived(rule, facts, constants), facts[pred].df)
    return tb.absent(new, counter[pred]) if pred in counter else new


def recover(facts: Kb, counter: dict[str, DataFrame], rules: list[Rule], extra: DataFrame | None = None) -> Kb:
    """The least base that holds the facts and that the rules add nothing to but counterexamples.

    The first round applies whole rules; later ones only join what the round before added: a rule
    is applied once for each of its atoms whose relation has grown, with the new tuples in its place.
    """
    constants = checkpointed(all_constants(facts, counter, rules, extra))
    folders: dict[str, str] = {}
    first, changed = facts, None
    number = 0
    while True:
        found: dict[str, list[DataFrame]] = {}
        for rule in rules:
            for variant, known in _variants(rule, facts, changed):
                found.setdefault(rule.head.pred, []).append(apply_rule(variant, known, counter, constants))
        changed = {}
        for pred, parts in found.items():
            folder = folders.setdefault(pred, new_folder(facts.spark))
            new = written(tb.union_of(*parts), f"{folder}/round-{number}")
            if not new.isEmpty():
                changed[pred] = new
        for pred in changed:
            grown = facts.spark.read.schema(first[pred].df.schema).option("recursiveFileLookup", "true").parquet(folders[pred])
            facts = facts.with_relation(Relation(pred, facts[pred].arity, first[pred].df.unionByName(grown)))
        number += 1
        if not changed:
            return facts


def _variants(rule: Rule, facts: Kb, changed: dict[str, DataFrame] | None) -> list[tuple[Rule, Kb]]:
    """The rule itself in the first round; later, of each atom that has new tuples, the rule over these."""
    if changed is None:
        return [(rule, facts)]
    out = []
    for k, atom in enumerate(rule.body, 1):
        if atom.pred in changed:
            name = f"{atom.pred} (new)"
            known = facts.with_relation(Relation(name, len(atom.args), changed[atom.pred]))
            out.append((Rule((*rule.atoms[:k], Atom(name, atom.args), *rule.atoms[k + 1 :])), known))
    return out


def needed(pred: str, rules: list[Rule]) -> list[Rule]:
    """Rules that tuples of a relation may depend on."""
    want, size = {pred}, 0
    while len(want) > size:
        size = len(want)
        want |= {b.pred for r in rules if r.head.pred in want for b in r.body}
    return [r for r in rules if r.head.pred in want]


def bind_head(rule: Rule, place: int, value: int) -> Rule | None:
    """The rule with its head argument set to a value, or None if it clashes."""
    arg = rule.head.args[place]
    if isinstance(arg, Const):
        return rule if arg.value == value else None
    if arg is None:
        return Rule((rule.head.put(place, Const(value)), *rule.body))
    return Rule(tuple(Atom(a.pred, tuple(Const(value) if x == arg else x for x in a.args)) for a in rule.atoms))


def select(facts: Kb, counter: dict[str, DataFrame], rules: list[Rule], pred: str, place: int, value: int, extra: DataFrame | None = None) -> DataFrame:
    """Tuples of the rebuilt relation with a value at a place.

    The value is pushed into the rules of that relation; their bodies use what other rules rebuild.
    A relation that its own rules build on is rebuilt whole and filtered.
    """
    below = needed(pred, rules)
    recursive = any(b.pred in {r.head.pred for r in needed(pred, rules)} and pred in {x.head.pred for x in needed(b.pred, rules)} for r in below if r.head.pred == pred for b in r.body)
    if recursive:
        return tb.slice_(recover(facts, counter, below, extra)[pred].df, place, value)
    base = recover(facts, counter, [r for r in below if r.head.pred != pred], extra)
    constants = all_constants(facts, counter, rules, extra)
    bound = [b for r in below if r.head.pred == pred and (b := bind_head(r, place, value)) is not None]
    return tb.union_of(tb.slice_(facts[pred].df, place, value), *(apply_rule(r, base, counter, constants) for r in bound))


def product(facts: Kb, counter: dict[str, DataFrame], rules: list[Rule], one: tuple[str, int], other: tuple[str, int], extra: DataFrame | None = None) -> DataFrame:
    """Equi-join of two rebuilt relations."""
    below = [r for r in rules if r in needed(one[0], rules) or r in needed(other[0], rules)]
    whole = recover(facts, counter, below, extra)
    return tb.equi_join(whole[one[0]].df, one[1], whole[other[0]].df, other[1])


def variables(rule: Rule) -> list[Var]:
    return list(rule.places)
