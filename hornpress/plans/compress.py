"""Compressing a base: rules, the tuples they can't derive, and those they derive wrongly."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornpress.functions.scores import Eval
from hornpress.operators import tables as tb
from hornpress.operators.graph import checkpointed, cycle_breakers, written
from hornpress.operators.kb import Kb, Relation
from hornpress.operators.recovery import recover
from hornpress.plans import compile as cp
from hornpress.plans.rules import Const, Pruner, Rule
from hornpress.plans.search import Config, Scored, Scorer, Stats, chosen_targets, find_rule

EDGES = "src_rel string, src_args array<int>, dst_rel string, dst_args array<int>"


def node(rel: Column, args: Column) -> Column:
    """A ground atom as text."""
    return F.concat(rel, F.lit("("), F.concat_ws(",", args.cast("array<string>")), F.lit(")"))


def dependencies(rule: Rule, proofs: DataFrame) -> DataFrame:
    """Edges from each proved tuple to the tuples it was proved from; a rule without a body proves from nothing."""
    head = F.array("head.*")
    if not rule.body:
        return proofs.select(F.lit(rule.head.pred).alias("src_rel"), head.alias("src_args"), F.lit("").alias("dst_rel"), F.array().cast("array<int>").alias("dst_args"))
    atoms = [F.struct(F.lit(b.pred).alias("rel"), F.array(*[F.col(f"body.b{k}.a{i}") for i in range(len(b.args))]).alias("args")) for k, b in enumerate(rule.body, 1)]
    edges = proofs.select(head.alias("src_args"), F.explode(F.array(*atoms)).alias("to"))
    return edges.select(F.lit(rule.head.pred).alias("src_rel"), "src_args", F.col("to.rel").alias("dst_rel"), F.col("to.args").alias("dst_args")).distinct()


@dataclass
class Compressed:
    """A base's rules and what is kept beside them. What is kept is worked out when it is first asked for."""

    kb: Kb
    rules: list[Scored]
    counter: dict[str, DataFrame]
    #: Dependency edges of each rule's proofs.
    proofs: list[DataFrame]
    stats: Stats = field(default_factory=Stats)

    @cached_property
    def edges(self) -> DataFrame:
        return checkpointed(reduce(DataFrame.unionByName, self.proofs, self.kb.spark.createDataFrame([], EDGES)).distinct())

    @cached_property
    def feedback(self) -> DataFrame:
        """Nodes on cycles of proofs, and which of them break the cycles."""
        with self.stats.timed("dependency"):
            graph = self.edges.filter("dst_rel <> ''").select(node(F.col("src_rel"), F.col("src_args")).alias("src"), node(F.col("dst_rel"), F.col("dst_args")).alias("dst"))
            return checkpointed(cycle_breakers(graph))

    @cached_property
    def necessary(self) -> dict[str, DataFrame]:
        feedback, kept = self.feedback, {}
        with self.stats.timed("dependency"):
            broken = self.edges.select("src_rel", "src_args").distinct().join(feedback.filter("feedback"), node(F.col("src_rel"), F.col("src_args")) == F.col("node"), "left_semi")
            for name, r in self.kb.relations.items():
                back = broken.filter(F.col("src_rel") == name).select(*[F.col("src_args")[i].alias(c) for i, c in enumerate(r.cols)])
                kept[name] = checkpointed(r.split()[1].unionByName(back))
        return kept

    @cached_property
    def supplementary(self) -> DataFrame:
        return checkpointed(supplementary_constants(self.kb, self.necessary, self.counter, [s.rule for s in self.rules]))

    def facts(self) -> Kb:
        return Kb(self.kb.name, {k: Relation(k, self.kb[k].arity, df) for k, df in self.necessary.items()}, self.kb.n)

    def recovered(self) -> Kb:
        return recover(self.facts(), self.counter, [s.rule for s in self.rules], self.supplementary)

    def is_lossless(self) -> bool:
        with self.stats.timed("validate"):
            back = self.recovered()
            return all(tb.same_rows(back[k].df, r.df) for k, r in self.kb.relations.items())

    def counters(self) -> DataFrame:
        """(name, value): how a run went: milliseconds by phase, levels, jobs, evaluations in all and for each rule."""
        s = self.stats
        rows = [(f"{k} ms", float(v)) for k, v in s.ms.items()] + [(k, float(getattr(s, k))) for k in ("levels", "jobs", "evaluated", "pruned")]
        rows.append(("evaluated a rule", s.evaluated / len(self.rules) if self.rules else 0.0))
        return self.kb.spark.createDataFrame(rows, "name string, value double")

    def report(self) -> DataFrame:
        """One row of figures; ratio: necessary tuples, counterexamples and rule lengths to tuples."""
        spark = self.kb.spark

        def total(tables: list[DataFrame]) -> DataFrame:
            return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")) for t in tables)).agg(F.sum("n").alias("n")) if tables else spark.createDataFrame([(0,)], "n long")

        parts = {
            "records": total([r.df for r in self.kb.relations.values()]),
            "necessary": total(list(self.necessary.values())),
            "counterexamples": total(list(self.counter.values())),
            "sccs": self.feedback.select("scc").distinct().agg(F.count("*").alias("n")),
            "scc_nodes": total([self.feedback]),
            "feedback": total([self.feedback.filter("feedback")]),
            "supplementary": total([self.supplementary]),
        }
        row = reduce(DataFrame.crossJoin, (t.select(F.col("n").alias(k)) for k, t in parts.items()))
        length = sum(s.rule.length for s in self.rules)
        return row.select("*", F.lit(len(self.rules)).alias("rules"), F.lit(length).alias("rule_length"), ((F.col("necessary") + F.col("counterexamples") + length) / F.col("records")).alias("ratio"))


def supplementary_constants(kb: Kb, necessary: dict[str, DataFrame], counter: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(value): constants 1 to n that no kept tuple, counterexample or rule has."""
    named = {a.value for r in rules for atom in r.atoms for a in atom.args if isinstance(a, Const)}
    kept = [tb.constants_of(t) for t in [*necessary.values(), *counter.values()]]
    used = reduce(DataFrame.unionByName, kept, kb.spark.createDataFrame([(c,) for c in sorted(named)], "value int")).distinct()
    return kb.spark.range(1, kb.n + 1).select(F.col("id").cast("int").alias("value")).join(used, "value", "left_anti")


def accept(kb: Kb, rule: Rule) -> tuple[Kb, DataFrame, DataFrame]:
    """The base with the rule's tuples entailed, the rule's counterexamples and its dependency edges."""
    proofs = checkpointed(cp.evidence(rule, kb))
    counter = checkpointed(cp.counterexamples(rule, kb))
    relation = kb[rule.head.pred].entail(proofs.select("head.*"))
    return kb.with_relation(Relation(relation.name, relation.arity, relation.df, written(relation.entailed))), counter, dependencies(rule, proofs)


def finish(kb: Kb, rules: list[Scored], counter: dict[str, DataFrame], edges: list[DataFrame], stats: Stats | None = None) -> Compressed:
    return Compressed(kb, rules, counter, edges, stats or Stats())


def compress_with(kb: Kb, rules: list[Rule]) -> Compressed:
    """By given rules, in order."""
    kb.persisted()
    counter: dict[str, DataFrame] = {}
    edges, scored = [], []
    for rule in rules:
        scored.append(Scored(rule, cp.evaluate(rule, kb)))
        kb, wrong, found = accept(kb, rule)
        counter[rule.head.pred] = tb.union_of(counter[rule.head.pred], wrong) if rule.head.pred in counter else wrong
        edges.append(found)
    return finish(kb, scored, counter, edges)


def compress(kb: Kb, config: Config = Config(), targets: list[str] | None = None, scorer: Scorer | None = None, find=find_rule) -> Compressed:  # noqa: ANN001, B008
    """By rules that are searched for, relation by relation. scorer and find: other ways to score and to search;
    what is kept is worked out exactly in any case. A search that config.go_on() ends keeps the rules found so far."""
    kb.persisted()
    scorer = scorer or Scorer(kb, config)
    counter: dict[str, DataFrame] = {}
    edges, rules = [], []
    for pred in chosen_targets(kb) if targets is None else targets:
        pruner, left = Pruner(), kb.sizes[pred]
        while left and config.go_on():
            with scorer.stats.timed("mine"):
                found = find(scorer, pred, pruner)
            if found is None:
                break
            rules.append(Scored(found.rule, cp.evaluate(found.rule, scorer.kb)))
            if not rules[-1].eval.pos:  # an estimate or a sample can mislead
                rules.pop()
                break
            with scorer.stats.timed("update"):
                scorer.kb, wrong, new = accept(scorer.kb, found.rule)
            # the table of column values and the sizes don't depend on entailment
            scorer.kb.__dict__.update({k: kb.__dict__[k] for k in ("colvals", "sizes") if k in kb.__dict__})
            counter[pred] = tb.union_of(counter[pred], wrong) if pred in counter else wrong
            edges.append(new)
            left -= int(rules[-1].eval.pos)
    return finish(scorer.kb, rules, counter, edges, scorer.stats)


def evals(rules: list[Scored]) -> list[tuple[str, Eval]]:
    return [(str(s.rule), s.eval) for s in rules]
