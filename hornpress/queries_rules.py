"""Registered queries of rule trees, scores, edits and searches.

Rules are few and small; queries about them return rows that follow from the rules alone. Searches
return figures of what they find, since equal rules can be written in several ways.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress import queries as q
from hornpress.functions.scores import CAPACITY, Eval, metric
from hornpress.operators import negatives as ng
from hornpress.operators import tables as tb
from hornpress.operators import templates as tp
from hornpress.operators.kb import Kb
from hornpress.plans import compile as cp
from hornpress.plans import estimate as es
from hornpress.plans import rules as rl
from hornpress.plans.compress import Compressed, compress, compress_with
from hornpress.plans.rules import Pruner, parse_rule
from hornpress.plans.search import Config, SampledScorer, Scorer, alike_columns, chosen_targets, symmetric_only


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, str) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


def on_rules(name: str, expected: list[tuple], schema: str, build) -> None:  # noqa: ANN001
    """A query about rules alone: build() gives the rows, `expected` says what they are."""
    q.QUERIES[name] = lambda spark, sf_dir: _values(spark, build(), schema)
    q.ORACLES[name] = _sql_values(expected, ", ".join(c.split()[0] for c in schema.split(", ")))


# --- rule trees --------------------------------------------------------------------------------

_WAY = "h(X,Y,4):-p(X,Z),q(Z,Y)"
_GENERAL = "family(Y,X,Z):-father(X,Z),mother(Y,?),isMale(Z)"
on_rules("generalizations", [("family(?,X0,X1):-father(X0,X1),isMale(X1)", 3), ("family(X0,?,X1):-father(?,X1),mother(X0,?),isMale(X1)", 3), ("family(X0,X1,?):-father(X1,X2),mother(X0,?),isMale(X2)", 3), ("family(X0,X1,X2):-father(X1,X2),mother(X0,?)", 3), ("family(X0,X1,X2):-father(X1,?),mother(X0,?),isMale(X2)", 3)], "rule string, length int", lambda: sorted({(str(parse_rule(str(g))), g.length) for g in rl.generalizations(parse_rule(_GENERAL))}))
on_rules("rule_script", [(k, k, k == 4) for k in range(5)], "step int, length int, last boolean", lambda: [(k, r.length, r == parse_rule(_WAY)) for k, r in enumerate(rl.steps_to(parse_rule(_WAY)))])

_PAIRS_OF_RULES = [
    ("h(X,Y):-p(X,Z),q(Z,Y)", "h(U,V):-q(W,V),p(U,W)", True, True, True),
    ("h(X,Y):-p(X,Z),q(Z,Y)", "h(X,Y):-p(X,Z),q(Y,Z)", False, False, False),
    ("h(X,?):-p(X,?)", "h(X,Y):-p(X,Z),q(Z,Y)", False, False, True),
    ("h(X,Y):-p(X,Y)", "h(X,Y):-p(X,Z),q(Z,Y)", False, False, False),
    ("h(?,?):-", "h(X,3):-p(X,?)", False, False, True),
]
on_rules("rule_identity", _PAIRS_OF_RULES, "one string, other string, same_print boolean, same_rule boolean, more_special boolean", lambda: [(a, b, x.fingerprint == y.fingerprint, rl.same_rule(x, y), rl.is_specialization(y, x)) for a, b, *_ in _PAIRS_OF_RULES for x, y in [(parse_rule(a), parse_rule(b))]])
_VALID = [("father(X,?):-father(X,?)", True), ("father(X,Y):-father(Y,X)", False), ("father(X,?):-father(Y,X),father(Y,X)", True), ("h(?,?):-p(X,X)", True), ("h(X,?):-p(X,?),q(Y,Y)", True), ("h(X):-p(X,?),q(3)", True), ("h(3,?):-", False)]
on_rules("rule_validity", _VALID, "rule string, invalid boolean", lambda: [(r, parse_rule(r).invalid) for r, _ in _VALID])
_TABU = [("h(X,Y):-p(X,Y)", True), ("h(X,?):-p(X,Z),q(Z,?)", True), ("h(X,Y):-q(X,Y)", False), ("h(?,X):-p(X,?)", False)]


def _tabu() -> list[tuple]:
    p = Pruner()
    p.add_tabu(parse_rule("h(X,?):-p(X,?)"))
    return [(r, p.is_tabu(parse_rule(r))) for r, _ in _TABU]


on_rules("rule_tabu", _TABU, "rule string, tabu boolean", _tabu)
_LINKED = parse_rule("h(X,Y):-p(X,Z),q(Z,W),r(W,Y),s(Z,Y),p(X,Z)")
_LINKS = [("X0", "X1", 2, 0), ("X0", "X2", 1, 2), ("X0", "X3", 2, 0), ("X1", "X2", 1, 1), ("X1", "X3", 1, 1), ("X2", "X3", 1, 1)]


def _links() -> list[tuple]:
    every, n = sorted(_LINKED.places), es.shared_links(_LINKED)
    return [(f"X{v.n}", f"X{w.n}", len(es.shortest_link(_LINKED, v, w) or []) - 1, n.get((v, w), 0)) for k, v in enumerate(every) for w in every[k + 1 :]]


on_rules("variable_links", _LINKS, "one string, other string, steps int, links int", _links)
on_rules("metrics", [("τ", "tau"), ("δ", "delta"), ("h", "h"), ("other", "tau")], "symbol string, metric string", lambda: [(s, metric(s)) for s in ("τ", "δ", "h", "other")])


@q.query("specializations", q.with_base(q.MINED) + ", " + q.colvals_sql(q.MINED) + """, s AS (SELECT rel, col, sum(cnt) AS rows FROM colvals GROUP BY rel, col),
often AS (SELECT rel, col, val FROM colvals JOIN s USING (rel, col) WHERE cnt >= ceil(rows * 0.25)), places AS (SELECT * FROM (VALUES ('nation_region'), ('region_nation'), ('supp_nation'), ('supp_region')) r(rel), (VALUES ('X?'), ('?X')) c(spot)),
rules AS (
  SELECT 'supp_region(X0,X0):-supp_nation(X0,?)' AS rule UNION ALL SELECT 'supp_region(X0,?):-supp_nation(X0,X0)' UNION ALL SELECT 'supp_region(X0,X1):-supp_nation(X0,X1)'
  UNION ALL SELECT 'supp_region(X0,?):-supp_nation(X0,?),' || rel || CASE spot WHEN 'X?' THEN '(X0,?)' ELSE '(?,X0)' END FROM places WHERE rel <> 'supp_region' OR spot = '?X'
  UNION ALL SELECT 'supp_region(X0,X1):-supp_nation(X0,?),' || rel || CASE spot WHEN 'X?' THEN '(X1,?)' ELSE '(?,X1)' END FROM places WHERE rel <> 'supp_region' OR spot = 'X?'
  UNION ALL SELECT 'supp_region(X0,?):-supp_nation(X0,X1),' || rel || CASE spot WHEN 'X?' THEN '(X1,?)' ELSE '(?,X1)' END FROM places
  UNION ALL SELECT 'supp_region(X0,' || val || '):-supp_nation(X0,?)' FROM often WHERE rel = 'supp_region' AND col = 1
  UNION ALL SELECT 'supp_region(X0,?):-supp_nation(X0,' || val || ')' FROM often WHERE rel = 'supp_nation' AND col = 1)
SELECT rule, 2 AS length FROM rules""")
def specializations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules one step from a rule that a search would look at."""
    kb, rule, p = q.base(spark, sf_dir, q.MINED), parse_rule("supp_region(X,?):-supp_nation(X,?)"), Pruner()
    p.fresh(rule)
    return _values(spark, [(str(r), r.length) for r, _ in rl.moves(rule, kb.schema, kb.promising_constants(0.25)) if p.fresh(r)], "rule string, length int")


# --- scores ------------------------------------------------------------------------------------


def _scores(kb: Kb) -> DataFrame:
    """All scores of a rule and of a longer one, each from its exact evaluation."""
    short, rule = parse_rule("noisy(X,?):-cust_region(X,?)"), parse_rule("noisy(X,Y):-cust_region(X,Y)")
    first = cp.evaluate(short, kb)
    then = cp.evaluate(rule, kb, first)
    rows = [(str(r), float(e.tau), float(e.delta), round(e.h_simple, 6), round(e.h_of(p), 6), round(e.h_total(p, 1.5), 6), e.useful) for r, e, p in ((short, first, then), (rule, then, first))]
    return _values(kb.spark, rows, "rule string, tau double, delta double, h_simple double, h_of double, h_total double, useful boolean")


_SC = ", f AS (SELECT count(*)::DOUBLE AS pos, (SELECT count(DISTINCT a0) FROM cust_region) * (SELECT count(*) FROM num)::DOUBLE AS every, 1 AS n FROM noisy WHERE a0 IN (SELECT a0 FROM cust_region)), g AS (SELECT count(*)::DOUBLE AS pos, (SELECT count(*) FROM cust_region)::DOUBLE AS every, 2 AS n FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region)), e AS (SELECT 'noisy(X0,?):-cust_region(X0,?)' AS rule, f.*, g.pos AS ppos, g.every AS pevery FROM f, g UNION ALL SELECT 'noisy(X0,X1):-cust_region(X0,X1)', g.*, f.pos, f.every FROM f, g), s AS (SELECT *, pos / (every + n) AS tau, pos * (ln(pos / every) - ln(ppos / pevery)) AS gain FROM e) SELECT rule, tau, 2 * pos - every - n AS delta, round(pos * ln(1 + tau), 6) AS h_simple, round(gain, 6) AS h_of, round(1.5 + gain, 6) AS h_total, 2 * pos - every - n > 0 AS useful FROM s"
q.on_base("scores", _SC, _scores, ["cust_region", "noisy"])
q.on_base("rule_coverage", "SELECT (SELECT count(*) FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region)) / (SELECT count(*) FROM noisy) AS coverage", lambda kb: _values(kb.spark, [(cp.coverage(parse_rule("noisy(X,Y):-cust_region(X,Y)"), kb),)], "coverage double"), ["cust_region", "noisy"])
q.on_base("self_join", "SELECT x.a0, x.a1, y.a0 AS a2 FROM supp_nation x JOIN supp_nation y ON x.a1 = y.a1 WHERE x.a0 < y.a0", lambda kb: tb.equi_join(kb["supp_nation"].df, 1, kb["supp_nation"].df, 1).filter("l_a0 < r_a0").select(F.col("l_a0").alias("a0"), F.col("l_a1").alias("a1"), F.col("r_a0").alias("a2")), ["supp_nation", "nation_region"])
q.on_base("slices", "SELECT (dense_rank() OVER (ORDER BY a1) - 1)::INT AS part, a1 AS value, a0, a1 FROM cust_nation", lambda kb: tb.slices(kb["cust_nation"].df, 1))

# --- edits -------------------------------------------------------------------------------------


def _edited(kb: Kb) -> DataFrame:
    """What edits and lookups say: relations made, loaded and found, and the errors of clashes."""

    def clash(act) -> bool:  # noqa: ANN001
        try:
            act()
        except ValueError:
            return True
        return False

    made = kb.create("empty", 3).load("copy", kb["supp_nation"].df)
    first = kb["supp_nation"].df.orderBy("a0", "a1").first()
    facts = [("arity_of_created", made["empty"].arity), ("rows_of_loaded", made["copy"].df.count()), ("known", int(made.get("copy") is not None)), ("unknown", int(made.get("none") is None)), ("has", int(kb.has("supp_nation", *first))), ("has_not", int(kb.has("supp_nation", first[1], first[0]))), ("other_arity", int(kb.has("supp_nation", first[0]))), ("created_again", int(clash(lambda: made.create("copy", 3)))), ("loaded_again", int(clash(lambda: made.load("copy", kb["supp_nation"].df))))]
    return _values(kb.spark, facts, "what string, value int")


q.on_base("edits", "SELECT 'rows_of_loaded' AS what, count(*)::INT AS value FROM supp_nation UNION ALL VALUES ('arity_of_created', 3), ('known', 1), ('unknown', 1), ('has', 1), ('has_not', 0), ('other_arity', 0), ('created_again', 1), ('loaded_again', 1)", _edited, q._SUP)
q.on_base("unentailed", "SELECT a0, a1 FROM cust_region WHERE (a0, a1) IN (SELECT (a0, a1) FROM noisy) AND a0 % 3 <> 0", lambda kb: (lambda r: r.unentail(r.df.filter("a0 % 3 = 0")).split()[0])(kb["cust_region"].entail(kb["noisy"].df)), ["cust_region", "noisy"])
q.on_base("relation_ids", "SELECT 'supp_region' AS rel, 0 AS id UNION ALL VALUES ('fresh', 1), ('cust_region', 2)", lambda kb: _values(kb.spark, [(r, i) for r, i in kb.without_slot("nation_region").create("fresh", 2).ids().items()], "rel string, id int"), ["supp_region", "nation_region", "cust_region"])

# --- templates ---------------------------------------------------------------------------------

q.on_base("template_dual_transition", q._template_sql([("supp_region(X,Y):-region_nation(Y,Z),nation_supp(Z,X)", "SELECT DISTINCT y.a1, x.a0 FROM region_nation x JOIN nation_supp y ON x.a1 = y.a0", 3), ("region_nation(X,Y):-nation_supp(Y,Z),supp_region(Z,X)", "SELECT DISTINCT y.a1, x.a0 FROM nation_supp x JOIN supp_region y ON x.a1 = y.a0", 3)]).replace(", rows AS", ", nation_supp AS (SELECT a1 AS a0, a0 AS a1 FROM supp_nation), rows AS", 1), lambda kb: tp.match(kb.load("nation_supp", tb.swapped(kb["supp_nation"].df)).delete("supp_nation"), "DualTransition"), ["region_nation", "supp_nation", "supp_region"])
q.on_base("template_run", ", n AS (SELECT (SELECT count(*) FROM nation_region) AS a, (SELECT count(*) FROM region_nation) AS b, (SELECT count(*) FROM supp_nation) AS c, (SELECT count(*) FROM supp_region) AS d), r AS (SELECT 'Dual' AS template, 2::BIGINT AS rules, a + b AS covered, a + b + c + d AS records FROM n UNION ALL SELECT 'Transition', (d / (d + 3) >= 0.8)::BIGINT, CASE WHEN d / (d + 3) >= 0.8 THEN d ELSE 0 END, a + b + c + d FROM n) SELECT *, covered / records AS share FROM r", lambda kb: tp.hinted(kb, ["Dual", "Transition"])[1], q.MINED)
q.on_base("template_entailed", "SELECT a0, a1 FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region) OR (a0 IN (SELECT a0 FROM far_cust) AND a1 IN (SELECT a1 FROM nation_region))", lambda kb: tp.entailed_by(kb, [parse_rule("noisy(X,Y):-cust_region(X,Y)"), parse_rule("noisy(X,Y):-far_cust(X),nation_region(?,Y)")]), ["nation_region", "cust_region", "far_cust", "noisy"])

# --- searches ----------------------------------------------------------------------------------

FOUND = "head string, pos double, neg double, length int"


def _found(kb: Kb, c: Compressed) -> DataFrame:
    return _values(kb.spark, [(s.rule.head.pred, float(s.eval.pos), float(s.eval.neg), s.rule.length) for s in c.rules], FOUND)


def _config(**more) -> Config:  # noqa: ANN003
    return Config(beam=3, metric=CAPACITY, **more)


def _mined(kb: Kb) -> DataFrame:
    return _found(kb, compress(kb, _config()))


_MINED = "SELECT 'nation_region' AS head, (SELECT count(*) FROM nation_region WHERE (a1, a0) IN (SELECT (a0, a1) FROM region_nation))::DOUBLE AS pos, (SELECT count(*) FROM region_nation WHERE (a1, a0) NOT IN (SELECT (a0, a1) FROM nation_region))::DOUBLE AS neg, 2 AS length UNION ALL SELECT 'region_nation', (SELECT count(*) FROM region_nation WHERE (a1, a0) IN (SELECT (a0, a1) FROM nation_region))::DOUBLE, (SELECT count(*) FROM nation_region WHERE (a1, a0) NOT IN (SELECT (a0, a1) FROM region_nation))::DOUBLE, 2"
_PATH = "SELECT DISTINCT x.a0, y.a1 FROM supp_nation x JOIN nation_region y ON x.a1 = y.a0"
q.on_base("mine", _MINED + f" UNION ALL SELECT 'supp_region', (SELECT count(*) FROM supp_region WHERE (a0, a1) IN (SELECT (a0, a1) FROM ({_PATH})))::DOUBLE, (SELECT count(*) FROM ({_PATH}) WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM supp_region))::DOUBLE, 3", _mined, q.MINED)
ORDERED = ["order_cust", "order_nation", "cust_nation"]
_BY_ORDER = "SELECT DISTINCT x.a1 AS a0, y.a1 FROM order_cust x JOIN order_nation y ON x.a0 = y.a0"
q.on_base("mine_orders", f"SELECT 'order_nation' AS head, (SELECT count(*) FROM order_nation WHERE (a0, a1) IN (SELECT (a0, a1) FROM ({q._OJOIN})))::DOUBLE AS pos, (SELECT count(*) FROM ({q._OJOIN}) WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM order_nation))::DOUBLE AS neg, 3 AS length UNION ALL SELECT 'cust_nation', (SELECT count(*) FROM cust_nation WHERE (a0, a1) IN (SELECT (a0, a1) FROM ({_BY_ORDER})))::DOUBLE, (SELECT count(*) FROM ({_BY_ORDER}) WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM cust_nation))::DOUBLE, 3", _mined, ORDERED)
# every order's nation follows from its customer's, and every customer's from an order's: of each pair of proofs one tuple stays
q.on_base("compression_report", "SELECT 2 * nr + sn AS records, nr + sn AS necessary, 0::BIGINT AS counterexamples, nr AS sccs, 2 * nr AS scc_nodes, nr AS feedback, 0::BIGINT AS supplementary, 2 AS rules, 4 AS rule_length, (nr + sn + 4) / (2 * nr + sn) AS ratio FROM (SELECT (SELECT count(*) FROM nation_region) AS nr, (SELECT count(*) FROM supp_nation) AS sn)", lambda kb: compress(kb, _config()).report(), ["nation_region", "region_nation", "supp_nation"])
q.on_base("recover_mined", " UNION ALL ".join(f"SELECT '{r}' AS rel, a0, a1 FROM {r}" for r in q.MINED), lambda kb: (lambda back: reduce(DataFrame.unionByName, (back[r].df.select(F.lit(r).alias("rel"), "a0", "a1") for r in q.MINED)))(compress(kb, _config()).recovered()), q.MINED)
q.on_base("lossless", "SELECT TRUE AS lossless", lambda kb: _values(kb.spark, [(compress_with(kb, q.GIVEN).is_lossless(),)], "lossless boolean"), q._GIVEN)


def _one(kb: Kb, pick, observe: float) -> DataFrame:  # noqa: ANN001
    """What a search that evaluates only chosen candidates finds for a relation."""
    found = es.find_rule_by(Scorer(kb.persisted(), _config(observe=observe)), "region_nation", Pruner(), pick)
    return _values(kb.spark, [(found.rule.head.pred, float(found.eval.pos), float(found.eval.neg), found.rule.length)] if found else [], FOUND)


_TURNED = "SELECT 'region_nation' AS head, (SELECT count(*) FROM region_nation WHERE (a1, a0) IN (SELECT (a0, a1) FROM nation_region))::DOUBLE AS pos, (SELECT count(*) FROM nation_region WHERE (a1, a0) NOT IN (SELECT (a0, a1) FROM region_nation))::DOUBLE AS neg, 2 AS length"
_ALL3 = ["nation_region", "region_nation", "supp_nation"]
q.on_base("mine_by_estimates", _TURNED, lambda kb: _one(kb, es.by_estimate, 2.0), _ALL3)
# with room for every candidate, a draw takes them all
q.on_base("mine_at_random", _TURNED, lambda kb: _one(kb, es.at_random(1), 100.0), _ALL3)


def _gated(kb: Kb) -> DataFrame:
    """Searches that only join similar columns, and that only look at turned relations."""
    out = []
    for name, gate in (("alike", alike_columns(tp.similar_pairs(kb, 0.5))), ("symmetric", symmetric_only)):
        c = compress(kb, _config(), ["region_nation"], Scorer(kb.persisted(), _config(), gate=gate))
        out.append(_found(kb, c).withColumn("gate", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


q.on_base("mine_gated", f"SELECT t.*, gate FROM ({_TURNED}) t, (VALUES ('alike'), ('symmetric')) v(gate)", _gated, _ALL3)


def _by_samples(kb: Kb) -> DataFrame:
    """A search that scores by the first and last tuples of gaps between positive ones, each weighing its gap's share."""
    samples = {k: ng.weights(r.df, ng.intervals(r.df, kb.n), kb.n) for k, r in kb.relations.items()}
    return _found(kb, compress(kb, _config(), ["region_nation"], SampledScorer(kb.persisted(), _config(), samples=samples)))


q.on_base("mine_with_negatives", _TURNED, _by_samples, _ALL3)
on_rules("search_targets", [("all", "a,b,c"), ("first two", "a,b"), ("blocked", "a,c")], "what string, targets string", lambda: [(w, ",".join(t)) for w, t in (("all", _targets()), ("first two", _targets(2)), ("blocked", _targets(None, ("b",))))])


def _targets(most: int | None = None, blocked: tuple[str, ...] = ()) -> list[str]:
    return chosen_targets(Kb("k", dict.fromkeys("abc"), 0), most, blocked)


# --- ranking -----------------------------------------------------------------------------------


@q.query("inversions", "WITH r AS (SELECT c_acctbal AS estimate, c_nationkey::DOUBLE AS exact FROM customer), p AS (SELECT x.exact < y.exact AS wrong FROM r x JOIN r y ON x.estimate > y.estimate) SELECT count(*) FILTER (wrong) AS inversions, count(*) AS pairs, count(*) FILTER (wrong) / count(*) AS share FROM p")
def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking of all customers, counted without listing pairs."""
    ranking = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return es.inversions(ranking.select(F.col("c_acctbal").alias("estimate"), F.col("c_nationkey").cast("double").alias("exact")))


# --- partition of relations --------------------------------------------------------------------

_PARTS = f""", {q.colvals_sql(q.TEMPLATE_BASE)}{q._PAIRS}, low AS (SELECT x.rel AS rel_i, x.col AS col_i, y.rel AS rel_j, y.col AS col_j, sum(least(x.cnt, y.cnt))::BIGINT AS low FROM colvals x JOIN colvals y ON x.val = y.val AND x.rel < y.rel GROUP BY ALL),
jac AS (SELECT rel_i AS a, rel_j AS b, max(low / (s.n + t.n - low)) AS j FROM low JOIN size s ON (s.rel, s.col) = (rel_i, col_i) JOIN size t ON (t.rel, t.col) = (rel_j, col_j) GROUP BY rel_i, rel_j),
k AS (SELECT range AS k, range / 100.0::DOUBLE AS t FROM range(101)),
near AS (SELECT k, a, b FROM jac, k WHERE j >= t UNION SELECT k, b, a FROM jac, k WHERE j >= t UNION SELECT DISTINCT k, rel, rel FROM colvals, k),
reach AS (SELECT k, a, b FROM near UNION SELECT r.k, r.a, n.b FROM reach r JOIN near n ON r.k = n.k AND r.b = n.a),
label AS (SELECT k, a, min(b) AS part FROM reach GROUP BY k, a), n AS (SELECT k, count(DISTINCT part) AS n FROM label GROUP BY k),
growth AS (SELECT x.k, y.n - x.n AS g FROM n x JOIN n y ON y.k = x.k + 1),
bend AS (SELECT coalesce(min(x.k), 0) AS k FROM growth x JOIN growth y ON y.k = x.k - 1 WHERE x.g < y.g)
SELECT (dense_rank() OVER (ORDER BY part) - 1)::INT AS part, a AS rel, k / 100.0::DOUBLE AS threshold FROM label WHERE k = (SELECT k FROM bend)"""
q.ORACLES["split_parts"] = q.with_base(q.TEMPLATE_BASE, recursive=True) + _PARTS
