"""The registered queries, each with the same rows as SQL where SQL can express them.

All work on a base of eight relations over the star-schema tables: constants are keys with the
letter of their domain, numbered in order of their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.functions import multisets as ms
from hornpress.operators import negatives as ng
from hornpress.operators import numeration as nm
from hornpress.operators import recovery as rc
from hornpress.operators import sampling as sp
from hornpress.operators import tables as tb
from hornpress.operators import templates as tp
from hornpress.operators.kb import Kb
from hornpress.plans import compile as cp
from hornpress.plans.compress import compress_with, dependencies
from hornpress.plans.rules import parse_rule

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Of each relation its arguments: (table, letter and column of each argument) as SQL text.
SOURCES = {
    "nation_region": "SELECT DISTINCT concat('n', n_nationkey) AS a0, concat('r', n_regionkey) AS a1 FROM nation",
    "region_nation": "SELECT DISTINCT concat('r', n_regionkey) AS a0, concat('n', n_nationkey) AS a1 FROM nation",
    "supp_nation": "SELECT DISTINCT concat('s', s_suppkey) AS a0, concat('n', s_nationkey) AS a1 FROM supplier",
    "supp_region": "SELECT DISTINCT concat('s', s_suppkey) AS a0, concat('r', n_regionkey) AS a1 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "cust_nation": "SELECT DISTINCT concat('c', c_custkey) AS a0, concat('n', c_nationkey) AS a1 FROM customer",
    "cust_region": "SELECT DISTINCT concat('c', c_custkey) AS a0, concat('r', n_regionkey) AS a1 FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "far_cust": "SELECT DISTINCT concat('c', c_custkey) AS a0 FROM customer WHERE c_nationkey % 5 <> 0",
    "noisy": "SELECT DISTINCT concat('c', c_custkey) AS a0, concat('r', CASE WHEN c_custkey % 23 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END) AS a1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 17 <> 0",
}
ORDERS = {
    "order_cust": "SELECT DISTINCT concat('o', o_orderkey) AS a0, concat('c', o_custkey) AS a1 FROM orders",
    "order_nation": "SELECT DISTINCT concat('o', o_orderkey) AS a0, concat('n', c_nationkey) AS a1 FROM orders JOIN customer ON o_custkey = c_custkey",
    "order_status": "SELECT DISTINCT concat('o', o_orderkey) AS a0, concat('t', o_orderstatus) AS a1 FROM orders",
}
#: Unary relations over customers only.
CUSTOMERS = {
    "cust": "SELECT DISTINCT concat('c', c_custkey) AS a0 FROM customer",
    "seventh": "SELECT DISTINCT concat('c', c_custkey) AS a0 FROM customer WHERE c_custkey % 7 = 0",
}
MINED = ["nation_region", "region_nation", "supp_nation", "supp_region"]


def sources(names: list[str]) -> dict[str, str]:
    return {k: (SOURCES | ORDERS | CUSTOMERS)[k] for k in names}


def base(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Kb:
    chosen = sources(names or list(SOURCES))
    # tables are named in the text by their files: a view of the session would outlive the query
    import re

    tables = "nation|supplier|customer|orders"
    rels = {k: spark.sql(re.sub(rf"\b(FROM|JOIN) ({tables})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", q)) for k, q in chosen.items()}
    return Kb.from_names("star", rels)


def with_base(names: list[str] | None = None, recursive: bool = False) -> str:
    """SQL of the base: num (name, num), and each relation as a table of numbers."""
    chosen = sources(names or list(SOURCES))
    raw = [f"raw_{k} AS ({q})" for k, q in chosen.items()]
    cells = " UNION ".join(f"SELECT {c} AS name FROM raw_{k}" for k, q in chosen.items() for c in (["a0", "a1"] if " AS a1 " in q else ["a0"]))
    num = f"num AS (SELECT name, row_number() OVER (ORDER BY name)::INT AS num FROM ({cells}))"
    rels = [
        f"{k} AS (SELECT x.num AS a0, y.num AS a1 FROM raw_{k} r JOIN num x ON x.name = r.a0 JOIN num y ON y.name = r.a1)" if " AS a1 " in q else f"{k} AS (SELECT x.num AS a0 FROM raw_{k} r JOIN num x ON x.name = r.a0)"
        for k, q in chosen.items()
    ]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*raw, num, *rels]) + "\n"


def colvals_sql(names: list[str] | None = None) -> str:
    chosen = sources(names or list(SOURCES))
    return "colvals AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rel, {i} AS col, a{i} AS val, count(*) AS cnt FROM {k} GROUP BY a{i}" for k, q in chosen.items() for i in ([0, 1] if " AS a1 " in q else [0])) + ")"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def on_base(name: str, sql: str | None, build: Callable[[Kb], DataFrame], names: list[str] | None = None, prefix: bool = True) -> None:
    """A query over the base; its SQL follows the base's."""
    QUERIES[name] = lambda spark, sf_dir: build(base(spark, sf_dir, names))
    if sql is not None:
        ORACLES[name] = (with_base(names) if prefix else "") + sql


# --- names and totals --------------------------------------------------------------------------

on_base("numeration", "SELECT name, num FROM num", lambda kb: kb.numeration)
on_base("kb_totals", "SELECT 8::BIGINT AS relations, (" + " + ".join(f"(SELECT count(*) FROM {k})" for k in SOURCES) + ")::BIGINT AS records, (SELECT count(*) FROM num)::INT AS constants", lambda kb: kb.totals())
on_base("encode", "SELECT a0, a1 FROM cust_region", lambda kb: kb["cust_region"].df)
on_base("decode", "SELECT a0, a1 FROM raw_cust_region", lambda kb: nm.decode(kb["cust_region"].df, kb.numeration))


def _new_names(kb: Kb) -> DataFrame:
    kept = kb.numeration.filter("num % 7 <> 3")
    return nm.add_names(kept, kb.spark.range(40).select(F.format_string("z%03d", "id").alias("name")))


on_base("add_names", ", kept AS (SELECT * FROM num WHERE num % 7 <> 3), fresh AS (SELECT printf('z%03d', range) AS name, row_number() OVER (ORDER BY range) AS k FROM range(40)), free AS (SELECT range::INT AS num, row_number() OVER (ORDER BY range) AS k FROM range(1, (SELECT max(num) FROM kept) + 41) WHERE range NOT IN (SELECT num FROM kept)) SELECT name, num FROM kept UNION ALL SELECT name, num FROM fresh JOIN free USING (k)", _new_names)
on_base("compaction", ", kept AS (SELECT num FROM num WHERE num % 3 <> 1), gaps AS (SELECT range::INT AS new, row_number() OVER (ORDER BY range) AS k FROM range(1, (SELECT count(*) FROM kept) + 1) WHERE range NOT IN (SELECT num FROM kept)), moving AS (SELECT num AS old, row_number() OVER (ORDER BY num DESC) AS k FROM kept WHERE num > (SELECT count(*) FROM kept)) SELECT old, new FROM gaps JOIN moving USING (k)", lambda kb: nm.compaction(kb.numeration.filter("num % 3 <> 1")))
on_base("remove_names", "SELECT name, num FROM num WHERE name NOT LIKE 'c%'", lambda kb: nm.remove_names(kb.numeration, kb.numeration.filter("name like 'c%'")))
on_base("permute_numeration", "SELECT name, ((SELECT count(*) FROM num) + 1 - num)::INT AS num FROM num", lambda kb: nm.permuted(kb.numeration, kb.numeration.select(F.col("num").alias("old"), (F.lit(kb.n + 1) - F.col("num")).cast("int").alias("new"))))
on_base("delete_relation", "SELECT name, num FROM num WHERE num IN (SELECT a0 FROM cust_region UNION SELECT a1 FROM cust_region)", lambda kb: kb.delete("nation_region").numeration, ["nation_region", "cust_region"])
on_base("tidy_up", "SELECT count(*)::BIGINT AS records, count(DISTINCT a0)::BIGINT AS heads, max(a0)::INT <= (SELECT count(*) FROM (SELECT a0 FROM cust_region UNION SELECT a1 FROM cust_region)) AS dense FROM cust_region", lambda kb: (lambda t: t["cust_region"].df.agg(F.count("*").alias("records"), F.countDistinct("a0").alias("heads"), (F.max("a0") <= F.lit(t.n)).alias("dense")))(kb.delete("nation_region").tidied()), ["nation_region", "cust_region"])
on_base("add_records", "SELECT a0, a1 FROM cust_region UNION SELECT a1 AS a0, a0 AS a1 FROM cust_region WHERE a0 % 5 = 0", lambda kb: kb.add("cust_region", tb.swapped(kb["cust_region"].df.filter("a0 % 5 = 0")))["cust_region"].df)
on_base("remove_records", "SELECT a0, a1 FROM cust_region WHERE a0 % 5 <> 0", lambda kb: kb.remove("cust_region", kb["cust_region"].df.filter("a0 % 5 = 0"))["cust_region"].df)

# --- tables ------------------------------------------------------------------------------------

on_base("slice", "SELECT a0, a1 FROM cust_nation WHERE a1 = (SELECT num FROM num WHERE name = 'n7')", lambda kb: kb["cust_nation"].df.join(F.broadcast(kb.numeration.filter("name = 'n7'").select(F.col("num").alias("a1"))), "a1").select("a0", "a1"))
on_base("members", "SELECT a0, a1 FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region)", lambda kb: tb.members(kb["noisy"].df, kb["cust_region"].df))
on_base("absent", "SELECT a0, a1 FROM noisy EXCEPT SELECT a0, a1 FROM cust_region", lambda kb: tb.absent(kb["noisy"].df, kb["cust_region"].df))
on_base("ordinals", "SELECT a0, a1, (row_number() OVER (ORDER BY a0, a1) - 1)::BIGINT AS ordinal FROM cust_nation", lambda kb: tb.ordinals(kb["cust_nation"].df))
on_base("ith_row", "SELECT a0, a1 FROM cust_nation ORDER BY a0, a1 LIMIT 1 OFFSET 10", lambda kb: tb.ith(kb["cust_nation"].df, 10))
on_base("split_slices", "SELECT a1 AS value, count(*) AS rows FROM cust_nation GROUP BY a1", lambda kb: tb.split_by(kb["cust_nation"].df, 1))
on_base("equal_in_row", ", pairs AS (SELECT x.a0, x.a1, y.a1 AS a2 FROM cust_region x JOIN noisy y ON x.a0 = y.a0) SELECT a0, a1, a2 FROM pairs WHERE a1 = a2", lambda kb: tb.equal_in_row(tb.project_join(kb["cust_region"].df, 0, [0, 1], kb["noisy"].df, 0, [1]), 1, 2))
on_base("distinct_values", "SELECT DISTINCT a1 AS value FROM cust_nation", lambda kb: tb.distinct_values(kb["cust_nation"].df, 1))
on_base("column_stats", "SELECT 0 AS col, count(DISTINCT a0) AS ndv, min(a0) AS low, max(a0) AS high, count(*) AS rows FROM supp_nation UNION ALL SELECT 1, count(DISTINCT a1), min(a1), max(a1), count(*) FROM supp_nation", lambda kb: tb.column_stats(kb["supp_nation"].df))
on_base("insert_places", "SELECT a0, a1, (SELECT count(*) FROM cust_region t WHERE (t.a0, t.a1) < (o.a0, o.a1)) AS place FROM noisy o", lambda kb: tb.insert_places(kb["cust_region"].df, kb["noisy"].df))
on_base("table_constants", "SELECT a0 AS value FROM supp_nation UNION SELECT a1 FROM supp_nation", lambda kb: tb.constants_of(kb["supp_nation"].df))
on_base("column_values", f", {colvals_sql()} SELECT * FROM colvals", lambda kb: kb.colvals)
on_base("promising_constants", f", {colvals_sql()}, s AS (SELECT rel, col, sum(cnt) AS rows FROM colvals GROUP BY rel, col) SELECT rel, col, val, cnt FROM colvals JOIN s USING (rel, col) WHERE cnt >= ceil(rows * 0.15)", lambda kb: kb.promising(0.15))
on_base("frequent_values", "SELECT 1 AS col, a1 AS val, count(*) AS cnt FROM cust_region GROUP BY a1 HAVING count(*) >= ceil((SELECT count(*) FROM cust_region) * 0.2)", lambda kb: tb.frequent_values(kb["cust_region"].df, 0.2))
on_base("split_by_entailment", "SELECT 'entailed' AS part, count(*) AS n FROM cust_region WHERE (a0, a1) IN (SELECT (a0, a1) FROM noisy) UNION ALL SELECT 'other', count(*) FROM cust_region WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM noisy)", lambda kb: (lambda s: s[0].agg(F.count("*").alias("n")).select(F.lit("entailed").alias("part"), "n").unionByName(s[1].agg(F.count("*").alias("n")).select(F.lit("other").alias("part"), "n")))(kb["cust_region"].entail(kb["noisy"].df).split()))

# --- joins and sets ----------------------------------------------------------------------------

on_base("equi_join", "SELECT x.a0 AS l_a0, x.a1 AS l_a1, y.a0 AS r_a0, y.a1 AS r_a1 FROM supp_nation x JOIN nation_region y ON x.a1 = y.a0", lambda kb: tb.equi_join(kb["supp_nation"].df, 1, kb["nation_region"].df, 0))
on_base("match_groups", "SELECT a1 AS value, rows1, rows2 FROM (SELECT a1, count(*) AS rows1 FROM cust_nation GROUP BY a1) JOIN (SELECT a1, count(*) AS rows2 FROM supp_nation GROUP BY a1) USING (a1)", lambda kb: tb.match_groups(kb["cust_nation"].df, 1, kb["supp_nation"].df, 1))
on_base("common_values", "SELECT a1 AS value FROM cust_nation INTERSECT SELECT a1 FROM supp_nation INTERSECT SELECT a0 FROM nation_region", lambda kb: tb.common_values((kb["cust_nation"].df, 1), (kb["supp_nation"].df, 1), (kb["nation_region"].df, 0)))
on_base("project_join", "SELECT DISTINCT x.a0, y.a1 FROM cust_nation x JOIN nation_region y ON x.a1 = y.a0", lambda kb: tb.project_join(kb["cust_nation"].df, 1, [0], kb["nation_region"].df, 0, [1]))
on_base("swapped", "SELECT a1 AS a0, a0 AS a1 FROM supp_nation", lambda kb: tb.swapped(kb["supp_nation"].df))
on_base("project_column", "SELECT DISTINCT a1 AS a0 FROM supp_nation", lambda kb: tb.column(kb["supp_nation"].df, 1))
on_base("union", "SELECT a0, a1 FROM cust_region UNION SELECT a0, a1 FROM noisy", lambda kb: tb.union_of(kb["cust_region"].df, kb["noisy"].df))
on_base("intersection", "SELECT a0, a1 FROM cust_region INTERSECT SELECT a0, a1 FROM noisy", lambda kb: tb.intersection(kb["cust_region"].df, kb["noisy"].df))

# --- multisets and similarity ------------------------------------------------------------------

_BAGS = ", b1 AS (SELECT a1 AS value, count(*) AS cnt FROM cust_region GROUP BY a1), b2 AS (SELECT a1 AS value, count(*) AS cnt FROM noisy GROUP BY a1) "
_bag = lambda kb, r: ms.multiset(kb[r].df, "a1")
on_base("multiset_union", _BAGS + "SELECT value, max(cnt) AS cnt FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY value", lambda kb: ms.union(_bag(kb, "cust_region"), _bag(kb, "noisy")))
on_base("multiset_intersection", _BAGS + "SELECT value, least(b1.cnt, b2.cnt) AS cnt FROM b1 JOIN b2 USING (value)", lambda kb: ms.intersection(_bag(kb, "cust_region"), _bag(kb, "noisy")))
on_base("multiset_difference", _BAGS + "SELECT value, b1.cnt - coalesce(b2.cnt, 0) AS cnt FROM b1 LEFT JOIN b2 USING (value) WHERE b1.cnt > coalesce(b2.cnt, 0)", lambda kb: ms.difference(_bag(kb, "cust_region"), _bag(kb, "noisy")))
on_base("multiset_sizes", _BAGS + "SELECT sum(cnt)::BIGINT AS size, count(*) AS different FROM b1", lambda kb: ms.sizes(_bag(kb, "cust_region")))
on_base("above_share", _BAGS + "SELECT value, cnt FROM b1 WHERE cnt > floor((SELECT sum(cnt) FROM b1) * 0.19)", lambda kb: ms.above_share(_bag(kb, "cust_region"), 0.19))
_PAIRS = ", size AS (SELECT rel, col, sum(cnt)::BIGINT AS n FROM colvals GROUP BY rel, col) "
on_base("jaccard_pairs", f", {colvals_sql()}{_PAIRS}, low AS (SELECT x.rel AS rel_i, x.col AS col_i, y.rel AS rel_j, y.col AS col_j, sum(least(x.cnt, y.cnt))::BIGINT AS low FROM colvals x JOIN colvals y ON x.val = y.val AND (x.rel < y.rel OR (x.rel = y.rel AND x.col < y.col)) GROUP BY ALL) SELECT rel_i, col_i, rel_j, col_j, low / (s.n + t.n - low) AS jaccard FROM low JOIN size s ON (s.rel, s.col) = (rel_i, col_i) JOIN size t ON (t.rel, t.col) = (rel_j, col_j)", lambda kb: ms.jaccard_pairs(kb.colvals))
on_base("column_similarity", f", {colvals_sql()}{_PAIRS}, held AS (SELECT x.rel AS rel_i, x.col AS col_i, y.rel AS rel_j, y.col AS col_j, sum(x.cnt)::BIGINT AS held FROM colvals x JOIN colvals y ON x.val = y.val AND (x.rel, x.col) <> (y.rel, y.col) GROUP BY ALL) SELECT rel_i, col_i, rel_j, col_j, held / n AS sim FROM held JOIN size ON (rel, col) = (rel_i, col_i)", lambda kb: ms.column_similarity(kb.colvals))
on_base("similar_columns", f", {colvals_sql()}{_PAIRS}, held AS (SELECT x.rel AS rel_i, x.col AS col_i, y.rel AS rel_j, y.col AS col_j, sum(x.cnt)::BIGINT AS held FROM colvals x JOIN colvals y ON x.val = y.val AND (x.rel, x.col) <> (y.rel, y.col) GROUP BY ALL) SELECT rel_i, col_i, rel_j, col_j, held / n AS sim FROM held JOIN size ON (rel, col) = (rel_i, col_i) WHERE held / n >= 0.9", lambda kb: ms.similar_columns(kb.colvals, 0.9))
QUERIES["median_price"] = lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("median"))
ORACLES["median_price"] = "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY o_orderstatus"

# --- rules -------------------------------------------------------------------------------------

SCORED = "rule string, pos long, all double, length int, tau double, delta double, h double"


def scored(kb: Kb, *rules: str) -> DataFrame:
    """Evaluations of rules, in one plan."""
    from functools import reduce

    rows = []
    for text in rules:
        r = parse_rule(text)
        pos, every, n = F.col("pos"), F.col("all"), r.length
        ratio = F.when(every + n > 0, pos / (every + n)).otherwise(0.0)
        rows.append(cp.evaluation(r, kb).select(F.lit(str(r)).alias("rule"), "pos", "all", F.lit(n).alias("length"), ratio.alias("tau"), (2 * pos - every - n).cast("double").alias("delta"), F.round(pos * (F.log(ratio + 0.01) - F.log(F.lit(0.01))), 6).alias("h")))
    return reduce(DataFrame.unionByName, rows)


def scored_sql(*rules: tuple[str, str, str]) -> str:
    """(rule, SQL of pos, SQL of all) to the same."""
    out = []
    for text, pos, every in rules:
        r = parse_rule(text)
        out.append(f"SELECT '{r}' AS rule, ({pos})::BIGINT AS pos, ({every})::DOUBLE AS \"all\", {r.length} AS length")
    return ", rows AS (" + " UNION ALL ".join(out) + "), t AS (SELECT *, CASE WHEN \"all\" + length > 0 THEN pos / (\"all\" + length) ELSE 0.0::DOUBLE END AS tau FROM rows) SELECT rule, pos, \"all\", length, tau, (2 * pos - \"all\" - length)::DOUBLE AS delta, round(pos * (ln(tau + 0.01) - ln(0.01::DOUBLE)), 6) AS h FROM t"


_N = "(SELECT count(*)::DOUBLE FROM num)"
TRANSIT = "cust_region(X,Y):-cust_nation(X,Z),nation_region(Z,Y)"
_JOIN = "SELECT DISTINCT x.a0, y.a1 FROM cust_nation x JOIN nation_region y ON x.a1 = y.a0"
on_base(
    "eval_rules",
    scored_sql(
        (TRANSIT, f"SELECT count(*) FROM cust_region WHERE (a0, a1) IN (SELECT (a0, a1) FROM ({_JOIN}))", f"SELECT count(*) FROM ({_JOIN})"),
        ("cust_region(?,?):-", "SELECT count(*) FROM cust_region", f"SELECT {_N} * {_N}"),
        ("cust_region(?,Y):-region_nation(Y,?)", "SELECT count(*) FROM cust_region WHERE a1 IN (SELECT a0 FROM region_nation)", f"SELECT {_N} * count(DISTINCT a0) FROM region_nation"),
        ("noisy(X,Y):-cust_region(X,Y)", "SELECT count(*) FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region)", "SELECT count(*) FROM cust_region"),
        ("noisy(X,Y):-far_cust(X),nation_region(?,Y)", "SELECT count(*) FROM noisy WHERE a0 IN (SELECT a0 FROM far_cust) AND a1 IN (SELECT a1 FROM nation_region)", "SELECT (SELECT count(*) FROM far_cust) * (SELECT count(DISTINCT a1) FROM nation_region)"),
        ("cust_nation(X,X):-", "SELECT count(*) FROM cust_nation WHERE a0 = a1", f"SELECT {_N}"),
    ),
    lambda kb: scored(kb, TRANSIT, "cust_region(?,?):-", "cust_region(?,Y):-region_nation(Y,?)", "noisy(X,Y):-cust_region(X,Y)", "noisy(X,Y):-far_cust(X),nation_region(?,Y)", "cust_nation(X,X):-"),
)
ORDER_RULE = "order_nation(X,Y):-order_cust(X,Z),cust_nation(Z,Y)"
_ORDERED = ["order_cust", "order_nation", "cust_nation"]
_OJOIN = "SELECT DISTINCT x.a0, y.a1 FROM order_cust x JOIN cust_nation y ON x.a1 = y.a0"
on_base("eval_orders", scored_sql((ORDER_RULE, f"SELECT count(*) FROM order_nation WHERE (a0, a1) IN (SELECT (a0, a1) FROM ({_OJOIN}))", f"SELECT count(*) FROM ({_OJOIN})")), lambda kb: scored(kb, ORDER_RULE), _ORDERED)


def _after(kb: Kb) -> DataFrame:
    """A rule's score once another rule's tuples are entailed."""
    first = parse_rule("noisy(X,Y):-far_cust(X),cust_region(X,Y)")
    return scored(kb.with_relation(kb["noisy"].entail(cp.newly_entailed(first, kb))), "noisy(X,Y):-cust_region(X,Y)")


_FIRST = "SELECT a0, a1 FROM noisy WHERE a0 IN (SELECT a0 FROM far_cust) AND (a0, a1) IN (SELECT (a0, a1) FROM cust_region)"
on_base("eval_after", scored_sql(("noisy(X,Y):-cust_region(X,Y)", f"SELECT count(*) FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region) AND (a0, a1) NOT IN (SELECT (a0, a1) FROM ({_FIRST}))", f"SELECT (SELECT count(*) FROM cust_region) - (SELECT count(*) FROM ({_FIRST}))")), _after)
on_base("derived", "SELECT DISTINCT x.a0, y.a1 FROM cust_nation x JOIN nation_region y ON x.a1 = y.a0", lambda kb: cp.derived(parse_rule(TRANSIT), kb))
on_base("derived_free", "SELECT n1.num AS a0, v.a0 AS a1 FROM num n1, (SELECT DISTINCT a0 FROM region_nation) v", lambda kb: cp.derived(parse_rule("nation_region(?,X):-region_nation(X,?)"), kb), ["nation_region", "region_nation"])
on_base("counterexamples", "SELECT a0, a1 FROM cust_region EXCEPT SELECT a0, a1 FROM noisy", lambda kb: cp.counterexamples(parse_rule("noisy(X,Y):-cust_region(X,Y)"), kb))
on_base("newly_entailed", "SELECT a0, a1 FROM noisy WHERE (a0, a1) IN (SELECT (a0, a1) FROM cust_region)", lambda kb: cp.newly_entailed(parse_rule("noisy(X,Y):-cust_region(X,Y)"), kb))
on_base("groundings", "SELECT h.a0 AS h_a0, h.a1 AS h_a1, x.a0 AS b1_a0, x.a1 AS b1_a1, y.a0 AS b2_a0, y.a1 AS b2_a1 FROM supp_region h JOIN supp_nation x ON x.a0 = h.a0 JOIN nation_region y ON y.a0 = x.a1 AND y.a1 = h.a1", lambda kb: cp.groundings(parse_rule("supp_region(X,Y):-supp_nation(X,Z),nation_region(Z,Y)"), kb).drop("h_entailed"))
on_base("evidence", "SELECT h.a0, h.a1, min({'a0': y.a0, 'a1': y.a1}).a0 AS b0, min({'a0': y.a0, 'a1': y.a1}).a1 AS b1 FROM cust_region h JOIN region_nation y ON y.a0 = h.a1 GROUP BY h.a0, h.a1", lambda kb: cp.evidence(parse_rule("cust_region(?,X):-region_nation(X,?)"), kb).select("head.a0", "head.a1", F.col("body.b1.a0").alias("b0"), F.col("body.b1.a1").alias("b1")))


# --- templates ---------------------------------------------------------------------------------

TEMPLATE_BASE = ["nation_region", "region_nation", "supp_nation", "supp_region", "cust_nation", "cust_region", "far_cust", "noisy"]


def _template_sql(candidates: list[tuple[str, str, int]]) -> str:
    """(rule, SQL of derived tuples, length): figures of each."""
    rows = []
    for text, derived, n in candidates:
        r = parse_rule(text)
        cols = ", ".join(f"a{i}" for i in range(len(r.head.args)))
        rows.append(f"SELECT '{r}' AS rule, {n} AS length, (SELECT count(*) FROM (SELECT {cols} FROM {r.head.pred} INTERSECT ({derived}))) AS pos, (SELECT count(*) FROM ({derived})) AS total, (SELECT count(*) FROM {r.head.pred}) AS size")
    return ", rows AS (" + " UNION ALL ".join(rows) + ") SELECT rule, length, pos, total - pos AS neg, pos / size AS coverage, pos / (total + length) AS tau, (2 * pos - total - length)::DOUBLE AS delta FROM rows WHERE pos / size >= 0.2 AND pos / (total + length) >= 0.8"


on_base("template_dual", _template_sql([("nation_region(X,Y):-region_nation(Y,X)", "SELECT a1, a0 FROM region_nation", 2), ("region_nation(X,Y):-nation_region(Y,X)", "SELECT a1, a0 FROM nation_region", 2)]), lambda kb: tp.match(kb, "Dual"), MINED)
on_base("template_subsumption", _template_sql([("noisy(X,Y):-cust_region(X,Y)", "SELECT a0, a1 FROM cust_region", 4), ("cust_region(X,Y):-noisy(X,Y)", "SELECT a0, a1 FROM noisy", 4)]), lambda kb: tp.match(kb, "Subsumption"), ["cust_region", "noisy"])
on_base("template_types", _template_sql([(f"far_cust(X):-{p}(X,?)", f"SELECT DISTINCT a0 FROM {p}", 1) for p in ("cust_nation", "cust_region", "noisy")]), lambda kb: tp.match(kb, "TypeInference", similar=0.5), ["far_cust", "cust_nation", "cust_region", "noisy"])
_CHAIN = ["nation_region", "supp_nation", "supp_region"]
on_base("template_transition", _template_sql([("supp_region(X,Y):-supp_nation(X,Z),nation_region(Z,Y)", "SELECT DISTINCT x.a0, y.a1 FROM supp_nation x JOIN nation_region y ON x.a1 = y.a0", 3)]), lambda kb: tp.match(kb, "Transition"), _CHAIN)
on_base("template_shared_sink", _template_sql([("supp_region(X,Y):-supp_nation(X,Z),region_nation(Y,Z)", "SELECT DISTINCT x.a0, y.a0 FROM supp_nation x JOIN region_nation y ON x.a1 = y.a1", 3)]), lambda kb: tp.match(kb, "SharedSink"), ["region_nation", "supp_nation", "supp_region"])
on_base("template_shared_source", _template_sql([("nation_region(X,Y):-supp_nation(Z,X),supp_region(Z,Y)", "SELECT DISTINCT x.a1, y.a1 FROM supp_nation x JOIN supp_region y ON x.a0 = y.a0", 3)]), lambda kb: tp.match(kb, "SharedSource"), _CHAIN)
on_base("template_reflexive", ", rows AS (SELECT 'nation_region(X0,X0):-' AS rule, 1 AS length, count(*) FILTER (a0 = a1) AS pos, " + _N + " AS total, count(*) AS size FROM nation_region) SELECT rule, length, pos, (total - pos)::BIGINT AS neg, pos / size AS coverage, pos / (total + length) AS tau, (2 * pos - total - length)::DOUBLE AS delta FROM rows", lambda kb: tp.match(kb, "Reflexive", coverage=0.0, tau=0.0), ["nation_region"])
on_base("template_hints", _template_sql([("supp_region(X,Y):-supp_nation(X,Z),nation_region(Z,Y)", "SELECT DISTINCT x.a0, y.a1 FROM supp_nation x JOIN nation_region y ON x.a1 = y.a0", 3)]), lambda kb: tp.match_hints(kb, ["h(X,Y):-p(X,Z),q(Z,Y);(h,p),(p,q),(h,q)"]), _CHAIN)


@query("type_rules", "WITH typed AS (SELECT s_suppkey AS e, s_nationkey + 1000000 AS t FROM supplier UNION SELECT s_suppkey, 2000000 + n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), size AS (SELECT t, count(*) AS n FROM typed GROUP BY t) SELECT 'type' || y.t || '(X0):-type' || x.t || '(X0)' AS rule, count(*) AS pos, any_value(n) AS \"all\" FROM typed x JOIN typed y ON x.e = y.e AND x.t <> y.t JOIN size s ON s.t = x.t GROUP BY x.t, y.t HAVING 2 * count(*) > any_value(n)")
def type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    by_nation = supplier.select(F.col("s_suppkey").cast("int").alias("a0"), (F.col("s_nationkey") + 1_000_000).alias("a1"))
    by_region = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("int").alias("a0"), (F.lit(2_000_000) + F.col("n_regionkey")).alias("a1"))
    return tp.type_rules(Kb.of("typed", {"type": by_nation.unionByName(by_region)}))


# --- negative samples --------------------------------------------------------------------------

_ORD = ", pos AS (SELECT a0, a1, (a0 - 1)::BIGINT * (SELECT count(*) FROM num) + a1 - 1 AS o FROM supp_nation), n AS (SELECT count(*) AS n FROM num) "
_DEC = "SELECT (o // n + 1)::INT AS a0, (o % n + 1)::INT AS a1 FROM {src}, n"
_BEGIN = "(SELECT o + 1 AS o FROM pos UNION SELECT 0) EXCEPT SELECT o FROM pos"
_END = "(SELECT o - 1 AS o FROM pos UNION SELECT n * n - 1 FROM n) EXCEPT SELECT o FROM pos"
_SUP = ["supp_nation", "supp_region"]
_IN = "o >= 0 AND o < n * n"
on_base("neg_interval_begins", _ORD + _DEC.format(src=f"({_BEGIN})") + f" WHERE {_IN}", lambda kb: ng.interval_begins(kb["supp_nation"].df, kb.n), _SUP)
on_base("neg_interval_ends", _ORD + _DEC.format(src=f"({_END})") + f" WHERE {_IN}", lambda kb: ng.interval_ends(kb["supp_nation"].df, kb.n), _SUP)
on_base("neg_intervals", _ORD + _DEC.format(src=f"(({_BEGIN}) UNION ({_END}))") + f" WHERE {_IN}", lambda kb: ng.intervals(kb["supp_nation"].df, kb.n), _SUP)
_MOVED = ", moved AS (SELECT a0 + d AS a0, a1 FROM supp_nation, (VALUES (1), (-1)) v(d) UNION SELECT a0, a1 + d FROM supp_nation, (VALUES (1), (-1)) v(d)) SELECT a0, a1 FROM moved WHERE a0 >= 1 AND a1 >= 1 AND a0 <= (SELECT count(*) FROM num) AND a1 <= (SELECT count(*) FROM num) EXCEPT SELECT a0, a1 FROM supp_nation"
on_base("neg_neighbours", _MOVED, lambda kb: ng.neighbours(kb["supp_nation"].df, kb.n), _SUP)
on_base("neg_neighbours_up", _MOVED.replace("(VALUES (1), (-1))", "(VALUES (1))"), lambda kb: ng.neighbours(kb["supp_nation"].df, kb.n, down=False), _SUP)
on_base("neg_even_steps", _ORD + ", s AS (SELECT range * ceil(n * n / 50.0)::BIGINT AS o FROM range(50), n) " + _DEC.format(src="(SELECT o FROM s EXCEPT SELECT o FROM pos)") + f" WHERE {_IN}", lambda kb: ng.even_steps(kb["supp_nation"].df, kb.n, 50), _SUP)
on_base("neg_next_record", _ORD + _DEC.format(src="(SELECT least(o + 3, n * n - 1) AS o FROM pos, n)"), lambda kb: ng.stepped(kb["supp_nation"].df, kb.n, 3), _SUP)
_WEIGHED = _ORD + ", neg AS (SELECT a0, a1, (a0 - 1)::BIGINT * n + a1 - 1 AS o FROM supp_region, n), gap AS (SELECT neg.*, coalesce((SELECT max(o) FROM pos WHERE pos.o < neg.o), -1) AS low, coalesce((SELECT min(o) FROM pos WHERE pos.o > neg.o), (SELECT n * n FROM n)) AS high FROM neg) "
on_base("neg_weights", _WEIGHED + "SELECT a0, a1, ((high - low - 1)::DOUBLE / count(*) OVER (PARTITION BY low))::FLOAT AS weight FROM gap", lambda kb: ng.weights(kb["supp_nation"].df, kb["supp_region"].df, kb.n), _SUP)
on_base("neg_in_gap", _WEIGHED + "SELECT a0, a1, (o - low)::DOUBLE / (high - low)::DOUBLE AS in_gap, o::DOUBLE / (SELECT n * n FROM n)::DOUBLE AS overall FROM gap", lambda kb: ng.in_gap(kb["supp_nation"].df, kb["supp_region"].df, kb.n), _SUP)
_MEETS = ", p AS (SELECT a0 AS c1, a1 AS c2 FROM supp_nation UNION ALL SELECT a1, a0 FROM supp_nation UNION ALL SELECT a0, a1 FROM supp_region UNION ALL SELECT a1, a0 FROM supp_region), rel AS (SELECT c1, c2, count(*) / sum(count(*)) OVER (PARTITION BY c1) AS relevance FROM p GROUP BY c1, c2) "
on_base("neg_cooccurrence", _MEETS + "SELECT c1, c2, relevance FROM rel", lambda kb: ng.cooccurrence([kb[r].df for r in _SUP]), _SUP)
on_base("neg_relevant", _MEETS + ", best AS (SELECT c1, c2 FROM (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY relevance DESC, c2) AS k FROM rel WHERE c1 <> c2) WHERE k <= 3) SELECT c2 AS a0, a1 FROM supp_nation JOIN best ON c1 = a0 UNION SELECT a0, c2 FROM supp_nation JOIN best ON c1 = a1 EXCEPT SELECT a0, a1 FROM supp_nation", lambda kb: ng.relevant(kb["supp_nation"].df, ng.cooccurrence([kb[r].df for r in _SUP]), 3), _SUP)
on_base("neg_hop_relevance", _MEETS + ", w1 AS (SELECT c1, c2, relevance / 2 AS w FROM rel), w2 AS (SELECT x.c1, y.c2, sum(x.w * y.relevance / 2) AS w FROM w1 x JOIN rel y ON x.c2 = y.c1 GROUP BY x.c1, y.c2) SELECT c1, c2, round(sum(w), 9) AS relevance FROM (SELECT * FROM w1 UNION ALL SELECT c1, c2, w * 2 FROM w2) GROUP BY c1, c2", lambda kb: ng.hop_relevance(ng.cooccurrence([kb[r].df for r in _SUP]), 2).select("c1", "c2", F.round("relevance", 9).alias("relevance")), _SUP)
on_base("neg_by_frequency", ", c AS (SELECT a0 AS old FROM supp_nation UNION ALL SELECT a1 FROM supp_nation UNION ALL SELECT a0 FROM supp_region UNION ALL SELECT a1 FROM supp_region) SELECT old, row_number() OVER (ORDER BY count(*) DESC, old)::INT AS new FROM c GROUP BY old", lambda kb: ng.by_frequency([kb[r].df for r in _SUP]), _SUP)
_N0 = "(SELECT count(*) FROM num)"


def _drawn(*parts: str) -> str:
    """The SQL of functions.draws.draw."""
    return "('0x' || substr(sha256(concat_ws(':', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


on_base("neg_uniform", f", d AS (SELECT DISTINCT ({_drawn(repr(ng.SEED), repr('uniform0'), '0', 'range')} % {_N0} + 1)::INT AS a0, ({_drawn(repr(ng.SEED), repr('uniform0'), '1', 'range')} % {_N0} + 1)::INT AS a1 FROM range(400)) SELECT a0, a1 FROM (SELECT * FROM d EXCEPT SELECT a0, a1 FROM supp_nation) ORDER BY {_drawn(repr('uniform'), 'a0', 'a1')}, a0, a1 LIMIT 200", lambda kb: ng.uniform(kb["supp_nation"].df, kb.n, 200), _SUP)
_NEAR = f"""
, r0 AS (SELECT DISTINCT a1 FROM supp_nation), r1 AS (SELECT DISTINCT a0 FROM supp_nation),
few AS (SELECT 4 * 200 > greatest((SELECT count(*) FROM r0), (SELECT count(*) FROM r1)) * {_N0} - (SELECT count(*) FROM supp_nation) AS few),
listed AS (SELECT n.num AS a0, a1 FROM num n, r0 UNION SELECT a0, n.num FROM r1, num n),
copies AS (SELECT a0, a1, unnest(range(1, greatest(1, ceil(400.0 / greatest(1, (SELECT count(*) FROM supp_nation))))::BIGINT + 1)) AS copy FROM supp_nation),
cut AS (SELECT *, {_drawn(repr(ng.SEED), repr('near0'), repr('c'), 'a0', 'a1', 'copy')} % 2 AS place, ({_drawn(repr(ng.SEED), repr('near0'), repr('v'), 'a0', 'a1', 'copy')} % {_N0} + 1)::INT AS v FROM copies),
moved AS (SELECT DISTINCT CASE WHEN place = 0 THEN v ELSE a0 END AS a0, CASE WHEN place = 1 THEN v ELSE a1 END AS a1 FROM cut),
found AS (SELECT * FROM listed WHERE (SELECT few FROM few) UNION SELECT * FROM moved WHERE NOT (SELECT few FROM few))
SELECT a0, a1 FROM (SELECT * FROM found EXCEPT SELECT a0, a1 FROM supp_nation) ORDER BY {_drawn(repr('near'), 'a0', 'a1')}, a0, a1 LIMIT 200"""
on_base("neg_near_positive", _NEAR, lambda kb: ng.near_positive(kb["supp_nation"].df, kb.n, 200), _SUP)
on_base("neg_adversarial", f"SELECT a0, a1 FROM (SELECT a0, a1 FROM cust_region EXCEPT SELECT a0, a1 FROM noisy) ORDER BY {_drawn(repr('adversarial'), 'a0', 'a1')}, a0, a1 LIMIT 50", lambda kb: ng.adversarial(kb["noisy"].df, cp.derived(parse_rule("noisy(X,Y):-cust_region(X,Y)"), kb), kb.n, 50), ["cust_region", "noisy"])
_FREE = f""", b AS (SELECT a0, row_number() OVER (ORDER BY a0) AS place FROM (SELECT DISTINCT a0 FROM far_cust)),
picks AS (SELECT {_drawn(repr(ng.SEED), repr('binding'), 'range')} % (SELECT count(*) FROM b) + 1 AS place, ({_drawn(repr(ng.SEED), repr('free'), '1', 'range')} % {_N0} + 1)::INT AS a1 FROM range(200))
SELECT a0, a1 FROM (SELECT DISTINCT a0, a1 FROM picks JOIN b USING (place) EXCEPT SELECT a0, a1 FROM noisy) ORDER BY {_drawn(repr('adversarial'), 'a0', 'a1')}, a0, a1 LIMIT 50"""
on_base("neg_adversarial_free", _FREE, lambda kb: ng.adversarial_draws(kb["noisy"].df, kb["far_cust"].df.select("a0"), [1], kb.n, 50), ["far_cust", "noisy"])
on_base("neg_previous_record", _ORD + _DEC.format(src="(SELECT greatest(o - 3, 0) AS o FROM pos)"), lambda kb: ng.stepped(kb["supp_nation"].df, kb.n, -3), _SUP)
_OTHER = ", other AS (SELECT name, row_number() OVER (ORDER BY name DESC)::INT AS num FROM num WHERE name NOT LIKE 'r%'), m AS (SELECT num.num AS old, other.num AS new FROM num JOIN other USING (name))"
on_base("neg_remapped", _OTHER + " SELECT x.new AS a0, y.new AS a1 FROM supp_region t JOIN m x ON x.old = t.a0 JOIN m y ON y.old = t.a1 UNION ALL SELECT x.new, y.new FROM supp_nation t JOIN m x ON x.old = t.a0 JOIN m y ON y.old = t.a1", lambda kb: (lambda m: ng.remapped(kb["supp_region"].df, m).unionByName(ng.remapped(kb["supp_nation"].df, m)))(ng.between(kb.numeration, nm.ranked(kb.numeration.filter("name not like 'r%'").select("name", (-F.col("num")).alias("down")), "down", "num").select("name", "num"))), _SUP)
_HOPS = _MEETS + """, h1 AS (SELECT c1, c2, 1 AS hop, relevance FROM rel WHERE c1 <> c2),
h2 AS (SELECT x.c1, y.c2, 2 AS hop, sum(x.relevance * y.relevance) AS relevance FROM h1 x JOIN h1 y ON x.c2 = y.c1 WHERE x.c1 <> y.c2 AND (x.c1, y.c2) NOT IN (SELECT (c1, c2) FROM h1) GROUP BY x.c1, y.c2),
turns AS (SELECT c1, c2, row_number() OVER (PARTITION BY c1 ORDER BY hop, round(relevance, 12) DESC, c2) AS turn FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)),
moved AS (SELECT c2 AS a0, a1, turn, 0 AS place FROM supp_nation JOIN turns ON c1 = a0 UNION ALL SELECT a0, c2, turn, 1 FROM supp_nation JOIN turns ON c1 = a1)
SELECT a0, a1 FROM moved WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM supp_nation) GROUP BY a0, a1 ORDER BY min({'turn': turn, 'place': place}), a0, a1 LIMIT 150"""
on_base("neg_relevant_by_hops", _HOPS, lambda kb: ng.relevant_by_hops(kb["supp_nation"].df, [kb[r].df for r in _SUP], 150, 2), _SUP)

# --- samples -----------------------------------------------------------------------------------

_EDGES = ", e AS (SELECT 'supp_nation' AS rel, a0, a1 FROM supp_nation UNION ALL SELECT 'supp_region', a0, a1 FROM supp_region), k AS (SELECT *, count(*) OVER (PARTITION BY rel) AS rows, (SELECT count(*) FROM e) AS total FROM e) "
_args = lambda df: df.select("rel", F.col("args")[0].alias("a0"), F.col("args")[1].alias("a1"))
on_base("sample_head", _EDGES + "SELECT rel, a0, a1 FROM k QUALIFY row_number() OVER (PARTITION BY rel ORDER BY a0, a1) <= floor(60.0::DOUBLE / total * rows)", lambda kb: _args(sp.by_end(kb, 60)), _SUP)
on_base("sample_tail", _EDGES + "SELECT rel, a0, a1 FROM k QUALIFY row_number() OVER (PARTITION BY rel ORDER BY a0 DESC, a1 DESC) <= floor(60.0::DOUBLE / total * rows)", lambda kb: _args(sp.by_end(kb, 60, last=True)), _SUP)
on_base("sample_major_nodes", _EDGES + ", d AS (SELECT node, count(*) AS deg FROM (SELECT a0 AS node FROM e UNION ALL SELECT a1 FROM e) GROUP BY node), c AS (SELECT node FROM d QUALIFY coalesce(sum(deg) OVER (ORDER BY deg DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 80) SELECT rel, a0, a1 FROM e WHERE a0 IN (SELECT node FROM c) OR a1 IN (SELECT node FROM c)", lambda kb: _args(sp.by_major_nodes(kb, 80)), _SUP)
on_base("sample_degrees", _EDGES + "SELECT node, count(*) AS deg FROM (SELECT a0 AS node FROM e UNION ALL SELECT a1 FROM e) GROUP BY node", lambda kb: sp.degrees(kb), _SUP)
_LN = "-ln((" + _drawn("0", "node") + " + 1) / 4294967297.0::DOUBLE) / deg"
on_base("sample_edges", _EDGES + f", p AS (SELECT rel, a0, a1, row_number() OVER (ORDER BY rel, a0, a1) AS place FROM e), d AS (SELECT DISTINCT {_drawn('0', 'range')} % (SELECT count(*) FROM e) + 1 AS place FROM range(60)) SELECT rel, a0, a1 FROM p JOIN d USING (place)", lambda kb: _args(sp.by_edge(kb, 60)), _SUP)
_CELLS = ", c AS (SELECT rel, a0, a1, unnest([a0, a1]) AS node FROM e), deg AS (SELECT node, count(*) AS deg FROM c GROUP BY node)"
_GROW = "t{k} AS (SELECT rel, a0, a1 FROM (SELECT rel, a0, a1, row_number() OVER (PARTITION BY node ORDER BY {draw}, rel, a0, a1) AS nth FROM c JOIN f{k} USING (node)) WHERE nth <= (SELECT mean FROM mean) UNION SELECT * FROM t{p}), f{n} AS (SELECT node FROM (SELECT a0 AS node FROM t{k} UNION SELECT a1 FROM t{k}) WHERE node NOT IN (SELECT node FROM s{k})), s{n} AS (SELECT node FROM s{k} UNION SELECT node FROM f{n})"
_SNOW = _EDGES + _CELLS + f", mean AS (SELECT greatest(1, round_even(avg(deg), 0))::BIGINT AS mean FROM deg), f0 AS (SELECT node FROM deg ORDER BY {_LN}, node LIMIT (SELECT greatest(1, ceil(pow(60, 1 / 3.0::DOUBLE) / mean))::BIGINT FROM mean)), s0 AS (SELECT node FROM f0), t AS (SELECT rel, a0, a1 FROM e WHERE false), " + ", ".join(_GROW.format(k=k, n=k + 1, p=k - 1 if k else "", draw=_drawn(str(k + 1), "rel", "a0 || ',' || a1")) for k in range(3)) + f" SELECT rel, a0, a1 FROM t2 ORDER BY {_drawn('0', 'rel', chr(97) + '0 || ' + repr(',') + ' || a1')}, rel, a0, a1 LIMIT 60"
on_base("sample_snowball", _SNOW, lambda kb: _args(sp.by_snowball(kb, 60)), _SUP)
_STEP = "m{k} AS (SELECT w.rel, w.a0, w.a1, walker, CASE WHEN w.a0 <> w.node THEN w.a0 WHEN w.a1 <> w.node THEN w.a1 ELSE w.node END AS node FROM ways w JOIN {at} p ON w.node = p.node WHERE place = {draw} % deg)"
_WALK = _EDGES + _CELLS + f", ways AS (SELECT c.*, deg, row_number() OVER (PARTITION BY node ORDER BY rel, a0, a1) - 1 AS place FROM c JOIN deg USING (node)), w0 AS (SELECT node, node AS walker FROM deg ORDER BY {_LN}, node LIMIT 4), " + ", ".join(_STEP.format(k=k, at=f"m{k - 1}" if k else "w0", draw=_drawn("0", str(k), "walker")) for k in range(3)) + " " + " UNION ".join(f"SELECT rel, a0, a1 FROM m{k}" for k in range(3))
on_base("sample_walk", _WALK, lambda kb: _args(sp.by_walk(kb, 12)), _SUP)
_WSTEP = "x{k} AS (SELECT i, w.rel, w.a0, w.a1, CASE WHEN w.a0 <> w.node THEN w.a0 WHEN w.a1 <> w.node THEN w.a1 ELSE w.node END AS node FROM (SELECT i, node, deg, sum(deg) OVER (ORDER BY i) AS upto, sum(deg) OVER () AS total FROM q{k} JOIN deg USING (node)) p JOIN ways w ON w.node = p.node WHERE {who} % total >= upto - p.deg AND {who} % total < upto AND place = {step} % p.deg), q{n} AS (SELECT i, coalesce((SELECT x.node FROM x{k} x WHERE x.i = q.i), q.node) AS node FROM q{k} q)"
_WEIGHTED = _EDGES + _CELLS + f", ways AS (SELECT c.*, deg, row_number() OVER (PARTITION BY node ORDER BY rel, a0, a1) - 1 AS place FROM c JOIN deg USING (node)), q0 AS (SELECT row_number() OVER () AS i, node FROM (SELECT node FROM deg ORDER BY {_LN}, node LIMIT 3)), " + ", ".join(_WSTEP.format(k=k, n=k + 1, who=_drawn("0", str(k), "'walker'"), step=_drawn("0", str(k), "'step'")) for k in range(6)) + " " + " UNION ".join(f"SELECT rel, a0, a1 FROM x{k}" for k in range(6))
on_base("sample_weighted_walk", _WEIGHTED, lambda kb: _args(sp.by_weighted_walk(kb, 6, 3)), _SUP)
on_base("sample_renumbered", _EDGES + ", s AS (SELECT rel, a0, a1 FROM k QUALIFY row_number() OVER (PARTITION BY rel ORDER BY a0, a1) <= floor(60.0::DOUBLE / total * rows)), u AS (SELECT a0 AS old FROM s UNION SELECT a1 FROM s) SELECT row_number() OVER (ORDER BY old)::INT AS new, old FROM u", lambda kb: sp.as_kb(kb, sp.by_end(kb, 60), "sample")[1], _SUP)


@query("split_parts")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot, parts = sp.split_parts(base(spark, sf_dir, TEMPLATE_BASE))
    return spark.createDataFrame([(k, r, pivot) for k, p in enumerate(parts) for r in p], "part int, rel string, threshold double")


# --- compression and recovery ------------------------------------------------------------------

GIVEN = [parse_rule(r) for r in ("region_nation(X,Y):-nation_region(Y,X)", "nation_region(X,Y):-region_nation(Y,X)", TRANSIT, "noisy(X,Y):-cust_region(X,Y)")]
_GIVEN = ["nation_region", "region_nation", "cust_nation", "cust_region", "noisy"]


def _edges(kb: Kb) -> DataFrame:
    r = parse_rule("supp_region(X,Y):-supp_nation(X,Z),nation_region(Z,Y)")
    return dependencies(r, cp.evidence(r, kb)).select("src_rel", F.concat_ws(",", F.col("src_args").cast("array<string>")).alias("src"), "dst_rel", F.concat_ws(",", F.col("dst_args").cast("array<string>")).alias("dst"))


on_base("dependency_edges", ", g AS (SELECT h.a0 AS h0, h.a1 AS h1, x.a1 AS z FROM supp_region h JOIN supp_nation x ON x.a0 = h.a0 JOIN nation_region y ON y.a0 = x.a1 AND y.a1 = h.a1) SELECT 'supp_region' AS src_rel, h0 || ',' || h1 AS src, 'supp_nation' AS dst_rel, h0 || ',' || z AS dst FROM g UNION SELECT 'supp_region', h0 || ',' || h1, 'nation_region', z || ',' || h1 FROM g", _edges, ["nation_region", "supp_nation", "supp_region"])
on_base("cycle_breakers", "SELECT 2 * count(*)::BIGINT AS nodes, count(*)::BIGINT AS sccs, count(*)::BIGINT AS feedback FROM nation_region", lambda kb: compress_with(kb, GIVEN[:2]).feedback.agg(F.count("*").alias("nodes"), F.countDistinct("scc").alias("sccs"), F.sum(F.col("feedback").cast("long")).alias("feedback")), ["nation_region", "region_nation"])
on_base("necessary", "SELECT a0, a1 FROM noisy EXCEPT SELECT a0, a1 FROM cust_region", lambda kb: compress_with(kb, GIVEN).necessary["noisy"], _GIVEN)
on_base("given_counterexamples", "SELECT a0, a1 FROM cust_region EXCEPT SELECT a0, a1 FROM noisy", lambda kb: compress_with(kb, GIVEN).counter["noisy"], _GIVEN)
on_base("recover_given", "SELECT a0, a1 FROM noisy", lambda kb: compress_with(kb, GIVEN).recovered()["noisy"].df, _GIVEN)
# rules that derive whole relations lose constants: of far customers all are right, the others are counterexamples, seventh has no rule
LOSING = [parse_rule(r) for r in ("cust(1):-", "cust(?):-", "far_cust(?):-")]
on_base("supplementary", "SELECT num AS value FROM num WHERE num NOT IN (SELECT a0 FROM seventh) AND num NOT IN (SELECT a0 FROM cust EXCEPT SELECT a0 FROM far_cust) AND num <> 1", lambda kb: compress_with(kb, LOSING).supplementary, ["cust", "far_cust", "seventh"])
on_base("select_compressed", "SELECT a0, a1 FROM cust_region WHERE a1 = (SELECT min(a1) FROM nation_region)", lambda kb: (lambda c: rc.select(c.facts(), c.counter, [s.rule for s in c.rules], "cust_region", 1, kb["nation_region"].df.agg(F.min("a1")).first()[0], c.supplementary))(compress_with(kb, GIVEN[2:3])), ["nation_region", "cust_nation", "cust_region"])
on_base("join_compressed", "SELECT x.a0 AS l_a0, x.a1 AS l_a1, y.a0 AS r_a0, y.a1 AS r_a1 FROM supp_region x JOIN nation_region y ON x.a1 = y.a1", lambda kb: (lambda c: rc.product(c.facts(), c.counter, [s.rule for s in c.rules], ("supp_region", 1), ("nation_region", 1), c.supplementary))(compress_with(kb, [parse_rule("supp_region(X,Y):-supp_nation(X,Z),nation_region(Z,Y)")])), ["nation_region", "supp_nation", "supp_region"])


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes chained by steps: a recursive program."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("int").alias("a0"), (F.col("p_size") + 3).cast("int").alias("a1")).distinct()
    kb = Kb.of("steps", {"step": parts, "reach": parts.limit(0)})
    rules = [parse_rule("reach(X,Y):-step(X,Y)"), parse_rule("reach(X,Y):-reach(X,Z),step(Z,Y)")]
    return rc.recover(Kb(kb.name, kb.relations, kb.n), {}, rules)["reach"].df


QUERIES["recursive_recovery"] = _closure
ORACLES["recursive_recovery"] = "WITH RECURSIVE step AS (SELECT DISTINCT p_size::INT AS a0, (p_size + 3)::INT AS a1 FROM part), reach AS (SELECT a0, a1 FROM step UNION SELECT r.a0, s.a1 FROM reach r JOIN step s ON r.a1 = s.a0) SELECT a0, a1 FROM reach"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["eval_rules"](spark, sf_dir)


def _weighted(kb: Kb) -> DataFrame:
    """The weight of negative samples that a rule covers, in place of the count of its wrong tuples."""
    pos = kb["noisy"].df
    samples = ng.weights(pos, ng.intervals(pos, kb.n), kb.n)
    covered = samples.join(cp.derived(parse_rule("noisy(X,Y):-cust_region(X,Y)"), kb), pos.columns, "left_semi")
    return ng.weighted_negatives(covered, pos.columns).select(F.round("negatives", 3).alias("negatives"))


on_base("neg_weighted_score", ", n AS (SELECT count(*) AS n FROM num), pos AS (SELECT (a0 - 1)::BIGINT * n + a1 - 1 AS o FROM noisy, n), neg AS (SELECT o FROM ((SELECT o + 1 AS o FROM pos UNION SELECT 0 UNION SELECT o - 1 FROM pos UNION SELECT n * n - 1 FROM n) EXCEPT SELECT o FROM pos), n WHERE o >= 0 AND o < n * n), marks AS (SELECT o, TRUE AS own FROM pos UNION ALL SELECT o, FALSE FROM neg), gap AS (SELECT o, own, coalesce(max(CASE WHEN own THEN o END) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS low, coalesce(min(CASE WHEN own THEN o END) OVER (ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), (SELECT n * n FROM n)) AS high FROM marks), w AS (SELECT o, ((high - low - 1)::DOUBLE / count(*) OVER (PARTITION BY low))::FLOAT AS weight FROM gap WHERE NOT own) SELECT round(coalesce(sum(weight::DOUBLE), 0.0::DOUBLE), 3) AS negatives FROM w WHERE o IN (SELECT (a0 - 1)::BIGINT * n + a1 - 1 FROM cust_region, n)", _weighted, ["cust_region", "noisy"])
