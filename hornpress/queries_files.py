"""Registered queries of files, generators and streams: what is written comes back."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress import queries as q
from hornpress.operators import negatives as ng
from hornpress.operators import templates as tp
from hornpress.operators.graph import checkpointed, new_folder
from hornpress.operators.kb import Kb
from hornpress.plans.compress import compress_with
from hornpress.plans.rules import parse_rule
from hornpress.sources import generators as gen
from hornpress.sources import readers as rd
from hornpress.sources import writers as wr
from hornpress.streaming.scoring import follow

_BACK = ["nation_region", "supp_nation", "cust_region"]


def _rows(kb: Kb, names: list[str] | None = None) -> DataFrame:
    """(rel, a0, a1) of binary relations."""
    return reduce(DataFrame.unionByName, (kb[r].df.select(F.lit(r).alias("rel"), "a0", "a1") for r in names or list(kb.relations)))


def _rows_sql(names: list[str], raw: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rel, a0, a1 FROM {raw}{r}" for r in names)


def _back(kb: Kb) -> Kb:
    path = new_folder(kb.spark)
    wr.kb_folder(kb, path)
    return rd.kb_folder(kb.spark, path, kb.name, check=True)


q.on_base("file_base", _rows_sql(_BACK), lambda kb: _rows(_back(kb)), _BACK)
q.on_base("file_names", "SELECT name, num FROM num", lambda kb: _back(kb).numeration, _BACK)
q.on_base("file_unmapped", "SELECT (SELECT count(*) + 7 FROM num)::INT AS value", lambda kb: (lambda b: rd.unmapped(b.add("cust_region", kb.spark.createDataFrame([(1, kb.n + 7)], "a0 int, a1 int"))))(_back(kb)), _BACK)
q.on_base("file_same_base", "SELECT TRUE AS same, FALSE AS same_after_edit", lambda kb: (lambda b: kb.spark.createDataFrame([(kb.same_as(b), kb.same_as(b.remove("nation_region", b["nation_region"].df.limit(1))))], "same boolean, same_after_edit boolean"))(_back(kb)), ["nation_region", "supp_nation"])


def _parquet(kb: Kb) -> DataFrame:
    path = new_folder(kb.spark)
    wr.kb_parquet(kb, path)
    return _rows(Kb.of("back", {r: kb.spark.read.parquet(f"{path}/{r}") for r in kb.relations}))


q.on_base("file_parquet", _rows_sql(_BACK), _parquet, _BACK)


def _compressed(kb: Kb) -> DataFrame:
    """Kept tuples and counterexamples of a compressed base that was written and read."""
    path = new_folder(kb.spark)
    wr.compressed(compress_with(kb, q.GIVEN), path)
    facts, counter, rules, _ = rd.compressed_folder(kb.spark, path)
    kept = _rows(facts).withColumn("kind", F.lit("fact"))
    return reduce(DataFrame.unionByName, (df.select(F.lit(r).alias("rel"), "a0", "a1", F.lit("wrong").alias("kind")) for r, df in counter.items()), kept).withColumn("rules", F.lit(len(rules)))


_KEPT = "SELECT 'nation_region' AS rel, a0, a1, 'fact' AS kind, 4 AS rules FROM nation_region UNION ALL SELECT 'cust_nation', a0, a1, 'fact', 4 FROM cust_nation UNION ALL (SELECT 'noisy', a0, a1, 'fact', 4 FROM noisy WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM cust_region)) UNION ALL (SELECT 'noisy', a0, a1, 'wrong', 4 FROM cust_region WHERE (a0, a1) NOT IN (SELECT (a0, a1) FROM noisy))"
q.on_base("file_compressed", _KEPT, _compressed, q._GIVEN)


def _result(kb: Kb) -> DataFrame:
    """The same from one text file: relation, arguments, and the rules' texts."""
    path = new_folder(kb.spark) + ".txt"
    wr.result_text(compress_with(kb, q.GIVEN[2:]), path)
    rules, facts, wrong, _ = rd.result_text(kb.spark, path)
    rows = [(kind, rel, *map(int, r)) for kind, part in (("fact", facts), ("wrong", wrong)) for rel, rs in part.items() for r in rs]
    return kb.spark.createDataFrame(rows, "kind string, rel string, a0 int, a1 int").withColumn("rules", F.lit("; ".join(map(str, rules))))


_TEXTS = "; ".join(map(str, q.GIVEN[2:]))
q.on_base("file_result_text", f"SELECT kind, rel, a0, a1, '{_TEXTS}' AS rules FROM (" + _KEPT.replace(", 4 AS rules", "").replace(", 4 FROM", " FROM") + " UNION ALL SELECT 'region_nation', a0, a1, 'fact' FROM region_nation)", _result, q._GIVEN)


def _negatives(kb: Kb) -> DataFrame:
    path = new_folder(kb.spark)
    wr.negatives({"supp_nation": ng.weights(kb["supp_nation"].df, kb["supp_region"].df, kb.n), "plain": kb["supp_region"].df}, path)
    back = rd.negatives_folder(kb.spark, path)
    return reduce(DataFrame.unionByName, (df.withColumn("rel", F.lit(k)) for k, df in back.items()))


q.on_base("file_negatives", q._WEIGHED + "SELECT 'supp_nation' AS rel, a0, a1, ((high - low - 1)::DOUBLE / count(*) OVER (PARTITION BY low))::FLOAT AS weight FROM gap UNION ALL SELECT 'plain', a0, a1, 1::FLOAT FROM supp_region", _negatives, q._SUP)


def _lines_back(kb: Kb) -> DataFrame:
    path = new_folder(kb.spark)
    wr.fact_lines(kb, path)
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("rel"), "a0", "a1") for k, df in rd.fact_lines(kb.spark, path).items()))


q.on_base("file_fact_lines", _rows_sql(_BACK, "raw_"), _lines_back, _BACK)


def _converted(kb: Kb) -> DataFrame:
    path = new_folder(kb.spark)
    wr.fact_lines(kb, f"{path}/lines")
    wr.converted(kb.spark, f"{path}/lines", f"{path}/base")
    return _rows(rd.kb_folder(kb.spark, f"{path}/base"), _BACK)


q.on_base("file_converted", _rows_sql(_BACK), _converted, _BACK)


def _triples(kb: Kb) -> DataFrame:
    """(rel, s, o) with names."""
    return _rows(kb).join(F.broadcast(kb.numeration.select(F.col("name").alias("s"), F.col("num").alias("a0"))), "a0").join(F.broadcast(kb.numeration.select(F.col("name").alias("o"), F.col("num").alias("a1"))), "a1").select("rel", "s", "o")


def _imported(kb: Kb) -> DataFrame:
    """The same triples through every import format; relations of under 50 lines go from the first."""
    spark, path, rows = kb.spark, new_folder(kb.spark), checkpointed(_triples(kb))
    rows.select(F.concat_ws("\t", "rel", "s", "o").alias("value")).write.text(f"{path}/tsv")
    rows.select(F.concat_ws("\t", F.lit("id"), "s", "rel", "o").alias("value")).write.text(f"{path}/yago")
    rows.select(F.concat_ws("  ", "s", "rel", "o", F.lit(".")).alias("head of lines")).write.csv(f"{path}/spaced", header=True, quote="", sep="\x01")
    rows.select(F.concat_ws("\t", "s", "rel", "o").alias("value")).write.text(f"{path}/codex")
    spark.createDataFrame([('{"n1": ["place", "land"], "n2": ["land"]}',)], "value string").coalesce(1).write.text(f"{path}/types")
    wr.frequent_triples(rows, f"{path}/frequent", 50)
    typed = rd.triples_with_types(spark, [f"{path}/codex"], f"{path}/types")
    parts = {
        "tsv": rd.triples(spark, f"{path}/tsv", 50),
        "subject_first": rd.subject_first(spark, f"{path}/yago"),
        "spaced": rd.spaced_triples(spark, f"{path}/spaced"),
        "frequent": rd.triples(spark, f"{path}/frequent"),
        "typed": reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("rel"), F.col("a0").alias("s"), (F.col("a1") if "a1" in df.columns else F.lit("")).alias("o")) for k, df in typed.items())),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("format"), "rel", "s", "o") for k, df in parts.items()))


_TRI = ", tri AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rel, a0 AS s, a1 AS o FROM raw_{r}" for r in _BACK) + "), much AS (SELECT rel FROM tri GROUP BY rel HAVING count(*) >= 50) "
q.on_base("file_imports", _TRI + "SELECT 'tsv' AS format, * FROM tri WHERE rel IN (SELECT rel FROM much) UNION ALL SELECT 'frequent', * FROM tri WHERE rel IN (SELECT rel FROM much) UNION ALL SELECT f, tri.* FROM tri, (VALUES ('subject_first'), ('spaced'), ('typed')) v(f) UNION ALL VALUES ('typed', 'land', 'n1', ''), ('typed', 'land', 'n2', ''), ('typed', 'place', 'n1', '')", _imported, _BACK)


def _hint_file(kb: Kb) -> DataFrame:
    """Thresholds and hints from a file, their rules written as lines and read."""
    path, spark = new_folder(kb.spark), kb.spark
    wr._lines(spark, f"{path}/hints", ["0.2", "0.8", "h(X,Y):-p(X,Z),q(Z,Y);(h,p),(p,q),(h,q)"])
    coverage, tau, hints = rd.hint_lines(spark, f"{path}/hints")
    wr.template_results(tp.match_hints(kb, hints, coverage, tau), f"{path}/rules")
    return spark.read.csv(f"{path}/rules", schema=tp.RESULT, sep="\t", header=True)


q.on_base("file_hints", q._template_sql([("supp_region(X,Y):-supp_nation(X,Z),nation_region(Z,Y)", "SELECT DISTINCT x.a0, y.a1 FROM supp_nation x JOIN nation_region y ON x.a1 = y.a0", 3)]), _hint_file, q._CHAIN)

# --- generators --------------------------------------------------------------------------------


@q.query("gen_families", "WITH f AS (SELECT range::VARCHAR AS f FROM range(60)), k AS (SELECT f, k || '_' || f AS c FROM f, (VALUES ('son'), ('daughter')) v(k)) SELECT 'father' AS rel, 'dad_' || f AS a0, c AS a1 FROM k UNION ALL SELECT 'mother', 'mom_' || f, c FROM k UNION ALL SELECT 'child', c, p || '_' || f FROM k, (VALUES ('dad'), ('mom')) v(p) UNION ALL SELECT 'gender', w || '_' || f, g FROM f, (VALUES ('dad', 'male'), ('mom', 'female'), ('son', 'male'), ('daughter', 'female')) v(w, g) UNION ALL SELECT 'parent', p || '_' || f, c FROM k, (VALUES ('dad'), ('mom')) v(p) UNION ALL SELECT 'parent', g || '_' || f, 'dad_' || f FROM f, (VALUES ('grandpa'), ('grandma')) v(g) UNION ALL SELECT 'grandparent', g || '_' || f, c FROM k, (VALUES ('grandpa'), ('grandma')) v(g)")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gen.families(spark, 60, grandparents=True)
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("rel"), "a0", "a1") for k, df in made.items() if k != "family"))


q.query("gen_functional", "SELECT (k.range + 1)::INT AS a0, ((k.range + 1) * 3 + v.range + 1 + 40)::INT AS a1 FROM range(40) k, range(3) v")(lambda spark, _: gen.functional(spark, 40, 3))
q.query("gen_varying", "SELECT (k.range + 1)::INT AS a0, ((k.range + 1) * 4 + v.range + 1 + 40)::INT AS a1 FROM range(40) k, range(4) v WHERE v.range + 1 <= (k.range + 1) % 4 + 1")(lambda spark, _: gen.varying(spark, 40, 4))


def _random_sql(k: int) -> str:
    cell = lambda i: f"({q._drawn('0', str(k), str(i), 'range')} % 10 + 1)::INT"
    return f"SELECT DISTINCT 'r{k + 1}' AS rel, [" + ", ".join(map(cell, range(k + 1))) + "]::VARCHAR AS args FROM range(10)"


@q.query("gen_random", " UNION ALL ".join(map(_random_sql, range(10))))
def random_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("rel"), F.concat(F.lit("["), F.concat_ws(", ", *df.columns), F.lit("]")).alias("args")) for k, df in gen.random_tables(spark).items()))


_PARENTS = "WITH father(a0, a1) AS (VALUES ('james', 'harry'), ('arthur', 'ron'), ('arthur', 'ginny'), ('harry', 'albus')), mother(a0, a1) AS (VALUES ('lily', 'harry'), ('molly', 'ron'), ('molly', 'ginny'), ('ginny', 'albus')), parent AS (SELECT * FROM father UNION SELECT * FROM mother) "
q.query("gen_wizards", _PARENTS + "SELECT 'father' AS rel, * FROM father UNION ALL SELECT 'mother', * FROM mother UNION ALL SELECT 'parent', * FROM parent UNION ALL SELECT 'child', a1, a0 FROM parent UNION ALL SELECT DISTINCT 'grandparent', x.a0, y.a1 FROM parent x JOIN parent y ON x.a1 = y.a0 UNION ALL SELECT DISTINCT 'sibling', x.a1, y.a1 FROM parent x JOIN parent y ON x.a0 = y.a0 AND x.a1 <> y.a1 UNION ALL SELECT DISTINCT 'female', a0, '' FROM mother UNION ALL SELECT DISTINCT 'male', a0, '' FROM (SELECT a0 FROM father UNION VALUES ('ron'), ('albus'))")(lambda spark, _: reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("rel"), "a0", (F.col("a1") if "a1" in df.columns else F.lit("")).alias("a1")) for k, df in gen.wizards(spark).items())))

# --- streams -----------------------------------------------------------------------------------


def _streamed(kb: Kb) -> DataFrame:
    """Arriving tuples in two files, marked by whether rules derive them."""
    path, rows = new_folder(kb.spark), kb["noisy"].df
    rows.repartition(2, "a0").write.parquet(f"{path}/in")
    stream = kb.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    rules = [parse_rule(q.TRANSIT.replace("cust_region(X,Y)", "noisy(X,Y)")), parse_rule("noisy(X,Y):-far_cust(X),cust_region(X,Y)")]
    query = follow(stream, kb, rules, f"{path}/out", f"{path}/checkpoint")
    began = time.monotonic()
    while query.isActive and time.monotonic() - began < 600:
        query.awaitTermination(5)
    return kb.spark.read.parquet(f"{path}/out").select("a0", "a1", "by_rule")


q.on_base("stream_explained", f"SELECT a0, a1, (a0, a1) IN (SELECT (a0, a1) FROM ({q._JOIN})) OR (a0 IN (SELECT a0 FROM far_cust) AND (a0, a1) IN (SELECT (a0, a1) FROM cust_region)) AS by_rule FROM noisy", _streamed, ["nation_region", "cust_nation", "cust_region", "far_cust", "noisy"])
