"""URL filters by a sort-merge range join.

A host's canonical key is its labels in reverse, each closed by a dot, so that all hosts below a
rule's host share the rule's key as a prefix: the rule is the interval of keys from its own to the
prefix's end, and intervals are nested or apart. Urls and rules are dealt to ranges of the key and
sorted together; the sweep keeps a stack of the rules passed, with one place for each number of
labels, since a nested rule has more. A url takes from the stack the rules that are still open at
its key, and of their paths the longest that its own begins with. A range begins with the rules
that are open at its border.

Hosts of very many rules hold a second sweep, over paths, for the urls below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from hornpress.llm.common import durable, few, shuffle_partitions, table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules of a host beyond which their paths are swept by themselves.
MOST_PATHS = 64
#: Ranges of the sweep for each shuffle partition, and at most; keys sampled for each border, and a border's length.
RANGES, MOST_RANGES, SAMPLED, BORDER = 1, 4096, 20, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """org.example. for example.org: the keys of a host and of all below it begin with its key."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def borders(keys: DataFrame) -> list[str]:
    """Keys that cut about equal ranges, from a sample of (key); they decide balance, not results."""
    ranges = min(MOST_RANGES, RANGES * shuffle_partitions(keys.sparkSession))
    rows = keys.count()
    part = min(1.0, ranges * SAMPLED / max(1, rows))
    sample = keys.select(F.substring("key", 1, BORDER).alias("key"))
    sample = (sample if part == 1 else sample.sample(fraction=part, seed=3)).limit(2 * ranges * SAMPLED)
    found = sorted({r["key"].encode() for r in sample.collect()})
    step = max(1, -(-len(found) // ranges))
    return [k.decode(errors="ignore") for k in found[step::step]]


def range_of(df: DataFrame, cuts: list[str]) -> DataFrame:
    """df and `range`: how many cuts are at or before its key, by binary search."""
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    df = df.withColumn("range", F.lit(0))
    step = 1 << len(cuts).bit_length()
    while step := step >> 1:
        at = F.col("range") + step
        df = df.withColumn("range", F.when((at <= len(cuts)) & (F.try_element_at(held, at) <= F.col("key")), at).otherwise(F.col("range")))
    return df


def open_at(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Carry-in: of each border (range, key) the rules (prefix, level, item) before it that are still open."""
    starts = keys.select("range", "key", F.explode(F.sequence(F.lit(0), F.length("key"))).alias("n")).select("range", F.expr("substring(key, 1, n)").alias("prefix"))
    return starts.join(few(rules), "prefix").select("range", "prefix", "level", "item")


def sweep(points: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """points (key, rest, ...) with `stack`: of each level the last rule (prefix, item) passed, by rising level.

    rules: (prefix, level, item), one row for each prefix. If rules of one level are never nested,
    then the last one passed is the only one of its level that can be open: between a rule and a key
    within it all keys begin with its prefix. points' column `rest` goes after the key in the order,
    so that one key's points can spread over ranges; columns `keep` are kept.
    """
    spark, none = points.sparkSession, F.lit(None)
    ordered = points.select(F.concat("key", "rest").alias("key"), *keep)
    cuts = borders(ordered.select("key"))
    levels = sorted(r["level"] for r in rules.select("level").distinct().collect())
    marks = range_of(rules.withColumn("key", F.col("prefix")), cuts).select("range", "prefix", "level", "item")
    if cuts:
        marks = marks.unionByName(open_at(spark.createDataFrame(list(enumerate(cuts, 1)), "range int, key string"), rules))
    mark = F.struct("prefix", "item").alias("mark")
    marks = marks.select("range", F.col("prefix").alias("key"), "level", mark, *[none.cast(points.schema[c].dataType).alias(c) for c in keep])
    kind = marks.schema["mark"].dataType
    events = range_of(ordered, cuts).select("range", "key", none.cast("int").alias("level"), none.cast(kind).alias("mark"), *keep).unionByName(marks)
    passed = Window.partitionBy("range").orderBy("key", F.col("level").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    stack = F.array(*[F.last(F.when(F.col("level") == n, F.col("mark")), ignorenulls=True).over(passed) for n in levels]) if levels else F.array().cast(ArrayType(kind))
    return events.select("level", *keep, stack.alias("stack")).filter("level is null").select(*keep, F.array_compact("stack").alias("stack"))


def chains(rules: DataFrame) -> DataFrame:
    """(host_key, path, chain) from (host_key, path, verdict): the rules of a host that hold a path, itself included."""
    begins = rules.select("host_key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("host_key", "path", F.expr("substring(path, 1, n)").alias("held_by"))
    holders = rules.select("host_key", F.col("path").alias("held_by"), "verdict")
    return begins.join(holders, ["host_key", "held_by"]).groupBy("host_key", "path").agg(F.collect_list(F.struct(F.col("held_by").alias("path"), "verdict")).alias("chain"))


def best_of(path: Column, rules: Column, host: Column) -> Column:
    """The longest of rules (path, verdict) that the path begins with; null if none."""
    fits = F.filter(rules, lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(host) + F.length(r["path"])).alias("n"), F.length(host).alias("m"), F.concat(host, r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null where none fits), verdict.

    rules: (verdict, host, path); a null path is an empty one, a rule without a host is ignored, and
    of rules with the same host and path block beats allow. The rule with the longest host and path
    together wins, then the longer host. Null urls and urls without :// have an empty host and path,
    which no rule fits. Repeated rows stay; urls of any length are read whole; other columns are not
    read; without rules every verdict is the default, and an empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    named = durable(pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")).withColumn("row", F.monotonically_increasing_id()))
    one = rules.filter("host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    one = durable(one.withColumn("host_key", host_key(F.col("host"))))
    sizes = one.groupBy("host_key", "host").agg(F.count("*").alias("n"))
    short = one.join(sizes.filter(F.col("n") <= MOST_PATHS).select("host_key"), "host_key", "left_semi").groupBy("host_key").agg(F.collect_list(F.struct("path", "verdict")).alias("paths"))
    labels = F.size(F.split("host_key", r"\.")).alias("level")
    hosts = durable(sizes.join(short, "host_key", "left").select(F.col("host_key").alias("prefix"), labels, F.struct("host", "paths").alias("item")))
    key = host_key(F.col("host"))
    swept = sweep(named.withColumn("key", key).withColumn("rest", F.hex(F.xxhash64("row"))), hosts, ["row", "page_id", "host", "path"])
    open_ = F.filter("stack", lambda r: F.startswith(key, r["prefix"]))
    best = F.array_max(F.transform(open_, lambda r: best_of(F.col("path"), r["item"]["paths"], r["item"]["host"])))
    crowded = hosts.filter("item.paths is null").select(F.col("prefix").alias("host_key"))
    if crowded.limit(1).count():
        swept = durable(swept)
        asked = swept.select("row", "path", F.explode(F.filter(open_, lambda r: r["item"]["paths"].isNull())).alias("r"))
        far = _by_path(asked.select("row", "path", F.col("r.prefix").alias("host_key"), F.col("r.item.host").alias("rule_host")), one.join(few(crowded), "host_key", "left_semi"))
        swept, best = swept.join(far, "row", "left"), F.greatest(best, F.col("far"))
    return swept.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _by_path(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, far): the best of the crowded hosts' rules, from (row, path, host_key, rule_host), by a sweep of paths.

    Here a rule's item is the chain of rules that hold it, and all have one level: what is still
    open is in the chain of the last rule passed.
    """
    whole = F.concat(F.lpad(F.length("host_key").cast("string"), 10, "0"), "host_key", "path")  # no host's key begins another's
    marks = durable(chains(rules).select(whole.alias("prefix"), F.lit(0).alias("level"), F.struct("host_key", "chain").alias("item")))
    swept = sweep(asked.withColumn("key", whole).withColumn("rest", F.hex(F.xxhash64("row"))), marks, ["row", "path", "host_key", "rule_host"])
    last = F.try_element_at("stack", F.lit(1))["item"]
    chain = F.when(last["host_key"] == F.col("host_key"), last["chain"])
    return swept.groupBy("row").agg(F.max(best_of(F.col("path"), chain, F.col("rule_host"))).alias("far"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages)
SELECT page_id, c.host, c.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN LATERAL (
  SELECT rules.host || rules.path AS rule, verdict FROM rules
  WHERE (c.host = rules.host OR ends_with(c.host, '.' || rules.host)) AND starts_with(c.path, rules.path)
  ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC LIMIT 1) r ON true
"""
