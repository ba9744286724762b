"""Graphs as edge tables (src, dst): cycles and feedback vertices."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rounds that remove nodes without a way in or out before the edges left are counted, and how many one task solves.
TRIMS, ONE_TASK = 3, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a local master may do without one: its temporary folder is shared."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df computed once, as a table in the checkpoint folder. For loops: what the optimizer knows about a
    checkpoint grows from round to round, a table starts anew."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a written table; frames that read it are of no use afterwards."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def cyclic_core(edges: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int]:
    """Edges, and their number, that are left when nodes without a way in or out are removed again and
    again: until nothing goes, or in so many rounds."""
    core = written(edges.select("src", "dst").distinct())
    left = core.count()
    while left and rounds != 0:
        sources, ends = core.select(F.col("src").alias("node")).distinct(), core.select(F.col("dst").alias("node")).distinct()
        inner = sources.join(ends, "node", "left_semi")
        smaller = core.join(inner, core["src"] == inner["node"], "left_semi").join(inner, F.col("dst") == inner["node"], "left_semi")
        past, core = core, written(smaller)
        forget(past)
        now = core.count()
        if now == left:
            break
        left, rounds = now, None if rounds is None else rounds - 1
    return core, left


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, comp) by the smallest label among neighbours, with every label's own label looked up in each round."""
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("comp")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels["node"] == near["src"]).select("node", F.least("comp", "near").alias("low"))
        further = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        new = written(low.join(further, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("comp")))
        same = new.join(labels.withColumnRenamed("comp", "old"), "node").filter("comp <> old").isEmpty()
        forget(labels)
        labels = new
        if same:
            return labels


def strong_components(edges: list[tuple[str, str]]) -> list[set[str]]:
    """Those of more than one node or with a loop, without recursion."""
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edges):
        out[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    found = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, 0)]
        while work:
            node, at = work.pop()
            if at == 0:
                index[node] = low[node] = len(index)
                stack.append(node)
                held.add(node)
            elif (child := out[node][at - 1]) in held:
                low[node] = min(low[node], low[child])
            if at < len(out[node]):
                work.append((node, at + 1))
                if out[node][at] not in index:
                    work.append((out[node][at], 0))
            elif low[node] == index[node]:
                part = set()
                while node not in part:
                    part.add(top := stack.pop())
                    held.discard(top)
                if len(part) > 1 or node in out[node]:
                    found.append(part)
    return found


def feedback_vertices(edges: list[tuple[str, str]], part: set[str]) -> list[str]:
    """Nodes of a strong component without which it has no cycle: the one of the largest product of ways in
    and out first (of equal ones the smallest), then nodes that lost all ways in or all ways out go."""
    into: dict[str, set[str]] = {n: set() for n in part}
    out: dict[str, set[str]] = {n: set() for n in part}
    for a, b in edges:
        if a in part and b in part:
            out[a].add(b)
            into[b].add(a)

    def remove(n: str) -> set[str]:
        near = (into[n] | out[n]) - {n}
        for m in out.pop(n):
            into[m].discard(n) if m != n else None
        for m in into.pop(n):
            out[m].discard(n) if m != n else None
        return near

    weight = lambda n: -len(into[n]) * len(out[n])
    heap = [(weight(n), n) for n in part]
    heapq.heapify(heap)
    links, chosen = sum(map(len, out.values())), []
    while links:
        w, best = heapq.heappop(heap)
        if best not in out or w != weight(best):  # an entry of before
            continue
        chosen.append(best)
        todo = [best]
        while todo:
            n = heapq.heappop(todo)
            if n in out and (n == best or bool(into[n]) != bool(out[n])):
                links -= len(out[n]) + len(into[n]) - (n in out[n])
                for m in remove(n):
                    heapq.heappush(heap, (weight(m), m))
                    heapq.heappush(todo, m)
    return chosen


def cycle_breakers(edges: DataFrame) -> DataFrame:
    """(node, scc, feedback): nodes on cycles, the smallest node of their strong component, and whether they are
    chosen to break its cycles.

    Nodes that lie on no cycle are removed in a few rounds. If what is left has at most ONE_TASK
    edges, one task solves it; the time is linear in the edges but for the choice of vertices.
    Otherwise nodes go until only the cyclic core is left, whose weak components are independent of
    each other and solved one by one: such a component must fit a task.
    """
    core, left = cyclic_core(edges, TRIMS)
    if left <= ONE_TASK:
        labelled = core.select(F.lit("").alias("comp"), "src", "dst")
    else:
        core, _ = cyclic_core(core)
        labelled = core.join(weak_components(core), core["src"] == F.col("node")).select("comp", "src", "dst")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["src"], pdf["dst"], strict=True))
        rows = [(n, min(part), n in chosen) for part in strong_components(pairs) for chosen in [set(feedback_vertices(pairs, part))] for n in sorted(part)]
        return pd.DataFrame(rows, columns=["node", "scc", "feedback"])

    return labelled.groupBy("comp").applyInPandas(solve, "node string, scc string, feedback boolean")
