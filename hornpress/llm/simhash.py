"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at most RADIUS bits, then
in some segment they differ in few: with m segments and RADIUS = s*m + a, in at most s bits of one
of the first a + 1 segments or in at most s - 1 bits of another. So each fingerprint stands in a
table under its segments' values, asks the table for the small Hamming ball around each segment
value, and complete distances are verified for what it fetches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornpress.llm.common import durable, few, forget, lean, record, schema, skew_join, spill_table, table, text_of

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 1 << 16
#: Pairs of a bucket beyond which links are searched row by row, keeping components only.
DENSE_PAIRS = 1 << 16
PAIRS_AT_ONCE = 1 << 21
#: Table entries of a bucket beyond which it is cut into a grid of cells.
CELL = 4096
#: Lines of a grid's side, at most: a cell's number has 24 bits.
SIDE = 4094
#: Rough costs, in nanoseconds, of a row that is shuffled and of a pair that is compared.
ROW_NS, PAIR_NS = 1500, 25


def fingerprint(text: str | None) -> int:
    """Of lower-cased 4-word shingles, repeats included; 0 for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, COUNT_AT_ONCE):
        top = min(n, at + COUNT_AT_ONCE)
        h = np.fromiter((digest(b" ".join(w[i : i + SHINGLE]), SEED) for i in range(at, top)), dtype=">u8", count=top - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    for b in batches:
        f = np.fromiter((fingerprint(t.as_py()) for t in b["text"]), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], pa.array(f.view(np.int64))], names=["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): a hash of the text, and its fingerprint as a signed 64-bit number."""
    text = text_of(text_col)
    df = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return df.mapInArrow(_fingerprints, schema(df, ["doc_id"], "h long, fp long"))


def layout(segments: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(shift, bits, ball radius) of each segment; a radius of -1 needs no lookup."""
    s, a = divmod(radius, segments)
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    shifts = [64 - sum(widths[: k + 1]) for k in range(segments)]
    return [(shifts[k], widths[k], s if k <= a else s - 1) for k in range(segments)]


def ball(bits: int, radius: int) -> list[int]:
    """Masks of up to `radius` set bits, 0 first."""
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


def best_segments(nodes: int) -> int:
    """2 to 4 segments: more mean smaller balls and thus fewer rows, but shorter keys and thus more pairs."""

    def cost(m: int) -> float:
        probes = [(len(ball(bits, r)), bits) for _, bits, r in layout(m)]
        return nodes * sum(n for n, _ in probes) * ROW_NS + sum(nodes * nodes * n / 2.0**bits for n, bits in probes) * PAIR_NS

    return min((2, 3, 4), key=cost)


class Forest:
    """Links of a task, as a spanning forest of bounded size."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := self.root(x)) != (q := self.root(y)):
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))

    def flush(self) -> pa.RecordBatch:
        a = np.array(self.links, dtype=np.int64).reshape(-1, 2)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= RADIUS


def _dense(held: np.ndarray, asks: np.ndarray, forest: Forest) -> None:
    """Links between a large bucket's table entries and its askers, without listing all pairs."""
    nodes = np.unique(np.concatenate([held, asks]))
    group = np.arange(len(nodes))
    at = np.searchsorted(nodes, asks)
    for i, x in zip(np.searchsorted(nodes, held).tolist(), held, strict=True):
        met = at[_near(asks, x[None])]
        own, others = group[i], group[met]
        if (fresh := others != own).any():
            labels, first = np.unique(others[fresh], return_index=True)
            forest.add(np.full(len(labels), x), nodes[met[fresh][first]])
            group[np.isin(group, labels)] = own


def _link_groups(key: np.ndarray, fp: np.ndarray, kind: np.ndarray, forest: Forest) -> None:
    """Rows by key, table entries (kind 1 or 3) first; askers are kind 2 or 3."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    held = np.add.reduceat((kind != 2).astype(np.int64), starts)
    asks = np.add.reduceat((kind != 1).astype(np.int64), starts)
    for s, e in zip(starts[dense := held * asks > DENSE_PAIRS], ends[dense], strict=True):
        _dense(fp[s:e][kind[s:e] != 2], fp[s:e][kind[s:e] != 1], forest)
    of = np.repeat(np.arange(len(starts)), ends - starts)
    rows = np.flatnonzero((kind != 1) & (held > 0)[of] & (ends - starts > 1)[of] & ~dense[of])
    n = held[of[rows]]
    cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS_AT_ONCE, n.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    for part in np.split(np.arange(len(rows)), cuts):
        if len(part):
            m = n[part]
            left = np.repeat(rows[part], m)
            right = np.repeat(starts[of[rows[part]]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            x, y = fp[left], fp[right]
            hit = _near(x, y) & (x != y)
            if hit.any():
                both = np.unique(np.stack([np.minimum(x[hit], y[hit]), np.maximum(x[hit], y[hit])]), axis=1)
                forest.add(both[0], both[1])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, kind, fp) to links; a key's rows may go over several batches."""
    forest, kept = Forest(), []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[c].to_numpy(zero_copy_only=False) for c in ("key", "fp", "kind")]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            _link_groups(*(np.concatenate([*(k[i] for k in kept), cols[i][:cut]]) for i in range(3)), forest)
            kept = []
        kept.append([c[cut:] for c in cols])
        if len(forest.up) > 1_000_000:
            yield forest.flush()
    if kept:
        _link_groups(*(np.concatenate([k[i] for k in kept]) for i in range(3)), forest)
    yield forest.flush()


def _grid(nodes: DataFrame, segments: list[tuple[Column, list[int]]], most: int) -> DataFrame:
    """(key, down, across): buckets of more than `most` entries or askers, and the lines they are cut into.

    segments: a segment's key and the masks of its ball. A bucket's askers are the entries of the
    buckets within the ball around its key. Only buckets of over most/ball entries are followed to
    their neighbours; the others of a ball add up to less than `most`. Buckets of many askers
    without entries have 0 lines down: nobody need ask them.
    """
    entries = nodes.select(F.explode(F.array(*[F.struct(k.alias("key"), F.lit(i).alias("segment")) for i, (k, _) in enumerate(segments)])).alias("x"))
    counts = spill_table(entries.groupBy("x.key", "x.segment").agg(F.count("*").alias("n")))
    near = []
    for i, (_, masks) in enumerate(segments):
        warm = counts.filter((F.col("segment") == i) & (F.col("n") > max(1, most // len(masks))))
        ball_of = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("key").bitwiseXOR(m))
        near.append(warm.select(F.explode(ball_of).alias("key"), "n"))
    asked = durable(reduce(DataFrame.unionByName, near).groupBy("key").agg(F.sum("n").alias("askers")).filter(F.col("askers") > most))
    if not asked.count():
        return asked.select("key", F.lit(0).alias("down"), F.lit(0).alias("across"))
    lines = lambda c: F.least(F.ceil(F.col(c) / most), F.lit(SIDE)).cast("int")
    cut = few(asked).join(counts.select("key", "n"), "key", "left")
    return durable(cut.select("key", F.coalesce(lines("n"), F.lit(0)).alias("down"), (lines("askers") + 1).alias("across")))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) from distinct fingerprints (fp): links of at most RADIUS bits that connect all that are so linked."""
    spark = nodes.sparkSession
    count = nodes.count()
    parts = layout(best_segments(count))
    used = [(k, at, bits, r) for k, (at, bits, r) in enumerate(parts) if r >= 0]

    def key(k: int, at: int, bits: int) -> Column:
        """Segment number, segment value, and 24 bits for the cell of a bucket's grid."""
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
        return F.shiftleft(value, 24) + F.lit(k << 58)

    def asks(k: int, at: int, bits: int, r: int) -> Column:
        masks = F.array(*[F.lit(m << 24).cast("long") for m in ball(bits, r)])
        return F.transform(masks, lambda m: F.struct(key(k, at, bits).bitwiseXOR(m).alias("key"), F.when(m == 0, 3).otherwise(2).alias("kind")))

    rows = nodes.select("fp", F.explode(F.concat(*[asks(*u) for u in used])).alias("x")).select("x.key", "x.kind", "fp")
    grid = _grid(nodes, [(key(k, at, bits), [m << 24 for m in ball(bits, r)]) for k, at, bits, r in used], max(CELL, 8 * max(count >> bits for _, bits, _ in parts)))
    if grid.count():
        entry, asker = (F.pmod(F.xxhash64("fp"), F.col(c)) for c in ("down", "across"))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.col("kind").alias("kind")))
        held = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: F.struct((entry * F.col("across") + i).alias("cell"), F.lit(1).alias("kind")))
        asked = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct((i * F.col("across") + asker).cast("long").alias("cell"), F.lit(2).alias("kind")))
        cells = F.when(F.col("down").isNull(), whole).when(F.col("down") > 0, F.when(F.col("kind") == 3, F.concat(held, asked)).otherwise(asked))
        rows = rows.join(few(grid), "key", "left").select("key", "fp", F.explode(cells).alias("c")).select((F.col("key") + F.col("c.cell")).alias("key"), "c.kind", "fp")
    return rows.repartition("key").sortWithinPartitions("key", F.col("kind") == 2).mapInArrow(_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component.

    Large and small stars in turn: every node's larger, then smaller, neighbours are tied to the
    smallest one, until only stars are left. Each round ends in a written table: a checkpoint would
    keep the constraints that the optimizer derives, which grow from round to round.
    """

    def tied(pairs: DataFrame) -> DataFrame:
        """pairs (u, v); with each the smallest v of its u."""
        mins = durable(pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree")))
        return skew_join(pairs, mins, "u", "degree")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = spill_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tied(both).filter("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        small = tied(durable(large))
        ties = small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        past, stars = stars, spill_table(ties.unionByName(small.select("u", F.col("low").alias("v"))).distinct())
        forget(past)
        was, now = now, state(stars)
        if was == now:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, fp, best) of each row: best (no_id, id, h) is the first of the row's component, null ids last."""
    prints = spill_table(fingerprints(docs, id_col, text_col))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "h")
    nodes = spill_table(prints.groupBy("fp").agg(F.min(first).alias("low"), F.count("*").alias("rows")))
    roots = durable(components(links(nodes.select("fp"))))
    known = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "low")
    lows = known.groupBy("root").agg(F.min("low").alias("best"), F.count("*").alias("degree"))
    named = skew_join(durable(known.select("fp", "root")), durable(lows), "root", "degree").select("fp", "best")
    of_print = spill_table(nodes.join(named, "fp", "left").select("fp", F.coalesce("best", "low").alias("best"), "rows"))
    return skew_join(prints, of_print, "fp", "rows").drop("rows")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (smallest doc_id reachable, itself included).

    A null or empty text has fingerprint 0, linked like any other. Null ids take part but are never
    the smallest, unless a component has no other. Repeated rows stay; texts of any length are read
    whole; other columns are not read. An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component.

    Rows are told apart by id and text: of a component the smallest id stays (null ids last), then
    the smallest hash of the text, and of rows that are equal in both the first by their JSON text.
    A row whose id another component's row has too is judged by its own text. Null texts are empty
    ones; columns can have any name; an empty table gives an empty one.
    """
    groups = spill_table(_grouped(docs, id_col, text_col).select("doc_id", "h", (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))).alias("first")))
    # the same id and text are in one component, so that all rows of a pair are first or none
    pairs = groups.groupBy("doc_id", "h", "first").agg(F.count("*").alias("n")).filter("not first or n > 1")
    judged = spill_table(pairs.select(F.col("doc_id").alias("judged_id"), F.col("h").alias("judged_h"), "first"))
    rec = docs.select(record(docs).alias("rec"))
    ident, h = F.col("rec").getField(id_col), F.xxhash64(F.coalesce(F.col("rec").getField(text_col).cast("string"), F.lit("")))
    met = rec.join(few(judged, 1_000_000), ident.eqNullSafe(F.col("judged_id")) & (h == F.col("judged_h")), "left").filter("first is null or first")
    once = met.filter("first is null").select("rec")
    if judged.filter("first").limit(1).count():
        order = Window.partitionBy("judged_id", "judged_h").orderBy(F.to_json("rec"))
        again = met.filter("first").withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("rec")
        once = once.unionByName(again)
    return once.select("rec.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
