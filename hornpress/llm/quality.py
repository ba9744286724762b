"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad, judged by its own features, those of the lines before and after it, and
the labels next to it. The chain is trained on a bounded sample of labelled documents, whose lines
all take the document's label. A document's quality is the mean of its lines' forward-backward
marginals, weighted by length and set against the sample's labels by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornpress.llm.common import lean, record, schema, table, text_of

#: Labelled documents that the model is fitted on, at most, and the most lines of one of them.
SAMPLE = 4000
SAMPLE_LINES = 1000
STEPS = 150
#: Bytes of text whose lines are scored together.
AT_ONCE = 4 << 20

UPPER, LOWER, DIGIT, SPACE, STOP, SYMBOL, END = range(7)
N_FEATURES = 13


def byte_classes() -> np.ndarray:
    lut = np.full(256, SYMBOL, np.uint8)
    lut[128:] = LOWER
    for chars, c in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"0123456789", DIGIT), (b" \t\r\x0b\x0c", SPACE), (b".,;:?'\"()-", STOP), (b"\n", END)):
        lut[list(chars)] = c
    return lut


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of every line, and the number of lines of each text (1 at least)."""
    raw = [t.encode("utf-8") for t in texts]
    flat = np.frombuffer(b"".join(r + b"\n" for r in raw), np.uint8)
    classes = byte_classes()[flat]
    ends = np.flatnonzero(classes == END)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    size = (ends - starts).astype(np.float64)
    count = [np.add.reduceat(classes == c, starts, dtype=np.int64).astype(np.float64) if len(starts) else np.zeros(0) for c in range(END)]
    lines, words, distinct, again = [], [], [], []
    for r in raw:
        seen: set[bytes] = set()
        parts = r.split(b"\n")
        lines.append(len(parts))
        for p in parts:
            w = p.split()
            words.append(len(w))
            distinct.append(len(set(w)))
            again.append(p in seen)
            seen.add(p)
    words, distinct = np.array(words, float), np.array(distinct, float)
    some, letters = np.maximum(size, 1), count[UPPER] + count[LOWER]
    last = np.where(size > 0, flat[np.maximum(ends - 1, 0)], 0)
    x = np.stack(
        [
            np.log1p(size),
            count[UPPER] / np.maximum(letters, 1),
            count[DIGIT] / some,
            count[SPACE] / some,
            count[STOP] / some,
            count[SYMBOL] / some,
            distinct / np.maximum(words, 1),
            np.log1p(words),
            letters / np.maximum(words, 1) / 10,
            np.array(again, float),
            (size == 0).astype(float),
            np.isin(last, list(b".!?")).astype(float),
            (classes[starts] == UPPER).astype(float) if len(starts) else np.zeros(0),
        ],
        axis=1,
    )
    return x, size, np.array(lines, np.int64)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its document (zeros at the ends), and 1."""
    first = np.cumsum(lines) - lines
    before, after = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    before[first], after[first + lines - 1] = 0, 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray
    curve: tuple[float, float]

    def score(self, texts: list[str]) -> np.ndarray:
        x, size, lines = line_features(texts)
        good = marginals(with_neighbours((x - self.mean) / self.scale, lines) @ self.weights, self.change, lines)[0]
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * logit(weighted(good, size, lines)) + self.curve[1], -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def weighted(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean marginal of each document, lines weighted by their length and one."""
    first, w = np.cumsum(lines) - lines, size + 1
    return np.add.reduceat(good * w, first) / np.add.reduceat(w, first) if len(lines) else np.zeros(0)


def marginals(unary: np.ndarray, change: np.ndarray, lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of each line to be good; of each document the expected label pairs (2 x 2), if asked for.

    unary: score of good over bad; change[i, j]: score of label j after i. Documents go in step,
    the longest first, so that those still running are always the first ones.
    """
    order = np.argsort(-lines, kind="stable")
    first, n = (np.cumsum(lines) - lines)[order], lines[order]
    running = np.searchsorted(-n, -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
    at = [first[:k] + t for t, k in enumerate(running)]
    fwd, bwd = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    own = np.stack([np.zeros(len(unary)), unary], axis=1)
    for t, i in enumerate(at):
        if t == 0:
            fwd[i] = own[i]
        else:
            p = fwd[i - 1]
            fwd[i] = np.logaddexp(p[:, :1] + change[0], p[:, 1:] + change[1]) + own[i]
            # the shift keeps long documents in range and cancels in the marginals
            fwd[i] -= fwd[i].max(axis=1, keepdims=True)
    for i in reversed(at[1:]):
        q = bwd[i] + own[i]
        b = np.logaddexp(q[:, :1] + change[:, 0], q[:, 1:] + change[:, 1])
        bwd[i - 1] = b - b.max(axis=1, keepdims=True)
    both = fwd + bwd
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    if not pairs:
        return good, None
    sums = np.zeros((len(lines), 2, 2))
    for t, i in enumerate(at[1:], 1):
        joint = fwd[i - 1][:, :, None] + change + (own[i] + bwd[i])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        sums[order[: running[t]]] += joint / joint.sum(axis=(1, 2), keepdims=True)
    return good, sums


def _ascend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def fit(x: np.ndarray, size: np.ndarray, lines: np.ndarray, quality: np.ndarray, penalty: float = 1e-3) -> Model:
    """From the lines of labelled documents; without both labels every document scores 0.5."""
    width = 3 * N_FEATURES + 1
    if not len(lines) or quality.min() == quality.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(width), np.zeros((2, 2)), (1.0, 0.0))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    wide = with_neighbours((x - mean) / scale, lines)
    label, share = np.repeat(quality, lines), 1 / np.repeat(lines, lines)
    kept = np.zeros((len(lines), 2, 2))
    kept[np.arange(len(lines)), quality, quality] = lines - 1

    def gradient(theta: np.ndarray) -> np.ndarray:
        w, change = theta[:width], theta[width:].reshape(2, 2)
        good, sums = marginals(wide @ w, change, lines, pairs=True)
        unary = wide.T @ ((label - good) * share)
        pair = ((kept - sums) / lines[:, None, None]).sum(axis=0)
        return np.concatenate([unary, pair.ravel()]) / len(lines) - penalty * theta

    theta = _ascend(gradient, width + 4, STEPS, 0.1)
    weights, change = theta[:width], theta[width:].reshape(2, 2)
    level = logit(weighted(marginals(wide @ weights, change, lines)[0], size, lines))

    def curve(t: np.ndarray) -> np.ndarray:
        off = quality - 1 / (1 + np.exp(-np.clip(t[0] * level + t[1], -30, 30)))
        return np.array([(off * level).mean(), off.mean()]) - penalty * t

    a, b = _ascend(curve, 2, 300, 0.05)
    return Model(mean, scale, weights, change, (max(float(a), 1e-3), float(b)))


def held_out(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(3)) == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, sizes = [], []
        for t in b["text"]:
            x, size, _ = line_features([t.as_py()])
            xs.append(x.astype("<f4").tobytes())
            sizes.append(size.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b["quality"], pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())], names=["quality", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted on at most `sample` labelled documents that aren't held out, the first by a hash of their id.

    Only features leave the executors, at most sample x SAMPLE_LINES lines of them. Labelled
    documents of more than SAMPLE_LINES lines are not sampled. Rows without a label or an id are not
    used, nor ids that are labelled both ways; of rows with the same id one text is used.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = agreed.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    short = rows.filter(F.length("text") - F.length(F.translate("text", "\n", "")) < SAMPLE_LINES)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = short.withColumn("nth", first).filter("nth = 1").select("quality", "text")
    got = one.mapInArrow(_features, "quality int, x binary, size binary").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    xs = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in got]
    if not xs:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = np.concatenate([np.frombuffer(r["size"], "<f4") for r in got]).astype(float)
    return fit(np.vstack(xs), size, np.array([len(x) for x in xs]), np.array([r["quality"] for r in got]))


def _score(model: Model, text_of_row: Callable[[pa.RecordBatch], pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A score beside a batch's first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            scores, some, length = [np.zeros(0)], [], 0
            for t in text_of_row(b):
                some.append(t.as_py() or "")
                length += len(some[-1])
                if length > AT_ONCE:
                    scores.append(model.score(some))
                    some, length = [], 0
            if some:
                scores.append(model.score(some))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores))], names=[b.schema.names[0], "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The score depends on the text alone. A null text is an empty one: one empty line. Ids may repeat
    or be null (not held out); other columns are not read.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    scored = df.mapInArrow(_score(model, lambda b: b["text"]), schema(df, ["doc_id"], "score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model predicts good.

    Each row is judged by its whole text alone: equal texts stay or go together, whatever their ids,
    nulls included. A null text is an empty one. Columns can have any name; an empty table gives an
    empty one.
    """
    at = docs.columns.index("text")
    rec = docs.select(record(docs).alias("rec"))
    return rec.mapInArrow(_score(model, lambda b: b["rec"].field(at)), schema(rec, ["rec"], "score double")).filter("score >= 0.5").select("rec.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
