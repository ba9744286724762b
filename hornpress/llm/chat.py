"""Chat formatting: transcripts to turns by a hidden Markov model.

A line's hidden state is its speaker's role and whether a turn begins with it. What is observed is
the line's speaker marker, if any, and its look. Viterbi finds the best states of a whole
conversation, however long: every part of it becomes a max-plus matrix over states, matrices are
multiplied in runs of RUN, runs again in runs, and the states at the ends of runs are then found
from the top down. Scores are whole numbers, so that any grouping gives the same path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hornpress.llm.common import durable, lean, schema, skew_join, spill_table, table, text_of

ROLES = ("system", "user", "assistant")
#: State 2r begins a turn of role r, state 2r + 1 continues it.
STATES = 2 * len(ROLES)
OUT, ALL = STATES, STATES + 1
#: Log probability of what can't be; sums of it stay whole 64-bit numbers.
NEVER = -(1 << 40)
NAMES = {"system": ("system", "sys", "instruction", "instructions"), "user": ("user", "human", "question", "q", "customer", "me"), "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent")}
#: Possessive, as no class holds what can follow it: a line is read once, whatever its length.
MARKER = re.compile(r"^\s*+[\[<(*#_]*+\s*+(" + "|".join(sorted((n for v in NAMES.values() for n in v), key=len, reverse=True)) + r")\s*+[\])*_]*+\s*+[:>]\s?[*_]*\s?", re.IGNORECASE)
ROLE_OF = {n: r for r, role in enumerate(ROLES) for n in NAMES[role]}
#: Observations: marker (none or a role) x blank, short, middle or long line x question or not.
OBSERVED = (len(ROLES) + 1) * 4 * 2
RUN = 256
SCALE = 1 << 16
#: Conversations that the model is fitted on, at most, and parts of one of them.
SAMPLE, SAMPLE_PARTS = 2000, 64

Batches = Iterator[pa.RecordBatch]


def observe(line: str) -> tuple[int, int]:
    """Observation of a line, and where its text begins after the marker."""
    found = MARKER.match(line)
    role, start = (ROLE_OF[found[1].lower()] + 1, found.end()) if found else (0, 0)
    rest = line[start:].strip()
    length = 0 if not rest else 1 if len(rest) < 40 else 2 if len(rest) < 160 else 3
    return (role * 4 + length) * 2 + rest.endswith("?"), start


class Hmm:
    """Whole-number log probabilities: step (ALL x ALL) and emit (ALL x OBSERVED). OUT stands before a conversation."""

    def __init__(self, step: np.ndarray, emit: np.ndarray) -> None:
        self.step, self.emit = step, emit

    def matrix(self, seen: list[int]) -> np.ndarray:
        """Best score from a state before the lines to a state at the last of them."""
        m = self.step + self.emit[:, seen[0]]
        for o in seen[1:]:
            m = times(m, self.step + self.emit[:, o])
        return m

    def path(self, seen: list[int], before: int = OUT, end: int = -1) -> list[int]:
        """Best states of lines, given the state before them and at the last (-1: free)."""
        score = self.step[before] + self.emit[:, seen[0]]
        back = []
        for o in seen[1:]:
            reach = score[:, None] + self.step
            back.append(reach.argmax(axis=0))
            score = reach.max(axis=0) + self.emit[:, o]
        states = [int(score.argmax()) if end < 0 else end]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def fitted(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Hmm:
    """From counts, each raised a little so that no role or observation is impossible."""

    def logs(counts: np.ndarray, more: float) -> np.ndarray:
        p = counts + more
        return np.round(np.log(p / p.sum(axis=-1, keepdims=True)) * SCALE).astype(np.int64)

    known_start, known_step, known_emit = prior()
    moves, seen = np.full((ALL, ALL), NEVER), np.full((ALL, OBSERVED), NEVER)
    moves[:STATES, :STATES] = logs(step + known_step, 0.01)
    moves[OUT, :STATES] = logs(start + known_start, 0.01)
    seen[:STATES] = logs(emit + known_emit, 0.01)
    return Hmm(moves, seen)


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One observation's worth of what markers mean, for states that the sample lacks."""
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, OBSERVED))
    start[::2] = 1
    for r in range(len(ROLES)):
        step[2 * r, 2 * r + 1] = step[2 * r + 1, 2 * r + 1] = 1
        step[2 * r : 2 * r + 2, [2 * q for q in range(len(ROLES)) if q != r]] = 0.5
        marked = np.arange(OBSERVED) // 8
        emit[2 * r, marked == r + 1] = 0.25
        emit[2 * r + 1, marked == 0] = 0.25
    return start, step, emit


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def _matrices(hmm: Hmm) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        lean()
        for b in batches:
            flat = [hmm.matrix([observe(x)[0] for x in t.as_py().split("\n")]).ravel() for t in b["text"]]
            m = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)), ALL * ALL).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["conv"], b["turn"], b["h"], m], names=["conv", "turn", "h", "m"])

    return run


def _children(row: pa.Scalar) -> list[np.ndarray]:
    return [np.array(c["m"], np.int64).reshape(ALL, ALL) for c in row.as_py()]


def _products(batches: Batches) -> Batches:
    """Runs of matrices, multiplied in order."""
    for b in batches:
        out = []
        for row in b["children"]:
            first, *others = _children(row)
            for m in others:
                first = times(first, m)
            out.append(first.ravel().tolist())
        yield pa.RecordBatch.from_arrays([b["conv"], b["at"], pa.array(out, pa.list_(pa.int64()))], names=["conv", "at", "m"])


def _ends(batches: Batches) -> Batches:
    """Best states at the end of each child of a run, given those before and at the end of the run."""
    for b in batches:
        out = []
        for row, before, end in zip(b["children"], b["before"].to_pylist(), b["end"].to_pylist(), strict=True):
            children = _children(row)
            enter = children[0][before]
            back = []
            for m in children[1:]:
                reach = enter[:, None] + m
                back.append(reach.argmax(axis=0))
                enter = reach.max(axis=0)
            states = [int(enter.argmax()) if end < 0 else end]
            for step in reversed(back):
                states.append(int(step[states[-1]]))
            states = states[::-1]
            out.append([{"before": p, "end": e} for p, e in zip([before, *states[:-1]], states, strict=True)])
        yield pa.RecordBatch.from_arrays([b["conv"], b["children"], pa.array(out, pa.list_(pa.struct([("before", pa.int32()), ("end", pa.int32())])))], names=["conv", "children", "ends"])


def _parsed(hmm: Hmm) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        lean()
        for b in batches:
            roles, begun, rendered, lines = [], [], [], []
            for text, before, end in zip(b["text"].to_pylist(), b["before"].to_pylist(), b["end"].to_pylist(), strict=True):
                split = text.split("\n")
                seen = [observe(x) for x in split]
                states = hmm.path([o for o, _ in seen], before, end)
                opens = [s % 2 == 0 or (before == OUT and not i) for i, s in enumerate(states)]
                roles.append([ROLES[s // 2] for s in states])
                begun.append(sum(opens))
                lines.append(len(split))
                rendered.append("".join((f"<|{ROLES[s // 2]}|>\n{x[at:]}\n" if o else f"{x}\n") for x, (_, at), s, o in zip(split, seen, states, opens, strict=True)))
            yield pa.RecordBatch.from_arrays([b["conv"], b["turn"], pa.array(lines, pa.int64()), pa.array(begun, pa.int64()), pa.array(roles, pa.list_(pa.string())), pa.array(rendered, pa.string())], names=["conv_id", "part", "n_lines", "begun", "roles", "rendered"])

    return run


def _placed(each: DataFrame) -> DataFrame:
    """each (conv, turn, h, ...) with `at`: a part's place in its conversation, from 0.

    Parts are sorted by ranges; a task's share of a conversation is counted, and shares add up.
    """
    ranged = each.repartitionByRange("conv", "turn", "h").sortWithinPartitions("conv", "turn", "h")
    row = spill_table(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row", 33)))
    shares = row.groupBy("conv", "task").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = shares.select("conv", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return row.join(base, ["conv", "task"]).withColumn("at", F.col("row") + F.col("base")).drop("row", "task", "base")


def _best_ends(parts: DataFrame) -> DataFrame:
    """(key, degree, before, end) of every part, from (conv, turn, h, m, degree)."""
    level = spill_table(_placed(parts))
    reach = level.agg(F.max("at")).first()[0]
    if reach is None:
        return parts.select(F.struct("conv", "turn", "h").alias("key"), "degree", F.lit(OUT).alias("before"), F.lit(-1).alias("end"))

    def runs(level: DataFrame) -> DataFrame:
        """A level's matrices in order, by run: RUN at most."""
        child = F.struct("at", "h", "m", "turn", "degree")
        return level.groupBy("conv", F.floor(F.col("at") / RUN).cast("long").alias("run")).agg(F.array_sort(F.collect_list(child)).alias("children")).withColumnRenamed("run", "at")

    levels = []
    while True:
        levels.append(durable(runs(level)))
        reach //= RUN
        if not reach:
            break
        product = levels[-1].mapInArrow(_products, schema(levels[-1], ["conv"], "at long, m array<long>"))
        level = product.select("conv", "at", F.lit(0).cast("long").alias("h"), "m", F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("degree"))
    known = levels[-1].select("conv", "children", F.lit(OUT).alias("before"), F.lit(-1).alias("end"))
    for deeper in [*reversed(levels[:-1]), None]:
        ends = known.mapInArrow(_ends, schema(known, ["conv", "children"], "ends array<struct<before: int, end: int>>"))
        each = ends.select("conv", F.explode(F.arrays_zip("children", "ends")).alias("x")).select("conv", "x.children.*", "x.ends.before", "x.ends.end")
        if deeper is not None:
            known = deeper.join(each.select("conv", "at", "before", "end"), ["conv", "at"]).select("conv", "children", "before", "end")
    return each.select(F.struct("conv", "turn", "h").alias("key"), "degree", "before", "end")


def parse(parts: DataFrame, hmm: Hmm, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per row of parts: conv_id, part, n_lines, begun, roles (of each line), rendered.

    A conversation's transcript comes in one or more parts, in the order of order_col (whole
    numbers), then of a hash of the text. Rows that are equal in all three are one part, and each
    gets its result. Rows without an id or an order are conversations of their own. A null text is
    an empty line. Other columns are not read.

    rendered: a header line for each turn that begins in the part, and the lines without markers.
    """
    text = text_of(text_col)
    df = parts.select(F.col(id_col).alias("conv"), F.col(order_col).cast("long").alias("turn"), F.xxhash64(text).alias("h"), text.alias("text"))
    alone = F.col("conv").isNull() | F.col("turn").isNull()
    matrices = df.filter(~alone).mapInArrow(_matrices(hmm), schema(df, ["conv"], "turn long, h long, m array<long>"))
    each = spill_table(matrices.groupBy("conv", "turn", "h").agg(F.first("m").alias("m"), F.count("*").alias("degree")))
    ends = spill_table(_best_ends(each))
    joined = skew_join(df.filter(~alone).withColumn("key", F.struct("conv", "turn", "h")), ends, "key", "degree").select("conv", "turn", "text", "before", "end")
    free = df.filter(alone).select("conv", "turn", "text", F.lit(OUT).alias("before"), F.lit(-1).alias("end"))
    out = StructType([StructField("conv_id", df.schema["conv"].dataType), *StructType.fromDDL("part long, n_lines long, begun long, roles array<string>, rendered string").fields])
    return joined.unionByName(free).mapInArrow(_parsed(hmm), out)


def _counts(batches: Batches) -> Batches:
    """Labelled parts (conv, turn, role, text) of whole conversations, in order, to what an HMM counts."""
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, OBSERVED))
    last: tuple = (None, None)
    for b in batches:
        for conv, role, text in zip(b["conv"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            r = 2 * ROLES.index(role)
            for i, line in enumerate(text.split("\n")):
                state = r + (i > 0)
                if i or last[0] == conv:
                    step[last[1], state] += 1
                else:
                    start[state] += 1
                emit[state, observe(line)[0]] += 1
                last = (conv, state)
    yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (start, step, emit)], names=["start", "step", "emit"])


def train(parts: DataFrame, sample: int = SAMPLE) -> Hmm:
    """From labelled parts (conv_id, turn, role, text): the first `sample` conversations by a hash of their id.

    Parts without a known role, an id or an order, and parts after a conversation's first
    SAMPLE_PARTS, are not used. Without any part the prior alone is the model.
    """
    labelled = parts.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    chosen = labelled.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    first = Window.partitionBy("conv_id").orderBy("turn", F.xxhash64(text_of()))
    some = labelled.join(F.broadcast(chosen), "conv_id").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE_PARTS)
    some = some.select(F.col("conv_id").alias("conv"), "turn", "role", text_of().alias("text"))
    counts = some.repartition("conv").sortWithinPartitions("conv", "turn").mapInArrow(_counts, "start array<double>, step array<double>, emit array<double>").collect()
    total = [sum((np.array(c[k]) for c in counts), np.zeros(n)) for k, n in (("start", STATES), ("step", STATES * STATES), ("emit", STATES * OBSERVED))]
    return fitted(total[0], total[1].reshape(STATES, STATES), total[2].reshape(STATES, OBSERVED))


def as_transcript(turns: DataFrame) -> DataFrame:
    """turns with a speaker marker before each text: one of several styles, or in an eighth of the turns none.

    The style follows from a hash of conversation and turn. Null and unknown roles have no marker;
    a null text is an empty one; other columns stay as they are.
    """
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id", "turn"), F.lit(8)) + 1
    marks = {
        "system": ["System: ", "SYSTEM: ", "[system]: ", "Instructions: ", "**System:** ", "System> ", "system: ", ""],
        "user": ["User: ", "Human: ", "USER: ", "Q: ", "[user]: ", "**User:** ", "me> ", ""],
        "assistant": ["Assistant: ", "AI: ", "Bot: ", "A: ", "[assistant]: ", "**Assistant:** ", "assistant> ", ""],
    }
    mark = F.coalesce(*[F.when(F.col("role") == r, F.element_at(F.array(*map(F.lit, m)), style.cast("int"))) for r, m in marks.items()], F.lit(""))
    return turns.withColumn("text", F.concat(mark, text_of()))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcripts, and parsed: conv_id, part, n_lines, begun, first_role, roles, rendered_sha256."""
    parts = as_transcript(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    parsed = parse(parts.drop("role"), train(parts))
    return parsed.select("conv_id", "part", "n_lines", "begun", F.element_at("roles", 1).alias("first_role"), F.concat_ws(",", "roles").alias("roles"), F.sha2("rendered", 256).alias("rendered_sha256"))
