"""Knowledge bases: named relations of integer-coded tuples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.operators import numeration as nm
from hornpress.operators import tables as tb


@dataclass(frozen=True)
class Relation:
    """A set of tuples, and those of them that rules have derived so far."""

    name: str
    arity: int
    df: DataFrame
    entailed: DataFrame | None = None

    @staticmethod
    def of(name: str, df: DataFrame) -> Relation:
        t = tb.as_table(df)
        return Relation(name, tb.arity(t), t)

    @property
    def cols(self) -> list[str]:
        return tb.names(self.arity)

    @property
    def flagged(self) -> DataFrame:
        """Rows with whether they are entailed."""
        if self.entailed is None:
            return self.df.withColumn("entailed", F.lit(False))
        marks = self.entailed.select(*self.cols).distinct().withColumn("mark", F.lit(True))
        return self.df.join(marks, self.cols, "left").withColumn("entailed", F.coalesce("mark", F.lit(False))).drop("mark")

    def entail(self, rows: DataFrame) -> Relation:
        """rows that the relation holds become entailed."""
        new = tb.members(rows.select(*self.cols), self.df)
        return Relation(self.name, self.arity, self.df, new.distinct() if self.entailed is None else tb.union_of(self.entailed, new))

    def unentail(self, rows: DataFrame) -> Relation:
        return self if self.entailed is None else Relation(self.name, self.arity, self.df, tb.absent(self.entailed, rows.select(*self.cols)))

    def newly(self, rows: DataFrame) -> DataFrame:
        """rows of the relation that are not entailed yet."""
        found = tb.members(rows.select(*self.cols).distinct(), self.df)
        return found if self.entailed is None else tb.absent(found, self.entailed)

    def split(self) -> tuple[DataFrame, DataFrame]:
        """(entailed, others)."""
        if self.entailed is None:
            return self.df.limit(0), self.df
        return tb.members(self.df, self.entailed), tb.absent(self.df, self.entailed)


@dataclass(frozen=True)
class Kb:
    """Relations in order; constants are 1 to n, n the highest number in use."""

    name: str
    relations: dict[str, Relation]
    n: int
    numeration: DataFrame | None = field(default=None, compare=False)
    #: Relations by number, None where one was deleted; empty if numbers are places.
    slots: tuple[str | None, ...] = ()

    @staticmethod
    def of(name: str, relations: dict[str, DataFrame], n: int | None = None, numeration: DataFrame | None = None) -> Kb:
        made = {k: Relation.of(k, df) for k, df in relations.items()}
        return Kb(name, made, highest(made.values()) if n is None else n, numeration)

    @staticmethod
    def from_names(name: str, relations: dict[str, DataFrame]) -> Kb:
        """From tables of strings: every distinct string is a constant, numbered in order."""
        cells = reduce(DataFrame.unionByName, (df.select(F.explode(F.array(*df.columns)).alias("name")) for df in relations.values()))
        numeration = nm.numbered(cells).persist()
        n = numeration.count()
        coded = {k: nm.encode(df.dropna(), numeration, n) for k, df in relations.items()}
        return Kb.of(name, coded, n, numeration)

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.relations.values())).df.sparkSession

    @property
    def schema(self) -> list[tuple[str, int]]:
        return [(r.name, r.arity) for r in self.relations.values()]

    def __getitem__(self, name: str) -> Relation:
        return self.relations[name]

    def get(self, name: str) -> Relation | None:
        return self.relations.get(name)

    def has(self, name: str, *args: int) -> bool:
        r = self.get(name)
        return r is not None and r.arity == len(args) and not r.df.filter(tb.all_of([F.col(f"a{i}") == v for i, v in enumerate(args)])).isEmpty()

    def with_relation(self, r: Relation) -> Kb:
        return Kb(self.name, {**self.relations, r.name: r}, self.n, self.numeration)

    def persisted(self) -> Kb:
        for r in self.relations.values():
            r.df.persist()
        return self

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Rows of each relation, in one job."""
        counts = reduce(DataFrame.unionByName, (r.df.agg(F.count("*").alias("n")).select(F.lit(r.name).alias("rel"), "n") for r in self.relations.values()))
        return {r["rel"]: r["n"] for r in counts.collect()}

    @cached_property
    def colvals(self) -> DataFrame:
        """(rel, col, val, cnt): how often each value is in each column."""
        cells = [r.df.select(F.lit(r.name).alias("rel"), F.posexplode(F.array(*r.cols)).alias("col", "val")) for r in self.relations.values()]
        return reduce(DataFrame.unionByName, cells).groupBy("rel", "col", "val").agg(F.count("*").alias("cnt")).persist()

    def promising(self, share: float = 0.25) -> DataFrame:
        """(rel, col, val, cnt) of values in at least ceil(rows * share) rows of their relation."""
        rows = self.colvals.groupBy("rel", "col").agg(F.sum("cnt").alias("rows"))
        return self.colvals.join(rows, ["rel", "col"]).filter(F.col("cnt") >= F.ceil(F.col("rows") * F.lit(share))).select("rel", "col", "val", "cnt")

    def promising_constants(self, share: float = 0.25) -> dict[tuple[str, int], list[int]]:
        """At most 1/share values of each column."""
        found: dict[tuple[str, int], list[int]] = {}
        for r in self.promising(share).orderBy("rel", "col", "val").collect():
            found.setdefault((r["rel"], r["col"]), []).append(r["val"])
        return found

    def totals(self) -> DataFrame:
        rows = reduce(DataFrame.unionByName, (r.df.agg(F.count("*").alias("n")) for r in self.relations.values()))
        return rows.agg(F.count("*").alias("relations"), F.sum("n").alias("records")).withColumn("constants", F.lit(self.n))

    def ids(self) -> dict[str, int]:
        """Each relation's number: its place, counting the slots that deleted relations left."""
        return {r: k for k, r in enumerate(self.slots or self.relations) if r in self.relations}

    # --- edits: each gives a new base --------------------------------------------------------

    def without_slot(self, name: str) -> Kb:
        """Without a relation, whose number stays free for the next relation that is made."""
        slots = [None if r == name else r for r in self.slots or self.relations]
        left = self.delete(name)
        return Kb(left.name, left.relations, left.n, left.numeration, tuple(slots))

    def create(self, name: str, arity: int) -> Kb:
        """An empty relation; one of the same name must have the same arity."""
        if (r := self.get(name)) is not None:
            if r.arity != arity:
                raise ValueError(f"{name} has arity {r.arity}, not {arity}")
            return self
        empty = self.spark.createDataFrame([], ", ".join(f"{c} int" for c in tb.names(arity)))
        made, slots = self.with_relation(Relation(name, arity, empty)), list(self.slots)
        if slots:  # the lowest number that is free
            slots[slots.index(None) if None in slots else len(slots) :] = [name, *(slots[slots.index(None) + 1 :] if None in slots else [])]
        return Kb(made.name, made.relations, made.n, made.numeration, tuple(slots))

    def load(self, name: str, df: DataFrame) -> Kb:
        if name in self.relations:
            raise ValueError(f"{name} is there already")
        made = Relation.of(name, df)
        return Kb(self.name, {**self.relations, name: made}, max(self.n, highest([made])), self.numeration)

    def delete(self, name: str) -> Kb:
        """Without a relation; constants that no other has are unmapped."""
        left = Kb(self.name, {k: r for k, r in self.relations.items() if k != name}, self.n, self.numeration)
        return left._forgetting()

    def add(self, name: str, rows: DataFrame) -> Kb:
        """Rows of numbers, or of names if there is a numeration; the relation is made if need be."""
        base, numeration = self.create(name, len(rows.columns)), self.numeration
        if numeration is not None and any(kind == "string" for _, kind in rows.dtypes):
            cells = rows.select(F.explode(F.array(*rows.columns)).alias("name"))
            numeration = nm.add_names(numeration, cells)
            rows = nm.encode(rows, numeration)
        r, t = base[name], tb.as_table(rows)
        made = Relation(name, r.arity, tb.union_of(r.df, t), r.entailed)
        return Kb(self.name, {**base.relations, name: made}, max(self.n, highest([made])), numeration)

    def remove(self, name: str, rows: DataFrame) -> Kb:
        """Without the given rows; constants that are left without a row are unmapped."""
        if (r := self.get(name)) is None:
            return self
        made = Relation(name, r.arity, tb.absent(r.df, tb.as_table(rows)))
        return Kb(self.name, {**self.relations, name: made}, self.n, self.numeration)._forgetting()

    def _used(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (tb.constants_of(r.df) for r in self.relations.values())).distinct()

    def _forgetting(self) -> Kb:
        if self.numeration is None:
            return self
        kept = self.numeration.join(self._used().withColumnRenamed("value", "num"), "num", "left_semi").select("name", "num")
        return Kb(self.name, self.relations, self.n, kept)

    def tidied(self) -> Kb:
        """Constants renumbered without gaps; empty relations stay, in order."""
        if self.numeration is None:
            return self
        moves = nm.compaction(self.numeration).persist()
        made = {k: Relation(k, r.arity, nm.remap(r.df, moves)) for k, r in self.relations.items()}
        numeration = nm.renumbered(self.numeration, moves)
        return Kb(self.name, made, numeration.count(), numeration)

    def same_as(self, other: Kb) -> bool:
        """Equal names, relations and numeration."""
        if self.name != other.name or self.schema != other.schema:
            return False
        if any(not tb.same_rows(r.df, other[k].df) for k, r in self.relations.items()):
            return False
        both = [k.numeration for k in (self, other)]
        return both[0] is both[1] or None not in both and tb.same_rows(both[0].select("name", "num"), both[1].select("name", "num"))


def highest(relations) -> int:  # noqa: ANN001
    """The highest constant of any relation, in one job."""
    tops = [r.df.agg(F.greatest(*[F.max(c) for c in r.cols], F.lit(0)).alias("top")) for r in relations]
    return (reduce(DataFrame.unionByName, tops).agg(F.max("top")).first()[0] or 0) if tops else 0
