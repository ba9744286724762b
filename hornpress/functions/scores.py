"""Scores of rules."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO, CAPACITY, GAIN = "tau", "delta", "h"
#: Symbols by which a score is chosen.
METRICS = {"τ": RATIO, "δ": CAPACITY, "h": GAIN, RATIO: RATIO, CAPACITY: CAPACITY}


def metric(symbol: str) -> str:
    """An unknown symbol is the compression ratio."""
    return METRICS.get(symbol, RATIO)


@dataclass(frozen=True)
class Eval:
    """pos: tuples newly derived and in the relation; all: tuples derived but those derived before."""

    pos: float
    all: float
    length: int
    parent_tau: float = 0.0
    parent_h: float = 0.0

    @property
    def neg(self) -> float:
        return self.all - self.pos

    @property
    def tau(self) -> float:
        cost = self.all + self.length
        return self.pos / cost if cost else 0.0

    @property
    def delta(self) -> float:
        return self.pos - self.neg - self.length

    @property
    def h(self) -> float:
        return self.parent_h + self.pos * (math.log(self.tau + 0.01) - math.log(self.parent_tau + 0.01))

    @property
    def h_simple(self) -> float:
        """pos * ln(1 + tau); minus infinity where nothing is derived."""
        return self.pos * math.log1p(self.tau) if self.pos and self.tau else -math.inf

    def h_of(self, parent: Eval) -> float:
        """Gain in the logarithm of precision."""
        if not (self.pos and self.all and parent.pos and parent.all):
            return -math.inf
        return self.pos * (math.log(self.pos / self.all) - math.log(parent.pos / parent.all))

    def h_total(self, parent: Eval, before: float = 0.0) -> float:
        """The gain over a rule and all rules on the way to it: `before` is the parent's own total."""
        return before + self.h_of(parent)

    @property
    def useful(self) -> bool:
        return self.delta > 0

    def value(self, name: str) -> float:
        return getattr(self, metric(name))


def tau(pos: Column, every: Column, length: Column) -> Column:
    cost = every + length
    return F.when(cost == 0, F.lit(0.0)).otherwise(pos.cast("double") / cost)


def delta(pos: Column, every: Column, length: Column) -> Column:
    return pos - (every - pos) - length


def gain(pos: Column, ratio: Column, parent_ratio: Column, parent_gain: Column) -> Column:
    return parent_gain + pos * (F.log(ratio + 0.01) - F.log(parent_ratio + 0.01))
