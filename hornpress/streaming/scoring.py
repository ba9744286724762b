"""A fixed set of rules over arriving tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hornpress.operators import tables as tb
from hornpress.operators.kb import Kb
from hornpress.plans import compile as cp
from hornpress.plans.rules import Rule


def explained(batch: DataFrame, kb: Kb, rules: list[Rule]) -> DataFrame:
    """Arriving tuples of one relation, with whether the rules derive them from the base."""
    cols = batch.columns
    rows = batch.distinct()
    # of each rule only what concerns the batch: its rows are looked up in the bodies' bindings
    known = tb.union_of(*(cp.matched_head(r, kb, rows).select(*cols) for r in rules)) if rules else batch.limit(0)
    return batch.join(known.withColumn("by_rule", F.lit(True)), cols, "left").withColumn("by_rule", F.coalesce("by_rule", F.lit(False)))


def follow(stream: DataFrame, kb: Kb, rules: list[Rule], out: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's tuples, marked, to a Parquet folder; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        explained(batch, kb, rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
