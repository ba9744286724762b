"""Compress a base folder: python -m hornpress IN OUT [options]."""

from __future__ import annotations

import argparse
import signal
import time
from threading import Event, current_thread, main_thread

from pyspark.sql import SparkSession

from hornpress.functions.scores import metric
from hornpress.plans import estimate
from hornpress.plans.compress import compress
from hornpress.plans.search import Config, chosen_targets, find_rule
from hornpress.sources import readers, writers


def _share(text: str) -> float:
    if not 0 <= (x := float(text)) <= 1:
        raise argparse.ArgumentTypeError(f"{text} is not from 0 to 1")
    return x


def parsed(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="hornpress", description="Compress a relational base by Horn rules.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-b", "--beam", type=int, default=5)
    p.add_argument("-m", "--metric", default="tau", help="tau (compression ratio), delta (capacity) or h (information gain)")
    p.add_argument("-f", "--coverage", type=_share, default=0.05, help="rules of no more coverage are left alone")
    p.add_argument("-c", "--constants", type=_share, default=0.25, help="least share of a column for a constant to be tried")
    p.add_argument("-p", "--stop", type=_share, default=1.0, help="a rule of this ratio ends a search")
    p.add_argument("-o", "--observe", type=float, default=0.0, help="from 1: search by estimates, evaluating so many times the beam")
    p.add_argument("-t", "--relations", type=int, default=None, help="only the first so many relations")
    p.add_argument("-x", "--block", action="append", default=[], help="a relation for which no rules are searched")
    p.add_argument("-s", "--seconds", type=float, default=None, help="time for each rule")
    p.add_argument("-v", "--validate", action="store_true", help="rebuild the base and compare")
    got = p.parse_args(args)
    if got.beam < 1:
        p.error("the beam is at least 1")
    return got


def main(args: list[str] | None = None) -> int:
    a = parsed(args)
    spark = SparkSession.builder.appName("hornpress").getOrCreate()
    stop = Event()
    # an interrupt ends the search, not the run: rules found so far are kept and written
    before = signal.signal(signal.SIGINT, lambda *_: stop.set()) if current_thread() is main_thread() else None
    began = time.monotonic()
    kb = readers.kb_folder(spark, a.input)
    loaded = 1000 * (time.monotonic() - began)
    config = Config(a.beam, metric(a.metric), a.coverage, a.constants, a.stop, a.seconds, lambda: not stop.is_set(), a.observe)

    def by_estimate(scorer, pred, pruner):  # noqa: ANN001, ANN202
        return estimate.find_rule_by(scorer, pred, pruner, estimate.by_estimate)

    done = compress(kb, config, chosen_targets(kb, a.relations, tuple(a.block)), find=by_estimate if a.observe >= 1 else find_rule)
    if before is not None:
        signal.signal(signal.SIGINT, before)
    done.stats.ms["load"] = loaded
    with done.stats.timed("dump"):
        writers.compressed(done, a.output)
    for s in done.rules:
        print(f"{s.rule}  +{s.eval.pos:g} -{s.eval.neg:g} tau {s.eval.tau:.3f}")
    done.report().show(truncate=False)
    same = not a.validate or done.is_lossless()
    done.counters().show(truncate=False)
    if a.validate:
        print("The rebuilt base equals the original." if same else "The rebuilt base differs!")
        return int(not same)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
