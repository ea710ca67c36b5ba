"""Experiments that can be stopped and taken up again: a result for each table, method and seed, each written once."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveline.frame import FeatureFrame
from sieveline.operators import report
from sieveline.operators.baselines import build_baseline
from sieveline.sources.results import RESULT_SCHEMA
from sieveline.sources.tables import CATALOGUE, Catalogue

from .config import budget, soft, strict
from .experiments import evaluate_method, select_k_nested
from .selector import Selector

_log = logging.getLogger(__name__)
KEYS = ("dataset", "method", "seed")
_COLUMNS = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]


@dataclass
class Outcome:
    """The results, which tables were loaded, and which weren't and why."""

    results: DataFrame
    loaded: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    ran: list[tuple[str, str, int]] = field(default_factory=list)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The results written so far; none if there is no such folder."""
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(path).select(*_COLUMNS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULT_SCHEMA)


def write_once(row: dict, spark: SparkSession, path: str) -> None:
    """Put one result into the folder of its keys, in place of what a run that was cut off may have left there."""
    one = spark.createDataFrame([row], RESULT_SCHEMA).coalesce(1)
    one.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*KEYS).parquet(path)


def missing(spark: SparkSession, path: str, datasets: Sequence[str], methods: Sequence[str], seeds: Sequence[int]) -> list[tuple[str, str, int]]:
    """Keys without a result, in the order of the arguments."""
    wanted = spark.createDataFrame([(d, m, s, i, j) for i, d in enumerate(datasets) for s in seeds for j, m in enumerate(methods)], "dataset string, method string, seed int, i int, j int")
    left = wanted.join(finished(spark, path).select(*KEYS), list(KEYS), "left_anti").orderBy("i", "seed", "j")
    return [(r["dataset"], r["method"], r["seed"]) for r in left.collect()]


def builder(method: str, k: int, p: int, resamples: int, causal: bool = False, refine: bool = False) -> Callable[[int], object]:
    """seed -> a model of the method; the proposed one goes softly by importances, or strictly by the Markov blanket."""
    if method != "Proposed":
        return lambda seed: build_baseline(method, k, seed)
    preset = strict if causal else soft
    return lambda seed: Selector(preset(k, p, resamples, seed, refine), artefacts=False)


def run_experiments(
    spark: SparkSession, names: Sequence[str], root: str, path: str, k: int | None = None, methods: Sequence[str] = report.METHODS, seeds: Sequence[int] = (0,), resamples: int = 8,
    causal: bool = False, refine: bool = False, max_samples: int | None = 600, catalogue: Catalogue = CATALOGUE, progress: Callable[[float, str], None] | None = None,
) -> Outcome:
    """Evaluate every method on every table with every seed, each result in a folder of its own below `path`.

    What has a result is left out, so a run that was stopped, or one with more seeds, methods or tables, does only the rest; a
    key is written in one piece, after its evaluation. Without k the size is chosen by nested cross-validation, twice for
    tables of over 200 features and three times for others, and kept for all results of a table. Wide tables get fewer resamples
    (see config.budget). Tables that don't load are listed with the reason. progress hears the share that is done and what is next; what it
    raises is logged.
    """
    todo = missing(spark, path, names, methods, seeds)
    out = Outcome(finished(spark, path))
    known = {r["dataset"]: r["k"] for r in out.results.groupBy("dataset").agg(F.max("k").alias("k")).collect()}
    began, frames, lost = time.perf_counter(), {}, set()

    def say(at: int, what: str) -> None:
        if progress:
            try:
                progress(at / max(1, len(todo)), f"{what}, {time.perf_counter() - began:.0f} s")
            except Exception:
                _log.exception("progress")

    def table(name: str) -> FeatureFrame | None:
        if name not in frames and name not in lost:
            try:
                frames.clear()  # keys come table by table
                frames[name] = catalogue.load(spark, name, root, None, max_samples).stored()
                out.loaded.append(name)
            except (KeyError, RuntimeError) as e:
                lost.add(name)
                out.skipped.append((name, str(e).splitlines()[0][:200]))
        return frames.get(name)

    for at, (name, method, seed) in enumerate(todo):
        frame = table(name)
        if frame is None:
            continue
        if name not in known:
            say(at, f"{name}: size")
            known[name] = min(k, frame.p) if k else select_k_nested(frame, repeats=2 if frame.p > 200 else 3)[0]
        size = known[name]
        _, inner, outer = budget(frame.p, size, resamples)
        say(at, f"{name}: {method}, seed {seed}")
        row = evaluate_method(method, builder(method, size, frame.p, inner, causal, refine), frame, size, outer, seed)
        write_once(row | {"dataset": name}, spark, path)
        out.ran.append((name, method, seed))
    say(len(todo), "done")
    out.results = finished(spark, path)
    return out
