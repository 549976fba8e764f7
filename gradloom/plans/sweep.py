"""Sweeps: a specification expanded to planned runs, of which those not done yet are executed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import evaluators, metrics
from ..operators.render import load_variant, sample_demos
from ..operators.store import PredictionCache, Warehouse
from ..sources.datasets import get_loader

KEYS = ("model_id", "revision", "dataset", "split", "variant", "evaluator", "limit", "seed")
PLAN = "ord int, model_id string, revision string, dataset string, split string, variant string, evaluator string, limit int, seed int"


@dataclass(frozen=True)
class Target:
    """What is evaluated; ``variant`` is none for perplexity."""

    dataset: str
    evaluator: str
    split: str
    variant: str | None = None


@dataclass(frozen=True)
class Spec:
    """A sweep: models with their revisions, targets, limit and seed."""

    models: list[tuple[str, list[str]]]
    targets: list[Target]
    limit: int | None = None
    seed: int = 0


def load_spec(path: str | Path) -> Spec:
    """A specification from YAML, of which JSON is a part."""
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return Spec(
        [(m["model_id"], list(m["revisions"])) for m in given["models"]],
        [Target(t["dataset"], t["evaluator"], t["split"], t.get("variant")) for t in given["targets"]],
        given.get("limit"),
        given.get("seed", 0),
    )


def planned_runs(spark: SparkSession, spec: Spec) -> DataFrame:
    """One row for each model, revision and target, numbered in this order."""
    rows = [
        (m, r, t.dataset, t.split, t.variant, t.evaluator, spec.limit, spec.seed)
        for m, revisions in spec.models
        for r in revisions
        for t in spec.targets
    ]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], PLAN)


def expand_sweeps(sweeps: DataFrame) -> DataFrame:
    """Planned runs of a table of specifications: ``sweep_id, ord`` and :data:`KEYS`; the products are explosions within a row, so nothing is shuffled."""
    models = sweeps.select("sweep_id", "spec", F.posexplode("spec.models").alias("i", "m"))
    revisions = models.select("sweep_id", "spec", "i", "m", F.posexplode("m.revisions").alias("j", "revision"))
    targets = revisions.select("sweep_id", "spec", "i", "m", "j", "revision", F.posexplode("spec.targets").alias("k", "t"))
    before = F.aggregate(F.slice("spec.models", F.lit(1), F.col("i")), F.lit(0), lambda a, m: a + F.size(m["revisions"]))
    ordinal = (before + F.col("j")) * F.size("spec.targets") + F.col("k")
    return targets.select(
        "sweep_id", ordinal.cast("int").alias("ord"), F.col("m.model_id").alias("model_id"), "revision", F.col("t.dataset").alias("dataset"), F.col("t.split").alias("split"),
        F.col("t.variant").alias("variant"), F.col("t.evaluator").alias("evaluator"), F.col("spec.limit").alias("limit"), F.col("spec.seed").alias("seed"),
    )


def same_run(a: str, b: str) -> Column:
    """Whether two planned runs are the same; a null variant or limit equals a null one."""
    cond = F.lit(True)
    for k in KEYS:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def done_keys(runs: DataFrame) -> DataFrame:
    """Distinct keys of finished runs; the limit is in their configuration."""
    done = runs.filter(F.col("status") == "done")
    limit = F.get_json_object("config_json", "$.limit").cast("int")
    return done.select("model_id", "revision", "dataset", "split", F.col("prompt_variant_id").alias("variant"), "evaluator", limit.alias("limit"), "seed").distinct()


def todo(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned runs that aren't done, each once, though a specification may name one twice."""
    left = planned.alias("p").join(done.alias("d"), same_run("p", "d"), "left_anti")
    return left.groupBy(*KEYS).agg(F.min("ord").alias("ord")).select("ord", *KEYS)


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


@dataclass
class Outcome:
    """What a sweep did."""

    executed: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    skipped: int = 0


def execute(
    warehouse: Warehouse, root: str, model_id: str, revision: str, dataset: str, split: str, variant: str | None, evaluator: str,
    limit: int | None, seed: int, scorer: Callable[[DataFrame], DataFrame], pool_split: str | None = None, window: int = 1024, library: str | None = None,
) -> tuple[str, bool]:
    """One run from its ``running`` row to ``done`` or ``failed``: ``run_id`` and whether it succeeded.

    Results are written only when the metrics are there, and removed again if the finished row can't be, so a failed run leaves none behind.
    """
    spark = warehouse.spark
    run = {
        "run_id": f"run-{uuid.uuid4().hex[:12]}", "model_id": model_id, "revision": revision, "dataset": dataset, "split": split, "prompt_variant_id": variant, "evaluator": evaluator,
        "framework": "gradloom", "seed": seed, "code_version": __version__, "metrics": {}, "n_examples": 0, "started_at": _now(), "status": "running",
        "config_json": json.dumps({"split": split, "limit": limit, "seed": seed}),
    }
    warehouse.save_run(run)
    try:
        load = get_loader(dataset)
        examples = load(spark, root, split, limit)
        chosen = load_variant(variant, library) if variant else None
        demos = None
        if chosen is not None and chosen.num_fewshot:
            pool = load(spark, root, pool_split or ("fixture_train" if split.startswith("fixture") else chosen.fewshot_split), None)
            demos = sample_demos(pool, chosen)
        cache = PredictionCache(warehouse)
        results = evaluators.evaluate(examples, evaluator, chosen, cache.scorer(scorer, model_id, revision), model_id, revision, demos, window)
        ordered = results.join(examples.select("example_id", "ord"), "example_id")
        row = ordered.agg(F.count("*").alias("_n"), *[v.alias(k) for k, v in metrics.for_evaluator(evaluator, ordered).items()]).first().asDict()
        warehouse.save_results(run["run_id"], ordered)
        config = {"split": split, "limit": limit, "seed": seed, "cache_hits": cache.hits, "cache_misses": cache.misses}
        n = row.pop("_n")
        warehouse.save_run(run | {"metrics": {k: float(v) for k, v in row.items()}, "n_examples": n, "config_json": json.dumps(config), "finished_at": _now(), "status": "done"})
        return run["run_id"], True
    except Exception as e:  # noqa: BLE001 - a failed run is recorded, the sweep goes on
        warehouse.drop_results(run["run_id"])
        config = {"split": split, "limit": limit, "seed": seed, "error": str(e)[:500]}
        warehouse.save_run(run | {"config_json": json.dumps(config), "finished_at": _now(), "status": "failed"})
        return run["run_id"], False


def cache_keys(warehouse: Warehouse, root: str, run: dict, window: int = 1024, library: str | None = None) -> DataFrame:
    """``request_hash`` of all requests that a recorded run made: its examples are loaded and rendered again, nothing is scored."""
    limit = json.loads(run["config_json"] or "{}").get("limit")
    load = get_loader(run["dataset"])
    chosen = load_variant(run["prompt_variant_id"], library) if run["prompt_variant_id"] else None
    demos = None
    if chosen is not None and chosen.num_fewshot:
        pool = load(warehouse.spark, root, "fixture_train" if run["split"].startswith("fixture") else chosen.fewshot_split, None)
        demos = sample_demos(pool, chosen)
    examples = load(warehouse.spark, root, run["split"], limit)
    return evaluators.requests_of(examples, run["evaluator"], chosen, run["model_id"], run["revision"], demos, window).select("request_hash").distinct()


def run_sweep(
    warehouse: Warehouse, root: str, spec: Spec, scorer_of: Callable[[str, str], Callable[[DataFrame], DataFrame]], window: int = 1024, library: str | None = None
) -> Outcome:
    """Execute what isn't done, grouped by model and revision so that each is loaded once; an unknown model fails its own runs only."""
    planned = planned_runs(warehouse.spark, spec)
    rest = todo(planned, done_keys(warehouse.runs())).orderBy("ord").collect()
    out = Outcome(skipped=planned.count() - len(rest))
    scorers: dict[tuple[str, str], Callable | None] = {}
    for r in rest:
        group = (r["model_id"], r["revision"])
        if group not in scorers:
            try:
                scorers[group] = scorer_of(*group)
            except KeyError:
                scorers[group] = None
        scorer = scorers[group] or _unknown(r["model_id"])
        run_id, ok = execute(warehouse, root, *group, r["dataset"], r["split"], r["variant"], r["evaluator"], r["limit"], r["seed"], scorer, window=window, library=library)
        out.executed.append(run_id)
        if not ok:
            out.failed.append(run_id)
    return out


def _unknown(model_id: str) -> Callable[[DataFrame], DataFrame]:
    def fail(_: DataFrame) -> DataFrame:
        raise KeyError(f"unknown model {model_id!r}")

    return fail
