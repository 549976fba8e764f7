"""Agreement of two frameworks: results of an external harness imported, joined by example, disagreements put in categories."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.store import Warehouse

CATEGORIES = ("PROMPT_FORMAT", "ANSWER_EXTRACTION", "NORMALIZATION", "TOKENIZATION_BOUNDARY", "DATA_MISMATCH", "UNEXPLAINED")

HARNESS = "doc_id string, example_id string, prompt string, target int, resps array<double>, resps_norm array<double>, acc double, generation string, extracted string"


#: The framework of imported runs, unless another is named.
FRAMEWORK = "lm_eval_harness"


def import_harness(spark: SparkSession, path: str, run_id: str, framework: str = FRAMEWORK) -> DataFrame:
    """An external harness's per-example JSON Lines as result rows: ``run_id, example_id, correct, score, detail_json, framework``."""
    raw = spark.read.schema(HARNESS).json(path)
    detail = F.to_json(F.struct(F.col("target").alias("answer_index"), F.col("resps").alias("logliks"), F.col("resps_norm").alias("logliks_norm"), "prompt", "generation", F.col("extracted").alias("extracted_number")))
    return raw.select(
        F.lit(run_id).alias("run_id"), F.coalesce("example_id", "doc_id").alias("example_id"), (F.col("acc") >= 0.5).alias("correct"), F.col("acc").alias("score"),
        detail.alias("detail_json"), F.lit(framework).alias("framework"),
    )


def imported_run(run_id: str, model_id: str, revision: str, dataset: str, split: str, variant: str | None, evaluator: str, framework: str = FRAMEWORK) -> dict:
    """The record of a run that another framework made."""
    return {
        "run_id": run_id, "model_id": model_id, "revision": revision, "dataset": dataset, "split": split, "prompt_variant_id": variant, "evaluator": evaluator, "framework": framework, "seed": 0,
        "code_version": framework, "config_json": json.dumps({"split": split, "limit": None, "seed": 0, "imported": True}),
    }


def import_run(warehouse: Warehouse, path: str, run: dict) -> dict:
    """Write an external run's results and its record, whose accuracy is that of the rows; gives the record."""
    rows = import_harness(warehouse.spark, path, run["run_id"], run["framework"])
    n, acc = rows.agg(F.count("*"), metrics.acc(F.col("correct"))).first()
    now = datetime.now(UTC).isoformat(timespec="seconds")
    record = run | {"metrics": {"acc": float(acc)}, "n_examples": n, "started_at": now, "finished_at": now, "status": "done"}
    warehouse.save_results(run["run_id"], rows)
    warehouse.save_run(record)
    return record


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``example_id, agree, category`` of two runs' results; the category is null where they agree.

    Both sides have ``example_id, correct, detail_json``. A row on one side only, or other gold answers, is a mismatch of data; after that
    other prompts, extracted numbers, the same log-likelihoods normalised otherwise, and unequal log-likelihoods with one winner explain a difference, in this order.
    """
    get = lambda side, field: F.get_json_object(F.col(f"{side}.detail_json"), f"$.{field}")
    array = lambda side, field: F.from_json(get(side, field), "array<double>")
    differs = lambda field: F.coalesce(get("a", field) != get("b", field), F.lit(False))
    number = lambda side, field: get(side, field).try_cast("double")
    far_off = lambda field: F.coalesce(F.abs(number("a", field) - number("b", field)) > tolerance, F.lit(False))

    def far(field: str):
        x, y = array("a", field), array("b", field)
        return x.isNotNull() & y.isNotNull() & ((F.size(x) != F.size(y)) | F.exists(F.zip_with(x, y, lambda p, q: ~(F.abs(p - q) <= tolerance)), lambda z: z))

    one_sided = F.col("a.example_id").isNull() | F.col("b.example_id").isNull()
    agree = ~one_sided & F.col("a.correct").eqNullSafe(F.col("b.correct"))
    extracted = ~number("a", "extracted_number").eqNullSafe(number("b", "extracted_number"))
    category = (
        F.when(agree, None)
        .when(one_sided | far_off("answer_index") | far_off("answer_number"), "DATA_MISMATCH")
        .when(differs("prompt"), "PROMPT_FORMAT")
        .when((get("a", "generation").isNotNull() | get("b", "generation").isNotNull()) & extracted, "ANSWER_EXTRACTION")
        .when(~far("logliks") & far("logliks_norm"), "NORMALIZATION")
        .when(far("logliks"), "TOKENIZATION_BOUNDARY")
        .otherwise("UNEXPLAINED")
    )
    joined = a.alias("a").join(b.alias("b"), F.col("a.example_id") == F.col("b.example_id"), "full_outer")
    return joined.select(F.coalesce("a.example_id", "b.example_id").alias("example_id"), F.coalesce(agree, F.lit(False)).alias("agree"), category.alias("category"))


def agreement(rows: DataFrame) -> DataFrame:
    """``n, n_agree, rate, unexplained`` of a parity join; any unexplained row fails the check."""
    return rows.agg(
        F.count("*").alias("n"), F.sum(F.col("agree").cast("int")).alias("n_agree"), F.round(F.avg(F.col("agree").cast("int")), 6).alias("rate"),
        F.sum(F.when(F.col("category") == "UNEXPLAINED", 1).otherwise(0)).alias("unexplained"),
    )


def category_counts(rows: DataFrame) -> DataFrame:
    """Disagreements by category."""
    return rows.filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


#: Disagreeing examples of each category that a report names.
REPORT_EXAMPLES = 20


def write_report(rows: DataFrame, a: str, b: str, path: str) -> None:
    """A Markdown report of a parity join: agreement, categories, and some examples of each category by id."""
    total = agreement(rows).first()
    lines = [f"# Parity of {a} and {b}", "", f"{total['n_agree'] or 0} of {total['n']} examples agree ({total['rate'] or 0:.4f}).", "", "| category | examples |", "|-|-|"]
    counts = {r["category"]: r["n"] for r in category_counts(rows).collect()}
    lines += [f"| {c} | {counts.get(c, 0)} |" for c in CATEGORIES]
    for c in CATEGORIES:
        if c in counts:
            some = rows.filter(F.col("category") == c).select("example_id").orderBy("example_id").limit(REPORT_EXAMPLES).collect()
            lines += ["", f"## {c}", "", *[f"- {r['example_id']}" for r in some]]
    lines += ["", "The check " + ("fails: disagreements are unexplained." if total["unexplained"] else "passes.")]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
