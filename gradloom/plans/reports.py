"""Chart-preparation queries over runs; drawing them is a thin shell (:mod:`..figures`).

``runs`` holds current runs with ``metrics``, a map, and ``seq``, the order of their last write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Parameter counts, chance rates, panels and checkpoints of the reports. Fixed values.
PARAM_COUNTS = {"pythia-70m": 70_000_000, "pythia-160m": 160_000_000, "pythia-410m": 410_000_000, "pythia-1b": 1_000_000_000}
CHANCE = {"arc_easy": 0.25, "hellaswag": 0.25, "mmlu": 0.25, "lambada": 0.0, "gsm8k": 0.0}
ACC_DATASETS = ("arc_easy", "hellaswag", "mmlu", "lambada", "gsm8k")
PPL_DATASETS = ("wikitext103", "c4_slice")
GRID_REVISIONS = ("step1000", "step64000", "main")
FINAL_STEP = X.FINAL_STEP


def param_counts(spark: SparkSession) -> DataFrame:
    """``model_id, params``: a handful of fixed rows."""
    return spark.createDataFrame(list(PARAM_COUNTS.items()), "model_id string, params bigint")


def chance_rates(spark: SparkSession) -> DataFrame:
    """``dataset, chance``."""
    return spark.createDataFrame(list(CHANCE.items()), "dataset string, chance double")


def parse_metrics(metrics_json: Column) -> Column:
    """A map of metrics; ``Infinity`` is a number."""
    return F.from_json(metrics_json, "map<string,double>", {"allowNonNumericNumbers": "true"})


def done(runs: DataFrame) -> DataFrame:
    """Finished runs."""
    return runs.filter(F.col("status") == "done")


def known(runs: DataFrame) -> DataFrame:
    """Runs of models with a known size, with ``params``; the sizes are a few fixed rows."""
    return runs.join(F.broadcast(param_counts(runs.sparkSession)), "model_id")


def final(runs: DataFrame) -> DataFrame:
    """Runs of the last checkpoint."""
    return runs.filter(X.revision_step(F.col("revision")) == FINAL_STEP)


def has(metric: str) -> Column:
    """Whether a run has the metric."""
    return F.map_contains_key("metrics", F.lit(metric))


def series(points: DataFrame, *by: str) -> DataFrame:
    """``by..., points``: points ``(x, y)`` in order."""
    return points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points"))


def accuracy_grid(runs: DataFrame) -> DataFrame:
    """``dataset, panel, model_id, revision, value``: accuracy, or bits per byte for texts, of three checkpoints; the run written last wins."""
    panels = {d: i for i, d in enumerate(ACC_DATASETS + PPL_DATASETS)}
    metric = F.when(F.col("dataset").isin(*PPL_DATASETS), F.lit("bpb")).otherwise(F.lit("acc"))
    rows = known(done(runs)).filter(F.col("dataset").isin(*panels) & F.col("revision").isin(*GRID_REVISIONS)).withColumn("value", F.try_element_at("metrics", metric))
    last = rows.filter("value is not null").groupBy("dataset", "model_id", "revision").agg(F.max_by("value", "seq").alias("value"))
    order = F.create_map(*[F.lit(x) for kv in panels.items() for x in kv])
    return last.select("dataset", order[F.col("dataset")].alias("panel"), "model_id", "revision", "value")


def scaling_points(runs: DataFrame, metric: str) -> DataFrame:
    """``dataset, x, y``: the metric against the logarithm of the model's size, of every final run that has it."""
    rows = final(known(done(runs))).filter(has(metric))
    return rows.select("dataset", F.log10("params").alias("x"), F.col("metrics")[metric].alias("y"))


def scaling_series(runs: DataFrame, metric: str) -> DataFrame:
    """``dataset, points, chance`` in the order of datasets; a dataset without a chance rate has null."""
    rates = F.broadcast(chance_rates(runs.sparkSession))
    return series(scaling_points(runs, metric), "dataset").join(rates, "dataset", "left")


def headline_points(runs: DataFrame) -> DataFrame:
    """``axis, dataset, x, y``: accuracy of the five benchmarks on one axis, bits per byte of every other run that has it on the second."""
    rows = final(known(done(runs))).withColumn("x", F.log10("params"))
    is_acc = F.col("dataset").isin(*ACC_DATASETS) & has("acc")
    axis = F.when(is_acc, "acc").when(has("bpb"), "bpb")
    return rows.withColumn("axis", axis).filter("axis is not null").select("axis", "dataset", "x", F.col("metrics")[F.col("axis")].alias("y"))


def sensitivity_points(runs: DataFrame) -> DataFrame:
    """``dataset, variant, x, y``: accuracy by prompt variant for datasets with two variants or more; normalised accuracy too where option texts are scored."""
    rows = final(known(done(runs))).filter((F.col("evaluator") == "loglik_mc") & F.col("prompt_variant_id").isNotNull() & has("acc")).withColumn("x", F.log10("params"))
    plain = rows.select("dataset", F.col("prompt_variant_id").alias("variant"), "x", F.col("metrics")["acc"].alias("y"))
    normed = rows.filter(F.col("prompt_variant_id").endswith("mc_option_text_v1") & has("acc_norm")).select(
        "dataset", F.concat("prompt_variant_id", F.lit(" (acc_norm)")).alias("variant"), "x", F.col("metrics")["acc_norm"].alias("y")
    )
    enough = plain.groupBy("dataset").agg(F.count_distinct("variant").alias("n")).filter("n >= 2").select("dataset")
    return plain.unionByName(normed).join(enough, "dataset", "left_semi")


def trajectory_points(runs: DataFrame, metric: str) -> DataFrame:
    """``model_id, dataset, x, y``: the metric against the training step, of all models."""
    step = X.revision_step(F.col("revision"))
    return done(runs).filter(has(metric) & step.isNotNull()).select("model_id", "dataset", step.alias("x"), F.col("metrics")[metric].alias("y"))


def model_order(models: DataFrame) -> DataFrame:
    """``model_id, params, rank``: by size, those of unknown size last in name order."""
    from pyspark.sql.window import Window

    sized = models.select("model_id").distinct().join(F.broadcast(param_counts(models.sparkSession)), "model_id", "left")
    return sized.withColumn("rank", F.row_number().over(Window.orderBy(F.col("params").asc_nulls_last(), "model_id")))
