"""The warehouse: runs, example results and cached predictions as Parquet folders."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT, RUN, RUN_FIELDS
from ..session import materialise
from .evaluators import ANSWER

_CACHE = f"request_hash string, answer {ANSWER}, seq bigint, model_id string, revision string"


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key; an aggregate, so partial maxima shrink the log before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")


class Warehouse:
    """Append-only tables; what is current is found when reading. Opening twice is harmless."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    # Runs: each save appends a version; the last one saved is the run.

    def save_run(self, run: dict) -> None:
        """Append a version of a run. ``seq`` is the time of writing, so nothing is read to find it."""
        row = {f: run.get(f) for f in RUN_FIELDS} | {"seq": time.time_ns()}
        self.spark.createDataFrame([tuple(row[f] for f in RUN_FIELDS)], RUN).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        """Current runs; ``seq`` orders them by last write."""
        return latest(self._read("runs", RUN), "run_id", "seq")

    def list_runs(self) -> DataFrame:
        """Current runs in the order of their last write."""
        return self.runs().orderBy("seq")

    def get_run(self, run_id: str) -> dict | None:
        """One run, or none; the filter reaches the scan."""
        found = latest(self._read("runs", RUN).filter(F.col("run_id") == run_id), "run_id", "seq").collect()
        return found[0].asDict() if found else None

    # Results: partitioned by run, so one run is read without the others.

    def save_results(self, run_id: str, results: DataFrame) -> None:
        """Append a run's results; their order is by ``ord`` if they have it, else by example."""
        order = F.col("ord") if "ord" in results.columns else F.lit(None).cast("bigint")
        out = results.select(
            F.lit(run_id).alias("run_id"), "example_id", "correct", "score",
            (F.to_json("detail") if "detail" in results.columns else F.col("detail_json")).alias("detail_json"), order.alias("ord"),
        )
        out.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/example_results")

    def results(self, run_id: str) -> DataFrame:
        """A run's results in order."""
        return self._read("example_results", RESULT).filter(F.col("run_id") == run_id).orderBy("ord", "example_id")

    def drop_results(self, run_id: str) -> None:
        """Remove a run's results, which are a folder of their own."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/example_results/run_id={run_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # Deletion: rewrite to a new folder, then swap.

    def rewrite(self, name: str, keep: DataFrame, partition: list[str] | None = None) -> None:
        """Replace a table by ``keep``, which may be read from it: written beside it first, then moved into place."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}")
        fs = path(name).getFileSystem(conf)
        writer = keep.write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(f"{self.root}/_new_{name}")
        fs.delete(path(f"_old_{name}"), True)
        if fs.exists(path(name)):
            fs.rename(path(name), path(f"_old_{name}"))
        fs.rename(path(f"_new_{name}"), path(name))
        fs.delete(path(f"_old_{name}"), True)

    def invalidate(self, keys: DataFrame, run_ids: DataFrame, dry_run: bool = True) -> dict[str, int]:
        """Drop the predictions of ``keys`` and the results and versions of ``run_ids``; a dry run only counts them."""
        cache, results, runs = self._read("predictions", _CACHE), self._read("example_results", RESULT), self._read("runs", RUN)
        found = {
            "predictions": cache.join(keys, "request_hash", "left_semi").select("request_hash").distinct().count(),
            "example_results": results.join(run_ids, "run_id", "left_semi").count(),
            "runs": runs.join(run_ids, "run_id", "left_semi").select("run_id").distinct().count(),
        }
        if not dry_run:
            if found["predictions"]:
                self.rewrite("predictions", cache.join(keys, "request_hash", "left_anti"), ["model_id", "revision"])
            if found["example_results"]:
                self.rewrite("example_results", results.join(run_ids, "run_id", "left_anti"), ["run_id"])
            if found["runs"]:
                self.rewrite("runs", runs.join(run_ids, "run_id", "left_anti"))
        return found


class PredictionCache:
    """Answers by the content hash of their request; the cache is a join, not a lookup for each request."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse, self.hits, self.misses = warehouse, 0, 0

    def known(self, model_id: str, revision: str) -> DataFrame:
        """Usable answers of a model: the last one written for each request; an answer whose greedy flag is unknown is none."""
        rows = self.warehouse._read("predictions", _CACHE).filter((F.col("model_id") == model_id) & (F.col("revision") == revision))
        usable = rows.filter(F.col("answer.loglik").isNull() | F.col("answer.is_greedy_match").isNotNull())
        return usable.groupBy("request_hash").agg(F.max_by("answer", F.coalesce("seq", F.lit(0))).alias("answer"))

    def scorer(self, score: Callable[[DataFrame], DataFrame], model_id: str, revision: str) -> Callable[[DataFrame], DataFrame]:
        """A scorer that asks ``score`` for missing answers only, once for each distinct request, and appends them in one write."""

        def cached(requests: DataFrame) -> DataFrame:
            asked = materialise(requests, "requests")  # rendered once, then counted, scored and joined
            known = self.known(model_id, revision)
            found = counters(asked, known).first()
            self.hits, self.misses = self.hits + found["hits"], self.misses + found["misses"]
            if found["misses"]:
                fresh = score(misses(asked, known))
                fresh.select("request_hash", F.col("answer").cast(ANSWER).alias("answer"), F.lit(time.time_ns()).alias("seq"), "model_id", "revision").write.mode("append").partitionBy("model_id", "revision").parquet(
                    f"{self.warehouse.root}/predictions"
                )
            return asked.join(self.known(model_id, revision), "request_hash", "left")

        return cached


def misses(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct requests without an answer."""
    return requests.join(known.select("request_hash"), "request_hash", "left_anti").dropDuplicates(["request_hash"])


def hits(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests with their answer."""
    return requests.join(known, "request_hash")


def counters(requests: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """``n_requests, misses, hits`` as a sequential cache counts them: a request's first occurrence misses, its repeats hit."""
    mark = known.select("request_hash").distinct().withColumn("_known", F.lit(True))
    found = requests.join(mark, "request_hash", "left")
    new = F.count_distinct(F.when(F.col("_known").isNull(), F.col("request_hash")))
    return found.groupBy(*by).agg(F.count("*").alias("n_requests"), new.alias("misses")).withColumn("hits", F.col("n_requests") - F.col("misses"))
