"""Queries of the training-data problems; those with SQL have it in :mod:`.oracle`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, work_dir
from . import leakage, ledger, merkle, packing, repetition, split_overlap, splitting, subjects, truncation


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.generations(table(spark, sf_dir, "predictions")).filter("generation is not null and request_hash is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations made mostly of repeats."""
    return repetition.failing(_generations(spark, sf_dir), "request_hash", "generation", "model_id").withColumnRenamed("doc_id", "request_hash")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generation's repeated share with its host's verdict."""
    return repetition.repetition(_generations(spark, sf_dir), "request_hash", "generation", "model_id").select(
        F.col("doc_id").alias("request_hash"), F.col("host").alias("model_id"), *[F.round(f"repeated{x}", 6).alias(f"repeated{x}") for x in ("", "_sentences", "_paragraphs")],
        "fails", "host_rate", "bad_host",
    )


def _hosts(spark: SparkSession, sf_dir: str, rules: tuple[str, ...]) -> DataFrame:
    shares = repetition.measured_once(_generations(spark, sf_dir), "request_hash", "generation", "model_id")
    each = [repetition.host_verdicts(shares, "host", r).select(F.col("host").alias("model_id"), F.lit(r).alias("rule"), "n_docs", "n_failed", "rate", "bad_host") for r in rules]
    return reduce(DataFrame.unionByName, each)


def p1_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk failure rates by model and document rule."""
    return _hosts(spark, sf_dir, tuple(repetition.RULES))


def p1_part_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk failure rates by model, of the rules on sentences and paragraphs."""
    return _hosts(spark, sf_dir, ("sentences", "paragraphs"))


def _mmlu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mmlu").filter("payload.question is not null").select("row_no", "payload")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus copies of records that are the same but for looks."""
    found = merkle.surplus_copies(_mmlu(spark, sf_dir), "payload", "row_no")
    return found.select(F.col("first_row").alias("first_row_no"), F.col("row").alias("row_no"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record, with its number of copies."""
    return merkle.collapse(_mmlu(spark, sf_dir), "payload", "row_no").select(F.col("first_row").alias("first_row_no"), "copies")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and an evaluation row that hold the same or nearly the same question."""
    pairs = split_overlap.cross_split_pairs(table(spark, sf_dir, "arc_easy"))
    return pairs.select(
        F.least("train_id", "eval_id").alias("example_id_a"), F.greatest("train_id", "eval_id").alias("example_id_b")
    ).distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs by evaluation split and source."""
    pairs = split_overlap.cross_split_pairs(table(spark, sf_dir, "arc_easy"))
    return pairs.groupBy("split", split_overlap.collection_of(F.col("eval_id")).alias("source")).agg(F.count("*").alias("n_pairs"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.arrivals([table(spark, sf_dir, t) for t in ("arc_easy", "mmlu", "gsm8k", "wikitext")])


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples that each sweep's limit chooses."""
    return ledger.sweep_samples(_arrivals(spark, sf_dir), table(spark, sf_dir, "sweep_specs"), ledger.SelectionLedger(spark, work_dir(spark)))


#: Times up to which rows had arrived at each growth step of :func:`p5_growth`, and its share.
GROWTH_CUTS, GROWTH_PERCENT = ("2024-03-01", "2024-08-01", "2100-01-01"), 10


def p5_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each dataset and split, by lowest hash priority, kept in a ledger that grows as rows arrive."""
    return ledger.share_samples(_arrivals(spark, sf_dir), list(GROWTH_CUTS), GROWTH_PERCENT, ledger.SelectionLedger(spark, work_dir(spark)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations that break off unfinished."""
    return truncation.truncated(table(spark, sf_dir, "predictions")).filter("cut").select("request_hash").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of broken-off generations by model."""
    return truncation.truncated(table(spark, sf_dir, "predictions")).groupBy("model_id").agg(
        F.count("*").alias("n_generations"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share_cut")
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "wikitext"), table(spark, sf_dir, "example_results"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized items."""
    return splitting.split_items(_items(spark, sf_dir), "text")


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the oversized texts put together again from their pieces, each of which repeats the end of the one before."""
    pieces = splitting.split_items(_items(spark, sf_dir).withColumn("item", F.xxhash64("text")), "text")
    by = pieces.groupBy("source_table", "run_id", "example_id", "item").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "piece"))).alias("p"))
    whole = F.aggregate("p", F.lit(""), lambda a, x: F.concat(F.substring(a, F.lit(1), x["start"]), x["piece"]))
    return by.select("source_table", "run_id", "example_id", F.sha2(whole, 256).alias("digest"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be split."""
    return p7_pieces(spark, sf_dir).select("source_table", "run_id", "example_id").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents packed into containers of 2,048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each document that the containers hold."""
    return p8_containers(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers are needed and how full they are."""
    each = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"))
    return each.agg(
        F.count("*").alias("n_containers"),
        F.sum("tokens").alias("n_tokens"),
        F.max("tokens").alias("most_tokens"),
        F.round(F.sum("tokens") / (F.count("*") * packing.CAPACITY), 6).alias("fill"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an evaluation item, whole or in part."""
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each leaked item is found."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each document treats."""
    return subjects.assigned_to_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject."""
    return p10_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_shares, p1_hosts, p1_part_hosts, p2_found, p2_records, p4_found, p4_counts, p5_sample, p5_growth, p6_found, p6_rates, p7_found, p7_pieces, p7_rebuilt, p8_containers, p8_bytes, p8_fill, p9_found, p9_items, p10_found, p10_composition)
}
