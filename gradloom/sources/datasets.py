"""Dataset loaders: raw or normalised records to examples in a defined order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schemas import example_schema
from ..session import materialise, partitions_for

#: Subject configurations that are pooled, in this order. Fixed values.
MMLU_SUBJECTS = (
    "high_school_mathematics",
    "college_computer_science",
    "high_school_world_history",
    "professional_law",
    "moral_scenarios",
    "astronomy",
    "college_biology",
    "world_religions",
)
SLICE_SIZE, SLICE_SEED = 200, 0
#: Bytes of a JSON Lines file at most: its line order is taken from the file read as one row.
FIXTURE_BYTES = 64 << 20

Loader = Callable[..., DataFrame]
_LOADERS: dict[str, Loader] = {}


def register(name: str) -> Callable[[Loader], Loader]:
    """Decorator that makes a loader known by ``name``."""

    def add(loader: Loader) -> Loader:
        _LOADERS[name] = loader
        return loader

    return add


def get_loader(name: str) -> Loader:
    """The loader of a dataset; an unknown name raises KeyError and lists the known ones."""
    if name not in _LOADERS:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name]


def with_ordinal(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``ord``, from 0 in the order given, without a single-task sort.

    Rows are range-partitioned and sorted; a partition's first number is the count of rows before it. The counts
    are one number a partition. The sorted rows are written before they are counted: ranges are drawn from a sample, and rows
    counted in one draw must not be numbered in another.
    """
    parts = partitions_for(rows)
    keyed = rows.select("*", F.struct(*order).alias("_key"))
    ranged = keyed.repartitionByRange(parts, "_key").sortWithinPartitions("_key")
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()).drop("_key")
    numbered = materialise(numbered, "ordinals")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = numbered.join(F.broadcast(starts), "_part")
    return placed.withColumn("ord", F.col("_start") + F.col("_mono") - F.col("_first")).drop("_part", "_mono", "_first", "_start")


def first_n(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by ``ord``; null takes all, 0 none."""
    return rows if limit is None else rows.filter(F.col("ord") < limit)


def read_jsonl(spark: SparkSession, path: str, dataset: str, limit: int | None = None) -> DataFrame:
    """A JSON Lines file in line order: blank lines are skipped, a line that doesn't parse fails; ``split`` comes from the rows.

    The line number is taken when the file is read whole, as fixtures are, so a file larger than ``FIXTURE_BYTES`` is refused: it
    belongs in a table. Rows beyond the limit aren't parsed.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()
    if size > FIXTURE_BYTES:
        raise ValueError(f"{path} has {size} bytes; fixtures have at most {FIXTURE_BYTES}")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    kept = lines.filter(X.strip(F.col("value")) != "")
    numbered = kept.withColumn("ord", F.row_number().over(Window.orderBy("line")).cast("bigint") - 1)
    wanted = first_n(numbered, limit)
    parsed = wanted.select("ord", F.from_json("value", example_schema(dataset), {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("ord", "r.*")


def normalise_arc(raw: DataFrame, split: str) -> DataFrame:
    """``id, question, choices{label,text}, answerKey`` to examples; an answer that is no label fails."""
    at = F.array_position("choices.label", F.col("answerKey"))
    index = F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("answer key is no label: "), F.coalesce("id", F.lit("?")))).cast("int"))
    return raw.select(
        F.lit("arc_easy").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("arc_easy-"), "id").alias("example_id"),
        F.struct(F.col("question"), F.col("choices.text").alias("choices"), index.alias("answer_index")).alias("payload"), *_ord(raw),
    )


def normalise_hellaswag(raw: DataFrame, split: str) -> DataFrame:
    """``ind, ctx, endings, label`` to examples; an empty label fails."""
    return raw.select(
        F.lit("hellaswag").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("hellaswag-"), F.col("ind").cast("string")).alias("example_id"),
        F.struct(F.col("ctx").alias("context"), F.col("endings").alias("choices"), F.col("label").cast("int").alias("answer_index")).alias("payload"), *_ord(raw),
    )


def mmlu_id(subject: Column, question: Column) -> Column:
    """The id that the raw question's hash makes."""
    return F.concat(F.lit("mmlu-"), subject, F.lit("-"), X.sha_prefix(question))


def normalise_mmlu(raw: DataFrame, split: str) -> DataFrame:
    """``subject, question, choices, answer`` to examples."""
    return raw.select(
        F.lit("mmlu").alias("dataset"), F.lit(split).alias("split"), mmlu_id(F.col("subject"), F.col("question")).alias("example_id"),
        F.struct("question", "choices", F.col("answer").cast("int").alias("answer_index"), "subject").alias("payload"), *_ord(raw),
    )


def pool_order(subject: Column) -> Column:
    """A subject's place in the pool, from 1; 0 for those that aren't pooled."""
    return F.array_position(F.array(*map(F.lit, MMLU_SUBJECTS)), subject)


def pooled(rows: DataFrame, subject: Column, order: list[Column], limit: int | None = None) -> DataFrame:
    """The pool's subjects one after the other, each in the order given, under one limit; later subjects may thus give nothing. Adds ``ord``."""
    return first_n(with_ordinal(rows.filter(pool_order(subject) > 0), [pool_order(subject), *order]), limit)


def is_body_line(text: Column) -> Column:
    """Neither blank nor a heading between equals signs."""
    t = X.strip(text)
    return (t != "") & ~(t.startswith("=") & t.endswith("="))


def normalise_wikitext(raw: DataFrame, split: str) -> DataFrame:
    """``text, ord`` to examples: stripped, without blank and heading rows; the id keeps the raw row's number."""
    rows = raw.filter(is_body_line(F.col("text")))
    return rows.select(
        F.lit("wikitext103").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("wikitext103-"), F.col("ord").cast("string")).alias("example_id"),
        F.struct(X.strip(F.col("text")).alias("text")).alias("payload"), "ord",
    )


def seeded_slice(rows: DataFrame, key: str, size: int = SLICE_SIZE, seed: int = SLICE_SEED) -> DataFrame:
    """A fixed sample by hash order, the same on any partitioning; ``ord`` is the position in it.

    A top-k, so each task keeps at most ``size`` rows and only they move.
    """
    priority = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    top = rows.withColumn("_p", priority).orderBy("_p", key).limit(size)
    return top.withColumn("ord", F.row_number().over(Window.orderBy("_p", key)).cast("bigint") - 1).drop("_p")


def normalise_c4(raw: DataFrame, split: str, key: str = "ord") -> DataFrame:
    """``text`` rows to the slice's examples; the id is the position in the slice."""
    rows = seeded_slice(raw, key)
    return rows.select(
        F.lit("c4_slice").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("c4_slice-"), F.col("ord").cast("string")).alias("example_id"),
        F.struct("text").alias("payload"), "ord",
    )


def normalise_lambada(raw: DataFrame, split: str) -> DataFrame:
    """``text, ord`` to a context and its last word."""
    context, target = X.last_word_split(F.col("text"))
    return raw.select(
        F.lit("lambada").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("lambada-"), F.col("ord").cast("string")).alias("example_id"),
        F.struct(context.alias("context"), target.alias("target")).alias("payload"), "ord",
    )


def normalise_gsm8k(raw: DataFrame, split: str) -> DataFrame:
    """``question, answer, ord`` to a question and its number; an answer without one fails."""
    return raw.select(
        F.lit("gsm8k").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("gsm8k-"), F.col("ord").cast("string")).alias("example_id"),
        F.struct("question", X.gold_number(F.col("answer")).alias("answer_number")).alias("payload"), "ord",
    )


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """``example_id`` of examples in both: demonstrations must come from a pool that shares none with what is evaluated."""
    return a.select("example_id").intersect(b.select("example_id"))


def _ord(raw: DataFrame) -> list[Column]:
    return [F.col("ord")] if "ord" in raw.columns else []


NORMALISERS = {
    "arc_easy": normalise_arc,
    "hellaswag": normalise_hellaswag,
    "mmlu": normalise_mmlu,
    "wikitext103": normalise_wikitext,
    "c4_slice": normalise_c4,
    "lambada": normalise_lambada,
    "gsm8k": normalise_gsm8k,
}
#: Names of the tables that hold normalised examples, where they differ from the dataset's.
TABLE_OF = {"wikitext103": "wikitext"}


def _make(dataset: str) -> Loader:
    def load(spark: SparkSession, root: str, split: str, limit: int | None = None) -> DataFrame:
        """Examples with ``ord``: a fixture file ``<dataset>[_train].jsonl`` if the split names one, else the table of normalised examples, else raw rows."""
        if split.startswith("fixture"):
            name = dataset if split == "fixture" else f"{dataset}_{split.removeprefix('fixture_')}"
            return read_jsonl(spark, f"{root}/{TABLE_OF.get(name, name)}.jsonl", dataset, limit)
        rows = spark.read.parquet(f"{root}/{TABLE_OF.get(dataset, dataset)}.parquet")
        if "payload" not in rows.columns:
            if dataset == "mmlu":
                return pooled(NORMALISERS[dataset](rows, split).withColumnRenamed("ord", "_ord"), F.col("payload.subject"), [F.col("_ord")], limit).drop("_ord")
            return first_n(NORMALISERS[dataset](rows, split), limit)
        # Re-delivered rows are one example: that which came last. Its place is that of the first.
        mine = rows.filter((F.col("split") == split) & F.col("example_id").isNotNull())
        latest = mine.groupBy("example_id").agg(F.max_by("payload", F.struct("added_at", "row_no")).alias("payload"), F.min("row_no").alias("row_no"))
        whole = latest.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "example_id", "payload", "row_no")
        if dataset == "mmlu":
            return pooled(whole, F.col("payload.subject"), [F.col("row_no")], limit)
        if dataset == "wikitext103":
            whole = whole.filter(is_body_line(F.col("payload.text"))).withColumn("payload", F.struct(X.strip(F.col("payload.text")).alias("text")))
        return first_n(with_ordinal(whole, [F.col("row_no")]), limit)

    return load


for _name in NORMALISERS:
    register(_name)(_make(_name))
