"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "arc_easy mmlu gsm8k wikitext runs example_results predictions sweep_specs eval_items "
    "subjects subject_labels"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale-factor folder, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a plan's bytes: for a filtered scan the size of its files. Nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, times: float = 1.0) -> int:
    """Partitions for a sort of ``df`` by ranges, which adaptive execution doesn't resize: one for each
    advisory size of its estimated bytes (``times`` them where rows multiply on the way), from
    ``spark.sql.shuffle.partitions`` up to a hundred times as many.
    """
    conf = df.sparkSession.conf
    usual = int(conf.get("spark.sql.shuffle.partitions"))
    each = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    return max(usual, min(100 * usual, int(scan_bytes(df) * times) // max(1, each)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows of a few large files over all tasks before work that is heavy on CPU.

    Tables of at least as many files as tasks, or large enough to be split among them, are left alone: moving
    them would cost a shuffle and gain nothing. Only file sizes are looked at; nothing runs.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    if scan_bytes(df) >= wanted * (128 << 20) or len(df.inputFiles()) >= wanted:
        return df
    return df.repartition(wanted, *keys) if keys else df.repartition(wanted)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by the session in ``spark.checkpoint.dir``.

    Where the option is unset, a session that is one process on one machine (a ``local`` master, as in tests) gets a
    folder of its own, deleted when Python ends. On any other master that is an error: a folder of
    one machine would be read back incomplete.
    """
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir", None)):
        if base := get():
            return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="gradloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's shared folder; :func:`discard_work` deletes it."""
    made = f"{shared_folder(spark)}/gradloom-{uuid.uuid4().hex}"
    _MADE.append(made)
    return made


_MADE: list[str] = []


def discard_work(spark: SparkSession) -> int:
    """Delete the folders that this process has made so far; call it when no result that reads them is in use."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = hadoop.Path(_MADE.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: cuts the lineage and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
