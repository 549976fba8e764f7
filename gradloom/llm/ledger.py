"""A reproducible sample that stays stable as data grows: a persisted selection ledger (problem 5)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialise, partitions_for

LEDGER = T.StructType(
    [
        T.StructField("pool", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("rank", T.LongType()),
    ]
)


def ranked(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """Adds ``rank``, from 1 within each ``pool`` in the order of the columns given, which must tell all rows of a pool apart.

    Rows are cut into so many ``ranges`` by pool and order, so a pool that holds all rows, or arrived all at once, spreads over many tasks; counts
    of a pool's rows by partition, summed up, are the ranks that its partitions begin with. The sorted rows are written before they are counted: ranges are
    drawn from a sample, and rows counted in one draw must not be ranked in another.
    """
    ranged = rows.repartitionByRange(ranges, "pool", *order).sortWithinPartitions("pool", *order)
    placed = materialise(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ledger-ranks")
    counts = placed.groupBy("pool", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("pool").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each pool and partition
    starts = counts.select("pool", "_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(starts, ["pool", "_part"])
    return joined.withColumn("rank", F.col("_start") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_start")


def early_enough(keys: DataFrame, quotas: DataFrame, by: list[str]) -> DataFrame:
    """``pool, quota, ...`` of ``quotas`` with ``_until``: the hour in which the pool's quota is surely filled, null if all keys are needed.

    ``keys``: ``by..., arrival``, of which quotas' ``by`` names the pool's. Keys are counted by hour; as many as the quota arrived up to that hour, and since
    the ledger's own keys are among the quota, enough of them are unseen. Only counts are sorted.
    """
    hours = keys.groupBy(*by, F.date_trunc("hour", "arrival").alias("_hour")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("_hour")
    summed = hours.withColumn("_n", F.sum("n").over(upto)).drop("n")
    at = quotas.join(summed, by, "left").groupBy("pool").agg(F.min(F.when(F.col("_n") >= F.col("quota"), F.col("_hour"))).alias("_until"))
    return quotas.join(at, "pool")


def grow(ledger: DataFrame, keys: DataFrame, quotas: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """The ledger after a growth step: ``pool, key, rank``.

    ``keys``: ``by..., key, arrival``, one row for each key of a dataset; ``quotas``: ``pool, quota, seed, by...``, one row a pool; a null quota takes all. Earlier
    keys are kept by a join, whether or not they are among the keys still. The quota's rest is filled from unseen keys. With ``order`` left out they are taken in order of
    arrival, those that arrived together by lowest hash priority, so that what was chosen from the rows up to any time stays chosen when later rows have
    come, even where no ledger was kept; ``["priority"]`` takes the lowest priorities whenever they came. The priority hashes pool, seed and key alone.
    Keys that came too late to be chosen fall out before anything is ranked.
    """
    kept = ledger.groupBy("pool").agg(F.count("*").alias("kept"))
    wanted = quotas.join(kept, "pool", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    wanted = early_enough(keys, wanted, by) if order is None else wanted.withColumn("_until", F.lit(None).cast("timestamp"))
    wanted = wanted.filter("quota is null or quota > kept")
    rows = keys.join(wanted, by).filter(F.col("_until").isNull() | (F.date_trunc("hour", "arrival") <= F.col("_until")))
    unseen = rows.select("pool", "key", "arrival", "quota", "seed", "kept").join(ledger.select("pool", "key"), ["pool", "key"], "left_anti")
    with_priority = unseen.withColumn("priority", F.sha2(F.concat_ws("|", "pool", "seed", "key"), 256)).drop("seed")
    fresh = ranked(with_priority, [*(order or ["arrival", "priority"]), "key"], partitions_for(keys, 2)).filter("quota is null or rank <= quota - kept")
    return ledger.select("pool", "key", "rank").unionByName(fresh.select("pool", "key", (F.col("kept") + F.col("rank")).alias("rank")))


class SelectionLedger:
    """A ledger kept as Parquet: one folder a version, the greatest being the current one.

    A version is written whole before it is used, so a lost executor or a repeated call leaves an older
    version in force and never half of one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath() for x in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def current(self) -> DataFrame:
        """The ledger's rows; none before the first step."""
        done = self._versions()
        if not done:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/v{done[-1]}")

    def advance(self, keys: DataFrame, quotas: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
        """One growth step (:func:`grow`), written as the next version."""
        number = (self._versions() or [0])[-1] + 1
        grow(self.current(), keys, quotas, by, order).write.parquet(f"{self.path}/v{number}")
        return self.current()


DATASET = ["dataset", "split"]


def sweep_pools(sweeps: DataFrame) -> DataFrame:
    """``sweep_id, pool, dataset, split, quota, seed``: what each sweep asks of each dataset and split; distinct."""
    target = F.explode("spec.targets").alias("t")
    return (
        sweeps.select("sweep_id", F.col("spec.limit").alias("quota"), F.col("spec.seed").alias("seed"), target)
        .select("sweep_id", F.col("t.dataset").alias("dataset"), F.col("t.split").alias("split"), "quota", F.coalesce("seed", F.lit(0)).alias("seed"))
        .distinct()
        .withColumn("pool", F.concat_ws("|", "dataset", "split", "seed"))
    )


def arrivals(tables: list[DataFrame]) -> DataFrame:
    """``dataset, split, key, arrival``: the keys of the datasets' tables, which may differ in their other columns, with their first arrival. Written once.

    Null keys are no keys; a key that comes again counts by its first arrival, an unknown one being the earliest.
    """
    parts = [t.select("dataset", "split", F.col("example_id").alias("key"), F.col("added_at").alias("arrival")) for t in tables]
    rows = reduce(DataFrame.unionByName, parts).filter("key is not null and dataset is not null and split is not null")
    first = rows.groupBy("dataset", "split", "key").agg(F.min("arrival").alias("arrival"))
    return materialise(first.withColumn("arrival", F.coalesce("arrival", F.lit("1970-01-01").cast("timestamp"))), "ledger-arrivals")


def sweep_samples(keys: DataFrame, sweeps: DataFrame, book: SelectionLedger) -> DataFrame:
    """``sweep_id, dataset, split, example_id``: the sample of each sweep and target. ``keys`` as :func:`arrivals` gives them.

    Sweeps that draw on one dataset, split and seed share one order of its keys, so a ledger serves them all: it holds each
    pool's keys up to the largest limit, and a sweep takes the ranks up to its own. A null limit takes all, 0 none. The ledger given grows by one step.
    """
    asked = sweep_pools(sweeps)
    quotas = asked.groupBy("pool", *DATASET, "seed").agg(F.max("quota").alias("most"), F.max(F.col("quota").isNull().cast("int")).alias("all"))
    quotas = quotas.select("pool", *DATASET, "seed", F.when(F.col("all") == 0, F.col("most")).alias("quota"))
    grown = book.advance(keys, quotas, DATASET)
    return grown.join(asked, "pool").filter("quota is null or rank <= quota").select("sweep_id", "dataset", "split", F.col("key").alias("example_id"))


def share_samples(keys: DataFrame, cuts: list[datetime | str], percent: int, book: SelectionLedger, seed: int = 0) -> DataFrame:
    """``dataset, split, example_id, version``: a sample of each dataset and split that grows with it to ``percent`` of its keys, rounded up.

    The ledger grows by one step for the keys that had arrived at each of ``cuts``. A quota so grows with what has arrived, and is filled from unseen keys of lowest
    hash priority; keys of earlier versions stay. ``version`` is the first step that chose the key, from 1.
    """
    keys = keys.withColumn("pool", F.concat_ws("|", *DATASET, F.lit(str(seed))))
    out = None
    for step, cut in enumerate(cuts, 1):
        there = keys.filter(F.col("arrival") <= F.lit(cut).cast("timestamp"))
        quotas = there.groupBy("pool", *DATASET).agg(F.ceil(F.count("*") * percent / 100).cast("int").alias("quota")).withColumn("seed", F.lit(seed))
        grown = book.advance(there.drop("pool"), quotas, DATASET, ["priority"])
        fresh = grown if out is None else grown.join(out.select("pool", "key"), ["pool", "key"], "left_anti")
        fresh = fresh.select("pool", "key", F.lit(step).alias("version"))
        out = fresh if out is None else out.unionByName(fresh)
    named = keys.select("pool", *DATASET).distinct()
    return out.join(named, "pool").select(*DATASET, F.col("key").alias("example_id"), "version")
