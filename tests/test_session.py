import pytest

from gradloom import session


class Stub:
    """A session without the option, on a given master."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"

    def get(self, name, default=None):
        return default

    def getConf(self):
        return self


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Stub(master))
    for master in ("local", "local[8]"):
        assert session.shared_folder(Stub(master)) == session.shared_folder(Stub(master))


def test_the_named_folder_is_used_and_cleared(spark, tmp_path):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = session.materialise(spark.range(3).toDF("x"), "numbers")
    assert kept.inputFiles()[0].removeprefix("file://").startswith(base.removeprefix("file:"))
    assert kept.count() == 3
    assert session.discard_work(spark) >= 1 and session.discard_work(spark) == 0


def test_spread_looks_at_files_only(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(16).write.parquet(f"{tmp_path}/many")
    assert session.spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.read.parquet(f"{tmp_path}/many")
    assert session.spread(many) is many
    assert session.partitions_for(many) == int(spark.conf.get("spark.sql.shuffle.partitions"))
