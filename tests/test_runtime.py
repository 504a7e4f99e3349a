import os

import pytest
from pyspark.sql import functions as F

from trawl import runtime


def test_shared_folder_and_steps(spark):
    folder = runtime.shared_dir(spark)
    assert runtime.shared_dir(spark) == folder
    df = runtime.materialize(spark.range(10).withColumn("p", F.col("id") % 2), "step", ["p"])
    assert df.where("p = 1").count() == 5 and df._trawl_path.startswith(folder)
    runtime.discard(df)
    assert not os.path.exists(df._trawl_path.removeprefix("file://"))
    empty = runtime.materialize(spark.range(0), "empty")
    assert empty.count() == 0 and empty.columns == ["id"]
    assert runtime.partitions(spark) >= 4


def test_paths_are_new(spark):
    assert runtime.new_path(spark, "x") != runtime.new_path(spark, "x")


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())


def test_package_reaches_workers(spark):
    @F.udf("string")
    def where(_):
        import trawl

        return trawl.__version__

    assert spark.range(1).select(where("id")).first()[0] == "0.1.0"


def test_tables_as_file_or_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert runtime.table(spark, str(tmp_path), "t").count() == 3
