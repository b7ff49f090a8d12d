import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from akin.sources import scratch


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        return self.value or default


def fake(master, folder=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=Conf(folder), sparkContext=context)


def test_the_folder_of_the_cluster_is_used():
    assert scratch.scratch_root(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    path = scratch.scratch_path(fake("yarn", "hdfs:///shared"), "x")
    assert path.startswith("hdfs:///shared/akin/app-yarn/x-")


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(fake("yarn"))


def test_local_mode_may_use_a_temporary_folder():
    session = fake("local[2]")
    assert scratch.scratch_root(session) == scratch.scratch_root(session)


def test_written_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "a long, b array<string>, c double")
    again = scratch.written(df, "t")
    assert again.schema.simpleString() == df.schema.simpleString() and again.collect() == df.collect()


def test_a_discarded_table_is_gone_from_the_disk(spark):
    from akin.sources.scratch import discard

    table, other = scratch.written(spark.range(10).toDF("x"), "gone"), scratch.written(spark.range(5).toDF("x"), "kept")
    path = table._scratch_path
    assert table.count() == 10 and spark.read.parquet(path).count() == 10
    scratch.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert other.count() == 5


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_the_shuffle_files_of_a_write_go_with_it(spark):
    grouped = spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(scratch.CLEAN_UP)
    table = scratch.written(grouped, "grouped")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 1000
    # The frame itself can still be run, and other queries are as they were.
    assert grouped.count() == 1000 and spark.conf.get(scratch.CLEAN_UP) == setting


def test_long_rows_go_to_python_in_small_batches(spark):
    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64()), "n": pa.array([batch.num_rows], pa.int64())})

    before = spark.conf.get(scratch.BATCH)
    long = spark.range(0, 3000, numPartitions=1).select(F.repeat(F.lit("abcdefgh"), 1250).alias("text"))
    found = scratch.written(long.mapInArrow(size, "bytes long, n long"), "sizes").agg(F.max("bytes"), F.sum("n")).first()
    assert found[0] < 3 * scratch.BATCH_BYTES and found[1] == 3000 and spark.conf.get(scratch.BATCH) == before
