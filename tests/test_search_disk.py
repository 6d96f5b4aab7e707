"""What the registered searches leave on disk beside their tables: no shuffle files of the steps that are over."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.plans import all_queries
from quillspark.session import materialize
from test_search_sizes import _shuffled, folder  # noqa: F401

NAMES = [
    "rnk_01_search",
    "rnk_04_fusion",
]


def _kept(spark) -> int:
    """Bytes of shuffle files in the folders of this process."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*"))


def test_a_written_table_keeps_no_shuffle_files(spark):
    before = _kept(spark)
    rows = materialize(spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").alias("x"), "id").groupBy("x").agg(F.min("id").alias("id")))
    assert rows.count() == 200_000
    assert _kept(spark) - before < 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


@pytest.mark.parametrize("name", NAMES)
def test_searches_keep_no_shuffle_files(spark, folder, name):  # noqa: F811
    before = _kept(spark)
    all_queries()[name](spark, folder)
    assert _kept(spark) - before < 100_000


def test_nearest_vectors_shuffle_one_list_a_task(spark):
    rows = spark.range(0, 20_000, 1, 2).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.xxhash64("id", i) % 1000 / 1000.0).alias("embedding"))
    rows = materialize(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        before = _shuffled(spark)
        found = R.knn(rows, rows.where("id < 100").withColumnRenamed("id", "request_id"), 10).collect()
        moved = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 1000 and all(r.id == r.request_id for r in found if r.place == 1)
    assert moved < 300_000, moved  # one list of 10 a query from each of a few tasks, whatever the number of batches
