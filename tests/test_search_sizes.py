"""What the registered searches move where a query's words are in every chunk: far less than a row for each query and chunk."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.plans import all_queries

NAMES = [
    "rnk_01_search",
    "rnk_03_bm25_stemmed",
    "rnk_06_diversity",
    "udf_08_contexts",
    "agg_17_quality",
    "prj_01_explained",
    "rnk_04_fusion",
    "rnk_03_bm25",
    "rnk_01_search_stemmed",
    "rnk_05_title_boost",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("searches")
    docs = spark.range(1, 2401).select("id", F.concat(F.lit("red gate w"), (F.col("id") % 60).cast("string")).alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"))
    chunks = spark.range(0, 4800).select(F.format_string("c%05d", "id").alias("id"), (F.col("id") / 2 + 1).cast("long").alias("document_id"), (F.col("id") % 2).cast("int").alias("chunk_index"), F.concat(F.lit("red gate w"), (F.col("id") % 50).cast("string")).alias("content"))
    vectors = chunks.where("document_id <= 200").select(F.col("id").alias("chunk_id"), "document_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.xxhash64("id", i) % 100) / 100).cast("float")).alias("embedding"))
    for name, df in (("kb_documents", docs), ("kb_chunks", chunks), ("kb_embeddings", vectors)):
        df.repartition(4).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    time.sleep(1)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("name", NAMES)
def test_searches_shuffle_no_pairs(spark, folder, name):
    before = _shuffled(spark)
    rows = all_queries()[name](spark, folder).collect()
    moved = _shuffled(spark) - before
    assert moved < 5_000_000, moved  # 120 queries x 4,800 chunks were several times that
    assert len(rows) == 1 if name == "agg_17_quality" else len({r["request_id"] for r in rows}) == 120
