import numpy as np

from quillspark.plans.retrieval_queries import queries


def test_all_elements_of_the_mean_come_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 64)).astype("f4")
    rows = [(f"c{i}", i % 2, [float(v) for v in x[i]]) for i in range(6)] + [("short", 0, [1.0])]
    spark.createDataFrame(rows, "chunk_id string, document_id long, embedding array<float>").write.parquet(f"{tmp_path}/kb_embeddings.parquet")
    got = {r.document_id: r.embedding for r in queries()["agg_11_mean_vectors"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1} and all(len(v) == 64 for v in got.values())
    for k in got:
        assert np.allclose(got[k], x[k::2].astype("f8").mean(0), atol=1.01e-5)
