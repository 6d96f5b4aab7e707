import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.operators.components import connected_components
from quillspark.operators.hierarchy import descendants, hierarchy
from quillspark.plans import all_oracle_sql, all_queries
from quillspark.plans.sql_queries import with_views
from quillspark.sources.files import csv_to_markdown, html_to_markdown, read_documents

ROWS = [("a", None), ("b", " a "), ("c", "b"), ("c", "b"), ("d", "gone"), ("e", " "), ("x", "y"), ("y", "x"), ("z", "x"), ("zz", "z"), ("s", "s"), (None, "a")]
EXPECTED = {"a": ("a", 0, "a"), "b": ("a", 1, "a/b"), "c": ("a", 2, "a/b/c"), "d": ("d", 0, "d"), "e": ("e", 0, "e"), "x": ("", -1, ""), "y": ("", -1, ""), "z": ("", -2, ""), "zz": ("", -2, ""), "s": ("", -1, "")}


@pytest.mark.parametrize("fragment_rows", [1000, 3])
def test_hierarchy(spark, fragment_rows):
    df = spark.createDataFrame(ROWS, "id string, parent_id string").withColumn("node", F.lit(1))
    found = {r.topic_id: (r.root_id, r.depth, r.path) for r in hierarchy(df, fragment_rows=fragment_rows).collect()}
    assert found == EXPECTED


def test_hierarchy_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(60)], "id string, parent_id string")
    paths = hierarchy(chain, fragment_rows=10)
    assert {r.topic_id: r.depth for r in paths.collect()} == {f"n{i}": i for i in range(60)}
    assert descendants(paths).count() == 60 * 59 // 2
    assert hierarchy(chain.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7}


def test_bm25_against_the_formula(spark):
    docs = {"a": "red green", "b": "red red blue", "c": "yellow", "d": None, "e": "", "f": "grey", "g": "black"}
    found = R.bm25(spark.createDataFrame(list(docs.items()), "id string, content string"), spark.createDataFrame([(1, "Red"), (2, "red yellow")], "request_id long, query string")).collect()
    sized = {k: v.split() for k, v in docs.items() if v is not None}
    avg = sum(map(len, sized.values())) / len(sized)
    idf = math.log((len(sized) - 2 + 0.5) / (2 + 0.5))
    tf = sized["b"].count("red")
    expected = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / avg))
    assert abs(next(r.score for r in found if (r.request_id, r.id) == (1, "b")) - expected) < 1e-8
    assert {r.id for r in found if r.request_id == 2} == {"a", "b", "c"}  # none holds both, so any


def test_knn_with_dirt_and_ties(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [5.0, 5.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.0, 0.0])], "request_id long, embedding array<double>")
    assert [(r.id, r.place) for r in R.knn(vectors, asked, 2).orderBy("place").collect()] == [(1, 1), (2, 2)]
    assert R.knn(vectors, asked.limit(0), 2).count() == 0


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "request_id long, id string, place int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "request_id long, id string, place int")
    fused = R.fuse(a, b).orderBy("place").collect()
    assert [r.id for r in fused] == ["y", "x", "z"] and abs(fused[0].score - (1 / 62 + 1 / 61)) < 1e-9
    ranked = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.99), (1, "c", 0.2)], "request_id long, id string, score double")
    assert [r.id for r in R.diversify(ranked, 0.9).orderBy("place").collect()][:2] == ["a", "c"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>T</h1><script>x</p></script><p>one <b>two</b> <a href='u'>l</a></p>")
    (tmp_path / "b.csv").write_text("a,b\n1\n2,3|,4\n")
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.bin").write_text("x")
    found = {r.extension: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert found["html"].content == "# T\n\none **two** [l](u)" == html_to_markdown((tmp_path / "a.html").read_text())
    assert found["csv"].content.splitlines()[2:] == ["| 1 |  |", "| 2 | 3\\| |"] and csv_to_markdown("") == ""
    assert found["json"].content is None and found["json"].error and found["bin"].error == "no parser for .bin"


def test_every_plan_has_sql_and_views():
    assert set(all_oracle_sql()) <= set(all_queries())
    assert with_views("SELECT 1 FROM tags").index("docs AS") < with_views("SELECT 1 FROM tags").index("tags AS")
