"""Components of long paths: the rounds do not grow with their length, and nothing but the result stays on disk."""

import random
from pathlib import Path

from quillspark.operators.components import connected_components
from quillspark.session import shared_dir


def test_long_paths_with_names_in_any_order(spark):
    names = list(range(1500))
    random.Random(5).shuffle(names)
    rows = [(f"n{a:05d}", f"n{b:05d}") for a, b in zip(names, names[1:])] + [("x2", "x1"), ("x3", "x2"), ("x4", "x4"), ("x1", "x3")]
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src string, dst string"), max_rounds=20).collect()}
    assert found == {f"n{i:05d}": "n00000" for i in names} | {"x1": "x1", "x2": "x1", "x3": "x1", "x4": "x4"}
    assert len(set(folder.iterdir()) - before) == 1


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, None)], "src long, dst long")).collect() == []
