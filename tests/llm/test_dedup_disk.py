"""What near-duplicate search and record linkage keep on disk: no sets of shingles of all texts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.llm.linkage import History
from quillspark.llm.neardup import near_duplicate_groups
from quillspark.session import Scratch
from test_linkage_sizes import VOCABULARY

ROWS, WORDS = 600, 400


@pytest.fixture
def texts(spark):
    rng = random.Random(3)
    rows = [(i, 1, "t", " ".join(rng.choice(VOCABULARY) for _ in range(WORDS)), None) for i in range(ROWS)]
    return spark.createDataFrame(rows, "id long, batch long, title string, content string, url string")


def _bytes(folder) -> int:
    return sum(f.stat().st_size for f in Path(str(folder).removeprefix("file:")).rglob("*.parquet"))


def test_near_duplicates_keep_no_sets_of_all_texts(spark, texts, monkeypatch):
    most, call = [0], Scratch.__call__

    def spied(self, df, name="cut"):
        out = call(self, df, name)
        most[0] = max(most[0], sum(_bytes(p) for p in self.paths))
        return out

    monkeypatch.setattr(Scratch, "__call__", spied)
    assert near_duplicate_groups(texts, "id", F.col("content"), 0.6, 3).count() == ROWS
    assert most[0] < ROWS * WORDS * 8  # the sets of all texts alone


def test_history_keeps_texts_not_sets(spark, texts, tmp_path):
    History(spark, f"file://{tmp_path}/h").accept(texts)
    assert _bytes(f"{tmp_path}/h/classes") < ROWS * WORDS * 6  # the sets are 8 bytes a word


def test_history_moves_texts_of_candidates_not_sets(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(0, ROWS, 2):
        words = [rng.choice(VOCABULARY[:200]) for _ in range(WORDS)]
        rows += [(i, 1, "t", " ".join(words), None), (i + 1, 2, "t", " ".join(words[:-20]), None)]
    most, call = {}, Scratch.__call__

    def spied(self, df, name="cut"):
        out = call(self, df, name)
        most[name] = max(most.get(name, 0), _bytes(self.paths[-1]))
        return out

    monkeypatch.setattr(Scratch, "__call__", spied)
    found = History(spark).accept(spark.createDataFrame(rows, "id long, batch long, title string, content string, url string")).collect()
    assert sorted((r.id_a, r.id_b) for r in found) == [(i, i + 1) for i in range(0, ROWS, 2)]
    assert all(abs(r.likeness - (WORDS - 22) / (WORDS - 2)) < 0.02 for r in found)
    assert max(most.values()) < ROWS * WORDS * 5, most  # their sets are 8 bytes a word
