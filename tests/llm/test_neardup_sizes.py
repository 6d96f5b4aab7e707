import random

from pyspark.sql import functions as F

from quillspark.llm.neardup import group_pairs, near_duplicate_groups
from test_linkage_sizes import VOCABULARY, edited_pairs, shingles


def _reordered(count, seed):
    """Pairs of short lines in another order, with a likeness of 0.6 or more."""
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        lines = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(6, 9))) for _ in range(rng.randint(5, 30))]
        other = list(lines)
        for _ in range(len(lines) // 6 + 1):
            at = rng.randrange(len(lines) - 1)
            other[at], other[at + 1] = other[at + 1], other[at]
        a, b = shingles("\n".join(lines)), shingles("\n".join(other))
        if 0.6 <= len(a & b) / len(a | b) < 1:
            out.append(("\n".join(lines), "\n".join(other)))
    return out


def test_pairs_around_24_and_40_shingles_and_reordered_lines(spark):
    base = VOCABULARY[:42]
    inserted = base[:10] + ["x1"] + base[10:20] + ["x2"] + base[20:31] + ["x3"] + base[31:]
    pairs = [(" ".join(base), " ".join(inserted))] + edited_pairs([24, 40], 0.6, 0.7, 3, each=30) + _reordered(20, 5)
    rows = [(2 * i + side, text) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    groups = near_duplicate_groups(spark.createDataFrame(rows, "id long, content string"), "id", F.col("content"), 0.6, 3)
    assert {tuple(r) for r in group_pairs(groups).collect()} >= {(2 * i, 2 * i + 1) for i in range(len(pairs))}
