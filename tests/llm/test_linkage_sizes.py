import random
import re

from quillspark.llm.linkage import History

VOCABULARY = [f"v{i}" for i in range(20_000)]


def shingles(text, width=3):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def edited_pairs(sizes, least, most, seed, each=12):
    """Pairs of texts on both sides of the given sizes, with a likeness between the bounds: words inserted, dropped, replaced."""
    rng = random.Random(seed)
    out = []
    while len(out) < each * len(sizes):
        size = sizes[len(out) // each]
        base = [rng.choice(VOCABULARY) for _ in range(int(size * rng.uniform(0.87, 1)))]
        edited = list(base)
        while len(edited) < size + 4 or rng.random() < 0.8:
            kind, at = rng.random(), rng.randrange(len(edited))
            edited[at : at + (kind > 0.8)] = [rng.choice(VOCABULARY)] if kind < 0.95 else []
        a, b = shingles(" ".join(base)), shingles(" ".join(edited))
        if len(a) < size <= len(b) and least <= len(a & b) / len(a | b) <= most:
            out.append((" ".join(base), " ".join(edited)))
    return out


def test_pairs_on_both_sides_of_128_and_256_shingles(spark):
    pairs = edited_pairs([128, 256], 0.6, 0.75, 7)
    rows = [(2 * i + side, side + 1, "t", text, None) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    df = spark.createDataFrame(rows, "id long, batch long, title string, content string, url string")
    found = {(r.id_a, r.id_b) for r in History(spark).accept(df).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(len(pairs))}
