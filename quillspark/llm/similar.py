"""Exact similarity joins on word shingles by vertical partitioning.

Two texts of a likeness (Jaccard of distinct ``width``-word runs) of at least t agree in one of their band keys, hashes
of the smallest shingles under random orders, but for a chance of MISS; so it is for every size and every kind of
edit. The order of keys is cut into fragments, each fragment counts what the pairs of texts share in it, the counts
are summed for each pair, and the pairs are verified on the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shingles as sh
from quillspark.session import materialize, partitions_for

#: Postings longer than this are not paired within one task but by a salted join.
HOT = 256
#: 64-bit words of the bitmap that bounds the overlap of two sets.
BITMAP = 16
SLICE = 1000
#: Smallest hashes that make one band key.
ROWS = 4
#: The chance at most that a pair right at the threshold shares no band key.
MISS = 1e-6


def bands_for(threshold: float) -> int:
    """How many band keys a text needs so that a pair of likeness ``threshold`` shares none with a chance of MISS."""
    return int(np.ceil(np.log(MISS) / np.log1p(-min(threshold, 0.999) ** ROWS)))


def band_keys(flat: np.ndarray, ends: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct band keys of each set: every key hashes the smallest values of the set under ROWS random orders.

    Two sets agree in a key with a chance of likeness ** ROWS, whatever their sizes and wherever their members
    differ. An empty set has no keys.
    """
    count = len(ends) - 1
    some = np.flatnonzero(np.diff(ends))
    draw = np.random.default_rng(20240601)
    keys = np.empty((len(some), bands), "u8")
    for band in range(bands):
        key = np.full(len(some), np.uint64(band))
        for _ in range(ROWS):
            mask, factor = (draw.integers(0, 1 << 63, dtype="u8") for _ in range(2))
            if len(some):
                key = sh.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ mask) * (factor | np.uint64(1)), ends[some]))
        keys[:, band] = key
    return sh.distinct(keys.ravel(), np.repeat(some, bands), count)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view("i8"), pa.int64()))


def _bitmaps(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    count = len(ends) - 1
    bits = np.zeros((count, BITMAP * 64), bool)
    bits[np.repeat(np.arange(count), np.diff(ends)), (flat >> np.uint64(17)) % np.uint64(BITMAP * 64)] = True
    return _lists(np.packbits(bits, axis=1).view("u8").ravel(), np.arange(0, count * BITMAP + 1, BITMAP))


def shingle_features(df: DataFrame, text: Column, keep: list[str], width: int = 3, threshold: float = 0.6, add: tuple[str, ...] = ("bitmap", "shingles", "grams")) -> DataFrame:
    """Per row of ``df``: its ``keep`` columns, number and set of shingles, and its join keys.

    Adds ``n`` (distinct shingles), ``set_a``/``set_b`` (a 128-bit hash of the set) and, of ``add``, ``bitmap``, ``shingles`` and
    ``grams`` (the band keys to join on). A null text, and one with fewer words than ``width``, has n = 0 and no keys.
    """
    bands = bands_for(threshold)
    spark = df.sparkSession
    source = df.select(*keep, text.alias("_text"))
    fields = {f.name: f for f in source.schema.fields}
    schema = ", ".join(f"{k} {fields[k].dataType.simpleString()}" for k in keep) + ", n int, set_a bigint, set_b bigint" + "".join(f", {x} array<bigint>" for x in add)
    of = {"bitmap": _bitmaps, "shingles": _lists, "grams": lambda flat, offs: _lists(*band_keys(flat, offs, bands))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                count = batch.num_rows
                hashes, ends = sh.word_hashes(batch.column(batch.num_columns - 1).to_pylist())
                flat, offs = sh.distinct(*sh.grams(hashes, ends, width), count)
                size = np.diff(offs)
                a, b = sh.set_hash(flat, offs)
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                cols += [pa.array(size, pa.int32()), pa.array(a), pa.array(b), *[of[x](flat, offs) for x in add]]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n", "set_a", "set_b", *add])

    return source.mapInArrow(run, schema)


def _sorted(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A fragment's postings in the order of their n-grams, and the length of each one's posting list."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return None
    gram, doc, new = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((doc, gram))
    gram, doc, new = gram[order], doc[order], new[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.concatenate([start, [len(gram)]]))
    return gram, doc, new, np.repeat(size, size)


def _partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One fragment of the n-gram order: count the partial overlap of each pair of texts in it."""
    if (found := _sorted(batches)) is None:
        return
    gram, doc, new, length = found
    use = length > 1
    gram, doc, new = gram[use], doc[use], new[use]
    left, right = [np.empty(0, "i8")], [np.empty(0, "i8")]
    step = 1
    while step < len(gram):
        i = np.flatnonzero(gram[step:] == gram[:-step])
        if not len(i):
            break
        i = i[new[i] | new[i + step]]
        left.append(doc[i])
        right.append(doc[i + step])
        step += 1
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    count = np.diff(np.concatenate([start, [len(a)]]))
    for at in range(0, len(start), 100_000):
        x = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(a[start[x]]), pa.array(b[start[x]]), pa.array(count[x])], names=["a", "b", "c"])


def pair_up(left: DataFrame, right: DataFrame, key: str, of: str, most: int = 2000) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; a key with more than ``most`` rows on the right is spread over tasks.

    Its right rows are dealt to as many salts by ``of``, a column of theirs, and its left rows go to each of the salts.
    """
    large = right.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_cuts"))
    cut_left, cut_right = (x.join(large, key, "left").na.fill(1, ["_cuts"]) for x in (left, right))
    a = cut_left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")
    b = cut_right.withColumn("_salt", F.pmod(F.xxhash64(of), F.col("_cuts").cast("bigint")).cast("int")).drop("_cuts")
    return a.join(b, [key, "_salt"]).drop("_salt")


def candidate_pairs(features: DataFrame, key: str, fragment_rows: int = 1_500_000, hot: int = HOT, cut: Callable = materialize) -> DataFrame:
    """Pairs ``(a, b, shared)``, a < b, of rows that share keys, with the number shared; see ``pairs_of_postings``."""
    total = int(features.select(F.sum(F.size("grams")).alias("s")).first()["s"] or 0)
    return pairs_of_postings(features.select(F.explode("grams").alias("gram"), F.col(key).alias("doc"), F.lit(True).alias("new")), total, fragment_rows, hot, cut)


def pairs_of_postings(postings: DataFrame, total: int, fragment_rows: int = 1_500_000, hot: int = HOT, cut: Callable = materialize) -> DataFrame:
    """Pairs ``(a, b, shared)``, a < b and one of them new, of the ``total`` postings ``(gram, doc, new)``.

    The order of keys is cut into fragments of about ``fragment_rows`` postings; every fragment counts its partial
    overlaps on its own, and the partial counts are summed for each pair. Keys with more than ``hot`` postings
    never enter a fragment: their postings are counted first and paired by a join salted by their number.
    """
    cuts = partitions_for(total, fragment_rows, postings.sparkSession)
    postings = postings.select("gram", "doc", "new")
    large = cut(postings.groupBy("gram").count().where(F.col("count") > hot), "hot-keys")
    is_hot = large.limit(1).count() > 0
    usual = postings.join(large.select("gram"), "gram", "left_anti") if is_hot else postings
    counted = cut(usual.repartition(cuts, "gram").mapInArrow(_partial_overlaps, "a bigint, b bigint, c bigint"), "overlaps")
    parts = counted
    if is_hot:
        rest = postings.join(large.select("gram"), "gram", "left_semi")
        more = (
            pair_up(rest.toDF("gram", "x", "new_x"), rest.toDF("gram", "y", "new_y"), "gram", "y", hot)
            .where("x < y and (new_x or new_y)")
            .groupBy(F.col("x").alias("a"), F.col("y").alias("b"))
            .agg(F.count("*").alias("c"))
        )
        parts = parts.unionByName(more)
    return parts.groupBy("a", "b").agg(F.sum("c").alias("shared"))


def _sets_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each text, flat, and their offsets."""
    parts = []
    for at in range(0, len(texts), SLICE):
        some = texts[at : at + SLICE]
        parts.append(sh.distinct(*sh.grams(*sh.word_hashes(some), width), len(some)))
    sizes = [np.diff(offs) for _, offs in parts]
    return np.concatenate([np.empty(0, "u8"), *[flat for flat, _ in parts]]), np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, "i8"), *sizes]))]).astype("i8")


def _rows_of(flat: np.ndarray, offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets number ``at``, one after the other, and for each value its place in ``at``."""
    size = offs[at + 1] - offs[at]
    start = np.cumsum(size) - size
    return flat[np.repeat(offs[at] - start, size) + np.arange(size.sum())], np.repeat(np.arange(len(at)), size)


def verified_links(pairs: DataFrame, features: DataFrame, key: str, threshold: float, sets: Callable, cut: Callable = materialize, width: int = 3) -> DataFrame:
    """The pairs whose likeness reaches ``threshold``, as ``(a, b, likeness)``: exact, on the shingle sets.

    Bitmaps of the sets (``n`` and ``bitmap`` of ``features``) bound the overlap from above (sets whose bitmaps differ in d bits have at
    most half of their sizes' sum less d in common). Only of the pairs that may reach the threshold are the sets needed: ``sets`` gives,
    for a table of the ids ``k`` in these pairs, ``(k, shingles)``, or ``(k, text)``: texts are moved as they are, a third of their sets,
    and their runs of ``width`` words are hashed beside the pairs; ``features`` are not read any more by then.
    """
    ids = cut(pairs.select("a", "b"), "pairs")
    bits = features.select(F.col(key).alias("k"), "n", *[F.col("bitmap")[i].alias(f"m{i}") for i in range(BITMAP)])
    joined = ids.join(bits.toDF("a", "na", *[f"x{i}" for i in range(BITMAP)]), "a").join(bits.toDF("b", "nb", *[f"y{i}" for i in range(BITMAP)]), "b")
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(BITMAP)), F.lit(0))
    most = (F.col("na") + F.col("nb") - apart) / 2
    fits = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")) & (most >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")))
    ids = cut(joined.where(fits & (F.col("na") > 0)).select("a", "b"), "bounded")
    body = sets(ids.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    of = "text" if "text" in body.columns else "shingles"
    body = cut(body.select("k", of), "sets")
    wide = ids.join(body.toDF("a", "sa"), "a").join(body.toDF("b", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(batch.schema.get_field_index(x)) for x in ("a", "b", "sa", "sb"))
            a, b, count = a.to_numpy(), b.to_numpy(), batch.num_rows
            if of == "text":
                _, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)  # the text of an id once a batch
                flat, offs = _sets_of(pa.concat_arrays([sa, sb]).take(pa.array(first)).to_pylist(), width)
            else:
                ends = [x.offsets.to_numpy().astype("i8") - x.offsets[0].as_py() for x in (sa, sb)]
                flat, offs, at = np.concatenate([sa.flatten().to_numpy(), sb.flatten().to_numpy()]), np.concatenate([ends[0], ends[0][-1] + ends[1][1:]]), np.arange(2 * count)
            size = offs[at + 1] - offs[at]
            for start in range(0, count, SLICE):
                some = np.arange(start, min(start + SLICE, count))
                both = [_rows_of(flat, offs, at[some + side]) for side in (0, count)]
                values, doc = (np.concatenate(x) for x in zip(*both))
                order = np.lexsort((values, doc))
                values, doc = values[order], doc[order]
                twice = (values[1:] == values[:-1]) & (doc[1:] == doc[:-1])
                common = np.bincount(doc[1:][twice], minlength=len(some))
                likeness = common / (size[some] + size[some + count] - common)
                near = likeness >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(a[some][near]), pa.array(b[some][near]), pa.array(likeness[near])], names=["a", "b", "likeness"])

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, likeness double")
