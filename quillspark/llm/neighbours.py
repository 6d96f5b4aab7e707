"""Most similar vectors for every vector by multiprobe cross-polytope hashing and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize, partitions_for


def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform."""
    n, d = x.shape
    for s in signs:
        x = x * s
        half = 1
        while half < d:
            y = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
        x = x * np.float32(d**-0.5)
    return x


class CrossPolytope:
    """Hash tables of signed axes: ``tables`` tables, each of one full axis and as many parts of others as ``rows`` ask for."""

    def __init__(self, dim: int, rows: int, tables: int, cell_rows: int = 1000, seed: int = 20):
        self.dim, self.padded, self.tables = dim, 1 << max(1, (dim - 1).bit_length()), tables
        cells, self.parts = max(1, rows // cell_rows), [self.padded]
        left = cells // (2 * self.padded)
        while left > 1:
            self.parts.append(min(self.padded, 1 << max(0, (left // 2).bit_length() - 1)))
            left //= 2 * self.parts[-1]
        self.probes_at_most = max(1, sum(p - 1 for p in self.parts))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1, 1], "f4"), (tables, len(self.parts), 3, self.padded))

    def cells(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The cell of each vector and its ``probes`` next likely cells: those with the next axis in one of the parts."""
        full = np.zeros((len(x), self.padded), "f4")
        full[:, : self.dim] = x
        own = np.zeros(len(x), "i8")
        others = []
        scale = 1
        for part, size in enumerate(self.parts):
            y = _rotate(full, self.signs[table, part])[:, :size]
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : 1 + min(probes, size - 1)]
            signed = np.take_along_axis(y, top, 1)
            codes = 2 * top + (signed < 0)
            code = codes[:, 0]
            for nth in range(1, top.shape[1]):
                others.append((np.abs(signed[:, 0]) - np.abs(signed[:, nth]), (codes[:, nth] - code) * scale))
            own += code * scale
            scale *= 2 * size
        out = [own]
        if others and probes:
            gaps, moves = np.stack([o[0] for o in others], 1), np.stack([o[1] for o in others], 1)
            order = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
            out += list((own[:, None] + np.take_along_axis(moves, order, 1)).T)
        return np.stack(out, 1)


class Plan(NamedTuple):
    """Shape of the hash: rows of a cell, tables, probes, and the recall expected of them."""

    cell_rows: int
    tables: int
    probes: int
    recall: float


def plan_hash(dim: int, rows: int, likely: np.ndarray, target: float, pairs: int = 800, seed: int = 5) -> Plan:
    """The cheapest shape whose expected recall of pairs with the similarities ``likely`` reaches ``target``.

    Recall is estimated on random pairs of those similarities, which meet if either one looks into the cell of the
    other in any table; so it is right for each number of rows, as cells get finer with it. The cost is the number of
    comparisons and of rows moved. Where no shape reaches the target, the one of the highest recall is taken.
    """
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(pairs, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(pairs, dim))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cos = np.clip(np.quantile(likely, (np.arange(pairs) + 0.5) / pairs), -1, 1)[:, None]
    y = (cos * x + np.sqrt(1 - cos * cos) * y).astype("f4")
    x = x.astype("f4")
    most_tables, most_probes, found = 16, 40, []
    for cell_rows in (500, 1000, 2000, 4000, 16_000, 64_000, 1 << 40):
        if cell_rows > rows and found and cell_rows < 1 << 40:
            continue
        hasher = CrossPolytope(dim, rows, most_tables, cell_rows)
        cells = 2.0 ** sum(np.log2(2 * p) for p in hasher.parts)
        ranks = np.full((most_tables, pairs), 1 << 30)
        for t in range(most_tables):
            a, b = hasher.cells(x, t, most_probes), hasher.cells(y, t, most_probes)
            for own, other in ((a, b), (b, a)):
                same = own == other[:, :1]
                ranks[t] = np.minimum(ranks[t], np.where(same.any(1), same.argmax(1), 1 << 30))
        for tables in range(2, most_tables + 1):
            best = ranks[:tables].min(0)
            for probes in (0, 1, 2, 4, 8, 16, 24, 40):
                cost = tables * (1 + probes) * (rows / cells + 2000)
                found.append((cost, Plan(cell_rows, tables, min(probes, hasher.probes_at_most), float((best <= probes).mean()))))
    enough = [f for f in found if f[1].recall >= target]
    return min(enough)[1] if enough else max(found, key=lambda f: f[1].recall)[1]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "f4").reshape(-1, dim)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, vec)``: unit vectors as float bytes, one for each id, of the vectors that can be compared.

    Null ids and null vectors, other lengths, vectors with null or non-finite elements and all-zero ones
    are left out; of differing rows of one id the smallest vector counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1)
            flat, ends = vectors.flatten(), np.concatenate([[0], np.cumsum(np.array([len(v) if v is not None else 0 for v in vectors]))])
            values = flat.to_numpy(zero_copy_only=False).astype("f8")
            rows = [i for i in range(len(ids)) if ends[i + 1] - ends[i] == dim]
            x = values[np.add.outer(ends[rows], np.arange(dim))] if rows else np.empty((0, dim))
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good]
            top = np.abs(x).max(1, keepdims=True) if len(x) else np.ones((0, 1))
            x = x / top
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype("f4") + np.float32(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, g in zip(rows, good) if g], pa.string()), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "vec"]
            )

    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "id string, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def likely_similarities(classes: DataFrame, k: int, dim: int, sample: int) -> np.ndarray:
    """The similarities of the k nearest others of ``sample`` vectors (those with the smallest hashes), exactly.

    The sample is a fixed bound of the index's design; the vectors are read once for it and only k numbers for each
    sampled vector and task leave a task.
    """
    asked = classes.orderBy(F.xxhash64("vec"), "cid").limit(sample).select("cid", "vec").toPandas()
    if not len(asked):
        return np.empty(0)
    ids, q = asked["cid"].to_numpy(), np.frombuffer(b"".join(map(bytes, asked["vec"])), "f4").reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -2, "f4")
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                s = q @ _matrix(batch.column(0), dim).T
                s[ids[:, None] == batch.column(1).to_numpy()[None]] = -2
                best = -np.sort(-np.concatenate([best, s], axis=1), axis=1)[:, :k]
        r, c = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype("i4")), pa.array(best[r, c].astype("f8"))], names=["q", "s"])

    rows = classes.select("vec", "cid").mapInArrow(run, "q int, s double")
    top = rows.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("nth") <= k)
    return top.select("s").toPandas()["s"].to_numpy()


def nearest_neighbours(
    df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", k: int = 10, dim: int = 64, least: float | None = None, target: float | None = None, sample: int = 400, block: int = 8192, plan: Plan | None = None
) -> DataFrame:
    """``(id, neighbour, similarity, place)``: for every usable vector its k most similar ones by cosine.

    Places run from 1; equal similarities (to nine digits) go by the smaller id. With ``least``, neighbours under it
    are not listed. Copies of a direction are one class, hashed and compared once; of each class only the k + 1
    smallest ids can be anyone's neighbours. Each class lies in one cell of every table and also looks into
    some other cells; candidates are compared exactly, and what one finds counts for both.

    Rows of a cell, tables and probes are chosen by ``plan_hash`` so that the expected recall is ``target``: 0.97 of
    pairs right at ``least``, or else 0.93 of the true neighbours of ``sample`` vectors. Every vector is indexed. A cell with more
    than ``block`` rows is cut into sub-cells that every query of the cell visits. Vectors that cannot be compared have
    no rows, an empty table gives none.
    """
    spark = df.sparkSession
    vectors = materialize(usable_vectors(df, id_col, vector_col, dim), "vectors")
    firsts = vectors.groupBy("vec").agg(F.min("id").alias("first"))
    classes = materialize(firsts.orderBy("first").select("vec", F.monotonically_increasing_id().alias("cid")), "classes")
    count = classes.count()
    members = materialize(vectors.join(classes, "vec").select("id", "cid"), "members")
    if plan is None:
        likely = np.array([least]) if least is not None else likely_similarities(classes, k, dim, sample)
        plan = plan_hash(dim, count, likely if len(likely) else np.array([1.0]), target or (0.97 if least is not None else 0.93))
    floor = -2.0 if least is None else least
    tables, probes = plan.tables, plan.probes
    hasher = CrossPolytope(dim, count, tables, plan.cell_rows)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch.column(0), dim)
                cells = np.stack([hasher.cells(x, table, probes) for table in range(tables)], 1)
                width = cells.shape[2]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), lists(cells[:, :, 0]), lists(cells.reshape(len(x), tables * width))], names=["cid", "vec", "own", "cells"])

    index = materialize(classes.mapInArrow(hashed, "cid bigint, vec binary, own array<bigint>, cells array<bigint>"), "hashed")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                if not n:
                    continue
                cells = batch.column(2).flatten().to_numpy().reshape(n, tables, -1)
                for table in range(tables):
                    for probe in range(cells.shape[2]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, table, "i4")), pa.array(np.ascontiguousarray(cells[:, table, probe])), pa.array(np.full(n, probe == 0)), batch.column(0), batch.column(1)], names=["tab", "cell", "stored", "cid", "vec"]
                        )

    placed = index.select("cid", "vec", "cells").mapInArrow(place, "tab int, cell bigint, stored boolean, cid bigint, vec binary")
    sizes = index.select(F.posexplode("own").alias("tab", "cell"))
    large = sizes.groupBy("tab", "cell").count().where(F.col("count") > block).select("tab", "cell", F.ceil(F.col("count") / block).cast("int").alias("cuts"))
    large = materialize(large, "large-cells")
    if large.limit(1).count():
        split = placed.join(large, ["tab", "cell"], "left").na.fill(1, ["cuts"])
        # a stored row has its own sub-cell, and as a query it visits all of them
        home = F.pmod(F.xxhash64("cid"), F.col("cuts").cast("bigint")).cast("int")
        stops = split.withColumn("home", home).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        placed = stops.select("tab", "cell", "sub", (F.col("stored") & (F.col("sub") == F.col("home"))).alias("stored"), "cid", "vec")
    else:
        placed = placed.withColumn("sub", F.lit(0)).select("tab", "cell", "sub", "stored", "cid", "vec")
    tasks = partitions_for(count * tables * (1 + probes), 200_000, spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        del parts
        tab, cell, sub = (whole.column(i).to_numpy() for i in range(3))
        stored, cid = whole.column(3).to_numpy(), whole.column(4).to_numpy()
        x = np.concatenate([_matrix(c, dim) for c in whole.column(5).chunks])
        del whole
        order = np.lexsort((sub, cell, tab))
        tab, cell, sub, stored, cid, x = tab[order], cell[order], sub[order], stored[order], cid[order], x[order]
        cut = np.flatnonzero((tab[1:] != tab[:-1]) | (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(tab)]):
            base = a + np.flatnonzero(stored[a:b])
            if not len(base):
                continue
            right = np.ascontiguousarray(x[base].T)
            for at in range(a, b, 1024):
                to = min(at + 1024, b)
                near = x[at:to] @ right
                near[cid[at:to, None] == cid[base][None]] = -3
                guests = np.flatnonzero(~stored[at:to])
                r, c = _best(near, k + 1, floor)
                yield from _measured(x, cid, r + at, base[c], k + 1, floor)
                if len(guests):  # who is looked up by a guest gets the guest as a candidate too
                    c, r = _best(near[guests].T, k + 1, floor)
                    yield from _measured(x, cid, base[c], guests[r] + at, k + 1, floor)

    hits = placed.repartition(tasks, "tab", "cell", "sub").mapInArrow(compare, "cid bigint, other bigint, similarity double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            whole = pa.Table.from_batches(parts)
            yield from _top(*(whole.column(i).to_numpy() for i in range(3)), k + 1, floor)

    best = hits.repartition(tasks, "cid").mapInArrow(merge, "cid bigint, other bigint, similarity double")
    smallest = members.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("nth") <= k + 1)
    smallest = smallest.select(F.col("cid").alias("other"), F.col("id").alias("neighbour"))
    own = classes.select("cid", F.col("cid").alias("other"), F.lit(1.0).alias("similarity"))
    near = best.unionByName(own).join(smallest, "other").select("cid", "neighbour", F.round("similarity", 9).alias("similarity"))
    by_class = Window.partitionBy("cid").orderBy(F.desc("similarity"), "neighbour")
    lists = near.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1).select("cid", "neighbour", "similarity", "nth")
    lists = lists.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", "similarity"))).alias("near"))
    wide = members.join(lists, "cid").select("id", F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("id")), 1, k).alias("near"))
    return wide.select("id", F.posexplode("near").alias("pos", "n")).select("id", F.col("n.neighbour").alias("neighbour"), F.col("n.similarity").alias("similarity"), (F.col("pos") + 1).alias("place"))


def _best(near: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's entries from ``least`` on, the ``most`` best of them and those that may tie."""
    if least <= 0 and near.shape[1] > most + 4:
        last = -np.partition(-near, most - 1, axis=1)[:, most - 1 : most]
        return np.nonzero((near >= last - 1e-6) & (near > -2.5))
    return np.nonzero(near >= max(least - 1e-4, -2.5))


def _measured(x: np.ndarray, cid: np.ndarray, query: np.ndarray, other: np.ndarray, most: int, least: float) -> Iterator[pa.RecordBatch]:
    """The best pairs of each query by their exact similarity."""
    for at in range(0, len(query), 100_000):
        q, o = query[at : at + 100_000], other[at : at + 100_000]
        a, b = x[q].astype("f8"), x[o].astype("f8")
        exact = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        yield from _top(cid[q], cid[o], exact, most, least)


def _top(query: np.ndarray, other: np.ndarray, similarity: np.ndarray, most: int, least: float) -> Iterator[pa.RecordBatch]:
    """The ``most`` best others of each query, each once."""
    fits = similarity >= least - 1e-9
    query, other, similarity = query[fits], other[fits], similarity[fits]
    order = np.lexsort((other, -np.round(similarity, 9), query))
    query, other, similarity = query[order], other[order], similarity[order]
    if not len(query):
        return
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (other[1:] != other[:-1])
    query, other, similarity = query[once], other[once], similarity[once]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    nth = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate([start, [len(query)]])))
    use = nth < most
    query, other, similarity = query[use], other[use], similarity[use]
    for at in range(0, len(query), 100_000):
        s = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(query[s]), pa.array(other[s]), pa.array(similarity[s])], names=["cid", "other", "similarity"])


def similar_pairs(near: DataFrame) -> DataFrame:
    """``(chunk_a, chunk_b)``, each pair once, of ids where one is among the nearest of the other."""
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
