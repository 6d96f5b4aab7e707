"""Evaluation texts leaking into training text: a prefix-filtered join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shingles as sh

SLICE = 1000


def _item_shingles(items: list[tuple[int, str]], width: int, run: int) -> pd.DataFrame:
    """Every shingle of every text, ``item`` being the number of the text; an id with two texts is two of them."""
    hashes, ends = sh.word_hashes([t for _, t in items])
    rows = []
    for i in range(len(items)):
        words = hashes[ends[i] : ends[i + 1]]
        if len(words) >= run:
            g, _ = sh.grams(words, np.array([0, len(words)]), width)
            rows.append(pd.DataFrame({"item": i, "at": np.arange(len(g)), "shingle": g}))
    return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame({"item": [], "at": [], "shingle": []}).astype({"item": "i8", "at": "i8", "shingle": "u8"})


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 12, width: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """``(doc_id, item_id)``, each once: the document holds ``run`` consecutive words of the item or more.

    Every stretch of ``run`` words of an item must bring its rarest shingle of ``width`` words along, so only
    these prefix shingles are looked up in the documents. Rarity is counted over the whole corpus. A hit fixes how
    item and document lie on each other; the common stretch around it is then measured word by word, within
    the bounds of both texts. Items of fewer than ``run`` words, null texts and null ids give nothing;
    repeated rows count once, and an id with several texts is leaked by any of them. The items are the query set: they are taken in blocks of ``block_words``
    words, and only a block's shingles are broadcast, whatever the number of items.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    kept = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).distinct()
    out = None
    block: list[tuple[int, str]] = []
    size = 0
    for row in [*kept.orderBy("item", "text").toLocalIterator(), None]:
        if row is None or (block and size > block_words):
            found = _leaks_of_block(spark, docs, block, run, width)
            out = found if out is None else out.unionByName(found)
            block, size = [], 0
        if row is not None:
            block.append((row["item"], row["text"]))
            size += len(row["text"]) // 4
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    return out.distinct().select(F.col("doc").cast(types[doc_id]).alias("doc_id"), F.col("item").alias("item_id"))


def _leaks_of_block(spark, docs: DataFrame, block: list[tuple[int, str]], run: int, width: int) -> DataFrame:
    pieces = _item_shingles(block, width, run)
    known = spark.sparkContext.broadcast(np.unique(pieces["shingle"].to_numpy("u8")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        total = np.zeros(len(table), "i8")
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                hashes, ends = sh.word_hashes(whole.column(0).slice(at, SLICE).to_pylist())
                g, _ = sh.grams(hashes, ends, width)
                if len(table) and len(g):
                    place = np.minimum(np.searchsorted(table, g), len(table) - 1)
                    total += np.bincount(place[table[place] == g], minlength=len(table))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["place", "n"])

    often = docs.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most the block's shingles
    rarity = np.zeros(len(known.value), "i8")
    rarity[often["place"].to_numpy("i8")] = often["n"].to_numpy("i8")
    if len(pieces):
        pieces["n"] = rarity[np.searchsorted(known.value, pieces["shingle"].to_numpy("u8"))]
    inside = run - width + 1
    rows = []
    for item, own in pieces.groupby("item", sort=True):
        n, s = own["n"].to_numpy(), own["shingle"].to_numpy("u8")
        best = {min(range(a, a + inside), key=lambda i: (n[i], s[i])) for a in range(len(own) - inside + 1)}
        rows += [(s[i], item, own["at"].iloc[i]) for i in best if n[i] > 0]
    rows.sort()
    prefix = np.array([r[0] for r in rows], "u8"), np.array([r[1] for r in rows], "i8"), np.array([r[2] for r in rows], "i8")
    words, ends = sh.word_hashes([t for _, t in block])
    texts = [words[ends[i] : ends[i + 1]] for i in range(len(block))]
    shared = spark.sparkContext.broadcast((prefix, texts, [item for item, _ in block]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, item_of, place_of), texts, ids = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                hashes, ends = sh.word_hashes(batch.column(1).to_pylist())
                found = set()
                n = len(hashes) - width + 1
                if n > 0 and len(table):
                    g, doc = sh.grams(hashes, ends, width)
                    low, high = np.searchsorted(table, g), np.searchsorted(table, g, side="right")
                    starts = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(ends) - width + 1))])
                    for h in np.flatnonzero(high > low):
                        d = doc[h]
                        p = h - starts[d]  # the place of the hit among the document's words
                        own = hashes[ends[d] : ends[d + 1]]
                        for t in range(low[h], high[h]):
                            item, q = item_of[t], place_of[t]
                            if (d, item) in found:
                                continue
                            other = texts[item]
                            lead, rest = min(p, q), min(len(own) - p, len(other) - q)
                            if lead + rest < run:
                                continue
                            same = own[p - lead : p + rest] == other[q - lead : q + rest]
                            apart = np.flatnonzero(~same)
                            a = apart[apart < lead]
                            b = apart[apart >= lead]
                            if (b[0] if len(b) else lead + rest) - (a[-1] + 1 if len(a) else 0) >= run:
                                found.add((d, item))
                pairs = sorted({(d, ids[i]) for d, i in found})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], pa.int64())], names=["doc", "item"])

    return docs.mapInArrow(verify, f"doc {docs.schema['doc'].dataType.simpleString()}, item bigint")
