"""Search end to end: hybrid, related chunks, batches, saved searches, and the fallback without an index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import like_any_word
from quillspark.operators import retrieval as R
from quillspark.session import materialize


class ChunkNotFoundError(LookupError):
    pass


class NoEmbeddingError(LookupError):
    pass


@dataclass
class Filters:
    """Conditions on documents; those that are None or empty hold always, and all given ones must hold."""

    library: str | None = None
    version: str | None = None
    topic_id: str | None = None
    source_type: str | None = None
    tags: list[str] = field(default_factory=list)
    min_rating: float | None = None
    date_from: str | None = None
    date_to: str | None = None


def matching_documents(docs: DataFrame, filters: Filters, tags: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """The documents that satisfy all conditions; a document must have every tag, and one without ratings has no average."""
    out = docs
    for name in ("library", "version", "topic_id", "source_type"):
        if getattr(filters, name) is not None:
            out = out.where(F.col(name) == getattr(filters, name))
    if filters.date_from is not None:
        out = out.where(F.col("created_at") >= F.to_timestamp(F.lit(filters.date_from)))
    if filters.date_to is not None:
        out = out.where(F.col("created_at") <= F.to_timestamp(F.lit(filters.date_to)))
    if filters.tags:
        names = sorted({t.strip().lower() for t in filters.tags})
        having = tags.where(F.lower(F.trim("name")).isin(names)).groupBy("document_id").agg(F.count_distinct(F.lower(F.trim("name"))).alias("n")).where(F.col("n") == len(names))
        out = out.join(having.select(F.col("document_id").alias("id")), "id", "left_semi")
    if filters.min_rating is not None:
        average = ratings.groupBy("document_id").agg(F.avg("rating").alias("avg_rating")).where(F.col("avg_rating") >= filters.min_rating)
        out = out.join(average.select(F.col("document_id").alias("id")), "id", "left_semi")
    return out


def page_bounds(limit: int, offset: int) -> tuple[int, int, int]:
    """Limit (1 to 1,000), offset (0 or more) and the number of candidates of each list (three times, at most 5,000)."""
    limit, offset = max(1, min(1000, int(limit))), max(0, int(offset))
    return limit, offset, min((offset + limit) * 3, 5000)


def search(
    chunks: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    filters: Filters | None = None,
    tags: DataFrame | None = None,
    ratings: DataFrame | None = None,
    limit: int = 10,
    offset: int = 0,
    diversity: float = 0.0,
    per_document: int = 0,
    stemmed: bool = True,
) -> DataFrame:
    """Hybrid search of many queries together: ``(request_id, id, document_id, score, place, vector_rank, text_rank, title_boost)``.

    ``queries`` has ``request_id``, ``query`` and, for the vector list, ``embedding``; ``vectors`` has ``id`` and
    ``embedding``. The nearest vectors (filtered after the search) and the BM25 list (filtered before its limit) are fused by
    reciprocal ranks; where the text list of a query is empty, the vector list counts alone with 1 - distance. Then
    scores of titles with a query word are raised, results re-ranked for diversity, capped per document and cut to the page.
    Without ``vectors`` only text counts. Null queries have no results.
    """
    limit, offset, most = page_bounds(limit, offset)
    fits = matching_documents(docs, filters or Filters(), tags, ratings).select(F.col("id").alias("document_id")).distinct()
    mine = chunks.join(fits, "document_id", "left_semi").select("id", "document_id")
    text = R.bm25(chunks, queries, stemmed=stemmed, most=most, keep=mine if filters else None)
    if vectors is None:
        fused = text.select("request_id", "id", "score", F.lit(None).cast("int").alias("vector_rank"), F.col("place").alias("text_rank"))
    else:
        near = R.knn(vectors, queries.select("request_id", "embedding"), most).join(mine.select("id"), "id", "left_semi")
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "id")))
        both = near.select("request_id", "id", F.col("place").alias("vector_rank"), "distance").join(text.select("request_id", "id", F.col("place").alias("text_rank")), ["request_id", "id"], "full")
        any_text = F.max(F.col("text_rank").isNotNull()).over(Window.partitionBy("request_id"))
        part = lambda c: F.coalesce(1 / (60 + F.col(c)), F.lit(0.0))
        fused = both.withColumn("score", F.round(F.when(any_text, part("vector_rank") + part("text_rank")).otherwise(1 - F.col("distance")), 12)).drop("distance")
    fused = materialize(fused, "fused")
    boosted = R.title_boost(fused.select("request_id", "id", "score"), chunks, docs, queries).withColumnRenamed("score", "boosted")
    ranked = fused.join(boosted, ["request_id", "id"]).withColumn("title_boost", F.col("boosted") != F.col("score")).drop("score").withColumnRenamed("boosted", "score")
    if diversity > 0:
        order = R.diversify(ranked.select("request_id", "id", "score"), min(diversity, 1.0), most=5000).select("request_id", "id", "place")
    else:
        by = Window.partitionBy("request_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"), "id")
        order = ranked.select("request_id", "id", F.row_number().over(by).alias("place"))
    placed = ranked.join(order, ["request_id", "id"])
    if per_document > 0:
        nth = F.row_number().over(Window.partitionBy("request_id", "document_id").orderBy("place"))
        placed = placed.withColumn("nth", nth).where(F.col("nth") <= per_document).drop("nth")
    final = placed.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("place")))
    return final.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).select("request_id", "id", "document_id", "score", "place", "vector_rank", "text_rank", "title_boost")


def explained(results: DataFrame) -> DataFrame:
    """Search rows with the structure that says how their score came about."""
    method = F.when(F.col("vector_rank").isNotNull() & F.col("text_rank").isNotNull(), "hybrid").when(F.col("vector_rank").isNotNull(), "vector").otherwise("keyword")
    factors = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), F.concat(F.lit("vector rank "), "vector_rank")), F.when(F.col("text_rank").isNotNull(), F.concat(F.lit("text rank "), "text_rank")), F.when(F.col("title_boost"), F.lit("title boost 1.5"))))
    return results.select("request_id", "id", "document_id", "score", "place", F.struct(method.alias("method"), F.col("score").alias("raw_score"), factors.alias("factors")).alias("score_explanation"))


def keyword_search(chunks: DataFrame, docs: DataFrame, query: str, filters: Filters | None = None, tags: DataFrame | None = None, ratings: DataFrame | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """``(id, document_id, score)``: the search without any index: chunks with any word of the query, page by page.

    Rows come by document and chunk; the score goes down by 0.1 from 1 with the place on the page.
    """
    limit, offset, _ = page_bounds(limit, offset)
    fits = matching_documents(docs, filters or Filters(), tags, ratings).select(F.col("id").alias("document_id"))
    found = chunks.where(like_any_word(F.col("content"), query)).join(fits, "document_id", "left_semi")
    page = found.orderBy("document_id", "chunk_index", "id").offset(offset).limit(limit)  # the page, at most 1,000 rows
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("document_id", "chunk_index", "id"))
    return page.select("id", "document_id", F.round(F.greatest(F.lit(0.0), 1 - 0.1 * (place - 1)), 6).alias("score"))


def lazy_count(rows: DataFrame, page: list, limit: int, offset: int) -> int:
    """The number of all results; counted only if the page does not show it already."""
    return len(page) if offset == 0 and len(page) < limit else rows.count()


def linked_neighbours(links: DataFrame) -> DataFrame:
    """``(document_id, neighbour)`` of undirected links, each once."""
    both = links.select(F.col("source_id").alias("document_id"), F.col("target_id").alias("neighbour"))
    return both.union(links.select("target_id", "source_id")).distinct()


def related_chunks(
    chunks: DataFrame, docs: DataFrame, vectors: DataFrame, asked: DataFrame, links: DataFrame | None = None, filters: Filters | None = None, tags: DataFrame | None = None, limit: int = 10, min_score: float = 0.0, linked_score: float = 0.6
) -> DataFrame:
    """``(request_id, id, document_id, score, place)``: the chunks most like each chunk of ``asked`` (``request_id``, ``id``), of other documents.

    Ten times ``limit`` nearest vectors are taken, those of the chunk's own document dropped, filters applied, twice ``limit``
    kept, and of them those from ``min_score`` on if it is positive. With ``links``, the first chunk of each linked document
    not yet there joins with ``linked_score``, whatever the filters. Chunks without a vector have no results.
    """
    own = asked.join(chunks.select("id", F.col("document_id").alias("own")), "id").select("request_id", "id", "own")
    near = R.knn(vectors, own.join(vectors.select("id", "embedding"), "id").select("request_id", "embedding"), limit * 10)
    fits = matching_documents(docs, filters or Filters(), tags).select(F.col("id").alias("document_id"))
    rows = near.join(chunks.select("id", "document_id"), "id").join(own.select("request_id", "own"), "request_id").where("document_id <> own").join(fits, "document_id", "left_semi")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "id"))).where(F.col("nth") <= 2 * limit)
    rows = rows.select("request_id", "id", "document_id", F.round(1 - F.col("distance"), 9).alias("score"))
    if min_score > 0:
        rows = rows.where(F.col("score") >= min_score)
    if links is not None:
        other = own.select("request_id", F.col("own").alias("document_id")).join(linked_neighbours(links), "document_id").select("request_id", F.col("neighbour").alias("document_id"), F.col("document_id").alias("own")).where("document_id <> own").drop("own")
        other = other.join(rows.select("request_id", "document_id").distinct(), ["request_id", "document_id"], "left_anti")
        firsts = chunks.groupBy("document_id").agg(F.min_by("id", F.struct("chunk_index", "id")).alias("id"))
        rows = rows.unionByName(other.join(firsts, "document_id").select("request_id", "id", "document_id", F.lit(linked_score).alias("score")))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def related_to(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, chunk_id, **options) -> DataFrame:
    """``related_chunks`` of one chunk; an unknown chunk and one without a vector are errors."""
    if not chunks.where(F.col("id") == chunk_id).limit(1).count():
        raise ChunkNotFoundError(f"Chunk not found: {chunk_id}")
    if not vectors.where((F.col("id") == chunk_id) & F.col("embedding").isNotNull()).limit(1).count():
        raise NoEmbeddingError(f"No embedding found for chunk: {chunk_id}")
    return related_chunks(chunks, docs, vectors, chunks.where(F.col("id") == chunk_id).select(F.lit(1).cast("bigint").alias("request_id"), "id").limit(1), **options)


def search_batch(chunks: DataFrame, docs: DataFrame, queries: list[str], **options) -> DataFrame:
    """``search`` of 1 to 20 query texts in one plan; equal texts are one request, numbered by their first place."""
    if not 1 <= len(queries) <= 20:
        raise ValueError("a batch has 1 to 20 queries")
    rows = [(i, q) for i, q in enumerate(dict.fromkeys(queries), 1)]
    asked = chunks.sparkSession.createDataFrame(rows, "request_id bigint, query string")
    return search(chunks, docs, asked, **options).join(asked, "request_id")


def save_search(saved: DataFrame | None, spark, name: str, query: str, filters: Filters, at: str) -> DataFrame:
    """The saved searches ``(id, name, query, filters, last_run_at, result_count)`` with one more; a name is taken once."""
    schema = "id bigint, name string, query string, filters string, last_run_at timestamp, result_count int"
    saved = saved if saved is not None else spark.createDataFrame([], schema)
    if not name.strip() or saved.where(F.col("name") == name).limit(1).count():
        raise ValueError("a saved search needs a name of its own")
    number = (saved.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
    return saved.unionByName(spark.createDataFrame([(number, name, query, json.dumps(asdict(filters)), None, None)], schema))


def run_saved(saved: DataFrame, key, at: str, chunks: DataFrame, docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The results of a saved search, by id or name, and the saved searches with its time and number of results."""
    row = saved.where((F.col("id").cast("string") == str(key)) | (F.col("name") == str(key))).first()
    if row is None:
        raise LookupError(f"Saved search not found: {key}")
    asked = chunks.sparkSession.createDataFrame([(1, row["query"])], "request_id bigint, query string")
    found = search(chunks, docs, asked, filters=Filters(**json.loads(row["filters"])), **options)
    hit = F.col("id") == row["id"]
    return found, saved.withColumn("last_run_at", F.when(hit, F.to_timestamp(F.lit(at))).otherwise(F.col("last_run_at"))).withColumn("result_count", F.when(hit, found.count()).otherwise(F.col("result_count")))


def pack_scores(packs: DataFrame, query: str) -> DataFrame:
    """Packs ``(name, description, tags, author)`` with a positive score for the query, best first.

    The name counts 100 if equal and 50 if it holds the query, the description 20, each tag 30 or 15, the author 10.
    """
    q = query.strip().lower()
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    tag = lambda t: F.when(F.lower(t) == q, 30).when(has(t), 15).otherwise(0)
    score: Column = F.when(F.lower("name") == q, 100).when(has(F.col("name")), 50).otherwise(0) + F.when(has(F.col("description")), 20).otherwise(0) + F.when(has(F.col("author")), 10).otherwise(0)
    score = score + F.aggregate(F.transform(F.coalesce("tags", F.array().cast("array<string>")), tag), F.lit(0), lambda a, b: a + b)
    return packs.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "name")


def retrieval_quality(expected: DataFrame, results: DataFrame, k: int = 3) -> DataFrame:
    """``(mrr, hit_at_k, queries)``: the mean reciprocal rank of each request's expected id; one that is missing counts 0."""
    rank = expected.join(results.select("request_id", F.col("document_id").alias("expected"), "place"), ["request_id", "expected"], "left").groupBy("request_id").agg(F.min("place").alias("place"))
    return rank.agg(F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 9).alias("mrr"), F.sum(F.when(F.col("place") <= k, 1).otherwise(0)).alias("hit_at_k"), F.count("*").alias("queries"))
