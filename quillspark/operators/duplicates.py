"""Exact and semantic duplicates, and the graph of documents, topics and tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.operators.components import connected_components


def exact_groups(docs: DataFrame) -> DataFrame:
    """``(content_hash, ids, titles)`` of contents that more than one document has, the ids in order."""
    rows = docs.where("content is not null").groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("g"), F.count("*").alias("n"))
    return rows.where("n > 1").select("content_hash", F.transform("g", lambda x: x["id"]).alias("ids"), F.transform("g", lambda x: x["title"]).alias("titles"))


def check_duplicates(new: DataFrame, docs: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.95, strategy: str = "both") -> DataFrame:
    """``(id, is_duplicate, strategy, existing_id, similarity)`` of each new document.

    ``exact``: a document has the same content (the smallest id counts, similarity 1). ``semantic``: the nearest vector of
    ``vectors`` (``id``, ``embedding``) to the new one's ``embedding`` has a similarity (1 - distance) of ``threshold``
    or more. ``both`` looks for the second only where the first finds nothing.
    """
    if strategy not in ("exact", "semantic", "both"):
        raise ValueError(f"unknown strategy {strategy}")
    rows = new.select("id").distinct()
    out = rows.withColumn("exact", F.lit(None).cast("bigint"))
    if strategy != "semantic":
        known = docs.where("content is not null").groupBy(F.sha2("content", 256).alias("h")).agg(F.min("id").alias("exact"))
        out = rows.join(new.select("id", F.sha2("content", 256).alias("h")).join(known, "h").select("id", "exact"), "id", "left")
    if strategy != "exact" and vectors is not None:
        asked = new.join(out.where("exact is null").select("id"), "id", "left_semi").select(F.col("id").alias("request_id"), "embedding")
        near = R.knn(vectors, asked, 1).select(F.col("request_id").alias("id"), F.col("id").alias("near"), F.round(1 - F.col("distance"), 9).alias("s")).where(F.col("s") >= threshold)
        out = out.join(near, "id", "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("bigint")).withColumn("s", F.lit(None).cast("double"))
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "semantic")
    return out.select("id", kind.isNotNull().alias("is_duplicate"), kind.alias("strategy"), F.coalesce("exact", "near").alias("existing_id"), F.when(F.col("exact").isNotNull(), F.lit(1.0)).otherwise(F.col("s")).alias("similarity"))


def similar_documents(means: DataFrame, threshold: float, block: int = 32_768) -> DataFrame:
    """``(a, b, similarity)``, a < b: all pairs of vectors ``(id, embedding)`` with a cosine of ``threshold`` or more.

    The vectors are dealt to blocks, and each pair of blocks is compared by one task, so a task holds two blocks whatever
    the number of rows; only pairs that reach the threshold leave it. Vectors of length 0 are like nothing.
    """
    total = means.count()
    blocks = max(1, -(-total // block))
    placed = means.where("id is not null and embedding is not null").select(F.col("id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("bigint")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    kind = means.schema["id"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        width = pc.list_value_length(table.column("v")).to_numpy()
        found = []
        for size in np.unique(width):
            rows = np.flatnonzero(width == size)
            x = table.column("v").take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
            length = np.linalg.norm(x, axis=1)
            good = length > 0
            x, at = x[good] / length[good, None], rows[good]
            left, right = np.flatnonzero(own[at] == low), np.flatnonzero(own[at] == high)
            for start in range(0, len(left), 512):
                part = left[start : start + 512]
                s = np.round(x[part] @ x[right].T, 9)
                r, c = np.nonzero(s >= threshold)
                i, j = ids[at[part[r]]], ids[at[right[c]]]
                keep = i < j if low == high else i != j
                found.append((np.minimum(i, j)[keep], np.maximum(i, j)[keep], s[r, c][keep]))
        a, b, s = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, ids.dtype), np.empty(0, ids.dtype), np.empty(0))
        return pa.table({"a": pa.array(a), "b": pa.array(b), "similarity": pa.array(s.astype(float))})

    return meets.groupBy("low", "high").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def star_clusters(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, cluster)``: greedy stars in the order of the ids: a free node takes all free nodes it is alike to.

    ``pairs`` has ``(a, b)``. Stars depend on the order, but not across components: each connected component is one
    group, solved on its own pairs. Nodes in no pair, and stars of one, have no row.
    """
    known = nodes.select("id").distinct()
    pairs = pairs.select("a", "b").join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi")
    parts = connected_components(pairs, "a", "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def stars(frame):
        import pandas as pd

        near: dict = {}
        for a, b in zip(frame.a, frame.b):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        taken: dict = {}
        for node in sorted(near):
            if node not in taken and (free := [n for n in near[node] if n not in taken and n > node]):
                taken[node] = node
                taken.update({n: node for n in free})
        return pd.DataFrame({"id": list(taken), "cluster": list(taken.values())})

    grouped = pairs.join(parts.toDF("a", "component"), "a")
    return grouped.groupBy("component").applyInPandas(stars, f"id {kind}, cluster {kind}")


def semantic_clusters(docs: DataFrame, means: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(id, cluster)``: star clusters by mean vectors of the documents that are in no exact group."""
    copies = exact_groups(docs).select(F.explode("ids").alias("id"))
    rest = docs.select("id").distinct().join(copies, "id", "left_anti")
    return star_clusters(similar_documents(means.join(rest, "id", "left_semi"), threshold), rest)


# ---- graph


def graph_nodes(docs: DataFrame, topics: DataFrame, tags: DataFrame, ratings: DataFrame, most: int = 200, topic_id: str | None = None, tag: str | None = None) -> DataFrame:
    """``(node, type, label)``: the best-rated, newest documents up to ``most`` (1 to 5,000), with their topics and tags."""
    some = docs if topic_id is None else docs.where(F.col("topic_id") == topic_id)
    if tag is not None:
        some = some.join(tags.where(F.lower("name") == tag.strip().lower()).select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    average = ratings.groupBy(F.col("document_id").alias("id")).agg(F.avg("rating").alias("avg_rating"))
    chosen = some.join(average, "id", "left").orderBy(F.desc_nulls_last("avg_rating"), F.desc_nulls_last("updated_at"), "id").limit(max(1, min(5000, most)))
    nodes = chosen.select(F.concat(F.lit("doc:"), "id").alias("node"), F.lit("document").alias("type"), F.col("title").alias("label"), F.col("id"), "topic_id")
    of_topic = nodes.select(F.col("topic_id").alias("id")).distinct().join(topics.select("id", "name"), "id").select(F.concat(F.lit("topic:"), "id").alias("node"), F.lit("topic").alias("type"), F.col("name").alias("label"))
    of_tag = tags.join(nodes.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.concat(F.lit("tag:"), "name").alias("node"), F.lit("tag").alias("type"), F.col("name").alias("label")).distinct()
    return nodes.select("node", "type", "label").unionByName(of_topic).unionByName(of_tag)


def graph_edges(nodes: DataFrame, docs: DataFrame, tags: DataFrame, links: DataFrame, means: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(source, target, type, weight)`` among the chosen nodes: topics, tags, links, and likeness of mean vectors."""
    threshold = max(0.0, min(1.0, threshold))
    ids = nodes.where("type = 'document'").select(F.substring_index("node", ":", -1).cast("bigint").alias("id"))
    doc = lambda c: F.concat(F.lit("doc:"), c)
    topics = nodes.where("type = 'topic'").select(F.expr("substring(node, 7)").alias("topic_id"))
    belongs = docs.join(ids, "id", "left_semi").join(topics, "topic_id", "left_semi").select(doc("id").alias("source"), F.concat(F.lit("topic:"), "topic_id").alias("target"), F.lit("belongs_to_topic").alias("type"), F.lit(1.0).alias("weight")).distinct()
    tagged = tags.join(ids.toDF("document_id"), "document_id", "left_semi").select(doc("document_id").alias("source"), F.concat(F.lit("tag:"), "name").alias("target"), F.lit("has_tag").alias("type"), F.lit(1.0).alias("weight")).distinct()
    linked = links.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi").select(doc("source_id").alias("source"), doc("target_id").alias("target"), F.col("link_type").alias("type"), F.lit(1.0).alias("weight"))
    alike = similar_documents(means.join(ids, "id", "left_semi"), threshold).select(doc("a").alias("source"), doc("b").alias("target"), F.lit("similar_to").alias("type"), F.col("similarity").alias("weight"))
    return belongs.unionByName(tagged).unionByName(linked).unionByName(alike)


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component, name)``: connected components of the documents, each named by its first topic, else by its first node."""
    parts = connected_components(edges, "source", "target")
    names = parts.join(nodes, "node").groupBy("component").agg(F.min(F.when(F.col("type") == "topic", F.col("label"))).alias("topic"))
    return parts.join(names, "component", "left").select("node", "component", F.coalesce("topic", "component").alias("name"))
