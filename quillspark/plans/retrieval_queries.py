"""Queries over the retrieval operators: the titles and vectors of the documents whose id is divisible by 20, against all chunks."""

from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.operators import search as S
from quillspark.operators.components import connected_components
from quillspark.session import materialize, table

MOST = 30  # candidates of each list for a page of ten


def chunks(spark, sf):
    return table(spark, sf, "kb_chunks").select("id", "document_id", "chunk_index", "content").dropDuplicates(["id"])


def docs(spark, sf):
    return table(spark, sf, "kb_documents").dropDuplicates(["id"])


def vectors(spark, sf):
    """One vector for each chunk, those that can be compared."""
    usable = (F.size("embedding") == 64) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table(spark, sf, "kb_embeddings").where(usable).dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("id"), "document_id", "embedding")


def asked(spark, sf):
    first = chunks(spark, sf).join(vectors(spark, sf).select("id", "embedding"), "id").groupBy(F.col("document_id").alias("id")).agg(F.min_by("embedding", F.struct("chunk_index", "id")).alias("embedding"))
    found = docs(spark, sf).where("id % 20 = 0").select("id", "title").join(first, "id", "left").select(F.col("id").alias("request_id"), F.col("title").alias("query"), "embedding")
    return materialize(found, "asked")


def _bm25(spark, sf, queries=None):
    return R.bm25(chunks(spark, sf), queries or asked(spark, sf), most=MOST)


def _near(spark, sf, queries=None):
    return R.knn(vectors(spark, sf).select("id", "embedding"), (queries or asked(spark, sf)).select("request_id", "embedding"), MOST)


def _fused(spark, sf, queries=None):
    queries = queries or asked(spark, sf)
    return materialize(R.fuse(_near(spark, sf, queries), _bm25(spark, sf, queries)), "fused")


def _boosted(spark, sf):
    queries = asked(spark, sf)
    return R.title_boost(_fused(spark, sf, queries), chunks(spark, sf), docs(spark, sf), queries)


def _knn(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.knn(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "request_id"), k=10)


def search(spark, sf, queries=None, **options):
    return S.search(chunks(spark, sf), docs(spark, sf), queries or asked(spark, sf), vectors(spark, sf).select("id", "embedding"), **options)


def _tags(spark, sf):
    d = docs(spark, sf)
    return R.suggest_tags(d, d.select(F.col("id").alias("document_id"), F.col("source_type").alias("name")))


def _related(spark, sf):
    first = chunks(spark, sf).where("document_id % 20 = 0").select(F.col("document_id").alias("request_id"), "id", "chunk_index")
    one = first.join(vectors(spark, sf).select("id"), "id", "left_semi").groupBy("request_id").agg(F.min_by("id", F.struct("chunk_index", "id")).alias("id"))
    return S.related_chunks(chunks(spark, sf), docs(spark, sf), vectors(spark, sf).select("id", "embedding"), one, min_score=0.2)


def _quality(spark, sf):
    queries = asked(spark, sf)
    expected = queries.where("embedding is not null and query is not null").select("request_id", F.col("request_id").alias("expected"))
    return S.retrieval_quality(expected, search(spark, sf, queries, stemmed=False, per_document=2))


def _topic_components(spark, sf):
    t = table(spark, sf, "kb_topics").select("id", F.trim("parent_id").alias("parent_id")).distinct()
    return connected_components(t.join(t.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi"), "id", "parent_id")


def queries():
    return {
        "rnk_02_knn": _knn,
        "join_03_near_chunks": lambda spark, sf: _near(spark, sf).join(chunks(spark, sf).select("id", "document_id"), "id").join(docs(spark, sf).select(F.col("id").alias("document_id"), "title"), "document_id").select("request_id", "id", "document_id", "title", "distance"),
        "rnk_03_bm25": _bm25,
        "rnk_03_bm25_stemmed": lambda spark, sf: R.bm25(chunks(spark, sf), asked(spark, sf), stemmed=True, most=MOST),
        "rnk_04_fusion": _fused,
        "rnk_05_title_boost": _boosted,
        "rnk_01_search": lambda spark, sf: search(spark, sf, stemmed=False, per_document=2).select("request_id", "id", "score", "place"),
        "rnk_01_search_stemmed": lambda spark, sf: search(spark, sf, per_document=2),
        "prj_01_explained": lambda spark, sf: S.explained(search(spark, sf, stemmed=False, per_document=2)),
        "rnk_06_diversity": lambda spark, sf: search(spark, sf, stemmed=False, diversity=0.7),
        "rnk_08_keyword": lambda spark, sf: S.keyword_search(chunks(spark, sf), docs(spark, sf), "Checkpoint 50%_ firewall", S.Filters(source_type="library"), limit=1000),
        "rnk_09_related": lambda spark, sf: _related(spark, sf).select("request_id", "id", "score", "place"),
        "rnk_10_batch": lambda spark, sf: S.search_batch(chunks(spark, sf), docs(spark, sf), ["restore job", "firewall rule", "restore job"], stemmed=False).select("query", "id", "score", "place"),
        "rnk_13_tag_suggestion": _tags,
        "agg_17_quality": _quality,
        "join_10_context_window": lambda spark, sf: R.context_window(_bm25(spark, sf), chunks(spark, sf)),
        "agg_11_mean_vectors": lambda spark, sf: R.mean_vectors(table(spark, sf, "kb_embeddings").dropDuplicates(["chunk_id"])).select("document_id", F.transform("embedding", lambda v: F.round(v, 5)).alias("embedding")),
        "grf_04_components": _topic_components,
    }


_TERMS = r"list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
_GOOD = "len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64"
_VIEWS = (
    "chunk AS (SELECT DISTINCT id, document_id, chunk_index, content FROM kb_chunks), doc AS (SELECT DISTINCT id, title, content, source_type FROM kb_documents), "
    f"vec AS (SELECT DISTINCT chunk_id AS id, embedding::DOUBLE[] AS embedding FROM kb_embeddings WHERE {_GOOD}), "
    "firsts AS (SELECT document_id, arg_min(v.embedding, (chunk_index, c.id)) AS embedding, arg_min(c.id, (chunk_index, c.id)) AS id FROM chunk c JOIN vec v USING (id) GROUP BY 1), "
    "q AS (SELECT doc.id AS request_id, title AS query, embedding FROM doc LEFT JOIN firsts ON document_id = doc.id WHERE doc.id % 20 = 0)"
)


def _bm25_sql(queries: str, name: str = "one") -> str:
    word = r"regexp_replace(regexp_replace(CASE WHEN contains(w, ':') THEN regexp_replace(w, '^[^:]*:', '') ELSE w END, '^\*+', ''), '\*+$', '')"
    return (
        rf"{name}_w AS (SELECT request_id, {word} AS w FROM (SELECT request_id, unnest(string_split_regex(trim(query), '\s+')) AS w FROM {queries})), "
        f"{name}_q AS (SELECT DISTINCT request_id, " + _TERMS.format("w") + f" AS p FROM {name}_w WHERE w <> '' AND upper(w) NOT IN ('NEAR', 'AND', 'OR', 'NOT')), {name}_k AS (SELECT * FROM {name}_q WHERE len(p) > 0), "
        f"{name}_c AS (SELECT request_id, count(*) AS asked FROM {name}_k GROUP BY 1), {name}_s AS (SELECT id, " + _TERMS.format("content") + f" AS t FROM chunk WHERE content IS NOT NULL), {name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_s), "
        f"{name}_p AS (SELECT p, id, len(t) AS dl, len(list_filter(generate_series(1, len(t) - len(p) + 1), lambda i: t[i:i + len(p) - 1] = p)) AS tf FROM (SELECT DISTINCT p FROM {name}_k) JOIN {name}_s ON list_has_all(t, p)), "
        f"{name}_t AS (SELECT * FROM {name}_p WHERE tf > 0), {name}_d AS (SELECT p, count(*) AS df FROM {name}_t GROUP BY 1), "
        f"{name}_x AS (SELECT request_id, id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS held FROM {name}_t JOIN {name}_d USING (p) CROSS JOIN {name}_n JOIN {name}_k USING (p) GROUP BY 1, 2), "
        f"{name}_a AS (SELECT *, max((held = asked)::INT) OVER (PARTITION BY request_id) AS any_all FROM {name}_x JOIN {name}_c USING (request_id)), "
        f"{name} AS (SELECT * FROM (SELECT request_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, id) AS place FROM {name}_a WHERE held = asked OR any_all = 0) WHERE place <= {MOST})"
    )


_NEAR = f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS place FROM (SELECT request_id, v.id, round(list_distance(q.embedding, v.embedding), 9) AS distance FROM q, vec v WHERE q.embedding IS NOT NULL)) WHERE place <= {MOST})"
_FUSED = (
    "f0 AS (SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.id, b.id) AS id, a.place AS pa, b.place AS pb, a.distance FROM near a FULL JOIN one b ON a.request_id = b.request_id AND a.id = b.id), "
    "f1 AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + pa), 0) + coalesce(1.0::DOUBLE / (60 + pb), 0), 12) AS score FROM f0)"
)
_HIT = "len(list_filter(string_split_regex(lower(q.query), '\\s+'), lambda w: w <> '' AND contains(coalesce(lower(d.title), ''), w))) > 0"
_SEARCH = (
    "g0 AS (SELECT *, max((pb IS NOT NULL)::INT) OVER (PARTITION BY request_id) AS any_text FROM f1), g1 AS (SELECT request_id, id, pa, pb, CASE WHEN any_text = 1 THEN score ELSE round(1 - distance, 12) END AS s FROM g0), "
    f"g2 AS (SELECT g.request_id, g.id, c.document_id, pa, pb, round(CASE WHEN {_HIT} THEN s * 1.5 ELSE s END, 12) AS score FROM g1 g JOIN q USING (request_id) LEFT JOIN chunk c ON c.id = g.id LEFT JOIN doc d ON d.id = c.document_id WHERE q.query IS NOT NULL), "
    "g3 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pa NULLS LAST, pb NULLS LAST, id) AS r FROM g2), g4 AS (SELECT *, row_number() OVER (PARTITION BY request_id, document_id ORDER BY r) AS nth FROM g3), "
    "found AS (SELECT * FROM (SELECT request_id, id, document_id, score, row_number() OVER (PARTITION BY request_id ORDER BY r) AS place FROM g4 WHERE nth <= 2) WHERE place <= 10)"
)


def oracle_sql():
    from quillspark.functions.text import STOP_WORDS

    one = f"WITH {_VIEWS}, {_bm25_sql('q')}"
    full = f"{one}, {_NEAR}, {_FUSED}"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return {
        "rnk_02_knn": "SELECT request_id, id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS place FROM (SELECT a.vec_id AS request_id, b.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE place <= 10",
        "join_03_near_chunks": f"WITH {_VIEWS}, {_NEAR} SELECT request_id, n.id, c.document_id, d.title, distance FROM near n JOIN chunk c ON c.id = n.id JOIN doc d ON d.id = c.document_id",
        "rnk_03_bm25": f"{one} SELECT request_id, id, score, place FROM one",
        "rnk_04_fusion": f"{full} SELECT request_id, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pa NULLS LAST, pb NULLS LAST, id) AS place FROM f1",
        "rnk_05_title_boost": f"{full} SELECT f.request_id, f.id, c.document_id, round(CASE WHEN {_HIT} THEN f.score * 1.5 ELSE f.score END, 12) AS score FROM f1 f JOIN q USING (request_id) LEFT JOIN chunk c ON c.id = f.id LEFT JOIN doc d ON d.id = c.document_id",
        "rnk_01_search": f"{full}, {_SEARCH} SELECT request_id, id, score, place FROM found",
        "agg_17_quality": f"{full}, {_SEARCH}, e AS (SELECT request_id, (SELECT min(place) FROM found f WHERE f.request_id = q.request_id AND f.document_id = q.request_id) AS place FROM q WHERE embedding IS NOT NULL AND query IS NOT NULL) SELECT round(avg(coalesce(1.0::DOUBLE / place, 0)), 9) AS mrr, sum(CASE WHEN place <= 3 THEN 1 ELSE 0 END)::BIGINT AS hit_at_k, count(*) AS queries FROM e",
        "rnk_08_keyword": f"WITH {_VIEWS}, h AS (SELECT c.*, row_number() OVER (ORDER BY document_id, chunk_index, c.id) AS rn FROM chunk c WHERE (contains(lower(content), 'checkpoint') OR contains(lower(content), '50%_') OR contains(lower(content), 'firewall')) AND document_id IN (SELECT id FROM doc WHERE source_type = 'library')) SELECT id, document_id, round(greatest(0.0, 1 - 0.1 * (rn - 1))::DOUBLE, 6) AS score FROM h WHERE rn <= 1000",
        "rnk_09_related": f"WITH {_VIEWS}, a AS (SELECT document_id AS request_id, id, embedding FROM firsts WHERE document_id % 20 = 0), n0 AS (SELECT request_id, v.id, round(list_distance(a.embedding, v.embedding), 9) AS distance FROM a, vec v), "
        "n1 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS p FROM n0), n2 AS (SELECT n.request_id, n.id, distance, row_number() OVER (PARTITION BY n.request_id ORDER BY distance, n.id) AS nth FROM n1 n JOIN chunk c ON c.id = n.id WHERE p <= 100 AND c.document_id <> n.request_id AND c.document_id IN (SELECT id FROM doc)), "
        "n3 AS (SELECT request_id, id, round(1 - distance, 9) AS score FROM n2 WHERE nth <= 20) SELECT * FROM (SELECT request_id, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS place FROM n3 WHERE score >= 0.2) WHERE place <= 10",
        "rnk_13_tag_suggestion": "WITH d AS (SELECT DISTINCT id, title, content, source_type FROM kb_documents), t AS (SELECT id, " + _TERMS.format("coalesce(title, '') || ' ' || coalesce(content, '')") + " AS t FROM d), "
        f"w AS (SELECT id AS document_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM t), c AS (SELECT document_id, tag, count(*) AS tf, min(pos) AS first_pos FROM w WHERE len(tag) >= 3 AND tag NOT IN ({stop}) GROUP BY 1, 2), "
        "s AS (SELECT document_id, tag, first_pos, round(tf / max(tf) OVER (PARTITION BY document_id) * (CASE WHEN tag IN (SELECT lower(source_type) FROM d) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS score FROM c) "
        "SELECT document_id, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, first_pos) AS nth FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = s.document_id AND lower(d.source_type) = s.tag)) WHERE nth <= 5",
        "join_10_context_window": f"{one}, m AS (SELECT o.request_id, c.* FROM one o JOIN chunk c ON c.id = o.id) SELECT m.request_id, m.id, coalesce(list(n.id ORDER BY n.chunk_index, n.id) FILTER (WHERE n.chunk_index < m.chunk_index), []) AS \"before\", coalesce(list(n.id ORDER BY n.chunk_index, n.id) FILTER (WHERE n.chunk_index > m.chunk_index), []) AS after FROM m LEFT JOIN chunk n ON n.document_id = m.document_id AND n.id <> m.id AND abs(n.chunk_index - m.chunk_index) <= 1 GROUP BY 1, 2",
        "agg_11_mean_vectors": f"WITH v AS (SELECT DISTINCT chunk_id, document_id, embedding::DOUBLE[] AS e FROM kb_embeddings WHERE {_GOOD}), u AS (SELECT document_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT document_id, i, round(avg(x), 5) AS x FROM u GROUP BY 1, 2) SELECT document_id, list(x ORDER BY i) AS embedding FROM m GROUP BY 1",
        "grf_04_components": "WITH RECURSIVE t AS (SELECT DISTINCT id, trim(parent_id) AS p FROM kb_topics), e AS (SELECT id AS a, p AS b FROM t WHERE p IN (SELECT id FROM t) UNION SELECT p, id FROM t WHERE p IN (SELECT id FROM t)), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node",
    }
