"""Queries over the document store's operators; each SQL is written on its own, not derived from the plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as K
from quillspark.operators import duplicates as D
from quillspark.operators import links as L
from quillspark.operators import packs as X
from quillspark.operators import retrieval as R
from quillspark.operators import search as S
from quillspark.operators.documents import Store, embedding_text, list_documents, url_status
from quillspark.plans.retrieval_queries import chunks, docs, vectors
from quillspark.plans.sql_queries import PRELUDE, run_plan, with_views
from quillspark.providers import HashedWordsEmbedder, context_prompt, embed
from quillspark.session import table
from quillspark.sources import connectors as N
from quillspark.sources import crawl as W
from quillspark.sources.files import parser_column
from quillspark.streaming import watch as Q

AS_OF = "2025-10-01 00:00:00"


def _view(name):
    return lambda spark, sf: run_plan(spark, sf, f"SELECT * FROM {name}")


links, tags, ratings, topics = (_view(n) for n in ("links", "tags", "ratings", "topics"))


def messages(spark, sf):
    return table(spark, sf, "slack_messages").dropDuplicates(["message_id"])


def _means(spark, sf):
    return R.mean_vectors(vectors(spark, sf)).select(F.col("document_id").alias("id"), "embedding").where("id is not null")


def _store(spark, sf):
    d, c, e = docs(spark, sf), chunks(spark, sf), vectors(spark, sf)
    empty = Store.empty(spark)
    r = table(spark, sf, "kb_ratings").dropDuplicates(["id"]).select("id", "document_id", F.lit(None).cast("string").alias("chunk_id"), "rating", "feedback", F.col("created_at").cast("timestamp").alias("created_at"))
    return Store(
        documents=d.select(*Store._names("documents")), chunks=c.select("id", "document_id", "chunk_index", "content"), embeddings=e.select(F.col("id").alias("chunk_id"), "document_id", "embedding"),
        links=links(spark, sf), tags=tags(spark, sf), ratings=r, versions=empty.versions, topics=table(spark, sf, "kb_topics").dropDuplicates(["id"]).select("id", "name", "description", "parent_id"),
    )


def _counts(store):
    out = None
    for name in ("documents", "chunks", "embeddings", "links", "tags", "ratings"):
        one = getattr(store, name).select(F.lit(name).alias("tbl")).groupBy("tbl").count()
        out = one if out is None else out.unionByName(one)
    return out.select("tbl", F.col("count").alias("n"))


def _new_ratings(spark, sf):
    return table(spark, sf, "kb_ratings").dropDuplicates(["id"]).select("id", "document_id", F.lit(None).cast("string").alias("chunk_id"), "rating", "feedback", "created_at")


def _references(spark, sf):
    d = docs(spark, sf).select("id", "title", "url")
    return d.where("url is not null").select((F.col("id") + 1).alias("document_id"), F.col("url").alias("target")).unionByName(d.where("title is not null").select(F.col("id").alias("document_id"), F.upper("title").alias("target")))


def _users(spark, sf):
    m = messages(spark, sf)
    ids = m.select("user_id").unionByName(m.select(F.explode(F.regexp_extract_all("text", F.lit("<@(U[A-Z0-9]+)>"), F.lit(1))).alias("user_id"))).where("user_id is not null").distinct()
    return ids.select("user_id", F.lit(" ").alias("display_name"), F.concat(F.lit("Real "), "user_id").alias("real_name"), F.col("user_id").alias("name"))


def _packs(spark, sf):
    d = docs(spark, sf).where("library is not null")
    return d.groupBy(F.col("library").alias("name")).agg(F.min("title").alias("description"), F.array_sort(F.collect_set("source_type")).alias("tags"), F.min("submitted_by").alias("author"))


def _offers(spark, sf):
    d = docs(spark, sf).where("library is not null and version is not null").select(F.col("source_type").alias("registry"), F.length("source_type").alias("priority"), F.col("library").alias("name"), "version").distinct()
    return d, d.select("name", F.lit(None).cast("string").alias("version")).distinct()


def _registry(spark, sf):
    d = docs(spark, sf).where("id is not null").select("id", F.to_json(F.struct(F.col("library").alias("name"), F.col("title").alias("description"), F.col("version").alias("latestVersion"))).alias("j"))
    return X.registry_index(d.select(F.when(F.col("id") % 7 == 0, F.substring("j", 1, 9)).otherwise(F.col("j")).alias("entry"))).select("name", "description", F.col("latestVersion").alias("latest"))


def _addresses(spark, sf):
    m = messages(spark, sf).select("message_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"), F.lit(1))).alias("ip")).distinct()

    @F.pandas_udf("boolean")
    def private(ips: pd.Series) -> pd.Series:
        return ips.map(W.is_private_address)

    return m.select("message_id", "ip", private("ip").alias("private"))


def _graph(spark, sf):
    d = docs(spark, sf)
    nodes = D.graph_nodes(d, topics(spark, sf), tags(spark, sf), ratings(spark, sf))
    return D.graph_edges(nodes, d, tags(spark, sf), links(spark, sf), _means(spark, sf)).select("source", "target", "type")


def _semantic(spark, sf):
    new = docs(spark, sf).where("id % 20 = 0").select("id", "content").join(_means(spark, sf), "id", "left")
    return D.check_duplicates(new, docs(spark, sf).where("id % 20 <> 0"), _means(spark, sf).where("id % 20 <> 0"), 0.9)


def _indexed(spark, sf):
    new = docs(spark, sf).select("title", "content", "url", "source_type", "library", "version", "topic_id")
    store, found = Store.empty(spark).index(new, AS_OF, HashedWordsEmbedder(64))
    return found.groupBy("status").count().select("status", F.col("count").alias("n"))


def _requests(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


def queries():
    filters = S.Filters(library="fennmark-core", source_type="library", date_from="2024-06-01 00:00:00")
    return {
        # sources
        "src_04_parser_dispatch": lambda spark, sf: docs(spark, sf).where("url is not null").select("id", parser_column(F.regexp_replace("url", "[?#].*$", "")).alias("parser")),
        "src_01_export_rows": lambda spark, sf: X.export_rows(_store(spark, sf)).groupBy("table").agg(F.count("*").alias("n")),
        "src_26_channel_filter": lambda spark, sf: N.filter_channels(messages(spark, sf).select("channel_id", "channel_name").distinct(), ["GENERAL", "ops-fennmark", "ops-vantorel"], ["ops-vantorel"]),
        "src_28_chat_documents": lambda spark, sf: N.chat_documents(messages(spark, sf), _users(spark, sf)),
        "src_40_registry_entries": _registry,
        "join_23_message_users": lambda spark, sf: N.resolve_users(messages(spark, sf), _users(spark, sf)).select("message_id", "author", "text"),
        # changes
        "snk_01_index": _indexed,
        "snk_02_url_status": lambda spark, sf: url_status(docs(spark, sf).where("id % 2 = 0").select("id", "url", "content"), docs(spark, sf).where("id % 2 = 1")).select("id", "status", "old_id"),
        "snk_05_cascade": lambda spark, sf: _counts(_store(spark, sf).delete(docs(spark, sf).where("id % 3 = 0").select("id"))),
        "snk_06_by_source": lambda spark, sf: _counts(_store(spark, sf).delete_where(F.col("source_type") == "topic")[0]),
        "snk_07_by_prefix": lambda spark, sf: _counts(_store(spark, sf).delete_where(F.startswith("url", F.lit("https://docs.")))[0]),
        "snk_07_by_tag": lambda spark, sf: _counts(_store(spark, sf).delete_tagged("fennmark")),
        "snk_08_pruned": lambda spark, sf: _counts(_store(spark, sf).prune_expired(AS_OF)[0]),
        "snk_09_bulk_delete": lambda spark, sf: _counts(_store(spark, sf).bulk_delete(filters)[0]),
        "snk_09_bulk_retag": lambda spark, sf: _store(spark, sf).bulk_retag(S.Filters(tags=["long", "library"]), add=["Big "], remove=["long"])[0].tags,
        "snk_13_rejected": lambda spark, sf: _store(spark, sf).rate(_new_ratings(spark, sf))[1],
        "snk_16_pack": lambda spark, sf: X.pack_json(docs(spark, sf), tags(spark, sf), topics(spark, sf)).select("name", "doc_count", F.size(F.from_json("documents", "array<struct<title:string>>")).alias("parsed")),
        "snk_17_install_batches": lambda spark, sf: X.install_batches(docs(spark, sf), 10, 25).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
        "snk_20_webhook_match": lambda spark, sf: table(spark, sf, "kb_syncs").distinct().select("id", "status", F.when(F.col("status") == "completed", F.array(F.lit("sync.completed"), F.lit("sync.any"))).otherwise(F.array(F.lit("sync.any"))).alias("events"), (F.col("id") % 3 > 0).alias("active")).where(F.col("active") & F.array_contains("events", "sync.completed")).select("id"),
        # filters
        "flt_05_escaped_words": lambda spark, sf: chunks(spark, sf).where(T.like_any_word(F.col("content"), "50% fire_wall CHECKPOINT")).select("id"),
        "flt_12_threshold": lambda spark, sf: D.similar_documents(_means(spark, sf), 0.95).select("a", "b"),
        "flt_13_globs": lambda spark, sf: docs(spark, sf).where(F.col("url").rlike(X.glob_regex("*.example/*/pages/*", across=True)) | F.col("url").rlike(X.glob_regex("https://*/docs/*"))).select("id"),
        "flt_15_selected": lambda spark, sf: _store(spark, sf).select(S.Filters(tags=["long", "library"]), most=None),
        "flt_17_private": _addresses,
        "flt_19_references": lambda spark, sf: L.resolve_references(_references(spark, sf), docs(spark, sf)),
        "flt_20_list": lambda spark, sf: list_documents(docs(spark, sf), S.Filters(source_type="manual"), limit=40, offset=5).select("id"),
        "flt_22_stale": lambda spark, sf: X.stale(table(spark, sf, "kb_syncs").distinct().select("id", F.when(F.col("id") % 5 > 0, F.col("started_at").cast("timestamp")).alias("last_sync"), (F.col("id") % 3 * 24 * 60).cast("double").alias("interval_hours")), AS_OF).select("id", "is_stale"),
        "flt_26_skip_reasons": lambda spark, sf: docs(spark, sf).where("url is not null").select("id", W.skip_reason(F.col("url"), "fennmark.example", True, "/docs", ["*-copy*"], ["/docs/a"]).alias("reason")),
        # duplicates and graph
        "dup_02_groups": lambda spark, sf: D.exact_groups(docs(spark, sf)).select("content_hash", "ids"),
        "dup_03_exact": lambda spark, sf: D.check_duplicates(docs(spark, sf).where("id % 2 = 0").select("id", "content"), docs(spark, sf).where("id % 2 = 1"), strategy="exact"),
        "dup_03_both": _semantic,
        "dup_04_star_clusters": lambda spark, sf: D.semantic_clusters(docs(spark, sf), _means(spark, sf), 0.85),
        "dup_06_first_entries": lambda spark, sf: X.first_entries(docs(spark, sf).where("library is not null").select(F.col("library").alias("name"), F.col("id").alias("position"))),
        "grf_01_graph": _graph,
        "grf_03_similar": lambda spark, sf: D.similar_documents(_means(spark, sf), 0.85),
        "grf_05_prerequisites": lambda spark, sf: L.prerequisite_chains(links(spark, sf)),
        "grf_06_titles": lambda spark, sf: L.link_titles(links(spark, sf), docs(spark, sf), "see_also"),
        "grf_08_markdown_links": lambda spark, sf: L.extracted(docs(spark, sf).select("id", F.regexp_replace("content", r"(?m)^#+ (.*)$", "[$1](http://h/$1)").alias("content")), "id", "content", L.markdown_links),
        # chunks, text
        "chk_01_headings": lambda spark, sf: K.chunked(docs(spark, sf), "id", "content", K.chunk_by_headings),
        "chk_04_windows": lambda spark, sf: K.chunked(docs(spark, sf), "id", "content", K.chunk_by_windows, window=4096),
        "chk_06_titles": lambda spark, sf: docs(spark, sf).where("url is not null").select("id", T.title_from_url(F.col("url")).alias("title")),
        "dup_05_chunks": lambda spark, sf: K.dedupe_chunks(chunks(spark, sf)).select("id"),
        "prj_05_prefixed": lambda spark, sf: embedding_text(chunks(spark, sf), docs(spark, sf)),
        "scl_02_tokens": lambda spark, sf: docs(spark, sf).select("id", T.tokens(F.col("content")).alias("tokens")),
        "scl_05_titles": lambda spark, sf: docs(spark, sf).select("id", T.slug(F.col("title")).alias("slug"), T.truncated(F.col("title"), 30).alias("short")),
        "scl_06_times": lambda spark, sf: messages(spark, sf).select("message_id", F.date_format(T.epoch_time(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("time")),
        "scl_08_vectors": lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.round(T.norm(F.col("embedding")), 6).alias("norm"), F.round(T.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"), F.round(T.l2(F.col("embedding"), F.reverse("embedding")), 6).alias("l2")),
        "scl_16_versions": lambda spark, sf: docs(spark, sf).where("library is not null and version is not null").groupBy("library").agg(F.max_by("version", T.semver_key(F.col("version"))).alias("latest")).select("library", "latest", T.bump_patch(F.col("latest")).alias("next")),
        "udf_01_embeddings": lambda spark, sf: embed(chunks(spark, sf), HashedWordsEmbedder(32), "id", "content"),
        "udf_08_contexts": lambda spark, sf: context_prompt(S.search(chunks(spark, sf), docs(spark, sf), docs(spark, sf).where("id % 20 = 0").select(F.col("id").alias("request_id"), F.col("title").alias("query")), limit=5), chunks(spark, sf), docs(spark, sf)).select("request_id", "context"),
        # registries
        "rnk_12_pack_scores": lambda spark, sf: S.pack_scores(_packs(spark, sf), "fennmark-core").select("name", "score"),
        "srt_04_resolved": lambda spark, sf: X.resolve_packs(*_offers(spark, sf)),
        "join_22_chosen": lambda spark, sf: X.resolve_packs(*_offers(spark, sf), choose="model-generated"),
        # logs
        "agg_15_corpus": lambda spark, sf: chunks(spark, sf).where("content is not null").select("id", R.terms(F.col("content")).alias("t")).agg(F.count("*").alias("n"), F.round(F.avg(F.size("t")), 6).alias("avgdl")),
        "agg_15_document_frequency": lambda spark, sf: chunks(spark, sf).where("content is not null").select("id", F.explode(F.array_distinct(R.terms(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")),
        "str_06_fixed_windows": lambda spark, sf: Q.fixed_window_limit(_requests(spark, sf), most=1).where("refused > 0").select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "requests", "refused"),
        "str_07_sliding_gate": lambda spark, sf: Q.sliding_gate(table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), most=1, seconds=600).where("waits").select("event_id", "in_window"),
        "str_01_debounced": lambda spark, sf: Q.debounced(_requests(spark, sf), "user_id", gap="10 minutes").select("user_id", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"), "events"),
    }


_D = "(SELECT DISTINCT id, title, content, url, library, version, topic_id, source_type, submitted_by, created_at, updated_at, expires_at FROM kb_documents)"
_C = "(SELECT DISTINCT id, document_id, chunk_index, content FROM kb_chunks)"
_GOOD = "len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64"
_MEANS = f"WITH v AS (SELECT DISTINCT chunk_id, document_id, embedding::DOUBLE[] AS e FROM kb_embeddings WHERE {_GOOD}), u AS (SELECT document_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m0 AS (SELECT document_id AS id, i, avg(x) AS x FROM u WHERE document_id IS NOT NULL GROUP BY 1, 2), m AS (SELECT id, list(x ORDER BY i) AS e FROM m0 GROUP BY 1)"
_VER = "(string_split(version, '.')[1]::INT, string_split(version, '.')[2]::INT, string_split(version, '.')[3]::INT)"


def _rest(gone: str) -> str:
    """Rows of each table without the documents a condition holds for."""
    views = ", ".join(f"{v} AS ({PRELUDE[v]})" for v in ("docs", "chunks", "tags", "links")).replace("{", "").replace("}", "")
    return (
        f"WITH {views}, gone AS (SELECT id FROM docs WHERE {gone}) SELECT 'documents' AS tbl, count(*) AS n FROM (SELECT DISTINCT id FROM docs WHERE id NOT IN (FROM gone)) "
        "UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN (FROM gone) "
        f"UNION ALL SELECT 'embeddings', count(*) FROM (SELECT DISTINCT chunk_id, document_id FROM kb_embeddings WHERE {_GOOD}) WHERE document_id NOT IN (FROM gone) "
        "UNION ALL SELECT 'links', count(*) FROM links WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone) UNION ALL SELECT 'tags', count(*) FROM tags WHERE document_id NOT IN (FROM gone) "
        "UNION ALL SELECT 'ratings', count(*) FROM (SELECT DISTINCT id, document_id FROM kb_ratings) WHERE document_id NOT IN (FROM gone)"
    )


def oracle_sql():
    view = lambda sql: with_views(sql).replace("{", "").replace("}", "").replace(" AS STRING)", " AS VARCHAR)")
    host = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    resolved = f"SELECT DISTINCT source_type AS registry, length(source_type) AS priority, library AS name, version FROM {_D} WHERE library IS NOT NULL AND version IS NOT NULL"
    latest = f"SELECT name, registry, priority, arg_max(version, {_VER}) AS version FROM ({resolved}) GROUP BY 1, 2, 3"
    return {
        "src_04_parser_dispatch": f"SELECT id, CASE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^./]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' WHEN 'json' THEN 'json' WHEN 'pdf' THEN 'pdf' END AS parser FROM {_D} WHERE url IS NOT NULL",
        "src_01_export_rows": f"SELECT tbl AS \"table\", n FROM ({_rest('false')}) UNION ALL SELECT 'topics', count(DISTINCT id) FROM kb_topics",
        "src_26_channel_filter": "SELECT DISTINCT channel_id, channel_name FROM slack_messages WHERE channel_name IN ('general', 'ops-fennmark')",
        "src_40_registry_entries": f"SELECT library AS name, title AS description, version AS latest FROM {_D} WHERE id % 7 <> 0 AND trim(library) <> '' AND trim(version) <> '' AND title IS NOT NULL",
        "join_23_message_users": "SELECT DISTINCT message_id, CASE WHEN user_id IS NULL THEN 'unknown' ELSE 'Real ' || user_id END AS author, regexp_replace(text, '<@(U[A-Z0-9]+)>', '@Real \\1', 'g') AS text FROM slack_messages",
        "snk_02_url_status": f"SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN o.h = sha256(n.content) THEN 'unchanged' ELSE 'changed' END AS status, o.id AS old_id FROM {_D} n LEFT JOIN (SELECT url, min(id) AS id, arg_min(sha256(content), id) AS h FROM {_D} WHERE url IS NOT NULL AND id % 2 = 1 GROUP BY url) o ON o.url = n.url WHERE n.id % 2 = 0",
        "snk_05_cascade": _rest("id % 3 = 0"),
        "snk_06_by_source": _rest("source_type = 'topic'"),
        "snk_07_by_prefix": _rest("url LIKE 'https://docs.%'"),
        "snk_07_by_tag": _rest("library LIKE 'fennmark%'"),
        "snk_08_pruned": _rest(f"expires_at <= TIMESTAMP '{AS_OF}'"),
        "snk_09_bulk_delete": _rest("id IN (SELECT id FROM docs WHERE library = 'fennmark-core' AND source_type = 'library' AND created_at >= TIMESTAMP '2024-06-01 00:00:00' ORDER BY id LIMIT 1000)"),
        "snk_09_bulk_retag": view("SELECT document_id, name FROM tags WHERE NOT (name = 'long' AND document_id IN (SELECT document_id FROM tags WHERE name = 'library')) UNION SELECT document_id, 'big' FROM tags WHERE name = 'long' AND document_id IN (SELECT document_id FROM tags WHERE name = 'library')"),
        "snk_13_rejected": f"SELECT DISTINCT r.id, r.document_id, CASE WHEN rating IS NULL OR rating < 1 OR rating > 5 THEN 'rating must be a whole number from 1 to 5' ELSE 'document not found' END AS reason FROM kb_ratings r LEFT JOIN {_D} d ON d.id = r.document_id WHERE rating IS NULL OR rating NOT BETWEEN 1 AND 5 OR d.id IS NULL",
        "snk_16_pack": f"SELECT library AS name, count(*) AS doc_count, count(*)::INT AS parsed FROM {_D} WHERE library IS NOT NULL GROUP BY 1",
        "snk_17_install_batches": f"SELECT (rn // 10)::INT AS batch, count(*) AS n, min(id) AS first_id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn FROM (SELECT DISTINCT id FROM {_D})) WHERE rn >= 25 GROUP BY 1",
        "snk_20_webhook_match": "SELECT DISTINCT id FROM kb_syncs WHERE status = 'completed' AND id % 3 > 0",
        "flt_05_escaped_words": f"SELECT id FROM {_C} WHERE contains(lower(content), '50%') OR contains(lower(content), 'fire_wall') OR contains(lower(content), 'checkpoint')",
        "flt_12_threshold": f"{_MEANS} SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.id < b.id AND round(list_cosine_similarity(a.e, b.e), 9) >= 0.95",
        "flt_13_globs": f"SELECT id FROM {_D} WHERE regexp_matches(url, '(?i)^.*\\.example/.*/pages/.*$') OR regexp_matches(url, '^https://[^/]*/docs/[^/]*$')",
        "flt_15_selected": view("SELECT DISTINCT a.document_id AS id FROM tags a JOIN tags b ON a.document_id = b.document_id WHERE a.name = 'long' AND b.name = 'library'"),
        "flt_17_private": r"SELECT DISTINCT message_id, ip, regexp_matches(ip, '^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.') AND len(list_filter(string_split(ip, '.'), lambda p: p::INT > 255 OR (len(p) > 1 AND p[1] = '0'))) = 0 AS private FROM (SELECT message_id, unnest(regexp_extract_all(text, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1)) AS ip FROM slack_messages)",
        "flt_19_references": f"WITH d AS (SELECT id, title, url FROM {_D}), r AS (SELECT id + 1 AS s, url AS t FROM d WHERE url IS NOT NULL UNION ALL SELECT id, upper(title) FROM d WHERE title IS NOT NULL), f AS (SELECT s, coalesce((SELECT min(id) FROM d WHERE d.url = r.t), (SELECT min(id) FROM d WHERE lower(d.title) = lower(r.t))) AS x FROM r) SELECT DISTINCT s AS source_id, x AS target_id FROM f WHERE x IS NOT NULL AND x <> s",
        "flt_20_list": f"SELECT id FROM {_D} WHERE source_type = 'manual' ORDER BY updated_at DESC NULLS LAST, id LIMIT 40 OFFSET 5",
        "flt_22_stale": f"SELECT DISTINCT id, CASE WHEN id % 5 = 0 THEN true WHEN id % 3 = 0 THEN false ELSE floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(started_at)) > id % 3 * 24 * 60 * 3600 END AS is_stale FROM kb_syncs",
        "flt_26_skip_reasons": f"SELECT id, CASE WHEN NOT ({host} = 'fennmark.example' OR {host} LIKE '%.fennmark.example') THEN 'domain' WHEN NOT starts_with({path}, '/docs') THEN 'path' WHEN lower(url) LIKE '%-copy%' THEN 'excluded' WHEN starts_with({path}, '/docs/a') THEN 'robots' END AS reason FROM {_D} WHERE url IS NOT NULL",
        "dup_02_groups": f"SELECT sha256(content) AS content_hash, list(id ORDER BY id) AS ids FROM {_D} WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "dup_03_exact": f"SELECT n.id, o.id IS NOT NULL AS is_duplicate, CASE WHEN o.id IS NOT NULL THEN 'exact' END AS strategy, o.id AS existing_id, CASE WHEN o.id IS NOT NULL THEN 1.0::DOUBLE END AS similarity FROM {_D} n LEFT JOIN (SELECT content, min(id) AS id FROM {_D} WHERE id % 2 = 1 AND content IS NOT NULL GROUP BY 1) o ON o.content = n.content WHERE n.id % 2 = 0",
        "dup_03_both": f"{_MEANS}, n AS (SELECT d.id, (SELECT min(o.id) FROM {_D} o WHERE o.content = d.content AND o.id % 20 <> 0) AS x, m.e FROM {_D} d LEFT JOIN m USING (id) WHERE d.id % 20 = 0), s AS (SELECT n.id, o.id AS near, round(1 - round(list_distance(n.e, o.e), 9), 9) AS s, row_number() OVER (PARTITION BY n.id ORDER BY round(list_distance(n.e, o.e), 9), o.id) AS r FROM n, m o WHERE n.x IS NULL AND n.e IS NOT NULL AND o.id % 20 <> 0), b AS (SELECT * FROM s WHERE r = 1 AND s >= 0.9) "
        "SELECT n.id, coalesce(x, near) IS NOT NULL AS is_duplicate, CASE WHEN x IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'semantic' END AS strategy, coalesce(x, near) AS existing_id, CASE WHEN x IS NOT NULL THEN 1.0 ELSE s END AS similarity FROM n LEFT JOIN b ON b.id = n.id",
        "dup_06_first_entries": f"SELECT library AS name, min(id) AS position FROM {_D} WHERE library IS NOT NULL GROUP BY 1",
        "grf_03_similar": f"{_MEANS} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM m a JOIN m b ON a.id < b.id WHERE round(list_cosine_similarity(a.e, b.e), 9) >= 0.85",
        "grf_05_prerequisites": view("SELECT source_id AS a, min(target_id) AS b FROM links WHERE link_type = 'prerequisite' AND source_id <> target_id GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT source_id AS a", ", n AS (SELECT source_id AS a", 1) + "), c AS (SELECT a AS document_id, 1 AS step, b AS prerequisite_id, [a, b] AS p FROM n UNION ALL SELECT document_id, step + 1, b, list_append(p, b) FROM c JOIN n ON n.a = c.prerequisite_id WHERE NOT list_contains(p, b)) SELECT document_id, step, prerequisite_id FROM c",
        "grf_06_titles": view("SELECT l.source_id AS document_id, 'out' AS direction, l.target_id AS other_id, d.title, l.link_type FROM links l JOIN docs d ON d.id = l.target_id WHERE l.link_type = 'see_also' UNION ALL SELECT l.target_id, 'in', l.source_id, d.title, l.link_type FROM links l JOIN docs d ON d.id = l.source_id WHERE l.link_type = 'see_also'"),
        "chk_06_titles": r"SELECT id, CASE WHEN t <> '' THEN t ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) END AS title FROM (SELECT id, url, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/?', ''), '/+$', ''), '([^/]+)$', 1), '\.[A-Za-z0-9]+$', ''), '[-_]+', ' ', 'g')) AS t FROM " + _D + " WHERE url IS NOT NULL)",
        "dup_05_chunks": r"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))) ORDER BY chunk_index) AS n FROM " + _C + ") WHERE n = 1",
        "prj_05_prefixed": f"SELECT c.id, concat_ws(' | ', nullif(concat_ws(' | ', d.title, 'Library: ' || d.library, 'Version: ' || d.version), ''), c.content) AS text FROM {_C} c JOIN {_D} d ON d.id = c.document_id",
        "scl_02_tokens": f"SELECT id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: len(t) >= 3 AND t NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)})) AS tokens FROM {_D}",
        "scl_05_titles": f"SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(title) > 30 THEN left(title, 27) || '...' ELSE title END AS short FROM {_D}",
        "scl_06_times": "SELECT DISTINCT message_id, strftime(make_timestamp(coalesce(try_cast(string_split(ts, '.')[1] AS BIGINT), 0) * 1000000), '%Y-%m-%d %H:%M:%S') AS time FROM slack_messages",
        "scl_08_vectors": "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_cosine_similarity(e, list_reverse(e)), 6) AS cosine, round(list_distance(e, list_reverse(e)), 6) AS l2 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        "scl_16_versions": f"SELECT library, latest, string_split(latest, '.')[1] || '.' || string_split(latest, '.')[2] || '.' || (string_split(latest, '.')[3]::INT + 1) AS next FROM (SELECT library, arg_max(version, {_VER}) AS latest FROM {_D} WHERE library IS NOT NULL AND version IS NOT NULL GROUP BY 1)",
        "rnk_12_pack_scores": f"WITH p AS (SELECT library AS name, min(title) AS d, list(DISTINCT source_type) AS t, min(submitted_by) AS a FROM {_D} WHERE library IS NOT NULL GROUP BY 1) SELECT * FROM (SELECT name, (CASE WHEN lower(name) = 'fennmark-core' THEN 100 WHEN contains(lower(name), 'fennmark-core') THEN 50 ELSE 0 END + CASE WHEN contains(lower(d), 'fennmark-core') THEN 20 ELSE 0 END + CASE WHEN contains(lower(coalesce(a, '')), 'fennmark-core') THEN 10 ELSE 0 END + coalesce(list_sum(list_transform(t, lambda x: CASE WHEN lower(x) = 'fennmark-core' THEN 30 WHEN contains(lower(x), 'fennmark-core') THEN 15 ELSE 0 END)), 0))::INT AS score FROM p) WHERE score > 0",
        "srt_04_resolved": f"SELECT name, arg_min(version, (priority, registry)) AS version, arg_min(registry, (priority, registry)) AS registry FROM ({latest}) GROUP BY 1",
        "join_22_chosen": f"SELECT name, arg_min(version, (registry <> 'model-generated', priority, registry)) AS version, arg_min(registry, (registry <> 'model-generated', priority, registry)) AS registry FROM ({latest}) GROUP BY 1",
        "agg_15_corpus": f"SELECT count(*) AS n, round(avg(len(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: t <> ''))), 6) AS avgdl FROM {_C} WHERE content IS NOT NULL",
        "agg_15_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: t <> ''))) AS term FROM {_C}) GROUP BY 1",
        "str_06_fixed_windows": "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests, count(*) - 1 AS refused FROM events GROUP BY user_id, date_trunc('minute', ts) HAVING count(*) > 1",
        "str_07_sliding_gate": "SELECT event_id, n AS in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 1",
        "str_01_debounced": "SELECT user_id, strftime(max(ts) + INTERVAL 10 MINUTES, '%Y-%m-%d %H:%M:%S') AS fired_at, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run",
    }
