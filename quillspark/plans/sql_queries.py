"""Relational operators of the document store as SQL plans.

Each plan is one text over the tables in braces; it runs on Spark, and with the table names in place of the braces
on any SQL engine. ``PRELUDE`` defines the views of the store: every record once, and the tables that follow from others
(tags, links, versions, search log, hits, webhooks).
"""

from __future__ import annotations

import re

from quillspark.session import table

AS_OF = "TIMESTAMP '2025-10-01 00:00:00'"

PRELUDE = {
    "docs": "SELECT DISTINCT id, sync_id, source_type, library, version, topic_id, title, content, url, submitted_by, content_hash, created_at, updated_at, expires_at FROM {kb_documents}",
    "chunks": "SELECT DISTINCT id, document_id, chunk_index, content FROM {kb_chunks}",
    "ratings": "SELECT DISTINCT id, document_id, rating, feedback, rated_by, created_at FROM {kb_ratings} WHERE rating BETWEEN 1 AND 5",
    "all_ratings": "SELECT DISTINCT id, document_id, rating, rated_by FROM {kb_ratings}",
    "topics": "SELECT DISTINCT id, name, description, trim(parent_id) AS parent_id FROM {kb_topics}",
    "syncs": "SELECT DISTINCT id, connector_type, connector_name, started_at, status FROM {kb_syncs}",
    "tags": "SELECT DISTINCT document_id, name FROM (SELECT id AS document_id, source_type AS name FROM docs UNION ALL SELECT id, library FROM docs UNION ALL SELECT id, CASE WHEN length(content) > 3000 THEN 'long' ELSE 'short' END FROM docs) t WHERE name IS NOT NULL",
    "links": "SELECT id AS source_id, CAST(floor(id / 2.0) AS BIGINT) AS target_id, CASE id % 3 WHEN 0 THEN 'prerequisite' WHEN 1 THEN 'see_also' ELSE 'related' END AS link_type FROM docs WHERE id >= 2",
    "search_log": "SELECT event_id AS id, concat(event_type, ' ', CAST(user_id % 20 AS STRING)) AS query, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 9 AS INT) END AS result_count, CAST(round(value) AS BIGINT) AS latency_ms, ts AS created_at FROM {events}",
    "hits": "SELECT event_id AS search_log_id, (event_id * 7) % 300 + 1 AS document_id, CAST(event_id % 5 + 1 AS INT) AS rank FROM {events} WHERE event_id % 7 <> 0",
    "versions": "SELECT d.id AS document_id, v.version, d.title FROM docs d JOIN (SELECT 1 AS version UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) v ON v.version <= 1 + d.id % 6",
    "messages": "SELECT DISTINCT message_id, channel_id, channel_name, ts, user_id, text, thread_ts, reply_count, subtype FROM {slack_messages}",
    "avg_ratings": "SELECT document_id, avg(rating) AS avg_rating, count(*) AS n FROM ratings GROUP BY document_id",
}

#: name: (SQL, text of the DuckDB variant where the dialects differ)
PLANS: dict[str, str | tuple[str, str]] = {
    # scans and lookups
    "src_01_export_counts": "SELECT 'documents' AS tbl, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'topics', count(*) FROM topics UNION ALL SELECT 'ratings', count(*) FROM all_ratings",
    "src_02_document_by_id": "SELECT id, title, library, url FROM docs WHERE id = 7",
    "src_03_topic_by_name": "SELECT id, name, parent_id FROM topics WHERE name LIKE 'Signed%'",
    "src_23_repository_status": "SELECT n.id, CASE WHEN o.url IS NULL THEN 'new' WHEN o.h = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM docs n LEFT JOIN (SELECT url, max(content_hash) AS h FROM docs WHERE url IS NOT NULL AND source_type = 'library' GROUP BY url) o ON o.url = n.url",
    "src_27_thread_class": "SELECT message_id, CASE WHEN thread_ts IS NULL THEN 'standalone' WHEN thread_ts = ts THEN 'parent' ELSE 'reply' END AS kind FROM messages",
    "src_28_thread_documents": (
        "SELECT channel_id, coalesce(thread_ts, ts) AS thread, count(*) AS messages, concat_ws('\\n---\\n', transform(array_sort(collect_list(struct(ts, message_id, concat('**', coalesce(user_id, 'bot'), '**:\\n', coalesce(text, '')) AS line))), x -> x.line)) AS document FROM messages GROUP BY channel_id, coalesce(thread_ts, ts)",
        "SELECT channel_id, coalesce(thread_ts, ts) AS thread, count(*) AS messages, string_agg(concat('**', coalesce(user_id, 'bot'), '**:', chr(10), coalesce(text, '')), concat(chr(10), '---', chr(10)) ORDER BY ts, message_id) AS document FROM messages GROUP BY channel_id, coalesce(thread_ts, ts)",
    ),
    "src_33_incremental_pages": f"SELECT id FROM docs WHERE updated_at > {AS_OF}",
    # sinks and changes
    "snk_02_url_upsert": "SELECT n.id, CASE WHEN o.url IS NULL THEN 'new' WHEN o.h = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM docs n LEFT JOIN (SELECT url, min(content_hash) AS h FROM docs WHERE sync_id <= 3 AND url IS NOT NULL GROUP BY url) o ON o.url = n.url WHERE n.sync_id > 3",
    "snk_03_title_length_guard": "SELECT n.id FROM docs n WHERE EXISTS (SELECT 1 FROM docs o WHERE o.title = n.title AND length(o.content) = length(n.content) AND o.id < n.id)",
    "snk_04_patch": "SELECT d.id, coalesce(p.title, d.title) AS title, CASE WHEN p.clear_library THEN NULL ELSE d.library END AS library FROM docs d LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN upper(title) END AS title, id % 3 = 0 AS clear_library FROM docs WHERE id % 5 = 0) p ON p.id = d.id",
    "snk_05_delete_cascade": "SELECT c.id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.id = c.document_id AND d.source_type = 'topic')",
    "snk_06_delete_source": "SELECT source_type, count(*) AS n FROM docs WHERE source_type <> 'manual' GROUP BY source_type",
    "snk_07_disconnect_prefix": "SELECT id FROM docs WHERE url IS NULL OR NOT url LIKE 'https://docs.%'",
    "snk_08_prune_expired": f"SELECT id FROM docs WHERE expires_at IS NULL OR expires_at > {AS_OF}",
    "snk_09_bulk_move": "SELECT id, CASE WHEN library = 'lumidock-sdk' THEN 'moved' ELSE topic_id END AS topic_id FROM docs",
    "snk_10_upsert_tags": "SELECT DISTINCT name FROM (SELECT DISTINCT lower(trim(name)) AS name FROM tags UNION ALL SELECT lower(trim(connector_type)) FROM syncs) t",
    "snk_11_upsert_config": "SELECT coalesce(n.connector_name, o.connector_name) AS connector_name, coalesce(n.status, o.status) AS status FROM (SELECT connector_name, max(status) AS status FROM syncs WHERE id % 2 = 0 GROUP BY connector_name) n FULL OUTER JOIN (SELECT connector_name, min(status) AS status FROM syncs GROUP BY connector_name) o ON n.connector_name = o.connector_name",
    "snk_12_first_hits": "SELECT search_log_id, document_id, min(rank) AS rank FROM hits GROUP BY search_log_id, document_id",
    "snk_13_rating_check": "SELECT r.id, CASE WHEN r.rating IS NULL OR r.rating NOT BETWEEN 1 AND 5 THEN 'bad rating' WHEN d.id IS NULL THEN 'no document' ELSE 'ok' END AS verdict FROM all_ratings r LEFT JOIN docs d ON d.id = r.document_id",
    "snk_14_rename_topic": "SELECT id, CASE WHEN parent_id IS NULL THEN concat('Root: ', name) ELSE name END AS name FROM topics",
    "snk_16_pack_documents": "SELECT library, count(*) AS doc_count, sum(length(content)) AS chars FROM docs WHERE library IS NOT NULL GROUP BY library",
    "snk_18_installed": "SELECT DISTINCT library AS name FROM docs WHERE library IS NOT NULL AND library NOT LIKE '%sdk'",
    "snk_23_reindex_selection": f"SELECT c.id FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.updated_at < {AS_OF}",
    "snk_25_sync_state": "SELECT connector_type, connector_name, status FROM (SELECT s.*, row_number() OVER (PARTITION BY connector_type, connector_name ORDER BY id DESC) AS rn FROM syncs s) t WHERE rn = 1",
    "snk_27_add_tags": "SELECT document_id, name FROM tags UNION SELECT id, 'reviewed' FROM docs WHERE id % 4 = 0",
    "snk_29_page_outcome": "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty' WHEN updated_at = created_at THEN 'unchanged' WHEN url IS NOT NULL THEN 'updated' ELSE 'indexed' END AS outcome FROM docs) t GROUP BY outcome",
    "snk_30_counters": "SELECT source_type, sum(CASE WHEN updated_at > created_at THEN 1 ELSE 0 END) AS updated, count(*) AS indexed FROM docs GROUP BY source_type",
    # filters and projections
    "flt_01_metadata": "SELECT id FROM docs WHERE library = 'fennmark-core' AND source_type = 'library'",
    "flt_02_all_tags": "SELECT document_id FROM tags WHERE name IN ('library', 'long') GROUP BY document_id HAVING count(DISTINCT name) = 2",
    "flt_03_min_rating": "SELECT d.id FROM docs d LEFT JOIN avg_ratings a ON a.document_id = d.id WHERE a.avg_rating >= 3.5",
    "flt_04_date_range": f"SELECT id FROM docs WHERE created_at >= TIMESTAMP '2025-03-01 00:00:00' AND created_at <= {AS_OF}",
    "flt_05_any_word": "SELECT c.id FROM chunks c WHERE lower(c.content) LIKE '%firewall%' OR lower(c.content) LIKE '%checkpoint%'",
    "flt_07_root_topics": "SELECT id, name FROM topics WHERE parent_id IS NULL OR parent_id = ''",
    "flt_08_in_list": "SELECT document_id, name FROM tags WHERE document_id IN (1, 5, 9, 13, 21)",
    "flt_09_not_in": "SELECT id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.document_id = d.id)",
    "flt_10_url_prefix": "SELECT id FROM docs WHERE url LIKE 'https://www.%'",
    "flt_11_expired": f"SELECT id FROM docs WHERE expires_at IS NOT NULL AND expires_at <= {AS_OF}",
    "flt_14_extension": "SELECT id FROM docs WHERE url LIKE '%.html' OR url LIKE '%/docs/%'",
    "flt_15_bulk_selector": "SELECT d.id FROM docs d WHERE d.library IS NOT NULL AND EXISTS (SELECT 1 FROM tags t WHERE t.document_id = d.id AND t.name = 'long') ORDER BY d.id LIMIT 1000",
    "flt_18_same_domain": (
        "SELECT id FROM docs WHERE parse_url(url, 'HOST') = 'fennmark.example' OR parse_url(url, 'HOST') LIKE '%.fennmark.example'",
        "SELECT id FROM docs WHERE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) = 'fennmark.example' OR regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) LIKE '%.fennmark.example'",
    ),
    "flt_20_recent": "SELECT id, title FROM docs ORDER BY updated_at DESC NULLS LAST, id LIMIT 50",
    "flt_21_field_checks": "SELECT id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' WHEN url IS NOT NULL AND lower(url) NOT LIKE 'http%' THEN 'url' WHEN library IS NOT NULL AND version IS NULL THEN 'version' ELSE 'ok' END AS reason FROM docs",
    "flt_25_dedup_mode": "SELECT id, CASE WHEN n > 1 AND id > first_id THEN 'skip' WHEN n > 1 THEN 'warn' ELSE 'index' END AS decision FROM (SELECT id, count(*) OVER (PARTITION BY content) AS n, min(id) OVER (PARTITION BY content) AS first_id FROM docs WHERE content IS NOT NULL) t",
    "prj_02_neighbours": "SELECT DISTINCT CASE WHEN source_id = 20 THEN target_id ELSE source_id END AS neighbour FROM links WHERE source_id = 20 OR target_id = 20",
    "prj_05_embedding_text": "SELECT c.id, concat(concat_ws(' | ', d.title, concat('Library: ', d.library), concat('Version: ', d.version)), ' | ', c.content) AS text FROM chunks c JOIN docs d ON d.id = c.document_id".replace("concat('Library: ', d.library)", "'Library: ' || d.library").replace("concat('Version: ', d.version)", "'Version: ' || d.version"),
    "prj_04_context": (
        "SELECT document_id, concat_ws('\\n\\n', transform(array_sort(collect_list(struct(chunk_index, id, content))), x -> x.content)) AS context FROM chunks GROUP BY document_id",
        "SELECT document_id, string_agg(content, concat(chr(10), chr(10)) ORDER BY chunk_index, id) AS context FROM chunks GROUP BY document_id",
    ),
    # joins
    "join_01_chunks_documents": "SELECT c.id, d.title, d.library FROM chunks c JOIN docs d ON d.id = c.document_id",
    "join_02_documents_ratings": "SELECT d.id, round(a.avg_rating, 6) AS avg_rating FROM docs d LEFT JOIN avg_ratings a ON a.document_id = d.id",
    "join_04_tag_names": "SELECT t.document_id, t.name, n.uses FROM tags t JOIN (SELECT name, count(*) AS uses FROM tags GROUP BY name) n ON n.name = t.name",
    "join_05_link_titles": "SELECT l.source_id, s.title AS source_title, l.target_id, t.title AS target_title, l.link_type FROM links l JOIN docs s ON s.id = l.source_id JOIN docs t ON t.id = l.target_id",
    "join_06_semi": "SELECT d.id FROM docs d WHERE EXISTS (SELECT 1 FROM tags t WHERE t.document_id = d.id AND t.name = 'topic')",
    "join_07_never_hit": f"SELECT d.id FROM docs d WHERE d.created_at < {AS_OF} AND NOT EXISTS (SELECT 1 FROM hits h JOIN search_log s ON s.id = h.search_log_id WHERE h.document_id = d.id AND h.rank = 1)",
    "join_08_latest_sync": "SELECT s.id, s.connector_name, s.status FROM syncs s JOIN (SELECT connector_type, connector_name, max(id) AS id FROM syncs GROUP BY connector_type, connector_name) m ON m.id = s.id",
    "join_10_band": "SELECT a.id, count(*) AS around FROM chunks a JOIN chunks b ON b.document_id = a.document_id AND abs(a.chunk_index - b.chunk_index) <= 2 AND a.id <> b.id GROUP BY a.id",
    "join_12_topic_counts": "SELECT t.id, count(d.id) AS documents FROM topics t LEFT JOIN docs d ON d.topic_id = t.id GROUP BY t.id",
    "join_16_scalar_subquery": "SELECT d.id, (SELECT round(avg(r.rating), 6) FROM ratings r WHERE r.document_id = d.id) AS avg_rating FROM docs d",
    "join_17_overview": "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM search_log) AS searches, (SELECT round(avg(latency_ms)) FROM search_log) AS latency",
    "join_18_hit_log": "SELECT s.query, d.title, count(*) AS n FROM hits h JOIN search_log s ON s.id = h.search_log_id JOIN docs d ON d.id = h.document_id GROUP BY s.query, d.title",
    "join_20_linked_blend": "SELECT document_id, id, CAST(0.6 AS DOUBLE) AS score FROM (SELECT c.document_id, c.id, row_number() OVER (PARTITION BY c.document_id ORDER BY c.chunk_index, c.id) AS rn FROM chunks c WHERE EXISTS (SELECT 1 FROM links l WHERE l.target_id = c.document_id AND l.link_type = 'related') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.document_id = c.document_id AND h.rank = 5)) t WHERE rn = 1",
    "join_21_state_diff": "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'same' ELSE 'updated' END AS change FROM (SELECT id, content_hash FROM docs WHERE id % 7 <> 0) o FULL OUTER JOIN (SELECT id, CASE WHEN id % 11 = 0 THEN 'x' ELSE content_hash END AS content_hash FROM docs WHERE id % 5 <> 0) n ON n.id = o.id WHERE coalesce(o.id, n.id) IS NOT NULL",
    # aggregations
    "agg_01_overview": "SELECT count(*) AS searches, round(avg(latency_ms)) AS latency, sum(CASE WHEN result_count = 0 THEN 1 ELSE 0 END) AS empty FROM search_log",
    "agg_02_popular": "SELECT d.id, count(*) AS hits FROM hits h JOIN docs d ON d.id = h.document_id GROUP BY d.id ORDER BY hits DESC, d.id LIMIT 20",
    "agg_03_top_queries": "SELECT query, count(*) AS n, round(avg(latency_ms)) AS latency FROM search_log GROUP BY query ORDER BY n DESC, query LIMIT 10",
    "agg_04_per_day": "SELECT CAST(CAST(created_at AS DATE) AS STRING) AS day, count(*) AS n FROM search_log WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '14' DAY GROUP BY CAST(created_at AS DATE)",
    "agg_05_bundle": "SELECT 'total' AS part, 'all' AS name, count(*) AS n, round(avg(result_count), 2) AS results FROM search_log UNION ALL SELECT 'top', query, n, r FROM (SELECT query, count(*) AS n, round(avg(result_count), 2) AS r FROM search_log GROUP BY query ORDER BY n DESC, query LIMIT 10) t UNION ALL SELECT 'empty', query, n, 0.0 FROM (SELECT query, count(*) AS n FROM search_log WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 10) u UNION ALL SELECT 'day', CAST(CAST(created_at AS DATE) AS STRING), count(*), round(avg(result_count), 2) FROM search_log WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY CAST(created_at AS DATE)",
    "agg_06_gaps": "SELECT query, count(*) AS n, CAST(max(created_at) AS DATE) AS last_day FROM search_log WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 20",
    "agg_07_rating_summary": "SELECT document_id, count(*) AS n, round(avg(rating), 6) AS average, coalesce(sum(CASE WHEN feedback IS NOT NULL THEN 1 ELSE 0 END), 0) AS comments FROM ratings GROUP BY document_id",
    "agg_08_average": "SELECT document_id, round(avg_rating, 6) AS avg_rating FROM avg_ratings",
    "agg_10_duplicate_titles": (
        "SELECT content_hash, count(*) AS n, array_join(array_sort(collect_list(lpad(CAST(id AS STRING), 10, '0'))), ',') AS ids FROM docs WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1",
        "SELECT content_hash, count(*) AS n, string_agg(lpad(CAST(id AS STRING), 10, '0'), ',' ORDER BY id) AS ids FROM docs WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1",
    ),
    "agg_12_versions": "SELECT document_id, max(version) + 1 AS next_version, count(*) AS n FROM versions GROUP BY document_id",
    "agg_16_sync_counters": "SELECT connector_type, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS completed, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS running, count(*) AS runs FROM syncs GROUP BY connector_type",
    "agg_18_dashboard": "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM ratings) AS ratings, (SELECT count(*) FROM links) AS links, (SELECT count(DISTINCT name) FROM tags) AS tags",
    # windows, sorts
    "win_02_cap_per_document": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY length(content) DESC, id) AS rn FROM chunks) t WHERE rn <= 2",
    "win_04_overlap": "SELECT id, concat(coalesce(right(lag(content) OVER (PARTITION BY document_id ORDER BY chunk_index, id), 20), ''), '|', content) AS text FROM chunks",
    "win_05_context": "SELECT id, lag(id) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS before_id, lead(id) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS after_id FROM chunks",
    "win_06_newest_versions": "SELECT document_id, version FROM (SELECT document_id, version, row_number() OVER (PARTITION BY document_id ORDER BY version DESC) AS rn FROM versions) t WHERE rn <= 3",
    "win_09_hit_rank": "SELECT search_log_id, document_id, row_number() OVER (PARTITION BY search_log_id ORDER BY rank, document_id) AS place FROM hits",
    "srt_01_page": "SELECT id, title FROM docs ORDER BY id LIMIT 20 OFFSET 40",
    "srt_02_graph_nodes": "SELECT d.id FROM docs d LEFT JOIN avg_ratings a ON a.document_id = d.id ORDER BY a.avg_rating DESC NULLS LAST, d.updated_at DESC NULLS LAST, d.id LIMIT 200",
    "srt_03_sync_history": "SELECT id, connector_name FROM syncs ORDER BY id DESC LIMIT 20",
    "srt_05_ratings": "SELECT id, rating FROM ratings WHERE document_id = 5 ORDER BY created_at DESC, id",
    "srt_06_version_history": "SELECT version FROM versions WHERE document_id = 11 ORDER BY version DESC",
    # duplicates, graph, sets
    "dup_01_hash": ("SELECT id, sha2(content, 256) AS h FROM docs WHERE content IS NOT NULL", "SELECT id, sha256(content) AS h FROM docs WHERE content IS NOT NULL"),
    "dup_02_exact_groups": ("SELECT sha2(content, 256) AS h, count(*) AS n, min(id) AS first_id FROM docs WHERE content IS NOT NULL GROUP BY sha2(content, 256) HAVING count(*) > 1", "SELECT sha256(content) AS h, count(*) AS n, min(id) AS first_id FROM docs WHERE content IS NOT NULL GROUP BY sha256(content) HAVING count(*) > 1"),
    "dup_05_chunk_dedupe": (
        "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, sha2(trim(regexp_replace(content, '\\\\s+', ' ')), 256) ORDER BY chunk_index, id) AS rn FROM chunks) t WHERE rn = 1",
        "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) ORDER BY chunk_index, id) AS rn FROM chunks) t WHERE rn = 1",
    ),
    "grf_02_edges": "SELECT CAST(id AS STRING) AS source, topic_id AS target, 'belongs_to_topic' AS type FROM docs WHERE topic_id IS NOT NULL UNION ALL SELECT CAST(document_id AS STRING), name, 'has_tag' FROM tags UNION ALL SELECT CAST(source_id AS STRING), CAST(target_id AS STRING), link_type FROM links",
    "grf_06_links_in_out": "SELECT d.id, (SELECT count(*) FROM links l WHERE l.source_id = d.id) AS outgoing, (SELECT count(*) FROM links m WHERE m.target_id = d.id) AS incoming FROM docs d",
    "grf_10_topic_children": "SELECT p.id AS parent, c.id AS child FROM topics c JOIN topics p ON p.id = c.parent_id",
    "set_02_concat": "SELECT id FROM docs UNION ALL SELECT document_id FROM tags",
    "set_03_distinct": "SELECT DISTINCT library FROM docs",
    "set_04_difference": "SELECT id FROM docs EXCEPT SELECT document_id FROM hits",
    "set_05_containment": "SELECT document_id FROM tags WHERE name IN ('manual', 'short') GROUP BY document_id HAVING count(DISTINCT name) = 2",
    "set_06_intersect": "SELECT name FROM tags WHERE document_id % 2 = 0 INTERSECT SELECT name FROM tags WHERE document_id % 2 = 1",
    # scalar functions
    "scl_05_slug": (
        "SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-'), '^-|-$', '') AS slug FROM topics",
        "SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM topics",
    ),
    "scl_05_truncate": "SELECT id, CASE WHEN length(title) > 40 THEN concat(left(title, 37), '...') ELSE title END AS title FROM docs",
    "scl_16_semver": (
        "SELECT DISTINCT version, version RLIKE '^[0-9]+\\\\.[0-9]+\\\\.[0-9]+$' AS valid, regexp_replace(version, '\\\\.[0-9]+$', '.x') AS line FROM docs WHERE version IS NOT NULL",
        "SELECT DISTINCT version, regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+$') AS valid, regexp_replace(version, '\\.[0-9]+$', '.x') AS line FROM docs WHERE version IS NOT NULL",
    ),
}


def _needed(sql: str) -> list[str]:
    """The views a plan uses, those they use before them."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in PRELUDE:
            if re.search(rf"(?<![{{\w]){name}\b", text) and name not in found:
                visit(PRELUDE[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """The plan with the definitions of its views."""
    views = _needed(sql)
    return ("WITH " + ", ".join(f"{v} AS ({PRELUDE[v]})" for v in views) + " " if views else "") + sql


def run_plan(spark, sf: str, sql: str):
    """Run a plan over the tables below ``sf``."""
    text = with_views(sql)
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def queries():
    return {name: lambda spark, sf, sql=p if isinstance(p, str) else p[0]: run_plan(spark, sf, sql) for name, p in PLANS.items()}


def oracle_sql():
    return {name: re.sub(r"\{(\w+)\}", r"\1", with_views(p if isinstance(p, str) else p[1])) for name, p in PLANS.items()}
