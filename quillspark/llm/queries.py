"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import atexit

from pyspark.sql import functions as F

from quillspark.llm import langid, personal
from quillspark.llm.leaks import leaked_items
from quillspark.llm.linkage import History, repeated_records
from quillspark.llm.neardup import group_pairs, near_duplicate_groups
from quillspark.llm.neighbours import nearest_neighbours, similar_pairs
from quillspark.llm.split import one_text, split_items
from quillspark.llm.tokenize import encode_corpus
from quillspark.session import drop_path, materialize, table, tokenizer_dir


def _groups(spark, sf):
    docs = table(spark, sf, "kb_documents").where(F.length(F.regexp_replace("content", r"(?U)\s+", "")) > 0)
    return near_duplicate_groups(docs, "id", F.concat_ws(" ", F.coalesce("title", F.lit("")), "content"), threshold=0.6, width=3)


def _deliveries(spark, sf):
    """The history built from the earlier half of the batches, then the later half delivered to it; the folder goes at the end."""
    docs = table(spark, sf, "kb_documents").select("id", F.col("sync_id").alias("batch"), "title", "content", "url")
    middle = docs.agg(F.percentile_approx("batch", 0.5).alias("m")).first()["m"]
    history = History(spark)
    atexit.register(drop_path, spark, history.folder)
    first = history.accept(docs.where(F.col("batch") <= F.lit(middle)))
    history = History(spark, history.folder)  # as a later run would open it
    return history, first.unionByName(history.accept(docs.where((F.col("batch") > F.lit(middle)) | F.col("batch").isNull())))


def p2_found(spark, sf):
    return _deliveries(spark, sf)[1].where("batch_a <> batch_b").select("id_a", "id_b")


def p2_repeats(spark, sf):
    return repeated_records(*_deliveries(spark, sf))


def p4_found(spark, sf):
    docs, chunks = table(spark, sf, "kb_documents").select("id", "content"), table(spark, sf, "kb_chunks").select("id", "content")
    pieces = split_items(docs, "id", "content", "document", with_content=False).unionByName(split_items(chunks, "id", "content", "chunk", with_content=False))
    return pieces.where("chunk_index = 0").select("item_kind", "item_id", "boundary").distinct()


def p4_pieces(spark, sf):
    docs, chunks = table(spark, sf, "kb_documents").select("id", "content"), table(spark, sf, "kb_chunks").select("id", "document_id", "content")
    owners = chunks.select(F.col("id").alias("item_id"), "document_id").groupBy("item_id").agg(F.min("document_id").alias("document_id"))
    both = split_items(one_text(docs, "id", "content"), "id", "content", "document").withColumn("document_id", F.col("item_id").cast("bigint"))
    both = both.unionByName(split_items(one_text(chunks, "id", "content"), "id", "content", "chunk").join(owners, "item_id"))
    return both.select("item_kind", "item_id", "document_id", "chunk_index", "content")


def _personal(spark, sf, of):
    slack, ratings = table(spark, sf, "slack_messages"), table(spark, sf, "kb_ratings")
    return of(slack, "slack_messages", "message_id", "text"), of(ratings, "kb_ratings", "id", "feedback")


def p6_found(spark, sf):
    a, b = _personal(spark, sf, personal.personal_items)
    return a.unionByName(b).select("table_name", "row_id", "kind", "start_pos").distinct()


def p6_replaced(spark, sf):
    """Placeholders in the text."""
    a, b = _personal(spark, sf, personal.replace_items)
    return a.unionByName(b)


def p6_surrogates(spark, sf):
    """Keyed surrogates in the text; an entity has the same one in both tables."""
    a, b = _personal(spark, sf, personal.personal_items)
    names = materialize(personal.surrogate_table(a.unionByName(b), b"quillspark"), "entities")
    a, b = _personal(spark, sf, lambda *x: personal.replace_items(*x, surrogates=names))
    return a.unionByName(b)


def _segments(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return materialize(langid.segments(docs, langid.train(table(spark, sf, "lang_samples"), docs)), "segments")


def queries():
    vectors = lambda spark, sf: table(spark, sf, "kb_embeddings").select("chunk_id", "embedding")
    return {
        "p1_found": lambda spark, sf: similar_pairs(nearest_neighbours(vectors(spark, sf), least=0.85)),
        "p1_neighbours": lambda spark, sf: nearest_neighbours(vectors(spark, sf)),
        "p2_found": p2_found,
        "p2_repeats": p2_repeats,
        "p3_found": lambda spark, sf: group_pairs(_groups(spark, sf)),
        "p3_groups": _groups,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p6_found": p6_found,
        "p6_replaced": p6_replaced,
        "p6_surrogates": p6_surrogates,
        "p9_found": lambda spark, sf: langid.label_cases(_segments(spark, sf)),
        "p9_segments": lambda spark, sf: _segments(spark, sf).where("seg > 0"),
        "p9_documents": lambda spark, sf: langid.document_languages(_segments(spark, sf)),
        "p7_ids": lambda spark, sf: encode_corpus(table(spark, sf, "documents"), "doc_id", "text", f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"),
        "p8_found": lambda spark, sf: leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")),
    }


_RUNS = "list_transform(generate_series(1, len({w}) - {n} + 1), lambda i: array_to_string({w}[i:i + {n} - 1], ' '))"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _likeness_sql(rows: str) -> str:
    """Views up to ``linked``: pairs of ids whose texts (``id, text``) have a likeness of 0.6 or more."""
    return (
        f"t AS (SELECT id, any_value(text) AS text FROM ({rows}) GROUP BY id), w AS (SELECT id, {_WORDS.format('text')} AS w FROM t), "
        f"s AS (SELECT DISTINCT id, unnest({_RUNS.format(w='w', n=3)}) AS g FROM w WHERE len(w) >= 3), n AS (SELECT id, count(*) AS n FROM s GROUP BY id), "
        "common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), "
        "linked AS (SELECT x, y FROM common JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE c >= 0.6 * (p.n + q.n - c))"
    )


_PAGE = (
    r"u0 AS (SELECT id, any_value(sync_id) AS batch, regexp_replace(regexp_replace(trim(any_value(url)), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u FROM kb_documents WHERE id IS NOT NULL GROUP BY id), "
    r"u1 AS (SELECT id, batch, u, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host, url_decode(regexp_extract(u, '^[^/?]*([^?]*)', 1)) AS path, regexp_extract(u, '\?(.*)$', 1) AS q FROM u0 WHERE u <> ''), "
    r"page AS (SELECT id, batch, host || regexp_replace(regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/(index|default)\.(html?|php|aspx?|jsp)$', '/', 'i'), '/+$', '') || '?' || "
    r"array_to_string(list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: url_decode(replace(p, '+', ' ')) || CASE WHEN contains(p, '=') THEN '' ELSE '=' END), "
    r"lambda p: NOT regexp_matches(p, '(?i)^(utm_\w+|ref|referrer|referer|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl|_hsenc|_hsmi|mkt_tok|campaign_id|source|src)='))), '&') AS page FROM u1)"
)


def oracle_sql():
    return {
        "p2_found": "WITH " + _likeness_sql("SELECT id, content AS text FROM kb_documents WHERE id IS NOT NULL AND content IS NOT NULL") + f", {_PAGE} SELECT x AS id_a, y AS id_b FROM (SELECT x, y FROM linked UNION SELECT a.id, b.id FROM page a JOIN page b ON a.page = b.page AND a.id < b.id) JOIN u0 p ON p.id = x JOIN u0 r ON r.id = y WHERE p.batch <> r.batch",
        "p3_found": "WITH RECURSIVE " + _likeness_sql("SELECT id, coalesce(title, '') || ' ' || content AS text FROM kb_documents WHERE trim(content, E' \\t\\n\\r') <> ''") + ", e AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS id_a, y AS id_b FROM r WHERE x < y",
        "p8_found": f"WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL), "
        f"dr AS (SELECT doc_id, unnest({_RUNS.format(w='w', n=12)}) AS r FROM d WHERE len(w) >= 12), ir AS (SELECT item_id, unnest({_RUNS.format(w='w', n=12)}) AS r FROM i WHERE len(w) >= 12) SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)",
    }
