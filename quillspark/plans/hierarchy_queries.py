"""Queries over the topic tree."""

from quillspark.operators.hierarchy import descendants, hierarchy, subtree_sizes
from quillspark.session import table


#: Nodes of a fragment; low enough that registered queries contract and expand.
FRAGMENT = 10_000


def _paths(spark, sf):
    return hierarchy(table(spark, sf, "kb_topics").select("id", "parent_id"), fragment_rows=FRAGMENT)


def queries():
    return {
        "p5_found": _paths,
        "p5_descendants": lambda spark, sf: descendants(_paths(spark, sf)),
        "p5_subtrees": lambda spark, sf: subtree_sizes(_paths(spark, sf)),
    }


_TREE = r"""
WITH RECURSIVE t0 AS (SELECT DISTINCT id, nullif(regexp_replace(parent_id, '^\s+|\s+$', '', 'g'), '') AS p FROM kb_topics WHERE id IS NOT NULL),
t AS (SELECT a.id, b.id AS p FROM t0 a LEFT JOIN t0 b ON a.p = b.id),
good AS (SELECT id, id AS root_id, 0 AS depth, id AS path FROM t WHERE p IS NULL
  UNION ALL SELECT t.id, g.root_id, g.depth + 1, g.path || '/' || t.id FROM good g JOIN t ON t.p = g.id),
bad AS (SELECT id, p FROM t WHERE id NOT IN (SELECT id FROM good)),
up AS (SELECT id AS origin, p AS pos FROM bad UNION SELECT up.origin, bad.p FROM up JOIN bad ON bad.id = up.pos),
found AS (SELECT id AS topic_id, root_id, depth::INT AS depth, path FROM good
  UNION ALL SELECT id, '', (CASE WHEN EXISTS (SELECT 1 FROM up WHERE origin = id AND pos = id) THEN -1 ELSE -2 END)::INT, '' FROM bad)
"""


def oracle_sql():
    below = """, below AS (SELECT unnest(string_split(path, '/')) AS topic_id, generate_subscripts(string_split(path, '/'), 1) - 1 AS pos, topic_id AS descendant_id, depth FROM found WHERE depth > 0)"""
    return {
        "p5_found": _TREE + "SELECT topic_id, root_id, depth, path FROM found",
        "p5_descendants": _TREE + below + " SELECT topic_id, descendant_id, (depth - pos)::INT AS distance FROM below WHERE pos < depth",
        "p5_subtrees": _TREE + below + " SELECT f.topic_id, count(b.pos)::BIGINT AS descendants, coalesce(max(b.depth - b.pos), 0)::INT AS deepest FROM found f LEFT JOIN below b ON b.topic_id = f.topic_id AND b.pos < b.depth GROUP BY f.topic_id",
    }
