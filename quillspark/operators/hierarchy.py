"""Parent-child rows to full hierarchies: path, depth, root, descendants and loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize, partitions_for

_LEVEL = "node string, parent string, seg array<string>"


def _climb(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the parents held in this fragment: each node's chain up to where it leaves the fragment."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    whole = pd.concat(parts, ignore_index=True)
    parent = {n: p if isinstance(p, str) else None for n, p in zip(whole.node, whole.parent)}
    own = dict(zip(whole.node, whole.seg))
    done: dict[str, tuple[str | None, list[str], int]] = {}
    for first in parent:
        chain, on_way, node = [], set(), first
        while node in parent and node not in done and node not in on_way:
            chain.append(node)
            on_way.add(node)
            node = parent[node]
        if node is not None and node in on_way:  # a loop within the fragment
            at = chain.index(node)
            for n in chain[at:]:
                done[n] = (None, [], 1)
            for n in chain[:at]:
                done[n] = (None, [], 2)
            continue
        exit_, path, dead = done[node] if node in done else (node, [], 0)
        if dead:
            for n in chain:
                done[n] = (None, [], 2)
            continue
        for n in reversed(chain):
            path = path + list(own[n])
            done[n] = (exit_, path, 0)
    names = list(done)
    for at in range(0, len(names), 20_000):
        some = names[at : at + 20_000]
        yield pd.DataFrame({"node": some, "out": [done[n][0] for n in some], "seg": [done[n][1] for n in some], "dead": [done[n][2] for n in some], "own": [list(own[n]) if done[n][2] == 1 else [] for n in some]})


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", fragment_rows: int = 200_000) -> DataFrame:
    """``(topic_id, root_id, depth, path)`` of every node of parent-child rows, one row for each id.

    White space around a parent is ignored; a node whose parent is null, blank or no id of the table is a
    root with depth 0. ``path`` joins the ids from the root with ``/``. A node on a loop has depth -1, one
    below a loop -2, both with an empty root and path. Rows with a null id are left out, repeated rows of an
    id count once (of differing rows, the smallest non-blank parent counts), an empty table gives none.

    Fragments of about ``fragment_rows`` nodes are contracted to the nodes that other fragments enter them by;
    that smaller forest is solved in the same way, and the fragment paths are expanded from its solution.
    A node is put with its parent for about a quarter of all links, chosen anew in each round, so chains shrink
    whatever the number of fragments; children of a parent with very many stay apart, so no fragment fills.
    """
    spark = df.sparkSession
    trim = F.regexp_replace(F.col(parent_col).cast("string"), r"(?U)^\s+|\s+$", "")
    rows = df.select(F.col(id_col).cast("string").alias("node"), F.when(F.length(trim) > 0, trim).alias("parent")).where("node is not null")
    rows = rows.groupBy("node").agg(F.min("parent").alias("parent"))
    rows = materialize(rows, "rows")
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = rows.where("parent is not null").join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    # roots, which may be most rows, take no part in the join
    level = linked.unionByName(rows.where("parent is null")).select("node", "parent", F.array("node").alias("seg"))
    level = materialize(level, "forest")
    rounds: list[DataFrame] = []
    while True:
        count = level.count()
        cuts = 1 if count <= fragment_rows else partitions_for(count, fragment_rows, spark)
        if cuts == 1:
            placed = level.repartition(1)
        else:
            coin = lambda c: F.pmod(F.xxhash64(c, F.lit(len(rounds))), F.lit(2)) == 0
            busy = level.where("parent is not null").groupBy("parent").count().where(F.col("count") > max(1, fragment_rows // 10)).select("parent", F.lit(True).alias("busy"))
            joins = F.col("parent").isNotNull() & F.col("busy").isNull() & coin(F.col("node")) & ~coin(F.col("parent"))
            placed = level.join(busy, "parent", "left").withColumn("place", F.when(joins, F.col("parent")).otherwise(F.col("node"))).repartition(cuts, "place")
        solved = placed.select("node", "parent", "seg").mapInPandas(_climb, "node string, out string, seg array<string>, dead int, own array<string>")
        solved = materialize(solved, "fragments")
        rounds.append(solved)
        if cuts == 1:
            break
        entered = solved.where("out is not null").select(F.col("out").alias("node")).distinct()
        level = materialize(solved.join(entered, "node", "left_semi").where("dead = 0").select("node", F.col("out").alias("parent"), "seg").unionByName(
            # a node that ends in a loop stays, so that what hangs on it finds it
            solved.join(entered, "node", "left_semi").where("dead > 0").select("node", F.col("node").alias("parent"), F.array().cast("array<string>").alias("seg"))
        ), "quotient")
        if len(rounds) > 60:
            raise RuntimeError("the forest did not contract in 60 rounds")
    on_loop = rounds[0].where("dead = 1").select("node")
    for r in rounds[1:]:
        on_loop = on_loop.union(r.where("dead = 1").select(F.explode("own").alias("node")))
    answer = rounds[-1].select("node", "seg", F.col("dead") > 0)
    answer = answer.toDF("node", "full", "dead")
    for solved in reversed(rounds[:-1]):
        above = answer.toDF("out", "head", "above_dead")
        answer = materialize(
            solved.join(above, "out", "left").select(
                "node", F.concat(F.coalesce("head", F.array().cast("array<string>")), "seg").alias("full"), ((F.col("dead") > 0) | F.coalesce("above_dead", F.lit(False))).alias("dead")
            ),
            "expanded",
        )
    loops = on_loop.distinct().withColumn("loop", F.lit(True))
    lost = F.col("loop") | F.col("dead")
    return answer.join(loops, "node", "left").na.fill(False, ["loop"]).select(
        F.col("node").alias("topic_id"),
        F.when(lost, "").otherwise(F.element_at("full", 1)).alias("root_id"),
        F.when(F.col("loop"), -1).when(F.col("dead"), -2).otherwise(F.size("full") - 1).cast("int").alias("depth"),
        F.when(lost, "").otherwise(F.concat_ws("/", "full")).alias("path"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """``(topic_id, descendant_id, distance)``: for each node of ``hierarchy`` all nodes below it, at any depth.

    Topics on or below a loop have none. Ids must not contain ``/``. The rows grow with the sum of all depths.
    """
    steps = paths.where("depth > 0").select(F.posexplode(F.split("path", "/")).alias("at", "topic_id"), F.col("topic_id").alias("descendant_id"), "depth")
    return steps.where("at < depth").select("topic_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def subtree_sizes(paths: DataFrame) -> DataFrame:
    """``(topic_id, descendants, deepest)`` of every node: how many nodes hang below it and how far down."""
    below = descendants(paths).groupBy("topic_id").agg(F.count("*").alias("descendants"), F.max("distance").alias("deepest"))
    return paths.select("topic_id").join(below, "topic_id", "left").select("topic_id", F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"), F.coalesce("deepest", F.lit(0)).cast("int").alias("deepest"))
