"""Near-duplicate records with small edits: groups of records connected by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.similar import candidate_pairs, pair_up, shingle_features, verified_links
from quillspark.operators.components import connected_components
from quillspark.session import Scratch, materialize


def near_duplicate_groups(df: DataFrame, id_col: str, text: Column, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Group records whose texts have a likeness of at least ``threshold``, directly or through others.

    Returns ``(id, group_id, links)``, one row per id with a usable text: ``group_id`` is the smallest id
    of the group (its own for a record like no other) and ``links`` the number of class representatives
    its class is linked to, counting its own copies as one. Copies (texts with the same set of shingles)
    form a class that is joined through its smallest id. Rows with a null id, a null text or one of fewer
    words than ``width`` are left out; repeated rows of an id count once (of differing rows, the one with the
    smallest set hash). An empty table gives an empty result; other columns are ignored.
    """
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), text.alias("_t"))
    with Scratch(df.sparkSession) as cut:
        feats = cut(shingle_features(texts, F.col("_t"), ["id"], width, threshold, ("bitmap", "grams")).where("n > 0"), "features")
        one = feats.groupBy("id").agg(F.min(F.struct("set_a", "set_b", "n")).alias("s"))
        classes = one.groupBy("s").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        members = materialize(one.join(classes, "s").select("id", "rep", "copies", F.col("s.set_a").alias("set_a"), F.col("s.set_b").alias("set_b")), "members")
        reps = members.where("id = rep").select("id", "set_a", "set_b")
        rep_feats = cut(feats.join(reps, ["id", "set_a", "set_b"], "left_semi").dropDuplicates(["id"]), "rep-features")
        cut.drop(feats)

        def sets(ends: DataFrame) -> DataFrame:
            """Shingles are computed again for the candidates alone: for all texts they are several times their compressed size."""
            cut.drop(rep_feats)
            again = shingle_features(texts.join(ends.withColumnRenamed("k", "id"), "id", "left_semi"), F.col("_t"), ["id"], width, threshold, ("shingles",))
            return again.join(reps, ["id", "set_a", "set_b"], "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "k")

        links = materialize(verified_links(candidate_pairs(rep_feats, "id", cut=cut), rep_feats, "id", threshold, sets, cut), "links")
    label = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("others"))
    return (
        members.join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.when(F.col("copies") > 1, 1).otherwise(0)).cast("bigint").alias("links"))
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs ``(id_a, id_b)``, id_a < id_b, within the groups (asked for where groups are small); large groups are salted."""
    some = groups.join(groups.groupBy("group_id").count().where("count > 1").select("group_id"), "group_id", "left_semi")
    a, b = some.select("group_id", F.col("id").alias("id_a")), some.select("group_id", F.col("id").alias("id_b"))
    return pair_up(a, b, "group_id", "id_b").where("id_a < id_b").select("id_a", "id_b")
