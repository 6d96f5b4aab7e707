"""Deduplicating new batches against all history: incremental record linkage over persisted blocking keys."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import parse_qsl, unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.llm.similar import pair_up, pairs_of_postings, shingle_features, verified_links
from quillspark.operators.components import connected_components
from quillspark.session import Scratch, materialize, shared_dir, write

#: Query parameters that only tell where a visitor came from.
_VISITOR = re.compile(r"^(?:utm_\w+|ref|referrer|referer|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl|_hsenc|_hsmi|mkt_tok|campaign_id|source|src)$", re.I)
_INDEX = re.compile(r"/(?:index|default)\.(?:html?|php|aspx?|jsp)$", re.I)


def page_of(url: str | None) -> str | None:
    """What all spellings of a page's address share; None for null and blank addresses.

    Without protocol, letter case of the host, ``www.``, default port, trailing slash or index file, fragment, escaping,
    order of parameters and parameters that only tell where a visitor came from.
    """
    if url is None or not url.strip():
        return None
    url = url.strip()
    if not re.match(r"[a-z][a-z0-9+.-]*://", url, re.I):
        url = "http://" + url.lstrip("/")
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.").rstrip(".")
        port = parts.port
    except ValueError:
        return url.lower()
    if port in (80, 443):
        port = None
    path = _INDEX.sub("/", re.sub(r"/{2,}", "/", unquote(parts.path))).rstrip("/")
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not _VISITOR.match(k))
    return f"{host}{f':{port}' if port else ''}{path}" + ("?" + "&".join(f"{k}={v}" for k, v in query) if query else "")


@F.pandas_udf(StringType())
def _pages(urls: pd.Series) -> pd.Series:
    return urls.map(page_of, na_action="ignore")


def learn_weights(patterns: list[tuple[tuple[int, ...], int]], levels: tuple[int, ...], rounds: int = 60) -> np.ndarray:
    """Match weights (log2 of m / u) of each field's levels, learned without labels by expectation maximisation.

    ``patterns`` are the agreement patterns of candidate pairs, matching or not, with their numbers; there are at
    most as many as the levels' product. Returns an array (field, level).
    """
    x = np.array([p for p, _ in patterns]).reshape(-1, len(levels))
    n = np.array([c for _, c in patterns], float)
    m, u = np.ones((len(levels), max(levels))), np.ones((len(levels), max(levels)))
    for f, size in enumerate(levels):
        m[f, :size] = np.linspace(1, 3, size)
        u[f, :size] = np.linspace(3, 1, size)
    m, u = m / m.sum(1, keepdims=True), u / u.sum(1, keepdims=True)
    share = 0.5
    for _ in range(rounds if len(x) else 0):
        like = share * np.prod([m[f, x[:, f]] for f in range(len(levels))], axis=0)
        unlike = (1 - share) * np.prod([u[f, x[:, f]] for f in range(len(levels))], axis=0)
        w = like / (like + unlike + 1e-300)
        share = float(np.clip((w * n).sum() / n.sum(), 0.01, 0.99))
        for f, size in enumerate(levels):
            for level in range(size):
                at = x[:, f] == level
                m[f, level] = (w * n)[at].sum() + 0.1
                u[f, level] = ((1 - w) * n)[at].sum() + 0.1
            m[f, :size] /= m[f, :size].sum()
            u[f, :size] /= u[f, :size].sum()
    return np.log2(m / u)


#: Levels of the compared fields: likeness of contents (none, some, high, same words), page (other, missing, same), title (other, same).
LEVELS = (4, 3, 2)

#: The history's tables: columns, and the column whose hash gives the bucket.
TABLES = {
    "records": ("id bigint, batch bigint", "id"),
    "members": ("class bigint, id bigint, batch bigint, title bigint, page bigint", "class"),
    "pages": ("page bigint, id bigint, batch bigint, title bigint, class bigint", "page"),
    "sets": ("set_a bigint, set_b bigint, n int, class bigint", "set_a"),
    "classes": ("class bigint, n int, bitmap array<bigint>, content string", "class"),
    "keys": ("gram bigint, doc bigint", "gram"),
    "links": ("a bigint, b bigint, likeness double", "a"),
    "merges": ("node bigint, into bigint", "node"),
}


class History:
    """Everything accepted so far, as tables in one folder that any later session can open again.

    Each delivery adds one part to each table and, last of all, a manifest that names the parts that count; a delivery that
    breaks off leaves no trace. Parts are divided by hash into ``buckets``, and a delivery reads only the buckets its own
    keys fall into; parts are merged when they become many. A delivery is compared through its keys alone:

    - a class is a set of shingles; a record with a known set joins its class and compares nothing;
    - a new class probes the table of keys, of which every class has the same number (``similar.band_keys``);
      texts are kept, and their sets computed again for the candidates alone;
    - pages are blocked by the address without its spelling.

    Clusters are a union-find mapping: a record is its own representative until a row of ``merges`` says into which it
    went; a delivery writes rows for the representatives it merges and for no others. Weights are learned from the
    patterns of all candidate pairs so far, matching or not, whose counts the manifest keeps.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: float = 0.6, buckets: int = 16, most_parts: int = 24):
        self.spark, self.most_parts = spark, most_parts
        self.folder = (folder or f"{shared_dir(spark)}/history-{uuid.uuid4().hex[:12]}").rstrip("/")
        found = self._manifests()
        if found:
            self.state = json.loads(self.spark.read.text(f"{self.folder}/manifest/{max(found)}.json", wholetext=True).first()[0])
        else:
            self.state = {"number": 0, "threshold": threshold, "buckets": buckets, "parts": {t: [] for t in TABLES}, "patterns": []}

    # ---- storage

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.folder}/manifest")
        if not self._files().exists(at):
            return []
        return [int(m[1]) for s in self._files().listStatus(at) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))]

    def _commit(self) -> None:
        self.state["number"] += 1
        target = f"{self.folder}/manifest/{self.state['number']}.json"
        out = self._files().create(self._path(target + ".new"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        self._files().rename(self._path(target + ".new"), self._path(target))

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.state["buckets"]).cast("bigint")).cast("int")

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        """Add a part to a table; it counts from the next manifest on."""
        columns, by = TABLES[name]
        part = f"delivery={self.state['number']:06d}-{uuid.uuid4().hex[:6]}"
        rows = df.select(*[c.split()[0] for c in columns.split(", ")]).withColumn("bucket", self._bucket(by))
        write(rows.repartition("bucket"), f"{self.folder}/{name}/{part}", "bucket")
        self._added.append((name, part))
        return self._read(name, parts=[part])

    def _read(self, name: str, asked: DataFrame | None = None, column: str | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of a table; with ``asked``, of the buckets that its ``column`` falls into (at most ``buckets`` numbers)."""
        parts = self.state["parts"][name] if parts is None else parts
        columns = TABLES[name][0]
        if not parts:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(columns + ", delivery string, bucket int").option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/{p}" for p in parts])
        if asked is not None:
            rows = rows.where(F.col("bucket").isin([r[0] for r in asked.select(self._bucket(column)).distinct().collect()] or [-1]))
        return rows.drop("delivery", "bucket")

    def _compact(self) -> None:
        """Merge the parts of tables that have too many; of merges, every row then points to its representative."""
        for name, parts in self.state["parts"].items():
            if len(parts) > self.most_parts:
                rows = self._read(name)
                if name == "merges":
                    rows = self._resolve(rows.select(F.col("node").alias("id"))).toDF("node", "into")
                self._added = []
                self._write(name, rows)
                self.state["parts"][name] = [self._added[0][1]]

    # ---- deliveries

    @property
    def threshold(self) -> float:
        return self.state["threshold"]

    @property
    def weights(self) -> np.ndarray:
        """Match weights of each field's levels, from all candidate pairs so far."""
        return learn_weights([(tuple(p), c) for *p, c in self.state["patterns"]], LEVELS)

    def accept(self, batch: DataFrame) -> DataFrame:
        """Take in ``(id, batch, title, content, url)``; the pairs it makes with the history and within itself.

        Returns ``(id_a, id_b, batch_a, batch_b, likeness, same_page, same_title, no_page)``, id_a < id_b, likeness null
        under the threshold. Null ids are left out, repeated rows and ids already known count once; null contents and
        addresses match nothing. Pairs of large classes and pages are spread over many tasks.
        """
        self._added: list[tuple[str, str]] = []
        with Scratch(self.spark) as cut:
            out, counted = self._deliver(batch, cut)
        for name, part in self._added:
            self.state["parts"][name].append(part)
        total = {tuple(p): c for *p, c in self.state["patterns"]}
        for *pattern, count in counted:
            total[tuple(pattern)] = total.get(tuple(pattern), 0) + count
        self.state["patterns"] = [[*p, c] for p, c in sorted(total.items())]
        self._compact()
        self._commit()
        return out

    def _deliver(self, batch: DataFrame, cut: Scratch) -> tuple[DataFrame, list]:
        batch = batch.where("id is not null").select(F.col("id").cast("bigint").alias("id"), F.col("batch").cast("bigint").alias("batch"), "title", "content", "url")
        batch = batch.join(self._read("records", batch, "id").select("id"), "id", "left_anti")
        batch = batch.repartition(2 * self.spark.sparkContext.defaultParallelism, "id").dropDuplicates(["id"])  # as many tasks as cores for the shingles
        facts = batch.select("id", "batch", F.xxhash64(F.lower(F.trim("title"))).alias("title"), F.col("title").isNull().alias("untitled"), _pages("url").alias("address"), "content")
        facts = facts.select("id", "batch", F.when(~F.col("untitled"), F.col("title")).alias("title"), F.when(F.col("address").isNotNull(), F.xxhash64("address")).alias("page"), "content")
        feats = cut(shingle_features(facts, F.col("content"), ["id", "batch", "title", "page", "content"], 3, self.threshold, ("bitmap", "grams")), "batch")
        sets = ["set_a", "set_b", "n"]
        classes = feats.where("n > 0").groupBy(*sets).agg(F.min("id").alias("class"))
        known = self._read("sets", classes, "set_a").withColumnRenamed("class", "was")
        classes = cut(classes.join(known, sets, "left").select(*sets, F.coalesce("was", "class").alias("class"), F.col("was").isNull().alias("new")), "batch-classes")
        new = cut(feats.join(classes.select(*sets, "class"), sets, "left").select("id", "batch", "title", "page", "class"), "new")
        self._write("records", new)
        self._write("sets", classes.where("new"))
        fresh = feats.join(classes.where("new").select(F.col("class").alias("id")), "id", "left_semi").withColumnRenamed("id", "class")
        self._write("classes", fresh)
        keys = self._write("keys", fresh.select(F.explode("grams").alias("gram"), F.col("class").alias("doc")))
        cut.drop(feats)
        # candidates: pairs of a new class with any class that share keys
        probed = cut(self._read("keys", keys, "gram").join(keys.select("gram").distinct(), "gram", "left_semi"), "probed")
        postings = keys.withColumn("new", F.lit(True)).unionByName(probed.withColumn("new", F.lit(False)))
        candidates = cut(pairs_of_postings(postings, keys.count() + probed.count(), cut=cut).select("a", "b"), "candidates")
        ends = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        bodies = self._read("classes", ends, "class", self.state["parts"]["classes"] + [p for n, p in self._added if n == "classes"])
        texts_of = lambda ends: bodies.select(F.col("class").alias("k"), F.col("content").alias("text")).join(ends, "k", "left_semi")
        links = cut(verified_links(candidates, bodies, "class", self.threshold, texts_of, cut, 3), "links")
        both = self._write("links", links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness")))
        # pairs of records: a new one with members of its class or a linked one, and with those of its page
        member_parts = self.state["parts"]["members"] + [self._part("members", new.where("class is not null"))]
        pages = self._read("pages", new.where("page is not null"), "page", self.state["parts"]["pages"] + [self._part("pages", new.where("page is not null"))])
        touched = new.where("class is not null").select("class").distinct()
        near = self._read("links", touched, "class").unionByName(both).join(touched.withColumnRenamed("class", "a"), "a", "left_semi")
        near = cut(near.unionByName(touched.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("likeness"))), "near")
        members = self._read("members", near, "b", member_parts)
        mine = new.toDF("x", "batch_x", "title_x", "page_x", "class_x")
        by_text = mine.join(near.toDF("class_x", "class", "likeness"), "class_x")
        by_text = pair_up(by_text, members.toDF("class", "y", "batch_y", "title_y", "page_y"), "class", "y").drop("class", "class_x")
        by_page = mine.where("page_x is not null").withColumn("page", F.col("page_x"))
        by_page = pair_up(by_page, pages.toDF("page", "y", "batch_y", "title_y", "class_y"), "page", "y").select("x", "batch_x", "title_x", "page_x", F.lit(None).cast("double").alias("likeness"), "y", "batch_y", "title_y", F.col("page").alias("page_y"))
        found = by_text.unionByName(by_page).where("x <> y")
        first = F.col("x") < F.col("y")
        end = lambda c, one: F.when(first, F.col(f"{c}_x" if one else f"{c}_y")).otherwise(F.col(f"{c}_y" if one else f"{c}_x"))
        rows = found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), end("batch", True).alias("batch_a"), end("batch", False).alias("batch_b"), "likeness", *self._agreement("x", "y"))
        out = materialize(rows.groupBy("id_a", "id_b", "batch_a", "batch_b", "same_page", "same_title", "no_page").agg(F.max("likeness").alias("likeness")), "batch-pairs")
        self._merge(new, links, pages, cut)
        # patterns: the pairs, and of the candidates that are none one pair of representatives each
        failed = candidates.join(links.select("a", "b"), ["a", "b"], "left_anti")
        heads = self._read("members", ends, "class", member_parts).where("class = id").select(F.col("id"), "title", "page")
        failed = failed.join(heads.toDF("a", "title_x", "page_x"), "a").join(heads.toDF("b", "title_y", "page_y"), "b").select(F.lit(None).cast("double").alias("likeness"), *self._agreement("x", "y"))
        failed = failed.where("not same_page")
        counted = out.select("likeness", "same_page", "same_title", "no_page").unionByName(failed).select(*self._levels()).groupBy("l0", "l1", "l2").count().collect()  # at most 24 patterns
        return out, [tuple(r) for r in counted]

    def _part(self, name: str, df: DataFrame) -> str:
        self._write(name, df)
        return self._added[-1][1]

    @staticmethod
    def _agreement(x: str, y: str) -> list:
        same = lambda c: F.coalesce(F.col(f"{c}_{x}") == F.col(f"{c}_{y}"), F.lit(False))
        return [same("page").alias("same_page"), same("title").alias("same_title"), (F.col(f"page_{x}").isNull() | F.col(f"page_{y}").isNull()).alias("no_page")]

    @staticmethod
    def _levels() -> list:
        likeness = F.when(F.col("likeness").isNull(), 0).when(F.col("likeness") < 0.8, 1).when(F.col("likeness") < 1, 2).otherwise(3)
        page = F.when(F.col("same_page"), 2).when(F.col("no_page"), 1).otherwise(0)
        return [likeness.alias("l0"), page.alias("l1"), F.col("same_title").cast("int").alias("l2")]

    # ---- clusters

    def _merge(self, new: DataFrame, links: DataFrame, pages: DataFrame, cut: Scratch) -> None:
        """Merge the representatives that the delivery connects: each new record with its class and page, classes with linked ones."""
        first = pages.join(new.where("page is not null").select("page").distinct(), "page", "left_semi").groupBy("page").agg(F.min("id").alias("to"))
        edges = new.where("class is not null").select(F.col("id").alias("src"), F.col("class").alias("dst"))
        edges = edges.unionByName(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        edges = cut(edges.unionByName(new.join(first, "page").select(F.col("id").alias("src"), F.col("to").alias("dst"))).where("src <> dst").distinct(), "edges")
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        head = cut(self._resolve(ends), "heads")
        over = edges.join(head.toDF("src", "s"), "src").join(head.toDF("dst", "d"), "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
        merged = connected_components(over, cut=cut).where("node <> component")
        self._write("merges", merged.toDF("node", "into"))

    def _resolve(self, ids: DataFrame) -> DataFrame:
        """``(id, cluster)``: the representative of each id, following the mapping as long as it leads on."""
        at = ids.select("id", F.col("id").alias("cluster"))
        while self.state["parts"]["merges"]:
            step = self._read("merges", at, "cluster")
            moved = materialize(at.join(step.toDF("cluster", "into"), "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster"), F.col("into").isNotNull().alias("went")), "resolved")
            at = moved.select("id", "cluster")
            if not moved.where("went").limit(1).count():
                break
        return at

    def clusters(self, ids: DataFrame | None = None) -> DataFrame:
        """``(id, cluster)`` of some records, or of all."""
        return self._resolve(self._read("records").select("id") if ids is None else ids)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """The pairs with their score: the sum of the fields' learned weights."""
        weights, total = self.weights, F.lit(0.0)
        for field, level in enumerate(self._levels()):
            table = F.array(*[F.lit(float(w)) for w in weights[field]])
            total = total + F.element_at(table, level.cast("int") + 1)
        return pairs.withColumn("score", total)


def repeated_records(history: History, pairs: DataFrame) -> DataFrame:
    """``(id, repeats, score, cluster)``: for each record of a later batch the best-scored record it repeats."""
    scored = history.scored(pairs.where("batch_a <> batch_b"))
    later = scored.select(F.when(F.col("batch_a") > F.col("batch_b"), F.col("id_a")).otherwise(F.col("id_b")).alias("id"), F.when(F.col("batch_a") > F.col("batch_b"), F.col("id_b")).otherwise(F.col("id_a")).alias("repeats"), "score", "likeness")
    best = later.groupBy("id").agg(F.max(F.struct("score", F.coalesce("likeness", F.lit(0.0)).alias("likeness"), (-F.col("repeats")).alias("low"))).alias("best"))
    best = materialize(best, "best")
    return best.join(history.clusters(best.select("id")), "id").select("id", (-F.col("best.low")).alias("repeats"), F.round("best.score", 6).alias("score"), "cluster")
