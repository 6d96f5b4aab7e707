"""Reading and changing the store: lookups, indexing, patches, deletes, bulk changes, tags, topics, ratings, versions.

Every change takes tables and returns the tables as they are afterwards; ``Store.write`` puts them in place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import js_trim
from quillspark.operators.chunking import chunked, dedupe_chunks
from quillspark.operators.links import extracted, markdown_links, resolve_references, wiki_links
from quillspark.operators.search import Filters, matching_documents
from quillspark.providers import Embedder, embed


class DocumentNotFoundError(LookupError):
    pass


class ValidationError(ValueError):
    pass


def lookup(table: DataFrame, key, *columns: str, error: type[Exception] = LookupError):
    """The row whose first matching column (by default ``id``) equals ``key``; the earlier column wins, no row is an error."""
    for column in columns or ("id",):
        row = table.where(F.col(column).cast("string") == str(key)).limit(1).first()
        if row is not None:
            return row
    raise error(f"not found: {key}")


def get_document(docs: DataFrame, key):
    return lookup(docs, key, error=DocumentNotFoundError)


def list_documents(docs: DataFrame, filters: Filters | None = None, limit: int = 50, offset: int = 0, **tables) -> DataFrame:
    """Documents by filters, the last changed first."""
    return matching_documents(docs, filters or Filters(), **tables).orderBy(F.desc_nulls_last("updated_at"), "id").offset(max(0, offset)).limit(max(1, min(1000, limit)))


# ---- indexing


def embedding_text(chunks: DataFrame, docs: DataFrame, use_prefix: bool = True) -> DataFrame:
    """``(id, text)``: what of a chunk is embedded: title, library and version before its content, those there are."""
    if not use_prefix:
        return chunks.select("id", F.col("content").alias("text"))
    owner = docs.select(F.col("id").alias("document_id"), "title", "library", "version")
    tagged = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name), F.col(c)))
    head = F.concat_ws(" | ", "title", tagged("Library: ", "library"), tagged("Version: ", "version"))
    return chunks.join(owner, "document_id").select("id", F.concat_ws(" | ", F.when(head != "", head), "content").alias("text"))


def url_status(new: DataFrame, docs: DataFrame) -> DataFrame:
    """New documents with ``status``: new, unchanged or changed against the stored one of their address, and that one's id as ``old_id``."""
    old = docs.where("url is not null").groupBy("url").agg(F.min(F.struct("id", F.sha2("content", 256).alias("h"))).alias("o"))
    joined = new.join(old, "url", "left")
    status = F.when(F.col("o").isNull(), "new").when(F.col("o.h") == F.sha2("content", 256), "unchanged").otherwise("changed")
    return joined.withColumn("status", status).withColumn("old_id", F.col("o.id")).drop("o")


def dedup_decision(duplicate: Column, mode: str) -> Column:
    """What becomes of a document: ``skip`` leaves duplicates out, ``warn`` and ``force`` index them, the first with a note."""
    if mode not in ("skip", "warn", "force"):
        raise ValidationError(f"unknown mode {mode}")
    return F.when(~duplicate, "index").otherwise({"skip": "skip", "warn": "index_with_warning", "force": "index"}[mode])


@dataclass
class Store:
    """The tables of a document store."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    links: DataFrame
    tags: DataFrame
    ratings: DataFrame
    versions: DataFrame
    topics: DataFrame

    #: Tables whose rows belong to a document, and the column that says to which.
    CHILDREN = (("chunks", "document_id"), ("embeddings", "document_id"), ("tags", "document_id"), ("ratings", "document_id"), ("versions", "document_id"), ("links", "source_id"), ("links", "target_id"))
    SCHEMAS = {
        "documents": "id bigint, source_type string, library string, version string, topic_id string, title string, content string, url string, submitted_by string, content_hash string, created_at timestamp, updated_at timestamp, expires_at timestamp",
        "chunks": "id string, document_id bigint, chunk_index int, content string",
        "embeddings": "chunk_id string, document_id bigint, embedding array<float>",
        "links": "source_id bigint, target_id bigint, link_type string",
        "tags": "document_id bigint, name string",
        "ratings": "id bigint, document_id bigint, chunk_id string, rating int, feedback string, created_at timestamp",
        "versions": "document_id bigint, version int, title string, content string, created_at timestamp",
        "topics": "id string, name string, description string, parent_id string",
    }

    @classmethod
    def empty(cls, spark: SparkSession) -> "Store":
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in cls.SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "Store":
        return cls(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in cls.SCHEMAS.items()})

    def write(self, folder: str) -> "Store":
        """Write all tables to a new folder, which then holds the store; the old one stays as it was."""
        for name in self.SCHEMAS:
            getattr(self, name).write.mode("errorifexists").parquet(f"{folder}/{name}")
        return Store.read(self.documents.sparkSession, folder)

    def index(self, new: DataFrame, at: str, embedder: Embedder | None = None, most: int = 1500, overlap: float = 0.1, mode: str = "skip") -> tuple["Store", DataFrame]:
        """Take in documents ``(title, content, url, source_type, library, version, topic_id)``: the store and ``(title, url, id, status)``.

        A blank title or content is ``invalid``; the same content at a known address ``unchanged``; other content there
        ``changed``, which replaces the old document; a document with title and length of a known one is
        ``duplicate_title``, unless ``mode`` is force; all others are ``indexed``. Repeated rows of an address or of a text
        count once. New documents get chunks, vectors, and links to documents they name.
        """
        spark = new.sparkSession
        names = ["title", "content", "url", "source_type", "library", "version", "topic_id"]
        rows = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in names])
        rows = rows.withColumn("key", F.coalesce("url", F.sha2(F.concat_ws("\x1f", "title", "content"), 256))).groupBy("key").agg(*[F.min_by(c, F.struct("content", "title")).alias(c) for c in names])
        known = self.documents.select("title", F.length("content").alias("size")).where("title is not null").distinct().withColumn("twin", F.lit(True))
        judged = url_status(rows, self.documents).withColumn("size", F.length("content")).join(known, ["title", "size"], "left")
        blank = lambda c: F.coalesce(F.length(js_trim(F.col(c))), F.lit(0)) == 0
        twin = (F.col("status") == "new") & F.coalesce("twin", F.lit(False)) & F.lit(mode != "force")
        outcome = F.when(blank("title") | blank("content"), "invalid").when(F.col("status") == "unchanged", "unchanged").when(twin, "duplicate_title").when(F.col("status") == "changed", "changed").otherwise("indexed")
        from quillspark.session import materialize

        judged = judged.withColumn("outcome", outcome)
        top = self.documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        # ids: places within partitions by key, and the partitions' sizes before them
        placed = materialize(judged.repartition("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()).withColumn("taken", F.col("outcome").isin("indexed", "changed")), "judged")
        sizes = placed.where("taken").groupBy("part").count()
        before = sizes.withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")  # one row for each partition
        nth = F.row_number().over(Window.partitionBy("part").orderBy("key"))
        fresh = placed.where("taken").withColumn("nth", nth).join(before, "part").withColumn("id", F.col("base") + F.col("nth") + F.lit(top))
        time = F.to_timestamp(F.lit(at))
        fresh = materialize(
            fresh.select(
                F.col("id").cast("bigint").alias("id"), F.coalesce("source_type", F.lit("manual")).alias("source_type"), "library", "version", "topic_id", "title", "content", "url", F.lit("manual").alias("submitted_by"),
                F.sha2("content", 256).alias("content_hash"), time.alias("created_at"), time.alias("updated_at"), F.lit(None).cast("timestamp").alias("expires_at"), "old_id", "key",
            ),
            "fresh",
        )
        kept = self.delete(fresh.where("old_id is not null").select(F.col("old_id").alias("id")))
        docs = kept.documents.select(*Store._names("documents")).unionByName(fresh.select(*Store._names("documents")))
        pieces = dedupe_chunks(chunked(fresh, "id", "content", most=most, overlap=overlap)).withColumn("id", F.concat_ws("-", "document_id", "chunk_index"))
        pieces = materialize(pieces.select(*Store._names("chunks")), "pieces")
        vectors = embed(embedding_text(pieces, fresh), embedder, "id", "text") if embedder else spark.createDataFrame([], "id string, embedding array<float>")
        vectors = vectors.join(pieces.select("id", "document_id"), "id").select(F.col("id").alias("chunk_id"), "document_id", "embedding")
        named = extracted(fresh, "id", "content", wiki_links).unionByName(extracted(fresh, "id", "content", markdown_links))
        found = resolve_references(named, docs).withColumn("link_type", F.lit("references"))
        store = replace(kept, documents=docs, chunks=kept.chunks.select(*Store._names("chunks")).unionByName(pieces), embeddings=kept.embeddings.unionByName(vectors), links=kept.links.unionByName(found))
        return store, placed.select("title", "url", "key", F.col("outcome").alias("status"), "old_id").join(fresh.select("key", "id"), "key", "left").select("title", "url", F.coalesce("id", "old_id").alias("id"), "status")

    @staticmethod
    def _names(table: str) -> list[str]:
        return [c.split()[0] for c in Store.SCHEMAS[table].split(", ")]

    # ---- changes

    def delete(self, ids: DataFrame) -> "Store":
        """Without the documents ``(id)`` and all that belongs to them."""
        gone = ids.select("id").distinct()
        out = {"documents": self.documents.join(gone, "id", "left_anti")}
        for name, column in self.CHILDREN:
            out[name] = out.get(name, getattr(self, name)).join(gone.toDF(column), column, "left_anti")
        return replace(self, **out)

    def delete_document(self, key) -> "Store":
        get_document(self.documents, key)
        return self.delete(self.documents.where(F.col("id") == key).select("id"))

    def delete_where(self, condition: Column) -> tuple["Store", int]:
        """Delete the documents a condition holds for: a source type, an address prefix, an expiry; also the number of them."""
        ids = self.documents.where(condition).select("id").distinct()
        return self.delete(ids), ids.count()

    def delete_tagged(self, prefix: str) -> "Store":
        """Delete the documents with a tag that begins with ``prefix``."""
        return self.delete(self.tags.where(F.startswith("name", F.lit(prefix))).select(F.col("document_id").alias("id")).distinct())

    def prune_expired(self, as_of: str) -> tuple["Store", int]:
        return self.delete_where(F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.to_timestamp(F.lit(as_of))))

    def update(self, patch: DataFrame, at: str) -> "Store":
        """Patch documents: ``(id, fields, title, content, library, version, topic_id, url)``; only columns named in ``fields`` change, null clears.

        The state before becomes the document's next version; documents whose content changes lose their chunks and vectors
        and get new chunks.
        """
        names = ["title", "content", "library", "version", "topic_id", "url"]
        p = patch.select("id", "fields", *[F.col(c).alias(f"new_{c}") if c in patch.columns else F.lit(None).cast("string").alias(f"new_{c}") for c in names]).dropDuplicates(["id"])
        joined = self.documents.join(p, "id", "left")
        has = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))
        any_field = F.coalesce(F.size("fields") > 0, F.lit(False))
        new = {c: F.when(has(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in names}
        docs = joined.select(*[new[c].alias(c) if c in new else F.sha2(new["content"], 256).alias(c) if c == "content_hash" else F.when(any_field, F.to_timestamp(F.lit(at))).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in Store._names("documents")])
        touched = joined.where(any_field)
        numbers = self.versions.groupBy("document_id").agg(F.max("version").alias("last"))
        snapshot = touched.select(F.col("id").alias("document_id"), "title", "content").join(numbers, "document_id", "left").select("document_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "title", "content", F.to_timestamp(F.lit(at)).alias("created_at"))
        recut = touched.where(has("content") & ~F.col("content").eqNullSafe(F.col("new_content"))).select("id", F.col("new_content").alias("content"))
        gone = recut.select(F.col("id").alias("document_id"))
        pieces = chunked(recut, "id", "content").withColumn("id", F.concat_ws("-", "document_id", "chunk_index")).select(*Store._names("chunks"))
        return replace(self, documents=docs, versions=self.versions.unionByName(snapshot), chunks=self.chunks.join(gone, "document_id", "left_anti").select(*Store._names("chunks")).unionByName(pieces), embeddings=self.embeddings.join(gone, "document_id", "left_anti"))

    def rollback(self, document_id: int, version: int, at: str) -> "Store":
        """The document as it was in a version; its present state becomes a version first."""
        row = self.versions.where((F.col("document_id") == document_id) & (F.col("version") == version)).first()
        if row is None:
            raise LookupError(f"Version not found: {document_id} {version}")
        patch = self.documents.sparkSession.createDataFrame([(document_id, ["title", "content"], row["title"], row["content"])], "id bigint, fields array<string>, title string, content string")
        return self.update(patch, at)

    def newest_versions(self, keep: int = 10) -> "Store":
        nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version")))
        return replace(self, versions=self.versions.withColumn("_n", nth).where(F.col("_n") <= keep).drop("_n"))

    # ---- bulk

    def select(self, filters: Filters, most: int | None = 1000) -> DataFrame:
        """Ids of a bulk change, by filters, in order; an empty selector is refused."""
        if filters == Filters():
            raise ValidationError("a bulk change needs at least one condition")
        ids = matching_documents(self.documents, filters, self.tags, self.ratings).select("id").distinct()
        return ids if most is None else ids.orderBy("id").limit(most)

    def bulk_delete(self, filters: Filters, dry_run: bool = False) -> tuple["Store", DataFrame]:
        ids = self.select(filters)
        return (self if dry_run else self.delete(ids)), ids

    def bulk_retag(self, filters: Filters, add: list[str] = (), remove: list[str] = (), dry_run: bool = False) -> tuple["Store", DataFrame]:
        ids = self.select(filters)
        clean = lambda names: sorted({n.strip().lower() for n in names if n.strip()})
        mine = self.tags.join(ids.toDF("document_id"), "document_id", "left_semi")
        rest = self.tags.join(mine.where(F.col("name").isin(*clean(remove))), ["document_id", "name"], "left_anti").select("document_id", "name") if remove else self.tags.select("document_id", "name")
        new = ids.select(F.col("id").alias("document_id"), F.explode(F.array(*[F.lit(n) for n in clean(add)])).alias("name")) if add else None
        tags = rest if new is None else rest.unionByName(new).distinct()
        return (self if dry_run else replace(self, tags=tags)), ids

    def bulk_move(self, filters: Filters, topic_id: str, dry_run: bool = False) -> tuple["Store", DataFrame]:
        ids = self.select(filters)
        lookup(self.topics, topic_id)
        marked = self.documents.join(ids.withColumn("_m", F.lit(True)), "id", "left")
        docs = marked.withColumn("topic_id", F.when(F.col("_m"), F.lit(topic_id)).otherwise(F.col("topic_id"))).drop("_m")
        return (self if dry_run else replace(self, documents=docs)), ids

    # ---- tags, topics, ratings

    def add_tags(self, document_id: int, names: list[str]) -> "Store":
        get_document(self.documents, document_id)
        rows = [(document_id, n) for n in sorted({n.strip().lower() for n in names if n.strip()})]
        new = self.documents.sparkSession.createDataFrame(rows, Store.SCHEMAS["tags"])
        return replace(self, tags=self.tags.select("document_id", "name").unionByName(new).distinct())

    def remove_tag(self, name: str, document_id: int | None = None) -> "Store":
        hit = F.col("name") == name.strip().lower()
        return replace(self, tags=self.tags.where(~(hit if document_id is None else hit & (F.col("document_id") == document_id))))

    def add_topics(self, new: DataFrame) -> "Store":
        """Topics by name: one that is there stays as it is; ids are the names' slugs."""
        from quillspark.functions.text import slug

        rows = new.select(js_trim(F.col("name")).alias("name"), "description", "parent_id").where("name <> ''").dropDuplicates(["name"]).join(self.topics.select("name"), "name", "left_anti")
        return replace(self, topics=self.topics.unionByName(rows.select(slug(F.col("name")).alias("id"), "name", "description", "parent_id")))

    def rename_topic(self, topic_id: str, name: str) -> "Store":
        lookup(self.topics, topic_id)
        return replace(self, topics=self.topics.withColumn("name", F.when(F.col("id") == topic_id, F.lit(name)).otherwise(F.col("name"))))

    def delete_topic(self, topic_id: str) -> "Store":
        """Without a topic; its documents have none, its children become roots."""
        lookup(self.topics, topic_id)
        clear = lambda c: F.when(F.col(c) == topic_id, F.lit(None)).otherwise(F.col(c))
        return replace(self, topics=self.topics.where(F.col("id") != topic_id).withColumn("parent_id", clear("parent_id")), documents=self.documents.withColumn("topic_id", clear("topic_id")))

    def rate(self, new: DataFrame) -> tuple["Store", DataFrame]:
        """Take in ratings; those of a bad value, an unknown document or a chunk of another one come back with the reason."""
        owner = self.chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("owner"))
        known = self.documents.select(F.col("id").alias("document_id"), F.lit(True).alias("known")).distinct()
        judged = new.join(known, "document_id", "left").join(owner, "chunk_id", "left")
        reason = F.when(F.col("rating").isNull() | ~F.col("rating").between(1, 5), "rating must be a whole number from 1 to 5").when(F.col("known").isNull(), "document not found").when(F.col("chunk_id").isNotNull() & ~F.col("owner").eqNullSafe(F.col("document_id")), "chunk is not of the document")
        judged = judged.withColumn("reason", reason)
        return replace(self, ratings=self.ratings.unionByName(judged.where("reason is null").select(*Store._names("ratings")))), judged.where("reason is not null").select("id", "document_id", "reason")

    def reindex(self, embedder: Embedder, ids: list[int] | None = None, since: str | None = None, before: str | None = None) -> tuple["Store", DataFrame]:
        """New vectors of chunks, of some documents or all; also ``(id, ok)``. Chunks that cannot be embedded keep theirs."""
        some = self.documents if ids is None else self.documents.where(F.col("id").isin(ids))
        some = some if since is None else some.where(F.col("updated_at") >= F.to_timestamp(F.lit(since)))
        some = some if before is None else some.where(F.col("updated_at") < F.to_timestamp(F.lit(before)))
        chosen = self.chunks.join(some.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        made = embed(embedding_text(chosen, self.documents, use_prefix=False), embedder, "id", "text")
        good = made.where("embedding is not null").join(chosen.select("id", "document_id"), "id").select(F.col("id").alias("chunk_id"), "document_id", "embedding")
        rest = self.embeddings.join(good.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "document_id", "embedding")
        return replace(self, embeddings=rest.unionByName(good)), made.select("id", F.col("embedding").isNotNull().alias("ok"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """Rows by key: new ones join; for known keys new values count where they are not null, or, without ``update``, the old row stays."""
    if not update:
        return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))
    a, b = old.alias("o"), new.dropDuplicates(keys).alias("n")
    joined = a.join(b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])
