"""Connectors over exported data: chat, notes, wiki pages, notebooks and vaults as documents, with what a sync adds, changes and deletes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import epoch_time, mrkdwn_to_markdown, truncated
from quillspark.operators.links import resolve_references
from quillspark.sources import converters as C

_MENTION = r"<@(U[A-Z0-9]+)>"


@F.pandas_udf(StringType())
def _plain_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(mrkdwn_to_markdown, na_action="ignore")


# ---- chat


def read_chat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Channels ``(channel_id, channel_name)`` and messages of exported answers of a chat service, one JSON object a file or line.

    Answers that are not ok count for nothing; pages of one channel simply add up.
    """
    schema = "ok boolean, channel string, channels array<struct<id:string,name:string>>, messages array<struct<ts:string,user:string,text:string,thread_ts:string,reply_count:int,subtype:string>>"
    pages = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).where("ok")
    channels = pages.select(F.explode("channels").alias("c")).select(F.col("c.id").alias("channel_id"), F.col("c.name").alias("channel_name")).distinct()
    messages = pages.select("channel", F.explode("messages").alias("m")).select(F.col("channel").alias("channel_id"), "m.ts", F.col("m.user").alias("user_id"), "m.text", "m.thread_ts", "m.reply_count", "m.subtype").distinct()
    return channels, messages


def filter_channels(channels: DataFrame, include: list[str] = ("all",), exclude: list[str] = ()) -> DataFrame:
    """Channels named by id or by name in any case; the one word ``all`` takes all; exclusions win."""
    named = lambda some: F.lower("channel_name").isin([c.lower() for c in some]) | F.col("channel_id").isin(list(some))
    out = channels if list(include) == ["all"] else channels.where(F.coalesce(named(include), F.lit(False)))
    return out.where(~F.coalesce(named(exclude), F.lit(False))) if exclude else out


def classify_messages(messages: DataFrame) -> DataFrame:
    """Messages with ``kind``: parent of a thread, standalone, or other (replies and notices)."""
    plain, replies = F.col("subtype").isNull(), F.coalesce("reply_count", F.lit(0))
    return messages.withColumn("kind", F.when(plain & (replies > 0), "parent").when(plain & (replies == 0) & F.col("thread_ts").isNull(), "standalone").otherwise("other"))


def display_names(users: DataFrame) -> DataFrame:
    """``(user_id, name)``: the display name, else the real name, else the name, else the id; blank ones count as none."""
    some = lambda c: F.when(F.length(F.trim(F.col(c))) > 0, F.col(c))
    return users.select("user_id", F.coalesce(some("display_name"), some("real_name"), some("name"), F.col("user_id")).alias("name")).dropDuplicates(["user_id"])


def resolve_users(messages: DataFrame, users: DataFrame, key: str = "message_id") -> DataFrame:
    """Messages with ``author`` and with mentions in ``text`` replaced by names; users that are not known keep their id, no user is ``unknown``."""
    names = display_names(users)
    mentioned = messages.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_MENTION), F.lit(1)))).alias("user_id"))
    found = mentioned.join(names, "user_id", "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("user_id", F.coalesce("name", "user_id").alias("name")))).alias("names"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            texts = [re.sub(_MENTION, lambda m, n=dict(n): "@" + n.get(m[1], m[1]), t) if n else t for t, n in zip(frame["text"], frame["names"])]
            yield frame[[key]].assign(resolved=texts)

    kind = messages.schema[key].dataType.simpleString()
    texts = messages.select(key, "text").join(found, key).mapInPandas(put, f"{key} {kind}, resolved string")
    author = names.toDF("user_id", "author")
    return messages.join(author, "user_id", "left").join(texts, key, "left").withColumn("author", F.coalesce("author", "user_id", F.lit("unknown"))).withColumn("text", F.coalesce("resolved", "text")).drop("resolved")


def chat_documents(messages: DataFrame, users: DataFrame, threads: str = "aggregate") -> DataFrame:
    """``(title, content, url)`` of messages ``(message_id, channel_name, ts, user_id, text, thread_ts, reply_count, subtype)``.

    Standalone messages are a document each. A thread is one document of its messages in order, or with ``separate`` each
    message of it that has a text is one. Notices and threads whose parent is missing give none.
    """
    if threads not in ("aggregate", "separate"):
        raise ValueError(f"unknown mode {threads}")
    rows = classify_messages(resolve_users(messages, users)).withColumn("time", F.date_format(epoch_time(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    rows = rows.withColumn("line", F.concat(F.lit("**"), "author", F.lit("** ("), "time", F.lit("):\n"), F.coalesce(_plain_markdown("text"), F.lit("")))).withColumn("short", truncated(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))))
    base = F.concat(F.lit("slack://"), "channel_name")
    alone = rows.where("kind = 'standalone' and text is not null and text <> ''").select(F.concat(F.lit("#"), "channel_name", F.lit(" — "), "author", F.lit(": "), "short").alias("title"), F.col("line").alias("content"), F.concat(base, F.lit("/"), "ts").alias("url"))
    parents = rows.where("kind = 'parent'").select("channel_name", F.col("ts").alias("thread"), F.col("short").alias("parent_short"))
    inside = rows.where("subtype is null").withColumn("thread", F.coalesce("thread_ts", "ts")).join(parents, ["channel_name", "thread"])
    if threads == "separate":
        made = inside.where("text is not null and text <> ''").select(F.concat(F.lit("#"), "channel_name", F.lit(" thread reply — "), "author", F.lit(": "), "short").alias("title"), F.col("line").alias("content"), F.concat(base, F.lit("/thread/"), "thread", F.lit("/"), "ts").alias("url"))
    else:
        packed = inside.groupBy("channel_name", "thread").agg(F.min("parent_short").alias("short"), F.array_sort(F.collect_list(F.struct("ts", "message_id", "line"))).alias("lines"))
        text = F.concat(F.lit("# Thread in #"), "channel_name", F.lit("\n\n"), F.concat_ws("\n\n---\n\n", F.transform("lines", lambda x: x["line"])))
        made = packed.select(F.concat(F.lit("#"), "channel_name", F.lit(" thread: "), "short").alias("title"), text.alias("content"), F.concat(base, F.lit("/thread/"), "thread").alias("url"))
    return alone.unionByName(made)


# ---- notes, wiki pages, notebooks


def notes_documents(objects: DataFrame, since: str | None = None) -> DataFrame:
    """``(id, title, content, url, tags)`` of exported pages and database rows ``(id, json, edited_at)``; those not edited after ``since`` are left out.

    The JSON holds ``title`` or ``properties``, ``blocks`` and, for a row, ``database``: its title is then ``database — row``
    and its properties are a line before the text. Values of select properties are tags.
    """
    rows = objects if since is None else objects.where(F.col("edited_at") > F.to_timestamp(F.lit(since)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame.id, frame.json):
                x = json.loads(text)
                title, body = C.object_title(x), C.blocks_to_markdown(x.get("blocks") or [])
                values = C.property_values(x.get("properties") or {})
                if x.get("database"):
                    title = f"{x['database']} — {title}"
                    body = "Metadata: " + ", ".join(f"{n}: {v}" for n, v in values) + ("\n\n" + body if body else "") if values else body
                tags = [v.strip() for n, v in values if (x["properties"][n].get("type") in ("select", "multi_select")) for v in v.split(",") if v.strip()]
                out.append((i, title, body, f"notion://{'row' if x.get('database') else 'page'}/{i}", tags))
            yield pd.DataFrame(out, columns=["id", "title", "content", "url", "tags"])

    return rows.where("json is not null").select("id", "json").mapInPandas(run, "id string, title string, content string, url string, tags array<string>")


def wiki_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``(url, title, content, tags, outcome)`` of wiki pages ``(id, space, title, storage, version, labels, metadata_labels)``.

    ``known`` has ``(url, name)``, the tags of documents there; a page whose version tag is there is ``skipped``, one with
    another ``updated``, a new one ``indexed``. Labels come from either of the two places they may be in.
    """
    url = F.concat(F.lit("confluence://"), "space", F.lit("/"), "id")
    version = F.concat(F.lit("confluence-version:"), "version")
    rows = pages.withColumn("url", url).withColumn("tag", version)
    state = known.where(F.startswith("name", F.lit("confluence-version:"))).groupBy("url").agg(F.collect_set("name").alias("tags_there"))

    @F.pandas_udf(StringType())
    def convert(storage: pd.Series) -> pd.Series:
        return storage.map(C.storage_to_markdown, na_action="ignore")

    outcome = F.when(F.array_contains("tags_there", F.col("tag")), "skipped").when(F.col("tags_there").isNotNull(), "updated").otherwise("indexed")
    labels = F.coalesce("labels", "metadata_labels", F.array().cast("array<string>"))
    return rows.join(state, "url", "left").select("url", "title", convert("storage").alias("content"), F.array_distinct(F.concat(labels, F.array("tag", F.concat(F.lit("confluence-space:"), "space")))).alias("tags"), outcome.alias("outcome"))


def wiki_counts(pages: DataFrame) -> DataFrame:
    """``(indexed, updated, skipped)``: an updated page counts as indexed too."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return pages.agg(n("indexed", "updated").alias("indexed"), n("updated").alias("updated"), n("skipped").alias("skipped"))


def notebook_pages(pages: DataFrame, known: DataFrame, last_sync: str | None) -> tuple[DataFrame, DataFrame]:
    """New and changed pages ``(url, title, content)`` of ``(notebook, section, id, title, html, modified)``, and the ``url`` of known pages that are gone.

    Pages not modified after ``last_sync`` are left out; without it all count.
    """
    url = F.concat_ws("/", F.lit("onenote:/"), "notebook", "section", "id")

    @F.pandas_udf(StringType())
    def convert(html: pd.Series) -> pd.Series:
        return html.map(C.notebook_to_markdown, na_action="ignore")

    rows = pages.withColumn("url", url)
    fresh = rows if last_sync is None else rows.where(F.col("modified") > F.to_timestamp(F.lit(last_sync)))
    gone = known.where(F.startswith("url", F.lit("onenote://"))).select("url").distinct().join(rows.select("url"), "url", "left_anti")
    return fresh.select("url", "title", convert("html").alias("content")), gone


# ---- vaults


def read_vault(spark: SparkSession, folder: str, exclude: list[str] = (), topic_by: str = "folder") -> DataFrame:
    """``(path, modified, title, content, raw_hash, tags, links, topic)`` of the notes of a vault."""
    root = str(Path(folder).resolve())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root) + 2})").alias("path"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("raw_hash"))
    names = {p.stem.lower() for p in Path(root).rglob("*.md")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, when, text, mark in zip(frame.path, frame.modified, frame.text, frame.raw_hash):
                if C.vault_listed(path, exclude):
                    n = C.note(text, names)
                    title = n["head"].get("title")
                    out.append((path, when, title if isinstance(title, str) and title else path.rsplit("/", 1)[-1].removesuffix(".md"), n["body"], mark, n["tags"], n["links"], C.note_topic(path, n["head"], topic_by)))
            yield pd.DataFrame(out, columns=["path", "modified", "title", "content", "raw_hash", "tags", "links", "topic"])

    return rows.mapInPandas(run, "path string, modified timestamp, title string, content string, raw_hash string, tags array<string>, links array<string>, topic string")


def vault_changes(notes: DataFrame, tracked: DataFrame) -> DataFrame:
    """``(path, change)`` of notes against the tracked state ``(path, modified, raw_hash)``: added, updated, same or deleted.

    A note that was not modified later is the same without a look at its text.
    """
    joined = notes.select("path", "modified", "raw_hash", F.lit(True).alias("here")).alias("n").join(tracked.alias("t"), "path", "full")
    same = (F.col("n.modified") <= F.col("t.modified")) | (F.col("n.raw_hash") == F.col("t.raw_hash"))
    return joined.select("path", F.when(F.col("here").isNull(), "deleted").when(F.col("t.modified").isNull(), "added").when(same, "same").otherwise("updated").alias("change"))


def vault_links(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(source_id, target_id)`` of notes: their links as titles of documents, none to themselves."""
    mine = notes.join(docs.select("id", F.col("title").alias("t")), F.col("t") == F.col("title")).select(F.col("id").alias("document_id"), F.explode("links").alias("target"))
    return resolve_references(mine, docs, by_url=False)


# ---- schedules and states


def read_schedules(folder: str) -> list[dict]:
    """Schedule entries of connector files: those with a schedule; the type is the file's name where it says none."""
    out = []
    for file in sorted(Path(folder).glob("*.json")):
        try:
            config = json.loads(file.read_text())
        except json.JSONDecodeError:
            continue
        if isinstance(config, dict) and config.get("schedule"):
            out.append({"type": config.get("type") or file.stem, "name": config.get("name") or file.stem, "schedule": config["schedule"], "config": config})
    return out


def track(syncs: DataFrame, connector_type: str, name: str, at: str, status: str = "running", **counters: int) -> DataFrame:
    """The runs ``(id, connector_type, connector_name, status, started_at, completed_at, added, updated, deleted, errored, error)`` with a start, or with the end of the last run of that name."""
    spark = syncs.sparkSession
    hit = (F.col("connector_type") == connector_type) & (F.col("connector_name") == name)
    if status == "running":
        number = (syncs.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
        row = spark.createDataFrame([(number, connector_type, name, status, at)], "id bigint, connector_type string, connector_name string, status string, started string")
        blank = [F.lit(None if f.name in ("completed_at", "error") else 0).cast(f.dataType).alias(f.name) for f in syncs.schema.fields if f.name not in ("id", "connector_type", "connector_name", "status", "started_at")]
        return syncs.unionByName(row.select("id", "connector_type", "connector_name", "status", F.to_timestamp("started").alias("started_at"), *blank))
    last = syncs.where(hit & (F.col("status") == "running")).agg(F.max("id").alias("m")).first()["m"]
    done = {"status": F.lit(status), "completed_at": F.to_timestamp(F.lit(at))} | {c: F.lit(v) for c, v in counters.items()}
    return syncs.select(*[F.when(F.col("id") == F.lit(last), done[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in done else F.col(f.name) for f in syncs.schema.fields])
