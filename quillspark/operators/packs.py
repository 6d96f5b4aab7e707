"""Packs of documents, the registry they come from, and export and import of a whole store."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import json
import os
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import bump_patch, is_semver, semver_key
from quillspark.operators.documents import Store, ValidationError, upsert


def validate_pack(pack: dict) -> dict:
    """A pack whose fields are all there and of the right kind; anything else is an error that names the field."""
    for field, kind in (("name", str), ("version", str), ("description", str), ("documents", list), ("metadata", dict)):
        if not isinstance(pack.get(field), kind):
            raise ValidationError(f"pack field {field} is missing or no {kind.__name__}")
    if not pack["name"].strip():
        raise ValidationError("pack field name is blank")
    for n, doc in enumerate(pack["documents"]):
        if not isinstance(doc, dict) or not all(isinstance(doc.get(f), str) and doc[f].strip() for f in ("title", "content")):
            raise ValidationError(f"document {n} of the pack needs a title and a content")
    return pack


def read_pack(path: str) -> dict:
    """A pack from a file, packed or not: its first two bytes tell."""
    data = Path(path).read_bytes()
    try:
        return validate_pack(json.loads(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
    except (json.JSONDecodeError, UnicodeDecodeError, OSError) as problem:
        raise ValidationError(f"{path} is no pack: {problem}") from problem


def write_pack(pack: dict, path: str) -> str:
    """Write a pack, packed if the name ends in .gz; the checksum of the file."""
    data = json.dumps(validate_pack(pack), ensure_ascii=False, sort_keys=True).encode()
    data = gzip.compress(data, mtime=0) if path.endswith(".gz") else data
    Path(path).write_bytes(data)
    return hashlib.sha256(data).hexdigest()


def pack_json(docs: DataFrame, tags: DataFrame, topics: DataFrame, by: str = "library") -> DataFrame:
    """``(name, doc_count, documents)``: a pack for each value of ``by``, its documents as JSON in the order of their ids.

    The JSON grows with the largest pack; ``docs`` should hold what is to be one file.
    """
    named = tags.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    rows = docs.where(F.col(by).isNotNull()).join(topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic")), "topic_id", "left").join(named, "id", "left")
    doc = F.struct("id", F.struct("title", "content", F.coalesce("url", F.lit("")).alias("source"), F.array_compact(F.array("topic")).alias("topics"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).alias("doc"))
    return rows.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("doc_count"), F.to_json(F.transform(F.array_sort(F.collect_list(doc)), lambda d: d["doc"])).alias("documents"))


def create_pack(docs: DataFrame, tags: DataFrame, topics: DataFrame, name: str, version: str, description: str, author: str, at: str) -> dict:
    """The documents of library ``name`` as a pack."""
    row = pack_json(docs.where(F.col("library") == name), tags, topics).first()
    documents = json.loads(row["documents"]) if row else []
    return validate_pack({"name": name, "version": version, "description": description, "documents": documents, "metadata": {"author": author, "license": "", "createdAt": at}})


def install_batches(docs: DataFrame, size: int = 10, resume_from: int = 0) -> DataFrame:
    """``(batch, id)`` of documents in the order of their ids, from the place ``resume_from`` on.

    Places come from counts of ranges of ids, so that no task sees all rows.
    """
    ids = docs.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    from quillspark.session import materialize

    ids = materialize(ids, "ranges")
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")  # one row for each range
    nth = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    placed = ids.withColumn("nth", nth).join(before, "part").withColumn("place", F.col("base") + F.col("nth") - 1)
    return placed.where(F.col("place") >= resume_from).select(F.floor(F.col("place") / size).cast("int").alias("batch"), "id")


def install_pack(store: Store, installed: DataFrame, pack: dict, at: str, resume_from: int = 0, size: int = 10, on_progress: Callable[[int, int], None] = lambda done, total: None, **options) -> tuple[Store, DataFrame, list[str]]:
    """Install a pack's documents in batches: the store, the packs ``(name, version, doc_count, installed_at)`` and the errors of batches.

    A pack that is there already changes nothing. Documents come as type ``library`` with the pack's name; a batch that
    fails is left out and named, the others stand. Topics and tags of the pack are not taken over.
    """
    spark = store.documents.sparkSession
    if installed.where(F.col("name") == pack["name"]).limit(1).count():
        return store, installed, []
    errors, done, count = [], 0, 0
    rows = pack["documents"][resume_from:]
    for start in range(0, len(rows), size * 100):  # what one plan takes in
        some = rows[start : start + size * 100]
        try:
            new = spark.createDataFrame([(d["title"], d["content"], d.get("source") or None, "library", pack["name"], pack["version"]) for d in some], "title string, content string, url string, source_type string, library string, version string")
            store, found = store.index(new, at, **options)
            count += found.where(F.col("status").isin("indexed", "changed")).count()
        except Exception as problem:  # the batch is named, the others go on
            errors.append(f"documents {resume_from + start} to {resume_from + start + len(some) - 1}: {problem}")
        done += len(some)
        on_progress(done, len(rows))
    row = spark.createDataFrame([(pack["name"], pack["version"], count)], "name string, version string, doc_count bigint").withColumn("installed_at", F.to_timestamp(F.lit(at)))
    return store, installed.unionByName(row), errors


def remove_pack(store: Store, installed: DataFrame, name: str) -> tuple[Store, DataFrame]:
    if not installed.where(F.col("name") == name).limit(1).count():
        raise LookupError(f"Pack not installed: {name}")
    return store.delete_where((F.col("source_type") == "library") & (F.col("library") == name))[0], installed.where(F.col("name") != name)


def list_installed(installed: DataFrame) -> DataFrame:
    return installed.orderBy("name")


def glob_regex(pattern: str, across: bool = False) -> str:
    """A glob as a regular expression: * stays within a path part unless ``across``, ** never does, ? is one character."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**", at):
            at += 2
            at += at < len(pattern) and pattern[at] == "/"
            out += ".*"
        elif pattern[at] == "*":
            out, at = out + (".*" if across else "[^/]*"), at + 1
        elif pattern[at] == "?" and not across:
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.escape(pattern[at]), at + 1
    return ("(?i)" if across else "") + f"^{out}$"


def walk(folder: str, extensions: tuple[str, ...] | None = None, include: list[str] = (), exclude: list[str] = (), hidden: bool = False) -> list[str]:
    """Paths of the files below a folder, relative to it, in order: by extension and globs; an excluded folder is not entered."""
    matches = lambda path, globs: any(re.match(glob_regex(g), path) or fnmatch.fnmatch(path.rsplit("/", 1)[-1], g) for g in globs)
    out = []
    for at, folders, files in os.walk(folder):
        here = os.path.relpath(at, folder).replace(os.sep, "/")
        prefix = "" if here == "." else f"{here}/"
        folders[:] = [d for d in folders if (hidden or not d.startswith(".")) and not matches(prefix + d, exclude) and not matches(f"{prefix}{d}/", exclude)]
        for name in files:
            path = prefix + name
            if (hidden or not name.startswith(".")) and (not extensions or name.rsplit(".", 1)[-1].lower() in extensions) and (not include or matches(path, include)) and not matches(path, exclude):
                out.append(path)
    return sorted(out)


def pack_from_files(docs: DataFrame, suggested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pack documents ``(title, content, source)`` of parsed files ``(path, content, error)``, and ``(path, reason)`` of those left out.

    Titles are file names without extension, trailing blanks go, empty files are left out.
    """
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]+$", "")
    text = F.regexp_replace("content", r"(?U)\s+$", "")
    reason = F.when(F.col("content").isNull(), F.coalesce("error", F.lit("unreadable"))).when(F.length(text) == 0, "empty")
    judged = docs.withColumn("reason", reason)
    return judged.where("reason is null").select(name.alias("title"), text.alias("content"), F.col("path").alias("source")), judged.where("reason is not null").select("path", "reason")


# ---- registry

INDEX = "name string, description string, tags array<string>, latestVersion string, author string, updatedAt string"


def registry_index(entries: DataFrame, column: str = "entry") -> DataFrame:
    """Well-formed entries of a registry's index from their JSON, one row for each: malformed ones and such without a required field are dropped."""
    parsed = entries.select(F.from_json(column, INDEX, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    needed = [F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > 0) for c in ("name", "latestVersion")]
    return parsed.where(needed[0] & needed[1] & F.col("description").isNotNull()).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def first_entries(entries: DataFrame, key: str = "name", order: str = "position") -> DataFrame:
    """Of entries with one name the first."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return entries.withColumn("_n", nth).where(F.col("_n") == 1).drop("_n")


def publish(index: DataFrame, versions: DataFrame, pack: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Index ``(name, latestVersion, ...)`` and versions ``(name, version, checksum, published_at)`` with packs ``(name, version, checksum, ...)`` published.

    A null version is the last one with its patch number raised, or 1.0.0; one that is no semantic version, or is there already, is refused.
    """
    last = versions.groupBy("name").agg(F.max_by("version", semver_key(F.col("version"))).alias("last"))
    rows = pack.join(last, "name", "left").withColumn("version", F.coalesce("version", bump_patch(F.col("last")), F.lit("1.0.0"))).drop("last")
    if rows.where(~is_semver(F.col("version"))).limit(1).count():
        raise ValidationError("a version must look like 1.2.3")
    if rows.join(versions, ["name", "version"], "left_semi").limit(1).count():
        raise ValidationError("the version is published already")
    all_versions = versions.unionByName(rows.select("name", "version", "checksum").withColumn("published_at", F.to_timestamp(F.lit(at))))
    entry = rows.select("name", F.col("version").alias("latestVersion"), *[c for c in rows.columns if c in index.columns and c not in ("name", "latestVersion")])
    return upsert(index, entry, ["name"]), all_versions


def unpublish(index: DataFrame, versions: DataFrame, name: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Without a version; the next lower one is the latest, and a pack without versions leaves the index."""
    rest = versions.where((F.col("name") != name) | (F.col("version") != version))
    last = rest.groupBy("name").agg(F.max_by("version", semver_key(F.col("version"))).alias("latestVersion"))
    return index.drop("latestVersion").join(last, "name").select(*index.columns), rest


def manifest(versions: DataFrame, name: str) -> DataFrame:
    """The versions of a pack, the newest first."""
    return versions.where(F.col("name") == name).orderBy(F.desc("published_at"), semver_key(F.col("version")).desc())


def resolve_packs(registries: DataFrame, wanted: DataFrame, choose: str | None = None) -> DataFrame:
    """``(name, version, registry)`` for each wanted pack ``(name, version)`` over all registries ``(registry, priority, name, version)``.

    A null version means the highest of a registry. Of several registries the one chosen by name counts, else the lowest priority.
    """
    offers = registries.join(wanted.toDF("name", "wanted"), "name").where("wanted is null or version = wanted")
    best = offers.groupBy("name", "registry", "priority").agg(F.max_by("version", semver_key(F.col("version"))).alias("version"))
    order = F.struct((F.col("registry") != F.lit(choose or "")).alias("other"), "priority", "registry")
    return best.groupBy("name").agg(F.min_by(F.struct("version", "registry"), order).alias("b")).select("name", "b.version", "b.registry")


def verify_checksums(packs: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(name, version, status)`` of resolved packs ``(name, version, data)``: unknown without a manifest entry, else missing, mismatch or ok."""
    rows = packs.join(manifests.select("name", "version", "checksum", F.lit(True).alias("known")), ["name", "version"], "left")
    status = F.when(F.col("known").isNull(), "skipped").when(F.coalesce(F.trim("checksum"), F.lit("")) == "", "missing checksum").when(F.sha2("data", 256) != F.col("checksum"), "mismatch").otherwise("ok")
    return rows.select("name", "version", status.alias("status"))


def valid_registry(name: str, url: str) -> bool:
    return bool(re.fullmatch(r"[a-z0-9][a-z0-9-]{0,63}", name)) and bool(re.match(r"(?:https://|git@|ssh://)[^\s]+$", url))


class RegistryConfig:
    """Registries in a JSON file: ``{name, url, interval_hours, priority, last_sync}``."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> list[dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else []

    def _save(self, rows: list[dict]) -> None:
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(rows, indent=1))
        new.replace(self.path)

    def add(self, name: str, url: str, interval_hours: float = 24, priority: int = 10) -> None:
        rows = self.all()
        if not valid_registry(name, url) or any(r["name"] == name for r in rows):
            raise ValidationError("a registry needs a name of its own in small letters and an address")
        self._save([*rows, {"name": name, "url": url, "interval_hours": interval_hours, "priority": priority, "last_sync": None}])

    def remove(self, name: str) -> None:
        rows = self.all()
        if all(r["name"] != name for r in rows):
            raise LookupError(f"Registry not found: {name}")
        self._save([r for r in rows if r["name"] != name])

    def synced(self, name: str, at: str) -> None:
        self._save([r | {"last_sync": at} if r["name"] == name else r for r in self.all()])

    def sync(self, fetch: Callable[[str], list], cache: dict, at: str) -> list[tuple[str, str]]:
        """``(name, status)``: success with new entries in ``cache``, offline where only the cache answers, error where nothing does."""
        out = []
        for r in self.all():
            try:
                cache[r["name"]] = fetch(r["url"])
                self.synced(r["name"], at)
                out.append((r["name"], "success"))
            except Exception:
                out.append((r["name"], "offline" if r["name"] in cache else "error"))
        return out


def stale(df: DataFrame, as_of: str, last: str = "last_sync", hours: str = "interval_hours") -> DataFrame:
    """Rows with ``is_stale``: never synced, or longer ago than the interval; an interval of 0 means never again."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(last)) / 3600
    return df.withColumn("is_stale", F.when(F.col(last).isNull(), True).when(F.col(hours) == 0, False).otherwise(age > F.col(hours)))


# ---- export and import

SECRET = ("secret", "token", "api_key", "password")


def redacted(df: DataFrame) -> DataFrame:
    """Without the values of columns that hold secrets."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.lit("[redacted]")).alias(c) if c in SECRET else F.col(c) for c in df.columns])


def export_rows(store: Store, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(table, row)``: every row of the store as JSON, secrets redacted; written as text it is the backup."""
    tables = {n: getattr(store, n) for n in Store.SCHEMAS} | (extra or {})
    parts = [redacted(df).select(F.lit(name).alias("table"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def export_store(store: Store, folder: str, extra: dict[str, DataFrame] | None = None) -> None:
    export_rows(store, extra).select(F.to_json(F.struct("table", "row")).alias("value")).write.text(folder)


def import_store(spark: SparkSession, folder: str, into: Store) -> tuple[Store, DataFrame]:
    """Rows of a backup put into a store by key, and the lines ``(value, reason)`` that are none."""
    lines = spark.read.text(folder).select("value", F.from_json("value", "table string, row string").alias("x"))
    names = list(Store.SCHEMAS)
    bad = lines.where(F.col("x.table").isNull() | F.col("x.row").isNull() | ~F.col("x.table").isin(names)).select("value", F.lit("no row of a known table").alias("reason"))
    keys = {"documents": ["id"], "chunks": ["id"], "embeddings": ["chunk_id"], "links": ["source_id", "target_id", "link_type"], "tags": ["document_id", "name"], "ratings": ["id"], "versions": ["document_id", "version"], "topics": ["id"]}
    out = {}
    for name, schema in Store.SCHEMAS.items():
        rows = lines.where(F.col("x.table") == name).select(F.from_json("x.row", schema).alias("r")).select("r.*")
        old = getattr(into, name).select(*Store._names(name))
        out[name] = rows.dropDuplicates(keys[name]).unionByName(old.join(rows.select(*keys[name]), keys[name], "left_anti").select(*old.columns))
    return Store(**out), bad
