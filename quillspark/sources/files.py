"""Documents from files: the parser goes by the extension, and every text becomes markdown."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.packs import glob_regex
from quillspark.sources import converters as C


def csv_to_markdown(text: str) -> str:
    """A table with the first row as its head; rows are padded or cut to its width."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return ""
    width = len(rows[0])
    cell = lambda c: c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(cell(c) for c in (row + [""] * width)[:width]) + " |" for row in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _text(of: Callable[[str], str]) -> Callable[[bytes], str]:
    return lambda data: of(data.decode("utf-8-sig"))


html_to_markdown = C.html_to_markdown
PARSERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("md", "markdown", "mdx", "txt"), _text(str)),
    "json": _text(C.json_to_markdown), "yaml": _text(C.yaml_to_markdown), "yml": _text(C.yaml_to_markdown), "csv": _text(csv_to_markdown),
    "html": _text(html_to_markdown), "htm": _text(html_to_markdown), "pdf": C.pdf_text, "docx": C.docx_text, "epub": C.epub_text, "pptx": C.pptx_text, "ppt": lambda data: "",
}


def extension_of(name: str) -> str:
    found = re.search(r"\.([^./\\]+)$", name)
    return found[1].lower() if found else ""


def supported_extensions() -> list[str]:
    return sorted(PARSERS)


def parser_for(name: str) -> Callable[[bytes], str]:
    """The parser of a file by its name's extension; an unknown one is an error that names it."""
    try:
        return PARSERS[extension_of(name)]
    except KeyError:
        raise C.ParseError(f"no parser for .{extension_of(name)}") from None


def register_parser(extensions: list[str], parse: Callable[[bytes], str]) -> None:
    """Use a parser, which the executors must be able to load, for files of these extensions."""
    for e in extensions:
        PARSERS[e.lstrip(".").lower()] = parse


def parser_column(path):
    """Column: the kind of parser a path goes to, or null."""
    kind = {"md": "markdown", "markdown": "markdown", "mdx": "markdown", "txt": "text", "yml": "yaml", "htm": "html", "ppt": "pptx"}
    known = F.create_map(*[F.lit(x) for e in PARSERS for x in (e, kind.get(e, e))])
    return known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def read_documents(spark: SparkSession, path: str, pattern: str = "*", exclude: tuple[str, ...] = (), parsers: dict | None = None) -> DataFrame:
    """``(path, modified, extension, content, error)`` of all files below a folder but those that a glob of ``exclude`` matches.

    Globs are matched with the path below the folder. Files of an unknown kind and files that cannot be parsed have a
    null content and an error that says why.
    """
    known = dict(PARSERS) if parsers is None else parsers

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, when, ext, data in zip(frame.path, frame.modified, frame.extension, frame.data):
                try:
                    if ext not in known:
                        raise C.ParseError(f"no parser for .{ext}")
                    rows.append((name, when, ext, known[ext](bytes(data)), None))
                except Exception as problem:  # whatever a broken file makes its parser do
                    rows.append((name, when, ext, None, str(problem)[:200]))
            yield pd.DataFrame(rows, columns=["path", "modified", "extension", "content", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = re.sub(r"^file:/+", "/", path).rstrip("/")
    below = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root) + 2})")
    for glob in exclude:
        files = files.where(~below.rlike(glob_regex(glob)) & ~below.rlike(glob_regex(glob.rstrip("/") + "/**")))
    named = files.select("path", F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([^.\/]+)$", 1)).alias("extension"), F.col("content").alias("data"))
    return named.mapInPandas(parse, "path string, modified timestamp, extension string, content string, error string")


def index_files(store, spark: SparkSession, path: str, at: str, **options):
    """Index all files below a path: the store, the outcome of each document, and the files left out with the reason."""
    from quillspark.operators.packs import pack_from_files

    docs, left_out = pack_from_files(read_documents(spark, path))
    store, found = store.index(docs.withColumn("url", F.col("source")), at, **options)
    return store, found, left_out


def normalise(spark: SparkSession, items: list[dict], fetch: Callable[[str], str] | None = None) -> DataFrame:
    """``(title, content, url, error)`` of raw inputs: each a dict with ``text``, ``path``, ``data`` and ``name``, or ``url``."""
    from pathlib import Path

    from quillspark.operators.chunking import derive_title

    rows = []
    for item in items:
        try:
            if "text" in item:
                text, url = item["text"], item.get("url")
            elif "path" in item:
                text, url = parser_for(item["path"])(Path(item["path"]).read_bytes()), item["path"]
            elif "data" in item:
                text, url = parser_for(item["name"])(item["data"]), item.get("url")
            elif "url" in item and fetch:
                text, url = html_to_markdown(fetch(item["url"])), item["url"]
            else:
                raise C.ParseError("an input has text, a path, data with a name, or an address")
            title = item.get("title") or Path(item.get("path") or item.get("name") or "").stem or derive_title(text, url)
            rows.append((title, text, url, None))
        except Exception as problem:
            rows.append((item.get("title"), None, item.get("url") or item.get("path"), str(problem)[:200]))
    return spark.createDataFrame(rows, "title string, content string, url string, error string")
