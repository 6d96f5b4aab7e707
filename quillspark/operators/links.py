"""Links of documents: extraction from markup, resolution to documents, and chains of prerequisites."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ANCHOR = re.compile(r"<a(?=[\s>/])([^>]*)>", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Extensions of files that are no pages.
ASSETS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "pdf", "zip", "gz", "tar", "mp4", "mp3", "webp", "xml", "json")


def _absolute(href: str, base: str) -> str | None:
    try:
        url = urldefrag(urljoin(base, href)).url
        parts = urlsplit(url)
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
        return None
    path = parts.path.rstrip("/") if parts.path not in ("", "/") else "/"
    return parts._replace(scheme=parts.scheme.lower(), netloc=parts.netloc.lower(), path=path or "/").geturl()


def html_links(html: str | None, base: str) -> list[str]:
    """Absolute addresses of a page's anchors, without fragments and trailing slashes, each once, in order."""
    out: dict[str, None] = {}
    for tag in _ANCHOR.finditer(html or ""):
        m = _HREF.search(" " + tag[1])
        href = next((g for g in m.groups() if g is not None), "").strip() if m else ""
        if href and not href.startswith("#") and (url := _absolute(href, base)):
            out[url] = None
    return list(out)


def markdown_links(text: str | None) -> list[tuple[str, str]]:
    """Text and target of each ``[text](target)``, in order."""
    return [(m[1], m[2].strip()) for m in re.finditer(r"\[([^\[\]]+)\]\(([^()\s]+(?:\([^()\s]*\)[^()\s]*)*)[^()]*\)", text or "") if m[2].strip()]


def wiki_links(text: str | None) -> list[str]:
    """Targets of ``[[target]]`` and ``[[target|alias]]``, each once, in order."""
    return list(dict.fromkeys(t for m in re.finditer(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]", text or "") if (t := m[1].strip())))


def page_links(html: str | None, base: str, prefix: str = "") -> list[str]:
    """Links of a documentation page to pages of its site: same origin, below a path, no assets."""
    origin = urlsplit(base)[:2]
    return [u for u in html_links(html, base) if urlsplit(u)[:2] == origin and urlsplit(u).path.startswith(prefix) and urlsplit(u).path.rsplit(".", 1)[-1].lower() not in ASSETS]


def sitemap_links(xml: str | None) -> list[str]:
    return list(dict.fromkeys(m[1].strip() for m in re.finditer(r"<loc>\s*([^<]+?)\s*</loc>", xml or "")))


def extracted(df: DataFrame, id_col: str, text_col: str, of: Callable[[str], list], base_col: str | None = None) -> DataFrame:
    """``(document_id, position, target)`` of what ``of`` finds in each text; pairs count with their second part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text, base in zip(frame.document_id, frame.t, frame.b):
                found = of(text, base) if base_col else of(text)
                rows += [(i, n, x[1] if isinstance(x, tuple) else x) for n, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["document_id", "position", "target"])

    kind = df.schema[id_col].dataType.simpleString()
    base = F.col(base_col) if base_col else F.lit(None).cast("string")
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("document_id"), F.col(text_col).alias("t"), base.alias("b"))
    return rows.mapInPandas(run, f"document_id {kind}, position int, target string")


def resolve_references(refs: DataFrame, docs: DataFrame, by_url: bool = True) -> DataFrame:
    """``(source_id, target_id)``, each once: references ``(document_id, target)`` as documents.

    A target is an address first and else a title in any case; of several documents the smallest id counts. References to
    the document itself and such that nothing answers give no row.
    """
    urls = docs.where("url is not null").groupBy(F.col("url").alias("target")).agg(F.min("id").alias("u"))
    titles = docs.where("title is not null").groupBy(F.lower("title").alias("low")).agg(F.min("id").alias("t"))
    found = refs.withColumn("low", F.lower("target")).join(titles, "low", "left")
    found = found.join(urls, "target", "left") if by_url else found.withColumn("u", F.lit(None).cast("bigint"))
    return found.select(F.col("document_id").alias("source_id"), F.coalesce("u", "t").alias("target_id")).where("target_id is not null and target_id <> source_id").distinct()


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links ``(source_id, target_id, link_type)`` with new ones; each triple once, none to itself."""
    return links.select("source_id", "target_id", "link_type").unionByName(new.select("source_id", "target_id", "link_type").where("source_id <> target_id")).distinct()


def delete_links(links: DataFrame, keys: DataFrame) -> DataFrame:
    return links.join(keys.select("source_id", "target_id", "link_type"), ["source_id", "target_id", "link_type"], "left_anti")


def link_titles(links: DataFrame, docs: DataFrame, link_type: str | None = None) -> DataFrame:
    """``(document_id, direction, other_id, title, link_type)``: every document's links out and in with the other one's title."""
    some = links if link_type is None else links.where(F.col("link_type") == link_type)
    out = some.select(F.col("source_id").alias("document_id"), F.lit("out").alias("direction"), F.col("target_id").alias("other_id"), "link_type")
    both = out.unionByName(some.select(F.col("target_id").alias("document_id"), F.lit("in").alias("direction"), F.col("source_id").alias("other_id"), "link_type"))
    return both.join(docs.select(F.col("id").alias("other_id"), "title"), "other_id").select("document_id", "direction", "other_id", "title", "link_type")


def prerequisite_chains(links: DataFrame, link_type: str = "prerequisite", most: int = 100) -> DataFrame:
    """``(document_id, step, prerequisite_id)``: what each document needs first, step by step.

    Each step follows the link to the smallest target; a chain stops where it would come back to a document it has.
    """
    nxt = links.where(F.col("link_type") == link_type).groupBy(F.col("source_id").alias("at")).agg(F.min("target_id").alias("next")).where("at <> next")
    front = nxt.select(F.col("at").alias("document_id"), F.col("next").alias("at"), F.array("at", "next").alias("path"))
    from quillspark.session import materialize

    out = front.select("document_id", F.lit(1).alias("step"), F.col("at").alias("prerequisite_id"))
    for step in range(2, most + 1):
        grown = front.join(nxt, "at").where(~F.array_contains("path", F.col("next"))).select("document_id", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        front = materialize(grown, "chain")
        if not front.limit(1).count():
            break
        out = out.unionByName(front.select("document_id", F.lit(step).alias("step"), F.col("at").alias("prerequisite_id")))
    return out
