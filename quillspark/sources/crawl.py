"""Pages of the web from a table of pages: what may be fetched, what a crawl visits, and what of a page is content."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.chunking import derive_title
from quillspark.operators.links import ASSETS, html_links, page_links, sitemap_links
from quillspark.operators.packs import glob_regex
from quillspark.session import materialize
from quillspark.sources.converters import Markup, html_to_markdown

MAX_PAGES, MAX_DEPTH = 200, 5


def is_private_address(address: str) -> bool:
    """Whether an IP address belongs to this machine, a private network or a link; text that is no address is not private."""
    try:
        ip = ipaddress.ip_address(address.strip().strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.version == 4:
        return any(ip in ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16"))
    return any(ip in ipaddress.ip_network(n) for n in ("::1/128", "fc00::/7", "fe80::/10"))


def may_fetch(url: str, resolve: Callable[[str], list[str]] | None = None, allow_private: bool = False) -> bool:
    """Whether an address may be fetched: http or https, and neither it nor any address its host resolves to is private."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not host:
        return False
    if allow_private:
        return True
    found = [host, *(resolve(host) if resolve else [])]
    return host != "localhost" and not host.endswith(".localhost") and not any(is_private_address(a) for a in found)


def disallowed_paths(robots: str, agent: str) -> list[str]:
    """Path prefixes a robots file forbids to an agent; rules that name it count alone, else those for all."""
    rules: dict[str, list[str]] = {}
    agents: list[str] = []
    in_rules = False
    for line in robots.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [value.lower()] if in_rules else [*agents, value.lower()]
            in_rules = False
            for a in agents:
                rules.setdefault(a, [])
        elif name == "disallow":
            in_rules = bool(value) or in_rules
            for a in agents if value else []:
                rules[a].append(value)
    return sorted(set(rules.get(agent.lower(), rules.get("*", []))))


def same_domain(host: str, seed: str) -> bool:
    return host.lower() == seed.lower() or host.lower().endswith("." + seed.lower())


def skip_reason(url, seed_host: str, domain: bool = True, prefix: str = "", exclude: list[str] = (), robots: list[str] = ()):
    """Column: why a crawl leaves an address out, the first reason in order, or null."""
    host, path = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    starts = lambda paths: [F.startswith(path, F.lit(p)) for p in paths]
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    reason = F.when(F.lit(domain) & ~((host == seed_host.lower()) | F.endswith(host, F.lit("." + seed_host.lower()))), "domain")
    reason = reason.when(F.lit(bool(prefix)) & ~F.startswith(path, F.lit(prefix)), "path")
    reason = reason.when(any_of([url.rlike(glob_regex(g, across=True)) for g in exclude]), "excluded")
    return reason.when(any_of(starts(robots)), "robots")


def crawl(pages: DataFrame, seed: str, max_pages: int = 25, max_depth: int = 2, domain: bool = True, prefix: str = "", exclude: list[str] = (), robots: str = "", agent: str = "quillspark", extra_seeds: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Visit pages breadth first from a seed over a table ``(url, html)``: ``(url, depth, title, content)`` and ``(url, reason)`` left out.

    Each round joins the frontier with the pages and explodes their links; at most 200 pages and depth 5. The seed is
    never left out; links count only up to ``max_depth``; of one depth pages go by their address. Addresses of no page are
    ``missing``.
    """
    most, deepest = max(1, min(MAX_PAGES, max_pages)), max(0, min(MAX_DEPTH, max_depth))
    spark, host = pages.sparkSession, urlsplit(seed).hostname or ""
    rules = disallowed_paths(robots, agent)
    clean = lambda u: u.split("#", 1)[0].rstrip("/") if urlsplit(u).path not in ("", "/") else u.split("#", 1)[0].rstrip("/") + "/"

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"link": [u for url, html in zip(frame.url, frame.html) for u in html_links(html, url)]}, dtype=object)

    first = spark.createDataFrame([(clean(u),) for u in dict.fromkeys([seed, *extra_seeds])], "url string")
    known = pages.select(F.when(F.col("url").rlike(r"^[a-z]+://[^/]+$"), F.concat("url", F.lit("/"))).otherwise(F.regexp_replace("url", "(?<=[^/:])/$", "")).alias("url"), "html").where("html is not null").dropDuplicates(["url"])
    known = known.unionByName(pages.where(F.col("url").rlike(r"^[a-z]+://[^/]+/$")).select("url", "html").where("html is not null")).dropDuplicates(["url"])
    frontier, seen, left_out, visited, count = first, first, None, None, 0
    for depth in range(deepest + 1):
        hit = materialize(frontier.join(known, "url", "left").orderBy("url"), "frontier")
        here = hit.where("html is not null").orderBy("url").limit(most - count)  # a crawl takes at most 200 pages
        here = materialize(here.select("url", F.lit(depth).alias("depth"), "html"), "visited")
        visited = here if visited is None else visited.unionByName(here)
        gone = hit.where("html is null").select("url", F.lit("missing").alias("reason"))
        left_out = gone if left_out is None else left_out.unionByName(gone)
        count += here.count()
        if depth == deepest or count >= most:
            break
        found = here.mapInPandas(links, "link string").select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti")
        judged = materialize(found.withColumn("reason", skip_reason(F.col("url"), host, domain, prefix, list(exclude), rules)), "judged")
        left_out = left_out.unionByName(judged.where("reason is not null").select("url", "reason"))
        frontier = judged.where("reason is null").select("url")
        seen = seen.unionByName(judged.select("url"))
        if not frontier.limit(1).count():
            break
    return visited.mapInPandas(_content, "url string, depth int, title string, content string"), left_out


def _content(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"url": frame.url, "depth": frame.depth, "title": [derive_title(h, u) for u, h in zip(frame.url, frame.html)], "content": [html_to_markdown(h) for h in frame.html]})


# ---- documentation sites

#: What a site's generator leaves in its pages, and the elements (tag, attribute, value) that hold the content.
SITES = {
    "sphinx": (r"(?i)content=[\"']Sphinx|sphinxsidebar|rst-content|class=[\"']sphinx-[a-z]", [("div", "role", "main"), ("div", "class", "body"), ("section", "role", "main"), ("article", None, None)]),
    "vitepress": (r"__VITEPRESS_|VPDoc|vp-doc|(?i:content=[\"']VitePress)", [("div", "class", "vp-doc"), ("div", "class", "VPDoc"), ("main", None, None)]),
    "doxygen": (r"(?i)Generated by Doxygen|content=[\"']Doxygen|doc-content|doxygen", [("div", "class", "contents"), ("div", "id", "doc-content"), ("div", "class", "textblock")]),
    "generic": (r"", [("main", None, None), ("article", None, None), ("div", "role", "main"), ("div", "class", "content")]),
}


def site_kind(html):
    """Column: the generator of a documentation page."""
    kind = None
    for name, (pattern, _) in SITES.items():
        if pattern:
            kind = F.when(html.rlike(pattern), name) if kind is None else kind.when(html.rlike(pattern), name)
    return kind.otherwise("generic")


def element_of(html: str, tag: str, attribute: str | None = None, value: str | None = None) -> str | None:
    """The inside of the first element of a tag with a word in an attribute, up to its own end tag; None without one."""
    for m in re.finditer(rf"<{tag}(\s[^>]*)?>", html, re.I):
        if attribute:
            found = re.search(rf"{attribute}\s*=\s*[\"']([^\"']*)[\"']", m[1] or "", re.I)
            if not found or value.lower() not in found[1].lower().split():
                continue
        depth = 1
        for t in re.compile(rf"<(/?){tag}(?:\s[^>]*)?>", re.I).finditer(html, m.end()):
            depth += -1 if t[1] else 1
            if depth == 0:
                return html[m.end() : t.start()]
        return None
    return None


def main_content(html: str, kind: str) -> str:
    """A page's content as markdown: the first element its generator puts content in, else the whole page."""
    return Markup().markdown(next((x for where in SITES[kind][1] if (x := element_of(html, *where))), html))


def site_documents(pages: DataFrame) -> DataFrame:
    """``(url, kind, title, content)`` of pages ``(url, html)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"url": frame.url, "kind": frame.kind, "title": [derive_title(h, u) for u, h in zip(frame.url, frame.html)], "content": [main_content(h, k) for h, k in zip(frame.html, frame.kind)]})

    return pages.where("html is not null").select("url", site_kind(F.col("html")).alias("kind"), "html").mapInPandas(run, "url string, kind string, title string, content string")


def site_frontier(sitemap: str | None, root_html: str | None, base: str, prefix: str = "") -> list[str]:
    """Where a documentation site's crawl begins: the addresses of its sitemap and the links of its root page, each once."""
    host = urlsplit(base).netloc
    own = [u for u in sitemap_links(sitemap) if urlsplit(u).netloc == host and urlsplit(u).path.startswith(prefix) and urlsplit(u).path.rsplit(".", 1)[-1].lower() not in ASSETS]
    return list(dict.fromkeys([*own, *page_links(root_html, base, prefix)]))


def page_outcomes(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``(url, outcome)`` of pages ``(url, content)`` against known ones: empty and equal ones are skipped, known ones updated, the others indexed."""
    old = known.groupBy("url").agg(F.min(F.sha2("content", 256)).alias("h"))
    blank = F.coalesce(F.length(F.regexp_replace("content", r"(?U)\s+", "")), F.lit(0)) == 0
    return pages.join(old, "url", "left").select("url", F.when(blank, "skipped").when(F.col("h") == F.sha2("content", 256), "skipped").when(F.col("h").isNotNull(), "updated").otherwise("indexed").alias("outcome"))


def repository(url: str) -> dict:
    """Host, owner, repository, branch and path of an address at one of two code hosts; others are refused."""
    parts = urlsplit(url)
    host = {"github.com": "github", "gitlab.com": "gitlab"}.get((parts.hostname or "").lower())
    if host is None:
        raise ValueError(f"unsupported repository host: {parts.hostname}")
    names = [p for p in re.sub(r"\.git$", "", parts.path.strip("/")).split("/") if p]
    if len(names) < 2:
        raise ValueError("a repository address has an owner and a name")
    rest = names[names.index("-") + 1 :] if host == "gitlab" and "-" in names else names[2:] if host == "github" else []
    tree = rest[1:] if rest[:1] == ["tree"] else []
    return {"host": host, "owner": names[0], "repo": names[1], "branch": tree[0] if tree else None, "path": "/".join(tree[1:]) or None}


def repository_files(files: DataFrame, extensions: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Files ``(path, content)`` of a repository by extension and folder; hidden ones are left out."""
    keep = ~F.col("path").rlike(r"(^|/)\.[^/]")
    if prefix:
        keep = keep & F.startswith("path", F.lit(prefix.strip("/") + "/"))
    if extensions:
        keep = keep & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lstrip(".").lower() for e in extensions])
    return files.where(keep)
