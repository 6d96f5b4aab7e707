"""Formats of files and services as markdown; everything here works on one text or one file and runs inside Arrow functions."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from xml.etree import ElementTree


class ParseError(ValueError):
    """A file that is not what its name says, or whose reader is missing here."""


# ---- markup


class Markup(HTMLParser):
    """HTML, storage markup of wikis and notebook pages as markdown, in one pass over the tags.

    Scripts, styles and navigation are dropped. Wiki macros: code, panels, expandable parts, issue keys, images, links and
    attachments; tables of contents vanish. Notebook tags: to-do entries, ink, images and attached files.
    """

    SKIP = {"script", "style", "nav", "noscript", "ac:parameter"}
    WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "ri:page", "ri:attachment", "ri:user", "ri:url"}
    BLOCK = {"p", "div", "article", "section", "main", "table", "ul", "ol", "header", "footer", "figure"}

    def __init__(self, notebook: bool = False):
        super().__init__(convert_charrefs=True)
        self.notebook = notebook
        self.parts: list[list[str]] = [[]]  # open pieces of output; the last takes text
        self.open: list[tuple[str, dict, Callable[[str], str]]] = []
        self.lists: list[list] = []
        self.parameter = ""

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag in self.VOID:
            self.say(self.single(tag, at))
            return
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        self.open.append((tag, at, self.finish(tag, at)))
        self.parts.append([])

    def handle_endtag(self, tag):
        places = [i for i, (t, _, _) in enumerate(self.open) if t == tag]
        if not places:
            return
        while len(self.open) > places[-1]:
            name, at, finish = self.open.pop()
            text = "".join(self.parts.pop())
            if name in ("ul", "ol") and self.lists:
                self.lists.pop()
            if name == "ac:parameter":
                for outer, outer_at, _ in reversed(self.open):
                    if outer == "ac:structured-macro":
                        outer_at[f"parameter:{at.get('ac:name', '')}"] = text.strip()
                        break
            self.say(finish(text))

    def handle_data(self, data):
        self.say(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.say(data[6:])

    def say(self, text: str) -> None:
        self.parts[-1].append(text)

    def single(self, tag: str, at: dict) -> str:
        if tag == "br":
            return "\n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return "[image]" if self.notebook else f"![{at.get('alt', '')}]({at.get('src', '')})"
        if tag == "ri:attachment" and any(t == "ac:image" for t, _, _ in self.open):
            return ""
        if tag == "ri:attachment":
            return f"[attached: {at.get('ri:filename', '')}]"
        if tag == "ri:page":
            for outer, outer_at, _ in reversed(self.open):
                if outer == "ac:link":
                    outer_at["page"] = at.get("ri:content-title", "")
        return ""

    def finish(self, tag: str, at: dict) -> Callable[[str], str]:
        """What an element's inner text becomes when it ends."""
        if tag in self.SKIP:
            return lambda text: ""
        if re.fullmatch(r"h[1-6]", tag):
            return lambda text: f"\n\n{'#' * int(tag[1])} {' '.join(text.split())}\n\n"
        if self.notebook and at.get("data-tag", "").startswith("to-do"):
            box = "x" if at["data-tag"] == "to-do:completed" else " "
            return lambda text: f"\n- [{box}] {text.strip()}\n"
        if self.notebook and (tag == "ink" or "InkNode" in at.get("class", "")):
            return lambda text: "[handwritten content]"
        if self.notebook and tag == "div" and "data-id" in at:
            return lambda text: ""
        if self.notebook and tag == "object" and "data-attachment" in at:
            return lambda text: f"[attached: {at['data-attachment']}]"
        if tag in ("blockquote", "cite"):
            return self.quoted
        if tag in self.WRAP:
            return lambda text, w=self.WRAP[tag]: f"{w}{text.strip()}{w}" if text.strip() else text
        if tag == "pre":
            return lambda text: f"\n\n```{at.get('language', '')}\n{text.strip(chr(10))}\n```\n\n"
        if tag == "code":
            if self.open and self.open[-1][0] == "pre":
                language = re.search(r"language-(\S+)", at.get("class", ""))
                self.open[-1][1]["language"] = language[1] if language else ""
                return lambda text: text
            return lambda text: f"`{text}`"
        if tag == "a":
            return lambda text: f"[{text.strip()}]({at.get('href', '')})"
        if tag == "li":
            return self.entry
        if tag == "tr":
            return lambda text: f"\n|{text}"
        if tag in ("td", "th"):
            return lambda text: f" {' '.join(text.split())} |"
        if tag == "ac:structured-macro":
            return lambda text: self.macro(at, text)
        if tag == "ac:image":
            return lambda text: "[image]"
        if tag == "ac:link":
            return lambda text: f"[{text.strip() or 'link'}]({at['page']})" if at.get("page") else f"[{text.strip() or 'link'}]" if not text.strip().startswith("[attached") else text.strip()
        if tag in self.BLOCK:
            return lambda text: f"\n\n{text.strip()}\n\n"
        return lambda text: text

    @staticmethod
    def quoted(text: str) -> str:
        lines = re.sub(r"\n{3,}", "\n\n", text.strip()).split("\n")
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in lines) + "\n\n"

    def entry(self, text: str) -> str:
        kind = self.lists[-1] if self.lists else ["ul", 0]
        kind[1] += 1
        body = re.sub(r"\n{2,}", "\n", text.strip()).replace("\n", "\n  ")
        return f"\n{f'{kind[1]}.' if kind[0] == 'ol' else '-'} {body}"

    def macro(self, at: dict, text: str) -> str:
        name = at.get("ac:name", "").lower()
        if name == "code":
            return f"\n\n```{at.get('parameter:language', '')}\n{text.strip(chr(10))}\n```\n\n"
        if name in ("info", "note", "warning", "tip"):
            return self.quoted(f"**{name.capitalize()}:** {text.strip()}")
        if name == "panel":
            return self.quoted(text)
        if name == "expand":
            return f"\n\n**{at.get('parameter:title') or 'Details'}**\n\n{text.strip()}\n\n"
        if name == "toc":
            return ""
        if name == "jira":
            return f"[JIRA: {at.get('parameter:key') or 'UNKNOWN'}]"
        return text

    def markdown(self, html: str) -> str:
        self.feed(html)
        self.close()
        while self.open:
            self.handle_endtag(self.open[-1][0])
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(self.parts[0]))).strip()


def html_to_markdown(html: str) -> str:
    return Markup().markdown(html)


def storage_to_markdown(html: str) -> str:
    """A wiki's storage markup; character data sections count as text."""
    return Markup().markdown(re.sub(r"<!\[CDATA\[([\s\S]*?)\]\]>", lambda m: m[1].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), html))


def notebook_to_markdown(html: str) -> str:
    return Markup(notebook=True).markdown(html)


# ---- blocks of a notes service


def _rich(parts: list | None) -> str:
    return "".join(p.get("plain_text", "") for p in parts or [])


_PREFIX = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}


def _block(kind: str, data: dict, block: dict) -> str | None:
    text = _rich(data.get("rich_text"))
    if kind in _PREFIX:
        return _PREFIX[kind] + text
    if kind == "to_do":
        return f"- [{'x' if data.get('checked') else ' '}] {text}"
    if kind == "code":
        return f"```{data.get('language') or ''}\n{text}\n```"
    if kind == "callout":
        return f"> {(data.get('icon') or {}).get('emoji', '')} {text}".strip()
    if kind == "divider":
        return "---"
    if kind == "image":
        url = (data.get("external") if data.get("type") == "external" else data.get("file")) or {}
        return f"![{_rich(data.get('caption'))}]({url['url']})" if url.get("url") else "[image]"
    if kind == "bookmark":
        return f"[{_rich(data.get('caption')) or data.get('url', '')}]({data.get('url', '')})"
    if kind == "child_page":
        return f"[{data.get('title') or 'Untitled'}](notion://page/{block.get('id', '')})"
    return text if kind in ("paragraph", "toggle") else text or None


def blocks_to_markdown(blocks: list[dict], depth: int = 0) -> str:
    """A tree of blocks: children are indented by two blanks, table rows are lines between bars; at most 20 levels deep."""
    lines: list[str] = []
    for block in blocks if depth <= 20 else []:
        kind = block.get("type", "")
        children = block.get("children") or []
        if kind == "table":
            lines += ["| " + " | ".join(_rich(c) for c in row["table_row"]["cells"]) + " |" for row in children if (row.get("table_row") or {}).get("cells")]
            continue
        if kind != "table_row" and (line := _block(kind, block.get(kind) or {}, block)) is not None:
            lines.append(line)
        if inner := blocks_to_markdown(children, depth + 1):
            lines += [f"  {x}" for x in inner.split("\n")]
    return "\n".join(lines)


def object_title(found: dict) -> str:
    """The title of a page or database: its own, else its first property of that type."""
    if found.get("title"):
        return _rich(found["title"])
    return next((_rich(p["title"]) for p in (found.get("properties") or {}).values() if p.get("type") == "title" and p.get("title")), "Untitled")


def property_values(properties: dict) -> list[tuple[str, str]]:
    """Names and texts of the properties of a database row, titles left out."""
    out = []
    for name, p in properties.items():
        value = p.get(p.get("type", ""))
        if p.get("type") in ("rich_text",):
            value = _rich(value)
        elif isinstance(value, dict):
            value = value.get("name") or value.get("start")
        elif isinstance(value, list):
            value = ", ".join(str(v.get("name", "")) for v in value) if p.get("type") != "title" else None
        if value not in (None, "", []) and p.get("type") != "title":
            out.append((name, str(value)))
    return out


# ---- notes in a vault


def note(text: str, names: set[str]) -> dict:
    """Head, body, tags and links of a note: embedded notes are named, links become markdown, comments and queries go, callouts are quotes."""
    from quillspark.functions.text import frontmatter

    head, body = frontmatter(text)
    links = [m[1] for m in re.finditer(r"(?<!!)\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", body)]
    body = re.sub(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", lambda m: f"[Embedded: {m[1]}]" if m[1].lower() in names else f"[{m[1]}]", body)
    body = re.sub(r"(?<!!)\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", lambda m: f"[{m[1] if m[2] is None else m[2]}]({re.sub(r'\s+', '-', m[1].lower())})", body)
    body = re.sub(r"%%[\s\S]*?%%|```dataview[\s\S]*?```", "", body)
    body = re.sub(r"(?m)^> \[!(\w+)\][ \t]*(.*)$", r"> **\1**: \2", body)
    own = head.get("tags")
    tags = dict.fromkeys([m[1] for m in re.finditer(r"(?:^|\s)#([a-zA-Z][\w/-]*)", body)] + [t for t in (own if isinstance(own, list) else []) if isinstance(t, str)])
    return {"head": head, "body": body.strip(), "tags": list(tags), "links": links}


def embed_notes(path: str, bodies: dict[str, str], seen: frozenset = frozenset()) -> str:
    """A note with the notes it embeds in its place, each at most once on the way down."""
    names = {p.rsplit("/", 1)[-1].removesuffix(".md").lower(): p for p in bodies}

    def put(m: re.Match) -> str:
        target = names.get(m[1].lower())
        if target is None or target in seen or target == path:
            return m[2] or f"[{m[1]}]"
        return re.sub(r"^---\r?\n[\s\S]*?\r?\n---", "", embed_notes(target, bodies, seen | {path, target})).strip()

    return re.sub(r"!\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", put, bodies[path])


def note_topic(path: str, head: dict, by: str = "folder") -> str | None:
    """The topic of a note: its folder, or what its head says."""
    if by == "folder":
        return path.rpartition("/")[0] or None
    topic = head.get("topic")
    return topic if isinstance(topic, str) and topic else None


def vault_listed(path: str, exclude: list[str] = ()) -> bool:
    """Whether a file of a vault is a note to read: not in a hidden or excluded folder, no excluded path or name."""
    parts = path.split("/")
    if not path.endswith(".md") or any(p.startswith(".") for p in parts) or parts[0] in ("node_modules",):
        return False
    return not any(path == e or path.startswith(e.rstrip("/") + "/") or parts[-1] == e for e in exclude)


# ---- files


def yaml_to_markdown(text: str) -> str:
    import yaml

    try:
        list(yaml.safe_load_all(text))
    except yaml.YAMLError as problem:
        raise ParseError(f"no YAML: {problem}") from problem
    return f"```yaml\n{text.strip()}\n```"


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as problem:
        raise ParseError(f"no archive: {problem}") from problem


def _read(archive: zipfile.ZipFile, name: str) -> bytes:
    try:
        return archive.read(name)
    except KeyError as problem:
        raise ParseError(f"{name} is missing") from problem


def docx_text(data: bytes) -> str:
    """The paragraphs of a word processor's file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(_read(_archive(data), "word/document.xml"))
    marks = {f"{w}tab": "\t", f"{w}br": "\n"}
    lines = ["".join(n.text or "" if n.tag == f"{w}t" else marks.get(n.tag, "") for n in p.iter()) for p in root.iter(f"{w}p")]
    return "\n\n".join(line for line in lines if line.strip())


def pptx_text(data: bytes) -> str:
    """The texts of a presentation, slide by slide."""
    archive = _archive(data)
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        runs = [t.text or "" for t in ElementTree.fromstring(archive.read(name)).iter("{http://schemas.openxmlformats.org/drawingml/2006/main}t")]
        if any(r.strip() for r in runs):
            out.append(f"--- Slide {number} ---\n" + "\n".join(r for r in runs if r.strip()))
    return "\n\n".join(out)


def epub_text(data: bytes) -> str:
    """The chapters of a book in the order of its spine, without tags."""
    archive = _archive(data)
    c, o = "{urn:oasis:names:tc:opendocument:xmlns:container}", "{http://www.idpf.org/2007/opf}"
    root = ElementTree.fromstring(_read(archive, "META-INF/container.xml")).find(f".//{c}rootfile")
    if root is None:
        raise ParseError("the book names no package")
    package = ElementTree.fromstring(_read(archive, root.get("full-path")))
    items = {i.get("id"): i.get("href") for i in package.iter(f"{o}item")}
    out = []
    for ref in package.iter(f"{o}itemref"):
        name = normpath(join(dirname(root.get("full-path")), items.get(ref.get("idref"), "")))
        if name in archive.namelist():
            html = re.sub(r"(?is)<(script|style|head)\b.*?</\1>", "", archive.read(name).decode("utf-8", "replace"))
            text = re.sub(r"\n\s*\n+", "\n\n", unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)</(?:p|h[1-6]|div|li)>", "\n\n", html)))).strip()
            if text:
                out.append(text)
    return "\n\n".join(out)


def pdf_text(data: bytes) -> str:
    """The text of a PDF by whichever reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as problem:
        raise ParseError("reading PDF files needs the package pypdf") from problem
    return "\n\n".join(t.strip() for page in PdfReader(io.BytesIO(data)).pages if (t := page.extract_text() or "").strip())


def json_to_markdown(text: str) -> str:
    try:
        return "```json\n" + json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n```"
    except json.JSONDecodeError as problem:
        raise ParseError(f"no JSON: {problem}") from problem
