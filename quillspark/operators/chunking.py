"""Cutting documents into chunks: by headings, by windows, and source code by its declarations."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import LANGUAGES

_HEADING = re.compile(r"(#{1,3}) +(\S.*)$")
MAX_DOCUMENT = 100 * 1024 * 1024


def _paragraph_pieces(text: str, most: int) -> Iterator[str]:
    """An oversized section packed paragraph by paragraph; a paragraph that is still too long is cut by length."""
    packed: list[str] = []
    for paragraph in re.split(r"\n\n+", text):
        joined = f"{packed[-1]}\n\n{paragraph}" if packed and packed[-1] else paragraph
        if packed and (len(joined) <= most or not packed[-1]):
            packed[-1] = joined
        else:
            packed.append(paragraph)
    for piece in (p.strip() for p in packed):
        cuts = [piece] if len(piece) <= most else [piece[i : i + most].strip() for i in range(0, len(piece), most)]
        yield from (c for c in cuts if c)


def chunk_by_headings(content: str, most: int = 1500, overlap: float = 0.1) -> list[str]:
    """Chunks that begin at headings of the first three levels and name the headings above them.

    A chunk over ``most`` characters is cut between paragraphs, then by length. With more than one chunk, each begins
    with about ``overlap`` (0 to 0.5) of the one before, from a line start where there is one. Blank text gives none.
    """
    chunks: list[str] = []
    above: list[tuple[int, str]] = []
    lines: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal lines, size
        text = "\n".join(lines).strip()
        if text:
            chunks.extend([text] if len(text) <= most else _paragraph_pieces(text, most))
            lines, size = [], 0

    for line in content.split("\n"):
        heading = _HEADING.match(line)
        if heading:
            level, name = len(heading[1]), heading[2].strip()
            if lines:
                flush()
                above = above[: next((i for i in range(len(above), 0, -1) if above[i - 1][0] < level), 0)]
                trail = " > ".join(n for _, n in above)
                lines = [f"Context: {trail}"] if trail else []
                size = len(lines[0]) if lines else 0
            above.append((level, name))
        size += len(line) + (1 if lines else 0)
        lines.append(line)
        if size > most:
            flush()
    flush()
    return with_overlap(chunks, overlap)


def with_overlap(chunks: list[str], overlap: float) -> list[str]:
    """Each chunk but the first begins with the end of the one before."""
    share = max(0.0, min(overlap, 0.5))
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:]):
        tail = before[len(before) - int(len(before) * share) :]
        first, newline, rest = tail.partition("\n")
        tail = (rest if newline and first else tail).strip()
        out.append(f"{tail}\n\n{chunk}" if tail else chunk)
    return out


def chunk_by_windows(content: str, most: int = 1500, window: int = 65_536) -> list[str]:
    """Chunks of a very long text: windows that end at a sentence or line end, each cut by headings, repeats left out.

    Windows share a tenth, 1,024 characters at most. Texts over ``MAX_DOCUMENT`` characters are refused.
    """
    if len(content) > MAX_DOCUMENT:
        raise ValueError("the document is longer than 100 MB")
    shared = min(window // 10, 1024)
    seen, out, at = set(), [], 0
    while at < len(content):
        end = min(at + window, len(content))
        if end < len(content):
            stop = re.compile(r"[.\n]").search(content, end, min(end + 200, len(content)))
            end = stop.end() if stop else end
        for chunk in chunk_by_headings(content[at:end], most, 0):
            mark = hashlib.sha256(re.sub(r"\s+", " ", chunk).strip().encode()).digest()
            if mark not in seen:
                seen.add(mark)
                out.append(chunk)
        at = end if end >= len(content) or end - shared <= 0 else end - shared
    return out


def chunk_text(content: str, most: int = 1500, overlap: float = 0.1) -> list[str]:
    """``chunk_by_windows`` for texts over a million characters, ``chunk_by_headings`` for others."""
    return chunk_by_windows(content, most) if len(content) > 1024 * 1024 else chunk_by_headings(content, most, overlap)


def chunked(df: DataFrame, id_col: str, content_col: str, cutter: Callable[..., list[str]] = chunk_text, **options) -> DataFrame:
    """``(document_id, chunk_index, content)`` of every text; null, blank and null-id rows have no chunks. Nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, c) for i, text in zip(frame.document_id, frame.content) for n, c in enumerate(cutter(text, **options))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "content"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(id_col).isNotNull() & F.col(content_col).isNotNull()).select(F.col(id_col).alias("document_id"), F.col(content_col).alias("content"))
    return rows.mapInPandas(run, f"document_id {kind}, chunk_index int, content string")


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each text of a document, white space aside."""
    from pyspark.sql import Window

    key = F.sha2(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")), 256)
    place = F.row_number().over(Window.partitionBy("document_id", key).orderBy("chunk_index"))
    return chunks.withColumn("_n", place).where("_n = 1").drop("_n")


def strip_tags(html: str) -> str:
    """Text without tags; a > inside a quoted attribute does not end its tag."""
    out, at = [], 0
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        m = re.compile(r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>").match(html, start)
        at = m.end() if m else len(html)
    return "".join([*out, html[at:]])


def derive_title(content: str | None, url: str | None = None) -> str:
    """A document's title: its first HTML heading or title, its first markdown heading, else from its address."""
    for pattern in (r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"):
        if content and (m := re.search(pattern, content)) and (text := re.sub(r"\s+", " ", strip_tags(m[1])).strip()):
            return text
    if content and (m := re.search(r"(?m)^#\s+(\S.*)$", content)):
        return m[1].strip()
    if url:
        path = re.sub(r"^[A-Za-z][\w+.-]*://", "", re.sub(r"[?#].*$", "", url)).rstrip("/")
        host, *parts = path.split("/")
        words = re.sub(r"[-_]+", " ", re.sub(r"\.\w+$", "", parts[-1])).strip() if parts else ""
        return words or host
    return "Untitled"


# ---- source code


class Code(NamedTuple):
    content: str
    start_line: int
    end_line: int
    node_type: str


_DECLARATION = {
    "javascript": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\b|class\s|const\s+\w+\s*=\s*(?:async\s*)?(?:\(|function))",
    "typescript": r"(?:export\s+(?:default\s+)?)?(?:abstract\s+|async\s+|declare\s+)*(?:function\b|class\s|interface\s|type\s+\w+\s*=|enum\s|namespace\s)",
    "go": r"(?:func|type)\s", "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+)?(?:fn|struct|enum|trait|impl|mod)\b",
    "java": r"(?:public|protected|private|abstract|final|static|\s)*(?:class|interface|enum|record)\s", "csharp": r"(?:public|internal|protected|private|abstract|sealed|static|\s)*(?:namespace|class|interface|enum|struct|record)\s",
    "c": r"(?:(?:struct|enum|union|typedef)\b|[\w*]+[\w\s*]*\([^;]*$)", "cpp": r"(?:(?:class|struct|enum|union|typedef|namespace|template)\b|[\w:*&<>]+[\w\s:*&<>]*\([^;]*$)", "ruby": r"(?:def|class|module)\s",
}
_DECLARATION["tsx"] = _DECLARATION["typescript"]


def _python_nodes(text: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """Top-level statements as ``(first line, last line, type, lines of the members)``; a type only for declarations."""
    out = []
    for node in ast.parse(text).body:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        kind = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}.get(type(node), "")
        members = [(min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]), n.end_lineno) for n in node.body] if kind else []
        out.append((first, node.end_lineno, kind, [(first, members[0][0] - 1), *members] if members and members[0][0] > first else members))
    return out


def _plain_nodes(text: str, language: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """The same for languages without a parser here: declarations begin in the first column and end with their block."""
    lines, out, at = text.split("\n"), [], 0
    begins = re.compile(_DECLARATION[language])
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        start, depth, opened = at, 0, False
        declared = begins.match(lines[at])
        while at < len(lines):
            code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[at])
            depth += code.count("{") - code.count("}")
            opened |= "{" in code
            at += 1
            closes = re.match(r"end\b", lines[at - 1]) if language == "ruby" else opened and depth <= 0
            if not declared or closes or (not opened and language != "ruby" and code.rstrip().endswith(";")):
                break
        members: list[tuple[int, int]] = []
        for n in range(start, at):  # members are separated by blank lines
            if members and lines[n].strip() and lines[n - 1].strip():
                members[-1] = (members[-1][0], n + 1)
            elif lines[n].strip():
                members.append((n + 1, n + 1))
        out.append((start + 1, at, "declaration" if declared else "", members))
    return out


def chunk_code(text: str, language: str, most: int = 1500) -> list[Code]:
    """Chunks of source code by top-level declarations; what stands before one goes with it where it fits.

    A declaration over ``most`` characters is packed from its members. Python is parsed; for the other languages
    declarations are found by their first line and their braces. Unknown languages and unparsable text are one chunk.
    """
    language = LANGUAGES.get(language.lower(), language.lower())
    lines = text.split("\n")
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    try:
        nodes = _python_nodes(text) if language == "python" else _plain_nodes(text, language)
    except (SyntaxError, ValueError, KeyError):
        nodes = []
    out: list[Code] = []
    loose: list[tuple[int, int]] = []
    for first, last, kind, members in nodes:
        if not kind:
            loose.append((first, last))
            continue
        lead = "\n".join(cut(*n) for n in loose)
        body = cut(first, last)
        if len(body) + (len(lead) + 2 if lead else 0) <= most:
            out.append(Code(f"{lead}\n\n{body}" if lead else body, loose[0][0] if loose else first, last, kind))
            loose = []
            continue
        if lead:
            out.append(Code(lead, loose[0][0], loose[-1][1], "preamble"))
        loose = []
        packed: list[Code] = []
        for a, b in members if len(members) > 1 else [(first, last)]:
            piece = cut(a, b)
            if packed and len(packed[-1].content) + 2 + len(piece) <= most:
                packed[-1] = Code(f"{packed[-1].content}\n\n{piece}", packed[-1].start_line, b, kind)
            else:
                packed.append(Code(piece, a, b, kind))
        out += packed
    if loose and out:
        out.append(Code("\n".join(cut(*n) for n in loose), loose[0][0], loose[-1][1], "trailing"))
    return out or ([Code(text, 1, len(lines), "module")] if text.strip() else [])


def code_documents(files: DataFrame, repo: str, most: int = 1500) -> DataFrame:
    """``(title, url, content, language)`` of repository files ``(path, content)``: a row for each chunk of code, one for each other file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
                if language is None:
                    rows.append((path, f"repo://{repo}/{path}", content, None))
                    continue
                for c in chunk_code(content, language, most):
                    rows.append((f"{path}:L{c.start_line}-L{c.end_line} [{c.node_type}]", f"repo://{repo}/{path}#L{c.start_line}", c.content, language))
            yield pd.DataFrame(rows, columns=["title", "url", "content", "language"])

    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(run, "title string, url string, content string, language string")
