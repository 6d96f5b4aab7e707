"""Providers that work offline: embedders, language models, document parsers, and questions answered from search results."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns texts into vectors of ``dimensions`` numbers."""

    name: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float] | None]: ...


class HashEmbedder:
    """Four numbers from a rolling hash of the text, of length 1: the same text always has the same vector."""

    name, dimensions = "hash", 4

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def embed(self, text: str) -> list[float]:
        h = 5381
        for unit in text.encode("utf-16-le")[::2]:
            h = ((h * 33) ^ unit) & 0xFFFFFFFF
        x = np.array([math.sin((h >> (8 * i)) & 0xFF) + 1e-3 for i in range(self.dimensions)])
        return (x / np.linalg.norm(x)).tolist()


class VocabularyEmbedder:
    """Counts of the words of a fixed vocabulary, of length 1; a text without any of them has a zero vector."""

    name = "vocabulary"

    def __init__(self, words: list[str]):
        self.place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.dimensions = len(self.place)

    @classmethod
    def of(cls, texts: DataFrame, column: str, most: int = 20_000) -> "VocabularyEmbedder":
        """The ``most`` most frequent words of a table of texts (a fixed bound of the vector's length)."""
        words = texts.select(F.explode(F.split(F.lower(column), "[^a-z0-9]+")).alias("w")).where(F.length("w") > 1)
        return cls([r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()])

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for w in re.findall(r"[a-z0-9]+", text.lower()):
                if len(w) > 1 and w in self.place:
                    row[self.place[w]] += 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class HashedWordsEmbedder:
    """Counts of words hashed into ``dimensions`` places, of length 1: needs no vocabulary and no network."""

    name = "hashed-words"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            words = np.array(re.findall(r"[^\W_]+", text.lower()), dtype=object)
            if len(words):
                np.add.at(row, (pd.util.hash_array(words, hash_key="quillspark-vectr") % np.uint64(self.dimensions)).astype(int), 1.0)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


_EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "hashed-words": HashedWordsEmbedder}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    if not name.strip():
        raise ValueError("a provider needs a name")
    _EMBEDDERS[name] = factory


def embedder(name: str, **options) -> Embedder:
    if name not in _EMBEDDERS:
        raise LookupError(f"unknown provider {name}; known: {', '.join(sorted(_EMBEDDERS))}")
    return _EMBEDDERS[name](**options)


def embed(df: DataFrame, provider: Embedder, id_col: str, text_col: str, batch: int = 50) -> DataFrame:
    """``(id, embedding)`` of each row, in batches of ``batch`` texts; a batch that fails is tried text by text, and a text that fails has null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            for at in range(0, len(frame), batch):
                texts = frame.text.iloc[at : at + batch].tolist()
                try:
                    out += provider.embed_batch(texts)
                except Exception:
                    for text in texts:
                        try:
                            out += provider.embed_batch([text])
                        except Exception:
                            out.append(None)
            yield pd.DataFrame({"id": frame.id, "embedding": out})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, embedding array<float>")


# ---- language models


class LanguageModel(Protocol):
    name: str

    def complete(self, system: str, prompt: str) -> str: ...


class Passthrough:
    """Gives the prompt back: the assembled context, for a model outside."""

    name = "passthrough"

    def complete(self, system: str, prompt: str) -> str:
        return prompt


class Extractive:
    """Answers with the sentences of the context that share most words with the question."""

    name = "extractive"

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def complete(self, system: str, prompt: str) -> str:
        context, _, question = prompt.rpartition("Question:")
        asked = set(re.findall(r"[^\W_]+", question.lower()))
        found = [(len(asked & set(re.findall(r"[^\W_]+", s.lower()))), -i, s.strip()) for i, s in enumerate(re.split(r"(?<=[.!?])\s+|\n+", context)) if s.strip()]
        best = sorted(sorted(found, reverse=True)[: self.sentences], key=lambda x: -x[1])
        return " ".join(s for n, _, s in best if n)


SYSTEM = "Answer from the context alone. Name the documents you use. Say so if the context does not hold the answer."


def context_prompt(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(request_id, context, sources)``: the contents of each request's hits in their order, numbered and titled, and their documents."""
    one = docs.groupBy(F.col("id").alias("document_id")).agg(F.min("title").alias("title"), F.min("url").alias("url"))
    text = chunks.groupBy("id").agg(F.min("content").alias("content"))
    rows = hits.select("request_id", "id", "document_id", "score", "place").join(text, "id").join(one, "document_id")
    part = F.struct("place", F.concat(F.lit("["), F.col("place"), F.lit("] "), F.coalesce("title", F.lit("Untitled")), F.lit("\n"), "content").alias("text"), "document_id", "title", "url", "score")
    packed = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    source = lambda p: F.struct(p["document_id"].alias("document_id"), p["title"].alias("title"), p["url"].alias("url"), p["score"].alias("score"))
    return packed.select("request_id", F.concat_ws("\n\n---\n\n", F.transform("parts", lambda p: p["text"])).alias("context"), F.transform("parts", source).alias("sources"))


def ask(found: DataFrame, question: str, model: LanguageModel, request_id: int = 1) -> dict:
    """The model's answer to a question from the context of ``context_prompt``, with its sources; no context is said so."""
    row = found.where(F.col("request_id") == request_id).first()
    if row is None:
        return {"answer": "No relevant documents were found.", "sources": [], "model": model.name}
    prompt = f"{row['context']}\n\nQuestion: {question}"
    return {"answer": model.complete(SYSTEM, prompt), "sources": [s.asDict() for s in row["sources"]], "model": model.name}


def ask_stream(found: DataFrame, question: str, model: LanguageModel, request_id: int = 1) -> Iterator[dict]:
    """``ask`` as events: the sources, the answer word by word (or as the model streams it), the end."""
    row = found.where(F.col("request_id") == request_id).first()
    yield {"type": "sources", "sources": [s.asDict() for s in row["sources"]] if row else []}
    prompt = f"{row['context'] if row else ''}\n\nQuestion: {question}"
    stream = getattr(model, "complete_stream", None)
    for token in stream(SYSTEM, prompt) if stream else re.findall(r"\S+\s*", model.complete(SYSTEM, prompt)) if row else []:
        yield {"type": "token", "token": token}
    yield {"type": "done", "model": model.name}


def retry(call: Callable, attempts: int = 3, wait: float = 1.0, retriable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """Call until it works: waits double from ``wait`` seconds, or are what the error's ``retry_after`` says."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if attempt + 1 == attempts or not retriable(error):
                raise
            sleep(getattr(error, "retry_after", None) or wait * 2**attempt)
