"""Language of documents and of their segments: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import shared_dir, spread

#: Raised whenever fitting changes, so that weights of another way of fitting are not taken for its own.
FIT = 2
LANGS = ("en", "de", "fr", "es", "pt", "nl")
#: Other spellings of the labels (three-letter codes and names); regions are cut off first.
SPELLINGS = {
    "en": "eng english englisch anglais ingles inglés engels",
    "de": "deu ger german deutsch allemand aleman alemán alemao alemão duits",
    "fr": "fra fre french francais français franzosisch französisch frances francés francês frans",
    "es": "spa spanish espanol español castellano spanisch espagnol espanhol spaans",
    "pt": "por portuguese portugues português portugués portugiesisch portugais portugees",
    "nl": "nld dut dutch nederlands niederlandisch niederländisch neerlandais néerlandais neerlandes holandés holandes holandês",
}
NAMES = {w: lang for lang, words in SPELLINGS.items() for w in [lang, *words.split()]}

_FENCE = re.compile(r"^[ \t]*```")
_CODE = re.compile(r"`[^`\n]*`|https?://\S+|<[^>\n]{1,200}>")
_MARK = re.compile(r"^(?:\s|[>|•]|[-*+](?=\s)|//|\d+[.)](?=\s)|﻿|…)+")
_STOP = re.compile(r"(?<=[.!?])[\"”»)\]]*\s+|\s\|\s?|\|\s*$")
_WHOLE = re.compile(r"[.!?][\"”»)\]]*$")
_LETTERS = re.compile(r"[^\W\d_]+")


def label_of(label: str | None) -> str | None:
    """The language a label names in any spelling; None if it names none of LANGS."""
    if label is None:
        return None
    low = unicodedata.normalize("NFC", label).strip().lower()
    return NAMES.get(low) or NAMES.get(re.split(r"[-_ .(]", low)[0])


class Stretch(NamedTuple):
    """A piece of prose: where it starts, its text without code, and whether it is a whole sentence."""

    start: int
    text: str
    whole: bool


def stretches(text: str | None) -> list[Stretch]:
    """All prose of a text in order: sentences, headings, entries, notes; code and addresses are left out.

    A whole sentence begins a line or follows another one, ends with a full stop, exclamation or question mark, and
    has three words or more. A line that goes on in small letters belongs to the sentence of the line before.
    """
    out: list[Stretch] = []
    if not text:
        return out
    fenced, open_ = False, False
    at = 0
    for line in re.split(r"(\r\n|\r|\n)", text):
        start, at = at, at + len(line)
        if _FENCE.match(line):
            fenced, open_ = not fenced, False
            continue
        if line in ("\n", "\r", "\r\n"):
            continue
        if fenced or not line.strip():
            open_ = False
            continue
        heading = line.lstrip("\ufeff \t").startswith("#")
        last = 0
        for m in [*_STOP.finditer(line), None]:
            end = m.start() if m else len(line)
            piece = line[last:end] + (m[0].rstrip(" \t|") if m else "")
            lead = _MARK.match(piece)
            offset = last + (lead.end() if lead else 0)
            raw = piece[lead.end() if lead else 0 :]
            body = _CODE.sub(" ", raw).strip().lstrip("# ")
            words = len(_LETTERS.findall(body))
            ended = bool(_WHOLE.search(body))
            if open_ and last == 0 and not lead and not heading and raw[:1].islower():
                before = out.pop()
                body = f"{before.text} {body}"
                words = len(_LETTERS.findall(body))
                out.append(Stretch(before.start, body, ended and words >= 3))
            elif words:
                out.append(Stretch(start + offset, body, ended and words >= 3 and not heading))
            last = m.end() if m else end
            open_ = bool(words) and not ended and not heading and m is None
    return out


def sentences(text: str | None) -> list[tuple[int, str]]:
    """Start and text of the whole sentences of a text."""
    return [(s.start, s.text) for s in stretches(text) if s.whole]


def _bytes(text: str) -> np.ndarray:
    """Folded input: composed accents, small letters, digits as one sign."""
    folded = re.sub(r"\d", "0", re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).lower()))
    return np.frombuffer(folded.encode("utf-8", "replace"), "u1")


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), width), "i8"), np.zeros((len(rows), width), "f4")
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return x, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ByteGRU:
    """Two gated recurrent layers, one over the bytes forwards and one backwards; every position has a label."""

    def __init__(self, hidden: int = 24, labels: tuple[str, ...] = LANGS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        h = hidden
        self.p = {"V": rng.normal(0, 0.1, (2 * h, len(labels))), "c": np.zeros(len(labels))}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (256, 3 * h))  # a byte's part of both gates and the candidate
            self.p["U" + d] = rng.normal(0, h**-0.5, (h, 3 * h))
        self.p = {k: v.astype("f4") for k, v in self.p.items()}

    def _stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings and recurrent weights of both directions, one above the other."""
        return np.concatenate([self.p["Ef"], self.p["Eb"]]), np.stack([self.p["Uf"], self.p["Ub"]])

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """States after each byte of both directions, which run side by side: (time, direction, row, hidden).

        The backward direction reads each row from its last byte on; ``turn`` has the places. Rows are over where the
        mask is 0.
        """
        (E, U), h = self._stacked(), self.hidden
        n, steps = x.shape
        size = mask.sum(1).astype("i8")[:, None]
        turn = np.where(np.arange(steps) < size, size - 1 - np.arange(steps), np.arange(steps))
        both = np.stack([x, np.take_along_axis(x, turn, 1) + 256])
        state, out, tape = np.zeros((2, n, h), "f4"), np.zeros((steps, 2, n, h), "f4"), []
        Ug, Uc = np.ascontiguousarray(U[:, :, : 2 * h]), np.ascontiguousarray(U[:, :, 2 * h :])
        for t in range(steps):
            part = E[both[:, :, t]]
            gates = _sigmoid(part[:, :, : 2 * h] + state @ Ug)
            z, r = gates[:, :, :h], gates[:, :, h:]
            reset = r * state
            cand = np.tanh(part[:, :, 2 * h :] + reset @ Uc)
            new = state + mask[:, t, None] * z * (cand - state)
            if keep:
                tape.append((t, state, z, r, reset, cand))
            state = new
            out[t] = state
        return out, turn, both, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        out, turn, both, tape = self._run(x, mask, keep)
        back = np.take_along_axis(out[:, 1], turn.T[:, :, None], 0)
        states = np.concatenate([out[:, 0], back], 2)
        logits = states @ self.p["V"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        return prob, states, turn, both, tape

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions and its gradient, by backpropagation through time."""
        prob, states, turn, both, tape = self.forward(x, mask, True)
        total = mask.sum()
        n, steps = x.shape
        loss = -(np.log(prob[:, np.arange(n), y] + 1e-9) * mask.T).sum() / total
        delta = prob.copy()
        delta[:, np.arange(n), y] -= 1
        delta *= (mask.T / total)[:, :, None]
        h = self.hidden
        g = {"V": states.reshape(-1, 2 * h).T @ delta.reshape(-1, delta.shape[2]), "c": delta.sum((0, 1))}
        above = delta @ self.p["V"].T
        dout = np.stack([above[:, :, :h], np.take_along_axis(above[:, :, h:], turn.T[:, :, None], 0)], 1)
        E, U = self._stacked()
        Ugt, Uct = np.ascontiguousarray(U[:, :, : 2 * h].transpose(0, 2, 1)), np.ascontiguousarray(U[:, :, 2 * h :].transpose(0, 2, 1))
        dstate = np.zeros((2, n, h), E.dtype)
        dpart = np.zeros((steps, 2, n, 3 * h), E.dtype)
        dU = np.zeros_like(U)
        for t, state, z, r, reset, cand in reversed(tape):
            dnew = dstate + dout[t]
            m = mask[:, t, None]
            dcand = dnew * m * z * (1 - cand * cand)
            dreset = dcand @ Uct
            dgates = np.concatenate([dnew * m * (cand - state) * z * (1 - z), dreset * state * r * (1 - r)], 2)
            dpart[t, :, :, : 2 * h], dpart[t, :, :, 2 * h :] = dgates, dcand
            dU[:, :, : 2 * h] += state.transpose(0, 2, 1) @ dgates
            dU[:, :, 2 * h :] += reset.transpose(0, 2, 1) @ dcand
            dstate = dnew * (1 - m * z) + dreset * r + dgates @ Ugt
        g["Uf"], g["Ub"] = dU
        flat = both.transpose(2, 0, 1).ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        dE = np.zeros_like(E)
        dE[flat[start]] = np.add.reduceat(dpart.reshape(-1, 3 * h)[order], start, axis=0)
        g["Ef"], g["Eb"] = dE[:256], dE[256:]
        return float(loss), g

    def fit(self, texts: list[str], labels: list[str], epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 3) -> "ByteGRU":
        """Train with Adam on texts cut into stretches of up to 120 bytes; a batch holds stretches of like length.

        The weights kept are a running average over the last steps, which is steadier than those of the last one.
        """
        rng = np.random.default_rng(seed)
        rows, ys = [], []
        for text, label in dict.fromkeys(zip(texts, labels)):
            data = _bytes(text)
            for at in range(0, len(data), 120):
                if len(data) - at >= 12 or at == 0:
                    rows.append(data[at : at + 120])
                    ys.append(self.labels.index(label))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        size = np.array([len(r) for r in rows])
        steps = epochs * -(-len(rows) // batch)
        keep = 1 - 1 / max(2, min(200, steps / 8))
        step = 0
        for epoch in range(epochs):
            order = np.argsort(size + rng.uniform(0, 40, len(rows)), kind="stable")
            batches = [order[at : at + batch] for at in range(0, len(order), batch)]
            now = rate * (1 - epoch / epochs) ** 0.5
            for which in rng.permutation(len(batches)):
                some = batches[which]
                x, mask = _pad([rows[i] for i in some])
                _, g = self.gradient(x, mask, np.array([ys[i] for i in some]))
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
                    mean[k] = keep * mean[k] + (1 - keep) * self.p[k]
        self.p = {k: (v / (1 - keep**step)).astype("f4") for k, v in mean.items()} if step else self.p
        return self

    def probabilities(self, texts: list[str], batch: int = 512, width: int = 600) -> np.ndarray:
        """Each text's label probabilities: the positions' probabilities, pooled as a geometric mean.

        Texts longer than ``width`` bytes are read in stretches of that length, all of them.
        """
        out = np.zeros((len(texts), len(self.labels)))
        parts = [(i, data[at : at + width]) for i, t in enumerate(texts) for data in [_bytes(t)] for at in range(0, len(data), width)]
        parts.sort(key=lambda p: len(p[1]))
        for at in range(0, len(parts), batch):
            some = parts[at : at + batch]
            x, mask = _pad([p[1] for p in some])
            prob, *_ = self.forward(x, mask)
            score = (np.log(prob + 1e-6) * mask.T[:, :, None]).sum(0)
            for (i, _), s in zip(some, score):
                out[i] += s
        length = np.array([max(1, len(_bytes(t))) for t in texts])[:, None] if texts else np.ones((0, 1))
        mean = np.exp(out / length)
        return mean / mean.sum(1, keepdims=True)


def train(samples: DataFrame, weak: DataFrame | None = None, weak_rows: int = 70, hidden: int = 24) -> ByteGRU:
    """A network trained on correct samples (``lang``, ``text``), at most 5,000 of them.

    With ``weak``, sentences of at most ``weak_rows`` rows labelled with each language (``doc_id``, ``lang``, ``text``;
    three times that for English, the most varied; those with the smallest hash of the id) are added where a first
    network, trained on the samples alone, agrees with their label, or is unsure and nothing else in the text speaks
    against the label. The fitted weights are kept in the shared folder under a hash of all they come from, and read
    from there the next time.
    """
    rows = [r for r in samples.where("text is not null").orderBy(F.xxhash64("text")).limit(5000).collect() if label_of(r["lang"])]
    more = []
    if weak is not None:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
        some = weak.where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull()).select("lang", "text", "doc_id", place.alias("nth"))
        more = some.where(F.col("nth") <= F.when(F.col("lang") == "en", 3 * weak_rows).otherwise(weak_rows)).orderBy("lang", "nth").select("lang", "text").collect()
    content = json.dumps([FIT, hidden, [(r["lang"], r["text"]) for r in rows], [(r["lang"], r["text"]) for r in more]])
    path = f"{shared_dir(samples.sparkSession)}/langid-{hashlib.sha256(content.encode()).hexdigest()[:24]}"
    return _kept(samples.sparkSession, path, hidden) or _keep(samples.sparkSession, path, _fitted(rows, more, hidden))


def _keep(spark, path: str, net: ByteGRU) -> ByteGRU:
    rows = [(k, list(v.shape), v.astype("f4").tobytes()) for k, v in net.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return net


def _kept(spark, path: str, hidden: int) -> ByteGRU | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    net = ByteGRU(hidden)
    net.p = {r["name"]: np.frombuffer(bytes(r["data"]), "f4").reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
    return net


def _fitted(rows: list, more: list, hidden: int) -> ByteGRU:
    texts, labels = [], []
    for r in rows:
        for _, s in sentences(r["text"]) or [(0, r["text"])]:
            texts.append(s)
            labels.append(label_of(r["lang"]))
    net = ByteGRU(hidden).fit(texts, labels, epochs=7)
    if not more:
        return net
    for r in more:
        lang = label_of(r["lang"])
        some = [s for _, s in sentences(r["text"])]
        if lang is None or not some:
            continue
        prob = net.probabilities(some)
        own = prob[:, LANGS.index(lang)]
        steady = prob.max(1)
        against = ((prob.argmax(1) != LANGS.index(lang)) & (steady > 0.9)).any()
        for s, p in zip(some, own):
            if p > 0.5 or not against:
                texts.append(s)
                labels.append(lang)
    return ByteGRU(hidden).fit(texts, labels, epochs=7)


def languages_of(net: ByteGRU, texts: list[str | None], sure: float = 0.9) -> list[tuple[str | None, float, list[tuple]]]:
    """``(lang, confidence, segments)`` of each text; a segment is ``(start, lang, whole sentences, confidence)``.

    A document's probabilities are pooled over all positions of all its prose (a geometric mean), and ``lang`` is the most
    likely one with its pooled probability; a text without prose has no language and confidence 0. A sentence the network is
    not sure of (under ``sure``), and a piece that is no whole sentence, goes with the language of the document's other
    sentences unless that is next to excluded for it.
    """
    found = [stretches(t) for t in texts]
    flat = [s.text for some in found for s in some]
    codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, "i8"), [])
    prob = net.probabilities(list(unique))[codes] if flat else np.empty((0, len(LANGS)))
    out, n = [], 0
    for some in found:
        own, n = prob[n : n + len(some)], n + len(some)
        if not len(own):
            out.append((None, 0.0, []))
            continue
        log = np.log(own + 1e-9)
        size = np.array([len(s.text) for s in some])[:, None]
        pooled = np.exp((log * size).sum(0) / size.sum())
        pooled /= pooled.sum()
        whole = np.array([s.whole for s in some])
        firm = own.max(1) >= sure
        basis = whole & firm if (whole & firm).any() else whole if whole.any() else firm if firm.any() else np.ones(len(some), bool)
        main = log[basis].sum(0).argmax()
        best = own.argmax(1)
        words = np.array([len(_LETTERS.findall(s.text)) for s in some])
        weak = (own.max(1) < sure) | (~whole & (words < 4)) | (words < 4) & (own.max(1) < 0.98)
        best[weak & ((own[:, main] >= 0.05) | (words < 4))] = main
        segs: list[list] = []
        for k, s in enumerate(some):
            if not segs or segs[-1][1] != LANGS[best[k]]:
                segs.append([s.start, LANGS[best[k]], 0, []])
            segs[-1][2] += int(s.whole)
            segs[-1][3].append(own[k, best[k]])
        out.append((LANGS[int(pooled.argmax())], float(pooled.max()), [(a, lang, w, float(np.mean(p))) for a, lang, w, p in segs]))
    return out


def segments(df: DataFrame, net: ByteGRU, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sure: float = 0.9) -> DataFrame:
    """``(doc_id, seg, start_pos, lang, sentences, confidence, given)``: each stretch of prose in one language, from seg 1 on.

    ``given`` is the language the label names, if any; ``sentences`` counts whole sentences. Row 0 of each document has its
    most likely language with its pooled probability; null, blank and code-only texts have that row alone, with a null
    language and confidence 0. Null ids have no rows; repeated rows give repeated segments.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(net)
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2000):
                frame = whole.iloc[at : at + 2000]
                rows = []
                for i, label, (lang, confidence, segs) in zip(frame.i, frame.l, languages_of(shared.value, list(frame.t), sure)):
                    given = label_of(label)
                    rows.append((i, 0, 0, lang, sum(s[2] for s in segs), confidence, given))
                    rows += [(i, k, *s, given) for k, s in enumerate(segs, 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "seg", "start_pos", "lang", "sentences", "confidence", "given"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l"))
    return spread(rows).mapInPandas(run, f"doc_id {kind}, seg int, start_pos int, lang string, sentences int, confidence double, given string")


def document_languages(segs: DataFrame) -> DataFrame:
    """``(doc_id, lang, confidence, languages, is_case)``: each document's language and whether its label fails.

    ``languages`` are those of at least one whole sentence, in order; a document is a case if there are any and its label
    does not name the only one.
    """
    docs = segs.groupBy("doc_id").agg(
        F.max(F.when(F.col("seg") == 0, F.struct(F.col("confidence"), F.col("lang")))).alias("main"),
        F.array_sort(F.collect_set(F.when((F.col("seg") > 0) & (F.col("sentences") > 0), F.col("lang")))).alias("languages"),
        F.max("given").alias("given"),
    )
    one = (F.size("languages") == 1) & F.coalesce(F.col("given") == F.try_element_at("languages", F.lit(1)), F.lit(False))
    return docs.select("doc_id", F.col("main.lang").alias("lang"), F.col("main.confidence").alias("confidence"), "languages", ((F.size("languages") > 0) & ~one).alias("is_case"))


def label_cases(segs: DataFrame) -> DataFrame:
    """``(doc_id, lang)``: for each document whose label is missing, wrong or not the only language, all that count."""
    return document_languages(segs).where("is_case").select("doc_id", F.explode("languages").alias("lang"))
