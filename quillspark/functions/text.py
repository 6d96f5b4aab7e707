"""Scalar functions on text, addresses, versions and vectors: columns where built-ins can say it, plain functions else."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that say nothing about a text's subject.
STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would shall should may might must can could i you he she it we they me him her
    us them my your his its our their this that these those am not no nor and but or if then else when at by for with about against between into through
    during before after above below to from up down in out on off over under again further once here there all any both each few more most other some
    such only own same so than too very just because as until while of""".split()
)
#: Languages of source files by extension or other name.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "python": "python", "javascript": "javascript", "typescript": "typescript", "golang": "go", "rust": "rust", "c++": "cpp", "csharp": "csharp", "ruby": "ruby",
}


def js_trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeezed(c: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return js_trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case terms of ASCII letters and digits, of ``least`` characters or more, without stop words."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) >= least) & ~t.isin(*stop))


def like_escape(text: str) -> str:
    """A text that LIKE (with ``\\`` as escape) takes literally."""
    return re.sub(r"([\\%_\[])", r"\\\1", text)


def like_any_word(c: Column, query: str) -> Column:
    """Whether any white-space separated word of the query stands in ``c``, A to Z in any case, patterns taken literally."""
    fold = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.lit(False)
    for word in query.split():
        found = found | F.contains(fold, F.lit("".join(ch.lower() if ch.isascii() else ch for ch in word)))
    return found


def query_words(query: str) -> list[str]:
    """The words of a full-text query: without column prefixes, outer wildcards and operators."""
    out = []
    for word in query.split():
        word = (word.split(":", 1)[1] if ":" in word else word).strip("*")
        if word and word.upper() not in ("NEAR", "AND", "OR", "NOT"):
            out.append(word)
    return out


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncated(c: Column, most: int = 80) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def title_from_url(url: Column) -> Column:
    """The last part of the path as words without its extension, else the host."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/?", "")
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]+)$", 1)
    words = js_trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))
    return F.when(F.length(words) > 0, words).otherwise(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def epoch_time(ts: Column) -> Column:
    """The time of ``seconds.fraction`` text; the epoch itself if it is no number."""
    return F.timestamp_seconds(F.coalesce(F.try_element_at(F.split(ts, r"\."), F.lit(1)).try_cast("bigint"), F.lit(0)))


def days_before(as_of: str, days: int) -> Column:
    return F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))


def fixed(c: Column, places: int) -> Column:
    """A number with a fixed number of decimals, as text."""
    return F.format_string(f"%.{places}f", c.cast("double"))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


# versions


def is_semver(c: Column) -> Column:
    return c.rlike(r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$")


def semver_key(c: Column) -> Column:
    """Orders versions by their numbers; a pre-release comes before its release."""
    part = lambda i: F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)", i).try_cast("bigint")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (~F.contains(c, F.lit("-"))).alias("release"), c.alias("text"))


def bump_patch(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)", i)
    return F.when(is_semver(c), F.concat_ws(".", part(1), part(2), (part(3).try_cast("bigint") + 1).cast("string")))


def pack_spec(c: Column) -> Column:
    """``name@version`` at its last @; one at the start belongs to the name."""
    at = F.length(c) - F.locate("@", F.reverse(c)) + 1
    has = (F.locate("@", c) > 0) & (at > 1)
    return F.struct(F.when(has, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("name"), F.when(has, F.substring(c, at + 1, F.length(c))).alias("version"))


def language_of(path: Column) -> Column:
    """The language of a source file by its extension, or of another name of it; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return known[F.lower(F.regexp_extract(path, r"([^./]+)$", 1))]


# plain functions


def sign(payload: str, secret: str) -> str:
    """HMAC-SHA256 of a payload, in hex."""
    return hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()


def _keystream(key: bytes, nonce: bytes, size: int) -> bytes:
    out = b""
    while len(out) < size:
        out += hashlib.sha256(key + nonce + len(out).to_bytes(8, "big")).digest()
    return out[:size]


def seal(text: str, secret: str, nonce: bytes) -> str:
    """A stored secret: encrypted with a key derived by scrypt and authenticated; ``unseal`` opens it."""
    key = hashlib.scrypt(secret.encode(), salt=nonce, n=2**12, r=8, p=1, dklen=64)
    body = bytes(a ^ b for a, b in zip(text.encode(), _keystream(key[:32], nonce, len(text.encode()))))
    return base64.b64encode(nonce + body + hmac.new(key[32:], nonce + body, hashlib.sha256).digest()).decode()


def unseal(sealed: str, secret: str) -> str:
    data = base64.b64decode(sealed)
    nonce, body, tag = data[:16], data[16:-32], data[-32:]
    key = hashlib.scrypt(secret.encode(), salt=nonce, n=2**12, r=8, p=1, dklen=64)
    if not hmac.compare_digest(tag, hmac.new(key[32:], nonce + body, hashlib.sha256).digest()):
        raise ValueError("the sealed text was changed or the secret is another one")
    return bytes(a ^ b for a, b in zip(body, _keystream(key[:32], nonce, len(body)))).decode()


def mrkdwn_to_markdown(text: str) -> str:
    """Chat markup to markdown; code stays as it is."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"```[\s\S]*?```", keep, text)
    text = re.sub(r"`[^`]+`", keep, text)
    text = re.sub(r"<#[A-Z0-9]+\|([^>]+)>", r"#\1", text)
    text = re.sub(r"<(https?://[^|>]+)\|([^>]+)>", r"[\2](\1)", text)
    text = re.sub(r"<(https?://[^>]+)>", r"\1", text)
    for mark, new in (("*", "**"), ("_", "*"), ("~", "~~")):
        m = re.escape(mark)
        text = re.sub(rf"(^|[\s(]){m}([^{m}\n]+){m}([\s).,!?]|$)", lambda x, n=new: f"{x[1]}{n}{x[2]}{n}{x[3]}", text)
    while "\x00" in text:
        text = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


def frontmatter(text: str) -> tuple[dict, str]:
    """The YAML head between lines of three dashes, with dates as ISO text, and the rest; no or a bad head is none."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    import yaml

    try:
        head = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, text
    if not isinstance(head, dict):
        return {}, text[m.end() :]
    iso = lambda v: v.isoformat() if hasattr(v, "isoformat") else [iso(x) for x in v] if isinstance(v, list) else v
    return {str(k): iso(v) for k, v in head.items()}, text[m.end() :]


# stemming (Porter's published algorithm)

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Vowels and consonants of a word as v and c; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + rules[end] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of an English word."""
    if len(word) <= 2:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


_TERM = re.compile(r"[^\W_]+")


def analyzed(text: str | None) -> list[str]:
    """Stemmed terms of a text in order, without accents and case."""
    if not text:
        return []
    folded = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return _TERM.findall(folded)


@F.pandas_udf(ArrayType(StringType()))
def stemmed_terms(texts: pd.Series) -> pd.Series:
    """``analyzed`` terms with their stems, batch by batch; each different word is stemmed once."""
    known: dict[str, str] = {}
    out = []
    for text in texts:
        terms = analyzed(text)
        for t in terms:
            if t not in known:
                known[t] = stem(t)
        out.append([known[t] for t in terms])
    return pd.Series(out)
