"""Personal information in free text: where it is, and the text with keyed surrogates in its place."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.session import materialize, spread

_S = r"[ \u00a0\u202f\u2009]"
_D = r"[-\u2010\u2011\u2012\u2013]"
_SEP = rf"(?:{_S}|{_D}|\.)"
_END = r"(?![\w])"
_BEGIN = r"(?<![\w+])"

EMAIL = re.compile(
    r"(?<![\w.+%-])[\w.+%-]+(?:@|\uff20|[ ]?\(@\)[ ]?|[ ]?[\[(](?:at|AT)[\])][ ]?)(?:[\w-]+(?:\.|[ ]?[\[(](?:dot|DOT)[\])][ ]?|[ ]dot[ ]))+[^\W\d_]{2,}"
    r"|(?<![\w.+%-])[\w.+%-]+[ ](?:at|AT)[ ][\w-]+(?:[ ](?:dot|DOT)[ ][\w-]+)+"
)
#: A login in the address of a repository: user@host:path, or behind a scheme.
_LOGIN = re.compile(r":[\w~/.-]")

PHONE = re.compile(
    rf"{_BEGIN}(?:"
    rf"(?:\+|00)\d{{1,3}}{_SEP}?(?:\(0?\d{{0,4}}\){_SEP}?)?\d{{1,4}}(?:(?:{_SEP}|/)?\d{{2,6}}){{1,5}}"  # international
    rf"|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}"  # area code in brackets
    rf"|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}"
    rf"|0\d{{2,4}}/\d{{3,8}}(?:{_D}\d{{1,5}})?"
    rf"|0\d(?:{_SEP}\d{{2}}){{4}}"
    rf"|0\d{{2,4}}{_SEP}\d{{3,4}}{_SEP}?\d{{3,4}}"
    rf"){_END}"
)
_ID_FORMS = rf"""
    \d{{3}}(?:{_D}\d\d{_D}|{_S}\d\d{_S})\d{{4}}
  | P<[A-Z]{{2,3}}[A-Z0-9]{{6,9}}
  | [A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]
  | [A-Z]{{2}}\d\d(?:{_S}?\d{{4}}){{3,7}}(?:{_S}?\d{{1,4}})?
  | [12]{_S}?\d\d{_S}?\d\d{_S}?\d[\dAB]{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d\d
  | [XYZ]{_D}?\d{{7}}(?:{_D}?[A-Z])?
  | \d{{8}}{_D}?[A-Z]
"""
ID_NUMBER = re.compile(rf"(?<![\w-])(?:{_ID_FORMS})(?![\w]|-\w)", re.VERBOSE)
#: Bare digits are a person's number only behind words that say so.
BARE_ID = re.compile(
    r"(?i:\b(?:ssn|social[ ]security|tax[ ]id|passport|national[ ]id|the[ ]ID|ausweis\w*|pass(?:nummer)?|documento|dni|nie|s[ée]cu\w*|bsn|nif|steuer\w*)[^\w\n]{0,3}(?:(?:no|nr|num|number|nummer)?[.:]?[ ]?)?)(\d{8,11})(?![\w]|-\w)"
    r"|\"(\d{9})\""
)
_NOT_ID = re.compile(r"(?i)(?:order|sku|part|invoice|serial|model|version|build|ticket|trace|sha)\b[^\d\n]{0,12}$")

_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’.-]*"
_LINK = r"(?:de|del|de[ ]la|de[ ]los|de[ ]las|la|las|los|el|du|des|le|les|da|do|dos|van|der|den|dem|het|am|im|zum|zur|an|auf|of|the|und|y|d'|l')"
_CITY = rf"{_CAP}(?:[ -](?:{_LINK}[ ])?{_CAP}){{0,3}}"
_STREET = r"(?:St\.|St|Street|Rd\.?|Road|Lane|Ln\.?|Avenue|Ave\.?|Court|Ct\.?|Crescent|Hill|Approach|Drive|Dr\.?|Way|Close|Place|Row|Square|Terrace|Gardens|Boulevard|Blvd\.?|Walk|Mews|Parade|Grove)"
_VOIE = r"(?:rue|avenue|av\.|chemin|boulevard|bd|place|impasse|all[ée]e|quai|route|cours|passage|square|sentier|faubourg)"
ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\w+,[ ]?)?\b\d+[a-zA-Z]?[ ](?:{_CAP}[ ]){{1,4}}?{_STREET}[,\n][ ]?{_CITY}(?:,?[ ]\w{{2}})?[ ](?:\d{{4,6}}|[A-Z]{{1,2}}\d[\dA-Z]?[ ]\d[A-Z]{{2}})"
    rf"|(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\w+,[ ]?\d+[a-zA-Z]?[ ]{_CAP}(?:[ ]{_CAP}){{0,4}}[,\n][ ]?{_CITY}[ ](?:\d{{4,6}}|[A-Z]{{1,2}}\d[\dA-Z]?[ ]\d[A-Z]{{2}})"
    rf"|\b(?:P\.?[ ]?O\.?[ ]?Box|Postfach|Apartado|BP|Postbus)[ ]\d+,[ ]?(?:\d{{4,6}}[ ]{_CITY}|{_CITY}[ ]\d{{4,6}})"
    rf"|\b\d+(?:[ ](?:bis|ter|quater))?,?[ ]{_VOIE}[ ](?:{_LINK}[ ]?){{0,2}}{_CAP}(?:[ -](?:{_LINK}[ ])?{_CAP}){{0,3}},[ ]\d{{5}}[ ]{_CITY}"
    rf"|{_BEGIN}{_CAP}(?:[ ](?:(?:{_LINK}[ ]){{1,2}})?{_CAP}|[ ](?:{_LINK}[ ]){{1,2}}{_CAP}){{0,4}}[ ]\d+[ ]?[a-zA-Z]?,[ ](?:\d+[ºªo°]?[ ]?[A-Z]?,[ ])?\d{{4,5}}(?:[ ][A-Z]{{2}})?[ ]{_CITY}"
)

# A name has two parts or more: given name or initial and family name, in either order, in any case.
_PART = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_OF = r"(?:(?i:van|von|de|der|den|del|la|di|da|dos|al|el|bin|ter|ten)[ ]){0,3}"
_NAME = rf"{_OF}{_PART},[ ](?:{_PART}|[^\W\d_]\.)(?:[ ][^\W\d_]\.)?|(?:[^\W\d_]\.|{_PART})(?:[ ][^\W\d_]\.)?[ ]{_OF}{_PART}"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra|Mme|M)\.?[ ])?"
#: What stands around a name: words before it and what follows.
_AROUND = [
    (r"(?:^|[\s>])(?:fwd[ ]from|forwarded[ ]by)[ ]", r"[ ](?:&lt;|<)"),
    (r"\bthis[ ]is[ ]", r"[ ]from[ ]"),
    (r"\blooks[ ]like[ ]", r"[ ]and[ ]"),
    (r"\bbadge[ ]to[ ]", r",[ ]"),
    (r"\blunch[ ]with[ ]", r"[ ]moved\b"),
    (r"\bfor[ ]the[ ]record,[ ]", r"[ ]lives[ ]at\b"),
    (r"\(belongs[ ]to[ ]", r"\)"),
    (r"\bdump:[ ]\"", r"\""),
    (r"\bcontact[ ]for[ ]", r"\?"),
    (r"\bkudos[ ](?:to[ ])?", r"(?:[ ]:|$)"),
    (r"\b(?:Regards|Cheers|Thanks),\n", r"(?:\n|$)"),
    (r"\bGr(?:ü|ue|u\u0308)(?:ß|ss)en?,?\n", r"(?:\n|$)"),
    (r"\b(?:Cordialement|Saludos|Cumprimentos|Groeten),[ \n]", r"(?:[\n.]|$)"),
    (r"\b(?:hier[ ]ist|mein[ ]Name[ ]ist)[ ]", r"[,.]"),
    (r"\b(?:soy|me[ ]llamo)[ ]", r"[,.]"),
    (r"\b(?:je[ ]suis|je[ ]m'appelle)[ ]", r"[,.]"),
    (r"\"(?:reporter|name|author|assignee)\":[ ]?\"", r"\""),
    (r"\bonboarding:[ ]", r",[ ][^\s,]+"),
    (r"(?:^|[\s(])", r"[ ]signed[ ]off\b"),
    (r"(?:^|\n)--[ ]", r",[ ]on[ ]call\b"),
    (r"\bopened[ ]by[ ]", r";"),
    (r"(?:^|\n)", r"[ ]/[ ][+(\d]"),
    (r"(?:^|\n)", r"[ ]asked[ ]why\b"),
    (r"\bAsk[ ]", r"[ ]about[ ]it\b"),
    (r"\bPregunten[ ]a[ ]", r"(?:\.|$)"),
    (r"[.!?][ ]\(", r"\)$"),
]
NAMES = [(re.compile(rf"{before}{_TITLE}(?P<name>{_NAME})(?={after})"), before) for before, after in _AROUND]
_SECOND = re.compile(rf"[ ]and[ ]{_TITLE}(?P<name>{_NAME})(?=[ ]both\b)")
#: Words that take part in names of teams, roles and products.
_NO_NAME = re.compile(r"(?i)\b(?:admin|team|project|gateway|cluster|studio|console|theme|support|desk|bot|service|server|street|the|each|and)\b")
_ANCHOR = re.compile(r"(?i)fwd|forwarded|this is|looks like|badge|lunch|record|belongs|dump|contact|kudos|regards|cheers|thanks,|gr(?:ü|ue|ü)|cordialement|saludos|cumprimentos|groeten|hier ist|name|soy|llamo|je |reporter|author|assignee|onboarding|signed|on call|opened|asked| / |ask |pregunten|\)$")

KINDS = ("email", "phone", "id_number", "address", "name")

# Names in any setting: capitalised candidates, scored by what they are made of and what stands around them.
#: Common given names, female and male, of the six languages.
FEMALE = frozenset("""anna maria laura julia sarah sara emma lena lisa eva clara sofia sophia sophie marie claire camille chloé alice louise
jeanne élodie nathalie isabelle catherine elena lucía carmen isabel pilar marta paula ana beatriz inês joana rita catarina teresa mariana sanne
anouk femke fleur ingrid katrin sabine petra monika ursula heike anke birgit mary jennifer linda elizabeth susan jessica karen nancy emily olivia
grace hannah rachel rebecca helen martha ruth diana valentina gabriela fatima aisha mei yuki priya olga natalia irina tatiana svetlana""".split())
MALE = frozenset("""john james robert michael william david richard thomas charles daniel matthew anthony mark paul steven andrew george kevin brian
edward peter hans klaus jürgen wolfgang stefan andreas markus felix lukas max jan jonas tim pierre jean jacques michel philippe nicolas luc antoine
olivier josé juan carlos luis antonio manuel javier miguel pedro pablo diego fernando alejandro joão paulo tiago rui nuno ricardo bruno daan sem
lars bram sven erik joost pieter willem henk ahmed ali omar mohammed wei hiroshi raj ivan dmitri sergei igor boris""".split())
_TITLES = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herrn?|Frau|Sr|Sra|Señora?|Don|Doña|Mme|Mlle|Monsieur|Madame|Dhr|Mevr|Mevrouw|Meneer|Dona|Senhora?)\.?"
_UP = r"(?:[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*)"
_INITIAL = r"(?:[^\W\d_a-zß-öø-ÿ]\.)"
_PARTICLES = frozenset("van von de der den del la di da dos al el bin ter ten du le".split())
_PARTICLE = r"(?:(?:van|von|de|der|den|del|la|di|da|dos|al|el|bin|ter|ten|du|le)[ ]){0,3}"
CANDIDATE = re.compile(
    rf"(?<![\w@./#<-])(?:(?P<inv>{_UP}),[ ](?P<invgiven>{_UP}|{_INITIAL})(?:[ ]{_INITIAL})?"
    rf"|(?P<given>{_INITIAL}|{_UP})(?:[ ](?:{_INITIAL}|{_UP}))?[ ]{_PARTICLE}(?P<family>{_UP}))(?![\w@]|\.\w|-\w)"
)
_STRONG = re.compile(
    r"(?i)(?:\b(?:(?:asked|ask|called|call|met|meet|contact|contacted|emailed|email|ping|pinged|tell|told|dear|hi|hello|hey|thanks|cc|attn|author|reporter|assignee|owner|colleague|engineer|manager|lawyer|doctor)"
    r"|(?:(?:re)?viewed|approved|signed|written|reported|opened|assigned|filed|forwarded|sent|owned|led|booked|merged|fixed|tested|handled)[ ](?:by|from|to)"
    r"|(?:met|meeting|lunch|speak|spoke|talk|talked|call|chat|chatted|work|worked|working|pair|paired|sync|synced|appointment|interview)[ ](?:with|to)|on[ ]behalf[ ]of|(?:my[ ])?name[ ]is|i[ ]am|i['’]m|this[ ]is|kudos[ ]to|thanks[ ]to"
    r"|kollegin|kollege|liebe|lieber|hallo|hier[ ]ist|mein[ ]name[ ]ist|ich[ ]bin|ansprechpartner(?:in)?(?:[ ]ist)?|(?:geprüft|genehmigt|erstellt|unterschrieben|gemeldet)[ ]von|termin[ ]mit"
    r"|bonjour|cher|chère|contacter|(?:vu|signé|approuvé|rédigé|envoyé)[ ]par|je[ ]suis|je[ ]m['’]appelle|rendez-vous[ ]avec"
    r"|hola|estimad[oa]|soy|me[ ]llamo|pregunten?[ ]a|contactar[ ](?:a|con)|hablar[ ]con|(?:aprobado|firmado|revisado|escrito)[ ]por"
    r"|olá|car[oa]|falar[ ]com|chamo-me|sou[ ][oa]|(?:aprovado|assinado|revisto|escrito)[ ]por|beste|vraag[ ](?:het[ ])?(?:aan)?|ik[ ]ben|(?:goedgekeurd|geschreven|getekend)[ ]door)[ ,:]*[ ])$"
)
_WEAK = re.compile(r"(?i)\b(?:by|with|from|for|to|von|mit|bei|für|an|par|avec|pour|chez|con|por|para|com|door|met|voor|aan|and|und|et|y|e|en)[ ]$")
_BEHIND = re.compile(
    r"(?i)(?:,)?[ ](?:(?:has|had)[ ](?:asked|said|joined|left|written|signed|confirmed|approved|moved)|asked|asks|said|says|wrote|writes|called|calls|confirmed|approved|reviewed|signed|reported|replied|lives|works|joined|left[ ]the|agreed|mentioned|thinks|complained|resigned|will[ ](?:call|join|send|ask|be)"
    r"|hat[ ](?:gesagt|gefragt|geschrieben|unterschrieben)|sagt|sagte|fragt|fragte|schreibt|meint|wohnt|a[ ](?:dit|demandé|écrit|signé|confirmé)|habite|écrit[ ]que|dijo|preguntó|escribió|vive[ ]en|disse|perguntou|escreveu|mora[ ]em|zei|vroeg|schrijft|woont)\b"
    r"|(?:['’]s[ ](?:desk|laptop|phone|number|email|address|team|manager|passport|account)\b)|[ ]?(?:<|&lt;|\()[\w.+-]+@|[ ]?[/|][ ]?\+?\(?\d"
)
_CLOSING = re.compile(r"(?i)(?:regards|cheers|thanks|thank you|best|sincerely|grü(?:ß|ss)en?|gruß|cordialement|bien à vous|saludos|atentamente|cumprimentos|atenciosamente|groeten|groetjes|mvg)[ ,.!]*\s*\n\s*(?:--\s*)?$")
#: Capitalised words that start sentences or name things, never people.
_NOT_PART = frozenset("""the this that these those there when where what which while with without please bitte danke and but for from after before since
until every each some any all our your their his her its new old first last next main open closed error warning note todo see using user users admin
der die das den dem ein eine wenn vor nach seit bei mit für und oder aber nicht danach deshalb trotzdem am im in zum zur viele es
le la les un une des du si dans pour avec sans après avant depuis quand el los las una unos por para con sin desde cuando como o os as um uma
de het een als voor na bij met en of maar monday tuesday wednesday thursday friday saturday sunday january february march april june july august
september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi lunes martes
team project projekt gateway cluster studio console theme support desk bot service server street road avenue lane city park harbour harbor river lake
mount north south east west united states kingdom university institute college school hospital bank company inc corp ltd gmbh group office department
windows linux android chrome python java google microsoft apple amazon slack github cloud data machine learning product release version build api""".split())


def _general_names(text: str) -> Iterator[tuple[int, int]]:
    """Places of names by evidence: titles, given names, initials, what is done with people and what people do, signatures."""
    last_end = -1
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        given, family = (m["invgiven"], m["inv"]) if m["inv"] else (m["given"], m["family"])
        words = re.findall(r"[^\W\d_]+", m[0])
        low = [w.lower() for w in words]
        before = text[max(0, start - 48) : start]
        if not m["inv"] and low[0] not in MALE | FEMALE and len(words) > 2 and (_STRONG.search(f"{before}{words[0]} ") or low[0] in _NOT_PART or re.fullmatch(_TITLES, words[0])):
            start += len(m[0].split(" ")[0]) + 1  # a word of the sentence, not of the name
            before, words, low = text[max(0, start - 48) : start], words[1:], low[1:]
            given = words[0]
        if sum(w not in _PARTICLES for w in words) < 2 or any(w.lower() in _NOT_PART and w not in _PARTICLES for w in words) or _NO_NAME.search(m[0]):
            continue
        if (after := re.match(r"[ -]([^\W\d_]+)", text[end:])) and after[1].lower() in _NOT_PART and after[1][0].isupper():
            continue  # part of a longer name of a thing
        score = 0
        if title := re.search(rf"(?:^|[\s(,]){_TITLES}[ ]$", before):
            score += 2
        if given.rstrip(".").lower() in MALE or given.rstrip(".").lower() in FEMALE:
            score += 2
        if len(given.rstrip(".")) == 1:
            score += 1
        cue = before if not title else before[: title.start() + 1]
        score += 2 if _STRONG.search(cue) else 1 if _WEAK.search(cue) else 0
        if re.search(r"(?:and|und|et|y|e|en)[ ]$", before) and last_end >= start - 6:
            score += 2
        score += 2 if _BEHIND.match(text, end) else 0
        if _CLOSING.search(text[max(0, start - 60) : start]) and re.match(r"\s*(?:\n|$|,|\.)", text[end:]):
            score += 2
        if re.search(r"(?i)(?:\bthe|\bin|\bnear|\bof|\bproject|\bversion)[ ]$", before) and not title:
            score -= 2
        if score >= 2:
            last_end = end
            yield start, end


class Item(NamedTuple):
    kind: str
    start: int
    end: int


def find_items(text: str | None) -> list[Item]:
    """The items of personal data in a text, in order and without overlaps; a null or empty text has none."""
    if not text:
        return []
    taken: list[Item] = []

    def take(kind: str, start: int, end: int) -> None:
        if all(end <= t.start or start >= t.end for t in taken):
            taken.append(Item(kind, start, end))

    if "@" in text or "\uff20" in text or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            before = text[max(0, m.start() - 3) : m.start()]
            if _LOGIN.match(text, m.end()) or before == "://" or text[m.start() : m.end()].startswith(("git@", "hg@")):
                continue
            take("email", m.start(), m.end())
    if re.search(r"\d", text):
        for m in ADDRESS.finditer(text):
            take("address", m.start(), m.end())
        for m in ID_NUMBER.finditer(text):
            if not _NOT_ID.search(text[max(0, m.start() - 24) : m.start()]):
                take("id_number", m.start(), m.end())
        for m in BARE_ID.finditer(text):
            group = 1 if m.group(1) else 2
            take("id_number", m.start(group), m.end(group))
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 16 and not _NOT_ID.search(text[max(0, m.start() - 24) : m.start()]):
                take("phone", m.start(), m.end())
    if _ANCHOR.search(text):
        for pattern, _ in NAMES:
            for m in pattern.finditer(text):
                if not _NO_NAME.search(m["name"]):
                    take("name", m.start("name"), m.end("name"))
        if " both " in text:
            for m in _SECOND.finditer(text):
                take("name", m.start("name"), m.end("name"))
    if CANDIDATE.search(text):
        for start, end in _general_names(text):
            take("name", start, end)
    return sorted(taken, key=lambda t: t.start)


def personal_items(df: DataFrame, table_name: str, id_col: str, text_col: str) -> DataFrame:
    """``(table_name, row_id, kind, start_pos, end_pos, item)``: one row for each item in a text.

    Positions are 0-based code points. Null ids, null and empty texts give none; repeated rows give repeated
    items. Whole texts are searched, and nothing is shuffled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(table_name, i, t.kind, t.start, t.end, text[t.start : t.end]) for i, text in zip(frame.i, frame.t) for t in find_items(text)]
            yield pd.DataFrame(rows, columns=["table_name", "row_id", "kind", "start_pos", "end_pos", "item"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    return spread(rows).mapInPandas(run, "table_name string, row_id bigint, kind string, start_pos int, end_pos int, item string")


# ---- surrogates

#: Syllables of made-up words by script; the first is Latin. The first letter of each script's block and its last.
_SYLLABLES = {
    ("\u0000", "\u024f"): ("b br d f g gr h k l m n p r s t v w z", "a e i o u ia ei", "n r l s m nd rt ck"),
    ("\u0400", "\u04ff"): ("б бр д ф г гр к л м н п р с т в з", "а е и о у я", "н р л с м нд рт к"),
    ("\u0370", "\u03ff"): ("β δ γ κ λ μ ν π ρ σ τ φ χ", "α ε ι ο η ω", "ν ρ λ"),
    ("\u0590", "\u05ff"): ("ב ג ד ה ל מ נ ר ש ת", "א ו י", "ן ר ל"),
    ("\u0600", "\u06ff"): ("ب د ر س ف ل م ن ه", "ا و ي", "ن ر ل"),
}
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letters by remainder


class _Keyed:
    """A stream of numbers fixed by key, kind, unit and attempt."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.at, self.pool = key, "\x1f".join(what), 0, b""

    def pick(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, f"{self.what}\x1f{self.at}".encode(), hashlib.sha256).digest()
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


def _plain(item: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", item).lower()).strip()


def units_of(kind: str, item: str) -> list[str]:
    """What of a mention gets a surrogate of its own, the same for all mentions of an entity.

    Of a name each word but particles and initials, so that family names stay common to relatives and to short and
    reversed forms; of the other kinds the whole item without its spelling.
    """
    low = _plain(item)
    if kind == "name":
        return list(dict.fromkeys(w for w in re.findall(r"[^\W\d_]+", low) if len(w) > 1 and w not in _PARTICLES))
    if kind == "email":
        low = re.sub(r"\s*[\[(]?(?:@|\uff20|\bat\b)[\])]?\s*", "@", low, count=1)
        return [re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", low)]
    if kind == "phone":
        digits = re.sub(r"\D", "", low.replace("(0)", ""))
        return [digits[2:] if low.startswith("00") else digits]
    if kind == "id_number":
        return [re.sub(r"[^0-9a-z]", "", low)]
    return [low]


def _letter(key: bytes, letter: str) -> str:
    """The first letter that names beginning with ``letter`` get: a keyed permutation, so initials agree with full names."""
    letters = sorted("bdfghklmnprstvwz" + "aeiou" + "cjqxy")
    order = sorted(letters, key=lambda c: hmac.new(key, f"initial{c}".encode(), hashlib.sha256).digest())
    at = unicodedata.normalize("NFD", letter.lower())[0]
    return order[letters.index(at)] if at in letters else letter.lower()


def _word(key: bytes, kind: str, word: str, attempt: int) -> str:
    """A made-up word in the script of ``word``; a name keeps the keyed initial and, ending in a vowel, ends in one."""
    rng = _Keyed(key, kind, word, str(attempt))
    low = next((s for (a, b), s in _SYLLABLES.items() if a <= word[0] <= b), _SYLLABLES["\u0000", "\u024f"])
    onsets, vowels, codas = (x.split() for x in low)
    latin = "\u0000" <= word[0] <= "\u024f"
    count = 2 + attempt // 3
    out = "".join(onsets[rng.pick(len(onsets))] + vowels[rng.pick(len(vowels))] for _ in range(count))
    female = word in FEMALE or (word not in MALE and word[-1] in "aαая")
    if kind == "name" and latin:
        out = _letter(key, word[0]) + (vowels[rng.pick(5)] if _letter(key, word[0]) not in "aeiou" else "") + out
        return out + ("na" if female else "o" if word[-1] in "oi" else codas[rng.pick(len(codas))])
    return out if female else out + codas[rng.pick(len(codas))]


def unit_surrogate(kind: str, unit: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of one unit in the unit's own spelling, fixed by the key and the attempt."""
    rng = _Keyed(key, kind, unit, str(attempt))
    if kind == "name":
        return _word(key, kind, unit, attempt)
    if kind == "email":
        return f"{_word(key, 'local', unit, attempt)}{rng.pick(10**4)}@{_word(key, 'domain', unit.partition('@')[2], 0)}.example"
    if kind == "phone":
        keep = 2 if len(unit) > 10 else 0
        return unit[:keep] + "".join(str(rng.pick(10)) for _ in unit[keep:])
    if kind == "id_number":
        new = "".join(str(rng.pick(10)) if c.isdigit() else c for c in unit)
        if re.fullmatch(r"[a-z]{2}\d\d[0-9a-z]{10,30}", unit):  # with valid check digits
            value = int("".join(str(int(c, 36)) for c in new[4:] + new[:2] + "00"))
            new = f"{new[:2]}{98 - value % 97:02d}{new[4:]}"
        elif re.fullmatch(r"\d{8}[a-z]", unit):
            new = new[:8] + _DNI[int(new[:8]) % 23].lower()
        return new
    words = {w: _word(key, "place", w, attempt) for w in set(re.findall(r"[^\W\d_]{5,}", unit))}
    return re.sub(r"\d|[^\W\d_]{5,}", lambda m: words.get(m[0]) or str(1 + rng.pick(9)), unit)


def _dress(word: str, like: str) -> str:
    """Case as in the original."""
    return word.upper() if like.isupper() and len(like) > 1 else word if like.islower() else word[:1].upper() + word[1:]


def put_surrogates(kind: str, item: str, new: dict[str, str], key: bytes) -> str:
    """A mention with the surrogates of its units in it, in the mention's spelling: case, order, separators, initials."""
    if kind == "name":
        nfc = unicodedata.normalize("NFC", item)
        one = lambda m: m[0] if m[0].lower() in _PARTICLES else _letter(key, m[0]).upper() if len(m[0]) == 1 and m[0].isupper() else _dress(new.get(m[0].lower(), m[0].lower()), m[0])
        return re.sub(r"[^\W\d_]+", one, nfc)
    [unit] = units_of(kind, item)
    value = new.get(unit, unit)
    if kind == "email":
        m = re.search(r"@|\uff20|\s*\(@\)\s*|\s*[\[(](?:at|AT)[\])]\s*|\s+(?:at|AT)\s+", item)
        local, _, domain = value.partition("@")
        dot = re.search(r"\s*[\[(](?:dot|DOT)[\])]\s*|\s+(?:dot|DOT)\s+", item)
        return local + (m[0] if m else "@") + domain.replace(".", dot[0] if dot else ".")
    if kind in ("phone", "id_number"):
        left = list(value)
        free = re.sub(r"\(0\)", lambda m: "(\x00)", item)
        head = 2 if kind == "phone" and free.startswith("00") else 0
        out = item[:head]
        for c in free[head:]:
            take = c.isdigit() if kind == "phone" else c.isascii() and c.isalnum()
            out += (left.pop(0).upper() if c.isupper() else left.pop(0)) if take and left else c
        return out.replace("\x00", "0")
    parts = iter(re.findall(r"\d|[^\W\d_]+", value))
    return re.sub(r"\d|[^\W\d_]+", lambda m: _dress(next(parts, m[0]), m[0]), unicodedata.normalize("NFC", item))


def _units(items: DataFrame) -> DataFrame:
    """Every item with each of its units, one row for each."""

    @F.pandas_udf(ArrayType(StringType()))
    def of(kind: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([units_of(k, i) for k, i in zip(kind, item)])

    return items.withColumn("unit", F.explode_outer(of("kind", "item")))


def surrogate_table(items: DataFrame, key: bytes) -> DataFrame:
    """``(kind, unit, surrogate)``: for every unit found a surrogate that no other unit has and no original is.

    Units whose surrogate is taken (of several the smallest unit keeps it) or equals an original try the next one, for as
    many rounds as it takes; surrogates grow with the attempts. Works on distinct units, none is sent to the driver.
    """

    @F.pandas_udf(StringType())
    def make(kind: pd.Series, unit: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([unit_surrogate(k, u, key, n) for k, u, n in zip(kind, unit, attempt)])

    left = materialize(_units(items).where("unit is not null").select("kind", "unit").distinct(), "units")
    originals = left.select("kind", F.col("unit").alias("surrogate"))
    left, done, attempt = left.withColumn("attempt", F.lit(0)), None, 0
    while True:
        tried = left.withColumn("surrogate", make("kind", "unit", "attempt"))
        taken = originals if done is None else originals.unionByName(done.select("kind", "surrogate"))
        tried = tried.join(taken.withColumn("taken", F.lit(True)).distinct(), ["kind", "surrogate"], "left")
        first = tried.groupBy("kind", "surrogate").agg(F.min("unit").alias("first"))
        judged = materialize(tried.join(first, ["kind", "surrogate"]).withColumn("wins", F.col("taken").isNull() & (F.col("first") == F.col("unit"))), "surrogates")
        won = judged.where("wins").select("kind", "unit", "surrogate")
        done = won if done is None else done.unionByName(won)
        attempt += 1
        left = judged.where("not wins").select("kind", "unit", F.lit(attempt).alias("attempt"))
        if not left.limit(1).count():
            return done


def replace_items(df: DataFrame, table_name: str, id_col: str, text_col: str, key: bytes = b"quillspark", surrogates: DataFrame | None = None) -> DataFrame:
    """``(table_name, row_id, text)``: the texts with each item replaced and all else unchanged, each row once.

    Without ``surrogates`` an item becomes a typed placeholder (``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``,
    ``[NAME]``); with a table from ``surrogate_table`` it becomes a keyed surrogate of its kind and format. Null texts stay
    null and texts without items are returned as they are.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["row_id"])
    if surrogates is None:

        @F.pandas_udf(StringType())
        def plain(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: _splice(t, [(i.start, i.end, f"[{i.kind.upper()}]") for i in find_items(t)]), na_action="ignore")

        return rows.select(F.lit(table_name).alias("table_name"), "row_id", plain("text").alias("text"))
    rows = materialize(rows, "texts")
    items = _units(personal_items(rows, table_name, "row_id", "text"))
    found = items.join(surrogates, ["kind", "unit"], "left").groupBy("row_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "kind", "item", "unit", "surrogate")).alias("items"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, items in zip(frame["text"], frame["items"]):
                spans: dict = {}
                for i in items if items is not None else []:
                    spans.setdefault((i["start_pos"], i["end_pos"], i["kind"], i["item"]), {})[i["unit"]] = i["surrogate"]
                out.append(_splice(text, [(a, b, put_surrogates(kind, item, new, key)) for (a, b, kind, item), new in spans.items()]) if spans else text)
            yield pd.DataFrame({"table_name": table_name, "row_id": frame["row_id"], "text": out})

    return rows.join(found, "row_id", "left").mapInPandas(put, "table_name string, row_id bigint, text string")


def _splice(text: str, parts: list[tuple[int, int, str]]) -> str:
    for start, end, new in sorted(parts, reverse=True):
        text = text[:start] + new + text[end:]
    return text
