import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, personal
from quillspark.llm.leaks import leaked_items
from quillspark.llm.linkage import History, page_of, repeated_records
from quillspark.llm.neardup import group_pairs, near_duplicate_groups
from quillspark.llm.neighbours import nearest_neighbours
from quillspark.llm.split import Tree, pieces_of, split_items
from quillspark.llm.tokenize import ByteBPE, PerfectHash, encode_corpus, read_ranks
from quillspark.session import tokenizer_dir

WORDS = [f"w{i}" for i in range(400)]


def _texts(seed=1, groups=12, copies=4):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.choice([10, 30, 80, 200]))]
        for c in range(copies):
            edited = list(base)
            for _ in range(c * len(base) // 60):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            out.append((len(out) + 1, f"T{g}", " ".join(edited)))
    return out


def _shingles(text, width=3):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _links(rows, least, width=3):
    sets = {i: _shingles(t, width) for i, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def test_near_duplicates_against_all_pairs(spark):
    rows = _texts() + [(900, "n", None), (901, "e", ""), (902, "s", "two words"), (1, "T0", _texts()[0][2])]
    df = spark.createDataFrame(rows, "id long, title string, content string").withColumn("n", F.lit("clash"))
    groups = near_duplicate_groups(df, "id", F.col("content"), 0.6, 3)
    links = _links({(i, c) for i, _, c in rows}, 0.6)
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    members = [i for i, _, c in _texts() if _shingles(c)]
    expected = {(a, b) for a, b in itertools.combinations(members, 2) if find(a) == find(b)}
    assert {tuple(r) for r in group_pairs(groups).collect()} == expected and expected
    assert near_duplicate_groups(df.limit(0), "id", F.col("content")).count() == 0


def test_linkage_finds_what_all_pairs_find(spark):
    rows = [(i, i % 3 + 1, t, c, f"http://www.a.test/p{i % 20}/") for i, t, c in _texts(5)] + [(500, 3, None, None, None), (501, 1, "x", "", " ")]
    df = spark.createDataFrame(rows, "id long, batch long, title string, content string, url string")
    history = History(spark)
    pairs = None
    for b in (1, 2, 3):
        history = History(spark, history.folder)  # opened again for each batch
        found = history.accept(df.where(F.col("batch") == b))
        pairs = found if pairs is None else pairs.unionByName(found)
    batch = {r[0]: r[1] for r in rows}
    expected = {p for p in _links([(r[0], r[3]) for r in rows], 0.6) if batch[p[0]] != batch[p[1]]}
    expected |= {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if page_of(a[4]) and page_of(a[4]) == page_of(b[4]) and a[1] != b[1]}
    assert {(r.id_a, r.id_b) for r in pairs.where("batch_a <> batch_b").collect()} == expected
    cluster = {r.id: r.cluster for r in history.clusters().collect()}
    parent = {i: i for i in batch}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in _links([(r[0], r[3]) for r in rows], 0.6) | {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if page_of(a[4]) and page_of(a[4]) == page_of(b[4])}:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert cluster == {i: find(i) for i in batch}
    assert (history.weights[:, 0] < 0).any() and history.weights[0, 3] > history.weights[0, 0]
    best = repeated_records(History(spark, history.folder), pairs).collect()
    assert best and all(batch[r.repeats] < batch[r.id] for r in best)


@pytest.mark.parametrize("other", ["HTTPS://WWW.a.test:443/x%2Dy/index.html#top", "a.test/x-y/?utm_source=mail&fbclid=1", "http://a.test/x-y?ref=nav"])
def test_spellings_of_a_page(other):
    assert page_of(other) == page_of("http://a.test/x-y")


def test_other_pages():
    assert page_of("http://a.test/x?page=2") != page_of("http://a.test/x") != page_of("http://a.test/X") and page_of(" ") is None and page_of(None) is None
    assert page_of("http://a.test/x?b=1&a=2") == page_of("http://a.test/x?a=2&b=1")


@pytest.mark.parametrize("block", [8192, 20])
def test_neighbours_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(15, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(20, 16)) for c in centres])
    x[5] = x[4] * 2.0
    x[6] = x[4]
    rows = [(f"c{i:03d}", [float(f) for f in v]) for i, v in enumerate(x.astype("f4"))]
    dirt = [("n", None), ("z", [0.0] * 16), ("short", [1.0]), ("inf", [float("inf")] * 16), ("nan", [float("nan")] * 16), rows[0], (None, rows[0][1])]
    df = spark.createDataFrame(rows + dirt, "chunk_id string, embedding array<float>")
    found = {(r.id, r.neighbour) for r in nearest_neighbours(df, k=5, dim=16, least=0.85, block=block).collect()}
    y = x.astype("f4").astype("f8")
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = np.round(y @ y.T, 9)
    expected = set()
    for i in range(len(s)):
        s[i, i] = -9
        expected |= {(f"c{i:03d}", f"c{j:03d}") for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    assert len(found & expected) >= 0.9 * len(expected)
    assert {("c004", "c006"), ("c006", "c004"), ("c004", "c005")} <= found
    assert nearest_neighbours(df.limit(0), k=5, dim=16).count() == 0


SPLITS = {"para\n\n" * 50: "blank_line", ("a" * 9 + "\n") * 50: "line", "One two. " * 60: "sentence", "word " * 90: "word", "x" * 500: "none", "```\n" + "code\n\n" * 60: "line"}


@pytest.mark.parametrize("text", SPLITS)
def test_split_boundary_and_round_trip(text):
    tree = Tree(text)
    pieces = pieces_of(text, 100, tree=tree)
    assert tree.boundary(100) == SPLITS[text]
    assert "".join(text[s + o : e] for s, e, o in pieces) == text and max(e - s for s, e, _ in pieces) <= 100


def test_sections_and_list_entries_stay_whole():
    text = "# A\n" + "intro text\n" * 4 + "## A1\n" + "x y z\n" * 8 + "## A2\n" + "p q\n" * 8 + "# B\n" + "tail\n" * 5
    assert [text[s:e].splitlines()[0] for s, e in Tree(text).pack(80)] == ["# A", "## A1", "## A2", "# B"]
    items = "".join(f"- item {i}\n  - part a{i}\n  - part b{i}\n" for i in range(6))
    assert all(items[s:e].startswith("- item") for s, e in Tree(items).pack(70))
    nested = "- one\n" + "  - inner entry\n" * 8 + "- two\n"
    assert all(nested[s:e].lstrip().startswith("- ") for s, e in Tree(nested).pack(40))


def _plain_boundary(text, limit):
    """The definition word by word: cut everywhere at one kind after the other."""
    lines, fenced, block, stretches = re.split(r"(?<=\n)", text), False, "", []
    for line in lines:
        block += line
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not line.strip() and not fenced:
            stretches.append(block)
            block = ""
    for kind, found in (("blank_line", [*stretches, block]), ("line", text.split("\n")), ("sentence", re.split(r"\n|(?<=[.!?])\s+", text)), ("word", text.split())):
        if all(len(x.strip()) <= limit for x in found):
            return kind
    return "none"


def test_boundary_against_the_definition():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "x" * rng.randint(1, 60), ". ", "! ", "\n", "\n\n", "```\n", "# H\n", "- e\n", "  ", "long word here "]) for _ in range(rng.randint(20, 90)))
        tree = Tree(text)
        pieces = pieces_of(text, 50, tree=tree)
        assert tree.boundary(50) == (_plain_boundary(text, 50) if len(text) > 50 else "blank_line"), text
        assert "".join(text[s + o : e] for s, e, o in pieces) == text and max(e - s for s, e, _ in pieces) <= 50


def test_split_items(spark):
    df = spark.createDataFrame([(1, "a b. " * 400), (2, None), (3, ""), (4, "short"), (None, "x" * 2000)], "id long, content string")
    rows = split_items(df, "id", "content", "document").collect()
    assert {r.item_id for r in rows} == {"1"} and sorted(r.chunk_index for r in rows) == list(range(len(rows)))


def test_perfect_hash_and_tokens(spark):
    keys = [f"k{i}" for i in range(5000)]
    perfect = PerfectHash(keys)
    assert sorted(perfect.find(np.array(keys, dtype=object))) == list(range(5000)) and (perfect.find(np.array(["no", "k5000"], dtype=object)) == -1).all()
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{tokenizer_dir()}/byte_bpe_50k"
    theirs = tokenizers.Tokenizer.from_file(path + ".json")
    theirs.encode_special_tokens = True
    texts = ["", None, "Hello  world\n\n", "zażółć gęślą", "日本語🚀", "<|endoftext|>", "don't 12345678", "\u00a0x", "a" * 3000]
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", path + ".tiktoken").collect()}
    assert got == {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert ByteBPE(read_ranks(path + ".tiktoken")).encode_batch([])[1].tolist() == [0]


def test_leaks_against_all_windows(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(8)] + [(90, "short one"), (91, None)]
    items.append((3, " ".join(rng.choice(WORDS) for _ in range(30))))  # an id with two texts
    docs = [(200, "x " + items[-1][1] + " y"), (201, items[3][1])]
    for d in range(60):
        words = [rng.choice(WORDS) for _ in range(50)]
        item = items[d % 8][1].split()
        length = rng.choice([0, 11, 12, 30])
        at = rng.randrange(0, 10)
        docs.append((d, " ".join(words[:20] + item[at : at + length] + words[20:])))
    docs += [(98, None), (99, "")]

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    expected = {(d, i) for d, t in docs for i, x in items if runs(t) & runs(x)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaked_items(d, i).collect()} == expected and expected
    assert {tuple(r) for r in leaked_items(d, i, block_words=50).collect()} == expected


FOUND = [
    ("mail a.b+c@x.example or (297) 555 0149", [("email", "a.b+c@x.example"), ("phone", "(297) 555 0149")]),
    ("HR needs the ID: 947-32-1839 (belongs to MIRA VAN DER HOELST)", [("id_number", "947-32-1839"), ("name", "MIRA VAN DER HOELST")]),
    ("send the badge to N. Kastenko, Am Alten Speicher 51b, 79999 Bad Elmen", [("name", "N. Kastenko"), ("address", "Am Alten Speicher 51b, 79999 Bad Elmen")]),
    ("ask quim at mossgate dot example", [("email", "quim at mossgate dot example")]),
    ("order no. 204-24-2621, sku 925-05-1293B, host 10.16.78.1, git@x.example:a/b.git, <@U0MML3ZNX> Tarnova Admin asked for a token", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,expected", FOUND)
def test_personal_items(text, expected):
    assert [(i.kind, text[i.start : i.end]) for i in personal.find_items(text)] == expected


#: Settings that no rule was made from.
NAMED = [
    ("The invoice goes to Maria Lopez, not to accounting.", ["Maria Lopez"]),
    ("Yesterday I met J. de Vries and Anna Weber.", ["J. de Vries", "Anna Weber"]),
    ("Dear Mr. John Miller, your order shipped", ["John Miller"]),
    ("Termin mit Frau Jelka Brandt um 9", ["Jelka Brandt"]),
    ("Le contrat est signé par Sophie Martin", ["Sophie Martin"]),
    ("Hay que hablar con Carmen Ruiz mañana", ["Carmen Ruiz"]),
    ("approved by Kowalczyk, Ewa on Monday", ["Kowalczyk, Ewa"]),
    ("Tarvik Boulen said the build is fine", ["Tarvik Boulen"]),
    ("Best regards,\nOlwen Tarrick", ["Olwen Tarrick"]),
    ("The Green Harbour Cluster asked for a restart, see Silver Heron and Windows Server in New York", []),
    ("Bitte Rückruf. Wenn der Suchindex nicht reagiert, hilft Die Vorlage", []),
]


@pytest.mark.parametrize("text,expected", NAMED)
def test_names_in_other_settings(text, expected):
    assert [text[i.start : i.end] for i in personal.find_items(text) if i.kind == "name"] == expected


def test_placeholders(spark):
    rows = [(1, "lunch with Mira Kast moved to 02:25"), (2, "kudos KAST, MIRA :clap:"), (3, None), (4, "nothing"), (5, "kudos Bela Orm :clap:"), (5, "kudos Bela Orm :clap:")]
    df = spark.createDataFrame(rows, "id long, t string")
    plain = {r.row_id: r.text for r in personal.replace_items(df, "x", "id", "t").collect()}
    assert plain == {1: "lunch with [NAME] moved to 02:25", 2: "kudos [NAME] :clap:", 3: None, 4: "nothing", 5: "kudos [NAME] :clap:"}


def test_surrogates_are_coreferent_distinct_and_well_formed(spark):
    rows = [(1, "lunch with Mira Kast moved to 02:25"), (2, "kudos KAST, MIRA :clap:"), (3, None), (4, "nothing"), (5, "kudos M. Kast :clap:"), (6, "Ask Мария Иванова about it"), (7, "call +49 30 1234567 or 0049 (0)30-1234567"), (8, "IBAN DE44 5001 0517 5407 3249 31"), (9, "mail a.b@x.example or a.b at x dot example"), (10, "send the badge to N. Kastenko, Am Alten Speicher 51b, 79999 Bad Elmen")]
    rows += [(100 + i, f"lunch with Name{chr(97 + i % 26)}{chr(97 + i // 26)} Kast moved") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string")
    items = personal.personal_items(df, "x", "id", "t")
    table = personal.surrogate_table(items, b"k").collect()
    for kind in personal.KINDS:
        new, old = [r.surrogate for r in table if r.kind == kind], {r.unit for r in table if r.kind == kind}
        assert len(set(new)) == len(new) and not set(new) & old
    put = {r.row_id: r.text for r in personal.replace_items(df, "x", "id", "t", b"k", spark.createDataFrame(table)).collect()}
    name = re.search("with (.*) moved", put[1])[1]
    given, family = name.split()
    assert name != "Mira Kast" and put[4] == "nothing" and put[3] is None
    assert put[2] == f"kudos {family.upper()}, {given.upper()} :clap:" and put[5] == f"kudos {given[0]}. {family} :clap:"
    assert all(family in put[100 + i] for i in range(300)) and len({put[100 + i] for i in range(300)}) == 300
    assert re.fullmatch(r"Ask [А-Я][а-я]+ [А-Я][а-я]+ about it", put[6]) and put[6] != rows[5][1]
    one, other = re.fullmatch(r"call (.*) or (.*)", put[7]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", other.replace("(0)", ""))[2:] and one.startswith("+49 ") and other.startswith("0049 (0)")
    iban = put[8][5:].replace(" ", "")
    assert iban.startswith("DE") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    mail, spelled = re.fullmatch(r"mail (\S+) or (.*)", put[9]).groups()
    assert spelled.replace(" at ", "@").replace(" dot ", ".") == mail
    assert re.fullmatch(r"send the badge to [A-Z]\. \w+, Am \w+ \w+ \d\db, \d{5} Bad \w+", put[10])


def test_language_labels_and_sentences():
    assert [langid.label_of(x) for x in ("en-US", " Deutsch ", "español", "xx", "", None, "por")] == ["en", "de", "es", None, None, None, "pt"]
    text = "# Head line here now.\nThis is one sentence. (gezellig)\n```\ncode is not a sentence.\n```\n- Das ist noch ein Satz!"
    assert [s for _, s in langid.sentences(text)] == ["This is one sentence.", "Das ist noch ein Satz!"] and langid.sentences(None) == []
    wrapped = "The first line goes on\nhere. Done.\n\n- Note without a stop\n`x = 1`"
    assert [(wrapped[s.start :][:3], s.whole) for s in langid.stretches(wrapped)] == [("The", True), ("Don", False), ("Not", False)]


def test_every_document_has_a_language_row(spark):
    samples = [("en", "the house and the garden are with this man."), ("fr", "la maison et le jardin sont avec cette femme."), ("de", "das haus und der garten sind mit diesem mann.")] * 15
    net = langid.train(spark.createDataFrame(samples, "lang string, text string"))
    again = langid.train(spark.createDataFrame(samples, "lang string, text string"))
    assert all((net.p[k] == again.p[k]).all() for k in net.p)
    docs = [(1, "en", "the garden and the house with this man"), (2, None, None), (3, "", "```\nx = 1\n```"), (4, "en", "la maison et le jardin sont avec cette femme."), (5, "Français", "la femme et la maison sont avec le jardin."), (5, "Français", "la femme et la maison sont avec le jardin.")]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("seg", F.lit("clash"))
    rows = {r.doc_id: r for r in langid.document_languages(langid.segments(df, net)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].lang == "en" and 0 < rows[1].confidence < 1 and rows[1].languages == [] and not rows[1].is_case
    assert (rows[2].lang, rows[2].confidence, rows[3].lang) == (None, 0.0, None)
    assert rows[4].is_case and rows[4].languages == ["fr"] and not rows[5].is_case
    assert langid.document_languages(langid.segments(df.limit(0), net)).count() == 0


def test_gradient_and_learning():
    net = langid.ByteGRU(hidden=5, labels=("a", "b"))
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, mask = langid._pad([np.frombuffer(b"abcab", "u1"), np.frombuffer(b"ba", "u1")])
    y = np.array([0, 1])
    _, g = net.gradient(x, mask, y)
    for name, at in (("Uf", (1, 7)), ("Ub", (2, 12)), ("Ef", (97, 3)), ("Eb", (98, 11)), ("V", (4, 1)), ("c", (0,))):
        values = []
        for step in (1e-3, -1e-3):
            net.p[name][at] += step
            values.append(net.gradient(x, mask, y)[0])
            net.p[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-3 - g[name][at]) < 2e-3
    texts = ["aba aab baa abb", "xyx yyx xxy yxx"] * 12
    learned = langid.ByteGRU(hidden=6, labels=("a", "b")).fit(texts, ["a", "b"] * 12, epochs=30, batch=8)
    assert learned.probabilities(["abba aab", "xyxy yx"]).argmax(1).tolist() == [0, 1]
