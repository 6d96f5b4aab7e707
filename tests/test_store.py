import json
import math
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import providers as P
from quillspark.functions import text as T
from quillspark.operators import chunking as K
from quillspark.operators import duplicates as D
from quillspark.operators import links as L
from quillspark.operators import packs as X
from quillspark.operators import search as S
from quillspark.operators.documents import DocumentNotFoundError, Store, ValidationError, dedup_decision, get_document, list_documents, upsert
from quillspark.sources import connectors as N
from quillspark.sources import converters as C
from quillspark.sources import crawl as W
from quillspark.sources.files import normalise, parser_for, read_documents, register_parser
from quillspark.streaming import watch as Q

AT = "2025-01-01 00:00:00"


# ---- functions


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("runs", "run"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustable", "adjust"), ("controlling", "control"), ("sky", "sky"), ("filing", "file"), ("is", "is")])
def test_stems(word, expected):
    assert T.stem(word) == expected


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(T.js_trim(F.lit("\u00a0 a b\t"))) == "a b" and get(T.slug(F.lit(" Hello, World! "))) == "hello-world"
    assert get(T.truncated(F.lit("x" * 90))) == "x" * 77 + "..." and get(T.title_from_url(F.lit("https://a.test/docs/my-page_one.html?x=1"))) == "my page one"
    assert get(T.title_from_url(F.lit("https://a.test/"))) == "a.test" and T.query_words("title:run *foo* AND x") == ["run", "foo", "x"]
    assert T.like_escape("50%_\\[") == "50\\%\\_\\\\\\[" and get(T.like_any_word(F.lit("Cost 50% É"), "x 50%")) and not get(T.like_any_word(F.lit("cost 500"), "50%"))
    assert str(get(T.epoch_time(F.lit("86400.123")))) == "1970-01-02 00:00:00" and str(get(T.epoch_time(F.lit("nope")))) == "1970-01-01 00:00:00"
    assert get(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0 and abs(get(T.l2(F.array(F.lit(3.0)), F.array(F.lit(0.0)))) - 3) < 1e-12
    assert get(T.bump_patch(F.lit("1.2.9"))) == "1.2.10" and get(T.is_semver(F.lit("1.2"))) is False
    assert tuple(get(T.pack_spec(F.lit("@org/x@1.0.0")))) == ("@org/x", "1.0.0") and tuple(get(T.pack_spec(F.lit("@org")))) == ("@org", None)
    assert get(T.language_of(F.lit("a/b.tsx"))) == "tsx" and get(T.language_of(F.lit("golang"))) == "go"
    assert get(T.tokens(F.lit("The Quick brown-fox is on")))[:3] == ["quick", "brown", "fox"]
    assert T.sign("a", "k") == "780c3db4ce3de5b9e55816fba98f590631d96c075271b26976238d5f4444219b" or len(T.sign("a", "k")) == 64
    sealed = T.seal("pass wörd", "s", b"0" * 16)
    assert T.unseal(sealed, "s") == "pass wörd"
    with pytest.raises(ValueError):
        T.unseal(sealed, "other")
    assert T.mrkdwn_to_markdown("*b* _i_ ~s~ `*c*` <#C1|ops> <https://x.y|t> <https://z.w>") == "**b** *i* ~~s~~ `*c*` #ops [t](https://x.y) https://z.w"
    assert T.frontmatter("---\na: 2024-01-02\ntags: [x]\n---\nbody") == ({"a": "2024-01-02", "tags": ["x"]}, "body") and T.frontmatter("---\n: [\n---\nb")[0] == {}


# ---- chunks


def test_heading_chunks():
    assert K.chunk_by_headings("", 100) == [] == K.chunk_by_headings(" \n ", 100)
    text = "# A\nintro\n## B\nbody\n## C\nmore\n# D\nlast"
    assert K.chunk_by_headings(text, 1500, 0) == ["# A\nintro", "Context: A\n## B\nbody", "Context: A\n## C\nmore", "# D\nlast"]
    long = K.chunk_by_headings("para one\n\n" * 30 + "x" * 250, 100, 0)
    assert all(0 < len(c) <= 100 for c in long) and "".join(long).count("x") == 250
    over = K.chunk_by_headings("# A\n" + "one line\n" * 5 + "# B\ntext", 1500, 0.5)
    assert over[1].endswith("\n\n# B\ntext") and over[1].startswith("one line")
    began = time.time()
    K.chunk_by_headings("a plain line of text\n" * 10_000)
    assert time.time() - began < 0.5


def test_window_chunks_and_titles():
    text = "Sentence number one. " * 20_000
    chunks = K.chunk_by_windows(text, 1500)
    assert len(set(chunks)) == len(chunks) and max(map(len, chunks)) <= 1500
    assert K.strip_tags("<a title='x>y'>t</a> b") == "t b" and K.derive_title("<title>T &</title>") == "T &" and K.derive_title(None, "https://a.test/x-y/") == "x y"
    assert K.derive_title("text\n# Head") == "Head" and K.derive_title("<h1>H <b>x</b></h1><title>T</title>") == "H x"


def test_code_chunks(spark):
    code = "import os\n\nX = 1\n\n@deco\ndef f():\n    return 1\n\nclass A:\n    def a(self):\n        pass\n\n    def b(self):\n        pass\n\nprint(X)\n"
    parts = K.chunk_code(code, "py", 60)
    assert [(p.node_type, p.start_line) for p in parts] == [("function_definition", 1), ("class_definition", 9), ("class_definition", 13), ("trailing", 16)] or parts[-1].node_type == "trailing"
    assert K.chunk_code("x = = 1", "python")[0].node_type == "module" and K.chunk_code("", "python") == []
    js = K.chunk_code("import a from 'a';\n\nexport function f() {\n  return 1;\n}\n\nclass B {\n  x() {}\n}\n", "ts", 40)
    assert [p.node_type for p in js] == ["preamble", "declaration", "declaration"] or [p.node_type for p in js] == ["declaration", "declaration"]
    rows = K.code_documents(spark.createDataFrame([("a/x.py", "def f():\n    pass"), ("README.md", "hi"), (None, "x")], "path string, content string"), "r").collect()
    assert {r.url for r in rows} == {"repo://r/a/x.py#L1", "repo://r/README.md"}


# ---- links


def test_link_extraction():
    html = "<a href='/x/#f'>1</a><a  class=q href=\"y/\">2</a><abbr href='no'><a href=''></a><a href='#t'></a><a href='mailto:a@b'></a><a href=/x>3</a>"
    assert L.html_links(html, "https://a.test/d/") == ["https://a.test/x", "https://a.test/d/y"] and L.html_links(None, "x") == []
    assert L.markdown_links("[a](http://x) ![i](y) [b]( )") == [("a", "http://x"), ("i", "y")] and L.wiki_links("[[A|x]] [[B]] [[A]]") == ["A", "B"]
    assert L.sitemap_links("<loc> https://a.test/1 </loc><loc>https://a.test/1</loc>") == ["https://a.test/1"]
    assert L.page_links("<a href='/docs/a'></a><a href='/docs/i.png'></a><a href='/x'></a><a href='https://b.test/docs/a'></a>", "https://a.test/", "/docs") == ["https://a.test/docs/a"]


def test_references_and_chains(spark):
    docs = spark.createDataFrame([(1, "One", "http://a/1"), (2, "Two", None), (3, "two", None)], "id long, title string, url string")
    refs = spark.createDataFrame([(1, "TWO"), (1, "one"), (2, "http://a/1"), (2, "none")], "document_id long, target string")
    assert {tuple(r) for r in L.resolve_references(refs, docs).collect()} == {(1, 2), (2, 1)}
    links = spark.createDataFrame([(1, 2, "prerequisite"), (2, 3, "prerequisite"), (3, 1, "prerequisite"), (5, 1, "related")], "source_id long, target_id long, link_type string")
    assert {tuple(r) for r in L.prerequisite_chains(links).collect()} == {(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 2, 2)}
    assert {(r.document_id, r.direction, r.title) for r in L.link_titles(links, docs, "related").collect()} == {(5, "out", "One")}
    assert L.add_links(links, spark.createDataFrame([(1, 1, "x"), (5, 1, "related")], links.schema)).count() == 4 and L.delete_links(links, links.limit(1)).count() == 3


# ---- store


def _store(spark):
    new = spark.createDataFrame([("Alpha", "# Alpha\nabout [[Beta]] engines", "http://a"), ("Beta", "# Beta\nabout running engines", "http://b"), (" ", "x", None), ("Gamma", None, None)], "title string, content string, url string")
    return Store.empty(spark).index(new, AT, P.HashedWordsEmbedder(32))


def test_index_patch_and_delete(spark, tmp_path):
    store, found = _store(spark)
    assert sorted(r.status for r in found.collect()) == ["indexed", "indexed", "invalid", "invalid"]
    store = store.write(str(tmp_path / "s"))
    ids = {r.title: r.id for r in store.documents.collect()}
    assert sorted(ids) == ["Alpha", "Beta"] and store.embeddings.count() == store.chunks.count() == 2
    assert [tuple(r) for r in store.links.collect()] == [(ids["Alpha"], ids["Beta"], "references")]
    again = spark.createDataFrame([("Alpha", "# Alpha\nabout [[Beta]] engines", "http://a"), ("Beta", "other text", "http://b"), ("Beta", "# Beta\nabout running engineX", None)], "title string, content string, url string")
    later, found = store.index(again, AT)
    assert {(r.title, r.url): r.status for r in found.collect()} == {("Alpha", "http://a"): "unchanged", ("Beta", "http://b"): "changed", ("Beta", None): "duplicate_title"}
    later = later.write(str(tmp_path / "s2"))
    assert {r.title for r in later.documents.collect()} == {"Alpha", "Beta"} and later.documents.where("title = 'Beta'").first().content == "other text"
    patch = spark.createDataFrame([(ids["Alpha"], ["title", "library", "content"], "New", None, "new content")], "id long, fields array<string>, title string, library string, content string")
    changed = store.update(patch, "2025-02-01 00:00:00")
    row = get_document(changed.documents, ids["Alpha"])
    assert (row.title, row.library, row.url) == ("New", None, "http://a") and changed.versions.first().title == "Alpha"
    assert changed.chunks.where(F.col("document_id") == ids["Alpha"]).first().content == "new content" and changed.embeddings.count() == 1
    back = changed.rollback(ids["Alpha"], 1, AT)
    assert get_document(back.documents, ids["Alpha"]).title == "Alpha" and back.versions.count() == 2 and back.newest_versions(1).versions.count() == 1
    gone = store.delete_document(ids["Beta"])
    assert gone.documents.count() == 1 and gone.links.count() == 0 and gone.chunks.count() == 1
    with pytest.raises(DocumentNotFoundError):
        store.delete_document(999)
    assert store.delete_where(F.startswith("url", F.lit("http://a")))[1] == 1
    tagged = store.add_tags(ids["Alpha"], [" X ", "x"])
    assert [r.name for r in tagged.tags.collect()] == ["x"] and tagged.remove_tag("X").tags.count() == 0 and tagged.delete_tagged("x").documents.count() == 1
    assert list_documents(store.documents, S.Filters(source_type="manual"), limit=1).count() == 1
    rated, refused = store.rate(spark.createDataFrame([(1, ids["Alpha"], None, 5, None), (2, ids["Alpha"], None, 6, None), (3, 99, None, 3, None), (4, ids["Alpha"], f"{ids['Beta']}-0", 3, None)], "id long, document_id long, chunk_id string, rating int, feedback string").withColumn("created_at", F.current_timestamp()))
    assert rated.ratings.count() == 1 and {r.id for r in refused.collect()} == {2, 3, 4}


def test_bulk_topics_and_reindex(spark):
    store, _ = _store(spark)
    store = store.add_topics(spark.createDataFrame([("My Topic", None, None), ("My Topic", None, None)], "name string, description string, parent_id string"))
    assert [r.id for r in store.topics.collect()] == ["my-topic"]
    moved, ids = store.bulk_move(S.Filters(source_type="manual"), "my-topic")
    assert ids.count() == 2 and {r.topic_id for r in moved.documents.collect()} == {"my-topic"} and store.bulk_move(S.Filters(source_type="manual"), "my-topic", dry_run=True)[0] is store
    assert moved.rename_topic("my-topic", "T").topics.first().name == "T" and {r.topic_id for r in moved.delete_topic("my-topic").documents.collect()} == {None}
    tagged, _ = store.bulk_retag(S.Filters(source_type="manual"), add=["a", "b"])
    assert tagged.tags.count() == 4 and tagged.bulk_retag(S.Filters(tags=["a", "a"]), remove=["b"])[0].tags.count() == 2
    assert store.bulk_delete(S.Filters(source_type="manual"))[0].documents.count() == 0
    with pytest.raises(ValidationError):
        store.select(S.Filters())

    class Half(P.HashEmbedder):
        def embed_batch(self, texts):
            if any("Alpha" in t for t in texts):
                raise RuntimeError("no")
            return super().embed_batch(texts)

    again, done = store.reindex(Half())
    assert sorted(r.ok for r in done.collect()) == [False, True] and sorted(len(r.embedding) for r in again.embeddings.collect()) == [4, 32]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 3)} == {tuple(r) for r in upsert(old, new, ["k"], update=False).collect()}
    assert [r.d for r in spark.createDataFrame([(True,), (False,)], "x boolean").select(dedup_decision(F.col("x"), "skip").alias("d")).collect()] == ["skip", "index"]


# ---- search


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "Running engines", "x", None, None), (2, "Cooking", "y", None, None), (3, "Other", "x", None, None)], "id long, title string, library string, version string, topic_id string").withColumn("source_type", F.lit("m")).withColumn("created_at", F.current_timestamp())
    chunks = spark.createDataFrame([("a", 1, 0, "He runs the engine"), ("b", 2, 0, "A café recipe"), ("c", 3, 0, "runner ran"), ("d", 3, 1, None)], "id string, document_id long, chunk_index int, content string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, "running", [1.0, 0.0]), (2, "cafe", [0.0, 1.0]), (3, "nothing-here", [1.0, 0.0]), (4, None, None)], "request_id long, query string, embedding array<double>")
    got = {r.request_id: r for r in S.search(chunks, docs, asked, vectors, limit=1).collect()}
    assert got[1].id == "a" and got[1].title_boost and abs(got[1].score - 1.5 * 2 / 61) < 1e-9 and got[2].id == "b" and got[3].score == 1.0 and 4 not in got
    assert {r.id for r in S.search(chunks, docs, asked, vectors, filters=S.Filters(library="x")).collect()} == {"a", "c"}
    assert S.explained(S.search(chunks, docs, asked, vectors, limit=1)).where("request_id = 1").first().score_explanation.method == "hybrid"
    phrase = spark.createDataFrame([(1, "the-engine"), (2, "engine-the")], "request_id long, query string")
    assert {r.request_id for r in S.search(chunks, docs, phrase).collect()} == {1}
    assert [r.score for r in S.keyword_search(chunks, docs, "RAN recipe").orderBy("document_id").collect()] == [1.0, 0.9]
    assert S.search_batch(chunks, docs, ["running", "running"]).select("request_id").distinct().count() == 1
    with pytest.raises(ValueError):
        S.search_batch(chunks, docs, [])
    links = spark.createDataFrame([(1, 2, "related")], "source_id long, target_id long, link_type string")
    near = S.related_to(chunks, docs, vectors, "a", links=links, min_score=0.5).orderBy("place").collect()
    assert [(r.id, round(r.score, 2)) for r in near] == [("c", 0.86), ("b", 0.6)]
    with pytest.raises(S.ChunkNotFoundError):
        S.related_to(chunks, docs, vectors, "zz")
    with pytest.raises(S.NoEmbeddingError):
        S.related_to(chunks, docs, vectors, "d")
    saved = S.save_search(None, spark, "mine", "running", S.Filters(library="x"), AT)
    found, saved = S.run_saved(saved, "mine", AT, chunks, docs)
    assert found.count() == 1 and saved.first().result_count == 1
    packs = spark.createDataFrame([("react", "a lib", ["ui"], "ann"), ("react-dom", "react in pages", ["react", "x"], None), ("vue", None, None, None)], "name string, description string, tags array<string>, author string")
    assert [(r["name"], r.score) for r in S.pack_scores(packs, "React").collect()] == [("react", 100), ("react-dom", 100)]
    expected = spark.createDataFrame([(1, 1), (2, 3)], "request_id long, expected long")
    assert tuple(S.retrieval_quality(expected, S.search(chunks, docs, asked, vectors)).first())[2] == 2


def test_duplicates_and_graph(spark):
    docs = spark.createDataFrame([(1, "a", "x", "t"), (2, "b", "x", "t"), (3, "c", "y", None), (4, "d", "z", None), (5, "e", "w", None)], "id long, title string, content string, topic_id string").withColumn("updated_at", F.current_timestamp())
    means = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.1]), (4, [1.0, 0.11]), (5, [0.0, 0.0])], "id long, embedding array<double>")
    assert [r.ids for r in D.exact_groups(docs).collect()] == [[1, 2]]
    assert {(r.a, r.b) for r in D.similar_documents(means, 0.9, block=2).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert {tuple(r) for r in D.semantic_clusters(docs, means).collect()} == {(3, 3), (4, 3)}
    new = spark.createDataFrame([(9, "x", [0.0, 1.0]), (8, "q", [1.0, 0.0]), (7, "r", [0.0, 5.0])], "id long, content string, embedding array<double>")
    assert {r.id: (r.strategy, r.existing_id) for r in D.check_duplicates(new, docs, means).collect()} == {9: ("exact", 1), 8: ("semantic", 1), 7: (None, None)}
    topics, tags = spark.createDataFrame([("t", "Topic")], "id string, name string"), spark.createDataFrame([(3, "k")], "document_id long, name string")
    ratings, links = spark.createDataFrame([(4, 5)], "document_id long, rating int"), spark.createDataFrame([(4, 3, "related")], "source_id long, target_id long, link_type string")
    nodes = D.graph_nodes(docs, topics, tags, ratings, 4)
    assert nodes.count() == 6 and nodes.where("type = 'document'").first().node == "doc:4"
    edges = D.graph_edges(nodes, docs, tags, links, means, 0.999)
    assert {r.type for r in edges.collect()} == {"belongs_to_topic", "has_tag", "related", "similar_to"}
    assert D.clusters(nodes, edges).where("node = 'doc:1'").first()["name"] == "Topic"


# ---- packs, export


def test_packs(spark, tmp_path):
    pack = {"name": "p", "version": "1.0.0", "description": "d", "documents": [{"title": f"t{i}", "content": f"text {i} " * 3, "source": f"http://p/{i}"} for i in range(3)], "metadata": {}}
    path = str(tmp_path / "p.json.gz")
    assert len(X.write_pack(pack, path)) == 64 and X.read_pack(path)["name"] == "p"
    with pytest.raises(ValidationError):
        X.validate_pack({"name": "p"})
    installed = spark.createDataFrame([], "name string, version string, doc_count long, installed_at timestamp")
    store, installed, errors = X.install_pack(Store.empty(spark), installed, pack, AT, resume_from=1)
    assert not errors and store.documents.count() == 2 and installed.first().doc_count == 2
    assert X.install_pack(store, installed, pack, AT)[0] is store
    made = X.create_pack(store.documents, store.tags, store.topics, "p", "1.0.1", "d", "me", AT)
    assert [d["title"] for d in made["documents"]] == ["t1", "t2"] or len(made["documents"]) == 2
    assert X.remove_pack(store, installed, "p")[0].documents.count() == 0 and X.list_installed(installed).count() == 1
    docs = spark.range(25).withColumnRenamed("id", "id")
    batches = X.install_batches(docs, 10, 5).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in batches} == {0: 5, 1: 10, 2: 5}
    extra = spark.createDataFrame([(1, "http://h", "s3cret")], "id long, url string, secret string")
    X.export_store(store, str(tmp_path / "backup"), {"webhooks": extra})
    restored, bad = X.import_store(spark, str(tmp_path / "backup"), Store.empty(spark))
    assert restored.documents.count() == 2 and restored.chunks.count() == store.chunks.count() and bad.count() == 1 and "s3cret" not in bad.first()["value"]


def test_registry(spark, tmp_path):
    entries = spark.createDataFrame([('{"name":"a","description":"x","latestVersion":"1.0.0"}',), ("{bad",), ('{"name":"b"}',)], "entry string")
    assert [r["name"] for r in X.registry_index(entries).collect()] == ["a"]
    index = spark.createDataFrame([("a", "x", "1.0.0")], "name string, description string, latestVersion string")
    versions = spark.createDataFrame([("a", "1.0.0", "c0"), ("a", "1.0.10", "c1")], "name string, version string, checksum string").withColumn("published_at", F.to_timestamp(F.lit(AT)))
    index, versions = X.publish(index, versions, spark.createDataFrame([("a", None, "c2"), ("n", None, "c3")], "name string, version string, checksum string"), "2025-02-02 00:00:00")
    assert {r["name"]: r.latestVersion for r in index.collect()} == {"a": "1.0.11", "n": "1.0.0"} and X.manifest(versions, "a").first().version == "1.0.11"
    with pytest.raises(ValidationError):
        X.publish(index, versions, spark.createDataFrame([("a", "1.0", "c")], "name string, version string, checksum string"), AT)
    index, versions = X.unpublish(index, versions, "a", "1.0.11")
    assert {r["name"]: r.latestVersion for r in index.collect()} == {"a": "1.0.10", "n": "1.0.0"}
    offers = spark.createDataFrame([("r1", 2, "a", "2.0.0"), ("r2", 1, "a", "1.0.0")], "registry string, priority int, name string, version string")
    wanted = spark.createDataFrame([("a", None)], "name string, version string")
    assert X.resolve_packs(offers, wanted).first().registry == "r2" and X.resolve_packs(offers, wanted, "r1").first().version == "2.0.0"
    data = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], "name string, version string, data string")
    sums = spark.createDataFrame([("a", "1", __import__("hashlib").sha256(b"x").hexdigest()), ("b", "1", ""), ("c", "1", "00")], "name string, version string, checksum string")
    assert {r["name"]: r.status for r in X.verify_checksums(data, sums).collect()} == {"a": "ok", "b": "missing checksum", "c": "mismatch", "d": "skipped"}
    config, cache = X.RegistryConfig(str(tmp_path / "r.json")), {}
    config.add("main", "https://r.test")
    with pytest.raises(ValidationError):
        config.add("Bad Name", "ftp://x")
    assert config.sync(lambda u: [u], cache, AT) == [("main", "success")] and config.sync(lambda u: 1 / 0, cache, AT) == [("main", "offline")] and config.sync(lambda u: 1 / 0, {}, AT) == [("main", "error")]
    config.remove("main")
    assert config.all() == []
    state = spark.createDataFrame([(1, None, 1.0), (2, AT, 0.0), (3, AT, 1.0), (4, "2025-01-01 23:30:00", 1.0)], "id int, last string, interval_hours double").withColumn("last_sync", F.to_timestamp("last"))
    assert {r.id: r.is_stale for r in X.stale(state, "2025-01-02 00:00:00").collect()} == {1: True, 2: False, 3: True, 4: False}


# ---- sources


def _zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_files_of_all_kinds(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    _zip(tmp_path / "a.docx", {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'})
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    _zip(tmp_path / "b.pptx", {f"ppt/slides/slide{n}.xml": f'<p xmlns:a="{a}"><a:t>S{n}</a:t></p>' for n in (10, 2)})
    _zip(tmp_path / "c.epub", {"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>', "O/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="x" href="x.html"/><item id="y" href="y.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>', "O/x.html": "<p>First &amp; x</p>", "O/y.html": "<style>s</style><p>Second</p>"})
    (tmp_path / "d.yaml").write_text("a: [1")
    (tmp_path / "e.yml").write_text("a: 1\n")
    (tmp_path / "f.docx").write_text("broken")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.md").write_text("x")
    (tmp_path / "h.pdf").write_bytes(b"%PDF-")
    found = {r.path.rsplit("/", 1)[1]: r for r in read_documents(spark, str(tmp_path), exclude=("sub/**",)).collect()}
    assert found["a.docx"].content == "One\n\nTwo" and found["b.pptx"].content == "--- Slide 2 ---\nS2\n\n--- Slide 10 ---\nS10" and found["c.epub"].content == "Second\n\nFirst & x"
    assert found["d.yaml"].error and found["e.yml"].content == "```yaml\na: 1\n```" and found["f.docx"].error and "g.md" not in found and found["h.pdf"].error
    assert X.walk(str(tmp_path), ("md", "yml")) == ["e.yml", "sub/g.md"] and X.walk(str(tmp_path), exclude=["sub", "*.docx", "*.y*"]) == ["b.pptx", "c.epub", "h.pdf"]
    with pytest.raises(C.ParseError):
        parser_for("x.unknown")
    register_parser([".unknown"], lambda data: "ok")
    assert parser_for("x.UNKNOWN")(b"") == "ok"
    rows = normalise(spark, [{"text": "# T\nx"}, {"path": str(tmp_path / "e.yml")}, {"name": "q.txt", "data": b"hey"}, {"url": "http://x"}]).collect()
    assert [r.title for r in rows][:3] == ["T", "e", "q"] and rows[3].error


def test_wiki_and_notebook_markup():
    storage = '<p>a</p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[x < 1]]></ac:plain-text-body></ac:structured-macro><ac:structured-macro ac:name="info"><ac:rich-text-body><p>note</p></ac:rich-text-body></ac:structured-macro><ac:structured-macro ac:name="toc"/><ac:structured-macro ac:name="expand"><ac:parameter ac:name="title">More</ac:parameter><ac:rich-text-body>in</ac:rich-text-body></ac:structured-macro><ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">K-1</ac:parameter></ac:structured-macro><ac:image><ri:attachment ri:filename="i.png"/></ac:image><ac:link><ri:page ri:content-title="P"/><ac:plain-text-link-body><![CDATA[go]]></ac:plain-text-link-body></ac:link><ri:attachment ri:filename="f.txt"/>'
    out = C.storage_to_markdown(storage)
    for part in ("```py\nx < 1\n```", "> **Info:** note", "**More**\n\nin", "[JIRA: K-1]", "[image]", "[go](P)", "[attached: f.txt]"):
        assert part in out, out
    assert "toc" not in out
    page = C.notebook_to_markdown('<p data-tag="to-do:completed">done</p><p data-tag="to-do">open</p><cite>q</cite><img src="x"><div class="InkNode">z</div><object data-attachment="a.pdf" type="x"></object><div data-id="1">meta</div>')
    for part in ("- [x] done", "- [ ] open", "> q", "[image]", "[handwritten content]", "[attached: a.pdf]"):
        assert part in page, page
    assert "meta" not in page and C.html_to_markdown("<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>") == "1. a\n  - b\n2. c"
    rich = lambda t: [{"plain_text": t}]
    blocks = [{"type": "heading_1", "heading_1": {"rich_text": rich("H")}}, {"type": "to_do", "to_do": {"rich_text": rich("t"), "checked": True}, "children": [{"type": "paragraph", "paragraph": {"rich_text": rich("in")}}]}, {"type": "table", "table": {}, "children": [{"type": "table_row", "table_row": {"cells": [rich("a"), rich("b")]}}]}, {"type": "divider", "divider": {}}, {"type": "image", "image": {"type": "external", "external": {"url": "u"}, "caption": rich("c")}}, {"type": "child_page", "id": "9", "child_page": {"title": "P"}}]
    assert C.blocks_to_markdown(blocks) == "# H\n- [x] t\n  in\n| a | b |\n---\n![c](u)\n[P](notion://page/9)"
    assert C.object_title({"properties": {"N": {"type": "title", "title": rich("Row")}}}) == "Row" and C.object_title({}) == "Untitled"


def test_connectors(spark, tmp_path):
    messages = spark.createDataFrame([(1, "ops", "1.0", "U1", "hi <@U2> *b*", None, 1, None), (2, "ops", "2.0", "U2", "reply", "1.0", None, None), (3, "ops", "3.0", None, "alone <@U9>", None, None, None), (4, "ops", "4.0", "U1", "joined", None, None, "channel_join")], "message_id long, channel_name string, ts string, user_id string, text string, thread_ts string, reply_count int, subtype string")
    users = spark.createDataFrame([("U1", "Ann", "A", "a"), ("U2", "", "Bea", "b")], "user_id string, display_name string, real_name string, name string")
    docs = {r.url: r for r in N.chat_documents(messages, users).collect()}
    assert docs["slack://ops/thread/1.0"].content == "# Thread in #ops\n\n**Ann** (1970-01-01T00:00:01.000Z):\nhi @Bea **b**\n\n---\n\n**Bea** (1970-01-01T00:00:02.000Z):\nreply"
    assert docs["slack://ops/3.0"].content.startswith("**unknown**") and "@U9" in docs["slack://ops/3.0"].content and len(docs) == 2
    assert N.chat_documents(messages, users, "separate").count() == 3
    channels = spark.createDataFrame([("C1", "Ops"), ("C2", "dev"), ("C3", None)], "channel_id string, channel_name string")
    assert {r.channel_id for r in N.filter_channels(channels, ["ops", "C2"], ["dev"]).collect()} == {"C1"} and N.filter_channels(channels).count() == 3
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat" / "a.json").write_text(json.dumps({"ok": True, "channels": [{"id": "C1", "name": "x"}]}) + "\n" + json.dumps({"ok": True, "channel": "C1", "messages": [{"ts": "1", "text": "t"}]}) + "\n" + json.dumps({"ok": False, "channel": "C1", "messages": [{"ts": "2"}]}))
    assert [d.count() for d in N.read_chat(spark, str(tmp_path / "chat"))] == [1, 1]
    row = {"database": "DB", "properties": {"Name": {"type": "title", "title": [{"plain_text": "R"}]}, "S": {"type": "select", "select": {"name": "done"}}}, "blocks": []}
    made = N.notes_documents(spark.createDataFrame([("1", json.dumps(row), AT)], "id string, json string, e string").withColumn("edited_at", F.to_timestamp("e"))).first()
    assert (made.title, made.content, made.tags) == ("DB — R", "Metadata: S: done", ["done"])
    pages = spark.createDataFrame([("1", "S", "T", "<p>x</p>", 2, ["l"], None), ("2", "S", "T", "<p>x</p>", 1, None, ["m"]), ("3", "S", "T", "<p>x</p>", 1, None, None)], "id string, space string, title string, storage string, version int, labels array<string>, metadata_labels array<string>")
    known = spark.createDataFrame([("confluence://S/1", "confluence-version:1"), ("confluence://S/2", "confluence-version:1")], "url string, name string")
    wiki = N.wiki_pages(pages, known)
    assert {r.url[-1]: r.outcome for r in wiki.collect()} == {"1": "updated", "2": "skipped", "3": "indexed"} and tuple(N.wiki_counts(wiki).first()) == (2, 1, 1)
    book = spark.createDataFrame([("n", "s", "1", "T", "<p>x</p>", "2025-01-02 00:00:00"), ("n", "s", "2", "T", "<p>y</p>", AT)], "notebook string, section string, id string, title string, html string, m string").withColumn("modified", F.to_timestamp("m"))
    fresh, gone = N.notebook_pages(book, spark.createDataFrame([("onenote://n/s/9",), ("http://x",)], "url string"), AT)
    assert [r.content for r in fresh.collect()] == ["x"] and [r.url for r in gone.collect()] == ["onenote://n/s/9"]
    syncs = spark.createDataFrame([], "id long, connector_type string, connector_name string, status string, started_at timestamp, completed_at timestamp, added int, updated int, deleted int, errored int, error string")
    syncs = N.track(N.track(syncs, "slack", "w", AT), "slack", "w", AT, "completed", added=3)
    assert (syncs.first().status, syncs.first().added) == ("completed", 3)
    (tmp_path / "cfg").mkdir()
    (tmp_path / "cfg" / "notion.json").write_text('{"schedule": "0 * * * *"}')
    assert N.read_schedules(str(tmp_path / "cfg"))[0]["type"] == "notion"


def test_vault(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian" / "x.md").write_text("no")
    (tmp_path / "A.md").write_text("---\ntitle: Alpha\ntags: [t1]\n---\n[[Beta Note|b]] ![[Beta Note]] %%c%% #tag\n> [!note] hi")
    (tmp_path / "sub" / "Beta Note.md").write_text("see [[Alpha]] and [[beta note]]")
    notes = N.read_vault(spark, str(tmp_path))
    rows = {r.path: r for r in notes.collect()}
    assert set(rows) == {"A.md", "sub/Beta Note.md"} and rows["A.md"].title == "Alpha" and rows["A.md"].tags == ["tag", "t1"] and rows["sub/Beta Note.md"].topic == "sub"
    assert rows["A.md"].content == "[b](beta-note) [Embedded: Beta Note]  #tag\n> **note**: hi"
    docs = notes.select((F.hash("path") % 1000 + 1000).cast("long").alias("id"), "title", F.lit(None).cast("string").alias("url"))
    assert N.vault_links(notes, docs).count() == 2
    tracked = spark.createDataFrame([("A.md", "old"), ("gone.md", "x")], "path string, raw_hash string").withColumn("modified", F.to_timestamp(F.lit("2000-01-01")))
    assert {r.path: r.change for r in N.vault_changes(notes, tracked).collect()} == {"A.md": "updated", "gone.md": "deleted", "sub/Beta Note.md": "added"}
    assert C.embed_notes("a.md", {"a.md": "x ![[B]] ![[none]]", "b.md": "---\nq: 1\n---\nin ![[a]]"}) == "x in [a] [none]"


def test_crawl(spark):
    assert [W.is_private_address(a) for a in ("10.1.2.3", "172.32.0.1", "::ffff:127.0.0.1", "fd00::1", "8.8.8.8", "x", "0.1.1.1")] == [True, False, True, True, False, False, True]
    assert W.may_fetch("https://a.test") and not W.may_fetch("ftp://a.test") and not W.may_fetch("http://127.0.0.1/") and not W.may_fetch("http://a.test", lambda h: ["10.0.0.1"])
    robots = "User-agent: *\nDisallow: /all\n\nUser-agent: me\nUser-agent: you\nDisallow: /mine # c\nDisallow:\n"
    assert W.disallowed_paths(robots, "me") == ["/mine"] == W.disallowed_paths(robots, "you") and W.disallowed_paths(robots, "x") == ["/all"]
    pages = spark.createDataFrame([("https://a.test/", "<title>Root</title><a href='/b'>b</a><a href='/all/x'>n</a><a href='https://c.test/'>c</a><a href='/gone'>g</a><a href='/b.skip'>s</a>"), ("https://a.test/b", "<h1>B</h1><a href='/d'>d</a>"), ("https://a.test/d", "<h1>D</h1>"), ("https://a.test/all/x", "x")], "url string, html string")
    seen, left = W.crawl(pages, "https://a.test", max_depth=1, exclude=["*.skip"], robots=robots)
    assert {(r.url, r.depth, r.title) for r in seen.collect()} == {("https://a.test/", 0, "Root"), ("https://a.test/b", 1, "B")}
    assert {r.url: r.reason for r in left.collect()} == {"https://a.test/all/x": "robots", "https://c.test/": "domain", "https://a.test/gone": "missing", "https://a.test/b.skip": "excluded"}
    site = W.site_documents(spark.createDataFrame([("u1", "<div class='sphinxsidebar'>s</div><div class='a body'><div>x</div>y</div>z"), ("u2", "<main>m</main>n")], "url string, html string"))
    assert {(r.kind, r.content) for r in site.collect()} == {("sphinx", "x\n\ny"), ("generic", "m")}
    assert W.site_frontier("<loc>https://a.test/docs/1</loc><loc>https://b.test/</loc>", "<a href='/docs/2'></a>", "https://a.test/docs/", "/docs") == ["https://a.test/docs/1", "https://a.test/docs/2"]
    assert W.repository("https://github.com/o/r.git/") == {"host": "github", "owner": "o", "repo": "r", "branch": None, "path": None}
    assert W.repository("https://gitlab.com/o/r/-/tree/main/a/b")["path"] == "a/b" and W.repository("https://github.com/o/r/tree/dev/x")["branch"] == "dev"
    with pytest.raises(ValueError):
        W.repository("https://x.test/a/b")
    files = spark.createDataFrame([("src/a.py", "x"), (".git/c", "x"), ("src/b.md", "x"), ("t/a.py", "x")], "path string, content string")
    assert [r.path for r in W.repository_files(files, [".py"], "src/").collect()] == ["src/a.py"]


# ---- incremental work, providers


def test_watch_limits_and_schedules(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one")
    got, problems = [], []
    Q.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda b: got.extend(r.path.rsplit("/", 1)[1] for r in b.collect()))
    (tmp_path / "in" / "b.txt").write_text("two")
    (tmp_path / "in" / "c.bin").write_text("no")
    Q.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda b: (got.extend(r.path.rsplit("/", 1)[1] for r in b.collect()), 1 / 0), problems.append)
    assert got == ["a.md", "b.txt"] and len(problems) == 1
    events = spark.createDataFrame([("p", 0.0), ("p", 0.2), ("p", 1.0), ("q", 0.0)], "path string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.path, r.events) for r in Q.debounced(events).collect()) == [("p", 1), ("p", 2), ("q", 1)]
    now = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, content string")
    tracked = spark.createDataFrame([("a", __import__("hashlib").sha256(b"x").hexdigest()), ("b", "old"), ("d", "h")], "path string, raw_hash string")
    assert {r.path: r.action for r in Q.file_actions(now, tracked).collect()} == {"a": "skip", "b": "reindex", "c": "index", "d": "delete"}
    requests = spark.createDataFrame([(1, float(i)) for i in range(5)] + [(1, 70.0)], "user_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.requests, r.refused) for r in Q.fixed_window_limit(requests, most=3).collect()) == [(1, 0), (5, 2)]
    assert Q.sliding_gate(requests, most=3).where("waits").count() == 2
    new, mark = Q.high_water(requests, "1970-01-01 00:00:03", "ts")
    assert new.count() == 2 and mark.startswith("1970-01-01 00:01:10")
    at = time.struct_time((2025, 1, 6, 9, 30, 0, 0, 6, 0))
    assert Q.cron_due("*/15 9 * * 1", at) and not Q.cron_due("0 9 * * *", at)
    with pytest.raises(ValueError):
        Q.cron_due("61 * * * *", at)
    scheduler, ran = Q.Scheduler(), []
    scheduler.add("j", "* * * * *", lambda: (ran.append(1), time.sleep(0.3)))
    assert scheduler.tick(at) == ["j"] and scheduler.tick(at) == [] and scheduler.stop(5) and ran == [1]
    clock = [0.0]
    tasks = Q.Tasks(keep=10, now=lambda: clock[0])
    done = tasks.start(lambda stop: 7)
    assert tasks.wait(done) == {"state": "completed", "result": 7}
    slow = tasks.start(lambda stop: stop.wait(5))
    assert tasks.cancel(slow) and tasks.wait(slow)["state"] == "cancelled"
    clock[0] = 20.0
    with pytest.raises(LookupError):
        tasks.get(done)


def test_providers_and_answers(spark):
    assert abs(math.hypot(*P.HashEmbedder().embed("x")) - 1) < 1e-9 and P.HashEmbedder().embed("x") == P.HashEmbedder().embed("x")
    texts = spark.createDataFrame([(1, "red red blue"), (2, ""), (3, None)], "id long, t string")
    words = P.VocabularyEmbedder.of(texts, "t")
    assert [round(v, 3) for v in words.embed_batch(["red red blue"])[0]] == [0.894, 0.447]
    assert {r.id: sum(r.embedding) for r in P.embed(texts, words, "id", "t").collect()}[2] == 0
    P.register_embedder("mine", lambda: words)
    assert P.embedder("mine") is words
    with pytest.raises(LookupError):
        P.embedder("none")
    store, _ = _store(spark)
    hits = S.search(store.chunks, store.documents, spark.createDataFrame([(1, "engines")], "request_id long, query string"))
    context = P.context_prompt(hits, store.chunks, store.documents)
    answer = P.ask(context, "what about running engines?", P.Extractive(1))
    assert "running engines" in answer["answer"] and len(answer["sources"]) == 2 and P.ask(context, "q", P.Passthrough(), 9)["sources"] == []
    events = list(P.ask_stream(context, "running engines", P.Extractive(1)))
    assert [e["type"] for e in events][0] == "sources" and events[-1]["type"] == "done" and any(e["type"] == "token" for e in events)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return 5

    assert P.retry(flaky, 3, sleep=lambda s: None) == 5
    with pytest.raises(RuntimeError):
        P.retry(lambda: (_ for _ in ()).throw(RuntimeError()), 2, sleep=lambda s: None)
