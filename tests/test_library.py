"""Files, records, listings, exports and what a model call takes: literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evidence, graph, lexical, question
from folioscope.sources import library as lib


def rows(df, *c):
    return sorted(tuple(r[x] for x in c) for r in df.collect())


def test_uploads_and_imports(spark):
    files = spark.createDataFrame([("../a b.pdf", bytearray(b"%PDF-1.4 x")), ("b.pdf", bytearray(b"")), ("c.pdf", bytearray(b"<html>")), ("d.pdf", None)], "name string, content binary")
    assert rows(lib.stored_uploads(files), "file") == [("a b.pdf",)]
    wanted = spark.createDataFrame([("1706.03762v7",), ("cs/0112017",), (None,)], "arxiv string")
    have = spark.createDataFrame([("1706.03762v7.pdf",)], "file string")
    assert rows(lib.to_import(wanted, have), "arxiv", "file") == [("cs/0112017", "cs-0112017.pdf")]
    found = spark.createDataFrame([("/p/b.pdf", "h2"), ("/p/a.pdf", "h1"), ("/p/c.pdf", "h3")], "path string, file_hash string")
    store = spark.createDataFrame([("h3",), (None,)], "file_hash string")
    assert [r["path"] for r in lib.pending(found, store).collect()] == ["/p/a.pdf", "/p/b.pdf"]
    assert [r["path"] for r in lib.pending(found, store, "b.pdf").collect()] == ["/p/b.pdf"] and lib.pending(found, store, "c.pdf").count() == 0
    assert lib.store_name("papers", "gemini") == "papers" and lib.store_name("papers", "local") == "papers-local"


def test_cache(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps({"1706.1": {"title": "A", "year": 2017}, "10.1/x": {"title": None, "year": None}}))
    (tmp_path / "broken.json").write_text("{oops")
    read = lambda name: lib.cached_records(spark, f"file://{tmp_path}/{name}", "title string, year int")
    assert {r["key"]: r["title"] for r in read("records.json").collect()} == {"1706.1": "A", "10.1/x": None}
    assert read("broken.json").count() == 0 and read("missing.json").count() == 0
    keys = spark.createDataFrame([("1", "10.1/x", "/a/p.pdf"), ("", "10.1/x", "/a/p.pdf"), (None, "", "/a/p.v2.pdf")], "a string, d string, p string")
    assert [r["k"] for r in keys.select(lib.cache_key(F.col("a"), F.col("d"), F.col("p")).alias("k")).collect()] == ["1", "10.1/x", "p.v2"]


def test_listing_and_exports(spark):
    chunks = spark.createDataFrame([("/d/b.pdf", " ", 0), ("/d/b.pdf", "Bee", 1), ("/d/b.pdf", "Later", 2), ("/d/x.pdf", "X", 0)], "source string, title string, ord int")
    files = spark.createDataFrame([("c.pdf", ""), ("b.pdf", "other"), ("a.pdf", "From PDF")], "file string, pdf_title string")
    assert [tuple(r) for r in lib.listing(chunks, files).collect()] == [("a.pdf", "From PDF"), ("b.pdf", "Bee"), ("c.pdf", "c")]
    fields = "file string, authors array<string>, year int, title string, venue string, doi string, arxiv string, retracted boolean"
    records = spark.createDataFrame([("b", ["Bo Ek"], 2001, "Two", None, None, None, None), ("a", ["Al Fo"], 2000, "One", None, None, None, None)], fields)
    text = lib.bibtex_file(records).first()["bibtex"]
    assert text.index("fo2000") < text.index("ek2001") and lib.bibtex_file(records.where("false")).first()["bibtex"] == ""


def test_graph_payload_and_storage(spark, tmp_path):
    fields = "file string, ord int, own_id string, reference_ids array<string>, title string, year int, citation_count int"
    records = spark.createDataFrame([("a", 1, "W1", ["W2"], "A", 2000, 3), ("b", 2, "W2", None, "B", 2001, 0), ("c", 3, None, None, "C", None, None)], fields)
    one = lib.graph_payload(records, None).first()
    assert [tuple(e) for e in one["edges"]] == [("a", "b")] and one["shared"] == [] and len(one["papers"]) == 3
    nodes = spark.createDataFrame([("paper_c", "C", "paper", "c", ["c"]), ("paper_a", "A", "paper", "a", ["a"]), ("k", "Attention", "concept", None, ["a", "c"])], "node string, label string, file_type string, stem string, papers array<string>")
    edges = spark.createDataFrame([("paper_c", "paper_a", "cites", "E", 1.0, "c"), ("paper_c", "k", "uses", "E", 1.0, "c")], "source string, target string, relation string, confidence string, confidence_score double, paper string")
    stored = graph.stored_graph(nodes, edges, str(tmp_path))
    two = lib.graph_payload(records, stored).first()
    assert [tuple(e) for e in two["edges"]] == [("a", "b"), ("c", "a")] and [(x["a"], x["b"], x["concepts"]) for x in two["shared"]] == [("a", "c", "Attention")]
    assert graph.loaded_graph(spark, f"{tmp_path}/none") is None and graph.node_link(spark, f"{tmp_path}/none.json") is None
    data = {"directed": True, "nodes": [{"id": "k", "label": "K", "papers": ["a"]}], "links": [{"source": "k", "target": "z", "relation": "r"}]}
    (tmp_path / "graph.json").write_text(json.dumps(data))
    nodes, edges = graph.node_link(spark, f"{tmp_path}/graph.json")
    assert rows(nodes, "node", "label") == [("k", "K")] and rows(edges, "source", "target", "relation") == [("k", "z", "r")]


def test_golden_hits_and_evidence(spark):
    gold = lib.golden_set(spark, [{"q": "?", "paper": 1412.698, "contains": ["Adam"]}, {"q": "!", "paper": "p", "kind": "k", "contains": []}])
    assert rows(gold, "paper", "kind") == [("1412.698", "other"), ("p", "k")]
    shown = spark.createDataFrame([("/d/p.pdf", "we use ADAM here"), ("/d/q.pdf", "adam"), ("/d/p.pdf", "sgd")], "source string, text string")
    hit = shown.select(evidence.is_hit(F.col("source"), F.col("text"), F.lit("p"), F.array(F.lit("adam"), F.lit("zzz"))).alias("h"))
    assert [r["h"] for r in hit.collect()] == [True, False, False]
    spans = spark.createDataFrame([(1, "c1"), (2, "c2")], "answer_id int, chunk_id string")
    matches = spark.createDataFrame([(1, "c1", "/d/p.pdf", "ADAM"), (2, "c1", "/d/p.pdf", "adam"), (2, "c2", "/d/z.pdf", "adam")], "answer_id int, id string, source string, text string")
    wanted = spark.createDataFrame([(1, "p", ["adam"]), (2, "p", ["adam"]), (3, "p", ["adam"])], "answer_id int, paper string, contains array<string>")
    assert rows(evidence.cites_evidence(spans, matches, wanted), "answer_id", "cited_expected_evidence") == [(1, True), (2, False), (3, False)]


@pytest.mark.parametrize(("content", "text"), [("plain", "plain"), ('"quoted \\" text"', 'quoted " text'), ('["a", {"type": "text", "text": "b"}, {"type": "thinking"}]', "ab"), ("[]", "")])
def test_message_text(spark, content, text):
    assert spark.createDataFrame([(content,)], "c string").select(lib.message_text(F.col("c")).alias("t")).first()["t"] == text


def test_conversations_and_highlights(spark):
    counts = spark.createDataFrame([(1, "unchecked", 2), (1, "supported", 3), (1, "partial", 0), (2, "fabricated", 1)], "answer_id int, verdict string, n int")
    assert rows(lib.verdict_line(counts), "answer_id", "line") == [(1, "3 supported, 2 unchecked"), (2, "1 fabricated")]
    said = spark.createDataFrame([(1, 1, "user", "x" * 70), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (2, 1, "assistant", "e")], "conv_id int, turn int, role string, text string")
    assert rows(lib.before_last_question(said), "conv_id", "turn") == [(1, 1), (1, 2)]
    assert rows(lib.conversation_titles(said), "conv_id", "title") == [(1, "x" * 60)]
    spans = spark.createDataFrame([(1, 2, 4, 10), (1, 4, 6, 10), (2, None, None, 5), (3, None, None, 0), (4, 0, 3, 3)], "key int, start int, end int, length int")
    got = rows(lib.pieces_between(spans), "key", "start", "end", "marked")
    assert got == [(1, 0, 2, False), (1, 2, 4, True), (1, 4, 6, True), (1, 6, 10, False), (2, 0, 5, False), (4, 0, 3, True)]


def test_lines_of_spans(spark):
    fields = "paper string, page_no int, block_no int, line_no int, span_no int, kind string, text string, size double, bold boolean"
    spans = [
        ("p", 0, 0, 0, 1, "text", "lo ", 9.0, False), ("p", 0, 0, 0, 0, "text", " Hel", 12.0, True), ("p", 0, 1, 0, 0, "image", "x", 1.0, True),
        ("p", 0, 2, 0, 0, "text", "  ", 9.0, True), ("p", 0, 2, 1, 0, "text", "End", 9.0, True), ("p", 1, 0, 0, 0, "text", "Two", 8.0, False),
    ]
    got = rows(lib.lines_of(spark.createDataFrame(spans, fields)), "page_no", "line_no", "text", "size", "bold")
    assert got == [(0, 0, "Hello", 12.0, False), (0, 1, "End", 9.0, True), (1, 0, "Two", 8.0, False)]


def test_index_skips_headers_and_formulas_and_both_ways_agree(spark, tmp_path, monkeypatch):
    texts = [("a", "Title of all\n\nred fox", "prose"), ("b", "Title of all\n\nx = y fox", "math"), ("c", "red red cat", "prose"), ("d", "blue title", None), ("e", "", "prose")]
    docs = spark.createDataFrame([(i, t, c, f"/d/{i}.pdf") for i, t, c in texts], "id string, text string, content_type string, source string")
    index = lexical.Index.write(docs, str(tmp_path), "id")
    assert index.stats.first()["n_docs"] == 5 and rows(index.terms.where("term = 'title'"), "df") == [(1,)] and index.terms.where("term = 'y'").count() == 0
    ask = spark.createDataFrame([(1, "title fox"), (2, "red blue cat red"), (3, "zebra"), (4, "")], "q int, text string")
    whole = rows(index.search(ask, 2), "q", "rank", "id", "score")
    assert {r[2] for r in whole if r[0] == 1} == {"a", "d"} and {r[0] for r in whole} == {1, 2}
    for least in (0, 1):
        monkeypatch.setattr(lexical, "COMMON_LEAST", least)
        monkeypatch.setattr(lexical, "COMMON_SHARE", 0.0)
        assert rows(index.search(ask, 2), "q", "rank", "id", "score") == whole


def test_passages_for_a_question(spark, tmp_path):
    texts = [f"{w} common words" for w in ("apple", "berry", "cherry", "date", "elder", "fig")]
    chunks = spark.createDataFrame([(f"s{i % 2}-chunk-{i // 2}", f"s{i % 2}", i // 2, f"s{i % 2}-chunk-{i // 2 - 1}" if i > 1 else None, f"s{i % 2}-chunk-{i // 2 + 1}" if i < 4 else None, t) for i, t in enumerate(texts)], "id string, source string, chunk_index int, prev_id string, next_id string, text string")
    own = lib.embedded(chunks.select("id", "text")).select("id", "embedding")
    ask = lib.embedded(spark.createDataFrame([(1, "cherry")], "id int, text string")).withColumnRenamed("id", "q")
    index = lexical.Index.write(chunks, str(tmp_path), "id")
    found = question.retrieve_passages(index, chunks, own, ask, k=1)
    assert [(r["place"], r["id"], r["channels"]) for r in found.orderBy("place").collect()] == [(1, "s0-chunk-0", "neighbour"), (2, "s0-chunk-1", "bm25,dense"), (3, "s0-chunk-2", "neighbour")]
    said = spark.createDataFrame([(1, "[2]")], "q int, reply string")
    assert question.retrieve_passages(index, chunks, own, ask, replies=said, k=1, budget=0).first()["id"] != "s0-chunk-1"
