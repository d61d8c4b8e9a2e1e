"""Literal cases of parsing, splitting, evidence, bibliography and graph search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import biblio, blocks, evidence, graph, lexical, matching, passages, retrieval
from folioscope.sources import tables


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


def kinds(lines, mathy=None):
    return [(b["content_type"], b["text"]) for b in blocks.typed(lines, mathy or [False] * len(lines), False)]


def test_mathy(spark):
    for t, wanted in [("We use N = 6 layers", False), ("θt+1,i −θ∗,i = αt · ∑ βt−j", True), ("x = y", True), ("", False), ("=" * 201, False), ("the rate of loss", False)]:
        assert one(spark, passages.is_mathy(F.col("t")), t=t) == wanted, t
    assert one(spark, passages.is_mathy(F.lit(None).cast("string"))) is False


def test_blocks_captions_and_maths(spark):
    end = "This sentence is long enough to tell that the running text of the paper has come back after the table " + "z" * 20 + "."
    rows = ["Intro text.", "Table 1: numbers", "1 2 3", "4 5 6", end]
    assert kinds(rows) == [("prose", "Intro text."), ("table", "Table 1: numbers\n1 2 3\n4 5 6"), ("prose", end)]
    assert kinds(["Fig. 2: a", "Algorithm 1 b"]) == [("figure", "Fig. 2: a"), ("algorithm", "Algorithm 1 b")]
    assert kinds(["words", "x", "y", "more"], [False, True, True, False]) == [("prose", "words x y more")]
    long = "w" * 250
    assert kinds([long, *["a = b + c"] * 3, long], [False, True, True, True, False]) == [("prose", long + "\n\n" + "a = b + c a = b + c a = b + c"), ("prose", long)]
    assert kinds([long, *["a" * 90] * 3, long], [False, True, True, True, False])[1] == ("math", " ".join(["a" * 90] * 3))
    # A short equation right before a caption opens the prose after the unit, or stands before it if none follows.
    assert kinds([long, "x = 1", "Table 1", end], [False, True, False, False]) == [("prose", long), ("table", "Table 1"), ("prose", "x = 1 " + end)]
    assert kinds([long, "x = 1", "Table 1"], [False, True, False]) == [("prose", long + "\n\nx = 1"), ("table", "Table 1")]
    assert kinds(["", "  ", None]) == [] and blocks.typed([], [], True) == []
    assert blocks.typed(["[1] A. Author. compu-", "ting."], [False] * 2, True) == [{"content_type": "reference", "text": "[1] A. Author. computing."}]
    many = kinds(["Table 9", *["7" * 90] * 60])
    assert many[0][0] == "table" and len(many[0][1]) == 3000 and many[1][0] == "prose"


def test_reflow():
    assert blocks.reflowed(["a computa-", "tional cost", "of state-of-the-", "Art ends.", "New one"]) == "a computational cost of state-of-the- Art ends.\n\nNew one"
    assert blocks.reflowed([]) == ""


def test_overlapped_pieces():
    rng = random.Random(7)
    for _ in range(60):
        n = itertools.count()
        text = "".join(rng.choice([f"w{next(n)}", " ", ". ", "\n", "\n\n", "? ", "-".join(f"x{next(n)}" for _ in range(20)), f"é{next(n)}"]) for _ in range(rng.randrange(200)))
        parts = passages.overlapped(text, 50, 12)
        assert all(0 < len(p) <= 50 and p in text for p in parts)
        # Nothing is lost: all that is not white space comes again, in order.
        again = iter("".join(parts))
        assert all(c in again for c in "".join(text.split()))
    assert passages.overlapped("One two. Three four. Five six.", 22, 10) == ["One two. Three four.", "Five six."]
    assert passages.overlapped("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert passages.overlapped("", 10, 2) == [] and passages.overlapped(" \n ", 10, 2) == []


def test_split_long_keeps_hard_cuts_apart(spark):
    cut = passages.split_long(10)
    assert one(spark, cut(F.col("t")), t="x" * 12 + "\n\nab") == ["x" * 10, "xx", "ab"]
    assert one(spark, cut(F.col("t")), t="abc\n\ndef\n\nghij") == ["abc\n\ndef", "ghij"]


LINES = "paper string, page_no int, line_no int, text string, size double, bold boolean"


def test_parse_and_chunks(spark):
    body = [f"Sentence number {i} has some words in it to fill the page with." for i in range(120)]
    rows = [("p", 1, 0, "arXiv: 1234.5678", 30.0, False), ("p", 1, 1, "Deep Lan-", 20.0, False), ("p", 1, 2, "guage Nets", 20.0, False), ("p", 1, 3, "1 Method", 10.0, True)]
    rows += [("p", 1 + i // 50, 4 + i, t, 10.0, False) for i, t in enumerate(body)]
    rows += [("p", 9, 900, "References", 10.0, False), ("p", 9, 901, "[1] Someone.", 10.0, False), ("q", 1, 1, "only text", 10.0, False)]
    parsed = blocks.parse(spark.createDataFrame(rows, LINES))
    got = {(r["paper"], r["section_no"], r["part"]): r for r in parsed.collect()}
    parts = [r["section"] for k, r in sorted(got.items()) if r["section"].startswith("1 Method")]
    assert parts == ["1 Method (1)", "1 Method (2)"] and {r["paper_title"] for r in got.values()} == {"Deep Language Nets", "only text"}
    found = blocks.chunks(parsed, 300, 50).orderBy("paper", "seq").collect()
    assert [r["seq"] for r in found if r["paper"] == "p"] == list(range(sum(r["paper"] == "p" for r in found)))
    assert not [r for r in found if r["section"] == "References"] and all(len(r["body"]) <= 300 for r in found)
    assert found[-1]["text"] == "only text — Page 1\n\nonly text" and found[-1]["page"] == 1
    assert blocks.chunks(parsed, 300, 50, references=True).where("content_type = 'reference'").first()["text"].startswith("Deep Language Nets — References — Reference\n\n")
    assert blocks.parse(spark.createDataFrame([], LINES)).count() == 0


@pytest.mark.parametrize("width", [2, 4096])
def test_chunk_records_in_ranges(spark, width):
    rows = [("a", i, "x" * i) for i in range(1, 8)] + [(None, 1, "n"), ("b", 5, None), ("b", 9, "")]
    got = passages.chunk_records(spark.createDataFrame(rows, "source string, seq long, text string"), width=width).orderBy("source", "seq").collect()
    a = [r for r in got if r["source"] == "a"]
    assert len(got) == 10 and [r["chunk_index"] for r in a] == list(range(7))
    assert [r["doc_start"] for r in a] == [0, *itertools.accumulate(i + 2 for i in range(1, 7))]
    assert a[0]["prev_id"] is None and a[-1]["next_id"] is None and [r["next_id"] for r in a[:-1]] == [r["id"] for r in a[1:]] and [r["prev_id"] for r in a[1:]] == [r["id"] for r in a[:-1]]


def test_claims(spark):
    answer = 'It uses "dropout" [p-chunk-1 "dropout  in the first two"]. It has [p-chunk-1 "rate of 0.7"]. Also [q-chunk-9 "some quote"]. Bare [p-chunk-1] here. ' + "Nothing cited in this sentence that is long enough."
    answers = spark.createDataFrame([(1, answer), (2, "")], "answer_id int, answer string")
    got = spark.createDataFrame([(1, "p-chunk-1", "we use dropout in the first two layers", 5000)], "answer_id int, id string, text string, doc_start int")
    found = evidence.claim_spans(answers, got)
    rows = found.orderBy("pos").collect()
    assert [r["verdict"] for r in rows] == ["unchecked", "fabricated", "fabricated", "unchecked", "unchecked"]
    span = rows[0]["spans"][0]
    assert (span["start"], span["doc_start"], span["exact"]) == (7, 5007, False) and "q-chunk-9" in rows[2]["reason"]
    tell = lambda reply: evidence.judged_claims(found, spark.createDataFrame([(1, reply)], "answer_id int, reply string")).orderBy("pos")
    assert tell('ok [{"n": 1, "verdict": "SUPPORTED", "why": "said"}]').first()["verdict"] == "supported"
    for bad in ("error", "[{", None, '[{"n": 4, "verdict": "supported"}]', '[{"n": 1, "verdict": "maybe"}]'):
        assert tell(bad).first()["verdict"] == "unchecked", bad
    told = evidence.claim_summary(tell('[{"n": 1, "verdict": "unsupported"}]')).first()
    assert (told["n_unsupported"], told["n_fabricated"], told["n_uncited"], [f["pos"] for f in told["flagged"]]) == (1, 2, 1, [0, 1, 2])
    assert '"docStart":5007' in evidence.payload(found).where("answer_id = 1").first()["claims"]


def test_run_summary(spark):
    rows = [(["supported", "partial", "unsupported", "fabricated"], 1, True, None), (["x"], 9, True, "boom")]
    shape = "verdicts array<string>, bare_citations int, cited_expected_evidence boolean, error string"
    got = evidence.run_summary(spark.createDataFrame(rows, shape)).first()
    assert (got["quote_rate"], got["support_rate"], got["scored"], got["failed"], got["bare_citations"]) == (0.75, 0.333, 1, 1, 1)
    assert evidence.run_summary(spark.createDataFrame([], shape)).first()["quote_rate"] is None


def test_stances(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "q int, rank int, id string")
    reply = '[{"n": 1, "stance": "Supports", "claim": "yes"}, {"n": 2, "stance": "contradicts", "claim": "no"}, {"n": 99, "stance": "supports"}]'
    got = evidence.stances(rows, spark.createDataFrame([(0, reply)], "q int, reply string"))
    assert [r["stance"] for r in got.orderBy("rank").collect()] == ["supports", "contradicts", "neutral"]
    years = spark.createDataFrame([("a", "P", 2019), ("b", "Q", 2023), ("c", "R", 0)], "id string, paper string, year int")
    text = evidence.split_text(got.join(years, "id")).first()["block"]
    assert "more recent (2023+) than the support (to 2019)" in text and "  - Q: no" in text and "1 paper(s) support: P" in text
    assert evidence.split_text(got.where("stance <> 'contradicts'").join(years, "id")).count() == 0


def test_rerank_fills_up_to_least(spark):
    p = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate("abcdefgh")], "q int, rank int, id string")
    ask = lambda reply: [r["id"] for r in retrieval.reranked(p, spark.createDataFrame([(0, reply)], "q int, reply string"), 6).orderBy("place").collect()]
    assert ask("[5]") == ["e", "a", "b"] and ask("none") == list("abcdef") and ask("[5, 4, 3, 2]") == list("edcb") and ask("[1,]") == list("abcdef")


def test_expansion_in_reading_order(spark):
    chain = spark.createDataFrame([(f"c{i}", "s", i, f"c{i - 1}" if i else None, f"c{i + 1}" if i < 4 else None, "x" * 10) for i in range(5)], "id string, source string, chunk_index int, prev_id string, next_id string, text string")
    ranked = spark.createDataFrame([(0, 1, "c3", "bm25"), (0, 2, "c1", "bm25")], "q int, rank int, id string, channels string")
    order = lambda budget: [r["id"] for r in retrieval.expanded(ranked, chain, budget).orderBy("place").collect()]
    assert order(100) == ["c0", "c1", "c2", "c3", "c4"] and order(31) == ["c1", "c2", "c3"] and order(20) == ["c3", "c1"]
    full = chain.withColumns({"content_type": F.lit("table"), "paper_title": F.lit("T"), "section": F.lit(None).cast("string")})
    assert retrieval.formatted(retrieval.expanded(ranked, chain, 20), full).first()["context"].startswith("[c3] [table] (T — ?)\nx")


def test_dense_blocks_agree(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    q = rows.where("vec_id < 9").select(F.col("vec_id").alias("q"), "embedding")
    assert sorted(retrieval.dense_top_k(rows, q, 5).collect()) == sorted(retrieval.dense_top_k(rows, q, 5, block=2).collect())


def test_dense_blocks_have_the_scores_of_cosine(spark, monkeypatch):
    some = [(i, [float((i * 7 + d * d) % 11 - 5) if i % 9 else 1.0 for d in range(6)]) for i in range(90)]
    some += [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [1.0, 2.0]), (93, [2.0, 4.0]), (94, [0.0] * 6)]
    rows = spark.createDataFrame(some, "vec_id long, embedding array<float>").repartition(5)
    q = rows.where("vec_id % 5 = 0 or vec_id > 89").where("vec_id <> 94").select(F.col("vec_id").alias("q"), "embedding")
    pairs = rows.where("vec_id <> 94").crossJoin(q.withColumnRenamed("embedding", "e"))
    want = lexical.top_k(pairs.select("q", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("e")), 6).alias("score")), 4, "vec_id")
    monkeypatch.setattr(retrieval, "cosine", None)  # pair by pair is too slow for large tables
    for block in (3, 2048):
        assert sorted(map(str, retrieval.dense_top_k(rows.where("vec_id <> 94"), q, 4, block).collect())) == sorted(map(str, want.collect()))
    first = [r["vec_id"] for r in retrieval.dense_top_k(rows, q.where("q = 5"), 1).collect()]
    assert first == [94]  # a zero vector's score is NaN, which SQL puts first
    named = rows.select(F.concat(F.lit("s"), "vec_id").alias("vec_id"), "embedding")
    assert retrieval.dense_top_k(named, q.where("q = 5"), 4).count() == 4


def test_expanded_queries(spark):
    q = spark.createDataFrame([(0, "one"), (1, "two")], "q int, text string")
    got = retrieval.expanded_queries(q, spark.createDataFrame([(0, 'so ["ONE", " a ", "", "b", "c", "d"]'), (1, "no")], "q int, reply string"))
    assert [(r["q"], r["text"]) for r in got.orderBy("q", "n").collect()] == [(0, "one"), (0, "a"), (0, "b"), (0, "c"), (1, "two")]


def test_identifiers(spark):
    for t, wanted in [
        ("https://arxiv.org/abs/1706.03762", "1706.03762"), ("http://arxiv.org/pdf/1706.03762v5", "1706.03762v5"), ("arxiv.org/pdf/1706.03762.pdf", "1706.03762"),
        ("https://arxiv.org/html/2311.05232v2", "2311.05232v2"), ("  arXiv:1706.03762  ", "1706.03762"), ("1706.03762", "1706.03762"), ("https://arxiv.org/abs/cs/0501001", "cs/0501001"),
        ("", None), ("how does attention work", None), ("https://example.com/paper", None),
    ]:
        assert one(spark, tx.arxiv_id(F.col("t")), t=t) == wanted, t
    assert one(spark, tx.stamped_arxiv_id(F.col("h"), F.col("n")), h="no", n="1706.03762") == "1706.03762"
    assert one(spark, tx.stem(F.col("t")), t="/data/a.b/bert.v1.pdf") == "bert.v1"


def test_warnings_and_titles(spark):
    warn = lambda **v: one(spark, biblio.warnings(F.col("r"), F.col("n"), F.col("d"), F.col("a")), **v)
    assert warn(r=True, n="", d="10.1/x", a="") == ["RETRACTED: this work has been retracted"]
    assert "could not be checked" in warn(r=False, n="", d="", a="")[0]
    close = biblio.title_close()
    assert not one(spark, close(F.col("a"), F.col("b")), a="Attention Is All You Need", b="Tensor Product Attention Is All You Need")


NODES = [
    ("bert", 0, "b_paper", "BERT: Pre-training", "paper", False), ("bert", 1, "b_model", "BERT (Bidirectional Encoders)", "concept", False),
    ("bert", 2, "b_tf", "Transformer architecture (Vaswani et al., 2017)", "concept", True), ("bert", 3, "b_attn", "Attention Is All You Need (Vaswani)", "paper", True),
    ("vit", 0, "v_paper", "An Image is Worth 16x16 Words", "paper", False), ("vit", 1, "v_model", "Vision Transformer", "concept", False), ("vit", 2, "v_tf", "Transformer Architecture", "concept", True),
]
EDGES = [("bert", 0, "b_model", "b_tf", "implements"), ("bert", 1, "b_paper", "b_attn", "cites"), ("vit", 0, "v_model", "v_tf", "implements"), ("vit", 1, "v_model", "v_model", "implements"), ("vit", 2, "v_model", "gone", "x")]


@pytest.fixture(scope="module")
def library(spark):
    nodes = spark.createDataFrame(NODES, "paper string, ord int, id string, label string, file_type string, is_stub boolean")
    edges = spark.createDataFrame(EDGES, "paper string, ord int, source string, target string, relation string").withColumns({"confidence": F.lit("EXTRACTED"), "confidence_score": F.lit(1.0)})
    titles = spark.createDataFrame([("bert", ["BERT: Pre-training"]), ("vit", ["An Image is Worth 16x16 Words"]), ("attn", ["Attention Is All You Need"])], "stem string, names array<string>")
    return graph.merged_extractions(nodes, edges, titles, spark.createDataFrame([("vit", "bert"), ("vit", "none")], "citing string, cited string"))


def ask(spark, text):
    return spark.createDataFrame([(0, text)], "q int, text string")


def test_extraction_merge(library):
    nodes, edges = library
    papers = {r["node"]: r["papers"] for r in nodes.collect()}
    assert papers["concept_transformer_architecture"] == ["bert", "vit"] and papers["paper_attn"] == ["attn"] and len(papers) == 6
    assert sorted((r["citing"], r["relation"], r["cited"]) for r in graph.paper_links(nodes, edges).collect()) == [("bert", "cites", "attn"), ("vit", "cites", "bert")]
    assert edges.count() == 4


def test_graph_questions(spark, library):
    nodes, edges = library
    related = lambda t: {r["paper"] for r in graph.related_papers(nodes, edges, graph.question_seeds(nodes, edges, ask(spark, t))).collect()}
    assert related("Which models use the Transformer?") == {"bert", "vit"} and related("What is the capital of France?") == set()
    found = graph.question_facts(nodes, edges, graph.question_seeds(nodes, edges, ask(spark, "How does Vision Transformer relate to the Transformer architecture?")))
    assert ("Vision Transformer", "implements", "Transformer architecture (Vaswani et al., 2017)", "vit", "EXTRACTED") in [tuple(r)[2:] for r in found.collect()]
    block = graph.facts_block(found).first()["block"]
    assert "Vision Transformer -[implements]-> Transformer architecture" in block and "Never cite" in block


def test_graph_search(spark, library, tmp_path):
    nodes, edges = library
    texts = [("b1", "BERT stacks transformer encoder layers", "/data/bert.pdf"), ("v1", "Vision Transformer splits an image into patches", "/data/vit.pdf"), ("g1", "The transformer in this generator is unrelated", "/data/gan.pdf")]
    docs = spark.createDataFrame(texts + [(f"x{i}", "noise samples feed a sampler", "/data/gan.pdf") for i in range(9)], "doc_id string, text string, source string")
    assert {r["doc_id"] for r in graph.search(lexical.Index.write(docs, str(tmp_path)), docs, nodes, edges, ask(spark, "Which models use the Transformer?"), 5).collect()} == {"b1", "v1"}
    assert graph.search(lexical.Index.write(docs, str(tmp_path)), docs, nodes, edges, ask(spark, "capital of France"), 5).count() == 0


def test_title_citations(spark):
    squash = lambda t: tx.squash(tx.nfkc()(F.col(t)))
    texts = spark.createDataFrame([("bert", "[12] A. Vaswani. Atten-\ntion is all\nyou need. NeurIPS"), ("attn", "Attention Is All You Need"), ("r", "classiﬁcation with deep nets, and deep nets"), ("r", ""), ("n", None)], "stem string, text string")
    titles = spark.createDataFrame([("attn", "Attention Is All You Need"), ("c", "Classification with Deep"), ("d", "Deep nets"), ("e", None)], "stem string, name string")
    got = graph.title_citations(texts.select("stem", squash("text").alias("squashed")), titles.select("stem", squash("name").alias("name")))
    assert sorted(map(tuple, got.collect())) == [("bert", "attn"), ("r", "c")]


@pytest.mark.parametrize("sifted", [0, 1 << 18])
def test_holding_agrees_with_all_pairs(spark, monkeypatch, sifted):
    monkeypatch.setattr(matching, "SIFTED_MOST", sifted)
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(60)))) for i in range(40)] + [(40, None), (41, ""), (1, "aaa")]
    parts = [(i, rng.choice(texts[:40])[1][: rng.choice([1, 4, 9, 12, 13, 30])]) for i in range(30)] + [(30, ""), (31, None), (0, "bbbb")]
    got = matching.holding(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame(parts, "wanted int, part string"))
    assert {tuple(r) for r in got.collect()} == {(k, w, p) for k, t in texts for w, p in parts if t and p and p in t}
    assert matching.holding(spark.createDataFrame([], "key int, text string"), spark.createDataFrame([], "wanted int, part string")).count() == 0


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([("a", i, f"text Table {i}") for i in range(8)], "source string, page int, text string")
    wanted = spark.createDataFrame([(1, "a", 1, "Table 4"), (2, "a", 99, ""), (3, "a", -3, None), (4, "a", 1, "Table 7")], "id int, source string, page int, caption string")
    assert sorted(map(tuple, tables.page_of_caption(pages, wanted).collect())) == [(1, 4), (2, 7), (3, 0), (4, 1)]
    names = spark.createDataFrame([(1, "a.pdf"), (2, "x/a.pdf"), (3, "b")], "ord int, name string")
    assert [r["stored"] for r in tables.numbered_names(names).orderBy("ord").collect()] == ["a.pdf", "a-1.pdf", "b.pdf"]
    (tmp_path / "bert.json").write_text('{"nodes": [{"id": "x", "label": "X", "file_type": "concept", "metadata": {"graphify_reference_stub": true}}], "edges": [{"source": "x", "target": "x"}]}')
    (tmp_path / "bad.json").write_text('{"failed_chunks": 2, "nodes": [{"id": "y"}]}')
    nodes, edges = tables.extractions(spark, str(tmp_path))
    assert [(r["paper"], r["id"], r["is_stub"]) for r in nodes.collect()] == [("bert", "x", True)] and edges.count() == 1


def test_stripped_edges(spark):
    rows = [(1, None), (2, ""), (3, '[x-chunk-1]  and  [x-chunk-1][y-chunk-2 "some words"]'), (4, "no  marks")]
    answers = spark.createDataFrame(rows, "answer_id int, answer string")
    none = spark.createDataFrame([], "id string")
    known = spark.createDataFrame([("y-chunk-2",), ("y-chunk-2",)], "id string")
    text = lambda df: {r["answer_id"]: r["answer"] for r in df.collect()}
    assert text(evidence.stripped(answers, none)) == {1: None, 2: "", 3: " and ", 4: "no marks"}
    assert text(evidence.stripped(answers, known))[3] == ' and [y-chunk-2 "some words"]'


def test_kinds_and_map_edges(spark):
    golden = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "q int, kind string")
    found = spark.createDataFrame([(1, 9, True), (3, 2, True), (3, 1, False), (2, 3, False)], "q int, rank int, hit boolean")
    assert {(r["kind"], r["n"], r["hits"]) for r in evidence.hits_by_kind(golden, found).collect()} == {("a", 2, 1), ("other", 1, 0)}
    papers = spark.createDataFrame([("a", 2017), ("b", None), ("c", 0)], "paper string, year int")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), ("c", "b")], "citing string, cited string")
    assert {tuple(r) for r in graph.map_rows(papers, edges).collect()} == {("a", 2017, 2017, 1, 0), ("b", None, 9999, 0, 2), ("c", 0, 9999, 1, 0)}
