"""Literal cases, and properties that the SQL comparison does not reach."""

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import biblio, evidence, graph, lexical, passages, retrieval
from folioscope.sources import tables
from folioscope.streaming import ingest


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, tx.tokens(F.col("t")), t="β1 = 0.9 and ε = 10−8, Σ over all i für")
    assert {"beta1", "epsilon", "sigma", "für"} <= set(got)


def test_labels_and_ids(spark):
    assert one(spark, tx.norm_label(F.col("t")), t="Transformer architecture (Vaswani et al., 2017)") == "transformer architecture"
    assert one(spark, tx.norm_label(F.col("t")), t="(MLM)") == "mlm"
    assert one(spark, tx.body_of(F.col("t")), t="Title - Section\n\nbody") == "body"
    assert one(spark, tables.safe_pdf_name(F.col("t")), t="../../etc/passwd") == "passwd.pdf"


def test_bm25_finds_rare_terms(spark):
    docs = spark.createDataFrame([(1, "β1 = 0.9 default value"), (2, "residual stream"), (3, "attention heads"), (4, "")], "doc_id int, text string")
    q = spark.createDataFrame([(0, "beta1 default value")], "q int, text string")
    assert [r["doc_id"] for r in lexical.bm25(docs, q, 1).collect()] == [1]
    assert lexical.bm25(docs.where("doc_id > 9"), q).count() == 0


def test_rrf(spark):
    ranked = lambda ids: spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(ids)], "q int, rank int, doc_id string")
    got = retrieval.rrf([("dense", ranked("bac")), ("bm25", ranked("dae"))]).orderBy("rank").collect()
    assert got[0]["doc_id"] == "a" and got[0]["channels"] == "bm25,dense"
    assert retrieval.rrf([("a", ranked("")), ("b", ranked(""))]).count() == 0


def test_rerank_keeps_least(spark):
    p = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate("abc")], "q int, rank int, id string")
    ask = lambda reply: [r["id"] for r in retrieval.reranked(p, spark.createDataFrame([(0, reply)], "q int, reply string"), 2, 2).orderBy("place").collect()]
    assert ask("[3, 1, 2]") == ["c", "a"] and ask("no list") == ["a", "b"] and ask("[99, 2, 2, 0, 1]") == ["b", "a"] and ask("[3]") == ["c", "a"]


def test_cap_demotes(spark):
    rows = spark.createDataFrame([(0, i + 1, s) for i, s in enumerate("aaabc")], "q int, rank int, source string")
    assert [r["source"] for r in retrieval.cap_per_source(rows, 1).orderBy("rank").collect()] == list("abcaa")


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(0, 1, "a", 5), (0, 2, "b", 50), (0, 3, "c", 4)], "q int, first int, id string, size int")
    assert retrieval.within_budget(rows, 10).first()["taken"] == ["a", "c"]


def test_lines(spark):
    texts = ["computa-", "tional cost.", "state-of-the-", "Art is", "wrapped"]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "key int, pos int, text string")
    got = [r["text"] for r in passages.spliced(rows).orderBy("line_no").collect()]
    assert got == ["computational cost.", "state-of-the-", "Art is", "wrapped"]


def test_sections(spark):
    rows = [("p", 1, 1, "A Title", 20.0, False), ("p", 1, 2, "by someone", 10.0, False), ("p", 1, 3, "1 Introduction", 12.0, True), ("p", 1, 4, "text one", 10.0, False), ("p", 2, 1, "Figure 3", 14.0, False), ("p", 2, 2, "Results.", 10.0, False), ("p", 2, 3, "more", 10.0, False), ("r", 1, 1, "plain", 10.0, False)]
    lines = spark.createDataFrame(rows, "paper string, page_no int, line_no int, text string, size double, bold boolean")
    got = {(r["paper"], r["section"]): r["text"] for r in passages.sections(lines).collect()}
    assert got == {("p", "A Title"): "by someone", ("p", "1 Introduction"): "text one\nFigure 3", ("p", "Results."): "more", ("r", "Page 1"): "plain"}


def test_split_long(spark):
    parts = one(spark, passages.split_long(4000)(F.col("t")), t="x" * 9500)
    assert max(map(len, parts)) <= 4000 and sum(map(len, parts)) == 9500


def test_flexible_quote(spark):
    got = one(spark, evidence.flexible_place()(F.col("q"), F.col("t")), q="dropout  IN the", t="we use dropout in\nthe first")
    assert (got["start"], got["exact"]) == (7, False)


def test_spans_merge_and_clamp(spark):
    rows = spark.createDataFrame([(0, -3, 2, 10), (0, 2, 4, 10), (0, 6, 6, 10), (0, 8, 99, 10)], "key int, start int, end int, length int")
    assert sorted((r["start"], r["end"]) for r in evidence.merged_spans(rows).collect()) == [(0, 4), (8, 10)]


def test_titles_and_graph(spark):
    close = biblio.title_close()
    assert one(spark, close(F.col("a"), F.col("b")), a="Attention Is All You Need", b="attention is all you need!")
    assert not one(spark, close(F.col("a"), F.col("b")), a="Attention Is All You Need", b="Not All You Need")
    edges = spark.createDataFrame([("a", "b", "x", 0.1, 1), ("a", "b", "cites", 0.2, 2), ("a", "a", "x", 0.1, 3)], "source string, target string, relation string, score double, ord int")
    assert [tuple(r) for r in graph.merged_edges(edges).collect()] == [("a", "b", "cites", 0.2)]


def test_bibtex(spark):
    got = one(spark, biblio.bibtex_key(F.col("a"), F.col("y"), F.col("t")), a=["Ashish Vaswani"], y=2017, t="Attention Is All You Need")
    assert got == "vaswani2017attention"
    assert one(spark, biblio.tex_escaped(F.col("t")), t="a_b & 5% \\") == r"a\_b \& 5\% \textbackslash{}"


def test_ingest_in_parts_again_and_deleted(spark, tmp_path):
    out = str(tmp_path / "out")
    first = [("/d/a.pdf", "h" * 12, 1, "one"), ("/d/b.pdf", "g" * 12, 1, "three")]
    second = [("/d/a.pdf", "h" * 12, 2, "two"), ("/d/a.pdf", "h" * 12, 1, "one"), ("/d/c.pdf", None, 1, "lost")]
    for n, part in enumerate((first, second, first)):
        spark.createDataFrame(part, ingest.PIECES).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(ingest.PIECES).parquet(str(tmp_path / "in" / str(n)))
        ingest.start(stream, out, str(tmp_path / f"state{n}")).awaitTermination()
    got = {(r["id"], r["prev_id"], r["text"], r["doc_start"]) for r in spark.read.parquet(f"{out}/chunks").collect()}
    assert got == {("a-hhhhhhhh-chunk-0", None, "one", 0), ("a-hhhhhhhh-chunk-1", "a-hhhhhhhh-chunk-0", "two", 5), ("b-gggggggg-chunk-0", None, "three", 0)}
    gone = spark.createDataFrame([("h" * 12,), ("x",)], "file_hash string")
    assert ingest.kept(spark, out, gone).count() == 1
    ingest.drop(spark, out, gone)
    assert [r["id"] for r in ingest.held(spark, f"{out}/chunks").collect()] == ["b-gggggggg-chunk-0"]
    ingest.take(spark.createDataFrame(second, ingest.PIECES), out)
    assert ingest.held(spark, f"{out}/chunks").count() == 3
