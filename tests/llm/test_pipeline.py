"""What each stage of the pipeline keeps and changes, by value."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(2)


def kept(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"]) for r in df.collect())


def test_language_keeps_all_with_letters(spark):
    rows = [(1, "ein text", "de"), (2, "a text", "en"), (2, "a text", "en"), (3, None, "en"), (4, "", "en"), (5, "123 !!", "en"), (None, "más texto", None), (6, "日本", "ja")]
    want = sorted([(1, "ein text"), (2, "a text"), (2, "a text"), (-1, "más texto"), (6, "日本")])
    assert kept(cp.language(spark, frame(spark, rows), SF)) == want
    assert kept(cp.language(spark, frame(spark, [(i, t, None) for i, t, _ in rows]), SF)) == want  # nothing to learn from


def test_near_duplicates_keep_one_of_a_group(spark):
    near = LONG.replace("word30", "other")
    rows = [(4, LONG, "en"), (3, near, "en"), (9, "something else entirely", "en"), (9, LONG, "en"), (7, "a b", "en"), (8, "a b c d e f", "en"), (None, LONG, "en")]
    assert kept(cp.near_duplicates(spark, frame(spark, rows), SF)) == sorted([(3, near), (9, "something else entirely"), (7, "a b"), (8, "a b c d e f")])


def test_leaks_go_and_clean_documents_stay(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    rows = [(i, f"Before. {t} After.", "en") for i, t in enumerate(items)] + [(10, LONG, "en"), (11, None, "en"), (12, "", "en"), (None, LONG, "en")]
    assert [x[0] for x in kept(cp.benchmark_leaks(spark, frame(spark, rows).na.fill("~", ["text"]), SF))] == [-1, 10, 11, 12]


def test_personal_data_and_encoding(spark):
    rows = [(1, "write to ann.b@x.com or ann.b@x.com", "en"), (2, "ann.b@x.com", "en"), (3, None, "en"), (4, "nothing", "en")]
    out = {r["doc_id"]: r for r in cp.personal_data(spark, frame(spark, rows), SF).collect()}
    new = out[2]["text"]
    assert new != "ann.b@x.com" and out[1]["text"] == f"write to {new} or {new}" and out[3]["text"] is None and out[4]["text"] == "nothing"
    got = {r["doc_id"]: r for r in cp.encoding(spark, frame(spark, rows), SF).collect()}
    assert got[3]["n_tokens"] == 0 and got[4]["round_trip"] and len(got[4]["ids"]) == got[4]["n_tokens"] > 0


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert kept(docs) == kept(cp.run(spark, SF))
