"""Every query of the library, by name, with the SQL that must give the same rows.

The tables stand in for a document library: a document is a passage, its source a paper, a benchmark item a question
whose answer is the passage that holds it, and lineitem a graph of suppliers and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import biblio, blocks, evidence, graph, lexical, passages, question, retrieval
from folioscope.sources import library as lib
from folioscope.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def docs(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "documents")


def questions(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "benchmark").select(F.col("item_id").alias("q"), "text")


TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
#: Two sources hold nothing but formulas, whose words are not indexed; a passage's header is not either.
BODY = r"""typed AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src13') THEN '' WHEN instr(text, chr(10) || chr(10)) BETWEEN 1 AND 200 THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE text END AS text FROM documents)"""
POST = f"""
{BODY}, tok AS (SELECT doc_id, unnest({TOK}) AS term FROM typed),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN post p USING (doc_id) GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, sum(dl) AS n_tokens, sum(dl) / count(*) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT item_id AS q, unnest({TOK}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT q, p.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM post p JOIN qt USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = p.doc_id, stats GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0) WHERE rank <= 8)"""

DENSE = """
asked AS (SELECT item_id AS q, embedding AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
de AS (SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank, vec_id AS doc_id
       FROM (SELECT q, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS s FROM embeddings JOIN documents ON doc_id = vec_id, asked)) WHERE rank <= 8)"""
FUSED = f"""{POST}, {DENSE},
ch AS (SELECT q, doc_id, rank, 0 AS no, 'bm25' AS channel FROM bm UNION ALL SELECT q, doc_id, rank, 1, 'dense' FROM de),
fu AS (SELECT q, doc_id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, min(no * 1000 + rank) AS f, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM ch GROUP BY 1, 2),
fused AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, f, doc_id) AS rank, doc_id, score, channels FROM fu)"""
INDEXES: dict = {}


def typed(s, d):
    """The documents with the type of their content."""
    return docs(s, d).withColumn("content_type", F.when(F.col("source").isin("src1", "src13"), "math").when(F.col("lang") == "de", "reference").otherwise("prose"))


def index(s, d):
    """The lexical index of the documents: written by the first query of a session that needs it, read by the others."""
    at = (s.sparkContext.applicationId, d)
    if at not in INDEXES:
        INDEXES[at] = tables.shared_path(s, "index")
        return lexical.Index.write(typed(s, d), INDEXES[at])
    return lexical.Index.read(s, INDEXES[at])


@query(f"SELECT doc_id, len({TOK})::BIGINT AS n_tokens FROM documents")
def tokens_per_doc(s, d):
    return docs(s, d).select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {POST} SELECT term, df FROM dfs")
def term_df(s, d):
    return index(s, d).terms.select("term", "df")


@query(f"WITH {POST} SELECT n_docs, n_tokens::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(s, d):
    return index(s, d).stats.select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {POST} SELECT q, rank, doc_id, score FROM bm")
def bm25_topk(s, d):
    return index(s, d).search(questions(s, d))


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s) WHERE rank <= 8""")
def dense_topk(s, d):
    e = tables.table(s, d, "embeddings")
    return retrieval.dense_top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"))


def asked(s, d):
    """q, text, embedding: the benchmark's items with the vectors of their numbers."""
    return questions(s, d).join(tables.table(s, d, "embeddings").select(F.col("vec_id").alias("q"), "embedding"), "q", "left")


def vectors(s, d):
    """id, embedding: the vectors of documents."""
    own = tables.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return own.join(docs(s, d).select("doc_id"), "doc_id", "left_semi")


def channels(s, d):
    near = retrieval.dense_top_k(vectors(s, d).withColumnRenamed("doc_id", "vec_id"), asked(s, d).where("embedding is not null"))
    return [("bm25", index(s, d).search(questions(s, d))), ("dense", near.withColumnRenamed("vec_id", "doc_id"))]


def fused(s, d):
    return retrieval.rrf(channels(s, d))


@query(f"WITH {FUSED} SELECT q, channel, rank, doc_id FROM ch")
def rrf_channels(s, d):
    return retrieval.tagged(channels(s, d)).select("q", "channel", "rank", "doc_id")


@query(f"WITH {FUSED} SELECT q, rank, doc_id, score, channels FROM fused")
def rrf_fused(s, d):
    return fused(s, d)


@query(f"""WITH {FUSED},
p AS (SELECT fused.*, source, row_number() OVER (PARTITION BY q, source ORDER BY rank) AS place FROM fused JOIN documents USING (doc_id))
SELECT q, row_number() OVER (PARTITION BY q ORDER BY place > 2, rank) AS rank, doc_id, source FROM p""")
def source_capped(s, d):
    ranked = fused(s, d).join(docs(s, d).select("doc_id", "source"), "doc_id")
    return retrieval.cap_per_source(ranked, 2).select("q", "rank", "doc_id", "source")


CHUNKS = """
ch AS (SELECT source, doc_id, text, row_number() OVER w - 1 AS chunk_index,
  coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_start
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
chunks AS (SELECT *, source || '-chunk-' || chunk_index AS id, doc_start + length(text) AS doc_end FROM ch),
chain AS (SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""


def chunked(s, d):
    return passages.chunk_records(docs(s, d).select("source", F.col("doc_id").alias("seq"), "text"))


@query(f"WITH {CHUNKS} SELECT source, chunk_index, id, prev_id, next_id, doc_start, doc_end FROM chain")
def chunk_records(s, d):
    return chunked(s, d).select("source", "chunk_index", "id", "prev_id", "next_id", "doc_start", "doc_end")


NEAR = f"""WITH {POST}, {CHUNKS},
hit AS (SELECT q, rank, id, prev_id, next_id FROM bm JOIN chain USING (doc_id)),
want AS (SELECT q, id, min(f) AS f FROM (SELECT q, prev_id AS id, rank * 2 AS f FROM hit UNION ALL SELECT q, next_id, rank * 2 + 1 FROM hit) WHERE id IS NOT NULL GROUP BY 1, 2)"""


def near(s, d):
    chain = chunked(s, d)
    hits = index(s, d).search(questions(s, d)).join(chain.select(F.col("seq").alias("doc_id"), "id"), "doc_id").select("q", "rank", "id")
    return retrieval.neighbours(hits, chain).join(chain.select("id", F.length("text").alias("size")), "id")


@query(f"{NEAR} SELECT q, id FROM want w WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.q = w.q AND h.id = w.id)")
def neighbour_ids(s, d):
    return near(s, d).select("q", "id")


#: Passages with their size in order of n per question are taken while they fit; a larger one is passed over.
FOLD = """fold AS (SELECT q, 0::BIGINT AS n, left0::BIGINT AS rest, NULL::VARCHAR AS id, false AS taken FROM purse
UNION ALL SELECT f.q, f.n + 1, CASE WHEN o.size <= f.rest THEN f.rest - o.size ELSE f.rest END, o.id, o.size <= f.rest FROM fold f JOIN ord o ON o.q = f.q AND o.n = f.n + 1)"""


@query(f"""{NEAR.replace("WITH", "WITH RECURSIVE", 1)},
ord AS (SELECT w.q, w.id, length(c.text) AS size, row_number() OVER (PARTITION BY w.q ORDER BY f) AS n FROM want w JOIN chunks c USING (id) WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.q = w.q AND h.id = w.id)),
purse AS (SELECT DISTINCT q, 24000 AS left0 FROM ord), {FOLD}
SELECT q, coalesce(string_agg(id, ',' ORDER BY n) FILTER (taken), '') AS taken FROM fold GROUP BY 1""")
def neighbour_budget(s, d):
    return retrieval.within_budget(near(s, d), 24000).select("q", F.array_join("taken", ",").alias("taken"))


#: Replies of a reranker, with prose, repeats and numbers out of range.
REPLIES = [(1, "[3, 1, 2]"), (2, "I think [2, 1] is best"), (3, "sorry"), (4, "[99, 2, 2, 0, 1]"), (5, "[3]")]


@query("""
WITH p AS (SELECT q, rank, 'p' || rank AS id FROM range(1, 6) a(q), range(1, 4) b(rank)),
r AS (SELECT * FROM (VALUES (1, 3, 0), (1, 1, 1), (1, 2, 2), (2, 2, 0), (2, 1, 1), (4, 2, 1), (4, 1, 4), (5, 3, 0)) t(q, rank, pos)),
o AS (SELECT p.q, id, pos, row_number() OVER (PARTITION BY p.q ORDER BY pos IS NULL, pos, rank) AS place FROM p LEFT JOIN r USING (q, rank))
SELECT q::INTEGER AS q, place, id, CASE WHEN pos IS NULL THEN NULL ELSE 1.0::DOUBLE / (1 + pos) END AS score FROM o WHERE place <= 2""")
def rerank_applied(s, d):
    rows = s.range(1, 6).select(F.col("id").cast("int").alias("q")).crossJoin(s.range(1, 4).select(F.col("id").cast("int").alias("rank")))
    ranked = rows.withColumn("id", F.concat(F.lit("p"), "rank"))
    return retrieval.reranked(ranked, s.createDataFrame(REPLIES, "q int, reply string"), limit=2, least=2)


LINES = """ln AS (SELECT doc_id AS key, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents),
sn AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER w, '\\p{L}-$') AND regexp_matches(text, '^\\p{Ll}') THEN 0 ELSE 1 END AS new FROM ln WINDOW w AS (PARTITION BY key ORDER BY pos)),
sg AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY pos) AS line_no FROM sn),
sl AS (SELECT *, max(pos) OVER (PARTITION BY key, line_no) AS last FROM sg),
sp AS (SELECT key, line_no, string_agg(CASE WHEN pos < last THEN regexp_replace(text, '-$', '') ELSE text END, '' ORDER BY pos) AS text FROM sl GROUP BY 1, 2)"""


def lines(s, d):
    return passages.spliced(docs(s, d).select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "text")))


@query(f"WITH {LINES} SELECT key, line_no::BIGINT AS line_no, md5(text) AS text_md5 FROM sp")
def spliced_lines(s, d):
    return lines(s, d).select("key", "line_no", F.md5("text").alias("text_md5"))


@query(rf"""WITH {LINES},
o AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER w, '[.!?:;][''")\]]?\s*$') AND regexp_matches(text, '^\p{{Lu}}') THEN 1 ELSE 0 END AS new FROM sp WINDOW w AS (PARTITION BY key ORDER BY line_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY line_no) AS para_no FROM o)
SELECT key, para_no::BIGINT AS para_no, md5(string_agg(text, ' ' ORDER BY line_no)) AS text_md5 FROM g GROUP BY 1, 2""")
def reflowed_paragraphs(s, d):
    return passages.paragraphs(lines(s, d)).select("key", "para_no", F.md5("text").alias("text_md5"))


@query(r"""WITH c AS (SELECT source, text, lang, length(text) AS n, ltrim(CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE text END, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM documents)
SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_papers, coalesce(sum(len(regexp_extract_all(text, '[a-z]-\n[a-z]'))), 0)::BIGINT AS hyphen_breaks,
count(*) FILTER (lang = 'de' AND source NOT IN ('src1', 'src13')) AS reference_chunks, count(*) FILTER (regexp_matches(body, '^\p{Ll}')) AS mid_sentence, count(*) FILTER (n < 120) AS orphans,
round_even(avg(n), 0)::BIGINT AS mean_size, round_even(median(n), 0)::BIGINT AS median_size, max(n)::BIGINT AS max_size FROM c""")
def chunk_health(s, d):
    return passages.health(typed(s, d))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def content_histogram(s, d):
    return docs(s, d).groupBy("lang").agg(F.count("*").alias("n"))


@query()
def split_pieces(s, d):
    pieces = docs(s, d).select("doc_id", F.posexplode(passages.split_long(4000)(F.col("text"))).alias("piece", "text"))
    return pieces.select("doc_id", "piece", F.length("text").alias("n_chars"))


HITS = f"""WITH {POST}, gold AS (SELECT item_id AS q, b.text, (SELECT min(source) FROM documents d WHERE contains(d.text, b.text)) AS paper FROM benchmark b),
hit AS (SELECT bm.q, bm.rank FROM bm JOIN documents d USING (doc_id) JOIN gold g ON g.q = bm.q AND g.paper = d.source AND contains(lower(d.text), lower(g.text))),
f AS (SELECT b.item_id AS q, min(rank) AS first FROM benchmark b LEFT JOIN hit ON hit.q = b.item_id GROUP BY 1)"""


def golden(s, d):
    """q, paper, contains: each item with the first source that holds it."""
    first = quote_exact(s, d).join(docs(s, d).select("doc_id", "source"), "doc_id").groupBy(F.col("quote_id").alias("q")).agg(F.min("source").alias("paper"))
    return questions(s, d).join(first, "q", "left").select("q", "paper", F.array("text").alias("contains"))


def results(s, d):
    ranked = index(s, d).search(questions(s, d)).join(docs(s, d).select("doc_id", "source", "text"), "doc_id")
    hit = evidence.is_hit(F.col("source"), F.col("text"), F.col("paper"), F.col("contains"))
    return ranked.join(golden(s, d), "q").select("q", "rank", F.coalesce(hit, F.lit(False)).alias("hit"))


@query(f"""{HITS} SELECT count(*) AS n, count(first) AS hits, round(count(first) / greatest(count(*), 1), 3) AS recall,
round(sum(coalesce(1.0::DOUBLE / first, 0)) / greatest(count(*), 1), 3) AS mrr FROM f""")
def recall_mrr(s, d):
    return evidence.retrieval_metrics(questions(s, d), results(s, d))


@query(f"{HITS} SELECT q FROM f WHERE first IS NULL")
def misses(s, d):
    return questions(s, d).select("q").join(results(s, d).where("hit"), "q", "left_anti")


@query(f"{HITS} SELECT CASE WHEN q % 3 = 0 THEN 'other' ELSE 'k' || q % 3 END AS kind, count(*) AS n, count(first) AS hits FROM f GROUP BY 1")
def hits_by_kind(s, d):
    kind = F.when(F.col("q") % 3 != 0, F.concat(F.lit("k"), (F.col("q") % 3).cast("string")))
    return evidence.hits_by_kind(questions(s, d).select("q", kind.alias("kind")), results(s, d))


JUDGED = "CASE WHEN toxic = 1 AND quality = 1 THEN 'fabricated' WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported' ELSE 'partial' END"


def judged(s, d):
    return tables.table(s, d, "labels").withColumn("verdict", F.expr(JUDGED))


@query(f"SELECT verdict, count(*) AS n, verdict IN ('unsupported', 'fabricated', 'partial') AS flagged FROM (SELECT {JUDGED} AS verdict FROM labels) GROUP BY 1, 3")
def verdict_counts(s, d):
    return evidence.verdicts(judged(s, d))


@query(f"""SELECT count(*) AS n, round(count(*) FILTER (verdict <> 'fabricated') / nullif(count(*), 0), 3) AS quote_rate,
round(count(*) FILTER (verdict = 'supported') / nullif(count(*) FILTER (verdict <> 'fabricated'), 0), 3) AS support_rate FROM (SELECT {JUDGED} AS verdict FROM labels)""")
def answer_summary(s, d):
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return judged(s, d).agg(
        F.count("*").alias("n"),
        evidence.rate(n("verdict <> 'fabricated'"), F.count("*")).alias("quote_rate"),
        evidence.rate(n("verdict = 'supported'"), n("verdict <> 'fabricated'")).alias("support_rate"),
    )


@query("""SELECT item_id AS quote_id, doc_id, instr(d.text, b.quote) - 1 AS start, instr(d.text, b.quote) - 1 + length(b.quote) AS "end"
FROM documents d JOIN (SELECT item_id, text AS quote FROM benchmark) b ON contains(d.text, b.quote)""")
def quote_exact(s, d):
    quotes = tables.table(s, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return evidence.located(quotes, docs(s, d).select("doc_id", "text"))


@query()
def quote_flexible(s, d):
    found = quote_exact(s, d).join(docs(s, d).select("doc_id", "text"), "doc_id")
    spaced = found.withColumn("quote", F.regexp_replace(F.upper(F.expr("substring(text, start + 1, end - start)")), " ", "  "))
    place = evidence.flexible_place()(F.col("quote"), F.col("text"))
    return spaced.select("quote_id", "doc_id", place.alias("p")).select("quote_id", "doc_id", "p.start", "p.end", "p.exact")


#: Answers with citations of known and unknown passages.
ANSWERS = [
    (1, 'It holds [a-chunk-2 "the first quote"]. It also holds [b-chunk-1] and [a-chunk-2]. Unknown [z-chunk-9].'),
    (2, "No citation here. But (see [b-chunk-1])."),
]
KNOWN = [("a-chunk-2",), ("b-chunk-1",)]


@query("SELECT * FROM (VALUES (1, 1, 'a-chunk-2'), (1, 2, 'b-chunk-1'), (2, 1, 'b-chunk-1')) t(answer_id, number, id)")
def used_citations(s, d):
    return evidence.used_citations(s.createDataFrame(ANSWERS, "answer_id int, answer string"), s.createDataFrame(KNOWN, "id string"))


@query("""SELECT * FROM (VALUES (1, 'It holds [a-chunk-2 "the first quote"]. It also holds [b-chunk-1] and [a-chunk-2]. Unknown .'),
(2, 'No citation here. But (see [b-chunk-1]).')) t(answer_id, answer)""")
def stripped_citations(s, d):
    return evidence.stripped(s.createDataFrame(ANSWERS, "answer_id int, answer string"), s.createDataFrame(KNOWN, "id string"))


@query("SELECT * FROM (VALUES (1, 1, 'a-chunk-2', 1), (1, 2, 'b-chunk-1', 2), (2, 1, 'b-chunk-1', 1), (2, 2, 'a-chunk-2', NULL)) t(answer_id, place, id, number)")
def cited_first(s, d):
    answers, known = s.createDataFrame(ANSWERS, "answer_id int, answer string"), s.createDataFrame(KNOWN, "id string")
    shown = answers.select("answer_id").crossJoin(F.broadcast(known.withColumn("rank", F.when(F.col("id") == "a-chunk-2", 1).otherwise(2))))
    return evidence.cited_first(shown, evidence.used_citations(answers, known))


@query("""SELECT * FROM (VALUES (1, 'Is it "so"?"', 'A|B'), (2, 'raw', ''), (3, 'raw', 'C|D|E')) t(id, question, followups)""")
def reply_parsers(s, d):
    rows = [(1, ' "Is it "so"?"\nmore', 'Sure: ["A", " B ", ""]'), (2, "  ", "none"), (3, None, '["C", "D", "E", "F"]')]
    found = s.createDataFrame(rows, "id int, reply string, listed string")
    return found.select("id", evidence.condensed(F.col("reply"), F.lit("raw")).alias("question"), F.array_join(evidence.followups(F.col("listed")), "|").alias("followups"))


@query("""SELECT * FROM (VALUES (1, '429 Too Many Requests', true), (2, '429 GenerateRequestsPerDay', false), (3, 'Quota exceeded', true), (4, 'no such host', false), (5, NULL, false)) t(id, message, again)""")
def retry_worthy(s, d):
    rows = [(1, "429 Too Many Requests"), (2, "429 GenerateRequestsPerDay"), (3, "Quota exceeded"), (4, "no such host"), (5, None)]
    return s.createDataFrame(rows, "id int, message string").withColumn("again", tables.worth_retrying(F.col("message")))


@query("SELECT count(*) AS n, count(*) <= 1000 AS fits FROM documents")
def ingest_cost(s, d):
    return tables.ingest_cost(docs(s, d))


@query("""SELECT * FROM (VALUES ('mrr', 0.583::DOUBLE, 0.662::DOUBLE, 0.079::DOUBLE), ('chunks', 949, 949, 0)) t(metric, base, value, delta)""")
def report_diff(s, d):
    report, base = [("mrr", 0.662), ("chunks", 949.0), ("new", 1.0)], [("mrr", 0.583), ("chunks", 949.0), ("old", 1.0)]
    return evidence.compared(s.createDataFrame(report, "metric string, value double"), s.createDataFrame(base, "metric string, value double"))


@query("""SELECT doc_id, regexp_extract(text, '(?i)(?:table|figure|fig\\.?|algorithm|listing)[ \\t\\n\\f\\r]*[0-9]+[.:]?') AS caption FROM documents""")
def captions(s, d):
    return docs(s, d).select("doc_id", passages.caption(F.col("text")).alias("caption"))


@query("""SELECT source AS q, doc_id % 5 AS paper, min_by(doc_id, doc_id)::VARCHAR AS claim, nullif(arg_min(doc_id % 3, doc_id), 0) AS year
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1, 2""")
def disagreements(s, d):
    rows = docs(s, d).join(tables.table(s, d, "labels"), "doc_id")
    stance = F.when(F.col("toxic") == 1, "contradicts").otherwise("neutral")
    return evidence.disagreements(rows.select(
        F.col("source").alias("q"), F.col("doc_id").alias("rank"), (F.col("doc_id") % 5).alias("paper"), (F.col("doc_id") % 3).alias("year"),
        stance.alias("stance"), F.col("doc_id").cast("string").alias("claim"),
    ))


@query("""SELECT * FROM (VALUES (1, 'CAUTIONS' || chr(10) || '- B: unverified' || chr(10) || '- A: retracted' || chr(10) || chr(10))) t(q, block)""")
def cautions_block(s, d):
    rows = [(1, 1, "B", "unverified"), (1, 2, "A", "retracted"), (1, 3, "B", "retracted"), (1, 4, "C", None), (2, 1, "C", None)]
    return evidence.cautions(s.createDataFrame(rows, "q int, rank int, title string, warning string"))


@query("""SELECT * FROM (VALUES (1, 'preprint · published: NeurIPS 2017'), (2, NULL), (3, NULL), (4, 'preprint · published: ICML')) t(id, note)""")
def preprint_notes(s, d):
    rows = s.createDataFrame([(1, "1706.1", "NeurIPS", 2017), (2, "1706.1", "arXiv preprint", 2017), (3, None, "ICML", 2018), (4, "1", "ICML", 0)], "id int, arxiv string, venue string, year int")
    return rows.select("id", biblio.preprint_note(F.col("arxiv"), F.col("venue"), F.col("year")).alias("note"))


@query("""SELECT * FROM (VALUES (1, 2, true), (2, 3, true), (1, 4, false)) t(a, b, close)""")
def title_close(s, d):
    names = {1: "Attention Is All You Need", 2: "Attention is all you need!", 3: "Attention Is All You Needs", 4: "Not All Attention Is All You Need"}
    rows = s.createDataFrame([(a, b, names[a], names[b]) for a, b in [(1, 2), (2, 3), (1, 4)]], "a int, b int, ta string, tb string")
    return rows.select("a", "b", biblio.title_close()(F.col("ta"), F.col("tb")).alias("close"))


@query("""SELECT * FROM (VALUES (1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 0, 0), (2, 1, 1)) t(answer_id, pos, n_cited)""")
def claims(s, d):
    found = evidence.claims(s.createDataFrame(ANSWERS, "answer_id int, answer string"))
    return found.select("answer_id", "pos", F.size("cited").alias("n_cited"))


@query("""WITH s AS (SELECT source AS topic, doc_id AS paper, 2000 + doc_id % 25 AS year, toxic FROM documents JOIN labels USING (doc_id))
SELECT topic, count(DISTINCT paper) FILTER (toxic = 0) AS n_support, count(DISTINCT paper) FILTER (toxic = 1) AS n_against,
coalesce(min(year) FILTER (toxic = 1) > max(year) FILTER (toxic = 0), false) AS newer FROM s GROUP BY 1 HAVING count(DISTINCT paper) FILTER (toxic = 1) > 0""")
def stance_split(s, d):
    rows = docs(s, d).join(tables.table(s, d, "labels"), "doc_id")
    stance = F.when(F.col("toxic") == 1, "contradicts").when(F.col("toxic") == 0, "supports")
    return evidence.stance_split(rows.select(F.col("source").alias("topic"), F.col("doc_id").alias("paper"), (2000 + F.col("doc_id") % 25).alias("year"), stance.alias("stance")))


@query(f"""WITH w AS (SELECT source AS title, doc_id AS pos, CASE WHEN v = 'fabricated' THEN 'retracted' WHEN v = 'unsupported' THEN 'unverified' END AS warning
FROM (SELECT source, doc_id, {JUDGED} AS v FROM documents JOIN labels USING (doc_id)))
SELECT title, pos, warning FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY pos) AS k FROM w WHERE warning IS NOT NULL) WHERE k = 1""")
def warnings_first(s, d):
    warning = F.when(F.col("verdict") == "fabricated", "retracted").when(F.col("verdict") == "unsupported", "unverified")
    rows = docs(s, d).select("doc_id", "source").join(judged(s, d), "doc_id")
    return evidence.first_per_title(rows.select(F.col("source").alias("title"), F.col("doc_id").alias("pos"), warning.alias("warning")))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE trim(text, ' ') <> '')
SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || ' …' ELSE text END, chr(10) ORDER BY turn)) AS history_md5
FROM m WHERE k <= 6 GROUP BY 1""")
def history_window(s, d):
    return evidence.history_window(tables.table(s, d, "conversations")).select("conv_id", F.md5("history").alias("history_md5"))


@query(r"SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1 HAVING max_by(role, turn) = 'user'")
def last_user_turn(s, d):
    return evidence.last_question(tables.table(s, d, "conversations"))


SPANS = "SELECT l_orderkey AS key, (l_partkey % 90 - 5)::BIGINT AS s, (l_partkey % 90 - 5 + l_quantity % 20)::BIGINT AS e FROM lineitem"


@query(f"""WITH c AS (SELECT key, greatest(s, 0) AS s, least(e, 80) AS e FROM ({SPANS})), f AS (SELECT * FROM c WHERE e > s),
r AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT key, min(s) AS start, max(e) AS "end" FROM i GROUP BY key, island""")
def highlight_segments(s, d):
    at = F.col("l_partkey") % 90 - 5
    spans = tables.table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), at.alias("start"), (at + F.col("l_quantity") % 20).cast("long").alias("end"), F.lit(80).cast("long").alias("length"))
    return evidence.merged_spans(spans)


EDGES = """e AS (SELECT source, target, relation, score FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY ord DESC, relation DESC, score DESC) AS k FROM (
  SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag || l_linestatus AS relation, l_discount AS score, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)) WHERE k = 1),
dg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
sd AS (SELECT node FROM dg JOIN (SELECT 's' || s_suppkey AS node, s_nationkey % 3 AS overlap FROM supplier) USING (node) ORDER BY overlap DESC, degree DESC, node LIMIT 6),
nb AS (SELECT DISTINCT target AS node FROM (SELECT source, target FROM e UNION ALL SELECT target, source FROM e) WHERE source IN (FROM sd) AND target NOT IN (FROM sd))"""


def edges(s, d):
    raw = tables.table(s, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.concat("l_returnflag", "l_linestatus").alias("relation"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return graph.merged_edges(raw)


def seed_nodes(s, d):
    overlap = tables.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), (F.col("s_nationkey") % 3).alias("overlap"))
    return graph.seeds(graph.degrees(edges(s, d)), overlap)


@query(f"WITH {EDGES} SELECT * FROM e")
def merged_edges(s, d):
    return edges(s, d)


@query(f"WITH {EDGES} SELECT * FROM dg")
def degrees(s, d):
    return graph.degrees(edges(s, d))


@query(f"WITH {EDGES} SELECT * FROM sd")
def seeds(s, d):
    return seed_nodes(s, d)


@query(f"WITH {EDGES} SELECT * FROM nb")
def neighbours(s, d):
    return graph.neighbours(edges(s, d), seed_nodes(s, d))


@query(f"WITH {EDGES} SELECT node, degree FROM nb JOIN dg USING (node) ORDER BY degree DESC, node LIMIT 8")
def expansion_terms(s, d):
    return graph.expansion(edges(s, d), seed_nodes(s, d))


@query(f"WITH {EDGES} SELECT * FROM e WHERE source IN (FROM sd) OR target IN (FROM sd) ORDER BY relation IN ('AF'), score DESC, source, target LIMIT 12")
def facts(s, d):
    return graph.facts(edges(s, d), seed_nodes(s, d), ["AF"])


@query("""SELECT p_brand AS node, arg_min(p_name, p_partkey) AS label, count(DISTINCT p_type) AS n_papers, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS papers FROM part GROUP BY 1""")
def merged_nodes(s, d):
    rows = tables.table(s, d, "part").select(F.col("p_brand").alias("node"), F.col("p_name").alias("label"), F.col("p_type").alias("paper"), F.col("p_partkey").alias("ord"))
    return graph.merged_nodes(rows).select("node", "label", "n_papers", F.array_join("papers", "|").alias("papers"))


@query("""WITH o AS (SELECT DISTINCT p_type AS paper, p_brand AS label FROM part)
SELECT x.paper AS a, y.paper AS b, count(*) AS n, string_agg(x.label, '|' ORDER BY x.label) AS concepts FROM o x JOIN o y ON x.label = y.label AND x.paper < y.paper GROUP BY 1, 2""")
def shared_concepts(s, d):
    return graph.shared_concepts(tables.table(s, d, "part").select(F.col("p_type").alias("paper"), F.col("p_brand").alias("label")))


@query("SELECT * FROM (VALUES ('bert', 'transformer'), ('draft', 'transformer')) t(citing, cited)")
def citation_edges(s, d):
    rows = [("transformer", 1, "W1", ["W1"]), ("bert", 2, "W2", ["W1", "W999"]), ("draft", 3, None, ["W1"])]
    return graph.citation_edges(s.createDataFrame(rows, "paper string, ord int, own_id string, reference_ids array<string>"))


def library_graph(s, d):
    """Parts as papers of a library; each supplier's lineitem leads from the order's part to the supplier's own number."""
    raw = tables.table(s, d, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited"), F.when(F.col("l_returnflag") == "R", "cites").otherwise("uses").alias("relation"))
    return raw.where("citing <> cited")


LIBRARY = """raw AS (SELECT l_partkey AS citing, l_suppkey AS cited, CASE WHEN l_returnflag = 'R' THEN 'cites' ELSE 'uses' END AS relation FROM lineitem WHERE l_partkey <> l_suppkey),
known AS (SELECT DISTINCT ps.l_partkey AS citing, ps.l_suppkey AS cited FROM lineitem ps WHERE l_linestatus = 'F' AND l_partkey <> l_suppkey),
me AS (SELECT citing, cited FROM known UNION SELECT citing, cited FROM raw WHERE relation = 'cites')"""


@query(f"WITH {LIBRARY} SELECT citing, cited FROM me")
def map_edges(s, d):
    base = tables.table(s, d, "lineitem").where("l_linestatus = 'F' AND l_partkey <> l_suppkey").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited"))
    return graph.map_edges(base, library_graph(s, d))


@query(f"""WITH {LIBRARY}, p AS (SELECT p_partkey AS paper, p_size % 4 AS year FROM part),
k AS (SELECT * FROM me WHERE citing IN (SELECT paper FROM p) AND cited IN (SELECT paper FROM p))
SELECT paper, year, coalesce(nullif(year, 0), 9999) AS sort_year, (SELECT count(*) FROM k WHERE citing = paper) AS cites, (SELECT count(*) FROM k WHERE cited = paper) AS cited_by FROM p""")
def library_map(s, d):
    papers = tables.table(s, d, "part").select(F.col("p_partkey").alias("paper"), (F.col("p_size") % 4).alias("year"))
    return graph.map_rows(papers, map_edges(s, d))


@query("""SELECT * FROM (VALUES ('bert', 'cites', 'attn'), ('vit', 'uses', 'bert')) t(citing, relation, cited)""")
def paper_links(s, d):
    nodes = s.createDataFrame([("n1", "attn"), ("n2", "bert"), ("n3", None), ("n4", "vit")], "node string, stem string")
    edges = s.createDataFrame([("n2", "n1", "cites"), ("n3", "n1", "cites"), ("n4", "n2", "uses")], "source string, target string, relation string")
    return graph.paper_links(nodes, edges)


SQUASH = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH t AS (SELECT 'b' || item_id AS stem, {SQUASH.format("text")} AS name FROM benchmark), x AS (SELECT 'd' || doc_id AS stem, {SQUASH.format("text")} AS body FROM documents)
SELECT DISTINCT x.stem AS citing, t.stem AS cited FROM x JOIN t ON length(name) >= 12 AND contains(body, name)""")
def title_citations(s, d):
    titles = tables.table(s, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("stem"), tx.squash(F.col("text")).alias("name"))
    return graph.title_citations(docs(s, d).select(F.concat(F.lit("d"), "doc_id").alias("stem"), tx.squash(F.col("text")).alias("squashed")), titles)


#: Texts with and without identifiers.
IDS = [("https://arxiv.org/abs/1706.03762v7",), ("arXiv:2005.14165",), ("see arxiv.org/pdf/cs/0112017",), ("10.1000/xyz.123). done",), ("doi 10.48550/arXiv.1706.03762",), ("none",)]


@query(r"""WITH every AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES ('i0', 'https://arxiv.org/abs/1706.03762v7'), ('i1', 'arXiv:2005.14165'), ('i2', 'see arxiv.org/pdf/cs/0112017'),
('i3', '10.1000/xyz.123). done'), ('i4', 'doi 10.48550/arXiv.1706.03762'), ('i5', 'none')) t(id, text)),
x AS (SELECT id, nullif(regexp_extract(text, '((?:\d{4}\.\d{4,5}|[a-zA-Z-]+(?:\.[a-zA-Z]{2})?/\d{7})(?:[vV]\d+)?)', 1), '') AS arxiv_id, regexp_extract(text, '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b', 1) AS found FROM every)
SELECT id, arxiv_id, CASE WHEN found <> '' AND NOT contains(found, '10.48550') THEN regexp_replace(found, '[.,;)]+$', '') END AS doi FROM x""")
def identifiers(s, d):
    own = s.createDataFrame([(f"i{n}", t) for n, (t,) in enumerate(IDS)], "id string, text string")
    every = docs(s, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(own)
    return every.select("id", tx.arxiv_id(F.col("text")).alias("arxiv_id"), tx.doi(F.col("text")).alias("doi"))


#: Bibliographic rows, and the entries that they give.
ENTRIES = [
    (1, ["Ashish Vaswani", "Noam Shazeer"], 2017, "Attention Is All You Need", "NeurIPS", None, "1706.03762", False),
    (2, ["Jo Brown"], 2020, "Some 50% & more", "Nature", "10.1/x_y", None, True),
    (3, ["Ann Lee"], 0, "With Care", None, "10.48550/arXiv.1", "1706.1", False),
    (4, None, None, None, None, None, None, None),
]


@query(r"""SELECT * FROM (VALUES
(1, '@inproceedings{vaswani2017attention,' || chr(10) || '  author = {Ashish Vaswani and Noam Shazeer},' || chr(10) || '  title = {{Attention Is All You Need}},' || chr(10) || '  booktitle = {NeurIPS},' || chr(10) || '  year = {2017},' || chr(10) || '  eprint = {1706.03762},' || chr(10) || '  archivePrefix = {arXiv}' || chr(10) || '}' || chr(10)),
(2, '@article{brown2020some,' || chr(10) || '  author = {Jo Brown},' || chr(10) || '  title = {{Some 50\% \& more}},' || chr(10) || '  journal = {Nature},' || chr(10) || '  year = {2020},' || chr(10) || '  doi = {10.1/x_y},' || chr(10) || '  note = {Retracted}' || chr(10) || '}' || chr(10)),
(3, '@misc{leendcare,' || chr(10) || '  author = {Ann Lee},' || chr(10) || '  title = {{With Care}},' || chr(10) || '  eprint = {1706.1},' || chr(10) || '  archivePrefix = {arXiv},' || chr(10) || '  url = {https://arxiv.org/abs/1706.1}' || chr(10) || '}' || chr(10)),
(4, '@misc{anonnduntitled,' || chr(10) || chr(10) || '}' || chr(10))) t(id, entry)""")
def bibtex(s, d):
    c = ["authors", "year", "title", "venue", "doi", "arxiv", "retracted"]
    rows = s.createDataFrame(ENTRIES, "id int, authors array<string>, year int, title string, venue string, doi string, arxiv string, retracted boolean")
    return rows.select("id", biblio.bibtex(*map(F.col, c)).alias("entry"))


#: Recorded answers of the bibliographic services.
ANSWERED = [
    ("a", "arxiv_search", "<feed><entry><id>http://arxiv.org/abs/9.1v1</id><title>Not All Attention Is All You Need</title></entry><entry><id>http://arxiv.org/abs/1706.03762v7</id><title>Attention Is\n All You Need</title></entry></feed>"),
    ("a", "arxiv", "<feed><entry><title>Attention Is All You Need</title><published>2017-06-12</published><author> <name>Ashish Vaswani</name></author></entry></feed>"),
    ("a", "semanticscholar", '{"title": "x", "year": 2018, "venue": "NeurIPS", "citationCount": 7, "externalIds": {"DOI": "10.5/a"}}'),
    ("a", "openalex_search", '{"results": [{"id": "W1", "title": "Attention is all you need", "publication_year": 2025}, {"id": "W2", "title": "Attention Is All You Need!", "publication_year": 2017, "cited_by_count": 9, "referenced_works": ["W7"]}]}'),
    ("a", "crossref", '{"message": {"updated-by": [{"type": "Retraction", "DOI": "10.9/r"}]}}'),
    ("a", "citers", '{"data": [{"citingPaper": {"title": "BERT", "year": 2018}}, {"citingPaper": {"title": null}}]}'),
    ("b", "crossref", '{"message": {"type": "retraction"}}'),
    ("b", "openalex_doi", "not json"),
]
PAPERS = [("a", "Attention Is All You Need", None, None), ("b", "Other", None, "10.5/b"), ("c", "Third", None, None)]


@query("""SELECT * FROM (VALUES
('a', 2017, 'NeurIPS', '10.5/a', '1706.03762', 'W2', 9, 'Retracted by 10.9/r.', 'Ashish Vaswani', 'W7', 'BERT', 'arxiv-title-search,arxiv,semanticscholar,openalex,crossref', false),
('b', NULL, NULL, '10.5/b', NULL, NULL, NULL, 'Crossref records a retraction notice for this DOI.', '', '', '', 'crossref', false),
('c', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', '', '', '', true))
t(key, year, venue, doi, arxiv_id, openalex_id, citation_count, retraction_note, authors, reference_ids, citers, resolved_by, unresolved)""")
def resolved_papers(s, d):
    rows = biblio.resolved(s.createDataFrame(PAPERS, "key string, title string, arxiv_id string, doi string"), s.createDataFrame(ANSWERED, "key string, service string, body string"))
    lists = [F.array_join(c, ",").alias(c) for c in ("authors", "reference_ids", "resolved_by")]
    return rows.select("key", "year", "venue", "doi", "arxiv_id", "openalex_id", "citation_count", "retraction_note", *lists, F.array_join(F.transform("citers", lambda c: c["title"]), ",").alias("citers"), "unresolved")


@query(r"""WITH b AS (SELECT doc_id, text, trim(regexp_replace(text, '\([^)]*\)', ' ', 'g'), ' ') AS bare FROM documents)
SELECT doc_id, md5(trim(regexp_replace(lower(CASE WHEN bare = '' THEN text ELSE bare END), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) AS label_md5 FROM b""")
def norm_labels(s, d):
    return docs(s, d).select("doc_id", F.md5(tx.norm_label(F.col("text"))).alias("label_md5"))


@query("SELECT source, coalesce(arg_min(nullif(split_part(text, chr(10), 1), ''), doc_id), source) AS title FROM documents GROUP BY 1")
def library(s, d):
    return tables.library(docs(s, d).select("source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("doc_id").alias("ord")))


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels))")
def new_files_only(s, d):
    """The store holds the labelled documents."""
    own = docs(s, d).withColumn("file_hash", F.md5("text"))
    return tables.unseen(own, own.join(tables.table(s, d, "labels"), "doc_id", "left_semi")).select("doc_id")


# The same words that the expression asks for, as lists.
MATHY = r"""
t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
w AS (SELECT *, length(t) AS n, list_transform(string_split_regex(t, '\s+'), lambda x: regexp_replace(x, '^[.,()]+|[.,()]+$', '', 'g')) AS bare, string_split_regex(t, '\s+') AS words FROM t),
c AS (SELECT *, len(list_filter(range(1, len(words) + 1), lambda i: length(words[i]) >= 3 AND regexp_full_match(bare[i], '\p{L}+'))) AS sensible,
  len(list_filter(bare, lambda x: lower(x) IN ('the', 'a', 'an', 'of', 'to', 'in', 'is', 'are', 'we', 'that', 'for', 'and', 'with', 'as', 'on', 'by', 'this', 'it', 'be', 'from', 'which'))) AS stops,
  (n - length(regexp_replace(t, '[∑∏∫∂∇√±≤≥≈≠∈∀∃⊤⊆∪∩·×→←↦⟨⟩αβγδεθλμσφψωΓΔΘΛΣΦΨΩ\^_{}]', '', 'g'))) / nullif(n, 0) AS signs,
  (n - length(regexp_replace(t, '[=+\-/*<>\^_\p{Nd}⁰¹²³⁴-⁹₀-₉]', '', 'g'))) / nullif(n, 0) AS dense FROM w)"""


@query(f"""WITH {MATHY} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n > 0 AND n <= 200 AND sensible < 3 AND stops < 2 AND (signs > 0.05 OR (sensible <= 1 AND dense > 0.15))) AS n_mathy FROM c GROUP BY 1""")
def math_lines(s, d):
    rows = docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(passages.is_mathy(F.col("line")), 1)).alias("n_mathy"))


@query()
def typed_blocks(s, d):
    built = docs(s, d).select("doc_id", F.posexplode(blocks.build(F.split("text", "\n"), F.lit(False))).alias("block_no", "b"))
    return built.select("doc_id", "block_no", "b.content_type", F.length("b.text").alias("n_chars"), F.md5("b.text").alias("text_md5"))


def paper_lines(s, d):
    """Documents as papers: their lines, fifty to a page, in one type size."""
    rows = docs(s, d).where("text is not null").select(F.col("doc_id").alias("paper"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where("trim(text) <> ''")
    return rows.withColumns({"page_no": F.floor(F.col("line_no") / 50).cast("int"), "size": F.lit(10.0), "bold": F.lit(False)})


@query()
def parsed_chunks(s, d):
    found = blocks.chunks(blocks.parse(paper_lines(s, d)))
    return found.select("paper", "seq", "section", "page", "content_type", F.length("body").alias("n_chars"), F.md5("text").alias("text_md5"))


@query()
def overlapping_pieces(s, d):
    pieces = docs(s, d).select("doc_id", F.posexplode(passages.overlapping()(F.col("text"))).alias("piece", "text"))
    return pieces.select("doc_id", "piece", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


QUOTE = '[^.!?"]{4,400}'


def told(s, d):
    """Per benchmark item an answer with a quote that it holds, one that it does not, and one of a passage that is not there."""
    own = tables.table(s, d, "benchmark").select(F.col("item_id").alias("answer_id"), F.regexp_extract("text", QUOTE, 0).alias("quote"), "text")
    cite = lambda name, quote: F.concat(F.lit(f"This is said here [{name}-chunk-"), F.col("answer_id").cast("string"), F.lit(' "'), quote, F.lit('"].'))
    answer = F.concat_ws(" ", cite("b", F.col("quote")), cite("b", F.lit("never written")), cite("z", F.col("quote")))
    retrieved = own.select("answer_id", F.concat(F.lit("b-chunk-"), F.col("answer_id").cast("string")).alias("id"), "text", (F.col("answer_id") * 1000).alias("doc_start"))
    return own.select("answer_id", answer.alias("answer")), retrieved


SPANNED = """p AS (SELECT item_id AS answer_id, text, regexp_extract(text, '[^.!?"]{4,400}', 0) AS quote FROM benchmark),
c AS (SELECT answer_id, 0 AS pos, 'unchecked' AS verdict, instr(text, quote) - 1 AS start, answer_id * 1000 + instr(text, quote) - 1 + length(quote) AS doc_end, '' AS reason FROM p
UNION ALL SELECT answer_id, 1, 'fabricated', NULL, NULL, 'quoted text does not appear in the cited passage' FROM p
UNION ALL SELECT answer_id, 2, 'fabricated', NULL, NULL, 'cites z-chunk-' || answer_id || ', which was not retrieved' FROM p)"""


@query(f"WITH {SPANNED} SELECT * FROM c")
def claim_spans(s, d):
    first = lambda f: F.try_element_at("spans", F.lit(1))[f]
    return evidence.claim_spans(*told(s, d)).select("answer_id", "pos", "verdict", first("start").cast("long").alias("start"), first("doc_end").alias("doc_end"), "reason")


def judged_answers(s, d):
    answers, retrieved = told(s, d)
    reply = F.when(F.col("answer_id") % 3 == 0, 'Here: [{"n": 1, "verdict": "no"}, {"n": 1, "verdict": "Partial", "why": "thin"}]').when(F.col("answer_id") % 3 == 1, "[oops")
    return evidence.judged_claims(evidence.claim_spans(answers, retrieved), answers.select("answer_id", reply.alias("reply")))


@query(f"WITH {SPANNED} SELECT answer_id, pos, CASE WHEN pos = 0 AND answer_id % 3 = 0 THEN 'partial' ELSE verdict END AS verdict, CASE WHEN pos = 0 AND answer_id % 3 = 0 THEN 'thin' ELSE reason END AS reason FROM c")
def claims_judged(s, d):
    return judged_answers(s, d).select("answer_id", "pos", "verdict", "reason")


@query("""SELECT item_id AS answer_id, (item_id % 3 = 0)::INT::BIGINT AS n_partial, 2::BIGINT AS n_fabricated, (item_id % 3 <> 0)::INT::BIGINT AS n_unchecked, 0::BIGINT AS n_uncited,
(2 + (item_id % 3 = 0)::INT) AS n_flagged FROM benchmark""")
def claim_summary(s, d):
    return evidence.claim_summary(judged_answers(s, d)).select("answer_id", "n_partial", "n_fabricated", "n_unchecked", "n_uncited", F.size("flagged").alias("n_flagged"))


@query(f"""WITH r AS (SELECT {JUDGED} AS v, quality, doc_id FROM labels), s AS (SELECT * FROM r WHERE doc_id % 7 <> 0)
SELECT (SELECT count(*) FROM s) AS scored, (SELECT count(*) FROM r) - (SELECT count(*) FROM s) AS failed, count(*) FILTER (v <> 'fabricated') AS judged, count(*) FILTER (v = 'fabricated') AS fabricated,
count(*) FILTER (v = 'supported') AS supported, coalesce(sum(doc_id % 3), 0)::BIGINT AS bare_citations, count(*) FILTER (quality = 1) AS evidence,
round(count(*) FILTER (v <> 'fabricated') / nullif(count(*), 0), 3) AS quote_rate, round(count(*) FILTER (v = 'supported') / nullif(count(*) FILTER (v <> 'fabricated'), 0), 3) AS support_rate,
round(count(*) FILTER (quality = 1) / nullif(count(*), 0), 3) AS evidence_rate FROM s""")
def run_summary(s, d):
    error = F.when(F.col("doc_id") % 7 == 0, "timeout")
    rows = judged(s, d).select(F.array("verdict").alias("verdicts"), (F.col("doc_id") % 3).alias("bare_citations"), (F.col("quality") == 1).alias("cited_expected_evidence"), error.alias("error"))
    return evidence.run_summary(rows)


def brand_graph(s, d):
    """Part names as concepts, part types as papers, and an edge from each concept to its brand's."""
    part = tables.table(s, d, "part")
    paper = lambda: F.col("p_type").alias("paper")
    own = part.select(paper(), F.col("p_partkey").alias("ord"), F.concat(F.lit("n"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("concept").alias("file_type"), F.lit(False).alias("is_stub"))
    brands = part.select(paper(), (F.col("p_partkey") + 10**9).alias("ord"), F.concat(F.lit("b"), "p_brand").alias("id"), F.col("p_brand").alias("label"), F.lit("concept").alias("file_type"), F.lit(False).alias("is_stub"))
    edges = part.select(
        paper(), F.col("p_partkey").alias("ord"), F.concat(F.lit("n"), "p_partkey").alias("source"), F.concat(F.lit("b"), "p_brand").alias("target"),
        F.lit("has_brand").alias("relation"), F.lit("EXTRACTED").alias("confidence"), (F.col("p_size") / 50).alias("confidence_score"),
    )
    titles = part.select(F.col("p_type").alias("stem")).distinct().withColumn("names", F.array("stem"))
    none = s.createDataFrame([], "citing string, cited string")
    return graph.merged_extractions(own.union(brands), edges, titles, none)


PLAIN_LABEL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


@query(rf"""WITH t AS (SELECT DISTINCT p_type AS stem, {PLAIN_LABEL.format("p_type")} AS plain FROM part),
n AS (SELECT p_type AS paper, {PLAIN_LABEL.format("p_name")} AS plain FROM part UNION ALL SELECT p_type, {PLAIN_LABEL.format("p_brand")} FROM part)
SELECT 'concept_' || replace(plain, ' ', '_') AS node, count(DISTINCT paper) AS n_papers FROM n WHERE plain <> '' AND plain NOT IN (SELECT plain FROM t) GROUP BY 1
UNION ALL SELECT 'paper_' || regexp_replace(lower(stem), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), 1 FROM t""")
def extracted_nodes(s, d):
    return brand_graph(s, d)[0].select("node", F.size("papers").cast("long").alias("n_papers"))


@query(rf"""WITH t AS (SELECT DISTINCT {PLAIN_LABEL.format("p_type")} AS plain, p_type AS stem FROM part),
p AS (SELECT *, {PLAIN_LABEL.format("p_name")} AS name, {PLAIN_LABEL.format("p_brand")} AS brand FROM part),
e AS (SELECT 'concept_' || replace(name, ' ', '_') AS source, 'concept_' || replace(brand, ' ', '_') AS target, 'has_brand' AS relation, 'EXTRACTED' AS confidence,
  CASE WHEN p_size = 0 THEN 0.5::DOUBLE ELSE p_size / 50.0::DOUBLE END AS confidence_score, p_type AS paper, p_partkey AS ord
  FROM p WHERE name <> '' AND brand <> '' AND name NOT IN (SELECT plain FROM t) AND brand NOT IN (SELECT plain FROM t) AND name <> brand)
SELECT source, target, relation, confidence, confidence_score, paper FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY paper DESC, ord DESC) AS k FROM e) WHERE k = 1""")
def extracted_edges(s, d):
    return brand_graph(s, d)[1]


@query()
def related_by_question(s, d):
    nodes, edges = brand_graph(s, d)
    asked = tables.table(s, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("q"), F.concat(F.lit("which papers use "), "p_brand").alias("text"))
    return graph.related_papers(nodes, edges, graph.question_seeds(nodes, edges, asked))


def placed(hit: str, k: str) -> str:
    """SQL for the passages of hit (q, rank, id, channels) and their neighbours within the budget, in reading order; chain and chunks are known."""
    return f"""want AS (SELECT q, id, min(f) AS f FROM (SELECT q, prev_id AS id, rank * 2 AS f FROM {hit} JOIN chain USING (id) UNION ALL SELECT q, next_id, rank * 2 + 1 FROM {hit} JOIN chain USING (id)) WHERE id IS NOT NULL GROUP BY 1, 2),
ord AS (SELECT w.q, w.id, length(c.text) AS size, row_number() OVER (PARTITION BY w.q ORDER BY f) AS n FROM want w JOIN chunks c USING (id) WHERE NOT EXISTS (SELECT 1 FROM {hit} h WHERE h.q = w.q AND h.id = w.id)),
purse AS (SELECT * FROM (SELECT q, {k} - sum(length(c.text)) AS left0 FROM {hit} JOIN chunks c USING (id) GROUP BY 1) WHERE left0 > 0 AND q IN (SELECT q FROM ord)), {FOLD},
every AS (SELECT q, rank, id, channels FROM {hit} UNION ALL SELECT q, NULL, id, 'neighbour' FROM fold WHERE taken)
SELECT e.q, row_number() OVER (PARTITION BY e.q ORDER BY CASE WHEN p.q IS NOT NULL THEN c.source END NULLS FIRST, CASE WHEN p.q IS NOT NULL THEN c.chunk_index END NULLS FIRST, rank NULLS FIRST, e.id) AS place, e.id, channels
FROM every e JOIN chunks c USING (id) LEFT JOIN purse p ON p.q = e.q"""


@query(f"WITH RECURSIVE {POST}, {CHUNKS}, top AS (SELECT q, rank, id, 'bm25' AS channels FROM bm JOIN chain USING (doc_id)), {placed('top', '24000')}")
def context_expanded(s, d):
    chain = chunked(s, d)
    ranked = index(s, d).search(questions(s, d)).join(chain.select(F.col("seq").alias("doc_id"), "id"), "doc_id").select("q", "rank", "id", F.lit("bm25").alias("channels"))
    return retrieval.expanded(ranked, chain)


WIDE = f"""{POST.replace("rank <= 8", "rank <= 25")}, {DENSE.replace("rank <= 8", "rank <= 25")}, {CHUNKS},
chn AS (SELECT q, id, rank, 0 AS no, 'bm25' AS channel FROM bm JOIN chunks USING (doc_id) UNION ALL SELECT q, id, rank, 1, 'dense' FROM de JOIN chunks USING (doc_id)),
fu AS (SELECT q, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, min(no * 1000 + rank) AS f, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM chn GROUP BY 1, 2),
fused AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, f, id) AS old, id, source, channels FROM fu JOIN chunks USING (id)),
capped AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY place > 4, old) AS rank, id, channels FROM (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY old) AS place FROM fused)),
top AS (SELECT * FROM capped WHERE rank <= 8)"""


def by_number(s, d, ranked):
    """A ranked list by doc_id as one by passage id."""
    return ranked.join(chunked(s, d).select(F.col("seq").alias("doc_id"), "id"), "doc_id")


class Numbered:
    """The documents' index under the passages' ids."""

    def __init__(self, s, d):
        self.s, self.d, self.key = s, d, "id"

    def search(self, queries, k):
        return by_number(self.s, self.d, index(self.s, self.d).search(queries, k)).select("q", "rank", "id", "score")


@query(f"WITH RECURSIVE {WIDE}, {placed('top', '24000')}")
def retrieve_passages(s, d):
    """BM25 and dense channels fused, capped, cut and expanded."""
    own = by_number(s, d, vectors(s, d).withColumnRenamed("vec_id", "doc_id")).select("id", "embedding", F.col("doc_id").alias("ord"))
    return question.retrieve_passages(Numbered(s, d), chunked(s, d), own, asked(s, d))


def library_relations(s, d):
    """Sources as papers: each item's first three words are a concept of the sources that hold it, linked to the next item's."""
    held = quote_exact(s, d).join(docs(s, d).select("doc_id", "source"), "doc_id").select(F.col("quote_id").alias("ord"), F.col("source").alias("paper")).distinct()
    held = tables.stored(held, "held")
    label = F.substring_index(F.regexp_replace(F.trim("text"), r"\s+", " "), " ", 3)
    named = questions(s, d).select(F.col("q").alias("ord"), label.alias("label"))
    nodes = held.join(named, "ord").select("paper", "ord", F.concat(F.lit("n"), "ord").alias("id"), "label", F.lit("concept").alias("file_type"), F.lit(False).alias("is_stub"))
    both = held.join(held.select(F.col("ord").alias("next"), "paper"), "paper").where("next > ord").groupBy("paper", "ord").agg(F.min("next").alias("next"))
    edges = both.select("paper", "ord", F.concat(F.lit("n"), "ord").alias("source"), F.concat(F.lit("n"), "next").alias("target"), F.lit("precedes").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"))
    titles = docs(s, d).select(F.col("source").alias("stem")).distinct().withColumn("names", F.array("stem"))
    merged = graph.merged_extractions(nodes, edges, titles, s.createDataFrame([], "citing string, cited string"))
    return graph.stored_graph(*merged, tables.shared_path(s, "graph"))


@query()
def retrieve_with_graph(s, d):
    """All three channels and a reranker's recorded replies."""
    own = by_number(s, d, vectors(s, d)).select("id", "embedding")
    said = questions(s, d).select("q", F.lit("[3, 1, 2, 9, 4]").alias("reply")).where("q % 2 = 0")
    return question.retrieve_passages(Numbered(s, d), chunked(s, d), own, asked(s, d), relations=library_relations(s, d), replies=said)


@query("""SELECT source || '.pdf' AS file, coalesce(arg_min(split_part(text, chr(10), 1), doc_id) FILTER (trim(split_part(text, chr(10), 1), ' ') <> ''), source) AS title FROM documents WHERE source IS NOT NULL GROUP BY source""")
def library_listing(s, d):
    files = docs(s, d).where("source is not null").select(F.concat("source", F.lit(".pdf")).alias("file"), F.lit("").alias("pdf_title")).distinct()
    chunks = docs(s, d).select(F.concat(F.lit("/data/"), "source", F.lit(".pdf")).alias("source"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("doc_id").alias("ord"))
    return lib.listing(chunks, files)


@query("SELECT conv_id, substr(min_by(text, turn), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY 1")
def conversation_titles(s, d):
    return lib.conversation_titles(tables.table(s, d, "conversations"))


@query("SELECT conv_id, turn, role FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id) WHERE turn < last")
def before_last_question(s, d):
    return lib.before_last_question(tables.table(s, d, "conversations")).select("conv_id", "turn", "role")


@query(f"""WITH v AS (SELECT source AS answer_id, {JUDGED} AS verdict, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT answer_id, string_agg(n || ' ' || verdict, ', ' ORDER BY list_position(['supported', 'partial', 'unsupported', 'fabricated', 'unchecked'], verdict)) AS line FROM v GROUP BY 1""")
def verdict_lines(s, d):
    rows = judged(s, d).join(docs(s, d).select("doc_id", F.col("source").alias("answer_id")), "doc_id")
    return lib.verdict_line(rows.groupBy("answer_id", "verdict").agg(F.count("*").alias("n")))


@query(f"""{HITS} SELECT q AS answer_id, coalesce(bool_or(rank <= 3), false) AS cited_expected_evidence FROM benchmark b JOIN (SELECT item_id AS q FROM benchmark) i ON i.q = b.item_id LEFT JOIN hit USING (q) GROUP BY 1""")
def cited_evidence(s, d):
    """Answers that cite the three best passages."""
    found = index(s, d).search(questions(s, d)).join(docs(s, d).select("doc_id", "source", "text"), "doc_id")
    matches = found.select(F.col("q").alias("answer_id"), F.col("doc_id").alias("id"), "rank", "source", "text")
    return evidence.cites_evidence(matches.where("rank <= 3").select("answer_id", F.col("id").alias("chunk_id")), matches, golden(s, d).withColumnRenamed("q", "answer_id"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN source ELSE '' END, ''), CASE WHEN lang = 'fr' THEN '10.1/' || doc_id END, 'p' || doc_id) AS key FROM documents")
def cache_keys(s, d):
    arxiv = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    doi = F.when(F.col("lang") == "fr", F.concat(F.lit("10.1/"), "doc_id"))
    return docs(s, d).select("doc_id", lib.cache_key(arxiv, doi, F.concat(F.lit("/data/p"), "doc_id", F.lit(".pdf"))).alias("key"))


@query(f"""WITH c AS (SELECT key, greatest(s, 0) AS s, least(e, 80) AS e FROM ({SPANS})), f AS (SELECT * FROM c WHERE e > s),
r AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT key, min(s) AS s, max(e) AS e FROM i GROUP BY key, island),
g AS (SELECT key, coalesce(lag(e) OVER (PARTITION BY key ORDER BY s), 0) AS a, s, e, lead(s) OVER (PARTITION BY key ORDER BY s) AS nxt FROM m)
SELECT key, s AS start, e AS "end", true AS marked FROM g UNION ALL SELECT key, a, s, false FROM g WHERE a < s UNION ALL SELECT key, e, 80, false FROM g WHERE nxt IS NULL AND e < 80""")
def highlight_pieces(s, d):
    return lib.pieces_between(highlight_segments(s, d).withColumn("length", F.lit(80).cast("long")))


@query("""SELECT source, chunk_index, source || '-' || substr(md5(source), 1, 8) || '-chunk-' || chunk_index AS id FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index FROM documents)""")
def hashed_chunk_ids(s, d):
    rows = docs(s, d).select("source", F.col("doc_id").alias("seq"), "text")
    return passages.chunk_records(rows, lib.chunk_prefix(F.concat(F.col("source"), F.lit(".pdf")), F.md5("source"))).select("source", "chunk_index", "id")
