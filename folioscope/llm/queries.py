"""The thin queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, pieces, pii, repeats, simhash, tokencount, toxicity, urlfilter

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabularies split text, and the identifier that they leave free.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
#: The pseudonyms' key for public test tables; a deployment sets its own in spark.folioscope.pii.key.
TEST_KEY = "folioscope"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> F.Column:
    """crc32 of doc_id as text, mod n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.folioscope.pii.key", TEST_KEY)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    vocabulary = tokencount.Vocabulary(f"{tokenizers}/byte_bpe_multi_50k.tiktoken", SPLIT, END_OF_DOCUMENT)
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary).select("doc_id", "n_tokens")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The site rules of the contract, and the patterns of the default list.
SITE_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
PATTERN_RULES = [
    ("block", "/ads/"),
    ("block", "||ads.*^"),
    ("block", "/login^"),
    ("block", "/cart^"),
    ("block", "?sessionid="),
    ("block", "^ref=x^"),
    ("allow", "||m.*^fr^"),
]


def url_rules() -> list[urlfilter.Rule]:
    return [urlfilter.Rule(a, host=h, path=p) for a, h, p in SITE_RULES] + [urlfilter.Rule(a, pattern=p) for a, p in PATTERN_RULES]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, url_rules()).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, '.' || host AS h,
         regexp_matches(lower(url), '(?s)/ads/|^[^:/?#]*://(?:[^/?#]*\.)?ads\..*(?:[^a-z0-9_.%-]|$)|/login(?:[^a-z0-9_.%-]|$)|/cart(?:[^a-z0-9_.%-]|$)|\?sessionid=|[^a-z0-9_.%-]ref=x(?:[^a-z0-9_.%-]|$)') AS blocked,
         regexp_matches(lower(url), '(?s)^[^:/?#]*://(?:[^/?#]*\.)?m\..*[^a-z0-9_.%-]fr(?:[^a-z0-9_.%-]|$)') AS allowed
  FROM cut
), named AS (
  SELECT *, CASE WHEN h LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
                 WHEN h LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
                 WHEN h LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
                 WHEN h LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
                 WHEN h LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold(3) != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    model = pieces.Model(f"{tokenizers}/piece_bpe_32k.model")
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "n_tokens", "ids", "round_trip")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "share", "verbatim")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "text")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_pii": op2_pii,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_langid": op7_langid,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontaminate": op9_decontaminate,
    "op10_repeats": op10_repeats,
}
ORACLE = {"op6_url_filter": OP6_SQL}
