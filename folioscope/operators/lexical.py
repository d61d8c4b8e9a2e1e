"""The lexical index: postings, terms and statistics as tables in a folder, and BM25 over them.

A text is tokenised once, when the index is written. A query's rare terms are scored first. Where the k-th best score
so far is above all that the query's common terms could give, only documents with a rare term can be among the best,
and common terms are looked up for those alone that can still get there; other queries are scored in full. Both give
the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import body_of, tokens
from folioscope.sources.tables import shared_path

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Fixed value: what is kept in the index without its words.
SKIPPED = "math"
#: A term is common if more documents than this, and than this share of all, have it. Only speed depends on it.
COMMON_LEAST, COMMON_SHARE = 1000, 0.05
#: Scores are rounded before they are ranked; bounds leave that much room.
DIGITS, ROOM = 6, 1e-5


def spelled(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, at, term, dl: a row per token of a passage's body; one without tokens, or of the skipped type, keeps one row with a null term."""
    body = body_of(F.coalesce(F.col(text), F.lit("")))
    if "content_type" in docs.columns:
        body = F.when(F.coalesce(F.col("content_type") == SKIPPED, F.lit(False)), "").otherwise(body)
    own = docs.select(key, tokens(body).alias("all"))
    return own.select(key, F.size("all").alias("dl"), F.posexplode_outer("all").alias("at", "term"))


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, term, tf, dl, lead: a row per passage and term; lead marks one row of each passage, so sums over passages need no other table."""
    first = F.coalesce(F.min("at"), F.lit(0)) == 0
    return spelled(docs, key, text).groupBy(key, "term", "dl").agg(F.count("term").alias("tf"), first.alias("lead"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, avgdl."""
    return post.agg(F.count(F.when(F.col("lead"), 1)).alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens")).withColumn("avgdl", F.try_divide("n_tokens", "n_docs"))


def term_df(post: DataFrame) -> DataFrame:
    return post.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; a negative idf is replaced by a quarter of the mean over all terms."""
    raw = df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class Index:
    """postings (key, term, tf, dl, lead), terms (term, df, idf) and stats (one row) of a collection."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str

    @staticmethod
    def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> "Index":
        """Write the index of passages (key, text and, if there is one, content_type); rows of one key count as one passage each."""
        spark = docs.sparkSession
        postings(docs, key, text).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
        post = spark.read.parquet(f"{folder}/postings")
        stats = corpus_stats(post)
        stats.write.mode("overwrite").parquet(f"{folder}/stats")
        idf(term_df(post), spark.read.parquet(f"{folder}/stats")).write.mode("overwrite").parquet(f"{folder}/terms")
        return Index.read(spark, folder, key)

    @staticmethod
    def read(spark, folder: str, key: str = "doc_id") -> "Index":
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "terms", "stats")), key)

    def search(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """q, rank, key, score: the k best passages with a positive score for each query (q, text); ties to the smaller key."""
        key, stats = self.key, self.stats.first()  # one row
        n, avgdl = stats["n_docs"] or 0, stats["avgdl"] or 1.0
        asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
        most = F.col("qtf") * F.col("idf") * (K1 + 1)
        limit = max(COMMON_LEAST, int(COMMON_SHARE * n))
        weighted = asked.join(self.terms, "term").withColumn("common", F.col("df") > limit)
        part = most * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))

        def scored(terms: DataFrame, by: list[str]) -> DataFrame:
            return self.postings.select(key, "term", "tf", "dl").join(terms, by).groupBy("q", key).agg(F.sum(part).alias("s"))

        def best(every: DataFrame) -> DataFrame:
            return top_k(every.select("q", key, F.round("s", DIGITS).alias("score")).where("score > 0"), k, key)

        if n <= limit:  # no term can be common
            return best(scored(weighted, ["term"]))
        rare = scored(weighted.where(~F.col("common")), ["term"])
        gain = weighted.where("common").groupBy("q").agg(F.sum(F.greatest(most, F.lit(0.0))).alias("up"), F.sum(F.least(most, F.lit(0.0))).alias("down"))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), key))
        kth = rare.withColumn("place", place).where(F.col("place") == k).select("q", F.col("s").alias("kth"))
        sure = gain.join(kth, "q").where(F.col("kth") + F.col("down") > F.col("up") + ROOM)
        alive = rare.join(sure, "q").where(F.col("s") + F.col("up") >= F.col("kth") + F.col("down") - ROOM).select("q", key, "s")
        wanted = alive.join(weighted.where("common"), "q")
        added = scored(wanted.select("q", key, "term", "qtf", "idf"), [key, "term"])
        bounded = alive.join(added.withColumnRenamed("s", "more"), ["q", key], "left").select("q", key, (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"))
        plain = rare.join(gain, "q", "left_anti")
        full = scored(weighted.join(gain.join(sure, "q", "left_anti").select("q"), "q", "left_semi"), ["term"])
        return best(bounded.union(plain.select("q", key, "s")).union(full.select("q", key, "s")))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 8, key: str = "doc_id") -> DataFrame:
    """Index.search over passages whose index is written for this one call."""
    return Index.write(docs, shared_path(docs.sparkSession, "index"), key).search(queries, k)


def top_k(scored: DataFrame, k: int, key: str | Column) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "rank", key, "score")
