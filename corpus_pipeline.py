"""The corpus pipeline: documents through five of the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last adds the encoding. run() writes each stage's result to the shared folder, reads it again, and
deletes its predecessor's. What a stage's docstring does not say otherwise: an empty table gives an empty table,
repeated rows and rows that share a doc_id are judged one by one, texts of any length are taken whole, and further
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, decontaminate, langid, pieces, pii, queries, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is in a language: texts that are null, empty or without a letter go.

    The classifier learns from the labels of two thirds of the ids. Where those have none, no text is judged but by
    its letters. Equal texts get equal languages; a tie goes to the language that comes first by name.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").where(queries.fold(3) != 1))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return langid.predict(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts with a similarity of 0.8 or more over sets of five-word shingles.

    That of the smallest doc_id stays (then of the smallest text hash); a null id comes last. Of repeated rows one
    stays, and so it is for null and empty texts, which are alike. Two texts under one id are two rows.
    """
    return simhash.keep_one(docs, simhash.similar_groups(docs.select("doc_id", "text"), shingle=5, similarity=0.8)).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other names or numbers, go; null and empty texts stay.

    Rows are judged by doc_id and text; an empty benchmark, or one of nulls, takes nothing away.
    """
    found = decontaminate.leaks(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "benchmark"))
    return decontaminate.without_leaks(docs, found).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get pseudonyms, equal values equal ones; n_chars follows the new text. Null and empty texts stay."""
    new = pii.pseudonymise(docs, queries.pii_key(spark))
    return new.withColumn("n_chars", F.when(F.col("n_found") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's pieces (n_tokens, ids), and whether they decode to the text again; null and empty texts have none."""
    return pieces.encode(docs, pieces.Model(f"{queries.TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
#: SimHash groups, codeword classifiers and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        if held is not None:
            common.drop_written(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
