"""Tables and files: readers, new-file tests, and sinks keyed by content hash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import stem


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir.

    Only a local session, as in tests, may leave that unset: it gets a folder of its own on the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/folioscope-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written under the shared folder and read again, for what is read more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_hash of the PDF files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.sha2("content", 256).alias("file_hash"))


def unseen(files: DataFrame, store: DataFrame) -> DataFrame:
    """The files whose hash the store does not have."""
    return files.join(store.select("file_hash").distinct(), "file_hash", "left_anti")


def append_by_hash(chunks: DataFrame, path: str) -> None:
    """Write chunks, one partition per file hash; a file that is written again replaces its own rows only."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_hash").parquet(path)


def safe_pdf_name(name: Column) -> Column:
    """A base name that ends in .pdf, without path parts or odd characters."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._ -]", "_")
    return F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(F.when(base == "", "upload").otherwise(base), F.lit(".pdf")))


def library(chunks: DataFrame) -> DataFrame:
    """source, title: the first non-empty title of each source by ordinal, else the source's name."""
    titled = F.min_by("title", F.when(F.col("title") != "", F.col("ord")))
    return chunks.groupBy("source").agg(titled.alias("t")).select("source", F.coalesce("t", "source").alias("title"))


EXTRACTION = """failed_chunks long,
nodes array<struct<id:string,label:string,file_type:string,metadata:struct<graphify_reference_stub:boolean>>>,
edges array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_location:string>>"""


def extractions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """raw_nodes and raw_edges of the JSON files in a folder, one per paper, named by its stem; files with failed chunks are left out."""
    files = spark.read.schema(EXTRACTION).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    whole = files.where(F.coalesce("failed_chunks", F.lit(0)) == 0).withColumn("paper", stem(F.input_file_name()))
    nodes = whole.select("paper", F.posexplode("nodes").alias("ord", "n")).select("paper", "ord", "n.id", "n.label", "n.file_type", F.coalesce("n.metadata.graphify_reference_stub", F.lit(False)).alias("is_stub"))
    return nodes, whole.select("paper", F.posexplode("edges").alias("ord", "e")).select("paper", "ord", "e.*")


def page_of_caption(pages: DataFrame, wanted: DataFrame, window: int = 5) -> DataFrame:
    """id, page for wanted (id, source, page, caption) over pages (source, page, text), counted from 0.

    The first page that holds the caption, of `window` pages from the one named; without any the one named, within the file.
    """
    last = pages.groupBy("source").agg(F.max("page").alias("last"))
    start = wanted.join(last, "source").withColumn("page", F.greatest(F.lit(0), F.least("page", "last")))
    texts = pages.select("source", F.col("page").alias("at"), "text")
    near = (F.col("at") >= F.col("page")) & (F.col("at") < F.col("page") + window) & F.contains("text", "caption") & (F.coalesce("caption", F.lit("")) != "")
    held = start.join(texts, "source").where(near).groupBy("id").agg(F.min("at").alias("at"))
    return start.join(held, "id", "left").select("id", F.coalesce("at", "page").alias("page"))


def without(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """The chunks of all files but those whose hash is given: what stays when a paper is deleted or its ingestion failed."""
    return chunks.join(hashes.select("file_hash").distinct(), "file_hash", "left_anti")


def numbered_names(names: DataFrame) -> DataFrame:
    """ord, name, stored for uploads (ord, name): the safe name, with -1, -2 and so on before the extension where it was taken before."""
    safe = names.withColumn("safe", safe_pdf_name(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("safe").orderBy("ord")) - 1
    return safe.withColumn("n", nth).select("ord", "name", F.when(F.col("n") == 0, F.col("safe")).otherwise(F.concat(F.regexp_replace("safe", r"(?i)\.pdf$", ""), F.lit("-"), F.col("n").cast("string"), F.lit(".pdf"))).alias("stored"))


def worth_retrying(message: Column) -> Column:
    """Whether a failed call may work later: throttled by the minute, not by the day."""
    daily = message.contains("PerDay")
    throttled = message.contains("429") | message.contains("RESOURCE_EXHAUSTED") | F.lower(message).contains("quota")
    return F.coalesce(~daily & throttled, F.lit(False))


def ingest_cost(chunks: DataFrame, per_day: int = 1000) -> DataFrame:
    """One row: n, fits: how many embeddings a new ingest takes, and whether a day's quota holds them."""
    return chunks.agg(F.count("*").alias("n")).withColumn("fits", F.col("n") <= per_day)
