"""Incremental ingestion: micro-batches of files' pieces that are idempotent by content hash."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.passages import chunk_records
from folioscope.sources.library import chunk_prefix
from folioscope.sources.tables import append_by_hash, without

PIECES = "source string, file_hash string, seq long, text string"


def held(spark: SparkSession, path: str) -> DataFrame | None:
    """A table's rows; None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def chunks_of(pieces: DataFrame) -> DataFrame:
    """Chunk records of whole files' pieces (source, file_hash, seq, text); ids start with the file's stem and its hash."""
    return chunk_records(pieces, chunk_prefix(F.col("source"), F.col("file_hash")))


def take(batch: DataFrame, path: str) -> None:
    """Add a batch of pieces to the store under path, and make the chunks of the files that it touches anew.

    Pieces are kept as they come, once each, under their file's hash. A file whose pieces come in several batches, or
    again, is numbered over all of them, and its chunks are replaced together; a run that ended between the two writes
    is made good by the next batch that names the file. The hash is that of the file, not of what a batch holds of it.
    """
    spark = batch.sparkSession
    rows = batch.select("source", "file_hash", F.col("seq").cast("long").alias("seq"), "text").where("file_hash is not null").dropDuplicates(["file_hash", "seq"])
    known = held(spark, f"{path}/pieces")
    new = rows if known is None else rows.join(known.select("file_hash", "seq"), ["file_hash", "seq"], "left_anti")
    new.write.mode("append").partitionBy("file_hash").parquet(f"{path}/pieces")
    every = held(spark, f"{path}/pieces")
    if every is None:
        return
    count = lambda df, name: df.groupBy("file_hash").agg(F.count("*").alias(name))
    touched = count(every.join(rows.select("file_hash").distinct(), "file_hash", "left_semi"), "n")
    done = held(spark, f"{path}/chunks")
    if done is not None:
        touched = touched.join(count(done, "m"), "file_hash", "left").where("m is null or m <> n")
    append_by_hash(chunks_of(every.join(touched.select("file_hash"), "file_hash", "left_semi")), f"{path}/chunks")


def drop(spark: SparkSession, path: str, hashes: DataFrame) -> None:
    """Delete files (file_hash) from the store, as when a paper goes or its ingestion failed: each hash is a folder of its own."""
    for name in ("chunks", "pieces"):
        rows = held(spark, f"{path}/{name}")
        if rows is None:
            continue
        gone = [r["file_hash"] for r in rows.select("file_hash").distinct().join(hashes.select("file_hash").distinct(), "file_hash", "left_semi").toLocalIterator()]
        for h in gone:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/file_hash={h}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame | None:
    """The store's chunks without those of some files."""
    rows = held(spark, f"{path}/chunks")
    return None if rows is None else without(rows, hashes)


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take every batch of a stream of pieces (source, file_hash, seq, text) into the store under path."""
    return stream.writeStream.foreachBatch(lambda batch, _: take(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
