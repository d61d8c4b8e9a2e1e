"""Token counts from flat token files by scanning for separators.

A token file is a run of little-endian 16- or 32-bit identifiers in which an end-of-document identifier
closes each document; it has no header and no index. The scan cuts files into byte ranges (blocks) of a
fixed size, whatever documents they cut, and searches each for separators with vector instructions. A
block's summary is two numbers: its separators, and the tokens after its last one. A prefix scan over a
file's summaries then gives every block its first document's number and the tokens that an open document
brings along, which stitches the documents that run over any number of blocks.

`write_files` makes such files from texts, in the folder it is given: one file per task, written under
another name and moved when whole, so that a task that is run again only replaces equal bytes.

Defined results: null and empty texts are documents of no tokens; a file's last document may lack its
separator, unless it is empty; separators in a text are ordinary text; repeated rows are documents of
their own; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


class Vocabulary:
    """Byte-pair ranks of a .tiktoken file, the splitting pattern, and the separator's identifier."""

    def __init__(self, path: str, pattern: str, separator: int):
        with open(path, "rb") as f:
            self.data = f.read()
        self.pattern, self.separator = pattern, separator
        self.digest = hashlib.sha256(self.data + pattern.encode()).hexdigest()

    def encoder(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @property
    def width(self) -> int:
        return 2 if max(self.separator, self.data.count(b"\n")) < 1 << 16 else 4


def write_files(docs: DataFrame, vocabulary: Vocabulary, folder: str) -> DataFrame:
    """Write docs (doc_id, text) as token files; returns (file, ordinal, doc_id), the order of the documents."""
    kind = np.dtype(f"<u{vocabulary.width}")

    def run(batches):
        encode = common.per_process(("tokens", vocabulary.digest), vocabulary.encoder)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        part, n = f"{root}/{uuid.uuid4().hex}.part", 0
        out = None
        for b in batches:
            out = out or store.open_output_stream(part)
            for t in b.column(1):
                ids = encode((t.as_py() or "").encode("utf-8", "replace").decode())
                ids.append(vocabulary.separator)
                out.write(np.array(ids, kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * b.num_rows), pa.array(np.arange(n, n + b.num_rows)), b.column(0)], names=["file", "ordinal", "doc_id"]
            )
            n += b.num_rows
        if out:
            out.close()
            store.move(part, f"{root}/{name}")

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, ordinal long, doc_id long")
    return common.written(rows, "token-order")


def scan(spark: SparkSession, folder: str, separator: int, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """file, ordinal, n_tokens for each document in the .bin files of a folder."""
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    files = [(f.base_name, f.size // width) for f in found if f.base_name.endswith(".bin") and f.size]
    blocks = (
        spark.createDataFrame(files, "file string, n long")
        .select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block_tokens))).alias("block"))
        .repartition(max(1, min(4096, sum(1 + n // block_tokens for _, n in files))), "file", "block")
    )

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            got = []
            for name, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    f.seek(block * block_tokens * width)
                    ids = np.frombuffer(f.read(block_tokens * width), f"<u{width}")
                at = np.flatnonzero(ids == separator)
                got.append((name, block, len(at), len(ids) - 1 - int(at[-1]) if len(at) else len(ids), int(at[0]) if len(at) else 0, np.diff(at) - 1))
            cols = list(zip(*got, strict=True)) or [[]] * 6
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["file", "block", "n", "tail", "head", "inner"])

    read = common.written(blocks.mapInArrow(run, "file string, block long, n long, tail long, head long, inner array<long>"), "token-blocks")
    by_file = Window.partitionBy("file").orderBy("block")
    summary = read.select("file", "block", "n", "tail").withColumn("run", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(by_file))
    summary = summary.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    summary = summary.withColumns(
        {
            "carry": F.coalesce(F.lag("open").over(by_file), F.lit(0)),
            "before": F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "last": F.lead("block").over(by_file).isNull(),
        }
    )
    closed = (
        read.where("n > 0")
        .join(summary.select("file", "block", "carry", "before"), ["file", "block"])
        .select("file", "before", F.posexplode(F.concat(F.array(F.col("head") + F.col("carry")), "inner")).alias("k", "n_tokens"))
        .select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens")
    )
    left_open = summary.where("last and open > 0").select("file", (F.col("before") + F.col("n")).alias("ordinal"), F.col("open").alias("n_tokens"))
    return closed.union(left_open)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, block_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, file, ordinal, n_tokens for each row of docs: writes token files, scans them, then deletes them."""
    spark = docs.sparkSession
    folder = common.fresh_path(spark, "tokens")
    order = write_files(docs, vocabulary, folder)
    counts = common.written(scan(spark, folder, vocabulary.separator, vocabulary.width, block_tokens), "token-counts")
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")


common.ship(__name__)
