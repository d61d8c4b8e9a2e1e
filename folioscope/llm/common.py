"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Send this module's functions to executors by value, so that they need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def per_process(key: tuple, make):
    """What make() gave for this key, kept by a Python worker from task to task."""
    kept = vars(sys).setdefault("_folioscope_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def whole_groups(batches, column: str, rows: int):
    """Tables of `rows` rows or more (but the last) from batches sorted by a column; no group is torn."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column(column).to_numpy()
        other = np.flip(key != key[-1])
        if other.any():
            edge = len(key) - int(other.argmax())  # the last group may go on in the next batch
            yield t.slice(0, edge).combine_chunks()
            t = t.slice(edge)
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the one that the cluster names in spark.checkpoint.dir.

    Only a local session, as in tests, may leave that unset: it gets a folder of its own on the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/folioscope-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folioscope_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by written(), once nothing reads them any more."""
    for t in tables:
        remove(t.sparkSession, t._folioscope_path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that written() has left in this application; results that read them can't be read again."""
    remove(spark, shared_dir(spark))


def with_least(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """rows with a column least: the smallest value among the rows of the same key; n: the number of rows.

    Keys with more than max(64, n / 10000) rows are at most 20,000 whatever n is, so their minima are broadcast and
    their rows stay where they are; the rows of all other keys are joined by shuffle, and no task gets a large group.
    """
    limit = max(64, n // 10_000)
    lowest = rows.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__low"), F.count("*").alias("__n"))
    crowded = F.broadcast(lowest.where(F.col("__n") > limit).select("__key", F.col("__low").alias("least")))
    tagged = rows.join(crowded, F.col(key) == F.col("__key"), "left")
    others = tagged.where("__key is null").drop("__key", "least").join(lowest.where(F.col("__n") <= limit), F.col(key) == F.col("__key"))
    return tagged.where("__key is not null").drop("__key").unionByName(others.withColumnRenamed("__low", "least").drop("__key", "__n"))


def least_reachable(u: list[int], v: list[int]) -> dict[int, int]:
    """node -> the smallest node that it can reach, by union-find."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        up.setdefault(i, i)
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in zip(u, v, strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def connected_components(edges: DataFrame, collected: int = 0, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node it can reach.

    edges: columns u and v (long). Returns node, label for each node that has an edge to another.
    Up to `collected` edges are solved on the driver, which has no plans of joins to hold then. Beyond that it
    alternates large-star and small-star rounds; each is written to the shared folder, so a lost
    executor costs one round. It ends when a round gives the very edges that it was given. A hub's
    edges are only ever aggregated in parts, and never meet in one task.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    count = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = count(now)
    if 0 < state[0] <= collected:
        found = least_reachable(*now.toArrow().to_pydict().values())
        return spark.createDataFrame(pa.table({"node": pa.array(found.keys(), pa.int64()), "label": pa.array(found.values(), pa.int64())}))
    for _ in range(max_rounds):
        n = state[0]
        if not n:
            return spark.createDataFrame([], "node long, label long")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        low = with_least(large, "u", "v", 2 * n)
        nxt = written(low.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
        new = count(nxt)
        done = new == state and nxt.join(now, ["u", "v"], "left_anti").isEmpty()
        drop_written(now)
        now, state = nxt, new
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


ship(__name__)
