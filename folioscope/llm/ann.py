"""Nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more dimension, sqrt(M**2 - |x|**2) with M the largest norm, and queries a zero there; the
largest inner product is then the least Euclidean distance. All are turned by one random rotation, which
makes any prefix of dimensions a fair sample of a distance, and are dealt into inverted lists around
k-means centres (fitted on at most `max_sample` vectors, the least by hash; every vector is indexed).

How many lists a query probes is measured, not set: sampled vectors ask the sample, and the fewest lists that
hold `recall` of their true neighbours are probed. Vectors that cluster need few, vectors without structure most.

A query first measures the lists nearest to it that hold `4 * k` candidates together: the distance of its k-th
best there is its threshold. The other probed lists are then scanned in column blocks. After each block a
hypothesis test on the partial distance (is distance * sqrt(d / D) above threshold * (1 + epsilon /
sqrt(d))?) abandons candidates early; few live to the last block. Survivors get their exact inner product
on the original vectors, in double precision. Blocks are matrix products while most pairs live, and lists of
the living pairs after that.

A list's vectors come in chunks and its queries in blocks, and each chunk meets each block in a task of its own;
so a task's memory is bounded whatever list is crowded.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those that have not the commonest length (the longer one, if equally common). Repeated ids are candidates of
their own; for a query all rows of its own id are left out. An id that stands with several vectors asks with all
of them, and a candidate counts by its best score. A query has as many rows as there are candidates, up to k;
ties go to the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that take part, with their squared norm n2."""
    v = F.col("v")
    kind = vectors.schema["embedding"].dataType.simpleString()
    same = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long"), same.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    common_size = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    first = common_size.first()
    return fine.where(F.size(v) == (first["d"] if first else 0)).withColumn("n2", F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest centres of each row, nearest first."""
    out = []
    for at in range(0, len(x), 4096):
        d = (centres * centres).sum(axis=1) - 2 * x[at : at + 4096] @ centres.T
        some = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Index:
    """Rotation, centres, number of probes and largest norm, fitted on a bounded sample (the norm on all vectors)."""

    def __init__(self, vectors: DataFrame, k: int, lists: int | None, recall: float, max_sample: int, seed: int):
        stats = vectors.agg(F.count("*").alias("n"), F.max("n2").alias("m2")).first()
        self.n, self.m2 = stats["n"], stats["m2"] or 0.0
        self.lists = lists or max(1, min(4096, int(math.sqrt(self.n))))
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("v", "n2").toArrow()
        if not self.n:
            return
        x = matrix(sample.column("v"))
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.normal(size=(x.shape[1] + 1, x.shape[1] + 1)))
        self.rotation = q * np.sign(np.diag(r))
        self.lists = min(self.lists, len(x))
        turned = self.turned(x, sample.column("n2").to_numpy())
        self.centres = kmeans(turned, self.lists)
        self.probes = self.enough(x, turned, k, recall, rng)

    def turned(self, x: np.ndarray, n2: np.ndarray | None) -> np.ndarray:
        """Vectors with their added dimension (queries: zero), rotated."""
        last = np.zeros(len(x)) if n2 is None else np.sqrt(np.maximum(0.0, self.m2 - n2))
        return np.hstack([x, last[:, None]]) @ self.rotation

    def enough(self, x: np.ndarray, turned: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
        """The fewest probes that find `recall` of the k nearest of 256 sampled vectors, a neighbour at a list's place counting once."""
        asked = rng.choice(len(x), size=min(256, len(x)), replace=False)
        k = min(k, len(x) - 1)
        if k < 1:
            return self.lists
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(score, -k, axis=1)[:, -k:]
        home = nearest(turned, self.centres, 1)[:, 0]
        order = nearest(self.turned(x[asked], None), self.centres, self.lists)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(self.lists), order.shape), 1)
        needed = np.sort(np.take_along_axis(place, home[best], 1).ravel())
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


#: A share of pairs still alive below which they are kept as a list.
SPARSE = 0.15


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, width: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query number, row number) that column blocks and the test leave; limit: squared distances."""
    wide = x.shape[1]
    part = alive = i = j = None
    for a in range(0, wide, width):
        d = min(a + width, wide)
        xb, qb = x[:, a:d], q[:, a:d]
        bound = limit * (d / wide) * (1 + epsilon / math.sqrt(d)) ** 2 if d < wide else limit * (1 + 1e-9) + 1e-9
        if i is None:
            block = (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1)[None, :] - 2 * (qb @ xb.T)
            part = block if part is None else part + block
            alive = part <= bound[:, None]
            if np.count_nonzero(alive) < SPARSE * alive.size:
                i, j = np.nonzero(alive)
                part = part[i, j]
            continue
        for at in range(0, len(i), 1 << 18):
            s = slice(at, at + (1 << 18))
            part[s] += ((qb[i[s]] - xb[j[s]]) ** 2).sum(axis=1)
        stay = part <= bound[i]
        i, j, part = i[stay], j[stay], part[stay]
    return np.nonzero(alive) if i is None else (i, j)


def k_best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the pairs that are among the k best of their query i; ties to the smaller id."""
    order = np.lexsort((ids, -score, i))
    first = np.flatnonzero(np.diff(i[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < k]


def search(
    vectors: DataFrame,
    query_filter: str,
    k: int = 20,
    lists: int | None = None,
    recall: float = 0.96,
    max_sample: int = 16384,
    width: int = 16,
    epsilon: float = 2.1,
    chunk: int = 8192,
    seed: int = 4,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector that query_filter picks."""
    out = "query_id long, row long, vec_id long, score double"
    spark = vectors.sparkSession
    fine = usable(vectors)
    index = Index(fine, k, lists, recall, max_sample, seed)
    if not index.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = fine.schema["v"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = index.turned(matrix(b.column(1)), b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(x, index.centres, 1)[:, 0])], names=["vec_id", "v", "list"])

    placed = fine.select("vec_id", "v", "n2").mapInArrow(assign, f"vec_id long, v {kind}, list long")
    placed = common.written(placed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most 4096 rows
    held = np.array([sizes.get(i, 0) for i in range(index.lists)])

    def visits(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = nearest(index.turned(matrix(b.column(1)), None), index.centres, index.lists)
            before = np.cumsum(held[near], axis=1) - held[near]
            home = before < 4 * k + b.column(2).to_numpy()[:, None]  # its own rows are no candidates
            probed = home | (np.arange(index.lists)[None, :] < index.probes)
            row, col = np.nonzero(probed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(near[row, col]), pa.array(home[row, col])],
                names=["query_id", "v", "list", "home"],
            )

    # A query vector may stand in the table more than once; its copies ask the same and are asked once.
    asked = placed.where(F.expr(query_filter)).groupBy("vec_id", "v").agg(F.count("*").alias("own"))
    own = F.sum("own").over(Window.partitionBy("vec_id"))
    asked = asked.select("vec_id", "v", own.alias("own")).mapInArrow(visits, f"query_id long, v {kind}, list long, home boolean")
    queries = common.written(asked, "visits")
    visitors = {(r["list"], r["home"]): r["count"] for r in queries.groupBy("list", "home").count().collect()}  # twice the lists at most
    # Four times an even share of the vectors, so that a crowded list is many chunks at any size of the table.
    chunk = max(256, min(chunk, 4 * index.n // index.lists))

    def table_of(numbers: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(max(1, numbers.get(i, 1))) for i in range(index.lists)]), (F.col("list") + 1).cast("int"))

    chunks = table_of({i: math.ceil(n / chunk) for i, n in sizes.items()})

    def compare(with_limit: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
            if left.num_rows and right.num_rows:
                x, ids, rows = matrix(left.column("v")), left.column("vec_id").to_numpy(), left.column("row").to_numpy()
                turned = index.turned(x, (x * x).sum(axis=1))
                for at in range(0, right.num_rows, 256):
                    part = right.slice(at, 256)
                    q, own = matrix(part.column("v")), part.column("query_id").to_numpy()
                    if with_limit:
                        least = part.column("least").to_numpy(zero_copy_only=False)
                        far = np.where(np.isnan(least), np.inf, (q * q).sum(axis=1) + index.m2 - 2 * least)
                        i, j = scan(turned, index.turned(q, None), far, width, epsilon)
                        score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + (1 << 18)]], x[j[s : s + (1 << 18)]]) for s in range(0, max(1, len(i)), 1 << 18)])
                    else:
                        whole = q @ x.T
                        whole[own[:, None] == ids[None, :]] = -np.inf
                        edge = np.partition(whole, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
                        i, j = np.nonzero((whole >= edge[:, None]) & (whole > -np.inf))
                        score = np.einsum("ij,ij->i", q[i], x[j])
                    keep = ids[j] != own[i]
                    i, j, score = i[keep], j[keep], score[keep]
                    best = k_best(i, ids[j], score, k)
                    found.append((own[i[best]], rows[j[best]], ids[j[best]], score[best]))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)]
            return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), cols, strict=True)))

        return run

    def visit(part: DataFrame, home: bool) -> DataFrame:
        blocks = table_of({i: math.ceil(visitors.get((i, home), 0) / chunk) for i in range(index.lists)})
        dealt = part.select("list", F.pmod(F.xxhash64("query_id", "v"), blocks).cast("int").alias("block"), *[c for c in part.columns if c != "list"])
        dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        spots = placed.select("list", F.pmod(F.xxhash64("row"), chunks).cast("int").alias("chunk"), "row", "vec_id", "v")
        spots = spots.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        key = ("list", "chunk", "block")
        return spots.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(compare(not home), out)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    once = lambda found: found.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    near = common.written(once(visit(queries.where("home"), True)), "near")
    least = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    far = visit(queries.where("not home").join(least, "query_id", "left"), False)
    ranked = once(near.union(far)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


common.ship(__name__)
