"""SimHash near-duplicate search with vantage-point trees.

A document's fingerprint has one bit for each bit of a 64-bit hash: it is set when more than half
of the hashes of the document's word shingles (repeats included) have it set. Documents whose
fingerprints differ in few bits are linked; groups are the connected components of the links.

Search. A fingerprint is cut into blocks so that two linked fingerprints differ, in at least one
block, by no more than ``radius // blocks`` bits (pigeonhole). Each block has a vantage-point tree
over Hamming distance, fitted on a bounded sample of fingerprints; every fingerprint is then routed
through it. Its home leaf is where its own distances lead; it also visits, as a guest, each leaf
that the triangle bound cannot exclude, so a linked pair always meets in the home leaf of one of
them. In a leaf, homes are compared with all rows on whole fingerprints, so links are exact.

Equal fingerprints are collapsed before the search. A leaf sends out a spanning set of links, never
all pairs. A leaf with many rows is cut into chunks of bounded size that are all compared.

Defined results: a null text counts as an empty one; a text without words has fingerprint zero and
is linked like any other; fewer words than a shingle give one shingle of all words; repeated rows
are documents of their own; a null doc_id takes part but never names a group unless all are null;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of one comparison task at most, on either side.
CHUNK_ROWS = 16384
#: Shingles of one task's sets at most, on either side.
CHUNK_SHINGLES = 1 << 21


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles; A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    ends = (starts + lengths - 1)[shingle - 1 :]
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)), "<u8", len(ends)
    )


def majority_bits(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint as `words` 64-bit words; word j > 0 comes from hashes remixed with j."""
    out = np.zeros(words, "<u8")
    if not len(hashes):
        return out
    for j in range(words):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 8160):
            h = hashes[at : at + 8160]
            if j:
                h = h + np.uint64(j * 0x9E3779B97F4A7C15 & (2**64 - 1))
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            if whole:
                counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += bits[whole:].sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id, fp (long, the bits of the first word) and, when words > 1, wide (array of longs)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = [majority_bits(shingle_hashes(t or b"", shingle), words) for t in texts]
            cols = [b.column(0), pa.array([int(f[0].astype("<i8")) for f in fps], pa.int64())]
            if words > 1:
                cols.append(pa.array([f.view("<i8").tolist() for f in fps], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "wide"][: len(cols)])

    schema = "doc_id long, fp long" + (", wide array<long>" if words > 1 else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def block_edges(blocks: int, bits: int = 64) -> list[tuple[int, int]]:
    cuts = [round(bits * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def grow_tree(values: np.ndarray, leaves: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage value, limit, inner child, outer child) of a vantage-point tree; a child < 0 is leaf -child - 1.

    The limit is where the sample splits most evenly. Always returns at least one node; leaf numbers are dense.
    """
    rng, nodes, found = np.random.default_rng(seed), [], [0]
    depth = max(0, math.ceil(math.log2(max(1, leaves))))

    def leaf() -> int:
        found[0] += 1
        return -found[0]

    def grow(sample: np.ndarray, left: int) -> int:
        if left <= 0 or len(sample) < 4:
            return leaf()
        best = None
        for v in rng.choice(sample, size=min(8, len(sample)), replace=False):
            d = np.bitwise_count(sample ^ v)
            for m in np.unique(d)[:-1]:
                inside = np.count_nonzero(d <= m)
                border = np.count_nonzero((d > int(m) - 1) & (d <= int(m) + 1))
                cost = border + abs(2 * inside - len(sample))
                if best is None or cost < best[0]:
                    best = (cost, int(v), int(m))
        if best is None:
            return leaf()
        at = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(sample ^ np.uint64(best[1]))
        inner = grow(sample[d <= best[2]], left - 1)
        outer = grow(sample[d > best[2]], left - 1)
        nodes[at] = (best[1], best[2], inner, outer)
        return at

    root = grow(values, depth)
    return nodes if root >= 0 else [(0, 64, -1, -1)]


def route(values: np.ndarray, tree: list, radius: int):
    """Yields (leaf, row numbers, whether each is at home) for the leaves that the triangle bound leaves open."""
    stack = [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while stack:
        at, rows, home = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows, home
            continue
        vantage, limit, inner, outer = tree[at]
        d = np.bitwise_count(values[rows] ^ np.uint64(vantage)).astype(np.int64)
        inside = d <= limit
        if inner == outer:
            stack.append((inner, rows, home))
            continue
        near, far = d - radius <= limit, d + radius > limit
        stack.append((inner, rows[near], (home & inside)[near]))
        stack.append((outer, rows[far], (home & ~inside)[far]))


def spanning_links(home: np.ndarray, rows: np.ndarray, limit: int) -> np.ndarray:
    """For each row, the number of a row in its group under links between a home and any row.

    home: row numbers of the homes; rows: fingerprints, one line of 64-bit words each.
    """
    label = np.arange(len(rows))
    step = max(1, 4_000_000 // max(1, len(rows)))
    for at in range(0, len(home), step):
        part = home[at : at + step]
        near = np.bitwise_count(rows[part, 0][:, None] ^ rows[None, :, 0])
        if rows.shape[1] > 1:
            near = near.astype(np.uint16)
            for j in range(1, rows.shape[1]):
                near += np.bitwise_count(rows[part, j][:, None] ^ rows[None, :, j])
        hit = near <= limit
        for i in np.flatnonzero(hit.sum(axis=1) > 1):
            groups = np.unique(label[hit[i]])
            if len(groups) > 1:
                label[np.isin(label, groups[1:])] = groups[0]
    return label


def close_pairs(shard: np.ndarray, bits: np.ndarray, home: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that span the groups in each shard; rows are sorted by shard."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    size = np.diff(edge)
    few = np.repeat(size <= 8, size)
    left, right = [], []
    for k in range(1, min(8, int(size.max(initial=1)))):  # small shards: all their rows against the k-th next, at once
        a = np.flatnonzero(few[:-k] & (shard[:-k] == shard[k:]) & (home[:-k] | home[k:]))
        for at in range(0, len(a), 1 << 18):
            i = a[at : at + (1 << 18)]
            hit = np.bitwise_count(bits[i] ^ bits[i + k]).sum(axis=1, dtype=np.uint16) <= limit
            left.append(i[hit] + k)
            right.append(i[hit])
    for g in np.flatnonzero(size > 8):
        at, end = edge[g], edge[g + 1]
        label = spanning_links(np.flatnonzero(home[at:end]), bits[at:end], limit)
        moved = np.flatnonzero(label != np.arange(end - at))
        left.append(moved + at)
        right.append(label[moved] + at)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def links_in_shards(placed: DataFrame, sizes: DataFrame, limit: int, max_broadcast: int = 100_000) -> DataFrame:
    """u, v: a spanning set of the links in each shard of placed (shard, fp, home, wide).

    sizes (shard, nh, na): of the crowded shards, how many chunks of homes and of all rows
    to make. It is broadcast if it is short, else joined by shuffle.
    """
    sizes = common.written(sizes, "sizes")
    crowded = sizes.count()
    parts = placed.select("shard", F.lit(0).alias("h"), F.lit(0).alias("a"), "fp", "home", "wide")
    if crowded:
        cut = placed.join(F.broadcast(sizes) if crowded <= max_broadcast else sizes, "shard", "left")
        spot = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("na")).cast("int")
        other = F.pmod(F.xxhash64("fp", F.lit(8)), F.col("nh")).cast("int")
        small = cut.where("na is null").select(*parts.columns[:1], F.lit(0).alias("h"), F.lit(0).alias("a"), "fp", "home", "wide")
        visits = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda h: F.struct(h.alias("h"), spot.alias("a"), F.lit(False).alias("home")))
        at_home = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda a: F.struct(other.alias("h"), a.alias("a"), F.lit(True).alias("home")))
        big = cut.where("na is not null and nh > 0").select("shard", "fp", "wide", F.explode(F.when(F.col("home"), F.concat(visits, at_home)).otherwise(visits)).alias("x"))
        parts = small.union(big.select("shard", "x.h", "x.a", "fp", "x.home", "wide"))

    def compare(batches):
        for t in common.whole_groups(batches, "task", 1 << 16):
            fp, task = t.column("fp").to_numpy(), t.column("task").to_numpy()
            wide = t.column("wide").combine_chunks()
            wide = pa.concat_arrays(wide.chunks) if isinstance(wide, pa.ChunkedArray) else wide
            bits = np.ascontiguousarray(wide.flatten().to_numpy().view(np.uint64).reshape(len(fp), -1))
            a, b = close_pairs(task, bits, t.column("home").to_numpy(zero_copy_only=False), limit)
            keep = fp[a] != fp[b]
            yield from pa.table({"u": fp[a][keep], "v": fp[b][keep]}).to_batches()

    task = F.xxhash64("shard", "h", "a")  # two shards in one task value would only be compared too
    return (
        parts.select(task.alias("task"), "fp", "home", "wide").repartition("task").sortWithinPartitions("task").mapInArrow(compare, "u long, v long")
    )


def place(distinct: DataFrame, radius: int, blocks: int, home_rows: int, max_leaves: int, seed: int) -> DataFrame:
    """shard, fp, home: every fingerprint in every leaf that it has to visit.

    The trees are fitted on a sample of at most 16 * max_leaves fingerprints (the least by hash).
    """
    n = distinct.count()
    leaves = max(1, min(max_leaves, math.ceil(n / home_rows)))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(16 * leaves).toArrow().column("fp").to_numpy().view(np.uint64)
    spans = block_edges(blocks)
    cut = [lambda x, a=a, b=b: (x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in spans]
    trees = [grow_tree(c(sample), leaves, seed + i) for i, c in enumerate(cut)]
    near = radius // blocks

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i, tree in enumerate(trees):
                a, e = spans[i]
                values = (fp.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << (e - a)) - 1)
                for leaf, rows, home in route(values, tree, near):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), i * (1 << 20) + leaf)), pa.array(fp[rows]), pa.array(home)],
                        names=["shard", "fp", "home"],
                    )

    return distinct.select("fp").mapInArrow(run, "shard long, fp long, home boolean")


def crowded_shards(placed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """shard, nh, na for the shards of placed (shard, home) that overflow a chunk."""
    chunks = lambda n: F.ceil(n / chunk_rows).cast("int")
    return placed.groupBy("shard").agg(chunks(F.sum(F.col("home").cast("int"))).alias("nh"), chunks(F.count("*")).alias("na")).where("na > 1")


def components(
    docs: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    blocks: int = 3,
    home_rows: int = 384,
    max_leaves: int = 8192,
    seed: int = 11,
) -> DataFrame:
    """doc_id, fp, component_id, label (the component's key) for each row of docs (doc_id, text): see the module's notes."""
    fps = common.written(fingerprints(docs, shingle), "fingerprints")
    first = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    placed = place(first, radius, blocks, home_rows, max_leaves, seed)
    links = links_in_shards(placed.withColumn("wide", F.array("fp")), crowded_shards(placed), radius)
    return _named(fps, first, common.connected_components(links))


def _named(fps: DataFrame, first: DataFrame, labels: DataFrame) -> DataFrame:
    """Give each fingerprint the smallest doc_id of its component, then each row its fingerprint's; label: the component's key."""
    label = first.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    label = common.written(label, "labels")
    least = common.with_least(label, "label", "first_id", label.count()).select("fp", F.col("least").alias("component_id"), "label")
    return fps.join(common.written(least, "named"), "fp").select(*fps.columns, "component_id", "label")


def sketches(docs: DataFrame, shingle: int, words: int, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """doc_id, text_hash, fp (a hash of the set of distinct shingles), n (its size), wide (the set's fingerprint) and bands.

    A band is a hash of `rows` minima of the set under hash functions of the band's own; a set without shingles has none.
    """
    rng = np.random.default_rng(seed)
    flip, odd = (rng.integers(0, 1 << 64, bands * rows, "<u8") | np.uint64(i) for i in (0, 1))

    def run(batches):
        for b in batches:
            fp, n, wide, band = [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                held = np.unique(shingle_hashes(t or b"", shingle))
                fp.append(np.int64(xxhash.xxh64_intdigest(held.tobytes(), 42) - (1 << 63)))
                n.append(len(held))
                wide.append(majority_bits(held, words).view("<i8"))
                least = np.array([((held ^ x) * y).min() for x, y in zip(flip, odd, strict=True)] if len(held) else [], "<u8").reshape(-1, rows)
                band.append(np.array([xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least)], "<u8").view("<i8"))
            cols = [pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(wide, pa.list_(pa.int64())), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "text_hash", "fp", "n", "wide", "bands"])

    schema = "doc_id long, text_hash long, fp long, n long, wide array<long>, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


#: Graphs of links with so many edges at most are collected; larger ones take rounds of joins.
COLLECTED = 100_000
#: From so many shingles on, fingerprints sieve candidates; below, sets are too small for them.
SIEVED = 64
#: Up to so many rows, all pairs of a shard are candidates at once.
FEW = 8


#: So many nearest rows of each row are candidates in a crowded shard from the start.
NEAREST = 3
#: Rows that a leaf of a shard's tree holds without being split, and how many comparisons a row of a node a split has to save.
LEAF, SAVED = 64, 16


def vantage_leaves(n: int, measure, radius: float, seed: int = 17):
    """Yields (rows, homes), ascending row numbers, for the leaves of a vantage-point tree over n rows of a metric.

    measure(rows) gives a function from a row to its distances from rows. A row is at home in one leaf, and a guest in
    each other one that the triangle bound cannot exclude, so of two rows within the radius each is in the other's home
    leaf. A node is split at the vantage point and limit that leave the fewest comparisons; where none saves enough it
    stays whole, so the tree never costs more comparisons than there are pairs.
    """
    rng = np.random.default_rng(seed)
    stack = [(np.arange(n), np.ones(n, bool))]
    while stack:
        rows, home = stack.pop()
        most = np.count_nonzero(home)
        if not most:
            continue
        best, work = None, (most - SAVED) * len(rows)
        if len(rows) > LEAF:
            to = measure(rows)
            for v in rng.choice(rows, 4, replace=False):
                d = to(v)
                own = np.sort(d[home])
                gap = int(np.argmax(np.diff(own))) if most > 1 else 0
                for limit in {own[most // 4], own[most // 2], own[3 * most // 4], own[gap], own[min(gap + 1, most - 1)] - 1e-9}:
                    inside, near, far = d <= limit, d <= limit + radius, d > limit - radius
                    within = np.count_nonzero(home & inside)
                    cost = within * np.count_nonzero(near) + (most - within) * np.count_nonzero(far)
                    if 0 < within < most and cost < work:
                        best, work = (inside, near, far), cost
        if best is None:
            yield rows, rows[home]
            continue
        inside, near, far = best
        stack.append((rows[near], (home & inside)[near]))
        stack.append((rows[far], (home & ~inside)[far]))


def nearest_rows(bits: np.ndarray, rows: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers: each of homes with its NEAREST others of rows; bits: a line of 64-bit words per row."""
    i, j, held = [], [], bits[rows]
    step, k = max(1, 4_000_000 // len(rows)), min(NEAREST, len(rows) - 1)
    for at in range(0, len(homes) if k else 0, step):
        part = homes[at : at + step]
        far = np.zeros((len(part), len(rows)), np.uint16)
        for w in range(bits.shape[1]):
            far += np.bitwise_count(bits[part, w][:, None] ^ held[None, :, w])
        far[np.arange(len(part)), np.searchsorted(rows, part)] = np.iinfo(np.uint16).max
        i.append(np.repeat(part, k))
        j.append(rows[np.argpartition(far, k - 1, axis=1)[:, :k].ravel()])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(i or empty), np.concatenate(j or empty)


def dealt_in_chunks(spread: DataFrame, sizes: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """spread's rows with task: those of a shard in one, or for the shards in sizes (shard, na) each two of na chunks in one."""
    crowded = sizes.count()
    cut = spread.join(F.broadcast(sizes) if crowded <= max_broadcast else sizes, "shard", "left")
    na = F.coalesce("na", F.lit(1))
    spot = F.pmod(F.xxhash64("fp", F.lit(7)), na).cast("int")
    meets = F.transform(F.sequence(F.lit(0), na - 1), lambda a: F.struct(F.least(a, spot).alias("h"), F.greatest(a, spot).alias("a")))
    task = F.xxhash64("shard", "x.h", "x.a")  # two chunks meet once, under the lesser one's number
    dealt = cut.withColumn("x", F.explode(meets)).withColumn("task", task).drop("na", "x")
    return dealt.repartition("task").sortWithinPartitions("task")


def flat_list(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's start."""
    column = t.column(name).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()


def sieve(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, similarity: float, limit: int):
    """Of pairs of row numbers those whose sizes allow the similarity and, where both sets are large, whose fingerprints differ by limit at most."""

    def may(i, j):
        hit = np.flatnonzero((fp[i] != fp[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9))
        i, j = i[hit], j[hit]
        near = (np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.uint16) <= limit) | (np.minimum(n[i], n[j]) < SIEVED)
        return i[near], j[near]

    return may


def candidates(spread: DataFrame, sizes: DataFrame, similarity: float, limit: int) -> DataFrame:
    """u, v: pairs of rows of spread (shard, fp, n, wide) in one shard that may be similar.

    Small shards give all of them. A crowded one is searched through a vantage-point tree over its fingerprints: a leaf
    gives of each row at home its NEAREST rows, and pairs with a leader (the first row at home that no earlier leader
    took), so no more than a few times the shard's rows.
    """

    def compare(batches):
        for t in common.whole_groups(batches, "task", 1 << 16):
            task, fp, n = (t.column(c).to_numpy() for c in ("task", "fp", "n"))
            bits = np.ascontiguousarray(flat_list(t, "wide")[0].view(np.uint64).reshape(len(fp), -1))
            may, found = sieve(fp, n, bits, similarity, limit), []
            edge = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
            size = np.diff(edge)
            few = np.repeat(size <= FEW, size)
            for k in range(1, min(FEW, int(size.max(initial=1)))):
                a = np.flatnonzero(few[:-k] & (task[:-k] == task[k:]))
                found.append(may(a, a + k))
            for g in np.flatnonzero(size > FEW):
                lo, own = edge[g], bits[edge[g] : edge[g + 1]]
                measure = lambda rows, own=own: lambda v: np.bitwise_count(own[rows] ^ own[v]).sum(axis=1, dtype=np.int64)
                for rows, left in vantage_leaves(len(own), measure, limit):
                    i, j = nearest_rows(own, rows, left)
                    found.append(may(lo + i, lo + j))
                    left = lo + left
                    while len(left) > 1:
                        first, left = left[0], left[1:]
                        found.append(may(np.full(len(left), first), left))
                        left = np.setdiff1d(left, found[-1][1], assume_unique=True)
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from pa.table({"u": np.minimum(fp[i], fp[j]), "v": np.maximum(fp[i], fp[j])}).to_batches()

    dealt = dealt_in_chunks(spread.select("shard", "fp", "n", "wide"), sizes)
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def links_apart(crowd: DataFrame, sizes: DataFrame, similarity: float, limit: int) -> DataFrame:
    """u, v: all links in a shard between rows of crowd (shard, fp, n, wide, label, bands, held) with different labels.

    Sets are compared where they meet, so a crowded shard sends out no pair that is not a link. They meet in the leaves
    of a vantage-point tree over the sets' Jaccard distance, whose triangle bound is exact. A pair that shares several
    shards is compared in the first one.
    """

    def compare(batches):
        for t in common.whole_groups(batches, "task", 1 << 10):
            task, shard, fp, n, label = (t.column(c).to_numpy() for c in ("task", "shard", "fp", "n", "label"))
            bits = np.ascontiguousarray(flat_list(t, "wide")[0].view(np.uint64).reshape(len(fp), -1))
            bands = flat_list(t, "bands")[0].reshape(len(fp), -1)
            held, start = flat_list(t, "held")
            may, own = sieve(fp, n, bits, similarity, limit), np.argmax(bands == shard[:, None], axis=1)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
            ends = np.append(start, len(held))
            for g in np.flatnonzero(np.diff(edge) > 1):
                lo, hi = edge[g], edge[g + 1]
                if (label[lo:hi] == label[lo]).all():
                    continue
                known, ids = np.unique(held[ends[lo] : ends[hi]], return_inverse=True)
                mark, at = np.zeros(len(known), bool), ends[lo : hi + 1] - ends[lo]

                def measure(rows, ids=ids, mark=mark, at=at):
                    size = at[rows + 1] - at[rows]
                    first = np.cumsum(size) - size
                    all_of = ids[np.repeat(at[rows] - first, size) + np.arange(size.sum())]

                    def to(v):
                        mine = ids[at[v] : at[v + 1]]
                        mark[mine] = True
                        both = np.add.reduceat(mark[all_of], first, dtype=np.int64)
                        mark[mine] = False
                        return 1 - both / (size + len(mine) - both)

                    return to

                for rows, homes in vantage_leaves(hi - lo, measure, 1 - similarity + 1e-9):
                    for k in homes:
                        rest = lo + rows[rows > k]  # a pair is compared where its first row is at home
                        rest = rest[label[rest] != label[lo + k]]
                        _, j = may(np.full(len(rest), lo + k), rest)
                        j = j[np.argmax(bands[j] == bands[lo + k], axis=1) == own[lo + k]]
                        if not len(j):
                            continue
                        j = j[measure(j - lo)(k) <= 1 - similarity + 1e-9]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[lo + k], fp[j])), pa.array(np.maximum(fp[lo + k], fp[j]))], names=["u", "v"])

    return dealt_in_chunks(crowd, sizes).mapInArrow(compare, "u long, v long")


def sets_of(wanted: DataFrame, docs: DataFrame, first: DataFrame, shingle: int, max_broadcast: int = 100_000) -> DataFrame:
    """fp, held: the sets of distinct shingles of wanted (fp); first has a row of docs for each fp."""
    keys = common.written(first.join(wanted, "fp").select("fp", F.col("first.doc_id").alias("k_id"), F.col("first.text_hash").alias("k_hash")), "wanted")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash"))
    texts = docs.select("doc_id", "text").join(F.broadcast(keys) if keys.count() <= max_broadcast else keys, same).select("fp", "text")

    def run(batches):
        for b in batches:
            for fp, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held = np.unique(shingle_hashes(t or b"", shingle)).view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([fp], pa.int64()), pa.array([held], pa.list_(pa.int64()))], names=["fp", "held"])

    return common.written(texts.mapInArrow(run, "fp long, held array<long>").dropDuplicates(["fp"]), "sets")


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose sets of distinct shingles have the similarity; first has a row of docs for each fp."""
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), docs, first, shingle)
    one, two = sets.select(F.col("fp").alias("u"), F.col("held").alias("a")), sets.select(F.col("fp").alias("v"), F.col("held").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    enough = both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9
    return pairs.join(one, "u").join(two, "v").where(enough).select("u", "v")


def similar_groups(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = 0.8,
    words: int = 10,
    bands: int = 20,
    rows: int = 4,
) -> DataFrame:
    """doc_id, text_hash, fp, component_id, label, with links between texts of a shingle similarity (Jaccard) of `similarity` or more.

    Links are exact: each is checked on the sets of distinct shingles. Texts with equal sets are collapsed before.
    Candidates share a band of `rows` minima, whatever their length: with 20 bands of 4 a pair at similarity 0.8 does
    with probability 0.99997. Two sets of similarity s have a cosine of 2s / (1 + s) at least, and each fingerprint bit
    differs with probability acos(cosine) / pi; candidates with six standard deviations more are sieved out, unless
    one is short. A crowded shard is searched through vantage-point trees: its rows are first checked against leaders and
    their nearest rows; then all its candidates
    that the links so far leave in different components are checked where they meet, so a large group of copies sends
    out links only, and once it hangs together needs none of its other pairs.
    """
    total = 64 * words
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = math.ceil(total * share + 6 * math.sqrt(total * share * (1 - share)))
    fps = common.written(sketches(docs, shingle, words, bands, rows), "sketches")
    first = common.written(
        fps.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "wide", "bands")]),
        "distinct",
    )
    spread = first.select(F.explode("bands").alias("shard"), "fp", "n", "wide")
    counts = spread.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))
    large = common.written(counts.where(F.col("rows") > FEW), "sizes")
    pieces = lambda c, most: large.select("shard", F.ceil(F.col(c) / most).cast("int").alias("na")).where("na > 1")
    pairs = common.written(candidates(spread, pieces("rows", CHUNK_ROWS), similarity, limit), "candidates")
    links = common.written(verified(pairs, docs, first, shingle, similarity), "links")
    labels = common.connected_components(links, COLLECTED)
    n_large = large.count()
    if n_large:
        crowd = spread.join(F.broadcast(large.select("shard")) if n_large <= 100_000 else large.select("shard"), "shard", "left_semi").drop("label")
        crowd = crowd.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        # Shards whose rows hang together by now have nothing left to compare.
        open_ = crowd.groupBy("shard").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("shard")
        crowd = common.written(crowd.join(open_, "shard", "left_semi"), "crowd")
        sets = sets_of(crowd.select("fp").distinct(), docs, first, shingle)
        more = common.written(links_apart(crowd.join(first.select("fp", "bands"), "fp").join(sets, "fp"), pieces("held", CHUNK_SHINGLES), similarity, limit).distinct(), "links")
        if not more.isEmpty():
            labels = common.connected_components(links.union(more), COLLECTED)
    return _named(fps.select("doc_id", "text_hash", "fp"), first.select("fp", "first_id"), labels)


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each group: that of the smallest doc_id, then of the smallest text hash; a null id comes last.

    Rows are known by doc_id and text, so two texts under one id are two rows, and stay both if they are not alike.
    Repeated rows leave one, whichever of them: they differ at most in columns that groups does not know.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")
    keep = groups.groupBy("label").agg(first).select(F.col("x.doc_id").alias("__keep_id"), F.col("x.text_hash").alias("__keep_hash"))
    known = docs.withColumn("__hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("__hash") == F.col("__keep_hash"))
    return known.join(keep, same, "left_semi").dropDuplicates(["doc_id", "__hash"]).drop("__hash")


common.ship(__name__)
