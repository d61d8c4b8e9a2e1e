"""Removal of long repeated byte strings, by building sorted suffixes of many texts column by column.

Every `length`-byte string that starts at more than one place of the collection is covered, and the bytes
it covers are removed from all its places; matches never cross documents.

Windows are dealt out first. A window's anchor is the least hashed 32-byte gram in it (leftmost, if equal),
so equal windows have equal anchors at equal offsets, and a run of windows with one anchor is a segment.
Each window is in one segment. Segments are grouped by their anchor's gram; only grams that occur more than
once can hold repeats, and equal segments collapse to one sequence with a multiplicity (whose common prefix
with itself is all of it).

In a group, sequences stand aligned at their anchors. Columns are taken from the last to the first: each
round inserts one symbol per sequence, updates the order of the sequences' suffixes (the Burrows-Wheeler
order of the collection at that column) by a stable sort on the inserted symbol, and the common prefixes of
neighbours by range minima over the previous round's. A suffix whose common prefix with a neighbour reaches
`length` starts a repeated window. As equal windows stand in the same column, suffixes of other columns need
not be merged in, and a round is a sequential pass over arrays of one entry per sequence. These arrays take
the place of the sequential files: a bin holds `bin_rows` sequences of at most 2 * length bytes, so they fit.
The whole construction, with all columns' suffixes in one order and files that every round reads and writes from end
to end, is in columns.py; it gives the same windows, and the README says what it costs.

A gram with more than `max_group` different sequences is not gathered: its windows are counted one by one by
their 128-bit hash instead, with partial counts before the shuffle, which is exact too.

Defined results: a null text is empty; texts shorter than `length` never change; repeated rows are documents of
their own, so their texts are removed whole (if long enough); a null doc_id is kept; other columns of the input
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32
#: Windows of a text that are cut at a time; only the memory of a task depends on it.
SPAN = 1 << 20
SEGMENTS = "array<struct<gram:long,hash:long,start:long,anchor:int,n:int>>"


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position, by doubling."""
    h, size, base = b.astype(np.uint64), 1, 0x100000001B3
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % 2**64, size * 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def segments(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """gram, hash, start, anchor offset and number of windows of a text's segments."""
    wide, found = length - GRAM + 1, []
    low = np.uint64((1 << 21) - 1)
    for at in range(0, len(text) - length + 1, SPAN):
        b = np.frombuffer(text, np.uint8, min(SPAN + length - 1, len(text) - at), at)
        h = gram_hashes(b)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        rows = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max)
        rows[: len(h)] = key
        rows = rows.reshape(-1, wide)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - wide + 1
        spot = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(spot)) + 1])
        count = np.diff(np.concatenate([first, [n]]))
        view, digest = memoryview(text), xxhash.xxh3_64_intdigest
        sums = [digest(view[at + s : at + s + c + length - 1]) for s, c in zip(first.tolist(), count.tolist(), strict=True)]
        found.append((h[spot[first]], np.array(sums, np.uint64), first + at, spot[first] - first, count))
    if not found:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def repeated_windows(groups: np.ndarray, texts: list[bytes], anchors: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each sequence a flag per window: whether it starts in another sequence of its group too, or has copies.

    groups: group numbers, ascending; anchors: where each sequence's anchor stands in it.
    """
    n, left = len(texts), int(anchors.max(initial=0))
    width = left + max((len(t) - int(a) for t, a in zip(texts, anchors.tolist(), strict=True)), default=0)
    symbols = np.full((width, n), 256, np.uint16)
    for i, (t, a) in enumerate(zip(texts, anchors.tolist(), strict=True)):
        symbols[left - a : left - a + len(t), i] = np.frombuffer(t, np.uint8)
    flags = np.zeros((width, n), bool)
    order, common_prefix = np.arange(n), np.zeros(n + 1, np.int32)
    base = groups.astype(np.int64) * 257
    for column in range(width - 1, -1, -1):
        key = base[order] + symbols[column, order]
        moved = np.argsort(key, kind="stable")
        key, order = key[moved], order[moved]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 257 != 256)) + 1
        new = np.zeros(n + 1, np.int32)
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = moved[same - 1] + 1, moved[same] + 1
            new[same] = 1 + np.minimum.reduceat(common_prefix, spans)[::2]
        common_prefix = new
        long = common_prefix >= length
        if long.any():
            flags[column, order[long[:n] | long[1:]]] = True
    out = []
    for i, (t, a) in enumerate(zip(texts, anchors.tolist(), strict=True)):
        windows = len(t) - length + 1
        out.append(np.ones(windows, bool) if copies[i] > 1 else flags[left - a : left - a + windows, i])
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


RUNS = "array<struct<first:int,last:int>>"


def _run_array(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in r] for r in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))


def remove_repeats(docs: DataFrame, length: int = 400, bin_rows: int = 16384, max_group: int = 16384) -> DataFrame:
    """doc_id, n_bytes, spans, kept_sha256, text for each row of docs (doc_id, text).

    spans are the maximal removed runs of bytes; text is what is left, whose bytes kept_sha256 is the hash of (a character
    that a run has cut shows as U+FFFD in text only).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A text is named by 128 bits of its hash in all that follows.
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("text"), "text")})

    def cut(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            parts = [segments(t, length) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5)]
            fields = [pa.array(c.astype(np.uint64).view(np.int64)) for c in cols[:2]] + [pa.array(cols[2], pa.int64())]
            fields += [pa.array(c.astype(np.int32)) for c in cols[3:]]
            segs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["gram", "hash", "start", "anchor", "n"]))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array([len(t) for t in texts], pa.int64()), segs], names=["k1", "k2", "n_bytes", "segs"])

    cut_rows = common.written(rows.mapInArrow(cut, f"k1 long, k2 long, n_bytes long, segs {SEGMENTS}"), "segments")
    texts = common.written(
        cut_rows.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.first("n_bytes").alias("n_bytes"), F.first("segs").alias("segs")), "texts"
    )
    common.drop_written(cut_rows)
    places = texts.select("k1", "k2", "m", F.explode("segs").alias("s")).select("k1", "k2", "m", "s.*")
    grams = places.groupBy("gram").agg(F.sum("m").alias("c"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("c > 1")
    # As a table of its own the join's two sides are plain exchanges, so a hot gram's rows can be split.
    grams = common.written(grams.select("gram", (F.col("lo") == F.col("hi")).alias("alike")), "grams")
    found = common.written(places.join(grams, "gram"), "places")

    sequences = found.where("not alike").groupBy("gram", "hash").agg(F.sum("m").alias("copies"), F.min(F.struct("k1", "k2", "start", "anchor", "n")).alias("at"))
    sequences = common.written(sequences.select("gram", "hash", "copies", "at.*"), "sequences")
    wanted = sequences.select("k1", "k2").distinct()
    one_each = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    held = common.written(one_each.join(wanted, ["k1", "k2"], "left_semi"), "held")

    # One row per text, with the sequences to cut from it; their number is bounded by the text's length.
    by_text = sequences.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "hash", "copies", "anchor", "start", "n")).alias("cuts"))

    def slice_out(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 32):
                out = []
                for cuts, text in zip(*(c.to_pylist() for c in whole.slice(k, 32).columns), strict=True):
                    data = text.encode()
                    out += [(c["gram"], c["hash"], c["copies"], c["anchor"], data[c["start"] : c["start"] + c["n"] + length - 1]) for c in cuts]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["gram", "hash", "copies", "anchor", "bytes"])

    cuts = by_text.join(held, ["k1", "k2"]).select("cuts", "text")
    spelled = cuts.mapInArrow(slice_out, "gram long, hash long, copies long, anchor int, bytes binary")
    # Of n sequences n / max_group grams at most are crowded.
    large = common.written(sequences.groupBy("gram").count().where(F.col("count") > max_group).select("gram", F.lit(True).alias("crowded")), "crowded")
    n_large = large.count()
    if n_large:
        spelled = spelled.join(F.broadcast(large) if n_large <= 100_000 else large, "gram", "left")
    else:
        spelled = spelled.withColumn("crowded", F.lit(None).cast("boolean"))
    spelled = common.written(spelled, "spelled")

    def build(batches):
        def solve(b: pa.Table) -> pa.RecordBatch:
            gram = b.column("gram").to_numpy()
            flags = repeated_windows(
                np.cumsum(np.concatenate([[0], np.diff(gram) != 0])), b.column("bytes").to_pylist(), b.column("anchor").to_numpy(), b.column("copies").to_numpy(), length
            )
            got = [runs(f) for f in flags]
            keep = np.array([i for i, r in enumerate(got) if r], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(gram[keep]), pa.array(b.column("hash").to_numpy()[keep]), _run_array([got[i] for i in keep])], names=["gram", "hash", "runs"]
            )

        for t in common.whole_groups(batches, "gram", bin_rows):
            yield solve(t)

    ordered = spelled.where("crowded is null").select("gram", "hash", "copies", "anchor", "bytes").repartition("gram").sortWithinPartitions("gram")
    small = ordered.mapInArrow(build, f"gram long, hash long, runs {RUNS}")

    def windows(batches):
        for b in batches:
            for gram, sum_, copies, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w = [xxhash.xxh3_128_intdigest(text[i : i + length]) for i in range(len(text) - length + 1)]
                k = len(w)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([gram] * k, pa.int64()), pa.array([sum_] * k, pa.int64()), pa.array([copies] * k, pa.int64()), pa.array(range(k), pa.int32()),
                        pa.array([x.to_bytes(16, "big") for x in w], pa.binary()),
                    ],
                    names=["gram", "hash", "copies", "i", "w"],
                )

    each = spelled.where("crowded").select("gram", "hash", "copies", "bytes").mapInArrow(windows, "gram long, hash long, copies long, i int, w binary")
    often = each.groupBy("w").agg(F.sum("copies").alias("c")).where("c > 1").select("w")
    crowded = each.join(often, "w").groupBy("gram", "hash").agg(F.collect_list(F.struct(F.col("i").alias("first"), F.col("i").alias("last"))).alias("runs"))

    own = found.where("m = 1")
    whole = own.where("alike").select("k1", "k2", "start", F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))).alias("runs"))
    partly = own.where("not alike").join(small.union(crowded), ["gram", "hash"]).select("k1", "k2", "start", "runs")
    removed = (
        whole.union(partly)
        .select("k1", "k2", "start", F.explode("runs").alias("r"))
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct((F.col("start") + F.col("r.first")).alias("a"), (F.col("start") + F.col("r.last") + length).alias("b"))).alias("spans"))
    )
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")))
    copied = texts.where((F.col("m") > 1) & (F.col("n_bytes") >= length)).select("k1", "k2", all_of_it.alias("spans"))
    removed = common.written(removed.unionByName(copied), "spans")

    def strike(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                b, out = whole.slice(k, 64), []
                for spans, text in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    runs_, end = [], -1
                    for a, z in sorted((s["a"], s["b"]) for s in spans or ()):
                        if a > end:
                            runs_.append([a, z])
                        end = runs_[-1][1] = max(end, z)
                    edges = [0, *(x for r in runs_ for x in r), len(text)]
                    rest = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if runs_ else text
                    out.append((len(text), [{"start": a, "end": z} for a, z in runs_], hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "spans", "kept_sha256", "text"])

    both = rows.join(removed, ["k1", "k2"], "left").select("doc_id", "spans", "text")
    return both.mapInArrow(strike, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, text string")


common.ship(__name__)
