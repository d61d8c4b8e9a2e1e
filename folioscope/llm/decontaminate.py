"""Benchmark decontamination by template canonicalisation.

Words (runs without white space, outer punctuation stripped, lower-cased) become a template: numbers, names
(runs of capitalised words inside a sentence) and units turn into typed placeholders. Windows of `anchor` template words
of the benchmark's items meet those of the documents in a hash join; an item's first word is left out, since only its
place in a sentence tells a name. Windows of one document and item at one shift form an alignment, and alignments whose
shifts are no more than `gap` apart form a chain, so that inserted, dropped or changed words only cost the windows over
them. A chain counts if its windows cover at least `share` of the item's words, or if `window` words on end agree word
for word, values included; and if its slots are consistent: names and units one to one, and of the numbers more than
`steady` have the commonest document value of their benchmark value (different numbers may become equal). So a question
with other names and numbers is caught, and `verbatim` says whether all slots agree.

All of it is built-in expressions. The benchmark's windows are broadcast if there are at most `max_broadcast` of them,
else joined by shuffle; the same goes for the rows that the slots are checked on. Items with equal templates and slots
are compared once, under the least item_id, and their ids joined again at the end.

Defined results: null and empty texts match nothing; an item of fewer than 2 * `anchor` + 1 words is matched by
windows of `least` words. One of `least` words or fewer says too little for a template: it is found where all its words
stand in a row as they are (but for case and outer punctuation), and one of one or two words only where a document
consists of nothing else; an item without words is never found. Repeated rows of a document give one row
per item; rows are keyed by doc_id and text, so a null doc_id is a document too; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pii import let

#: Words taken as units of measure.
UNITS = (
    "mm cm m km kilometers kilometer meters meter metres metre miles mile feet foot inches inch yards yard "
    "mg g kg grams gram kilograms kilogram pounds pound lbs ounces ounce tons tonnes "
    "ml l liters liter litres litre gallons gallon "
    "seconds second minutes minute hours hour days day weeks week months month years year "
    "dollars dollar euros euro cents cent usd eur percent degrees degree celsius fahrenheit mph kmh"
).split()
PUNCTUATION = ".,;:!?()[]{}\"'`*#%&$€£+-–—…«»“”‘’|"


#: The blank between two capitalised words of which the first is inside a sentence.
RUN = r"\s(?=\p{Lu})(?<=[^\s.!?:\"]\s\p{Lu}[\p{L}\p{N}'’-]{0,40}\s)"


def joined(text: Column) -> Column:
    """text with each run of name words as one word."""
    return F.regexp_replace(text, RUN, "_")


def words(text: Column) -> Column:
    return F.split(joined(text), r"\s+")


def plain_words(text: Column) -> Column:
    """The lower-cased words without outer punctuation; those of nothing else are left out."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION)))), lambda w: w != "")


def slots(text: Column) -> Column:
    """For each word a struct: t, its template word, and v, its value if that is a placeholder (else empty)."""

    def one(raw: Column, w: Column, i: Column) -> Column:
        bare = F.btrim(w, F.lit(PUNCTUATION))
        low, head = F.lower(bare), F.substring(bare, 1, 1)
        before = F.substring(F.coalesce(F.get(raw, i - 1), F.lit("")), -1, 1)
        inside = ~before.isin("", ".", "!", "?", ":", '"')
        kind = F.when(head.between("0", "9"), "<num>").when((low != bare) & inside & (head != F.lower(head)), "<name>").when(low.isin(*UNITS), "<unit>")
        return F.struct(F.coalesce(kind, low).alias("t"), F.when(kind.isNotNull(), low).otherwise("").alias("v"))

    return let(words(text), lambda raw: F.transform(raw, lambda w, i: one(raw, w, i)))


OUTER = "[" + "".join("\\" + c if c in "[]-^\\" else c for c in PUNCTUATION) + "]"
#: Capitalised words that the end of no sentence precedes, run by run as joined() has them, and what parts words.
NAME = r"(?=\p{Lu})(?<=[^\s.!?:\"]\s)(?:\p{Lu}[\p{L}\p{N}'’-]{0,40}\s(?=\p{Lu}))*+\p{Lu}\S*"
BETWEEN = rf"{OUTER}*\s+{OUTER}*"


def template(text: Column) -> Column:
    """The hashes of a text's template words; their positions are those of words()."""
    shaped = F.lower(F.regexp_replace(text, NAME, "<name>"))
    one = lambda w: (
        F.when((w >= "0") & (w < ":"), F.lit(1).cast("long")).when(w.isin(*UNITS), F.lit(2).cast("long")).otherwise(F.xxhash64(w))
    )
    return F.transform(F.split(F.btrim(shaped, F.lit(PUNCTUATION)), BETWEEN), one)


def windows(hashes: Column, size: int) -> Column:
    """The hashes of all windows of a size over word hashes (null for fewer words).

    Spans double: a span's hash is that of two halves, and the last step lets the halves overlap.
    """

    def grown(h: Column, span: int) -> Column:
        if span == size:
            return h
        step = min(span, size - span)
        # The inner transform reads h at two places; let() has it computed once.
        return let(h, lambda g: grown(F.transform(g, lambda x, i: F.xxhash64(x, F.get(g, i + step))), span + step))

    return let(hashes, lambda h: F.when(F.size(h) >= size, F.slice(grown(h, 1), F.lit(1), F.size(h) - size + 1)))


def longest(ats: Column) -> Column:
    """The most consecutive numbers in a sorted array."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(x: Column, at: Column) -> Column:
        n = F.when(at == x["last"] + 1, x["n"] + 1).otherwise(1)
        return F.struct(at.alias("last"), n.alias("n"), F.greatest(x["best"], n).alias("best"))

    return F.aggregate(ats, start, step, lambda x: x["best"])


FOUND = "doc_id long, text_hash long, item_id long, shift int, n_windows long, share double, verbatim boolean"


def short_leaks(named: DataFrame, items: DataFrame, max_broadcast: int) -> DataFrame:
    """The rows of leaks() for items (item_id, words) of a few words in documents (doc_id, text_hash, text)."""
    sizes = sorted(r["n"] for r in items.select(F.size("words").alias("n")).distinct().collect())  # as many as there are lengths
    keyed = items.select("item_id", F.size("words").alias("size"), F.array_join("words", " ").alias("all"))
    wanted = keyed.select("size", "all").distinct()
    at = lambda w, i, size: F.array_join(F.slice(w, i + 1, size), " ")
    starts = lambda w, size: F.when((F.size(w) == size) | (F.lit(size > 2) & (F.size(w) > size)), F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    spelled = lambda w, size: F.transform(starts(w, size), lambda i: F.struct(F.lit(size).alias("size"), i.alias("shift"), at(w, i, size).alias("all")))
    every = let(plain_words(F.col("text")), lambda w: F.flatten(F.array(*[spelled(w, size) for size in sizes])))
    spots = named.select("doc_id", "text_hash", F.explode(every).alias("x")).select("doc_id", "text_hash", "x.*")
    met = spots.join(F.broadcast(wanted) if wanted.count() <= max_broadcast else wanted, ["size", "all"])
    found = met.groupBy("doc_id", "text_hash", "all").agg(F.min("shift").alias("shift")).join(keyed.select("all", "item_id"), "all")
    return found.select("doc_id", "text_hash", "item_id", "shift", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("share"), F.lit(True).alias("verbatim"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    least: int = 5,
    share: float = 0.5,
    max_broadcast: int = 500_000,
    anchor: int = 7,
    gap: int = 13,
    steady: float = 0.67,
) -> DataFrame:
    """doc_id, text_hash, item_id, shift, n_windows, share, verbatim for each document and item with a chain that counts.

    shift is the chain's first, n_windows its number of different item windows, share the part of the item's words they cover.
    """
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    told = known.select("item_id", slots(F.col("text")).alias("s"), template(F.col("text")).alias("hashes"), plain_words(F.col("text")).alias("words"))
    told = told.withColumns({"few": F.size("s") <= least, "k1": F.xxhash64("s", "hashes"), "k2": F.xxhash64(F.lit("template"), "s", "hashes")})
    items = (
        told.where(~F.col("few"))
        .groupBy("k1", "k2")
        .agg(F.min("item_id").alias("item"), F.first("s").alias("s"), F.first("hashes").alias("hashes"))
        .withColumn("n", F.size("s") - 1)
        .withColumn("size", F.when(F.col("n") >= 2 * anchor, anchor).otherwise(least))
    )
    members = told.where(~F.col("few")).select("k1", "k2", "item_id").join(items.select("k1", "k2", "item"), ["k1", "k2"]).select("item", "item_id")
    items = items.drop("k1", "k2")
    short = told.where(F.col("few") & (F.size("words") > 0)).select("item_id", "words")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # two values at most
    spark = docs.sparkSession
    few = None if short.isEmpty() else short_leaks(named, short, max_broadcast)
    if not sizes:
        return few if few is not None else spark.createDataFrame([], FOUND)
    rest = F.slice("hashes", F.lit(2), F.col("n"))
    of_item = None
    for size in sizes:
        part = items.where(F.col("size") == size).select("item", F.lit(size).alias("size"), F.posexplode(windows(rest, size)).alias("at", "h"))
        of_item = part if of_item is None else of_item.union(part)
    n_windows = of_item.count()
    limited = lambda df, n: F.broadcast(df) if n <= max_broadcast else df

    shaped = named.select("doc_id", "text_hash", template(F.col("text")).alias("t"))
    # One row per window, whatever its size, so that the template is made once.
    sized = lambda t, size: F.coalesce(F.transform(windows(t, size), lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("pos"), h.alias("h"))), F.array())
    every = let(F.col("t"), lambda t: F.flatten(F.array(*[sized(t, size) for size in sizes])))
    hits = shaped.select("doc_id", "text_hash", F.explode(every).alias("w")).select("doc_id", "text_hash", "w.*")
    shifts = (
        hits.join(limited(of_item, n_windows), ["h", "size"])
        .groupBy("doc_id", "text_hash", "item", "size", (F.col("pos") - F.col("at") - 1).alias("shift"))
        .agg(F.sort_array(F.collect_set("at")).alias("ats"))
    )
    by_shift = Window.partitionBy("doc_id", "text_hash", "item").orderBy("shift")
    far = F.coalesce(F.col("shift") - F.lag("shift").over(by_shift) > gap, F.lit(True))
    covered = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda at: F.sequence(at, at + F.col("size") - 1))))
    # Per shift, the places of the item's words and of the document's (those of words(), from 0).
    spots = F.transform("parts", lambda x: F.transform(covered(x["ats"]), lambda k: F.struct((k + 1).alias("i"), (k + 1 + x["shift"]).alias("j"))))
    run = F.array_max(F.transform("parts", lambda x: longest(x["ats"]))) + F.col("size") - 1
    aligned = (
        shifts.withColumn("far", far.cast("int"))
        .withColumn("chain", F.sum("far").over(by_shift))
        .groupBy("doc_id", "text_hash", "item", "size", "chain")
        .agg(F.sort_array(F.collect_list(F.struct("shift", "ats"))).alias("parts"))
        .withColumn("ats", F.array_distinct(F.flatten(F.col("parts.ats"))))
        .join(F.broadcast(items.drop("size")) if n_windows <= max_broadcast else items.drop("size"), "item")
        .withColumn("share", F.size(covered(F.col("ats"))) / F.col("n"))
        .where((F.col("share") >= share) | (run >= window))
        .select("doc_id", "text_hash", "item", F.element_at("parts.shift", 1).alias("shift"), F.size("ats").cast("long").alias("n_windows"), "share", "s", spots.alias("spots"))
    )
    aligned = common.written(aligned, "aligned")
    keys = aligned.select("doc_id", "text_hash").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    matched = named.alias("d").join(limited(keys, keys.count()).alias("k"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    held = matched.select("doc_id", "text_hash", slots(F.col("text")).alias("ds"))
    same = F.col("a.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("a.text_hash") == F.col("d.text_hash"))
    both = aligned.alias("a").join(held.alias("d"), same).select("a.*", "d.ds")
    at = lambda spot: F.struct(F.get("s", spot["i"]).alias("b"), F.get("ds", spot["j"]).alias("d"), spot["i"].alias("i"))
    both = both.withColumn("met", F.transform("spots", lambda part: F.transform(part, at)))
    slot = lambda x: F.struct(x["b"]["t"].alias("t"), x["b"]["v"].alias("b"), x["d"]["v"].alias("d"))
    both = both.withColumn("pairs", F.filter(F.transform(F.flatten("met"), slot), lambda p: (p["b"] != "") & (p["d"] != "")))
    agree = F.transform("met", lambda part: F.array_sort(F.transform(F.filter(part, lambda x: x["b"]["v"] == x["d"]["v"]), lambda x: x["i"])))
    both = both.withColumn("strict", F.filter("pairs", lambda p: p["t"] != "<num>")).withColumn("numbers", F.filter("pairs", lambda p: p["t"] == "<num>"))
    side = lambda name: F.size(F.array_distinct(F.transform("strict", lambda p: F.struct(p["t"], p[name]))))
    one_to_one = (F.size(F.array_distinct("strict")) == side("b")) & (side("b") == side("d"))
    often = lambda p: F.size(F.filter("numbers", lambda q: q == p))
    commonest = F.transform(
        F.array_distinct(F.transform("numbers", lambda p: p["b"])),
        lambda b: F.array_max(F.transform(F.filter("numbers", lambda p: p["b"] == b), often)),
    )
    held = F.aggregate(commonest, F.lit(0), lambda x, n: x + n)
    quoted = F.array_max(F.transform(agree, longest)) >= window
    consistent = one_to_one & (held >= steady * F.size("numbers"))
    checked = both.where(quoted | ((F.col("share") >= share) & consistent))
    best = F.max_by(F.struct("shift", "n_windows", "share", F.forall("pairs", lambda p: p["b"] == p["d"]).alias("verbatim")), F.struct("n_windows", -F.col("shift")))
    found = (
        checked.groupBy("doc_id", "text_hash", "item")
        .agg(best.alias("x"))
        .join(members, "item")
        .select("doc_id", "text_hash", "item_id", "x.*")
    )
    return found if few is None else found.unionByName(few)


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that leaks() did not find."""
    bad = found.select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_hash")), "left_anti")
