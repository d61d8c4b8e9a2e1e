"""Passages: lines to paragraphs and sections, chunk records with offsets, long-text splitting, health figures."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import stem

#: Headings that count as such in any type size.
KNOWN_HEADERS = [
    "abstract", "introduction", "background", "related work", "method", "methods", "methodology", "approach", "model",
    "architecture", "experiments", "experimental setup", "results", "evaluation", "discussion", "analysis", "ablation",
    "ablation study", "conclusion", "conclusions", "future work", "references", "appendix", "acknowledgements", "acknowledgments",
]
HEADER_RATIO, HEADER_CHARS = 1.15, 80
#: The preprint stamp, captions, numbered headings, and the end of a sentence.
ARXIV_STAMP = r"(?i)^\s*arxiv:\s*\d"
CAPTION = r"(?i)^\s*(table|figure|fig\.?|algorithm|listing)\s*\d+"
NUMBERED = r"^\s*(\d+(\.\d+)*|[IVXLC]+)\.?\s*[A-Z][A-Za-z]"
#: Fixed value: a word that a line break has cut.
HYPHEN_BREAK = r"[a-z]-\n[a-z]"
SENTENCE_END = r"[.!?:;]['\")\]]?\s*$"


def is_header(text="text", size="size", bold="bold", body="body"):
    t = F.col(text)
    known = F.lower(F.regexp_replace(F.trim(t), r"\.+$", "")).isin(*KNOWN_HEADERS)
    numbered = F.col(bold) & t.rlike(NUMBERED) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 10)
    refused = (F.length(t) > HEADER_CHARS) | t.rlike(ARXIV_STAMP) | t.rlike(CAPTION)
    return F.when(refused, False).otherwise((F.col(size) > F.col(body) * HEADER_RATIO) | known | numbered)


def caption(text: Column) -> Column:
    """The first caption mark in a text, like "Table 2:"; empty if there is none."""
    return F.regexp_extract(text, r"(?i)(?:table|figure|fig\.?|algorithm|listing)\s*\d+[.:]?", 0)


def body_size(lines: DataFrame) -> DataFrame:
    """paper, body: the commonest type size to one decimal; of equals the one that comes first."""
    counts = lines.groupBy("paper", F.bround("size", 1).alias("s")).agg(F.count("*").alias("n"), F.min(F.struct("page_no", "line_no")).alias("first"))
    order = Window.partitionBy("paper").orderBy(F.desc("n"), "first")
    return counts.withColumn("k", F.row_number().over(order)).where("k = 1").select("paper", F.col("s").alias("body"))


def section_lines(lines: DataFrame) -> DataFrame:
    """paper, section_no, section, pages, lines (array, in order): every header opens a section; what is before is the front matter.

    A paper with fewer than two sections with text has one per page instead.
    """
    order = Window.partitionBy("paper").orderBy("page_no", "line_no")
    marked = lines.join(body_size(lines), "paper").withColumn("head", is_header())
    numbered = marked.withColumn("section_no", F.sum(F.col("head").cast("int")).over(order))
    entry = F.struct("page_no", "line_no", "head", "text")
    grouped = lambda df, *keys: df.groupBy("paper", *keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    texts = lambda rows: F.transform(rows, lambda x: x["text"])
    pages = F.array_sort(F.array_distinct(F.transform("e", lambda x: x["page_no"])))
    head = F.element_at(F.filter("e", lambda x: x["head"]), 1)
    name = F.when(F.size(F.filter("e", lambda x: x["head"])) > 0, F.trim(head["text"])).otherwise("Front matter")
    by_head = grouped(numbered, "section_no").select("paper", "section_no", name.alias("section"), pages.alias("pages"), texts(F.filter("e", lambda x: ~x["head"])).alias("lines"))
    counted = by_head.where(F.size("lines") > 0).withColumn("n", F.count("*").over(Window.partitionBy("paper")))
    kept = counted.where("n >= 2").drop("n")
    unsplit = marked.join(kept.select("paper").distinct(), "paper", "left_anti").withColumn("section_no", F.col("page_no").cast("long"))
    by_page = grouped(unsplit, "section_no").select("paper", "section_no", F.concat(F.lit("Page "), F.col("section_no").cast("string")).alias("section"), pages.alias("pages"), texts(F.col("e")).alias("lines"))
    return kept.unionByName(by_page)


def sections(lines: DataFrame) -> DataFrame:
    """paper, section_no, section, n_lines, text of section_lines."""
    return section_lines(lines).select("paper", "section_no", "section", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def titles(lines: DataFrame, chars: int = 200, slack: float = 0.5) -> DataFrame:
    """paper, title: the largest lines of the first page, without the arXiv stamp; its first line if none is larger than the body."""
    first = lines.withColumn("first_page", F.min("page_no").over(Window.partitionBy("paper"))).where((F.col("page_no") == F.col("first_page")) & ~F.col("text").rlike(ARXIV_STAMP))
    top = first.join(body_size(lines), "paper").withColumn("top", F.max("size").over(Window.partitionBy("paper")))
    rows = top.groupBy("paper", "top", "body").agg(F.array_sort(F.collect_list(F.struct("line_no", "size", "text"))).alias("l"))
    large = F.array_join(F.transform(F.filter("l", lambda x: x["size"] >= F.col("top") - slack), lambda x: x["text"]), " ")
    joined = F.regexp_replace(F.substring(F.trim(large), 1, chars), r"([\p{L}\p{N}_])- ([\p{L}\p{N}_])", "$1$2")
    return rows.select("paper", F.when(F.col("top") <= F.col("body"), F.element_at("l", 1)["text"]).otherwise(joined).alias("title"))


#: Signs that stand in equations, and words that stand in sentences.
MATH_CHARS = "∑∏∫∂∇√±≤≥≈≠∈∀∃⊤⊆∪∩·×→←↦⟨⟩αβγδεθλμσφψωΓΔΘΛΣΦΨΩ^_{}"
STOP_WORDS = ["the", "a", "an", "of", "to", "in", "is", "are", "we", "that", "for", "and", "with", "as", "on", "by", "this", "it", "be", "from", "which"]
OPERATORS = "=+-/*<>^_"
MATH_SHARE, OPERATOR_SHARE, MATH_CHARS_MOST = 0.05, 0.15, 200


def is_mathy(line: Column) -> Column:
    """Whether a line is an equation: no sentence words, and many maths signs, or many operators and digits."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    n = F.length(t)
    words = F.split(t, r"\s+")
    bare = lambda w: F.regexp_replace(w, r"^[.,()]+|[.,()]+$", "")
    real = F.size(F.filter(words, lambda w: (F.length(w) >= 3) & bare(w).rlike(r"^\p{L}+$")))
    stops = F.size(F.filter(words, lambda w: F.lower(bare(w)).isin(*STOP_WORDS)))
    share = lambda signs: (n - F.length(F.regexp_replace(t, f"[{signs}]", ""))) / n
    signs = share(re.escape(MATH_CHARS))
    dense = share(re.escape(OPERATORS) + r"\p{Nd}⁰¹²³⁴-⁹₀-₉")
    sentence = (real >= 3) | (stops >= 2)
    fine = F.when((n == 0) | (n > MATH_CHARS_MOST) | sentence, False).when(signs > MATH_SHARE, True).when(real > 1, False).otherwise(dense > OPERATOR_SHARE)
    return F.coalesce(fine, F.lit(False))


def spliced(lines: DataFrame) -> DataFrame:
    """key, line_no, text: a line that ends in a letter and a hyphen joins a next line that starts in lower case."""
    order = Window.partitionBy("key").orderBy("pos")
    glued = F.lag("text").over(order).rlike(r"\p{L}-$") & F.col("text").rlike(r"^\p{Ll}")
    part = lines.withColumn("new", F.when(F.coalesce(glued, F.lit(False)), 0).otherwise(1)).withColumn("line_no", F.sum("new").over(order))
    last = F.max("pos").over(Window.partitionBy("key", "line_no"))
    piece = F.when(F.col("pos") < last, F.regexp_replace("text", "-$", "")).otherwise(F.col("text"))
    rows = part.withColumn("piece", piece).groupBy("key", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return rows.select("key", "line_no", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """key, para_no, text from (key, line_no, text): a new one where a sentence ended and the next line starts in upper case."""
    order = Window.partitionBy("key").orderBy("line_no")
    opened = F.lag("text").over(order).rlike(SENTENCE_END) & F.col("text").rlike(r"^\p{Lu}")
    part = lines.withColumn("para_no", F.sum(F.when(F.coalesce(opened, F.lit(False)), 1).otherwise(0)).over(order))
    rows = part.groupBy("key", "para_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("p"))
    return rows.select("key", "para_no", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def chunk_records(bodies: DataFrame, prefix: Column | None = None, width: int = 4096) -> DataFrame:
    """source, chunk_index, id, prev_id, next_id, doc_start, doc_end for bodies (source, seq, text); seq is a whole number.

    A body's offset is the sum of len + 2 over the source's earlier bodies. Both running numbers are summed in two
    levels, over ranges of `width` numbers and within each, so that a source of any size is dealt over many tasks.
    An id is the prefix (the source, if none is given), "-chunk-", and the index.
    """
    own = bodies.withColumn("_range", F.floor(F.col("seq") / width))
    size = F.coalesce(F.length("text"), F.lit(0)) + 2
    ranges = own.groupBy(F.col("source").alias("_s"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"), F.sum(size).alias("_size"))
    each = Window.partitionBy("_s")
    before = each.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_s", "_r", F.sum("_n").over(each).alias("_all"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_size")])
    within = Window.partitionBy("source", "_range").orderBy("seq")
    named = own.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & F.col("_range").eqNullSafe(F.col("_r")))
    named = named.withColumns({
        "chunk_index": (F.col("_n") + F.row_number().over(within) - 1).cast("int"),
        "doc_start": (F.col("_size") + F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"),
    })
    called = lambda index: F.concat_ws("-chunk-", F.col("source") if prefix is None else prefix, index.cast("string"))
    at = F.col("chunk_index")
    return named.withColumns({
        "id": called(at),
        "prev_id": F.when(at > 0, called(at - 1)),
        "next_id": F.when(at + 1 < F.col("_all"), called(at + 1)),
        "doc_end": F.col("doc_start") + F.length("text"),
    }).drop("_range", "_s", "_r", "_all", "_n", "_size")


def split_long(limit: int):
    """An Arrow function string -> array<string>: pieces of up to limit characters at paragraph breaks, hard cuts if need be.

    What is cut hard stays by itself; the rest is packed as long as it fits.
    """
    def cut(text: str) -> list[str]:
        if len(text) <= limit:
            return [text]
        out: list[list[str]] = [[]]
        for para in text.split("\n\n"):
            held = "\n\n".join(out[-1])
            if held and len(held) + len(para) + 2 > limit:
                out.append([])
            if len(para) > limit:
                out[-1:] = [*out[-1:], *([para[i : i + limit]] for i in range(0, len(para), limit)), []]
            elif para or held:
                out[-1].append(para)
        pieces = ("\n\n".join(p).strip() for p in out)
        return [p for p in pieces if p]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return run


#: Where a passage may be cut, best first.
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", " ", ""]


def overlapped(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of up to size characters that share up to overlap characters with the piece before.

    The text is cut after each best separator that it has; parts of size characters or more are cut again at the next
    ones; runs of short parts are packed. As separators stay, every piece is a slice of the text.
    """
    out: list[str] = []

    def pack(cuts: list[int]) -> None:
        first = 0
        for k in range(1, len(cuts) - 1):
            end, coming = cuts[k], cuts[k + 1]
            if coming - cuts[first] > size:
                out.append(text[cuts[first] : end])
                while first < k and (end - cuts[first] > overlap or coming - cuts[first] > size):
                    first += 1
        out.append(text[cuts[first] : cuts[-1]])

    def cut(lo: int, hi: int, level: int) -> None:
        while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) < 0:
            level += 1
        sep = SEPARATORS[level]
        ends = [m.end() + lo for m in re.finditer(re.escape(sep), text[lo:hi])] if sep else list(range(lo + 1, hi))
        run = [lo]
        for a, b in itertools.pairwise(dict.fromkeys([lo, *ends, hi])):
            if b - a < size or not sep:
                run.append(b)
                continue
            if len(run) > 1:
                pack(run)
            cut(a, b, level + 1)
            run = [b]
        if len(run) > 1:
            pack(run)

    cut(0, len(text), 0)
    return [p.strip() for p in out if p.strip()]


def overlapping(size: int = 1200, overlap: int = 150):
    """An Arrow function string -> array<string>, as overlapped(); null gives no piece."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: overlapped(t, size, overlap) if t else [])

    return run


def health(chunks: DataFrame) -> DataFrame:
    """One row of figures over chunks (source, text, content_type): hyphen_breaks counts places, not chunks; mid_sentence looks behind the header."""
    n = F.length("text")
    flag = lambda c: F.count(F.when(c, 1))
    cut = F.locate("\n\n", F.col("text"))
    body = F.regexp_replace(F.when(cut > 0, F.substring("text", cut + 2, n)).otherwise(F.col("text")), r"(?U)^\s+", "")
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct(stem(F.col("source"))).alias("n_papers"),
        F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(HYPHEN_BREAK), F.lit(0)))), F.lit(0)).alias("hyphen_breaks"),
        flag(F.col("content_type") == "reference").alias("reference_chunks"),
        flag(body.rlike(r"^\p{Ll}")).alias("mid_sentence"),
        flag(n < 120).alias("orphans"),
        F.coalesce(F.bround(F.avg(n)), F.lit(0)).cast("long").alias("mean_size"),
        F.coalesce(F.bround(F.median(n)), F.lit(0)).cast("long").alias("median_size"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_size"),
    )
