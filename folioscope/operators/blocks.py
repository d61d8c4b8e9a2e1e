"""Typed blocks: a section's lines as prose, maths, references and captioned units; sections in parts; chunks of blocks."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import passages

PROSE, MATH, REFERENCE = "prose", "math", "reference"
#: Fixed value: the headings behind which there is nothing to answer from.
REFERENCE_SECTION = r"(?i)^\s*(references?|bibliography|acknowledge?ments?)\b"
#: Sizes in characters, but the maths run's, in lines.
SECTION_MOST, UNIT_MOST, BLOCK_LEAST, RESUMING_LEAST, MATH_RUN_LEAST = 4000, 3000, 200, 100, 3
BLOCKS = "array<struct<content_type:string,text:string>>"


def joined_words(lines: list[str]) -> list[str]:
    """Lines with words that a line end broke joined again."""
    whole = re.sub(r"(\w)-\n(?=(\w))", lambda m: m[1] if m[1].isalpha() and m[2].islower() else m[0], "\n".join(lines))
    return whole.split("\n") if whole else []


def reflowed(lines: list[str]) -> str:
    """Paragraphs, an empty line between them: a new one where a sentence ended and a line starts in upper case."""
    rows = joined_words(lines)
    opened = [i for i in range(1, len(rows)) if re.search(passages.SENTENCE_END, rows[i - 1]) and rows[i][0].isupper()]
    return "\n\n".join(" ".join(rows[a:b]) for a, b in itertools.pairwise([0, *opened, len(rows)]))


def runs_of(lines: list[str], mathy: list[bool]) -> list[tuple[str, list[str]]]:
    """(kind, lines) in the order of the blocks. A caption's unit ends at a long line that ends a sentence, or beyond UNIT_MOST.

    Maths runs of under MATH_RUN_LEAST lines become a line of the prose around them; one right before a caption opens the
    prose that follows the unit, if any does.
    """
    runs: list[tuple[str, list[str]]] = []
    for line, equation in zip(lines, mathy, strict=True):
        kind = runs[-1][0] if runs else ""
        caption = re.match(passages.CAPTION, line)
        if caption:
            word = caption[1].lower()
            runs.append(("figure" if word.startswith("fig") else word, [line]))
        elif kind not in ("", PROSE, MATH):
            ended = len(line) > RESUMING_LEAST and re.search(passages.SENTENCE_END, line)
            if ended or sum(map(len, runs[-1][1])) > UNIT_MOST:
                runs.append((PROSE, [line]))
            else:
                runs[-1][1].append(line)
        elif kind == (MATH if equation else PROSE):
            runs[-1][1].append(line)
        else:
            runs.append((MATH if equation else PROSE, [line]))

    out: list[tuple[str, list[str]]] = []
    late: list[str] = []
    for i, (kind, rows) in enumerate(runs):
        after = [k for k, _ in runs[i + 1 : i + 3]]
        if kind == MATH and len(rows) < MATH_RUN_LEAST:
            kind, rows = PROSE, [" ".join(rows)]
            if after and after[0] not in (PROSE, MATH):
                if after[1:] == [PROSE]:
                    late = rows
                else:
                    out.append((PROSE, rows))
                continue
        if kind == PROSE:
            rows, late = late + rows, []
            # A captioned unit, or a long maths run, ends the prose before it.
            if out and out[-1][0] == PROSE and i and runs[i - 1][0] in (PROSE, MATH):
                out[-1][1].extend(rows)
                continue
        out.append((kind, list(rows)))
    return out


def typed(lines: list[str], mathy: list[bool], reference: bool) -> list[dict]:
    rows = [(t.strip(), m) for t, m in zip(lines, mathy, strict=True) if t and t.strip()]
    texts = [t for t, _ in rows]
    if reference:
        return [{"content_type": REFERENCE, "text": reflowed(texts)}] if texts else []
    render = {PROSE: reflowed, MATH: " ".join}
    unit = lambda x: "\n".join(joined_words(x))[:UNIT_MOST]
    out: list[dict] = []
    for kind, run in runs_of(texts, [m for _, m in rows]):
        text = render.get(kind, unit)(run)
        before = out[-1]["content_type"] if out else ""
        if kind in render and before in (PROSE, kind) and len(text) < BLOCK_LEAST:
            out[-1]["text"] += "\n\n" + text
        else:
            out.append({"content_type": kind, "text": text})
    return [b for b in out if b["text"].strip()]


def build(lines: Column, reference: Column) -> Column:
    """The blocks of a section's lines (array of strings), small ones joined to the one before; references are one block."""

    @F.pandas_udf(BLOCKS)
    def run(texts: pd.Series, mathy: pd.Series, is_reference: pd.Series) -> pd.Series:
        return pd.Series([typed(list(t), list(m), bool(r)) if t is not None else [] for t, m, r in zip(texts, mathy, is_reference, strict=True)])

    return run(lines, F.transform(lines, passages.is_mathy), reference)


def parse(lines: DataFrame) -> DataFrame:
    """paper, paper_title, section_no, part, section, text, pages, blocks of lines (paper, page_no, line_no, text, size, bold).

    Sections of over SECTION_MOST characters go in numbered parts, the blocks dealt to them in equal numbers.
    """
    cut = passages.section_lines(lines).withColumn("blocks", build(F.col("lines"), F.col("section").rlike(REFERENCE_SECTION)))
    whole = cut.withColumn("whole", F.trim(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"))).where("whole <> ''")
    parted = whole.withColumn("parts", passages.split_long(SECTION_MOST)("whole")).select("*", F.posexplode("parts").alias("part", "text"))
    each = F.greatest(F.lit(1), F.ceil(F.size("blocks") / F.size("parts"))).cast("int")
    long = F.length("whole") > SECTION_MOST
    name = F.when(long, F.concat("section", F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("section"))
    own = F.when(long, F.slice("blocks", F.col("part") * each + 1, each)).otherwise(F.col("blocks"))
    found = parted.select("paper", "section_no", "part", name.alias("section"), "text", "pages", own.alias("blocks"))
    return found.join(passages.titles(lines).withColumnRenamed("title", "paper_title"), "paper", "left")


def chunks(sections: DataFrame, size: int = 1200, overlap: int = 150, references: bool = False) -> DataFrame:
    """paper, seq, text, body, section, paper_title, page, content_type of parsed sections.

    Prose, maths and references are split; a captioned unit is one chunk. A section without blocks is one of prose.
    Reference sections are left out unless asked for. seq numbers a paper's chunks.
    """
    kept = sections if references else sections.where(~F.col("section").rlike(REFERENCE_SECTION))
    alone = F.array(F.struct(F.lit(PROSE).alias("content_type"), F.col("text")))
    rows = kept.withColumn("b", F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(alone)).select("*", F.posexplode("b").alias("block_no", "block"))
    split = F.col("block.content_type").isin(PROSE, MATH, REFERENCE)
    pieces = passages.overlapping(size, overlap)(F.when(split, F.col("block.text")))
    rows = rows.where("trim(block.text) <> ''").withColumn("pieces", F.when(split, pieces).otherwise(F.array("block.text")))
    rows = rows.select("*", F.posexplode("pieces").alias("piece_no", "body"))
    kind = F.col("block.content_type")
    title = F.coalesce("paper_title", F.lit(""))
    header = F.concat(title, F.lit(" — "), "section", F.when(kind == PROSE, "").otherwise(F.concat(F.lit(" — "), F.initcap(kind))))
    place = F.struct("section_no", "part", "block_no", "piece_no")
    ready = rows.select(
        "paper", place.alias("place"), F.concat(header, F.lit("\n\n"), "body").alias("text"), "body", "section", title.alias("paper_title"),
        F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(0)).alias("page"), kind.alias("content_type"),
    )
    number = F.row_number().over(passages.Window.partitionBy("paper").orderBy("place")) - 1
    return ready.withColumn("seq", number).drop("place")
