"""The library's files and records: uploads, the record cache, listings, exports, golden sets, and what a model call takes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import stem
from folioscope.operators import biblio, graph
from folioscope.sources.tables import safe_pdf_name


def acceptable_upload(content: Column) -> Column:
    """Whether a file's bytes are a PDF's: not empty, and with its mark at the start."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def import_name(arxiv: Column) -> Column:
    """The file name of an imported paper; a slash of the older identifiers becomes a hyphen."""
    return F.concat(F.regexp_replace(arxiv, "/", "-"), F.lit(".pdf"))


def to_import(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """arxiv, file of wanted (arxiv) that files (file) does not have yet."""
    named = wanted.where("arxiv is not null").select("arxiv", import_name(F.col("arxiv")).alias("file"))
    return named.join(files.select("file").distinct(), "file", "left_anti").select("arxiv", "file")


def pending(files: DataFrame, store: DataFrame, only: str | None = None) -> DataFrame:
    """path, file_hash of files that the store does not have, in order of path; only: that one file."""
    asked = files if only is None else files.where(F.regexp_extract("path", r"([^/\\]*)$", 1) == only)
    return asked.join(store.select("file_hash").distinct(), "file_hash", "left_anti").select("path", "file_hash").orderBy("path")


def store_name(base: str, provider: str) -> str:
    """The name of a provider's store: vectors of different providers differ in width. Fixed value: one keeps the bare name."""
    return base if provider == "gemini" else f"{base}-{provider}"


def chunk_prefix(source: Column, file_hash: Column) -> Column:
    """What a chunk's id starts with: its file's stem and the first eight characters of its hash."""
    return F.concat_ws("-", stem(source), F.substring(file_hash, 1, 8))


def cache_key(arxiv: Column, doi: Column, path: Column) -> Column:
    """What a paper's record is kept under: its arXiv identifier, else its DOI, else its file's stem; empty ones count as missing."""
    return F.coalesce(F.nullif(arxiv, F.lit("")), F.nullif(doi, F.lit("")), stem(path))


def cached_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """key and the fields of schema for each record of a JSON object file; a missing or broken file has none."""
    empty = spark.createDataFrame([], f"key string, {schema}")
    texts = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", path.rsplit("/", 1)[1]).load(path.rsplit("/", 1)[0])
    whole = texts.select(F.from_json("value", f"map<string, struct<{schema}>>").alias("m"))
    return empty.unionByName(whole.select(F.explode("m").alias("key", "r")).select("key", "r.*"))


def listing(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """file, title in order of file: the first non-empty title of a file's chunks (source, title, ord), else the file's own title, else its stem.

    files: file, pdf_title.
    """
    first = chunks.where(F.trim("title") != "").groupBy(F.regexp_extract("source", r"([^/\\]*)$", 1).alias("file")).agg(F.min_by("title", "ord").alias("t"))
    title = F.coalesce("t", F.nullif("pdf_title", F.lit("")), stem(F.col("file")))
    return files.join(first, "file", "left").select("file", title.alias("title")).orderBy("file")


def bibtex_file(records: DataFrame) -> DataFrame:
    """One row: the entries of all records (file, authors, year, title, venue, doi, arxiv, retracted) in order of file, as one text."""
    entry = biblio.bibtex(*map(F.col, ["authors", "year", "title", "venue", "doi", "arxiv", "retracted"]))
    rows = records.groupBy().agg(F.array_sort(F.collect_list(F.struct("file", entry.alias("e")))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["e"]), "\n").alias("bibtex"))


def corpus_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers (file, title, year, citation_count) and edges (citing, cited) of cached records (file, ord, own_id, reference_ids, title, year, citation_count)."""
    cites = graph.citation_edges(records.select(F.col("file").alias("paper"), "ord", "own_id", "reference_ids"))
    return records.select("file", "title", "year", "citation_count"), cites


def graph_payload(records: DataFrame, relations: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """One row: papers, edges and shared (concepts that two papers discuss) as arrays in order; without relations nothing is shared."""
    papers, cites = corpus_graph(records)
    shared = None
    if relations is not None:
        nodes, edges = relations
        cites = graph.map_edges(cites, graph.paper_links(nodes, edges))
        concepts = nodes.where("stem is null").select(F.explode("papers").alias("paper"), "label")
        shared = graph.shared_concepts(concepts)
    ordered = lambda df, *c: df.select(F.array_sort(F.collect_list(F.struct(*c))).alias("l"))
    out = ordered(papers, "file", "title", "year", "citation_count").withColumnRenamed("l", "papers").crossJoin(ordered(cites, "citing", "cited").withColumnRenamed("l", "edges"))
    if shared is None:
        return out.withColumn("shared", F.array().cast("array<struct<a:string,b:string,concepts:string>>"))
    return out.crossJoin(ordered(shared, "a", "b", "concepts").withColumnRenamed("l", "shared"))


def golden_set(spark: SparkSession, items: list[dict]) -> DataFrame:
    """q, question, paper, kind, contains of a golden set's items; identifiers that were read as numbers become text again."""
    rows = [(n, str(x["q"]), str(x["paper"]), x.get("kind") or "other", [str(c) for c in x["contains"]]) for n, x in enumerate(items)]
    return spark.createDataFrame(rows, "q long, question string, paper string, kind string, contains array<string>")


def report(metrics: DataFrame) -> str:
    """metrics (metric, value) as the JSON text of a report, in order of metric; they are a few figures."""
    return json.dumps({r["metric"]: r["value"] for r in metrics.orderBy("metric").collect()}, indent=2)


def message_text(content: Column) -> Column:
    """A model's reply as plain text, from the JSON of its content: a string, or a list of strings and of blocks with a text."""
    parts = F.transform(F.from_json(content, "array<string>"), lambda p: F.when(p.startswith("{"), F.get_json_object(p, "$.text")).otherwise(p))
    listed = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "")
    return F.when(F.trim(content).startswith("["), listed).when(F.trim(content).startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), content, F.lit("}")), "$.a")).otherwise(content)


def embedded(texts: DataFrame, width: int = 64) -> DataFrame:
    """texts (id, text) with embedding: hashed word counts of unit length, which stand in for a model where none can be called; none for a text without words."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    terms = texts.select("id", F.explode(words).alias("w")).groupBy("id", F.pmod(F.xxhash64("w"), F.lit(width)).cast("int").alias("at")).agg(F.sum(F.when(F.xxhash64("w", F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)).alias("x"))
    rows = terms.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n"))
    return texts.join(rows.where("n > 0").select("id", vector.alias("embedding")), "id", "left")


def verdict_line(counts: DataFrame) -> DataFrame:
    """answer_id, line: an answer's verdicts (answer_id, verdict, n) in a fixed order, those that do not occur left out."""
    order = ["supported", "partial", "unsupported", "fabricated", "unchecked"]
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")))
    rows = counts.groupBy("answer_id").agg(*[of(v).alias(v) for v in order])
    shown = [F.when(F.col(v) > 0, F.concat(F.col(v).cast("string"), F.lit(f" {v}"))) for v in order]
    return rows.select("answer_id", F.concat_ws(", ", *shown).alias("line"))


def before_last_question(messages: DataFrame) -> DataFrame:
    """The messages (conv_id, turn, role) before a conversation's last one of a user: what stays when its answer is made again."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return messages.join(last, "conv_id").where("turn < last").drop("last")


def conversation_titles(messages: DataFrame, chars: int = 60) -> DataFrame:
    """conv_id, title: the start of each conversation's first question."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", F.substring("t", 1, chars).alias("title"))


def pieces_between(spans: DataFrame) -> DataFrame:
    """key, start, end, marked: a text's highlighted and plain pieces in order, from merged spans (key, start, end) and texts' length.

    A text without spans is one plain piece; an empty text has none.
    """
    rows = spans.groupBy("key", "length").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("s"))
    piece = lambda a, z, m: F.struct(a.cast("long").alias("start"), z.cast("long").alias("end"), F.lit(m).alias("marked"))
    before = F.transform("s", lambda x, i: F.array(piece(F.when(i == 0, F.lit(0)).otherwise(F.get("s", i - 1)["end"]), x["start"], False), piece(x["start"], x["end"], True)))
    tail = F.array(piece(F.coalesce(F.try_element_at("s", F.lit(-1))["end"], F.lit(0)), F.col("length"), False))
    every = F.filter(F.concat(F.flatten(before), tail), lambda p: p["start"] < p["end"])
    return rows.select("key", F.explode(every).alias("p")).select("key", "p.*")


def lines_of(spans: DataFrame) -> DataFrame:
    """paper, page_no, line_no, text, size, bold of a page's spans (paper, page_no, block_no, line_no, span_no, kind, text, size, bold).

    Image blocks are left out; a line's spans are joined in order and stripped, blank lines go, and lines are numbered on a page
    in order; size is the largest of its spans, bold holds if all of them are.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    rows = spans.where("kind = 'text'").groupBy("paper", "page_no", "block_no", "line_no").agg(text.alias("joined"), F.max("size").alias("size"), F.every("bold").alias("bold"))
    named = rows.select("paper", "page_no", F.struct("block_no", "line_no").alias("at"), F.regexp_replace("joined", r"(?U)^\s+|\s+$", "").alias("text"), "size", "bold").where("text <> ''")
    entry = F.array_sort(F.collect_list(F.struct("at", "text", "size", "bold")))
    pages = named.groupBy("paper", "page_no").agg(entry.alias("l"))  # a page's lines, a few hundred at most
    return pages.select("paper", "page_no", F.posexplode("l").alias("line_no", "x")).select("paper", "page_no", "line_no", "x.text", "x.size", "x.bold")


def stored_uploads(names: DataFrame) -> DataFrame:
    """file of uploads (name, content) that are PDFs, by their safe names."""
    return names.where(acceptable_upload(F.col("content"))).select(safe_pdf_name(F.col("name")).alias("file"))
