"""The relation graph: merging nodes and edges, degrees, seeds, neighbours, facts, shared concepts, citations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import norm_label, stem, tokens
from folioscope.operators import lexical, matching
from folioscope.sources.tables import stored


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """node, label, papers, n_papers: the first label (by ord) wins, papers are the sorted distinct ones."""
    return nodes.groupBy("node").agg(F.min_by("label", "ord").alias("label"), F.array_sort(F.collect_set("paper")).alias("papers")).withColumn("n_papers", F.size("papers").cast("long"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """source, target, relation, score: one edge per pair, the last (by ord, then relation and score) wins; loops go."""
    last = F.max(F.struct("ord", "relation", "score"))
    return edges.where("source <> target").groupBy("source", "target").agg(last.alias("e")).select("source", "target", "e.relation", "e.score")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: edges in and out."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def seeds(degree: DataFrame, overlap: DataFrame, limit: int = 6) -> DataFrame:
    """node: the nodes with most overlap (node, overlap), then most edges, then least id; a node may have no edge."""
    ranked = overlap.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.orderBy(F.desc("overlap"), F.desc("degree"), "node").limit(limit).select("node")


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: what one edge in either direction leads to from the start nodes, without these."""
    both = edges.select("source", "target").union(edges.select("target", "source"))
    reached = both.join(start.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node")).distinct()
    return reached.join(start, "node", "left_anti")


def expansion(edges: DataFrame, start: DataFrame, limit: int = 8) -> DataFrame:
    """node, degree: the neighbours with most edges; ties to the least id."""
    return neighbours(edges, start).join(degrees(edges), "node").orderBy(F.desc("degree"), "node").limit(limit)


def facts(edges: DataFrame, start: DataFrame, vague: list[str], limit: int = 12) -> DataFrame:
    """Edges that touch a start node: precise relations first, then by score, then by (source, target)."""
    touching = edges.join(start.withColumnRenamed("node", "source"), "source", "left_semi").union(edges.join(start.withColumnRenamed("node", "target"), "target", "left_semi").select(edges.columns)).distinct()
    return touching.orderBy(F.col("relation").isin(*vague), F.desc("score"), "source", "target").limit(limit)


def shared_concepts(node_papers: DataFrame) -> DataFrame:
    """a, b, n, concepts for pairs of papers over (paper, label): labels that both have."""
    own = node_papers.distinct()
    left, right = own.select(F.col("paper").alias("a"), "label"), own.select(F.col("paper").alias("b"), "label")
    return left.join(right, "label").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "|").alias("concepts"))


def citation_edges(papers: DataFrame) -> DataFrame:
    """citing, cited over papers (paper, ord, own_id, reference_ids); of papers with one own_id the last is cited, none cites itself."""
    target = papers.where("own_id is not null").groupBy("own_id").agg(F.max_by("paper", "ord").alias("cited"))
    cites = papers.select(F.col("paper").alias("citing"), F.explode("reference_ids").alias("own_id"))
    return cites.join(target, "own_id").where("citing <> cited").select("citing", "cited")


#: Words that name no concept by themselves, and relations that say little.
GENERIC = (
    "a about an and are approach architecture data deep did do does for from how in is learning method methods model models "
    "network networks neural of on paper papers relate task the to training use used uses using what which with"
).split()
VAGUE = ["conceptually_related_to", "semantically_similar_to"]
GUIDE = (
    "RELATIONSHIPS — links between papers and concepts that a model has extracted. They are hints, not evidence. Never cite them: "
    "state a link only where one of the PASSAGES says the same, and cite that passage.\n"
)
SEEDS_MOST, OVERLAP_LEAST, EXPANSION_MOST, FACTS_MOST = 6, 0.5, 8, 12


def paper_node(stem: Column) -> Column:
    return F.concat(F.lit("paper_"), F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}_]+", "_"))


def merged_extractions(raw_nodes: DataFrame, raw_edges: DataFrame, titles: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of what was found per paper: nodes (node, label, file_type, stem, papers), edges (source, target, relation, confidence, confidence_score, paper).

    raw_nodes: paper, ord, id, label, file_type, is_stub; raw_edges: paper, ord, source, target, relation, confidence,
    confidence_score; titles: stem, names; citations: citing, cited. A paper's own node is the one of its type that is no
    stub, or any that bears its title; others merge by normalised label, the first one's label and type standing. Edges
    with unknown ends and loops go; of edges between the same ends the last stands, citations after all others.
    """
    stems = titles.select("stem", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    by_title = stems.select("stem", F.explode("names").alias("n")).groupBy(norm_label(F.col("n")).alias("plain")).agg(F.max("stem").alias("titled"))
    plain = raw_nodes.withColumn("plain", norm_label(F.coalesce("label", F.lit("")))).where("plain <> ''")
    met = plain.join(by_title, "plain", "left").join(stems.select(F.col("stem").alias("paper"), F.lit(True).alias("known")), "paper", "left")
    itself = (F.col("file_type") == "paper") & ~F.coalesce("is_stub", F.lit(False)) & F.col("known")
    concept = F.concat(F.lit("concept_"), F.regexp_replace("plain", " ", "_"))
    named = met.withColumn("node", F.when(itself, paper_node(F.col("paper"))).when(F.col("titled").isNotNull(), paper_node(F.col("titled"))).otherwise(concept))
    papers = stems.select(paper_node(F.col("stem")).alias("node"), F.coalesce(F.try_element_at("names", F.lit(1)), "stem").alias("label"), F.lit("paper").alias("file_type"), "stem", F.array("stem").alias("papers"))
    first = F.min_by(F.struct("label", F.coalesce(F.nullif("file_type", F.lit("")), F.lit("concept")).alias("file_type")), F.struct("paper", "ord"))
    merged = named.join(papers.select("node"), "node", "left_anti").groupBy("node").agg(first.alias("f"), F.array_sort(F.collect_set("paper")).alias("papers"))
    nodes = papers.unionByName(merged.select("node", "f.label", "f.file_type", F.lit(None).cast("string").alias("stem"), "papers"))

    ids = named.groupBy("paper", "id").agg(F.max_by("node", "ord").alias("node"))
    end = lambda c: ids.select("paper", F.col("id").alias(c), F.col("node").alias(f"{c}_node"))
    given = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other)).alias(c)
    score = F.coalesce(F.nullif("confidence_score", F.lit(0.0)), F.lit(0.5)).alias("confidence_score")
    own = raw_edges.join(end("source"), ["paper", "source"]).join(end("target"), ["paper", "target"]).select(
        F.col("source_node").alias("source"), F.col("target_node").alias("target"), given("relation", "references"), given("confidence", "INFERRED"), score, "paper",
        F.struct(F.lit(0).alias("kind"), "paper", F.col("ord").cast("long").alias("ord")).alias("at"),
    )
    known = stems.select("stem")
    cites = citations.join(known.withColumnRenamed("stem", "citing"), "citing", "left_semi").join(known.withColumnRenamed("stem", "cited"), "cited", "left_semi").select(
        paper_node(F.col("citing")).alias("source"), paper_node(F.col("cited")).alias("target"), F.lit("cites").alias("relation"), F.lit("EXTRACTED").alias("confidence"),
        F.lit(1.0).alias("confidence_score"), F.col("citing").alias("paper"), F.struct(F.lit(1).alias("kind"), F.col("citing").alias("paper"), F.lit(0).cast("long").alias("ord")).alias("at"),
    )
    columns = ["relation", "confidence", "confidence_score", "paper"]
    last = own.unionByName(cites).where("source <> target").groupBy("source", "target").agg(F.max_by(F.struct(*columns), "at").alias("e"))
    return nodes, last.select("source", "target", *[F.col(f"e.{c}") for c in columns])


def stored_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write a merged graph as two tables and read it again; what searches it then need not merge it anew."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    return loaded_graph(nodes.sparkSession, folder)


def loaded_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The nodes and edges of a stored graph; None where there is none."""
    try:
        return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


NODE_LINK = "directed boolean, nodes array<struct<id:string,label:string,file_type:string,stem:string,papers:array<string>>>, links array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,paper:string>>"


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The nodes and edges of a graph in one node-link JSON file; None where there is no such file."""
    try:
        whole = spark.read.schema(NODE_LINK).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    nodes = whole.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node"), "n.label", "n.file_type", "n.stem", "n.papers")
    return nodes, whole.select(F.explode("links").alias("e")).select("e.*")


def question_seeds(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = SEEDS_MOST, least: float = OVERLAP_LEAST) -> DataFrame:
    """q, node: for each question (q, text) the nodes (node, label) of whose telling label words it names the share `least` or more.

    Best are those with the largest share, then with most edges, then the least id.
    """
    told = lambda c: F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in GENERIC]))
    have = nodes.select("node", told(norm_label(F.coalesce("label", F.lit("")))).alias("terms"))
    have = have.select("node", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    want = questions.select("q", F.explode(told(F.col("text"))).alias("term"))
    shared = have.join(want, "term").groupBy("q", "node", "n").agg(F.count("*").alias("k")).withColumn("overlap", F.col("k") / F.col("n")).where(F.col("overlap") >= least)
    ranked = shared.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("overlap"), F.desc("degree"), "node"))
    return ranked.withColumn("k", best).where(F.col("k") <= limit).select("q", "node")


def linked(edges: DataFrame, start: DataFrame) -> DataFrame:
    """q, node: what one edge in either direction leads to from a question's seeds (q, node), without these."""
    both = edges.select("source", "target").union(edges.select("target", "source"))
    reached = both.join(start.withColumnRenamed("node", "source"), "source").select("q", F.col("target").alias("node")).distinct()
    return reached.join(start, ["q", "node"], "left_anti")


def related_papers(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """q, paper: the papers that hold a question's seeds, or a node one edge away."""
    held = start.unionByName(linked(edges, start)).join(nodes.select("node", F.explode("papers").alias("paper")), "node")
    return held.select("q", "paper").distinct()


def widened(questions: DataFrame, nodes: DataFrame, edges: DataFrame, start: DataFrame, limit: int = EXPANSION_MOST) -> DataFrame:
    """q, text: questions with the labels of their seeds' best linked neighbours after them; ties to the least id."""
    near = linked(edges, start).join(degrees(edges), "node").join(nodes.select("node", norm_label(F.col("label")).alias("plain")), "node")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("degree"), "node"))
    terms = near.withColumn("k", place).where(F.col("k") <= limit).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "plain"))).alias("l"))
    return questions.join(terms, "q", "left").select("q", F.concat_ws(" ", "text", F.array_join(F.transform("l", lambda x: x["plain"]), " ")).alias("text"))


def search(index: lexical.Index, papers_of: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 25, over: int = 4) -> DataFrame:
    """q, rank, key, score: of the k * over best passages of an index for the widened question, the first k in related papers.

    papers_of (key, source) says which paper a passage is from.
    A question that names no node gets none.
    """
    start = stored(question_seeds(nodes, edges, questions), "seeds")
    papers = stored(related_papers(nodes, edges, start), "related")
    asked = widened(questions, nodes, edges, start).join(papers.select("q").distinct(), "q", "left_semi")
    hits = index.search(asked, k * over).join(papers_of.select(index.key, stem(F.col("source")).alias("paper")), index.key)
    kept = hits.join(papers, ["q", "paper"], "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank")))
    return kept.where(F.col("rank") <= k).select("q", "rank", index.key, "score")


def question_facts(nodes: DataFrame, edges: DataFrame, start: DataFrame, limit: int = FACTS_MOST) -> DataFrame:
    """q, place, source, relation, target, paper, confidence: edges that touch a question's seeds, by labels.

    Telling relations come first, then the surer ones; ties to the least ends.
    """
    ends = edges.withColumn("node", F.explode(F.array("source", "target")))
    touching = ends.join(start, "node").drop("node").distinct()
    order = Window.partitionBy("q").orderBy(F.col("relation").isin(*VAGUE), F.desc("confidence_score"), "source", "target")
    best = touching.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    label = lambda c: nodes.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    named = best.join(label("source"), "source").join(label("target"), "target")
    return named.select("q", "place", F.col("source_label").alias("source"), "relation", F.col("target_label").alias("target"), "paper", "confidence")


def facts_block(found: DataFrame) -> DataFrame:
    """q, block: a question's facts as text for a prompt; no row without facts."""
    line = F.concat(F.lit("- "), "source", F.lit(" -["), "relation", F.lit("]-> "), "target", F.lit(" (from "), "paper", F.lit(")"))
    rows = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))).alias("l"))
    return rows.select("q", F.concat(F.lit(GUIDE), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n\n")).alias("block"))


def paper_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """citing, relation, cited: edges between papers of the library, by stem."""
    own = nodes.where("stem is not null")
    end = lambda c, name: own.select(F.col("node").alias(c), F.col("stem").alias(name))
    return edges.join(end("source", "citing"), "source").join(end("target", "cited"), "target").select("citing", "relation", "cited")


def map_edges(base: DataFrame, links: DataFrame) -> DataFrame:
    """citing, cited: known citations and those of the graph."""
    return base.select("citing", "cited").union(links.where("relation = 'cites'").select("citing", "cited")).distinct()


def map_rows(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """paper, year, cites, cited_by over papers (paper, year) and edges (citing, cited): known papers only; unknown years (null, zero) sort as 9999."""
    own = papers.select("paper").distinct()
    known = edges.select("citing", "cited").distinct().join(own.withColumnRenamed("paper", "citing"), "citing", "left_semi").join(own.withColumnRenamed("paper", "cited"), "cited", "left_semi")
    count = lambda end, name: known.groupBy(F.col(end).alias("paper")).agg(F.count("*").alias(name))
    rows = papers.join(count("citing", "cites"), "paper", "left").join(count("cited", "cited_by"), "paper", "left")
    year = F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)).alias("sort_year")
    return rows.select("paper", "year", year, F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def title_citations(texts: DataFrame, titles: DataFrame, least: int = 12) -> DataFrame:
    """citing, cited: texts (stem, squashed) that hold a title (stem, name squashed) of `least` characters or more of another stem."""
    names = titles.where(F.length("name") >= least).select(F.col("stem").alias("wanted"), F.col("name").alias("part"))
    held = matching.holding(texts.select(F.col("stem").alias("key"), F.col("squashed").alias("text")), names)
    return held.where("key <> wanted").select(F.col("key").alias("citing"), F.col("wanted").alias("cited")).distinct()
