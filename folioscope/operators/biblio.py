"""Bibliography: TeX escaping, keys and entries, warning lines, title likeness."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What TeX needs escaped.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escaped(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


#: Words that open no key, and what a conference's name holds.
KEY_STOP_WORDS = ["a", "an", "the", "on", "of", "for", "and", "in", "to", "with"]
CONFERENCE = r"(?i)conference|proceedings|symposium|workshop|neurips|nips|icml|iclr|cvpr|iccv|acl\b|emnlp|neural information processing"
ARXIV_DOI = "10.48550"


def bibtex_key(authors: Column, year: Column, title: Column) -> Column:
    """The first author's last name, the year, the first title word of over three letters that is no stop word."""
    last = F.try_element_at(F.split(F.trim(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit(""))), r"\s+"), F.lit(-1))
    words = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*KEY_STOP_WORDS))
    whole = F.concat(F.coalesce(F.nullif(last, F.lit("")), F.lit("anon")), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("nd")), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("untitled")))
    return F.regexp_replace(F.lower(whole), "[^a-z0-9]", "")


def bibtex(authors: Column, year: Column, title: Column, venue: Column, doi: Column, arxiv: Column, retracted: Column | None = None) -> Column:
    """An entry: an inproceedings in a conference's venue, an article with another venue and a DOI, else a misc. arXiv's own DOIs are left out."""
    given = lambda c: F.nullif(c, F.lit(""))
    real = F.when(~doi.startswith(ARXIV_DOI), given(doi))
    place, eprint = given(venue), given(arxiv)
    kind = F.when(place.rlike(CONFERENCE), "inproceedings").when(place.isNotNull() & real.isNotNull(), "article").otherwise("misc")
    field = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    names = given(F.array_join(F.transform(F.coalesce(authors, F.array().cast("array<string>")), tex_escaped), " and "))
    rows = [
        field("author", names), field("title", F.concat(F.lit("{"), tex_escaped(given(title)), F.lit("}"))),
        F.when(kind == "inproceedings", field("booktitle", tex_escaped(place))).when(kind == "article", field("journal", tex_escaped(place))),
        field("year", F.nullif(year, F.lit(0)).cast("string")), field("doi", real), field("eprint", eprint),
        F.when(eprint.isNotNull(), field("archivePrefix", F.lit("arXiv"))), F.when(kind == "misc", field("url", F.concat(F.lit("https://arxiv.org/abs/"), eprint))),
        F.when(F.lit(False) if retracted is None else retracted, field("note", F.lit("Retracted"))),
    ]
    return F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(authors, year, title), F.lit(",\n"), F.array_join(F.array_compact(F.array(*rows)), ",\n"), F.lit("\n}\n"))


#: The sentences that readers of the records expect.
RETRACTED_PLAIN, UNCHECKED = "this work has been retracted", "No DOI or arXiv id found — retraction status could not be checked."


def warnings(retracted: Column, note: Column, doi: Column, arxiv: Column) -> Column:
    """What to warn of: a retraction, and that without an identifier there is no telling."""
    unknown = (F.coalesce(doi, F.lit("")) == "") & (F.coalesce(arxiv, F.lit("")) == "")
    why = F.coalesce(F.nullif(note, F.lit("")), F.lit(RETRACTED_PLAIN))
    return F.array_compact(
        F.array(F.when(retracted, F.concat(F.lit("RETRACTED: "), why)), F.when(unknown, UNCHECKED))
    )


def preprint_note(arxiv: Column, venue: Column, year: Column) -> Column:
    """Where an arXiv copy's work was published; null if there is no id, no venue, or the venue is arXiv."""
    known = (arxiv != "") & (venue != "") & ~venue.rlike("(?i)arxiv")
    when = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" "), year.cast("string"))).otherwise("")
    return F.when(known, F.concat(F.lit("preprint · published: "), venue, when))


def chunk_metadata(records: DataFrame) -> DataFrame:
    """source and the scalar columns that a paper's record gives its chunks: no nulls, 0 and "" stand for unknown."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return records.select(
        "source", F.coalesce("year", F.lit(0)).alias("pub_year"), text("venue"), text("doi"), text("arxiv_id"), text("arxiv_doi"),
        F.coalesce("citation_count", F.lit(0)).cast("long").alias("citation_count"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
    )


def title_close(threshold: float = 0.92):
    """An Arrow function (title, title) -> boolean: equal, or alike by matching blocks, after normalising."""

    def plain(t: str) -> str:
        return re.sub(r"[^a-z0-9 ]", "", t.lower()).strip()

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [(plain(x or ""), plain(y or "")) for x, y in zip(a, b, strict=True)]
        return pd.Series([bool(x and y) and (x == y or difflib.SequenceMatcher(None, x, y).ratio() >= threshold) for x, y in pairs])

    return run


#: What is read from recorded answers of the services.
PLAIN = {
    "semanticscholar": "struct<title:string,year:int,venue:string,citationCount:long,externalIds:struct<DOI:string>>",
    "openalex_doi": "struct<id:string,title:string,publication_year:int,cited_by_count:long,is_retracted:boolean,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>,referenced_works:array<string>,ids:struct<doi:string>>",
    "crossref": "struct<message:struct<type:string,`update-to`:array<map<string,string>>,`updated-by`:array<struct<type:string,DOI:string>>>>",
    "citers": "struct<data:array<struct<citingPaper:struct<title:string,year:int>>>>",
}
REFERENCES_MOST = 200


def arxiv_found(papers: DataFrame, responses: DataFrame) -> DataFrame:
    """key, found: the first arXiv id in a recorded title search whose title is close to the paper's."""
    entry = lambda e, pattern: F.regexp_extract(e, pattern, 1)
    rows = responses.where("service = 'arxiv_search'").select("key", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("at", "e"))
    named = rows.select("key", "at", F.regexp_replace(entry("e", r"(?s)<title>\s*(.*?)\s*</title>"), r"\s+", " ").alias("t"), entry("e", r"<id>https?://arxiv\.org/abs/([^v<]+)").alias("id"))
    near = named.join(papers.select("key", "title"), "key").where("id <> ''").where(title_close()(F.col("title"), F.col("t")))
    return near.groupBy("key").agg(F.min_by("id", "at").alias("found"))


def openalex_found(known: DataFrame, responses: DataFrame) -> DataFrame:
    """key, work: the recorded search's first work of a close title and a year within one; the earliest if the paper's year is unknown."""
    rows = responses.where("service = 'openalex_search'").select("key", F.posexplode(F.from_json("body", f"struct<results:array<{PLAIN['openalex_doi']}>>")["results"]).alias("at", "work"))
    met = rows.join(known.select("key", "title", "year"), "key")
    year = F.col("work.publication_year")
    unknown = (F.coalesce("year", F.lit(0)) == 0) | (F.coalesce(year, F.lit(0)) == 0)
    fits = met.where(unknown | (F.abs(year - F.col("year")) <= 1))
    near = fits.where(title_close()(F.col("title"), F.col("work.title")))
    order = F.struct(F.when(F.coalesce("year", F.lit(0)) == 0, F.coalesce(F.nullif(year, F.lit(0)), F.lit(9999))).otherwise(0), "at")
    return near.groupBy("key").agg(F.min_by("work", order).alias("work"))


def resolved(papers: DataFrame, responses: DataFrame) -> DataFrame:
    """Bibliographic records of papers (key, title, arxiv_id, doi) from recorded answers responses (key, service, body).

    Services, in the order in which they are asked: arxiv_search (only without an id), arxiv (its title, year and venue
    win), semanticscholar, openalex_doi, else openalex_search, crossref (only with a DOI), citers. Each fills what is
    still empty. An answer that is missing or can't be read is none. Columns: key, title, year, venue, doi, arxiv_id,
    arxiv_doi, openalex_id, authors, citation_count, is_retracted, retraction_note, reference_ids, citers, resolved_by,
    unresolved.
    """
    full = lambda c: F.nullif(c, F.lit(""))
    none = F.array().cast("array<string>")
    names = ["arxiv", *PLAIN]
    bodies = responses.where(F.col("service").isin(*names)).groupBy("key").agg(*[F.max(F.when(F.col("service") == n, F.col("body"))).alias(f"_{n}") for n in names])
    start = papers.select("key", full("title").alias("title"), full("arxiv_id").alias("arxiv_id"), full("doi").alias("doi"))
    own = start.join(arxiv_found(start.where("arxiv_id is null"), responses), "key", "left").join(bodies, "key", "left")
    own = own.withColumns({n: F.from_json(f"_{n}", schema) for n, schema in PLAIN.items()}).withColumn("arxiv_id", F.coalesce("arxiv_id", "found"))

    atom = F.when(F.col("arxiv_id").isNotNull() & F.col("_arxiv").contains("<entry>"), F.regexp_extract("_arxiv", r"(?s)<entry>(.*)", 0))
    tag = lambda pattern: full(F.regexp_replace(F.trim(F.regexp_extract("atom", pattern, 1)), r"\s+", " "))
    own = own.withColumn("atom", atom).withColumns({
        "title": F.coalesce(tag("<title>([^<]+)</title>"), "title"),
        "year": tag(r"<published>(\d{4})-").cast("int"),
        "venue": tag("<arxiv:journal_ref[^>]*>([^<]+)<"),
        "doi": F.coalesce("doi", tag("<arxiv:doi[^>]*>([^<]+)<")),
        "authors": F.coalesce(F.transform(F.regexp_extract_all("atom", F.lit(r"<author>\s*<name>([^<]+)</name>"), F.lit(1)), lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), none),
    })
    known = F.coalesce("arxiv_id", "doi").isNotNull()
    s2 = F.when(known & full("semanticscholar.title").isNotNull(), F.col("semanticscholar"))
    own = own.withColumn("s2", s2).withColumns({
        "title": F.coalesce("title", "s2.title"), "year": F.coalesce("year", "s2.year"), "venue": F.coalesce("venue", full("s2.venue")),
        "citation_count": F.col("s2.citationCount"), "doi": F.coalesce("doi", full("s2.externalIds.DOI")),
    })

    by_doi = F.when(F.col("doi").isNotNull() & full("openalex_doi.id").isNotNull(), F.col("openalex_doi"))
    own = own.withColumn("by_doi", by_doi)
    searched = openalex_found(own.where("by_doi is null and title is not null"), responses)
    own = own.join(searched, "key", "left").withColumn("w", F.coalesce("by_doi", "work")).withColumns({
        "title": F.coalesce("title", full("w.title")), "year": F.coalesce("year", "w.publication_year"), "venue": F.coalesce("venue", full("w.primary_location.source.display_name")),
        "authors": F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce(F.filter(F.transform("w.authorships", lambda a: a["author"]["display_name"]), lambda n: n != ""), none)),
        "citation_count": F.when(F.col("w").isNotNull(), F.col("w.cited_by_count")).otherwise(F.col("citation_count")),
        "reference_ids": F.coalesce(F.slice("w.referenced_works", 1, REFERENCES_MOST), none),
        "doi": F.coalesce("doi", F.regexp_replace(full("w.ids.doi"), "https://doi.org/", "")),
    })

    message = F.when(F.col("doi").isNotNull(), F.col("crossref.message"))
    notices = F.filter(F.col("m").getField("updated-by"), lambda u: F.lower(u["type"]).contains("retract"))
    own = own.withColumn("m", message).withColumn("notice", F.try_element_at(notices, F.lit(-1)))
    own = own.withColumn("withdrawn", F.coalesce((F.col("m.type") == "retraction"), F.lit(False)) | (F.coalesce(F.size(F.col("m").getField("update-to")), F.lit(0)) > 0))
    note = F.when(F.col("notice").isNotNull(), F.concat(F.lit("Retracted by "), F.coalesce("notice.DOI", F.lit("None")), F.lit("."))).when(
        F.col("withdrawn"), "Crossref records a retraction notice for this DOI."
    ).when(F.col("w.is_retracted"), "OpenAlex reports this work as retracted.")
    told = F.transform(F.filter(F.coalesce(F.col("citers.data"), F.array().cast("array<struct<citingPaper:struct<title:string,year:int>>>")), lambda d: F.coalesce(d["citingPaper"]["title"], F.lit("")) != ""), lambda d: d["citingPaper"])
    cited_by = F.when(F.coalesce("arxiv_id", "doi").isNotNull(), told).otherwise(F.array().cast("array<struct<title:string,year:int>>"))
    by = lambda name, there: F.when(there, name)
    steps = F.array_compact(F.array(
        by("arxiv-title-search", F.col("found").isNotNull()), by("arxiv", F.col("atom").isNotNull()), by("semanticscholar", F.col("s2").isNotNull()),
        by("openalex", F.col("w").isNotNull()), by("crossref", F.col("m").isNotNull()), by("semanticscholar", F.size("cited_by") > 0),
    ))
    done = own.withColumn("cited_by", cited_by).withColumn("resolved_by", F.array_distinct(steps))
    return done.select(
        "key", "title", "year", "venue", "doi", "arxiv_id", F.concat(F.lit(f"{ARXIV_DOI}/arXiv."), "arxiv_id").alias("arxiv_doi"), F.col("w.id").alias("openalex_id"), "authors",
        "citation_count", note.isNotNull().alias("is_retracted"), note.alias("retraction_note"), "reference_ids", F.col("cited_by").alias("citers"), "resolved_by", (F.size("resolved_by") == 0).alias("unresolved"),
    )
