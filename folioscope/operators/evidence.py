"""Evidence: quotes, citations, verdicts, stances, warnings, and retrieval metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import stem
from folioscope.operators import matching

#: Fixed value: how an answer cites a passage, with or without a quote.
CITATION = r"\[([A-Za-z0-9._-]+chunk-\d+)(?:\s+\"([^\"]{4,400})\")?\]"


def located(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quote_id, doc_id, start, end: the first exact places of quotes (quote_id, quote) in texts (doc_id, text)."""
    held = matching.holding(texts.select(F.col("doc_id").alias("key"), "text"), quotes.select(F.col("quote_id").alias("wanted"), F.col("quote").alias("part")))
    met = held.select(F.col("key").alias("doc_id"), F.col("wanted").alias("quote_id"), F.col("part").alias("quote")).join(texts.select("doc_id", "text"), "doc_id")
    at = F.instr(F.col("text"), F.col("quote"))
    return met.select("quote_id", "doc_id", (at - 1).alias("start"), (at - 1 + F.length("quote")).alias("end"))


def flexible_place():
    """An Arrow function (quote, text) -> struct(start, end, exact): exact, else with any white space and letter case.

    No place for a null or empty quote or text.
    """
    def place(quote: str | None, text: str | None) -> dict:
        found = {"start": None, "end": None, "exact": None}
        if not quote or not text:
            return found
        at = text.find(quote)
        if at >= 0:
            return {"start": at, "end": at + len(quote), "exact": True}
        m = re.search(r"\s+".join(map(re.escape, quote.split())), text, re.I)
        return {"start": m.start(), "end": m.end(), "exact": False} if m else found

    @F.pandas_udf("start int, end int, exact boolean")
    def run(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [place(q, t) for q, t in zip(quote, text, strict=True)]
        return pd.DataFrame(rows, columns=["start", "end", "exact"]).astype({"start": "Int32", "end": "Int32", "exact": "boolean"})

    return run


def claims(answers: DataFrame) -> DataFrame:
    """answer_id, pos, text, cited: the sentences of answers (answer_id, answer) and the ids that each cites, with repeats."""
    parts = answers.select("answer_id", F.posexplode(F.split(F.trim("answer"), r"(?<=[.!?])\s+(?=[A-Z(])")).alias("pos", "text"))
    return parts.where("text <> ''").withColumn("cited", F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)))


def claim_spans(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """answer_id, pos, text, spans, verdict, reason of answers (answer_id, answer) and what each retrieved (answer_id, id, text, doc_start).

    A claim with a quote that its passage does not hold, or with a passage that was not retrieved, is fabricated (the last
    such reason stands); any other is unchecked. A citation without a quote makes no span. Offsets of the document count
    from the passage's start there.
    """
    sentences = claims(answers).drop("cited")
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(CITATION), F.lit(g)).alias(n) for g, n in ((1, "id"), (2, "quote"))])
    cited = sentences.select("answer_id", "pos", "text", F.posexplode_outer(pairs).alias("cite_no", "c"))
    known = retrieved.dropDuplicates(["answer_id", "id"]).select(
        F.col("answer_id").alias("_a"), F.col("id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("doc_start", F.lit(0)).cast("long").alias("_at")
    )
    met = cited.join(known, (F.col("answer_id") == F.col("_a")) & (F.col("c.id") == F.col("_id")), "left").withColumn("p", flexible_place()(F.col("c.quote"), F.col("_text")))
    unknown, missing = F.col("c.id").isNotNull() & F.col("_id").isNull(), (F.col("c.quote") != "") & F.col("p.start").isNull()
    reason = F.when(unknown, F.concat(F.lit("cites "), F.col("c.id"), F.lit(", which was not retrieved"))).when(missing, "quoted text does not appear in the cited passage")
    span = F.when(
        F.col("p.start").isNotNull(),
        F.struct(
            F.col("c.id").alias("chunk_id"), F.col("c.quote").alias("quote"), F.col("p.start").alias("start"), F.col("p.end").alias("end"),
            (F.col("_at") + F.col("p.start")).alias("doc_start"), (F.col("_at") + F.col("p.end")).alias("doc_end"), F.col("p.exact").alias("exact"),
        ),
    )
    rows = met.select("answer_id", "pos", "text", F.struct("cite_no", span.alias("span"), reason.alias("reason")).alias("r"))
    merged = rows.groupBy("answer_id", "pos", "text").agg(F.array_sort(F.collect_list("r")).alias("r"))
    wrong = F.array_compact(F.transform("r", lambda x: x["reason"]))
    return merged.select(
        "answer_id", "pos", "text", F.array_compact(F.transform("r", lambda x: x["span"])).alias("spans"),
        F.when(F.size(wrong) > 0, "fabricated").otherwise("unchecked").alias("verdict"), F.coalesce(F.try_element_at(wrong, F.lit(-1)), F.lit("")).alias("reason"),
    )


#: A judge's reply, what it may say, and how many claims it is asked about.
REPLY = "array<struct<n:string,verdict:string,why:string>>"
JUDGEMENTS, JUDGED_MOST, REASON_CHARS = ("supported", "partial", "unsupported"), 12, 120


def listed(reply: Column, schema: str) -> Column:
    """The list in a model's reply, from the first opening to the last closing bracket; null if there is none."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), schema)


def judged_claims(found: DataFrame, replies: DataFrame, most: int = JUDGED_MOST) -> DataFrame:
    """The claims of claim_spans with the verdicts of replies (answer_id, reply).

    Asked about are an answer's first unchecked claims that have a span, numbered from 1. Of entries with one number the
    last counts; one that is no verdict leaves the claim unchecked. A reply that can't be read changes nothing.
    """
    pending = (F.col("verdict") == "unchecked") & (F.size("spans") > 0)
    asked = found.where(pending).withColumn("n", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))).where(F.col("n") <= most)
    said = replies.select("answer_id", F.posexplode(listed(F.col("reply"), REPLY)).alias("at", "e")).select("answer_id", "at", F.expr("try_cast(e.n AS int)").alias("n"), "e.verdict", "e.why")
    last = said.where("n is not null").groupBy("answer_id", "n").agg(F.max_by(F.struct("verdict", "why"), "at").alias("said"))
    told = asked.select("answer_id", "pos", "n").join(last, ["answer_id", "n"]).drop("n")
    verdict = F.lower(F.col("said.verdict"))
    return found.join(told, ["answer_id", "pos"], "left").select(
        "answer_id", "pos", "text", "spans",
        F.when(F.col("said").isNull(), F.col("verdict")).when(verdict.isin(*JUDGEMENTS), verdict).otherwise("unchecked").alias("verdict"),
        F.when(F.col("said").isNull(), F.col("reason")).otherwise(F.substring(F.coalesce("said.why", F.lit("")), 1, REASON_CHARS)).alias("reason"),
    )


def claim_summary(found: DataFrame, least: int = 40) -> DataFrame:
    """answer_id, n_<verdict> each, n_uncited (unchecked, without a span, over `least` characters), flagged (in order) of judged claims."""
    n = lambda c: F.count(F.when(c, 1))
    bad = F.col("verdict").isin("unsupported", "fabricated", "partial")
    entry = F.when(bad, F.struct("pos", "text", "verdict", "reason"))
    bare = (F.size("spans") == 0) & (F.col("verdict") == "unchecked") & (F.length("text") > least)
    return found.groupBy("answer_id").agg(
        *[n(F.col("verdict") == v).alias(f"n_{v}") for v in (*JUDGEMENTS, "fabricated", "unchecked")],
        n(bare).alias("n_uncited"),
        F.array_sort(F.collect_list(entry)).alias("flagged"),
    )


def payload(found: DataFrame) -> DataFrame:
    """answer_id, claims: a JSON list of an answer's claims in order, with the names that a browser expects."""
    span = lambda x: F.struct(
        x["chunk_id"].alias("chunkId"), x["quote"].alias("quote"), x["start"].alias("start"), x["end"].alias("end"),
        x["doc_start"].alias("docStart"), x["doc_end"].alias("docEnd"), x["exact"].alias("exact"),
    )
    rows = found.select("answer_id", F.struct("pos", "text", "verdict", "reason", F.transform("spans", span).alias("spans")).alias("c"))
    inner = lambda x: F.struct(*[x[k].alias(k) for k in ("text", "verdict", "reason", "spans")])
    return rows.groupBy("answer_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list("c")), inner)).alias("claims"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of figures over answers (verdicts array, bare_citations, cited_expected_evidence, error); those with an error only count as failed."""
    fine = F.coalesce(F.col("error"), F.lit("")) == ""
    of = lambda *names: F.coalesce(F.sum(F.when(fine, F.size(F.filter("verdicts", lambda v: v.isin(*names))))), F.lit(0))
    sums = rows.agg(
        F.count(F.when(fine, 1)).alias("scored"), F.count(F.when(~fine, 1)).alias("failed"), of(*JUDGEMENTS).alias("judged"), of("fabricated").alias("fabricated"),
        of("supported").alias("supported"), F.coalesce(F.sum(F.when(fine, F.col("bare_citations"))), F.lit(0)).alias("bare_citations"),
        F.count(F.when(fine & F.col("cited_expected_evidence"), 1)).alias("evidence"),
    )
    quotes = F.col("judged") + F.col("fabricated")
    return sums.withColumns({"quote_rate": rate(F.col("judged"), quotes), "support_rate": rate(F.col("supported"), F.col("judged")), "evidence_rate": rate(F.col("evidence"), F.col("scored"))})


def stances(passages: DataFrame, replies: DataFrame, most: int = 10) -> DataFrame:
    """q, rank, id, stance, claim: passages (q, rank, id) with the stances of replies (q, reply); neutral where nothing readable is said."""
    said = replies.select("q", F.posexplode(listed(F.col("reply"), "array<struct<n:string,stance:string,claim:string>>")).alias("at", "e"))
    last = said.select("q", "at", F.expr("try_cast(e.n AS int)").alias("place"), "e.stance", "e.claim").groupBy("q", "place").agg(F.max_by(F.struct("stance", "claim"), "at").alias("s"))
    placed = passages.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank")))
    stance = F.lower(F.col("s.stance"))
    told = F.when((F.col("place") <= most) & stance.isin("supports", "contradicts"), stance).otherwise("neutral")
    claim = F.when(F.col("place") <= most, F.substring(F.coalesce("s.claim", F.lit("")), 1, REASON_CHARS)).otherwise("")
    return placed.join(last, ["q", "place"], "left").select("q", "rank", "id", told.alias("stance"), F.coalesce(claim, F.lit("")).alias("claim"))


def split_text(labelled: DataFrame, most: int = 4) -> DataFrame:
    """q, block over labelled (q, rank, paper, year, stance, claim): the disagreement in words; no row where none pushes back. Year zero is unknown."""
    side = lambda s: F.col("stance") == s
    names = lambda s: F.array_sort(F.collect_set(F.when(side(s), F.col("paper"))))
    year = lambda s: F.when(side(s) & (F.col("year") != 0), F.col("year"))
    against = F.when(side("contradicts"), F.struct("rank", "paper", "claim"))
    found = labelled.groupBy("q").agg(
        names("supports").alias("pro"), names("contradicts").alias("con"), F.max(year("supports")).alias("last"), F.min(year("contradicts")).alias("first"),
        F.slice(F.array_sort(F.collect_list(against)), 1, most).alias("c"),
    )
    side_line = lambda c, verb: F.concat(F.lit("  "), F.size(c).cast("string"), F.lit(f" paper(s) {verb}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("—"))
    newer = F.when(
        F.col("first") > F.col("last"),
        F.concat(F.lit("  The pushback is more recent ("), F.col("first").cast("string"), F.lit("+) than the support (to "), F.col("last").cast("string"), F.lit(") — say so.")),
    )
    quoted = F.transform(F.filter("c", lambda x: x["claim"] != ""), lambda x: F.concat(F.lit("  - "), x["paper"], F.lit(": "), x["claim"]))
    # The block's sentences, which prompts refer to.
    head = F.array_compact(F.array(F.lit("DISAGREEMENT IN THE RETRIEVED EVIDENCE — do not average this away."), side_line("pro", "support"), side_line("con", "push back"), newer))
    end = F.array(F.lit("Report the split explicitly, and say which side each paper is on."))
    return found.where(F.size("con") > 0).select("q", F.array_join(F.concat(head, quoted, end), "\n").alias("block"))


def used_citations(answers: DataFrame, known: DataFrame) -> DataFrame:
    """answer_id, number, id: retrieved ids that an answer cites, numbered by first use."""
    cited = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1))).alias("pos", "id"))
    first = cited.join(known.select("id").distinct(), "id", "left_semi").groupBy("answer_id", "id").agg(F.min("pos").alias("pos"))
    return first.select("answer_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")).alias("number"), "id")


def stripped(answers: DataFrame, known: DataFrame) -> DataFrame:
    """answer_id, answer: without the citations of passages that were not retrieved; runs of blanks become one.

    An answer without citations loses only its runs of blanks; a null answer stays null. answer_id names one answer.
    """
    cited = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1))).alias("pos", "id"))
    invented = cited.join(known.select("id").distinct(), "id", "left_anti").groupBy("answer_id").agg(F.collect_set("pos").alias("gone"))
    kept = F.transform(
        F.regexp_extract_all("answer", F.lit(CITATION), F.lit(0)),
        lambda whole, at: F.when(F.coalesce(F.array_contains("gone", at), F.lit(False)), "").otherwise(whole),
    )
    woven = F.array_join(F.transform(F.split("answer", CITATION), lambda part, at: F.concat(part, F.coalesce(F.get("kept", at), F.lit("")))), "")
    rows = answers.join(invented, "answer_id", "left").withColumn("kept", kept)
    return rows.select("answer_id", F.regexp_replace(F.when(F.col("answer").isNotNull(), woven), r"[ \t]{2,}", " ").alias("answer"))


def cited_first(passages: DataFrame, used: DataFrame) -> DataFrame:
    """answer_id, place, id, number: an answer's passages (answer_id, rank, id), the cited ones of used_citations first, the rest in rank order."""
    rows = passages.join(used.select("answer_id", "id", "number"), ["answer_id", "id"], "left")
    order = Window.partitionBy("answer_id").orderBy(F.col("number").isNull(), "number", "rank")
    return rows.select("answer_id", F.row_number().over(order).alias("place"), "id", "number")


def verdicts(judged: DataFrame) -> DataFrame:
    """verdict, n, flagged over judged (verdict)."""
    return judged.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("flagged", F.col("verdict").isin("unsupported", "fabricated", "partial"))


def rate(part, whole):
    return F.round(F.try_divide(part, whole), 3)


def stance_split(labelled: DataFrame) -> DataFrame:
    """topic, n_support, n_against, newer: distinct papers on either side, and whether all against are newer; only topics with some against.

    A year of zero counts as unknown.
    """
    side = lambda s: F.col("stance") == s
    year = lambda s: F.when(side(s) & (F.col("year") != 0), F.col("year"))
    found = labelled.groupBy("topic").agg(
        F.count_distinct(F.when(side("supports"), F.col("paper"))).alias("n_support"),
        F.count_distinct(F.when(side("contradicts"), F.col("paper"))).alias("n_against"),
        F.max(year("supports")).alias("last_support"),
        F.min(year("contradicts")).alias("first_against"),
    )
    return found.where("n_against > 0").select("topic", "n_support", "n_against", F.coalesce(F.col("first_against") > F.col("last_support"), F.lit(False)).alias("newer"))


def first_per_title(rows: DataFrame) -> DataFrame:
    """title, pos, warning: the first row of each title that has a warning."""
    order = Window.partitionBy("title").orderBy("pos")
    return rows.where("warning is not null").withColumn("k", F.row_number().over(order)).where("k = 1").select("title", "pos", "warning")


def disagreements(labelled: DataFrame) -> DataFrame:
    """q, paper, claim, year: the first contradicting passage of each paper over labelled (q, rank, paper, year, stance, claim); year zero is none."""
    first = labelled.where("stance = 'contradicts'").groupBy("q", "paper").agg(F.min_by(F.struct("claim", "year"), "rank").alias("f"))
    return first.select("q", "paper", F.coalesce("f.claim", F.lit("")).alias("claim"), F.nullif("f.year", F.lit(0)).alias("year"))


def cautions(found: DataFrame) -> DataFrame:
    """q, block over found (q, rank, title, warning): a title's first warning each, in rank order, in words; no row where nothing is warned of."""
    first = found.where("warning is not null").groupBy("q", "title").agg(F.min(F.struct("rank", "warning")).alias("w"))
    told = first.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("w.rank", "title", "w.warning"))).alias("l"))
    line = F.transform("l", lambda x: F.concat(F.lit("- "), x["title"], F.lit(": "), x["warning"]))
    return told.select("q", F.concat(F.lit("CAUTIONS\n"), F.array_join(line, "\n"), F.lit("\n\n")).alias("block"))


def condensed(reply: Column, question: Column) -> Column:
    """The first line of a model's reply, without quotation marks around it all; the question itself where the reply is empty or missing."""
    said = F.regexp_replace(F.regexp_replace(reply, r"(?U)^\s+|\s+$", ""), '^"+|"+$', "")
    return F.coalesce(F.when(said != "", F.trim(F.regexp_extract(said, r"^[^\r\n]*", 0))), question)


def followups(reply: Column, most: int = 3) -> Column:
    """The first non-blank questions listed in a model's reply; none where there is no list."""
    texts = F.transform(listed(reply, "array<string>"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.slice(F.filter(texts, lambda x: x != ""), 1, most), F.array().cast("array<string>"))


def is_hit(source: Column, text: Column, paper: Column, contains: Column) -> Column:
    """Whether a passage is of the paper that a golden item names, by its file's stem, and holds one of the item's strings in any letter case."""
    return (stem(source) == paper) & F.exists(contains, lambda c: F.contains(F.lower(text), F.lower(c)))


def cites_evidence(spans: DataFrame, matches: DataFrame, golden: DataFrame) -> DataFrame:
    """answer_id, cited_expected_evidence: whether an answer cites a passage of the expected paper that holds an expected string.

    spans: answer_id, chunk_id; matches: answer_id, id, source, text; golden: answer_id, paper, contains.
    """
    hit = is_hit(F.col("source"), F.col("text"), F.col("paper"), F.col("contains"))
    cited = matches.join(spans.select("answer_id", F.col("chunk_id").alias("id")).distinct(), ["answer_id", "id"], "left_semi")
    good = cited.join(golden, "answer_id").where(hit).select("answer_id").distinct().withColumn("hit", F.lit(True))
    return golden.select("answer_id").join(good, "answer_id", "left").select("answer_id", F.coalesce("hit", F.lit(False)).alias("cited_expected_evidence"))


def last_question(messages: DataFrame) -> DataFrame:
    """conv_id, text: the last message that is not blank, of conversations where that is a user's."""
    told = messages.where(F.col("text").rlike(r"(?U)\S"))
    last = told.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m"))
    return last.where("m.role = 'user'").select("conv_id", "m.text")


def hits_by_kind(golden: DataFrame, results: DataFrame, k: int = 8) -> DataFrame:
    """kind, n, hits over golden (q, kind) and results (q, rank, hit); a null kind counts as other."""
    met = results.where("hit").where(F.col("rank") <= k).select("q").distinct().withColumn("met", F.lit(1))
    kind = F.coalesce("kind", F.lit("other")).alias("kind")
    return golden.select("q", kind).join(met, "q", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("met").alias("hits"))


def compared(report: DataFrame, base: DataFrame) -> DataFrame:
    """metric, base, value, delta: metrics (metric, value) that both reports have."""
    both = report.join(base.select("metric", F.col("value").alias("base")), "metric")
    return both.select("metric", "base", "value", F.round(F.col("value") - F.col("base"), 3).alias("delta"))


def retrieval_metrics(golden: DataFrame, results: DataFrame, k: int = 8) -> DataFrame:
    """One row: n, hits, recall, mrr over golden (q) and results (q, rank, hit)."""
    first = results.where("hit").where(F.col("rank") <= k).groupBy("q").agg(F.min("rank").alias("first"))
    return golden.select("q").join(first, "q", "left").agg(
        F.count("*").alias("n"),
        F.count("first").alias("hits"),
        F.round(F.count("first") / F.greatest(F.count("*"), F.lit(1)), 3).alias("recall"),
        F.round(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1)), 3).alias("mrr"),
    )


def merged_spans(spans: DataFrame) -> DataFrame:
    """key, start, end: spans (key, start, end, length) clamped to the text, empty ones dropped, touching ones joined."""
    fixed = spans.select("key", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end")).where("end > start")
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = fixed.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return island.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def history_window(messages: DataFrame, turns: int = 6, chars: int = 1500) -> DataFrame:
    """conv_id, history: the last turns of each conversation as labelled lines, long ones cut."""
    fine = messages.where(F.trim("text") != "")
    last = fine.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("k") <= turns)
    said = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    body = F.when(F.length(said) > chars, F.concat(F.substring(said, 1, chars), F.lit(" …"))).otherwise(said)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), body)
    rows = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history"))
