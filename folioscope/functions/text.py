"""Text expressions: tokens, labels, identifiers. All are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that Greek letters are indexed under.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ϵ": "epsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma",
    "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}


def tokens(text: Column) -> Column:
    """Lower-case word tokens; a Greek letter with a digit becomes one token, alone it becomes its name."""
    low = F.lower(text)
    spelled = low
    for glyph, name in GREEK.items():
        spelled = F.regexp_replace(spelled, f"{glyph}([0-9])", f" {name}$1 ")
        spelled = F.regexp_replace(spelled, glyph, f" {name} ")
    plain = F.when(low.rlike("[" + "".join(GREEK) + "]"), spelled).otherwise(low)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def norm_label(label: Column) -> Column:
    """A concept label without its bracketed part (kept if nothing else is left), lower-case, single blanks."""
    bare = F.trim(F.regexp_replace(label, r"\([^)]*\)", " "))
    chosen = F.when(bare == "", label).otherwise(bare)
    return F.trim(F.regexp_replace(F.lower(chosen), r"[^\p{L}\p{N}]+", " "))


def squash(text: Column) -> Column:
    """Lower-case ASCII letters and digits only, for matching across line breaks; ligatures and other compatibility forms are spelled out.

    Only texts beyond ASCII are handed to Arrow to be normalised.
    """
    spelled = nfkc()(F.when(text.rlike(r"[^\x00-\x7F]"), text))
    return F.regexp_replace(F.lower(F.coalesce(spelled, text)), "[^a-z0-9]", "")


#: Identifiers of both arXiv schemes, with a version.
ARXIV_ID = r"(?i)((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?)"
#: The identifier that is printed on a paper, that at the start of a file's name, a DOI, and arXiv's own DOIs.
PRINTED_ID, NAMED_ID = r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})", r"^(\d{4}\.\d{4,5})"
DOI, ARXIV_DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b", "10.48550"


def arxiv_id(text: Column) -> Column:
    """The first arXiv identifier of either scheme in a link, after `arXiv:` or bare, with its version if given; else null."""
    return F.nullif(F.regexp_extract(text, ARXIV_ID, 1), F.lit(""))


def stamped_arxiv_id(head: Column, name: Column) -> Column:
    """The identifier that a paper's opening pages name, else the one that its file's name starts with; without a version."""
    printed = F.nullif(F.regexp_extract(head, PRINTED_ID, 1), F.lit(""))
    return F.coalesce(printed, F.nullif(F.regexp_extract(name, NAMED_ID, 1), F.lit("")))


def doi(text: Column) -> Column:
    """The first DOI, without closing punctuation; null if there is none or it is an arXiv one."""
    found = F.regexp_extract(text, DOI, 1)
    return F.when((found != "") & ~found.contains(ARXIV_DOI), F.regexp_replace(found, r"[.,;)]+$", ""))


def nfkc():
    """An Arrow function string -> string: compatibility composition, which the engine has no expression for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return run


def body_of(text: Column) -> Column:
    """A passage without its header, if that is shorter than 200 characters."""
    cut = F.locate("\n\n", text)
    return F.when((cut > 0) & (cut <= 200), F.substring(text, cut + 2, F.length(text))).otherwise(text)


def stem(path: Column) -> Column:
    """A file's name without folders and the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
