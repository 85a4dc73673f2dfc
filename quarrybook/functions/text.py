"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKENIZER_VERSION = "1"
NORMALIZATION_VERSION = "1"
#: Unicode white space, as in a character class.
SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}]+(?:[-/][\p{L}\p{N}]+)*"
#: Words that are never index terms.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how in into is it its "
    "may might of on or than that the their there these they this those to was were what when where which "
    "while who whom why will with would"
).split()
#: Greek letters that answers spell out.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "τ": "tau", "ω": "omega"}


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; the only step of normalisation that Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def squash(text: Column) -> Column:
    """White space runs to one blank, none at the ends.

    Other white space becomes blanks first (printable ASCII is told apart by one comparison), then only runs of blanks are matched.
    """
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"[[^ -~]&&[{SPACE}]]+", " "), "  +", " "))


def normalize_text(text: Column) -> Column:
    """NFC, then :func:`squash`.  Only texts with a character from U+0300 on can change under NFC, so only those go through Python."""
    open_to_change = F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)
    return squash(F.coalesce(nfc(open_to_change), text))


def searchable_text(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit("\n"), abstract)


def content_hash(title: Column, abstract: Column) -> Column:
    """SHA-256 of the normalised title and abstract."""
    return F.sha2(searchable_text(title, abstract), 256)


def tokenize(text: Column) -> Column:
    """Index terms in order, with repeats.

    A compound (parts joined by - or /) gives its parts run together, then its
    parts; stop words are dropped except where run together.
    """

    def terms(word: Column) -> Column:
        together = F.translate(word, "-/", "")
        parts = F.filter(F.split(F.translate(word, "/", "-"), "-"), lambda p: ~p.isin(*STOPWORDS))
        compound = F.length(together) < F.length(word)
        return F.when(compound, F.concat(F.array(together), parts)).when(word.isin(*STOPWORDS), F.array().cast("array<string>")).otherwise(F.array(word))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), terms))


def word_set(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, for comparing questions."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))))


def normalize_folded(folded: Column) -> Column:
    """The rest of answer normalisation, for text that is already NFKC and case-folded."""
    for letter, name in GREEK.items():
        folded = F.replace(folded, F.lit(letter), F.lit(f" {name} "))
    folded = F.regexp_replace(F.regexp_replace(folded, "[-_/]+", " "), rf"[^\p{{L}}\p{{N}}\p{{M}}_{SPACE}]", " ")
    return F.regexp_replace(squash(folded), "^(the|a|an) ", "")


def normalize_answer(text: Column, exact: bool = True) -> Column:
    """Answers in comparable form; ``exact=False`` folds case without Python, which is equal for text in NFKC with no folding but ß."""
    return normalize_folded(nfkc_casefold(text) if exact else F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def display_text(text: Column) -> Column:
    """Without the source ids that a model wrote into its own text."""
    return F.trim(F.regexp_replace(text, r"\s*[(\[]\s*S\d+(?:\s*[,;/]\s*S\d+)*\s*[)\]]", ""))


def strip_fence(text: Column) -> Column:
    """The body of a fenced code block, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def pmid_from_url(url: Column) -> Column:
    """The id in either of the two forms of a reference address; null for anything else."""
    found = F.regexp_extract(F.trim(url), r"^https?://(?:www\.ncbi\.nlm\.nih\.gov/pubmed|pubmed\.ncbi\.nlm\.nih\.gov)/(\d+)/?$", 1)
    return F.nullif(found, F.lit(""))


def pmid_url(pmid: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))


def valid_pmid(pmid: Column) -> Column:
    return pmid.rlike("^[1-9][0-9]{0,9}$")
