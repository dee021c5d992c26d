"""Text expressions: words, search tokens, answer normalisation, numbers, sentences and question terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
WORD = r"[^\s\p{Z}]+"
TOKEN = r"[\p{L}\p{N}_]+"
NUMBER = r"(?<![A-Za-z0-9_.])(\d+(?:,\d{3})*(?:\.\d+)?)(?![0-9])"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "for", "to", "is", "are", "was", "were", "be", "been", "do", "does", "did", "what", "which", "who", "whom",
    "whose", "when", "where", "why", "how", "that", "this", "these", "those", "it", "its", "they", "their", "them", "with", "by", "as", "at", "from",
    "and", "or", "not", "can", "could", "would", "should", "will", "have", "has", "had", "than", "there", "paper", "authors", "author", "used",
    "use", "using", "also", "such", "only", "other", "some", "any", "each", "many", "much", "few", "more", "most", "very", "both", "over", "into",
    "then", "about", "between", "during", "after", "before", "under", "again", "further", "here", "while", "through", "above", "below", "just",
    "now", "same", "own", "too", "but", "all", "one", "two", "may", "might", "must", "shall", "being", "else", "however", "thus", "therefore",
    "since", "because", "although", "whether", "show", "shown", "shows", "given", "based", "make", "made", "like", "well", "first", "second", "new",
    "different", "several", "various", "often", "relate", "related", "within", "without", "across", "around", "per",
)


def normalised(text: Column) -> Column:
    """CR and CRLF as LF, outer white space gone."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Words with the white space after them, so that joining them gives the text back."""
    return F.regexp_extract_all(text, F.lit(WORD + r"[\s\p{Z}]*"), F.lit(0))


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def answer_words(text: Column) -> Column:
    """Words of an answer: lower case, no ASCII punctuation, no articles."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.filter(F.split(F.trim(bare), r"\s+"), lambda w: ~w.isin("a", "an", "the") & (w != ""))


def numbers(text: Column) -> Column:
    """Canonical forms of the numbers in a text: no thousands separators, no needless zeros."""
    def canonical(x: Column) -> Column:
        x = F.replace(x, F.lit(","), F.lit(""))
        x = F.regexp_replace(x, r"(\.\d*?)0+$", "$1")
        x = F.regexp_replace(x, r"\.$", "")
        return F.regexp_replace(x, r"^0+(?=\d)", "")

    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), canonical)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def content_tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more that are not stopwords."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def key_terms(question: Column) -> Column:
    found = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def stem(word: Column) -> Column:
    out = word
    for suffix in ("s", "es", "ed", "ing"):
        cut = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        out = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 4), cut).otherwise(out)
    return out


def has_cue(text: Column, cues: list[str] | tuple[str, ...]) -> Column:
    """Whether a cue stands in the text with no word character on either side."""
    return text.rlike(r"(?<!\w)(" + "|".join(c.replace(".", r"\.") for c in cues) + r")(?!\w)")


def rounded(x: Column) -> Column:
    return F.round(x, 6)


def exact_mean(x: Column) -> Column:
    """The mean to six places of figures of up to twelve, added up as decimals: halves are rounded as they are, not as binary sums turn out."""
    exact = x.try_cast("decimal(38,12)")
    return F.when(F.count(exact) == F.count(x), F.round(F.avg(exact), 6).cast("double")).otherwise(rounded(F.avg(x)))
