"""Scalar text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    # single blanks stay, and are no match
    return F.trim(F.regexp_replace(text, r"\s(?:(?<! )|\s)\s*", " "))


def fingerprint(text: Column) -> Column:
    """Key under which texts that differ in case and white space alone are equal."""
    return F.lower(squeeze(text))


def sentences(text: Column) -> Column:
    """The text cut at white space that follows a full stop, an exclamation or a question mark."""
    # white space is looked for first, as what stands before it is looked at for every character otherwise
    return F.split(F.coalesce(text, F.lit("")), r"\s(?<=[.!?]\s)\s*", -1)


def pieces(text: Column, chars: int) -> Column:
    """The text in pieces of so many characters, the last one shorter; an empty text is one piece."""
    last = F.floor((F.length(text) - 1) / chars).cast("int")
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * chars + 1, F.lit(chars))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def tokens_by_words(text: Column) -> Column:
    """Token estimate: 1.3 for each word, truncated."""
    return (word_count(text) * F.lit(1.3)).cast("int")


def tokens_by_chars(text: Column, per_token: int = 4) -> Column:
    """Token estimate: a token for every few characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / per_token).cast("int")


def title_case(text: Column) -> Column:
    """Collapsed white space, every run of letters capitalised: co-op becomes Co-Op and 4th becomes 4Th."""
    parts = F.regexp_extract_all(squeeze(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def summary(text: Column, limit: int = 220) -> Column:
    """The text if it is short, else its first sentence, cut with an ellipsis if that is too long as well."""
    return summary_of(squeeze(text), limit)


def summary_of(clean: Column, limit: int = 220) -> Column:
    """summary() of a text that squeeze() has collapsed; as a column, that is worked out once."""
    first = F.get(sentences(clean), F.lit(0))
    return (
        F.when(F.length(clean) <= limit, clean)
        .when(F.length(first) <= limit, first)
        .otherwise(F.concat(F.rtrim(F.substring(first, 1, limit - 3)), F.lit("...")))
    )


def context_base(text: Column, low: Column, relations: Column) -> Column:
    """What a snippet's score has from its text alone: the relations that it names, and the penalty for a length far from 180; low is the text in lower case."""
    verbs = F.size(F.filter(relations, lambda r: F.contains(low, F.lower(r))))
    return F.struct(verbs.alias("verbs"), F.least(F.abs(F.length(text) - 180) / F.lit(180.0) * 0.5, F.lit(0.8)).alias("penalty"))


def context_total(base: Column, named: Column, others: Column) -> Column:
    """How well a snippet shows the use of a factor: that it names the factor, the other factors and relations that it names, less the penalty."""
    score = 1.0 + F.when(named, 1.0).otherwise(0.0) + F.lit(0.4) * others + F.lit(0.2) * base["verbs"] - base["penalty"]
    return F.round(F.greatest(score, F.lit(0.1)), 6)


def without_part(text: Column, original: Column) -> Column:
    """Chunk ids (@x_part3) replaced by the id of the whole."""
    return F.regexp_replace(text, F.lit(r"@.*?_part\d+"), F.concat(F.lit("@"), F.regexp_replace(original, r"([\\$])", r"\\$1")))


def without_fences(text: Column) -> Column:
    """Without a markdown fence at either end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", ""))


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))
