"""Term predicates of the learned lexicons and keyword matching in page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _plausible(value: Column) -> Column:
    return F.length(value).between(3, 32) & value.rlike("[a-z]")


def valid_learned_term(c: Column) -> Column:
    """3 to 32 characters with a letter, and not a neutral URL word."""
    value = F.lower(c)
    return _plausible(value) & ~value.isin(K.NEUTRAL_URL_TERMS)


def valid_text_term(c: Column) -> Column:
    """As valid_learned_term for page text: no markup words, short plain words only if suspicious."""
    value = F.lower(c)
    short = value.rlike("^[a-z]{1,4}$") & ~value.isin(K.SUSPICIOUS_TEXT_KEYWORDS)
    return _plausible(value) & ~value.isin(K.LOW_INFORMATION_PAGE_TERMS) & ~short


def text_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda x: x != ""))


def is_word(term: Column) -> Column:
    """A term that can be found as one whole run of letters and digits."""
    return term.rlike("^[a-z0-9]+$")


def bounded_match(text: Column, term: Column) -> Column:
    """A phrase matches as substring; another term must not touch letters or digits."""
    pattern = F.concat(F.lit("(?<![a-z0-9])\\Q"), term, F.lit("\\E(?![a-z0-9])"))
    return F.when(F.contains(term, F.lit(" ")), F.contains(text, term)).otherwise(F.rlike(text, pattern))


def keywords_in(text: Column, words: Column, terms: list[str]) -> Column:
    """Sorted terms of a fixed list found in `text`; `words` is text_words(text)."""
    terms = [t.strip().lower() for t in terms]
    terms = sorted({t for t in terms if t and t not in K.LOW_INFORMATION_PAGE_TERMS})
    single = [t for t in terms if t.isascii() and t.isalnum()]
    other = [t for t in terms if t not in single]
    found = F.array_intersect(words, F.array(*[F.lit(t) for t in single]).cast("array<string>"))
    if other:
        found = F.concat(found, F.array_compact(F.array(*[
            F.when(bounded_match(text, F.lit(t)), F.lit(t)) for t in other])))
    return F.sort_array(found)
