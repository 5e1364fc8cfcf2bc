"""Text as Catalyst expressions: tokens, shingles, word n-grams, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = sorted(
    """about above after again all also an and any are as at be because been before being below between both but by
    can could did do does during each every few for from further had has have her here his how if in into is it its
    just may might more most my no nor not of on once only or other our out own same shall should so some such than
    that the their then there these this those through to too under up very was were what when where which who whom
    will with would your a""".split()
)
#: Unicode words: letters with marks joined by mid-letter signs, digits joined by mid-number signs, connectors.
WORD = r"(?:\p{L}\p{M}*(?:['’.:·]\p{L}\p{M}*)*|\p{N}(?:['’.,;]\p{N})*|_)+"

#: The same words in lower-case text, with runs of plain letters taken at once and nothing tried again.
JAVA_WORD = r"(?:[a-z]++\p{M}*+(?:['’.:·]\p{L}\p{M}*+)*+|\p{L}\p{M}*+(?:['’.:·]\p{L}\p{M}*+)*+|\p{N}(?:['’.,;]\p{N})*+|_)++"


def _s(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, even where f uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def is_term(word: Column) -> Column:
    """Two bytes or more, not of underscores alone, not a stop word."""
    return (F.octet_length(word) >= 2) & (F.replace(word, F.lit("_"), F.lit("")) != "") & ~word.isin(STOPWORDS)


def raw_words(c) -> Column:
    return F.regexp_extract_all(F.lower(_s(c)), F.lit(JAVA_WORD), F.lit(0))


def tokens(c) -> Column:
    """Lower-case terms in text order, repeats kept; null gives none."""
    return F.filter(raw_words(c), is_term)


def shingles(c, n: int) -> Column:
    """Character n-grams in lower case; a shorter text is its own only one."""

    def cut(low):
        return F.when(F.char_length(low) < n, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(low) - (n - 1)), lambda i: F.substr(low, i, F.lit(n))))

    return let(F.lower(_s(c)), cut)


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a blank; fewer words are one run."""

    def runs(w):
        return F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))

    return let(words, runs)


def slugify(c) -> Column:
    """Lower case, each run of other signs than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_s(c)), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-|-$", "")


def capitalize(c) -> Column:
    """First letter upper, the rest as it is."""
    return F.concat(F.upper(F.substring(_s(c), 1, 1)), F.substr(_s(c), F.lit(2)))
