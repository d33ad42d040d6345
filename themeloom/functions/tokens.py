"""From text to word forms, one article per row.

An article is one row, and its words are cut and picked inside that row. None
of these expressions needs a shuffle.
"""

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where text is cut, and which lemmas are kept.
WORD_BREAK = r"\W+"
ONLY_LETTERS = "^[a-z]+$"
MIN_LENGTH = 3

# Whole words that pass the two rules above, in lower-case text.
KEPT_WORD = r"(?<!\w)[a-z]{3,}+(?!\w)"


def word_forms(text: Column) -> Column:
    """Lower case, cut at every run of non-word characters."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK)


def kept_words(text: Column) -> Column:
    """The words that pass the rules for lemmas themselves, picked by one pattern."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(KEPT_WORD), F.lit(0))


def is_kept_word(word: str) -> bool:
    return re.fullmatch(KEPT_WORD, word) is not None


def plain_text(text: Column) -> Column:
    """The word forms joined again by single spaces."""
    return F.array_join(word_forms(text), " ")


def is_kept(lemma: Column, stop_words: Sequence[str] = ()) -> Column:
    """Long enough, letters only, and not a stop word."""
    kept = (F.length(lemma) >= MIN_LENGTH) & lemma.rlike(ONLY_LETTERS)
    return kept & ~lemma.isin(list(stop_words)) if stop_words else kept


def keep(lemmas: Column, stop_words: Sequence[str] = ()) -> Column:
    return F.filter(lemmas, lambda lemma: is_kept(lemma, stop_words))
