"""Language identification by function words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from .text import judgeable

#: Frequent function words of each language that few others share.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "for", "with", "was", "are", "this", "by", "from"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "ein", "eine", "von", "auf", "den", "zu", "im"),
    "fr": ("le", "les", "et", "est", "une", "dans", "pour", "que", "du", "des", "qui", "sur", "pas", "au"),
    "es": ("el", "los", "las", "y", "del", "que", "por", "para", "con", "una", "un", "al", "se", "su"),
}


def votes(words: Column, code: str) -> Column:
    """How many of the words (in lower case, apart by blanks) are function words of the language."""
    return F.regexp_count(words, F.lit(rf"(?<!\S)(?:{'|'.join(FUNCTION_WORDS[code])})(?!\S)"))


def words_of(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\s]", " "))


def detect(df: DataFrame, text: str) -> DataFrame:
    """Adds language and confidence: null below the least confidence, or where no language may be told.

    The votes are columns of their own, so that the words are cut once.
    """
    out = df.withColumn("_words", words_of(F.col(text)))
    out = out.withColumns({f"_{c}": votes(F.col("_words"), c) for c in FUNCTION_WORDS} | {"_ok": judgeable(F.col(text))})
    counts = [F.col(f"_{c}") for c in FUNCTION_WORDS]
    most, total = F.greatest(*counts), sum(counts[1:], counts[0])
    out = out.withColumn("_share", F.round(F.coalesce(F.try_divide(most.cast("double"), total.cast("double")), F.lit(0.0)), 4))
    first = F.coalesce(*[F.when(F.col(f"_{c}") == most, F.lit(c)) for c in FUNCTION_WORDS])
    out = out.withColumn("language", F.when(F.col("_ok") & (F.col("_share") >= SETTINGS.lang_min_confidence), first))
    return out.withColumn("confidence", F.when(F.col("_ok"), F.col("_share")).otherwise(0.0)).drop("_words", "_ok", "_share", *[f"_{c}" for c in FUNCTION_WORDS])
