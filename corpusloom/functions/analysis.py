"""Text analysis by language: words, stop words, stems."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem
from corpusloom.functions.text import let, words

LANGUAGES = {"en": "english", "de": "german"}
#: Endings that a word tokeniser parts from English words; they hold an apostrophe or are its halves.
_CLITIC = r"(?iU)(n['’]t|['’](?:s|m|d|ll|re|ve))\b"


@lru_cache
def stop_words(language: str) -> tuple[str, ...]:
    """Stop words of a language, in lower case; needs an active session."""
    return tuple(w.lower() for w in StopWordsRemover.loadDefaultStopWords(LANGUAGES[language]))


def _check(language: str) -> None:
    if language not in LANGUAGES:
        raise ValueError(f"Unsupported language: {language!r}; there are {', '.join(sorted(LANGUAGES))}")


def alphabetic_words(text: Column, language: str) -> Column:
    """Lower-case words made of letters only, in order, with repeats.

    Clitics are parted from English words first. What is glued to a digit, a hyphen or
    an underscore isn't a word of letters and is left out.
    """
    _check(language)
    lower = F.lower(text)
    if language == "en":
        lower = let(lower, lambda x: F.when(x.contains("'") | x.contains("’"), F.regexp_replace(x, _CLITIC, " ")).otherwise(x))  # looking for the pattern takes far longer
    found = F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{M}\p{N}_]+(?:[-'’][\p{L}\p{M}\p{N}_]+)*"), F.lit(0))
    return F.filter(found, lambda w: w.rlike(r"^\p{L}+$"))


def content_words(text: Column, language: str) -> Column:
    return F.filter(alphabetic_words(text, language), lambda w: ~w.isin(*stop_words(language)))


def tokens(text: Column, language: str, stemmer: str | None = None) -> Column:
    """Stems of the content words. Other languages than en and de are an error, and so are other spellings of these."""
    _check(language)
    return stem(content_words(text, language), stemmer or LANGUAGES[language])


def index_tokens(text: Column, language: str) -> Column:
    """What the retrieval index holds: in English by the Porter stemmer, in German by the Snowball one."""
    return tokens(text, language, {"en": "porter", "de": "german"}.get(language, language))


def tokens_by_language(text: Column, language: Column) -> Column:
    """``index_tokens`` where a row's language has an analysis, words elsewhere. Each text is analysed in its language only."""
    return F.coalesce(*[index_tokens(F.when(language == x, text), x) for x in LANGUAGES], words(text))


def query_text(query: Column, language: str) -> Column:
    return F.array_join(index_tokens(query, language), " ")
