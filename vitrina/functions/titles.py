"""Titles: cleaning for display and normalising for matching."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is removed from titles before matching. Words are looked for in lower case.
LANGUAGE_TAG = r"[\(\[]?\b(en\s+)?(espa[nñ]ol|ingl[eé]s|english|castellano)\b[\)\]]?"
EDITION_TAG = r"\b\d+[aª]?\s*(edici[oó]n|edition)\b|\b(edici[oó]n|edition)\b"
#: Phrases and words that shops append to titles.
NOISE_PHRASES = (
    r"juegos?\s+de\s+mesa|board\s+game|card\s+game|juego\s+de\s+cartas|juego\s+de\s+rol|rol\s+game|role[\-\s]?playing\s+game|rpg"
    r"|juego\s+familiar|juego\s+educativo|juego\s+cooperativo|juego\s+de\s+estrategia|party\s+game|juego\s+de\s+dados"
)
NOISE_WORDS = r"cooperativo|familiar|educativo|estrategia|competitivo|abstracto|party|dados|cartas|rol\b"
SEPARATORS = r"[\-\|,;:\s]"
LATIN = "A-Za-záéíóúüñÁÉÍÓÚÜÑ"
#: Letters that lose their accent, and what they become.
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûäëïöçãõåýÿªº", "aeiouunaeiouaeiouaeiocaoayyao"

#: Where noise stands, between separators, glued to a word, or at the end.
BOUNDED = rf"(?:^|(?<={SEPARATORS})){SEPARATORS}*(?:{NOISE_PHRASES})\s*[\-\|,;:]?"
GLUED = rf"(?<=[{LATIN}])(?:{NOISE_PHRASES})(?:\s*[\-\|,;:].*)?$"
TRAILING = rf"{SEPARATORS}+(?:{NOISE_WORDS})(?={SEPARATORS}|$)"


def clean_title(title: Column) -> Column:
    """A title without noise phrases, otherwise as written; null stays null."""
    text = F.regexp_replace(title, "(?iU)" + BOUNDED, " ")
    text = F.regexp_replace(text, "(?iU)" + GLUED, "")
    text = F.regexp_replace(text, "(?iU)" + TRAILING, "")
    return F.btrim(F.regexp_replace(text, r"(?U)\s{2,}", " "), F.lit(" -|,:;"))


def normalize_title(title: Column) -> Column:
    """Match key: lower case, no language or edition tags, no accents, no punctuation; null is "".

    Built-in functions only: exact for letters of the accent table; normalize_title_exact decomposes
    every character.
    """
    text = F.lower(F.coalesce(title, F.lit("")))
    text = F.regexp_replace(text, "(?iU)" + LANGUAGE_TAG, " ")
    text = F.regexp_replace(text, "(?iU)" + EDITION_TAG, " ")
    text = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[̀-ͯ]", "")
    text = F.regexp_replace(text, r"(?U)[^\w\s]|\p{M}|‍", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: str | None) -> str:
    """The exact rule for one title."""
    if text is None:
        return ""
    text = re.sub(LANGUAGE_TAG, " ", text.lower(), flags=re.I)
    text = re.sub(EDITION_TAG, " ", text, flags=re.I)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", text).split())


@F.pandas_udf(T.StringType())
def normalize_title_exact(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Match key with full compatibility decomposition (ligatures, full width, signs)."""
    for batch in titles:
        yield batch.map(normalize_text, na_action=None)
