"""Language codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes with their English names; names and spellings that stand for a code.
LANGUAGES = {
    "es": "Spanish", "en": "English", "pt": "Portuguese", "pt-br": "Brazilian Portuguese", "fr": "French", "de": "German", "it": "Italian", "ca": "Catalan", "gl": "Galician", "eu": "Basque",
    "nl": "Dutch", "pl": "Polish", "ru": "Russian", "uk": "Ukrainian", "ja": "Japanese", "ko": "Korean", "zh": "Simplified Chinese", "zh-tw": "Traditional Chinese", "ar": "Arabic", "tr": "Turkish",
    "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish", "el": "Greek", "he": "Hebrew", "hi": "Hindi", "ro": "Romanian", "cs": "Czech", "hu": "Hungarian",
}
ALIASES = {
    "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "english": "en", "inglés": "en", "ingles": "en", "portuguese": "pt", "portugués": "pt", "portugues": "pt",
    "french": "fr", "francés": "fr", "frances": "fr", "german": "de", "alemán": "de", "aleman": "de", "italian": "it", "italiano": "it",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def resolved(value: Column) -> tuple[Column, Column]:
    """(code, name): a code, an alias, a region of a known language, else a free name."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    key = F.replace(F.lower(raw), F.lit("_"), F.lit("-"))
    base = F.split(key, "-")[0]
    alias = _lookup(ALIASES, key)
    code = F.when(_lookup(LANGUAGES, key).isNotNull(), key).when(alias.isNotNull(), alias).when(_lookup(LANGUAGES, base).isNotNull(), key).otherwise(F.coalesce(F.nullif(F.substring(base, 1, 8), F.lit("")), F.lit("und")))
    name = F.coalesce(_lookup(LANGUAGES, key), _lookup(LANGUAGES, alias), _lookup(LANGUAGES, base), raw)
    return code, name
