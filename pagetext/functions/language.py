"""L1-L3: language heuristic and language-list resolution as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker tokens (with both blanks) and marker letters of the heuristic.
ID_TOKENS = (" yang ", " tidak ", " kamu ", " saya ", " untuk ", " dengan ")
EN_TOKENS = (" the ", " and ", " with ", " from ", " this ", " that ")
ID_CHARS = "khsyaiu"
EN_CHARS = "thearoin"

# Language-list resolution.
AUTO_TOKENS = ("auto", "detect", "auto-detect", "auto_detect")
LATIN_ALIASES = ("en", "english", "id", "indonesian", "latin", "latin-script", "mix")
ENGINE_LANGUAGE = {
    "en": "en", "english": "en", "latin": "en", "latin-script": "en", "mix": "en",
    "id": "en", "indonesian": "en", "multi": "multilingual", "multilingual": "multilingual",
    "ar": "arabic", "arabic": "arabic", "ru": "cyrillic", "russian": "cyrillic",
}

# Detector codes mapped to the two supported languages.
DETECTOR_CODES = {"en": "en", "eng": "en", "id": "id", "ind": "id",
                  "ms": "id", "msa": "id", "jv": "id", "jw": "id"}


def strip_ws(s: Column) -> Column:
    """Python-style strip() of ASCII whitespace."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _count_sub(s: Column, token: str) -> Column:
    # non-overlapping occurrences, as str.count
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))) / len(token))


def _count_chars(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.translate(s, chars, ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def language_heuristic(text: Column, default: str = "mix") -> Column:
    """L1: token/letter scores on stripped, lower-cased text."""
    def scores(s: Column) -> Column:
        score = lambda tokens, chars: sum((_count_sub(s, t) for t in tokens), F.lit(0)) * 5 + _count_chars(s, chars)
        return F.struct((s == "").alias("blank"), score(ID_TOKENS, ID_CHARS).alias("id"), score(EN_TOKENS, EN_CHARS).alias("en"))

    def chosen(x: Column) -> Column:
        return (F.when(x["blank"], F.lit(default))
                .when((x["id"] == 0) & (x["en"] == 0), F.lit(default))
                .when(F.abs(x["id"] - x["en"]) <= 2, F.lit("mix"))
                .when(x["id"] > x["en"], F.lit("id"))
                .otherwise(F.lit("en")))
    return F.when(text.isNull(), F.lit(default)).otherwise(_once(_once(F.lower(strip_ws(text)), scores), chosen))


def _map_lookup(mapping: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, key)


def resolve_engine_language(languages: Column) -> Column:
    """L2: language list -> engine language code."""
    normalized = F.filter(F.transform(F.filter(languages, lambda x: x.isNotNull() & (x != "")),
                                      lambda x: F.trim(F.lower(x))),
                          lambda x: ~x.isin(*AUTO_TOKENS))
    unique = F.array_distinct(normalized)
    latin = F.array(*[F.lit(x) for x in LATIN_ALIASES])
    first = F.get(normalized, 0)
    return (F.when(languages.isNull() | (F.size(normalized) == 0), F.lit("en"))
            .when(F.size(unique) > 1,
                  F.when(F.size(F.array_except(unique, latin)) == 0, F.lit("en"))
                  .otherwise(F.lit("multilingual")))
            .otherwise(F.coalesce(_map_lookup(ENGINE_LANGUAGE, first), first)))


def primary_language(languages: Column) -> Column:
    """L3: first configured language, 'en' when none."""
    return F.coalesce(F.get(languages, 0), F.lit("en"))


def languages_str(languages: Column) -> Column:
    return F.array_join(languages, ",")


def detector_code(code: Column) -> Column:
    """Map a detector language code to 'en' / 'id' (NULL when unsupported)."""
    return _map_lookup(DETECTOR_CODES, code)
