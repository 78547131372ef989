"""Entity candidates of a text by shape: acronyms, capitalised phrases, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions.text import WS

_TOKEN = fixed.PROPER_TOKEN_SHAPE
ACRONYM, IDENTIFIER = "(?U)" + fixed.ACRONYM_SHAPE, "(?U)" + fixed.IDENTIFIER_SHAPE
PROPER = rf"(?U)\b({_TOKEN}(?:[{WS}]+{_TOKEN}){{0,4}})\b"


def clean(term: Column) -> Column:
    """White space collapsed, punctuation at both ends gone."""
    return F.regexp_replace(F.regexp_replace(term, f"[{WS}]+", " "), r"""\A[ .,:;"'()\[\]{}]+|[ .,:;"'()\[\]{}]+\z""", "")


def _stop(token: Column) -> Column:
    return F.lower(token).isin(*fixed.STOPWORDS)


def _named(tokens: Column) -> Column:
    """The entity in a capitalised phrase, or null."""
    single = F.element_at(tokens, 1)
    alone = F.when(~_stop(single) & (F.length(single) >= 3) & single.rlike("[a-z]"), F.lower(single))
    first = F.array_position(F.transform(tokens, _stop), False).cast("int")
    rest = F.array_join(F.slice(tokens, F.greatest(first, F.lit(1)), F.size(tokens)), " ")
    return F.when(F.size(tokens) == 1, alone).when((first > 0) & (F.length(rest) >= 3), F.lower(rest))


def entity_set(text: Column) -> Column:
    """array<string>: distinct entities, lower-cased."""

    def found(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), clean)

    acronyms = F.transform(F.filter(found(ACRONYM), lambda t: F.length(t) >= 2), lambda t: F.lower(t))
    phrases = F.transform(F.filter(found(PROPER), lambda t: t != ""), lambda t: _named(F.split(t, " ")))
    identifiers = F.transform(F.filter(found(IDENTIFIER), lambda t: F.length(t) >= 4), lambda t: F.lower(t))
    return F.array_distinct(F.filter(F.concat(acronyms, phrases, identifiers), lambda t: t.isNotNull()))
