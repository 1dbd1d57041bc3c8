"""Text analysis as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the token rules: camel-case boundaries, separators, blanks.
ACRONYM_END = r"([A-Z]+)([A-Z][a-z])"
CAMEL = r"([a-z0-9])([A-Z])"
SEPARATOR = r"[^a-z0-9]+"
BLANK = r"[ \t\r\n]+"


def tokenize(text: Column) -> Column:
    """Camel-case boundaries split, lower case, runs of ASCII letters and digits.
    T8: U+0130 lowers to a plain i. Null has no tokens."""
    parted = F.regexp_replace(F.regexp_replace(text, ACRONYM_END, "$1 $2"), CAMEL, "$1 $2")
    lowered = F.lower(F.translate(parted, "İ", "i"))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATOR), ""), F.array().cast("array<string>"))


def tokenize_text(text: str) -> list[str]:
    """T1 on the driver, for query strings."""
    parted = re.sub(CAMEL, r"\1 \2", re.sub(ACRONYM_END, r"\1 \2", text))
    return [t for t in re.split(SEPARATOR, parted.replace("İ", "i").lower()) if t]


def prefixes(token: Column) -> Column:
    """Every prefix of a token, shortest first; none for an empty token."""
    return F.when(F.length(token) > 0, F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(token, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def prefix_ngrams(text: Column) -> Column:
    """Each token followed by its prefixes, first occurrences over the field."""
    return F.array_distinct(F.flatten(F.transform(tokenize(text), lambda t: F.concat(F.array(t), prefixes(t)))))


def field_text(df: DataFrame, field: str) -> Column | None:
    """T5: the text of a field; string arrays are joined by a blank. Fields of any
    other type, and missing fields, have none."""
    kind = dict(zip(df.columns, (f.dataType for f in df.schema.fields), strict=True)).get(field)
    if isinstance(kind, T.StringType):
        return F.col(f"`{field}`")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.when(F.col(f"`{field}`").isNotNull(), F.concat_ws(" ", F.col(f"`{field}`")))
    return None


def field_tokens(df: DataFrame, field: str, prefix: bool = False) -> Column:
    """T4: prefix fields are analysed with prefixes, others into whole words."""
    text = field_text(df, field)
    if text is None:
        return F.array().cast("array<string>")
    return prefix_ngrams(text) if prefix else tokenize(text)


def field_length(df: DataFrame, field: str) -> Column:
    """Words separated by blank, tab, CR or LF; 0 where there is no text."""
    text = field_text(df, field)
    if text is None:
        return F.lit(0)
    return F.coalesce(F.size(F.array_remove(F.split(text, BLANK), "")), F.lit(0))


def search_type(query: Column, has_filters: Column) -> Column:
    """Q25: the class of a search for analytics."""
    return (
        F.when(has_filters | (query == ""), "filtered")
        .when(query.contains("*") | query.contains("?"), "wildcard")
        .when((F.size(F.array_remove(F.split(query, r"\s+"), "")) == 1) & (F.octet_length(query) > 3), "fuzzy_search")
        .otherwise("exact_match")
    )


def search_type_of(query: str, has_filters: bool) -> str:
    """Q25 on the driver, for the event of a search."""
    if has_filters or query == "":
        return "filtered"
    if "*" in query or "?" in query:
        return "wildcard"
    words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", query) if w]
    return "fuzzy_search" if len(words) == 1 and len(query.encode("utf-8")) > 3 else "exact_match"
