"""Inverted index as tables: postings, vocabulary, prefix map.

``postings(documentID, field, term, tf)`` holds whole words only. Prefix search is
derived from the vocabulary: ``prefix_map(prefix, field, term)`` lists every prefix
of every word of the prefix-enabled fields and the words themselves of the others,
which costs a row per vocabulary prefix instead of one per document and prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import field_tokens, prefixes
from lodestone.settings import IndexSettings

ID = "documentID"


def token_rows(docs: DataFrame, fields: tuple[str, ...] | list[str], id_col: str = ID) -> DataFrame:
    """(documentID, field, term) per token, all fields in one scan."""
    def tagged(field: str) -> Column:
        return F.transform(field_tokens(docs, field), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    pairs = [tagged(f) for f in fields]
    if not pairs:
        empty = F.array().cast("array<struct<field:string,term:string>>")
        return docs.select(F.col(id_col).alias(ID), F.explode(empty).alias("x")).select(ID, "x.field", "x.term")
    return docs.select(F.col(id_col).alias(ID), F.explode(F.concat(*pairs) if len(pairs) > 1 else pairs[0]).alias("x")).select(ID, "x.field", "x.term")


def build_postings(docs: DataFrame, settings: IndexSettings, id_col: str = ID) -> DataFrame:
    """Term frequency per document and field; combined in the map stage, so the
    shuffle carries postings, not tokens."""
    return token_rows(docs, settings.searchable_fields, id_col).groupBy(ID, "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """Distinct (term, field)."""
    return postings.select("term", "field").distinct()


def prefix_map(vocab: DataFrame, settings: IndexSettings) -> DataFrame:
    """(prefix, field, term): what a query token reaches by equality."""
    wide = F.col("field").isin(list(settings.prefix_fields)) if settings.prefix_fields else F.lit(False)
    return vocab.select("field", "term", F.explode(F.when(wide, prefixes(F.col("term"))).otherwise(F.array("term"))).alias("prefix"))


def dictionary(vocab: DataFrame, settings: IndexSettings) -> DataFrame:
    """Distinct index keys, prefixes included: what fuzzy search may match."""
    return prefix_map(vocab, settings).select(F.col("prefix").alias("term")).distinct()


def lookup_term(postings: DataFrame, settings: IndexSettings, term: str) -> DataFrame:
    """The posting list of an index key; prefix fields score 1. The key reaches
    the scan, as the words of prefix fields that begin with it do. Ordered by score,
    document and field (M6) only when it is shown."""
    reach = (F.col("term") == term) | (F.col("field").isin(list(settings.prefix_fields)) & F.col("term").startswith(term)) if settings.prefix_fields and term else F.col("term") == term
    found = postings.where(reach)
    wide = F.col("field").isin(list(settings.prefix_fields)) if settings.prefix_fields else F.lit(False)
    return found.groupBy(ID, "field").agg(F.max(F.when(wide, F.lit(1.0)).otherwise(F.col("tf").cast("double"))).alias("score"))


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by (term, documentID, field), new rows replace old ones."""
    keys = ["term", ID, "field"]
    return old.join(new.select(*keys), keys, "left_anti").select(*keys, "tf").unionByName(new.select(*keys, "tf"))


def replace_documents(old: DataFrame, ids: DataFrame, new: DataFrame | None) -> DataFrame:
    """Drop the rows of ``ids`` and add ``new`` ones."""
    kept = old.join(ids.select(ID).distinct(), ID, "left_anti")
    return kept if new is None else kept.unionByName(new, allowMissingColumns=True)


def last_version(docs: DataFrame, order: Column | None = None) -> DataFrame:
    """I4 within a batch: one row per documentID, the last by ``order``, and among
    equal ones (or without an order) the last in row order. The rank limit runs before
    the shuffle too."""
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    keys = [F.col("_place").desc()] if order is None else [order.desc_nulls_last(), F.col("_place").desc()]
    rank = F.row_number().over(Window.partitionBy(ID).orderBy(*keys))
    return placed.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_place")


def clean_documents(docs: DataFrame, id_col: str = ID) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Identifiers are trimmed of all white space and
    must be strings that are not blank; rejected rows carry a reason."""
    if id_col not in docs.columns or not isinstance(docs.schema[id_col].dataType, T.StringType):
        bad = docs.withColumn("reason", F.lit(f"{id_col} must be a string"))
        return docs.limit(0), bad
    trimmed = F.regexp_replace(F.col(id_col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    ok = F.col(id_col).isNotNull() & (trimmed != "")
    reason = F.when(F.col(id_col).isNull(), f"{id_col} is missing").otherwise(f"{id_col} is blank")
    return docs.where(ok).withColumn(id_col, trimmed), docs.where(~ok).withColumn("reason", reason)


def list_documents(docs: DataFrame, page: int, size: int) -> tuple[DataFrame, int]:
    """One page in identifier order, and the total."""
    return docs.orderBy(ID).offset((page - 1) * size).limit(size), docs.count()


def find_document(docs: DataFrame, ident: str) -> DataFrame:
    """The document of an identifier; the predicate reaches the scan."""
    return docs.where(F.col(ID) == ident).limit(1)
