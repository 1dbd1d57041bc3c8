"""BM25 over the index tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.frames import any_equal
from lodestone.functions.text import field_length
from lodestone.operators.fuzzy import PROBES
from lodestone.operators.index import ID, prefix_map, vocabulary
from lodestone.settings import IndexSettings

K1 = 1.2
B = 0.75


def document_frequency(postings: DataFrame, settings: IndexSettings) -> DataFrame:
    """B1: distinct documents per index key, across fields; on prefix fields a word
    counts for each of its prefixes."""
    keys = prefix_map(vocabulary(postings), settings) if settings.prefix_fields else None
    rows = postings.select(F.col("term").alias("key"), ID) if keys is None else postings.join(keys, ["term", "field"]).select(F.col("prefix").alias("key"), ID)
    return rows.groupBy("key").agg(F.count_distinct(ID).alias("df"))


def inverse_frequency(n: Column, df: Column) -> Column:
    """B2: ln(N / df), 0 where either is 0."""
    return F.when((n > 0) & (df > 0), F.log(n / df)).otherwise(0.0)


def document_lengths(docs: DataFrame, settings: IndexSettings, id_col: str = ID) -> DataFrame:
    """Words over the searchable fields."""
    total = sum((field_length(docs, f) for f in settings.searchable_fields), F.lit(0))
    return docs.select(F.col(id_col).alias(ID), total.cast("long").alias("length"))


def bm25_score(tf: Column, idf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """B5."""
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.when(average > 0, length / average).otherwise(0.0))
    return idf * tf * F.lit(k1 + 1) / (tf + norm)


def _met(postings: DataFrame, settings: IndexSettings, tokens: list[str]) -> DataFrame:
    """Postings that a token reaches, with the token: its own in whole-word fields,
    those of longer words too in prefix fields. The tokens reach the scan."""
    wide = F.col("field").isin(list(settings.prefix_fields)) if settings.prefix_fields else None
    same = any_equal("term", tokens) if len(tokens) <= PROBES else F.col("term").isin(tokens)
    if wide is None:
        return postings.where(same).withColumn("token", F.col("term"))
    begins = reduce(lambda a, b: a | b, (F.col("term").startswith(t) for t in tokens), F.lit(False))
    reached = F.filter(F.array(*map(F.lit, tokens)), lambda t: (F.col("term") == t) | (wide & F.col("term").startswith(t)))
    return postings.where(begins).withColumn("token", F.explode(reached))


def bm25_scores(docs: DataFrame, postings: DataFrame, settings: IndexSettings, tokens: list[str], k1: float = K1, b: float = B, id_col: str = ID) -> DataFrame:
    """(documentID, token, bm25) for the given tokens; documents without a token are
    absent, which counts as 0. Term rows, corpus size and mean length (B4) are small
    and broadcast; documents meet postings once."""
    wide = list(settings.prefix_fields)
    met = _met(postings, settings, sorted(set(tokens)))
    weight = F.when(F.col("field").isin(wide), F.lit(1)).otherwise(F.col("tf")) if wide else F.col("tf")
    per_field = met.groupBy(ID, "token", "field").agg(F.max(weight).alias("w"))
    tf = per_field.groupBy(ID, "token").agg(F.sum("w").cast("double").alias("tf"))
    freq = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    lengths = document_lengths(docs, settings, id_col)
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))
    stats = F.broadcast(freq.crossJoin(corpus).select("token", inverse_frequency(F.col("n"), F.col("df")).alias("idf"), "average"))
    score = bm25_score(F.col("tf"), F.col("idf"), F.col("length"), F.col("average"), k1, b)
    return tf.join(lengths, ID).join(stats, "token").select(ID, "token", score.alias("bm25"))
