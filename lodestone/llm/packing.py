"""Conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` words; full pieces fill a bin of
their own and the remainders are packed. Bins are ordered by residual; a piece
looks up the smallest residual that holds it and walks to the next larger one
until a bin is compatible: its source bitmap and its duplicate-cluster bitmap
must not yet hold the piece's bits. So no bin has two documents of one source or
of one duplicate cluster, and of the compatible bins the tightest is taken.

Remainders are dealt by identifier hash into blocks of about ``BLOCK`` documents,
which spreads a hot source and every large cluster; a block is packed by one task
in decreasing size (ties by identifier), so memory is bounded by the block.

Null texts and texts without words have no piece. A null source is a source of
its own. Without a cluster column, equal texts are a cluster. Repeated rows are
pieces of one cluster and land in different bins. Empty tables have no bins. The
table must have the source column (a column of nulls will do); others than the named
ones are not read, so they cannot clash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

CAPACITY = 2048
BLOCK = 2048


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each piece, in the given order. ``sources`` and ``clusters`` are
    small dense numbers; -1 conflicts with nothing."""
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has residual r
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own_source = 1 << source if source >= 0 else 0
        own_cluster = 1 << cluster if cluster >= 0 else 0
        ahead, base, chosen = filled >> size, size, -1
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            base += step
            for b in by_residual[base]:
                if not (source_bits[b] & own_source or cluster_bits[b] & own_cluster):
                    chosen = b
                    break
            if chosen >= 0:
                break
            ahead >>= step + 1
            base += 1
        if chosen < 0:
            chosen = len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
            left = capacity
        else:
            by_residual[base].remove(chosen)
            if not by_residual[base]:
                filled &= ~(1 << base)
            left = base
        source_bits[chosen] |= own_source
        cluster_bits[chosen] |= own_cluster
        by_residual[left - size].append(chosen)
        filled |= 1 << (left - size)
        out.append(chosen)
    return out


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "id", "cluster"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sources = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        clusters, seen = pd.factorize(pdf["cluster"], use_na_sentinel=False)
        # only clusters with two pieces here need a bit
        many = pdf.groupby(clusters).size()
        dense = {c: k for k, c in enumerate(many[many > 1].index)}
        bins = best_fit(pdf["n_words"].tolist(), sources.tolist(), [dense.get(c, -1) for c in clusters], capacity)
        pdf["bin"] = bins
        at = pdf.groupby("bin")["n_words"]
        pdf["bin_start"] = at.cumsum() - pdf["n_words"]
        pdf["bin_words"] = at.transform("sum")
        return pdf[["id", "piece", "first_word", "n_words", "source", "block", "bin", "bin_start", "bin_words"]]

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """Per piece: id column, piece, first_word, n_words, source, bin_id, bin_start
    (the piece's offset in its bin), bin_words (the bin's fill)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(text) if cluster_col is None else F.xxhash64(F.col(cluster_col))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), words.alias("words"))
    id_type = dict(sized.dtypes)["id"]
    # repeated rows are counted and numbered, so that they spread over the blocks too;
    # written once, since both kinds of pieces read it
    sized = materialize(sized.groupBy("id", "source", "cluster", "words").agg(F.count(F.lit(1)).alias("copies")), "lengths").where("words > 0")
    sized = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    blocks = max(1, math.ceil(docs.count() / block))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id", "cluster", "copy"), F.lit(blocks)).cast("int"))
    whole = F.floor(F.col("words") / capacity).cast("int")
    full = sized.where(whole > 0).select("id", "source", "cluster", "copy", "block", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select(
        F.col("id").alias(id_col), "piece", (F.col("piece") * capacity).alias("first_word"), F.lit(capacity).alias("n_words"), "source", F.concat_ws("-", F.lit("full"), "block", F.hex(F.xxhash64("id", "cluster", "copy")), "piece").alias("bin_id"), F.lit(0).alias("bin_start"), F.lit(capacity).alias("bin_words")
    )
    rest = sized.withColumns({"piece": whole, "first_word": whole * capacity, "n_words": F.col("words") - whole * capacity}).where("n_words > 0").select("id", "source", "cluster", "block", "piece", "first_word", "n_words")
    packed = rest.groupBy("block").applyInPandas(_packer(capacity), f"id {id_type}, piece int, first_word int, n_words int, source string, block int, bin int, bin_start int, bin_words int")
    packed = packed.select(F.col("id").alias(id_col), "piece", "first_word", "n_words", "source", F.concat_ws("-", F.lit("mixed"), "block", "bin").alias("bin_id"), "bin_start", "bin_words")
    return full.union(packed)
